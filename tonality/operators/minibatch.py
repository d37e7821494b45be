"""Mini-batch training of the classifier with durable state (M2b, M3), several class-weight sets at once (M4).

Rows are dealt into seeded shards that are shuffled anew in each epoch. A task trains every parameter set on its shard in Adam steps of
32 rows; the shards' parameters and moments are averaged by their rows. One shard is plain mini-batch
training. All sets share the passes: an epoch is one training job and one validation job, however many sets
there are, and sets that stopped early are left out.

After each epoch the state of all sets is committed as one Parquet file below ``state_path``. A run that broke off goes on
from the last committed epoch when it is started again with the same arguments.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonality.operators.fuse import arrow_matrix, check_broadcast
from tonality.operators.model import GRAD_CHUNK, GRAD_LANES, ReluClassifier, softmax_rows, weighted_ce_grad
from tonality.operators.split import hash_order
from tonality.session import drop_scratch, materialize, ship_package

BETA1, BETA2, EPS = 0.9, 0.999, 1e-8  # fixed values: Adam's usual constants
STATE = ("run_id string, theta array<double>, m array<double>, v array<double>, t double, best_theta array<double>, best_loss double, "
         "best_epoch int, bad int, stopped boolean, train_losses array<double>, val_losses array<double>")


@dataclass
class Run:
    """One parameter set: current parameters, Adam moments and steps, the best epoch's parameters, the losses so far."""

    run_id: str
    theta: np.ndarray
    m: np.ndarray
    v: np.ndarray
    t: float
    best_theta: np.ndarray
    best_loss: float = float("inf")
    best_epoch: int = 0
    bad: int = 0
    stopped: bool = False
    train_losses: list[float] = field(default_factory=list)
    val_losses: list[float] = field(default_factory=list)

    @staticmethod
    def fresh(run_id: str, theta: np.ndarray) -> Run:
        return Run(run_id, theta.copy(), np.zeros_like(theta), np.zeros_like(theta), 0.0, theta.copy())

    def row(self) -> tuple:
        lists = [x.tolist() for x in (self.theta, self.m, self.v)]
        return (self.run_id, *lists, self.t, self.best_theta.tolist(), self.best_loss, self.best_epoch, self.bad, self.stopped,
                self.train_losses, self.val_losses)

    @staticmethod
    def of(row) -> Run:
        arrays = {k: np.array(row[k], dtype=float) for k in ("theta", "m", "v", "best_theta")}
        rest = {k: row[k] for k in ("run_id", "t", "best_loss", "best_epoch", "bad", "stopped")}
        return Run(**arrays, **rest, train_losses=list(row["train_losses"]), val_losses=list(row["val_losses"]))


def commit(spark: SparkSession, state_path: str, epoch: int, runs: list[Run]) -> None:
    """The state after ``epoch`` as one file: its rename into place is the commit."""
    spark.createDataFrame([r.row() for r in runs], STATE).coalesce(1).write.mode("overwrite").parquet(f"{state_path}/epoch={epoch}")


def last_state(spark: SparkSession, state_path: str) -> tuple[int, list[Run]]:
    """The last committed epoch and its runs; epoch 0 and none if there is no state yet."""
    try:
        state = spark.read.schema(STATE + ", epoch int").parquet(state_path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0, []
    newest = state.agg(F.max("epoch")).first()[0] or 0
    return newest, [Run.of(r) for r in state.where(F.col("epoch") == newest).orderBy("run_id").collect()]


def _weighted_sums(parts: DataFrame, runs: int, size: int) -> np.ndarray:
    """Rows ``run, chunk, lane, g`` added up over tasks: a matrix of ``runs`` x ``size``."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    for by in (["run", "chunk", "lane"], ["run", "chunk"]):
        parts = parts.groupBy(*by).agg(vector_to_array(Summarizer.sum(array_to_vector("g"))).alias("g"))
    out = np.zeros((runs, size))
    for r in parts.collect():
        out[r["run"], r["chunk"] * GRAD_CHUNK:r["chunk"] * GRAD_CHUNK + len(r["g"])] = r["g"]
    return out


def _chunks(run: int, values: np.ndarray):
    import pyarrow as pa

    n = -(-len(values) // GRAD_CHUNK)
    offsets = np.minimum(np.arange(n + 1) * GRAD_CHUNK, len(values)).astype(np.int32)
    lane = TaskContext.get().partitionId() % GRAD_LANES
    cols = [np.full(n, run, np.int32), np.arange(n, dtype=np.int32), np.full(n, lane, np.int32)]
    return pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))],
                                      names=["run", "chunk", "lane", "g"])


def _rows(batch, d_in: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and weights (rows x sets) of an Arrow batch."""
    X, _ = arrow_matrix(batch.column("x"), d_in)
    y = batch.column("y").to_numpy(zero_copy_only=False).astype(np.int64)
    w = np.nan_to_num(np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in batch.schema.names if c[0] == "w"], axis=1))
    return X, y, w


def _train_epoch(rows: DataFrame, model: ReluClassifier, runs: list[Run], d_in: int, shards: int, batch_rows: int, lr: float, order_seed: int) -> None:
    """One epoch for all ``runs`` in one job; their parameters, moments, steps and training losses are updated."""
    spark = rows.sparkSession
    size = len(runs[0].theta)
    shared = spark.sparkContext.broadcast((model, [(r.theta, r.m, r.v, r.t) for r in runs]))

    def train(batches: Iterator) -> Iterator:
        start_model, starts = shared.value
        shard, held, states, losses, steps, seen = None, None, None, None, 0, 0

        def step(X: np.ndarray, y: np.ndarray, w: np.ndarray) -> None:
            nonlocal steps, seen
            for i, (theta, m, v, t) in enumerate(states):
                total = w[:, i].sum()
                if total <= 0:  # no row of the batch has a weight in this set
                    continue
                loss, g = weighted_ce_grad(start_model.with_flat(theta), X, y, w[:, i])
                g = g / total
                t += 1
                m = BETA1 * m + (1 - BETA1) * g
                v = BETA2 * v + (1 - BETA2) * g * g
                theta = theta - lr * (m / (1 - BETA1 ** t)) / (np.sqrt(v / (1 - BETA2 ** t)) + EPS)
                states[i] = (theta, m, v, t)
                losses[i] += loss / total
            steps += 1
            seen += len(y)

        def finish() -> Iterator:
            if len(held[1]):
                step(*held)
            for i, (theta, m, v, t) in enumerate(states):
                yield _chunks(i, np.concatenate([seen * np.concatenate([theta, m, v, [t]]), [seen, losses[i], steps]]))

        for b in batches:
            of = b.column("shard").to_numpy(zero_copy_only=False)
            X, y, w = _rows(b, d_in)
            cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                if of[lo] != shard:
                    if shard is not None:
                        yield from finish()
                    shard, states, losses, steps, seen = of[lo], list(starts), np.zeros(len(starts)), 0, 0
                    held = (X[:0], y[:0], w[:0])
                held = tuple(np.concatenate([a, c[lo:hi]]) for a, c in zip(held, (X, y, w)))
                full = len(held[1]) // batch_rows * batch_rows
                for k in range(0, full, batch_rows):
                    step(*(a[k:k + batch_rows] for a in held))
                held = tuple(a[full:] for a in held)
        if shard is not None:
            yield from finish()

    dealt = rows.where("split = 'train'").withColumn("h", hash_order("key", order_seed)).withColumn("shard", F.pmod(F.xxhash64("h"), F.lit(shards)))
    dealt = dealt.repartition("shard").sortWithinPartitions("shard", "h", "key").drop("h", "key", "split")
    sums = _weighted_sums(dealt.mapInArrow(train, "run int, chunk int, lane int, g array<double>"), len(runs), 3 * size + 4)
    shared.destroy()
    for r, s in zip(runs, sums):
        seen, loss, steps = s[-3:]
        if seen <= 0:
            raise ValueError("no training rows")
        r.theta, r.m, r.v = (s[k * size:(k + 1) * size] / seen for k in range(3))
        r.t = float(s[3 * size] / seen)
        r.train_losses.append(float(loss / steps))


def _validate(rows: DataFrame, model: ReluClassifier, runs: list[Run], d_in: int) -> list[float | None]:
    """Weighted mean loss of every run over the validation rows, in one job; none without such rows."""
    shared = rows.sparkSession.sparkContext.broadcast([model.with_flat(r.theta) for r in runs])

    def losses(batches: Iterator) -> Iterator:
        total = np.zeros((len(shared.value), 2))
        for b in batches:
            X, y, w = _rows(b, d_in)
            for i, m in enumerate(shared.value):
                P = softmax_rows(m.logits(X))
                total[i] += (w[:, i] * -np.log(np.maximum(P[np.arange(len(y)), y], 1e-300))).sum(), w[:, i].sum()
        for i, values in enumerate(total):
            yield _chunks(i, values)
    val = rows.where("split = 'val'").drop("key", "split")
    sums = _weighted_sums(val.mapInArrow(losses, "run int, chunk int, lane int, g array<double>"), len(runs), 2)
    shared.destroy()
    return [float(a / b) if b > 0 else None for a, b in sums]


def fit_minibatches(feats: DataFrame, key: str, weight_sets: dict[str, list[float]], start: ReluClassifier, state_path: str,
                    features: str = "features", label: str = "label", split_col: str = "split", batch_rows: int = 32, shards: int = 1,
                    epochs: int = 50, patience: int = 5, lr: float = 1e-3, seed: int = 42, stop_after: int | None = None) -> list[Run]:
    """Train one classifier per set of class weights, each from ``start``, until ``patience`` epochs bring no lower validation
    loss (without validation rows: training loss) or ``epochs`` are done; returns the runs by name.

    ``feats`` holds a unique ``key``, ``features array<double>``, ``label`` and ``split_col`` (train, val; other rows
    are left out). ``stop_after`` ends this call after so many epochs of its own, as an interruption would.
    """
    spark = feats.sparkSession
    ship_package(spark)
    check_broadcast([start.fc1, start.fc2])
    done, runs = last_state(spark, state_path)
    if runs and [r.run_id for r in runs] != sorted(weight_sets):
        raise ValueError(f"{state_path} holds the state of other runs")
    runs = runs or [Run.fresh(name, start.flat()) for name in sorted(weight_sets)]
    if done >= epochs or all(r.stopped for r in runs):
        return runs
    weights = [F.element_at(F.array(*[F.lit(float(w)) for w in weight_sets[r.run_id]]), (F.col(label) + 1).cast("int")) for r in runs]
    rows = materialize(feats.where(F.col(split_col).isin("train", "val")).select(
        F.col(key).cast("string").alias("key"), F.col(split_col).alias("split"), F.col(features).cast("array<double>").alias("x"),
        F.col(label).cast("int").alias("y"), *[w.alias(f"w{i}") for i, w in enumerate(weights)]), "minibatch-rows")
    last = epochs if stop_after is None else min(epochs, done + stop_after)
    d_in = start.fc1.d_in
    for epoch in range(done + 1, last + 1):
        active = [i for i, r in enumerate(runs) if not r.stopped]
        if not active:
            break
        of_active = [runs[i] for i in active]
        part = rows.select("key", "split", "x", "y", *[f"w{i}" for i in active])
        _train_epoch(part, start, of_active, d_in, shards, batch_rows, lr, seed + epoch)
        for r, val in zip(of_active, _validate(part, start, of_active, d_in)):
            r.val_losses.append(r.train_losses[-1] if val is None else val)
            if r.val_losses[-1] < r.best_loss:
                r.best_theta, r.best_loss, r.best_epoch, r.bad = r.theta, r.val_losses[-1], epoch, 0
            else:
                r.bad += 1
                r.stopped = r.bad >= patience
        commit(spark, state_path, epoch, runs)
    drop_scratch(rows)
    return runs


def history(spark: SparkSession, state_path: str) -> DataFrame:
    """``run_id, epoch, train_loss, val_loss, is_best`` of the last committed state."""
    _, runs = last_state(spark, state_path)
    rows = [(r.run_id, e, a, b, e == r.best_epoch) for r in runs for e, (a, b) in enumerate(zip(r.train_losses, r.val_losses), 1)]
    return spark.createDataFrame(rows, "run_id string, epoch int, train_loss double, val_loss double, is_best boolean")


def best_model(spark: SparkSession, state_path: str, shape: ReluClassifier, run_id: str | None = None) -> ReluClassifier:
    """The best epoch's classifier of a run, or of the run with the lowest validation loss (ties: first name)."""
    _, runs = last_state(spark, state_path)
    chosen = min((r for r in runs if run_id in (None, r.run_id)), key=lambda r: (r.best_loss, r.run_id))
    return shape.with_flat(chosen.best_theta)
