"""Text baseline at its optimum (M1): L-BFGS over a coefficient table, with a line search of one pass.

The vocabulary and all vectors as long as it (coefficients, gradient, history of steps) stay in one table of shards of terms; the
driver holds the intercepts and inner products only.

- The search direction is a sum of table columns (steps, gradient differences and the gradient). Its factors follow from the
  inner products of these columns, which one aggregate gives.
- The bags lie in blocks of documents (:mod:`text_blocks`); a pass sends them coefficients and takes sums by term.
- The logits are linear in the step length, so one pass with the change of the coefficients gives the
  loss at every length of a grid, and the best one is taken. The loss never rises. The blocks keep the logits
  and their change, so the gradient after the step needs no coefficients.
- Terms are scaled by the curvature of the loss at zero, so frequent and rare terms move alike.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonality.functions.labels import CLASS_NAMES
from tonality.operators.model import TextBaseline
from tonality.operators.text_blocks import TOTALS, Bag, Shard, TextBlocks, softmax, text_blocks
from tonality.operators.tokens import fit_vocabulary
from tonality.session import drop_scratch, materialize, ship_package

STEP_LENGTHS = [2.0 ** k for k in range(-12, 5)]


@dataclass
class FittedText(TextBaseline):
    """``history``: (iteration, mean regularised loss, gradient norm); ``converged``: the norm fell to ``tol`` of the first."""
    converged: bool


def _factors(dots: np.ndarray, pairs: int) -> np.ndarray:
    """Factors of the columns ``s1, y1, s2, y2, ..., g`` (oldest pair first) in the search direction.

    The two loops over the pairs run on the inner products ``dots`` of the columns alone.
    """
    n = 2 * pairs + 1
    out = np.zeros(n)
    out[-1] = -1.0
    alpha = np.zeros(pairs)
    for i in range(pairs - 1, -1, -1):
        s, y = 2 * i, 2 * i + 1
        alpha[i] = out @ dots[:, s] / dots[s, y]
        out[y] -= alpha[i]
    if pairs:
        out *= dots[n - 3, n - 2] / dots[n - 2, n - 2]
    for i in range(pairs):
        s, y = 2 * i, 2 * i + 1
        out[s] += alpha[i] - out @ dots[:, y] / dots[s, y]
    return out


def _summed(df: DataFrame, size: int, of_batch: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """The sum over all batches of ``size`` numbers each: summed in every task, then over tasks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            if b.num_rows:
                total += of_batch(b)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], names=["i", "v"])
    out = np.zeros(size)
    for i, v in df.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v")).collect():
        out[i] = v
    return out


def fit_text_optimum(train: DataFrame, key: str, tokens: str = "tokens", label: str = "label", classes: int = len(CLASS_NAMES),
                     C: float = 1.0, max_iter: int = 1000, tol: float = 1e-4, history: int = 10) -> FittedText:
    """M1: bag of words (vocabulary fitted on ``train``) and multinomial logistic regression at its optimum.

    Minimises ``mean(loss) + ||w||^2 / (2 C n)`` (intercepts free) until the gradient norm is ``tol`` times the first, or for
    ``max_iter`` iterations; ``converged`` tells which. Rows without a label take no part; a document without a
    word of the vocabulary counts through the intercepts.
    """
    ship_package(train.sparkSession)
    src = train.select(F.col(key).alias("_key"), F.col(tokens).alias("tokens"), F.col(label).cast("int").alias("_y")).where(F.col(label).isNotNull())
    vocabulary = materialize(fit_vocabulary(src, "tokens", min_len=2), "text-vocabulary")
    blocks = text_blocks(src, vocabulary, classes)
    try:
        return _fit(vocabulary, blocks, C, max_iter, tol, history)
    finally:
        blocks.drop()


def _fit(vocabulary: DataFrame, blocks: TextBlocks, C: float, max_iter: int, tol: float, keep: int) -> FittedText:
    """A shard's vectors ``V`` are u (scaled coefficients), g (gradient) and the history s, y, s, y, ... of its terms.

    Numbers that change with each iteration go into NumPy kernels, not into SQL expressions, so Spark compiles its code once.
    """
    K, n = blocks.classes, max(blocks.n, 1)
    ridge = 1.0 / (C * n)
    table = materialize(blocks.shards(2, lambda squares: 1.0 / np.sqrt(squares / (4.0 * n) + ridge)), "text-shards")
    bias_scale = 2.0  # the curvature of a column of ones is 1 / 4
    bias = np.zeros((2, K))  # the same vectors for the intercepts; the driver holds these few numbers
    factors, length, pairs, logits = None, 0.0, 0, None
    past, first_norm, converged = [], None, False

    for iteration in range(max_iter + 1):
        # the gradient at u + length * (step of 1)
        def moved(V: np.ndarray, a=length, f=factors) -> np.ndarray:
            return V[0] if f is None else V[0] + a * np.tensordot(f, V[1:], 1)
        drop = factors is not None and pairs == keep

        def advanced(V: np.ndarray, gradient: Callable[[np.ndarray], np.ndarray], moved=moved, f=factors, drop=drop) -> np.ndarray:
            """``V`` of shape (vectors, terms, K): u moved, the gradient renewed, the new pair appended."""
            u = moved(V)
            g = gradient(u)
            if f is None:
                return np.stack([u, g])
            old = V[4:] if drop else V[2:]
            return np.concatenate([u[None], g[None], old, (u - V[0])[None], (g - V[1])[None]])

        def update(shard: Shard, sums: np.ndarray, advanced=advanced) -> tuple[np.ndarray, np.ndarray]:
            """The inner products of all vectors, plain and of the unscaled coefficients they stand for, come with them."""
            V = advanced(shard.V, lambda u: shard.scale * (sums / n + ridge * shard.scale * u))
            flat = (X.reshape(len(V), -1) for X in (V, V * shard.scale))
            return V, np.concatenate([(X @ X.T).ravel() for X in flat])

        def gradient(bag: Bag, messages: pa.Table, a=length) -> pa.Table:
            return bag.gradient(_along(bag, messages, a))
        nxt = materialize(blocks.gathered(table, blocks.at_blocks(_no_logits(vocabulary.sparkSession) if logits is None else logits, gradient), update), "text-shards")
        drop_scratch(table)
        table = nxt
        if factors is not None:
            pairs += not drop
        size = 2 + 2 * pairs
        sums = _summed(table.select("shard", "numbers"), 2 * size * size + K + 1, _products_and_totals(2 * size * size, K + 1))
        (plain, scaled), totals = sums[:-K - 1].reshape(2, size, size), sums[-K - 1:]
        bias = advanced(bias[:, None], lambda u: bias_scale * totals[None, :K] / n)[:, 0]
        plain = plain + bias @ bias.T
        order = [*range(2, size), 1]  # history, then the gradient
        norm = float(np.sqrt(plain[1, 1]))
        loss = totals[K] / n + ridge * scaled[0, 0] / 2
        past.append((iteration, float(loss), norm))
        first_norm = norm if first_norm is None else first_norm
        converged = norm <= tol * first_norm
        if converged or iteration == max_iter:
            break
        by_order = _factors(plain[np.ix_(order, order)], pairs)
        factors = np.concatenate([by_order[-1:], by_order[:-1]])  # of g, then the history, as they lie in V
        wd, dd = scaled[0, 1:] @ factors, factors @ scaled[1:, 1:] @ factors

        # the loss at every step length in one pass; the blocks keep their logits and the change by a step of 1
        def toward(shard: Shard, f=factors) -> np.ndarray:
            return shard.scale * np.tensordot(f, shard.V[1:], 1)

        def along(bag: Bag, messages: pa.Table, a=length, of_bias=bias_scale * factors @ bias[1:]) -> pa.Table:
            Z, D = _along(bag, messages, a), bag.logits(bag.received(messages, K), of_bias)
            found = [bag.losses(Z + x * D, softmax(Z + x * D)[1]).sum() for x in STEP_LENGTHS]
            return pa.table([pa.array([bag.block], pa.int32()), pa.array([TOTALS], pa.int64()), pa.array([np.stack([Z, D]).tobytes()]),
                             pa.array([np.array(found).tobytes()])], names=["block", "shard", "sent", "losses"])
        messages = blocks.sent(table, toward)
        if logits is not None:
            messages = messages.unionByName(logits)
        after = materialize(blocks.at_blocks(messages, along, "block int, shard long, sent binary, losses binary"), "text-logits")
        if logits is not None:
            drop_scratch(logits_table)
        logits_table, logits = after, after.select("block", "shard", "sent")
        losses = _summed(after.select("losses"), len(STEP_LENGTHS), lambda b: np.sum([np.frombuffer(x) for x in b.column("losses").to_pylist()], axis=0))
        tried = [x / n + ridge * (scaled[0, 0] + 2 * a * wd + a * a * dd) / 2 for a, x in zip(STEP_LENGTHS, losses)]
        best = int(np.argmin(tried))
        if not tried[best] < loss:  # no length lowers the loss: it is as low as sums of doubles tell
            break
        length = STEP_LENGTHS[best]

    coefficients = materialize(blocks.coefficients(table, [f"w{c}" for c in range(K)], lambda shard: shard.V[0] * shard.scale), "text-coefficients")
    for used in (table, *([] if logits is None else [logits_table])):
        drop_scratch(used)
    return FittedText(vocabulary, coefficients, (bias_scale * bias[0]).tolist(), past, converged)


def _no_logits(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "block int, shard long, sent binary")


def _along(bag: Bag, messages: pa.Table, length: float) -> np.ndarray:
    """The logits of a block's documents after a step of ``length``, from those before it and their change by a step of 1; 0 at first."""
    kept = [x for s, x in zip(messages.column("shard").to_pylist(), messages.column("sent").to_pylist()) if s == TOTALS]
    if not kept:
        return np.zeros(bag.y.shape)
    Z, D = np.frombuffer(kept[0]).reshape(2, *bag.y.shape)
    return Z + length * D


def _products_and_totals(products: int, totals: int) -> Callable[[pa.RecordBatch], np.ndarray]:
    """Of the ``numbers`` of shards: the sums of their inner products and, last, the totals over all documents."""
    def of_batch(b: pa.RecordBatch) -> np.ndarray:
        out = np.zeros(products + totals)
        for shard, numbers in zip(b.column("shard").to_pylist(), b.column("numbers").to_pylist()):
            out[slice(products, None) if shard == TOTALS else slice(products)] += np.frombuffer(numbers)
        return out
    return of_batch


def class_probabilities(model: TextBaseline, df: DataFrame, key: str, tokens: str = "tokens") -> DataFrame:
    """``key, probs, predicted`` for every row; terms outside the vocabulary are dropped, a tie takes the first class."""
    from tonality.functions.vectors import argmax, softmax
    from tonality.operators.model import _class_columns, _text_logits

    z = _text_logits(df.select(F.col(key).alias("_key"), tokens), tokens, model)
    return (z.select(F.col("_key").alias(key), softmax(F.array(*_class_columns("z", len(model.intercepts)))).alias("probs"))
            .withColumn("predicted", argmax("probs")))


def save_text_model(model: TextBaseline, path: str) -> None:
    """Vocabulary and coefficients as tables, then one row with intercepts and history: a folder without that row is not whole."""
    spark = model.vocabulary.sparkSession
    model.vocabulary.select("term", "term_id").write.mode("overwrite").parquet(f"{path}/vocabulary")
    model.coefficients.select("term_id", *[f"w{c}" for c in range(len(model.intercepts))]).write.mode("overwrite").parquet(f"{path}/coefficients")
    history = [[float(x) for x in step] for step in model.history]
    row = spark.createDataFrame([([float(b) for b in model.intercepts], history, getattr(model, "converged", None))],
                                "intercepts array<double>, history array<array<double>>, converged boolean")
    row.write.mode("overwrite").parquet(f"{path}/summary")


def load_text_model(spark: SparkSession, path: str) -> TextBaseline:
    """The model as saved; the tables stay tables, whatever their size. ``FittedText`` if it says whether it converged."""
    row = spark.read.parquet(f"{path}/summary").first()
    if row is None:
        raise ValueError(f"{path} holds no whole text model")
    history = [(int(step[0]), *step[1:]) for step in row.history]
    parts = (spark.read.parquet(f"{path}/vocabulary"), spark.read.parquet(f"{path}/coefficients"), list(row.intercepts), history)
    return TextBaseline(*parts) if row.converged is None else FittedText(*parts, row.converged)
