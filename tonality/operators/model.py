"""Classifiers: batch scoring, class-weighted ReLU classifier, text baseline, weight sweep.

``fit_relu_classifier`` runs one Spark job per optimisation step: every partition computes the
weighted cross-entropy gradient of its rows in one Arrow pass (and the validation loss of its
validation rows), partial sums are combined by a mergeable vector-sum aggregate split into
chunks, and only the summed gradient (one number per weight) reaches the driver, which applies
the Adam update, the way MLlib's own optimisers iterate.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonality.functions.labels import CLASS_NAMES
from tonality.operators.fuse import Linear, arrow_matrix, check_broadcast, closed_form_linear, layers_from_table, params_table, random_linear
from tonality.session import ship_package

GRAD_CHUNK = 4096
GRAD_LANES = 64  # tasks that share the first sum of a chunk


@dataclass
class ReluClassifier:
    """``logits = fc2(relu(fc1(x)))`` (input -> hidden ReLU -> classes)."""
    fc1: Linear
    fc2: Linear

    @staticmethod
    def seeded(d_in: int, hidden: int = 128, classes: int = 3, seed: int = 42) -> ReluClassifier:
        return ReluClassifier(random_linear(hidden, d_in, seed), random_linear(classes, hidden, seed + 1))

    @staticmethod
    def closed_form(d_in: int, hidden: int = 128, classes: int = 3, salt: int = 1) -> ReluClassifier:
        return ReluClassifier(closed_form_linear(hidden, d_in, salt), closed_form_linear(classes, hidden, salt + 1))

    def logits(self, X: np.ndarray) -> np.ndarray:
        return self.fc2(np.maximum(self.fc1(X), 0.0))

    def flat(self) -> np.ndarray:
        return np.concatenate([self.fc1.W.ravel(), self.fc1.b, self.fc2.W.ravel(), self.fc2.b])

    def with_flat(self, v: np.ndarray) -> ReluClassifier:
        h, d = self.fc1.W.shape
        c = self.fc2.W.shape[0]
        o = 0
        W1 = v[o:o + h * d].reshape(h, d); o += h * d
        b1 = v[o:o + h]; o += h
        W2 = v[o:o + c * h].reshape(c, h); o += c * h
        b2 = v[o:o + c]
        return ReluClassifier(Linear(W1.copy(), b1.copy()), Linear(W2.copy(), b2.copy()))


def class_names(n: int) -> np.ndarray:
    """Names of ``n`` classes: the three known ones, then their numbers."""
    return np.array([*CLASS_NAMES, *map(str, range(len(CLASS_NAMES), n))], dtype=object)


def softmax_rows(Z: np.ndarray) -> np.ndarray:
    Z = Z - Z.max(axis=1, keepdims=True)
    E = np.exp(Z)
    return E / E.sum(axis=1, keepdims=True)


def weighted_ce_grad(model: ReluClassifier, X: np.ndarray, y: np.ndarray, w: np.ndarray):
    """Sum over rows of ``w_i * nll_i`` and its gradient (not yet divided by ``sum w``)."""
    Hp = model.fc1(X)
    H = np.maximum(Hp, 0.0)
    Z = model.fc2(H)
    P = softmax_rows(Z)
    n = X.shape[0]
    nll = -np.log(np.maximum(P[np.arange(n), y], 1e-300))
    loss = float(np.sum(w * nll))
    dZ = P.copy()
    dZ[np.arange(n), y] -= 1.0
    dZ *= w[:, None]
    dW2 = dZ.T @ H
    db2 = dZ.sum(axis=0)
    dH = (dZ @ model.fc2.W) * (Hp > 0)
    dW1 = dH.T @ X
    db1 = dH.sum(axis=0)
    return loss, np.concatenate([dW1.ravel(), db1, dW2.ravel(), db2])


# ---------------------------------------------------------------- M5 scoring

def score(df: DataFrame, vec_col: str, model: ReluClassifier, keep: list[str] | None = None,
          with_probs: bool = False) -> DataFrame:
    """M5: ``predicted, sentiment, confidence`` (= largest softmax probability) per row.

    One forward pass per Arrow batch with the parameters broadcast. A null vector (nothing to
    score) gives ``neutral`` with a null confidence.
    """
    ship_package(df.sparkSession)
    keep = [c for c in df.columns if c != vec_col] if keep is None else keep
    src = df.select(*keep, vec_col)
    d_in = model.fc1.d_in
    check_broadcast([model.fc1, model.fc2])
    bc = df.sparkSession.sparkContext.broadcast(model)
    fields = [f for f in src.schema.fields if f.name in keep]
    fields += [T.StructField("predicted", T.IntegerType(), True), T.StructField("sentiment", T.StringType(), True),
               T.StructField("confidence", T.DoubleType(), True)]
    if with_probs:
        fields.append(T.StructField("probs", T.ArrayType(T.DoubleType()), True))
    schema = T.StructType(fields)
    vi = len(keep)
    names = class_names(model.fc2.d_out)

    def run(batches):
        import pyarrow as pa
        from tonality.operators.fuse import arrow_vectors
        m = bc.value
        for batch in batches:
            X, valid = arrow_matrix(batch.column(vi), d_in)
            P = softmax_rows(m.logits(X))
            pred = np.where(valid, P.argmax(axis=1), 1).astype(np.int32)
            conf = P.max(axis=1)
            cols = list(batch.columns[:vi]) + [
                pa.array(pred, type=pa.int32()), pa.array(names[pred].tolist(), type=pa.string()),
                pa.array(conf, type=pa.float64(), mask=~valid)]
            if with_probs:
                cols.append(arrow_vectors(P, valid))
            yield pa.RecordBatch.from_arrays(cols, schema=pa.schema([(f.name, _arrow_type(f.dataType)) for f in schema.fields]))

    return src.mapInArrow(run, schema)


def _arrow_type(dt):
    from pyspark.sql.pandas.types import to_arrow_type
    return to_arrow_type(dt)


# ---------------------------------------------------------------- M2b / M3 training

def _partial_gradients(feats: DataFrame, model: ReluClassifier, d_in: int, features: str, label: str,
                       weight: str, split_col: str) -> np.ndarray:
    """One job: per partition ``[grad..., sum w*nll (train), sum w (train), sum w*nll (val), sum w (val)]``,
    summed over partitions chunk by chunk with a mergeable vector-sum aggregate."""
    ship_package(feats.sparkSession)
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    spark = feats.sparkSession
    check_broadcast([model.fc1, model.fc2])
    bc = spark.sparkContext.broadcast(model)
    cols = feats.columns
    fi, li, wi, si = cols.index(features), cols.index(label), cols.index(weight), cols.index(split_col)
    n_par = model.flat().size
    total = n_par + 4
    n_chunks = (total + GRAD_CHUNK - 1) // GRAD_CHUNK

    def run(batches):
        import pyarrow as pa
        m = bc.value
        acc = np.zeros(total)
        for batch in batches:
            X, _ = arrow_matrix(batch.column(fi), d_in)
            y = np.asarray(batch.column(li).to_numpy(zero_copy_only=False), dtype=np.int64)
            # a class that the training rows lack has no weight: its rows count for nothing
            w = np.nan_to_num(np.asarray(batch.column(wi).to_numpy(zero_copy_only=False), dtype=np.float64))
            sp = np.asarray(batch.column(si).to_numpy(zero_copy_only=False), dtype=object)
            tr, va = sp == "train", sp == "val"
            if tr.any():
                loss, g = weighted_ce_grad(m, X[tr], y[tr], w[tr])
                acc[:n_par] += g
                acc[n_par] += loss
                acc[n_par + 1] += w[tr].sum()
            if va.any():
                P = softmax_rows(m.logits(X[va]))
                nll = -np.log(np.maximum(P[np.arange(va.sum()), y[va]], 1e-300))
                acc[n_par + 2] += float(np.sum(w[va] * nll))
                acc[n_par + 3] += w[va].sum()
        ids = np.arange(n_chunks, dtype=np.int32)
        vals = [acc[i * GRAD_CHUNK:(i + 1) * GRAD_CHUNK] for i in ids]
        offsets = np.cumsum([0] + [len(v) for v in vals]).astype(np.int32)
        lane = np.full(n_chunks, TaskContext.get().partitionId() % GRAD_LANES, np.int32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids), pa.array(lane), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(vals)))],
            names=["chunk", "lane", "g"])

    # two levels: many partitions' sums of one chunk meet in GRAD_LANES tasks first
    parts = feats.mapInArrow(run, "chunk int, lane int, g array<double>")
    summed = parts
    for by in (["chunk", "lane"], ["chunk"]):
        summed = summed.groupBy(*by).agg(vector_to_array(Summarizer.sum(array_to_vector("g"))).alias("g"))
    summed = summed.collect()
    bc.destroy()   # the step's job is done; do not keep one parameter copy per step on the executors
    out = np.zeros(total)
    for r in summed:
        v = np.asarray(r["g"], dtype=np.float64)
        out[r["chunk"] * GRAD_CHUNK: r["chunk"] * GRAD_CHUNK + v.size] = v
    return out


@dataclass
class TrainResult:
    model: ReluClassifier          # parameters of the best validation epoch
    history: list                  # (epoch, train_loss, val_loss)
    best_epoch: int


def fit_relu_classifier(feats: DataFrame, features: str = "features", label: str = "label", weight: str = "weight",
                        split_col: str = "split", hidden: int = 128, classes: int = 3, epochs: int = 50,
                        patience: int = 5, lr: float = 1e-3, steps_per_epoch: int = 1, seed: int = 42,
                        d_in: int | None = None, checkpoint: bool = True,
                        start: ReluClassifier | None = None) -> TrainResult:
    """M2b + M3: class-weighted ReLU classifier, Adam, early stop on the validation loss.

    ``feats`` carries ``features array<double>, label int, weight double, split`` with
    ``split`` in train / val (other rows are ignored). Every step is one full pass over the
    training rows (exact weighted mean loss, batch-size free). Training stops after
    ``patience`` epochs without a strict improvement and returns the best epoch's parameters.
    The first parameters are drawn from ``seed``, or given as ``start``.
    """
    from tonality.session import materialize

    spark = feats.sparkSession
    src = feats.select(F.col(features).cast("array<double>").alias(features), F.col(label).cast("int").alias(label),
                       F.col(weight).cast("double").alias(weight), split_col) \
        .where(F.col(split_col).isin("train", "val"))
    if d_in is None:
        d_in = int(src.agg(F.max(F.size(features))).first()[0])
    if checkpoint:
        src = materialize(src, "train-features")   # reliable copy in the shared folder: each step re-reads it
    model = start or ReluClassifier.seeded(d_in, hidden, classes, seed)
    theta = model.flat()
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
    b1, b2, eps = 0.9, 0.999, 1e-8
    best, best_theta, best_epoch, bad, t = float("inf"), theta.copy(), -1, 0, 0
    history = []
    n_par = theta.size
    # one job per step: the gradient at the current parameters and, in the same pass, their
    # validation loss; the job after an epoch's last step therefore also scores that epoch
    acc = _partial_gradients(src, model.with_flat(theta), d_in, features, label, weight, split_col)
    for ep in range(epochs):
        for _ in range(steps_per_epoch):
            wsum = acc[n_par + 1]
            if wsum <= 0:
                raise ValueError("no training rows")
            g = acc[:n_par] / wsum
            t += 1
            m1 = b1 * m1 + (1 - b1) * g
            m2 = b2 * m2 + (1 - b2) * g * g
            theta = theta - lr * (m1 / (1 - b1 ** t)) / (np.sqrt(m2 / (1 - b2 ** t)) + eps)
            acc = _partial_gradients(src, model.with_flat(theta), d_in, features, label, weight, split_col)
        train_loss = acc[n_par] / acc[n_par + 1]
        val_loss = acc[n_par + 2] / acc[n_par + 3] if acc[n_par + 3] > 0 else train_loss
        history.append((ep + 1, float(train_loss), float(val_loss)))
        if val_loss < best:
            best, best_theta, best_epoch, bad = val_loss, theta.copy(), ep + 1, 0
        else:
            bad += 1
            if bad >= patience:
                break
    return TrainResult(model.with_flat(best_theta), history, best_epoch)


def relu_gradient(feats: DataFrame, model: ReluClassifier, features: str = "features", label: str = "label",
                  weight: str = "weight", split_col: str = "split") -> DataFrame:
    """One step's result at given parameters: ``idx, value`` with the weighted mean training loss at
    -1, the validation loss at -2 and the gradient of the training loss at 0.. (order of ``flat()``)."""
    src = feats.select(F.col(features).cast("array<double>").alias(features), label, weight, split_col)
    acc = _partial_gradients(src, model, model.fc1.d_in, features, label, weight, split_col)
    n = model.flat().size
    rows = [(-1, float(acc[n] / acc[n + 1])), (-2, float(acc[n + 2] / acc[n + 3]) if acc[n + 3] > 0 else None)]
    rows += [(i, float(v)) for i, v in enumerate(acc[:n] / acc[n + 1])]
    return feats.sparkSession.createDataFrame(rows, "idx int, value double")


def history_frame(spark: SparkSession, res: TrainResult, run_id: str = "run") -> DataFrame:
    return spark.createDataFrame([(run_id, e, tl, vl) for e, tl, vl in res.history],
                                 "run_id string, epoch int, train_loss double, val_loss double")


def sweep_class_weights(feats: DataFrame, weight_sets: dict[str, list[float]], features: str = "features",
                        label: str = "label", split_col: str = "split", **fit_kw) -> DataFrame:
    """M4: one training run and one evaluation record per class-weight set, keyed by ``run_id``.

    Features are checkpointed once and shared by all runs.
    """
    from tonality.operators.metrics import evaluation_record
    from tonality.session import materialize

    base = materialize(feats, "sweep-features")
    records = None
    for run_id, ws in weight_sets.items():
        wmap = F.element_at(F.array(*[F.lit(float(w)) for w in ws]), (F.col(label) + 1).cast("int"))
        res = fit_relu_classifier(base.withColumn("weight", wmap), features, label, "weight", split_col,
                                  checkpoint=False, **fit_kw)
        test = base.where(F.col(split_col) == "test")
        scored = score(test, features, res.model, keep=[label]).select(F.col(label).alias("truth"),
                                                                     F.col("predicted").alias("prediction"))
        rec = evaluation_record(scored, run_id, weights=ws)
        records = rec if records is None else records.unionByName(rec)
    return records


# ---------------------------------------------------------------- M1 text baseline

@dataclass
class TextBaseline:
    """A fitted bag-of-words classifier: ``vocabulary(term, term_id)``, ``coefficients(term_id, w0..)``, intercepts."""
    vocabulary: DataFrame
    coefficients: DataFrame
    intercepts: list[float]
    history: list                  # (step, mean training loss before the step)


def _class_columns(prefix: str, classes: int) -> list[str]:
    return [f"{prefix}{c}" for c in range(classes)]


def _text_logits(docs: DataFrame, tokens: str, model: TextBaseline) -> DataFrame:
    """``docs(_key, tokens)`` as ``_key, z0..``: the summed coefficients of each document's terms and the intercepts."""
    from tonality.operators.tokens import listed, postings

    ws, zs = _class_columns("w", len(model.intercepts)), _class_columns("z", len(model.intercepts))
    weights = model.vocabulary.join(model.coefficients.select("term_id", *ws), "term_id").select("term", *ws)
    sums = (listed(postings(docs, "_key", tokens, 2).join(weights, "term"), "_key", *ws)
            .groupBy("_key").agg(*[F.sum(F.col("count") * F.col(w)).alias(z) for w, z in zip(ws, zs)]))
    out = docs.select("_key").join(sums, "_key", "left")
    return out.withColumns({z: F.coalesce(F.col(z), F.lit(0.0)) + F.lit(float(b)) for z, b in zip(zs, model.intercepts)})


def fit_text_baseline(train: DataFrame, key: str, tokens: str = "tokens", label: str = "label", classes: int = 3,
                      C: float = 1.0, steps: int = 100, lr: float = 0.02, tol: float = 1e-5) -> TextBaseline:
    """M1: bag of words (vocabulary fitted on train) + multinomial logistic regression.

    Minimises ``mean(loss) + ||w||^2 / (2 C n)`` (the usual ``C * sum(loss) + ||w||^2 / 2``) by full-batch
    Adagrad from zero, until the loss changes by less than ``tol`` or after ``steps`` steps. The
    vocabulary and the coefficients are tables joined by term id: the driver holds the intercepts
    and the loss only, so a vocabulary of any size fits. The bag of words is packed once into blocks of documents; each
    step sends them the coefficients of their terms, writes the shards of terms anew and drops the old copy.
    """
    from tonality.operators.text_blocks import TOTALS, text_blocks
    from tonality.operators.tokens import fit_vocabulary
    from tonality.session import drop_scratch, materialize

    src = (train.select(F.col(key).alias("_key"), F.col(tokens).alias("tokens"), F.col(label).cast("int").alias("_y"))
           .where(F.col(label).isNotNull()))
    vocabulary = materialize(fit_vocabulary(src, "tokens", min_len=2), "baseline-vocabulary")
    blocks = text_blocks(src, vocabulary, classes)
    n, ws = max(blocks.n, 1), _class_columns("w", classes)
    table = materialize(blocks.shards(2), "baseline-shards")  # the coefficients, then the sums of squares of Adagrad

    def update(shard, sums):
        w, squares = shard.V
        g = sums / n + w / (C * n)
        squares = squares + g * g
        return np.stack([w - lr * g / (np.sqrt(squares) + 1e-8), squares]), np.zeros(0)
    bias, bias_acc, history = np.zeros(classes), np.zeros(classes), []
    for step in range(steps):
        def gradient(bag, messages, bias=bias):
            return bag.gradient(bag.logits(bag.received(messages, classes), bias))
        nxt = materialize(blocks.gathered(table, blocks.at_blocks(blocks.sent(table, lambda shard: shard.V[0]), gradient), update), "baseline-shards")
        totals = nxt.where(F.col("shard") == TOTALS).select("numbers").first()
        totals = np.frombuffer(totals[0]) if totals else np.zeros(classes + 1)
        history.append((step, float(totals[classes]) / n))
        drop_scratch(table)
        table = nxt
        gb = totals[:classes] / n
        bias_acc += gb * gb
        bias = bias - lr * gb / (np.sqrt(bias_acc) + 1e-8)
        if len(history) > 1 and abs(history[-1][1] - history[-2][1]) < tol:
            break
    # a term that no document with a key holds keeps its zeros
    found = vocabulary.select("term_id").join(blocks.coefficients(table, ws, lambda shard: shard.V[0]), "term_id", "left")
    coef = materialize(found.select("term_id", *[F.coalesce(w, F.lit(0.0)).alias(w) for w in ws]), "baseline-coefficients")
    drop_scratch(table)
    blocks.drop()
    return TextBaseline(vocabulary, coef, bias.tolist(), history)


def predict_text_baseline(model: TextBaseline, df: DataFrame, key: str, tokens: str = "tokens") -> DataFrame:
    """``key, predicted`` for every row; terms outside the vocabulary are dropped, a tie takes the first class."""
    from tonality.functions.vectors import argmax

    z = _text_logits(df.select(F.col(key).alias("_key"), tokens), tokens, model)
    return z.select(F.col("_key").alias(key), argmax(F.array(*_class_columns("z", len(model.intercepts)))).alias("predicted"))


# ---------------------------------------------------------------- S11 persistence

def save_model(spark: SparkSession, model: ReluClassifier, path: str, mode: str = "overwrite") -> None:
    """Parameters as a DM17 table in Parquet."""
    params_table(spark, {"fc1": model.fc1, "fc2": model.fc2}).write.mode(mode).parquet(path)


def load_model(spark: SparkSession, path: str) -> ReluClassifier:
    layers = layers_from_table(spark.read.parquet(path))
    return ReluClassifier(layers["fc1"], layers["fc2"])


# ---------------------------------------------------------------- F5 / F7 classifier head

def linear_head(df: DataFrame, vec_col: str, head: Linear, probs: str = "probs", code: str = "predicted") -> DataFrame:
    """Class probabilities ``softmax(W x + b)`` and their argmax code, next to the vector.

    Expression form (the head has few outputs); pair it with ``encode_batch`` for the vectors.
    """
    from tonality.functions.vectors import argmax, softmax
    from tonality.operators.fuse import project_expr

    out = df.withColumn(probs, softmax(project_expr(F.col(vec_col), head)))
    return out.withColumn(code, F.when(F.col(vec_col).isNotNull(), argmax(probs)))


# ---------------------------------------------------------------- M2a weighted logistic regression

def fit_weighted_logreg(train: DataFrame, features: str = "features", label: str = "label", weight: str = "weight",
                        reg: float = 0.0, max_iter: int = 100):
    """Multinomial logistic regression with per-row class weights (MLlib ``weightCol``).

    ``features`` is ``array<double>``; it is turned into an MLlib vector only at this edge.
    Returns the fitted model; ``predict_weighted_logreg`` scores a frame with it.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    src = train.select(array_to_vector(F.col(features).cast("array<double>")).alias("_x"),
                       F.col(label).cast("double").alias("_y"), F.col(weight).cast("double").alias("_w"))
    lr = LogisticRegression(featuresCol="_x", labelCol="_y", weightCol="_w", family="multinomial",
                            regParam=reg, maxIter=max_iter, standardization=False)
    return lr.fit(src)


def predict_weighted_logreg(model, df: DataFrame, features: str = "features", keep: list[str] | None = None) -> DataFrame:
    from pyspark.ml.functions import array_to_vector, vector_to_array

    keep = [c for c in df.columns if c != features] if keep is None else keep
    src = df.select(*keep, array_to_vector(F.col(features).cast("array<double>")).alias("_x"))
    out = model.setFeaturesCol("_x").transform(src)
    return out.select(*keep, F.col("prediction").cast("int").alias("predicted"),
                      vector_to_array("probability").alias("probs"))
