"""Message scoring chain shared by the batch job (M6) and the stream (ST1).

text / emoji / sticker -> clean -> hashed vectors -> gated fusion (missing modalities masked) ->
ReLU classifier -> ``sentiment, confidence``. Every step is a per-row expression or an Arrow
batch, so the chain has no shuffle and runs unchanged on a stream.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonality.functions.text import normalize_text, words
from tonality.operators.encode import hash_embed
from tonality.operators.fuse import FusionParams, Linear, check_broadcast, layers_from_table, params_table
from tonality.operators.model import ReluClassifier
from tonality.session import ship_package


@dataclass
class ScoringModel:
    params: FusionParams
    classifier: ReluClassifier
    dims: tuple[int, int, int] = (64, 32, 16)

    @staticmethod
    def closed_form(dims=(64, 32, 16), hidden: int = 128) -> ScoringModel:
        p = FusionParams.closed_form(*dims)
        return ScoringModel(p, ReluClassifier.closed_form(max(dims), hidden, 3, salt=1), dims)


def message_vectors(df: DataFrame, dims=(64, 32, 16), text: str = "text", emoji: str = "emoji",
                    sticker: str = "sticker") -> DataFrame:
    """Hashed vectors per modality; a null input gives a null vector (the modality is missing)."""
    dt, de, ds = dims
    staged = (df.withColumn("_tw", words(normalize_text(text)))
              .withColumn("_ew", _emoji_tokens(emoji))
              .withColumn("_sw", F.array(F.lower(F.coalesce(F.col(sticker), F.lit(""))))))
    staged = hash_embed(staged, "_tw", dt, "text_vec")
    staged = hash_embed(staged, "_ew", de, "emoji_vec")
    staged = hash_embed(staged, "_sw", ds, "sticker_vec")
    return (staged.withColumn("text_vec", F.when(F.col(text).isNotNull(), F.col("text_vec")))
            .withColumn("emoji_vec", F.when(F.col(emoji).isNotNull(), F.col("emoji_vec")))
            .withColumn("sticker_vec", F.when(F.col(sticker).isNotNull(), F.col("sticker_vec")))
            .drop("_tw", "_ew", "_sw"))


def _emoji_tokens(emoji: str):
    """One token per grapheme cluster (an emoji with modifiers stays whole); blanks dropped."""
    return F.filter(F.regexp_extract_all(F.coalesce(F.col(emoji), F.lit("")), F.lit(r"(\X)"), 1),
                    lambda t: F.trim(t) != "")


def score_messages(df: DataFrame, model: ScoringModel, key: str, text: str = "text", emoji: str = "emoji",
                   sticker: str = "sticker") -> DataFrame:
    """``key, predicted, sentiment, confidence`` for each message row, in one Arrow pass.

    The JVM cleans the inputs and splits them into words; one NumPy kernel per
    batch then builds the three hashed vectors, fuses them (missing modalities masked) and runs
    the classifier. A message whose text is missing but has an emoji or sticker is scored on a
    zero text vector; a message with all three inputs missing is ``neutral`` with a null
    confidence.
    """
    ship_package(df.sparkSession)
    from pyspark.sql import types as T

    from tonality.operators.encode import words_to_matrix
    from tonality.operators.fuse import fuse_arrays
    from tonality.operators.model import class_names, softmax_rows

    dt, de, ds = model.dims
    staged = df.select(
        key,
        F.when(F.col(text).isNotNull(), words(normalize_text(text))).alias("_ts"),
        F.when(F.col(emoji).isNotNull(), _emoji_tokens(emoji)).alias("_es"),
        F.when(F.col(sticker).isNotNull(), F.array(F.lower(F.col(sticker)))).alias("_ss"),
        (F.col(text).isNotNull() | F.col(emoji).isNotNull() | F.col(sticker).isNotNull()).alias("_any"))
    check_broadcast([*model.params.layers().values(), model.classifier.fc1, model.classifier.fc2])
    bc = df.sparkSession.sparkContext.broadcast(model)
    key_field = staged.schema[key]
    schema = T.StructType([key_field, T.StructField("predicted", T.IntegerType(), True),
                           T.StructField("sentiment", T.StringType(), True),
                           T.StructField("confidence", T.DoubleType(), True)])
    names = class_names(model.classifier.fc2.d_out)

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        m = bc.value
        for batch in batches:
            valid = {c: np.asarray(pc.is_valid(batch.column(c)).to_numpy(zero_copy_only=False), dtype=bool)
                     for c in ("_ts", "_es", "_ss")}
            anyin = np.asarray(batch.column("_any").to_numpy(zero_copy_only=False), dtype=bool)
            Xt = words_to_matrix(batch.column("_ts"), dt)
            Xe = words_to_matrix(batch.column("_es"), de)
            Xs = words_to_matrix(batch.column("_ss"), ds)
            Y = fuse_arrays(Xt, Xe, valid["_es"].astype(np.float64), Xs, valid["_ss"].astype(np.float64),
                            m.params, "mask")
            P = softmax_rows(m.classifier.logits(Y))
            pred = np.where(anyin, P.argmax(axis=1), 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), pa.array(pred, type=pa.int32()), pa.array(names[pred].tolist(), type=pa.string()),
                 pa.array(P.max(axis=1), type=pa.float64(), mask=~anyin)],
                names=[key, "predicted", "sentiment", "confidence"])

    return staged.mapInArrow(run, schema)


def score_table(comments: DataFrame, model: ScoringModel, key: str = "id", text: str = "comment_text") -> DataFrame:
    """M6: comments table -> ``id, sentiment`` (+ confidence); text only, the other modalities absent."""
    src = comments.select(F.col(key), F.col(text).alias("text"), F.lit(None).cast("string").alias("emoji"),
                          F.lit(None).cast("string").alias("sticker"))
    return score_messages(src, model, key).select(key, "sentiment", "confidence")


def save_scoring_model(spark: SparkSession, model: ScoringModel, path: str, mode: str = "overwrite") -> None:
    """The whole scoring model (fusion, classifier, input widths) as one DM17 parameter table."""
    layers = model.params.layers() | {"fc1": model.classifier.fc1, "fc2": model.classifier.fc2}
    params = params_table(spark, layers)
    dims = params_table(spark, {"dims": Linear(np.array([model.dims], dtype=float), np.zeros(1))})
    params.unionByName(dims).write.mode(mode).parquet(path)


def load_scoring_model(spark: SparkSession, path: str) -> ScoringModel:
    layers = layers_from_table(spark.read.parquet(path))
    dims = tuple(int(d) for d in layers.pop("dims").W[0])
    classifier = ReluClassifier(layers.pop("fc1"), layers.pop("fc2"))
    return ScoringModel(FusionParams(**layers), classifier, dims)
