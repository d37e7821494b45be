"""Driver tables and the stand-in fixtures derived from them (FIXTURES.md section 2).

The driver's parquet tables hold no reviews, emojis or images, so each operator runs on a
stand-in built from them with plain projections and aggregates; every stand-in grows with the
tables it is read from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonality.functions.labels import label_rating

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations")

# Fixed value: URL pattern whose first path segment is the page language (the "class folder").
PAGE_CLASS_PATTERN = r"^https?://[^/]+/([a-z]+)/"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read a driver table: one plan at every size and place."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews stand-in: ``review_id, verified_reviews, rating`` from ``documents``; rating = doc_id % 5 + 1."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("review_id"), F.col("text").alias("verified_reviews"),
        (F.col("doc_id") % 5 + 1).cast("double").alias("rating"))


def order_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Larger reviews stand-in: rating = first digit of ``o_orderpriority``."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("review_id"),
        F.substring("o_orderpriority", 1, 1).cast("double").alias("rating"))


def truth_prediction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-class truth / prediction pairs: rating label of an order against ``o_orderkey % 3``."""
    return order_ratings(spark, sf_dir).select(
        "review_id", label_rating("rating", "le2").alias("truth"),
        (F.col("review_id") % 3).cast("int").alias("prediction"))


def emoji_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Emoji lexicon stand-in from ``lineitem`` per part: R -> Negative, N -> Neutral, A -> Positive.

    One aggregate with map-side partial sums; its size is the number of parts.
    """
    li = table(spark, sf_dir, "lineitem")
    flag = F.col("l_returnflag")
    return li.groupBy("l_partkey").agg(
        F.sum(F.when(flag == "R", 1).otherwise(0)).cast("long").alias("Negative"),
        F.sum(F.when(flag == "N", 1).otherwise(0)).cast("long").alias("Neutral"),
        F.sum(F.when(flag == "A", 1).otherwise(0)).cast("long").alias("Positive"),
        F.count(F.lit(1)).alias("Occurrences"),
    ).select(F.col("l_partkey").cast("string").alias("Emoji"), "Negative", "Neutral", "Positive", "Occurrences")


def symbol_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name table stand-in (symbol -> ``:short_name:``) from ``region``."""
    return table(spark, sf_dir, "region").select(
        F.col("r_regionkey").cast("string").alias("symbol"),
        F.concat(F.lit(":"), F.regexp_replace(F.lower("r_name"), " ", "_"), F.lit(":")).alias("name"))


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols to name: one per nation (keys 0..24; only some have a name in ``symbol_names``)."""
    return table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("symbol_id"), F.col("n_nationkey").cast("string").alias("symbol"))


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class-folder stand-in: each page is a file, its language path segment is the folder."""
    return table(spark, sf_dir, "pages").select(
        "page_id", F.col("url").alias("path"),
        F.nullif(F.regexp_extract("url", PAGE_CLASS_PATTERN, 1), F.lit("")).alias("category"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``vec_id, embedding array<float>(64), label`` straight from ``embeddings``."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")


def modality_frames(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Three modalities of one message table, keyed by ``msg_id``.

    text: every embedding row (64-d). emoji: 0..n per message, ``msg_id = vec_id div 3``,
    the first 32 values. sticker: ``msg_id = 2 * vec_id`` (so only even messages have one),
    values 33..48. Both are derived from the same table so they scale with it.
    """
    v = vectors(spark, sf_dir)
    text = v.select(F.col("vec_id").alias("msg_id"), F.col("embedding").cast("array<double>").alias("text_vec"), "label")
    emoji = v.select((F.col("vec_id") / 3).cast("long").alias("msg_id"),
                     F.slice(F.col("embedding").cast("array<double>"), 1, 32).alias("emoji_vec"))
    sticker = v.select((F.col("vec_id") * 2).alias("msg_id"),
                       F.slice(F.col("embedding").cast("array<double>"), 33, 16).alias("sticker_vec"))
    return {"text": text, "emoji": emoji, "sticker": sticker}


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request rows: one per conversation turn (every role), keyed ``conv_id-turn``.

    All three modalities occur: every second turn has an emoji and every third a sticker (texts
    derived from the role and the conversation), every fifth turn of those has no text.
    """
    turn = F.col("turn")
    has_emoji, has_sticker = turn % 2 == 0, turn % 3 == 0
    return table(spark, sf_dir, "conversations").select(
        F.concat_ws("-", F.col("conv_id").cast("string"), turn.cast("string")).alias("request_id"),
        F.when(~((has_emoji | has_sticker) & (F.col("conv_id") % 5 == 0)), F.col("text")).alias("text"),
        F.when(has_emoji, F.substring("role", 1, 2)).alias("emoji"),
        F.when(has_sticker, F.concat(F.lit("Sticker"), (F.col("conv_id") % 7).cast("string"))).alias("sticker"))


def page_vectors(spark: SparkSession, sf_dir: str, dim: int = 16) -> DataFrame:
    """A second modality from another table: ``page_id, s_vec`` = hashed words of the page URL
    (split on non-letters), ``dim`` wide. Pages are fewer than embeddings at small scale factors
    and more at larger ones, so positional alignment both pads and cuts."""
    from tonality.operators.encode import hash_embed
    p = table(spark, sf_dir, "pages").select(
        "page_id", F.filter(F.split(F.lower("url"), "[^a-z]+"), lambda w: F.length(w) > 0).alias("_w"))
    return hash_embed(p, "_w", dim, "s_vec", keep=["page_id"])


def turn_vectors(spark: SparkSession, sf_dir: str, dim: int = 32) -> DataFrame:
    """A third modality: ``conv_id, turn, e_vec`` = hashed words of each conversation turn."""
    from tonality.functions.text import clean_ascii, words
    from tonality.operators.encode import hash_embed
    c = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", words(clean_ascii("text"), 1).alias("_w"))
    return hash_embed(c, "_w", dim, "e_vec", keep=["conv_id", "turn"])
