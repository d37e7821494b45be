"""Lexicon operators: name lookup, occurrence filter, scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonality.functions.labels import label_majority, label_name, sentiment_score
from tonality.functions.text import strip_ws


def demojize(df: DataFrame, col: str, names: DataFrame, symbol: str = "symbol", name: str = "name",
             out: str = "emoji_clean") -> DataFrame:
    """Replace a symbol by its short name (``:red_heart:``); unknown symbols stay as they are.

    A left join against the name table; the planner broadcasts it if its real size allows.
    """
    lookup = names.select(F.col(symbol).alias("_sym"), F.col(name).alias("_name"))
    # a symbol table may list a symbol twice; keep one name per symbol so the join cannot add rows
    lookup = lookup.groupBy("_sym").agg(F.min("_name").alias("_name"))
    joined = df.join(lookup, F.col(col) == F.col("_sym"), "left")
    return joined.withColumn(out, strip_ws(F.coalesce(F.col("_name"), F.col(col).cast("string")))).drop("_sym", "_name")


def min_occurrences(df: DataFrame, n: int = 100, col: str = "Occurrences") -> DataFrame:
    """Keep symbols seen at least ``n`` times (pushed below any later projection by Catalyst)."""
    return df.where(F.col(col) >= n)


def lexicon_labels(df: DataFrame, symbol: str = "Emoji") -> DataFrame:
    """P7 applied to a lexicon: ``emoji, sentiment_label, label_numeric`` (emoji_dataset_info shape)."""
    code = label_majority("Negative", "Neutral", "Positive")
    return df.select(F.col(symbol).alias("emoji"), label_name(code).alias("sentiment_label"),
                     code.alias("label_numeric"))


def score_lexicon(df: DataFrame, n: int = 100, symbol: str = "Emoji") -> DataFrame:
    """P8 + P9: ``Emoji, sentiment_score, Occurrences`` for symbols seen at least ``n`` times."""
    return min_occurrences(df, n).select(
        symbol, sentiment_score("Positive", "Negative", "Occurrences").alias("sentiment_score"), "Occurrences")
