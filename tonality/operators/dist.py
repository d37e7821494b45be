"""Distributions and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonality.session import materialize


def class_distribution(df: DataFrame, label: str = "label", dense: bool = False) -> DataFrame:
    """A1 / A2: rows per class, most frequent first.

    ``dense=True`` is the ``bincount`` form: one row for every code from 0 to the largest code
    seen, with 0 for an absent code. The counts are written once; only the largest code reaches
    the driver, and the grid is a distributed range, so a stray large code costs no single task.
    """
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("count"))
    if dense:
        spark = df.sparkSession
        counts = materialize(counts.withColumn(label, F.col(label).cast("int")), "class-counts")
        top = counts.agg(F.max(label)).first()[0]
        grid = spark.range(0 if top is None else top + 1).select(F.col("id").cast("int").alias(label))
        counts = grid.join(counts, label, "left").select(label, F.coalesce("count", F.lit(0)).cast("long").alias("count"))
    return counts.orderBy(F.desc("count"), F.asc(label))


def distinct_labels(df: DataFrame, label: str = "label") -> DataFrame:
    """A3: the distinct non-null labels."""
    return df.select(label).where(F.col(label).isNotNull()).distinct()


def num_classes(df: DataFrame, label: str = "label") -> DataFrame:
    """A3: number of distinct labels as a one-row frame."""
    return df.agg(F.count_distinct(label).alias("num_classes"))


def dataset_profile(df: DataFrame, vector_cols: tuple[str, ...] = ()) -> DataFrame:
    """Row count, column count and, per vector column, the largest width seen."""
    aggs = [F.count(F.lit(1)).alias("rows"), F.lit(len(df.columns)).cast("long").alias("columns")]
    for c in vector_cols:
        aggs.append(F.max(F.size(c)).cast("long").alias(f"{c}_dim"))
    return df.agg(*aggs)


def class_weights(df: DataFrame, label: str = "label", split_col: str | None = None,
                  scope: str = "train") -> DataFrame:
    """A5: inverse-frequency weight ``1/count`` per class.

    ``scope="train"`` counts only rows of the training split (``split_col == 'train'``);
    ``scope="all"`` counts every row, as the reference does. A class with no row gets no weight
    row (the reference's value would be infinite).
    """
    src = df
    if scope == "train" and split_col is not None:
        src = df.where(F.col(split_col) == "train")
    return (src.where(F.col(label).isNotNull()).groupBy(label)
            .agg(F.count(F.lit(1)).alias("count"))
            .select(label, "count", (F.lit(1.0) / F.col("count").cast("double")).alias("weight")))


def with_class_weight(df: DataFrame, weights: DataFrame, label: str = "label") -> DataFrame:
    """Attach each row's class weight. Every row stays: a class without a weight row (one that
    the training rows lack) gets a null weight. The planner picks the join from the real size."""
    return df.join(weights.select(label, "weight"), label, "left")


def category_counts(df: DataFrame, category: str = "category", with_total: bool = True) -> DataFrame:
    """A4 / K2: rows per category, largest first, plus a grand-total row (``is_total = 1``).

    Empty categories cannot appear (they have no rows), matching the reference skipping empty
    folders.
    """
    if not with_total:
        return (df.groupBy(category).agg(F.count(F.lit(1)).alias("count"))
                .orderBy(F.desc("count"), F.asc(category)))
    return (df.rollup(category)
            .agg(F.count(F.lit(1)).alias("count"), F.grouping_id().cast("int").alias("is_total"))
            .orderBy(F.asc("is_total"), F.desc("count"), F.asc(category)))


def unique_tokens(df: DataFrame, col: str) -> DataFrame:
    """Distinct values of a string column."""
    return df.select(col).where(F.col(col).isNotNull()).distinct()
