"""File sources and sinks: CSV readers with declared schemas, CSV sink, Parquet bundles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

REVIEW_COLUMNS = {"verified_reviews": "string", "rating": "double"}
LEXICON_COLUMNS = {"Emoji": "string", "Negative": "bigint", "Neutral": "bigint", "Positive": "bigint",
                   "Occurrences": "bigint"}


def _read_named(spark: SparkSession, path: str, columns: dict[str, str], multiline: bool) -> DataFrame:
    """Read a headed CSV with every field as text, then pick and cast columns by header name.

    Nothing is inferred (no extra pass over the data) and column order in the file does not
    matter, unlike a positional schema. A field that does not read as its type is null.
    """
    raw = (spark.read.option("header", True).option("multiLine", multiline).option("escape", '"')
           .option("inferSchema", False).option("encoding", "UTF-8").csv(path))
    missing = [c for c in columns if c not in raw.columns]
    if missing:
        raise ValueError(f"{path}: missing columns {missing}")
    raw = raw.withColumn("_path", F.col("_metadata.file_path"))
    return raw.select("_path", *[F.col(c).try_cast(t).alias(c) for c, t in columns.items()],
                      *[c for c in raw.columns if c not in columns and c == "review_id"])


def read_reviews(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """``review_id, verified_reviews, rating``.

    A quoted review may hold line breaks, so by default a file is read by one task. ``multiline=False``
    promises that no field holds one: large files are then split among tasks.

    A ``review_id`` column in the file is used as the key; otherwise one is assigned: the row's
    position in the order of file path and content, which no split of the files changes.
    """
    df = _read_named(spark, path, REVIEW_COLUMNS, multiline)
    if "review_id" in df.columns:
        return df.select(F.col("review_id").cast("long"), "verified_reviews", "rating")
    from tonality.operators.split import positional_index
    keyed = positional_index(df, ["_path", "verified_reviews", "rating"], name="review_id")
    return keyed.select("review_id", "verified_reviews", "rating")


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """Emoji lexicon ``Emoji, Negative, Neutral, Positive, Occurrences``."""
    return _read_named(spark, path, LEXICON_COLUMNS, multiline=False).drop("_path")


def _flatten_arrays(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.ArrayType) and not isinstance(f.dataType.elementType, (T.ArrayType, T.StructType, T.MapType)):
            cols.append(F.concat(F.lit("["), F.array_join(F.col(f.name).cast("array<string>"), ", "), F.lit("]")).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", single_file: bool = False) -> None:
    """Headed CSV; list columns become ``[a, b, c]`` text (widen vectors first with S10 for one
    column per value). ``single_file`` only for small results."""
    out = _flatten_arrays(df)
    if single_file:
        out = out.coalesce(1)
    (out.write.mode(mode).option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).csv(path))


def write_bundle(df: DataFrame, path: str, split_col: str = "split", mode: str = "overwrite") -> None:
    """A named tensor bundle is one Parquet dataset partitioned by split."""
    w = df.write.mode(mode)
    if split_col in df.columns:
        w = w.partitionBy(split_col)
    w.parquet(path)


def read_bundle(spark: SparkSession, path: str, split: str | None = None, split_col: str = "split") -> DataFrame:
    """Read a bundle; asking for one split prunes the other partitions at the file listing."""
    df = spark.read.parquet(path)
    if split is not None:
        df = df.where(F.col(split_col) == split)
    return df
