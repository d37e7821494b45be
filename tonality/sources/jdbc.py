"""Database tables in and out.

With a JDBC ``url`` the read is split into ``num_partitions`` range queries on the numeric key
(each executor reads its own slice); without one the table comes from the session catalog.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_comments(spark: SparkSession, table: str = "product_comments", url: str | None = None,
                  properties: dict | None = None, key: str = "id", text: str = "comment_text",
                  num_partitions: int = 64, bounds: tuple[int, int] | None = None) -> DataFrame:
    """``id, comment_text`` (only these two columns are fetched)."""
    if url is None:
        return spark.table(table).select(key, text)
    props = dict(properties or {})
    if bounds is None:
        row = spark.read.jdbc(url, f"(SELECT MIN({key}) AS lo, MAX({key}) AS hi FROM {table}) b", properties=props).first()
        bounds = (int(row["lo"] or 0), int(row["hi"] or 0))
    query = f"(SELECT {key}, {text} FROM {table}) c"
    return spark.read.jdbc(url, query, column=key, lowerBound=bounds[0], upperBound=bounds[1] + 1,
                           numPartitions=num_partitions, properties=props)


def write_sentiments(df: DataFrame, table: str = "product_sentiments", url: str | None = None,
                     properties: dict | None = None, mode: str = "overwrite",
                     num_partitions: int = 16, batch_size: int = 10_000) -> None:
    """Replace the output table with ``id, sentiment`` (and any other columns given).

    A JDBC target sees at most ``num_partitions`` connections, each writing ``batch_size`` rows a time."""
    if url is None:
        df.write.mode(mode).saveAsTable(table)
    else:
        (df.write.mode(mode).option("numPartitions", num_partitions).option("batchsize", batch_size)
         .jdbc(url, table, properties=dict(properties or {})))
