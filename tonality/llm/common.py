"""Shared helpers of the training-data operators: row identity, Arrow-batch maps, word offsets."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonality.session import materialize, ship_package

# Fixed value: the separators between words, [\x20\x09-\x0D] (what ``bytes.split()`` splits at).
SPACE = b" \t\n\v\f\r"


def table(spark, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only ``doc_id`` and ``text``: other columns, whatever their names, take no part in an operator."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def text_hash(text: str = "text") -> Column:
    """64-bit hash of a whole text; with ``doc_id`` it names a row.

    Rows with the same id and the same text are one document; rows with the same id and other
    texts are different ones. Null and empty text hash alike.
    """
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def arrow_map(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` over single batches: ``fn(batch)`` gives one output batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield fn(b)
    return df.mapInArrow(run, schema)


def column_bytes(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A string column as UTF-8 bytes, one per row, without decoding them."""
    return batch.column(name).cast(pa.binary()).to_pylist()


def written_once(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """``materialize`` what ``make()`` gives (a Parquet table in the shared checkpoint folder), and let
    Spark's cleaner free the shuffle files behind it. It does so once the driver has collected the
    plan, so nothing outside may hold it: hence a function."""
    df = make()
    out = materialize(df, name)
    del df
    for _ in range(2):  # Python tells the JVM of its dropped references with the next call only
        gc.collect()
        out.sparkSession._jvm.System.gc()
    return out


_STATE: dict = {}


def worker_state(key: tuple, make: Callable):
    """What a Python worker remembers from batch to batch and task to task (tables of known words).

    One entry only: when another operator's tasks reach the worker, the tables of the one before go,
    so a job of many operators needs no more memory than its largest.
    """
    if key not in _STATE:
        _STATE.clear()
        _STATE[key] = make()
    return _STATE[key]


def word_offsets(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word in ``b" ".join(words)``."""
    n = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(n + 1) - 1
    return ends - n, ends
