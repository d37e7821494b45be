"""Rows of equal key found by range partitioning, a secondary sort and one streaming pass.

Rows ``(k1, k2, d1, d2, pos)`` carry a 128-bit key, a unit ``(d1, d2)`` (a document) and a
position. They are range-partitioned on key and unit, so a key that holds a third of all rows
is cut into many ranges instead of landing in one task; within a partition they are sorted by
key, unit and position and read once as Arrow batches. Memory is one batch plus the rows of one
undecided run (fewer than ``min_units`` units).

Only the first and the last run of a partition can continue next door. Of those, the first row
is always reported with the number of units seen, and the others too while undecided; these few
rows are settled by one small aggregate and join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COLUMNS = ("k1", "k2", "d1", "d2", "pos")
SCHEMA = "k1 long, k2 long, d1 long, d2 long, pos int, open boolean, units int, head boolean"


def _arrays(batch: pa.RecordBatch) -> list[np.ndarray]:
    """The five columns plus ``d1 is null``; nulls are read as 0."""
    d1 = batch.column("d1")
    cols = [batch.column(c).fill_null(0).to_numpy(zero_copy_only=False) for c in COLUMNS]
    return cols + [d1.is_null().to_numpy(zero_copy_only=False)]


def _new(cols: list[np.ndarray], which: tuple[int, ...]) -> np.ndarray:
    """True where a row differs from the one before it in any of the columns; the first row is True."""
    out = np.ones(len(cols[0]), bool)
    out[1:] = False
    for i in which:
        out[1:] |= cols[i][1:] != cols[i][:-1]
    return out


def _block(cols: list[np.ndarray], open_: np.ndarray, units: np.ndarray, head: np.ndarray) -> pa.RecordBatch:
    d1 = pa.array(cols[2], pa.int64(), mask=cols[5].astype(bool))
    arrays = [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), d1, pa.array(cols[3], pa.int64()),
              pa.array(cols[4], pa.int32()), pa.array(open_), pa.array(units.astype(np.int32)), pa.array(head)]
    return pa.RecordBatch.from_arrays(arrays, names=[*COLUMNS, "open", "units", "head"])


def _stream(batches: Iterator[pa.RecordBatch], min_units: int, keep_first: bool,
            unit: tuple[int, ...] = (2, 3, 5)) -> Iterator[pa.RecordBatch]:
    rest: list[np.ndarray] | None = None  # rows of the last, undecided run
    running: tuple | None = None  # key of a run that was decided while still open
    first = True  # the run at the front is the partition's first one

    def report(cols, starts, sizes, units, edge):
        """Rows of runs that qualify, and those of edge runs."""
        if not len(starts):
            return None
        good = units >= min_units
        run = np.repeat(np.arange(len(starts)), sizes)
        head = np.zeros(len(run), bool)
        head[starts] = True
        open_ = edge[run] & (head | ~good[run])
        take = open_ | (good[run] & ~(head & keep_first))
        if not take.any():
            return None
        n = np.where(head & open_, units[run], 0)
        return _block([c[take] for c in cols], open_[take], n[take], (head & open_)[take])

    for b in batches:
        if not b.num_rows:
            continue
        cols = _arrays(b)
        if running is not None:
            n = int(np.argmax(_new_from(cols, running))) if _new_from(cols, running).any() else len(cols[0])
            if n:
                part = [c[:n] for c in cols]
                yield _block(part, np.zeros(n, bool), np.zeros(n, int), np.zeros(n, bool))
                cols = [c[n:] for c in cols]
            if not len(cols[0]):
                continue
            running, first = None, False
        if rest is not None:
            cols = [np.concatenate([a, c]) for a, c in zip(rest, cols)]
            rest = None
        new_key = _new(cols, (0, 1))
        starts = np.flatnonzero(new_key)
        sizes = np.diff(np.append(starts, len(new_key)))
        units = np.add.reduceat((new_key | _new(cols, unit)).astype(np.int64), starts)
        edge = np.zeros(len(starts), bool)
        edge[0] = first
        last = starts[-1]
        closed = report([c[:last] for c in cols], starts[:-1], sizes[:-1], units[:-1], edge[:-1])
        if closed is not None:
            yield closed
        if len(starts) > 1:
            first = False
        tail = [c[last:] for c in cols]
        if units[-1] >= min_units:  # decided: it streams on; it may reach the partition's end, so its head stays open
            yield report(tail, np.array([0]), sizes[-1:], units[-1:], np.array([True]))
            running = (tail[0][0], tail[1][0])
        else:
            rest = tail
    if rest is not None:
        units = np.array([_new(rest, unit).sum()])
        out = report(rest, np.array([0]), np.array([len(rest[0])]), units, np.array([True]))
        if out is not None:
            yield out


def _new_from(cols: list[np.ndarray], key: tuple) -> np.ndarray:
    return (cols[0] != key[0]) | (cols[1] != key[1])


def repeated(rows: DataFrame, min_units: int, keep_first: bool = False, partitions: int | None = None,
             each_row: bool = False) -> DataFrame:
    """Rows ``SCHEMA`` of keys with ``min_units`` units or more, and the open ones of partition edges.

    ``each_row`` makes every position its own unit. The caller writes the result once (it is
    small, and :func:`settle` reads it twice) and gives it to :func:`settle`.
    """
    spark = rows.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = ["k1", "k2", "d1", "d2"] + ["pos"] * each_row
    ranged = rows.repartitionByRange(n, *by).sortWithinPartitions(*COLUMNS)
    unit = (2, 3, 4, 5) if each_row else (2, 3, 5)
    return ranged.mapInArrow(lambda it: _stream(it, min_units, keep_first, unit), SCHEMA)


def settle(stream: DataFrame, min_units: int, keep_first: bool = False) -> DataFrame:
    """``d1, d2, pos`` of every row whose key has ``min_units`` units (without the first row if ``keep_first``)."""
    edges = stream.where("open")
    row = F.struct("d1", "d2", "pos")
    total = (edges.groupBy("k1", "k2")
             .agg(F.sum("units").alias("total"), F.min(F.when(F.col("head"), row)).alias("front"))
             .where(F.col("total") >= min_units).select("k1", "k2", "front"))
    late = edges.join(total, ["k1", "k2"])
    if keep_first:
        late = late.where(~row.eqNullSafe(F.col("front")))
    return stream.where("NOT open").select("d1", "d2", "pos").unionByName(late.select("d1", "d2", "pos"))
