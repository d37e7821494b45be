"""Exact substring deduplication with difference-cover anchors.

A word is removed if it lies in a window of ``length`` words whose word sequence also starts
anywhere else, in any document. Hashing every window would move every position of the corpus;
instead only the windows that start at positions of a difference cover modulo ``period`` are
hashed: for any two positions some shift below ``period`` brings both onto the cover, so any two
equal windows of ``length`` words share an aligned anchor of ``length - period + 1`` words inside
them (with period 21, five positions in 21 are hashed).

1. Anchors ``(hash, document, position)`` are range-partitioned, sorted and streamed
   (:mod:`runs`); those that occur once go.
2. Around the others the match is extended: each window of ``length`` words that contains a
   repeated anchor is hashed in full (96 bits) and the same stream keeps those that repeat.
3. The starts found return to their documents, which drop the covered words.

Hot anchors are split by the range partitioning; no pairs are formed and no group is collected.

Defined cases: null text has no words; texts shorter than ``length`` words lose nothing; rows with
the same id and text are one document and get the same result, equal texts under other ids are
others; a null ``doc_id`` is an id like any other; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

from itertools import combinations, compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonality.llm.common import arrow_map, column_bytes, text_hash, texts, word_offsets, written_once
from tonality.llm.runs import repeated, settle
from tonality.session import drop_scratch

ROW = "k1 long, k2 long, d1 long, d2 long, pos int"


def difference_cover(period: int) -> list[int]:
    """Residues such that every difference modulo ``period`` occurs between two of them."""
    if period <= 31:  # the smallest one, by search
        for size in range(1, period + 1):
            for rest in combinations(range(1, period), size - 1):
                if len({(a - b) % period for a in (0, *rest) for b in (0, *rest)}) == period:
                    return [0, *rest]
    root = int(np.ceil(np.sqrt(period)))
    return sorted({*range(root), *range(0, period, root), period - 1})


def _rows(batch: pa.RecordBatch, keys: list[bytes], pos: list[int], counts: list[int]) -> pa.RecordBatch:
    """Rows of ``ROW`` from 8- or 16-byte keys, ``counts`` of them for each document of the batch.

    Of 16 bytes 12 are kept (a 96-bit key): the rest would only be shuffled.
    """
    width = len(keys[0]) // 8 if keys else 1
    key = np.frombuffer(b"".join(keys), ">i8").reshape(-1, width).astype(np.int64)
    owner = pa.array(np.repeat(np.arange(len(counts)), counts))
    second = key[:, 1] & 0xFFFFFFFF if width > 1 else np.zeros(len(key), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(key[:, 0]), pa.array(second), batch.column("d1").take(owner),
                                       batch.column("d2").take(owner), pa.array(pos, pa.int32())],
                                      names=["k1", "k2", "d1", "d2", "pos"])


def _sources(docs: DataFrame) -> DataFrame:
    return texts(docs).select(F.col("doc_id").cast("long").alias("d1"), text_hash().alias("d2"), "text")


def anchors(docs: DataFrame, length: int, period: int) -> DataFrame:
    """``ROW``: hashes of the anchors at cover positions of every text of ``length`` words or more."""
    size, cover = length - period + 1, difference_cover(period)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, pos, counts = [], [], []
        for text in column_bytes(batch, "text"):
            words = (text or b"").split()
            n = len(words) - size + 1 if len(words) >= length else 0
            if n <= 0:
                counts.append(0)
                continue
            joined = b" ".join(words)
            starts, ends = word_offsets(words)
            at = np.add.outer(np.arange(0, n, period), cover).ravel()
            at = at[:np.searchsorted(at, n)]
            keys += [xxhash.xxh3_64_digest(joined[s:e]) for s, e in zip(starts[at].tolist(), ends[at + size - 1].tolist())]
            pos += at.tolist()
            counts.append(len(at))
        return _rows(batch, keys, pos, counts)
    return arrow_map(_sources(docs), run, ROW)


def spread(at: np.ndarray, before: int, after: int, n: int) -> np.ndarray:
    """Which of ``n`` places lie in ``[a - before, a + after]`` for some ``a`` of ``at``."""
    change = np.bincount(np.clip(at - before, 0, n), minlength=n + 1) - np.bincount(np.clip(at + after + 1, 0, n), minlength=n + 1)
    return np.cumsum(change[:n]) > 0


def _positions(batch: pa.RecordBatch) -> list[np.ndarray]:
    """The lists of column ``at`` as slices of one array; a null list is empty."""
    at = batch.column("at")
    values, edges = at.values.to_numpy(zero_copy_only=False).astype(np.int64), at.offsets.to_numpy().tolist()
    return [values[a:z] for a, z in zip(edges, edges[1:])]


def _joined(docs: DataFrame, starts: DataFrame, how: str) -> DataFrame:
    """``d1, d2, text`` and ``at``, the positions found in each document."""
    by_doc = (starts.groupBy("d1", "d2").agg(F.collect_set("pos").alias("at"))
              .withColumnsRenamed({"d1": "_d1", "d2": "_d2"}))
    src = _sources(docs)
    return src.join(by_doc, (src["d2"] == by_doc["_d2"]) & src["d1"].eqNullSafe(by_doc["_d1"]), how).select("d1", "d2", "text", "at")


def windows(docs: DataFrame, anchored: DataFrame, length: int, period: int) -> DataFrame:
    """``ROW``: every window of ``length`` words around the repeated anchors ``d1, d2, pos``."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, pos, counts = [], [], []
        for text, at in zip(column_bytes(batch, "text"), _positions(batch)):
            words = (text or b"").split()
            n = len(words) - length + 1
            joined = b" ".join(words)
            starts, ends = word_offsets(words)
            here = np.flatnonzero(spread(at, period - 1, 0, n))
            keys += [xxhash.xxh3_128_digest(joined[s:e]) for s, e in zip(starts[here].tolist(), ends[here + length - 1].tolist())]
            pos += here.tolist()
            counts.append(len(here))
        return _rows(batch, keys, pos, counts)
    return arrow_map(_joined(docs, anchored, "inner"), run, ROW)


def repeated_windows(docs: DataFrame, length: int = 35, period: int = 21) -> DataFrame:
    """``d1, d2, pos``: the starts of windows of ``length`` words that also start elsewhere, by document (id, text hash)."""
    if not 1 <= period <= length:
        raise ValueError("period must lie between 1 and length")
    near = written_once(lambda: repeated(anchors(docs, length, period), 2, each_row=True), "anchors")
    far = written_once(lambda: repeated(windows(docs, settle(near, 2), length, period), 2, each_row=True), "windows")
    drop_scratch(near)
    return settle(far, 2)


def kept_words(text: bytes, at: np.ndarray | None, length: int) -> tuple[int, list[bytes]]:
    """Number of words before, and the words that stay."""
    words = text.split()
    if at is None or not len(at):
        return len(words), words
    gone = spread(np.asarray(at), 0, length - 1, len(words))
    return len(words), list(compress(words, (~gone).tolist()))


def remove_repeated(docs: DataFrame, length: int = 35, period: int = 21) -> DataFrame:
    """``doc_id, n_words, n_removed, text`` per row; ``text`` holds the words that stay, joined by one space."""
    joined = _joined(docs, repeated_windows(docs, length, period), "left")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        done = [kept_words(t or b"", a, length) for t, a in zip(column_bytes(batch, "text"), _positions(batch))]
        return pa.RecordBatch.from_arrays(
            [batch.column("d1"), pa.array([n for n, _ in done], pa.int64()), pa.array([n - len(k) for n, k in done], pa.int64()),
             pa.array([b" ".join(k) for _, k in done], pa.binary()).cast(pa.string())],
            names=["doc_id", "n_words", "n_removed", "text"])
    return arrow_map(joined, run, "doc_id long, n_words long, n_removed long, text string")
