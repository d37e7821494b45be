"""Line deduplication: range-partitioned line hashes, secondary sort, streamed decisions, keep bitmaps.

Texts are split at ``\\n``; a line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` at both ends
with A-Z lower-cased. One narrow pass turns every line into ``(128-bit key hash, document,
line number)``; :mod:`runs` range-partitions these on hash and document, sorts by hash, document
and position and streams them, so that the first occurrence of a key comes first. Decisions come
back as one compressed keep bitmap for each document that loses lines; texts move once, when a
bitmap meets its document.

Defined cases: null text is empty; an empty text is one empty line; empty keys never count; rows
with the same id and text are one document (for counting) and get the same result; a null
``doc_id`` is an id like any other; an empty table gives an empty result; extra columns of any
name are carried by :func:`drop_lines` and ignored elsewhere.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonality.llm.common import SPACE, arrow_map, column_bytes, text_hash, texts, written_once
from tonality.llm.runs import repeated, settle


def line_key(line: bytes) -> bytes:
    return line.strip(SPACE).lower()


def line_rows(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """``k1, k2, d1, d2, pos``: every line whose key has ``min_chars`` code points or more."""
    src = texts(docs).select(F.col("doc_id").cast("long").alias("d1"), text_hash().alias("d2"), "text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        digests, counts, pos = [], [], []
        for text in column_bytes(batch, "text"):
            keys = [line_key(x) for x in (text or b"").split(b"\n")]
            at = [i for i, k in enumerate(keys) if k and (min_chars <= 1 or len(k.decode()) >= min_chars)]
            digests += [xxhash.xxh3_128_digest(keys[i]) for i in at]
            pos += at
            counts.append(len(at))
        key = np.frombuffer(b"".join(digests), ">i8").reshape(-1, 2).astype(np.int64)
        row = pa.array(np.repeat(np.arange(len(counts)), counts))
        return pa.RecordBatch.from_arrays(
            [pa.array(key[:, 0]), pa.array(key[:, 1]), batch.column("d1").take(row), batch.column("d2").take(row),
             pa.array(pos, pa.int32())], names=["k1", "k2", "d1", "d2", "pos"])
    return arrow_map(src, run, "k1 long, k2 long, d1 long, d2 long, pos int")


def pack(dropped: list[int]) -> bytes:
    """Keep bitmap of a document: bit i is 0 if line i goes; lines past its end are kept."""
    keep = np.ones(-(-(max(dropped) + 1) // 8) * 8, np.uint8)  # whole bytes, filled with ones
    keep[dropped] = 0
    return zlib.compress(np.packbits(keep).tobytes(), 1)


def unpack(bitmap: bytes | None, n_lines: int) -> np.ndarray:
    """The keep flag of each of ``n_lines`` lines."""
    keep = np.ones(n_lines, bool)
    if bitmap is not None:
        bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8))[:n_lines]
        keep[:len(bits)] = bits.astype(bool)
    return keep


def keep_bitmaps(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """``d1, d2, n_dropped, keep`` for each document (id, text hash) that loses lines.

    A key found in ``min_docs`` documents or more loses all its lines, or with ``keep_first`` all
    but the first by document id, text hash and line number.
    """
    stream = written_once(lambda: repeated(line_rows(docs, min_chars), min_docs, keep_first), "line-runs")
    by_doc = settle(stream, min_docs, keep_first).groupBy("d1", "d2").agg(F.collect_set("pos").alias("dropped"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        dropped = batch.column("dropped").to_pylist()
        return pa.RecordBatch.from_arrays(
            [batch.column("d1"), batch.column("d2"), pa.array([len(x) for x in dropped], pa.int64()),
             pa.array([pack(x) for x in dropped], pa.binary())], names=["d1", "d2", "n_dropped", "keep"])
    return arrow_map(by_doc, run, "d1 long, d2 long, n_dropped long, keep binary")


def _with_bitmaps(rows: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``rows`` (with ``_id``, ``_hash``) and ``n_dropped``, ``keep`` of their bitmaps."""
    b = bitmaps.withColumnsRenamed({"d1": "_b_id", "d2": "_b_hash"})
    return (rows.join(b, (rows["_hash"] == b["_b_hash"]) & rows["_id"].eqNullSafe(b["_b_id"]), "left")
            .drop("_b_id", "_b_hash"))


def kept_text(text: bytes, bitmap: bytes | None) -> tuple[int, bytes]:
    """Number of lines before, and the text of the lines that stay."""
    lines = text.split(b"\n")
    if bitmap is None:
        return len(lines), text
    return len(lines), b"\n".join([x for x, k in zip(lines, unpack(bitmap, len(lines))) if k])


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """``doc_id, n_lines, n_dropped, text`` per row; ``text`` is what stays."""
    bitmaps = keep_bitmaps(docs, min_docs, min_chars, keep_first)
    rows = texts(docs).withColumns({"_id": F.col("doc_id").cast("long"), "_hash": text_hash()})
    joined = _with_bitmaps(rows, bitmaps).select("doc_id", "text", "n_dropped", "keep")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        done = [kept_text(t or b"", k) for t, k in zip(column_bytes(batch, "text"), batch.column("keep").to_pylist())]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([n for n, _ in done], pa.int64()), batch.column("n_dropped").fill_null(0),
             pa.array([t for _, t in done], pa.binary()).cast(pa.string())], names=["doc_id", "n_lines", "n_dropped", "text"])
    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_map(joined, run, f"doc_id {kind}, n_lines long, n_dropped long, text string")


def drop_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """``docs`` with the lines that go taken out of ``text``; ``n_chars``, if there, is the new length.

    All rows and columns stay. A row that loses nothing is left as it is (also a null text).
    """
    bitmaps = keep_bitmaps(docs, min_docs, min_chars, keep_first)
    rows = docs.select(F.struct("*").alias("_row"), F.col("text").alias("_text"),
                       F.col("doc_id").cast("long").alias("_id"), text_hash("text").alias("_hash"))
    joined = _with_bitmaps(rows, bitmaps).select("_row", "_text", "keep")
    flags = arrow_map(joined, _apply, joined.select("_row", "_text").schema)
    text = F.col("_text")
    out = {c: F.col("_row")[c] for c in docs.columns}
    out["text"] = text
    if "n_chars" in out:
        out["n_chars"] = F.when(text.isNull(), F.col("_row.n_chars")).otherwise(F.char_length(text).cast(docs.schema["n_chars"].dataType))
    return flags.select(*[v.alias(k) for k, v in out.items()])


def _apply(batch: pa.RecordBatch) -> pa.RecordBatch:
    done = [t if k is None else kept_text(t or b"", k)[1]
            for t, k in zip(column_bytes(batch, "_text"), batch.column("keep").to_pylist())]
    return pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(done, pa.binary()).cast(pa.string())],
                                      names=["_row", "_text"])
