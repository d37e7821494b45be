"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A document's fingerprint is the bitwise majority of the 64-bit hashes of its word shingles.
Fingerprints within ``radius`` bits link. Each distinct fingerprint emits every variant within
half the radius; two linked fingerprints always share a variant, so one shuffle on variants
brings every link together. A variant holds at most as many distinct fingerprints as the ball
has masks (65 for radius 2), whatever the data; copies were collapsed before. In a variant's
group every fingerprint is tied to the smallest *centre* (a fingerprint within ``radius // 2``
of the variant), which keeps all components without emitting all pairs.

Defined cases: null or wordless text has fingerprint zero and links like any other; fewer words
than the shingle length make one shingle; repeated rows and equal ids get equal results; a null
``doc_id`` is carried but is never a component id unless all ids of the component are null; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonality.llm.common import arrow_map, column_bytes, text_hash, texts, word_offsets, written_once
from tonality.llm.components import connected_components

SEED = 42
SLAB = 1 << 16  # shingles hashed at a time: bounds memory for very long texts


def fingerprint(data: bytes | None, shingle: int) -> int:
    """The fingerprint of one UTF-8 text as a signed 64-bit integer (0 without words)."""
    words = (data or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    starts, ends = word_offsets(words)
    if len(words) > shingle:
        starts, ends = starts[:len(words) - shingle + 1], ends[shingle - 1:]
    else:
        starts, ends = starts[:1], ends[-1:]
    ones = np.zeros(64, np.int64)
    for a in range(0, len(starts), SLAB):
        spans = zip(starts[a:a + SLAB].tolist(), ends[a:a + SLAB].tolist())
        digests = b"".join([xxhash.xxh64_digest(joined[s:e], SEED) for s, e in spans])
        ones += np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(starts)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``doc_id, text_hash, fp`` per row; one narrow pass over the texts."""
    src = texts(docs).withColumn("text_hash", text_hash())

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = [fingerprint(t, shingle) for t in column_bytes(batch, "text")]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(fps, pa.int64())],
                                          names=["doc_id", "text_hash", "fp"])
    return arrow_map(src, run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, text_hash long, fp long")


def _masks(radius: int) -> list[int]:
    out = []
    for r in range(radius + 1):
        for bits in combinations(range(64), r):
            m = sum(1 << b for b in bits)
            out.append(m - (1 << 64) if m >= 1 << 63 else m)
    return out


def links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """Distinct ``(a, b)`` fingerprint links that connect every pair within ``radius`` bits.

    Both ends of each link are verified. A pair itself need not be listed when a third
    fingerprint of the same variant ties its two ends.
    """
    inner, outer = radius // 2, radius - radius // 2
    variants = (fps.select("fp").distinct()
                .select("fp", F.explode(F.lit(_masks(outer))).alias("mask"))
                .select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"),
                        (F.bit_count("mask") <= inner).alias("central")))
    group = Window.partitionBy("variant")
    centre = F.min(F.when(F.col("central"), F.col("fp"))).over(group)
    return (variants.select("fp", centre.alias("centre"))
            .where("centre IS NOT NULL AND fp <> centre")
            .where(F.bit_count(F.col("fp").bitwiseXOR(F.col("centre"))) <= radius)
            .select(F.col("centre").alias("a"), F.col("fp").alias("b")).distinct())


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """``doc_id, text_hash, fp, component_id, root_fp`` per row.

    ``component_id`` is the smallest id reachable by links, ``root_fp`` the component's smallest
    fingerprint (the component's own key where ids are null or repeat).
    """
    fps = written_once(lambda: fingerprints(docs, shingle), "simhash-fp")
    firsts = fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    roots = connected_components(links(fps, radius), "simhash-cc")
    nodes = firsts.join(roots, firsts["fp"] == roots["node"], "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root_fp"))
    smallest = nodes.groupBy("root_fp").agg(F.min("first_id").alias("component_id"))
    of_fp = nodes.select("fp", "root_fp").join(smallest, "root_fp")
    return fps.join(of_fp, "fp").select("doc_id", "text_hash", "fp", "component_id", "root_fp")


def keep_one(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """``docs`` with one row for each group: the one with the smallest id (then smallest text hash).

    Rows that repeat both id and text count as one. All columns are kept as they are.
    """
    found = near_duplicates(docs, shingle, radius)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("best")
    kept = (found.groupBy("root_fp").agg(best)
            .select(F.col("best.doc_id").alias("_k_id"), F.col("best.text_hash").alias("_k_hash")))
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_id"), text_hash("text").alias("_hash"))
    out = rows.join(kept, rows["_id"].eqNullSafe(kept["_k_id"]) & (rows["_hash"] == kept["_k_hash"]))
    return out.dropDuplicates(["_id", "_hash"]).select("_row.*")
