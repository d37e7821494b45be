"""Connected components of a link table by alternating large-star and small-star rounds.

All state stays in written tables in the shared checkpoint folder; the driver sees only a row
count and a checksum per round. A node's smallest neighbour comes from a map-side combined
``min`` and is joined back, so a node that holds a third of all links is split like any skewed join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonality.session import drop_scratch, materialize


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    low = e.groupBy("u").agg(F.min("v").alias("m"))  # every edge has u > v
    moved = e.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _state(e: DataFrame) -> tuple:
    r = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def connected_components(links: DataFrame, name: str) -> DataFrame:
    """``node, root`` for every node of ``links(a, b)`` that is not the smallest of its component.

    ``root`` is the component's smallest node. Rounds needed grow with the logarithm of the
    largest component. Null ends and self-links are ignored; no links give an empty table.
    """
    e = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    state = _state(e)
    while state[0]:
        nxt = materialize(_small_star(_large_star(e)), name)
        drop_scratch(e)
        e, before, state = nxt, state, _state(nxt)
        if state == before:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
