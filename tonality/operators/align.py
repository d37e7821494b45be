"""Aligning modalities.

The reference pairs row ``i`` of one modality with row ``i`` of another. Here the default is a
key join (``align_keyed``); the positional form (``align_positional``) is kept as an explicit
operator that needs a declared order key on each side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonality.functions.vectors import zeros
from tonality.operators.split import positional_index


def align_positional(base: DataFrame, other: DataFrame, base_order, other_order, vec_col: str,
                     dim: int, other_cols: list[str] | tuple = (), out: str | None = None,
                     pos: str = "pos") -> DataFrame:
    """Give base row ``i`` (in ``base_order``) the vector of other row ``i`` (in ``other_order``).

    The base keeps all its rows; when ``other`` is shorter the missing vectors are zeros (the
    reference pads with zero rows), when it is longer its extra rows are dropped. Both sides get a
    dense position from range buckets, then a left equi-join on the position (a shuffle on both
    sides, no single-task window). An order is one column or several (the others break ties).
    """
    out = out or vec_col
    order = [other_order] if isinstance(other_order, str) else list(other_order)
    b = positional_index(base, base_order, name=pos)
    o = positional_index(other.select(*order, vec_col, *other_cols), order, name=pos)
    o = o.select(pos, F.col(vec_col).cast("array<double>").alias("_v"),
                 *[F.col(c).alias(f"other_{c}") for c in (*order, *other_cols)])
    j = b.join(o, pos, "left")
    return j.withColumn(out, F.coalesce(F.col("_v"), zeros(dim))).drop("_v")


def align_positional_many(base: DataFrame, base_order, others: dict[str, tuple], pos: str = "pos") -> DataFrame:
    """J1 for several modalities at once: the base is indexed once and every other frame is
    left-joined on the same position. ``others`` maps an output column to
    ``(frame, order column or columns, vector column, dim)``."""
    out = positional_index(base, base_order, name=pos)
    for name, (df, order, vec, dim) in others.items():
        order = [order] if isinstance(order, str) else list(order)
        o = positional_index(df.select(*order, vec), order, name=pos)
        o = o.select(pos, F.col(vec).cast("array<double>").alias(f"_v_{name}"))
        out = out.join(o, pos, "left").withColumn(name, F.coalesce(F.col(f"_v_{name}"), zeros(dim))).drop(f"_v_{name}")
    return out


def zip_columns(left: DataFrame, right: DataFrame, key: str | None = None, left_order=None,
                right_order=None) -> DataFrame:
    """Put two frames of equal length side by side.

    With a shared ``key`` this is an inner equi-join; without one, rows are matched by position
    in the declared order of each side.
    """
    if key is not None:
        return left.join(right, key, "inner")
    lp = positional_index(left, left_order, name="_zpos")
    rp = positional_index(right, right_order, name="_zpos")
    return lp.join(rp, "_zpos", "inner").drop("_zpos")


def mean_vectors(df: DataFrame, key: str, vec_col: str, out: str, count_col: str | None = None) -> DataFrame:
    """Element-wise mean of the vectors of each key (0..n per message), as ``array<double>``.

    ``Summarizer.mean`` is a mergeable aggregate, so partial means are combined map-side and a
    hot key costs no more than its partial states.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    aggs = [vector_to_array(Summarizer.mean(array_to_vector(F.col(vec_col).cast("array<double>")))).alias(out)]
    if count_col:
        aggs.append(F.count(F.lit(1)).alias(count_col))
    return df.where(F.col(vec_col).isNotNull()).groupBy(key).agg(*aggs)


def align_keyed(base: DataFrame, key: str, modalities: dict[str, tuple[DataFrame, str, str]],
                counts: bool = True) -> DataFrame:
    """Attach to each base row the mean vector of every other modality with the same key.

    ``modalities`` maps an output name to ``(frame, key column, vector column)``. A message with
    no row in a modality gets null there (``fuse_modalities`` then masks or zero-fills it).
    """
    out = base
    for name, (df, k, v) in modalities.items():
        m = mean_vectors(df.withColumnRenamed(k, key) if k != key else df, key, v, name,
                         f"n_{name}" if counts else None)
        out = out.join(m, key, "left")
        if counts:
            out = out.withColumn(f"n_{name}", F.coalesce(F.col(f"n_{name}"), F.lit(0)).cast("long"))
    return out
