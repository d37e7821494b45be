"""Dense indexes and exact, repeatable splits.

A plain ``row_number() over (partition by label order by ...)`` sends every row of a class to
one task; with a class holding a third of the data that task never finishes. The exact splits
look for the few rows at which a share ends and compare the others with them. ``dense_index``
(T0) numbers all rows: it cuts each group into buckets that are monotone in the sort order, counts the
buckets (a map-side-combined aggregate whose result has at most groups x buckets rows), turns
the counts into offsets with a window over that small table, and numbers rows only inside
``(group, bucket)``. Index = offset + local row number, exactly the global row number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonality.session import materialize


def hash_order(key_cols, seed: int) -> Column:
    """Repeatable pseudo-random order: md5 of the key text and the seed, as 32 hex digits.

    One key column gives ``md5(cast(key as string) || ':' || seed)``, which DuckDB computes
    identically, so the oracle can rebuild the same order.
    """
    keys = [key_cols] if isinstance(key_cols, str) else list(key_cols)
    text = F.col(keys[0]).cast("string") if len(keys) == 1 else F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    return F.md5(F.concat(text, F.lit(f":{seed}")))


def dense_index(df: DataFrame, order_cols: list, bucket: Column, partition_by: list[str] | tuple = (),
                name: str = "_idx", total_name: str | None = None) -> DataFrame:
    """1-based row number inside each ``partition_by`` group, in ``order_cols`` order.

    ``bucket`` must be non-decreasing in the sort order within a group (a hash prefix for hash
    orders, a range bucket for value orders); rows are numbered inside ``(group, bucket)``, so it
    decides how large a task gets. The planner picks the join with the bucket offsets from their
    real size. ``total_name`` adds the group's row count.
    """
    parts = list(partition_by)
    order = [F.col(c) if isinstance(c, str) else c for c in order_cols]
    # number rows inside (group, bucket) first; the bucket counts are then read from the same
    # shuffle (both branches share the exchange below the window, which Spark reuses); a
    # non-nullable bucket keeps the join from inferring a null filter on one branch only
    local = (df.withColumn("_b", F.coalesce(bucket, F.lit(0).cast(df.select(bucket).schema[0].dataType)))
             .withColumn("_local", F.row_number().over(Window.partitionBy(*parts, "_b").orderBy(*order))))
    hist = local.groupBy(*parts, "_b").agg(F.max("_local").cast("long").alias("_n"))
    w_prev = Window.partitionBy(*parts).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    off = hist.select(*[F.col(p).alias(f"_g{i}") for i, p in enumerate(parts)], F.col("_b").alias("_ob"),
                      F.coalesce(F.sum("_n").over(w_prev), F.lit(0)).alias("_off"),
                      F.sum("_n").over(Window.partitionBy(*parts)).alias("_tot"))
    # null-safe on the group columns: rows of a null group keep their own numbering
    cond = [F.col(p).eqNullSafe(F.col(f"_g{i}")) for i, p in enumerate(parts)] + [F.col("_b") == F.col("_ob")]
    out = local.join(off, cond).drop(*[f"_g{i}" for i in range(len(parts))], "_ob")
    out = out.withColumn(name, F.col("_off") + F.col("_local"))
    if total_name:
        out = out.withColumnRenamed("_tot", total_name)
    return out.drop("_b", "_off", "_tot", "_local")


ROWS_PER_BUCKET = 1_000_000


def bucket_digits(rows: int) -> int:
    """Hex digits of the hash prefix so that a bucket holds about ``ROWS_PER_BUCKET`` rows at most."""
    d = 1
    while rows / 16 ** d > ROWS_PER_BUCKET:
        d += 1
    return d


def _cut_points(rounding: str, fractions, total: Column) -> list[Column]:
    fn = F.ceil if rounding == "ceil" else F.floor
    cuts, acc = [], F.lit(0).cast("long")
    for f in fractions[:-1]:
        acc = acc + fn(F.lit(float(f)) * total.cast("double")).cast("long")
        cuts.append(acc)
    return cuts


def _boundaries(keys: DataFrame, group: list[str], fractions, rounding: str, rows: int) -> DataFrame:
    """Per group the last ``(_h, _k)`` of each share but the last, in order, as ``_bounds``.

    ``keys`` holds the group columns, ``_h`` (hash) and ``_k`` (key). Buckets are hash prefixes; their
    counts give the bucket in which each share ends, and only the rows of those buckets (one or
    two per group) are numbered.
    """
    b = keys.withColumn("_b", F.substring("_h", 1, bucket_digits(rows)))
    hist = b.groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(*group).orderBy("_b")
    hist = hist.select(*group, "_b", "_n", F.sum("_n").over(upto).alias("_to"),
                       F.sum("_n").over(Window.partitionBy(*group)).alias("_tot"))
    cuts = F.array(*_cut_points(rounding, fractions, F.col("_tot")))
    hit = (hist.select(*[F.col(g).alias(f"_c{i}") for i, g in enumerate(group)], F.col("_b").alias("_cb"), (F.col("_to") - F.col("_n")).alias("_off"), "_to", F.posexplode(cuts).alias("_i", "_cut"))
           .where((F.col("_cut") > F.col("_off")) & (F.col("_cut") <= F.col("_to"))))
    on = [F.col(g).eqNullSafe(F.col(f"_c{i}")) for i, g in enumerate(group)] + [F.col("_b") == F.col("_cb")]
    inside = b.join(hit, on).select(*group, "_b", "_h", "_k", "_i", (F.col("_cut") - F.col("_off")).alias("_at"))
    number = F.row_number().over(Window.partitionBy(*group, "_b", "_i").orderBy("_h", "_k"))
    ends = inside.withColumn("_rn", number).where("_rn = _at").select(*group, "_i", F.struct("_h", "_k").alias("_end"))
    return ends.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("_i", "_end"))).alias("_bounds"))


BOUND_BYTES = 16 << 20  # the boundary table is broadcast if its groups take no more than this


def _split(df: DataFrame, key: str, group: list[str], fractions, names, seed: int, rounding: str, split_col: str) -> DataFrame:
    """Exact shares of each group in seeded hash order.

    Only ``(group, hash, key)`` is read to find where the shares end; every row is then placed by
    comparing its hash with at most a few boundaries of its group. Other columns are neither
    counted, sorted nor (with few groups) shuffled.
    """
    keys = df.select(*[F.col(g) for g in group], hash_order(key, seed).alias("_h"), F.col(key).cast("string").alias("_k"))
    bounds = materialize(_boundaries(keys, group, fractions, rounding, df.count()), "split-bounds")
    bounds = bounds.withColumnsRenamed({g: f"_g{i}" for i, g in enumerate(group)})
    groups = bounds.count()
    if groups * 64 * (len(fractions) + len(group)) <= BOUND_BYTES:
        bounds = F.broadcast(bounds)
    staged = df.withColumn("_me", F.struct(hash_order(key, seed).alias("_h"), F.col(key).cast("string").alias("_k")))
    staged = staged.join(bounds, [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)], "left")
    share = F.lit(names[-1])
    for i in range(len(names) - 2, -1, -1):  # the first share whose end is not before the row
        mine = F.exists("_bounds", _ends_at_or_after(i))
        share = F.when(mine, F.lit(names[i])).otherwise(share)
    return staged.withColumn(split_col, share).drop("_me", "_bounds", *[f"_g{i}" for i in range(len(group))])


def _ends_at_or_after(i: int):
    return lambda x: (x["_i"] == i) & (x["_end"] >= F.col("_me"))


def split_stratified(df: DataFrame, key: str, label: str, fractions=(0.2, 0.8), names=("test", "train"),
                     seed: int = 42, rounding: str = "ceil", split_col: str = "split") -> DataFrame:
    """Exact per-class split in a seeded hash order.

    Inside each class, rows sorted by ``md5(key:seed)`` (then key); the first ``ceil(f0 * n_class)``
    rows get ``names[0]`` (test by default), the next share ``names[1]`` and so on. Same result for
    any partitioning of the input; rows of a null class are a class; rows of one key stay together.
    """
    return _split(df, key, [label], fractions, names, seed, rounding, split_col)


def split_exact(df: DataFrame, key: str, fractions=(0.2, 0.8), names=("test", "train"), seed: int = 42,
                rounding: str = "ceil", split_col: str = "split") -> DataFrame:
    """Exact global split in a seeded hash order.

    ``fractions=(0.2, 0.8), rounding="ceil"`` is the 80/20 rule (test = ceil(0.2 n));
    ``fractions=(0.7, 0.15, 0.15), names=("train","val","test"), rounding="floor"`` is the
    70/15/15 rule (floor, floor, rest).
    """
    return _split(df.withColumn("_all", F.lit(0)), key, ["_all"], fractions, names, seed, rounding, split_col).drop("_all")


def hash_unit(key: str, seed: int) -> Column:
    """A number in [0, 1) from the first 8 hex digits of ``md5(key:seed)``."""
    return F.conv(F.substring(hash_order(key, seed), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def split_hash(df: DataFrame, key: str, fractions=(0.2, 0.8), names=("test", "train"), seed: int = 42,
               split_col: str = "split") -> DataFrame:
    """T4: approximate split, decided per row from the key hash (no shuffle, no count)."""
    u = hash_unit(key, seed)
    acc, expr = 0.0, None
    for f, nm in zip(fractions[:-1], names[:-1]):
        acc += float(f)
        expr = F.when(u < acc, F.lit(nm)) if expr is None else expr.when(u < acc, F.lit(nm))
    expr = expr.otherwise(F.lit(names[-1])) if expr is not None else F.lit(names[-1])
    return df.withColumn(split_col, expr)


def positional_index(df: DataFrame, order_by, tie_break: list[str] | tuple = (), name: str = "pos",
                     partitions: int | None = None) -> DataFrame:
    """T0 for a value order: 0-based position of each row in ``order_by`` (then ``tie_break``) order.

    ``order_by`` is one column or several, of any orderable type; nulls come last, NaN after all
    numbers. Rows are range-partitioned and sorted once and written with their place in the
    partition; the partitions' row counts (one row each) give the offsets. Full ties follow a hash
    of the row, so a value shared by a third of the rows is cut by its ties.
    """
    cols = [order_by] if isinstance(order_by, str) else list(order_by)
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hashable = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    order = [F.col(c).asc_nulls_last() for c in [*cols, *tie_break]] + [F.xxhash64(*hashable).asc()]
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    # the id holds the partition in its upper and the place in the partition in its lower 33 bits
    placed = materialize(ranged.withColumn("_id", F.monotonically_increasing_id()), "positions")
    part = F.shiftright("_id", 33)
    sizes = placed.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # over one row per partition
    offsets = sizes.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return (placed.withColumn("_p", part).join(F.broadcast(offsets), "_p")
            .withColumn(name, (F.col("_off") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).cast("long"))
            .drop("_p", "_id", "_off"))


def stack_splits(parts: dict[str, DataFrame], split_col: str = "split") -> DataFrame:
    """Stack per-split frames into one frame with a ``split`` column."""
    out = None
    for nm, d in parts.items():
        d = d.withColumn(split_col, F.lit(nm))
        out = d if out is None else out.unionByName(d)
    return out
