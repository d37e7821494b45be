import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from tonality.operators import align, split
from tonality.sources import tables as S

from table_dirs import SF01


def test_dense_index_equals_row_number(spark):
    o = S.table(spark, SF01, "orders").select("o_orderkey", (F.col("o_orderkey") % 3).alias("g"))
    h = split.hash_order("o_orderkey", 9)
    staged = o.withColumn("_h", h)
    ours = split.dense_index(staged, ["_h", "o_orderkey"], F.substring("_h", 1, 2), ["g"], name="rn")
    plain = staged.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy("_h", "o_orderkey")))
    a = ours.select("o_orderkey", "g", "rn")
    b = plain.select("o_orderkey", "g", "rn")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_split_stratified_exact_sizes_and_stable(spark):
    rows = [(i, 0 if i % 10 == 0 else (1 if i % 10 < 3 else 2)) for i in range(997)]
    df = spark.createDataFrame(rows, "k long, y int")
    s1 = split.split_stratified(df, "k", "y", seed=42)
    counts = {(r.y, r.split): r["count"] for r in s1.groupBy("y", "split").count().collect()}
    for y in range(3):
        n = sum(1 for _, v in rows if v == y)
        assert counts[(y, "test")] == math.ceil(0.2 * n)
        assert counts[(y, "train")] == n - math.ceil(0.2 * n)
    s2 = split.split_stratified(df.repartition(7), "k", "y", seed=42)
    assert s1.exceptAll(s2).count() == 0
    assert s1.count() == len(rows) and s1.select("k").distinct().count() == len(rows)


def test_split_exact_70_15_15(spark):
    df = spark.range(1001).withColumnRenamed("id", "k")
    s = split.split_exact(df, "k", (0.7, 0.15, 0.15), ("train", "val", "test"), seed=3, rounding="floor")
    c = {r.split: r["count"] for r in s.groupBy("split").count().collect()}
    assert c == {"train": 700, "val": 150, "test": 151}


def test_split_hash_no_shuffle(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    s = split.split_hash(df, "k", (0.2, 0.8), ("test", "train"), 42)
    plan = s._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    n = s.where("split = 'test'").count()
    assert 120 < n < 280


def test_positional_index_and_align(spark):
    base = spark.createDataFrame([(i * 10,) for i in range(5)], "bk long")
    for n_other in (3, 5, 7):
        other = spark.createDataFrame([(100 - i, [float(i), float(i)]) for i in range(n_other)], "ok long, v array<double>")
        j = align.align_positional(base, other, "bk", "ok", "v", 2).orderBy("pos").collect()
        assert len(j) == 5
        for r in j:
            if r.pos < n_other:
                # other ordered by ok ascending: position p holds ok = 100 - (n_other - 1 - p)
                i = n_other - 1 - r.pos
                assert r.v == [float(i), float(i)] and r.other_ok == 100 - i
            else:
                assert r.v == [0.0, 0.0] and r.other_ok is None
        assert [r.bk for r in j] == [0, 10, 20, 30, 40]


def test_align_keyed_mean_and_missing(spark):
    base = spark.createDataFrame([(1,), (2,), (3,)], "m long")
    emo = spark.createDataFrame([(1, [1.0, 3.0]), (1, [3.0, 5.0]), (3, [0.0, 0.0])], "m long, v array<double>")
    j = {r.m: r for r in align.align_keyed(base, "m", {"emoji": (emo, "m", "v")}).collect()}
    assert j[1].emoji == [2.0, 4.0] and j[1].n_emoji == 2
    assert j[2].emoji is None and j[2].n_emoji == 0
    assert j[3].emoji == [0.0, 0.0]


def test_stack_splits(spark):
    a = spark.createDataFrame([(1,)], "x int")
    b = spark.createDataFrame([(2,), (3,)], "x int")
    s = split.stack_splits({"train": a, "test": b})
    assert sorted((r.x, r.split) for r in s.collect()) == [(1, "train"), (2, "test"), (3, "test")]


def test_split_keeps_null_labels_and_spreads_hot_class(spark):
    rows = [(i, None if i % 50 == 0 else (2 if i % 10 else 0)) for i in range(5000)]
    df = spark.createDataFrame(rows, "k long, y int")
    s = split.split_stratified(df, "k", "y", seed=1)
    assert s.count() == 5000
    nulls = s.where("y IS NULL")
    assert nulls.count() == 100 and nulls.where("split = 'test'").count() == 20
    plain = df.withColumn("h", split.hash_order("k", 1)).withColumn("rn", F.row_number().over(Window.partitionBy("y").orderBy("h")))
    n = F.count(F.lit(1)).over(Window.partitionBy("y"))
    want = plain.withColumn("split", F.when(F.col("rn") <= F.ceil(0.2 * n), "test").otherwise("train")).select("k", "y", "split")
    assert s.exceptAll(want).count() == 0


def test_splits_of_small_and_empty_groups(spark):
    df = spark.createDataFrame([(i, i % 7, f"pad{i}") for i in range(9)], "k long, y int, pad string")
    s = split.split_exact(df, "k", (0.05, 0.05, 0.9), ("a", "b", "c"), seed=2, rounding="floor")
    assert s.columns == ["k", "y", "pad", "split"] and {r.split for r in s.collect()} == {"c"}
    s = split.split_stratified(df, "k", "y", (0.5, 0.5), ("a", "b"), rounding="ceil")
    assert s.where("split = 'a'").count() == 7 and s.where("split = 'b'").count() == 2
    assert split.split_stratified(df.limit(0), "k", "y").count() == 0
    assert split.split_exact(df.limit(0), "k").count() == 0


def test_positional_index_splits_a_hot_order_value(spark):
    # a third of the rows share one order value; the tie-break orders them
    rows = [(5 if i % 3 == 0 else i, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "o long, t long")
    got = split.positional_index(df, "o", ["t"], partitions=16)
    plain = df.withColumn("pos", (F.row_number().over(Window.orderBy("o", "t")) - 1).cast("long"))
    assert got.select("o", "t", "pos").exceptAll(plain.select("o", "t", "pos")).count() == 0
    assert got.where("o = 5").count() == 1001      # i % 3 == 0, plus i = 5 itself


def test_positional_index_takes_nulls_nan_and_text(spark):
    rows = [(None if i % 5 == 0 else float("nan") if i % 7 == 0 else float(i % 11), None if i % 4 == 0 else i, f"t{i % 13}")
            for i in range(2000)]
    df = spark.createDataFrame(rows, "o double, t long, s string")
    for cols in (["o", "t", "s"], ["s", "o", "t"]):
        order = [F.col(c).asc_nulls_last() for c in cols]
        plain = df.withColumn("pos", (F.row_number().over(Window.orderBy(*order)) - 1).cast("long"))
        got = split.positional_index(df, cols[0], cols[1:], partitions=9)
        key = lambda r: (r.pos, repr(r.o), r.t, r.s)
        assert sorted(map(key, got.collect()), key=str) == sorted(map(key, plain.collect()), key=str)
    same = spark.createDataFrame([(1,)] * 50, "o int")
    assert sorted(r.pos for r in split.positional_index(same, "o").collect()) == list(range(50))
    assert split.positional_index(same.limit(0), "o").count() == 0


def test_bucket_digits_scale_with_rows():
    assert split.bucket_digits(10_000) == 1
    assert split.bucket_digits(10 ** 12) == 5      # 10**12 / 16**5 = 954k rows per bucket


def test_align_many_equals_single_and_positional_zip(spark):
    base = spark.createDataFrame([(i,) for i in range(6)], "b long")
    e = spark.createDataFrame([(10 + i, [float(i)]) for i in range(4)], "o long, v array<double>")
    s = spark.createDataFrame([(20 + i, [float(-i), 1.0]) for i in range(9)], "o long, v array<double>")
    many = {r.b: (r.ev, r.sv) for r in align.align_positional_many(base, "b", {"ev": (e, "o", "v", 1),
                                                                              "sv": (s, "o", "v", 2)}).collect()}
    one_e = {r.b: r.ev for r in align.align_positional(base, e, "b", "o", "v", 1, out="ev").collect()}
    one_s = {r.b: r.sv for r in align.align_positional(base, s, "b", "o", "v", 2, out="sv").collect()}
    assert many == {b: (one_e[b], one_s[b]) for b in range(6)}
    left = spark.createDataFrame([(5 - i, f"x{i}") for i in range(5)], "lk long, a string")
    right = spark.createDataFrame([(100 + i, i * 2) for i in range(5)], "rk long, c long")
    z = {r.lk: r.c for r in align.zip_columns(left, right, left_order="lk", right_order="rk").collect()}
    assert z == {lk: 2 * (lk - 1) for lk in range(1, 6)}
