"""Property tests: exact split sizes and disjoint, complete splits for random inputs."""
import math

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tonality.operators import split


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(n=st.integers(min_value=1, max_value=400), seed=st.integers(min_value=0, max_value=10_000),
       classes=st.integers(min_value=1, max_value=4))
def test_stratified_split_sizes(spark, n, seed, classes):
    rows = [(i, i % classes) for i in range(n)]
    df = spark.createDataFrame(rows, "k long, y int")
    s = split.split_stratified(df, "k", "y", seed=seed).collect()
    assert len(s) == n and len({r.k for r in s}) == n
    for c in range(classes):
        nc = sum(1 for _, y in rows if y == c)
        got = sum(1 for r in s if r.y == c and r.split == "test")
        assert got == math.ceil(0.2 * nc)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(n=st.integers(min_value=1, max_value=400), seed=st.integers(min_value=0, max_value=10_000))
def test_three_way_split_sizes(spark, n, seed):
    df = spark.range(n).withColumnRenamed("id", "k")
    c = {r.split: r["count"] for r in split.split_exact(df, "k", (0.7, 0.15, 0.15), ("train", "val", "test"),
                                                        seed=seed, rounding="floor").groupBy("split").count().collect()}
    assert c.get("train", 0) == math.floor(0.7 * n)
    assert c.get("val", 0) == math.floor(0.15 * n)
    assert c.get("test", 0) == n - math.floor(0.7 * n) - math.floor(0.15 * n)


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(n_base=st.integers(min_value=1, max_value=60), n_other=st.integers(min_value=0, max_value=80))
def test_positional_alignment_keeps_base(spark, n_base, n_other):
    from tonality.operators.align import align_positional
    base = spark.createDataFrame([(i * 3,) for i in range(n_base)], "b long")
    other = spark.createDataFrame([(i, [float(i)]) for i in range(n_other)], "o long, v array<double>")
    out = align_positional(base, other, "b", "o", "v", 1).collect()
    assert len(out) == n_base
    for r in out:
        assert r.v == ([float(r.pos)] if r.pos < n_other else [0.0])
