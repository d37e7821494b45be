import numpy as np
import pytest
from pyspark.sql import functions as F

from tonality.functions import vectors as V
from tonality.operators import fuse


def test_softmax_l2_argmax(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],), ([0.0, 0.0, 0.0],), ([5.0, 5.0, 1.0],)], "x array<double>")
    got = df.select(V.softmax("x").alias("s"), V.l2_normalize("x").alias("n"), V.argmax("x").alias("a")).collect()
    for r in got:
        assert sum(r.s) == pytest.approx(1.0)
    assert got[1].n == [0.0, 0.0, 0.0]
    assert got[0].n == pytest.approx(list(np.array([1, 2, 3]) / np.linalg.norm([1, 2, 3])))
    assert [r.a for r in got] == [2, 0, 0]


def test_widen_pack_roundtrip(spark):
    df = spark.createDataFrame([(1, [0.5, 0.25, 0.125])], "id int, v array<double>")
    w = V.widen_vector(df, "v", 3, keep=["id"])
    assert w.columns == ["id", "emb_0", "emb_1", "emb_2"]
    p = V.pack_vector(w, ["emb_0", "emb_1", "emb_2"], "v")
    assert p.first().v == [0.5, 0.25, 0.125]


def _inputs(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(40):
        t = rng.normal(size=8).tolist()
        e = rng.normal(size=4).tolist() if i % 3 else None
        s = rng.normal(size=2).tolist() if i % 2 else None
        rows.append((i, t, e, s))
    return spark.createDataFrame(rows, "id int, text_vec array<double>, emoji_vec array<double>, sticker_vec array<double>")


@pytest.mark.parametrize("missing", ["mask", "zeros"])
def test_fusion_arrow_equals_expression(spark, missing):
    df = _inputs(spark)
    p = fuse.FusionParams.seeded(8, 4, 2, seed=5)
    a = {r.id: r.fused for r in fuse.fuse_modalities(df, p, missing=missing).collect()}
    b = {r.id: r.fused for r in fuse.fuse_expr(df, p, missing=missing).collect()}
    for k in a:
        assert a[k] == pytest.approx(b[k], abs=1e-9)


def test_fusion_zero_padding_is_not_neutral(spark):
    df = _inputs(spark).where("id = 0")   # id 0: emoji and sticker missing
    p = fuse.FusionParams.seeded(8, 4, 2, seed=5)
    m = np.array(fuse.fuse_modalities(df, p, missing="mask").first().fused)
    z = np.array(fuse.fuse_modalities(df, p, missing="zeros").first().fused)
    t = np.array(df.first().text_vec)
    proj_t = p.text(t[None, :])[0]
    assert m == pytest.approx(proj_t / np.linalg.norm(proj_t))
    assert not np.allclose(m, z)   # zeros still add the normalised biases


def test_project_arrow_equals_expression(spark):
    df = _inputs(spark).select("id", "text_vec")
    lay = fuse.random_linear(5, 8, 1)
    a = {r.id: r.p for r in fuse.project_vector(df, "text_vec", lay, "p").collect()}
    b = {r.id: r.p for r in fuse.project_vector(df, "text_vec", lay, "p", method="expr").collect()}
    for k in a:
        assert a[k] == pytest.approx(b[k], abs=1e-9)


def test_params_table_roundtrip(spark):
    p = fuse.FusionParams.seeded(8, 4, 2, seed=5)
    back = fuse.layers_from_table(fuse.params_table(spark, p.layers()))
    for k, lay in p.layers().items():
        assert np.allclose(back[k].W, lay.W) and np.allclose(back[k].b, lay.b)


def test_arrow_nodes_carry_only_what_is_kept(spark):
    from tonality.operators.encode import hash_embed

    df = spark.createDataFrame([(1, "pad", ["a", "b"], [1.0, 2.0])], "k int, pad string, w array<string>, x array<double>")
    for out in (hash_embed(df, "w", 8, "v", keep=["k"]), fuse.project_vector(df, "x", fuse.closed_form_linear(3, 2, 1), "v", keep=["k"])):
        assert out.columns == ["k", "v"] and len(out.first().v) in (8, 3)
        node = out._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[1]
        assert "pad" not in node.split("LogicalRDD")[0]
