import numpy as np
import pytest
from pyspark.sql import functions as F

from tonality.operators import model as M


def _data(spark, n=300, d=6, seed=0):
    rng = np.random.default_rng(seed)
    X = rng.normal(size=(n, d))
    y = (X[:, 0] > 0.3).astype(int) + (X[:, 1] > 0.8).astype(int)
    w = np.array([1.0, 2.0, 3.0])[y]
    sp = np.where(np.arange(n) % 5 == 0, "val", "train")
    rows = [(i, X[i].tolist(), int(y[i]), float(w[i]), str(sp[i])) for i in range(n)]
    return X, y, w, sp, spark.createDataFrame(rows, "id int, features array<double>, label int, weight double, split string")


def test_gradient_matches_finite_difference():
    rng = np.random.default_rng(1)
    m = M.ReluClassifier.seeded(4, 5, 3, seed=2)
    X = rng.normal(size=(20, 4))
    y = rng.integers(0, 3, 20)
    w = rng.uniform(0.5, 2, 20)
    loss, g = M.weighted_ce_grad(m, X, y, w)
    theta = m.flat()
    eps = 1e-6
    for k in rng.choice(theta.size, 15, replace=False):
        tp = theta.copy(); tp[k] += eps
        tm = theta.copy(); tm[k] -= eps
        num = (M.weighted_ce_grad(m.with_flat(tp), X, y, w)[0] - M.weighted_ce_grad(m.with_flat(tm), X, y, w)[0]) / (2 * eps)
        assert g[k] == pytest.approx(num, rel=1e-4, abs=1e-6)


def test_distributed_gradient_is_partition_free(spark):
    X, y, w, sp, df = _data(spark)
    m = M.ReluClassifier.seeded(6, 7, 3, seed=3)
    tr = sp == "train"
    loss, g = M.weighted_ce_grad(m, X[tr], y[tr], w[tr])
    for parts in (1, 4):
        acc = M._partial_gradients(df.select("features", "label", "weight", "split").repartition(parts), m, 6,
                                   "features", "label", "weight", "split")
        n = g.size
        assert acc[:n] == pytest.approx(g, rel=1e-9, abs=1e-9)
        assert acc[n] == pytest.approx(loss)
        assert acc[n + 1] == pytest.approx(w[tr].sum())


def test_training_loss_falls_and_keeps_best(spark):
    X, y, w, sp, df = _data(spark)
    res = M.fit_relu_classifier(df, hidden=16, epochs=12, patience=3, lr=0.05, seed=1)
    hist = res.history
    assert hist[-1][1] < hist[0][1]
    best = min(hist, key=lambda h: h[2])
    assert res.best_epoch == best[0]
    scored = M.score(df, "features", res.model, keep=["id", "label"])
    acc = scored.where(F.col("label") == F.col("predicted")).count() / df.count()
    assert acc > 0.5


def test_score_null_vector_is_neutral(spark):
    m = M.ReluClassifier.seeded(3, 4, 3, seed=0)
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, None)], "id int, v array<double>")
    got = {r.id: r for r in M.score(df, "v", m, keep=["id"], with_probs=True).collect()}
    assert got[2].sentiment == "neutral" and got[2].confidence is None
    P = M.softmax_rows(m.logits(np.array([[1.0, 2.0, 3.0]])))[0]
    assert got[1].confidence == pytest.approx(P.max())
    assert got[1].predicted == int(P.argmax())


def test_save_load_model(spark, tmp_dir):
    m = M.ReluClassifier.seeded(3, 4, 3, seed=0)
    M.save_model(spark, m, tmp_dir + "/model")
    back = M.load_model(spark, tmp_dir + "/model")
    assert np.allclose(back.flat(), m.flat())


def test_linear_head_and_weighted_logreg(spark):
    from tonality.operators.fuse import random_linear
    X, y, w, sp, df = _data(spark)
    head = random_linear(3, 6, 4)
    h = M.linear_head(df, "features", head).select("id", "probs", "predicted").orderBy("id").first()
    P = M.softmax_rows(head(X[:1]))[0]
    assert h.probs == pytest.approx(P.tolist()) and h.predicted == int(P.argmax())
    model = M.fit_weighted_logreg(df, "features", "label", "weight", max_iter=50)
    pred = M.predict_weighted_logreg(model, df, "features", keep=["id", "label"])
    acc = pred.where(F.col("label") == F.col("predicted")).count() / df.count()
    assert acc > 0.6


def test_records_append_and_latest(spark, tmp_dir):
    from tonality.operators import metrics
    df = spark.createDataFrame([(0, 0), (1, 1), (2, 1)], "truth int, prediction int")
    path = tmp_dir + "/records"
    metrics.append_records(metrics.evaluation_record(df, "a"), path)
    metrics.append_records(metrics.evaluation_record(df, "b"), path)
    recs = spark.read.parquet(path)
    assert recs.count() == 2
    assert metrics.latest_record(recs).first().run_id == "b"


def test_preview_orders(spark):
    from tonality.operators.rank import preview
    df = spark.range(100).withColumnRenamed("id", "k")
    assert [r.k for r in preview(df, ["k"]).collect()] == [0, 1, 2, 3, 4]
