import pytest
from pyspark.sql import functions as F

from tonality.operators import metrics

# Golden: the reference's published confusion matrix (rows = truth) and its report.
MATRIX = [[28, 2, 1], [5, 9, 0], [47, 22, 264]]


def golden_rows(spark):
    rows = [(t, p) for t in range(3) for p in range(3) for _ in range(MATRIX[t][p])]
    return spark.createDataFrame(rows, "truth int, prediction int")


def test_confusion_matrix_golden(spark):
    df = golden_rows(spark)
    cm = metrics.confusion_matrix(df)
    got = {(r.truth, r.prediction): r["count"] for r in cm.collect()}
    assert got == {(t, p): MATRIX[t][p] for t in range(3) for p in range(3)}
    arr = metrics.matrix_rows(cm).first()[0]
    assert [list(x) for x in arr] == MATRIX


def test_classification_report_golden(spark):
    rep = {r["class"]: r for r in metrics.classification_report(golden_rows(spark)).collect()}
    assert rep["negative"].precision == pytest.approx(0.35)
    assert rep["negative"].recall == pytest.approx(0.9032258064516129)
    assert rep["negative"].f1 == pytest.approx(0.5045045045045045)
    assert rep["neutral"].f1 == pytest.approx(0.3829787234042553)
    assert rep["positive"].precision == pytest.approx(0.9962264150943396)
    assert rep["positive"].support == 333
    assert rep["accuracy"].f1 == pytest.approx(0.7962962962962963)
    assert rep["macro avg"].precision == pytest.approx(0.5396512292738708)
    assert rep["macro avg"].recall == pytest.approx(0.7796252473671829)
    assert rep["macro avg"].f1 == pytest.approx(0.5901421239071563)
    assert rep["weighted avg"].precision == pytest.approx(0.9164327461497274)
    assert rep["weighted avg"].f1 == pytest.approx(0.8333899699918819)
    assert sum(rep[c].support for c in ("negative", "neutral", "positive")) == 378


def test_f1_scores_golden(spark):
    r = metrics.f1_scores(golden_rows(spark)).first()
    assert r.f1_weighted == pytest.approx(0.8333899699918819)
    assert r.f1_macro == pytest.approx(0.5901421239071563)
    assert r.accuracy == pytest.approx(301 / 378)


def test_absent_classes(spark):
    # truth without class 1, prediction without class 0
    rows = [(0, 1), (0, 2), (2, 2), (2, 1)]
    df = spark.createDataFrame(rows, "truth int, prediction int")
    rep = {r["class"]: r for r in metrics.classification_report(df).collect()}
    assert rep["neutral"].support == 0 and rep["neutral"].recall == 0.0 and rep["neutral"].precision == 0.0
    assert rep["negative"].precision == 0.0
    f = metrics.f1_scores(df).first()
    # classes seen in truth or prediction: 0, 1, 2 -> f1 = 0, 0, 2*1/(2+2)=0.5
    assert f.f1_macro == pytest.approx(0.5 / 3)


def test_class_weights_and_record(spark):
    from tonality.operators import dist
    rows = [(0, "train")] * 205 + [(1, "train")] * 122 + [(2, "train")] * 2193 + [(1, "test")] * 7
    df = spark.createDataFrame(rows, "label int, split string")
    w = {r.label: r.weight for r in dist.class_weights(df, "label", "split", "train").collect()}
    assert w[0] == pytest.approx(0.004878048785030842, rel=1e-6)
    assert w[1] == pytest.approx(0.008196720853447914, rel=1e-6)
    assert w[2] == pytest.approx(0.00045599634177051485, rel=1e-6)
    rec = metrics.evaluation_record(golden_rows(spark), "run1", weights=[w[0], w[1], w[2]]).first()
    assert rec.run_id == "run1" and [list(x) for x in rec.confusion_matrix] == MATRIX
    assert rec.per_class_metrics["neutral"]["support"] == 14
    assert len(rec.stamp) == 15


def test_weighted_log_loss(spark):
    import math
    rows = [([0.7, 0.2, 0.1], 0, 2.0), ([0.1, 0.1, 0.8], 2, 1.0), ([0.3, 0.3, 0.4], 1, 3.0)]
    df = spark.createDataFrame(rows, "p array<double>, y int, weight double")
    got = metrics.weighted_log_loss(df, "p", "y").first().log_loss
    expect = (2 * -math.log(0.7) + 1 * -math.log(0.8) + 3 * -math.log(0.3)) / 6
    assert got == pytest.approx(expect)
