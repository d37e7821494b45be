"""The model registry: best and newest run, runs without a metric, runs that broke off."""

import pytest

from tonality.operators.model import ReluClassifier
from tonality.operators.fuse import FusionParams
from tonality.plans import registry
from tonality.plans.scoring import ScoringModel, save_scoring_model


def _model(salt):
    return ScoringModel(FusionParams.closed_form(8, 4, 4), ReluClassifier.closed_form(8, 5, 3, salt=salt), (8, 4, 4))


def test_best_and_newest_run(spark, tmp_path):
    path = str(tmp_path / "registry")
    for salt, (run, loss) in enumerate([("a", 0.5), ("b", 0.2), ("c", 0.9), ("d", float("nan"))], 1):
        registry.register(spark, path, run, _model(salt), {"val_loss": loss, "f1": salt / 10})
    registry.register(spark, path, "e", _model(9), {"f1": 0.05})
    save_scoring_model(spark, _model(7), f"{path}/models/broken")  # no row: never chosen
    found = registry.runs(spark, path)
    assert registry.chosen(found, "val_loss") == "b" and registry.chosen(found, "val_loss", largest=True) == "c"
    assert registry.chosen(found, "f1", largest=True) == "d" and registry.chosen(found) == "e"
    best = registry.load(spark, path, "val_loss")
    assert best.dims == (8, 4, 4) and best.classifier.flat() == pytest.approx(_model(2).classifier.flat())
    with pytest.raises(ValueError):
        registry.chosen(found, "accuracy")
    with pytest.raises(ValueError):
        registry.chosen(found.limit(0))


def test_ties_go_to_the_newest(spark, tmp_path):
    path = str(tmp_path / "registry")
    for run in ("z", "a"):
        registry.register(spark, path, run, _model(1), {"val_loss": 0.5})
    assert registry.chosen(registry.runs(spark, path), "val_loss") == "a"


def test_text_models_as_saved(spark, tmp_path):
    from tonality.operators.model import TextBaseline
    from tonality.operators.text_model import FittedText, class_probabilities, fit_text_optimum, load_text_model, save_text_model
    rows = [(i, ["good day", "bad rain", "so so", "good good bad"][i % 4].split(), [2, 0, 1, 2][i % 4]) for i in range(24)] + [(99, [], 1)]
    docs = spark.createDataFrame(rows, "k long, tokens array<string>, label int")
    fitted = fit_text_optimum(docs, "k")
    path = str(tmp_path / "registry")
    registry.register(spark, path, "fitted", fitted, {"loss": 0.1})
    plain = TextBaseline(fitted.vocabulary, fitted.coefficients, [0.0, 0.0, 0.0], [(0, 1.0)])
    registry.register(spark, path, "plain", plain, {"loss": 0.5})
    best = registry.load_text(spark, path, "loss")
    assert isinstance(best, FittedText) and best.converged == fitted.converged and best.intercepts == fitted.intercepts
    assert [tuple(h) for h in best.history] == [tuple(h) for h in fitted.history]
    score = lambda m: {r.k: (r.probs, r.predicted) for r in class_probabilities(m, docs, "k").collect()}
    assert score(best) == score(fitted) and len(score(best)) == 25
    assert type(registry.load_text(spark, path)) is TextBaseline  # the newest
    save_text_model(plain, f"{path}/models/fitted")  # overwritten as a whole
    assert load_text_model(spark, f"{path}/models/fitted").intercepts == [0.0] * 3
