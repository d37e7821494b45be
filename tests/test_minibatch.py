"""Mini-batch training against a plain NumPy loop; resuming, early stopping, several sets at once."""

import hashlib

import numpy as np
import pytest

from tonality.operators import minibatch as B
from tonality.operators.model import ReluClassifier, score, softmax_rows, weighted_ce_grad

START = ReluClassifier.seeded(6, 7, 3, seed=3)
SETS = {"even": [1.0, 1.0, 1.0], "heavy": [4.0, 1.0, 2.0]}


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    X = rng.normal(size=(230, 6))
    y = (X[:, 0] > 0.3).astype(int) + (X[:, 1] > 0.8).astype(int)
    split = np.array(["val" if i % 5 == 0 else "test" if i % 7 == 0 else "train" for i in range(230)])
    rows = [(i, X[i].tolist(), int(y[i]), str(split[i])) for i in range(230)]
    return X, y, split, spark.createDataFrame(rows, "id long, features array<double>, label int, split string").repartition(3)


def plain_loop(X, y, split, weights, epochs, patience, lr, batch=32, seed=42):
    w = np.array(weights)[y]
    theta = START.flat()
    m, v, t = np.zeros_like(theta), np.zeros_like(theta), 0
    train, val = np.flatnonzero(split == "train"), split == "val"
    out, best, bad = [], np.inf, 0
    for epoch in range(1, epochs + 1):
        order = sorted(train, key=lambda i: hashlib.md5(f"{i}:{seed + epoch}".encode()).hexdigest())
        losses = []
        for k in range(0, len(order), batch):
            i = order[k:k + batch]
            loss, g = weighted_ce_grad(START.with_flat(theta), X[i], y[i], w[i])
            g, t = g / w[i].sum(), t + 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            theta = theta - lr * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
            losses.append(loss / w[i].sum())
        P = softmax_rows(START.with_flat(theta).logits(X[val]))
        val_loss = np.sum(w[val] * -np.log(P[np.arange(val.sum()), y[val]])) / w[val].sum()
        out.append((np.mean(losses), val_loss))
        best, bad = (val_loss, 0) if val_loss < best else (best, bad + 1)
        if bad >= patience:
            break
    return out


def test_one_shard_equals_the_plain_loop_also_when_resumed(spark, data, tmp_path):
    X, y, split, df = data
    state = str(tmp_path / "state")
    args = dict(epochs=12, patience=2, lr=0.08)
    first = B.fit_minibatches(df, "id", SETS, START, state, stop_after=2, **args)
    assert all(len(r.val_losses) == 2 and not r.stopped for r in first)
    runs = B.fit_minibatches(df, "id", SETS, START, state, **args)
    for r in runs:
        want = plain_loop(X, y, split, SETS[r.run_id], 12, 2, 0.08)
        assert list(zip(r.train_losses, r.val_losses)) == [pytest.approx(x, rel=1e-9) for x in want]
        assert r.best_epoch == int(np.argmin([b for _, b in want])) + 1
    assert any(r.stopped for r in runs)
    again = B.fit_minibatches(df, "id", SETS, START, state, **args)  # nothing left to do
    assert [r.val_losses for r in again] == [r.val_losses for r in runs]
    h = B.history(spark, state).where("is_best").collect()
    assert {(r.run_id, r.epoch) for r in h} == {(r.run_id, r.best_epoch) for r in runs}
    scored = score(df, "features", B.best_model(spark, state, START, "even"), keep=["label"])
    assert scored.where("predicted = label").count() > 0.6 * 230


def test_a_sweep_equals_single_runs(spark, data, tmp_path):
    df = data[3]
    args = dict(epochs=2, lr=0.05)
    both = B.fit_minibatches(df, "id", SETS, START, str(tmp_path / "both"), **args)
    for r in both:
        one = B.fit_minibatches(df, "id", {r.run_id: SETS[r.run_id]}, START, str(tmp_path / r.run_id), **args)[0]
        assert r.theta == pytest.approx(one.theta, rel=1e-9) and r.val_losses == pytest.approx(one.val_losses)
    with pytest.raises(ValueError):
        B.fit_minibatches(df, "id", {"even": SETS["even"]}, START, str(tmp_path / "both"), epochs=9)


def test_four_shards_bring_the_loss_down_as_far(spark, data, tmp_path):
    df = data[3]
    one = B.fit_minibatches(df, "id", {"a": SETS["even"]}, START, str(tmp_path / "one"), epochs=5, lr=0.02)[0]
    four = B.fit_minibatches(df, "id", {"a": SETS["even"]}, START, str(tmp_path / "four"), epochs=5, lr=0.02, shards=4, batch_rows=8)[0]
    assert four.train_losses[-1] < 0.8 * four.train_losses[0]
    assert four.val_losses[-1] < one.val_losses[0] and four.val_losses[-1] < one.val_losses[-1] + 0.1


def test_no_rows(spark, data, tmp_path):
    with pytest.raises(ValueError):
        B.fit_minibatches(data[3].where("split = 'val'"), "id", {"a": SETS["even"]}, START, str(tmp_path / "s"), epochs=1)
    run = B.fit_minibatches(data[3].where("split = 'train'"), "id", {"a": SETS["even"]}, START, str(tmp_path / "t"), epochs=1)[0]
    assert run.val_losses == run.train_losses
