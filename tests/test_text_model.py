"""The text baseline at its optimum against Newton's method on dense NumPy matrices."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonality.operators import text_model as T


def _texts(n=120, seed=0):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(25)]
    rows = []
    for i in range(n):
        y = int(rng.integers(0, 3))
        weights = np.ones(25) + np.eye(25)[y * 3] * 4 + np.eye(25)[y * 3 + 1] * 2
        rows.append((i, [str(w) for w in rng.choice(words, rng.integers(0, 30), p=weights / weights.sum())], y if i % 11 else 2 - y))
    return rows


def _newton(rows, C=1.0, classes=3):
    terms = sorted({t for _, ts, _ in rows for t in ts if len(t) >= 2})
    X = np.array([[ts.count(t) for t in terms] + [1.0] for _, ts, _ in rows])
    Y = np.eye(classes)[[y for *_, y in rows]]
    n, d = X.shape
    ridge = np.ones(d) / (C * n)
    ridge[-1] = 0.0
    W = np.zeros((d, classes))
    for _ in range(60):
        Z = X @ W
        P = np.exp(Z - Z.max(axis=1, keepdims=True))
        P /= P.sum(axis=1, keepdims=True)
        g = X.T @ (P - Y) / n + ridge[:, None] * W
        H = np.zeros((d, classes, d, classes))
        for a in range(classes):
            for b in range(classes):
                H[:, a, :, b] = X.T @ (X * (P[:, a] * ((a == b) - P[:, b]))[:, None]) / n + (a == b) * np.diag(ridge)
        W -= np.linalg.lstsq(H.reshape(d * classes, -1), g.ravel(), rcond=None)[0].reshape(d, classes)
    return dict(zip(terms, W[:-1])), P


@pytest.fixture(scope="module")
def fitted(spark):
    rows = _texts()
    df = spark.createDataFrame([*rows, (900, ["w1", "w2"], None), (901, None, None)], "id long, tokens array<string>, label int")
    return rows, df, T.fit_text_optimum(df, "id", tol=1e-5)


def test_coefficients_are_those_of_newton(fitted):
    rows, _, model = fitted
    want, _ = _newton(rows)
    got = {r.term: [r.w0, r.w1, r.w2] for r in model.vocabulary.join(model.coefficients, "term_id").collect()}
    assert model.converged and got.keys() == want.keys()
    for term, w in want.items():
        assert got[term] == pytest.approx(w, abs=1e-3)


def test_loss_never_rises_and_gradient_vanishes(fitted):
    _, _, model = fitted
    losses = [loss for _, loss, _ in model.history]
    assert losses[0] == pytest.approx(np.log(3)) and all(b < a for a, b in zip(losses, losses[1:]))
    assert model.history[-1][2] <= 1e-5 * model.history[0][2]


def test_probabilities_and_class_shares(fitted):
    rows, df, model = fitted
    _, want = _newton(rows)
    got = {r.id: r for r in T.class_probabilities(model, df, "id").collect()}
    assert len(got) == len(rows) + 2
    for (i, _, _), p in zip(rows, want):
        assert got[i].probs == pytest.approx(p, abs=1e-3)
    share = np.bincount([y for *_, y in rows], minlength=3) / len(rows)
    assert np.mean([got[i].probs for i, *_ in rows], axis=0) == pytest.approx(share, abs=1e-5)


def test_an_early_end_is_reported(fitted):
    _, df, _ = fitted
    model = T.fit_text_optimum(df, "id", max_iter=2)
    assert not model.converged and len(model.history) == 3


def test_fit_of_nothing(spark):
    df = spark.createDataFrame([], "id long, tokens array<string>, label int")
    model = T.fit_text_optimum(df, "id")
    assert model.coefficients.count() == 0 and model.intercepts == [0.0] * 3
    lone = spark.createDataFrame([(1, [], 2), (2, None, 2)], "id long, tokens array<string>, label int")
    model = T.fit_text_optimum(lone, "id", max_iter=3)
    assert T.class_probabilities(model, lone, "id").where(F.col("predicted") == 2).count() == 2


def test_blocks_travel_by_distinct_term(spark):
    from tonality.operators.text_blocks import TOTALS, text_blocks
    from tonality.operators.tokens import fit_vocabulary

    rows = [(i % 40, ["aa", "bb", "aa"][:1 + i % 3], i % 3) for i in range(90)] + [(None, ["cc", "aa"], 1), (None, [], 0)]
    src = spark.createDataFrame(rows, "_key long, tokens array<string>, _y int").repartition(5)
    vocabulary = fit_vocabulary(src, "tokens").cache()
    blocks = text_blocks(src, vocabulary, 3)
    ids = {r.term: r.term_id for r in vocabulary.collect()}
    assert blocks.n == len(rows) and blocks.wants.count() == 2 * blocks.blocks.count()  # not one row per document; no "cc"
    W = spark.createDataFrame([(ids["aa"], 0.5, -0.25, 0.0), (ids["bb"], 1.0, 0.0, -1.0)], "term_id long, w0 double, w1 double, w2 double")
    bias = np.array([0.1, 0.2, 0.3])
    got = {r.term_id: list(r)[1:] for r in blocks.gradient(W, ["w0", "w1", "w2"], bias).collect()}
    counts = {}
    for k, words, _ in rows:
        for w in words if k is not None else []:
            counts.setdefault(k, dict.fromkeys(("aa", "bb"), 0))[w] += 1
    w = {"aa": np.array([0.5, -0.25, 0.0]), "bb": np.array([1.0, 0.0, -1.0])}
    want, total, loss = {"aa": np.zeros(3), "bb": np.zeros(3)}, np.zeros(3), 0.0
    for k, _, y in rows:
        own = counts.get(k, {})
        z = bias + sum((n * w[t] for t, n in own.items()), np.zeros(3))
        p = np.exp(z) / np.exp(z).sum()
        loss -= np.log(p[y])
        total += p - np.eye(3)[y]
        for t, n in own.items():
            want[t] += n * (p - np.eye(3)[y])
    for t in want:
        assert got[ids[t]][:3] == pytest.approx(want[t])
    assert got[TOTALS] == pytest.approx([*total, loss])
    blocks.drop()


def test_a_pass_travels_by_block_and_shard(spark):
    """Terms of several shards, word lists cut over Arrow batches: sums as on dense matrices, one row for each block and shard."""
    from tonality.operators.text_blocks import SHARD, TOTALS, text_blocks

    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(300)]
    rows = [(i % 150 if i % 13 else None, [str(w) for w in rng.choice(words, 20)] + ["z", None], int(rng.integers(0, 3))) for i in range(400)]
    src = spark.createDataFrame([*rows, (7, None, 1), (900, [], 2)], "_key long, tokens array<string>, _y int").repartition(3)
    ids = {w: i * (SHARD // 100) + 5 for i, w in enumerate(words[:-1])}  # the last word is not in the vocabulary
    vocabulary = spark.createDataFrame(list(ids.items()), "term string, term_id long")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        blocks = text_blocks(src, vocabulary, 3)
        shards = blocks.shards(1, lambda squares: squares).cache()
        made = {r.shard: np.frombuffer(r.local, np.uint16) for r in shards.collect()}
        sent = blocks.sent(shards, lambda shard: shard.V[0]).collect()
        number = blocks.blocks.count()
        W = {w: rng.normal(size=3) for w in ids}
        values = spark.createDataFrame([(ids[w], *map(float, v)) for w, v in W.items()], "term_id long, w0 double, w1 double, w2 double")
        bias = np.array([0.3, 0.0, -0.1])
        got = {r.term_id: np.array(r[1:]) for r in blocks.gradient(values, ["w0", "w1", "w2"], bias).collect()}
        squares = {r.shard: np.frombuffer(r.scale) for r in shards.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    docs, counts, labels = [None, *range(150), 900], {}, {}
    for k, tokens, y in [*rows, (7, [], 1), (900, [], 2)]:
        labels.setdefault(k, []).append(y)
        for w in tokens if k is not None else []:
            if w in ids:
                counts[k, w] = counts.get((k, w), 0) + 1
    X = np.array([[counts.get((k, w), 0) for w in ids] for k in docs if k in labels])
    Y = np.array([np.bincount(labels[k], minlength=3) for k in docs if k in labels])
    Z = X @ np.array(list(W.values())) + bias
    P = np.exp(Z) / np.exp(Z).sum(axis=1, keepdims=True)
    R = Y.sum(axis=1, keepdims=True) * P - Y
    want = X.T @ R
    held = [i for i, w in enumerate(ids) if X[:, i].any()]
    assert got.keys() == {TOTALS, *(list(ids.values())[i] for i in held)}
    for i in held:
        term = list(ids.values())[i]
        assert got[term][:3] == pytest.approx(want[i])
        at = np.searchsorted(made[term // SHARD], term % SHARD)
        assert squares[term // SHARD][at] == (X[:, i] ** 2).sum()
    assert got[TOTALS] == pytest.approx([*R.sum(axis=0), -(Y * np.log(P)).sum()])
    assert len(made) == 3 and len(sent) <= number * len(made) and len({(r.block, r.shard) for r in sent}) == len(sent)
    blocks.drop()


def test_steps_of_shards_take_the_words_of_rows_without_key_as_zeros(spark, monkeypatch):
    from tonality.operators import text_blocks as B
    from tonality.operators.model import fit_text_baseline

    monkeypatch.setattr(B.TextBlocks, "gradient", None)  # sums by row of a term: no step takes them
    df = spark.createDataFrame([(None, ["only", "here"], 0), (1, ["else"], 1), (1, ["else", "where"], 2), (2, None, 0)], "k long, tokens array<string>, label int")
    model = fit_text_baseline(df, "k", steps=2, lr=0.1)
    got = {r.term: [r.w0, r.w1, r.w2] for r in model.vocabulary.join(model.coefficients, "term_id").collect()}
    assert got.keys() == {"only", "here", "else", "where"} and got["only"] == got["here"] == [0.0] * 3
    assert all(got["else"]) and model.history[1][1] < model.history[0][1] == pytest.approx(np.log(3))
