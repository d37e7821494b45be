"""Model fitting, weight sweep, batch-table and stream scoring.

The optimisers start from closed-form parameters and take a fixed number of steps, so SQL can take
the same steps; the convex fits are checked by a property of their optimum.
"""

from __future__ import annotations

import math
import os
import uuid

from pyspark.sql import functions as F

from tonality.functions import text as X
from tonality.functions.labels import label_name, label_rating
from tonality.functions import vectors as V
from tonality.operators import dist, fuse, split
from tonality.operators.model import (ReluClassifier, fit_relu_classifier, fit_text_baseline, history_frame, predict_text_baseline,
                                      relu_gradient, sweep_class_weights)
from tonality.functions.text import WS_CLASS
from tonality.plans import sqlfrag as Q
from tonality.operators.metrics import literal_rows
from tonality.plans.catalog import query
from tonality.plans.catalog_more import _fusion_sql as fusion_sql
from tonality.plans.scoring import ScoringModel, score_table
from tonality.session import materialize
from tonality.sources import tables as S


# A label the vector decides: the argmax of a closed-form projection of all 64 values (salt 41).
LABEL_SALT, HIDDEN, CLASSES, WIDTH = 41, 4, 3, 64


def _labelled_vectors(spark, sf):
    x = F.col("embedding").cast("array<double>")
    v = S.vectors(spark, sf).select("vec_id", x.alias("features"))
    label = V.argmax(fuse.project_expr(F.col("features"), fuse.closed_form_linear(CLASSES, WIDTH, LABEL_SALT)))
    v = v.withColumn("label", label)
    return split.split_exact(v, "vec_id", (0.7, 0.15, 0.15), ("train", "val", "test"), seed=7, rounding="floor")


def _train_features(spark, sf):
    """Features for the classifier: 64-d embeddings with their labels, 70/15/15 split, inverse-frequency
    weights from the training rows; written once, as every optimiser step reads them."""
    v = materialize(_labelled_vectors(spark, sf), "labelled-vectors")
    w = dist.class_weights(v, "label", split_col="split", scope="train")
    return dist.with_class_weight(v, w, "label")


_FEATURES_SQL = f"""
o AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x, row_number() OVER (ORDER BY {Q.hash_order('vec_id', 7)}, vec_id) AS rn,
             count(*) OVER () AS cnt FROM embeddings),
lab AS (SELECT *, {Q.project('x', CLASSES, WIDTH, LABEL_SALT)} AS q FROM o),
sp AS (SELECT vec_id, x, {Q.argmax('q')} AS y,
              CASE WHEN rn <= floor(CAST(0.7 AS DOUBLE) * cnt) THEN 'train'
                   WHEN rn <= floor(CAST(0.7 AS DOUBLE) * cnt) + floor(CAST(0.15 AS DOUBLE) * cnt) THEN 'val' ELSE 'test' END AS split
       FROM lab),
cw AS (SELECT y, 1.0 / CAST(count(*) AS DOUBLE) AS w FROM sp WHERE split = 'train' GROUP BY y)"""


def _step_sql(state: str, data: str, k: str) -> str:
    """CTEs of one optimiser step: forward pass, losses and mean gradient at the parameters of ``state(theta)``."""
    w1, b1, w2 = HIDDEN * WIDTH, HIDDEN * WIDTH + HIDDEN, HIDDEN * WIDTH + HIDDEN + CLASSES * HIDDEN
    return f"""
a{k} AS (SELECT d.*, s.theta, list_transform(range({HIDDEN}), lambda i: list_sum(list_transform(range({WIDTH}),
             lambda j: x[j + 1] * s.theta[i * {WIDTH} + j + 1])) + s.theta[{w1} + i + 1]) AS pre FROM {data} d, {state} s),
h{k} AS (SELECT *, list_transform(pre, lambda u: greatest(u, 0.0)) AS h FROM a{k}),
z{k} AS (SELECT *, list_transform(range({CLASSES}), lambda c: list_sum(list_transform(range({HIDDEN}),
             lambda i: h[i + 1] * theta[{b1} + c * {HIDDEN} + i + 1])) + theta[{w2} + c + 1]) AS z FROM h{k}),
p{k} AS (SELECT *, {Q.softmax('z')} AS p FROM z{k}),
l{k} AS (SELECT sum(w * -ln(p[y + 1])) FILTER (WHERE split = 'train') / sum(w) FILTER (WHERE split = 'train') AS train_loss,
                sum(w * -ln(p[y + 1])) FILTER (WHERE split = 'val') / sum(w) FILTER (WHERE split = 'val') AS val_loss FROM p{k}),
dz{k} AS (SELECT *, list_transform(range({CLASSES}), lambda c: w * (p[c + 1] - CASE WHEN y = c THEN 1.0 ELSE 0.0 END)) AS dz
          FROM p{k} WHERE split = 'train'),
dh{k} AS (SELECT *, list_transform(range({HIDDEN}), lambda i: CASE WHEN pre[i + 1] > 0 THEN list_sum(list_transform(
              range({CLASSES}), lambda c: dz[c + 1] * theta[{b1} + c * {HIDDEN} + i + 1])) ELSE 0.0 END) AS dh FROM dz{k}),
r{k} AS (SELECT w, list_concat(list_concat(flatten(list_transform(range({HIDDEN}), lambda i: list_transform(range({WIDTH}),
             lambda j: dh[i + 1] * x[j + 1]))), dh), list_concat(flatten(list_transform(range({CLASSES}),
             lambda c: list_transform(range({HIDDEN}), lambda i: dz[c + 1] * h[i + 1]))), dz)) AS g FROM dh{k}),
u{k} AS (SELECT unnest(g) AS v, generate_subscripts(g, 1) AS idx FROM r{k}),
s{k} AS (SELECT idx, sum(v) / (SELECT sum(w) FROM r{k}) AS v FROM u{k} GROUP BY idx),
g{k} AS (SELECT list(v ORDER BY idx) AS g FROM s{k})"""


def _start_sql(name: str) -> str:
    theta = f"""list_concat(list_concat(flatten(list_transform(range({HIDDEN}), lambda i: list_transform(range({WIDTH}),
        lambda j: {Q.weight('i', 'j', 1)}))), list_transform(range({HIDDEN}), lambda i: {Q.bias('i', 1)})),
        list_concat(flatten(list_transform(range({CLASSES}), lambda i: list_transform(range({HIDDEN}), lambda j: {Q.weight('i', 'j', 2)}))),
        list_transform(range({CLASSES}), lambda i: {Q.bias('i', 2)})))"""
    return f"{name} AS (SELECT theta, list_transform(theta, lambda u: 0.0::DOUBLE) AS m, list_transform(theta, lambda u: 0.0::DOUBLE) AS v FROM (SELECT {theta} AS theta))"


def _adam_sql(name: str, state: str, grad: str, t: int, lr: float) -> str:
    """CTE of the state after Adam's step ``t``."""
    n = HIDDEN * WIDTH + HIDDEN + CLASSES * HIDDEN + CLASSES
    return f"""
{name}_m AS (SELECT s.theta, list_transform(range({n}), lambda i: 0.9 * s.m[i + 1] + 0.1 * g.g[i + 1]) AS m,
       list_transform(range({n}), lambda i: 0.999 * s.v[i + 1] + 0.001 * g.g[i + 1] * g.g[i + 1]) AS v FROM {state} s, {grad} g),
{name} AS (SELECT list_transform(range({n}), lambda i: theta[i + 1] - {lr} * (m[i + 1] / {1 - 0.9 ** t!r})
       / (sqrt(v[i + 1] / {1 - 0.999 ** t!r}) + 1e-8)) AS theta, m, v FROM {name}_m)"""


def _fit_sql(data: str, epochs: int, lr: float, tag: str = "") -> tuple[str, list[str]]:
    """CTEs of ``epochs`` Adam steps from the closed-form start, and the names of the states after each."""
    parts, states = [_start_sql(f"t{tag}0")], []
    for k in range(epochs + 1):
        parts.append(_step_sql(f"t{tag}{k}", data, f"{tag}{k}"))
        if k < epochs:
            parts.append(_adam_sql(f"t{tag}{k + 1}", f"t{tag}{k}", f"g{tag}{k}", k + 1, lr))
            states.append(f"t{tag}{k + 1}")
    return ",\n".join(p.strip() for p in parts), states


_WEIGHTED_SQL = "dat AS (SELECT vec_id, x, y, w, split FROM sp JOIN cw USING (y) WHERE split <> 'test')"


@query("relu_gradient", f"""
WITH {_FEATURES_SQL}, {_WEIGHTED_SQL}, {_start_sql('t0')}, {_step_sql('t0', 'dat', '0').strip()}
SELECT CAST(idx - 1 AS INTEGER) AS idx, round(v, 8) AS value FROM s0
UNION ALL SELECT -1, round(train_loss, 8) FROM l0 UNION ALL SELECT -2, round(val_loss, 8) FROM l0""")
def q_relu_gradient(spark, sf):
    """Loss and every gradient entry at closed-form parameters."""
    g = relu_gradient(_train_features(spark, sf), ReluClassifier.closed_form(WIDTH, HIDDEN, CLASSES, salt=1))
    return g.select("idx", F.round("value", 8).alias("value"))


_EPOCHS, _LR = 4, 0.05
_FIT, _ = _fit_sql("dat", _EPOCHS, _LR)


@query("fit_relu_classifier", f"""
WITH {_FEATURES_SQL}, {_WEIGHTED_SQL}, {_FIT}
{' UNION ALL '.join(f"SELECT {k} AS epoch, round(train_loss, 6) AS train_loss, round(val_loss, 6) AS val_loss FROM l{k}" for k in range(1, _EPOCHS + 1))}""")
def q_fit_relu_classifier(spark, sf):
    """M2b + M3: four Adam epochs from a closed-form start; the losses after each."""
    res = fit_relu_classifier(_train_features(spark, sf), hidden=HIDDEN, classes=CLASSES, epochs=_EPOCHS, patience=_EPOCHS,
                              lr=_LR, start=ReluClassifier.closed_form(WIDTH, HIDDEN, CLASSES, salt=1))
    return history_frame(spark, res, "relu").select("epoch", F.round("train_loss", 6).alias("train_loss"),
                                                    F.round("val_loss", 6).alias("val_loss"))


@query("fit_weighted_logreg", f"""
WITH {_FEATURES_SQL} SELECT y AS label, count(*) AS rows, true AS at_optimum FROM sp WHERE split = 'train' GROUP BY y""")
def q_fit_weighted_logreg(spark, sf):
    """At the optimum, with a free intercept, the weighted mean probability of each class over the
    training rows is the class's share of the weight."""
    from tonality.operators.model import fit_weighted_logreg, predict_weighted_logreg
    train = _train_features(spark, sf).where(F.col("split") == "train")
    model = fit_weighted_logreg(train, "features", "label", "weight", reg=1e-3, max_iter=500)
    pred = predict_weighted_logreg(model, train, "features", keep=["label", "weight"])
    classes = F.explode(F.array(*[F.struct(F.lit(c).alias("label"), (F.col("weight") * F.col("probs")[c]).alias("mass"),
                                           F.when(F.col("label") == c, F.col("weight")).otherwise(0.0).alias("own"),
                                           (F.col("label") == c).cast("long").alias("row")) for c in range(CLASSES)]))
    sums = pred.select("weight", classes.alias("c")).groupBy("c.label").agg(
        F.sum("c.row").alias("rows"), ((F.sum("c.mass") - F.sum("c.own")) / F.sum("weight")).alias("gap"))
    return sums.where("rows > 0").select("label", "rows", (F.abs("gap") < 1e-3).alias("at_optimum"))


_SETS = {"w_2_3_1": [2.0, 3.0, 1.0], "w_3_1_1": [3.0, 1.0, 1.0], "w_4_1_1": [4.0, 1.0, 1.0]}
_SWEEP_EPOCHS = 2


def _sweep_sql() -> str:
    parts, runs = [_FEATURES_SQL.strip()], []
    for n, (run, ws) in enumerate(_SETS.items()):
        tag = f"{chr(97 + n)}"
        parts.append(f"d{tag} AS (SELECT vec_id, x, y, {ws}[y + 1] AS w, split FROM sp)")
        cte, states = _fit_sql(f"d{tag}", _SWEEP_EPOCHS, _LR, tag)
        parts.append(cte)
        losses = " UNION ALL ".join(f"SELECT {k} AS k, val_loss, (SELECT theta FROM {s}) AS theta FROM l{tag}{k}" for k, s in enumerate(states, 1))
        parts.append(f"best{tag} AS (SELECT theta FROM ({losses}) ORDER BY val_loss, k LIMIT 1)")
        parts.append(_step_sql(f"best{tag}", f"d{tag}", f"{tag}x").strip())
        parts.append(f"pr{tag} AS (SELECT y AS truth, {Q.argmax('z')} AS prediction FROM z{tag}x WHERE split = 'test')")
        parts.append(f"""f{tag} AS (SELECT c, count(*) FILTER (WHERE truth = c) AS s, count(*) FILTER (WHERE prediction = c) AS q,
            count(*) FILTER (WHERE truth = c AND prediction = c) AS t FROM pr{tag}, (SELECT unnest([0, 1, 2]) AS c) GROUP BY c)""")
        runs.append(f"""SELECT '{run}' AS run_id, round(sum(f1 * s) / sum(s), 6) AS f1_weighted, round(avg(f1), 6) AS f1_macro,
            round(CAST(sum(t) AS DOUBLE) / sum(s), 6) AS accuracy FROM (SELECT *, 2.0 * t / (s + q) AS f1 FROM f{tag} WHERE s + q > 0)""")
    return "WITH " + ",\n".join(parts) + "\n" + "\nUNION ALL ".join(runs)


@query("sweep_class_weights", _sweep_sql())
def q_sweep_class_weights(spark, sf):
    """M4: one evaluation record per class-weight set, two Adam epochs each from a closed-form start."""
    rec = sweep_class_weights(_labelled_vectors(spark, sf), _SETS, "features", "label", "split", hidden=HIDDEN, classes=CLASSES,
                              epochs=_SWEEP_EPOCHS, patience=5, lr=_LR, start=ReluClassifier.closed_form(WIDTH, HIDDEN, CLASSES, salt=1))
    return rec.select("run_id", *[F.round(c, 6).alias(c) for c in ("f1_weighted", "f1_macro", "accuracy")])


_MB_ROWS, _MB_EPOCHS, _MB_PATIENCE, _MB_LR = 32, 8, 2, 0.2


def _minibatch_sql(features: str, epochs: int, patience: int, lr: float) -> str:
    """The mini-batch loop as a recursive query, a step of 32 rows per round; then losses, early stop and the best epoch."""
    n = HIDDEN * WIDTH + HIDDEN + CLASSES * HIDDEN + CLASSES
    w1, b1, w2 = HIDDEN * WIDTH, HIDDEN * WIDTH + HIDDEN, HIDDEN * WIDTH + HIDDEN + CLASSES * HIDDEN
    return f"""
WITH RECURSIVE {features.strip()}, {_WEIGHTED_SQL}, {_start_sql('t0')},
steps AS (SELECT CAST(ceil(count(*) / {_MB_ROWS}.0) AS BIGINT) AS s FROM dat WHERE split = 'train'),
ord AS (SELECT vec_id, (e - 1) * (SELECT s FROM steps) + (row_number() OVER (PARTITION BY e ORDER BY md5(CAST(vec_id AS VARCHAR) || ':' || CAST(42 + e AS VARCHAR)), CAST(vec_id AS VARCHAR)) - 1) // {_MB_ROWS} AS step
        FROM dat, (SELECT unnest(range(1, {epochs} + 1)) AS e) WHERE split = 'train'),
st AS (SELECT 0::BIGINT AS t, theta, m, v, 0.0::DOUBLE AS loss FROM t0 UNION ALL SELECT * FROM (
  WITH bt AS (SELECT d.* FROM dat d JOIN ord o USING (vec_id) JOIN st ON o.step = st.t),
  {_step_sql('st', 'bt', 'q').strip()},
  mv AS (SELECT s.t, s.theta, list_transform(range({n}), lambda i: 0.9 * s.m[i + 1] + 0.1 * g.g[i + 1]) AS m,
                list_transform(range({n}), lambda i: 0.999 * s.v[i + 1] + 0.001 * g.g[i + 1] * g.g[i + 1]) AS v FROM st s, gq g
         WHERE s.t < {epochs} * (SELECT s FROM steps))
  SELECT t + 1, list_transform(range({n}), lambda i: theta[i + 1] - {lr} * (m[i + 1] / (1 - pow(0.9, t + 1)))
                / (sqrt(v[i + 1] / (1 - pow(0.999, t + 1))) + 1e-8)), m, v, (SELECT train_loss FROM lq) FROM mv)),
ep AS (SELECT t // (SELECT s FROM steps) AS epoch, theta FROM st WHERE t > 0 AND t % (SELECT s FROM steps) = 0),
tl AS (SELECT (t - 1) // (SELECT s FROM steps) + 1 AS epoch, avg(loss) AS train_loss FROM st WHERE t > 0 GROUP BY 1),
fa AS (SELECT ep.epoch, d.y, d.split, coalesce(cw.w, 0) AS w, theta, list_transform(range({HIDDEN}), lambda i: greatest(0.0, list_sum(list_transform(range({WIDTH}),
         lambda j: x[j + 1] * theta[i * {WIDTH} + j + 1])) + theta[{w1} + i + 1])) AS h FROM sp d LEFT JOIN cw USING (y), ep WHERE d.split <> 'train'),
fz AS (SELECT *, list_transform(range({CLASSES}), lambda c: list_sum(list_transform(range({HIDDEN}),
         lambda i: h[i + 1] * theta[{b1} + c * {HIDDEN} + i + 1])) + theta[{w2} + c + 1]) AS z FROM fa),
fp AS (SELECT *, {Q.softmax('z')} AS p FROM fz),
vl AS (SELECT epoch, sum(w * -ln(p[y + 1])) / sum(w) AS val_loss FROM fp WHERE split = 'val' GROUP BY epoch),
lo AS (SELECT epoch, val_loss, coalesce(val_loss < min(val_loss) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS better FROM vl),
im AS (SELECT *, max(CASE WHEN better THEN epoch END) OVER (ORDER BY epoch) AS best_so_far FROM lo),
en AS (SELECT coalesce(min(epoch), {epochs}) AS last FROM im WHERE epoch - best_so_far >= {patience}),
be AS (SELECT best_so_far AS best FROM im, en WHERE epoch = last)"""


_MB_LOSSES = f"""
hits AS (SELECT count(*) FILTER (WHERE y = {Q.argmax('z')}) AS test_right FROM fp, be WHERE epoch = best AND split = 'test')
SELECT CAST(epoch AS INTEGER) AS epoch, round(train_loss, 6) AS train_loss, round(val_loss, 6) AS val_loss, epoch = best AS is_best, test_right
FROM im JOIN tl USING (epoch), en, be, hits WHERE epoch <= last"""


@query("fit_minibatch_resumed", f"{_minibatch_sql(_FEATURES_SQL, _MB_EPOCHS, _MB_PATIENCE, _MB_LR)},{_MB_LOSSES}")
def q_fit_minibatch_resumed(spark, sf):
    """M2b + M3: mini-batches of 32 from a closed-form start; the run breaks off after two epochs, goes on from its committed
    state and stops early; losses per epoch, the best epoch and the test rows its parameters get right."""
    from tonality.operators import minibatch
    from tonality.operators.model import score
    from tonality.session import scratch_path

    feats = materialize(_labelled_vectors(spark, sf), "labelled-vectors")
    found = dist.class_weights(feats, "label", split_col="split", scope="train").collect()  # one row per class
    weights = {"inverse": [next((float(r["weight"]) for r in found if r["label"] == c), 0.0) for c in range(CLASSES)]}
    state, start = scratch_path(spark, f"minibatch-{uuid.uuid4().hex}"), ReluClassifier.closed_form(WIDTH, HIDDEN, CLASSES, salt=1)
    args = dict(batch_rows=_MB_ROWS, epochs=_MB_EPOCHS, patience=_MB_PATIENCE, lr=_MB_LR)
    minibatch.fit_minibatches(feats, "vec_id", weights, start, state, stop_after=2, **args)
    minibatch.fit_minibatches(feats, "vec_id", weights, start, state, **args)
    scored = score(feats.where("split = 'test'"), "features", minibatch.best_model(spark, state, start), keep=["label"])
    right = scored.agg(F.count(F.when(F.col("predicted") == F.col("label"), 1)).alias("test_right"))
    return minibatch.history(spark, state).crossJoin(right).select(  # a join with one row
        "epoch", F.round("train_loss", 6).alias("train_loss"), F.round("val_loss", 6).alias("val_loss"), "is_best", "test_right")


_FUSED_SQL = (fusion_sql("mask").strip().removeprefix("WITH ").rsplit("SELECT vec_id,", 1)[0].rstrip() + ","
              + _FEATURES_SQL.replace("CAST(embedding AS DOUBLE[]) AS x", "fused AS x").replace("FROM embeddings", "FROM f"))
_FF_EPOCHS, _FF_LR = 3, 0.05
_BIAS2, _W2, _BIAS3 = HIDDEN * WIDTH, HIDDEN * WIDTH + HIDDEN, HIDDEN * WIDTH + HIDDEN + CLASSES * HIDDEN


@query("fused_fit_score", f"""
{_minibatch_sql(_FUSED_SQL, _FF_EPOCHS, _FF_EPOCHS, _FF_LR)},
sa AS (SELECT vec_id, theta, list_transform(range({HIDDEN}), lambda i: greatest(0.0, list_sum(list_transform(range({WIDTH}),
         lambda j: x[j + 1] * theta[i * {WIDTH} + j + 1])) + theta[{_BIAS2} + i + 1])) AS h FROM sp, ep, be WHERE ep.epoch = be.best),
sz AS (SELECT vec_id, list_transform(range({CLASSES}), lambda c: list_sum(list_transform(range({HIDDEN}),
         lambda i: h[i + 1] * theta[{_W2} + c * {HIDDEN} + i + 1])) + theta[{_BIAS3} + c + 1]) AS z FROM sa),
sq AS (SELECT vec_id, z, {Q.softmax('z')} AS p FROM sz)
SELECT vec_id, {Q.label_name(Q.argmax('z'))} AS sentiment, round(list_max(p), 6) AS confidence FROM sq""")
def q_fused_fit_score(spark, sf):
    """S11 + M2 + M6: modalities fused, a classifier fitted on the fused vectors, its best state after one and after three epochs
    put into the registry, the best of both loaded again and every row scored with it."""
    from tonality.operators import minibatch
    from tonality.operators.model import score
    from tonality.plans import registry
    from tonality.plans.catalog_more import _fusion_input
    from tonality.session import scratch_path

    params = fuse.FusionParams.closed_form(64, 32, 16)
    fused = fuse.fuse_modalities(_fusion_input(spark, sf), params, missing="mask", keep=["vec_id"]).withColumnRenamed("fused", "features")
    label = V.argmax(fuse.project_expr(F.col("features"), fuse.closed_form_linear(CLASSES, WIDTH, LABEL_SALT)))
    feats = materialize(fused.withColumn("label", label), "fused-vectors")
    feats = materialize(split.split_exact(feats, "vec_id", (0.7, 0.15, 0.15), ("train", "val", "test"), seed=7, rounding="floor"), "fused-splits")
    found = dist.class_weights(feats, "label", split_col="split", scope="train").collect()  # one row per class
    weights = {"inverse": [next((float(r["weight"]) for r in found if r["label"] == c), 0.0) for c in range(CLASSES)]}
    base, start = scratch_path(spark, f"fused-fit-{uuid.uuid4().hex}"), ReluClassifier.closed_form(WIDTH, HIDDEN, CLASSES, salt=1)
    for stop_after in (1, _FF_EPOCHS - 1):
        run = minibatch.fit_minibatches(feats, "vec_id", weights, start, f"{base}/state", epochs=_FF_EPOCHS, patience=_FF_EPOCHS, lr=_FF_LR,
                                        stop_after=stop_after)[0]
        model = ScoringModel(params, minibatch.best_model(spark, f"{base}/state", start))
        registry.register(spark, f"{base}/registry", f"epoch-{len(run.val_losses)}", model, {"val_loss": run.best_loss})
    model = registry.load(spark, f"{base}/registry", "val_loss")
    out = score(feats, "features", model.classifier, keep=["vec_id"])
    return out.select("vec_id", "sentiment", F.round("confidence", 6).alias("confidence"))


_TEXT_STEPS, _TEXT_LR = 3, 0.01


def _text_baseline_sql() -> str:
    """Adagrad steps of the bag-of-words classifier, unrolled; then the confusion counts on the test rows."""
    c3 = range(CLASSES)
    parts = [f"""
d AS (SELECT review_id AS k, list_filter(string_split({Q.clean_ascii('verified_reviews')}, ' '), lambda w: length(w) >= 2) AS l,
             {Q.label_ge4('rating')} AS y, row_number() OVER (ORDER BY {Q.hash_order('review_id', 42)}, review_id) AS rn,
             count(*) OVER () AS cnt FROM ({Q.reviews()})),
s AS (SELECT k, l, y, CASE WHEN rn <= ceil(CAST(0.2 AS DOUBLE) * cnt) THEN 'test' ELSE 'train' END AS split FROM d),
tr AS (SELECT k, y FROM s WHERE split = 'train'),
n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM tr),
bag AS (SELECT k, split, term, CAST(count(*) AS DOUBLE) AS c FROM (SELECT k, split, unnest(l) AS term FROM s) GROUP BY 1, 2, 3),
b AS (SELECT k, term, c FROM bag WHERE split = 'train'),
w0 AS (SELECT DISTINCT term, {', '.join(f'0.0::DOUBLE AS w{c}, 0.0::DOUBLE AS a{c}' for c in c3)} FROM b),
i0 AS (SELECT {', '.join(f'0.0::DOUBLE AS b{c}, 0.0::DOUBLE AS a{c}' for c in c3)})"""]
    for t in range(_TEXT_STEPS):
        e = " + ".join(f"exp(z{c} - top)" for c in c3)
        parts.append(f"""
x{t} AS (SELECT b.k, {', '.join(f'sum(c * w{c}) AS s{c}' for c in c3)} FROM b JOIN w{t} USING (term) GROUP BY b.k),
y{t} AS (SELECT tr.k, tr.y, {', '.join(f'coalesce(s{c}, 0) + i.b{c} AS z{c}' for c in c3)} FROM tr LEFT JOIN x{t} USING (k), i{t} i),
m{t} AS (SELECT *, greatest({', '.join(f'z{c}' for c in c3)}) AS top FROM y{t}),
e{t} AS (SELECT *, {e} AS tot FROM m{t}),
r{t} AS (SELECT k, ln(tot) + top - CASE y {' '.join(f'WHEN {c} THEN z{c}' for c in c3)} END AS loss,
                {', '.join(f'exp(z{c} - top) / tot - CASE WHEN y = {c} THEN 1.0 ELSE 0.0 END AS r{c}' for c in c3)} FROM e{t}),
g{t} AS (SELECT term, {', '.join(f'sum(c * r{c}) / (SELECT n FROM n) AS g{c}' for c in c3)} FROM b JOIN r{t} USING (k) GROUP BY term),
f{t} AS (SELECT w.term, {', '.join(f'w.w{c}, w.a{c}, coalesce(g.g{c}, 0) + w.w{c} / (SELECT n FROM n) AS g{c}' for c in c3)}
         FROM w{t} w LEFT JOIN g{t} g USING (term)),
w{t + 1} AS (SELECT term, {', '.join(f'w{c} - {_TEXT_LR} * g{c} / (sqrt(a{c} + g{c} * g{c}) + 1e-8) AS w{c}, a{c} + g{c} * g{c} AS a{c}' for c in c3)} FROM f{t}),
h{t} AS (SELECT {', '.join(f'(SELECT sum(r{c}) FROM r{t}) / (SELECT n FROM n) AS g{c}' for c in c3)}),
i{t + 1} AS (SELECT {', '.join(f'b{c} - {_TEXT_LR} * g{c} / (sqrt(a{c} + g{c} * g{c}) + 1e-8) AS b{c}, a{c} + g{c} * g{c} AS a{c}' for c in c3)}
         FROM i{t}, h{t})""")
    last = _TEXT_STEPS
    parts.append(f"""
v AS (SELECT bag.k, {', '.join(f'sum(c * w{c}) AS s{c}' for c in c3)} FROM bag JOIN w{last} USING (term) WHERE split = 'test' GROUP BY bag.k),
q AS (SELECT s.k, s.y, [{', '.join(f'coalesce(s{c}, 0) + i.b{c}' for c in c3)}] AS z FROM s LEFT JOIN v USING (k), i{last} i WHERE split = 'test')""")
    losses = " UNION ALL ".join(f"SELECT 'loss {t}' AS item, round(sum(loss) / (SELECT n FROM n), 6) AS value FROM r{t}" for t in range(last))
    return ("WITH " + ",".join(parts) + f"\n{losses} UNION ALL SELECT 'right', CAST(count(*) FILTER (WHERE y = {Q.argmax('z')}) AS DOUBLE) FROM q")


@query("fit_text_baseline", _text_baseline_sql())
def q_fit_text_baseline(spark, sf):
    """M1: three Adagrad steps of the bag-of-words classifier on the reviews stand-in; the training loss
    before each and the number of test rows it gets right."""
    r = S.reviews(spark, sf)
    d = r.select("review_id", X.words(X.clean_ascii("verified_reviews"), 2).alias("tokens"), label_rating("rating", "ge4").alias("label"))
    d = materialize(split.split_exact(d, "review_id", (0.2, 0.8), ("test", "train"), seed=42, rounding="ceil"), "baseline-tokens")
    model = fit_text_baseline(d.where(F.col("split") == "train"), "review_id", steps=_TEXT_STEPS, lr=_TEXT_LR, tol=0.0)
    test = d.where(F.col("split") == "test")
    right = predict_text_baseline(model, test, "review_id").join(test, "review_id").agg(
        F.lit("right").alias("item"), F.sum((F.col("predicted") == F.col("label")).cast("double")).alias("value"))
    losses = literal_rows(spark, [(f"loss {t}", round(v, 6)) for t, v in model.history], ["item", "value"], ["string", "double"])
    return losses.unionByName(right)


_SPLIT_REVIEWS = f"""
d AS (SELECT {Q.label_ge4('rating')} AS label, row_number() OVER (ORDER BY {Q.hash_order('review_id', 42)}, review_id) AS rn,
             count(*) OVER () AS cnt FROM ({Q.reviews()})),
s AS (SELECT label, CASE WHEN rn <= ceil(CAST(0.2 AS DOUBLE) * cnt) THEN 'test' ELSE 'train' END AS split FROM d)"""


_LBFGS_STEPS = 20


@query("text_baseline_lbfgs", f"""
WITH {_SPLIT_REVIEWS}
SELECT label, count(*) FILTER (WHERE split = 'train') AS train_rows, CAST(count(*) FILTER (WHERE split = 'test') AS DOUBLE) AS support,
       true AS loss_fell, true AS below_shares FROM s GROUP BY label""")
def q_text_baseline_lbfgs(spark, sf):
    """M1 by L-BFGS and its report (text_ana in full): the loss falls with each of 20 iterations and ends below the entropy of the
    class shares. A fit to the optimum takes hundreds of iterations on these texts; the tests compare one with Newton's method."""
    from tonality.operators.metrics import classification_report
    from tonality.plans.pipelines import text_analysis

    model, rows = text_analysis(S.reviews(spark, sf), max_iter=_LBFGS_STEPS)
    losses = [loss for _, loss, _ in model.history]
    fell = all(b < a for a, b in zip(losses, losses[1:]))
    counts = rows.where(F.col("split") == "train").groupBy("label").agg(F.count(F.lit(1)).alias("train_rows"))
    shares = [r["train_rows"] for r in counts.collect()]  # one row per class
    entropy = -sum(x / sum(shares) * math.log(x / sum(shares)) for x in shares)
    report = classification_report(rows.where(F.col("split") == "test"), "label", "predicted").select("class", "support")
    return counts.withColumn("class", label_name("label")).join(report, "class").select("label", "train_rows", "support", F.lit(fell).alias("loss_fell"), F.lit(losses[-1] < entropy).alias("below_shares"))


# the words of a message, by the rule: the text in lower case, cut at runs of white space
MESSAGE_WORDS = f"list_filter(string_split_regex({Q.normalize_text('text')}, '{WS_CLASS}+'), lambda w: length(w) >= 1)"

_REQUESTS_SQL = """SELECT conv_id || '-' || turn AS rid,
    CASE WHEN NOT ((turn % 2 = 0 OR turn % 3 = 0) AND conv_id % 5 = 0) THEN text END AS text,
    CASE WHEN turn % 2 = 0 THEN substr(role, 1, 2) END AS emoji,
    CASE WHEN turn % 3 = 0 THEN 'Sticker' || (conv_id % 7) END AS sticker FROM conversations"""


def _request_score_sql() -> str:
    """Oracle of request scoring with all three modalities: hashed vectors, gated fusion with the missing
    ones masked (a missing text is a zero vector), ReLU classifier (salts 1 and 2)."""
    zeros = "list_transform(range(64), lambda i: 0.0::DOUBLE)"
    inputs = f"""req AS ({_REQUESTS_SQL}),
{Q.hashed_vectors('tv', "SELECT rid, text FROM req WHERE text IS NOT NULL", 'rid', MESSAGE_WORDS, 64)},
{Q.hashed_vectors('ev', "SELECT rid, emoji FROM req WHERE emoji IS NOT NULL", 'rid', "string_split(emoji, '')", 32)},
{Q.hashed_vectors('sv', "SELECT rid, sticker FROM req WHERE sticker IS NOT NULL", 'rid', "[lower(sticker)]", 16)},
x AS (SELECT req.rid AS vec_id, coalesce(tv.v, {zeros}) AS xt, ev.v AS xe, sv.v AS xs
      FROM req LEFT JOIN tv ON req.rid = tv.k LEFT JOIN ev ON req.rid = ev.k LEFT JOIN sv ON req.rid = sv.k)"""
    fused = fusion_sql("mask", inputs).rsplit("SELECT vec_id,", 1)[0]
    return f"""{fused.rstrip()},
h AS (SELECT vec_id, list_transform({Q.project('fused', 128, 64, 1)}, lambda u: greatest(u, 0.0)) AS h FROM f),
z AS (SELECT vec_id, {Q.project('h', 3, 128, 2)} AS z FROM h),
pr AS (SELECT vec_id, z, {Q.softmax('z')} AS p FROM z)
SELECT vec_id AS request_id, {Q.label_name(Q.argmax('z'))} AS sentiment, round(list_max(p), 6) AS confidence FROM pr"""


def _score_sql(source: str, key: str) -> str:
    """Oracle of the message-scoring chain for text-only messages: words of the normalised text
    hashed into 64 signed slots (md5), L2-normalised, projected by the text layer of the fusion
    (salt 11) and normalised (emoji and sticker absent, so masked), then the ReLU classifier
    (salts 1 and 2)."""
    return f"""
WITH d AS (SELECT {key} AS k, {MESSAGE_WORDS} AS l
           FROM ({source})),
t AS (SELECT k, md5(unnest(l)) AS h FROM d),
s AS (SELECT k, CAST(CAST(('0x' || substr(h, 1, 8)) AS BIGINT) % 64 AS INTEGER) AS slot,
             CASE WHEN CAST(('0x' || substr(h, 9, 1)) AS INTEGER) < 8 THEN 1.0 ELSE -1.0 END AS sg FROM t),
a AS (SELECT k, slot, sum(sg) AS v FROM s GROUP BY 1, 2),
g AS (SELECT d.k, r.slot FROM d, (SELECT unnest(range(64)) AS slot) r),
w AS (SELECT g.k, list(CAST(coalesce(a.v, 0) AS DOUBLE) ORDER BY g.slot) AS raw
      FROM g LEFT JOIN a ON g.k = a.k AND g.slot = a.slot GROUP BY g.k),
x AS (SELECT k, list_transform(raw, lambda u: u / greatest(sqrt(list_sum(list_transform(raw, lambda q: q * q))), 1e-12))
             AS xt FROM w),
p AS (SELECT k, {Q.project('xt', 64, 64, 11)} AS pt FROM x),
f AS (SELECT k, list_transform(pt, lambda u: u / greatest(sqrt(list_sum(list_transform(pt, lambda q: q * q))), 1e-12))
             AS fused FROM p),
h AS (SELECT k, list_transform({Q.project('fused', 128, 64, 1)}, lambda u: greatest(u, 0.0)) AS h FROM f),
z AS (SELECT k, {Q.project('h', 3, 128, 2)} AS z FROM h),
pr AS (SELECT k, z, {Q.softmax('z')} AS p FROM z)
SELECT k AS {key}, {Q.label_name(Q.argmax('z'))} AS sentiment, round(list_max(p), 6) AS confidence FROM pr"""


@query("score_table", _score_sql("SELECT doc_id AS id, text FROM documents", "id"))
def q_score_table(spark, sf):
    """M6: the comments table (documents stand-in) scored end to end."""
    comments = S.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("comment_text"))
    out = score_table(comments, ScoringModel.closed_form())
    return out.select("id", "sentiment", F.round("confidence", 6).alias("confidence"))


@query("score_stream", _request_score_sql())
def q_score_stream(spark, sf):
    """ST1: conversation turns written as JSON request files, scored by a streaming query run to
    completion (availableNow); returns the sink's rows."""
    from tonality.session import checkpoint_dir
    from tonality.streaming.score_stream import start_scoring

    base = os.path.join(checkpoint_dir(spark), f"score_stream_{uuid.uuid4().hex}")
    src, sink, ck = (os.path.join(base, p) for p in ("requests", "scored", "checkpoint"))
    S.requests(spark, sf).write.mode("overwrite").json(src)
    q = start_scoring(spark, src, sink, ck, ScoringModel.closed_form(), available_now=True)
    q.awaitTermination()
    return spark.read.parquet(sink).select("request_id", "sentiment", F.round("confidence", 6).alias("confidence"))


# lines that are cut off in the middle, so that they are no JSON
_CUT_OFF = "turn % 3 = 0 AND conv_id % 10 = 0"


@query("score_stream_tables", f"""
SELECT *, (SELECT count(*) FROM conversations WHERE {_CUT_OFF}) AS quarantined FROM ({_request_score_sql()})
WHERE request_id NOT IN (SELECT conv_id || '-' || turn FROM conversations WHERE {_CUT_OFF})""")
def q_score_stream_tables(spark, sf):
    """ST1 + S6: request lines, some of them cut off, streamed into tables with a ledger; one batch is replayed and one broke off
    before its commit, and both leave no trace."""
    from tonality.session import checkpoint_dir
    from tonality.streaming.score_stream import commit_batch, committed_rows, start_scoring_tables

    base = os.path.join(checkpoint_dir(spark), f"score_tables_{uuid.uuid4().hex}")
    src, tables, ck = (os.path.join(base, p) for p in ("lines", "tables", "checkpoint"))
    conv = F.split("request_id", "-")
    cut = (conv[1].cast("long") % 3 == 0) & (conv[0].cast("long") % 10 == 0)
    line = F.to_json(F.struct("request_id", "text", "emoji", "sticker"))
    S.requests(spark, sf).select(F.when(cut, F.substring(line, 1, 12)).otherwise(line).alias("value")).repartition(2).write.text(src)
    model = ScoringModel.closed_form()
    start_scoring_tables(spark, src, tables, ck, model, max_files_per_trigger=1).awaitTermination()
    lines = spark.read.text(src)
    commit_batch(lines, 0, tables, model)  # the replay
    broken = committed_rows(spark, tables).select("request_id", "predicted", "sentiment", "confidence")
    broken.write.parquet(f"{tables}/scored/run=scoring/batch_id=99")
    bad = committed_rows(spark, tables, "quarantine").agg(F.count(F.lit(1)).alias("quarantined"))
    return committed_rows(spark, tables).crossJoin(bad).select(  # a join with one row
        "request_id", "sentiment", F.round("confidence", 6).alias("confidence"), "quarantined")


from tonality.plans import catalog_io  # noqa: E402,F401  (sources, sinks and round trips)
