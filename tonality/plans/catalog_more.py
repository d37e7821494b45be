"""Queries of phases 3-5 (alignment, fusion, scoring, features, models); registered into ``catalog``."""

from __future__ import annotations

from pyspark.sql import functions as F

from tonality.functions import vectors as V
from tonality.operators import align, dist, fuse, metrics, split
from tonality.operators.model import ReluClassifier, score
from tonality.plans import sqlfrag as Q
from tonality.plans.catalog import query
from tonality.sources import tables as S

# ---------------------------------------------------------------- phase 3: alignment, fusion, scoring

_PAGE_VECTORS = Q.hashed_vectors("pv", "SELECT page_id, url FROM pages", "page_id", Q.page_words("url"), 16)
_TURN_VECTORS = Q.hashed_vectors("tv", "SELECT conv_id * 1000000000 + turn AS turn_id, text FROM conversations", "turn_id",
                                 Q.text_words("text"), 32)


@query("align_positional", f"""
WITH {_PAGE_VECTORS},
b AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS pos FROM embeddings),
o AS (SELECT k AS page_id, v AS s_vec, row_number() OVER (ORDER BY k) - 1 AS pos FROM pv),
j AS (SELECT b.vec_id, b.pos, o.page_id AS other_page_id,
             coalesce(o.s_vec, list_transform(range(16), lambda i: 0.0::DOUBLE)) AS v
      FROM b LEFT JOIN o ON b.pos = o.pos)
SELECT vec_id, pos, other_page_id, {Q.widen('v', 16)} FROM j""")
def q_align_positional(spark, sf):
    """Embedding rows paired by position with page vectors (zeros when pages run out,
    surplus pages dropped)."""
    from tonality.session import materialize
    base = S.vectors(spark, sf).select("vec_id")
    # the page vectors come from a Python (Arrow) pass, which column pruning cannot skip; the
    # quantile sketch and both index branches read them, so they are written once
    pages = materialize(S.page_vectors(spark, sf, 16), "page-vectors")
    j = align.align_positional(base, pages, "vec_id", "page_id", "s_vec", 16, out="v")
    return V.widen_vector(j, "v", 16, keep=["vec_id", "pos", "other_page_id"], digits=6)


def _modal_sql() -> str:
    return """
t AS (SELECT vec_id AS msg_id FROM embeddings),
eu AS (SELECT vec_id // 3 AS msg_id, unnest(range(32)) AS k, unnest(CAST(embedding AS DOUBLE[])[1:32]) AS v FROM embeddings),
ea AS (SELECT msg_id, k, avg(v) AS v FROM eu GROUP BY msg_id, k),
e AS (SELECT msg_id, list(v ORDER BY k) AS emoji_vec FROM ea GROUP BY msg_id),
en AS (SELECT vec_id // 3 AS msg_id, count(*) AS n_emoji FROM embeddings GROUP BY 1),
s AS (SELECT vec_id * 2 AS msg_id, CAST(embedding AS DOUBLE[])[33:48] AS sticker_vec FROM embeddings)"""


@query("align_keyed", f"""
WITH {_modal_sql()},
j AS (SELECT t.msg_id, coalesce(en.n_emoji, 0) AS n_emoji, e.emoji_vec, s.sticker_vec
      FROM t LEFT JOIN e ON t.msg_id = e.msg_id LEFT JOIN en ON t.msg_id = en.msg_id
      LEFT JOIN s ON t.msg_id = s.msg_id)
SELECT msg_id, n_emoji, sticker_vec IS NOT NULL AS has_sticker,
       {Q.widen('emoji_vec', 32, prefix='e_')}, {Q.widen('sticker_vec', 16, prefix='s_')} FROM j""")
def q_align_keyed(spark, sf):
    m = S.modality_frames(spark, sf)
    base = m["text"].select("msg_id")
    j = align.align_keyed(base, "msg_id", {"emoji": (m["emoji"], "msg_id", "emoji_vec"),
                                           "sticker": (m["sticker"], "msg_id", "sticker_vec")})
    j = j.select("msg_id", F.col("n_emoji").alias("n_emoji"), F.col("emoji").alias("emoji_vec"),
                 F.col("sticker").alias("sticker_vec"), F.col("sticker").isNotNull().alias("has_sticker"))
    e = V.widen_vector(j, "emoji_vec", 32, prefix="e_", keep=["msg_id", "n_emoji", "has_sticker", "sticker_vec"],
                       digits=6)
    return V.widen_vector(e, "sticker_vec", 16, prefix="s_", digits=6)


@query("zip_columns", f"""
WITH p AS (SELECT vec_id, {Q.softmax(Q.dvec('embedding'))} AS p FROM embeddings)
SELECT e.vec_id, e.label, {Q.widen('p.p', 64, prefix='p_')} FROM embeddings e JOIN p ON e.vec_id = p.vec_id""")
def q_zip_columns(spark, sf):
    v = S.vectors(spark, sf)
    probs = v.select("vec_id", V.softmax("embedding").alias("p"))
    z = align.zip_columns(v.select("vec_id", "label"), probs, key="vec_id")
    return V.widen_vector(z, "p", 64, prefix="p_", keep=["vec_id", "label"], digits=6)


@query("project_vector", f"""
WITH p AS (SELECT vec_id, {Q.project(Q.dvec('embedding'), 16, 64, 21)} AS v FROM embeddings)
SELECT vec_id, {Q.widen('v', 16)} FROM p""")
def q_project_vector(spark, sf):
    v = S.vectors(spark, sf).select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    p = fuse.project_vector(v, "x", fuse.closed_form_linear(16, 64, 21), out="v", keep=["vec_id"])
    return V.widen_vector(p, "v", 16, keep=["vec_id"], digits=6)


@query("gate", f"""
WITH p AS (SELECT vec_id, {Q.project(Q.dvec('embedding'), 1, 64, 22)}[1] AS z FROM embeddings)
SELECT vec_id, round({Q.sigmoid('z')}, 6) AS gate FROM p""")
def q_gate(spark, sf):
    v = S.vectors(spark, sf)
    g = fuse.gate_expr(F.col("embedding"), fuse.closed_form_linear(1, 64, 22))
    return v.select("vec_id", F.round(g, 6).alias("gate"))


def _fusion_input(spark, sf):
    v = S.vectors(spark, sf)
    x = F.col("embedding").cast("array<double>")
    return v.select("vec_id", x.alias("text_vec"),
                    F.when(F.col("label") % 3 != 1, F.slice(x, 1, 32)).alias("emoji_vec"),
                    F.when(F.col("label") % 3 == 2, F.slice(x, 33, 16)).alias("sticker_vec"))


_FUSION_INPUT_SQL = """x AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS xt,
                  CASE WHEN label % 3 <> 1 THEN CAST(embedding AS DOUBLE[])[1:32] END AS xe,
                  CASE WHEN label % 3 = 2 THEN CAST(embedding AS DOUBLE[])[33:48] END AS xs FROM embeddings)"""


def _fusion_sql(missing: str, inputs: str = _FUSION_INPUT_SQL) -> str:
    # closed-form parameters, salts 11..15 (FusionParams.closed_form(64, 32, 16))
    if missing == "mask":
        pe = f"CASE WHEN xe IS NULL THEN NULL ELSE {Q.project('xe', 64, 32, 12)} END"
        ps = f"CASE WHEN xs IS NULL THEN NULL ELSE {Q.project('xs', 64, 16, 13)} END"
    else:
        pe = Q.project("coalesce(xe, list_transform(range(32), lambda i: 0.0::DOUBLE))", 64, 32, 12)
        ps = Q.project("coalesce(xs, list_transform(range(16), lambda i: 0.0::DOUBLE))", 64, 16, 13)
    return f"""
WITH {inputs},
p AS (SELECT vec_id, {Q.project('xt', 64, 64, 11)} AS pt, {pe} AS pe, {ps} AS ps FROM x),
n AS (SELECT vec_id, pt, pe, ps,
             greatest(sqrt(list_sum(list_transform(pt, lambda u: u * u))), 1e-12) AS nt,
             greatest(sqrt(list_sum(list_transform(pe, lambda u: u * u))), 1e-12) AS ne,
             greatest(sqrt(list_sum(list_transform(ps, lambda u: u * u))), 1e-12) AS ns FROM p),
u AS (SELECT vec_id, list_transform(pt, lambda v: v / nt) AS t,
             coalesce(list_transform(pe, lambda v: v / ne), list_transform(range(64), lambda i: 0.0::DOUBLE)) AS e,
             coalesce(list_transform(ps, lambda v: v / ns), list_transform(range(64), lambda i: 0.0::DOUBLE)) AS s
      FROM n),
g AS (SELECT vec_id, t, e, s, {Q.sigmoid(Q.project('t', 1, 64, 14) + '[1]')} AS ge,
             {Q.sigmoid(Q.project('t', 1, 64, 15) + '[1]')} AS gs FROM u),
f AS (SELECT vec_id, list_transform(range(64), lambda k: t[k + 1] + ge * e[k + 1] + gs * s[k + 1]) AS fused FROM g)
SELECT vec_id, {Q.widen('fused', 64)} FROM f"""


@query("fuse_modalities", _fusion_sql("mask"))
def q_fuse_modalities(spark, sf):
    f = fuse.fuse_modalities(_fusion_input(spark, sf), fuse.FusionParams.closed_form(64, 32, 16), missing="mask", keep=["vec_id"])
    return V.widen_vector(f, "fused", 64, keep=["vec_id"], digits=6)


@query("fuse_modalities_zeros", _fusion_sql("zeros"))
def q_fuse_modalities_zeros(spark, sf):
    f = fuse.fuse_modalities(_fusion_input(spark, sf), fuse.FusionParams.closed_form(64, 32, 16), missing="zeros", keep=["vec_id"])
    return V.widen_vector(f, "fused", 64, keep=["vec_id"], digits=6)


_POSITIONAL_INPUT_SQL = f"""{_PAGE_VECTORS},
{_TURN_VECTORS},
b AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS xt, row_number() OVER (ORDER BY vec_id) - 1 AS pos FROM embeddings),
e AS (SELECT v AS xe, row_number() OVER (ORDER BY k) - 1 AS pos FROM tv),
s AS (SELECT v AS xs, row_number() OVER (ORDER BY k) - 1 AS pos FROM pv),
x AS (SELECT b.vec_id, b.xt, coalesce(e.xe, list_transform(range(32), lambda i: 0.0::DOUBLE)) AS xe,
             coalesce(s.xs, list_transform(range(16), lambda i: 0.0::DOUBLE)) AS xs
      FROM b LEFT JOIN e ON b.pos = e.pos LEFT JOIN s ON b.pos = s.pos)"""


@query("fusion_positional", _fusion_sql("zeros", _POSITIONAL_INPUT_SQL))
def q_fusion_positional(spark, sf):
    """The reference's fusion script: text rows (embeddings) paired by position with emoji
    vectors (conversation turns) and sticker vectors (pages), zero rows appended when a modality
    is shorter and surplus rows cut, then the gated fusion with zero inputs."""
    from tonality.session import materialize
    v = S.vectors(spark, sf)
    base = v.select("vec_id", F.col("embedding").cast("array<double>").alias("text_vec"))
    turns = materialize(S.turn_vectors(spark, sf, 32), "turn-vectors")
    pages = materialize(S.page_vectors(spark, sf, 16), "page-vectors")
    j = align.align_positional_many(base, "vec_id", {"emoji_vec": (turns, ["conv_id", "turn"], "e_vec", 32),
                                                     "sticker_vec": (pages, "page_id", "s_vec", 16)})
    j = j.select("vec_id", "text_vec", "emoji_vec", "sticker_vec")
    f = fuse.fuse_modalities(j, fuse.FusionParams.closed_form(64, 32, 16), missing="zeros", keep=["vec_id"])
    return V.widen_vector(f, "fused", 64, keep=["vec_id"], digits=6)


_SCORE_SQL = f"""
WITH h AS (SELECT vec_id, list_transform({Q.project(Q.dvec('embedding'), 128, 64, 1)}, lambda v: greatest(v, 0.0)) AS h
           FROM embeddings),
z AS (SELECT vec_id, {Q.project('h', 3, 128, 2)} AS z FROM h),
p AS (SELECT vec_id, z, {Q.softmax('z')} AS p FROM z)
SELECT vec_id, {Q.argmax('z')} AS predicted, {Q.label_name(Q.argmax('z'))} AS sentiment,
       round(list_max(p), 6) AS confidence FROM p"""


@query("score", _SCORE_SQL)
def q_score(spark, sf):
    v = S.vectors(spark, sf).select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    s = score(v, "x", ReluClassifier.closed_form(64, 128, 3, salt=1), keep=["vec_id"])
    return s.select("vec_id", "predicted", "sentiment", F.round("confidence", 6).alias("confidence"))


@query("weighted_log_loss", f"""
WITH x AS (SELECT vec_id, CAST(label % 3 AS INTEGER) AS y, {Q.softmax(Q.dvec('embedding'))} AS p,
                  CASE WHEN {Q.hash_unit('vec_id', 42)} < 0.2 THEN 'test' ELSE 'train' END AS split FROM embeddings),
w AS (SELECT y, 1.0 / CAST(count(*) AS DOUBLE) AS weight FROM x GROUP BY y)
SELECT split, round(sum(weight * -ln(greatest(p[y + 1], 1e-300))) / sum(weight), 6) AS log_loss, count(*) AS rows
FROM x JOIN w USING (y) GROUP BY split""")
def q_weighted_log_loss(spark, sf):
    v = S.vectors(spark, sf).select("vec_id", (F.col("label") % 3).cast("int").alias("y"),
                                    V.softmax("embedding").alias("p"))
    v = split.split_hash(v, "vec_id", (0.2, 0.8), ("test", "train"), 42)
    w = dist.class_weights(v, "y", scope="all")
    r = metrics.weighted_log_loss(dist.with_class_weight(v, w, "y"), "p", "y", "weight", by=["split"])
    return r.select("split", F.round("log_loss", 6).alias("log_loss"), "rows")


from tonality.plans import catalog_features  # noqa: E402,F401  (phase 4-6 queries)
