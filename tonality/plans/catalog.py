"""The query catalog: one Spark plan per operator over the driver tables, plus its DuckDB oracle.

Every query reads the given tables (or frames Spark derives from them), runs over all rows and
aliases every output column so that the Spark result and the oracle result share names.
Vectors leave a query widened to ``emb_i`` columns rounded to 6 digits (the CSV sink shape),
and token arrays as comma-joined text, so results compare as plain values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonality.functions import labels as L
from tonality.functions import text as X
from tonality.functions import vectors as V
from tonality.operators import dist, metrics, rank, split
from tonality.plans import sqlfrag as Q
from tonality.sources import tables as S

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# ---------------------------------------------------------------- phase 1: clean, label, count

@query("normalize_text", f"""
SELECT review_id, {Q.normalize_text('verified_reviews')} AS comment_clean,
       verified_reviews IS NULL AS is_missing
FROM ({Q.reviews()})""")
def q_normalize_text(spark, sf):
    r = S.reviews(spark, sf)
    return r.select("review_id", X.normalize_text("verified_reviews").alias("comment_clean"),
                    X.is_missing("verified_reviews").alias("is_missing"))


@query("clean_ascii", f"""
SELECT review_id, {Q.clean_ascii('verified_reviews')} AS cleaned_text FROM ({Q.reviews()})""")
def q_clean_ascii(spark, sf):
    r = S.reviews(spark, sf)
    return r.select("review_id", X.clean_ascii("verified_reviews").alias("cleaned_text"))


@query("label_rating_le2", f"""
SELECT review_id, rating, {Q.label_le2('rating')} AS label_numeric,
       {Q.label_name(Q.label_le2('rating'))} AS sentiment_label
FROM ({Q.order_ratings()})""")
def q_label_le2(spark, sf):
    r = S.order_ratings(spark, sf).withColumn("label_numeric", L.label_rating("rating", "le2"))
    return r.select("review_id", "rating", "label_numeric", L.label_name("label_numeric").alias("sentiment_label"))


@query("label_rating_ge4", f"""
SELECT review_id, rating, {Q.label_ge4('rating')} AS label_numeric,
       {Q.label_name(Q.label_ge4('rating'))} AS sentiment
FROM ({Q.order_ratings()})""")
def q_label_ge4(spark, sf):
    r = S.order_ratings(spark, sf).withColumn("label_numeric", L.label_rating("rating", "ge4"))
    return r.select("review_id", "rating", "label_numeric", L.label_name("label_numeric").alias("sentiment"))


@query("label_name", f"""
SELECT vec_id, label, {Q.label_name('label')} AS label_name,
       CAST(CASE {Q.label_name('label')} WHEN 'negative' THEN 0 WHEN 'neutral' THEN 1
            WHEN 'positive' THEN 2 END AS INTEGER) AS label_code
FROM embeddings""")
def q_label_name(spark, sf):
    v = S.vectors(spark, sf).withColumn("label_name", L.label_name("label"))
    return v.select("vec_id", "label", "label_name", L.label_code("label_name").alias("label_code"))


@query("class_distribution", f"""
SELECT {Q.label_le2('rating')} AS label_numeric, count(*) AS count
FROM ({Q.order_ratings()}) GROUP BY 1""")
def q_class_distribution(spark, sf):
    r = S.order_ratings(spark, sf).select(L.label_rating("rating", "le2").alias("label_numeric"))
    return dist.class_distribution(r, "label_numeric")


@query("class_distribution_dense", """
WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label),
g AS (SELECT CAST(unnest(range(0, (SELECT max(label) FROM c) + 1)) AS INTEGER) AS label)
SELECT g.label, CAST(coalesce(c.n, 0) AS BIGINT) AS count FROM g LEFT JOIN c ON g.label = c.label""")
def q_class_distribution_dense(spark, sf):
    return dist.class_distribution(S.vectors(spark, sf), "label", dense=True)


@query("distinct_labels", "SELECT DISTINCT label FROM embeddings WHERE label IS NOT NULL")
def q_distinct_labels(spark, sf):
    return dist.distinct_labels(S.vectors(spark, sf), "label")


@query("dataset_profile", """
SELECT count(*) AS rows, CAST(3 AS BIGINT) AS columns, CAST(max(len(embedding)) AS BIGINT) AS embedding_dim
FROM embeddings""")
def q_dataset_profile(spark, sf):
    return dist.dataset_profile(S.vectors(spark, sf), ("embedding",))


# ---------------------------------------------------------------- phase 2: lexicon, ranks, metrics, splits

@query("demojize", f"""
SELECT n_nationkey AS symbol_id, CAST(n_nationkey AS VARCHAR) AS symbol,
       {Q.strip_ws("coalesce(':' || replace(lower(r_name), ' ', '_') || ':', CAST(n_nationkey AS VARCHAR))")} AS symbol_clean
FROM nation LEFT JOIN region ON CAST(n_nationkey AS VARCHAR) = CAST(r_regionkey AS VARCHAR)""")
def q_demojize(spark, sf):
    from tonality.operators.lookup import demojize
    return demojize(S.symbols(spark, sf), "symbol", S.symbol_names(spark, sf), out="symbol_clean")


@query("label_majority", f"""
SELECT Emoji, CAST(CASE WHEN Negative >= Neutral AND Negative >= Positive THEN 0
                        WHEN Neutral >= Positive THEN 1 ELSE 2 END AS INTEGER) AS label_numeric
FROM ({Q.emoji_lexicon()})""")
def q_label_majority(spark, sf):
    lex = S.emoji_lexicon(spark, sf)
    return lex.select("Emoji", L.label_majority("Negative", "Neutral", "Positive").alias("label_numeric"))


@query("sentiment_score", f"""
SELECT Emoji, CAST(Positive - Negative AS DOUBLE) / nullif(CAST(Occurrences AS DOUBLE), 0) AS sentiment_score,
       Occurrences FROM ({Q.emoji_lexicon()})""")
def q_sentiment_score(spark, sf):
    lex = S.emoji_lexicon(spark, sf)
    return lex.select("Emoji", L.sentiment_score("Positive", "Negative", "Occurrences").alias("sentiment_score"),
                      "Occurrences")


@query("min_occurrences", f"""
SELECT Emoji, Occurrences FROM ({Q.emoji_lexicon()}) WHERE Occurrences >= 25""")
def q_min_occurrences(spark, sf):
    from tonality.operators.lookup import min_occurrences
    return min_occurrences(S.emoji_lexicon(spark, sf), 25).select("Emoji", "Occurrences")


def _scored_lexicon(spark, sf, n=25):
    from tonality.operators.lookup import min_occurrences
    lex = min_occurrences(S.emoji_lexicon(spark, sf), n)
    return lex.select("Emoji", L.sentiment_score("Positive", "Negative", "Occurrences").alias("sentiment_score"),
                      "Occurrences")


_SCORED_SQL = f"""
SELECT Emoji, CAST(Positive - Negative AS DOUBLE) / nullif(CAST(Occurrences AS DOUBLE), 0) AS sentiment_score,
       Occurrences FROM ({Q.emoji_lexicon()}) WHERE Occurrences >= 25"""


@query("top_k_best", f"""
SELECT * FROM ({_SCORED_SQL}) ORDER BY sentiment_score DESC NULLS LAST, Occurrences DESC, Emoji LIMIT 10""")
def q_top_k_best(spark, sf):
    return rank.top_k(_scored_lexicon(spark, sf), ["sentiment_score", "Occurrences"], 10, ascending=False,
                      tie_break=["Emoji"])


@query("top_k_worst", f"""
SELECT * FROM ({_SCORED_SQL}) ORDER BY sentiment_score ASC NULLS LAST, Occurrences DESC, Emoji LIMIT 10""")
def q_top_k_worst(spark, sf):
    return rank.top_k(_scored_lexicon(spark, sf), ["sentiment_score", "Occurrences"], 10, ascending=[True, False],
                      tie_break=["Emoji"])


_SPLIT_REVIEWS_SQL = f"""
WITH l AS (SELECT review_id, {Q.label_le2('rating')} AS label_numeric FROM ({Q.reviews()})),
o AS (SELECT review_id, label_numeric,
             row_number() OVER (PARTITION BY label_numeric ORDER BY {Q.hash_order('review_id', 42)}, review_id) AS rn,
             count(*) OVER (PARTITION BY label_numeric) AS cnt FROM l)
SELECT review_id, label_numeric,
       CASE WHEN rn <= ceil(CAST(0.2 AS DOUBLE) * cnt) THEN 'test' ELSE 'train' END AS split FROM o"""


def _split_reviews(spark, sf):
    r = S.reviews(spark, sf).select("review_id", L.label_rating("rating", "le2").alias("label_numeric"))
    return split.split_stratified(r, "review_id", "label_numeric", fractions=(0.2, 0.8), names=("test", "train"),
                                  seed=42)


@query("split_stratified", _SPLIT_REVIEWS_SQL)
def q_split_stratified(spark, sf):
    return _split_reviews(spark, sf)


@query("class_weights", f"""
SELECT label_numeric, count(*) AS count, 1.0 / CAST(count(*) AS DOUBLE) AS weight
FROM ({_SPLIT_REVIEWS_SQL}) WHERE split = 'train' GROUP BY label_numeric""")
def q_class_weights(spark, sf):
    return dist.class_weights(_split_reviews(spark, sf), "label_numeric", split_col="split", scope="train")


@query("with_class_weight", """
WITH w AS (SELECT label, 1.0 / CAST(count(*) AS DOUBLE) AS weight FROM embeddings GROUP BY label)
SELECT e.vec_id, e.label, w.weight FROM embeddings e JOIN w ON e.label = w.label""")
def q_with_class_weight(spark, sf):
    v = S.vectors(spark, sf).select("vec_id", "label")
    w = dist.class_weights(v, "label", scope="all")
    return dist.with_class_weight(v, w, "label").select("vec_id", "label", "weight")


@query("split_exact_80_20", f"""
WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY {Q.hash_order('doc_id', 42)}, doc_id) AS rn,
                  count(*) OVER () AS cnt FROM documents)
SELECT doc_id, CASE WHEN rn <= ceil(CAST(0.2 AS DOUBLE) * cnt) THEN 'test' ELSE 'train' END AS split FROM o""")
def q_split_exact_80_20(spark, sf):
    d = S.table(spark, sf, "documents").select("doc_id")
    return split.split_exact(d, "doc_id", (0.2, 0.8), ("test", "train"), seed=42, rounding="ceil")


_SPLIT_703_SQL = f"""
WITH o AS (SELECT vec_id, label, row_number() OVER (ORDER BY {Q.hash_order('vec_id', 7)}, vec_id) AS rn,
                  count(*) OVER () AS cnt FROM embeddings)
SELECT vec_id, label, CASE WHEN rn <= floor(CAST(0.7 AS DOUBLE) * cnt) THEN 'train'
            WHEN rn <= floor(CAST(0.7 AS DOUBLE) * cnt) + floor(CAST(0.15 AS DOUBLE) * cnt) THEN 'val'
            ELSE 'test' END AS split FROM o"""


def _split_vectors(spark, sf, cols=("vec_id", "label")):
    v = S.vectors(spark, sf).select(*cols)
    return split.split_exact(v, "vec_id", (0.7, 0.15, 0.15), ("train", "val", "test"), seed=7, rounding="floor")


@query("split_exact_70_15_15", _SPLIT_703_SQL)
def q_split_exact_70_15_15(spark, sf):
    return _split_vectors(spark, sf)


@query("split_hash", f"""
SELECT doc_id, CASE WHEN {Q.hash_unit('doc_id', 42)} < 0.2 THEN 'test' ELSE 'train' END AS split FROM documents""")
def q_split_hash(spark, sf):
    return split.split_hash(S.table(spark, sf, "documents").select("doc_id"), "doc_id", (0.2, 0.8), ("test", "train"), 42)


@query("stack_splits", f"""
SELECT vec_id, label, 'train' AS split FROM embeddings WHERE {Q.hash_unit('vec_id', 42)} >= 0.2
UNION ALL
SELECT vec_id, label, 'test' AS split FROM embeddings WHERE {Q.hash_unit('vec_id', 42)} < 0.2""")
def q_stack_splits(spark, sf):
    v = S.vectors(spark, sf).select("vec_id", "label")
    u = split.hash_unit("vec_id", 42)
    return split.stack_splits({"train": v.where(u >= 0.2), "test": v.where(u < 0.2)})


@query("confusion_matrix", f"""
WITH tp AS ({Q.truth_prediction()}),
g AS (SELECT CAST(t AS INTEGER) AS truth, CAST(p AS INTEGER) AS prediction
      FROM (SELECT unnest([0, 1, 2]) AS t) a, (SELECT unnest([0, 1, 2]) AS p) b),
c AS (SELECT truth, prediction, count(*) AS n FROM tp GROUP BY 1, 2)
SELECT g.truth, g.prediction, CAST(coalesce(c.n, 0) AS BIGINT) AS count
FROM g LEFT JOIN c ON g.truth = c.truth AND g.prediction = c.prediction""")
def q_confusion_matrix(spark, sf):
    return metrics.confusion_matrix(S.truth_prediction(spark, sf), "truth", "prediction")


_REPORT_SQL = f"""
WITH tp AS ({Q.truth_prediction()}),
lab AS (SELECT * FROM (VALUES (0, 'negative'), (1, 'neutral'), (2, 'positive')) v(label, class)),
s AS (SELECT truth AS label, count(*) AS support FROM tp GROUP BY 1),
q AS (SELECT prediction AS label, count(*) AS predicted FROM tp GROUP BY 1),
t AS (SELECT truth AS label, count(*) AS tp FROM tp WHERE truth = prediction GROUP BY 1),
pc AS (SELECT lab.label, lab.class, CAST(coalesce(support, 0) AS DOUBLE) AS support,
              CAST(coalesce(predicted, 0) AS DOUBLE) AS predicted, CAST(coalesce(tp, 0) AS DOUBLE) AS tp
       FROM lab LEFT JOIN s USING (label) LEFT JOIN q USING (label) LEFT JOIN t USING (label)),
pr AS (SELECT *, coalesce(tp / nullif(predicted, 0), 0) AS precision, coalesce(tp / nullif(support, 0), 0) AS recall FROM pc),
f AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM pr)
SELECT class, precision, recall, f1, support FROM f
UNION ALL SELECT 'accuracy', NULL, NULL, coalesce(sum(tp) / nullif(sum(support), 0), 0), sum(support) FROM f
UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM f
UNION ALL SELECT 'weighted avg', coalesce(sum(precision * support) / nullif(sum(support), 0), 0),
                 coalesce(sum(recall * support) / nullif(sum(support), 0), 0),
                 coalesce(sum(f1 * support) / nullif(sum(support), 0), 0), sum(support) FROM f"""


@query("classification_report", _REPORT_SQL)
def q_classification_report(spark, sf):
    return metrics.classification_report(S.truth_prediction(spark, sf), "truth", "prediction")


@query("f1_scores", f"""
WITH tp AS ({Q.truth_prediction()}),
lab AS (SELECT truth AS label FROM tp UNION SELECT prediction FROM tp),
s AS (SELECT truth AS label, count(*) AS support FROM tp GROUP BY 1),
q AS (SELECT prediction AS label, count(*) AS predicted FROM tp GROUP BY 1),
t AS (SELECT truth AS label, count(*) AS tp FROM tp WHERE truth = prediction GROUP BY 1),
j AS (SELECT CAST(coalesce(support, 0) AS DOUBLE) AS s, CAST(coalesce(predicted, 0) AS DOUBLE) AS q,
             CAST(coalesce(tp, 0) AS DOUBLE) AS t
      FROM lab LEFT JOIN s USING (label) LEFT JOIN q USING (label) LEFT JOIN t USING (label)),
f AS (SELECT *, coalesce(2 * t / nullif(s + q, 0), 0) AS f1 FROM j)
SELECT avg(f1) AS f1_macro, coalesce(sum(f1 * s) / nullif(sum(s), 0), 0) AS f1_weighted,
       coalesce(sum(t) / nullif(sum(s), 0), 0) AS accuracy FROM f""")
def q_f1_scores(spark, sf):
    return metrics.f1_scores(S.truth_prediction(spark, sf), "truth", "prediction")


@query("argmax", f"""
SELECT vec_id, {Q.argmax(Q.dvec('embedding'))} AS predicted FROM embeddings""")
def q_argmax(spark, sf):
    v = S.vectors(spark, sf)
    return v.select("vec_id", V.argmax("embedding").alias("predicted"))


@query("widen_vector", f"""SELECT vec_id, label, {Q.widen(Q.dvec('embedding'), 64)} FROM embeddings""")
def q_widen_vector(spark, sf):
    return V.widen_vector(S.vectors(spark, sf), "embedding", 64, keep=["vec_id", "label"], digits=6)


@query("softmax", f"""
WITH s AS (SELECT vec_id, {Q.softmax(Q.dvec('embedding'))} AS p FROM embeddings)
SELECT vec_id, {Q.widen('p', 64, prefix='p_')} FROM s""")
def q_softmax(spark, sf):
    v = S.vectors(spark, sf).select("vec_id", V.softmax("embedding").alias("p"))
    return V.widen_vector(v, "p", 64, prefix="p_", keep=["vec_id"], digits=6)


@query("l2_normalize", f"""
WITH s AS (SELECT vec_id, {Q.l2norm(Q.dvec('embedding'))} AS v FROM embeddings)
SELECT vec_id, {Q.widen('v', 64)} FROM s""")
def q_l2_normalize(spark, sf):
    v = S.vectors(spark, sf).select("vec_id", V.l2_normalize("embedding").alias("v"))
    return V.widen_vector(v, "v", 64, keep=["vec_id"], digits=6)


def queries() -> dict[str, QueryFn]:
    from tonality.plans import catalog_more  # noqa: F401  (registers the remaining queries)
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from tonality.plans import catalog_more  # noqa: F401
    return dict(ORACLE)
