"""Queries of phases 4-6: features, category counts, models, batch and stream scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from tonality.functions import text as X
from tonality.functions import vectors as V
from tonality.operators import dist, split, tokens
from tonality.operators.encode import hash_embed
from tonality.plans import sqlfrag as Q
from tonality.plans.catalog import query
from tonality.sources import tables as S

# ---------------------------------------------------------------- shared stand-in: documents as word lists


def _docs(spark, sf):
    d = S.table(spark, sf, "documents").select("doc_id", X.words(X.clean_ascii("text"), 1).alias("tokens"))
    return split.split_hash(d, "doc_id", (0.2, 0.8), ("test", "train"), 42)


_DOCS_SQL = f"""
d AS (SELECT doc_id, list_filter(string_split({Q.clean_ascii('text')}, ' '), lambda w: length(w) >= 1) AS l,
             CASE WHEN {Q.hash_unit('doc_id', 42)} < 0.2 THEN 'test' ELSE 'train' END AS split FROM documents),
v AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS term_id
      FROM (SELECT DISTINCT unnest(l) AS term FROM d WHERE split = 'train') WHERE length(term) >= 2)"""


def _vocab(spark, sf):
    """Training documents and their fitted vocabulary. Both are used several times by each query (the
    vocabulary as lookup side, anti-join side, largest id), so the word lists and the vocabulary are
    written once as Parquet tables in the shared folder."""
    from tonality.session import materialize
    d = tokens.token_bundle(_docs(spark, sf))
    return d, materialize(tokens.fit_vocabulary(d.where(F.col("split") == "train"), "tokens", min_len=2), "vocabulary")


@query("fit_vocabulary", f"WITH {_DOCS_SQL} SELECT term, term_id FROM v")
def q_fit_vocabulary(spark, sf):
    return _vocab(spark, sf)[1]


@query("bag_of_words", f"""
WITH {_DOCS_SQL},
t AS (SELECT doc_id, unnest(l) AS term FROM d)
SELECT doc_id, term_id, count(*) AS count FROM t JOIN v USING (term) WHERE length(term) >= 2
GROUP BY doc_id, term_id""")
def q_bag_of_words(spark, sf):
    d, v = _vocab(spark, sf)
    return tokens.bag_of_words(d, "doc_id", "tokens", v, min_len=2)


@query("encode_tokens", f"""
WITH {_DOCS_SQL},
p AS (SELECT doc_id, unnest(l) AS term, unnest(range(len(l))) AS pos FROM d),
i AS (SELECT doc_id, pos, CAST(coalesce(v.term_id + {tokens.FIRST_WORD_ID}, {tokens.UNK_ID}) AS INTEGER) AS id
      FROM p LEFT JOIN v USING (term) WHERE pos < 62),
s AS (SELECT doc_id, list(id ORDER BY pos) AS ids FROM i GROUP BY doc_id),
f AS (SELECT d.doc_id, list_concat([{tokens.CLS_ID}], coalesce(s.ids, []), [{tokens.SEP_ID}]) AS seqall
      FROM d LEFT JOIN s ON d.doc_id = s.doc_id),
m AS (SELECT max(len(seqall)) AS target FROM f)
SELECT doc_id, array_to_string(list_concat(seqall, list_transform(range(target - len(seqall)), lambda k: {tokens.PAD_ID})), ',')
       AS input_ids, CAST(len(seqall) AS INTEGER) AS attention_len, CAST(target AS INTEGER) AS padded_len FROM f, m""")
def q_encode_tokens(spark, sf):
    d, v = _vocab(spark, sf)
    enc = tokens.encode_tokens(d, "doc_id", "tokens", v, max_len=64, pad="longest")
    return enc.select("doc_id", F.array_join(F.col("input_ids").cast("array<string>"), ",").alias("input_ids"),
                      F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).cast("int").alias("attention_len"),
                      F.size("input_ids").cast("int").alias("padded_len"))


@query("extend_vocabulary", f"""
WITH {_DOCS_SQL},
n AS (SELECT DISTINCT unnest(l) AS term FROM d WHERE split = 'test'),
a AS (SELECT term FROM n WHERE length(term) >= 1 AND term NOT IN (SELECT term FROM v)),
top AS (SELECT max(term_id) AS m FROM v)
SELECT term, term_id FROM v
UNION ALL SELECT term, row_number() OVER (ORDER BY term) + (SELECT m FROM top) AS term_id FROM a""")
def q_extend_vocabulary(spark, sf):
    d, v = _vocab(spark, sf)
    return tokens.extend_vocabulary(v, d.where(F.col("split") == "test"), "tokens", min_len=1)


@query("hash_embed", f"""
WITH d AS (SELECT doc_id, list_filter(string_split({Q.clean_ascii('text')}, ' '), lambda w: length(w) >= 1) AS l
           FROM documents),
t AS (SELECT doc_id, md5(unnest(l)) AS h FROM d),
s AS (SELECT doc_id, CAST(CAST(('0x' || substr(h, 1, 8)) AS BIGINT) % 16 AS INTEGER) AS slot,
             CASE WHEN CAST(('0x' || substr(h, 9, 1)) AS INTEGER) < 8 THEN 1.0 ELSE -1.0 END AS sg FROM t),
a AS (SELECT doc_id, slot, sum(sg) AS v FROM s GROUP BY 1, 2),
g AS (SELECT d.doc_id, r.slot FROM d, (SELECT unnest(range(16)) AS slot) r),
w AS (SELECT g.doc_id, list(CAST(coalesce(a.v, 0) AS DOUBLE) ORDER BY g.slot) AS raw
      FROM g LEFT JOIN a ON g.doc_id = a.doc_id AND g.slot = a.slot GROUP BY g.doc_id),
n AS (SELECT doc_id, raw, greatest(sqrt(list_sum(list_transform(raw, lambda u: u * u))), 1e-12) AS nr FROM w),
e AS (SELECT doc_id, list_transform(raw, lambda x: x / nr) AS e FROM n)
SELECT doc_id, {Q.widen('e', 16)} FROM e""")
def q_hash_embed(spark, sf):
    d = S.table(spark, sf, "documents").select("doc_id", X.words(X.clean_ascii("text"), 1).alias("tokens"))
    e = hash_embed(d, "tokens", dim=16, out="e", keep=["doc_id"])
    return V.widen_vector(e, "e", 16, keep=["doc_id"], digits=6)


@query("category_counts", f"""
SELECT category, count(*) AS count, CAST(GROUPING(category) AS INTEGER) AS is_total
FROM (SELECT nullif(regexp_extract(url, '{S.PAGE_CLASS_PATTERN}', 1), '') AS category FROM pages)
GROUP BY ROLLUP (category)""")
def q_category_counts(spark, sf):
    return dist.category_counts(S.page_files(spark, sf), "category", with_total=True)


@query("unique_tokens", f"""
WITH {_DOCS_SQL} SELECT DISTINCT unnest(l) AS term FROM d""")
def q_unique_tokens(spark, sf):
    return dist.unique_tokens(tokens.terms(_docs(spark, sf), "tokens"), "term")


# ---------------------------------------------------------------- the reference's preprocessing scripts

@query("text_preprocess", f"""
WITH l AS (SELECT review_id, verified_reviews AS original_review, {Q.normalize_text('verified_reviews')} AS comment_clean,
                  {Q.label_le2('rating')} AS label_numeric FROM ({Q.reviews()})),
o AS (SELECT *, row_number() OVER (PARTITION BY label_numeric ORDER BY {Q.hash_order('review_id', 42)}, review_id) AS rn,
             count(*) OVER (PARTITION BY label_numeric) AS cnt FROM l)
SELECT review_id, original_review, comment_clean, {Q.label_name('label_numeric')} AS sentiment_label, label_numeric,
       CASE WHEN rn <= ceil(CAST(0.2 AS DOUBLE) * cnt) THEN 'test' ELSE 'train' END AS split FROM o""")
def q_text_preprocess(spark, sf):
    from tonality.plans.pipelines import text_info
    return text_info(S.reviews(spark, sf)).select("review_id", "original_review", "comment_clean", "sentiment_label",
                                                  "label_numeric", "split")


@query("flagship_summary", f"""
WITH l AS (SELECT review_id, {Q.normalize_text('verified_reviews')} AS comment_clean,
                  {Q.label_le2('rating')} AS label_numeric FROM ({Q.reviews()})),
o AS (SELECT *, row_number() OVER (PARTITION BY label_numeric ORDER BY {Q.hash_order('review_id', 42)}, review_id) AS rn,
             count(*) OVER (PARTITION BY label_numeric) AS cnt FROM l),
s AS (SELECT *, CASE WHEN rn <= ceil(CAST(0.2 AS DOUBLE) * cnt) THEN 'test' ELSE 'train' END AS split FROM o)
SELECT split, label_numeric, {Q.label_name('label_numeric')} AS sentiment_label, count(*) AS rows,
       CAST(sum(length(comment_clean)) AS BIGINT) AS clean_chars
FROM s GROUP BY split, label_numeric""")
def q_flagship_summary(spark, sf):
    """``entry()``'s chain on any scale factor: clean -> label -> stratified split -> rows per (split, class)."""
    from tonality.plans.pipelines import text_preprocess_summary
    return text_preprocess_summary(spark, sf)


@query("emoji_preprocess", f"""
WITH lex AS ({Q.emoji_lexicon()}),
n AS (SELECT CAST(r_regionkey AS VARCHAR) AS symbol, min(':' || replace(lower(r_name), ' ', '_') || ':') AS name
      FROM region GROUP BY 1),
l AS (SELECT Emoji AS emoji, {Q.strip_ws('coalesce(n.name, lex.Emoji)')} AS emoji_clean,
             CAST(CASE WHEN Negative >= Neutral AND Negative >= Positive THEN 0
                       WHEN Neutral >= Positive THEN 1 ELSE 2 END AS INTEGER) AS label_numeric
      FROM lex LEFT JOIN n ON lex.Emoji = n.symbol),
o AS (SELECT *, row_number() OVER (PARTITION BY label_numeric ORDER BY {Q.hash_order('emoji', 42)}, emoji) AS rn,
             count(*) OVER (PARTITION BY label_numeric) AS cnt FROM l)
SELECT emoji, emoji_clean, {Q.label_name('label_numeric')} AS sentiment_label, label_numeric,
       CASE WHEN rn <= ceil(CAST(0.2 AS DOUBLE) * cnt) THEN 'test' ELSE 'train' END AS split FROM o""")
def q_emoji_preprocess(spark, sf):
    from tonality.plans.pipelines import emoji_info
    info = emoji_info(S.emoji_lexicon(spark, sf), S.symbol_names(spark, sf))
    return info.select("emoji", "emoji_clean", "sentiment_label", "label_numeric", "split")


from tonality.plans import catalog_models  # noqa: E402,F401  (rows-only model and stream queries)


_TEXT_SALT = 41


@query("text_model_registry", f"""
WITH {_DOCS_SQL},
t AS (SELECT doc_id, unnest(l) AS term FROM d),
s AS (SELECT doc_id, {', '.join(f"sum({Q.weight(str(c), 'term_id', _TEXT_SALT)} / 100.0) AS s{c}" for c in range(3))}
      FROM t JOIN v USING (term) WHERE length(term) >= 2 GROUP BY doc_id),
z AS (SELECT d.doc_id, [{', '.join(f"coalesce(s{c}, 0.0::DOUBLE) + {Q.bias(str(c), _TEXT_SALT)}" for c in range(3))}] AS z
      FROM d LEFT JOIN s ON d.doc_id = s.doc_id),
p AS (SELECT doc_id, {Q.softmax('z')} AS p FROM z)
SELECT doc_id, {Q.widen('p', 3, prefix='prob_')}, {Q.argmax('p')} AS predicted, {Q.label_name(Q.argmax('p'))} AS sentiment FROM p""")
def q_text_model_registry(spark, sf):
    """S11 for the text model: two text models with a term table of the training documents stored in a registry, the one
    with the smaller loss loaded, all documents scored with it."""
    import uuid

    from tonality.functions import labels as L
    from tonality.operators.fuse import closed_form_bias
    from tonality.operators.model import TextBaseline
    from tonality.operators.text_model import class_probabilities
    from tonality.plans import registry
    from tonality.session import scratch_path
    d, vocabulary = _vocab(spark, sf)
    rule = [(((F.lit(31 * c + _TEXT_SALT) + F.col("term_id") * 17) % 101 - 50).cast("double") / 100.0 / 100.0).alias(f"w{c}") for c in range(3)]
    bias = [float(closed_form_bias(c, _TEXT_SALT)) for c in range(3)]
    path = scratch_path(spark, f"round-trips/text-models-{uuid.uuid4().hex}")
    zero = vocabulary.select("term_id", *[F.lit(0.0).alias(f"w{c}") for c in range(3)])
    registry.register(spark, path, "by-rule", TextBaseline(vocabulary, vocabulary.select("term_id", *rule), bias, [(0, 1.0)]), {"loss": 1.0})
    registry.register(spark, path, "zero", TextBaseline(vocabulary, zero, [0.0] * 3, [(0, 1.1)]), {"loss": 1.1})
    out = class_probabilities(registry.load_text(spark, path, "loss"), d, "doc_id", "tokens")
    wide = V.widen_vector(out, "probs", 3, prefix="prob_", keep=["doc_id", "predicted"], digits=6)
    return wide.withColumn("sentiment", L.label_name("predicted"))
