"""Queries of the sources and sinks: each writes tables of the library to the shared checkpoint
folder with a sink and reads them back with a source, so the oracle sees what went through both."""

from __future__ import annotations

import os
import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonality.functions import labels as L
from tonality.functions import text as X
from tonality.functions import vectors as V
from tonality.operators import fuse, metrics, rank
from tonality.operators.encode import encode_batch, hash_embed, normalize_images
from tonality.operators.model import linear_head
from tonality.plans import pipelines
from tonality.plans import sqlfrag as Q
from tonality.plans.catalog import _SCORED_SQL, _SPLIT_703_SQL, _split_vectors, query
from tonality.plans.catalog_features import _docs
from tonality.plans.catalog_models import _request_score_sql, _score_sql
from tonality.plans.scoring import ScoringModel, load_scoring_model, save_scoring_model, score_messages, score_table
from tonality.sources import files, images, jdbc
from tonality.sources import tables as S


def _folder(spark, name: str) -> str:
    from tonality.session import scratch_path
    return scratch_path(spark, os.path.join("round-trips", f"{name}-{uuid.uuid4().hex}"))


# ---------------------------------------------------------------- CSV, bundles, tables, models

@query("read_reviews", Q.reviews())
def q_read_reviews(spark, sf):
    """S1 + S7: reviews with their line breaks and quotes through a CSV file."""
    path = _folder(spark, "reviews")
    files.write_csv(S.reviews(spark, sf), path)
    return files.read_reviews(spark, path)


@query("read_lexicon", Q.emoji_lexicon())
def q_read_lexicon(spark, sf):
    """S2 + S7."""
    path = _folder(spark, "lexicon")
    files.write_csv(S.emoji_lexicon(spark, sf), path)
    return files.read_lexicon(spark, path)


@query("bundle_round_trip", f"""
WITH s AS ({_SPLIT_703_SQL})
SELECT s.vec_id, s.label, s.split, {Q.widen(Q.dvec('e.embedding'), 64)} FROM s JOIN embeddings e USING (vec_id)
WHERE s.split = 'test'""")
def q_bundle(spark, sf):
    """All splits written as one bundle, one of them read back."""
    path = _folder(spark, "bundle")
    files.write_bundle(_split_vectors(spark, sf, ("vec_id", "label", "embedding")), path)
    test = files.read_bundle(spark, path, "test")
    return V.widen_vector(test, "embedding", 64, keep=["vec_id", "label", "split"], digits=6)


@query("saved_model_score", _request_score_sql())
def q_saved_model(spark, sf):
    """S11 + M6: the whole scoring model saved, loaded and applied to requests with all modalities."""
    path = _folder(spark, "model")
    save_scoring_model(spark, ScoringModel.closed_form(), path)
    out = score_messages(S.requests(spark, sf), load_scoring_model(spark, path), "request_id")
    return out.select("request_id", "sentiment", F.round("confidence", 6).alias("confidence"))


@query("comments_to_sentiments", _score_sql("SELECT doc_id AS id, text FROM documents", "id"))
def q_comments(spark, sf):
    """S5 + M6 + S6: a comments table of the catalog, scored into a sentiments table."""
    name = f"tonality_{uuid.uuid4().hex}"
    comments = S.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("comment_text"))
    comments.createOrReplaceTempView(f"{name}_comments")
    scored = score_table(jdbc.read_comments(spark, f"{name}_comments"), ScoringModel.closed_form())
    jdbc.write_sentiments(scored.select("id", "sentiment", F.round("confidence", 6).alias("confidence")), f"{name}_sentiments")
    return spark.table(f"{name}_sentiments")


_RECORD_SQL = f"""
WITH tp AS ({Q.truth_prediction()}),
lab AS (SELECT truth AS label FROM tp UNION SELECT prediction FROM tp),
j AS (SELECT label, (SELECT count(*) FROM tp WHERE truth = label) AS s, (SELECT count(*) FROM tp WHERE prediction = label) AS q,
             (SELECT count(*) FROM tp WHERE truth = label AND prediction = label) AS t FROM lab),
f AS (SELECT *, coalesce(2.0 * t / nullif(s + q, 0), 0) AS f1 FROM j)
SELECT 'run' AS run_id, round(sum(f1 * s) / sum(s), 9) AS f1_weighted, round(avg(f1), 9) AS f1_macro,
       round(CAST(sum(t) AS DOUBLE) / sum(s), 9) AS accuracy,
       {', '.join(f"CAST((SELECT count(*) FROM tp WHERE truth = {t} AND prediction = {p}) AS BIGINT) AS c{t}{p}" for t in range(3) for p in range(3))},
       {', '.join(f"round((SELECT f1 FROM f WHERE label = {c}), 9) AS f1_{n}" for c, n in enumerate(L.CLASS_NAMES))},
       2.0::DOUBLE AS w0 FROM f"""


@query("evaluation_record", _RECORD_SQL)
def q_evaluation_record(spark, sf):
    """A8 + S7: the evaluation record written as CSV (nested columns as JSON text) and read back."""
    path = _folder(spark, "record")
    record = metrics.evaluation_record(S.truth_prediction(spark, sf), "run", weights=[2.0, 3.0, 1.0])
    files.write_csv(metrics.csv_record(record), path)
    back = metrics.read_csv_record(spark.read.option("header", True).option("escape", '"').csv(path))
    cells = [F.col("confusion_matrix")[t][p].alias(f"c{t}{p}") for t in range(3) for p in range(3)]
    per = [F.round(F.col("per_class_metrics")[n]["f1"], 9).alias(f"f1_{n}") for n in L.CLASS_NAMES]
    return metrics.latest_record(back).select("run_id", *[F.round(c, 9).alias(c) for c in ("f1_weighted", "f1_macro", "accuracy")],
                                              *cells, *per, F.col("weights_used")[0].alias("w0"))


# ---------------------------------------------------------------- projections and small functions

@query("preview", "SELECT review_id, verified_reviews, rating FROM (" + Q.reviews() + ") ORDER BY review_id LIMIT 5")
def q_preview(spark, sf):
    """The first five rows."""
    return rank.preview(S.reviews(spark, sf), ["review_id"], 5)


@query("run_stamp", "SELECT event_id, strftime(ts, '%Y%m%d_%H%M%S') AS stamp FROM events")
def q_run_stamp(spark, sf):
    """P13 / f12: the stamp of each event."""
    return S.table(spark, sf, "events").select("event_id", X.run_stamp("ts").alias("stamp"))


@query("folder_code", f"""
SELECT page_id, CAST(coalesce(list_position(['de', 'en', 'fr'], regexp_extract(url, '{S.PAGE_CLASS_PATTERN}', 1)), 0) - 1 AS INTEGER) AS code
FROM pages""")
def q_folder_code(spark, sf):
    """The place of a page's folder in a class list; -1 for a folder that is not listed."""
    pages = S.page_files(spark, sf)
    return pages.select("page_id", F.coalesce(L.class_label_index("category", ["de", "en", "fr"]), F.lit(-1)).alias("code"))


@query("suffix_test", "SELECT page_id, lower(url) LIKE '%#top' OR lower(url) LIKE '%/' AS matches FROM pages")
def q_suffix(spark, sf):
    """P10 / f9."""
    return S.page_files(spark, sf).select("page_id", X.has_suffix("path", ["#TOP", "/"]).alias("matches"))


# ---------------------------------------------------------------- encoders

def _text_shape():
    """An encoder in the form of the extension point: two numbers for each text."""
    return lambda batch: np.array([[len(t or ""), (t or "").count("e")] for t in batch], dtype=float).reshape(len(batch), 2)


@query("encode_batch", "SELECT doc_id, CAST(length(text) AS DOUBLE) AS n_chars, CAST(length(text) - length(replace(text, 'e', '')) AS DOUBLE) AS n_e FROM documents")
def q_encode_batch(spark, sf):
    """The extension point with an encoder of its own."""
    docs = S.table(spark, sf, "documents").select("doc_id", "text")
    out = encode_batch(docs, "text", _text_shape, 2, out="v")
    return out.select("doc_id", F.col("v")[0].alias("n_chars"), F.col("v")[1].alias("n_e"))


_WORDS_SQL = f"list_filter(string_split({Q.clean_ascii('text')}, ' '), lambda w: length(w) >= 1)"


@query("extraction_outputs", f"""
WITH {Q.hashed_vectors('hv', 'SELECT doc_id, text FROM documents', 'doc_id', _WORDS_SQL, 16)},
z AS (SELECT k AS doc_id, v, {Q.project('v', 3, 16, 31)} AS z FROM hv),
p AS (SELECT doc_id, v, {Q.softmax('z')} AS p, {Q.argmax('z')} AS code FROM z)
SELECT p.doc_id, CASE WHEN {Q.hash_unit('p.doc_id', 42)} < 0.2 THEN 'test' ELSE 'train' END AS split,
       {Q.widen('v', 16)}, {Q.widen('p', 3, prefix='prob_')}, code AS predicted, {Q.label_name('code')} AS predicted_label,
       CAST(p.doc_id % 3 AS INTEGER) AS label FROM p""")
def q_extraction(spark, sf):
    """Vectors, class probabilities, code and name of the head, train and test stacked and widened."""
    d = hash_embed(_docs(spark, sf), "tokens", dim=16, out="v", keep=["doc_id", "split"])
    d = linear_head(d, "v", fuse.closed_form_linear(3, 16, 31))
    d = d.withColumns({"predicted_label": L.label_name("predicted"), "label": (F.col("doc_id") % 3).cast("int")})
    keep = ["doc_id", "split", "probs", "predicted", "predicted_label", "label"]
    wide = V.widen_vector(d, "v", 16, keep=keep, digits=6)
    return V.widen_vector(wide, "probs", 3, prefix="prob_", digits=6)


_SIDE = 6


def _pixel_sql(channel: int) -> str:
    """Position-weighted sum of one RGB channel of a 4 x 4 BGR image resized to 6 x 6 by pixel centres."""
    at = f"((2 * (i // {_SIDE}) + 1) * 4 // {2 * _SIDE}) * 4 + (2 * (i % {_SIDE}) + 1) * 4 // {2 * _SIDE}"
    return (f"CAST(list_sum(list_transform(range({_SIDE * _SIDE}), lambda i: (i + 1) * CAST(('0x' || substr(h, "
            f"CAST((({at}) * 3 + {2 - channel}) * 2 + 1 AS BIGINT), 2)) AS BIGINT))) AS BIGINT)")


@query("normalize_images", f"""
WITH b AS (SELECT page_id, sha256(url) || md5(url) AS h FROM pages)
SELECT page_id, {', '.join(f'{_pixel_sql(c)} AS {n}' for c, n in enumerate(('red', 'green', 'blue')))} FROM b""")
def q_normalize_images(spark, sf):
    """a 4 x 4 image from the hash of each page's address, resized and normalised."""
    pages = S.table(spark, sf, "pages").select("page_id", F.unhex(F.concat(F.sha2("url", 256), F.md5("url"))).alias("data"))
    image = F.struct(F.lit("").alias("origin"), F.lit(4).alias("height"), F.lit(4).alias("width"), F.lit(3).alias("nChannels"),
                     F.lit(16).alias("mode"), F.col("data"))
    out = normalize_images(pages.select("page_id", image.alias("image")), size=_SIDE)
    n = _SIDE * _SIDE
    sums = [F.aggregate(F.transform(F.slice("pixels", c * n + 1, n), lambda p, i: (F.round(p * 255).cast("long") * (i + 1))),
                        F.lit(0).cast("long"), lambda a, v: a + v) for c in range(3)]
    return out.select("page_id", *[s.alias(k) for s, k in zip(sums, ("red", "green", "blue"))])


def _half_means():
    """An image encoder in the form of the extension point: the mean of each colour in the upper and the lower half."""
    def encode(batch):
        out = np.zeros((len(batch), 6))
        for i, pixels in enumerate(batch):
            if pixels is not None:
                side = np.rint(np.array(pixels, np.float32) * 255).astype(float).reshape(3, 2, -1)
                out[i] = side.mean(axis=2).T.ravel() / 255
        return out
    return encode


_BYTE_SQL = "CAST(('0x' || substr(h, CAST(2 * ({at}) + 1 AS BIGINT), 2)) AS BIGINT)"
_HALF_SQL = ", ".join("list_sum(list_transform(range(8), lambda i: " + _BYTE_SQL.format(at=f"({8 * half} + i) * 3 + {c}") + ")) / (8 * 255.0::DOUBLE)"
                      for half in range(2) for c in range(3))


@query("image_folder", f"""
WITH b AS (SELECT page_id, coalesce(nullif(regexp_extract(url, '{S.PAGE_CLASS_PATTERN}', 1), ''), 'none') AS category,
                  sha256(coalesce(html, '')) || md5(coalesce(html, '')) AS h FROM pages),
v AS (SELECT *, list_sum(list_transform(range(48), lambda i: {_BYTE_SQL.format(at='i')})) AS pixel_sum, [{_HALF_SQL}] AS v FROM b),
z AS (SELECT *, {Q.project('v', 3, 6, 37)} AS z FROM v),
p AS (SELECT *, {Q.softmax('z')} AS p, {Q.argmax('z')} AS code FROM z)
SELECT page_id, category, CAST(coalesce(list_position(['de', 'en', 'fr'], category), 0) - 1 AS INTEGER) AS label, 4 AS height, 4 AS width,
       CAST(pixel_sum AS BIGINT) AS pixel_sum, (SELECT count(*) FROM pages) AS files, {Q.widen('v', 6, prefix='v_')},
       {Q.widen('p', 3, prefix='prob_')}, code AS predicted, {Q.label_name('code')} AS predicted_label FROM p""")
def q_image_folder(spark, sf):
    """S3 + S4 + F6 + F7: a 4 x 4 PNG for every page (the hash of its html) written into a folder per class, listed,
    decoded, resized, encoded and classified."""
    root = _folder(spark, "images")
    pages = S.table(spark, sf, "pages")
    html = F.coalesce("html", F.lit(""))
    category = F.coalesce(F.nullif(F.regexp_extract("url", S.PAGE_CLASS_PATTERN, 1), F.lit("")), F.lit("none"))
    rows = pages.select("page_id", category.alias("category"), F.unhex(F.concat(F.sha2(html, 256), F.md5(html))).alias("pixels"))
    totals = images.write_image_folder(rows, root, "page_id", "category", "pixels", 4, 4)
    listed = images.image_manifest(spark, root, classes=["de", "en", "fr"]).select("filename", "category", F.coalesce("label", F.lit(-1)).alias("label"))
    decoded = images.read_images(spark, root).select(
        F.element_at(F.split("path", "/"), -1).alias("filename"), "category", F.col("image.height").alias("height"),
        F.col("image.width").alias("width"), "image")
    pixels = normalize_images(decoded, size=8)
    # the resized image holds every pixel of the 4 x 4 one four times
    total = F.aggregate("pixels", F.lit(0).cast("long"), lambda a, x: a + F.round(x * 255).cast("long")) / 4
    vectors = encode_batch(pixels.withColumn("pixel_sum", total.cast("long")).drop("shape"), "pixels", _half_means, 6, out="v", batch_size=8)
    out = linear_head(vectors.join(listed, ["category", "filename"]), "v", fuse.closed_form_linear(3, 6, 37))
    out = out.withColumns({"page_id": F.regexp_extract("filename", "^(.*)\\.png$", 1).cast("long"), "files": F.lit(totals["files"]).cast("long"),
                           "predicted_label": L.label_name("predicted")})
    keep = ["page_id", "category", "label", "height", "width", "pixel_sum", "files", "probs", "predicted", "predicted_label"]
    wide = V.widen_vector(out, "v", 6, prefix="v_", keep=keep, digits=6)
    return V.widen_vector(wide, "probs", 3, prefix="prob_", digits=6)


# ---------------------------------------------------------------- the analysis scripts

@query("text_analysis", f"""
SELECT sentiment, count(*) AS rows, CAST(sum(length(cleaned_text)) AS BIGINT) AS clean_chars FROM (
  SELECT {Q.clean_ascii('verified_reviews')} AS cleaned_text, {Q.label_name(Q.label_ge4('rating'))} AS sentiment FROM ({Q.reviews()}))
GROUP BY sentiment""")
def q_text_analysis(spark, sf):
    """The text analysis inputs: strict clean, labels of the second rule, rows per label."""
    frame = pipelines.text_analysis_frame(S.reviews(spark, sf))
    return frame.groupBy("sentiment").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.length("cleaned_text")).alias("clean_chars"))


@query("emoji_analysis", f"""
(SELECT 'best' AS list, * FROM ({_SCORED_SQL}) ORDER BY sentiment_score DESC NULLS LAST, Occurrences DESC, Emoji LIMIT 10)
UNION ALL
(SELECT 'worst' AS list, * FROM ({_SCORED_SQL}) ORDER BY sentiment_score ASC NULLS LAST, Occurrences DESC, Emoji LIMIT 10)""")
def q_emoji_analysis(spark, sf):
    """The emoji analysis script: score, keep frequent symbols, ten best and ten worst."""
    found: dict[str, DataFrame] = pipelines.emoji_analysis(S.emoji_lexicon(spark, sf), n=25)
    best, worst = (found[k].withColumn("list", F.lit(k)) for k in ("best", "worst"))
    return best.unionByName(worst)
