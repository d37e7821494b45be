import os
import struct
import zlib

import numpy as np
from pyspark.sql import functions as F

from tonality.operators import dist
from tonality.operators.encode import normalize_images
from tonality.plans.scoring import ScoringModel
from tonality.sources import files, images
from tonality.streaming.score_stream import REQUEST_SCHEMA, score_stream, start_scoring


def _png(path, w, h, rgb):
    raw = b"".join(b"\x00" + bytes(rgb) * w for _ in range(h))

    def chunk(t, d):
        return struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d) & 0xFFFFFFFF)

    with open(path, "wb") as f:
        f.write(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0))
                + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def _folders(root):
    spec = {"negative": ["a.png", "mocking.png"], "neutral": ["b.PNG"], "positive": ["c.png", "mocking.png", "d.png"]}
    for cls, names in spec.items():
        os.makedirs(os.path.join(root, cls), exist_ok=True)
        for i, n in enumerate(names):
            _png(os.path.join(root, cls, n), 4, 2, (10 * i, 100, 200))
    open(os.path.join(root, "positive", "notes.txt"), "w").write("x")
    os.makedirs(os.path.join(root, "empty"), exist_ok=True)
    return spec


def test_image_manifest_and_counts(spark, tmp_dir):
    _folders(tmp_dir)
    man = images.image_manifest(spark, tmp_dir)
    plan = man._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<path:string>" in plan     # image bytes are never read for the manifest
    rows = man.collect()
    assert len(rows) == 6   # .txt ignored, upper-case .PNG kept
    assert {r.path.split("/")[-2] for r in rows if r.filename == "mocking.png"} == {"negative", "positive"}
    assert {r.category: r.label for r in rows} == {"negative": 0, "neutral": 1, "positive": 2}
    cc = dist.category_counts(man, "category").collect()
    assert [(r.category, r["count"], r.is_total) for r in cc] == [("positive", 3, 0), ("negative", 2, 0),
                                                                  ("neutral", 1, 0), (None, 6, 1)]


def test_read_and_normalize_images(spark, tmp_dir):
    _folders(tmp_dir)
    imgs = images.read_images(spark, tmp_dir)
    out = normalize_images(imgs, "image", size=8, keep=["path", "label"]).collect()
    assert len(out) == 6
    for r in out:
        a = np.array(r.pixels).reshape(3, 8, 8)
        assert r.shape == [3, 8, 8]
        assert np.allclose(a[1], 100 / 255, atol=1e-6) and np.allclose(a[2], 200 / 255, atol=1e-6)


def test_csv_readers_and_bundle(spark, tmp_dir):
    p = os.path.join(tmp_dir, "reviews.csv")
    with open(p, "w") as f:
        f.write('rating,date,verified_reviews\n5,x,"Great, really\ngreat"\n2,y,bad\n')
    r = files.read_reviews(spark, p).orderBy("rating").collect()
    assert [x.rating for x in r] == [2.0, 5.0] and r[1].verified_reviews == "Great, really\ngreat"
    lx = os.path.join(tmp_dir, "lex.csv")
    with open(lx, "w") as f:
        f.write("Emoji,Unicode codepoint,Occurrences,Position,Negative,Neutral,Positive\n😀,0x1f600,10,0.5,1,2,7\n")
    lex = files.read_lexicon(spark, lx).first()
    assert lex.Emoji == "😀" and lex.Occurrences == 10 and lex.Positive == 7
    df = spark.createDataFrame([(1, [0.5, 1.0], "train"), (2, [0.0, 2.0], "test")], "id int, v array<double>, split string")
    files.write_bundle(df, os.path.join(tmp_dir, "b"))
    t = files.read_bundle(spark, os.path.join(tmp_dir, "b"), "test")
    assert [x.id for x in t.collect()] == [2]
    assert "PartitionFilters: [isnotnull(split" in t._jdf.queryExecution().executedPlan().toString()
    files.write_csv(df, os.path.join(tmp_dir, "c"), single_file=True)
    back = spark.read.option("header", True).csv(os.path.join(tmp_dir, "c")).orderBy("id").collect()
    assert back[0].v == "[0.5, 1.0]"


def test_stream_equals_batch(spark, tmp_dir):
    reqs = [("1", "I love it", None, None), ("2", None, "😀😀", None), ("3", None, None, "happy.png"),
            ("4", None, None, None), ("5", "meh", "😐", "x.png")]
    df = spark.createDataFrame(reqs, REQUEST_SCHEMA)
    src = os.path.join(tmp_dir, "in")
    df.write.json(src)
    model = ScoringModel.closed_form()
    q = start_scoring(spark, src, os.path.join(tmp_dir, "out"), os.path.join(tmp_dir, "ck"), model, available_now=True)
    q.awaitTermination()
    streamed = {r.request_id: (r.sentiment, r.confidence) for r in spark.read.parquet(os.path.join(tmp_dir, "out")).collect()}
    batch = {r.request_id: (r.sentiment, r.confidence) for r in score_stream(df, model).collect()}
    assert streamed == batch
    assert batch["4"] == ("neutral", None)
    assert all(batch[i][1] is not None for i in "1235")


def test_catalog_table_roundtrip(spark):
    from tonality.plans.scoring import score_table
    from tonality.sources.jdbc import read_comments, write_sentiments
    spark.createDataFrame([(1, "Good"), (2, "Bad")], "id long, comment_text string").write.mode("overwrite") \
        .saveAsTable("product_comments")
    out = score_table(read_comments(spark), ScoringModel.closed_form())
    write_sentiments(out)
    assert spark.table("product_sentiments").count() == 2


def test_one_pass_scoring_equals_composition(spark):
    from tonality.operators.fuse import fuse_modalities
    from tonality.operators.model import score
    from tonality.plans.scoring import message_vectors, score_messages
    reqs = [(1, "Great stuff, really", "😀", None), (2, "bad", None, "sad.png"), (3, None, "😐😐", None),
            (4, "", None, None)]
    df = spark.createDataFrame(reqs, REQUEST_SCHEMA)
    model = ScoringModel.closed_form()
    one = {r.request_id: (r.predicted, r.confidence) for r in score_messages(df, model, "request_id").collect()}
    v = message_vectors(df, model.dims)
    v = v.withColumn("text_vec", F.coalesce("text_vec", F.array_repeat(F.lit(0.0), model.dims[0])))
    fused = fuse_modalities(v.select("request_id", "text_vec", "emoji_vec", "sticker_vec"), model.params)
    comp = {r.request_id: (r.predicted, r.confidence)
            for r in score(fused.select("request_id", "fused"), "fused", model.classifier, keep=["request_id"]).collect()}
    for k in one:
        assert one[k][0] == comp[k][0] and abs(one[k][1] - comp[k][1]) < 1e-12


def test_invalid_image_dropped(spark, tmp_dir):
    _folders(tmp_dir)
    with open(os.path.join(tmp_dir, "neutral", "broken.png"), "wb") as f:
        f.write(b"not a png at all")
    assert images.image_manifest(spark, tmp_dir).count() == 7     # the manifest lists every file
    assert images.read_images(spark, tmp_dir).count() == 6        # decoding drops the broken one


def test_emoji_info_names_and_majority(spark):
    from tonality.plans.pipelines import emoji_info
    lex = spark.createDataFrame([("❤", 1, 2, 30), ("♡", 5, 5, 1), ("😢", 9, 1, 0)],
                                "Emoji string, Negative long, Neutral long, Positive long") \
        .withColumn("Occurrences", F.col("Negative") + F.col("Neutral") + F.col("Positive"))
    names = spark.createDataFrame([("❤", ":red_heart: "), ("😢", ":crying_face:")], "symbol string, name string")
    got = {r.emoji: r for r in emoji_info(lex, names, split=False).collect()}
    assert got["❤"].emoji_clean == ":red_heart:" and got["❤"].sentiment_label == "positive"
    assert got["♡"].emoji_clean == "♡" and got["♡"].label_numeric == 0        # unknown kept; tie -> negative
    assert got["😢"].sentiment_label == "negative"


def test_stream_restart_scores_each_file_once(spark, tmp_dir):
    src, out, ck = (os.path.join(tmp_dir, p) for p in ("in", "out", "ck"))
    model = ScoringModel.closed_form()
    first = spark.createDataFrame([(str(i), f"text {i}", None, None) for i in range(5)], REQUEST_SCHEMA)
    first.coalesce(1).write.json(os.path.join(src, "batch1"))
    q = start_scoring(spark, os.path.join(src, "*"), out, ck, model, available_now=True)
    q.awaitTermination()
    assert spark.read.parquet(out).count() == 5
    second = spark.createDataFrame([(str(i), f"more {i}", "😀", None) for i in range(5, 9)], REQUEST_SCHEMA)
    second.coalesce(1).write.json(os.path.join(src, "batch2"))
    # a restarted query with the same checkpoint picks up only the new file
    q = start_scoring(spark, os.path.join(src, "*"), out, ck, model, available_now=True)
    q.awaitTermination()
    ids = sorted(r.request_id for r in spark.read.parquet(out).collect())
    assert ids == [str(i) for i in range(9)]


def test_parse_json_requests(spark):
    from tonality.streaming.score_stream import parse_requests
    raw = spark.createDataFrame([('{"request_id": 1, "text": "nice", "emoji": "😀"}',), ('{"request_id": 2}',)], "value string")
    reqs = parse_requests(raw)
    assert reqs.columns == ["request_id", "text", "emoji", "sticker"]
    got = {r.request_id: r for r in score_stream(reqs, ScoringModel.closed_form()).collect()}
    assert got["2"].sentiment == "neutral" and got["2"].confidence is None
    assert got["1"].confidence is not None


def test_table_sink_takes_each_batch_once(spark, tmp_dir):
    from tonality.streaming.score_stream import commit_batch, committed_rows, start_scoring_tables
    model = ScoringModel.closed_form()
    src, tables, ck = (os.path.join(tmp_dir, p) for p in ("in", "tables", "ck"))
    lines = ['{"request_id": "1", "text": "nice"}', '{"request_id": "2"', "", "no json", '{"text": "no id"}', '{"request_id": "3"}', "[1]"]
    frame = spark.createDataFrame([(x,) for x in lines], "value string")
    frame.repartition(3).write.text(src)
    start_scoring_tables(spark, src, tables, ck, model, max_files_per_trigger=1).awaitTermination()
    once = sorted(map(tuple, committed_rows(spark, tables).select("request_id", "sentiment").collect()))
    assert [r[0] for r in once] == ["1", "3"]
    bad = sorted(r.value for r in committed_rows(spark, tables, "quarantine").collect())
    assert bad == sorted(x for x in lines if x not in (lines[0], lines[5]))
    # a batch that is replayed after its commit, and one that broke off before it and comes again
    assert not commit_batch(frame, 0, tables, model)
    frame.select(F.lit("9").alias("request_id")).write.parquet(os.path.join(tables, "scored/run=scoring/batch_id=7"))
    assert sorted(map(tuple, committed_rows(spark, tables).select("request_id", "sentiment").collect())) == once
    assert commit_batch(frame, 7, tables, model)
    assert sorted(r.request_id for r in committed_rows(spark, tables).collect()) == ["1", "1", "3", "3"]
    assert commit_batch(frame, 0, tables, model, run="another checkpoint")
