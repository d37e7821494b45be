"""Dirty and unusual data: line breaks, missing classes, ragged vectors, bad fields, odd labels, resized images."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonality.functions import text as X
from tonality.operators import dist, fuse, metrics, rank
from tonality.operators import model as M
from tonality.operators.encode import normalize_images
from tonality.sources import files


def test_words_split_at_any_white_space(spark):
    df = spark.createDataFrame([("good\nbad\tfine  day end",)], "t string")
    assert df.select(X.words("t").alias("w")).first().w == ["good", "bad", "fine", "day", "end"]


def test_class_weight_keeps_rows_of_absent_classes(spark):
    df = spark.createDataFrame([(1, 0, "train"), (2, 5, "val"), (3, None, "val")], "k int, label int, split string")
    out = dist.with_class_weight(df, dist.class_weights(df, "label", "split", "train"), "label")
    assert {r.k: r.weight for r in out.collect()} == {1: 1.0, 2: None, 3: None}


def test_ragged_vectors_raise(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],), ([1.0, 2.0, 3.0, 4.0, 5.0],)], "x array<double>")
    with pytest.raises(Exception, match="not 4"):
        fuse.project_vector(df, "x", fuse.closed_form_linear(2, 4, 1)).collect()


def test_log_loss_of_odd_labels_and_weights(spark):
    df = spark.createDataFrame([(1, 0, 1.0), (1, 9, 1.0), (1, -1, 1.0), (2, 0, 0.0), (1, 0, None)], "g int, y int, w double")
    df = df.withColumn("p", F.array(F.lit(0.25), F.lit(0.75)))
    got = {r.g: (r.log_loss, r.rows) for r in metrics.weighted_log_loss(df, "p", "y", "w", by=["g"]).collect()}
    assert got[1][0] == pytest.approx(-np.log(0.25)) and got[1][1] == 4 and got[2] == (None, 1)


def test_bad_rating_reads_as_null_and_ids_do_not_depend_on_file_splits(spark, tmp_dir):
    for i in range(4):
        with open(os.path.join(tmp_dir, f"r{i}.csv"), "w") as f:
            f.write("verified_reviews,rating\n" + "".join(f'"text {i} {j}\nline ""two""",{j % 5 + 1}\n' for j in range(20)) + "odd,n/a\nodd,n/a\n")
    one = {(r.review_id, r.verified_reviews, r.rating) for r in files.read_reviews(spark, tmp_dir).collect()}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    try:
        two = {(r.review_id, r.verified_reviews, r.rating) for r in files.read_reviews(spark, tmp_dir).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert one == two and len(one) == 88 and {r[0] for r in one} == set(range(88))
    assert sum(r[2] is None for r in one) == 8 and any("\nline \"two\"" in r[1] for r in one)


def test_resize_takes_the_pixel_under_the_centre(spark):
    h, w, size = 5, 4, 3
    data = bytes((r * 40 + c * 7 + k) % 256 for r in range(h) for c in range(w) for k in range(3))
    df = spark.createDataFrame([(1, ("", h, w, 3, 16, bytearray(data)))],
                               "k int, image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>")
    got = np.array(normalize_images(df, size=size).first().pixels).reshape(3, size, size)
    for ch in range(3):
        for i in range(size):
            for j in range(size):
                r, c = int((i + 0.5) * h / size), int((j + 0.5) * w / size)
                assert got[ch, i, j] == pytest.approx(data[(r * w + c) * 3 + 2 - ch] / 255)


def test_record_through_csv(spark, tmp_dir):
    rows = [(i % 3, (i // 2) % 3) for i in range(378)]
    df = spark.createDataFrame(rows, "truth int, prediction int")
    record = metrics.evaluation_record(df, "golden", weights=[2.0, 3.0, 1.0])
    path = os.path.join(tmp_dir, "rec")
    files.write_csv(metrics.csv_record(record), path)
    back = metrics.read_csv_record(spark.read.option("header", True).option("escape", '"').csv(path)).first()
    want = record.first()
    assert back.confusion_matrix == want.confusion_matrix and back.weights_used == [2.0, 3.0, 1.0]
    assert {k: v.f1 for k, v in back.per_class_metrics.items()} == {k: v.f1 for k, v in want.per_class_metrics.items()}
    assert metrics.latest_summary(record).columns == ["F1_weighted", "F1_macro", "Confusion_matrix"]


def test_top_k_with_two_directions(spark):
    df = spark.createDataFrame([(1, 5), (1, 7), (0, 1)], "a int, b int")
    assert [tuple(r) for r in rank.top_k(df, ["a", "b"], 2, ascending=[True, False]).collect()] == [(0, 1), (1, 7)]


def test_fits_beat_chance_on_held_out_rows(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 6))
    y = (x @ rng.normal(size=(6, 3))).argmax(axis=1)
    rows = [(i, [float(v) for v in x[i]], int(y[i]), 1.0, ("train", "val", "test")[min(i % 5, 2) if i % 5 < 3 else 0]) for i in range(600)]
    df = spark.createDataFrame(rows, "k int, features array<double>, label int, weight double, split string")
    res = M.fit_relu_classifier(df, hidden=16, epochs=40, patience=10, lr=0.05, seed=1)
    test = df.where("split = 'test'")
    got = M.score(test, "features", res.model, keep=["label"])
    assert got.where("predicted = label").count() / test.count() > 0.75
    words = ["good", "fine", "bad", "awful", "so", "la", "la"]
    docs = [(i, [words[i % 2 * 2 + (i // 2) % 2], "so", words[4 + i % 3]], i % 2 * 2) for i in range(80)]
    train = spark.createDataFrame(docs, "k int, tokens array<string>, label int")
    model = M.fit_text_baseline(train, "k", steps=6, lr=0.3)
    losses = [v for _, v in model.history]
    assert losses[-1] < losses[0] / 2
    pred = M.predict_text_baseline(model, train, "k").join(train, "k")
    assert pred.where("predicted = label").count() == 80


def test_reviews_of_one_line_each_split_a_large_file(spark, tmp_path):
    path = str(tmp_path / "r.csv")
    with open(path, "w", encoding="utf-8") as f:
        f.write("review_id,verified_reviews,rating\n" + "".join(f'{i},"text, ""{i}"" caf\u00e9",{i % 5 + 1}\n' for i in range(20000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        whole, cut = files.read_reviews(spark, path), files.read_reviews(spark, path, multiline=False)
        assert whole.rdd.getNumPartitions() == 1 and cut.rdd.getNumPartitions() > 3
        assert cut.exceptAll(whole).count() == 0 == whole.exceptAll(cut).count() and cut.count() == 20000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
