import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonality.operators import tokens as TK
from tonality.operators.encode import encode_batch, hash_embed


def _docs(spark):
    rows = [(1, ["the", "cat", "sat", "a"]), (2, ["dog", "the", "zebra"]), (3, [])]
    return spark.createDataFrame(rows, "id int, tokens array<string>")


def test_fit_vocabulary_and_bag_of_words(spark):
    d = _docs(spark)
    v = {r.term: r.term_id for r in TK.fit_vocabulary(d, "tokens", min_len=2).collect()}
    assert v == {t: i for i, t in enumerate(sorted(["the", "cat", "sat", "dog", "zebra"]))}
    test = spark.createDataFrame([(9, ["the", "the", "unseen", "dog"])], "id int, tokens array<string>")
    bow = {(r.term_id, r["count"]) for r in TK.bag_of_words(test, "id", "tokens", TK.fit_vocabulary(d, "tokens")).collect()}
    assert bow == {(v["the"], 2), (v["dog"], 1)}


def test_encode_tokens_special_ids_truncation_padding(spark):
    d = _docs(spark)
    vocab = TK.fit_vocabulary(d, "tokens", min_len=1)
    v = {r.term: r.term_id for r in vocab.collect()}
    enc = {r.id: r for r in TK.encode_tokens(d, "id", "tokens", vocab, max_len=4).collect()}
    W = TK.FIRST_WORD_ID
    assert enc[1].input_ids == [TK.CLS_ID, W + v["the"], W + v["cat"], TK.SEP_ID]
    assert enc[3].input_ids == [TK.CLS_ID, TK.SEP_ID, TK.PAD_ID, TK.PAD_ID]
    assert enc[3].attention_mask == [1, 1, 0, 0]
    unk = spark.createDataFrame([(5, ["nope"])], "id int, tokens array<string>")
    e = TK.encode_tokens(unk, "id", "tokens", vocab, max_len=8).first()
    assert e.input_ids == [TK.CLS_ID, TK.UNK_ID, TK.SEP_ID]   # padded to the longest row


def test_extend_vocabulary_appends(spark):
    d = _docs(spark)
    vocab = TK.fit_vocabulary(d, "tokens", min_len=2)
    new = spark.createDataFrame([(1, ["yak", "cat", "ant"])], "id int, tokens array<string>")
    ext = {r.term: r.term_id for r in TK.extend_vocabulary(vocab, new, "tokens").collect()}
    assert ext["ant"] == 5 and ext["yak"] == 6 and ext["cat"] == 0


def test_hash_embed_matches_python(spark):
    d = _docs(spark)
    got = {r.id: r.e for r in hash_embed(d, "tokens", 8, "e").collect()}
    for i, toks in [(1, ["the", "cat", "sat", "a"]), (2, ["dog", "the", "zebra"])]:
        v = np.zeros(8)
        for t in toks:
            h = hashlib.md5(t.encode()).hexdigest()
            v[int(h[:8], 16) % 8] += 1 if int(h[8], 16) < 8 else -1
        v = v / max(np.linalg.norm(v), 1e-12)
        assert got[i] == pytest.approx(v.tolist())
    assert got[3] == [0.0] * 8


def test_encode_batch_extension_point(spark):
    df = spark.createDataFrame([(1, "ab"), (2, None), (3, "xyz")], "id int, t string")

    def factory():
        return lambda vals: np.array([[len(v or ""), 1.0] for v in vals])

    got = {r.id: r.embedding for r in encode_batch(df, "t", factory, 2).collect()}
    assert got[1] == [2.0, 1.0] and got[2] is None and got[3] == [3.0, 1.0]


def test_hash_embed_null_words_and_rows(spark):
    rows = [(1, ["a", None, "b", "a"]), (2, None), (3, []), (4, [None]), (5, ["a", "b", "a"])]
    d = spark.createDataFrame(rows, "id int, tokens array<string>")
    got = {r.id: r.e for r in hash_embed(d, "tokens", 8, "e").collect()}
    assert got[1] == got[5] and any(got[1])
    assert got[2] == got[3] == got[4] == [0.0] * 8


def test_word_slots_forget_nothing_they_need(monkeypatch):
    from tonality.operators import encode
    monkeypatch.setattr(encode, "REMEMBERED", 3)
    words = [f"w{i}" for i in range(10)]
    for part in (words[:5], words[5:], words):
        assert encode.word_slots(part, 16).tolist() == [encode.word_slot(w, 16) for w in part]


def test_bag_of_words_sends_no_word_per_document(spark):
    rows = [(1, ["aa", "bb", "aa", None, "c"]), (1, ["aa"]), (None, ["aa", "aa"]), (None, ["bb"]), (2, None), (3, [])]
    d = spark.createDataFrame(rows, "id int, tokens array<string>").repartition(3)
    vocab = spark.createDataFrame([("aa", 5), ("bb", 7)], "term string, term_id long")
    bag = TK.bag_of_words(d, "id", "tokens", vocab)
    assert sorted((r.id or 0, r.term_id, r["count"]) for r in bag.collect()) == [(0, 5, 2), (0, 7, 1), (1, 5, 3), (1, 7, 1)]
    plan = bag._jdf.queryExecution().executedPlan().toString()
    assert "keys=[id#" in plan and not any("hashpartitioning(id#" in line and "term#" in line for line in plan.splitlines())
    assert TK.postings(d.coalesce(1), "id", "tokens", 2).count() == 2
