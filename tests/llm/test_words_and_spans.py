"""Personal data, spelling variants and collocations against brute force."""

import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import pyarrow as pa
import pytest

from llm_cases import awkward_rows, frame, sort_key, write_tables
from tonality.llm import collocations, pii, queries, spelling

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def digits(s):
    return [int(c) for c in s if c in "0123456789"]


def check_digit_ok(s):
    d = digits(s)[::-1]
    return 14 <= len(d) <= 19 and (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def naive_base(text):
    """The contract's patterns as they stand, one ``finditer`` each."""
    tests = {"email": (EMAIL, lambda s: True), "ip": (IP, lambda s: all(int(p) <= 255 for p in s.split("."))),
             "card": (CARD, check_digit_ok), "phone": (PHONE, lambda s: 10 <= len(digits(s)) <= 15)}
    out = []
    for rank, (kind, (pattern, good)) in enumerate(tests.items()):
        out += [(m.start(), rank, kind, m.end()) for m in pattern.finditer(text) if good(m.group())]
    return sorted(out)


def awkward_text(rng):
    parts = ["a", "Z", ".", "..", "@", "@@", "+", "+4", " ", "  ", "-", "--", "(", "0", "7", "12", "255", "256", "1.2.3.4", "+49 (30) 123-45.67", "x@y.z",
             "4111 1111 1111 1111", "4111-1111-1111-1111", "é", "🙂", "\n", "%_", "0049", "1.1.1.1.1.1.1.1", "９"]
    return "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))


def test_base_spans_equal_the_patterns():
    rng = random.Random(5)
    scanner = pii.Scanner(pii.BASE)
    found = 0
    for _ in range(20_000):
        text = awkward_text(rng)
        got = [(a, r, pii.BASE[r].name, b) for a, r, b in scanner.spans(text)]
        assert got == naive_base(text), text
        found += len(got)
    assert found > 5000


def test_spans_that_need_a_scheme_or_a_cue():
    scanner = pii.Scanner(pii.KINDS)

    def kinds(text):
        return [(pii.KINDS[r].name, text[a:b]) for a, r, b in scanner.spans(text) if r >= len(pii.BASE)]
    assert kinds("see https://anna:pw@host.example/x and http://plain.example/") == [("login", "https://anna:pw@host.example")]
    assert kinds("IBAN: DE89 3704 0044 0532 0130 00 please") == [("iban", "DE89 3704 0044 0532 0130 00")]
    assert kinds("iban GB82WEST12345698765432.") == [("iban", "GB82WEST12345698765432")]
    assert kinds("iban GB82WEST12345698765433.") == []
    assert kinds("Account number: 1234 5678 90, account of 12345678") == [("account", "1234 5678 90")]
    assert kinds("SSN 123-45-6789 ssn 000-12-3456 social security number: 666-12-3456 123-45-6789") == [("ssn", "123-45-6789")]


def test_long_runs_take_linear_time():
    scanner = pii.Scanner(pii.KINDS)
    for text in ("1." * 100_000, "a" * 200_000 + "@", "a@" * 100_000, "+1" * 100_000, "+" + "1 " * 100_000, "1 " * 100_000, "a@b." * 50_000,
                 "http://" * 30_000, "iban " * 40_000, "account:" * 30_000, "9" * 200_000):
        assert len(scanner.spans(text)) <= 30_000


def test_pii_awkward_rows(spark, tmp_dir):
    rows = awkward_rows() + [(200, "mail a.b@c.de now", None, None, None), (200, "mail a.b@c.de now", None, None, None), (201, "ip 10.0.0.1 é 🙂 x@y.zz", "aa", "s", 1)]
    got = pii.find(frame(spark, rows)).collect()
    want = sorted(((i, naive_base(t or "")) for i, t, *_ in rows), key=repr)
    assert sorted(((r.doc_id, [tuple(s) for s in r.spans if s.rank < 4]) for r in got), key=repr) == want
    write_tables(tmp_dir, spark, [])
    assert queries.QUERIES["op11_pii"](spark, tmp_dir).count() == 0
    assert pii.find(frame(spark, rows), kinds=()).where("size(spans) > 0").count() == 0


# --- spelling variants -------------------------------------------------------------------------------------------


def naive_words(rows, one_in=31, min_chars=7, min_count=2):
    counts = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if one_in and h % one_in == 0:
                k = h % len(word)
                word = word[:k] + word[k + 1:]
            counts[word] += 1
    return {w: n for w, n in counts.items() if len(w) >= min_chars and n >= min_count}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def naive_variants(words, ratio=10):
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out, key=sort_key)


def variant_rows(seed=2):
    """Words over few letters, so that bigrams repeat within words and tie, with chains of ever more frequent forms."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("aé÷") for _ in range(rng.randint(3, 8))) for _ in range(400)]
    words += ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "abababab", "bababab", "abcdefgh", "abcdefg", "xabcdefgh", "abcdefghy", "zbcdefgh"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(60)), "aa", "s", 1) for i in range(40)]
    rows += [(50, "chainword " * 3 + "chainwords " * 40 + "Xchainwords " * 500, None, None, None)]
    return rows


@pytest.mark.parametrize("one_in", [31, 2, 0])
def test_variants_equal_brute_force(spark, one_in):
    rows = variant_rows() + awkward_rows()
    got = spelling.variants(frame(spark, rows), one_in=one_in)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = naive_variants(naive_words(rows, one_in))
    assert sum(w[4] > 0 for w in want) > 30 and any(w[1] and w[2] != w[1] for w in want)
    assert sorted(map(tuple, got.collect()), key=sort_key) == want


def test_near_pairs_of_one_prefix(spark):
    """A third of all words share front and back; every pair that differs by one letter is found, no other."""
    words = ["front" + a + b + "back" for a in "abcdefghijkl" for b in "abcdefghijkl"] + ["frontback", "frontaback", "frontbac"]
    df = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    got = {(r.word, r.near) for r in spelling.near_pairs(df).collect()}
    assert got == {(a, b) for a in words for b in words if one_edit(a, b)}


def test_variants_of_nothing(spark, tmp_dir):
    write_tables(tmp_dir, spark, [])
    assert queries.QUERIES["op12_spelling_variants"](spark, tmp_dir).count() == 0
    assert spelling.variants(frame(spark, [(None, None, None, None, None), (1, "short words only", "aa", "s", 1)])).count() == 0
    with pytest.raises(ValueError):
        spelling.variants(frame(spark, []), min_chars=3)


def test_runs_across_slices(monkeypatch):
    monkeypatch.setattr(spelling, "SLICE", 7)
    text = "one twothreefourfive, six éÿ seven " + "x" * 50
    assert [w for runs in spelling.runs_of(text) for w in runs] == spelling.RUN.findall(text)


# --- collocations ------------------------------------------------------------------------------------------------


def naive_collocations(rows, min_count=10, cover=50, top=2000):
    total, f = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")):
            words = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in (1, 2, 3):
                f.update((lang, *words[i:i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang in total:
        kept = []
        candidates = {g[1:]: n for g, n in f.items() if g[0] == lang and len(g) > 2 and n >= min_count}
        for g, a in candidates.items():
            if any(100 * n >= cover * a for h, n in candidates.items() if len(h) > len(g) and g in (h[:2], h[1:])):
                continue
            cuts = [(int(Fraction(1000000 * a * a, f[(lang, *g[:k])] * f[(lang, *g[k:])])), k) for k in range(1, len(g))]
            s, k = min(cuts)
            kept.append((-s, -a, " ".join(g).encode(), f[(lang, *g[:k])], f[(lang, *g[k:])]))
        out += [(lang, i + 1, p.decode(), -a, left, right, total[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(kept)[:top])]
    return sorted(out)


def collocation_rows(seed=4):
    rng = random.Random(seed)
    words = ["The", "of", "big", "House", "é", "ñandú", "a b", "x", "🙂"]
    rows = [(i, "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "!?", "\r\n"]) for _ in range(rng.randint(0, 60))),
             rng.choice(["aa", "bb", None]), "s", 1) for i in range(60)]
    passage = " ".join(f"w{i}" for i in range(150))
    rows += [(100 + i, passage, "aa", None, None) for i in range(12)]  # one long unary path
    rows += [(200 + i, "round and again " * 9, "cc", "s", 1) for i in range(3)]  # a circle of unary nodes
    rows += [(300, "ha " * 40, "cc", "s", 1), (301, "tic tac " * 30, "cc", "s", 1)]
    return rows


@pytest.mark.parametrize("part", [64, 3])
def test_collocations_equal_brute_force(spark, monkeypatch, part):
    monkeypatch.setattr(collocations, "PART", part)
    rows = collocation_rows() + awkward_rows()
    got = collocations.collocations(frame(spark, rows))
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = naive_collocations(rows)
    assert len(want) > 150
    assert sorted(map(tuple, got.collect())) == want
    few = collocations.collocations(frame(spark, rows), min_count=3, cover=80, top=7)
    assert sorted(map(tuple, few.collect())) == naive_collocations(rows, 3, 80, 7)


def test_paths_are_the_repeated_passages(spark, monkeypatch):
    monkeypatch.setattr(collocations, "PART", 1000)
    rows = collocation_rows()
    found = {(r.lang, r.words): list(r.counts) for r in collocations.paths(frame(spark, rows)).collect()}
    assert found["aa", " ".join(f"w{i}" for i in range(150))] == [12] * 148
    circle = [words for lang, words in found if lang == "cc" and "round" in words]
    assert circle == ["again round and again round"]
    assert found["cc", "ha ha ha"] == [38]
    every = Counter(g for (lang, words) in found for g in zip([lang] * 999, words.split(), words.split()[1:], words.split()[2:]))
    assert max(every.values()) == 1  # every edge lies on one path
    heavy = collocations.edges(frame(spark, rows)).groupBy("lang", "w1", "w2", "w3").sum("n").where("`sum(n)` >= 10 AND w3 <> ''")
    assert sum(every.values()) == heavy.count()


def test_hot_nodes_are_split(spark):
    """A pair with a third of all rows goes to many buckets by its third word, and nothing changes."""
    rows = [(i, " ".join(f"the same w{j % 97} x{j % 5}" for j in range(i, i + 40)), "aa", "s", 1) for i in range(60)] + collocation_rows()
    df = frame(spark, rows)
    hot = collocations.hot_nodes(df, share=0.05)
    assert ("aa", "the", "same") in hot and len(hot) <= 20
    found = collocations.packed_edges(df, hot, 64).where("hot").collect()
    of = {w3: r.bucket for r in found for w1, w2, w3 in zip(r.w1.split(" "), r.w2.split(" "), r.w3.split(" ")) if (w1, w2) == ("the", "same")}
    assert len(of) == 97 and len(set(of.values())) > 20
    assert sorted(map(tuple, collocations.collocations(df).collect())) == naive_collocations(rows)


@pytest.mark.parametrize("block", [1, 4, 1000])
def test_flow_of_a_partition_in_small_blocks(monkeypatch, block):
    monkeypatch.setattr(collocations, "BLOCK", block)
    rng = random.Random(block)
    cols = ["lang", "w1", "w2", "w3", "n"]
    rows = [("aa", rng.choice("ab"), rng.choice("xyz"), rng.choice(["", "u", "v"]), str(rng.randint(1, 5))) for _ in range(300)]
    hot = {("a", "x"), ("b", "z")}
    parts = {}
    for r in rows:
        is_hot = r[1:3] in hot
        parts.setdefault((sum(map(ord, "".join(r[1:4] if is_hot else r[1:3]))) % 4, is_hot, rng.randrange(3)), []).append(r)
    packed = [dict(zip(cols, map(" ".join, zip(*of))), bucket=k[0], hot=k[1]) for k, of in sorted(parts.items())]
    batches = [pa.RecordBatch.from_pylist(packed[i:i + 5]) for i in range(0, len(packed), 5)]
    got = Counter()
    for out in collocations._settled(iter(batches), 10):
        for r in out.to_pylist():
            got[r["kind"], r["w1"], r["w2"], r["w3"]] += r["n"]
    edge, node, word = Counter(), Counter(), Counter()
    for _, w1, w2, w3, n in rows:
        edge[w1, w2, w3] += int(n)
        node[w1, w2] += int(n)
        word[w1] += int(n)
    want = {(1, w, "", ""): n for w, n in word.items()} | {(2, *k, ""): n for k, n in node.items() if n >= 10}
    assert got == want | {(3, *k): n for k, n in edge.items() if n >= 10 and k[2]}


def test_scores_are_exact(spark):
    rng = random.Random(3)
    rows = [(a, a + rng.randrange(10**13), a + rng.randrange(10**13)) for a in (rng.randrange(1, 10 ** rng.randint(1, 15)) for _ in range(300))]
    rows += [(10**15, 10**15, 10**15), (1, 10**15, 10**15), (999_999_999_999_999, 10**15, 10**15)]
    df = spark.createDataFrame(rows, "a long, l long, r long")
    got = df.select("a", "l", "r", collocations.score(df.a, df.l, df.r).alias("s")).collect()
    assert all(r.s == 1000000 * r.a * r.a // (r.l * r.r) for r in got)


def test_a_long_text_is_split_in_slices(monkeypatch):
    text = "One two. Three, four five\tsix seven\x0beight! ".encode() * 50
    whole = list(collocations.tokens(text, collocations.Numbers()))
    monkeypatch.setattr(collocations, "SLICE", 11)
    parts = list(collocations.tokens(text, collocations.Numbers()))
    assert len(parts) > 50 and [x for p in parts for x in p] == [x for p in whole for x in p]


def test_collocations_of_nothing(spark, tmp_dir):
    write_tables(tmp_dir, spark, [])
    assert queries.QUERIES["op13_collocations"](spark, tmp_dir).count() == 0
    assert collocations.collocations(frame(spark, [(None, None, None, None, None), (1, " \n.,", "aa", "s", 1)])).count() == 0


def test_a_block_sums_its_grams_as_it_goes(monkeypatch):
    import numpy as np
    from tonality.llm import ppm
    rows = [(f"word {i % 7} again {i % 3}".encode(), i % 2 == 0) for i in range(60)]
    want = ppm.block_lists(rows, 3)
    monkeypatch.setattr(ppm, "CHUNK", 10)
    monkeypatch.setattr(ppm, "LISTED", 8)
    most, plain = [], ppm.summed
    monkeypatch.setattr(ppm, "summed", lambda k, n: most.append(len(k)) or plain(k, n))
    got = ppm.block_lists(rows, 3)
    for kind in want:
        assert all(np.array_equal(a, b) for a, b in zip(got[kind], want[kind]))
    assert max(most) < 2 * len(want[ppm.GRAM][0]) + 80


def test_positions_of_a_batch_are_slices():
    import numpy as np
    import pyarrow as pa
    from tonality.llm import substring_dedup as S
    batch = pa.record_batch([pa.array([[9], [3, 1], None, [], [4]], pa.list_(pa.int32()))], names=["at"])
    assert [p.tolist() for p in S._positions(batch.slice(1))] == [[3, 1], [], [], [4]]
    assert S.spread(np.array([1, 4]), 1, 0, 5).tolist() == [True, True, False, True, True]
    assert S.kept_words(b"a b c d", np.array([1]), 2) == (4, [b"a", b"d"])
