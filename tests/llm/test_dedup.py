"""SimHash, line and substring dedup against brute force."""

import hashlib
import random
import re
from collections import Counter

import pytest
import xxhash
from llm_cases import awkward_rows, frame, sort_key, write_tables

from tonality.llm import line_dedup, runs, simhash, substring_dedup
from tonality.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def brute_fingerprint(text, k=3):
    w = WORD.findall((text or "").translate(LOWER))
    shingles = [" ".join(w[i:i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [" ".join(w)] * bool(w)
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows, radius):
    fps = [brute_fingerprint(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(find(i), []).append(r[0])
    low = {g: min([x for x in ids if x is not None], default=None) for g, ids in groups.items()}
    return [(r[0], f"{fp:016x}", low[find(i)]) for i, (r, fp) in enumerate(zip(rows, fps))]


def test_simhash_query(spark, tmp_path):
    rows = awkward_rows()
    got = QUERIES["op1_simhash_near_dedup"](spark, write_tables(str(tmp_path / "t"), spark, rows)).collect()
    assert sorted(map(tuple, got), key=sort_key) == sorted(brute_components(rows, 2), key=sort_key)


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_links_connect_all_close_fingerprints(spark, radius):
    rng = random.Random(radius)
    base = [rng.getrandbits(64) for _ in range(4)]
    fps = set(base)
    for _ in range(60):
        x = rng.choice(sorted(fps))
        for b in rng.sample(range(64), rng.randint(1, 4)):
            x ^= 1 << b
        fps.add(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    links = [tuple(r) for r in simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), radius).collect()]
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= radius and a != b for a, b in links)

    def components(edges):
        root = {x: x for x in signed}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x
        for a, b in edges:
            root[find(a)] = find(b)
        return {frozenset(y for y in signed if find(y) == find(x)) for x in signed}
    close = [(a, b) for a in signed for b in signed if ((a ^ b) & (1 << 64) - 1).bit_count() <= radius]
    assert components(links) == components(close)


def test_keep_one_keeps_columns_and_one_row_of_each_group(spark):
    rows = awkward_rows()
    docs = frame(spark, rows)
    kept = simhash.keep_one(docs)
    assert kept.schema == docs.schema
    got = kept.select("doc_id", "text").collect()
    want = {}
    fps = [brute_fingerprint(r[1]) for r in rows]
    group = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (fps[i] ^ fps[j]).bit_count() <= 2:
                    group[i] = group[j] = min(group[i], group[j])
    for i, r in enumerate(rows):
        key = (r[0] is None, r[0] or 0)
        if group[i] not in want or key < want[group[i]]:
            want[group[i]] = key
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted(want.values())


def test_components_of_a_long_chain_and_a_star(spark):
    from tonality.llm.components import connected_components

    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7), (None, 3)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    assert got == {i: 0 for i in range(1, 41)} | {100 + i: 100 for i in range(1, 60)}


def brute_lines(rows, min_docs, keep_first, min_chars=1):
    key = lambda line: line.strip(" \t\n\v\f\r").translate(LOWER)
    docs = sorted({(r[0] is not None, r[0] or 0, xx(r[1]), r[1] or "") for r in rows})
    found = {}
    for d in docs:
        for n, line in enumerate(d[3].split("\n")):
            if len(key(line)) >= min_chars:
                found.setdefault(key(line), []).append((d, n))
    gone = set()
    for at in found.values():
        if len({d for d, _ in at}) >= min_docs:
            gone |= set(at[1:] if keep_first else at)
    out = []
    for r in rows:
        d = (r[0] is not None, r[0] or 0, xx(r[1]), r[1] or "")
        lines = d[3].split("\n")
        kept = [x for n, x in enumerate(lines) if (d, n) not in gone]
        out.append((r[0], len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def xx(text):
    h = xxhash.xxh64((text or "").encode(), seed=42).intdigest()
    return h - (1 << 64) if h >> 63 else h


@pytest.mark.parametrize("min_docs,keep_first", [(2, False), (2, True), (10, False), (10, True), (1, False)])
def test_line_dedup(spark, min_docs, keep_first):
    rows = awkward_rows()
    got = line_dedup.dedup_lines(frame(spark, rows), min_docs, 1, keep_first).collect()
    assert sorted(map(tuple, got), key=sort_key) == sorted(brute_lines(rows, min_docs, keep_first), key=sort_key)


def test_line_query(spark, tmp_path):
    rows = awkward_rows()
    got = QUERIES["op2_line_dedup"](spark, write_tables(str(tmp_path / "t"), spark, rows)).collect()
    want = [(a, b, c, hashlib.sha256(t.encode()).hexdigest()) for a, b, c, t in brute_lines(rows, 10, False)]
    assert sorted(map(tuple, got), key=sort_key) == sorted(want, key=sort_key)


def test_drop_lines_keeps_rows_columns_and_null_texts(spark):
    rows = awkward_rows()
    docs = frame(spark, rows)
    out = line_dedup.drop_lines(docs, 10, 1, True)
    assert out.columns == docs.columns
    got = sorted(((r.doc_id, r.text or "", r.fp) for r in out.collect()), key=sort_key)
    assert got == sorted(((a, t, "fp") for a, _, _, t in brute_lines(rows, 10, True)), key=sort_key)
    assert out.where("doc_id = 100").first().text is None


@pytest.mark.parametrize("partitions", [1, 2, 7, 40])
def test_runs_over_partition_edges(spark, partitions):
    rng = random.Random(partitions)
    rows = [(rng.choice([1, 1, 1, 2, 3, 4, 5]), 0, rng.choice([None, *range(9)]), rng.randint(0, 2), p) for p in range(400)]
    df = spark.createDataFrame(rows, "k1 long, k2 long, d1 long, d2 long, pos int")
    for min_units, keep_first, each in [(2, False, False), (5, True, False), (27, False, False), (28, False, False), (2, True, True)]:
        units = {}
        for k1, _, d1, d2, p in rows:
            units.setdefault(k1, set()).add((d1, d2, p) if each else (d1, d2))
        order = sorted(rows, key=lambda r: (r[0], r[2] is not None, r[2] or 0, r[3], r[4]))
        firsts = {}
        for r in order:
            firsts.setdefault(r[0], r)
        want = [r[2:] for r in rows if len(units[r[0]]) >= min_units and not (keep_first and r == firsts[r[0]])]
        stream = runs.repeated(df, min_units, keep_first, partitions, each).cache()
        got = [tuple(r) for r in runs.settle(stream, min_units, keep_first).collect()]
        stream.unpersist()
        assert sorted(got, key=sort_key) == sorted(want, key=sort_key), (min_units, keep_first, each)


def test_bitmap_round_trip():
    rng = random.Random(1)
    for n in (1, 7, 8, 9, 1000):
        gone = sorted(rng.sample(range(n), rng.randint(1, n)))
        assert [i for i, k in enumerate(line_dedup.unpack(line_dedup.pack(gone), n)) if not k] == gone


@pytest.mark.parametrize("period", [1, 2, 3, 7, 13, 21, 40])
def test_difference_cover(period):
    cover = substring_dedup.difference_cover(period)
    assert {(a - b) % period for a in cover for b in cover} == set(range(period))


def brute_substrings(rows, length):
    docs = {(r[0], r[1] or "") for r in rows}
    words = {d: WORD.findall(d[1]) for d in docs}
    count = Counter(tuple(w[i:i + length]) for w in words.values() for i in range(len(w) - length + 1))
    out = []
    for r in rows:
        w = words[(r[0], r[1] or "")]
        gone = set()
        for i in range(len(w) - length + 1):
            if count[tuple(w[i:i + length])] > 1:
                gone |= set(range(i, i + length))
        out.append((r[0], len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


@pytest.mark.parametrize("length,period", [(35, 21), (10, 7), (5, 5), (4, 1)])
def test_substring_dedup(spark, length, period):
    rows = awkward_rows()
    got = substring_dedup.remove_repeated(frame(spark, rows), length, period).collect()
    assert sorted(map(tuple, got), key=sort_key) == sorted(brute_substrings(rows, length), key=sort_key)


def test_empty_tables(spark, tmp_path):
    sf = write_tables(str(tmp_path / "t"), spark, [])
    for name in ("op1_simhash_near_dedup", "op2_line_dedup", "op7_substring_dedup"):
        assert QUERIES[name](spark, sf).count() == 0
    docs = frame(spark, [])
    assert simhash.keep_one(docs).count() == 0 and line_dedup.drop_lines(docs).count() == 0
