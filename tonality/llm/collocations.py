"""Phrase collocations from a weighted de Bruijn graph.

Only the longest grams, three words, are counted in the texts: an *edge* ``w1 w2 w3`` leads from the
node ``w1 w2`` to the node ``w2 w3``. Every piece ends in two end marks (empty words), so its last pair of words
and its last word have edges of their own.

1. Every task sums the edges of about a million words at a time; the sums are shuffled once, in packed
   rows, to buckets by node. A node that holds one in 10,000 edges of a small sample or more is dealt to all
   buckets by its third word (the sample steers this only, never a count).
2. Shorter counts come from the flow: a pair of words occurs as often as edges leave its node, those to
   an end mark (the piece-end correction) included; a word as often as edges leave its nodes. Each
   bucket is added up once and gives its edges and pairs of ``min_count`` or more and its share of the word counts.
3. Edges of ``min_count`` or more form the graph of candidates. Nodes with one edge in and one out are *unary*;
   the paths through them are compacted: each edge learns the first edge of its path and its place, twice as far in
   each round. Along a path an edge's far node and a node's edges are read from the neighbour; only
   the ends of paths look their far node up.
4. Candidates are scored by their weakest cut, dropped where a longer candidate explains them, and
   ranked per language: first in salted parts, then the best of all parts, so no task holds more than the
   best rows of every part.

Scores are exact: products are
decimals of 38 digits (counts up to 10**15), and the quotient is an integer division.

Defined cases: null text is empty and has no pieces; null language is ``und``; a piece of one or two words has no
gram of three, but its shorter ones count; ties in the ranking go to the larger count, then to the
smaller phrase in UTF-8 byte order, so ranks are unique; repeated rows count each time; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonality.llm.common import column_bytes, written_once
from tonality.session import drop_scratch

# Fixed value: the contract's ends of pieces.
ENDS = b".,;:!?\n\v\f\r"
MARK = b"\xff"  # never part of UTF-8 text: stands for an end of piece
TO_MARK = bytes.maketrans(ENDS, MARK * len(ENDS))
CUT = re.compile(b"[" + re.escape(ENDS) + b" \t]")
SLICE = 1 << 22  # bytes of a text split into words at once
TOKENS = 1 << 20  # words a task gathers before it sums their edges
ROWS = 1 << 16  # of a batch that leaves a task
BLOCK = 1 << 18  # rows added up together
BUCKETS = 8  # for each shuffle partition
EDGE = ["lang", "w1", "w2", "w3"]
PART = 64  # edges of a path read together
SALTS = 64


class Numbers(dict):
    """Numbers words as they come; 0 is the end mark."""

    def __init__(self) -> None:
        super().__init__({MARK: 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def tokens(text: bytes, numbers: Numbers) -> Iterator[np.ndarray]:
    """The numbered words of a text with end marks between pieces, a slice of the text at a time, and two marks at its end."""
    text = text.lower()  # of bytes: A-Z only
    at = 0
    while at < len(text):
        cut = CUT.search(text, at + SLICE)
        end = cut.end() if cut else len(text)
        words = text[at:end].translate(TO_MARK).replace(MARK, b" \xff ").split()
        yield np.fromiter(map(numbers.__getitem__, words), np.int32, len(words))
        at = end
    yield np.zeros(2, np.int32)


def summed(sequence: np.ndarray, lang: np.ndarray, words: int) -> tuple[np.ndarray, ...]:
    """``lang, w1, w2, w3, n`` of the distinct edges of a token sequence that ends in two marks."""
    at = np.flatnonzero(sequence)
    first, second = sequence[at].astype(np.int64), sequence[at + 1]
    third = np.where(second > 0, sequence[np.minimum(at + 2, len(sequence) - 1)], 0)
    pair, of = np.unique((lang[at] * words + first) * words + second, return_inverse=True)
    edge, n = np.unique(of * words + third, return_counts=True)
    pair, third = pair[edge // words], edge % words
    return pair // (words * words), pair // words % words, pair % words, third, n


class Sums:
    """The distinct edges of some documents: numbers of languages and words, their names, and counts."""

    def __init__(self, langs: dict[str, int], numbers: Numbers, parts: list[np.ndarray], of: list[np.ndarray]) -> None:
        self.lang, self.w1, self.w2, self.w3, self.n = summed(np.concatenate(parts), np.concatenate(of), len(numbers))
        self.langs, self.numbers, self.listed = langs, numbers, list(numbers)
        self.names = pa.array(list(langs), pa.string())
        self.words = pa.array([b"", *self.listed[1:]], pa.binary()).cast(pa.string())

    def columns(self, rows) -> list[pa.Array]:
        return [self.names.take(pa.array(self.lang[rows])), *(self.words.take(pa.array(w[rows])) for w in (self.w1, self.w2, self.w3)),
                pa.array(self.n[rows].astype(np.int64))]

    def hot(self, nodes: list[tuple[str, bytes, bytes]]) -> np.ndarray:
        """Which edges leave one of the ``nodes``."""
        size = len(self.numbers)
        known = [(self.langs[x], self.numbers[y], self.numbers[z]) for x, y, z in nodes
                 if x in self.langs and y in self.numbers and z in self.numbers]
        return np.isin((self.lang * size + self.w1) * size + self.w2, [(x * size + y) * size + z for x, y, z in known])

    def buckets(self, hot: np.ndarray, count: int) -> np.ndarray:
        """The same number for all edges of a node, wherever they are counted; for hot nodes by the third word too."""
        of_word = np.fromiter(map(zlib.crc32, self.listed), np.uint64, len(self.listed))
        of_lang = np.fromiter((zlib.crc32(x.encode()) for x in self.langs), np.uint64, len(self.langs))
        h = of_lang[self.lang]
        for word in (of_word[self.w1], of_word[self.w2], np.where(hot, of_word[self.w3], np.uint64(0))):
            h = (h ^ word) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return (h % np.uint64(count)).astype(np.int32)


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[Sums]:
    """The edges of a task's documents, about ``TOKENS`` words at a time."""
    langs, numbers, parts, of, held = {}, Numbers(), [], [], 0
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), column_bytes(batch, "text")):
            if not text:
                continue
            number = langs.setdefault(lang, len(langs))
            for part in tokens(text, numbers):
                parts.append(part)
                of.append(np.full(len(part), number, np.int32))
                held += len(part)
            if held > TOKENS:
                yield Sums(langs, numbers, parts, of)
                langs, numbers, parts, of, held = {}, Numbers(), [], [], 0
    if parts:
        yield Sums(langs, numbers, parts, of)


def _source(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))


def edges(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``lang, w1, w2, w3, n``: grams of three words, summed within tasks; empty words are end marks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sums in gathered(batches):
            for i in range(0, len(sums.n), ROWS):
                yield pa.RecordBatch.from_arrays(sums.columns(slice(i, i + ROWS)), names=[*EDGE, "n"])
    return _source(docs, text_col, lang_col).mapInArrow(run, "lang string, w1 string, w2 string, w3 string, n long")


def packed_edges(docs: DataFrame, hot: list[tuple[str, str, str]], buckets: int, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The same, a row per bucket: each column lists the values of many edges, joined by spaces (words hold none).

    Sorted lists shuffle in a third of the bytes that a row per edge would take.
    """
    nodes = [(lang, w1.encode(), w2.encode()) for lang, w1, w2 in hot]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sums in gathered(batches):
            is_hot = sums.hot(nodes)
            bucket = sums.buckets(is_hot, buckets) * 2 + is_hot  # edges of hot nodes in rows of their own
            order = np.argsort(bucket, kind="stable")
            starts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
            offsets = pa.array(np.append(starts, len(order)).astype(np.int32))
            for i in range(0, len(starts), 64):
                at = slice(int(starts[i]), int(offsets[min(i + 64, len(starts))].as_py()))
                lists = pc.subtract(offsets.slice(i, min(64, len(starts) - i) + 1), at.start)
                cols = [pc.binary_join(pa.ListArray.from_arrays(lists, c.cast(pa.string())), " ") for c in sums.columns(order[at])]
                rows = bucket[order[starts[i:i + 64]]]
                yield pa.RecordBatch.from_arrays([pa.array(rows // 2, pa.int32()), pa.array(rows % 2 == 1), *cols], names=["bucket", "hot", *EDGE, "n"])
    return _source(docs, text_col, lang_col).mapInArrow(run, "bucket int, hot boolean, lang string, w1 string, w2 string, w3 string, n string")


def hot_nodes(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", rows: int = 2000, share: float = 0.0001) -> list[tuple[str, str, str]]:
    """Nodes that ``share`` of all edges of about ``rows`` random documents leave: at most ``1 / share``."""
    sample = docs.select(F.col(lang_col), F.col(text_col)).sample(min(1.0, rows / max(docs.count(), 1)), 1)
    leaving = edges(sample, text_col, lang_col).groupBy("lang", "w1", "w2").agg(F.sum("n").alias("n"))
    leaving = written_once(lambda: leaving, "collocations-sample")
    least = max(1, (leaving.agg(F.sum("n")).first()[0] or 0) * share)
    out = [tuple(r) for r in leaving.where((F.col("n") >= least) & (F.col("w2") != "")).select("lang", "w1", "w2").collect()]
    drop_scratch(leaving)
    return out


def _settled(batches: Iterator[pa.RecordBatch], min_count: int) -> Iterator[pa.RecordBatch]:
    """What the flow of a partition gives, one bucket (and hot part of a bucket) after the other."""
    held: list[pa.Table] = []
    words: list[pa.Table] = []
    bucket = None

    def total(t: pa.Table, by: list[str]) -> pa.Table:
        return t.group_by(by, use_threads=False).aggregate([("n", "sum")]).rename_columns([*by, "n"])

    def rows(t: pa.Table, kind: int) -> Iterator[pa.RecordBatch]:
        blank = pa.array([""] * len(t), pa.string())
        cols = [pa.array([kind] * len(t), pa.int32())] + [t[c] if c in t.column_names else blank for c in [*EDGE, "n"]]
        yield from pa.table(cols, names=["kind", *EDGE, "n"]).to_batches(max_chunksize=ROWS)

    def give(t: pa.Table, hot: bool) -> Iterator[pa.RecordBatch]:
        edge = total(t, EDGE)
        node = total(edge, ["lang", "w1", "w2"])
        words.append(total(node, ["lang", "w1"]))
        if sum(map(len, words)) > 4 * BLOCK:
            words[:] = [total(pa.concat_tables(words), ["lang", "w1"])]
            if len(words[0]) > 2 * BLOCK:
                yield from rows(words.pop(), 1)
        yield from rows(edge.filter((pc.field("n") >= min_count) & (pc.field("w3") != "")), 3)
        yield from rows(node.filter((pc.field("n") >= (0 if hot else min_count)) & (pc.field("w2") != "")), 2)

    for b in batches:
        keys = list(zip(b.column("bucket").to_pylist(), b.column("hot").to_pylist()))
        ends = [i for i in range(1, len(keys) + 1) if i == len(keys) or keys[i] != keys[i - 1]]
        for start, end in zip([0, *ends], ends):
            if held and keys[start] != bucket:
                yield from give(pa.concat_tables(held), bucket[1])
                held = []
            bucket = keys[start]
            cols = [pc.list_flatten(pc.split_pattern(b.column(c).slice(start, end - start), " ")) for c in [*EDGE, "n"]]
            held.append(pa.table([*cols[:4], cols[4].cast(pa.int64())], names=[*EDGE, "n"]))
            if len(held) > 1 and sum(map(len, held)) > BLOCK:  # a large bucket is added up as it comes
                held = [total(pa.concat_tables(held), EDGE)]
    if held:
        yield from give(pa.concat_tables(held), bucket[1])
    if words:
        yield from rows(total(pa.concat_tables(words), ["lang", "w1"]), 1)


def flow(docs: DataFrame, min_count: int = 10, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Rows ``kind, lang, w1, w2, w3, n``: edges (3) and nodes (2) of ``min_count`` or more, shares of word counts (1).

    Edges are whole; the rows of a hot node and of a word are to be added up.
    """
    buckets = BUCKETS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = packed_edges(docs, hot_nodes(docs, text_col, lang_col), buckets, text_col, lang_col)
    dealt = found.repartition("bucket").sortWithinPartitions("bucket", "hot")
    return dealt.mapInArrow(lambda batches: _settled(batches, min_count), "kind int, lang string, w1 string, w2 string, w3 string, n long")


def name(*cols: str) -> Column:
    """Words hold no spaces, so the joined words name a phrase."""
    return F.concat_ws(" ", *cols)


def links(heavy: DataFrame) -> DataFrame:
    """``lang, id, up``: the edge (named by its words) that leaves a unary node and the one that enters it."""
    out = heavy.groupBy("lang", "w1", "w2").agg(F.count(F.lit(1)).alias("outs"), F.first("w3").alias("next")).where("outs = 1")
    into = (heavy.groupBy("lang", F.col("w2").alias("w1"), F.col("w3").alias("w2"))
            .agg(F.count(F.lit(1)).alias("ins"), F.first("w1").alias("before")).where("ins = 1"))
    both = out.join(into, ["lang", "w1", "w2"]).select("lang", name("w1", "w2", "next").alias("id"), name("before", "w1", "w2").alias("up"))
    return both.where("id <> up")


def walk(linked: DataFrame) -> DataFrame:
    """``lang, id, head, place``: the first edge of the path of each linked edge and the steps from it.

    Pointers double their reach in each round. A circle of unary nodes has no first edge: when a round settles
    nothing, only circles are left, and they go on until each knows its smallest edge, which becomes the first.
    """
    start = linked.select("lang", "id", "up", F.lit(1).cast("long").alias("place"), F.col("id").alias("low"), F.lit(False).alias("done"))
    state = written_once(lambda: start, "collocations-walk")
    left = changed = None
    while True:
        b = state.select("lang", F.col("id").alias("up"), F.col("up").alias("b_up"), F.col("place").alias("b_place"),
                         F.col("low").alias("b_low"), F.col("done").alias("b_done"))
        joined = state.join(b, ["lang", "up"], "left")
        met = F.col("b_up").isNotNull() & ~F.col("done")
        lower = met & (F.col("b_low") < F.col("low"))
        step = joined.select("lang", "id", F.when(met, F.col("b_up")).otherwise(F.col("up")).alias("up"),
                             F.when(met, F.col("place") + F.col("b_place")).otherwise(F.col("place")).alias("place"),
                             F.when(lower, F.col("b_low")).otherwise(F.col("low")).alias("low"),
                             (F.col("done") | F.col("b_up").isNull() | F.col("b_done")).alias("done"), lower.alias("moved"))
        reach = written_once(lambda step=step: step, "collocations-walk")
        drop_scratch(state)
        state = reach
        last = left
        left, changed = state.where("NOT done").agg(F.count(F.lit(1)), F.count(F.when(F.col("moved"), 1))).first()
        if not left or left == last and not changed:
            break
    done = state.where("done").select("lang", "id", F.col("up").alias("head"), "place")
    if not left:
        return done
    circles = state.where("NOT done AND id <> low").select("lang", "id").join(linked, ["lang", "id"])
    return done.unionByName(walk(circles))


def compact(heavy: DataFrame) -> DataFrame:
    """``heavy`` edges with ``head`` (the first edge of their path) and ``place`` in it (from 0)."""
    linked = written_once(lambda: links(heavy), "collocations-links")
    return (heavy.withColumn("id", name("w1", "w2", "w3")).join(walk(linked), ["lang", "id"], "left")
            .withColumn("head", F.coalesce("head", "id")).withColumn("place", F.coalesce("place", F.lit(0).cast("long"))).drop("id"))


def paths(docs: DataFrame, min_count: int = 10, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``lang, head, part, words, counts``: the compacted paths of edges found ``min_count`` times or more.

    These are the repeated passages: ``words`` space-joined, ``counts`` of the edges in turn. Long paths come in parts of
    64 edges, so that no row grows with the input.
    """
    found = compact(written_once(lambda: flow(docs, min_count, text_col, lang_col).where("kind = 3").drop("kind"), "collocations-heavy"))
    row = F.struct("place", "w1", "w2", "w3", "n")
    parts = found.groupBy("lang", "head", F.expr(f"place div {PART}").alias("part")).agg(F.array_sort(F.collect_list(row)).alias("e"))
    words = F.concat(F.transform("e", lambda x: x["w1"]), F.array(F.element_at("e", -1)["w2"], F.element_at("e", -1)["w3"]))
    return parts.select("lang", "head", "part", F.array_join(words, " ").alias("words"), F.transform("e", lambda x: x["n"]).alias("counts"))


def score(a: Column, left: Column, right: Column) -> Column:
    """``floor(1000000 * a * a / (left * right))``, exact."""
    d = lambda c: c.cast("decimal(16,0)")
    top = (d(a) * d(a)).cast("decimal(31,0)") * F.lit(1000000).cast("decimal(7,0)")
    return F.call_function("div", top.cast("decimal(38,0)"), (d(left) * d(right)).cast("decimal(38,0)"))


def collocations(docs: DataFrame, min_count: int = 10, cover: int = 50, top: int = 2000, text_col: str = "text",
                 lang_col: str = "lang") -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``top`` phrases of two or three words of each language.

    ``a`` counts the phrase, ``l`` and ``r`` the parts of its lowest-scoring cut (ties: the first), ``n`` all words of the
    language. A phrase goes if a longer one of ``min_count`` or more that contains it has ``cover`` per cent of its count.
    """
    found = written_once(lambda: flow(docs, min_count, text_col, lang_col), "collocations-flow")
    words = written_once(lambda: found.where("kind = 1").groupBy("lang", "w1").agg(F.sum("n").alias("n")), "collocations-words")
    one = words.where(F.col("n") >= min_count)
    pairs = found.where("kind = 2").groupBy("lang", "w1", "w2").agg(F.sum("n").alias("n12")).where(F.col("n12") >= min_count)
    nodes = written_once(lambda: pairs.join(one.select("lang", "w1", F.col("n").alias("n1")), ["lang", "w1"])
                         .join(one.select("lang", F.col("w1").alias("w2"), F.col("n").alias("n2")), ["lang", "w2"]), "collocations-nodes")
    heavy = written_once(lambda: found.where("kind = 3").drop("kind").join(nodes, ["lang", "w1", "w2"]), "collocations-heavy")

    # along a path the neighbours tell the far node and the other edge of a node
    path = Window.partitionBy("lang", "head", F.expr(f"place div {PART}")).orderBy("place")
    on_path = written_once(lambda: compact(heavy).select(
        "lang", "w1", "w2", "w3", "n", "n1", "n12", F.lead("n12").over(path).alias("n23"), F.lead("n2").over(path).alias("n3"),
        F.lag("n").over(path).alias("before")), "collocations-paths")
    ends = on_path.where("n23 IS NULL").drop("n23", "n3").join(
        nodes.select("lang", F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("n12").alias("n23"), F.col("n2").alias("n3")),
        ["lang", "w2", "w3"])
    cuts = on_path.where("n23 IS NOT NULL").unionByName(ends)
    first, second = score(F.col("n"), F.col("n1"), F.col("n23")), score(F.col("n"), F.col("n12"), F.col("n3"))
    pick = lambda x, y: F.when(F.col("s1") <= F.col("s2"), x).otherwise(y)
    three = (cuts.withColumn("s1", first).withColumn("s2", second)
             .select("lang", name("w1", "w2", "w3").alias("phrase"), F.col("n").alias("a"), pick(F.col("n1"), F.col("n12")).alias("l"),
                     pick(F.col("n23"), F.col("n3")).alias("r"), F.least("s1", "s2").alias("score")))

    longer = (on_path.select("lang", "w1", "w2", F.greatest("n", F.coalesce("before", "n")).alias("longer"))
              .unionByName(on_path.where("n23 IS NULL").select("lang", F.col("w2").alias("w1"), F.col("w3").alias("w2"), F.col("n").alias("longer")))
              .groupBy("lang", "w1", "w2").agg(F.max("longer").alias("longer")))
    two = (nodes.join(longer, ["lang", "w1", "w2"], "left").where(F.expr(f"longer IS NULL OR 100 * longer < {int(cover)} * n12"))
           .select("lang", name("w1", "w2").alias("phrase"), F.col("n12").alias("a"), F.col("n1").alias("l"), F.col("n2").alias("r"))
           .withColumn("score", score(F.col("a"), F.col("l"), F.col("r"))))

    best = [F.desc("score"), F.desc("a"), "phrase"]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    ranked = (three.unionByName(two).withColumn("rank", F.row_number().over(Window.partitionBy("lang", salt).orderBy(*best))).where(F.col("rank") <= top)
              .withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best))).where(F.col("rank") <= top))
    total = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return ranked.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
