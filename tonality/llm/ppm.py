"""Language-model scoring by prediction by partial matching (PPM) over bytes.

The model is a byte-context trie: how often each symbol followed each context of up to ``order``
symbols in the training texts (symbols: the 256 byte values and one end of text, which also
stands before a text's start). A symbol unseen in a context escapes to the next shorter one
(escape estimation of method D: of the weight ``2 T`` of a context seen ``T`` times with ``d``
different symbols, ``d`` goes to the escape and ``2 c - 1`` to a symbol seen ``c`` times; a context that leaves
no symbol to escape to has no escape); symbols that the longer context has ruled out are excluded
there, so no probability is spent on them. Below order 0
the unseen symbols share evenly. The score is the log10 probability of all bytes and the end.

How it runs: documents are dealt into blocks of about ``block_bytes``. A block lists its distinct
``order + 1``-grams and words once, with their training counts; these lists are the only thing that is
shuffled by key. Grams are summed, priced (a partition holds all grams whose context ends in the same three
symbols, at most 257**3 per such end at the default order, and gets the three-symbol counts that their second order needs by
a join; orders 0 and 1, at most 257 and 257**2 counts, are the only shared
tables) and sent back to the blocks that asked. There a task streams: the answers of a block come first and fill one
hash table, its texts follow batch by batch, and each document adds up its prices. No
table of the corpus reaches the driver or is broadcast.

``adaptive_cost`` prices a text by what came before it in the same text, without a corpus.

Defined cases: null text is empty and has one token, the end; without training rows every
count is 0 and bytes cost the even share; rows with the same id and text are all counted in
training; equal rows get equal scores; a null ``doc_id`` is an id whose text form is empty; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonality.llm.common import arrow_map, column_bytes, text_hash, texts, written_once
from tonality.session import drop_scratch

BITS, END, SYMBOLS = 9, 256, 257
LOW = (1 << BITS) - 1
CHUNK = 1 << 21  # bytes sorted at a time
PIECE = 1 << 19  # bytes priced at a time
LISTED = 1 << 21  # grams of chunks held before they are summed
END_WORD = b"\n"  # stands for the end of a text among the words; no word holds white space
GRAM, WORD, TEXT = 0, 1, 2


def mask(symbols: int) -> int:
    return (1 << BITS * symbols) - 1


def grams(data: bytes, order: int) -> np.ndarray:
    """For each byte and the end: the ``order`` symbols before it and itself, packed, oldest first."""
    s = np.full(len(data) + order + 1, END, np.int64)
    s[order:-1] = np.frombuffer(data, np.uint8)
    n = len(data) + 1
    out = np.zeros(n, np.int64)
    for j in range(order + 1):
        out = out << BITS | s[j:j + n]
    return out


def joint_grams(texts_: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The grams of several texts laid out one after another, and where each text's begin and end (begin, end, begin, ...).

    The places between an end and the next begin hold grams that belong to no text.
    """
    sizes = np.fromiter(map(len, texts_), np.int64, len(texts_))
    gap = max(order, 1)
    begins = order + np.concatenate([[0], np.cumsum(sizes + gap)[:-1]]) if len(texts_) else sizes
    s = np.full(int(sizes.sum()) + gap * len(texts_) + order, END, np.int64)
    for at, data in zip(begins.tolist(), texts_):
        s[at:at + len(data)] = np.frombuffer(data, np.uint8)
    n = len(s) - order
    out = s[:n].copy()
    for j in range(1, order + 1):
        out <<= BITS
        out |= s[j:j + n]
    return out, np.stack([begins - order, begins - order + sizes + 1], 1).ravel()


class Table:
    """Values by 64-bit key in open addressing, half full at most; repeated keys must have equal values."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.at = np.full(1 << bits, -1, np.int32)
        self.keys, self.values = keys, values
        left, slot = np.arange(len(keys), dtype=np.int32), self._slot(keys)
        while len(left):
            free = self.at[slot] < 0
            self.at[slot[free]] = left[free]  # of several keys for one slot the last stays
            lost = keys[self.at[slot]] != keys[left]
            left, slot = left[lost], slot[lost] + 1 & self.last

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        # Fixed value: an odd multiplier near 2**64 over the golden ratio
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).view(np.int64)

    def get(self, wanted: np.ndarray) -> np.ndarray:
        """The value of each wanted key; 0 where it is missing."""
        out = np.zeros(len(wanted), self.values.dtype)
        if not len(self.keys):
            return out
        slot = self._slot(wanted)
        at = self.at[slot]
        hit = self.keys[at] == wanted  # an empty slot (-1) reads the last key: right only if that key is wanted
        hit &= at >= 0
        np.copyto(out, self.values[at], where=hit)
        left = np.flatnonzero(~hit & (at >= 0))
        slot = slot[left]
        while len(left):
            slot = slot + 1 & self.last
            at = self.at[slot]
            hit = (at >= 0) & (self.keys[at] == wanted[left])
            out[left[hit]] = self.values[at[hit]]
            on = ~hit & (at >= 0)
            left, slot = left[on], slot[on]
        return out


def summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of their weights."""
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], weights[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(weights, first) if len(keys) else weights


def look_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The value of each wanted key; 0 where it is missing."""
    if not len(keys):
        return np.zeros(len(wanted), values.dtype)
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return np.where(keys[at] == wanted, values[at], 0)


class Level:
    """The counts of all grams of one length, and of their contexts: total, symbols, weight in the shorter context."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, lower: "Level | None", length: int) -> None:
        self.keys, self.counts = keys, counts
        context = keys >> BITS
        first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(keys) else np.zeros(0, np.int64)
        self.contexts = context[first]
        sums = lambda x: np.add.reduceat(x, first) if len(x) else x
        self.total = sums(counts)
        self.symbols = sums(np.ones(len(keys), np.int64))
        self.below = sums(lower.count(keys & mask(length - 1))) if lower else np.zeros(len(first), np.int64)

    def count(self, wanted: np.ndarray) -> np.ndarray:
        return look_up(self.keys, self.counts, wanted)


def levels(keys: np.ndarray, counts: np.ndarray, order: int, shared: list[tuple[np.ndarray, np.ndarray]]) -> list[Level]:
    """Levels 1 to ``order + 1``. ``shared``: keys and counts of the first levels over the whole corpus."""
    seen = counts > 0
    keys, counts = keys[seen], counts[seen]
    out: list[Level] = []
    for n in range(1, order + 2):
        table = shared[n - 1] if n <= len(shared) else summed(keys & mask(n), counts)
        out.append(Level(*table, out[-1] if out else None, n))
    return out


def price(wanted: np.ndarray, trie: list[Level]) -> np.ndarray:
    """log10 probability of the last symbol of each gram after its context."""
    order = len(trie) - 1
    out, open_ = np.zeros(len(wanted)), np.ones(len(wanted), bool)
    without, gone = np.zeros(len(wanted), np.int64), np.zeros(len(wanted), np.int64)  # excluded weight and symbols
    for j in range(order, -1, -1):
        level = trie[j]
        context = wanted >> BITS & mask(j)
        total = look_up(level.contexts, level.total, context) - without
        symbols = look_up(level.contexts, level.symbols, context) - gone
        count = level.count(wanted & mask(j + 1))
        hit, miss = open_ & (count > 0), open_ & (count == 0) & (symbols > 0)
        weight = 2 * total - symbols * (symbols + gone == SYMBOLS)  # nothing is left to escape to
        out[hit] += np.log10((2 * count[hit] - 1) / weight[hit])
        out[miss] += np.log10(symbols[miss] / weight[miss])
        open_ &= count == 0
        without = look_up(level.contexts, level.below, context)
        gone = look_up(level.contexts, level.symbols, context)
    if open_.any():
        out[open_] -= np.log10(SYMBOLS - len(trie[0].keys))
    return out


def adaptive_cost(data: bytes, order: int) -> float:
    """log10 probability of a text and its end if each symbol is priced by the symbols before it only.

    The same estimates, with a trie that learns a symbol after pricing it.
    """
    counts: dict[tuple[int, ...], dict[int, int]] = {}
    symbols = [END] * order + [*data, END]
    out = 0.0
    for i in range(order, len(symbols)):
        s, gone = symbols[i], set()
        for j in range(order, -1, -1):
            seen = counts.get(tuple(symbols[i - j:i]), {})
            left = {x: c for x, c in seen.items() if x not in gone}
            weight = 2 * sum(left.values()) - len(left) * (len(left) + len(gone) == SYMBOLS)
            if s in left:
                out += np.log10((2 * left[s] - 1) / weight)
                break
            if left:
                out += np.log10(len(left) / weight)
            gone |= seen.keys()
        else:
            out -= np.log10(SYMBOLS - len(gone))
        for j in range(order + 1):
            seen = counts.setdefault(tuple(symbols[i - j:i]), {})
            seen[s] = seen.get(s, 0) + 1
    return float(out)


def score_adaptive(docs: DataFrame, order: int = 5) -> DataFrame:
    """``doc_id, score`` per row: :func:`adaptive_cost` of each whole text (one narrow pass)."""
    src = texts(docs)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        cost = [adaptive_cost((t or b"").lower(), order) for t in column_bytes(batch, "text")]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(cost, pa.float64())], names=["doc_id", "score"])
    return arrow_map(src, run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, score double")


def words_of(data: bytes) -> list[bytes]:
    return [*data.split(), END_WORD]


def word_keys(words: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w) - (1 << 63) for w in words), np.int64, len(words))


def block_lists(rows: Iterable[tuple[bytes, bool]], order: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The distinct grams and words of a block ``(lower-cased text, in training)``, with training counts."""
    found: list[list[np.ndarray]] = [[], []]
    words: Counter = Counter()
    group, size = ([], []), 0

    def flush() -> None:
        nonlocal group, size
        for train in (0, 1):
            if group[train]:
                k, n = np.unique(np.concatenate(group[train]), return_counts=True)
                found[0].append(k)
                found[1].append(n * train)
        group, size = ([], []), 0
        if sum(map(len, found[0][1:])) > LISTED:  # the first are sums already
            found[:] = [[x] for x in summed(*map(np.concatenate, found))]

    for data, train in rows:
        group[train].append(grams(data, order))
        size += len(data)
        if size > CHUNK:
            flush()
        w = words_of(data)
        if train:
            words.update(w)
        else:
            words.update(dict.fromkeys(w, 0))
    flush()
    names = list(words)
    return {GRAM: summed(np.concatenate(found[0] or [np.zeros(0, np.int64)]), np.concatenate(found[1] or [np.zeros(0, np.int64)])),
            WORD: summed(word_keys(names), np.fromiter((words[w] for w in names), np.int64, len(names)))}


def in_training(id_col: str = "doc_id", parts: int = 5, part: int = 1):
    """False for held-out rows: ``crc32(id as text) mod parts = part`` (a null id counts as '')."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % parts != part


def _lists(dealt: DataFrame, order: int) -> DataFrame:
    """``kind, key, block, n``: every block's distinct grams and words with their training counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = []

        def rows() -> Iterator[tuple[bytes, bool]]:
            for b in batches:
                block[:] = b.column("block")[:1].to_pylist()
                for data, train in zip(column_bytes(b, "text"), b.column("train").to_pylist()):
                    yield (data or b"").lower(), train

        for kind, (keys, n) in block_lists(rows(), order).items():
            for a in range(0, len(keys), 1 << 16):
                k = keys[a:a + (1 << 16)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(k), kind, np.int32)), pa.array(k), pa.array(np.full(len(k), block[0], np.int32)),
                     pa.array(n[a:a + (1 << 16)])], names=["kind", "key", "block", "n"])
    return dealt.select("block", "text", "train").groupBy("block").applyInArrow(run, "kind int, key long, block int, n long")


def _prices(sums: DataFrame, order: int) -> DataFrame:
    """``key, value``: the price of every listed gram (``key, n``: its count in training)."""
    spark = sums.sparkSession
    pairs = sums.where("n > 0").groupBy(F.col("key").bitwiseAND(F.lit(mask(2))).alias("key")).agg(F.sum("n").alias("n"))
    two = pairs.toArrow()  # at most 257 ** 2 rows
    shared = [summed(two.column("key").to_numpy() & mask(1), two.column("n").to_numpy()),
              summed(two.column("key").to_numpy(), two.column("n").to_numpy())]
    shared = spark.sparkContext.broadcast(shared[:order + 1])
    context = lambda n: F.shiftright("key", BITS).bitwiseAND(F.lit(mask(n)))
    rows = sums.select(context(3).alias("end"), "key", "n", F.lit(False).alias("third"))
    if order > 2:
        # a context of two symbols has followers behind every symbol before it: each end that occurs gets their counts
        threes = sums.where("n > 0").groupBy(F.col("key").bitwiseAND(F.lit(mask(3))).alias("key")).agg(F.sum("n").alias("n"))
        ends = sums.select(context(3).alias("end")).distinct().withColumn("two", F.col("end").bitwiseAND(F.lit(mask(2))))
        rows = rows.unionByName(threes.withColumn("two", context(2)).join(ends, "two").select("end", "key", "n", F.lit(True).alias("third")))

    def run(batches):
        got = [[b.column(c).to_numpy(zero_copy_only=False) for c in ("key", "n", "third")] for b in batches if b.num_rows]
        if got:
            keys, n, third = (np.concatenate(x) for x in zip(*got))
            got.clear()
            tables = list(shared.value)
            if order > 2:
                k, first = np.unique(keys[third], return_index=True)
                tables.append((k, n[third][first]))
            keys, n = keys[~third], n[~third]
            trie = levels(keys, n, order, tables)
            for a in range(0, len(keys), 1 << 16):
                k = keys[a:a + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(price(k, trie))], names=["key", "value"])
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "end").select("key", "n", "third").mapInArrow(run, "key long, value double")


def _packed(answers: DataFrame) -> DataFrame:
    """``block, kind, keys, values``: the answers ``block, kind, key, value`` of each partition, packed by block."""
    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            block, kind = b.column("block").to_numpy(), b.column("kind").to_numpy()
            key, value = b.column("key").to_numpy(), b.column("value").to_numpy()
            order = np.lexsort((key, kind, block))
            block, kind, key, value = block[order], kind[order], key[order], value[order].astype(np.float64)
            starts = np.flatnonzero(np.concatenate([[True], (block[1:] != block[:-1]) | (kind[1:] != kind[:-1])]))
            stops = [*starts[1:].tolist(), len(block)]
            steps = np.diff(key, prepend=0)
            rows = [(zlib.compress(np.concatenate([key[a:a + 1], steps[a + 1:z]]).tobytes(), 1), zlib.compress(value[a:z].tobytes(), 1))
                    for a, z in zip(starts.tolist(), stops)]
            keys, values = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(block[starts]), pa.array(kind[starts]), pa.array(keys, pa.binary()),
                                              pa.array(values, pa.binary())], names=["block", "kind", "keys", "values"])
    return answers.select("block", "kind", "key", "value").mapInArrow(run, "block int, kind int, keys binary, values binary")


def _table(keys: list[bytes], values: list[bytes]) -> Table:
    k = [np.cumsum(np.frombuffer(zlib.decompress(x), np.int64)) for x in keys]
    v = [np.frombuffer(zlib.decompress(x), np.float64) for x in values]
    return Table(np.concatenate([np.zeros(0, np.int64), *k]), np.concatenate([np.zeros(0), *v]))


class Numbers(dict):
    """A running number for each new word."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Answers:
    """Prices and word counts that a block asked for, and what its texts come to."""

    def __init__(self, packed: dict[int, tuple[list[bytes], list[bytes]]], order: int, total: float, distinct: int) -> None:
        self.prices, self.words = (_table(*packed.get(kind, ([], []))) for kind in (GRAM, WORD))
        self.order, self.all = order, total + 0.5 * (distinct + 1)
        self.number = Numbers()
        self.known, self.base = np.zeros(0, np.int64), np.zeros(0)

    def costs(self, data: list[bytes]) -> np.ndarray:
        """The price of each text."""
        keys, edges = joint_grams(data, self.order)
        return np.add.reduceat(np.concatenate([self.prices.get(keys), [0.0]]), edges)[::2]

    def unigrams(self, data: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words, known words and the base score of each text."""
        lists = [words_of(t) for t in data]
        flat = list(chain.from_iterable(lists))
        seen = len(self.number)
        number = np.fromiter(map(self.number.__getitem__, flat), np.int64, len(flat))
        if len(self.number) > seen:
            count = self.words.get(word_keys(list(islice(self.number, seen, None))))
            self.known = np.concatenate([self.known, (count > 0).astype(np.int64)])
            self.base = np.concatenate([self.base, np.log10((count + 0.5) / self.all)])
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        begins = np.cumsum(sizes) - sizes
        return sizes, np.add.reduceat(self.known[number], begins), np.add.reduceat(self.base[number], begins)


def score(docs: DataFrame, order: int = 5, block_bytes: int = 24 << 20) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` per row.

    ``base_score`` is the smoothed unigram log10 probability of the words and the end, ``score`` the
    model's of the bytes and the end; both learn from the rows that are not held out.
    """
    src = texts(docs).select("doc_id", "text", in_training().alias("train"), text_hash().alias("h"))
    size = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    dealt = src.withColumn("block", F.pmod(F.hash("doc_id", "h"), F.lit(blocks)).cast("int"))
    lists = written_once(lambda: _lists(dealt, order), "ppm-lists")
    sums = lambda kind: lists.where(F.col("kind") == kind).groupBy("key").agg(F.sum("n").alias("n"))
    gram_sums = written_once(lambda: sums(GRAM), "ppm-grams")
    prices = written_once(lambda: _prices(gram_sums, order), "ppm-prices")
    drop_scratch(gram_sums)
    counts = written_once(lambda: sums(WORD).select("key", F.col("n").cast("double").alias("value")), "ppm-words")
    total, distinct = counts.agg(F.coalesce(F.sum("value"), F.lit(0.0)), F.count(F.when(F.col("value") > 0, 1))).first()
    rows = dealt.select("block", F.lit(TEXT).alias("kind"), "doc_id", F.col("text").cast("binary").alias("text"), "train")
    for kind, table in ((GRAM, prices), (WORD, counts)):
        rows = rows.unionByName(_packed(lists.where(F.col("kind") == kind).select("kind", "key", "block").join(table, "key")),
                                allowMissingColumns=True)

    def scored(mine: pa.RecordBatch, answers: Answers) -> Iterator[pa.RecordBatch]:
        sizes = pa.compute.binary_length(mine.column("text")).fill_null(0).to_pylist()
        at = 0
        while at < len(sizes):  # pieces of about PIECE bytes; no more of the batch is copied at once
            stop, size = at + 1, sizes[at]
            while stop < len(sizes) and size + sizes[stop] <= PIECE:
                size += sizes[stop] + 1
                stop += 1
            part = mine.slice(at, stop - at)
            data = [(t or b"").lower() for t in part.column("text").to_pylist()]
            n, known, base = answers.unigrams(data)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.compute.invert(part.column("train")), pa.array(n), pa.array(known),
                 pa.array(np.full(len(n), int(total), np.int64)), pa.array(base), pa.array(answers.costs(data))],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
            at = stop

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, packed, answers = None, {}, None
        for b in batches:
            ids, kinds = b.column("block").to_numpy(), b.column("kind").to_numpy()
            edges = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (kinds[1:] != kinds[:-1])])) if len(ids) else []
            for a, z in zip(edges, [*edges[1:], len(ids)]):
                part = b.slice(a, z - a)
                if ids[a] != block:
                    block, packed, answers = ids[a], {}, None
                if kinds[a] != TEXT:
                    for into, column in zip(packed.setdefault(int(kinds[a]), ([], [])), ("keys", "values")):
                        into += part.column(column).to_pylist()
                    continue
                if answers is None:
                    answers, packed = Answers(packed, order, total, distinct), {}
                yield from scored(part, answers)
    kind = src.schema["doc_id"].dataType.simpleString()
    return rows.repartition("block").sortWithinPartitions("block", "kind").mapInArrow(
        run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
