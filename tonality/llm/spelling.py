"""Spelling variants by pivotal grams.

Two words are near if they differ by exactly one inserted, deleted or replaced letter. All near
pairs of a vocabulary are found without comparing all words:

1. Bigrams are ranked by the number of places they stand at in all words, rare ones first. A word's
   *prefix* are its bigrams up to the rank of its third rarest place (ties included).
2. A dynamic program picks the word's two *pivots*: the two disjoint bigrams of the prefix with the
   smallest sum of counts. Three places always hold two disjoint bigrams, and one edit spoils one of two at most.
3. Of a near pair, the word whose prefix ends at the lower rank has pivots that rank within the prefix of the other
   word. So the pivots of every word are looked up among the prefixes of all words.
4. Position limits. Let pivot A stand before pivot B. An edit behind A leaves A and all letters before it at
   their places from the start; any other edit stands in front of B and leaves B and all behind it at
   their places from the end. What lies beyond the surviving pivot is cut in the middle, and the edit is
   in one half only, so the other half is equal too. A look-up therefore asks for a length, the place of
   the gram and equal letters in all parts an edit did not touch, as one 64-bit key.
5. Word pairs of equal keys are verified by their edit distance.

A near pair shares one of a word's 12 keys, so nothing is lost; the keys hold so much of a word that
groups stay small, and no bigram, however common, forms a group of its own. Joins are plain equi-joins
on evenly hashed keys.

Defined cases: words with fewer than three bigrams have no near words (``variants`` asks for ``min_chars`` of 4 or more);
null or empty texts have no words; a null ``doc_id`` is written as empty text in the deletion rule;
repeated rows count each time; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonality.llm.common import texts, written_once
from tonality.session import drop_scratch

# Fixed value: letters of words once A-Z are lower-cased; each fits one byte of Latin-1.
RUN = re.compile("[a-zÀ-ÿ]+")
SLICE = 1 << 20  # characters of a text read at once
HELD = 500_000  # distinct words a task holds before it gives their counts away
LETTERS = 256
PREFIX = 3  # q * edits + 1 bigrams
KEY_SCHEMA = "key long, word string, n long, last int"


def runs_of(text: str) -> Iterator[list[str]]:
    """The runs of a text, some of them at a time: a very long text is never held as a list of all its words."""
    at = 0
    while at < len(text):
        end = at + SLICE
        if end < len(text):  # a run that reaches the end of the slice belongs to it as a whole
            m = RUN.match(text, end)
            end = m.end() if m else end
        yield RUN.findall(text, at, end)
        at = end


def word_counts(docs: DataFrame, one_in: int = 31) -> DataFrame:
    """``word, n``: lower-cased (A-Z) runs of letters of all texts.

    Of a run whose ``crc32("<doc_id>:<run>")`` is divisible by ``one_in``, the letter at ``crc32 % length`` is left out
    (a stand-in for misspelt words); ``one_in=0`` leaves all runs as they are.
    """
    src = texts(docs).select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text")

    def block(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                text = (text.as_py() or "").encode().lower().decode()
                seed = zlib.crc32(f"{doc_id}:".encode())
                for runs in runs_of(text):
                    if not one_in:
                        counts.update(runs)
                        continue
                    for word, n in Counter(runs).items():
                        crc = zlib.crc32(word.encode(), seed)
                        if crc % one_in == 0:
                            k = crc % len(word)
                            word = word[:k] + word[k + 1:]
                        counts[word] += n
                    if len(counts) > HELD:
                        yield block(counts)
                        counts = Counter()
        if counts:
            yield block(counts)
    return src.mapInArrow(run, "word string, n long").where("word <> ''").groupBy("word").agg(F.sum("n").alias("n"))


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words as matrices of letters (one row per word, one matrix per length) and their row numbers."""
    words = [w.encode("latin-1") for w in batch.column("word").to_pylist()]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        yield rows, np.frombuffer(b"".join([words[i] for i in rows]), np.uint8).reshape(len(rows), size)


def _grams(letters: np.ndarray) -> np.ndarray:
    return letters[:, :-1].astype(np.int64) * LETTERS + letters[:, 1:]


def gram_counts(words: DataFrame) -> np.ndarray:
    """Places at which each bigram stands, over all words: an array of 256 * 256 numbers, whatever the input."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LETTERS * LETTERS, np.int64)
        for batch in batches:
            for _, letters in _by_length(batch):
                if letters.shape[1] > 1:
                    total += np.bincount(_grams(letters).ravel(), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["gram", "n"])
    sums = words.select("word").mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    out = np.zeros(LETTERS * LETTERS, np.int64)
    for gram, n in sums.collect():  # at most 90 * 90 rows
        out[gram] = n
    return out


def _scrambled(x: np.ndarray) -> np.ndarray:
    """Evenly spread 64-bit numbers for numbers (splitmix64)."""
    x = (x + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _placed(letters: np.ndarray, salt: int) -> np.ndarray:
    """A number for every letter at its column."""
    return _scrambled(np.arange(letters.shape[1], dtype=np.uint64) * np.uint64(LETTERS) + np.uint64(salt << 40) + letters)


class Ends:
    """Hashes of what stands at the two ends of words: ``front(k)`` of the first k letters, ``back(k)`` of the last k."""

    def __init__(self, letters: np.ndarray) -> None:
        n = len(letters)
        zero = np.zeros((n, 1), np.uint64)
        self._front = np.concatenate([zero, np.cumsum(_placed(letters, 1), axis=1, dtype=np.uint64)], axis=1)
        self._back = np.concatenate([zero, np.cumsum(_placed(letters[:, ::-1], 2), axis=1, dtype=np.uint64)], axis=1)

    def front(self, rows: np.ndarray, k: np.ndarray) -> np.ndarray:
        return self._front[rows, k]

    def back(self, rows: np.ndarray, k: np.ndarray) -> np.ndarray:
        return self._back[rows, k]


def _key(kind: int, size: int, place: np.ndarray, *parts: np.ndarray) -> np.ndarray:
    """One number for a kind of look-up, a word length, a place and hashes of letters."""
    out = _scrambled(place.astype(np.uint64) * np.uint64(4) + np.uint64(kind) + np.uint64(size << 32))
    for part in parts:
        out = (out ^ part) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def _keys(ends: Ends, size: int, rows: np.ndarray, place: np.ndarray, behind: bool, wanted: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and keys by which words of ``size`` letters meet words of ``wanted`` letters.

    ``behind``: the bigram stands at ``place`` from the start and the edit lies behind it; else at ``place`` from the end (its
    first letter included), and the edit lies in front. ``beyond`` letters of the wanted word lie on the edit's
    side; an edit within one half of them leaves the other half as it is.
    """
    fixed = place + 2 if behind else place  # letters from the word's end on the gram's side up to and with the gram
    beyond = wanted - fixed
    half = beyond // 2
    fits = beyond >= 0
    if behind:
        near = fixed + half  # the front up to the middle is equal
        for ok, kind in ((fits & (near <= size), 0), (fits & (wanted - near <= size), 1)):
            r, a, t = rows[ok], fixed[ok], near[ok]
            yield r, (_key(0, wanted, a, ends.front(r, t)) if kind == 0 else _key(1, wanted, a, ends.front(r, a), ends.back(r, wanted - t)))
    else:
        for ok, kind in ((fits & (wanted - half <= size), 2), (fits & (half <= size), 3)):
            r, a, t = rows[ok], fixed[ok], half[ok]
            yield r, (_key(2, wanted, a, ends.back(r, wanted - t)) if kind == 2 else _key(3, wanted, a, ends.front(r, t), ends.back(r, a)))


def pivots(letters: np.ndarray, weight: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each word: which places belong to its prefix, the rank the prefix ends at, and the places of its pivots A < B."""
    grams = _grams(letters)
    ranks = rank[grams]
    last = np.partition(ranks, PREFIX - 1, axis=1)[:, PREFIX - 1]
    within = ranks <= last[:, None]
    cost = np.where(within, weight[grams], np.iinfo(np.int64).max // 4)
    # best[j]: the cheapest first pivot at j or before; with a second one at j + 2 or later
    best = np.minimum.accumulate(cost, axis=1)
    second = np.argmin(best[:, :-2] + cost[:, 2:], axis=1) + 2
    upto = np.where(np.arange(cost.shape[1])[None, :] <= (second - 2)[:, None], cost, np.iinfo(np.int64).max)
    return within, last, np.argmin(upto, axis=1), second


def look_ups(words: DataFrame, counts: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """The keys of all prefixes (the index) and of all pivots (the queries)."""
    order = np.lexsort((np.arange(len(counts)), counts))
    rank = np.empty(len(counts), np.int64)
    rank[order] = np.arange(len(counts))
    shared = words.sparkSession.sparkContext.broadcast((counts, rank))

    def emit(of_pivots: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            weight, ranks = shared.value
            for batch in batches:
                for at, letters in _by_length(batch):
                    size = letters.shape[1]
                    if size < PREFIX + 1:
                        continue
                    within, last, first, second = pivots(letters, weight, ranks)
                    ends = Ends(letters)
                    out = []
                    if of_pivots:
                        rows = np.arange(len(at))
                        for wanted in (size - 1, size, size + 1):
                            out += _keys(ends, size, rows, first, True, wanted)
                            out += _keys(ends, size, rows, size - second, False, wanted)
                    else:
                        rows, places = np.nonzero(within)
                        out += _keys(ends, size, rows, places, True, size)
                        out += _keys(ends, size, rows, size - places, False, size)
                    rows = np.concatenate([r for r, _ in out])
                    key = np.concatenate([k for _, k in out])
                    which = pa.array(at[rows])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key), batch.column("word").take(which), batch.column("n").take(which),
                         pa.array(last[rows].astype(np.int32))], names=["key", "word", "n", "last"])
        return words.mapInArrow(run, KEY_SCHEMA)
    return emit(False), emit(True)


def near_pairs(words: DataFrame) -> DataFrame:
    """``word, n, near, near_n``: every near pair of the distinct ``word``s, in both directions."""
    index, asked = look_ups(words, gram_counts(words))
    a, b = asked.alias("a"), index.alias("b")
    met = a.join(b, "key").where(
        (F.col("b.last") >= F.col("a.last")) & (F.abs(F.length("a.word") - F.length("b.word")) <= 1)
        & (F.levenshtein("a.word", "b.word", 1) == 1))
    small = F.col("a.word") < F.col("b.word")
    pick = lambda name, yes, no: F.when(small, F.col(yes)).otherwise(F.col(no)).alias(name)
    pairs = met.select(pick("w1", "a.word", "b.word"), pick("n1", "a.n", "b.n"), pick("w2", "b.word", "a.word"), pick("n2", "b.n", "a.n"))
    pairs = pairs.groupBy("w1", "w2").agg(F.first("n1").alias("n1"), F.first("n2").alias("n2"))
    both = F.array(F.struct(F.col("w1").alias("word"), F.col("n1").alias("n"), F.col("w2").alias("near"), F.col("n2").alias("near_n")),
                   F.struct(F.col("w2").alias("word"), F.col("n2").alias("n"), F.col("w1").alias("near"), F.col("n1").alias("near_n")))
    return pairs.select(F.explode(both).alias("p")).select("p.*")


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for rows ``word, form``: forms followed to the last, twice as far with each round.

    A form is at least twice as frequent as its word, so no chain is longer than the bits of a count.
    """
    reach = written_once(lambda: forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        step = reach.select(F.col("word").alias("root"), F.col("root").alias("further"))
        joined = reach.join(step, "root", "left")
        longer = written_once(lambda joined=joined: joined.select("word", F.coalesce("further", "root").alias("root"),
                                                                  F.col("further").isNotNull().alias("moved")), "spelling-roots")
        moved = longer.where("moved").limit(1).count()
        drop_scratch(reach)
        reach = longer
        if not moved:
            return reach.select("word", "root")


def variants(docs: DataFrame, min_chars: int = 7, min_count: int = 2, ratio: int = 10, one_in: int = 31) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every distinct word of ``min_chars`` letters and ``min_count`` occurrences.

    ``form`` is the near word of largest n (ties: the smallest word) if its n is at least ``ratio`` (2 or more) times the word's.
    """
    if min_chars < PREFIX + 1 or ratio < 2:
        raise ValueError("min_chars must be 4 or more and ratio 2 or more")
    counted = word_counts(docs, one_in).where((F.length("word") >= min_chars) & (F.col("n") >= min_count))
    words = written_once(lambda: counted, "spelling-words")
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("form")))
    grouped = near_pairs(words).groupBy("word").agg(F.first("n").alias("n"), F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    is_form = -F.col("best.minus") >= ratio * F.col("n")
    found = written_once(lambda: grouped.select("word", "n_near", F.when(is_form, F.col("best.form")).alias("form"),
                                                F.when(is_form, -F.col("best.minus")).alias("form_n")), "spelling-near")
    root = roots(found.where("form IS NOT NULL"))
    return (words.join(found, "word", "left").join(root, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n",
                    F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("form_n").cast("long").alias("form_n")))
