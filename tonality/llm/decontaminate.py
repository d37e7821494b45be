"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders (slots); the other words are lower-cased and
lose punctuation at both ends. A capitalised word at a sentence start is read both ways, as a name
and plain, on both sides. Windows of ``window`` template tokens of documents and benchmark
items are hash-joined; the matches of one document, item and alignment must then agree on the
slots: each benchmark value stands for one document value and the other way round. So a copy
matches, and so does a question whose numbers or names were exchanged consistently, while two
texts that only share a form do not. An alignment counts if its windows span ``min_tokens``
tokens (or the whole item, if that is shorter); with ``by_run`` also if any run of windows of that
span agrees within itself, so a value changed elsewhere in the item hides no copy.

Scale: the document side is one narrow pass. A bitmap of benchmark hashes (``2**filter_bits``
bits, a fixed size) lets only candidate windows reach the shuffle; the join itself is exact and
neither side is collected or hinted for broadcast. Windows are 64-bit hashes; an alignment needs
several of them in step.

Defined cases: null or empty text has no windows and is clean; an item of fewer than ``window``
tokens is one window of its own length; windows with fewer than half plain words (they hold nearly
only slots) match by their words, values included, not by their template; repeated rows get equal results; equal items are each
reported; empty tables on either side find nothing; a null ``doc_id`` is an id like any other;
extra columns are carried by :func:`drop_contaminated` and ignored elsewhere.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonality.llm.common import arrow_map, column_bytes, text_hash, texts, worker_state
from tonality.session import materialize

# Words read as units and as numbers.
UNITS = frozenset("""km m cm mm mi ft in yd kg g mg lb lbs oz l ml s sec secs min mins h hr hrs kb mb gb tb hz khz mhz ghz
w kw kwh v mph kph usd eur gbp kilometre kilometres kilometer kilometers metre metres meter meters mile miles foot feet
inch inches gram grams kilogram kilograms pound pounds litre litres liter liters second seconds minute minutes hour
hours day days week weeks month months year years dollar dollars euro euros cent cents percent degree degrees""".split())
NUMBERS = frozenset("""zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen
seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million""".split())

NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*%?")
MEASURE = re.compile(r"[+-]?[$€£]?(\d[\d.,:/]*)([^\W\d_]+)")
EDGE = re.compile(r"^[\W_]+|[\W_]+$")
SENTENCE_END = re.compile(r"[.!?:;][\W_]*$")
BREAK = "\0"  # stands for a line break: no token, but a sentence ends
LINE_BREAK = b" \0 "
LITERAL = np.uint64(0xD6E8FEB86659FD93)  # sets hashes of the words themselves apart
MULTIPLIER = 0x9E3779B97F4A7C15  # odd; weights of the positions in a window
VOCABULARY = 400_000  # words remembered per worker before the table starts anew
CHUNK = 1 << 22  # bytes of text worked on at a time


class Template(dict):
    """Words (UTF-8) to numbers, remembered from batch to batch; per number the template codes."""

    def __init__(self) -> None:
        super().__init__()
        self.inside = np.zeros(1 << 12, np.uint64)  # code of the template token within a sentence (0: none)
        self.first = np.zeros(1 << 12, np.uint64)  # and at its start
        self.plain = np.zeros(1 << 12, np.uint64)  # code of the word itself, for windows of mostly slots
        self.slot = np.zeros((1 << 12, 2), bool)  # whether it is a slot: within, at the start
        self.ends = np.zeros(1 << 12, bool)  # whether a sentence ends here
        self.values: dict[int, str] = {}  # of words that can be slots

    def __missing__(self, word: bytes) -> int:
        n = len(self)
        if n == len(self.ends):
            for name in ("inside", "first", "plain", "slot", "ends"):
                old = getattr(self, name)
                setattr(self, name, np.concatenate([old, np.zeros_like(old)]))
        text = word.decode()
        core = EDGE.sub("", text)
        low, inside, first = core.lower(), "", ""
        if not (core.islower() and core.isalpha()) or low in UNITS or low in NUMBERS:
            inside, first = slot_kinds(core, low)
        self.inside[n], self.first[n] = (template_code(inside, low), template_code(first, low)) if core else (0, 0)
        self.plain[n] = template_code("", low) if core else 0
        self.slot[n] = bool(inside), bool(first)
        self.ends[n] = not text.isalpha() and (text == BREAK or bool(SENTENCE_END.search(text)))
        if inside:
            self.values[n] = low
        self[word] = n
        return n


def slot_kinds(core: str, low: str) -> tuple[str, str]:
    """The slot type of a word within a sentence and at its start; empty for a plain word."""
    if NUMBER.fullmatch(core) or low in NUMBERS:
        return "num", "num"
    if low in UNITS:
        return "unit", "unit"
    if (m := MEASURE.fullmatch(core)) and m[2].lower() in UNITS:
        return "measure", "measure"
    return ("name" if core[:1].isupper() and core[1:].islower() else ""), ""


def template_code(kind: str, low: str) -> int:
    return xxhash.xxh64_intdigest(f"\0{kind}" if kind else low) | 1


@dataclass
class Tokens:
    """The template tokens of several texts in one row: codes, slot flags, name codes, word numbers, owner text, place in it."""

    code: np.ndarray
    slot: np.ndarray
    name: np.ndarray  # code as a name, of a capitalised word at a sentence start (0: no such word); ``code`` has it plain
    word: np.ndarray
    owner: np.ndarray
    place: np.ndarray
    size: np.ndarray  # tokens of each text


def tokens(template: Template, texts: list[bytes | None]) -> Tokens:
    if len(template) > VOCABULARY:
        template.clear()
        template.values.clear()
    split = [t.replace(b"\n", LINE_BREAK).split() if t else [] for t in texts]
    counts = np.fromiter(map(len, split), np.int64, len(split))
    word = np.fromiter(map(template.__getitem__, chain.from_iterable(split)), np.int64, int(counts.sum()))
    owner = np.repeat(np.arange(len(texts)), counts)
    start = np.ones(len(word), bool)
    start[1:] = (owner[1:] != owner[:-1]) | template.ends[word[:-1]]
    code = np.where(start, template.first[word], template.inside[word])
    real = code != 0
    slot = np.where(start, template.slot[word, 1], template.slot[word, 0])[real]
    name = np.where(start & template.slot[word, 0] & ~template.slot[word, 1], template.inside[word], np.uint64(0))[real]
    owner = owner[real]
    size = np.bincount(owner, minlength=len(texts))
    place = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
    return Tokens(code[real], slot, name, word[real], owner, place, size)


def weights(size: int) -> np.ndarray:
    """The odd weights of the positions in a window."""
    return np.array([pow(MULTIPLIER, j + 1, 1 << 64) for j in range(size)], np.uint64)


def window_sums(codes: np.ndarray, size: int, at: np.ndarray | None = None) -> np.ndarray:
    """Weighted sum of every window of ``size`` codes (or of those that start ``at`` some places), with the size mixed in."""
    n = len(codes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n if at is None else len(at), size, np.uint64)
    for j, weight in enumerate(weights(size)):
        out += (codes[j:j + n] if at is None else codes[at + j]) * weight
    return out


def mixed(sums: np.ndarray) -> np.ndarray:
    out = sums ^ (sums >> np.uint64(29))
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def readings(t: Tokens, sums: np.ndarray, size: int, at: np.ndarray) -> Iterator[tuple]:
    """``(windows, hashes, places of words read as names)``: capitalised words at sentence starts, each plain and as a name."""
    either = np.flatnonzero(t.name)
    before = np.concatenate([[0], np.cumsum(t.name != 0)])
    count = before[at + size] - before[at]
    weight = weights(size)
    for k in np.flatnonzero(np.bincount(count, minlength=1)).tolist():
        p = at[count == k]
        if k == 0:
            yield p, mixed(sums[p]), np.zeros((len(p), 0), np.int64)
            continue
        token = either[before[p][:, None] + np.arange(k)]  # the k such words of each window
        place = token - p[:, None]
        step = (t.name[token] - t.code[token]) * weight[place]
        for choice in range(1 << k):
            named = [j for j in range(k) if choice >> j & 1]
            yield p, mixed(sums[p] + step[:, named].sum(axis=1, dtype=np.uint64)), place[:, named]


def windows(template: Template, t: Tokens, size: int, allowed=None, whole: bool = False) -> Iterator[tuple]:
    """``(owner, hash, place, size, tokens, slot values)`` of the windows that ``allowed`` lets pass.

    A window lies within one text; with ``whole`` it is the whole text. A reading with more slots than plain
    words is left to the hash of the words themselves, whose slot values are numbers, units and measures.
    """
    sums = window_sums(t.code, size)
    n = len(sums)
    if not n:
        return
    ok = t.owner[:n] == t.owner[size - 1:]
    slots = np.concatenate([[0], np.cumsum(t.slot)])
    slots = slots[size:] - slots[:n]
    if whole:
        ok &= t.size[t.owner[:n]] == size
    for at, h, named in readings(t, sums, size, np.flatnonzero(ok)):
        left = np.arange(len(at)) if allowed is None else np.flatnonzero(allowed(h))
        for i in left[(slots[at[left]] + named.shape[1]) * 2 <= size].tolist():
            p = int(at[i])
            flags = t.slot[p:p + size].copy()
            flags[named[i]] = True
            yield _row(template, t, p, size, h[i], flags)
    names = np.concatenate([[0], np.cumsum(t.name != 0)])
    at = np.flatnonzero(ok & ((slots + names[size:] - names[:n]) * 2 > size))
    if len(at):
        h = mixed(window_sums(template.plain[t.word], size, at) ^ LITERAL)
        valued = template.slot[t.word, 1]
        for i in (range(len(at)) if allowed is None else np.flatnonzero(allowed(h)).tolist()):
            p = int(at[i])
            yield _row(template, t, p, size, h[i], valued[p:p + size])


def _row(template: Template, t: Tokens, p: int, size: int, h: np.uint64, flags: np.ndarray) -> tuple:
    values = [template.values[w] for w in t.word[p:p + size][flags].tolist()]
    owner = int(t.owner[p])
    return owner, int(h.astype(np.int64)), int(t.place[p]), size, int(t.size[owner]), values


WINDOW_SCHEMA = "hash long, pos int, size int, tokens int, slots array<string>"


def item_windows(benchmark: DataFrame, window: int = 8) -> DataFrame:
    """``item_id`` and the windows of each benchmark item."""
    src = benchmark.select("item_id", F.col("text").cast("string").alias("text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        template = Template()
        t = tokens(template, column_bytes(batch, "text"))
        rows = list(windows(template, t, window))
        for size in sorted(set(t.size[(t.size > 0) & (t.size < window)].tolist())):
            rows += windows(template, t, size, whole=True)
        return _batch(rows, batch, ["item_id"])
    return arrow_map(src, run, f"item_id {src.schema['item_id'].dataType.simpleString()}, {WINDOW_SCHEMA}")


def _batch(rows: list[tuple], batch: pa.RecordBatch, ids: list[str]) -> pa.RecordBatch:
    owner, h, p, size, n, v = zip(*rows) if rows else ([],) * 6
    own = pa.array(owner, pa.int64())
    arrays = [pa.array(h, pa.int64()), pa.array(p, pa.int32()), pa.array(size, pa.int32()), pa.array(n, pa.int32()),
              pa.array(v, pa.list_(pa.string()))]
    return pa.RecordBatch.from_arrays([*(batch.column(c).take(own) for c in ids), *arrays],
                                      names=[*ids, "hash", "pos", "size", "tokens", "slots"])


def hash_bitmap(windows: DataFrame, bits: int) -> np.ndarray:
    """One bit for the top ``bits`` bits of each hash: at most ``2**bits / 8`` bytes, however many windows."""
    word = F.shiftrightunsigned(F.col("hash"), 64 - bits + 6)
    bit = F.shiftrightunsigned(F.col("hash"), 64 - bits).bitwiseAND(F.lit(63))
    rows = (windows.select(word.alias("word"), bit.cast("int").alias("b"))
            .groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("bits"))).toArrow()
    out = np.zeros(1 << max(bits - 6, 0), np.uint64)
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().astype(np.uint64)
    return out


def document_windows(docs: DataFrame, sizes: list[int], bitmap, bits: int) -> DataFrame:
    """``d1, d2`` (id and text hash) and the document windows whose hash may be in the benchmark."""
    src = texts(docs).select(F.col("doc_id").alias("d1"), text_hash().alias("d2"), "text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = bitmap.value

        def allowed(h: np.ndarray) -> np.ndarray:
            top = h >> np.uint64(64 - bits)
            return (words[(top >> np.uint64(6)).astype(np.int64)] >> (top & np.uint64(63)) & np.uint64(1)).astype(bool)
        template, rows, group, size, first = worker_state(("template",), Template), [], [], 0, 0
        data = column_bytes(batch, "text")
        for i, text in enumerate(data):
            group.append(text)
            size += len(text or b"")
            if size > CHUNK or i == len(data) - 1:
                t = tokens(template, group)
                for k in sizes:
                    rows += [(first + o, *rest) for o, *rest in windows(template, t, k, allowed)]
                group, size, first = [], 0, i + 1
        return _batch(rows, batch, ["d1", "d2"])
    return arrow_map(src, run, f"d1 {src.schema['d1'].dataType.simpleString()}, d2 long, {WINDOW_SCHEMA}")


def _one_to_one(pairs):
    return ((F.size(pairs) == F.size(F.array_distinct(pairs["slots"])))
            & (F.size(pairs) == F.size(F.array_distinct(pairs["d_slots"]))))


def matches(docs: DataFrame, benchmark: DataFrame, window: int = 8, min_tokens: int = 13, filter_bits: int = 24,
            by_run: bool = False) -> DataFrame:
    """``d1, d2, item_id`` for each document (id, text hash) and the items it contains.

    With ``by_run`` an alignment also counts if one of its runs does; else its slots must agree as a whole.
    """
    items = materialize(item_windows(benchmark, window), "benchmark-windows")
    sizes = [r[0] for r in items.select("size").distinct().collect()]  # window, and lengths below it
    bitmap = docs.sparkSession.sparkContext.broadcast(hash_bitmap(items, filter_bits))
    found = document_windows(docs, sizes, bitmap, filter_bits).withColumnsRenamed({"pos": "d_pos", "slots": "d_slots"})
    pairs = found.drop("tokens").join(items, ["hash", "size"]).where(F.size("slots") == F.size("d_slots"))
    # of the readings of a window the one with the fewest slots asks least: words read plain are equal on both sides
    matched = F.struct("pos", F.size("slots").alias("n"), F.array_distinct(F.arrays_zip("slots", "d_slots")).alias("pairs"))
    first_of_pos = lambda x, i: (i == 0) | (x["pos"] != F.get(F.col("run.pos"), i - 1))
    lined = (pairs.groupBy("d1", "d2", "item_id", (F.col("d_pos") - F.col("pos")).alias("shift"), "size", "tokens")
             .agg(F.array_sort(F.collect_set(matched)).alias("run"))
             .withColumn("run", F.filter("run", first_of_pos))
             .withColumn("need", F.greatest(F.least(F.lit(min_tokens), F.col("tokens")) - F.col("size") + 1, F.lit(1))))

    def agrees(run):
        return _one_to_one(F.array_distinct(F.flatten(run["pairs"])))

    def run_agrees(i):  # the ``need`` windows from the i-th on follow each other
        part = F.slice("run", i, F.col("need"))
        return (F.get(part["pos"], F.col("need") - 1) - F.get(part["pos"], F.lit(0)) == F.col("need") - 1) & agrees(part)
    hit = agrees(F.col("run"))
    if by_run:
        starts = F.sequence(F.lit(1), F.greatest(F.size("run") - F.col("need") + 1, F.lit(1)))
        hit |= F.exists(starts, run_agrees)
    return lined.where(F.size("run") >= F.col("need")).where(hit).select("d1", "d2", "item_id").distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, **params) -> DataFrame:
    """``doc_id, contaminated, n_items, item_ids`` (ascending) per row of ``docs``."""
    by_doc = matches(docs, benchmark, **params).groupBy("d1", "d2").agg(F.array_sort(F.collect_list("item_id")).alias("items"))
    rows = texts(docs).select("doc_id", text_hash().alias("_hash"))
    kind = benchmark.schema["item_id"].dataType.simpleString()
    items = F.coalesce("items", F.expr(f"cast(array() as array<{kind}>)"))
    return (rows.join(by_doc, rows["doc_id"].eqNullSafe(by_doc["d1"]) & (rows["_hash"] == by_doc["d2"]), "left")
            .select("doc_id", F.col("items").isNotNull().alias("contaminated"), F.size(items).cast("long").alias("n_items"),
                    items.alias("item_ids")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **params) -> DataFrame:
    """``docs`` without the rows that contain a benchmark item; all columns stay."""
    bad = matches(docs, benchmark, **params).select("d1", "d2").distinct()
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_id"), text_hash("text").alias("_hash"))
    return (rows.join(bad, rows["_id"].eqNullSafe(bad["d1"]) & (rows["_hash"] == bad["d2"]), "left_anti")
            .select("_row.*"))
