"""Bags of words in blocks of documents, for fits that multiply them by coefficients again and again (M1).

Documents are dealt into blocks by key. A block holds its counts as arrays in one row: its distinct terms in order of their ids,
the number of documents of each, and side by side these documents and the counts. Terms are dealt into shards by id; a row
of a shard holds every vector of a fit (coefficients, gradient, ...) for its terms, and which blocks ask for which of them.

A pass sends each block the coefficients of its terms, computes there with NumPy, and sends sums by term back to the shards. What
travels is one row of arrays for a block and a shard, as long as their common terms: it grows with the distinct terms of the
blocks, not with the words of the documents. No vector as long as the vocabulary reaches the driver.

Rows of equal key are one document with the words of all and the labels of each; rows with a null key have labels only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonality.session import drop_scratch, materialize, ship_package

BLOCK_WORDS, LEAST_WORDS = 2 << 20, 1 << 18  # words in a block: at most about, and fewer only if all cores have one
SHARD = 1 << 14  # ids in a shard of terms
TOTALS = -1  # stands for a term id, and for a shard, in the row of sums over all documents
SENT = 4 << 20  # numbers in an Arrow batch of messages: at most about

_STATE = "shard long, local binary, asked_by binary, lens binary, at binary, scale binary, v binary, numbers binary"
_MESSAGE = "block int, shard long, sent binary"


def _least(x: np.ndarray) -> bytes:
    """Numbers from 0 in the smallest type that holds them all; :func:`_numbers` reads them."""
    return x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0)).tobytes()


def _numbers(data: bytes, size: int) -> np.ndarray:
    return np.frombuffer(data, f"u{len(data) // size}") if size else np.zeros(0, np.uint8)


def _each(batch: pa.RecordBatch) -> Iterator[dict]:
    """The rows of a batch, one copied at a time: they hold long arrays."""
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


def _one_row(schema: str, *values) -> pa.RecordBatch:
    named = [c.split() for c in schema.split(", ")]
    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<string>": pa.list_(pa.string())}
    return pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array([v], types[t]) for v, (_, t) in zip(values, named)],
                                      names=[c for c, _ in named])


def _no_rows(schema: str) -> pa.Table:
    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64()}
    return pa.table({c: pa.array([], types[t]) for c, t in (c.split() for c in schema.split(", "))})


def _messages(blocks: np.ndarray, shards: np.ndarray, lens: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    """A row for each block and shard with its ``lens`` rows of ``values``, which lie side by side."""
    ends = np.append(0, np.cumsum(lens)) * values.shape[1] * 8
    sent = pa.Array.from_buffers(pa.binary(), len(lens), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values, np.float64))])
    return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array(shards, pa.int64()), sent], names=["block", "shard", "sent"])


class Bag:
    """The counts of a block and its labels: ``y`` has rows per class and, last, all rows of each document."""

    def __init__(self, row: dict, classes: int) -> None:
        self.block = row["block"]
        self.terms = np.frombuffer(row["terms"], np.int64)
        self.lens = _numbers(row["lens"], len(self.terms)).astype(np.int64)
        size = int(self.lens.sum())
        self.doc, self.count = _numbers(row["doc"], size).astype(np.int64), _numbers(row["count"], size)
        y = np.frombuffer(row["y"], np.float64).reshape(-1, classes + 1)
        self.y, self.rows = y[:, :classes], y[:, classes]
        shards = self.terms // SHARD
        self.starts = np.flatnonzero(np.diff(shards, prepend=shards[0] - 1)) if len(shards) else np.zeros(0, np.int64)
        self.shards, self.ends = shards[self.starts], np.append(self.starts[1:], len(shards))

    def received(self, messages: pa.Table, width: int) -> np.ndarray:
        """The sent rows of the block's terms, 0 for a term of which none came."""
        W = np.zeros((len(self.terms), width))
        for shard, sent in zip(messages.column("shard").to_pylist(), messages.column("sent").to_pylist()):
            if shard != TOTALS:
                at = np.searchsorted(self.shards, shard)
                W[self.starts[at]:self.ends[at]] = np.frombuffer(sent).reshape(-1, width)
        return W

    def messages(self, sums: np.ndarray, totals: np.ndarray) -> pa.Table:
        """The sums by term to the shards, and the totals."""
        return pa.Table.from_batches([_messages(np.full(len(self.shards), self.block), self.shards, self.ends - self.starts, sums),
                                      _messages(np.array([self.block]), np.array([TOTALS]), np.array([1]), totals[None])])

    def logits(self, W: np.ndarray, bias: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(self.doc, self.count * np.repeat(w, self.lens), len(self.rows)) for w in W.T], axis=1) + bias

    def over_documents(self, values: np.ndarray) -> np.ndarray:
        """The sums by term of a number for each of its documents."""
        return np.add.reduceat(values, np.cumsum(self.lens) - self.lens) if len(self.terms) else np.zeros(0)  # every term has one

    def by_term(self, R: np.ndarray) -> np.ndarray:
        return np.stack([self.over_documents(self.count * r[self.doc]) for r in np.ascontiguousarray(R.T)], axis=1)

    def losses(self, Z: np.ndarray, log_total: np.ndarray) -> np.ndarray:
        return self.rows * log_total - (self.y * Z).sum(axis=1)

    def gradient(self, Z: np.ndarray) -> pa.Table:
        """Messages with the gradient of the summed loss by term; the totals are that by intercept and, last, the loss."""
        P, log_total = softmax(Z)
        R = self.rows[:, None] * P - self.y
        return self.messages(self.by_term(R), np.append(R.sum(axis=0), self.losses(Z, log_total).sum()))


class Shard:
    """The terms of a shard: ``V`` has a matrix (terms, width) per vector; ``scale`` is a number per term."""

    def __init__(self, row: dict, width: int) -> None:
        self.row, self.local = row, np.frombuffer(row["local"], np.uint16)
        self.terms = row["shard"] * SHARD + self.local.astype(np.int64)
        self.scale = np.frombuffer(row["scale"])[:, None]
        self.V = np.frombuffer(row["v"]).reshape(-1, len(self.local), width)

    def blocks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The blocks in order, how many terms each asks for, and side by side the places of these terms."""
        return tuple(np.frombuffer(self.row[c], t) for c, t in (("asked_by", np.int32), ("lens", np.int32), ("at", np.uint16)))

    def summed(self, messages: pa.Table) -> np.ndarray:
        """The sums over blocks of what they sent, by term; added in order of the blocks."""
        blocks, lens, at = self.blocks()
        starts, sums = np.cumsum(lens) - lens, None
        for block, sent in sorted(zip(messages.column("block").to_pylist(), messages.column("sent").to_pylist())):
            i = np.searchsorted(blocks, block)
            part = np.frombuffer(sent).reshape(lens[i], -1)
            sums = np.zeros((len(self.local), part.shape[1])) if sums is None else sums
            sums[at[starts[i]:starts[i] + lens[i]]] += part
        return sums

    def with_vectors(self, V: np.ndarray, numbers: np.ndarray) -> pa.RecordBatch:
        row = self.row | {"v": np.ascontiguousarray(V, np.float64).tobytes(), "numbers": np.asarray(numbers, np.float64).tobytes()}
        return _one_row(_STATE, *(row[c.split()[0]] for c in _STATE.split(", ")))


def softmax(Z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of rows of logits and ``log(sum(exp(z)))``."""
    top = Z.max(axis=1, keepdims=True)
    E = np.exp(Z - top)
    total = E.sum(axis=1, keepdims=True)
    return E / total, (np.log(total) + top)[:, 0]


_PACKED = "block int, words array<string>, lens binary, doc binary, count binary, y binary"
_BLOCK = "block int, terms binary, lens binary, doc binary, count binary, y binary"


class _Gathered:
    """The documents of one block as they come: first their labels, then their word lists in any order."""

    def __init__(self, block: int, width: int) -> None:
        self.block, self.keys, self.ys, self.words, self.parts = block, [], [np.zeros((0, width))], pa.array([], pa.string()), []

    def labels(self, part: pa.RecordBatch, width: int) -> None:
        self.keys.append(part.column("_key"))
        self.ys.append(part.column("y").flatten().to_numpy().reshape(-1, width))

    def lists(self, part: pa.RecordBatch) -> None:
        """Adds the words of two letters or more: a pair (document, word) once for each part, with its count."""
        self.keys = [pa.concat_arrays(self.keys)] if len(self.keys) > 1 else self.keys
        docs = pc.index_in(part.column("_key"), value_set=self.keys[0]).to_numpy().astype(np.int64)
        tokens = part.column("tokens")
        coded = pc.list_flatten(tokens).dictionary_encode()
        code, owner = coded.indices.fill_null(-1).to_numpy().astype(np.int64), docs[pc.list_parent_indices(tokens).to_numpy()]
        long = pc.greater_equal(pc.utf8_length(coded.dictionary), 2).to_numpy(zero_copy_only=False)
        # the place of each word in the block's list, which grows by the new ones
        kept = coded.dictionary.filter(pa.array(long))
        place = pc.index_in(kept, value_set=self.words).fill_null(-1).to_numpy().astype(np.int64)
        new = place < 0
        place[new] = len(self.words) + np.arange(new.sum())
        self.words = pa.concat_arrays([self.words, kept.filter(pa.array(new))])
        slots = np.full(len(long) + 1, -1)  # the last is that of a null
        slots[:-1][long] = place
        slot = slots[code]
        pairs, counts = np.unique((slot << 32 | owner)[slot >= 0], return_counts=True)
        self.parts.append((pairs, counts))
        if sum(len(p) for p, _ in self.parts) > 4 * BLOCK_WORDS:
            self.parts = [self.merged()]

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.parts) == 1:
            return self.parts[0]
        pairs, counts = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*self.parts) if self.parts else ([], [])))
        pairs, at = np.unique(pairs, return_inverse=True)
        return pairs, np.bincount(at, counts, len(pairs)).astype(np.int64)

    def row(self) -> pa.RecordBatch:
        pairs, counts = self.merged()
        lens = np.bincount(pairs >> 32, minlength=len(self.words))
        words = pa.ListArray.from_arrays(pa.array([0, len(self.words)], pa.int32()), self.words)
        return _one_row(_PACKED, self.block, words, _least(lens), _least(pairs & 0xffffffff), _least(counts), np.concatenate(self.ys).tobytes())


def _pack(rows: DataFrame, width: int) -> DataFrame:
    """The blocks of rows ``(block, kind, _key, y, tokens)`` sorted by block and kind; labels have kind 0, word lists 1."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for b in batches:
            ids, kinds = b.column("block").to_numpy(), b.column("kind").to_numpy()
            inner = np.flatnonzero((ids[1:] != ids[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            edges = [0, *inner.tolist(), len(ids)] if len(ids) else []
            for a, z in zip(edges, edges[1:]):
                if now is None or ids[a] != now.block:
                    if now is not None:
                        yield now.row()
                    now = _Gathered(int(ids[a]), width)
                part = b.slice(a, z - a)
                if kinds[a]:
                    now.lists(part)
                else:
                    now.labels(part, width)
        if now is not None:
            yield now.row()
    return rows.mapInArrow(run, _PACKED)


def _with_terms(left: pa.Table, right: pa.Table) -> pa.Table:
    """A packed block and ``slot, term_id`` of its words: the block with its terms in order; other words are left out."""
    out = []
    for row in left.to_pylist():
        slot, terms = (right.column(c).to_numpy() for c in ("slot", "term_id"))
        order = np.argsort(terms)
        slot, terms, words = slot[order], terms[order], row["words"]
        lens = _numbers(row["lens"], words).astype(np.int64)
        starts, mine = np.cumsum(lens) - lens, lens[slot]
        at = np.repeat(starts[slot] - (np.cumsum(mine) - mine), mine) + np.arange(mine.sum())
        size = int(lens.sum())
        out.append(_one_row(_BLOCK, row["block"], terms.astype(np.int64).tobytes(), _least(mine), _least(_numbers(row["doc"], size)[at]),
                            _least(_numbers(row["count"], size)[at]), row["y"]))
    return pa.Table.from_batches(out) if out else _no_rows(_BLOCK)


@dataclass
class TextBlocks:
    """``blocks``: one row of arrays per block; ``n``: rows of documents."""
    blocks: DataFrame
    packed: DataFrame
    n: int
    classes: int

    @property
    def wants(self) -> DataFrame:
        """``term_id, block``: the distinct terms of each block."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for block, terms in zip(b.column("block").to_pylist(), b.column("terms").to_pylist()):
                    terms = np.frombuffer(terms, np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array(np.full(len(terms), block, np.int32))], names=["term_id", "block"])
        return self.blocks.select("block", "terms").mapInArrow(run, "term_id long, block int")

    def drop(self) -> None:
        self.blocks.unpersist()
        drop_scratch(self.packed)

    def shards(self, vectors: int, scale: Callable[[np.ndarray], np.ndarray] = np.ones_like) -> DataFrame:
        """The shards of all terms of the blocks, their ``vectors`` 0; ``scale`` is taken from the sums of squared counts."""
        classes = self.classes

        def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for row in _each(b):
                    bag = Bag(row, classes)
                    squares = bag.over_documents(bag.count.astype(np.float64) ** 2)
                    yield _messages(np.full(len(bag.shards), bag.block), bag.shards, bag.ends - bag.starts,
                                    np.stack([(bag.terms % SHARD).astype(np.float64), squares], axis=1))

        def run(table: pa.Table) -> pa.Table:
            shard = table.column("shard")[0].as_py()
            blocks, sent = zip(*sorted(zip(table.column("block").to_pylist(), table.column("sent").to_pylist())))
            parts = [np.frombuffer(x).reshape(-1, 2) for x in sent]
            every = np.concatenate(parts)
            local, at = np.unique(every[:, 0].astype(np.uint16), return_inverse=True)
            squares = np.bincount(at, every[:, 1], len(local))
            row = [shard, local.tobytes(), np.array(blocks, np.int32).tobytes(), np.array([len(p) for p in parts], np.int32).tobytes(),
                   at.astype(np.uint16).tobytes(), np.asarray(scale(squares), np.float64).tobytes(), bytes(vectors * len(local) * classes * 8), b""]
            return pa.Table.from_batches([_one_row(_STATE, *row)])
        return self.blocks.mapInArrow(asked, _MESSAGE).groupBy("shard").applyInArrow(run, _STATE)

    def sent(self, shards: DataFrame, values: Callable[[Shard], np.ndarray]) -> DataFrame:
        """``block, shard, sent``: to each block the rows of ``values(shard)`` for the terms it asks for."""
        classes = self.classes

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for row in _each(b):
                    shard = Shard(row, classes)
                    out, (blocks, lens, at) = values(shard), shard.blocks()
                    ends = np.cumsum(lens, dtype=np.int64)
                    some = np.unique(np.append(np.searchsorted(ends, np.arange(0, ends[-1], max(1, SENT // out.shape[1]))), len(ends)))
                    for a, z in zip(some, some[1:]):
                        yield _messages(blocks[a:z], np.full(z - a, row["shard"]), lens[a:z], out[at[ends[a] - lens[a]:ends[z - 1]]])
        return shards.where(F.col("shard") != TOTALS).mapInArrow(run, _MESSAGE)

    def at_blocks(self, messages: DataFrame, kernel: Callable[[Bag, pa.Table], pa.Table], schema: str = _MESSAGE) -> DataFrame:
        """What ``kernel(bag, its messages)`` gives for every block."""
        classes = self.classes

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            out = [kernel(Bag(row, classes), right) for row in left.to_pylist()]
            return pa.concat_tables(out) if out else _no_rows(schema)
        return self.blocks.groupBy("block").cogroup(messages.groupBy("block")).applyInArrow(run, schema)

    def gathered(self, shards: DataFrame, messages: DataFrame, update: Callable[[Shard, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
        """The shards with the vectors and ``numbers`` that ``update(shard, sums by term)`` gives; row ``TOTALS`` has the summed totals."""
        classes = self.classes

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            if left.num_rows:
                shard = Shard(left.to_pylist()[0], classes)
                return pa.Table.from_batches([shard.with_vectors(*update(shard, shard.summed(right)))])
            sent = [x for _, x in sorted(zip(right.column("block").to_pylist(), right.column("sent").to_pylist()))]
            totals = np.sum([np.frombuffer(x) for x in sent], axis=0)
            return pa.Table.from_batches([_one_row(_STATE, TOTALS, b"", b"", b"", b"", b"", b"", totals.tobytes())])
        kept = shards.where(F.col("shard") != TOTALS).select(*(c.split()[0] for c in _STATE.split(", ")))
        return kept.groupBy("shard").cogroup(messages.groupBy("shard")).applyInArrow(run, _STATE)

    def coefficients(self, shards: DataFrame, names: list[str], of_shard: Callable[[Shard], np.ndarray]) -> DataFrame:
        """``term_id, names``: a row for each term with that of ``of_shard``."""
        classes = self.classes

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for row in _each(b):
                    shard = Shard(row, classes)
                    yield pa.RecordBatch.from_arrays([pa.array(shard.terms), *map(pa.array, of_shard(shard).T.copy())], names=["term_id", *names])
        return shards.where(F.col("shard") != TOTALS).mapInArrow(run, "term_id long, " + ", ".join(f"{c} double" for c in names))

    def gradient(self, values: DataFrame, columns: list[str], bias: np.ndarray) -> DataFrame:
        """``term_id, r0 .. rK``: the gradient of the summed loss by term; in row ``TOTALS`` by intercept, and the loss in ``rK``.

        ``values(term_id, columns)`` are the coefficients, 0 for a term without a row.
        """
        K = self.classes
        names = [f"r{c}" for c in range(K + 1)]

        def filled(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows:
                return _no_rows(_STATE)
            shard = Shard(left.to_pylist()[0], K)
            W = np.zeros((SHARD, K))
            W[right.column("local").to_numpy()] = np.stack([right.column(c).to_numpy() for c in columns], axis=1)
            return pa.Table.from_batches([shard.with_vectors(W[shard.local][None], np.zeros(0))])
        given = values.select(F.floor(F.col("term_id") / SHARD).cast("long").alias("shard"), F.pmod("term_id", F.lit(SHARD)).alias("local"), *columns)
        shards = self.shards(1).groupBy("shard").cogroup(given.groupBy("shard")).applyInArrow(filled, _STATE)
        found = self.gathered(shards, self.at_blocks(self.sent(shards, lambda s: s.V[0]), lambda bag, m: bag.gradient(bag.logits(bag.received(m, K), bias))),
                              lambda s, sums: (sums[None], np.zeros(0)))
        sums = self.coefficients(found, names, lambda s: np.pad(s.V[0], ((0, 0), (0, 1))))
        return sums.unionByName(found.where(F.col("shard") == TOTALS).mapInArrow(lambda batches: (
            pa.RecordBatch.from_arrays([pa.array([TOTALS], pa.int64()), *(pa.array([x]) for x in np.frombuffer(t))], names=["term_id", *names])
            for b in batches for t in b.column("numbers").to_pylist()), sums.schema))


def text_blocks(src: DataFrame, vocabulary: DataFrame, classes: int) -> TextBlocks:
    """The blocks of ``src(_key, tokens, _y)``, with the words of ``vocabulary`` of two letters or more."""
    spark = src.sparkSession
    ship_package(spark)
    n, words = src.agg(F.count(F.lit(1)), F.sum(F.greatest(F.size("tokens"), F.lit(0)))).first()
    words = words or 0
    number = max(1, -(-words // BLOCK_WORDS), min(spark.sparkContext.defaultParallelism, -(-words // LEAST_WORDS)))
    labels = src.groupBy("_key").agg(F.array(*[F.count(F.when(F.col("_y") == c, 1)).cast("double") for c in range(classes)],
                                             F.count(F.lit(1)).cast("double")).alias("y"))
    lists = src.where(F.col("_key").isNotNull() & F.col("tokens").isNotNull()).select("_key", "tokens")
    rows = (labels.withColumn("kind", F.lit(0)).unionByName(lists.withColumn("kind", F.lit(1)), allowMissingColumns=True)
            .withColumn("block", F.pmod(F.hash("_key"), F.lit(int(number))).cast("int"))
            .select("block", "kind", "_key", "y", "tokens"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, "block").sortWithinPartitions("block", "kind")
    packed = materialize(_pack(dealt, classes + 1), "text-packed")
    ids = (packed.select("block", F.posexplode("words").alias("slot", "term"))
           .join(vocabulary.select("term", "term_id"), "term").select(F.col("block").alias("of_block"), "slot", "term_id"))
    counts = packed.select("block", F.size("words").alias("words"), "lens", "doc", "count", "y")
    blocks = counts.groupBy("block").cogroup(ids.groupBy("of_block")).applyInArrow(_with_terms, _BLOCK)
    blocks = blocks.repartition(min(parts, 2 * number), "block").persist(StorageLevel.MEMORY_AND_DISK)
    return TextBlocks(blocks, packed, int(n), classes)
