"""Language identification with hyperdimensional profiles.

Each letter (and the word edge) has a random vector of +1 and -1, drawn from its code point and
a seed. An n-gram's vector binds its letters' vectors, each permuted by its place (element-wise
product of rolled vectors). A document bundles its n-grams (their sum); a language's prototype
bundles the n-grams of all its training documents. The prediction is the prototype with the
largest cosine.

Training counts n-grams per language in Spark (map-side combined) over all training documents;
the prototypes, ``languages x dims`` numbers, are all that reaches the driver.

Defined cases: a null text or one without a letter is ``und`` with score 0, as is every text if
there is nothing to learn from; a training row with null ``lang`` or ``und`` text teaches nothing;
equal cosines go to the first language in order; negative cosines score 0; repeated rows get
equal results; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonality.llm.common import arrow_map, worker_state

UND = "und"
EDGE = 0  # the code of a word edge
BITS = 21  # of a code point
GROUP_CHARS = 1 << 19  # characters bundled at a time
CACHE = 1 << 15  # n-gram vectors remembered per task
LETTERS = 1 << 16  # letter vectors remembered per task
SLAB = 4096  # n-grams bundled at a time


def letters(text: str) -> np.ndarray:
    """Code points of the lower-cased letters; every run of other characters becomes one edge."""
    code = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32).astype(np.int64)
    used = np.unique(code)
    letter = np.array([chr(c).isalpha() for c in used.tolist()], bool)
    code = np.where(letter[np.searchsorted(used, code)], code, EDGE) if len(code) else code
    code = np.concatenate([[EDGE], code, [EDGE]])
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] != EDGE) | (code[:-1] != EDGE)
    return code[keep]


def ngrams(text: str | None, n: int = 3) -> np.ndarray:
    """Packed n-grams within words and at their edges; none if the text has no letter."""
    code = letters(text) if text else np.zeros(0, np.int64)
    if not code.any() or len(code) < n:
        return np.zeros(0, np.int64)
    size = len(code) - n + 1
    out, inner = np.zeros(size, np.int64), np.ones(size, bool)
    for j in range(n):
        out = out << BITS | code[j:j + size]
        if 0 < j < n - 1:
            inner &= code[j:j + size] != EDGE
    return out[inner]


class Letters:
    """Letter vectors as rows of one table, each drawn once from its code point; at most ``LETTERS`` are remembered."""

    def __init__(self, dims: int, seed: int) -> None:
        self.seed, self.row, self.rows = seed, {}, np.zeros((256, dims), np.int8)

    def of(self, codes: list[int]) -> np.ndarray:
        """One row for each of the distinct ``codes``."""
        new = [c for c in codes if c not in self.row]
        if len(self.row) + len(new) > LETTERS:
            self.row, new = {}, codes
        need = len(self.row) + len(new)
        if need > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros((max(need, 2 * len(self.rows)) - len(self.rows), self.rows.shape[1]), np.int8)])
        for c in new:
            self.row[c] = at = len(self.row)
            self.rows[at] = np.random.default_rng([self.seed, c]).integers(0, 2, self.rows.shape[1], dtype=np.int8) * 2 - 1
        return self.rows[np.fromiter(map(self.row.__getitem__, codes), np.int64, len(codes))]


@lru_cache(maxsize=1)
def letter_table(dims: int, seed: int) -> Letters:
    return Letters(dims, seed)


def ngram_vectors(grams: np.ndarray, n: int, dims: int, seed: int) -> np.ndarray:
    """One row for each packed n-gram: the product of its letters' vectors, rolled by place."""
    out = np.ones((len(grams), dims), np.int8)
    for a in range(0, len(grams), SLAB):  # so that a slab's letters are few and its rows stay in the processor's cache
        part = out[a:a + SLAB]
        for j in range(n):
            code = grams[a:a + SLAB] >> BITS * (n - 1 - j) & (1 << BITS) - 1
            used, at = np.unique(code, return_inverse=True)
            part *= np.roll(letter_table(dims, seed).of(used.tolist()), n - 1 - j, axis=1)[at]
    return out


class Bundler:
    """Bundles documents; remembers n-gram vectors from batch to batch."""

    def __init__(self, n: int, dims: int, seed: int) -> None:
        self.shape, self.dims = (n, dims, seed), dims
        self.grams, self.vectors = np.zeros(0, np.int64), np.zeros((0, dims), np.int8)

    def vectors_of(self, grams: np.ndarray) -> np.ndarray:
        """Vectors of sorted distinct n-grams."""
        new = np.setdiff1d(grams, self.grams, assume_unique=True)
        if len(new):
            if len(self.grams) + len(new) > CACHE:
                self.grams, self.vectors, new = self.grams[:0], self.vectors[:0], grams
            both = np.concatenate([self.grams, new])
            order = np.argsort(both)
            self.grams, self.vectors = both[order], np.concatenate([self.vectors, ngram_vectors(new, *self.shape)])[order]
        return self.vectors[np.searchsorted(self.grams, grams)]

    def bundle(self, docs: list[np.ndarray]) -> np.ndarray:
        """Sum of the n-gram vectors of each document; one row for each, float32."""
        if not sum(map(len, docs)):
            return np.zeros((len(docs), self.dims), np.float32)
        grams = np.concatenate(docs)
        order = np.argsort(grams)
        grams, row = grams[order], np.repeat(np.arange(len(docs)), [len(d) for d in docs])[order]
        first = np.concatenate([[True], grams[1:] != grams[:-1]])
        used, at = grams[first], np.cumsum(first) - 1
        out = np.zeros((len(docs), self.dims), np.float32)
        vectors = self.vectors_of if len(used) <= CACHE else lambda g: ngram_vectors(g, *self.shape)  # too many to remember
        for a in range(0, len(used), SLAB):  # bounds the counts and the float copy of the vectors
            some = used[a:a + SLAB]
            x, z = np.searchsorted(at, [a, a + len(some)])
            counts = np.bincount(row[x:z] * len(some) + at[x:z] - a, minlength=len(docs) * len(some)).reshape(len(docs), len(some))
            out += counts.astype(np.float32) @ vectors(some).astype(np.float32)
        return out


def held_out(id_col: str = "doc_id", parts: int = 3, part: int = 1):
    """Whether a row is kept from training: ``crc32(id as text) mod parts = part`` (a null id counts as '')."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % parts == part


def prototypes(training: DataFrame, n: int = 3, dims: int = 1024, seed: int = 7) -> tuple[list[str], np.ndarray]:
    """Languages in order and their bundles (one row each) from all rows of ``training(text, lang)``."""
    src = training.select(F.col("text").cast("string"), F.col("lang").cast("string")).where("text IS NOT NULL AND lang IS NOT NULL")

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        by_lang: dict[str, list[np.ndarray]] = {}
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
            by_lang.setdefault(lang, []).append(ngrams(text, n))
        langs, grams, counts = [], [], []
        for lang, parts in by_lang.items():
            g, c = np.unique(np.concatenate(parts), return_counts=True)
            langs += [lang] * len(g)
            grams.append(g)
            counts.append(c)
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(np.concatenate(grams)),
                                           pa.array(np.concatenate(counts))], names=["lang", "gram", "n"])
    counts = arrow_map(src, count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))

    def add(batches):
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            lang = b.column("lang").to_numpy(zero_copy_only=False)
            gram, num = b.column("gram").to_numpy(), b.column("n").to_numpy().astype(np.float64)
            for a in range(0, len(gram), 4096):
                v = ngram_vectors(gram[a:a + 4096], n, dims, seed)
                for name in np.unique(lang[a:a + 4096]):
                    mine = lang[a:a + 4096] == name
                    sums[name] = sums.get(name, 0) + num[a:a + 4096][mine] @ v[mine].astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()),
                                          pa.array([s.tolist() for s in sums.values()], pa.list_(pa.float64()))],
                                         names=["lang", "bundle"])
    parts = counts.repartition(16, "gram").mapInArrow(add, "lang string, bundle array<double>").toArrow()
    total: dict[str, np.ndarray] = {}
    for lang, part in zip(parts.column("lang").to_pylist(), parts.column("bundle").to_pylist()):
        total[lang] = total.get(lang, 0) + np.array(part)
    names = sorted(total)
    return names, np.stack([total[x] for x in names]) if names else np.zeros((0, dims))


def predict(docs: DataFrame, names: list[str], profiles: np.ndarray, n: int = 3, seed: int = 7) -> DataFrame:
    """All columns of ``docs`` as one struct ``row``, and ``lang_pred``, ``score`` (cosine, 0 to 1)."""
    dims = profiles.shape[1]
    unit = profiles / np.maximum(np.linalg.norm(profiles, axis=1, keepdims=True), 1e-12)
    shared = docs.sparkSession.sparkContext.broadcast(unit.astype(np.float32))
    src = docs.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("_text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        pred, score, group, size = [], [], [], 0

        def flush() -> None:
            nonlocal group, size
            bundles = worker_state(("bundler", n, dims, seed), lambda: Bundler(n, dims, seed)).bundle(group)
            norm = np.linalg.norm(bundles, axis=1)
            cosine = bundles @ shared.value.T / np.maximum(norm, 1e-12)[:, None]
            for c, g in zip(cosine, group):
                known = len(g) and len(names)
                best = int(c.argmax()) if known else -1
                pred.append(names[best] if known else UND)
                score.append(float(min(max(c[best], 0.0), 1.0)) if known else 0.0)
            group, size = [], 0

        for text in batch.column("_text").to_pylist():
            g = ngrams(text, n)
            group.append(g)
            size += len(g)
            if size > GROUP_CHARS or len(group) == 128:
                flush()
        if group:
            flush()
        return pa.RecordBatch.from_arrays([batch.column("row"), pa.array(pred, pa.string()), pa.array(score, pa.float64())],
                                          names=["row", "lang_pred", "score"])
    schema = src.select("row").schema.add("lang_pred", "string").add("score", "double")
    return arrow_map(src, run, schema)


def identify(docs: DataFrame, n: int = 3, dims: int = 1024, seed: int = 7) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` per row; learned from the rows that are not held out."""
    src = docs.select("doc_id", "text", "lang")
    names, profiles = prototypes(src.where(~held_out()), n, dims, seed)
    out = predict(src.select("doc_id", "text"), names, profiles, n, seed)
    return out.select("row.doc_id", held_out("row.doc_id").alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, n: int = 3, dims: int = 1024, seed: int = 7) -> DataFrame:
    """``docs`` without the rows whose language cannot be told (``und``); all columns stay.

    With no label to learn from, only the rows without a letter go.
    """
    names, profiles = prototypes(docs.select("doc_id", "text", "lang").where(~held_out()), n, dims, seed)
    if not len(names):
        return docs.where(F.coalesce(F.col("text").cast("string"), F.lit("")).rlike(r"\p{L}"))
    return predict(docs, names, profiles, n, seed).where(F.col("lang_pred") != UND).select("row.*")
