"""Encoders: text -> vector, images -> normalised pixel arrays, user encoders over Arrow batches.

``hash_embed`` is the built-in text encoder: signed feature hashing of the words (md5 of each
word picks a slot and a sign), L2-normalised. The JVM cleans and splits; each Arrow batch is
dictionary-encoded, so a word is hashed once per batch at most, and a NumPy
scatter-add builds the vectors: no shuffle, and it also runs on a stream. ``encode_batch`` is the extension point for any other encoder (a transformer, an image
network): it is built once per task and called once per Arrow batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonality.operators.fuse import arrow_vectors
from tonality.session import ship_package


REMEMBERED = 1 << 18  # words whose slot a worker remembers
_SLOTS: dict[int, dict[str, int]] = {}


def word_slot(word: str, dim: int) -> int:
    """``(slot + 1) * sign``: slot = first 8 hex digits of md5 mod ``dim``; sign from the 9th hex digit (< 8 -> +1)."""
    h = hashlib.md5(word.encode("utf-8", "surrogatepass"), usedforsecurity=False).hexdigest()
    return (int(h[:8], 16) % dim + 1) * (1 if h[8] < "8" else -1)


def word_slots(words: list[str], dim: int) -> np.ndarray:
    """The slots of distinct words."""
    known = _SLOTS.setdefault(dim, {})
    if len(known) > REMEMBERED:
        known.clear()
    for w in words:
        if w not in known:
            known[w] = word_slot(w, dim)
    return np.fromiter(map(known.__getitem__, words), np.int64, len(words))


def words_to_matrix(col, dim: int, normalize: bool = True) -> np.ndarray:
    """Arrow list<string> of words (one list per row) -> ``n x dim`` signed hashed counts (L2-normalised)."""
    import pyarrow.compute as pc

    n = len(col)
    coded = pc.list_flatten(col).dictionary_encode()
    slots = np.append(word_slots(coded.dictionary.to_pylist(), dim), 0)  # the last one is a null word's
    flat = slots[pc.fill_null(coded.indices, len(slots) - 1).to_numpy(zero_copy_only=False)]
    lens = np.asarray(pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    rows = np.repeat(np.arange(n), lens)
    M = np.zeros((n, dim), dtype=np.float64)
    if flat.size:
        M = np.bincount(rows * dim + np.maximum(np.abs(flat) - 1, 0), np.sign(flat), n * dim).reshape(n, dim)
    if normalize:
        M = M / np.maximum(np.linalg.norm(M, axis=1, keepdims=True), 1e-12)
    return M


def hash_embed(df: DataFrame, tokens: str, dim: int = 64, out: str = "embedding", normalize: bool = True,
               keep: list[str] | None = None) -> DataFrame:
    """F4 built-in: signed hashed bag of words, L2-normalised (a row without words gets zeros).

    Only the columns of ``keep`` (default: all) and the words travel to Python.
    """
    ship_package(df.sparkSession)
    staged = df.select(*(df.columns if keep is None else keep), (F.col(tokens) if isinstance(tokens, str) else tokens).alias("_words"))
    schema = T.StructType([f for f in staged.schema.fields if f.name != "_words"]
                          + [T.StructField(out, T.ArrayType(T.DoubleType()), True)])
    si = staged.columns.index("_words")
    keep_idx = [i for i, c in enumerate(staged.columns) if c != "_words"]

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            M = words_to_matrix(batch.column(si), dim, normalize)
            cols = [batch.column(i) for i in keep_idx] + [arrow_vectors(M)]
            yield pa.RecordBatch.from_arrays(cols, names=[batch.schema.names[i] for i in keep_idx] + [out])

    return staged.mapInArrow(run, schema)


def encode_batch(df: DataFrame, col: str, encoder_factory: Callable[[], Callable], dim: int,
                 out: str = "embedding", keep: list[str] | None = None, batch_size: int = 32) -> DataFrame:
    """F4-F7 extension point: ``encoder_factory()`` is called once per task and returns a function
    from a list of inputs (strings, bytes or lists) to an ``n x dim`` array.

    The encoder sees at most ``batch_size`` rows per call (32 as the reference's text batches,
    8 for images), whatever ``spark.sql.execution.arrow.maxRecordsPerBatch`` is; lower that
    setting as well for wide rows such as images, since it sizes the incoming Arrow batch.
    """
    ship_package(df.sparkSession)
    keep = [c for c in df.columns if c != col] if keep is None else keep
    src = df.select(*keep, col)
    schema = T.StructType([f for f in src.schema.fields if f.name in keep]
                          + [T.StructField(out, T.ArrayType(T.DoubleType()), True)])
    k = len(keep)

    def run(batches):
        import pyarrow as pa
        enc = encoder_factory()
        for whole in batches:
            for start in range(0, whole.num_rows, batch_size):
                batch = whole.slice(start, batch_size)
                values = batch.column(k).to_pylist()
                M = np.asarray(enc(values), dtype=np.float64).reshape(len(values), dim)
                valid = np.array([v is not None for v in values], dtype=bool)
                yield pa.RecordBatch.from_arrays(list(batch.columns[:k]) + [arrow_vectors(M, valid)],
                                                 names=list(batch.schema.names[:k]) + [out])

    return src.mapInArrow(run, schema)


def normalize_images(df: DataFrame, image_col: str = "image", size: int = 128, keep: list[str] | None = None,
                     out: str = "pixels", batch_size: int = 8) -> DataFrame:
    """decoded image rows (Spark's ``image`` source: BGR(A) bytes) -> float32 ``3 x size x size``
    in [0, 1], channel first, RGB order; nearest-neighbour resize. Flattened to one array.

    Output batches hold at most ``batch_size`` images (8 as the reference), so one output batch
    is ``batch_size x 3 x size x size x 4`` bytes (1.5 MB at the defaults).
    """
    ship_package(df.sparkSession)
    keep = [c for c in df.columns if c != image_col] if keep is None else keep
    src = df.select(*keep, image_col)
    schema = T.StructType([f for f in src.schema.fields if f.name in keep]
                          + [T.StructField(out, T.ArrayType(T.FloatType()), True),
                             T.StructField("shape", T.ArrayType(T.IntegerType()), True)])
    k = len(keep)

    def to_chw(h, w, c, data):
        a = np.frombuffer(data, dtype=np.uint8).reshape(h, w, c)
        if c == 1:
            a = np.repeat(a, 3, axis=2)
        else:
            a = a[:, :, [2, 1, 0]]          # BGR(A) -> RGB
        ri = ((2 * np.arange(size) + 1) * h // (2 * size)).clip(0, h - 1)  # the pixel under the centre of each target pixel
        ci = ((2 * np.arange(size) + 1) * w // (2 * size)).clip(0, w - 1)
        a = a[ri][:, ci].astype(np.float32) / np.float32(255.0)
        return np.transpose(a, (2, 0, 1)).ravel()

    def run(batches):
        import pyarrow as pa
        for whole in batches:
            for start in range(0, whole.num_rows, batch_size):
                yield from convert(pa, whole.slice(start, batch_size))

    def convert(pa, batch):
        arrs, shapes = [], []
        for im in batch.column(k).to_pylist():
            if im is None or not im.get("data"):
                arrs.append(None)
                shapes.append(None)
            else:
                arrs.append(to_chw(im["height"], im["width"], im["nChannels"], im["data"]))
                shapes.append([3, size, size])
        yield pa.RecordBatch.from_arrays(
            list(batch.columns[:k]) + [pa.array(arrs, type=pa.list_(pa.float32())),
                                       pa.array(shapes, type=pa.list_(pa.int32()))],
            names=list(batch.schema.names[:k]) + [out, "shape"])

    return src.mapInArrow(run, schema)
