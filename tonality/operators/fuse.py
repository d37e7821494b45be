"""Linear projection, gates and gated fusion of three modalities (F9, F11, F12, DM17).

Matrix products run once per Arrow batch (``mapInArrow``) with the parameters shipped as a
broadcast variable, never by exploding vectors into rows. Parameters are explicit, seeded or
closed-form, and can be stored as a table (``params_table``), unlike the reference's unseeded,
unsaved fusion layer.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonality.functions.vectors import as_double, gate, l2_normalize
from tonality.session import ship_package

# Layers above this many bytes are refused for broadcast (a 768 x 768 layer has 4.7 MB).
MAX_BROADCAST_BYTES = 400 << 20


@dataclass
class Linear:
    """One dense layer ``y = W x + b``; ``W`` has shape (out, in)."""
    W: np.ndarray
    b: np.ndarray

    @property
    def d_in(self) -> int:
        return int(self.W.shape[1])

    @property
    def d_out(self) -> int:
        return int(self.W.shape[0])

    def __call__(self, X: np.ndarray) -> np.ndarray:
        return X @ self.W.T + self.b


def closed_form_weight(i, j, salt: int):
    """Deterministic stand-in weight ``((31 i + 17 j + salt) mod 101 - 50) / 100``."""
    return ((31 * i + 17 * j + salt) % 101 - 50) / 100.0


def closed_form_bias(i, salt: int):
    return ((13 * i + salt) % 101 - 50) / 100.0


def closed_form_linear(d_out: int, d_in: int, salt: int) -> Linear:
    i = np.arange(d_out)[:, None]
    j = np.arange(d_in)[None, :]
    return Linear(closed_form_weight(i, j, salt).astype(np.float64),
                  closed_form_bias(np.arange(d_out), salt).astype(np.float64))


def random_linear(d_out: int, d_in: int, seed: int) -> Linear:
    """Seeded uniform(-1/sqrt(in), 1/sqrt(in)) initialisation (the usual dense-layer default)."""
    rng = np.random.default_rng(seed)
    k = 1.0 / np.sqrt(d_in)
    return Linear(rng.uniform(-k, k, (d_out, d_in)), rng.uniform(-k, k, d_out))


@dataclass
class FusionParams:
    """Projections of text / emoji / sticker to one width, and the two scalar gates."""
    text: Linear
    emoji: Linear
    sticker: Linear
    gate_emoji: Linear
    gate_sticker: Linear
    names: tuple = field(default=("text", "emoji", "sticker", "gate_emoji", "gate_sticker"))

    def layers(self) -> dict[str, Linear]:
        return {n: getattr(self, n) for n in self.names}

    @staticmethod
    def closed_form(d_text: int, d_emoji: int, d_sticker: int, salt: int = 11) -> FusionParams:
        d = max(d_text, d_emoji, d_sticker)
        return FusionParams(closed_form_linear(d, d_text, salt), closed_form_linear(d, d_emoji, salt + 1),
                            closed_form_linear(d, d_sticker, salt + 2), closed_form_linear(1, d, salt + 3),
                            closed_form_linear(1, d, salt + 4))

    @staticmethod
    def seeded(d_text: int, d_emoji: int, d_sticker: int, seed: int = 42) -> FusionParams:
        d = max(d_text, d_emoji, d_sticker)
        return FusionParams(random_linear(d, d_text, seed), random_linear(d, d_emoji, seed + 1),
                            random_linear(d, d_sticker, seed + 2), random_linear(1, d, seed + 3),
                            random_linear(1, d, seed + 4))


def check_broadcast(layers) -> None:
    """The one size check of every operator that sends layers to the tasks."""
    n = sum(layer.W.nbytes + layer.b.nbytes for layer in layers)
    if n > MAX_BROADCAST_BYTES:
        raise ValueError(f"layers of {n} bytes exceed the broadcast bound {MAX_BROADCAST_BYTES}")


def params_table(spark: SparkSession, layers: dict[str, Linear]) -> DataFrame:
    """DM17: ``layer, row, values array<double>, bias`` (one row per output unit)."""
    rows = [(name, int(r), [float(v) for v in lay.W[r]], float(lay.b[r]))
            for name, lay in layers.items() for r in range(lay.d_out)]
    schema = "layer string, row int, values array<double>, bias double"
    return spark.createDataFrame(rows, schema)


def layers_from_table(df: DataFrame) -> dict[str, Linear]:
    """Inverse of ``params_table``; the table is bounded by the layer sizes."""
    out: dict[str, list] = {}
    for r in df.orderBy("layer", "row").collect():
        out.setdefault(r["layer"], []).append(r)
    return {k: Linear(np.array([x["values"] for x in v], dtype=np.float64),
                      np.array([x["bias"] for x in v], dtype=np.float64)) for k, v in out.items()}


# ---------------------------------------------------------------- Arrow helpers

def arrow_matrix(col, dim: int):
    """Arrow list column -> (n x dim float64 matrix with zeros for nulls, validity mask)."""
    import pyarrow as pa
    import pyarrow.compute as pc

    n = len(col)
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    valid = np.asarray(pc.is_valid(col).to_numpy(zero_copy_only=False), dtype=bool)
    X = np.zeros((n, dim), dtype=np.float64)
    if valid.any():
        width = pc.list_value_length(col).to_numpy(zero_copy_only=False)
        if (width[valid] != dim).any():
            bad = int(np.flatnonzero(valid & (width != dim))[0])
            raise ValueError(f"row {bad} of the batch has a vector of {int(width[bad])} values, not {dim}")
        vals = np.asarray(pc.list_flatten(col.filter(pa.array(valid))).to_numpy(zero_copy_only=False), dtype=np.float64)
        X[valid] = vals.reshape(-1, dim)
    return X, valid


def arrow_vectors(X: np.ndarray, valid: np.ndarray | None = None):
    """(n x d) matrix -> Arrow list<double> column (null where ``valid`` is False)."""
    import pyarrow as pa

    n, d = X.shape
    offsets = pa.array(np.arange(0, n * d + 1, d, dtype=np.int32))
    arr = pa.ListArray.from_arrays(offsets, pa.array(X.reshape(-1), type=pa.float64()))
    if valid is not None and not valid.all():
        mask = pa.array(~valid)
        arr = pa.ListArray.from_arrays(offsets, pa.array(X.reshape(-1), type=pa.float64()), mask=mask)
    return arr


def _normalize_rows(Y: np.ndarray, eps: float = 1e-12) -> np.ndarray:
    return Y / np.maximum(np.linalg.norm(Y, axis=1, keepdims=True), eps)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-z))


# ---------------------------------------------------------------- F9 projection

def project_vector(df: DataFrame, col: str, layer: Linear, out: str = "projected", method: str = "arrow",
                   keep: list[str] | None = None) -> DataFrame:
    """``W x + b`` per row. ``method="arrow"``: one matrix product per Arrow batch with ``W``
    broadcast; ``method="expr"``: higher-order array expressions (small dims only). Only ``keep``
    (default: all columns) comes back next to the result."""
    ship_package(df.sparkSession)
    if method == "expr":
        return df.select(*(df.columns if keep is None else keep), project_expr(F.col(col), layer).alias(out))
    check_broadcast([layer])
    bc = df.sparkSession.sparkContext.broadcast((layer.W, layer.b))
    d_in = layer.d_in
    keep = df.columns if keep is None else keep
    src = df.select(*keep, F.col(col).alias("_x"))
    schema = T.StructType(src.schema.fields[:-1] + [T.StructField(out, T.ArrayType(T.DoubleType()), True)])
    k = len(keep)

    def run(batches):
        import pyarrow as pa
        W, b = bc.value
        for batch in batches:
            X, valid = arrow_matrix(batch.column(k), d_in)
            Y = X @ W.T + b
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], arrow_vectors(Y, valid)], names=[*keep, out])

    return src.mapInArrow(run, schema)


def project_expr(x: Column, layer: Linear) -> Column:
    """F9 as an expression: ``transform(sequence(0, out-1), i -> dot(x, W[i]) + b[i])``."""
    W = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in layer.W])
    b = F.array(*[F.lit(float(v)) for v in layer.b])
    xd = as_double(x)
    return F.transform(F.sequence(F.lit(0), F.lit(layer.d_out - 1)),
                       lambda i: F.aggregate(F.zip_with(xd, W[i], lambda a, w: a * w), F.lit(0.0), lambda s, v: s + v)
                       + b[i])


# ---------------------------------------------------------------- F11 / F12 fusion

def fuse_arrays(Xt, Xe, ve, Xs, vs, params: FusionParams, missing: str) -> np.ndarray:
    """NumPy kernel of the gated fusion for one batch (rows of the three modalities)."""
    t = _normalize_rows(params.text(Xt))
    e = _normalize_rows(params.emoji(Xe))
    s = _normalize_rows(params.sticker(Xs))
    ge = _sigmoid(params.gate_emoji(t))
    gs = _sigmoid(params.gate_sticker(t))
    if missing == "mask":
        e = e * ve[:, None]
        s = s * vs[:, None]
    elif missing != "zeros":
        raise ValueError(f"missing must be 'mask' or 'zeros', not {missing!r}")
    return t + ge * e + gs * s


def fuse_modalities(df: DataFrame, params: FusionParams, text: str = "text_vec", emoji: str = "emoji_vec",
                    sticker: str = "sticker_vec", out: str = "fused", missing: str = "mask",
                    keep: list[str] | None = None) -> DataFrame:
    """``fused = t + sigmoid(g_e . t) e + sigmoid(g_s . t) s`` with each modality projected to
    the common width and L2-normalised.

    A null modality is ``missing="mask"``: it contributes nothing; ``missing="zeros"``: it is a zero
    input vector, so (as in the reference) it still adds the normalised projection bias.
    A null text vector gives a null result. Only ``keep`` (default: all columns) comes back next
    to the result.
    """
    ship_package(df.sparkSession)
    layers = params.layers()
    check_broadcast(layers.values())
    bc = df.sparkSession.sparkContext.broadcast(params)
    dt, de, ds = params.text.d_in, params.emoji.d_in, params.sticker.d_in
    keep = df.columns if keep is None else keep
    src = df.select(*keep, *[F.col(c).alias(f"_x{i}") for i, c in enumerate((text, emoji, sticker))])
    k = len(keep)
    schema = T.StructType(src.schema.fields[:k] + [T.StructField(out, T.ArrayType(T.DoubleType()), True)])

    def run(batches):
        import pyarrow as pa
        p = bc.value
        for batch in batches:
            (Xt, vt), (Xe, ve), (Xs, vs) = (arrow_matrix(batch.column(k + i), d) for i, d in enumerate((dt, de, ds)))
            Y = fuse_arrays(Xt, Xe, ve.astype(np.float64), Xs, vs.astype(np.float64), p, missing)
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], arrow_vectors(Y, vt)], names=[*keep, out])

    return src.mapInArrow(run, schema)


def fuse_expr(df: DataFrame, params: FusionParams, text: str = "text_vec", emoji: str = "emoji_vec",
              sticker: str = "sticker_vec", out: str = "fused", missing: str = "mask") -> DataFrame:
    """F12 as array expressions (the reference path for tests; small widths only)."""
    d = params.text.d_out

    def proj(c, lay, dim):
        if missing == "mask":
            return F.when(F.col(c).isNotNull(), l2_normalize(project_expr(F.col(c), lay)))
        x = F.coalesce(F.col(c).cast("array<double>"), F.array_repeat(F.lit(0.0), dim))
        return l2_normalize(project_expr(x, lay))

    t = proj(text, params.text, params.text.d_in)
    staged = df.withColumn("_t", t).withColumn("_e", proj(emoji, params.emoji, params.emoji.d_in)) \
        .withColumn("_s", proj(sticker, params.sticker, params.sticker.d_in))
    ge = gate_expr(F.col("_t"), params.gate_emoji)
    gs = gate_expr(F.col("_t"), params.gate_sticker)
    zero = F.array_repeat(F.lit(0.0), d)
    e = F.coalesce(F.col("_e"), zero)
    s = F.coalesce(F.col("_s"), zero)
    staged = staged.withColumn("_ge", ge).withColumn("_gs", gs)
    fused = F.zip_with(F.zip_with(F.col("_t"), e, lambda a, b: a + F.col("_ge") * b), s,
                       lambda a, b: a + F.col("_gs") * b)
    return staged.withColumn(out, fused).drop("_t", "_e", "_s", "_ge", "_gs")


def gate_expr(x: Column, layer: Linear) -> Column:
    """``sigmoid(w . x + b)`` for a one-output layer."""
    return gate(x, layer.W[0].tolist(), float(layer.b[0]))
