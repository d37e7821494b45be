"""Small-vector math as higher-order array expressions.

These stay on the JVM. Higher-order functions are interpreted, so they are meant for norms,
gates and class-score vectors; matrix products over wide vectors go through Arrow batches
(``operators.fuse``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def as_double(col) -> Column:
    """float32 vectors are widened to double before arithmetic."""
    return _c(col).cast("array<double>")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once: inside an array function a plain sub-expression
    would be computed again for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def vsum(col) -> Column:
    return F.aggregate(_c(col), F.lit(0.0).cast("double"), lambda acc, v: acc + v)


def dot(a, b) -> Column:
    return vsum(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y))


def l2_norm(col) -> Column:
    return F.sqrt(F.aggregate(as_double(col), F.lit(0.0).cast("double"), lambda acc, v: acc + v * v))


def l2_normalize(col, eps: float = 1e-12) -> Column:
    """x / max(||x||, eps); a zero vector stays zero."""
    x = as_double(col)
    return let(F.greatest(l2_norm(x), F.lit(eps)), lambda n: F.transform(x, lambda v: v / n))


def softmax(col) -> Column:
    """F8: exp(x - max x) / sum exp(x - max x)."""
    x = as_double(col)
    return let(F.array_max(x), lambda m: let(F.transform(x, lambda v: F.exp(v - m)),
                                             lambda e: let(vsum(e), lambda s: F.transform(e, lambda v: v / s))))


def sigmoid(col) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(col)))


def gate(x, w, b: float | Column = 0.0) -> Column:
    """sigmoid(w . x + b) for a weight vector ``w`` (column or list of numbers)."""
    if isinstance(w, (list, tuple)):
        w = F.array(*[F.lit(float(v)) for v in w])
    b = b if isinstance(b, Column) else F.lit(float(b))
    return sigmoid(dot(x, w) + b)


def relu(col) -> Column:
    return F.transform(as_double(col), lambda v: F.greatest(v, F.lit(0.0)))


def argmax(col) -> Column:
    """K3: 0-based index of the largest score; on a tie the first index wins."""
    x = _c(col)
    return (F.array_position(x, F.array_max(x)) - 1).cast("int")


def zeros(dim: int) -> Column:
    return F.array_repeat(F.lit(0.0).cast("double"), dim)


def widen_vector(df: DataFrame, col: str, dim: int, prefix: str = "emb_", keep: list[str] | None = None,
                 digits: int | None = None) -> DataFrame:
    """Vector column -> ``prefix0 .. prefix{dim-1}`` double columns (the CSV sink shape)."""
    keep = [c for c in df.columns if c != col] if keep is None else keep
    x = as_double(col)
    cells = []
    for i in range(dim):
        v = x[i]
        if digits is not None:
            v = F.round(v, digits)
        cells.append(v.alias(f"{prefix}{i}"))
    return df.select(*keep, *cells)


def pack_vector(df: DataFrame, cols: list[str], name: str = "embedding") -> DataFrame:
    """S10 inverse: named double columns -> one ``array<double>`` column."""
    rest = [c for c in df.columns if c not in set(cols)]
    return df.select(*rest, F.array(*[F.col(c).cast("double") for c in cols]).alias(name))
