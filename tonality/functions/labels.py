"""Label derivation as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Class codes and names in code order (0, 1, 2).
CLASS_NAMES = ("negative", "neutral", "positive")


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def label_rating(col, variant: str = "le2", missing: str = "null") -> Column:
    """Rating -> class code 0/1/2.

    ``le2``: rating <= 2 -> 0, == 3 -> 1, anything else (2.5, 3.5, NaN) -> 2.
    ``ge4``: rating >= 4 -> 2, == 3 -> 1, anything else (2.5, 3.5, NaN) -> 0.
    Spark orders NaN above every double, so NaN is tested first to keep Python's semantics.
    A null rating gives a null code; ``missing="reference"`` gives what the reference does for a
    missing value (it reads as NaN there).
    """
    r = _c(col).cast("double")
    nan_code = 2 if variant == "le2" else 0
    if variant == "le2":
        body = F.when(r <= 2, 0).when(r == 3, 1).otherwise(2)
    elif variant == "ge4":
        body = F.when(r >= 4, 2).when(r == 3, 1).otherwise(0)
    else:
        raise ValueError(f"unknown variant {variant!r}")
    null_code = F.lit(nan_code) if missing == "reference" else F.lit(None)
    return (F.when(r.isNull(), null_code.cast("int"))
            .when(F.isnan(r), F.lit(nan_code))
            .otherwise(body).cast("int"))


def label_name(code) -> Column:
    """P5: code -> name; codes outside 0..2 give null."""
    names = F.array(*[F.lit(n) for n in CLASS_NAMES])
    c = _c(code)
    return F.when((c >= 0) & (c < len(CLASS_NAMES)), F.element_at(names, (c + 1).cast("int")))


def label_code(name) -> Column:
    """P5: name -> code; unknown names give null."""
    names = F.array(*[F.lit(n) for n in CLASS_NAMES])
    pos = F.array_position(names, _c(name))
    return F.when(pos > 0, (pos - 1).cast("int"))


def label_majority(neg, neu, pos) -> Column:
    """Code of the largest of three counts; ties go to the first of negative, neutral, positive."""
    n, u, p = _c(neg), _c(neu), _c(pos)
    return F.when((n >= u) & (n >= p), 0).when(u >= p, 1).otherwise(2).cast("int")


def sentiment_score(pos, neg, occurrences) -> Column:
    """(positive - negative) / occurrences; a zero denominator gives null, not an error."""
    return F.try_divide((_c(pos) - _c(neg)).cast("double"), _c(occurrences).cast("double"))


def class_label_index(name, classes) -> Column:
    """Position of ``name`` in an ordered class list, 0-based; -1 when absent."""
    return (F.array_position(F.array(*[F.lit(c) for c in classes]), _c(name)) - 1).cast("int")
