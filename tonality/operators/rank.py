"""Ranking and previews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _order(by, ascending: bool | list[bool]) -> list[Column]:
    up = [ascending] * len(by) if isinstance(ascending, bool) else ascending
    cols = [F.col(c) if isinstance(c, str) else c for c in by]
    return [c.asc_nulls_last() if a else c.desc_nulls_last() for c, a in zip(cols, up, strict=True)]


def top_k(df: DataFrame, by: list, k: int = 10, ascending: bool | list[bool] = False,
          tie_break: list | None = None) -> DataFrame:
    """K1: the ``k`` first rows by ``by`` (one direction for all, or one each); ``tie_break`` columns
    (ascending) make the order total.

    ``orderBy(..).limit(k)`` plans as TakeOrderedAndProject: each task keeps its own k best rows
    and only those reach the last merge, so no full sort or shuffle of the input happens.
    """
    tb = [F.col(c).asc_nulls_last() for c in (tie_break or [])]
    return df.orderBy(*_order(by, ascending), *tb).limit(k)


def preview(df: DataFrame, order_by: list[str], n: int = 5) -> DataFrame:
    """The first ``n`` rows after a declared order (a head without an order is not repeatable)."""
    return df.orderBy(*order_by).limit(n)
