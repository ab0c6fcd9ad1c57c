"""Pages of a table in the order of its keys, each found from where the one before ended."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.ordering import numbered, unused

Mark = tuple[Any, ...]


def _keyed(rows: DataFrame, keys: list[str]) -> DataFrame:
    for k in keys:
        rows = rows.where(F.col(f"`{k}`").isNotNull())
    return rows


def _beyond(keys: list[str], mark: Mark) -> Column:
    """Keys after the mark in their order. The first key's bound stands alone, so that it reaches the scan and row groups before it are not read."""
    if len(keys) != len(mark):
        raise ValueError(f"a mark of {len(mark)} values for {len(keys)} keys")
    later, same = F.lit(False), F.lit(True)
    for k, v in zip(keys, mark, strict=True):
        later |= same & (F.col(f"`{k}`") > F.lit(v))
        same &= F.col(f"`{k}`") == F.lit(v)
    return (F.col(f"`{keys[0]}`") >= F.lit(mark[0])) & later


def page(rows: DataFrame, keys: list[str], size: int, after: Mark | None = None) -> DataFrame:
    """The next `size` rows in the order of keys after the mark (from the start without one), in order.

    keys must tell rows apart: of rows alike in all keys those that the page's end cuts off are lost. Rows with a null key are on no page. What is added to the table or taken from it between
    two pages neither repeats nor hides another row; what is added before the mark is not seen. A page with fewer rows is the last.
    """
    if size < 1:
        raise ValueError("a page has at least one row")
    rows = _keyed(rows, keys)
    return (rows if after is None else rows.where(_beyond(keys, after))).orderBy(*[F.col(f"`{k}`") for k in keys]).limit(size)


def mark(of: DataFrame, keys: list[str]) -> Mark | None:
    """Where a page ends, to go on from: the greatest keys; None if it has no rows."""
    last = of.agg(F.max(F.struct(*[F.col(f"`{k}`") for k in keys]))).first()[0]
    return None if last is None else tuple(last)


def paged(rows: DataFrame, keys: list[str], size: int, name: str = "page") -> DataFrame:
    """rows and the page, from 0, that page() would find each on, for jobs that want all pages at once: rows are numbered by ranges of keys, and no task or driver walks the pages. Rows with a null key are left out."""
    nth = unused(rows, "nth")
    out = numbered(_keyed(rows, keys), [], [F.col(f"`{k}`").asc() for k in keys], nth)
    return out.withColumn(name, F.floor((F.col(nth) - 1) / size)).drop(nth)


def spans(rows: DataFrame, keys: list[str], size: int) -> DataFrame:
    """(page, first, last, n): each page's first and last keys, as structs, and how many rows it has. page() after a page's last gives the next page, so any page can be read, or read again, by itself."""
    at = F.struct(*[F.col(f"`{k}`") for k in keys])
    name = unused(rows, "page")
    return paged(rows.select(*keys), keys, size, name).groupBy(F.col(name).alias("page")).agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n"))
