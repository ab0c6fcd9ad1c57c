"""Numbering rows of groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.joins import small
from tessera.sources.scratch import stash


def unused(df: DataFrame, stem: str) -> str:
    """A column name that df does not have, whatever the case."""
    taken, name = {c.lower() for c in df.columns}, f"_{stem}"
    while name.lower() in taken:
        name = f"_{name}"
    return name


def numbered(df: DataFrame, keys: list[str], order: list[Column], name: str, keep: list[Column] | None = None) -> DataFrame:
    """df (or its columns `keep`, with the keys among them) and `name`: each row's place, from 1, among the rows of its keys in that order.

    Rows are sorted by ranges of keys and order, so a key with most of the rows lies in many ranges. A row's place is its place in its
    range and what earlier ranges hold of its key: sums of one row a key and range. Null keys are one group; rows that tie in the
    whole order stand in any, but one, order.
    """
    along = [*[F.col(f"`{k}`").asc() for k in keys], *order]
    at, part, shift = unused(df, "at"), unused(df, "part"), unused(df, "shift")
    rows = df.repartitionByRange(*along).sortWithinPartitions(*along).select(*(keep or [F.col(f"`{c}`") for c in df.columns]), F.monotonically_increasing_id().alias(at))
    rows = stash(rows, "sorted").withColumn(part, F.shiftright(at, 33))  # the id's upper bits are the range
    spans = rows.groupBy(*[F.col(f"`{k}`") for k in keys], part).agg(F.min(at).alias(shift), F.count("*").alias(at))
    earlier = F.sum(at).over(Window.partitionBy(*[F.col(f"`{k}`") for k in keys]).orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.select(*[F.col(f"`{k}`").alias(f"_of_{k}") for k in keys], F.col(part).alias(f"_of_{part}"), (F.coalesce(earlier, F.lit(0)) + 1 - F.col(shift)).alias(shift))
    same = F.col(part) == F.col(f"_of_{part}")
    for k in keys:
        same &= F.col(f"`{k}`").eqNullSafe(F.col(f"`_of_{k}`"))
    out = [c for c in rows.columns if c not in (at, part)]
    return rows.join(small(stash(spans, "spans")), same).select(*[F.col(f"`{c}`") for c in out], (F.col(at) + F.col(shift)).alias(name))
