"""Joins with a side that may be small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of ids and short strings (under 100 bytes each) up to which a side is broadcast.
BROADCAST_ROWS = 1_000_000


def fits(df: DataFrame) -> bool:
    """Whether df has few enough rows; it counts up to the limit."""
    return df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def small(df: DataFrame, known: bool | None = None) -> DataFrame:
    """Broadcast df if it fits; else leave the join to a shuffle. known: what fits() said of it or of a larger table."""
    return F.broadcast(df) if (fits(df) if known is None else known) else df
