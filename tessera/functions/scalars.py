"""Numbers, times and geometry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HALF_LIFE_HOURS = 168.0
INPUT_PRICE, OUTPUT_PRICE = 3, 25  # ten-millionths a token


def estimate_tokens(text: Column) -> Column:
    """max(1, length / 4, halves to even)."""
    return F.greatest(F.lit(1), F.bround(F.length(text) / 4)).cast("long")


def token_cost(tokens_in: Column, tokens_out: Column) -> Column:
    """Rounded to a millionth, halves to even."""
    return F.bround((tokens_in * INPUT_PRICE + tokens_out * OUTPUT_PRICE) / 10) / 1e6


def decayed(weight: Column, explicit: Column, last: Column, now: Column, half_life_hours: float = HALF_LIFE_HOURS) -> Column:
    """weight * 0.5 ** (hours / half life); explicit links never decay, and a time ahead of now counts as now."""
    hours = F.greatest(F.lit(0.0), (F.unix_micros(now.cast("timestamp")) - F.unix_micros(last.cast("timestamp"))) / 3.6e9)
    return F.when(explicit, weight).otherwise(weight * F.pow(F.lit(0.5), hours / half_life_hours))


def choose_k(n: Column) -> Column:
    return F.greatest(F.lit(1), F.bround(F.sqrt(n / 2))).cast("int")


def position_between(before: Column, after: Column) -> Column:
    """A card's place: the middle; 1000 past the last or before the first; 0 on an empty column."""
    return F.when(before.isNotNull() & after.isNotNull(), (before + after) / 2).when(before.isNotNull(), before + 1000).when(after.isNotNull(), after - 1000).otherwise(F.lit(0.0))


def normalised_box(x0: Column, top: Column, x1: Column, bottom: Column, width: Column, height: Column) -> Column:
    unit = lambda v, size: F.least(F.lit(1.0), F.greatest(F.lit(0.0), v / size))
    return F.array(unit(x0, width), unit(top, height), unit(x1, width), unit(bottom, height))


def completeness(enriched: Column, complex_: Column) -> Column:
    return F.when(complex_ == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), enriched / complex_))


def size_label(size: Column) -> Column:
    """b, kb, mb in steps of 1024, one decimal above bytes."""
    step = lambda k, unit: F.concat(F.format_string("%.1f", F.round(size / 1024.0**k, 1)), F.lit(unit))
    return F.when(size < 1024, F.concat(size.cast("string"), F.lit("b"))).when(size < 1024**2, step(1, "kb")).otherwise(step(2, "mb"))


def type_label(mime: Column) -> Column:
    """A short name of a file's type; of unknown types the part after the slash."""
    # fixed values
    names = {"text/plain": "TXT", "text/markdown": "MD", "application/pdf": "PDF", "image/jpeg": "JPG", "image/png": "PNG", "image/webp": "WEBP"}
    known = F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), mime)
    return F.coalesce(known, F.nullif(F.upper(F.get(F.split(mime, "/"), F.lit(1))), F.lit("")), F.lit("FILE"))
