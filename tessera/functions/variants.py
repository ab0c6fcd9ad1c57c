"""JSON documents as VARIANT: what a path holds, a path set anew, lengths and elements of arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parsed(text: Column) -> Column:
    """JSON text as VARIANT; null where it is null or broken."""
    return F.try_parse_json(text)


def at(value: Column, path: str, kind: str = "variant") -> Column:
    """What a JSON path ($.a.b[0]) holds, as a type; null where there is none or it is of another kind."""
    return F.try_variant_get(value, path, kind)


def elements(value: Column, kind: str = "variant") -> Column:
    """The elements of a VARIANT array, null where it is none; those of another kind are null."""
    held = F.try_variant_get(value, "$", "array<variant>")
    return held if kind == "variant" else F.transform(held, lambda x: F.try_variant_get(x, "$", kind))


def length(value: Column) -> Column:
    """How many elements an array has; null where it is none."""
    return F.when(F.schema_of_variant(value).startswith("ARRAY"), F.size(elements(value)))


def with_path(value: Column, path: list[str | int], new: Column, create: bool = True) -> Column:
    """value with `new` (a VARIANT) at a path of keys and places.

    The last key is made where it is missing, unless create is False; what leads to it is not, and then value stays as it is. A place counts from
    0, or from -1 backwards; one beyond an array's end appends, one before its start prepends (if create). Null stays null.
    """
    key, rest = path[0], path[1:]
    if isinstance(key, str):
        held = F.try_variant_get(value, "$", "map<string,variant>")
        old = F.try_element_at(held, F.lit(key))
        there = F.array_contains(F.map_keys(held), key)
        put = with_path(old, rest, new, create) if rest else new
        whole = F.to_variant_object(F.map_concat(F.map_filter(held, lambda k, _: k != key), F.create_map(F.lit(key), put)))
        able, may = F.schema_of_variant(value).startswith("OBJECT"), there | F.lit(create and not rest)
    else:
        held = F.try_variant_get(value, "$", "array<variant>")
        n = F.size(held)
        place = F.lit(key) if key >= 0 else n + key
        inside = (place >= 0) & (place < n)
        old = F.try_element_at(held, place + 1)
        put = with_path(old, rest, new, create) if rest else new
        changed = F.transform(held, lambda x, i: F.when(i == place, put).otherwise(x))
        added = F.when(place < 0, F.concat(F.array(put), held)).otherwise(F.concat(held, F.array(put)))
        whole = F.to_variant_object(F.when(inside, changed).otherwise(added))
        able, may = F.schema_of_variant(value).startswith("ARRAY"), inside | F.lit(create and not rest)
    return F.when(able & may, whole).otherwise(value)


def from_value(value: Column) -> Column:
    """A number, text, array or map as VARIANT."""
    return F.parse_json(F.to_json(F.struct(value.alias("v")))).cast("map<string,variant>")["v"]
