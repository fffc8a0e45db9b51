"""JSON, null and array functions of the queries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nonnulls(*columns: Column | str) -> Column:
    """how many are not null."""
    return sum((_c(c).isNotNull().cast("int") for c in columns), F.lit(0))


def in_range(c: Column | str, low: Column, high: Column) -> Column:
    """both ends belong to it."""
    return _c(c).between(low, high)


def append_if_absent(items: Column | str, item: Column) -> Column:
    """an array with the item, which stays where it is if it is there."""
    return F.when(F.array_contains(_c(items), item), _c(items)).otherwise(F.array_append(_c(items), item))


def array_length(document: Column | str) -> Column:
    """items of a JSON array, null for anything else."""
    return F.json_array_length(_c(document))


def field(document: Column | str, path: str) -> Column:
    """the text of a field (a path with dots), null if there is none; objects and arrays as JSON."""
    return F.get_json_object(_c(document), f"$.{path}")


def has_key(document: Column | str, key: str) -> Column:
    """whether an object has the key, also with the value null."""
    return F.coalesce(F.array_contains(F.json_object_keys(_c(document)), key), F.lit(False))


def type_of(document: Column | str) -> Column:
    """object, array, string, number, boolean or null; null for what is no JSON."""
    first = F.substring(F.trim(_c(document)), 1, 1)
    kind = F.when(first == "{", "object").when(first == "[", "array").when(first == '"', "string").when(first.isin("t", "f"), "boolean").when(first == "n", "null").otherwise("number")
    return F.when(F.try_parse_json(_c(document)).isNotNull(), kind)


def build_object(**fields: Column) -> Column:
    """a JSON object; fields that are null are left out."""
    return F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]))


def merged(first: Column | str, second: Column | str) -> Column:
    """F32: a map with the entries of both, the second's where keys agree."""
    a, b = _c(first), _c(second)
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)
