"""Filters over open JSON maps, parsed once into variants.

Paths that are absent, JSON null and texts that are no JSON are told apart as
the filters need: a test on what isn't there is false, never an error.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parsed(json: Column) -> Column:
    """The text as a variant; null where it is no JSON."""
    return F.try_parse_json(json)


def field(value: Column, path: str, kind: str = "string") -> Column:
    """What stands at ``path`` as ``kind``; null if it is absent or of another kind."""
    return F.try_variant_get(value, path, kind)


def has_key(value: Column, key: str) -> Column:
    """Whether an object has ``key``, with null as its value too."""
    return F.coalesce(F.array_contains(F.map_keys(F.try_variant_get(value, "$", "map<string,variant>")), key), F.lit(False))


def equals(value: Column, path: str, wanted: Column) -> Column:
    return F.coalesce(field(value, path) == wanted, F.lit(False))


def any_has(value: Column, key: str, path: str = "$") -> Column:
    """Whether some entry of the array at ``path`` is an object with ``key``."""
    entries = F.try_variant_get(value, path, "array<variant>")
    return F.coalesce(F.exists(entries, lambda e: has_key(e, key)), F.lit(False))
