"""Typed metadata filters over JSON text.

Filters are joined by and; a missing key or a stored null matches no filter;
integers and floats are one domain; strings and booleans match only their own
kind. Null, empty or undecodable metadata is empty and matches only no filter.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def prepare(spark: SparkSession) -> None:
    """Repeated keys: the last counts."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def _path(key: str) -> str:
    return "$['" + key.replace("\\", "\\\\").replace("'", "\\'") + "']"


def matches(metadata: Column, filters: dict) -> Column:
    parsed = F.try_parse_json(metadata)
    out = F.lit(True)
    for key, wanted in filters.items():
        kind = F.schema_of_variant(F.try_variant_get(parsed, _path(key), "variant"))
        if isinstance(wanted, bool):
            test = (kind == "BOOLEAN") & (F.try_variant_get(parsed, _path(key), "boolean") == wanted)
        elif isinstance(wanted, (int, float)):
            number = (kind == "BIGINT") | (kind == "DOUBLE") | kind.startswith("DECIMAL")
            test = number & (F.try_variant_get(parsed, _path(key), "double") == float(wanted))
        elif isinstance(wanted, str):
            test = (kind == "STRING") & (F.try_variant_get(parsed, _path(key), "string") == wanted)
        else:
            test = F.lit(False)
        out = out & F.coalesce(test, F.lit(False))
    return out


def canonical(metadata: dict | None) -> str:
    """Stored form: sorted keys, no spaces; equal for any order of keys."""
    return json.dumps(metadata or {}, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def canonical_column(metadata: Column) -> Column:
    """Sorted key → value text with its kind; null and undecodable are empty."""
    entries = F.map_entries(F.from_json(F.coalesce(metadata, F.lit("{}")), "map<string,variant>"))
    named = F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), F.coalesce(F.to_json(e["value"]), F.lit("null"))))
    return F.coalesce(F.array_join(F.array_sort(named), "&"), F.lit(""))
