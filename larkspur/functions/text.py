"""Text normalisation and hashing as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TRIM = " \t\n\r\x0b\x00"
SPACE = "[ \\t\\n\\r\\f\\x0B]+"


def trim(text: Column) -> Column:
    return F.btrim(text, F.lit(TRIM))


def normalise(text: Column, limit: int = 6000) -> Column:
    """Trim, turn each run of ASCII white space into one space, cut to limit code points."""
    return F.substring(F.regexp_replace(trim(text), SPACE, " "), 1, limit)


def content_hash(normalised: Column) -> Column:
    return F.md5(normalised.cast("binary"))


def parent_of(identifier: Column) -> Column:
    """The part before the first chunk separator; the whole id if there is none."""
    return F.substring_index(identifier, "_chunk_", 1)


def is_own_chunk(identifier: Column, parent: Column) -> Column:
    """identifier is parent + '_chunk_' + digits, in this case."""
    head = F.concat(parent, F.lit("_chunk_"))
    return F.startswith(identifier, head) & F.substring(identifier, F.length(head) + 1, F.length(identifier)).rlike("^[0-9]+$")


def cache_tag(collection: Column) -> Column:
    return F.regexp_replace(collection, "[^a-zA-Z0-9_]", "_")
