"""Statistics, orphans, reindexing, migration, cached results."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur import errors as E
from larkspur.functions import codec
from larkspur.functions.text import parent_of
from larkspur.sources.store import KEY


def stats(store: DataFrame) -> DataFrame:
    return store.groupBy("collection").agg(F.count("*").alias("cnt"), F.coalesce(F.max("tstamp"), F.lit(0)).cast("long").alias("last_indexed")).orderBy("collection")


def stats_formatted(rows: DataFrame) -> DataFrame:
    return rows.select("collection", F.format_number("cnt", 0).alias("cnt"), F.when(F.col("last_indexed") > 0, F.from_unixtime("last_indexed", "yyyy-MM-dd HH:mm:ss")).otherwise("-").alias("last_indexed"))


def orphans(store: DataFrame, live: DataFrame, match: str = "exact") -> DataFrame:
    """Stored rows whose id (match='parent': the id before the chunk part) is not live."""
    key = parent_of(F.col("identifier")) if match == "parent" else F.col("identifier")
    return store.withColumn("_k", key).join(live.select(F.col("identifier").alias("_k")), "_k", "left_anti").drop("_k")


def delete_orphans(store: DataFrame, live: DataFrame, allow_empty: bool = False, match: str = "exact") -> tuple[DataFrame, int]:
    if not allow_empty and live.limit(1).count() == 0:
        raise E.EngineError("no live ids given; all rows would go", E.ORPHANS_EMPTY)
    gone = orphans(store, live, match)
    return store.join(gone.select(*KEY), KEY, "left_anti"), gone.count()


def cleanup(store: DataFrame, providers: Iterable, collection: str | None = None, allow_empty: bool = False) -> tuple[DataFrame, int]:
    """providers have .collection and .live_identifiers() → DataFrame(identifier)."""
    total = 0
    for p in providers:
        if collection in (None, p.collection):
            own, rest = store.where(F.col("collection") == p.collection), store.where(F.col("collection") != p.collection)
            kept, n = delete_orphans(own, p.live_identifiers(), allow_empty)
            store, total = rest.unionByName(kept), total + n
    return store, total


def reindex(handlers: Iterable, collection: str | None = None, continue_on_error: bool = False) -> dict[str, int | Exception]:
    """Processed counts by label; stops at the first failure unless told to go on. handlers: .label, .collection, .reindex()."""
    out: dict[str, int | Exception] = {}
    for h in handlers:
        if collection in (None, h.collection):
            try:
                out[h.label] = h.reindex()
            except Exception as e:  # noqa: BLE001
                out[h.label] = e
                if not continue_on_error:
                    break
    return out


def migrate(rows: DataFrame, column: str = "vector") -> DataFrame:
    """JSON vectors become packed ones in one pass; status: packed, converted, or failed with its error code.

    A packed vector may begin with the byte of ``[`` by chance: such a blob is
    taken for JSON only if it parses as JSON, or can't be packed floats.
    """
    text = F.col(column).cast("string")
    legacy = text.startswith("[") & (F.try_parse_json(text).isNotNull() | (F.length(column) % 4 != 0))
    tried = rows.withColumn("_got", F.when(legacy, codec.repack(F.col(column))))
    status = F.when(F.coalesce(legacy, F.lit(False)), F.when(F.col("_got.error").isNull(), "converted").otherwise("failed")).otherwise("packed")
    return tried.withColumn("status", status).withColumn("error", F.col("_got.error")).withColumn(column, F.coalesce("_got.blob", column)).drop("_got")


class ResultCache:
    """Results keyed by arguments and snapshot version, with a lifetime; 0 switches it off."""

    def __init__(self, ttl: int = 3600, clock: Callable[[], float] = time.time, most: int = 10_000):
        self.ttl, self.clock, self.most, self.held = ttl, clock, most, {}

    @staticmethod
    def key(collection: str, query: str, top_k: int, filters: dict | None, collapse: bool, version: int = 0) -> str:
        return hashlib.md5(json.dumps([collection, query, top_k, sorted((filters or {}).items()), collapse, version]).encode()).hexdigest()

    def get(self, key: str):
        value, expires = self.held.get(key, (None, 0))
        return value if self.ttl and expires > self.clock() else None

    def put(self, key: str, value) -> None:
        if self.ttl:
            self.held.pop(key, None)
            while len(self.held) >= self.most:
                del self.held[next(iter(self.held))]  # the oldest
            self.held[key] = (value, self.clock() + self.ttl)

    def flush(self) -> None:
        self.held.clear()
