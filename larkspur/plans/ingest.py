"""Incremental ingest: which documents to skip, touch or embed, and the next snapshot."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions import metadata as M
from larkspur.functions.text import content_hash, normalise
from larkspur.operators.chunking import chunk_rows, stale
from larkspur.sources.store import KEY, latest, update_metadata, upsert


def actions(store: DataFrame, docs: DataFrame, limit: int = 6000) -> DataFrame:
    """docs (collection, identifier, text, metadata) with normalised text, content_hash and action: skip, metadata or embed."""
    text = normalise(F.col("text"), limit)
    named = docs.select(*KEY, text.alias("text"), "metadata").withColumn("content_hash", content_hash(F.col("text")))
    old = store.select(*KEY, F.col("content_hash").alias("old_hash"), F.col("metadata").alias("old_metadata"))
    same = F.coalesce(F.col("old_hash") == F.col("content_hash"), F.lit(False))
    equal = M.canonical_column(F.col("metadata")) == M.canonical_column(F.col("old_metadata"))
    action = F.when(same & equal, "skip").when(same, "metadata").otherwise("embed")
    return named.join(old, KEY, "left").select(*KEY, "text", "content_hash", "metadata", action.alias("action"))


def hashed_embedding(text: Column, dim: int = 64) -> Column:
    """Deterministic offline embedding: signed word hashes summed in buckets, of unit length."""

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        known: dict[str, tuple[int, float]] = {}  # words of this batch alone

        def one(text: str | None) -> np.ndarray:
            out = np.zeros(dim)
            for word in (text or "").lower().split(" "):
                if word:
                    if word not in known:
                        h = hashlib.md5(word.encode()).hexdigest()
                        known[word] = (int(h[:7], 16) % dim, 1.0 if h[7] < "8" else -1.0)
                    bucket, sign = known[word]
                    out[bucket] += sign
            length = np.sqrt(out @ out)
            return (out / length if length else out).astype(np.float32)

        return texts.map(one)

    return embed(text)


def ingest(store: DataFrame, docs: DataFrame, embed=hashed_embedding, now: int = 0) -> DataFrame:
    """The next snapshot; only rows whose text changed are embedded, once an id, unchanged rows keep their tstamp."""
    plan = actions(store, docs)
    made = latest(plan.where("action = 'embed'"), "content_hash").select(*KEY, embed(F.col("text")).alias("vector"), "content_hash", "metadata", F.lit(now).cast("long").alias("tstamp"))
    return upsert(update_metadata(store, plan.where("action = 'metadata'"), now), made)


def ingest_chunked(store: DataFrame, docs: DataFrame, chunks: Column, embed=hashed_embedding, now: int = 0, replace_bare: bool = False) -> DataFrame:
    """Ingest docs of one collection by chunks and drop their stale chunks; replace_bare drops unchunked rows too."""
    rows = chunk_rows(docs, "identifier", chunks)
    meta = docs.select("collection", F.col("identifier").alias("parent_id"), "metadata")
    new = rows.join(meta, "parent_id").select("collection", "identifier", "text", "metadata")
    parents = docs.select(F.col("identifier").alias("parent_id"))
    gone = stale(store.join(docs.select("collection").distinct(), "collection", "left_semi"), new, parents).select(*KEY)
    kept = store.join(gone, KEY, "left_anti")
    if replace_bare:
        kept = kept.join(docs.select(*KEY), KEY, "left_anti")
    return ingest(kept, new, embed, now)
