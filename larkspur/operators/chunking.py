"""Chunkers: columns text → array of chunks, and chunk rows with ids."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur import errors as E
from larkspur.functions.text import TRIM, is_own_chunk, trim


def paragraphs(text: Column, min_size: int = 100, max_size: int = 800) -> Column:
    """Merge small paragraphs while they fit; a small tail joins the chunk before it even beyond max_size."""
    if min_size < 1 or max_size < 1:
        raise E.EngineError("chunk sizes must be at least 1", E.PARAGRAPH_SIZES)
    if min_size > max_size:
        raise E.EngineError("minimum above maximum", E.PARAGRAPH_ORDER)
    lines = F.regexp_replace(trim(text), "\\r\\n?", "\n")
    parts = F.filter(F.transform(F.split(lines, "\n{2,}"), trim), lambda p: (p != "") & (p != "0"))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))
    joined = lambda a, b: F.concat(a, F.lit("\n\n"), b)

    def step(acc: Column, p: Column) -> Column:
        fits = (F.length(acc["open"]) < min_size) & (F.length(acc["open"]) + 2 + F.length(p) <= max_size)
        return (
            F.when(acc["open"] == "", F.struct(acc["done"].alias("done"), p.alias("open")))
            .when(fits, F.struct(acc["done"].alias("done"), joined(acc["open"], p).alias("open")))
            .otherwise(F.struct(F.array_append(acc["done"], acc["open"]).alias("done"), p.alias("open")))
        )

    def finish(acc: Column) -> Column:
        last = F.element_at(acc["done"], -1)
        merged = F.array_append(F.slice(acc["done"], 1, F.size(acc["done"]) - 1), joined(last, acc["open"]))
        small = (F.length(acc["open"]) < min_size) & (F.size(acc["done"]) > 0)
        return F.when(acc["open"] == "", acc["done"]).when(small, merged).otherwise(F.array_append(acc["done"], acc["open"]))

    return F.aggregate(parts, start, step, finish)


def window_one(text: str, size: int, overlap: int, tail: str) -> list[str]:
    text = text.strip(TRIM)
    n, out, start = len(text), [], 0
    if n <= size:
        return [text] if text else []
    while start < n:
        end = min(start + size, n)
        if end < n:
            back = max(start, end - 120)
            stop = max(text.rfind(mark, back, end) for mark in (". ", "? ", "! "))
            if stop > back:
                end = stop + 2
        if chunk := text[start:end].strip(TRIM):
            out.append(chunk)
        if tail == "stop" and end >= n:
            break
        start = max(start + 1, end - overlap)
    return out


def windows(size: int = 800, overlap: int = 100, tail: str = "reference"):
    """Sliding windows cut at sentence ends. tail='stop' ends with the first chunk that reaches the text's end;
    'reference' goes on through its shrinking suffixes."""
    if size < 1:
        raise E.EngineError("window size must be at least 1", E.WINDOW_SIZE)
    if not 0 <= overlap < size:
        raise E.EngineError("overlap must be from 0 to below the size", E.WINDOW_OVERLAP)

    @F.pandas_udf("array<string>")
    def chunk(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: window_one(t or "", size, overlap, tail))

    return chunk


def chunk_rows(docs: DataFrame, id_col: str, chunks: Column) -> DataFrame:
    """One row a chunk: identifier '<id>_chunk_<n>', parent_id, chunk_no, text."""
    rows = docs.select(F.col(id_col).cast("string").alias("parent_id"), F.posexplode(chunks).alias("chunk_no", "text"))
    return rows.select(F.concat_ws("_chunk_", "parent_id", "chunk_no").alias("identifier"), "parent_id", "chunk_no", "text")


def own_chunks(store: DataFrame, parents: DataFrame) -> DataFrame:
    """Stored rows that are chunks of the parents (column parent_id), and of no other id."""
    parent = F.regexp_extract("identifier", "^(.*)_chunk_[0-9]+$", 1)
    named = store.where(F.col("identifier").rlike("_chunk_[0-9]+$")).withColumn("parent_id", parent)
    return named.where(is_own_chunk(F.col("identifier"), F.col("parent_id"))).join(parents.select("parent_id").distinct(), "parent_id", "left_semi")


def stale(store: DataFrame, current: DataFrame, parents: DataFrame) -> DataFrame:
    """Stored own chunks of the parents that the current chunks no longer hold."""
    return own_chunks(store, parents).join(current.select("identifier"), "identifier", "left_anti")


def delete_chunked(store: DataFrame, parents: DataFrame) -> tuple[DataFrame, int]:
    """What stays when the parents' own chunks go, and how many rows went."""
    gone = own_chunks(store, parents).select("collection", "identifier")
    return store.join(gone, ["collection", "identifier"], "left_anti"), gone.count()
