"""Shards of near-equal bytes by histogram sort.

Texts are keyed by a 64-bit hash, so that equal texts share a key and a shard.
Splitters between keys come from rounds of exact counts: each round counts, in
every partition, the bytes below a few dozen candidate keys for each boundary,
the sums narrow each boundary's bracket, and the rounds end when every splitter
is within tolerance. Then the rows are exchanged once. Groups too large for the
tolerance are placed whole, largest first, and the boundaries of the others are
set to fill the shards up evenly.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspur.llm import common as C

LOW, HIGH = -(1 << 63), (1 << 63) - 1
PROBES = 64


def bytes_below(groups: DataFrame, probes: np.ndarray) -> np.ndarray:
    """Exact bytes with key < probe for each of the sorted probes, summed over partitions."""

    def count(batches):
        total = np.zeros(len(probes) + 1, np.int64)
        for batch in batches:
            at = np.searchsorted(probes, batch.column(0).to_numpy(), side="right")
            np.add.at(total, at, batch.column(1).to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["at", "n"])

    sums = groups.select("key", "bytes").mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(len(probes) + 1, np.int64)
    for r in sums:
        total[r["at"]] = r["n"]
    return np.cumsum(total)[:-1]


def splitters(groups: DataFrame, targets: list[float], tolerance: float) -> list[int]:
    """For each target the key below which about that many bytes lie."""
    brackets = [[LOW, HIGH, None, math.inf] for _ in targets]
    while True:
        open_ = [i for i, b in enumerate(brackets) if b[3] > tolerance and b[1] - b[0] > 1]
        if not open_:
            return [b[2] if b[2] is not None else b[1] for b in brackets]
        probes = sorted({lo + (hi - lo) * j // (PROBES + 1) for i in open_ for lo, hi in [brackets[i][:2]] for j in range(1, PROBES + 1)})
        below = bytes_below(groups, np.array(probes, np.int64)).tolist()
        for i in open_:
            b = brackets[i]
            for probe, n in zip(probes, below):
                if abs(n - targets[i]) < b[3]:
                    b[2], b[3] = probe, abs(n - targets[i])
                if n <= targets[i]:
                    b[0] = max(b[0], probe)
                else:
                    b[1] = min(b[1], probe)
                    break


def place_heavy(heavy: list[tuple[int, int]], light: int, shards: int) -> tuple[dict[int, int], list[float]]:
    """Shard of each heavy key, and each shard's share of the light bytes."""
    load, where = [0] * shards, {}
    for key, size in sorted(heavy, key=lambda kv: (-kv[1], kv[0])):
        j = min(range(shards), key=lambda j: (load[j], j))
        where[key] = j
        load[j] += size
    level, order = 0.0, sorted(load)
    for n in range(1, shards + 1):
        level = (light + sum(order[:n])) / n
        if n == shards or level <= order[n]:
            break
    return where, [max(0.0, level - x) for x in load]


def shard_by_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 8, tolerance: float = 0.002, bucket_bytes: int = 16 << 20, bucket_rows: int = 1000) -> DataFrame:
    """All rows and columns of docs with ``_size``, ``_shard`` and ``_slot``.

    Size is the text's UTF-8 bytes (null: none) plus 1. Equal texts share a
    shard; a null text is keyed as an empty one. Slots count each shard's rows
    from 0 without gaps, in key order, then by id; which of several rows with
    one text and id comes first isn't defined. Null and repeated ids are kept.
    An empty table gives no row. A group larger than a shard's even share makes
    its shard larger; the others stay even. If docs has a column of a new
    column's name, the new one has more underscores before it.

    Shards are exchanged in buckets, so many that none holds much over
    bucket_bytes, nor over bucket_rows or a fraction of a task's share of the
    rows; the exchange is as wide as there are buckets. Rows of a large group
    are dealt into buckets of their own.
    """
    spark = C.prepare(docs.sparkSession)
    size_name, shard_name, slot_name = (C.free_name(docs, n) for n in ("_size", "_shard", "_slot"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.xxhash64(text).alias("key"))
    groups = C.stored(keyed.groupBy("key").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")), "groups")
    total, n_rows = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.sum("rows"), F.lit(0))).first()
    mean = total / shards
    limit = tolerance * mean
    few = max(bucket_rows, n_rows // (16 * C.parallelism(spark)))
    large = groups.where(F.col("bytes") > limit).collect()  # at most shards / tolerance
    heavy = [(r["key"], r["bytes"]) for r in large]
    light = groups.where(F.col("bytes") <= limit)
    where, shares = place_heavy(heavy, total - sum(n for _, n in heavy), shards)
    targets = np.cumsum(shares)[:-1].tolist()
    cut = splitters(light, targets, limit / 2) if total else []

    buckets = max(1, math.ceil(mean / bucket_bytes), math.ceil(n_rows / shards / few))
    rows, base = [], buckets
    for r in sorted(large, key=lambda r: r["key"]):
        parts = max(1, math.ceil(r["bytes"] / bucket_bytes), math.ceil(r["rows"] / few))
        rows.append((r["key"], where[r["key"]], base, parts))
        base += parts
    width = max(C.parallelism(spark), shards * buckets + base - buckets)
    named = spark.createDataFrame(rows, "key long, own_shard int, first int, parts int")

    def sums(values: list[Column]) -> Column:
        out = F.lit(0)
        for v in values:
            out = out + v
        return out

    shard = sums([(F.col("key") >= F.lit(c)).cast("int") for c in cut])
    lows = F.array(*[F.lit(float(b)) for b in [LOW, *cut, HIGH]])
    lo, hi = F.element_at(lows, F.col("shard") + 1), F.element_at(lows, F.col("shard") + 2)
    inside = F.least(F.lit(buckets - 1), F.greatest(F.lit(0), F.floor((F.col("key").cast("double") - lo) / F.greatest(hi - lo, F.lit(1.0)) * buckets).cast("int")))
    own = F.col("first") + F.pmod(F.xxhash64("id", "row"), F.col("parts")).cast("int")
    dealt = keyed.join(F.broadcast(named), "key", "left").withColumn("shard", F.coalesce("own_shard", shard))
    dealt = dealt.select("row", "id", "size", "key", "shard", F.when(F.col("own_shard").isNotNull(), own).otherwise(inside).alias("bucket"))
    counts = dealt.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    starts = counts.select("shard", "bucket", F.coalesce(before, F.lit(0)).alias("before"))
    nth = F.row_number().over(W.partitionBy("shard", "bucket").orderBy("key", "id")) - 1
    ranked = dealt.repartition(width, "shard", "bucket").withColumn("nth", nth.cast("long"))
    if shards * buckets + base <= 500_000:  # 16 bytes each
        starts = F.broadcast(starts)
    joined = ranked.join(starts, ["shard", "bucket"])
    return joined.select("row.*", F.col("size").alias(size_name), F.col("shard").cast("int").alias(shard_name), (F.col("nth") + F.col("before")).alias(slot_name))
