"""Token ids as Parquet list columns that can be read selectively.

A file set holds one row a document, ascending by id over all files: ``part``
(the file's number), ``first`` (ids before the document in its part),
``n_tokens`` and ``tokens`` (list of int). Ids are dictionary-encoded (16 bits
an id for a 49k vocabulary), the sorted metadata columns delta-encoded (format
2.0); row groups and pages have set sizes, and page indexes let a reader fetch
the metadata, or a range of ids, without the other pages.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspur.llm import common as C
from larkspur.llm import kernels as K
from larkspur.llm import tokenize as T

SCHEMA = "id long, part int, first long, n_tokens long, tokens array<int>"
LAYOUT = {
    "compression": "zstd",
    "parquet.block.size": str(16 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary#id": "false",
    "parquet.enable.dictionary#first": "false",
    "parquet.enable.dictionary#n_tokens": "false",
}


def write_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end_id: int = 1, partitions: int | None = None) -> None:
    """Encode whole texts, append end_id to each, write them in ascending id order.

    A null text is an empty one and has the end id alone. Null ids come first.
    Rows that share an id follow each other in an order that any run repeats
    only if their texts are equal. An empty table writes no row. Other columns
    of docs are not read, whatever their names.
    """
    spark = C.prepare(docs.sparkSession)
    vocabulary = vocabulary or T.vocabulary_path()

    def encode(batches):
        part, first = TaskContext.get().partitionId(), 0
        for batch in K.runs(batches, 1):
            ids, size = T.with_end(*T.encoder(vocabulary).encode(batch.column(1)), end_id)
            stops = np.cumsum(size)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(np.full(len(size), part, np.int32)),
                    pa.array(first + stops - size),
                    pa.array(size),
                    pa.ListArray.from_arrays(np.concatenate([[0], stops]).astype(np.int32), pa.array(ids.astype(np.int32))),
                ],
                names=["id", "part", "first", "n_tokens", "tokens"],
            )
            first += int(stops[-1]) if len(stops) else 0

    chosen = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    dealt = chosen.repartitionByRange(partitions or C.parallelism(spark), "id").sortWithinPartitions("id", F.xxhash64("text"))
    dealt.mapInArrow(encode, SCHEMA).write.options(**LAYOUT).parquet(path)


def read_tokens(spark, path: str) -> DataFrame:
    return C.prepare(spark).read.schema(SCHEMA).parquet(path)


def token_index(spark, path: str) -> DataFrame:
    """(id, part, start, n_tokens): where each document begins in the whole run of ids.

    Reads the metadata columns alone; the token pages stay on disk.
    """
    meta = read_tokens(spark, path).select("id", "part", "first", "n_tokens")
    return meta.join(F.broadcast(part_starts(spark, path)), "part").select("id", "part", (F.col("part_start") + F.col("first")).alias("start"), "n_tokens")


def part_starts(spark, path: str) -> DataFrame:
    """(part, part_start): one row a written file, so as few as the write's partitions."""
    sums = read_tokens(spark, path).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    return sums.select("part", F.coalesce(before, F.lit(0)).alias("part_start"))


def digest(spark, path: str) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) from the ids as the files hold them."""

    def crc(batches):
        for batch in batches:
            lists = batch.column(3)
            offsets = lists.offsets.to_numpy()
            data = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), "<u4")
            sums = [zlib.crc32(data[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(np.diff(offsets).astype(np.int64)), pa.array(sums, pa.int64())],
                names=["id", "part", "first", "n_tokens", "ids_crc32"],
            )

    rows = read_tokens(spark, path).select("id", "part", "first", "tokens")
    rows = rows.mapInArrow(crc, "id long, part int, first long, n_tokens long, ids_crc32 long")
    starts = F.broadcast(part_starts(spark, path))
    return rows.join(starts, "part").select("id", (F.col("part_start") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")
