"""From raw documents to packed training sequences, in four stages.

Each stage takes (spark, docs, sf_dir), works on every row that the stage
before it kept, and returns the columns of documents; the last returns packed
pieces. Rows are judged one by one, by a key of their place: rows with a null
doc_id, and rows that share one, stay or go by their own texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import common as C
from larkspur.llm.decontaminate import contamination
from larkspur.llm.near_duplicates import components
from larkspur.llm.packing import pack
from larkspur.llm.quality import score, train

ACCEPT = 0.7
#: Keys of dropped rows are broadcast up to this many (8 MB); beyond, the join is shuffled.
BROADCAST_KEYS = 1_000_000


def without(docs: DataFrame, key: str, dropped: DataFrame) -> DataFrame:
    """docs without the rows whose key is in dropped, and without the key."""
    keys = C.stored(dropped.select(key), "dropped")
    if keys.count() <= BROADCAST_KEYS:
        keys = F.broadcast(keys)
    return docs.join(keys, key, "left_anti").drop(key)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what the classifier accepts."""
    weights = train(docs, C.table(spark, sf_dir, "labels"))
    scored = score(docs, weights, keep=docs.columns, name="_score")
    return scored.where(F.col("_score") >= ACCEPT).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep each group's row of the smallest id (a null after all others): five-word shingles, similarity of 0.8 or more."""
    rows, key = C.with_row_key(docs)
    found = components(rows, id_col=key, k=5, num=80, den=100).select(F.col("doc_id").alias(key), "component_id")
    groups = C.stored(found.join(rows.select(key, F.col("doc_id").alias("id")), key), "groups")
    smallest = F.min(F.struct(F.col("id").isNull(), "id", key))[key].alias("best")
    best = C.stored(groups.groupBy("component_id").agg(smallest, F.count("*").alias("n")).where("n > 1").select("component_id", "best"), "best")
    return without(rows, key, groups.join(best, "component_id").where(F.col(key) != F.col("best")))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop rows that hold a ten-word passage of the benchmark."""
    rows, key = C.with_row_key(docs)
    found = contamination(rows, C.table(spark, sf_dir, "benchmark"), id_col=key)
    return without(rows, key, found.where("n_hit > 0").select(F.col("doc_id").alias(key)))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place the pieces of every document in sequences of 2048 tokens."""
    return pack(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("packing", packing)]

#: Training by gradient steps, tokenization and packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = C.stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
