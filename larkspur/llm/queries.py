"""The opN_ queries: each applies its operator to whole tables and derives digest columns.

ORACLES is DuckDB SQL for those that SQL can express.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import common as C
from larkspur.llm.oracles import ORACLES


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspur.llm.decontaminate import contamination

    found = contamination(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspur.llm import quality as Q

    docs = C.table(spark, sf_dir, "documents")
    scored = Q.score(docs, Q.train(docs, C.table(spark, sf_dir, "labels")))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


#: verdict, host, path
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op2_url_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspur.llm.url_trust import judge

    return judge(C.table(spark, sf_dir, "pages"), RULES)


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspur.llm.html_text import extract

    return extract(C.table(spark, sf_dir, "pages"))


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspur.llm.nearest import search

    return search(C.table(spark, sf_dir, "embeddings"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspur.llm.packing import pack

    return pack(C.table(spark, sf_dir, "documents"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspur.llm.near_duplicates import components

    return components(C.table(spark, sf_dir, "documents"), k=3, num=90, den=100)


def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspur.llm import language_model as LM

    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    model = LM.train(docs.where(~held_out))
    scored = LM.score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.n_tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspur.llm.sharding import shard_by_bytes

    placed = shard_by_bytes(C.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return placed.select(
        "doc_id",
        F.col("_size").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        F.col("_shard").cast("int").alias("shard"),
        F.col("_slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspur.llm import token_files as TF

    docs = C.table(spark, sf_dir, "documents")
    path = C.scratch_path(spark, "tokens")
    TF.write_tokens(docs, path)
    return TF.digest(spark, path).select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32")


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_language_model": op6_language_model,
    "op7_sharding": op7_sharding,
    "op9_token_files": op9_token_files,
}
QUERIES |= {"op2_url_trust": op2_url_trust, "op3_html_text": op3_html_text, "op8_nearest": op8_nearest}
QUERIES["op10_quality"] = op10_quality
__all__ = ["ORACLES", "QUERIES"]
