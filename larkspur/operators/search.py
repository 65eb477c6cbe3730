"""Exact retrieval: scan, filter, guard, score, collapse, top-k; fusion and reranking."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur import errors as E
from larkspur.functions import metadata as M
from larkspur.functions import vector as V
from larkspur.functions.text import parent_of

#: Queries that meet a part of the rows at once; rows of a part, while there are fewer parts than tasks; vector components of a block or part.
QUERY_BLOCK, PART_ROWS, VALUES = 16_000, 1000, 4 << 20


def _top(k: int) -> int:
    if k < 0:
        raise ValueError("top_k must not be negative")
    return k


def collapse(hits: DataFrame, *keys: str) -> DataFrame:
    """Best score of each parent."""
    return hits.groupBy(*keys, parent_of(F.col("identifier")).alias("identifier")).agg(F.max("score").alias("score"))


def find_similar(store: DataFrame, query: list[float], top_k: int = 5, filters: dict | None = None, collapse_chunks: bool = False, collection: str | None = None, threshold: float | None = None, arrow: bool = False) -> DataFrame:
    """(identifier, score, rank) of the nearest rows; ties to the smaller id. Other dimensions are skipped."""
    M.prepare(store.sparkSession)
    rows = store if collection is None else store.where(F.col("collection") == collection)
    if filters:
        rows = rows.where(M.matches(F.col("metadata"), filters))
    rows = rows.where(F.size("vector") == len(query))
    score = V.cosine_arrow(query)(F.col("vector")) if arrow else V.cosine_to(query, F.col("vector"))
    hits = rows.select("identifier", score.alias("score"))
    if collapse_chunks:
        hits = collapse(hits)
    if threshold is not None:
        hits = hits.where(F.col("score") >= threshold)
    best = hits.orderBy(F.desc("score"), "identifier").limit(_top(top_k))
    return best.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "identifier")))  # k rows


def find_similar_many(store: DataFrame, queries: DataFrame, top_k: int = 5, collapse_chunks: bool = False, exclude_self: bool = False) -> DataFrame:
    """The same for a set of queries (query_id, query) of any size: bounded blocks of queries meet bounded parts of the rows.

    Each pair of a block and a part is one matrix product, of which each query's
    top_k remain; they are merged. exclude_self compares ids as text.
    """
    spark = store.sparkSession
    rows = store.select("identifier", "vector").where(F.col("vector").isNotNull())
    asked = queries.select("query_id", "query").where(F.col("query").isNotNull())
    if exclude_self:
        rows, asked = rows.where(F.col("identifier").isNotNull()), asked.where(F.col("query_id").isNotNull())
    rows, asked = _floats(rows, "vector"), _floats(asked, "query")
    many = lambda df, c: df.agg(F.count("*"), F.coalesce(F.sum(F.size(c)), F.lit(0))).first()
    (n, row_values), (m, query_values) = many(rows, "vector"), many(asked, "query")
    wide = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    blocks = max(1, -(-m // QUERY_BLOCK), -(-query_values // VALUES))
    parts = max(1, min(wide, -(-n // PART_ROWS)), -(-row_values // VALUES))
    dealt = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    name = parent_of(F.col("identifier")) if collapse_chunks else F.col("identifier")
    rows = rows.select(name.alias("identifier"), F.col("identifier").cast("string").alias("own"), "vector", dealt("identifier", parts).alias("_part"), each(blocks).alias("_block"))
    asked = asked.select("query_id", F.col("query_id").cast("string").alias("own"), "query", dealt("query_id", blocks).alias("_block"), each(parts).alias("_part"))
    kept, score = max(1, _top(top_k)), T.StructField("score", T.DoubleType())

    def meet(members: pa.Table, block: pa.Table) -> pa.Table:
        return _meet(members, block, kept, collapse_chunks, exclude_self)

    schema = T.StructType([asked.schema["query_id"], rows.schema["identifier"], score])
    hits = rows.groupBy("_part", "_block").cogroup(asked.groupBy("_part", "_block")).applyInArrow(meet, _nullable(schema))
    if collapse_chunks:
        hits = hits.groupBy("query_id", "identifier").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "identifier"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= top_k)


def _nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType) for f in schema])


def _floats(df: DataFrame, column: str) -> DataFrame:
    """Vectors of other numbers than floats as doubles."""
    return df if df.schema[column].dataType.elementType == T.FloatType() else df.withColumn(column, F.col(column).cast("array<double>"))


def _meet(members: pa.Table, block: pa.Table, k: int, collapsed: bool, exclude_self: bool) -> pa.Table:
    """(query_id, identifier, score): the k best of a part of the rows for each query of a block, among rows of its length."""
    members, block = members.combine_chunks(), block.combine_chunks()
    vectors, asked = (pa.concat_arrays(t.column(c).chunks) if len(t) else None for t, c in ((members, "vector"), (block, "query")))
    picked: list[tuple] = []
    if vectors is not None and asked is not None:
        ids = members.column("identifier")
        order = pc.rank(ids, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64)
        own_row, own_query = np.full(len(members), -2), np.full(len(block), -1)
        if exclude_self:
            known = pc.unique(block.column("own"))
            own_row, own_query = (pc.fill_null(pc.index_in(t.column("own"), value_set=known), -2).to_numpy().astype(np.int64) for t in (members, block))
        row_length, query_length = (pc.list_value_length(x).to_numpy() for x in (vectors, asked))
        for dim in np.intersect1d(row_length, query_length).tolist():
            at, of = np.flatnonzero(row_length == dim), np.flatnonzero(query_length == dim)
            rows, queries = V.Points(vectors.take(pa.array(at)), dim), V.Points(asked.take(pa.array(of)), dim)
            group = order[at] if collapsed else np.arange(len(at))
            with np.errstate(all="ignore"):
                picked += [(of[q], at[r], score, null) for q, r, score, null in V.nearest(rows, queries, k, group, order[at], own_row[at], own_query[of])]
    q, r, score, null = (np.concatenate([np.zeros(0, kind), *x]) for kind, x in zip((np.int64, np.int64, np.float64, bool), zip(*picked) if picked else [()] * 4))
    return pa.table({"query_id": block.column("query_id").take(pa.array(q)), "identifier": members.column("identifier").take(pa.array(r)), "score": pa.array(score, mask=null)})


def reciprocal_rank_fusion(semantic: DataFrame, keyword: DataFrame, top_k: int = 5, semantic_weight: float = 0.7, keyword_weight: float = 0.3, k: int = 60) -> DataFrame:
    """Sum of weight / (60 + rank) over both rankings (identifier, rank); ties by semantic, then keyword rank.

    A repeated keyword id counts each time; a weight of 0 leaves its ids in, with no score.
    """
    if semantic_weight < 0 or keyword_weight < 0:
        raise E.EngineError("weights must not be negative", E.WEIGHT_NEGATIVE)
    if semantic_weight == 0 and keyword_weight == 0:
        raise E.EngineError("one weight must be above 0", E.WEIGHTS_ZERO)
    none = F.lit(None).cast("int")
    left = semantic.select("identifier", F.col("rank").cast("int").alias("s"), none.alias("w"))
    right = keyword.where(F.col("rank") <= 4 * top_k).select("identifier", none.alias("s"), F.col("rank").cast("int").alias("w"))
    part = F.coalesce(F.lit(semantic_weight) / (k + F.col("s")), F.lit(keyword_weight) / (k + F.col("w")))
    fused = left.union(right).groupBy("identifier").agg(F.sum(part).alias("score"), F.min("s").alias("s"), F.min("w").alias("w"))
    order = [F.desc("score"), F.asc_nulls_last("s"), F.asc_nulls_last("w"), F.asc("identifier")]
    best = fused.orderBy(*order).limit(_top(top_k))
    return best.select("identifier", "score", F.row_number().over(W.orderBy(*order)).alias("rank"))  # k rows


def hybrid(store: DataFrame, query: list[float], keyword: DataFrame, top_k: int = 5, semantic_weight: float = 0.7, keyword_weight: float = 0.3, filters: dict | None = None, collapse_chunks: bool = False) -> DataFrame:
    """Fusion of the 4 * top_k nearest rows and a keyword ranking; filters and collapsing touch the rows alone."""
    near = find_similar(store, query, 4 * top_k, filters, collapse_chunks)
    return reciprocal_rank_fusion(near, keyword, top_k, semantic_weight, keyword_weight)


def parse_ranking(response: Column) -> Column:
    """The first [...] of a reply as an array of ids; null if there is none or it is no JSON list of scalars."""
    inner = F.regexp_extract(response, r"\[([^\]]+)\]", 1)
    text = F.when(inner != "", F.concat(F.lit("["), inner, F.lit("]")))
    return F.when(F.try_parse_json(text).isNotNull(), F.from_json(text, "array<string>"))


def reorder(candidates: DataFrame, ranking: DataFrame) -> DataFrame:
    """candidates (query_id, identifier, score, rank) in the order of ranking (query_id, ids); the rest follow as they were.

    Unknown and repeated ids are ignored; a null ranking, or a lone candidate, changes nothing. Scores stay.
    """
    wanted = ranking.select("query_id", F.posexplode("ids").alias("at", "identifier")).groupBy("query_id", "identifier").agg(F.min("at").alias("at"))
    order = W.partitionBy("query_id").orderBy(F.asc_nulls_last("at"), "rank")
    return candidates.join(wanted, ["query_id", "identifier"], "left").select("query_id", "identifier", "score", F.row_number().over(order).alias("rank"))


def rerank_prompt(query: str, identifiers: list[str]) -> str:
    return f"Query: {query}\nCandidates: {', '.join(identifiers)}\nReturn the candidates as a JSON array of ids, most relevant first."


def find_similar_with_rerank(store: DataFrame, query: list[float], ask: Callable[[list[str]], str], top_k: int = 5, rerank_k: int = 20, filters: dict | None = None) -> DataFrame:
    """The first top_k of max(top_k, rerank_k) hits as ask's reply orders them; its failure keeps the order."""
    hits = find_similar(store, query, max(top_k, rerank_k), filters).withColumn("query_id", F.lit(0))
    rows = hits.orderBy("rank").collect()  # at most max(top_k, rerank_k)
    spark = store.sparkSession
    response = None
    if len(rows) > 1:
        try:
            response = ask([r["identifier"] for r in rows])
        except Exception:  # noqa: BLE001
            response = None
    fixed = spark.createDataFrame(rows, hits.schema)
    ranking = spark.createDataFrame([(0, response)], "query_id int, response string").select("query_id", parse_ranking(F.col("response")).alias("ids"))
    return reorder(fixed, ranking).where(F.col("rank") <= top_k).orderBy("rank").select("identifier", "score", "rank")
