"""Registered queries over the test tables, each with its DuckDB twin where SQL can express it."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspur.functions import codec as CO
from larkspur.functions import metadata as M
from larkspur.functions import text as T
from larkspur.functions import vector as V
from larkspur.operators import chunking as CH
from larkspur.operators import rag as R
from larkspur.operators import search as S
from larkspur.plans import ingest as I
from larkspur.plans import maintenance as MA
from larkspur.sources import store as ST

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    M.prepare(spark)
    return spark.read.parquet(f"{d}/{name}.parquet")


def vectors(spark: SparkSession, d: str) -> DataFrame:
    meta = F.concat(F.lit('{"label":'), F.col("label"), F.lit("}"))
    return table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("identifier"), F.col("embedding").alias("vector"), meta.alias("metadata"))


def vector_zero(spark: SparkSession, d: str) -> list[float]:
    return list(table(spark, d, "embeddings").where("vec_id = 0").select("embedding").first()[0])


def rounded(hits: DataFrame) -> DataFrame:
    return hits.withColumn("score", F.round("score", 6))


def others(spark: SparkSession, d: str) -> DataFrame:
    return vectors(spark, d).where("identifier <> '0'")


COS = "list_dot_product(e.embedding::DOUBLE[], q.v) / (sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_dot_product(q.v, q.v)))"
SCORED = f"WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0), s AS (SELECT e.vec_id, e.label, e.vec_id::VARCHAR AS identifier, {COS} AS score FROM embeddings e, q WHERE e.vec_id <> 0)"


def top_sql(where: str = "true", k: int = 5) -> str:
    return f"{SCORED} SELECT identifier, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, identifier)::INT AS rank FROM s WHERE {where} ORDER BY s.score DESC, identifier LIMIT {k}"


@query(top_sql())
def cosine_topk(spark, d):
    return rounded(S.find_similar(others(spark, d), vector_zero(spark, d)))


@query(top_sql())
def cosine_topk_arrow(spark, d):
    return rounded(S.find_similar(others(spark, d), vector_zero(spark, d), arrow=True))


@query("SELECT vec_id, round(CASE WHEN vec_id % 10 = 0 THEN 0.0 ELSE list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) END, 6) AS score FROM embeddings")
def cosine_pair(spark, d):
    other = F.when(F.col("vec_id") % 10 == 0, F.transform("embedding", lambda x: x * 0)).otherwise(F.col("embedding"))
    return table(spark, d, "embeddings").select("vec_id", F.round(V.cosine(F.col("embedding"), other), 6).alias("score"))


@query(top_sql("label = 3"))
def topk_filtered(spark, d):
    return rounded(S.find_similar(others(spark, d), vector_zero(spark, d), filters={"label": 3}))


@query(top_sql("vec_id % 2 = 1"))
def topk_dim_guard(spark, d):
    mixed = others(spark, d).withColumn("vector", F.when(F.col("identifier").cast("long") % 2 == 0, F.slice("vector", 1, 32)).otherwise(F.col("vector")))
    return rounded(S.find_similar(mixed, vector_zero(spark, d)))


@query(top_sql("score >= 0.30", 1000))
def topk_threshold(spark, d):
    return rounded(S.find_similar(others(spark, d), vector_zero(spark, d), 1000, threshold=0.30))


@query(
    "WITH q AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT q.qid::VARCHAR AS query_id, e.vec_id::VARCHAR AS identifier, "
    + COS
    + " AS score FROM embeddings e JOIN q ON e.vec_id <> q.qid), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, identifier)::INT AS rank FROM s) SELECT query_id, identifier, round(score, 6) AS score, rank FROM r WHERE rank <= 5"
)
def topk_multi_query(spark, d):
    v = vectors(spark, d)
    queries = v.where(F.col("identifier").cast("long") % 50 == 0).select(F.col("identifier").alias("query_id"), F.col("vector").alias("query"))
    return rounded(S.find_similar_many(v, queries, exclude_self=True))


@query(SCORED + ", c AS (SELECT (vec_id % 50)::VARCHAR AS identifier, max(score) AS score FROM s GROUP BY ALL) SELECT identifier, round(score, 6) AS score, row_number() OVER (ORDER BY c.score DESC, identifier)::INT AS rank FROM c ORDER BY c.score DESC, identifier LIMIT 5")
def topk_collapse(spark, d):
    n = F.col("identifier").cast("long")
    chunked = others(spark, d).withColumn("identifier", F.concat_ws("_chunk_", (n % 50).cast("string"), F.floor(n / 50).cast("string")))
    return rounded(S.find_similar(chunked, vector_zero(spark, d), collapse_chunks=True))


def keyword_ranks(spark, d, repeat: bool = False) -> DataFrame:
    ids = table(spark, d, "embeddings").where("vec_id between 1 and 20").select(F.col("vec_id").cast("string").alias("identifier"), F.col("vec_id").cast("int").alias("rank"))
    return ids.union(ids.select("identifier", F.lit(20))) if repeat else ids


def fused_sql(sw: float, kw: float, keyword: str) -> str:
    return f"""{SCORED}, sem AS (SELECT identifier, row_number() OVER (ORDER BY score DESC, identifier) AS rank FROM s), near AS (SELECT * FROM sem WHERE rank <= 20),
    k AS ({keyword}), u AS (SELECT identifier, {sw}::DOUBLE / (60 + rank) AS p, rank AS sr, NULL AS kr FROM near UNION ALL SELECT identifier, {kw}::DOUBLE / (60 + rank), NULL, rank FROM k WHERE rank <= 20),
    g AS (SELECT identifier, sum(p) AS score, min(sr) AS sr, min(kr) AS kr FROM u GROUP BY identifier),
    r AS (SELECT identifier, score, row_number() OVER (ORDER BY score DESC, sr NULLS LAST, kr NULLS LAST, identifier)::INT AS rank FROM g) SELECT identifier, round(score, 9) AS score, rank FROM r WHERE rank <= 5"""


KEYWORD = "SELECT vec_id::VARCHAR AS identifier, vec_id::INT AS rank FROM embeddings WHERE vec_id BETWEEN 1 AND 20"


def fused(spark, d, repeat=False, **weights) -> DataFrame:
    return S.hybrid(others(spark, d), vector_zero(spark, d), keyword_ranks(spark, d, repeat), **weights).withColumn("score", F.round("score", 9))


@query(fused_sql(0.7, 0.3, KEYWORD))
def rrf_hybrid(spark, d):
    return fused(spark, d)


@query(fused_sql(1.0, 0.0, KEYWORD))
def rrf_semantic_only(spark, d):
    return fused(spark, d, semantic_weight=1.0, keyword_weight=0.0)


@query(fused_sql(0.7, 0.3, KEYWORD + " UNION ALL SELECT vec_id::VARCHAR, 20 FROM embeddings WHERE vec_id BETWEEN 1 AND 20"))
def rrf_keyword_dup(spark, d):
    return fused(spark, d, repeat=True)


@query(SCORED + ", t AS (SELECT identifier, score, row_number() OVER (ORDER BY score DESC, identifier) AS r FROM s QUALIFY r <= 20) SELECT identifier, round(score, 6) AS score, row_number() OVER (ORDER BY CASE WHEN r % 2 = 0 THEN -r END NULLS LAST, r)::INT AS rank FROM t")
def rerank_reorder(spark, d):
    hits = S.find_similar(others(spark, d), vector_zero(spark, d), 20).withColumn("query_id", F.lit(0))
    even = hits.where(F.col("rank") % 2 == 0)
    order = even.groupBy("query_id").agg(F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("rank", "identifier")))), lambda x: x["identifier"]).alias("ids"))
    return rounded(S.reorder(hits, order)).drop("query_id")


@query("SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN '3,1,' || vec_id ELSE NULL END AS ids FROM embeddings")
def rerank_parse(spark, d):
    reply = F.when(F.col("vec_id") % 3 == 0, F.concat(F.lit('Best first: ["3", "1", "'), F.col("vec_id"), F.lit('"] done [9]'))).when(F.col("vec_id") % 3 == 1, "no list").otherwise("[not json")
    return table(spark, d, "embeddings").select("vec_id", F.array_join(S.parse_ranking(reply), ",").alias("ids"))


NORM = "substring(regexp_replace(trim(text, E' \\t\\n\\r\\x0b'), '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g'), 1, 6000)"


@query(f"SELECT doc_id, md5({NORM}) AS content_hash, length({NORM})::INT AS n FROM documents")
def normalise_hash(spark, d):
    n = T.normalise(F.col("text"))
    return table(spark, d, "documents").select("doc_id", T.content_hash(n).alias("content_hash"), F.length(n).alias("n"))


def doc_rows(spark, d) -> DataFrame:
    meta = F.concat(F.lit('{"lang":"'), F.col("lang"), F.lit('"}'))
    return table(spark, d, "documents").select(F.lit("docs").alias("collection"), F.col("doc_id").cast("string").alias("identifier"), "text", meta.alias("metadata"), "doc_id")


def stored_docs(spark, d) -> DataFrame:
    rows = doc_rows(spark, d)
    return rows.select("collection", "identifier", F.array(F.lit(0.0).cast("float")).alias("vector"), T.content_hash(T.normalise(F.col("text"))).alias("content_hash"), "metadata", F.lit(1).cast("long").alias("tstamp"))


@query("SELECT doc_id::VARCHAR AS identifier, CASE WHEN doc_id % 5 = 0 THEN 'embed' WHEN doc_id % 7 = 0 THEN 'embed' WHEN doc_id % 11 = 0 THEN 'metadata' ELSE 'skip' END AS action FROM documents")
def hash_diff_actions(spark, d):
    store = stored_docs(spark, d).where(F.col("identifier").cast("long") % 5 != 0)
    text = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("new "), F.col("text"))).otherwise(F.col("text"))
    meta = F.when(F.col("doc_id") % 11 == 0, F.lit('{"lang":"xx"}')).otherwise(F.col("metadata"))
    return I.actions(store, doc_rows(spark, d).withColumn("text", text).withColumn("metadata", meta)).select("identifier", "action")


@query("SELECT doc_id::VARCHAR AS identifier, CASE WHEN doc_id % 3 = 0 THEN 9 ELSE 1 END::BIGINT AS tstamp FROM documents")
def upsert_merge(spark, d):
    old = stored_docs(spark, d)
    new = old.where(F.col("identifier").cast("long") % 3 == 0).withColumn("tstamp", F.lit(9).cast("long"))
    return ST.upsert(old.where(F.col("identifier").cast("long") % 2 == 0).unionByName(old.where(F.col("identifier").cast("long") % 2 == 1)), new).select("identifier", "tstamp")


@query("SELECT doc_id::VARCHAR AS identifier, CASE WHEN doc_id % 4 = 0 THEN '{\"a\":1}' ELSE '{\"lang\":\"' || lang || '\"}' END AS metadata, CASE WHEN doc_id % 4 = 0 THEN 9 ELSE 1 END::BIGINT AS tstamp FROM documents")
def metadata_update(spark, d):
    old = stored_docs(spark, d)
    new = old.where(F.col("identifier").cast("long") % 4 == 0).select("collection", "identifier", F.lit('{"a":1}').alias("metadata"))
    return ST.update_metadata(old, new, 9).select("identifier", "metadata", F.col("tstamp").cast("long").alias("tstamp"))


@query(
    """WITH RECURSIVE p AS (SELECT doc_id, list_filter(list_transform(string_split_regex(replace(trim(text, E' \\t\\n\\r\\x0b'), E'\\n', E'\\n\\n'), '\\n{2,}'), lambda x: trim(x, E' \\t\\n\\r\\x0b')), lambda x: x <> '' AND x <> '0') AS ps FROM documents),
    f AS (SELECT doc_id, ps, 1 AS i, ''::VARCHAR AS cur, []::VARCHAR[] AS done FROM p
      UNION ALL SELECT doc_id, ps, i + 1, CASE WHEN cur = '' THEN ps[i] WHEN length(cur) < 100 AND length(cur) + 2 + length(ps[i]) <= 800 THEN cur || E'\\n\\n' || ps[i] ELSE ps[i] END,
        CASE WHEN cur = '' OR (length(cur) < 100 AND length(cur) + 2 + length(ps[i]) <= 800) THEN done ELSE list_append(done, cur) END FROM f WHERE i <= len(ps)),
    e AS (SELECT doc_id, CASE WHEN cur = '' THEN done WHEN length(cur) < 100 AND len(done) > 0 THEN list_append(done[1:len(done) - 1], done[len(done)] || E'\\n\\n' || cur) ELSE list_append(done, cur) END AS chunks FROM f WHERE i = len(ps) + 1)
    SELECT doc_id, len(chunks)::INT AS n, md5(array_to_string(chunks, '|')) AS h FROM e"""
)
def paragraph_chunks(spark, d):
    chunks = CH.paragraphs(F.regexp_replace("text", "\n", "\n\n"))
    return table(spark, d, "documents").select("doc_id", chunks.alias("c")).select("doc_id", F.size("c").alias("n"), F.md5(F.array_join("c", "|").cast("binary")).alias("h"))


def windows_sql(size: int, overlap: int, tail: str) -> str:
    """One window a step, cut behind the last sentence sign of its last 120 characters."""
    space = "E' \\t\\n\\r\\x0b'"
    last = lambda sign: f"(CASE WHEN strpos(reverse(seg), ' {sign}') > 0 THEN length(seg) - strpos(reverse(seg), ' {sign}') - 1 ELSE 0 END)"
    stop = "to_ >= n" if tail == "stop" else "false"
    return f"""WITH RECURSIVE t AS (SELECT doc_id, trim(coalesce(text, ''), {space}) AS x FROM documents),
    w(doc_id, x, n, i, done) AS (SELECT doc_id, x, length(x), 0::BIGINT, CASE WHEN length(x) BETWEEN 1 AND {size} THEN [x] ELSE []::VARCHAR[] END FROM t
      UNION ALL SELECT doc_id, x, n, CASE WHEN {stop} THEN n ELSE greatest(i + 1, to_ - {overlap}) END, CASE WHEN piece <> '' THEN list_append(done, piece) ELSE done END FROM (
        SELECT *, trim(substring(x, i + 1, to_ - i), {space}) AS piece FROM (
          SELECT *, CASE WHEN edge < n AND greatest({last('.')}, {last('?')}, {last('!')}) > 0 THEN back + greatest({last('.')}, {last('?')}, {last('!')}) + 2 ELSE edge END AS to_ FROM (
            SELECT *, substring(x, back + 1, edge - back) AS seg FROM (
              SELECT *, greatest(i, edge - 120) AS back FROM (SELECT *, least(i + {size}, n) AS edge FROM w WHERE n > {size} AND i < n)))))),
    e AS (SELECT doc_id, done FROM w WHERE n <= {size} OR i >= n)
    SELECT doc_id, len(done)::INT AS n, md5(array_to_string(done, '|')) AS h FROM e"""


@query(windows_sql(800, 100, "reference"))
def sliding_chunks(spark, d):
    return table(spark, d, "documents").select("doc_id", CH.windows(800, 100)("text").alias("c")).select("doc_id", F.size("c").alias("n"), F.md5(F.array_join("c", "|").cast("binary")).alias("h"))


@query(windows_sql(800, 100, "stop"))
def sliding_chunks_stop_at_end(spark, d):
    return table(spark, d, "documents").select("doc_id", CH.windows(800, 100, "stop")("text").alias("c")).select("doc_id", F.size("c").alias("n"), F.md5(F.array_join("c", "|").cast("binary")).alias("h"))


@query("SELECT doc_id || '_chunk_' || i AS identifier, string_split(text, E'\\n')[i + 1] AS text FROM (SELECT doc_id, text, unnest(range(len(string_split(text, E'\\n')))) AS i FROM documents)")
def chunk_ids(spark, d):
    return CH.chunk_rows(table(spark, d, "documents"), "doc_id", F.split("text", "\n")).select("identifier", "text")


def chunk_store(spark, d) -> DataFrame:
    n = F.col("doc_id")
    name = F.when(n % 4 == 0, F.concat_ws("_chunk_", (n % 10).cast("string"), n.cast("string"))).when(n % 4 == 1, F.concat((n % 10).cast("string"), F.lit("_chunk_x"), n)).when(n % 4 == 2, F.concat((n % 10).cast("string"), F.lit("_chunk_1_chunk_"), n)).otherwise(n.cast("string"))
    return table(spark, d, "documents").select(F.lit("docs").alias("collection"), name.alias("identifier"), "doc_id")


PARENTS = "VALUES ('0'), ('2'), ('4')"


def parents(spark) -> DataFrame:
    return spark.createDataFrame([("0",), ("2",), ("4",)], "parent_id string")


@query("SELECT (doc_id % 10) || '_chunk_' || doc_id AS identifier FROM documents WHERE doc_id % 4 = 0 AND doc_id % 10 IN (0, 2, 4)")
def own_chunk(spark, d):
    return CH.own_chunks(chunk_store(spark, d), parents(spark)).select("identifier")


@query("SELECT (doc_id % 10) || '_chunk_' || doc_id AS identifier FROM documents WHERE doc_id % 4 = 0 AND doc_id % 10 IN (0, 2, 4) AND doc_id % 3 <> 0")
def stale_sweep(spark, d):
    current = chunk_store(spark, d).where("doc_id % 3 = 0")
    return CH.stale(chunk_store(spark, d), current, parents(spark)).select("identifier")


@query("SELECT count(*) FILTER (doc_id % 4 = 0 AND doc_id % 10 IN (0, 2, 4)) AS deleted, count(*) FILTER (NOT (doc_id % 4 = 0 AND doc_id % 10 IN (0, 2, 4))) AS kept FROM documents")
def delete_chunked(spark, d):
    kept, n = CH.delete_chunked(chunk_store(spark, d), parents(spark))
    return kept.agg(F.lit(n).cast("long").alias("deleted"), F.count("*").alias("kept"))


def live(spark, d) -> DataFrame:
    return table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("identifier"))


@query("SELECT doc_id::VARCHAR AS identifier FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def orphan_delete(spark, d):
    return MA.orphans(stored_docs(spark, d), live(spark, d)).select("identifier")


@query("SELECT doc_id::VARCHAR AS identifier FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def delete_by_ids(spark, d):
    keys = live(spark, d).withColumn("collection", F.lit("docs"))
    return ST.delete(stored_docs(spark, d), keys)[0].select("identifier")


@query("SELECT source AS collection, count(*) AS cnt FROM documents WHERE source <> 'src0' GROUP BY source")
def clear_collection(spark, d):
    rows = table(spark, d, "documents").withColumnRenamed("source", "collection")
    return ST.clear(rows, "src0", confirm=True).groupBy("collection").agg(F.count("*").alias("cnt"))


def event_rows(spark, d) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_type").alias("collection"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("tstamp"))


@query("SELECT event_type AS collection, count(*) AS cnt, floor(epoch(max(ts)))::BIGINT AS last_indexed FROM events GROUP BY event_type")
def collection_stats(spark, d):
    return MA.stats(event_rows(spark, d))


@query("SELECT event_type AS collection, format('{:,}', count(*)) AS cnt, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_indexed FROM events GROUP BY event_type")
def stats_formatted(spark, d):
    return MA.stats_formatted(MA.stats(event_rows(spark, d)))


@query("SELECT event_id FROM events WHERE json_extract_string(props, '$.k')::INT = 42")
def metadata_typed_eq(spark, d):
    return table(spark, d, "events").where(M.matches(F.col("props"), {"k": 42})).select("event_id")


@query("SELECT event_id FROM events WHERE event_id % 3 < 2 AND json_extract_string(props, '$.k')::INT = 42")
def metadata_numeric_domain(spark, d):
    n, k = F.col("event_id") % 3, F.get_json_object("props", "$.k")
    props = F.when(n == 0, F.col("props")).when(n == 1, F.concat(F.lit('{"k":'), k, F.lit(".0}"))).otherwise(F.concat(F.lit('{"k":"'), k, F.lit('"}')))
    return table(spark, d, "events").where(M.matches(props, {"k": 42.0})).select("event_id")


@query("SELECT count(*) AS n FROM events WHERE false")
def metadata_missing_key(spark, d):
    return table(spark, d, "events").where(M.matches(F.col("props"), {"absent": 1})).agg(F.count("*").alias("n"))


@query("SELECT event_id FROM events WHERE event_id % 4 = 0 AND json_extract_string(props, '$.k')::INT = 7")
def metadata_bad_json(spark, d):
    n = F.col("event_id") % 4
    props = F.when(n == 0, F.col("props")).when(n == 1, F.lit('{"k":')).when(n == 2, F.lit("[]"))
    return table(spark, d, "events").where(M.matches(props, {"k": 7})).select("event_id")


@query("SELECT event_id, event_id % 2 = 1 AS drifted FROM events")
def metadata_drift(spark, d):
    k = F.get_json_object("props", "$.k")
    a = F.concat(F.lit('{"a":"x","k":'), k, F.lit("}"))
    b = F.when(F.col("event_id") % 2 == 1, F.concat(F.lit('{"k":"'), k, F.lit('","a":"x"}'))).otherwise(F.concat(F.lit('{"k":'), k, F.lit(',"a":"x"}')))
    return table(spark, d, "events").select("event_id", (M.canonical_column(a) != M.canonical_column(b)).alias("drifted"))


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 4")
def history_truncate(spark, d):
    return R.truncate(table(spark, d, "conversations"), 2).select("conv_id", "turn", "role")


@query("SELECT role, count(*) AS n FROM conversations WHERE role IN ('user', 'assistant') GROUP BY role")
def history_roles(spark, d):
    """Roles as appending checks them: another role would raise."""
    rows = table(spark, d, "conversations").where(F.col("role").isin(*R.ROLES))
    none = F.array().cast("array<struct<role: string, content: string>>")
    return rows.select(F.element_at(R.append(none, F.col("role"), F.col("text")), -1)["role"].alias("role")).groupBy("role").agg(F.count("*").alias("n"))


@query("SELECT conv_id, 'system' AS first_role, list(role ORDER BY turn)[1] AS next_role, 'Documents:' || E'\\n\\n' || 'b1' || E'\\n\\n' || 'b2' || E'\\n\\n' || 'Question: ' || conv_id AS asked, count(*)::INT + 2 AS n FROM conversations WHERE role IN ('user', 'assistant') GROUP BY conv_id")
def rag_messages(spark, d):
    rows = table(spark, d, "conversations").where(F.col("role").isin(*R.ROLES))
    history = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("h"))
    past = F.transform("h", lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content")))
    made = history.select("conv_id", R.build_messages(F.col("conv_id").cast("string"), F.array(F.lit("b1"), F.lit("b2")), past).alias("m"))
    return made.select("conv_id", F.col("m")[0]["role"].alias("first_role"), F.col("m")[1]["role"].alias("next_role"), F.element_at("m", -1)["content"].alias("asked"), F.size("m").alias("n"))


@query(SCORED + ", t AS (SELECT vec_id, identifier, score, row_number() OVER (ORDER BY score DESC, identifier) AS r FROM s QUALIFY r <= 5) SELECT 0 AS query_id, string_agg('[' || identifier || '] ' || lang || E'\\n' || substring(regexp_replace(text, '<[^>]*>', '', 'g'), 1, 80), '|' ORDER BY r) AS blocks FROM t JOIN documents ON doc_id = vec_id")
def context_blocks(spark, d):
    hits = S.find_similar(others(spark, d), vector_zero(spark, d)).withColumn("query_id", F.lit(0))
    records = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("identifier"), F.col("lang").alias("title"), "text")
    return R.context_blocks(hits, records, length=80, threshold=-1.0).select("query_id", F.array_join("blocks", "|").alias("blocks"))


@query("SELECT doc_id::VARCHAR AS request_id, i::INT AS pos, string_split(lang || ' ' || source, ' ')[i + 1] AS delta FROM documents, (VALUES (0), (1)) v(i)")
def sse_parse(spark, d):
    line = lambda c: F.concat(F.lit('data: {"choices":[{"delta":{"content":"'), F.col(c), F.lit('"}}]}\n'))
    body = F.concat(F.lit(": keep-alive\n\n"), line("lang"), F.lit("data: {bad\n"), line("source"), F.lit("data: [DONE]\n"), line("lang"))
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("request_id"), body.alias("b"))
    pieces = docs.select("request_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.floor(F.length("b") / 7).cast("int")), lambda i: F.substring(F.col("b"), i * 7 + 1, F.lit(7)))).alias("seq", "fragment"))
    return R.parse_streams(pieces)


@query("SELECT vec_id, CASE vec_id % 4 WHEN 0 THEN 'packed' WHEN 1 THEN 'converted' ELSE 'failed' END AS status, CASE vec_id % 4 WHEN 2 THEN 1700004003 WHEN 3 THEN 1700004004 END AS error, CASE WHEN vec_id % 4 = 0 THEN 1.0 WHEN vec_id % 4 = 1 THEN round(embedding[1]::DOUBLE, 6) END AS first FROM embeddings")
def legacy_migrate(spark, d):
    n, v = F.col("vec_id") % 4, F.col("embedding")
    blob = F.when(n == 0, F.unhex(F.lit("0000803f"))).when(n == 1, F.to_json(v).cast("binary")).when(n == 2, F.lit("[0.1,").cast("binary")).otherwise(F.lit("[]").cast("binary"))
    moved = MA.migrate(table(spark, d, "embeddings").select("vec_id", blob.alias("vector")))
    first = F.when(F.col("error").isNull(), F.round(F.element_at(CO.unpack("vector")["vector"], 1).cast("double"), 6))
    return moved.select("vec_id", "status", "error", first.alias("first"))


@query("SELECT vec_id, 4 * len(embedding) AS bytes, list_transform(embedding, lambda x: round(x::DOUBLE, 6)) AS vector FROM embeddings")
def codec_roundtrip(spark, d):
    packed = table(spark, d, "embeddings").select("vec_id", CO.pack("embedding").alias("blob")).select("vec_id", "blob", CO.unpack("blob").alias("u"))
    return packed.select("vec_id", F.length("blob").cast("long").alias("bytes"), F.transform("u.vector", lambda x: V.rounded(x.cast("double"), 6)).alias("vector"))


@query("SELECT doc_id, md5('[\"docs\", \"' || doc_id || '\", 5, [[\"lang\", \"' || lang || '\"], [\"n\", 1]], false, 3]') AS cache_key FROM documents")
def cache_key(spark, d):
    @F.pandas_udf("string")
    def key(ids: pd.Series, langs: pd.Series) -> pd.Series:
        return pd.Series([MA.ResultCache.key("docs", str(i), 5, {"n": 1, "lang": lang}, False, 3) for i, lang in zip(ids, langs)])

    return table(spark, d, "documents").select("doc_id", key("doc_id", "lang").alias("cache_key"))


#: The offline embedding in SQL: words' md5 gives bucket and sign, sums are scaled to unit length in single precision.
EMBEDDED = f"""WITH n AS (SELECT doc_id::VARCHAR AS identifier, md5({NORM}) AS content_hash, {NORM} AS x FROM documents),
    w AS (SELECT identifier, md5(word) AS h FROM (SELECT identifier, unnest(string_split(lower(x), ' ')) AS word FROM n) WHERE word <> ''),
    s AS (SELECT identifier, ('0x' || substring(h, 1, 7))::BIGINT % 64 AS b, sum(CASE WHEN substring(h, 8, 1) < '8' THEN 1.0 ELSE -1.0 END)::DOUBLE AS v FROM w GROUP BY ALL),
    l AS (SELECT identifier, sqrt(sum(v * v)) AS size FROM s GROUP BY identifier),
    f AS (SELECT n.identifier, n.content_hash, g.b, coalesce(s.v, 0.0) AS v, coalesce(l.size, 0.0) AS size FROM n CROSS JOIN range(64) g(b) LEFT JOIN s ON s.identifier = n.identifier AND s.b = g.b LEFT JOIN l ON l.identifier = n.identifier)
    SELECT identifier, content_hash, list(round((CASE WHEN size > 0 THEN v / size ELSE v END)::FLOAT::DOUBLE, 5) ORDER BY b) AS vector FROM f GROUP BY ALL"""


@query(EMBEDDED)
def ingest_embeddings(spark, d):
    empty = spark.createDataFrame([], ST.SCHEMA)
    return I.ingest(empty, doc_rows(spark, d)).select("identifier", "content_hash", F.transform("vector", lambda x: F.round(x.cast("double"), 5)).alias("vector"))


def scratch_store(spark) -> ST.VectorStore:
    """An empty store in the folder that driver and executors share; one of our own only in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='larkspur-')}"
    return ST.VectorStore(spark, f"{folder.rstrip('/')}/larkspur/store-{uuid.uuid4().hex}")


def written_store(spark, d) -> ST.VectorStore:
    """A store of all documents after three commits: everything, a metadata change, deletions."""
    store, rows = scratch_store(spark), stored_docs(spark, d).withColumn("collection", F.when(F.col("identifier").cast("long") % 2 == 0, "even").otherwise("odd"))
    n = F.col("identifier").cast("long")
    store.commit(rows, expected=0)
    store.commit(ST.update_metadata(store.read(), rows.where(n % 4 == 0).select(*ST.KEY, F.lit('{"a":1}').alias("metadata")), 9), expected=1)
    store.commit(ST.delete(store.read(), rows.where(n % 5 == 0))[0], expected=2)
    return store


KEPT = "SELECT doc_id, doc_id::VARCHAR AS identifier, CASE WHEN doc_id % 2 = 0 THEN 'even' ELSE 'odd' END AS collection, CASE WHEN doc_id % 4 = 0 THEN '{\"a\":1}' ELSE '{\"lang\":\"' || lang || '\"}' END AS metadata, CASE WHEN doc_id % 4 = 0 THEN 9 ELSE 1 END::BIGINT AS tstamp, md5(" + NORM + ") AS content_hash FROM documents WHERE doc_id % 5 <> 0"


@query(f"SELECT identifier, metadata, tstamp, content_hash FROM ({KEPT}) WHERE collection = 'even'")
def store_scan(spark, d):
    return written_store(spark, d).scan("even").select("identifier", "metadata", "tstamp", "content_hash")


@query(f"SELECT d.doc_id::VARCHAR AS identifier, k.content_hash, k.metadata FROM documents d LEFT JOIN ({KEPT}) k ON k.doc_id = d.doc_id AND k.collection = 'odd'")
def store_lookup(spark, d):
    keys = table(spark, d, "documents").select(F.lit("odd").alias("collection"), F.col("doc_id").cast("string").alias("identifier"))
    return written_store(spark, d).lookup(keys, "content_hash", "metadata").select("identifier", "content_hash", "metadata")


@query(f"SELECT identifier FROM ({KEPT}) WHERE collection = 'odd'")
def store_identifiers(spark, d):
    return written_store(spark, d).identifiers("odd")


@query("SELECT * FROM (VALUES ('odd', '1', true), ('odd', '5', false), ('even', '2', true), ('even', '3', false)) t(collection, identifier, found)")
def store_exists(spark, d):
    store = written_store(spark, d)
    asked = [("odd", "1"), ("odd", "5"), ("even", "2"), ("even", "3")]
    return spark.createDataFrame([(c, i, store.exists(c, i)) for c, i in asked], "collection string, identifier string, found boolean")


@query(f"SELECT identifier FROM ({KEPT}) WHERE collection = 'odd' AND starts_with(identifier, '1')")
def prefix_scan(spark, d):
    return written_store(spark, d).by_prefix("odd", "1")


@query(f"SELECT collection, count(*) AS cnt, max(tstamp) AS last_indexed FROM ({KEPT}) GROUP BY collection")
def store_stats(spark, d):
    return MA.stats(written_store(spark, d).read())


@query("SELECT doc_id || '_chunk_' || i AS identifier, string_split(text, E'\\n')[i + 1] AS line, 7::BIGINT AS tstamp FROM (SELECT doc_id, text, unnest(range(len(string_split(text, E'\\n')))) AS i FROM documents) UNION ALL SELECT 'other', 'x', 1")
def ingest_chunked_rows(spark, d):
    """Chunks of all documents by line; stale chunks and the bare row that they replace go, other rows stay."""
    docs = doc_rows(spark, d)
    before = spark.createDataFrame([("docs", "1_chunk_9999"), ("docs", "1"), ("docs", "other")], "collection string, identifier string")
    one = F.array(F.lit(1.0).cast("float"))
    before = before.select(*ST.KEY, one.alias("vector"), F.lit("h").alias("content_hash"), F.lit("x").alias("metadata"), F.lit(1).cast("long").alias("tstamp"))
    lines = F.split("text", "\n")
    made = I.ingest_chunked(before, docs, lines, now=7, replace_bare=True)
    texts = CH.chunk_rows(docs, "identifier", lines).select("identifier", F.col("text").alias("line"))
    return made.join(texts, "identifier", "left").select("identifier", F.coalesce("line", "metadata").alias("line"), "tstamp")


@query("SELECT doc_id::VARCHAR AS identifier, CASE WHEN doc_id % 2 = 0 THEN 9 ELSE 1 END::BIGINT AS tstamp FROM documents")
def upsert_repeated_keys(spark, d):
    """A batch that holds keys twice: the later row of each is stored, once."""
    old = stored_docs(spark, d)
    new = old.where(F.col("identifier").cast("long") % 2 == 0)
    return ST.upsert(old, new.withColumn("tstamp", F.lit(5).cast("long")).unionByName(new.withColumn("tstamp", F.lit(9).cast("long")))).select("identifier", "tstamp")
