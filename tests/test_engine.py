"""Small cases of the retrieval engine's behaviour."""

import json

import pytest
from pyspark.sql import functions as F

from larkspur import errors as E
from larkspur.config import Config
from larkspur.functions import codec, vector
from larkspur.functions import metadata as M
from larkspur.operators import chunking, rag, search
from larkspur.plans import ingest, maintenance
from larkspur.providers import Availability, StreamParser, embed
from larkspur.sources import store as ST


def rows(spark, items):
    return spark.createDataFrame([(i, [float(x) for x in v], m) for i, v, m in items], "identifier string, vector array<float>, metadata string")


def ids(df):
    return [r["identifier"] for r in df.orderBy("rank").collect()]


def test_top_k_and_dimension_guard(spark):
    s = rows(spark, [("1", [1, 0], None), ("2", [0, 1], None), ("3", [0.7, 0.7], None), ("old", [1, 0, 0], None)])
    assert ids(search.find_similar(s, [1.0, 0.0], 2)) == ["1", "3"]
    assert ids(search.find_similar(s, [1.0, 0.0], 2, arrow=True)) == ["1", "3"]


def test_collapse(spark):
    s = rows(spark, [("doc1_chunk_0", [0.98, 0.02], None), ("doc1_chunk_1", [1, 0], None), ("doc2_chunk_0", [0.5, 0.5], None), ("42", [0, 1], None)])
    assert ids(search.find_similar(s, [1.0, 0.0], 3, collapse_chunks=True)) == ["doc1", "doc2", "42"]


def test_cosine_of_other_lengths_raises(spark):
    with pytest.raises(Exception, match=str(E.DIMENSIONS)):
        spark.range(1).select(vector.cosine(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0)))).collect()


@pytest.mark.parametrize(
    "stored,wanted,expected",
    [({}, {}, True), ({"a": 1}, {"b": 1}, False), ({"p": 1}, {"p": True}, False), ({"p": ""}, {"p": False}, False), ({"p": True}, {"p": True}, True), ({"s": "007"}, {"s": "7"}, False), ({"n": 1}, {"n": "1"}, False), ({"n": 1}, {"n": 1.0}, True), ({"n": 1}, {"n": 1.5}, False), ({"a": None}, {"a": 0}, False), ({"a.b": "x"}, {"a.b": "x"}, True)],
)
def test_metadata_filter(spark, stored, wanted, expected):
    M.prepare(spark)
    df = spark.createDataFrame([(json.dumps(stored),)], "m string")
    assert df.select(M.matches(F.col("m"), wanted)).first()[0] is expected


def test_chunkers(spark):
    def run(col, text):
        return spark.createDataFrame([(text,)], "t string").select(col).first()[0]

    for eol in ("\n", "\r\n", "\r"):
        text = f"First paragraph.{eol}{eol}Second paragraph.{eol}{eol}Third paragraph."
        assert len(run(chunking.paragraphs(F.col("t"), 1, 10000), text)) == 3
    assert run(chunking.paragraphs(F.col("t")), "   ") == []
    assert run(chunking.paragraphs(F.col("t"), 100, 10000), "A" * 200 + "\n\nHi.") == ["A" * 200 + "\n\nHi."]
    for args, code in (((900, 800), E.PARAGRAPH_ORDER), ((0, 800), E.PARAGRAPH_SIZES)):
        with pytest.raises(E.EngineError) as e:
            chunking.paragraphs(F.col("t"), *args)
        assert e.value.code == code
    text = "abcdefghij" * 20
    assert "".join(chunking.window_one(text, 50, 0, "reference")) == text
    assert len(chunking.window_one(text, 50, 20, "reference")) == 26 and len(chunking.window_one(text, 50, 20, "stop")) == 6
    assert len(chunking.window_one("Hello world. " * 30, 100, 20, "reference")) == 25
    for args, code in (((50, -100), E.WINDOW_OVERLAP), ((50, 50), E.WINDOW_OVERLAP), ((0, 0), E.WINDOW_SIZE)):
        with pytest.raises(E.EngineError) as e:
            chunking.windows(*args)
        assert e.value.code == code


def test_own_chunks(spark):
    s = spark.createDataFrame([(x,) for x in ("faq_chunk_0", "faq_chunk_1", "faq_chunk_overview", "faq_chunk_1_chunk_0", "Faq_chunk_2")], "identifier string")
    p = spark.createDataFrame([("faq",)], "parent_id string")
    assert sorted(r["identifier"] for r in chunking.own_chunks(s, p).collect()) == ["faq_chunk_0", "faq_chunk_1"]


def test_fusion(spark):
    def ranked(*names):
        return spark.createDataFrame([(n, i + 1) for i, n in enumerate(names)], "identifier string, rank int")

    assert ids(search.reciprocal_rank_fusion(ranked("A", "B"), ranked("B", "C")))[0] == "B"
    assert ids(search.reciprocal_rank_fusion(ranked("A", "B"), ranked("C"), semantic_weight=1, keyword_weight=0)) == ["A", "B", "C"]
    for w, code in (((-1, 1), E.WEIGHT_NEGATIVE), ((0, 0), E.WEIGHTS_ZERO)):
        with pytest.raises(E.EngineError) as e:
            search.reciprocal_rank_fusion(ranked("A"), ranked("B"), semantic_weight=w[0], keyword_weight=w[1])
        assert e.value.code == code


def test_rerank(spark):
    s = rows(spark, [("1", [1, 0], None), ("2", [0.9, 0.1], None), ("3", [0.8, 0.2], None)])
    assert ids(search.find_similar_with_rerank(s, [1.0, 0.0], lambda _: 'so: ["3", "1", "2"]', 2)) == ["3", "1"]

    def fails(_):
        raise RuntimeError

    assert ids(search.find_similar_with_rerank(s, [1.0, 0.0], fails, 2)) == ["1", "2"]


def test_codec():
    assert codec.unpack_one(codec.pack_one([])) == [] and len(codec.pack_one([0.5] * 3072)) == 12288
    for f, blob, code in ((codec.unpack_one, b"[0.1,0.2]", E.CODEC_LEGACY), (codec.unpack_one, b"abcde", E.CODEC_LENGTH), (codec.repack_one, b"[0.1,", E.LEGACY_JSON), (codec.repack_one, b"[]", E.LEGACY_SHAPE), (codec.repack_one, b'[0.1,"oops"]', E.LEGACY_NUMBER)):
        with pytest.raises(E.EngineError) as e:
            f(blob)
        assert e.value.code == code
    assert codec.unpack_one(codec.repack_one(b"[1,0,-1]")) == [1.0, 0.0, -1.0]


@pytest.mark.parametrize("size", [1, 3, 7, 64, 4096])
def test_stream_parser(size):
    line = lambda t: f'data: {{"choices":[{{"delta":{{"content":"{t}"}}}}]}}\n'
    body = (line("Hello") + ": keep-alive\n\n" + line("") + "data: {not json\n" + line(" world") + "data: [DONE]\n" + line("late")).encode()
    p = StreamParser()
    assert [d for i in range(0, len(body), size) for d in p.feed(body[i : i + size])] == ["Hello", " world"]


def test_ingest_twice_changes_nothing(spark, tmp_path):
    docs = spark.createDataFrame([("c", "1", "foo  bar\n\nbaz", '{"b":1,"a":2}'), ("c", "2", "x", None)], "collection string, identifier string, text string, metadata string")
    store = ST.VectorStore(spark, f"file://{tmp_path}/store")
    store.commit(ingest.ingest(store.read(), docs, now=1))
    again = docs.withColumn("metadata", F.when(F.col("identifier") == "1", '{"a":2,"b":1}'))
    store.commit(ingest.ingest(store.read(), again, now=2), expected=1)
    assert {r["tstamp"] for r in store.read().collect()} == {1} and store.version() == 2
    with pytest.raises(RuntimeError):
        store.commit(store.read(), expected=1)


def test_orphans_refuse_empty(spark):
    s = spark.createDataFrame([("c", "1")], "collection string, identifier string")
    with pytest.raises(E.EngineError) as e:
        maintenance.delete_orphans(s, s.select("identifier").limit(0))
    assert e.value.code == E.ORPHANS_EMPTY
    assert maintenance.delete_orphans(s, s.select("identifier").limit(0), allow_empty=True)[1] == 1


def test_messages_and_history(spark):
    m = rag.build_messages(F.lit("q?"), F.array(F.lit("a"), F.lit("b")), system="S")
    assert [tuple(x) for x in spark.range(1).select(m).first()[0]] == [("system", "S"), ("user", "Documents:\n\na\n\nb\n\nQuestion: q?")]
    h = spark.createDataFrame([(1, i, "user", str(i)) for i in range(6)], "conv_id int, turn int, role string, text string")
    assert sorted(r["turn"] for r in rag.truncate(h, 2).collect()) == [2, 3, 4, 5] and rag.truncate(h, 0).count() == 0


def test_config_and_clients():
    c = Config.of({"generation_max_tokens": "-1", "rag_top_k": "", "embedding_provider": " OLLAMA ", "generation_provider": "?", "system_prompt": " "})
    assert (c.generation_max_tokens, c.rag_top_k, c.embedding_provider, c.generation_provider, c.system_prompt) == (512, 0, "ollama", "llamacpp", None)
    assert embed(Config(), lambda *a: (200, '[{"embedding":[[1,2]]}]'), "x") == [1.0, 2.0]
    with pytest.raises(E.EngineError) as e:
        embed(Config(), lambda *a: (400, ""), "x")
    assert e.value.code == E.EMBED_TOO_LONG
    asked = []
    up = Availability(Config(), lambda *a: (asked.append(a[1]), (200, ""))[1])
    assert up("embedding") and up("embedding") and len(asked) == 1


def test_cache():
    now = [0.0]
    c = maintenance.ResultCache(10, lambda: now[0])
    k = c.key("c", "q", 5, {"b": 1, "a": 2}, False)
    assert k == c.key("c", "q", 5, {"a": 2, "b": 1}, False) != c.key("c", "q", 5, {"a": 2, "b": 1}, True)
    c.put(k, 1)
    assert c.get(k) == 1
    now[0] = 11
    assert c.get(k) is None


def test_many_queries_in_blocks_meet_every_row(spark, tmp_path, monkeypatch):
    import duckdb

    from larkspur.catalog import ORACLES, QUERIES

    made = spark.range(230).select(F.col("id").alias("vec_id"), F.array(*(F.sin(F.col("id") * i + i).cast("float") for i in range(1, 5))).alias("embedding"), (F.col("id") % 3).cast("int").alias("label"))
    made.coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    monkeypatch.setattr(search, "QUERY_BLOCK", 2)
    got = {tuple(r) for r in QUERIES["topk_multi_query"](spark, str(tmp_path)).select("query_id", "identifier", "rank").collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = {(r[0], r[1], r[3]) for r in con.execute(ORACLES["topk_multi_query"]).fetchall()}
    assert got == want and {r[0] for r in got} == {"0", "50", "100", "150", "200"} and len(got) == 25


@pytest.mark.parametrize("chunks", [False, True])
@pytest.mark.parametrize("exclude", [False, True])
@pytest.mark.parametrize("k", [0, 3, 200])
def test_many_queries_keep_each_parts_best_and_list_no_pairs(spark, monkeypatch, chunks, exclude, k):
    import random

    from pyspark.sql import Window

    rng = random.Random(3)
    nan, inf = float("nan"), float("inf")
    odd = [[0.0] * 4, [nan, 1.0, 0.0, 0.0], [None, 1.0, 0.0, 0.0], [inf, 1.0, 0.0, 0.0], [1e-30, 0.0, 0.0, 0.0], [1.0, 2.0], [2.0, 4.0], [], None, [-0.0, 0.0, 0.0, 0.0]]
    made = [[rng.gauss(0, 1) for _ in range(4)] for _ in range(40)]
    made += [made[0]] * 12 + [[3 * x for x in made[1]]] * 5 + odd * 2  # copies tie
    rows = [(f"{i % 23}_chunk_{i}" if i % 3 else str(i), v) for i, v in enumerate(made)] + [("5", made[2]), ("5", made[3]), (None, made[4])]
    asked = [(r[0], r[1]) for r in rows[::4]] + [("0", odd[0]), ("q", made[7]), ("q", made[8]), (None, made[9])] + [(f"o{i}", v) for i, v in enumerate(odd)]
    store = spark.createDataFrame(rows, "identifier string, vector array<float>").repartition(3)
    queries = spark.createDataFrame(asked, "query_id string, query array<float>")
    monkeypatch.setattr(search, "QUERY_BLOCK", 9)
    monkeypatch.setattr(search, "PART_ROWS", 30, raising=False)
    found = search.find_similar_many(store, queries, k, chunks, exclude)
    pairs = store.crossJoin(queries).where(F.size("vector") == F.size("query"))
    if exclude:
        pairs = pairs.where(F.col("identifier") != F.col("query_id"))
    hits = pairs.select("query_id", "identifier", vector.cosine(F.col("vector"), F.col("query"), strict=False).alias("score"))
    if chunks:
        hits = search.collapse(hits, "query_id")
    want = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "identifier"))).where(F.col("rank") <= k)
    text = lambda df: sorted(map(repr, map(tuple, df.select("query_id", "identifier", "score", "rank").collect())))
    assert text(found) == text(want) and (not k or found.count())
    assert found.columns == ["query_id", "identifier", "score", "rank"] and "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_a_part_gives_no_more_than_top_k_a_query_and_tiles_change_nothing(monkeypatch):
    import numpy as np
    import pyarrow as pa

    made = np.random.default_rng(1).normal(size=(300, 8)).astype(np.float32)
    made[200:] = made[:100]
    points = vector.Points(pa.array(made.tolist(), pa.list_(pa.float32())), 8)
    at, none = np.arange(300), np.full(300, -1)
    got = []
    for tile in (1 << 22, 1000):
        monkeypatch.setattr(vector, "TILE", tile)
        got.append([tuple(x) for q, r, score, _ in vector.nearest(points, points, 5, at, at, at, none) for x in zip(q.tolist(), r.tolist(), score.tolist())])
    assert got[0] == got[1] and len(got[0]) == 1500
    assert [r for q, r, _ in got[0] if q == 0][:2] == [0, 200]  # a tie goes to the smaller


def test_codec_roundtrip_rounds_as_its_sql_to_the_last_bit(spark, tmp_path):
    import duckdb

    from larkspur.catalog import ORACLES, QUERIES

    made = [[-8.903177928232253e-08, 0.0, -0.0, 5e-7], [-5e-7, -4.9e-7, 1e-45, -1e-45], [1e15, -3.4e38, 0.0078125, -0.0078125], [float("nan"), float("inf"), float("-inf"), 0.1234565]]
    spark.createDataFrame(list(enumerate(made)), "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got = sorted(repr((r[0], r[1], list(r[2]))) for r in QUERIES["codec_roundtrip"](spark, str(tmp_path)).collect())
    assert got == sorted(map(repr, con.execute(ORACLES["codec_roundtrip"]).fetchall())) and "-0.0, 0.0, -0.0" in got[0]
