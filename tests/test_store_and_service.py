"""Snapshots, ingest, migration, clients, history, search service and both streams."""

import json

import pytest
from pyspark.sql import functions as F

from larkspur import errors as E
from larkspur import providers as P
from larkspur.config import Config
from larkspur.operators import chunking, rag
from larkspur.plans import ingest, maintenance
from larkspur.service import SearchService
from larkspur.sources import store as ST
from larkspur.streaming import ingest as streaming

DOC = "collection string, identifier string, text string, metadata string"


def docs(spark, *rows):
    return spark.createDataFrame([("c", i, t, m) for i, t, m in rows], DOC)


@pytest.fixture
def store(spark, tmp_path):
    return ST.VectorStore(spark, f"file://{tmp_path}/store")


def test_a_dead_writer_does_not_stop_the_store(spark, store):
    store.commit(ingest.ingest(store.read(), docs(spark, ("1", "a", None)), now=1))
    store.read().write.partitionBy("collection").parquet(f"{store.root}/data-dead")  # written, never named
    assert store.version() == 1 and store.commit(store.read(), expected=1) == 2 and store.read().count() == 1
    assert store.vacuum(keep=1) == 2 and store.read().count() == 1


def test_of_two_writers_one_fails(spark, store, monkeypatch):
    store.commit(ingest.ingest(store.read(), docs(spark, ("1", "a", None)), now=1))
    monkeypatch.setattr(store, "version", lambda: 0)  # this writer looked before the other one was done
    with pytest.raises(RuntimeError):
        store.commit(spark.createDataFrame([], ST.SCHEMA))
    monkeypatch.undo()
    assert store.version() == 1 and store.read().count() == 1 and store.exists("c", "1") and not store.exists("c", "2")


def test_a_commit_rewrites_only_what_it_touches(spark, store):
    def rows(*keys):
        return spark.createDataFrame([(c, i, [1.0], "h", None, t) for c, i, t in keys], ST.SCHEMA)

    def held(version=None, collections=None):
        return sorted((r["collection"], r["identifier"], r["tstamp"]) for r in store.read(version, collections).collect())

    store.commit(rows(("a", "1", 1), ("b/%c", "1", 1), ("d", "1", 1)))
    first = store._manifest(1)
    assert store.commit(rows(("b/%c", "2", 2), ("d", "9", 2)), touched=["b/%c"]) == 2  # d isn't touched
    second = store._manifest(2)
    changed = {part for part in first if first[part] != second[part]}
    assert changed == {store._partition("b/%c")}
    assert held() == [("a", "1", 1), ("b/%c", "2", 2), ("d", "1", 1)] and held(1) == [("a", "1", 1), ("b/%c", "1", 1), ("d", "1", 1)]
    assert held(collections=["b/%c"]) == [("b/%c", "2", 2)] and held(collections=["none"]) == []
    assert store.commit(rows(), touched=["a"]) == 3  # a is empty now
    assert held() == [("b/%c", "2", 2), ("d", "1", 1)]
    assert store.vacuum(keep=1) == 1 and held() == [("b/%c", "2", 2), ("d", "1", 1)]  # the first folder still holds d
    store.commit(ST.upsert(store.read(collections=["d"]), rows(("d", "2", 4))), expected=3, touched=["d"])
    assert held() == [("b/%c", "2", 2), ("d", "1", 1), ("d", "2", 4)]
    assert store.commit(rows(("e", "1", 5)), expected=4) == 5 and held() == [("e", "1", 5)]


def test_repeated_keys_are_stored_once(spark, store):
    twice = docs(spark, ("1", "a", '{"n":1}'), ("1", "b", '{"n":2}'), ("2", "c", None))
    rows = ingest.ingest(store.read(), twice, now=1)
    assert sorted(r["identifier"] for r in rows.collect()) == ["1", "2"]
    store.commit(rows)
    both = spark.createDataFrame([("c", "1", '{"n":5}'), ("c", "1", '{"n":6}')], "collection string, identifier string, metadata string")
    assert ST.update_metadata(store.read(), both, 3).where("identifier = '1'").select("metadata", "tstamp").collect() == [('{"n":6}', 3)]


def test_migration_tells_packed_from_json(spark):
    packed = b"[" + b"\x01\x02\x03"
    rows = [(1, b"[0.1,0.2,0.3]"), (2, b"not json at all"), (3, packed), (4, b"[0.1,"), (5, b"[]"), (6, b'["a"]'), (7, None)]
    got = {r["id"]: r for r in maintenance.migrate(spark.createDataFrame(rows, "id int, vector binary")).collect()}
    assert [got[i]["status"] for i in range(1, 8)] == ["converted", "packed", "packed", "failed", "failed", "failed", "packed"]
    assert [got[i]["error"] for i in (4, 5, 6)] == [E.LEGACY_JSON, E.LEGACY_SHAPE, E.LEGACY_NUMBER] and bytes(got[3]["vector"]) == packed


def test_chunked_ingest_drops_stale_chunks(spark):
    old = spark.createDataFrame([("c", f"42_chunk_{i}", [1.0], "h", None, 1) for i in range(3)] + [("c", "42", [1.0], "h", None, 1), ("d", "42_chunk_7", [1.0], "h", None, 1)], ST.SCHEMA)
    one = docs(spark, ("42", "only chunk", None))
    got = ingest.ingest_chunked(old, one, F.array("text"), now=2, replace_bare=True)
    assert sorted((r["collection"], r["identifier"]) for r in got.collect()) == [("c", "42_chunk_0"), ("d", "42_chunk_7")]
    case = spark.createDataFrame([("c", x) for x in ("faq_chunk_0", "faq_chunk_1", "faq_chunk_overview", "faq_chunk_1_chunk_0", "Faq_chunk_2")], "collection string, identifier string")
    kept, n = chunking.delete_chunked(case, spark.createDataFrame([("faq",)], "parent_id string"))
    assert n == 2 and kept.count() == 3


def test_cleanup_and_reindex(spark):
    rows = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "1"), ("b", "9")], "collection string, identifier string")

    class Live:
        def __init__(self, collection, *ids):
            self.label = self.collection = collection
            self.ids = ids

        def live_identifiers(self):
            return spark.createDataFrame([(i,) for i in self.ids], "identifier string")

        def reindex(self):
            if not self.ids:
                raise ValueError("nothing to do")
            return len(self.ids)

    kept, n = maintenance.cleanup(rows, [Live("a", "1"), Live("b", "1")])
    assert n == 2 and sorted(map(tuple, kept.collect())) == [("a", "1"), ("b", "1")]
    assert maintenance.cleanup(rows, [Live("a", "1"), Live("b", "1")], collection="a")[1] == 1
    with pytest.raises(E.EngineError) as e:
        maintenance.cleanup(rows, [Live("a")])
    assert e.value.code == E.ORPHANS_EMPTY and maintenance.cleanup(rows, [Live("a")], allow_empty=True)[1] == 2
    assert list(maintenance.reindex([Live("a"), Live("b", "1")])) == ["a"]
    assert maintenance.reindex([Live("a"), Live("b", "1")], continue_on_error=True)["b"] == 1 and maintenance.reindex([Live("a", "1"), Live("b", "1")], "b") == {"b": 1}
    assert sorted(r["collection"] for r in maintenance.stats(rows.withColumn("tstamp", F.lit(None).cast("long"))).collect()) == ["a", "b"]
    assert ST.clear(rows, "a").count() == 4 and ST.clear(rows, "a", confirm=True).count() == 2


CLIENTS = [
    ("llamacpp", '[{"embedding":[[1,2]]}]', '{"choices":[{"message":{"content":"hi"}}]}', E.EMBED_STATUS, E.EMBED_SHAPE, E.GENERATE_STATUS, E.GENERATE_SHAPE),
    ("ollama", '{"embedding":[1,2]}', '{"message":{"content":"hi"}}', E.OLLAMA_EMBED_STATUS, E.OLLAMA_EMBED_SHAPE, E.OLLAMA_GENERATE_STATUS, E.OLLAMA_GENERATE_SHAPE),
    ("openai", '{"data":[{"embedding":[1,2]}]}', '{"choices":[{"message":{"content":"hi"}}]}', E.OPENAI_EMBED_STATUS, E.OPENAI_EMBED_SHAPE, E.OPENAI_GENERATE_STATUS, E.OPENAI_GENERATE_SHAPE),
]


@pytest.mark.parametrize("kind,vector,reply,bad_embed,no_embed,bad_reply,no_reply", CLIENTS)
def test_clients(kind, vector, reply, bad_embed, no_embed, bad_reply, no_reply):
    config = Config.of({"embedding_provider": kind, "generation_provider": kind, "openai_api_key": "k"})
    asked = [{"role": "user", "content": "q"}]
    assert P.embed(config, lambda *a: (200, vector), "x") == [1.0, 2.0] and P.complete(config, lambda *a: (200, reply), asked) == "hi"
    for call, answer, code in ((lambda s: P.embed(config, s, "x"), (500, ""), bad_embed), (lambda s: P.embed(config, s, "x"), (200, "{}"), no_embed), (lambda s: P.complete(config, s, asked), (500, ""), bad_reply), (lambda s: P.complete(config, s, asked), (200, "{}"), no_reply)):
        with pytest.raises(E.EngineError) as e:
            call(lambda *a: answer)
        assert e.value.code == code


def test_openai_needs_a_key():
    config = Config.of({"embedding_provider": "openai", "generation_provider": "openai"})
    for call, code in ((lambda: P.embed(config, None, "x"), E.OPENAI_EMBED_KEY), (lambda: P.complete(config, None, []), E.OPENAI_GENERATE_KEY)):
        with pytest.raises(E.EngineError) as e:
            call()
        assert e.value.code == code


def line(text):
    return f'data: {{"choices":[{{"delta":{{"content":"{text}"}}}}]}}\n'


def test_streamed_answers():
    body = (line("Hello") + ": keep-alive\n" + line(" world") + "data: [DONE]\n" + line("late")).encode()
    sent = []

    def send(*a):
        sent.append(a[2])
        return 200, (body[i : i + 5] for i in range(0, len(body), 5))

    history = rag.History().append("user", "Q").append("assistant", "A")
    assert list(P.generate_stream(Config(), send, "q?", ["a", "b"], history, "S")) == ["Hello", " world"]
    assert sent[0]["stream"] is True and [m["role"] for m in sent[0]["messages"]] == ["system", "user", "assistant", "user"]
    with pytest.raises(E.EngineError) as e:
        list(P.stream(Config(), lambda *a: (503, []), []))
    assert e.value.code == E.STREAM_STATUS
    assert P.generate(Config(), lambda *a: (200, '{"choices":[{"message":{"content":"hi"}}]}'), "q", []) == "hi"


def test_history(spark):
    h = rag.History()
    for i in range(1, 4):
        h = h.append("user", f"Q{i}").append("assistant", f"A{i}")
    assert [m["content"] for m in h.truncated(2).messages] == ["Q2", "A2", "Q3", "A3"] and h.truncated(0).messages == h.truncated(-1).messages == () and len(h.messages) == 6
    for role in ("system", "tool"):
        with pytest.raises(E.EngineError) as e:
            h.append(role, "x")
        assert e.value.code == E.HISTORY_ROLE
        with pytest.raises(Exception, match=str(E.HISTORY_ROLE)):
            none = F.array().cast("array<struct<role: string, content: string>>")
            spark.range(1).select(rag.append(none, F.lit(role), F.lit("x"))).collect()
    one = rag.messages("q?", ["a", "b"], None, "S")
    column = spark.range(1).select(rag.build_messages(F.lit("q?"), F.array(F.lit("a"), F.lit("b")), system="S")).first()[0]
    assert [(m["role"], m["content"]) for m in one] == [tuple(m) for m in column]


def test_models_as_columns(spark):
    def send(method, url, body, headers, timeout):
        return (200, json.dumps([{"embedding": [[float(len(body["content"]))]]}])) if "embedding" in url else (200, '{"choices":[{"message":{"content":"hi"}}]}')

    rows = spark.createDataFrame([("abc", "[]"), (None, None)], "text string, asked string")
    got = rows.select(P.embed_column(Config(), send)("text").alias("v"), P.complete_column(Config(), send)("asked").alias("r")).collect()
    assert [tuple(r) for r in got] == [([3.0], "hi"), (None, None)]


def test_service(spark, store):
    asked, now = [], [0.0]
    vectors = {"east": [1.0, 0.0], "north": [0.0, 1.0]}

    def embed(text):
        asked.append(text)
        return vectors[text]

    cache = maintenance.ResultCache(10, lambda: now[0])
    service = SearchService(store, embed, lambda m: 'order: ["c", "b"]', lambda c, q: ["z", "a"], cache)
    assert service.find("c", "east") == [] and asked == []
    rows = [("c", i, v, "h", '{"n":1}', 1) for i, v in (("a", [1.0, 0.0]), ("b", [0.9, 0.1]), ("c", [0.8, 0.2]), ("old", [1.0, 0.0, 0.0]), ("a_chunk_1", [0.0, 1.0]))]
    store.commit(spark.createDataFrame(rows, ST.SCHEMA))
    assert [i for i, _ in service.find("c", "east", 3)] == ["a", "b", "c"] and service.skipped == 1 and asked == ["east"]
    assert [i for i, _ in service.find("c", "east", 3)] == ["a", "b", "c"] and asked == ["east"]
    now[0] = 11.0
    service.find("c", "east", 3)
    assert asked == ["east", "east"]
    assert [i for i, _ in service.find_with_rerank("c", "east", 2, 3)] == ["c", "b"]
    service.complete = lambda m: 1 / 0
    assert [i for i, _ in service.find_with_rerank("c", "east", 2, 3)] == ["a", "b"]
    assert [i for i, _ in service.find_hybrid("c", "east", 2)] == ["a", "b"]
    assert service.delete_chunked("c", spark.createDataFrame([("a",)], "parent_id string")) == 1 and not cache.held
    assert service.delete(spark.createDataFrame([("c", "old"), ("c", "none")], "collection string, identifier string")) == 1
    assert service.find("c", "north", 1)[0][0] == "c" and service.skipped == 0


def test_cache_is_bounded():
    cache = maintenance.ResultCache(10, lambda: 0.0, most=2)
    for k in "abc":
        cache.put(k, k)
    assert [cache.get(k) for k in "abc"] == [None, "b", "c"]
    off = maintenance.ResultCache(0)
    off.put("a", 1)
    assert off.get("a") is None and not off.held


def test_ingest_stream(spark, store, tmp_path):
    schema = DOC + ", tstamp long"
    source = tmp_path / "in"
    spark.createDataFrame([("c", "1", "first", None, 1), ("c", "1", "second", None, 2), ("c", "2", "x", None, 1)], schema).coalesce(1).write.parquet(str(source))

    def run(checkpoint):
        streaming.ingest_stream(spark.readStream.schema(schema).parquet(str(source)), store, f"{tmp_path}/{checkpoint}").awaitTermination()

    run("k1")
    assert store.version() == 1 and {r["identifier"]: r["content_hash"] for r in store.read().collect()}.keys() == {"1", "2"}
    run("k1")
    run("k2")  # the same rows once more
    assert store.version() == 1


def test_delta_stream_waits_for_late_fragments(spark, tmp_path):
    body = (line("one") + line("two") + "data: [DONE]\n" + line("late")).encode()
    pieces = [body[i : i + 9] for i in range(0, len(body), 9)]
    schema = "request_id string, seq long, fragment binary"
    batches = [pieces[1::2], pieces[0::2]]
    for n, (offset, batch) in enumerate(zip((1, 0), batches)):
        spark.createDataFrame([("r", offset + 2 * i, p) for i, p in enumerate(batch)] * 2, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/b{n}")
    source = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    made = streaming.delta_stream(source).writeStream.format("memory").queryName("deltas").outputMode("append").option("checkpointLocation", f"{tmp_path}/k").trigger(availableNow=True).start()
    made.awaitTermination()
    assert [(r["pos"], r["delta"]) for r in spark.table("deltas").orderBy("pos").collect()] == [(0, "one"), (1, "two")]


def test_codec_columns(spark):
    from larkspur.functions import codec

    vectors = [[0.5, -1.0], [], None, [float("inf"), 2.0**100]]
    got = spark.createDataFrame([(v,) for v in vectors], "v array<float>").select(codec.unpack(codec.pack("v")).alias("u")).collect()
    assert [r["u"]["vector"] for r in got] == vectors and all(r["u"]["error"] is None for r in got)
    blobs = [b"[1,2]", b"abcde", b"", None, b"[\x00\x00\x00", codec.pack_one([3.0])]
    got = spark.createDataFrame([(b,) for b in blobs], "b binary").select(codec.unpack("b").alias("u")).collect()
    assert [r["u"]["error"] for r in got] == [E.CODEC_LEGACY, E.CODEC_LENGTH, None, None, None, None]
    assert [r["u"]["vector"] is None for r in got] == [True, True, False, True, False, False] and got[5]["u"]["vector"] == [3.0]
