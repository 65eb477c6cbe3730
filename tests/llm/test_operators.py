"""Corpus operators against brute force on small rows with nulls, empty texts, ties and repeats."""

import bisect
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from larkspur.llm import html_text, kernels, language_model, packing, tokenize

LINE = "one two three four five six seven eight nine ten eleven twelve"
ROWS = [(0, LINE), (1, LINE), (2, None), (3, ""), (4, "  \n"), (5, LINE + " thirteen"), (6, "Ünï cödé, x.y 12"), (7, "word " * 3000), (8, LINE.upper()), (None, "null id")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in ROWS], "doc_id long, text string, id string, n int")


def encoded(text, end):
    tok = tokenize.encoder(tokenize.vocabulary_path()).tokenizer
    return [*tok.encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_encoder_equals_library():
    texts = ["", None, "Hello, World's it's 'tis don't. é.e×.a", "<|endoftext|> a<|startoftext|>b", "a\x1cb c d é.x“.y”", "x1y2.3'4 ÀÉ.ß!É\tq\r\nz", "日本語。テスト", "A" * 90 + "...", "é.x"]
    ids, size = tokenize.Encoder(tokenize.vocabulary_path()).encode(pa.array(texts))
    assert [list(p) for p in np.split(ids, np.cumsum(size)[:-1])] == [encoded(t, 0)[:-1] for t in texts]


def test_token_files(spark, docs):
    from larkspur.llm import common, token_files

    path = common.scratch_path(spark, "t")
    token_files.write_tokens(docs, path)
    got = token_files.digest(spark, path).collect()
    start = 0
    for i, t in sorted(ROWS, key=lambda r: (r[0] is not None, r[0])):
        ids = encoded(t, 1)
        r = next(r for r in got if r["id"] == i)
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), crc(ids))
        start += len(ids)
    path = common.scratch_path(spark, "t")
    token_files.write_tokens(docs.limit(0), path)
    assert token_files.digest(spark, path).count() == 0


def test_packing(spark, docs):
    got = packing.pack(docs).collect()
    places = {}
    for r in got:
        ids = encoded(dict(ROWS)[r["doc_id"]], 0)[r["start"] : r["start"] + r["length"]]
        assert r["start"] == 2048 * r["piece"] and r["ids_crc32"] == crc(ids) and len(ids) == r["length"]
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r["length"] for r in got)
    assert len(places) == -(-total // 2048) and packing.pack(docs.limit(0)).count() == 0


def test_plan_places_every_piece_once():
    rng = np.random.default_rng(1)
    histogram = {int(k): int(n) for k, n in zip(rng.integers(1, 2049, 300), rng.integers(1, 50, 300))}
    runs, sequences = packing.plan(histogram)
    fill = np.zeros(sequences, np.int64)
    for length, first, n, sequence, _ in runs.tolist():
        fill[sequence : sequence + n] += length
    assert fill.max() <= 2048 and {k: int(runs[runs[:, 0] == k, 2].sum()) for k in histogram} == histogram
    room: list[int] = []  # piece by piece, best fit decreasing
    for length in sorted((k for k, n in histogram.items() for _ in range(n)), reverse=True):
        at = bisect.bisect_left(room, length)
        space = room.pop(at) if at < len(room) else 2048
        bisect.insort(room, space - length)
    assert sequences <= 1.01 * len(room)


def test_sharding(spark, docs):
    from larkspur.llm.sharding import shard_by_bytes

    got = shard_by_bytes(docs, shards=3).collect()
    assert len(got) == len(ROWS) and sum(r["_size"] for r in got) == sum(len((t or "").encode()) + 1 for _, t in ROWS)
    for s in {r["_shard"] for r in got}:
        slots = sorted(r["_slot"] for r in got if r["_shard"] == s)
        assert slots == list(range(len(slots)))
    assert len({r["_shard"] for r in got if r["text"] == LINE}) == 1
    assert shard_by_bytes(docs.limit(0)).count() == 0


def test_decontamination(spark, docs):
    from larkspur.llm.decontaminate import build_index, contamination, proximity

    items = spark.createDataFrame([(7, LINE), (70, "cödé x"), (8, None), (None, LINE)], "item_id long, text string")
    got = {r["doc_id"]: r for r in contamination(docs, items).collect()}
    assert (got[0]["n_words"], got[0]["n_hit"], got[0]["items"]) == (12, 12, ["7"]) and got[8]["n_hit"] == 12 and got[5]["n_hit"] == 12
    assert (got[6]["n_hit"], got[6]["items"]) == (2, ["70"]) and got[2]["n_words"] == got[7]["n_hit"] == 0 and len(got) == len(ROWS)
    near = proximity(build_index(docs), ["two", "thirteen"], 12).collect()
    assert [r["doc_id"] for r in near] == [5]


def test_components(spark, docs):
    from larkspur.llm.near_duplicates import components

    base = [f"w{i}" for i in range(200)]
    near = [(100, " ".join(base)), (101, " ".join(base[:199])), (102, " ".join([*base[:100], "x", *base[101:]])), (103, " ".join([*base[:50], *"abcdefghijklmnopqrstuvwxyz", *base[80:]]))]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in components(docs.select("doc_id", "text").union(spark.createDataFrame(near, "doc_id long, text string"))).collect()}
    assert got[0] == got[1] == got[8] == (10, 0) and got[5] == (11, 0) and got[2] == (0, 2) and got[3] == (0, 3)
    assert got[100] == (198, 100) and got[101] == (197, 100) and got[102] == (198, 100) and got[103][1] == 103


def test_language_model(spark, docs):
    model = language_model.train(docs)
    got = {r["doc_id"]: r for r in language_model.score(docs, model).collect()}
    n = sum(len((t or "").split()) + 1 for _, t in ROWS)
    assert model.n_tokens == n and got[3]["n_tokens"] == 1 and got[0]["n_known"] == 13 and got[0]["score"] > got[0]["base_score"]
    values = np.unique(np.random.default_rng(0).integers(0, 1 << 40, 5000).astype(np.uint64))
    ef = language_model.EliasFano.build(values)
    assert (ef.find(values) == np.arange(len(values))).all() and (ef.find(values + np.uint64(1))[:-1] == np.where(np.diff(values) == 1, np.arange(1, len(values)), -1)).all()


def test_language_model_holds_triples_seen_once(spark):
    texts = [(0, "a b c"), (1, "x b d"), (2, "x y b d")]
    model = language_model.train(spark.createDataFrame(texts, "doc_id long, text string"))
    held = sum(len(language_model.sequence(model.folder, f"runs-{s}", "triple").low) for s in model.runs)
    assert held == len({t for _, s in texts for w in [["<", *s.split(), ">"]] for t in zip(w, w[1:], w[2:])})
    pruned = language_model.train(spark.createDataFrame(texts, "doc_id long, text string"), min_triples=2)
    once = spark.createDataFrame([(0, "a b c")], "doc_id long, text string")
    assert language_model.score(once, model).first()["score"] > language_model.score(once, pruned).first()["score"]


def test_quality(spark):
    from larkspur.llm import quality

    docs = spark.createDataFrame([(i, ("BAD!! WORDS!! " if i % 2 else "some good words here. ") * (3 + i % 5)) for i in range(200)] + [(900, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(200)], "doc_id long, quality int")
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, quality.train(docs, labels)).collect()}
    assert all((got[i] >= 0.7) == (i % 2 == 0) for i in range(200)) and 0 <= got[900] <= 1
    assert quality.train(docs, labels.limit(0)).any() == np.False_


def test_nearest(spark):
    from larkspur.llm.nearest import search

    rng = np.random.default_rng(3)
    points = rng.normal(size=(800, 8)).astype(np.float32)
    bad = [(1000, None), (1100, [0.0] * 8), (1200, [float("nan")] * 8), (1300, [1.0] * 3), (None, [1.0] * 8)]
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)] + bad, "vec_id long, embedding array<float>")
    got = search(df).collect()
    assert sorted({r["query_id"] for r in got}) == list(range(0, 800, 100)) and len(got) == 80
    hits = 0
    for q in range(0, 800, 100):
        d = np.sqrt(((points.astype(float) - points[q].astype(float)) ** 2).sum(1))
        d[q] = np.inf
        hits += len(set(np.argsort(d)[:10].tolist()) & {r["vec_id"] for r in got if r["query_id"] == q})
    assert hits >= 72 and search(df.limit(0)).count() == 0


def test_url_trust(spark):
    from larkspur.llm.queries import RULES
    from larkspur.llm.url_trust import judge

    link = lambda h: f'<a href="http://{h}/x">'
    pages = [(1, "http://A.com/x?y", None), (2, "https://m.example.com/en/1", None), (3, "http://www.example.com/en/1", None), (4, "http://bad.net/es/", None), (5, "http://spam.org/", link("bad.net") * 3), (6, "no url", None), (7, None, None), (8, "http://ok.org", link("a.com")), (9, "http://xcom/", None)]
    got = {r["page_id"]: r for r in judge(spark.createDataFrame(pages, "page_id long, url string, html string"), RULES).collect()}
    assert [(got[i]["rule"], got[i]["verdict"]) for i in range(1, 10)] == [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), (None, "block"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow")]
    assert (got[1]["host"], got[1]["path"], got[7]["host"], got[8]["path"]) == ("a.com", "/x", "", "")


def test_main_text():
    page = '<html><body class="has-sidebar"><nav><a href=x>menu</a></nav><div class="cookie-notice">We use cookies</div><article><h1>T &amp; t</h1><p><b>One  two<br>three<p>Four&nbsp;five<form><input>Search</form></article><section id=comments><p>Nice post!</p></section><script>var a="<p>";</script><footer>&copy;</footer>'
    assert html_text.main_text(page) == "T & t One two three Four five"
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<p") == ""
    assert html_text.max_flow_side(2, [3.0, 0.0], [0.0, 1.0], [(0, 1, 2.0)]) == [True, True]


def test_words_kernel():
    text, start, end, h = kernels.words(*kernels.utf8(pa.array(["Ab ab", None, "", "ab"])), kernels.SPACED)
    assert text.tolist() == [0, 0, 3] and len(set(h.tolist())) == 1


@pytest.mark.parametrize("linkers", [1, 2, 100])
def test_url_trust_does_not_count_linkers(spark, linkers):
    from larkspur.llm.queries import RULES
    from larkspur.llm.url_trust import judge

    link = lambda h: f'<a href="http://{h}/x">'
    pages = [(-1, "http://bad.net/es/", None), (-2, "http://mixed.org/", link("bad.net") + link("a.org") * 9), (-3, "http://a.com/", "".join(link(f"ok{i}.org") for i in range(linkers)))]
    pages += [(i, f"http://spam{i}.org/", link("bad.net")) for i in range(linkers)] + [(1000 + i, f"http://ok{i}.org/", link("bad.net") + link("a.org")) for i in range(linkers)]
    got = {r["page_id"]: r["verdict"] for r in judge(spark.createDataFrame(pages, "page_id long, url string, html string"), RULES).collect()}
    assert all(got[i] == "block" and got[1000 + i] == "allow" for i in range(linkers)) and got[-2] == "allow"


def test_components_of_lone_short_texts(spark):
    from larkspur.llm.near_duplicates import components

    rows = [(n, " ".join(f"{n}{c}" for c in "abcdef"[:n])) for n in range(6)]  # each in its own partition
    got = components(spark.createDataFrame(spark.sparkContext.parallelize(rows, 6), "doc_id long, text string"), k=5, num=80).collect()
    assert sorted(map(tuple, got)) == [(n, min(n, 1), n) for n in range(6)]


def test_shingles_of_few_words():
    from larkspur.llm.near_duplicates import shingles

    assert [shingles(pa.array([None, " ".join("abcdef"[:n]), ""]), 5)[1].tolist() for n in range(7)] == [[0, min(1, n) + (n == 6), 0] for n in range(7)]


def test_components_link_near_copies_without_ids(spark):
    from larkspur.llm.near_duplicates import components

    words = [[f"{g}{i}" for i in range(200)] for g in "pqr"]
    texts = [(1, words[0]), (None, words[0][1:]), (None, words[1]), (None, words[1][1:]), (5, words[2][1:]), (None, words[2]), (6, words[2][:-1])]
    got = components(spark.createDataFrame([(i, " ".join(w)) for i, w in texts], "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, 198, 1), (None, 197, 1), (None, 198, None), (None, 197, None), (5, 197, 5), (None, 198, 5), (6, 197, 5)], key=str)


def test_components_test_what_a_refuted_forest_hides(spark):
    """b and c are linked; a, their pivot in every entry they share, is nearer to both by counts but linked with neither."""
    from larkspur.llm import near_duplicates as N

    measure = N.Measure(1, 90, 100)
    m, _ = measure.ranges(measure.size_class(200))
    words = np.array([f"w{i}" for i in range(200_000)])
    h = N.shingles(pa.array(words.tolist()), 1)[0]
    group, first = (kernels.mix(h) >> np.uint64(56)).tolist(), h < np.uint64(2**64 // m)
    alike = {}
    for i in np.flatnonzero(first).tolist():
        alike.setdefault(group[i], []).append(i)
    pools = [p for p in alike.values() if len(p) >= 4][:12]
    assert len(pools) == 12
    rest = np.flatnonzero(~first)[:188].tolist()
    b = [p[0] for p in pools] + rest
    c = b[1:]
    text = lambda rows: " ".join(words[rows])
    name = lambda rows: N.set_names(*N.shingles(pa.array([text(rows)]), 1))[0]
    others = [[b[0], *(p[1 + (k >> j) % 2] for j, p in enumerate(pools[1:])), *rest] for k in range(64)]
    a = next(x for x in others if name(x) < min(name(b), name(c)))
    docs = spark.createDataFrame([(1, text(a)), (2, text(b)), (3, text(c))], "doc_id long, text string")
    assert sorted(map(tuple, N.components(docs, k=1).collect())) == [(1, 200, 1), (2, 200, 2), (3, 199, 2)]


def test_nearest_of_repeated_rows(spark):
    from larkspur.llm.nearest import search

    rows = [(i, [float(i), 1.0]) for i in range(1, 30)] + [(100, [0.0, 1.0])] * 3 + [(1, [1.0, 1.0])] * 12
    got = search(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == [(100, i, i, float(i)) for i in range(1, 11)]


def test_components_of_an_empty_table_and_of_repeated_ids(spark):
    from larkspur.llm.near_duplicates import components

    long = " ".join(f"q{i}" for i in range(200))
    rows = [(1, "a b c d"), (1, "e f g h"), (2, "e f g h"), (3, long), (3, long + " end"), (4, "x " + long)]
    docs = spark.createDataFrame([(i, t, "c", 7) for i, t in rows], "doc_id long, text string, cls string, n int")
    got = sorted(map(tuple, components(docs).collect()))
    assert got == [(1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 198, 3), (3, 199, 3), (4, 199, 3)] and components(docs.limit(0)).count() == 0


def test_sets_that_meet_in_a_name_are_named_again(spark, monkeypatch):
    from larkspur.llm import near_duplicates as N

    named = N.set_names

    def clumsy(h, size, seed=0):
        return np.where(size > 0, 1, 0).astype(np.int64) if seed == 0 else named(h, size, seed)

    h, size = N.shingles(pa.array(["a b c", "d e f", ""]), 3)
    assert len(set(clumsy(h, size).tolist())) == 2 and len(set(named(h, size, 1).tolist())) == 3
    rows = spark.createDataFrame([(1, 5, 6), (1, 7, 8)], "cls long, n long, twin long").groupBy("cls").agg((F.min("twin") != F.max("twin")).alias("mixed"))
    assert rows.first()["mixed"]


def test_tree_finds_what_every_pair_would(spark):
    from larkspur.llm import near_duplicates as N

    rng = np.random.default_rng(2)
    measure = N.Measure(3, 80, 100)
    base = rng.poisson(3, (40, 64))
    points = np.clip(np.repeat(base, 30, axis=0) + rng.integers(-1, 2, (1200, 64)) * (rng.random((1200, 64)) < 0.2), 0, 255).astype(np.uint8)
    n = points.sum(axis=1).astype(np.int64)
    tree = N.RTree(n, points)
    assert len(tree.levels) >= 2
    seen = 0
    for i in range(0, 1200, 50):
        apart = np.abs(points.astype(int) - points[i]).sum(axis=1)
        want = np.flatnonzero(apart <= measure.most_apart(n + n[i]))
        got, _ = tree.within(measure, int(n[i]), points[i].astype(np.int16))
        sized = want[(n[want] * 80 <= n[i] * 100) & (n[i] * 80 <= n[want] * 100)]
        assert set(sized.tolist()) <= set(got.tolist()) <= set(want.tolist())
        seen += len(got)
    assert seen > 24


def ranked(links, seeds, damping=0.85, forward=True, averaged=False):
    """Power iteration in NumPy: mass along links (or against them), divided by the sender's links (or averaged over the receiver's)."""
    hosts = sorted({h for link in links for h in link} | set(seeds))
    at = {h: i for i, h in enumerate(hosts)}
    m = np.zeros((len(hosts), len(hosts)))
    for a, b in links:
        a, b = (a, b) if forward else (b, a)
        m[at[b], at[a]] += 1
    total = m.sum(axis=1 if averaged else 0)
    m = m / np.where(total > 0, total, 1)[:, None] if averaged else m / np.where(total > 0, total, 1)
    base = np.array([seeds.get(h, 0.0) for h in hosts]) * (1 - damping)
    x = base
    for _ in range(300):
        x = base + damping * m @ x
    return dict(zip(hosts, x))


def test_url_trust_equals_power_iteration(spark, monkeypatch):
    from larkspur.llm import url_trust as U
    from larkspur.llm.queries import RULES

    monkeypatch.setattr(U, "HUB_LINKS", 4)  # so that hosts of four links are dealt into parts
    rng = np.random.default_rng(6)
    hosts = [f"h{i}.org" for i in range(30)] + ["a.com", "b.com", "bad.net", "worse.net"]
    links = [(str(a), str(b)) for a, b in rng.choice(hosts, (160, 2)) if a != b]
    path = {"bad.net": "/es/", "worse.net": "/fr/x"}
    pages = [(i, f"http://{h}{path.get(h, '/')}", "".join(f'<a class=x href="https://{b}/y">' for a, b in links if a == h), "extra") for i, h in enumerate(hosts)]
    got = {r["host"]: r for r in U.judge(spark.createDataFrame(pages, "page_id long, url string, html string, leads string"), RULES, tolerance=1e-5, rounds=70).collect()}
    good, evil = {"a.com": 1.0, "b.com": 1.0}, {"bad.net": 1.0, "worse.net": 1.0}
    want = {"trust": ranked(links, good), "distrust": ranked(links, evil, forward=False), "leads": ranked(links, evil, forward=False, averaged=True), "vouched": ranked(links, good, averaged=True)}
    for h in hosts:
        leads, vouched = want["leads"].get(h, 0) / 0.15, want["vouched"].get(h, 0) / 0.15
        assert abs(got[h]["trust"] - want["trust"].get(h, 0)) < 1e-4 and abs(got[h]["distrust"] - want["distrust"].get(h, 0)) < 1e-4
        assert abs(got[h]["leads"] - leads) < 1e-3 and abs(got[h]["vouched"] - vouched) < 1e-3
        if got[h]["rule"] is None:
            assert got[h]["verdict"] == ("block" if leads - vouched > 0.5 else "allow")


def test_url_trust_by_distance_and_odd_tables(spark):
    from larkspur.llm.queries import RULES
    from larkspur.llm.url_trust import judge

    link = lambda h: f'<a href="//{h}/x">'
    chain = [(i, f"http://far{i}.org/", link(f"far{i - 1}.org" if i > 1 else "bad.net")) for i in range(1, 8)]
    pages = [*chain, (0, "http://bad.net/fr/", None), (8, "http://a.com/", link("far1.org")), (9, "http://a.com/", None), (9, "http://a.com/", None), (None, "://", ""), (None, None, None)]
    table = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = [(r["page_id"], r["verdict"]) for r in judge(table, RULES).collect()]
    said = dict(got)
    assert len(got) == len(pages) and [said[i] for i in range(1, 8)] == ["allow", "block", "block", "block", "allow", "allow", "allow"] and said[0] == "block" and got.count((9, "allow")) == 2 and got.count((None, "allow")) == 2
    assert judge(table.limit(0), RULES).count() == 0


def test_nearest_of_ties_lengths_and_clashing_names(spark):
    from larkspur.llm.nearest import search

    ties = [(i, [1.0, float(i % 2)]) for i in range(1, 24)] + [(100, [1.0, 0.0])]
    odd = [(200, [1.0, 1.0, 1.0]), (201, [1.0, 1.0, 2.0]), (202, [2.0, 1.0, 1.0]), (300, [5.0])]
    table = spark.createDataFrame([(i, v, "x", 3) for i, v in ties + odd], "vec_id long, embedding array<float>, leaf string, id int")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in search(table).collect())
    assert [g[2] for g in got if g[0] == 100] == [2, 4, 6, 8, 10, 12, 14, 16, 18, 20] and [g[1:] for g in got if g[0] == 200] == [(1, 201, 1.0), (2, 202, 1.0)]
    assert not [g for g in got if g[0] == 300]


def test_nearest_scans_a_small_share_of_clustered_vectors():
    from larkspur.llm import nearest as N

    rng = np.random.default_rng(9)
    centres = rng.normal(size=(150, 32))
    points = np.repeat(centres, 40, axis=0) + rng.normal(size=(6000, 32)) * 0.15
    tree = N.Tree(points)
    leaf = tree.assign(points)
    size = np.bincount(leaf, minlength=tree.leaves)
    asked = rng.permutation(6000)[:60]
    truth = []
    for q in asked.tolist():
        score = N.distances(points, points[q])
        score[q] = np.inf
        truth += [(q, int(leaf[i])) for i in N.smallest(score, np.arange(6000), 10)]
    visits = N.calibrate(tree, {q: points[q] for q in asked.tolist()}, truth, 0.94)
    seen = {q: tree.best_bins(points[q], visits) for q in asked.tolist()}
    assert np.mean([leaf in seen[q] for q, leaf in truth]) >= 0.9
    assert np.mean([size[b].sum() for b in seen.values()]) < 0.2 * 6000


def test_sharding_of_clashing_names_and_one_large_group(spark):
    from larkspur.llm.sharding import shard_by_bytes

    rows = [(i if i % 9 else None, "same text" if i % 3 == 0 else f"text {i} " * (i % 50), "a", 5, "b") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _size string, key int, _hshard string")
    got = shard_by_bytes(docs, bucket_rows=100).collect()
    assert shard_by_bytes(docs).columns == [*docs.columns, "__size", "_shard", "_slot"]
    load = {}
    for r in got:
        load.setdefault(r["_shard"], []).append((r["_slot"], r["__size"]))
        assert r["__size"] == len(r["text"]) + 1
    total = sum(s for x in load.values() for _, s in x)
    assert len(got) == 3000 and all(sorted(p for p, _ in x) == list(range(len(x))) for x in load.values())
    assert all(abs(sum(s for _, s in x) - total / 8) < 0.01 * total for x in load.values()) and len({r["_shard"] for r in got if r["text"] == "same text"}) == 1


def test_language_model_equals_brute_force(spark):
    """Interpolated absolute discounting by dictionaries of counts; the trie's 16-bit logarithms may differ by a thousandth a token."""
    from collections import Counter

    rng = np.random.default_rng(12)
    say = lambda: " ".join(rng.choice(list("abcdefghijkl"), rng.integers(0, 14), p=np.arange(1, 13) / 78))
    train = [(i, say()) for i in range(60)] + [(60, None), (61, "a"), (62, "a")]
    asked = train[:20] + [(100, "a b zz c d"), (101, "zz yy"), (102, ""), (103, "L k J"), (None, "a b"), (103, "l k j")]
    model = language_model.train(spark.createDataFrame(train, "doc_id long, text string"))
    got = language_model.score(spark.createDataFrame([(i, t, "x") for i, t in asked], "doc_id long, text string, n_tokens string"), model).collect()

    words = lambda t: [*(t or "").lower().split(), "<end>"]
    one, two, three = Counter(), Counter(), Counter()
    for _, t in train:
        w = words(t)
        one.update(w)
        two.update(zip(["<s>", *w], w))
        three.update(zip(["<s>", *w], w, w[1:]))
    n, v, d = sum(one.values()), len(one), 0.75
    one["<s>"] = len(train)
    kinds, follow = Counter(a for a, _ in two), Counter()
    for (a, b, _), c in three.items():
        follow[a, b] += c
    more = Counter((a, b) for a, b, _ in three)
    want = []
    for i, t in asked:
        w, total, base = words(t), 0.0, 0.0
        for k, x in enumerate(w):
            known = one[x] if x != "<s>" else 0
            p1 = (known + 1) / (n + v + 1)
            a = w[k - 1] if k else "<s>"
            p = p1 if not one[a] else max(0, two[a, x] - d) / one[a] + d * kinds[a] / one[a] * p1
            if k and follow[context := ((w[k - 2] if k > 1 else "<s>"), a)]:
                p = max(0, three[(*context, x)] - d) / follow[context] + d * more[context] / follow[context] * p
            total, base = total + np.log10(p), base + np.log10(p1)
        want.append((i, len(w), sum(one[x] > 0 for x in w), base, total))
    assert len(got) == len(want) and model.n_tokens == n and model.vocabulary == v
    for r, (i, size, known, base, total) in zip(sorted(got, key=lambda r: (str(r["doc_id"]), r["score"])), sorted(want, key=lambda x: (str(x[0]), x[4]))):
        assert (r["doc_id"], r["n_tokens"], r["n_known"]) == (i, size, known) and abs(r["base_score"] - base) < 1e-9 and abs(r["score"] - total) < 1e-3 * size
    nothing = language_model.train(spark.createDataFrame([], "doc_id long, text string"))
    assert nothing.n_tokens == 0 and language_model.score(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), nothing).first()["n_known"] == 0


def test_elias_fano_runs_over_many_words():
    """Long runs of values that share their high part, and values far apart."""
    for values in (np.arange(3000, dtype=np.uint64), np.array([0, 1, 1 << 40, (1 << 40) + 1, (1 << 60) + 7], np.uint64), np.concatenate([np.arange(256), np.arange(5) * 70_000 + 1_000_000]).astype(np.uint64)):
        ef = language_model.EliasFano.build(values)
        asked = np.unique(np.concatenate([values, values + np.uint64(1), values + np.uint64(5000)]))
        want = np.where(np.isin(asked, values), np.searchsorted(values, asked), -1)
        assert (ef.find(asked) == want).all()


def test_token_files_layout(spark, tmp_path):
    import pyarrow.parquet as pq

    from larkspur.llm import token_files

    docs = spark.createDataFrame([(i, f"text number {i} " * 30) for i in range(6000)], "doc_id long, text string")
    token_files.write_tokens(docs, f"file://{tmp_path}/t", partitions=1)
    (file,) = tmp_path.glob("t/*.parquet")
    meta = pq.ParquetFile(file).metadata
    columns = {meta.row_group(0).column(i).path_in_schema.split(".")[0]: meta.row_group(0).column(i) for i in range(meta.num_columns)}
    assert "DELTA_BINARY_PACKED" in columns["id"].encodings and any("DICTIONARY" in e for e in columns["tokens"].encodings)
    assert columns["id"].has_offset_index and columns["id"].has_column_index and meta.row_group(0).sorting_columns is not None
    index = token_files.token_index(spark, f"file://{tmp_path}/t")
    assert "tokens:array" not in index._jdf.queryExecution().executedPlan().toString()  # the metadata columns alone are read
    some = token_files.read_tokens(spark, f"file://{tmp_path}/t").where("id between 3000 and 3009").collect()
    starts = {r["id"]: r["start"] for r in index.collect()}
    assert [r["n_tokens"] for r in some] == [len(r["tokens"]) for r in some] and starts[3001] - starts[3000] == some[0]["n_tokens"] and starts[0] == 0
