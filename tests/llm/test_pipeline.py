"""The pipeline's stages and two operators against DuckDB SQL on a small fixture with copies, passages, nulls and repeats."""

import duckdb
import pandas as pd
import pytest

import corpus_pipeline
from larkspur.llm import oracles

PASSAGE = " ".join(f"bench{i}" for i in range(14))


def rows():
    made = []
    for g in range(6):
        words = [f"group{g}word{i}" for i in range(120)]
        made += [" ".join(words), " ".join(words).upper(), " ".join([*words[:60], "changed", *words[61:]]), " ".join(words[:100]), " ".join(words[30:])]
        made.append(" ".join([*words[:40], PASSAGE, *words[60:90][::-1]]))
    made += [None, "", " \t\n", "one", "one two", "One  two", "ten words " * 5, PASSAGE, PASSAGE.upper() + " tail", PASSAGE[7:], "word " * 4000]
    ids = [*range(len(made) - 2), 3, None]  # one repeated id and one null
    return pd.DataFrame({"doc_id": pd.array(ids, "Int64"), "text": pd.array(made, "string"), "lang": "en", "source": "s", "n_chars": 1})


@pytest.fixture(scope="module")
def sf_dir(tmp_path_factory):
    folder = tmp_path_factory.mktemp("sf")
    docs = rows()
    docs.to_parquet(folder / "documents.parquet")
    pd.DataFrame({"item_id": pd.array([5, 11, None, 12], "Int64"), "text": pd.array([PASSAGE, "ten words ten", PASSAGE, None], "string")}).to_parquet(folder / "benchmark.parquet")
    good = pd.DataFrame({"doc_id": pd.array(range(len(docs)), "Int64"), "quality": 1, "toxic": 0})
    good.loc[good.doc_id % 6 == 4, "quality"] = 0
    good.to_parquet(folder / "labels.parquet")
    return str(folder)


def answer(sf_dir, sql, **views):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        if t in views:
            con.register(t, views[t])
        else:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con.execute(sql).fetchall()


def as_rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def test_decontamination_equals_sql(spark, sf_dir):
    from larkspur.llm.queries import op1_decontamination

    got = as_rows(op1_decontamination(spark, sf_dir), "doc_id", "n_words", "n_hit", "contaminated")
    want = sorted(((r[0], r[1], r[2], r[5]) for r in answer(sf_dir, oracles.contamination_sql())), key=str)
    assert got == want and sum(r[3] for r in got) >= 8


@pytest.mark.parametrize("k, num", [(3, 90), (5, 80)])
def test_components_equal_sql(spark, sf_dir, k, num):
    from larkspur.llm.near_duplicates import components

    got = as_rows(components(spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id is not null"), k=k, num=num), "doc_id", "n_shingles", "component_id")
    docs = rows().dropna(subset=["doc_id"])
    assert got == sorted(answer(sf_dir, oracles.components_sql(k, num), documents=docs), key=str)


def by_row(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def test_stages_keep_what_sql_keeps(spark, sf_dir):
    """Row by row: null and repeated ids are judged by their own texts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    frame = rows()
    pairs = [(None if pd.isna(i) else int(i), None if pd.isna(t) else t) for i, t in zip(frame.doc_id, frame.text)]
    numbered = frame.assign(doc_id=range(len(frame)))
    groups = {}
    for row, _, component in answer(sf_dir, oracles.components_sql(5, 80), documents=numbered):
        groups.setdefault(component, []).append(row)
    stays = {min(g, key=lambda r: (pairs[r][0] is None, pairs[r][0] or 0, r)) for g in groups.values()}
    unique = corpus_pipeline.near_duplicates(spark, docs, sf_dir)
    assert unique.columns == docs.columns and by_row(unique) == sorted((pairs[r] for r in stays), key=str)

    hit = {r[0] for r in answer(sf_dir, oracles.contamination_sql(), documents=numbered) if r[2] > 0}
    clean = corpus_pipeline.decontamination(spark, docs, sf_dir)
    assert clean.columns == docs.columns and by_row(clean) == sorted((p for r, p in enumerate(pairs) if r not in hit), key=str)


def test_stages_take_empty_tables_and_clashing_names(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("*", "1 as _row", "2 as id", "3 as component_id", "4 as best")
    for name, stage in corpus_pipeline.STAGES:
        none = stage(spark, docs.limit(0), sf_dir)
        assert none.count() == 0, name
        if name != "packing":
            assert stage(spark, docs, sf_dir).columns == docs.columns


def test_features_take_little_memory():
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from larkspur.llm import kernels, quality

    words = np.random.default_rng(0).integers(0, 50_000, 2_600_000)
    text = " ".join(np.char.add("w", words.astype(str)).tolist())
    for texts in ([text], [text[i : i + 2000] for i in range(0, len(text), 2000)]):
        column = pa.array(texts)
        assert column.nbytes >= 16_000_000
        tracemalloc.start()
        found = [quality.features(column.slice(a, n)) for a, n in kernels.slices(column, quality.RUN_BYTES)][:1] if len(texts) == 1 else sum(len(quality.features(column.slice(a, n))[0]) for a, n in kernels.slices(column, quality.RUN_BYTES))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert found and peak < (600 << 20 if len(texts) == 1 else 60 << 20)


def test_run_packs_what_the_stages_keep(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
    kept = sorted((r["doc_id"] for r in docs.select("doc_id").collect()), key=str)
    packed = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted((r["doc_id"] for r in packed if r["piece"] == 0), key=str) == kept
    assert all(name == want for (name, _), want in zip(corpus_pipeline.STAGES, ["quality", "near_duplicates", "decontamination", "packing"]))
