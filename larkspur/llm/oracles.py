"""DuckDB SQL for the operators that SQL can express, over the same whole tables."""

from __future__ import annotations

LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ALNUM_WORDS = rf"coalesce(regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"
SPACED_WORDS = rf"coalesce(regexp_extract_all({LOWERED}, '[^\x20\x09-\x0D]+'), [])"


def contamination_sql(window: int = 10) -> str:
    """Every window of the benchmark against every run of as many words in the documents."""
    return f"""
WITH items AS (SELECT item_id, w, least(len(w), {window}) AS l FROM (SELECT item_id, {ALNUM_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
windows AS MATERIALIZED (
  SELECT DISTINCT item_id, l, array_to_string(w[i:i + l - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - l + 2)) AS i FROM items)),
docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {ALNUM_WORDS} AS w FROM documents),
lengths AS (SELECT DISTINCT l FROM windows),
runs AS (SELECT r, l, i, array_to_string(w[i:i + l - 1], ' ') AS g FROM (SELECT r, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM docs, lengths WHERE len(w) >= l)),
hits AS MATERIALIZED (SELECT DISTINCT r, i, l, item_id FROM runs JOIN windows USING (l, g)),
hit_words AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, unnest(range(i, i + l)) AS p FROM hits) GROUP BY r),
hit_items AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM hits) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(hit_words.n, 0) AS n_hit, coalesce(hit_items.n, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(hit_words.n, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit_words USING (r) LEFT JOIN hit_items USING (r)
"""


def components_sql(k: int = 3, num: int = 90, den: int = 100) -> str:
    """Distinct shingle sets joined on each shingle, then the closure of their links."""
    return f"""
WITH RECURSIVE words AS (SELECT row_number() OVER () AS r, doc_id, {SPACED_WORDS} AS w FROM documents),
docs AS MATERIALIZED (
  SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {k} THEN [array_to_string(w, ' ')]
    ELSE list_sort(list_distinct(list_transform(range(1, len(w) - {k} + 2), lambda i: array_to_string(w[i:i + {k} - 1], ' ')))) END AS s FROM words),
sets AS MATERIALIZED (SELECT row_number() OVER () AS c, s, len(s) AS n, min(doc_id) AS low FROM docs WHERE len(s) > 0 GROUP BY s),
shingles AS MATERIALIZED (SELECT c, n, unnest(s) AS g FROM sets),
links AS MATERIALIZED (
  SELECT a.c AS a, b.c AS b FROM shingles a JOIN shingles b ON a.g = b.g AND a.c <> b.c
    AND a.n * {den} >= b.n * {num} AND b.n * {den} >= a.n * {num}
  GROUP BY a.c, b.c, a.n, b.n HAVING {den} * count(*) >= {num} * (a.n + b.n - count(*))),
reach(c, other) AS (SELECT c, c FROM sets UNION SELECT reach.c, links.b FROM reach JOIN links ON reach.other = links.a),
lowest AS (SELECT reach.c, min(sets.low) AS component FROM reach JOIN sets ON sets.c = reach.other GROUP BY reach.c)
SELECT doc_id, len(docs.s) AS n_shingles, coalesce(component, doc_id) AS component_id
FROM docs LEFT JOIN sets ON docs.s = sets.s LEFT JOIN lowest USING (c)
"""


ORACLES = {"op1_decontamination": contamination_sql(), "op5_jaccard_join": components_sql()}
