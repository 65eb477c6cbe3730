"""Search over stored collections: embeds the query, filters, caches; writes empty the cache."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.operators import chunking as CH
from larkspur.operators import search as S
from larkspur.plans import ingest as I
from larkspur.plans.maintenance import ResultCache
from larkspur.sources import store as ST

log = logging.getLogger(__name__)


class SearchService:
    """embed: text → vector; complete: messages → reply; keywords: (collection, query) → ids, best first."""

    def __init__(self, store: ST.VectorStore, embed: Callable[[str], list[float]], complete: Callable[[list[dict]], str] | None = None, keywords: Callable[[str, str], list[str]] | None = None, cache: ResultCache | None = None):
        self.store, self.embed, self.complete, self.keywords = store, embed, complete, keywords
        self.cache = cache or ResultCache(0)
        self.skipped = 0  # rows of another dimension at the last search

    def find(self, collection: str, query: str, top_k: int = 5, filters: dict | None = None, collapse_chunks: bool = False) -> list[tuple[str, float]]:
        """(identifier, score) of the nearest rows; none, and nothing embedded, where the collection is empty."""
        version = self.store.version()
        key = self.cache.key(collection, query, top_k, filters, collapse_chunks, version)
        if (held := self.cache.get(key)) is not None:
            return held
        rows = self.store.read(version, [collection])
        found: list[tuple[str, float]] = []
        if rows.limit(1).count():
            vector = self.embed(query)
            self.skipped = rows.where(F.size("vector") != len(vector)).count()
            if self.skipped:
                log.warning("%d rows of %s have another dimension than the query", self.skipped, collection)
            hits = S.find_similar(rows, vector, top_k, filters, collapse_chunks).orderBy("rank")
            found = [(r["identifier"], r["score"]) for r in hits.collect()]  # top_k at most
        self.cache.put(key, found)
        return found

    def find_with_rerank(self, collection: str, query: str, top_k: int = 5, rerank_k: int = 20, filters: dict | None = None) -> list[tuple[str, float]]:
        """The first top_k of max(top_k, rerank_k) hits in the order that the model's reply names; its failure keeps the order."""
        hits = self.find(collection, query, max(top_k, rerank_k), filters)
        if len(hits) > 1 and self.complete:
            try:
                reply = self.complete([{"role": "user", "content": S.rerank_prompt(query, [i for i, _ in hits])}])
                spark = self.store.spark
                ids = spark.createDataFrame([(reply,)], "reply string").select(S.parse_ranking(F.col("reply"))).first()[0] or []
                place = {i: n for n, i in reversed(list(enumerate(ids)))}
                hits = sorted(hits, key=lambda h: place.get(h[0], len(ids)))
            except Exception as e:  # noqa: BLE001
                log.warning("not reranked: %s", e)
        return hits[:top_k]

    def find_hybrid(self, collection: str, query: str, top_k: int = 5, semantic_weight: float = 0.7, keyword_weight: float = 0.3, filters: dict | None = None) -> list[tuple[str, float]]:
        near = self.find(collection, query, 4 * top_k, filters)
        words = self.keywords(collection, query) if self.keywords else []
        ranked = lambda ids: self.store.spark.createDataFrame([(i, n + 1) for n, i in enumerate(ids)], "identifier string, rank int")
        fused = S.reciprocal_rank_fusion(ranked([i for i, _ in near]), ranked(words), top_k, semantic_weight, keyword_weight)
        return [(r["identifier"], r["score"]) for r in fused.orderBy("rank").collect()]

    def _commit(self, rows: DataFrame, version: int, touched: list[str]) -> int:
        made = self.store.commit(rows, expected=version, touched=touched)
        self.cache.flush()
        return made

    def _held(self, named: DataFrame) -> tuple[int, list[str], DataFrame]:
        """The newest version, the collections that rows name (each has its place in the log entry), and their stored rows."""
        version = self.store.version()
        touched = [r[0] for r in named.select("collection").distinct().collect()]
        return version, touched, self.store.read(version, touched)

    def ingest(self, docs: DataFrame, embed=I.hashed_embedding, now: int = 0) -> int:
        version, touched, held = self._held(docs)
        return self._commit(I.ingest(held, docs, embed, now), version, touched)

    def ingest_chunked(self, docs: DataFrame, chunks, embed=I.hashed_embedding, now: int = 0, replace_bare: bool = False) -> int:
        version, touched, held = self._held(docs)
        return self._commit(I.ingest_chunked(held, docs, chunks, embed, now, replace_bare), version, touched)

    def delete(self, keys: DataFrame) -> int:
        version, touched, held = self._held(keys)
        kept, n = ST.delete(held, keys)
        self._commit(kept, version, touched)
        return n

    def delete_chunked(self, collection: str, parents: DataFrame) -> int:
        """Drop the parents' own chunks in one collection; how many rows went."""
        version = self.store.version()
        kept, n = CH.delete_chunked(self.store.read(version, [collection]), parents)
        self._commit(kept.select(*ST.COLUMNS), version, [collection])
        return n
