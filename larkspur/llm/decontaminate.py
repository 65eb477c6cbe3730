"""Benchmark decontamination by a distributed positional inverted index.

The training texts' postings are stored by segment: a segment holds some
hundred thousand words of consecutive texts, its distinct terms in hash order,
and for each term the ascending positions at which it stands. Positions skip
one between texts, so that no phrase spans two. A phrase search starts from the
segment's rarest term of the phrase and intersects the other terms' lists,
moved by their offsets, from rare to frequent; a proximity search takes the
same lists and looks for all terms within a span of words. Segments are
independent rows: no shuffle, and no list longer than its segment.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm import common as C
from larkspur.llm import kernels as K

SEGMENT_WORDS = 400_000
#: Bytes of texts indexed at a time.
RUN_BYTES = 2 << 20
BLOCK_BYTES = 16 << 20
INDEX = "texts binary, terms binary, ends binary, postings binary, n_words long"


def _pack(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(a.tobytes())


def _unpack(b: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), kind)


class Segment:
    """Postings of one segment: ids, text starts (in positions) and words per text; term → positions."""

    def __init__(self, row: dict):
        texts = _unpack(row["texts"], np.int64).reshape(4, -1)
        self.ids, self.known_id, self.begin, self.n_words = texts
        self.terms, self.ends = _unpack(row["terms"], np.uint64), _unpack(row["ends"], np.int64)
        self.deltas = _unpack(row["postings"], np.uint32)
        self.lists: dict[int, np.ndarray] = {}

    def locate(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each term stands in the segment's term list, and how often it occurs (0: absent)."""
        if not len(self.terms):
            return np.zeros(len(terms), np.int64), np.zeros(len(terms), np.int64)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        size = self.ends[at] - np.where(at > 0, self.ends[at - 1], 0)
        return at, np.where(self.terms[at] == terms, size, 0)

    def positions(self, at: int) -> np.ndarray:
        if at not in self.lists:
            lo = int(self.ends[at - 1]) if at else 0
            self.lists[at] = np.cumsum(self.deltas[lo : int(self.ends[at])], dtype=np.int64)
        return self.lists[at]

    def phrase(self, ats: list[int], sizes: list[int]) -> np.ndarray:
        """Positions at which the phrase starts, from its terms' places and frequencies."""
        order = sorted(range(len(ats)), key=lambda j: sizes[j])
        starts = self.positions(ats[order[0]]) - order[0]
        for j in order[1:]:
            if not len(starts):
                break
            other = self.positions(ats[j])
            k = np.minimum(np.searchsorted(other, starts + j), len(other) - 1)
            starts = starts[other[k] == starts + j]
        return starts

    def near(self, ats: list[int], sizes: list[int], span: int) -> np.ndarray:
        """Positions of the rarest term around which every term stands within span words, in one text."""
        order = sorted(range(len(ats)), key=lambda j: sizes[j])
        anchor = self.positions(ats[order[0]])
        keep = np.ones(len(anchor), bool)
        text = np.searchsorted(self.begin, anchor, side="right") - 1
        lo = np.maximum(self.begin[text], anchor - span)
        hi = np.minimum(self.begin[text] + self.n_words[text] - 1, anchor + span)
        for j in order[1:]:
            other = self.positions(ats[j])
            keep &= np.searchsorted(other, hi, side="right") > np.searchsorted(other, lo, side="left")
        return anchor[keep]


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """Store the positional index of all texts in the shared folder; a text is never cut.

    A null text has no words; null ids are kept; an empty table gives no segment.
    """
    C.prepare(docs.sparkSession)

    def build(batches):
        for batch in K.runs(batches, 1, RUN_BYTES):
            offsets, data = K.utf8(batch.column(1))
            text, _, _, terms = K.words(offsets, data, K.ALNUM)
            n = len(batch)
            size = K.counts_per_text(text, n)
            stops = np.cumsum(size)
            lo = 0
            while lo < n:
                base = int(stops[lo] - size[lo])
                hi = max(lo + 1, int(np.searchsorted(stops, base + segment_words, side="right")))
                hi = min(hi, n)
                part = terms[base : int(stops[hi - 1])]
                sizes = size[lo:hi]
                position = np.arange(len(part)) + np.repeat(np.arange(hi - lo), sizes)
                order = np.argsort(part, kind="stable")
                grouped, position = part[order], position[order]
                last = np.flatnonzero(np.append(grouped[1:] != grouped[:-1], True)) if len(part) else np.zeros(0, np.int64)
                deltas = np.diff(position, prepend=0)
                firsts = np.append(0, last[:-1] + 1) if len(last) else last
                deltas[firsts] = position[firsts]
                ids = batch.column(0).slice(lo, hi - lo)
                begin = np.cumsum(sizes) - sizes + np.arange(hi - lo)
                texts = np.stack([ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False).astype(np.int64), begin, sizes])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([_pack(texts)]), pa.array([_pack(grouped[last])]), pa.array([_pack(last.astype(np.int64) + 1)]), pa.array([_pack(deltas.astype(np.uint32))]), pa.array([len(part)])],
                    names=["texts", "terms", "ends", "postings", "n_words"],
                )
                lo = hi

    chosen = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return C.stored(chosen.mapInArrow(build, INDEX), "postings", compression="uncompressed")


class Phrases:
    """Windows of benchmark items as rows of term numbers, each with the items that hold it."""

    def __init__(self, items: list[tuple[str, str | None]], width: int):
        column = pa.array([text for _, text in items], pa.string())
        text, _, _, terms = K.words(*K.utf8(column), K.ALNUM)
        self.vocabulary, number = np.unique(terms, return_inverse=True)
        found: dict[tuple[int, ...], set[str]] = {}
        for i, line in enumerate(np.split(number, np.cumsum(K.counts_per_text(text, len(items)))[:-1]) if items else []):
            line = line.tolist()
            for k in range(max(1, len(line) - width + 1)):
                if window := tuple(line[k : k + width]):
                    found.setdefault(window, set()).add(items[i][0])
        self.windows = sorted(found)
        self.items = [sorted(found[w]) for w in self.windows]
        self.length = np.array([len(w) for w in self.windows], np.int64)
        self.matrix = np.full((len(self.windows), width), -1)
        for i, w in enumerate(self.windows):
            self.matrix[i, : len(w)] = w


def _blocks(items: DataFrame, id_col: str, text_col: str, width: int):
    """The benchmark in blocks whose texts stay under BLOCK_BYTES on average."""
    chosen = items.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    size = chosen.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, math.ceil(size / BLOCK_BYTES))
    for i in range(n):
        part = chosen.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == i) if n > 1 else chosen
        yield Phrases(sorted({(r["id"], r["text"] or "") for r in part.collect()}), width)


FOUND = "segment string, nth long, doc_id long, n_words long, lo array<long>, hi array<long>, items array<string>"


def find(index: DataFrame, phrases: Phrases) -> DataFrame:
    """One row for each text of the index: its spans [lo, hi) of hit words, and the items that occur."""
    shared = index.sparkSession.sparkContext.broadcast(phrases)

    def search(batches):
        p = shared.value
        for batch in batches:
            for row in batch.to_pylist():
                s = Segment(row)
                n = len(s.ids)
                name = hashlib.md5(row["texts"] + row["postings"]).hexdigest()
                at, size = s.locate(p.vocabulary)
                present = np.append(size > 0, True)
                starts, lengths, items = [], [], [set() for _ in range(n)]
                for w in np.flatnonzero(present[p.matrix].all(axis=1)).tolist() if len(p.windows) else []:
                    window = p.windows[w]
                    got = s.phrase([int(at[t]) for t in window], [int(size[t]) for t in window])
                    if len(got):
                        starts.append(got)
                        lengths.append(np.full(len(got), len(window)))
                        for k in np.unique(np.searchsorted(s.begin, got, side="right") - 1).tolist():
                            items[k].update(p.items[w])
                lo, hi = np.zeros(0, np.int64), np.zeros(0, np.int64)
                if starts:
                    begin, length = np.concatenate(starts), np.concatenate(lengths)
                    depth = np.zeros(int(s.begin[-1] + s.n_words[-1]) + 2, np.int64)
                    np.add.at(depth, begin, 1)
                    np.add.at(depth, begin + length, -1)
                    change = np.diff((np.cumsum(depth) > 0).astype(np.int8), prepend=0)
                    lo, hi = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
                text = np.searchsorted(s.begin, lo, side="right") - 1
                ends = np.append(0, np.cumsum(np.bincount(text, minlength=n)[:n])).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([name] * n),
                        pa.array(np.arange(n)),
                        pa.array(s.ids, mask=s.known_id == 0),
                        pa.array(s.n_words),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(lo - s.begin[text])),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(hi - s.begin[text])),
                        pa.array([sorted(i) for i in items], pa.list_(pa.string())),
                    ],
                    names=["segment", "nth", "doc_id", "n_words", "lo", "hi", "items"],
                )

    return index.mapInArrow(search, FOUND)


def proximity(index: DataFrame, terms: list[str], span: int) -> DataFrame:
    """(doc_id, position): where the rarest of the terms has all others within span words of it."""
    text, _, _, hashes = K.words(*K.utf8(pa.array(terms, pa.string())), K.ALNUM)

    def search(batches):
        for batch in batches:
            for row in batch.to_pylist():
                s = Segment(row)
                at, size = s.locate(hashes)
                if len(hashes) and (size > 0).all():
                    got = s.near(at.tolist(), size.tolist(), span)
                    k = np.searchsorted(s.begin, got, side="right") - 1
                    yield pa.RecordBatch.from_arrays([pa.array(s.ids[k], mask=s.known_id[k] == 0), pa.array(got - s.begin[k])], names=["doc_id", "position"])

    return index.mapInArrow(search, "doc_id long, position long")


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", width: int = 10) -> DataFrame:
    """For every text its words inside occurrences of any item's windows of ``width`` words.

    Columns: doc_id, n_words, n_hit, n_items, items (sorted as strings), spans
    lo/hi. An item shorter than the width is one window; an item without words,
    or with a null id, matches nothing; items that share an id count once. Rows
    with a null or repeated doc_id each keep their own row.
    """
    index = build_index(docs, id_col, text_col)
    parts = [find(index, phrases) for phrases in _blocks(items, item_col, item_text, width)]
    rows = parts[0]
    if len(parts) > 1:
        for part in parts[1:]:
            rows = rows.unionByName(part)
        rows = rows.groupBy("segment", "nth").agg(
            F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("lo")).alias("lo"), F.flatten(F.collect_list("hi")).alias("hi"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
        )
        spans = F.array_sort(F.arrays_zip("lo", "hi"))
        zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
        n_hit = F.aggregate(spans, zero, lambda acc, x: F.struct((acc["n"] + F.greatest(F.lit(0), x["hi"] - F.greatest(x["lo"], acc["end"]))).cast("long").alias("n"), F.greatest(acc["end"], x["hi"]).cast("long").alias("end")), lambda acc: acc["n"])
    else:
        n_hit = F.aggregate(F.zip_with("lo", "hi", lambda a, b: b - a), F.lit(0).cast("long"), lambda acc, x: acc + x)
    return rows.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", "lo", "hi")
