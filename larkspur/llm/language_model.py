"""Language-model scoring by an Elias-Fano n-gram trie.

Training counts words, then runs of three words, in two exchanges of packed
arrays: each batch of texts sends, to each shard, the distinct n-grams it holds
with their counts. A shard's trie has a level of pairs and a level of triples.
A level is a monotone sequence (context's place * vocabulary + word) in
Elias-Fano form, whose successors of one context are neighbours, beside 16-bit
logarithms of discounted probabilities and of the mass left to shorter
contexts. Levels lie in the shared folder and are memory-mapped by scoring
workers, which hold no more of them than the pages they touch. The levels must
therefore be on a folder mounted on all hosts (a ``file:`` spark.checkpoint.dir).

Probabilities interpolate absolute discounting down to add-one words; every
counted triple is in the trie unless a larger ``min_triples`` is asked for.
"""

from __future__ import annotations

import json
import math
import os
import uuid
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm import common as C
from larkspur.llm import kernels as K

END = np.uint64(1)
SHARD_BYTES = 24 << 20
SCALE = 65535 / 20
#: Shards that a worker keeps mapped.
OPEN_FILES = 16_384
_FILES: dict[str, dict[str, np.ndarray]] = {}
_ONES, _TOPS = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)
_FIVES, _THREES, _FIFTEENS = np.uint64(0x5555555555555555), np.uint64(0x3333333333333333), np.uint64(0x0F0F0F0F0F0F0F0F)
_set_bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
#: For every byte, where its n-th set bit stands.
_NTH = np.argsort(1 - _set_bits, axis=1, kind="stable")


_RESTORED = 10.0 ** (np.arange(65536) / -SCALE)


def quantise(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.clip(np.rint(-np.log10(p) * SCALE), 0, 65535).astype(np.uint16)


def restore(code: np.ndarray) -> np.ndarray:
    return _RESTORED[code]


class EliasFano:
    """A sorted sequence of distinct 64-bit values: low bits in whole bytes, high bits in unary."""

    KINDS = {8: np.uint8, 16: np.uint16, 32: np.uint32, 64: np.uint64}

    def __init__(self, low: np.ndarray, bits: np.ndarray, zeros: np.ndarray):
        self.low, self.bits, self.zeros = low, bits, zeros
        self.shift = low.dtype.itemsize * 8

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        top = int(values[-1]) if n else 0
        shift = min(cls.KINDS, key=lambda s: n * s + (top >> s) + n)
        high = (values >> np.uint64(shift)).astype(np.int64) if shift < 64 else np.zeros(n, np.int64)
        size = n + (top >> shift) + 2
        bits = np.zeros((-(-size // 64) + 1) * 64, np.uint8)  # one word more, for windows that reach over
        bits[high + np.arange(n)] = 1
        bits = np.packbits(bits, bitorder="little").view(np.uint64)
        unset = 64 - np.bitwise_count(bits).astype(np.int64)
        zeros = np.cumsum(unset) - unset
        return cls(values.astype(cls.KINDS[shift]), bits, zeros.astype(np.uint32) if len(bits) < 1 << 25 else zeros)

    def select0(self, k: np.ndarray) -> np.ndarray:
        """Position of the k-th unset bit, from 0: its word by the directory, its byte by prefix counts, its bit by table."""
        word = np.searchsorted(self.zeros, k.astype(self.zeros.dtype), side="right") - 1
        rest = (k - self.zeros[word]).astype(np.uint64)
        value = ~self.bits[word]
        counts = value - ((value >> np.uint64(1)) & _FIVES)
        counts = (counts & _THREES) + ((counts >> np.uint64(2)) & _THREES)
        upto = ((counts + (counts >> np.uint64(4))) & _FIFTEENS) * _ONES
        byte = np.bitwise_count(((rest * _ONES | _TOPS) - upto) & _TOPS).astype(np.uint64) << np.uint64(3)
        before = ((upto << np.uint64(8)) >> byte) & np.uint64(255)
        return word * 64 + byte.astype(np.int64) + _NTH[((value >> byte) & np.uint64(255)).astype(np.int64), (rest - before).astype(np.int64)]

    def run(self, at: np.ndarray) -> np.ndarray:
        """How many set bits follow from each position on, up to the next unset one."""
        word, off = at >> 6, (at & 63).astype(np.uint64)
        near = ~self.bits[word] >> off
        free = near & (~near + np.uint64(1))
        inside = np.bitwise_count(free - np.uint64(1)).astype(np.int64)
        beyond = np.flatnonzero(near == 0)
        if len(beyond):
            nth = self.zeros[word[beyond] + 1].astype(np.int64)
            inside[beyond] = self.select0(nth) - at[beyond]
        return inside

    def find(self, q: np.ndarray) -> np.ndarray:
        """Each value's place in the sequence, or -1: a successor search among the values of its high part."""
        n = len(self.low)
        if not n or not len(q):
            return np.full(len(q), -1)
        if self.shift < 64:
            high = (q >> np.uint64(self.shift)).astype(np.int64)
            inside = high < len(self.bits) * 64 - n
            high = np.where(inside, high, 0)
            at = np.where(high > 0, self.select0(np.maximum(high - 1, 0)) + 1, 0)
            lo = at - high
            hi = np.where(inside, lo + self.run(np.minimum(at, len(self.bits) * 64 - 65)), lo)
        else:
            lo, hi = np.zeros(len(q), np.int64), np.full(len(q), n)
        low, stop = q.astype(self.low.dtype), hi.copy()
        open_ = np.flatnonzero(lo < hi)
        lo = lo.copy()
        while len(open_):
            first, last = lo[open_], hi[open_]
            middle = (first + last) >> 1
            less = self.low[middle] < low[open_]
            lo[open_], hi[open_] = np.where(less, middle + 1, first), np.where(less, last, middle)
            open_ = open_[lo[open_] < hi[open_]]
        found = (lo < stop) & (self.low[np.minimum(lo, n - 1)] == low)
        return np.where(found, lo, -1)

    def arrays(self, name: str) -> dict[str, np.ndarray]:
        return {f"{name}.low": self.low, f"{name}.bits": self.bits, f"{name}.zeros": self.zeros}


def save(folder: str, name: str, arrays: dict[str, np.ndarray]) -> None:
    """One file for all arrays of a shard's level; it appears whole, under its name, however often a task is tried."""
    os.makedirs(folder, exist_ok=True)
    places, at = {}, 0
    for part, a in arrays.items():
        places[part] = (a.dtype.str, len(a), at)
        at += -(-a.nbytes // 64) * 64
    head = json.dumps(places).encode()
    head += b" " * (-(len(head) + 8) % 64)
    tmp = f"{folder}/.{uuid.uuid4().hex}"
    with open(tmp, "wb") as f:
        f.write(len(head).to_bytes(8, "little") + head)
        for a in arrays.values():
            f.write(a.tobytes() + bytes(-a.nbytes % 64))
    os.replace(tmp, f"{folder}/{name}")


def mapped(folder: str, name: str) -> dict[str, np.ndarray]:
    path = f"{folder}/{name}"
    if path not in _FILES:
        if len(_FILES) >= OPEN_FILES:
            _FILES.pop(next(iter(_FILES)))
        raw = np.memmap(path, np.uint8, "r").view(np.ndarray)
        start = 8 + int.from_bytes(raw[:8].tobytes(), "little")
        places = json.loads(raw[8:start].tobytes())
        _FILES[path] = {part: raw[start + at : start + at + n * np.dtype(kind).itemsize].view(kind) for part, (kind, n, at) in places.items()}
    return _FILES[path]


def sequence(folder: str, name: str, part: str) -> EliasFano:
    held = mapped(folder, name)
    return EliasFano(*(held[f"{part}.{x}"] for x in ("low", "bits", "zeros")))


def narrow(a: np.ndarray) -> np.ndarray:
    """The same whole numbers in four bytes each, if they fit."""
    return a.astype(np.uint32) if not len(a) or int(a.max()) < 1 << 32 else a


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and where each value stands among them, by hashing; only the distinct ones are sorted."""
    coded = pa.array(values).dictionary_encode()
    found = coded.dictionary.to_numpy()
    order = np.argsort(found)
    rank = np.empty(len(found), np.int64)
    rank[order] = np.arange(len(found))
    return found[order], rank[coded.indices.to_numpy()]


def by_shard(shard: np.ndarray):
    """(shard, places of its entries) for each shard that has any: one sort, whatever the number of shards."""
    order = np.argsort(shard, kind="stable")
    kept = shard[order]
    first = np.flatnonzero(np.append(True, kept[1:] != kept[:-1])) if len(kept) else np.zeros(0, np.int64)
    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(kept)]):
        yield int(kept[a]), order[a:b]


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length, the first ascending and kept as differences; bytes of one weight lie together, as the high ones compress best."""
    first = np.diff(arrays[0], prepend=arrays[0].dtype.type(0))
    planes = (np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T) for a in (first, *arrays[1:]))
    return zstandard.ZstdCompressor(level=1).compress(b"".join(x.tobytes() for x in planes))


def _unpack(blob: bytes, kinds: list) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    sizes = [np.dtype(k).itemsize for k in kinds]
    n, out, at = len(raw) // sum(sizes), [], 0
    for k, size in zip(kinds, sizes):
        out.append(np.ascontiguousarray(raw[at : at + n * size].reshape(size, n).T).view(k).ravel())
        at += n * size
    return [np.cumsum(out[0], dtype=kinds[0]), *out[1:]]


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of every text with one end after each, and tokens per text."""
    offsets, data = K.utf8(column)
    text, _, _, h = K.words(offsets, data, K.SPACED)
    size = K.counts_per_text(text, len(offsets) - 1) + 1
    ends = np.cumsum(size)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint64)
    is_end = np.zeros(len(out), bool)
    is_end[ends - 1] = True
    out[is_end], out[~is_end] = END, h
    return out, size


@dataclass(frozen=True)
class Model:
    folder: str
    shards: int
    bits: int
    base: tuple[int, ...]
    vocabulary: int
    n_tokens: int
    n_texts: int
    discount: float
    runs: frozenset = frozenset()  # the shards that hold any pair
    begun: frozenset = frozenset()  # the word ranges that hold any context

    @property
    def span(self) -> int:
        return self.vocabulary + 2

    def range_of(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(h), np.int64)

    def shard_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (K.mix((a.astype(np.uint64) << np.uint64(32)) ^ b.astype(np.uint64)) % np.uint64(self.shards)).astype(np.int64)

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Word numbers of sorted distinct hashes, in their order; -1 for words not in training."""
        out = np.full(len(hashes), -1)
        for r, at in by_shard(self.range_of(hashes)):
            if r + 1 < len(self.base) and self.base[r + 1] > self.base[r] or r + 1 == len(self.base) and self.vocabulary > self.base[r]:
                got = sequence(self.folder, f"words-{r}", "h").find(hashes[at])
                out[at] = np.where(got >= 0, got + self.base[r], -1)
        return out

    def per_word(self, name: str, ids: np.ndarray) -> np.ndarray:
        """A stored array's value for each word number (0 for -1)."""
        out = np.zeros(len(ids), np.int64)
        known = np.flatnonzero(ids >= 0)
        for r, at in by_shard(np.searchsorted(np.array(self.base), ids[known], side="right") - 1):
            if name == "kinds" and r not in self.begun:
                continue
            at = known[at]
            a = mapped(self.folder, f"words-{r}" if name == "count" else f"kinds-{r}")[name]
            place = ids[at] - self.base[r]
            out[at] = np.where(place < len(a), a[np.minimum(place, len(a) - 1)], 0)
        return out


def _send(schema_shard: np.ndarray, arrays: list[np.ndarray], shards: int):
    order = np.argsort(schema_shard, kind="stable")
    ends = np.searchsorted(schema_shard[order], np.arange(shards + 1))
    used = [s for s in range(shards) if ends[s + 1] > ends[s]]
    blobs = [_pack(*(a[order[ends[s] : ends[s + 1]]] for a in arrays)) for s in used]
    return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(blobs, pa.binary())], names=["shard", "blob"])


def train(docs: DataFrame, text_col: str = "text", discount: float = 0.75, min_triples: int = 1) -> Model:
    """Count and build the trie from all texts of docs; a null text is an empty one, an end alone."""
    spark = C.prepare(docs.sparkSession)
    path = C.scratch_path(spark, "trie")
    if "://" in path and not path.startswith("file://"):
        raise ValueError("the trie is memory-mapped: spark.checkpoint.dir must be a folder mounted on all hosts (file:)")
    folder = path.removeprefix("file://").removeprefix("file:")
    texts = docs.select(F.col(text_col).alias("text"))
    size, n_texts = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    bits = max(0, math.ceil(math.log2(max(1, size / SHARD_BYTES))))
    shards = 1 << bits
    start = Model(folder, shards, bits, (), 0, 0, int(n_texts), discount)
    blob = "shard int, blob binary"

    def count_words(batches):
        for batch in batches:
            h, n = np.unique(tokens(batch.column(0))[0], return_counts=True)
            yield _send(start.range_of(h), [h, n.astype(np.uint32)], shards)

    def merge_words(key, part):
        h, n = (np.concatenate(a) for a in zip(*(_unpack(b, [np.uint64, np.uint32]) for b in part.column("blob").to_pylist())))
        h, which = np.unique(h, return_inverse=True)
        n = np.bincount(which, n).astype(np.int64)
        save(folder, f"words-{key[0].as_py()}", EliasFano.build(h).arrays("h") | {"count": narrow(n)})
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "words": pa.array([len(h)]), "tokens": pa.array([int(n.sum())])})

    found = texts.mapInArrow(count_words, blob).repartition(shards, "shard").groupBy("shard").applyInArrow(merge_words, "shard int, words long, tokens long").collect()
    words = {r["shard"]: (r["words"], r["tokens"]) for r in found}
    counts = [words.get(r, (0, 0)) for r in range(shards)]
    base = np.cumsum([0, *[w for w, _ in counts]]).tolist()
    model = Model(folder, shards, bits, tuple(base[:-1]), base[-1], sum(t for _, t in counts), int(n_texts), discount)
    bos, pad, span = model.vocabulary, model.vocabulary + 1, model.span

    def count_runs(batches):
        for batch in batches:
            h, size = tokens(batch.column(0))
            if not len(h):
                continue
            words, local = distinct(h)
            known = np.append(model.ids(words), [bos, pad])  # ascending, as word numbers follow hashes
            ends = np.cumsum(size)
            before = np.append(len(words), local[:-1])
            before[ends[:-1]] = len(words)
            after = np.append(local[1:], len(words) + 1)
            after[ends - 1] = len(words) + 1
            a, b, c = (x.astype(np.uint64) for x in (before, local, after))
            width = np.uint64(max(1, int(len(known) - 1).bit_length()))
            if 3 * int(width) <= 64:
                key = np.sort((((a << width) | b) << width) | c)
                new = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
                key, n = key[new], np.diff(np.append(new, len(key)))
                mask = (np.uint64(1) << width) - np.uint64(1)
                a, b, c = key >> (width * np.uint64(2)), (key >> width) & mask, key & mask
            else:
                order = np.lexsort((c, b, a))
                a, b, c = a[order], b[order], c[order]
                new = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1])))
                n = np.diff(np.append(new, len(a)))
                a, b, c = a[new], b[new], c[new]
            a, b, c = (known[x.astype(np.int64)].astype(np.uint32) for x in (a, b, c))
            yield _send(model.shard_of(a, b), [a, b, c, n.astype(np.uint32)], shards)

    def build(key, part):
        a, b, c, n = (np.concatenate(x) for x in zip(*(_unpack(p, [np.uint32] * 4) for p in part.column("blob").to_pylist())))
        pair = a.astype(np.uint64) * np.uint64(span) + b
        order = np.lexsort((c, pair))
        pair, c, n = pair[order], c[order], n[order].astype(np.int64)
        new = np.flatnonzero(np.append(True, (pair[1:] != pair[:-1]) | (c[1:] != c[:-1])))
        n = np.add.reduceat(n, new)
        pair, c = pair[new], c[new].astype(np.int64)
        first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
        place = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(pair))))
        events = np.add.reduceat(n, first)
        following = np.bincount(place, np.where(c == pad, 0, n), len(first))
        pairs = pair[first]
        a = (pairs // np.uint64(span)).astype(np.int64)
        context = np.where(a == bos, model.n_texts, model.per_word("count", np.where(a == bos, -1, a)))
        q2 = (events - discount) / context
        keep = (c != pad) & (n >= min_triples)
        q3 = (n[keep] - discount) / following[place[keep]]
        q3 = restore(quantise(q3))
        left = np.where(following > 0, 1 - np.bincount(place[keep], q3, len(first)), 1.0)
        name = f"runs-{key[0].as_py()}"
        triples = place[keep].astype(np.uint64) * np.uint64(span) + c[keep].astype(np.uint64)
        save(folder, name, EliasFano.build(pairs).arrays("pair") | EliasFano.build(triples).arrays("triple") | {"q2": quantise(q2), "left": quantise(np.maximum(left, 1e-19)), "q3": quantise(q3)})
        a, kinds = np.unique(a, return_counts=True)
        target = np.searchsorted(np.array(model.base), a, side="right") - 1
        sent = pa.Table.from_batches([_send(target, [a.astype(np.uint32), kinds.astype(np.uint32)], shards)])
        return sent.append_column("home", pa.array(np.full(len(sent), key[0].as_py(), np.int32)))

    def merge_contexts(key, part):
        r = key[0].as_py()
        a, n = (np.concatenate(x) for x in zip(*(_unpack(p, [np.uint32] * 2) for p in part.column("blob").to_pylist())))
        kinds = np.bincount(a.astype(np.int64) - model.base[r], n).astype(np.int64)
        save(folder, f"kinds-{r}", {"kinds": narrow(kinds)})
        return pa.table({"shard": pa.array([r], pa.int32())})

    counted = texts.mapInArrow(count_runs, blob).repartition(shards, "shard").groupBy("shard").applyInArrow(build, f"{blob}, home int")
    built = C.stored(counted, "contexts")
    merged = built.select("shard", "blob").repartition(shards, "shard").groupBy("shard").applyInArrow(merge_contexts, "shard int")
    begun = frozenset(r[0] for r in merged.collect())
    model = replace(model, runs=frozenset(r[0] for r in built.select("home").distinct().collect()), begun=begun)
    return model


def token_scores(model: Model, h: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """→ the model's probability of every token, its add-one probability, whether it is known."""
    words, word = distinct(h)
    numbers = model.ids(words)
    counts, kinds_of = model.per_word("count", numbers), model.per_word("kinds", numbers)
    ids = numbers[word]
    known = ids >= 0
    p1 = (counts[word] + 1) / (model.n_tokens + model.vocabulary + 1)
    starts = np.cumsum(size) - size
    bos, span = model.vocabulary, np.uint64(model.span)
    before = np.append(bos, ids[:-1])
    before[starts] = bos
    seen = before >= 0
    last = np.append(0, word[:-1])
    count = np.where(before == bos, model.n_texts, counts[last])
    kinds = np.where(before == bos, model.per_word("kinds", np.array([bos])), kinds_of[last])
    both = np.flatnonzero(seen & known)
    pair, which = distinct(before[both].astype(np.uint64) * span + ids[both].astype(np.uint64))
    shard = model.shard_of(pair // span, pair % span)
    at, q2, left = np.full(len(pair), -1), np.zeros(len(pair)), np.ones(len(pair))
    for s, own in by_shard(shard):
        if s not in model.runs:
            continue
        got = sequence(model.folder, f"runs-{s}", "pair").find(pair[own])
        hit = got >= 0
        at[own] = got
        held = mapped(model.folder, f"runs-{s}")
        q2[own[hit]] = restore(held["q2"][got[hit]])
        left[own[hit]] = restore(held["left"][got[hit]])
    place, home = np.full(len(h), -1), np.zeros(len(h), np.int64)
    p2, rest = np.zeros(len(h)), np.ones(len(h))
    place[both], home[both], p2[both], rest[both] = at[which], shard[which], q2[which], left[which]
    mass = np.where(seen & (count > 0), model.discount * kinds / np.maximum(count, 1), 1.0)
    p2 = p2 + mass * p1
    p3 = p2.copy()
    inner = np.ones(len(h), bool)
    inner[starts] = False
    i = np.flatnonzero(inner)
    i = i[place[i - 1] >= 0]
    p3[i] = rest[i - 1] * p2[i]
    i = i[known[i]]
    for s, own in by_shard(home[i - 1]):
        own = i[own]
        key, which = distinct(place[own - 1].astype(np.uint64) * span + ids[own].astype(np.uint64))
        got = sequence(model.folder, f"runs-{s}", "triple").find(key)
        held = mapped(model.folder, f"runs-{s}")["q3"]
        q3 = np.zeros(len(got))
        q3[got >= 0] = restore(held[got[got >= 0]])
        p3[own] += q3[which]
    return p3, p1, known


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) for every row; a null text is an empty one.

    Null and repeated ids are kept as they are; an empty table gives no row.
    """

    def run(batches):
        for batch in batches:
            h, size = tokens(batch.column(1))
            n = len(batch)
            owner = np.repeat(np.arange(n), size)
            p3, p1, known = token_scores(model, h, size) if n else (np.zeros(0), np.zeros(0), np.zeros(0, bool))
            total = lambda x: np.bincount(owner, x, n)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size.astype(np.int64)), pa.array(total(known).astype(np.int64)), pa.array(total(np.log10(p1))), pa.array(total(np.log10(p3)))], names=["doc_id", "n_tokens", "n_known", "base_score", "score"]
            )

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double")
