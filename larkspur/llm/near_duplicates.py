"""N-gram Jaccard join and its components by a count-vector R-tree.

A text's shingle hashes are dealt into groups; its point is the vector of group
counts. Two sets overlap by at most the sum of coordinate minima, so linked
texts lie within a known L1 distance of each other.

The tree's directory works on fine groups: hashes are cut into m ranges, m
above the most differences that a link of this size allows, so that a linked
pair has all counts equal in some range. A directory entry is the rectangle
without extent of such a range; its members are the only partners in question.
Each text is first tested against the smallest member of the entries that it
shares most. Entries whose members then still lie in several components get an
R-tree over their members' count vectors (sorted leaves with bounding boxes),
which yields, over components, a spanning forest of the pairs that pass the
bound; pairs are verified on whole shingle sets, refuted ones are remembered,
and the rounds end when no untested pair passes. No link is lost: every pair is
either in one component already, or fails the bound, or has been verified.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm import common as C
from larkspur.llm import kernels as K

#: Bits of the number of groups, at least and at most.
DIM_BITS = (6, 12)
LEAF = 32
FANOUT = 8
BLOCK = 4096
ROWS = "kind int, sig long, cls long, pivot long, id long, n long, vec binary, twin long"
NAMES = [c.split()[0] for c in ROWS.split(", ")]
#: Added to the names' seed for a set's second name.
TWIN = 0x7F4A7C15


class Measure:
    """Jaccard >= num/den over k-word shingles, and what follows from it for sizes and differences."""

    def __init__(self, k: int, num: int, den: int):
        self.k, self.num, self.den = k, num, den
        self.low = [1]
        self.cut: dict[int, tuple[int, int]] = {}

    def most_apart(self, total: np.ndarray) -> np.ndarray:
        """The largest symmetric difference of a link between sets of this total size."""
        return total - 2 * -(-self.num * total // (self.num + self.den))

    def size_class(self, n: int) -> int:
        while self.low[-1] <= n:
            self.low.append(self.low[-1] * self.den**2 // self.num**2 + 1)
        return int(np.searchsorted(self.low, n, side="right")) - 1

    def schemes(self, n: int) -> list[int]:
        """Classes of the smaller set of any link of a set of this size: its own, and the one below if in reach."""
        c = self.size_class(n)
        return [c, c - 1] if c and n * self.num <= (self.low[c] - 1) * self.den else [c]

    def ranges(self, c: int) -> tuple[int, int]:
        """Ranges for pairs whose smaller set is of class c, and how many of them may be empty unseen.

        As many are spare as the smallest sets of the class leave empty by
        chance, and two deviations: a set that leaves more shows its empty
        ranges, which many sets share.
        """
        if c not in self.cut:
            most, n = (self.low[c + 1] - 1) * (self.den - self.num) // self.num, self.low[c]
            for spare in range(1, 8 * n + 64) if most else ():
                m = most + 1 + spare
                bare = math.exp(-n / m)
                if m * bare + 2 * math.sqrt(max(0.0, m * bare * (1 - (1 + n / m) * bare))) + 1 <= spare:
                    break
            self.cut[c] = (most + 1 + spare, spare) if most else (1, 0)
        return self.cut[c]


def shingles(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """→ (sorted distinct shingle hashes of all texts, set size per text). Fewer than k words: one shingle of them all."""
    offsets, data = K.utf8(column)
    text, _, _, h = K.words(offsets, data, K.SPACED)
    n = len(offsets) - 1
    size = K.counts_per_text(text, n)
    rolled = np.zeros(len(h), np.uint64)
    for j in range(k):
        m = max(0, len(h) - j)
        rolled[:m] = K.mix(rolled[:m] * np.uint64(0x9E3779B97F4A7C15) + h[j:] + np.uint64(j))
    ends = np.cumsum(size)
    short = (size > 0) & (size < k)
    made = np.where(short, 1, np.maximum(size - k + 1, 0))
    stops = np.cumsum(made)
    whole = np.flatnonzero(np.arange(len(h)) + k <= ends[text]) if len(h) else np.zeros(0, np.int64)
    out = np.empty(int(stops[-1]) if n else 0, np.uint64)
    out[np.arange(len(whole)) + (np.cumsum(short) - short)[text[whole]]] = rolled[whole]
    for i in np.flatnonzero(short).tolist():
        value = np.uint64(int(size[i]) * 0x1000193)
        for w in h[ends[i] - size[i] : ends[i]]:
            value = K.mix(np.array([value ^ w]) * np.uint64(0x9E3779B97F4A7C15))[0]
        out[stops[i] - 1] = value
    for a, b in zip((stops - made).tolist(), stops.tolist()):
        out[a:b].sort()
    owner = np.repeat(np.arange(n), made)
    if len(out):
        new = np.append(True, (out[1:] != out[:-1]) | (owner[1:] != owner[:-1]))
        out, owner = out[new], owner[new]
    return out, K.counts_per_text(owner, n)


def set_names(h: np.ndarray, size: np.ndarray, seed: int = 0) -> np.ndarray:
    """One hash a set, by the seed: 0 for an empty one."""
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(K.mix((h + np.uint64(seed)) * np.uint64(0xC2B2AE3D27D4EB4F)), out=total[1:])
    ends = np.cumsum(size)
    return np.where(size > 0, K.mix((total[ends] - total[ends - size]) ^ (size.astype(np.uint64) << np.uint64(3))) | np.uint64(1), np.uint64(0)).view(np.int64)


def count_vectors(h: np.ndarray, size: np.ndarray) -> list[bytes]:
    """Each set's counts (255 at most) over about as many groups as it has shingles, a power of two."""
    bits = np.clip(np.ceil(np.log2(np.maximum(size, 1))), *DIM_BITS).astype(np.int64)
    base = np.concatenate([[0], np.cumsum(1 << bits)])
    owner = np.repeat(np.arange(len(size)), size)
    group = (K.mix(h) >> (64 - bits[owner]).astype(np.uint64)).astype(np.int64)
    counts = np.minimum(np.bincount(base[owner] + group, minlength=base[-1]), 255).astype(np.uint8).tobytes()
    packer = zstandard.ZstdCompressor(level=1)
    return [packer.compress(counts[a:b]) for a, b in zip(base[:-1].tolist(), base[1:].tolist())]


def folded(vectors: list[bytes]) -> np.ndarray:
    """Count vectors as rows of one length: neighbouring groups are merged down to the coarsest."""
    unpacker = zstandard.ZstdDecompressor()
    vectors = [unpacker.decompress(v) for v in vectors]
    dims = min(map(len, vectors), default=0)
    out = np.empty((len(vectors), dims), np.uint8)
    for i, v in enumerate(vectors):
        row = np.frombuffer(v, np.uint8)
        out[i] = row if len(row) == dims else np.minimum(row.reshape(dims, -1).sum(axis=1), 255)
    return out


def directory(docs: DataFrame, measure: Measure, id_col: str, text_col: str, seed: int) -> DataFrame:
    """Stored rows of two kinds: 0 a text (cls and twin name its set, pivot its text), 1 a member of an entry that several sets share."""
    spark = C.prepare(docs.sparkSession)

    def sign(batches):
        for batch in K.runs(batches, 1):
            h, size = shingles(batch.column(1), measure.k)
            names, twins, vec = set_names(h, size, seed), set_names(h, size, seed + TWIN), count_vectors(h, size)
            ids = batch.column(0).to_pylist()
            n = len(ids)
            ends = np.cumsum(size)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(n, np.int32)), pa.array(K.mix(np.arange(n).astype(np.uint64) ^ names.view(np.uint64)).view(np.int64)), pa.array(names), batch.column(2), pa.array(ids, pa.int64()), pa.array(size.astype(np.int64)), pa.array(vec, pa.binary()), pa.array(twins)],
                names=NAMES,
            )
            total = np.zeros(len(h) + 1, np.uint64)
            np.cumsum(K.mix(h + np.uint64(0x632BE59BD9B4E019)), out=total[1:])
            _, firsts = np.unique(names, return_index=True)
            sigs, owners = [], []
            for i in firsts.tolist():
                if not size[i]:
                    continue
                a, b = int(ends[i] - size[i]), int(ends[i])
                for scheme in measure.schemes(int(size[i])):
                    m, spare = measure.ranges(scheme)
                    if m < 2:
                        continue
                    bounds = (np.arange(1, m, dtype=np.float64) * (2.0**64 / m)).astype(np.uint64)
                    at = np.concatenate([[a], a + np.searchsorted(h[a:b], bounds), [b]])
                    value = total[at[1:]] - total[at[:-1]]
                    key = K.mix(value + K.mix(np.arange(m).astype(np.uint64) + np.uint64(scheme << 32)))
                    filled = at[1:] > at[:-1]
                    if m - int(filled.sum()) <= spare:
                        key = key[filled]
                    sigs.append(key)
                    owners.append(np.full(len(key), names[i]))
            if sigs:
                # 48 bits: a chance meeting only adds a member to an entry
                sig, own = (np.concatenate(sigs) >> np.uint64(16)).view(np.int64), np.concatenate(owners)
                k = len(sig)
                none = pa.nulls(k, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(k, np.int32)), pa.array(sig), pa.array(own), none, none, none, pa.nulls(k, pa.binary()), none], names=NAMES)

    def members(batches):
        held = (None, None)  # the entry and set that the batch before ended with
        pivot_of = (None, None)
        open_ = False
        for batch in batches:
            kind = batch.column(0).to_numpy()
            texts = batch.filter(pa.array(kind == 0))
            if len(texts):
                yield texts
            rest = batch.filter(pa.array(kind == 1))
            if not len(rest):
                continue
            sig, cls = rest.column(1).to_numpy(), rest.column(2).to_numpy()
            fresh = np.append((sig[0], cls[0]) != held, (sig[1:] != sig[:-1]) | (cls[1:] != cls[:-1]))
            sig, cls = sig[fresh], cls[fresh]
            if not len(sig):
                continue
            head = np.append(sig[0] != pivot_of[0], sig[1:] != sig[:-1])
            run = np.cumsum(head)
            pivots = np.append(pivot_of[1] if pivot_of[1] is not None else 0, cls[head])[run]
            out_sig, out_cls, out_pivot = [sig[~head]], [cls[~head]], [pivots[~head]]
            size = np.bincount(run)
            firsts = head & (size[run] > 1)
            if run[0] == 0 and not open_:
                out_sig.append(sig[:1]), out_cls.append(np.array([pivot_of[1]])), out_pivot.append(np.array([pivot_of[1]]))
            out_sig.append(sig[firsts]), out_cls.append(cls[firsts]), out_pivot.append(cls[firsts])
            last_run_seen = not head[-1] if run[-1] == 0 else size[run[-1]] > 1
            open_ = bool(last_run_seen) if run[-1] else True
            held, pivot_of = (sig[-1], cls[-1]), (sig[-1], pivots[-1])
            s, c, p = map(np.concatenate, (out_sig, out_cls, out_pivot))
            k = len(s)
            if k:
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(k, np.int32)), pa.array(s), pa.array(c), pa.array(p), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.int64())], names=NAMES)

    chosen = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("mark"))
    dealt = chosen.mapInArrow(sign, ROWS).repartition(C.parallelism(spark), "sig").sortWithinPartitions("sig", "cls")
    return C.stored(dealt.mapInArrow(members, ROWS), "directory")


def passes(measure: Measure, pairs: DataFrame, points: DataFrame) -> DataFrame:
    """The pairs (a, b) whose summed coordinate minima allow a link."""
    left = points.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("vec").alias("va"))
    right = points.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("vec").alias("vb"))

    def bound(batches):
        for batch in batches:
            if not len(batch):
                continue
            total = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            both = (folded([a, b]).astype(np.int64) for a, b in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist()))
            apart = np.array([v.sum() - 2 * np.minimum(v[0], v[1]).sum() for v in both])
            keep = apart <= measure.most_apart(total)
            yield batch.select([0, 1]).filter(pa.array(keep))

    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "va", "vb")
    return joined.mapInArrow(bound, "a long, b long")


def verify(measure: Measure, pairs: DataFrame, reps: DataFrame, docs: DataFrame, id_col: str, text_col: str, seed: int) -> DataFrame:
    """(a, b, linked) for stored pairs, each of them, on the whole shingle sets (64 bits a shingle) of one text of each."""
    wanted = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct().join(reps.select("cls", "rep"), "cls")
    wanted = C.stored(wanted, "wanted")
    if wanted.count() <= 500_000:  # 16 bytes each
        wanted = F.broadcast(wanted)
    key = F.coalesce(F.col(id_col).cast("long"), F.xxhash64(text_col))  # a row without an id goes by its text
    texts = docs.select(key.alias("rep"), F.col(text_col).alias("text")).join(wanted, "rep").select("cls", "text")

    def sets(batches):
        for batch in K.runs(batches, 1):
            h, size = shingles(batch.column(1), measure.k)
            right = set_names(h, size, seed) == batch.column(0).to_numpy()
            ends = np.cumsum(size)
            rows = np.flatnonzero(right).tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(right)), pa.array(size[right].astype(np.int64)), pa.array([h[ends[i] - size[i] : ends[i]].tobytes() for i in rows], pa.binary())], names=["cls", "n", "items"])

    kept = C.stored(texts.mapInArrow(sets, "cls long, n long, items binary").dropDuplicates(["cls"]), "sets", compression="uncompressed")
    left = kept.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("items").alias("sa"))
    right = kept.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("items").alias("sb"))

    def exact(batches):
        for batch in batches:
            linked = []
            for na, nb, sa, sb in zip(*(batch.column(c).to_pylist() for c in (2, 3, 4, 5))):
                both = np.concatenate([np.frombuffer(sa, np.uint64), np.frombuffer(sb, np.uint64)])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                linked.append(common * (measure.num + measure.den) >= measure.num * (na + nb))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "sa", "sb")
    tested = C.stored(joined.mapInArrow(exact, "a long, b long, linked boolean"), "verified")
    if tested.count() != pairs.count():
        raise RuntimeError("a pair's texts were not found again: the input changes from read to read")
    return tested


class RTree:
    """Count vectors in leaves of LEAF points under levels of FANOUT boxes a node, bulk-loaded by sort-tile-recursive.

    A box is the least and largest count of each group and the least and
    largest set size below it. A point's coordinate minima with a box sum to no
    less than with any point inside, so that a box whose bound allows no link
    is left out with all below it.
    """

    def __init__(self, n: np.ndarray, points: np.ndarray):
        spread = np.argsort(-points.astype(np.float64).var(axis=0))[:2] if len(points) else [0, 0]
        tiles = max(1, round((len(n) / LEAF) ** (1 / 3)))
        tile = np.zeros(len(n), np.int64)
        for values in (n, points[:, spread[0]], points[:, spread[1]]):
            order = np.lexsort((values, tile))
            first = np.searchsorted(tile[order], tile[order])
            size = np.bincount(tile)[tile[order]]
            tile[order] = tile[order] * tiles + (np.arange(len(n)) - first) * tiles // size
        self.order = np.argsort(tile, kind="stable")
        self.n, self.points = n[self.order], points[self.order].astype(np.int16)
        self.levels = []  # from the leaves up: least and largest counts, least and largest sizes
        at = np.arange(0, len(n), LEAF)
        level = (np.minimum.reduceat(self.points, at), np.maximum.reduceat(self.points, at), np.minimum.reduceat(self.n, at), np.maximum.reduceat(self.n, at))
        self.levels.append(level)
        while len(level[0]) > FANOUT:
            at = np.arange(0, len(level[0]), FANOUT)
            level = tuple(f.reduceat(x, at) for f, x in zip((np.minimum, np.maximum, np.minimum, np.maximum), level))
            self.levels.append(level)

    def within(self, measure: Measure, n: int, point: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Members that the bound lets be linked with the point, and their L1 distances."""
        nodes = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            low, high, bottom, top = (x[nodes] for x in self.levels[depth])
            gap = (np.maximum(low - point, 0) + np.maximum(point - high, 0)).sum(axis=1, dtype=np.int64)
            sized = (bottom * measure.num <= n * measure.den) & (n * measure.num <= top * measure.den)
            nodes = nodes[sized & (gap <= measure.most_apart(top + n))]
            if not len(nodes):
                return nodes, nodes
            width, count = (FANOUT, len(self.levels[depth - 1][0])) if depth else (LEAF, len(self.n))
            nodes = K.ragged(nodes * width, np.minimum(width, count - nodes * width))
        apart = np.abs(self.points[nodes] - point).sum(axis=1, dtype=np.int64)
        keep = apart <= measure.most_apart(self.n[nodes] + n)
        return self.order[nodes[keep]], apart[keep]


def near_pairs(measure: Measure, n: np.ndarray, points: np.ndarray, asks: np.ndarray):
    """(asking row, other row, L1 distance) of one block's pairs that pass the bound; a block of one leaf needs no tree above it."""
    held, asking = np.flatnonzero(~asks), np.flatnonzero(asks)
    if len(held) > LEAF:
        tree = RTree(n[held], points[held])
        for i in asking.tolist():
            near, apart = tree.within(measure, int(n[i]), points[i].astype(np.int16))
            yield np.full(len(near), i), held[near], apart
    elif len(held):
        wide = points.astype(np.int16)
        step = max(1, (1 << 22) // max(1, len(held) * points.shape[1]))
        for lo in range(0, len(asking), step):
            some = asking[lo : lo + step]
            apart = np.abs(wide[some][:, None] - wide[held][None]).sum(axis=2, dtype=np.int64)
            x, y = np.nonzero(apart <= measure.most_apart(n[some][:, None] + n[held][None]))
            yield some[x], held[y], apart[x, y]


def candidates(measure: Measure, members: DataFrame, refuted: DataFrame, every: bool) -> DataFrame:
    """Per entry (block) the pairs across components that pass the bound, all or a spanning forest of them, less refuted ones."""
    spark = C.prepare(members.sparkSession)
    names = ["sig", "held", "asked", "cls", "label", "n", "asks", "vec"]

    def chosen(block: pa.Table) -> list[tuple[int, int]]:
        cls, label, n = (block.column(c).to_numpy() for c in ("cls", "label", "n"))
        found = []
        for x, y, apart in near_pairs(measure, n, folded(block.column("vec").to_pylist()), block.column("asks").to_numpy()):
            other = label[x] != label[y]
            x, y = x[other], y[other]
            low, high = np.minimum(cls[x], cls[y]), np.maximum(cls[x], cls[y])
            found += zip((apart[other] / (n[x] + n[y])).tolist(), low.tolist(), high.tolist(), label[x].tolist(), label[y].tolist())
        if every:
            return [f[1:3] for f in found]
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        pairs = []
        for _, a, b, la, lb in sorted(found):
            if (ra := root(la)) != (rb := root(lb)):
                parent[ra] = rb
                pairs.append((a, b))
        return pairs

    def search(batches):
        """Rows come sorted by block; the last block of a batch may go on in the next."""
        kept: list[pa.RecordBatch] = []
        block_of = None

        def ended():
            pairs = chosen(pa.Table.from_batches(kept))
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["a", "b"])

        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("sig", "held", "asked")], axis=1)
            starts = np.append(0, np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1) if len(keys) else []
            for at, to in zip(starts, [*starts[1:], len(keys)]):
                if kept and tuple(keys[at]) != block_of:
                    yield ended()
                    kept.clear()
                kept.append(batch.slice(at, to - at))
                block_of = tuple(keys[at])
        if kept:
            yield ended()

    dealt = members.select(*names).repartition(C.parallelism(spark), "sig", "held", "asked").sortWithinPartitions("sig", "held", "asked")
    return dealt.mapInArrow(search, "a long, b long").distinct().join(refuted, ["a", "b"], "left_anti")


def blocks(members: DataFrame) -> DataFrame:
    """Deal each entry's members into blocks of bounded size: those outside its main component ask every block."""
    by_label = members.groupBy("sig", "label").agg(F.count("*").alias("k"))
    main = by_label.groupBy("sig").agg(F.max_by("label", F.struct("k", "label")).alias("main"), F.sum("k").alias("k"), F.max("k").alias("most"))
    rows = members.join(main.where(F.col("k") > F.col("most")), "sig")
    tiles = F.ceil(F.col("k") / BLOCK).cast("int")
    askers = F.ceil((F.col("k") - F.col("most")) / BLOCK).cast("int")
    held = rows.select("sig", "cls", "label", F.pmod(F.xxhash64("cls"), tiles).cast("int").alias("held"), F.explode(F.sequence(F.lit(0), askers - 1)).alias("asked"), F.lit(False).alias("asks"))
    asking = rows.where(F.col("label") != F.col("main"))
    asking = asking.select("sig", "cls", "label", F.explode(F.sequence(F.lit(0), tiles - 1)).alias("held"), F.pmod(F.xxhash64("cls", F.lit(1)), askers).cast("int").alias("asked"), F.lit(True).alias("asks"))
    return held.union(asking)


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, num: int = 90, den: int = 100, seed: int = 0) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs.

    A null or wordless text has an empty set, is linked with nothing and is its
    own component. Rows that share a doc_id are one node only through their
    texts. A row with a null doc_id takes part in its component under the
    smallest id there, null if there is none. An empty table gives no row.
    Other columns of docs are not read, whatever their names. Sets go by a
    63-bit name; if two different sets meet in one (their second names tell),
    the work is done again with other names.
    """
    measure = Measure(k, num, den)
    rows = directory(docs, measure, id_col, text_col, seed)
    texts = rows.where("kind = 0").select("id", "n", "cls")
    reps = rows.where("kind = 0 and n > 0").groupBy("cls").agg(F.coalesce(F.min("id"), F.min("pivot")).alias("rep"), F.max("n").alias("n"), F.first("vec").alias("vec"), (F.min("twin") != F.max("twin")).alias("mixed"))
    reps = C.stored(reps, "sets")
    if reps.where("mixed").limit(1).count():
        return components(docs, id_col, text_col, k, num, den, seed + 1)
    members = rows.where("kind = 1").select("sig", "cls", "pivot")
    shared = members.where("cls <> pivot").groupBy("cls", "pivot").agg(F.count("*").alias("k"))
    star = shared.groupBy("cls").agg(F.max_by("pivot", F.struct("k", "pivot")).alias("pivot")).select(F.least("cls", "pivot").alias("a"), F.greatest("cls", "pivot").alias("b")).distinct()
    pairs = C.stored(passes(measure, star, reps), "pairs")
    members = members.select("sig", "cls")
    spark = docs.sparkSession
    links = refuted = spark.createDataFrame([], "a long, b long")
    # The star's pairs and spanning forests link most of what is linked by few pairs; the last step tests every pair that still lies across components.
    step = "star"
    while True:
        tested = verify(measure, pairs, reps, docs, id_col, text_col, seed)
        links = C.stored(links.union(tested.where("linked").select("a", "b")), "links")
        labels = C.stored(C.connected_components(links), "labels")
        if step == "all":
            break
        refuted = C.stored(refuted.union(tested.where("not linked").select("a", "b")), "refuted")
        named = members.join(labels.withColumnRenamed("node", "cls"), "cls", "left").select("sig", "cls", F.coalesce("component", "cls").alias("label"))
        split = named.groupBy("sig").agg(F.count("*").alias("k"), F.bit_xor(F.xxhash64("cls")).alias("who"), F.bit_xor(F.xxhash64("cls", F.lit(1))).alias("whose"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi")
        once = split.groupBy("k", "who", "whose").agg(F.min("sig").alias("sig")).select("sig")  # entries with the same members need one tree
        named = C.stored(named.join(once, "sig"), "open")
        members = named.select("sig", "cls")  # an entry within one component stays so
        pairs = C.stored(candidates(measure, blocks(named).join(reps.select("cls", "n", "vec"), "cls"), refuted, step == "forest"), "pairs")
        step = "all" if step == "forest" else "forest"
    named = texts.join(labels.select(F.col("node").alias("cls"), "component"), "cls", "left").select("id", "n", F.coalesce("component", "cls").alias("label"))
    smallest = C.stored(named.where("n > 0").groupBy("label").agg(F.min("id").alias("smallest")), "smallest")  # stored, so that a large component's rows can be split over tasks
    return named.join(smallest, "label", "left").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("smallest")).otherwise(F.col("id")).alias("component_id"))
