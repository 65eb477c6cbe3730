"""Best-fit packing by pattern counts from non-negative least squares.

Texts become token pieces of at most ``width`` ids. The histogram of piece
lengths has at most ``width`` bins whatever the corpus, so the driver plans on
it: patterns of one to three lengths are enumerated, repeat counts fitted to
the histogram by non-negative least squares and rounded down, and what is left
is packed best-fit decreasing, in runs of equal bins, into new sequences and
the room that patterns leave. The plan is a list of runs; each piece finds its
place by its rank among the pieces of its length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspur.llm import common as C
from larkspur.llm import kernels as K
from larkspur.llm import tokenize as T

WIDTH = 2048
GRID = 24


def patterns(present: np.ndarray, width: int, grid: int = GRID) -> list[tuple[int, ...]]:
    """Patterns of one to three present lengths that fill a sequence as far as their last length can."""
    lengths = np.sort(present[(present > 0) & (present <= width)])
    found: set[tuple[int, ...]] = set()

    def largest(most: int) -> int:
        at = int(np.searchsorted(lengths, most, side="right")) - 1
        return int(lengths[at]) if at >= 0 else 0

    seconds = lengths[np.unique(np.linspace(0, len(lengths) - 1, grid).astype(int))] if len(lengths) else lengths
    for a in lengths.tolist():
        b = largest(width - a)
        found.add(tuple(sorted((a, b), reverse=True)) if b else (a,))
        for b in seconds.tolist():
            if a + b < width:
                c = largest(width - a - b)
                found.add(tuple(sorted((a, b, c), reverse=True)) if c else tuple(sorted((a, b), reverse=True)))
    return sorted(found, reverse=True)


def nonnegative_least_squares(columns: list[tuple[int, ...]], target: np.ndarray, rounds: int = 400) -> np.ndarray:
    """x >= 0 that brings the summed patterns near target: accelerated projected gradient steps."""
    if not columns:
        return np.zeros(0)
    rows = np.array([r for col in columns for r in col])
    cols = np.repeat(np.arange(len(columns)), [len(col) for col in columns])
    weight = 1 / np.sqrt(np.maximum(target, 1.0))

    def apply(x):
        return np.bincount(rows, x[cols], len(target)) * weight

    def adjoint(y):
        return np.bincount(cols, (y * weight)[rows], len(columns))

    probe = np.ones(len(columns))
    for _ in range(20):
        probe = adjoint(apply(probe))
        probe /= np.linalg.norm(probe)
    step = 1 / (1.05 * np.linalg.norm(adjoint(apply(probe))) + 1e-12)
    goal = target * weight
    x = z = np.zeros(len(columns))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, z - step * adjoint(apply(z) - goal))
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        z = new + (before - 1) / t * (new - x)
        x = new
    return x


#: Shares of a sequence that a pattern must fill to be used; the plan of the fewest sequences is taken.
FILLS = (1.0, 0.995, 0.97, 0.0)


def plan(histogram: dict[int, int], width: int = WIDTH) -> tuple[np.ndarray, int]:
    """Runs (length, first rank, pieces, first sequence, offset) and the number of sequences.

    Piece ``first rank + i`` of its length goes into sequence ``first sequence + i``.
    """
    left = np.zeros(width + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    columns = patterns(np.flatnonzero(left[:width]), width)
    x = nonnegative_least_squares(columns, np.append(left[:width], 0).astype(float))
    return min((fill(left.copy(), columns, x, f, width) for f in FILLS), key=lambda made: made[1])


def fill(left: np.ndarray, columns: list[tuple[int, ...]], x: np.ndarray, least: float, width: int) -> tuple[np.ndarray, int]:
    """Rounded repeats of the patterns that fill at least this share, then the residuals best-fit decreasing."""
    cursor = np.zeros(width + 1, np.int64)
    runs: list[tuple[int, int, int, int, int]] = []
    sequences = 0
    room: dict[int, list[tuple[int, int]]] = {}
    spaces: list[int] = []

    def put(length: int, n: int, sequence: int, offset: int) -> None:
        runs.append((length, int(cursor[length]), n, sequence, offset))
        cursor[length] += n
        left[length] -= n

    def leave(space: int, sequence: int, n: int) -> None:
        if space > 0:
            if space not in room:
                room[space] = []
                insort(spaces, space)
            room[space].append((sequence, n))

    if left[width]:
        n = int(left[width])
        put(width, n, 0, 0)
        sequences = n
    for k in sorted(range(len(columns)), key=lambda k: (-sum(columns[k]), -x[k])):
        pattern = columns[k]
        if sum(pattern) < least * width:
            break
        n = int(min([np.floor(x[k] + 1e-9), *(left[v] // pattern.count(v) for v in pattern)]))
        if n > 0:
            offset = 0
            for length in pattern:
                put(length, n, sequences, offset)
                offset += length
            leave(width - offset, sequences, n)
            sequences += n
    for length in range(width - 1, 0, -1):
        while left[length]:
            at = bisect_left(spaces, length)
            if at < len(spaces):
                space = spaces[at]
                sequence, bins = room[space].pop()
                n = min(bins, int(left[length]))
                if bins > n:
                    room[space].append((sequence + n, bins - n))
                if not room[space]:
                    del room[space], spaces[at]
                put(length, n, sequence, width - space)
                leave(space - length, sequence, n)
                continue
            each = width // length
            n = int(left[length])
            full, rest = divmod(n, each)
            for bins, count in ((full, each), (1 if rest else 0, rest)):
                for j in range(count if bins else 0):
                    put(length, bins, sequences, j * length)
                if bins:
                    leave(width - count * length, sequences, bins)
                    sequences += bins
    return np.array(sorted(runs), np.int64).reshape(-1, 5), sequences


PIECES = "id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


def token_pieces(docs: DataFrame, id_col: str, text_col: str, vocabulary: str, end_id: int, width: int) -> DataFrame:
    """One row a piece; nth counts the pieces of its length in its part from 0."""

    def cut(batches):
        part, seen = TaskContext.get().partitionId(), np.zeros(width + 1, np.int64)
        for batch in K.runs(batches, 1):
            ids, size = T.with_end(*T.encoder(vocabulary).encode(batch.column(1)), end_id)
            pieces = -(-size // width)
            which = np.repeat(np.arange(len(size)), pieces)
            piece = K.ragged(np.zeros(len(size), np.int64), pieces)
            start = piece * width
            length = np.minimum(width, size[which] - start)
            at = (np.cumsum(size) - size)[which] + start
            data = np.ascontiguousarray(ids, "<u4")
            crc = [zlib.crc32(data[a:b]) for a, b in zip(at.tolist(), (at + length).tolist())]
            order = np.argsort(length, kind="stable")
            sorted_length = length[order]
            firsts = np.searchsorted(sorted_length, sorted_length)
            nth = np.empty(len(length), np.int64)
            nth[order] = np.arange(len(length)) - firsts
            nth += seen[length]
            seen += np.bincount(length, minlength=width + 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(which)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(piece), part, np.int32)), pa.array(nth)],
                names=["id", "piece", "start", "length", "ids_crc32", "part", "nth"],
            )

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(cut, PIECES)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end_id: int = 0, width: int = WIDTH) -> DataFrame:
    """Every document's pieces with (sequence_id, offset): one row a piece.

    Columns: doc_id, piece, start, length, ids_crc32, sequence_id, offset. A
    null text is an empty one: the end id alone. Null and repeated ids are kept
    as they are, each row by itself. An empty table gives no row.
    """
    spark = C.prepare(docs.sparkSession)
    pieces = C.stored(token_pieces(docs, id_col, text_col, vocabulary or T.vocabulary_path(), end_id, width), "pieces")
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    histogram = {int(r["length"]): int(r["n"]) for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs, _ = plan(histogram, width)
    before = F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    ranks = counts.select("part", "length", F.coalesce(before, F.lit(0)).alias("before"))
    placed = pieces.join(ranks, ["part", "length"]).select("id", "piece", "start", "length", "ids_crc32", (F.col("nth") + F.col("before")).alias("rank"))
    shared = spark.sparkContext.broadcast(runs)

    def place(batches):
        runs = shared.value
        begins = (runs[:, 0] << 44) | runs[:, 1]
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            run = runs[np.searchsorted(begins, (length << 44) | rank, side="right") - 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(run[:, 3] + rank - run[:, 1]), pa.array(run[:, 4])], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return placed.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
