"""Cosine similarity: a JVM expression, an Arrow function for large scans, and top-k of many queries by matrix products."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspur import errors as E

ZERO = 0.0

#: Scores of rows with queries that are held at once.
TILE = 1 << 22
#: Norms of which neither squares nor products overflow or vanish.
LEAST, MOST = 1e-140, 1e140


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def rounded(x: Column, digits: int) -> Column:
    """Half away from zero of the product in binary, as C and SQL engines round doubles: a zero keeps its sign, which F.round drops."""
    scaled = F.abs(x) * F.lit(10.0**digits)
    near = F.rint(scaled)  # half to even
    value = F.signum(x) * F.when(scaled - near == 0.5, near + 1).otherwise(near) / F.lit(10.0**digits)
    return F.when(F.abs(value) < F.lit(float("inf")), value).otherwise(x)


def literal(vector: list[float]) -> Column:
    return F.lit([float(x) for x in vector]).cast("array<double>")


def cosine(a: Column, b: Column, strict: bool = True) -> Column:
    """0 if a norm is 0; unequal lengths raise (strict) or give null."""
    na, nb = norm(a), norm(b)
    value = F.when((na == 0) | (nb == 0), F.lit(0.0)).otherwise(dot(a, b) / (na * nb))
    other = F.raise_error(F.lit(f"vectors differ in length [{E.DIMENSIONS}]")).cast("double") if strict else F.lit(None).cast("double")
    return F.when(F.size(a) == F.size(b), value).otherwise(other)


def cosine_to(query: list[float], vector: Column) -> Column:
    """Cosine to one query whose norm is computed once, on the driver."""
    length = math.sqrt(sum(x * x for x in query))
    if length == 0:
        return F.lit(0.0)
    na = norm(vector)
    return F.when(na == 0, F.lit(0.0)).otherwise(dot(vector, literal(query)) / (na * F.lit(length)))


def cosine_arrow(query: list[float]):
    """The same by NumPy over Arrow batches."""
    q = np.asarray(query, np.float64)
    nq = float(np.sqrt(q @ q))

    @F.pandas_udf("double")
    def score(vectors: pd.Series) -> pd.Series:
        if not len(vectors) or nq == 0:
            return pd.Series(np.zeros(len(vectors)))
        m = np.stack(vectors.to_numpy()).astype(np.float64)
        n = np.sqrt((m * m).sum(axis=1))
        return pd.Series(np.divide(m @ q, n * nq, out=np.zeros(len(m)), where=n > 0))

    return score


class Points:
    """Vectors of one length in double precision, by component, with norms summed in order as the JVM expression sums them."""

    def __init__(self, lists: pa.Array, dim: int):
        flat = lists.flatten()
        values = flat.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False).reshape(len(lists), dim)
        self.by_component = np.ascontiguousarray(values.T)
        self.null = flat.is_null().to_numpy(zero_copy_only=False).reshape(len(lists), dim).any(axis=1)
        total = np.zeros(len(lists))
        for x in self.by_component:
            total += x * x
        self.norm = np.where(self.null, np.nan, np.sqrt(total))
        self.odd = ~((self.norm == 0) | (self.norm > LEAST) & (self.norm < MOST))
        self.unit = np.divide(values, self.norm[:, None], out=np.zeros_like(values), where=(~self.odd & (self.norm > 0))[:, None])

    def __len__(self) -> int:
        return len(self.norm)


def cosines(a: Points, b: Points, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores of the pairs (i, j) to the last bit of the JVM expression, and which of them are null."""
    total = np.zeros(np.broadcast_shapes(i.shape, j.shape))
    for x, y in zip(a.by_component, b.by_component):
        total += x[i] * y[j]
    zero = (a.norm[i] == 0) | (b.norm[j] == 0)
    return np.where(zero, ZERO, total / (a.norm[i] * b.norm[j])), (a.null[i] | b.null[j]) & ~zero


def nearest(rows: Points, queries: Points, k: int, group: np.ndarray, order: np.ndarray, own_row: np.ndarray, own_query: np.ndarray):
    """Yields (query, row, score, null): each query's k best groups of rows by their best row; ties to the smaller order of the group.

    A matrix product finds the rows that can be among them: those within its
    rounding error of the k-th best. Only these are scored in the JVM
    expression's order. As in Spark, NaN is the largest score and null the
    last. A row and a query with the same own number, 0 or more, don't meet.
    """
    by_group = np.argsort(group, kind="stable")
    starts = np.flatnonzero(np.append(True, np.diff(group[by_group]) != 0))
    single = len(starts) == len(rows)
    slack = (len(rows.by_component) + 16) * 2.0**-49
    odd_rows, every = np.flatnonzero(rows.odd), np.arange(len(rows))
    row_of = np.argsort(own_row, kind="stable")
    step = max(1, TILE // len(rows))
    for start in range(0, len(queries), step):
        asked = np.arange(start, min(start + step, len(queries)))
        near = queries.unit[asked] @ rows.unit.T
        for q, r in ((asked, odd_rows), (asked[queries.odd[asked]], every)):
            if len(q) and len(r):
                value, null = cosines(queries, rows, q[:, None], r[None])
                near[np.ix_(q - start, r)] = np.where(null, -np.inf, np.where(np.isnan(value), np.inf, value))
        first, last = (np.searchsorted(own_row[row_of], own_query[asked], side) for side in ("left", "right"))
        last = np.where(own_query[asked] < 0, first, last)
        own = np.repeat(np.arange(len(asked)), last - first), row_of[np.repeat(first - np.cumsum(np.append(0, last - first))[:-1], last - first) + np.arange((last - first).sum())]
        near[own] = -np.inf
        best = near if single else np.maximum.reduceat(near[:, by_group], starts, axis=1)
        edge = np.partition(best, len(starts) - k, axis=1)[:, len(starts) - k] if k < len(starts) else np.full(len(asked), -np.inf)
        hit = near >= (edge - slack)[:, None]
        hit[own] = False
        q, r = np.nonzero(hit)
        value, null = cosines(queries, rows, asked[q], r)
        kind = np.where(null, 2, np.where(np.isnan(value), 0, 1))
        down = -np.where(kind == 1, value, 0.0)
        if not single:  # the best row of each group
            at = np.lexsort((down, kind, group[r], q))
            at = at[(np.diff(q[at], prepend=-1) != 0) | (np.diff(group[r[at]], prepend=-1) != 0)]
            q, r, value, null, kind, down = (x[at] for x in (q, r, value, null, kind, down))
        at = np.lexsort((order[r], down, kind, q))
        place = np.arange(len(at)) - np.searchsorted(q[at], q[at])
        at = at[place < k]
        yield asked[q[at]], r[at], value[at], null[at]
