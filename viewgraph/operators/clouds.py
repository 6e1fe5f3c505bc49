"""Clouds in arrays: streams of whole groups within tasks, and exact nearest neighbours by a tree."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a group, of both clouds together, up to which one task takes it whole (some 20 MB).
WHOLE_ROWS = 200_000
_LEAF = 64


def large_groups(a: DataFrame, b: DataFrame, keys: list[str], most: int | None = None) -> list[tuple]:
    """The keys of groups too large for one task, so at most one for WHOLE_ROWS rows."""
    sizes = a.select(*keys).unionAll(b.select(*keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return [tuple(r) for r in sizes.where(F.col("n") > (WHOLE_ROWS if most is None else most)).select(*keys).collect()]


def apart(df: DataFrame, keys: list[str], large: list[tuple]) -> tuple[DataFrame, DataFrame]:
    """df without, and of, the large groups."""
    if not large:
        return df, df.limit(0)
    known = F.broadcast(df.sparkSession.createDataFrame(large, df.select(*keys).schema))
    same = [df[k].eqNullSafe(known[k]) for k in keys]
    return df.join(known, same, "left_anti"), df.join(known, same, "left_semi")


def side_by_side(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """keys, side (0: of a), idx, x, y, z: the rows of both by group, a first, each by idx, a group within one partition."""
    rows = [df.select(*keys, F.lit(i).alias("side"), "idx", *[F.col(c).cast("double").alias(c) for c in "xyz"]) for i, df in enumerate((a, b))]
    return rows[0].unionAll(rows[1]).repartition(*keys).sortWithinPartitions(*keys, "side", "idx")


def whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups, and where groups begin, with the end, of batches sorted by keys. A group without an end yet is held."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if all(held[0][k][0] == batch[k][-1] for k in map(batch.schema.get_field_index, keys)):
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        starts = _starts(t, keys)
        yield t.slice(0, starts[-1]), starts
        held = t.slice(starts[-1]).to_batches()
    if held:
        t = pa.Table.from_batches(held).combine_chunks()
        yield t, np.append(_starts(t, keys), t.num_rows)


def _starts(t: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(t.num_rows, bool)
    new[0] = True
    for k in keys:
        new[1:] |= ~same_as_before(t[k])
    return np.flatnonzero(new)


def same_as_before(c: pa.ChunkedArray) -> np.ndarray:
    """Whether each value but the first is the one before it; a null is as a null."""
    a, b = c.slice(1), c.slice(0, max(len(c) - 1, 0))
    return pc.fill_null(pc.equal(a, b), False).to_numpy() | (pc.is_null(a).to_numpy() & pc.is_null(b).to_numpy())


def numbered(t: pa.Table, starts: np.ndarray) -> np.ndarray:
    """A number for each row, the same for rows of one idx in one side of a group, of a table as side_by_side has it."""
    side = t["side"].to_numpy()
    new = np.append(True, ~same_as_before(t["idx"]) | (side[1:] != side[:-1]))
    new[starts[:-1]] = True
    return np.cumsum(new) - 1


def coordinates(t: pa.Table) -> np.ndarray:
    """(rows, 3), with NaN for null."""
    return np.column_stack([t[c].to_numpy() for c in "xyz"]).astype(float, copy=False)


def _distances(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    d = q[:, None, 0] - p[None, :, 0]
    d *= d
    for i in (1, 2):
        e = q[:, None, i] - p[None, :, i]
        e *= e
        d += e
    return np.sqrt(d, out=d)


def near(q: np.ndarray, p: np.ndarray, tree: Tree | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Which of p (not empty) is nearest to each of q, ties to the first, and how far it is."""
    with np.errstate(over="ignore"):
        if tree is not None or len(q) * len(p) > 250_000:
            return (tree or Tree(p)).near(q)
        at, d = np.empty(len(q), np.int64), np.empty(len(q))
        step = max(1, 32_768 // len(p))
        for i in range(0, len(q), step):
            every = _distances(q[i : i + step], p)
            at[i : i + step] = best = every.argmin(1)
            d[i : i + step] = every[np.arange(len(best)), best]
        return at, d


def near_both(p: np.ndarray, q: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """near(p, q) and near(q, p), of neither empty, which share their distances."""
    if len(p) * len(q) > 250_000:
        return near(p, q), near(q, p)
    with np.errstate(over="ignore"):
        at, d = np.empty(len(p), np.int64), np.empty(len(p))
        back, far = np.zeros(len(q), np.int64), np.full(len(q), np.inf)
        step, columns = max(1, 32_768 // len(q)), np.arange(len(q))
        for i in range(0, len(p), step):
            every = _distances(p[i : i + step], q)
            at[i : i + step] = best = every.argmin(1)
            d[i : i + step] = every[np.arange(len(best)), best]
            best = every.argmin(0)
            less = every[best, columns]
            better = less < far
            back[better], far[better] = best[better] + i, less[better]
        return (at, d), (back, far)


class Tree:
    """Points in boxes, halved at the median of the longest side, so dense and far-off ones cost no more than others."""

    def __init__(self, p: np.ndarray, distinct: bool = True):
        # Of points at one place the first is kept, which wins ties.
        self.first = np.sort(np.unique(p, axis=0, return_index=True)[1]) if distinct else np.arange(len(p))
        self.p = p[self.first]
        self.order = np.arange(len(self.p))
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        self.span: list[tuple[int, int]] = []
        self.kids: list[tuple[int, int] | None] = []
        self._build(0, len(self.p))

    def _build(self, start: int, end: int) -> int:
        own, at = self.order[start:end], len(self.low)
        part = self.p[own]
        low, high = part.min(0), part.max(0)
        self.low.append(low)
        self.high.append(high)
        self.span.append((start, end))
        self.kids.append(None)
        if end - start > _LEAF:
            half = (end - start) // 2
            self.order[start:end] = own[np.argpartition(part[:, (high - low).argmax()], half)]
            self.kids[at] = (self._build(start, start + half), self._build(start + half, end))
        return at

    def near(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, d = np.empty(len(q), np.int64), np.empty(len(q))
        if not len(q):
            return at, d
        asked = Tree(q, distinct=False)
        for (start, end), kids in zip(asked.span, asked.kids):
            if kids is None:
                own = asked.order[start:end]
                at[own], d[own] = self._near(q[own])
        return self.first[at], d

    def _near(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low, high, rows = q.min(0), q.max(0), np.arange(len(q))
        at, d, limit = np.full(len(q), len(self.p)), np.full(len(q), np.inf), np.inf
        todo = [(0.0, 0)]
        while todo:
            gap, node = todo.pop()
            if gap > limit:
                continue
            if (kids := self.kids[node]) is not None:
                out = [np.maximum(0, np.maximum(self.low[k] - high, low - self.high[k])) for k in kids]
                todo += sorted(((float(g @ g), k) for g, k in zip(out, kids)), reverse=True)
                continue
            own = np.sort(self.order[slice(*self.span[node])])
            every = _distances(q, self.p[own])
            best = every.argmin(1)
            far, which = every[rows, best], own[best]
            better = (far < d) | ((far == d) & (which < at))
            at[better], d[better] = which[better], far[better]
            limit = d.max() ** 2 * (1 + 1e-9)
        return at, d
