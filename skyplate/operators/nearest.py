"""Nearest partners within a radius, without a row for any pair.

Rows are dealt by a hash of `by` into buckets of many small groups or a large one; in a bucket the pairs of a group are
measured by numpy, BLOCK at a time. Memory is that of a bucket's rows and a block. A group's pairs are all measured: the
work is quadratic in its size, at some 20 ns a pair.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyplate.session import tasks

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the package

#: Pairs measured at once, and buckets.
BLOCK, BUCKETS = 1 << 20, 1024


def _codes(*columns: pa.ChunkedArray) -> list[np.ndarray]:
    """Whole numbers, equal where the values of the columns are; null is a value."""
    whole = pa.chunked_array([c for column in columns for c in column.chunks], type=columns[0].type).combine_chunks()
    codes = whole.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return np.split(codes, np.cumsum([len(c) for c in columns])[:-1])


def _place(table: pa.Table, names: tuple[str, str]) -> list[np.ndarray]:
    return [np.asarray(table[n].to_numpy(), dtype=float) for n in names]


class Side:
    """One side's rows in the order in which equally near ones win: by group, then its keys' text from the last on, and where a key repeats by place."""

    def __init__(self, table: pa.Table, group: np.ndarray, key: str, xy: tuple[str, str], text: str):
        by = pc.sort_indices(pa.table({"g": group, "t": table[text].combine_chunks(), "x": table[xy[0]], "y": table[xy[1]]}), sort_keys=[("g", "ascending"), ("t", "descending"), ("x", "ascending"), ("y", "ascending")]).to_numpy()
        self.table, self.group = table.take(pa.array(by)), group[by]
        self.x, self.y = _place(self.table, xy)
        n = len(by)
        self.key = np.unique(self.group * (n + 1) + _codes(self.table[key])[0], return_inverse=True)[1] if n else np.zeros(0, dtype=np.int64)


def _best(a: Side, b: Side, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each key of a one of its rows, the nearest row of b within the radius, and their distance."""
    starts, ends = np.searchsorted(b.group, a.group), np.searchsorted(b.group, a.group, side="right")
    rows = np.flatnonzero(ends > starts)
    sizes = (ends - starts)[rows]
    total, found, at = np.cumsum(sizes), [], 0
    while at < len(rows):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + BLOCK, side="right")))
        own, n = rows[at:to], sizes[at:to]
        first = np.cumsum(n) - n
        left = np.repeat(own, n)
        right = np.arange(len(left)) - np.repeat(first - starts[own], n)
        dx, dy = a.x[left] - b.x[right], a.y[left] - b.y[right]
        d = np.sqrt(dx * dx + dy * dy)
        d[np.isnan(d)] = np.inf
        least = np.minimum.reduceat(d, first)
        hits = np.flatnonzero(d == np.repeat(least, n))
        win = right[hits[np.searchsorted(hits, first)]]
        near = least <= radius
        found.append((own[near], win[near], least[near]))
        at = to
    if not found:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
    i, j, d = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((j, d, a.key[i]))  # of a key's several rows the one with the nearest
    keep = order[np.unique(a.key[i][order], return_index=True)[1]]
    return i[keep], j[keep], d[keep]


def nearest_within(left: DataFrame, right: DataFrame, by: list[str], key: str, other: str, radius: float, left_xy: tuple[str, str], right_xy: tuple[str, str], mutual: bool = False) -> DataFrame:
    """The pairs that `match.nearest` takes from those of `match.within`, or with `mutual` those that `match.mutual_nearest` does: by, the columns of both sides, dist."""
    n = tasks(left)
    rest = [c for c in right.columns if c not in by]
    own = list(left.columns)
    names = [*own, *rest, "dist"]
    types = {f.name: f.dataType.simpleString() for df in (right, left) for f in df.schema} | {"dist": "double"}
    sides = []
    for df, k in ((left, key), (right, other)):
        df = df.select(*(F.col(c).alias(c) for c in df.columns))  # a side of its own, if both come from one table
        df = df.na.drop(subset=by).withColumns({"_b": F.pmod(F.xxhash64(*by), F.lit(BUCKETS)).cast("int"), "_t": F.col(k).cast("string")})
        sides.append(df.repartition(n, "_b").groupBy("_b"))

    def of_bucket(one: pa.Table, two: pa.Table) -> pa.Table:
        groups = [np.zeros(one.num_rows, dtype=np.int64), np.zeros(two.num_rows, dtype=np.int64)]
        for c in by:
            codes = _codes(one[c], two[c])
            groups = [g * (one.num_rows + two.num_rows + 1) + x for g, x in zip(groups, codes, strict=True)]
        a, b = Side(one, groups[0], key, left_xy, "_t"), Side(two, groups[1], other, right_xy, "_t")
        i, j, d = _best(a, b, radius)
        if mutual:
            q, p, _ = _best(b, a, radius)
            keep = np.isin(a.key[i] * (two.num_rows + 1) + b.key[j], a.key[p] * (two.num_rows + 1) + b.key[q])
            i, j, d = i[keep], j[keep], d[keep]
        mine, theirs = a.table.take(pa.array(i)), b.table.take(pa.array(j))
        return pa.table([*(mine[c] for c in own), *(theirs[c] for c in rest), pa.array(d)], names=names)

    schema = ", ".join(f"`{c}` {types[c]}" for c in names)
    return sides[0].cogroup(sides[1]).applyInArrow(of_bucket, schema)
