"""Pairwise co-moments of many columns in one scan.

Every partition keeps, for each pair of column groups, the co-moment matrices of its
rows under pairwise null masks; the matrices of all partitions are merged by the
parallel-moments formula, two levels deep, as streams.  Sums are taken about the
means of the rows at hand, so a large common offset costs no digits.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# the functions below run in Python workers, which need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Columns of one group, and streams that merge the partitions' matrices first.
GROUP, STREAMS = 32, 64
#: Matrices of a pair of groups: rows, means, centred squares and products, rows with NaN or infinity.
PARTS = ("n", "mx", "my", "sxx", "syy", "sxy", "bad")


def _moments(x: np.ndarray, y: np.ndarray, px: np.ndarray, py: np.ndarray) -> np.ndarray:
    """The PARTS matrices of columns x against columns y; px, py: which are not null."""
    fx, fy = px & np.isfinite(x), py & np.isfinite(y)
    mean = lambda v, f: np.where(f, v, 0).sum(0) / np.maximum(f.sum(0), 1)
    cx, cy = mean(x, fx), mean(y, fy)
    zx, zy = np.where(fx, x - cx, 0.0), np.where(fy, y - cy, 0.0)
    wx, wy = fx.astype(float), fy.astype(float)
    n = wx.T @ wy
    some = np.maximum(n, 1)
    dx, dy = zx.T @ wy / some, wx.T @ zy / some
    bad = (px & ~fx).astype(float).T @ py.astype(float) + px.astype(float).T @ (py & ~fy).astype(float)
    return np.stack([n, cx[:, None] + dx, cy[None, :] + dy, (zx * zx).T @ wy - n * dx * dx,
                     wx.T @ (zy * zy) - n * dy * dy, zx.T @ zy - n * dx * dy, bad])


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Moments of the union of two sets of rows."""
    n = a[0] + b[0]
    some = np.maximum(n, 1)
    dx, dy = np.where(b[0] > 0, b[1] - a[1], 0), np.where(b[0] > 0, b[2] - a[2], 0)
    dx, dy = np.where(a[0] > 0, dx, 0), np.where(a[0] > 0, dy, 0)
    w = a[0] * b[0] / some
    mx = np.where(a[0] > 0, a[1] + dx * b[0] / some, b[1])
    my = np.where(a[0] > 0, a[2] + dy * b[0] / some, b[2])
    return np.stack([n, mx, my, a[3] + b[3] + w * dx * dx, a[4] + b[4] + w * dy * dy, a[5] + b[5] + w * dx * dy,
                     a[6] + b[6]])


def _add(state: dict, key: tuple, m: np.ndarray) -> None:
    state[key] = merge(state[key], m) if key in state else m


def _rows(state: dict) -> pa.RecordBatch:
    from pyspark import TaskContext
    stream = TaskContext.get().partitionId() % STREAMS  # fixed for a partition, also when it runs again
    return pa.RecordBatch.from_pydict({
        "by": pa.array([k[0] for k in state], pa.int32()),
        "gi": pa.array([k[1] for k in state], pa.int32()), "gj": pa.array([k[2] for k in state], pa.int32()),
        "stream": pa.array([stream] * len(state), pa.int32()),
        "m": pa.array([m.tobytes() for m in state.values()], pa.binary())})


STATE = "by int, gi int, gj int, stream int, m binary"


def comoments(df: DataFrame, columns: Sequence[str], by: str | None = None) -> DataFrame:
    """(i, j, n, mx, my, sxx, syy, sxy, bad) for every i <= j of the columns' places:
    rows where both are present, their means, centred sums of squares and products,
    and how many of them hold a NaN or an infinity (left out of the sums).  One scan;
    no rows: zeros.  ``by`` names an integer column of few values (folds, no NULLs): the
    result has one set of rows for each value that occurs, in a column ``by``."""
    groups = [range(lo, min(lo + GROUP, len(columns))) for lo in range(0, len(columns), GROUP)]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}
        for b in batches:
            key = b.column(b.num_columns - 1).to_numpy(zero_copy_only=False)
            data = b.columns[:-1]
            all_present = np.stack([~c.is_null().to_numpy(zero_copy_only=False) for c in data], axis=1)
            all_values = np.stack([c.fill_null(0.0).to_numpy(zero_copy_only=False) for c in data], axis=1)
            for one in np.unique(key).tolist():
                at = slice(None) if by is None else key == one
                present, values = all_present[at], all_values[at]
                for i, g in enumerate(groups):
                    for j, h in enumerate(groups[i:], i):
                        _add(state, (one, i, j), _moments(values[:, g[0]:g[-1] + 1], values[:, h[0]:h[-1] + 1],
                                                          present[:, g[0]:g[-1] + 1], present[:, h[0]:h[-1] + 1]))
        if state:
            yield _rows(state)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}
        for b in batches:
            for one, i, j, m in zip(*(b[c].to_pylist() for c in ("by", "gi", "gj", "m"))):
                _add(state, (one, i, j), np.frombuffer(m).reshape(len(PARTS), len(groups[i]), len(groups[j])))
        if state:
            yield _rows(state)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in merged(batches):
            for one, gi, gj, m in zip(*(b[c].to_pylist() for c in ("by", "gi", "gj", "m"))):
                g, h = groups[gi], groups[gj]
                m = np.frombuffer(m).reshape(len(PARTS), len(g), len(h))
                at = [(a, c) for a in range(len(g)) for c in range(len(h)) if g[a] <= h[c]]
                r, c = np.array(at).T
                out = {"by": pa.array([one] * len(r), pa.int32()), "i": pa.array(r + g[0], pa.int32()), "j": pa.array(c + h[0], pa.int32())}
                yield pa.RecordBatch.from_pydict(out | {p: pa.array(m[k][r, c]) for k, p in enumerate(PARTS)})

    x = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{k}") for k, c in enumerate(columns)],
                  (F.col(f"`{by}`") if by else F.lit(0)).cast("int").alias("by"))
    none = [] if by else [(0, i, j, 0, np.zeros((len(PARTS), len(groups[i]), len(groups[j]))).tobytes())
            for i in range(len(groups)) for j in range(i, len(groups))]  # without rows there are zeros still
    found = x.mapInArrow(partial, STATE).unionByName(df.sparkSession.createDataFrame(none, STATE))
    first = found.repartition("by", "gi", "gj", "stream").mapInArrow(merged, STATE)
    out = first.repartition("by", "gi", "gj").mapInArrow(
        cells, "by int, i int, j int, " + ", ".join(f"{p} double" for p in PARTS))
    return out if by else out.drop("by")


def pearson():
    """r as a column of ``comoments`` rows: NULL without variance, NaN beside NaN or infinity."""
    r = F.try_divide(F.col("sxy"), F.sqrt("sxx") * F.sqrt("syy"))
    return F.when(F.col("bad") > 0, F.lit(float("nan"))).when(F.col("n") > 0, r)
