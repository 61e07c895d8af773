"""Vectors of two tables against each other, in bounded tiles.

A table is dealt into tiles of equal size by row numbers in an order; the tiles of two tables meet in pairs, as grouped tasks. A task
holds one tile of each side, whatever the size of the tables and of any group in them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helicase.llm.common import numbered, ship

ship(__name__)

#: Score entries looked at in one NumPy step.
STEP_ENTRIES = 1 << 20


def valid(vectors: str = "embedding") -> F.Column:
    """Whether a vector is there and all its components are finite numbers."""
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.col(vectors).isNotNull() & F.forall(vectors, good)


def matrix(column: pa.Array | pa.ChunkedArray, width: int = 0) -> np.ndarray:
    """A row for each list of numbers, in double precision; shorter ones end in zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    width = max([width, *sizes])
    if len(sizes) and (sizes == width).all():
        return values.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list for each row of a matrix."""
    ends = np.arange(len(rows) + 1, dtype=np.int32) * (rows.shape[1] if rows.ndim == 2 else 0)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(rows).ravel(), kind))


def dealt(rows: DataFrame, size: int, *order: str) -> DataFrame:
    """`rows` (a written table) with `tile`: `size` rows each, neighbours in `order` together."""
    placed = numbered(rows.withColumn("all", F.lit(0)), "all", *order)
    return placed.withColumn("tile", F.expr(f"cast(idx div {size} as int)")).drop("all", "idx", "n")


def products(left: DataFrame, right: DataFrame, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """`run` over every pair of a tile of `left` and a tile of `right`."""
    n, m = ((t.agg(F.max("tile")).first()[0] or 0) + 1 for t in (left, right))
    spread = lambda t, own, other, k: t.withColumnRenamed("tile", own).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    a, b = spread(left, "left_tile", "right_tile", m), spread(right, "right_tile", "left_tile", n)
    return a.groupBy("left_tile", "right_tile").cogroup(b.groupBy("left_tile", "right_tile")).applyInArrow(run, schema)


def first(scores: np.ndarray, k: int) -> np.ndarray:
    """Mask of the k largest entries of each row; of equal ones those more to the left; never minus infinity."""
    there = scores > -np.inf
    if scores.shape[1] <= k:
        return there
    least = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
    over, same = scores > least, scores == least
    room = k - over.sum(1, keepdims=True)
    return there & (over | (same & (np.cumsum(same, 1) <= room)))


def steps(n: int, width: int) -> Iterator[slice]:
    """Ranges of n rows of so many entries."""
    size = max(1, STEP_ENTRIES // max(width, 1))
    for i in range(0, n, size):
        yield slice(i, i + size)
