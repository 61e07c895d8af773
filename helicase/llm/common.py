"""Helpers shared by the training-data operators.

Texts are handled as the UTF-8 bytes Arrow delivers: words, their 64-bit hashes
and their shingles are found with whole-array NumPy steps over slices of a batch,
so that no Python object is made for a word.
"""

from __future__ import annotations

import functools
import math
import sys
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helicase import session

#: Bytes of text looked at in one NumPy step; longer texts are a step of their own.
SLICE_BYTES = 1 << 19


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Written below the folder of spark.checkpoint.dir and read back."""
    return session.materialise(df, name)


def crc_of_id(column: str | Column) -> Column:
    return F.crc32(F.col(column).cast("string").cast("binary")) if isinstance(column, str) else F.crc32(column.cast("string").cast("binary"))


def numbered(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """`rows` (a written table) with idx, a row's number inside its (non-null) group in the given order, and n, the group's number of rows.

    One sort by range, the counts of (range, group) and running sums of those counts: no group is sorted in one task.
    Rows that agree in group and order are numbered in any way.
    """
    last = F.monotonically_increasing_id()  # equal rows may fall into several ranges
    ranges = rows.withColumn("tie", last).repartitionByRange(group, *order, "tie").sortWithinPartitions(group, *order, "tie").drop("tie")
    placed = staged(ranges.withColumn("at", F.monotonically_increasing_id()).withColumn("range", F.shiftright("at", 33)), "numbered")
    spans = placed.groupBy(group, "range").agg(F.min("at").alias("first"), F.count("*").alias("m"))
    every = Window.partitionBy(group)
    spans = spans.select(group, "range", "first", F.sum("m").over(every).alias("n"), (F.sum("m").over(every.orderBy("range")) - F.col("m")).alias("before"))
    return placed.join(spans, [group, "range"]).withColumn("idx", F.expr("before + at - first")).drop("range", "first", "before", "at")


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 (public splitmix64 constants)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@functools.lru_cache(None)
def _byte_codes() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


@functools.lru_cache(None)
def powers(n: int, base: int = 0xD1342543DE82EF95) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n - 1, 0), base, np.uint64)]))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of an Arrow column as one byte array, and where each begins (one more entry at the end); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def slices(at: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `size` bytes."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + size, "right")) - 1)
        yield i, j
        i = j


def in_parts(texts: pd.Series, run: Callable[[pa.Array], np.ndarray], rows: int = 1000) -> np.ndarray:
    """`run` over a few texts at a time, so that a batch isn't held twice; at least once, for its type."""
    return np.concatenate([run(pa.array(texts.iloc[i : i + rows], pa.string(), from_pandas=True)) for i in range(0, max(len(texts), 1), rows)])


def lowered(data: np.ndarray) -> np.ndarray:
    return data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words between white space (0x20, 0x09-0x0D) of lower-cased bytes.

    Returns the text number, first byte, length and 64-bit hash of each word.
    """
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = at[:-1][at[:-1] < at[1:]]
    begins[first] = inside[first]
    starts = np.flatnonzero(begins)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64)
    owner = np.searchsorted(at, starts, "right") - 1
    where = np.flatnonzero(inside)
    heads = np.searchsorted(where, starts)
    lengths = np.diff(np.append(heads, len(where)))
    place = np.arange(len(where)) - np.repeat(heads, lengths)
    longest = int(lengths.max())
    parts = _byte_codes()[data[where]] * powers(1 << max(6, longest.bit_length()))[place]
    return owner, starts, lengths, mix(np.add.reduceat(parts, heads) + lengths.astype(np.uint64))


def shingles(owner: np.ndarray, hashes: np.ndarray, n_texts: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of every k-word shingle; a text of fewer words gives its whole sequence as one."""
    counts = np.bincount(owner, minlength=n_texts)
    if not len(hashes):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    p = powers(k, 0x9FB21C651E98DF25)
    rolled = np.zeros(max(len(hashes) - k + 1, 0), np.uint64)
    for j in range(k):
        rolled += hashes[j : j + len(rolled)] * p[j]
    whole = owner[: len(rolled)] == owner[k - 1 :] if len(rolled) else np.zeros(0, bool)
    short = np.flatnonzero((counts > 0) & (counts < k))
    begin = np.concatenate([[0], np.cumsum(counts)])[short]
    extra = np.zeros(len(short), np.uint64)
    for j in range(k - 1):
        has = counts[short] > j
        extra[has] += hashes[begin[has] + j] * p[j]
    extra += counts[short].astype(np.uint64) * np.uint64(0xA24BAED4963EE407)
    return np.concatenate([owner[: len(rolled)][whole], short]), mix(np.concatenate([rolled[whole], extra]))


def distinct(owner: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, hash) in order, with how often each occurs."""
    order = np.lexsort((hashes, owner))
    o, h = owner[order], hashes[order]
    new = np.ones(len(o), bool)
    new[1:] = (o[1:] != o[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(new)
    return o[at], h[at], np.diff(np.append(at, len(o)))


def list_array(owner: np.ndarray, values: np.ndarray, n: int, kind: pa.DataType) -> pa.Array:
    """One Arrow list for each of n texts, from values in the order of their text."""
    ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, kind))


def ship(module: str) -> None:
    """Let executors run a module's functions without an installed copy."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


ship(__name__)


def tree_sum(rows: DataFrame, column: str, kind: str, add: Callable = np.add) -> np.ndarray | None:
    """Elementwise sum (or another `add`) of compressed arrays of NumPy type `kind`, one a row, in two steps on executors.

    Arrays have a fixed size, so what comes to the driver doesn't grow. None without rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for x in b.column(0):
                own = np.frombuffer(zlib.decompress(x.as_py()), kind)
                total = own.copy() if total is None else add(total, own)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], ["x"])

    rows = rows.select(F.col(column).alias("x")).filter("x is not null")
    some = rows.repartition(max(1, math.isqrt(rows.count()))).mapInArrow(run, "x binary")
    found = some.repartition(1).mapInArrow(run, "x binary").first()
    return None if found is None else np.frombuffer(zlib.decompress(found["x"]), kind)
