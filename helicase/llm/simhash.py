"""SimHash fingerprints and search within a Hamming radius.

The hashed terms of a text (its pairs of adjacent words) vote on 64 signed bits, each with a weight that grows with the
logarithm of its count. For a search, the bits fall into blocks; a table is kept for every choice of as many blocks as
must agree within the radius, and fingerprints that agree there are compared in full.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helicase.llm import common
from helicase.llm.common import ship, staged

ship(__name__)

TERM_WORDS = 2
#: Rows of one range of ids, read as one sorted run.
RANGE_ROWS = 5_000
MAX_RANGES = 100_000


def fingerprints(column: pa.Array) -> np.ndarray:
    """64-bit fingerprints of texts; of equal texts they are equal, of empty texts 0."""
    data, at = common.text_bytes(column)
    out = np.zeros(len(at) - 1, np.uint64)
    for i, j in common.slices(at):
        begin = at[i : j + 1] - at[i]
        owner, _, _, words = common.words(common.lowered(data[at[i] : at[j]]), begin)
        owner, terms, times = common.distinct(*common.shingles(owner, words, j - i, TERM_WORDS))
        if not len(terms):
            continue
        weight = np.rint(16 * (1 + np.log(times))).astype(np.int32)
        first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        votes = np.empty((len(first), 64), np.int64)
        bits = np.unpackbits(terms.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for k in range(64):
            votes[:, k] = np.add.reduceat(bits[:, k] * weight, first)
        yes = 2 * votes > np.add.reduceat(weight.astype(np.int64), first)[:, None]
        out[i + owner[first]] = np.packbits(yes, axis=1, bitorder="little").view("<u8").ravel()
    return out


def _hex(x: np.ndarray) -> list[str]:
    return [f"{v:016x}" for v in x.tolist()]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal bits."""
    return 1 - np.bitwise_count(a ^ b) / 64


def fingerprint_texts(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep` and `fingerprint` (16 hexadecimal digits) of every row of `docs` (column text)."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(_hex(common.in_parts(texts, fingerprints)))

    return docs.select(*keep, run("text").alias("fingerprint"))


def _ranges(ids: DataFrame) -> list[tuple[int, int]]:
    """Smallest and largest id of ranges that cover all ids, in descending order; null ids count as the smallest."""
    n = ids.count()
    parts = max(1, min(MAX_RANGES, -(-n // RANGE_ROWS)))
    rows = ids.repartitionByRange(parts, F.desc("id")).groupBy(F.spark_partition_id().alias("p")).agg(F.min("id").alias("low"), F.max("id").alias("high")).collect()
    return sorted(((r["low"], r["high"]) for r in rows), reverse=True)


def edited_pairs(docs: DataFrame) -> DataFrame:
    """For every row of `docs` (doc_id, text): its fingerprint, its edited text's, and how alike they are.

    The next row is that of the next smaller doc_id (after the smallest: the largest); rows of one doc_id stand in the order
    of their texts, a null doc_id comes last. The edited text keeps all but the last floor(n_chars/2) code points and
    goes on with the first as many of the next row's text. Null texts are empty. A single row is its own next. Other
    columns don't matter. Rows are dealt by ranges of ids and read as sorted runs; the first row of a range is sent to
    the range before it too, so that every row meets its next.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(2**63))).alias("id"), F.col("doc_id").isNull().alias("null_id"), F.coalesce("text", F.lit("")).alias("text"))
    ranges = _ranges(rows.select("id"))
    lows, highs = [a for a, _ in ranges][::-1], [b for _, b in ranges][::-1]

    @F.pandas_udf("array<int>")
    def places(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        """The row's range, counted downwards, and for the first id of a range the one before."""
        low, high, n = np.array(lows, np.int64), np.array(highs, np.int64), len(lows)
        for ids in batches:
            at = np.searchsorted(low, ids.to_numpy(), "right") - 1
            is_first = high[at] == ids.to_numpy()
            yield pd.Series([[n - 1 - a, (n - 2 - a) % n] if f else [n - 1 - a] for a, f in zip(at.tolist(), is_first.tolist())])

    dealt = rows.select("id", "null_id", "text", F.posexplode(places("id")).alias("guest", "range"))
    n = max(1, len(ranges))
    dealt = dealt.repartition(n, "range").sortWithinPartitions("range", "guest", F.desc("id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # rows whose next isn't known yet: one at most
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            ids, nulls, texts, nexts = zip(*out)
            edited = [t[: len(t) - len(t) // 2] + x[: len(t) // 2] for t, x in zip(texts, nexts)]
            own, new, nxt = (fingerprints(pa.array(v, pa.string())) for v in (texts, edited, nexts))
            columns = {
                "doc_id": pa.array([None if z else i for i, z in zip(ids, nulls)], pa.int64()), "n_chars": pa.array([len(t) for t in texts], pa.int64()),
                "edited_sha256": pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]), "fingerprint": pa.array(_hex(own)),
                "edited_fingerprint": pa.array(_hex(new)), "near_edited": pa.array(likeness(own, new)), "near_next": pa.array(likeness(own, nxt)),
            }
            out.clear()
            return pa.RecordBatch.from_pydict(columns)

        now, passed = None, False
        size = 0
        for b in batches:
            for id_, null, text, guest, place in zip(*(b.column(c).to_pylist() for c in ("id", "null_id", "text", "guest", "range"))):
                if place != now:
                    now, passed = place, False
                    held.clear()
                if passed:
                    continue
                if held:
                    i, z, t = held.pop()
                    out.append((i, z, t, text))
                    size += len(t)
                    if size > 4_000_000:
                        yield flush()
                        size = 0
                if guest:
                    passed = True
                else:
                    held.append((id_, null, text))
        if out:
            yield flush()

    return dealt.mapInArrow(run, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def within(queries: DataFrame, all_: DataFrame, radius: int) -> DataFrame:
    """Pairs (query, fingerprint, distance) of distinct fingerprints of the two tables, no further apart than `radius`.

    Tables are kept for all choices of half of 2 * radius blocks, rounded down to whole bits: differences spoil at most
    `radius` blocks, so that at least one choice agrees. Nulls match nothing.
    """
    parts = max(2 * radius, 1)
    edge = [64 * i // parts for i in range(parts + 1)]

    def keys(df: DataFrame, name: str) -> DataFrame:
        one = df.filter("fingerprint is not null").select("fingerprint").distinct()
        bits = F.conv("fingerprint", 16, 2)
        text = F.lpad(bits, 64, "0")
        block = [F.substring(text, 64 - edge[i + 1] + 1, edge[i + 1] - edge[i]) for i in range(parts)]
        tables = F.array(*[F.concat_ws(":", F.lit(str(t)), *[block[i] for i in chosen]) for t, chosen in enumerate(combinations(range(parts), parts - radius))])
        return one.select(F.col("fingerprint").alias(name), F.explode(F.transform(tables, lambda x: F.xxhash64(x))).alias("key"))

    pairs = keys(queries, "query").join(keys(all_, "fingerprint"), "key").select("query", "fingerprint")
    number = lambda c: F.conv(c, 16, -10).cast("bigint")
    far = F.bit_count(number(F.col("query")).bitwiseXOR(number(F.col("fingerprint"))))
    return pairs.select("query", "fingerprint", far.alias("distance")).filter(F.col("distance") <= radius).distinct()


def near_counts(rows: DataFrame, radius: int, is_query) -> DataFrame:
    """`rows` (fingerprint) with n_near: for rows that `is_query` holds for, how many rows (itself included) are within `radius`; else null."""
    counts = rows.groupBy("fingerprint").agg(F.count("*").alias("n"))
    asked = rows.filter(is_query).select("fingerprint")
    found = within(asked, counts, radius).join(counts, "fingerprint").groupBy("query").agg(F.sum("n").alias("n_near"))
    out = rows.join(found, rows["fingerprint"] == found["query"], "left").drop("query")
    return out.withColumn("n_near", F.when(is_query, F.col("n_near")))


def digest(docs: DataFrame, radius: int, is_query) -> DataFrame:
    """edited_pairs() with n_near over all rows."""
    return near_counts(staged(edited_pairs(docs), "simhash"), radius, is_query)
