"""Exact Jaccard join of documents on word n-grams.

A document by n-gram incidence matrix is multiplied with its transpose in blocks. Documents with equal sets are one row
of it. N-grams are ordered from rare to frequent, and two sets that are similar enough share one of the first
|x| - ceil(t |x|) + 1 of each, so only these columns bring documents together. Few documents in a column are compared in pairs
whose sizes allow the similarity. Columns with many, such as those of a large group of near copies, only say which
documents belong to one cluster; the clusters are multiplied block by block inside tasks, blocks whose sizes are too
far apart not at all, and of the links of a block only a spanning forest leaves the task. Pairs are counted over the
columns they share, and those that share too few for their sizes are not compared at all.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helicase.llm import common
from helicase.llm.common import ship, staged
from helicase.llm.components import components

ship(__name__)

#: Buckets of the counts that order the n-grams. Any order gives the same result.
BUCKETS = 1 << 20
#: Documents in a column that are compared in pairs.
FEW = 48
#: Size of the filter for sets that meet others.
FILTER_BITS = 1 << 24
#: N-grams of a block of a cluster. A set of a cluster with m blocks is sent to about m tasks, so few large blocks shuffle little; a cluster
#: of more than SHARED n-grams has up to SPREAD smaller blocks all the same, so that several tasks share it.
BLOCK, SHARED, SPREAD = 1_000_000, 100_000, 4


def sets(column: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of texts: first and last text, owner and hash of their distinct n-grams, set sizes and 64-bit set hashes."""
    data, at = common.text_bytes(column)
    for i, j in common.slices(at):
        begin = at[i : j + 1] - at[i]
        owner, _, _, words = common.words(common.lowered(data[at[i] : at[j]]), begin)
        owner, grams, _ = common.distinct(*common.shingles(owner, words, j - i, k))
        size = np.bincount(owner, minlength=j - i)
        sums = np.zeros(j - i, np.uint64)
        if len(grams):
            head = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            sums[owner[head]] = common.mix(np.add.reduceat(common.mix(grams ^ np.uint64(0x5851F42D4C957F2D)), head) ^ (np.add.reduceat(grams, head) * np.uint64(0x9E3779B97F4A7C15)))
        yield i, j, owner, grams, size, sums


def _bucket(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def _survey(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, size and set of every document, and from each task one row of n-gram counts by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.int64)
        names = ["doc_id", "size", "set", "counts"]
        for b in batches:
            sizes, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
            for _, _, _, grams, size, sums in sets(b.column("text"), k):
                counts += np.bincount(_bucket(grams), minlength=BUCKETS)
                sizes.append(size)
                hashes.append(sums)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(hashes).view(np.int64)), pa.nulls(b.num_rows, pa.binary())], names)
        none = pa.nulls(1, pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, pa.array([zlib.compress(counts.tobytes(), 1)], pa.binary())], names)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return staged(rows.mapInArrow(run, "doc_id bigint, size bigint, set bigint, counts binary"), "jaccard-survey")


def _columns(docs: DataFrame, counts: np.ndarray | None, k: int, percent: int) -> DataFrame:
    """(gram, size, set): the columns through which a set can meet a similar one."""
    shared = docs.sparkSession.sparkContext.broadcast(np.zeros(BUCKETS, np.int64) if counts is None else counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = shared.value
        seen: set[int] = set()
        for b in batches:
            for _, _, owner, grams, size, sums in sets(b.column("text"), k):
                fresh = np.zeros(len(size), bool)
                for i, s in enumerate(sums.tolist()):
                    fresh[i] = s not in seen
                    seen.add(s)
                use = fresh[owner]
                owner, grams = owner[use], grams[use]
                order = np.lexsort((grams, often[_bucket(grams)], owner))
                owner, grams = owner[order], grams[order]
                rank = np.arange(len(owner)) - np.searchsorted(owner, owner)
                first = rank < (size - (percent * size + 99) // 100 + 1)[owner]
                who = owner[first]
                yield pa.RecordBatch.from_arrays([pa.array(grams[first].view(np.int64)), pa.array(size[who]), pa.array(sums[who].view(np.int64))], ["gram", "size", "set"])

    return docs.select("text").mapInArrow(run, "gram bigint, size bigint, set bigint")


def _meetings(columns: DataFrame, percent: int) -> DataFrame:
    """(a, b, many): pairs of sets to compare; with `many`, members of a cluster with the column's first.

    Let p of n be the columns of a set. Grams of the set whose columns end first are in the other set only if they are in
    its columns too, so two sets share no more than the columns they meet in and the n - p others. (A pair that meets in
    a column of many is compared within its cluster, whatever is counted here.)
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple[int, int]] = []  # different sets of the column `now`, while they are few
        now, leader, last = None, None, None
        out: list[tuple[int, int, int, int, bool]] = []

        def close() -> None:
            for n, (s, x) in enumerate(group):
                out.extend((x, y, s, t, False) for t, y in group[n + 1 :] if 100 * s >= percent * t)
            group.clear()

        def table() -> pa.RecordBatch:
            columns = zip(*out) if out else [()] * 5
            kinds = [pa.int64()] * 4 + [pa.bool_()]
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["a", "b", "s", "t", "many"])
            out.clear()
            return batch

        for batch in batches:
            gram, size, own = (batch.column(c).to_numpy() for c in ("gram", "size", "set"))
            starts = np.flatnonzero(np.append(True, gram[1:] != gram[:-1])) if len(gram) else np.zeros(0, np.int64)
            counts = np.diff(np.append(starts, len(gram)))
            # a column with one set needs no look, but at the ends of a batch
            use = counts > 1
            use[:1] = use[-1:] = True
            for at, n in zip(starts[use].tolist(), counts[use].tolist()):
                if gram[at] != now:
                    close()
                    now, leader, last = gram[at], None, None
                for s, x in zip(size[at : at + n].tolist(), own[at : at + n].tolist()):
                    if x == last:
                        continue
                    last = x
                    if leader is not None:
                        out.append((leader, x, 0, 0, True))
                    else:
                        group.append((s, x))
                        if len(group) > FEW:
                            leader = group[0][1]
                            out.extend((leader, y, 0, 0, True) for _, y in group[1:])
                            group.clear()
                if len(out) > 50_000:
                    yield table()
        close()
        yield table()

    dealt = columns.repartition("gram").sortWithinPartitions("gram", "size", "set")
    met = dealt.mapInArrow(run, "a bigint, b bigint, s bigint, t bigint, many boolean").groupBy("a", "b", "s", "t", "many").agg(F.count("*").alias("n"))
    rest = lambda c: F.ceil(percent * F.col(c) / 100) - 1
    enough = F.col("n") >= F.ceil(percent * (F.col("s") + F.col("t")) / (100 + percent)) - F.greatest(rest("s"), rest("t"))
    return met.filter(F.col("many") | enough).select("a", "b", "many")


def _filter(wanted: DataFrame) -> np.ndarray:
    """Bits that are set for all of the sets `wanted` (set) and few others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(FILTER_BITS // 8, np.uint8)
        for b in batches:
            x = _filter_bit(b.column("set").to_numpy().view(np.uint64))
            np.bitwise_or.at(bits, x >> 3, (1 << (x & 7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(bits.tobytes(), 1)], pa.binary())], ["bits"])

    found = common.tree_sum(staged(wanted.mapInArrow(run, "bits binary"), "jaccard-filter"), "bits", "uint8", np.bitwise_or)
    return np.zeros(FILTER_BITS // 8, np.uint8) if found is None else found


def _filter_bit(sets: np.ndarray) -> np.ndarray:
    return (sets >> np.uint64(64 - FILTER_BITS.bit_length() + 1)).astype(np.int64)


def _arrays(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(set, size, grams) of the sets `wanted` (set): each from one of its documents.

    Tasks leave out most other sets by a filter of fixed size, so that texts need not be shuffled; a join is exact.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_filter(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = shared.value, set()
        for b in batches:
            for _, _, owner, grams, size, sums in sets(b.column("text"), k):
                x = _filter_bit(sums)
                use = (size > 0) & (bits[x >> 3] >> (x & 7).astype(np.uint8) & 1).astype(bool)
                for i in np.flatnonzero(use).tolist():
                    use[i] = sums[i] not in seen
                    seen.add(sums[i])
                at = np.flatnonzero(use)
                new = np.cumsum(use) - 1
                in_use = use[owner]
                yield pa.RecordBatch.from_arrays([pa.array(sums[at].view(np.int64)), pa.array(size[at]), common.list_array(new[owner[in_use]], grams[in_use].view(np.int64), len(at), pa.int64())], ["set", "size", "grams"])

    found = docs.select("text").mapInArrow(run, "set bigint, size bigint, grams array<bigint>")
    return staged(found.join(wanted, "set", "left_semi").dropDuplicates(["set"]), "jaccard-arrays")


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> Iterator[np.ndarray]:
    """Rows of the product of two blocks: for each set of `a`, how many n-grams it shares with each of `b`."""
    owner, grams = np.repeat(np.arange(len(b)), [len(x) for x in b]), np.concatenate(b)
    order = np.argsort(grams, kind="stable")
    owner, grams = owner[order], grams[order]
    for x in a:
        lo, hi = np.searchsorted(grams, x, "left"), np.searchsorted(grams, x, "right")
        n = hi - lo
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        yield np.bincount(owner[at], minlength=len(b))


def _unit(c: Column, i: Column, up: int, j: Column, side: Column) -> Column:
    """Block i of class c times block j of the same class or (up) the next; side: 0 for rows of block i."""
    return F.named_struct(F.lit("c"), c, F.lit("i"), i, F.lit("up"), F.lit(up), F.lit("j"), j, F.lit("side"), side)


def _cluster_links(clusters: DataFrame, arrays: DataFrame, percent: int) -> DataFrame:
    """(a, b): edges that connect what links connect within the clusters (node, root)."""
    # sets of similar sizes lie in the same class or in neighbouring ones
    classes = F.floor(F.log("size") / F.lit(math.log(100 / percent) * 1.01))
    members = clusters.select(F.col("node").alias("set"), F.col("root").alias("cluster")).join(arrays, "set").withColumn("class", classes)
    total = members.groupBy("cluster", "class").agg(F.sum("size").alias("sum"))
    total = total.select("cluster", "class", F.greatest(F.ceil(F.col("sum") / BLOCK), F.least(F.ceil(F.col("sum") / SHARED), F.lit(SPREAD))).alias("blocks"))
    after = total.select("cluster", (F.col("class") - 1).alias("class"), F.col("blocks").alias("next"))
    before = total.select("cluster", (F.col("class") + 1).alias("class"), F.col("blocks").alias("previous"))
    dims = total.join(after, ["cluster", "class"], "left").join(before, ["cluster", "class"], "left").na.fill(0, ["next", "previous"])
    dims = staged(dims, "jaccard-blocks")  # a few rows a cluster, so that a large cluster's members need not meet in one task
    m = members.join(dims, ["cluster", "class"]).withColumn("block", F.pmod(F.xxhash64("set"), F.col("blocks")))
    own = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1), lambda j: _unit(F.col("class"), F.least("block", j), 0, F.greatest("block", j), (F.col("block") > j).cast("int")))
    upper = F.when(F.col("next") > 0, F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("next") - 1), lambda j: _unit(F.col("class"), F.col("block"), 1, j, F.lit(0))))
    lower = F.when(F.col("previous") > 0, F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("previous") - 1), lambda i: _unit(F.col("class") - 1, i, 1, F.col("block"), F.lit(1))))
    empty = F.filter(own, lambda _: F.lit(False))
    units = m.select("cluster", "set", "grams", F.explode(F.concat(own, F.coalesce(upper, empty), F.coalesce(lower, empty))).alias("u"))
    units = units.select("cluster", F.xxhash64("cluster", "u.c", "u.i", "u.up", "u.j").alias("unit"), "u.side", ((F.col("u.i") == F.col("u.j")) & (F.col("u.up") == 0)).alias("square"), "set", "grams")

    def product(x: pd.DataFrame) -> pd.DataFrame:
        left = x if x["square"].iloc[0] else x[x["side"] == 0]
        right = x if x["square"].iloc[0] else x[x["side"] == 1]
        if not (len(left) and len(right)):
            return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        a, b = list(left["grams"]), list(right["grams"])
        size = np.array([len(g) for g in b])
        names = np.concatenate([left["set"].to_numpy(), right["set"].to_numpy()])
        label = pd.Series(np.arange(len(names))).groupby(names).transform("min").to_numpy().copy()
        # merged row by row: the links of a block are as many as its pairs, its sets few
        for i, n in enumerate(overlaps(a, b)):
            j = np.flatnonzero(100 * n >= percent * (len(a[i]) + size - n))
            met = np.unique(label[np.append(j + len(a), i)])
            if len(met) > 1:
                label[np.isin(label, met)] = met[0]
        out = pd.DataFrame({"a": names, "b": names[label]})
        return out[out["a"] != out["b"]].drop_duplicates()

    return units.groupBy("unit").applyInPandas(product, "a bigint, b bigint")


def _pair_links(pairs: DataFrame, arrays: DataFrame, percent: int) -> DataFrame:
    """The `pairs` (a, b) that link.

    Pairs are compared in units, to each of which a set is sent once: sets that have their smallest neighbour in common are
    together, by blocks if they are many, so that a set with many partners isn't sent to each of them.
    """
    sides = pairs.select(F.col("a").alias("set"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("set"), F.col("a").alias("other")))
    homes = sides.groupBy("set").agg(F.min("other").alias("least")).select("set", F.least("set", "least").alias("home")).join(arrays.select("set", "size"), "set")
    homes = staged(homes, "jaccard-homes")
    blocks = homes.groupBy("home").agg(F.ceil(F.sum("size") / BLOCK).alias("blocks"))
    # small groups share units, as a unit costs a call
    units = (homes.agg(F.sum("size")).first()[0] or 0) // (BLOCK // 4 + 1) + 1
    keys = homes.join(blocks, "home").select("set", F.pmod(F.xxhash64("home", F.pmod(F.xxhash64("set"), "blocks")), F.lit(units)).alias("key"))
    named = lambda c: keys.select(F.col("set").alias(c), F.col("key").alias(f"key_{c}"))
    placed = pairs.join(named("a"), "a").join(named("b"), "b")
    placed = staged(placed.select("a", "b", F.xxhash64(F.least("key_a", "key_b"), F.greatest("key_a", "key_b")).alias("unit")), "jaccard-units")
    sent = placed.select("unit", F.col("a").alias("set")).unionByName(placed.select("unit", F.col("b").alias("set"))).distinct()
    sent = staged(sent.join(arrays.select("set", "grams"), "set"), "jaccard-sent")

    def compare(pairs: pd.DataFrame, sent: pd.DataFrame) -> pd.DataFrame:
        grams = dict(zip(sent["set"].tolist(), sent["grams"]))
        sides = [(grams[x], grams[y]) for x, y in zip(pairs["a"].tolist(), pairs["b"].tolist())]
        links = [100 * (n := len(np.intersect1d(x, y, assume_unique=True))) >= percent * (len(x) + len(y) - n) for x, y in sides]
        return pairs.loc[np.array(links, bool), ["a", "b"]]

    return placed.groupBy("unit").cogroup(sent.groupBy("unit")).applyInPandas(compare, "a bigint, b bigint")


def join(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, n_equal and component_id of every row of `docs` (doc_id, text).

    A text's set holds its distinct k-word shingles (lower-cased A-Z; words between white space); with fewer words, the whole
    sequence. Two rows link when 100 * intersection >= percent * union. component_id is the smallest doc_id that links
    reach. Null, empty and blank texts have empty sets and link with nothing: they are their own component, as is a row whose
    group has only null ids (component null). Repeated rows link like any others; other columns don't matter. n_equal: rows with
    an equal set. Sets are known by 64-bit hashes.
    """
    survey = _survey(docs, k)
    meet = staged(_meetings(_columns(docs, common.tree_sum(survey, "counts", "int64"), k, percent), percent), "jaccard-meetings")
    wanted = meet.select(F.col("a").alias("set")).union(meet.select("b")).distinct()
    arrays = _arrays(docs, staged(wanted, "jaccard-wanted"), k)
    links = staged(_pair_links(meet.filter("not many").select("a", "b"), arrays, percent), "jaccard-links")
    clusters = components(meet.filter("many"))
    roots = components(links.unionByName(_cluster_links(clusters, arrays, percent)))
    rows = survey.filter("counts is null").select("doc_id", "size", "set")
    # what is known of a set is put together by set first, so that rows with one set meet it in one plain join
    each = rows.filter("size > 0").groupBy("set").agg(F.min("doc_id").alias("least"), F.count("*").alias("n_equal"))
    each = staged(each.join(roots.withColumnRenamed("node", "set"), "set", "left").withColumn("root", F.coalesce("root", "set")), "jaccard-sets")
    least = each.groupBy("root").agg(F.min("least").alias("component_id"))
    known = staged(each.join(least, "root").select("set", "n_equal", "component_id"), "jaccard-groups")
    out = rows.filter("size > 0").join(known, "set").select("doc_id", F.col("size").alias("n_shingles"), "n_equal", "component_id")
    alone = rows.filter("size = 0").select("doc_id", F.col("size").alias("n_shingles"), F.lit(1).cast("bigint").alias("n_equal"), F.col("doc_id").alias("component_id"))
    return out.unionByName(alone)
