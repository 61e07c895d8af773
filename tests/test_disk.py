"""What queries leave and send over executors' disks."""

import re
import time

from pyspark.sql import functions as F

from helicase.operators import pairing, pileup, seeds
from helicase.session import CLEANUP, materialise


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def shuffle_files(spark) -> set[str]:
    found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = (found.apply(i).getName() for i in range(found.size()))
    return {x for x in names if x.startswith("shuffle_")}


def test_a_written_table_leaves_no_shuffle_files(spark):
    before, was = shuffle_files(spark), spark.conf.get(CLEANUP, None)
    df = spark.range(20_000).groupBy((F.col("id") % 1000).alias("k")).agg(F.count("*").alias("n"))
    out = materialise(df, "counts")
    until = time.time() + 20
    while shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffle_files(spark) - before
    assert out.count() == 1000 and spark.conf.get(CLEANUP, None) == was
    # the plan that was written can still be run
    assert df.agg(F.sum("n")).first()[0] == 20_000


CANDIDATES = "pair_id long, mate int, ref string, pos long, reverse boolean, score int"


def test_candidates_are_dealt_by_their_pair_alone(spark):
    rows = [(1, 1, "a", 100, False, 0), (1, 2, "a", 1390, True, 1), (1, 2, "a", 250, True, 2), (2, 1, "a", 5, False, 3), (2, 2, "b", 9, True, 0), (2, 2, "b", 9, False, 0)]
    rows += [(3, 1, "a", 2800, True, 1), (3, 2, "a", 1401, False, 1), (3, 2, "a", 1400, False, 0), (None, 1, "a", 1, False, 0), (None, 2, "a", 2, True, 0)]
    placed = pairing.placements(spark.createDataFrame(rows, CANDIDATES))
    text = plan(placed)
    dealt = set(re.findall(r"Exchange hashpartitioning\(([^)]*)\)", text))
    assert dealt and all(re.fullmatch(r"pair_id#\d+L, \d+", x) for x in dealt), dealt
    got = {(r.pair_id, r.mate, r.ref, r.pos, r.reverse, r.paired) for r in placed.collect()}
    assert got == {
        (1, 1, "a", 100, False, True), (1, 2, "a", 1390, True, True), (2, 1, "a", 5, False, False), (2, 2, "b", 9, False, False),
        (3, 1, "a", 2800, True, True), (3, 2, "a", 1401, False, True), (None, 1, "a", 1, False, False), (None, 2, "a", 2, True, False),
    }


def test_realigned_reads_are_dealt_once(spark):
    letters = "ACGTTGCATTGACCAGTACGATCAGGCTTAAC"
    chunks_ext = spark.createDataFrame([("r", i, letters * 4) for i in range(80)], "ref string, chunk long, ext string")
    reads = spark.createDataFrame([(i, 1, f"n{i}", letters * 2, "I" * 64) for i in range(70)], "pair_id long, mate int, name string, nucs string, qual string")
    placed = spark.createDataFrame([(i, 1, "r", 32 * i + 1, False) for i in range(70)], "pair_id long, mate int, ref string, pos long, reverse boolean")
    laid = pileup.realign(placed, reads, chunks_ext, 32, near=1024)
    assert "Exchange" not in plan(laid.sortWithinPartitions("ref", "pos")).split("SortMergeJoin [ref", 1)[0]
    assert plan(laid).count("_stretch") and laid.where("ok and ref_bases = nucs").count() == 70
    homes = laid.groupBy(F.spark_partition_id().alias("task"), F.expr("(pos - 1) div 1024").alias("stretch")).count().collect()
    assert len(homes) == len({r.stretch for r in homes}) == 3


def test_what_the_seed_search_shuffled_goes_before_candidates_are_scored(spark):
    staged = []
    chunks = spark.createDataFrame([("r", i, "ACGTTGCATTGACCAGTACGATCAGGCTTAAC"[i:] + "ACGTTGCATTGACCAGTACGATCAGGCTTAAC"[:i]) for i in range(6)], "ref string, chunk long, s string")
    from helicase.sources import genome

    ext = genome.with_overhang(chunks, 32, 80)
    text = "".join(r.s for r in chunks.orderBy("chunk").collect())
    reads = spark.createDataFrame([(1, 1, text[20:80] + "A" + text[81:92], "I" * 72)], "pair_id long, mate int, nucs string, qual string")
    found = seeds.seeded_matches(reads, ext, 32, stage=lambda df, name: staged.append(name) or materialise(df, name))
    assert staged == ["starts"]
    assert (1, 1, "r", 21, False) in {tuple(r)[:5] for r in found.collect()}


def test_a_set_with_many_partners_is_sent_once(spark, monkeypatch):
    from helicase.llm import jaccard

    sent = {}
    monkeypatch.setattr(jaccard, "staged", lambda df, name: sent.setdefault(name, materialise(df, name)))
    grams = {i: list(range(100)) + [1000 + i * 10 + j for j in range(i % 4 * 10)] for i in range(1, 25)}
    arrays = spark.createDataFrame([(i, len(g), g) for i, g in grams.items()], "set long, size long, grams array<long>")
    pairs = [(a, b) for a in grams for b in grams if a < b]
    links = jaccard._pair_links(spark.createDataFrame(pairs, "a long, b long"), arrays, 80)
    j = lambda x, y: len(x & y) * 100 >= 80 * len(x | y)
    assert {tuple(r) for r in links.collect()} == {(a, b) for a, b in pairs if j(set(grams[a]), set(grams[b]))}
    assert sent["jaccard-sent"].count() == len(grams)  # 552 rows if each pair brought its own


def test_a_cluster_of_near_copies_is_sent_in_few_blocks(spark, monkeypatch):
    from helicase.llm import jaccard

    # 600 sets of 1,500 n-grams made nine blocks, each of them sent to nine products
    arrays = spark.createDataFrame([(i, 1500, [*range(1480), *range(2000 + i * 20, 2020 + i * 20)]) for i in range(600)], "set long, size long, grams array<long>")
    clusters = arrays.select(F.col("set").alias("node"), F.lit(0).cast("long").alias("root"))
    dims = []
    monkeypatch.setattr(jaccard, "staged", lambda df, name: dims.append(materialise(df, name)) or dims[-1])
    edges = {tuple(r) for r in jaccard._cluster_links(clusters, arrays, 80).collect()}
    assert [r.blocks for r in dims[0].collect()] == [4]
    root = {i: i for i in range(600)}
    find = lambda x: x if root[x] == x else find(root[x])
    for a, b in edges:
        root[find(a)] = find(b)
    assert len({find(i) for i in range(600)}) == 1
