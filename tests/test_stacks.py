"""Batches of reads that are counted together, against plain loops, and what of them crosses the network."""

import random
import re

from pyspark.sql import functions as F

from helicase.functions import stacks
from helicase.operators import kmers, pileup, prefixes, seeds
from helicase.plans import stages


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def rand_seq(rng, n, letters="ACGT"):
    return "".join(rng.choice(letters) for _ in range(n))


def test_reads_of_a_stitch_are_shuffled_whole(spark, sf_dir):
    index = prefixes.prefix_index(stages.reads(spark, sf_dir)).select("prefix", "nucs", "qual")
    texts = stages.reads(spark, sf_dir).select(F.xxhash64("nucs").alias("text_id"), F.col("nucs").alias("text"))
    text = plan(prefixes.stitch_step(texts, index))
    assert "posexplode" not in text and "Aggregate" not in text


def test_reads_are_realigned_once_and_depth_has_no_base_rows(spark, sf_dir):
    m = stages.mapping(spark, sf_dir)
    lazy = type(m)(m.reads, m.chunks, m.size, m.lengths, m.span, chunks_ext=m.chunks_ext)
    lazy.__dict__["placed"] = m.placed
    # a range would be sampled by a run of its own
    assert "rangepartitioning" not in plan(lazy.aligned)
    assert not re.search(r"explode|zip_with", plan(pileup.depth_runs(m.aligned)))
    assert not re.search(r"zip_with", plan(seeds.score_candidates(m.candidates.join(m.reads, ["pair_id", "mate"]), m.chunks_ext, m.size)))


def test_windows_are_turned_once_a_chunk(spark, sf_dir):
    text = plan(kmers.turned_windows(stages.reference_ext(spark, sf_dir), 32, [20, 30]))
    assert "translate" not in text[: text.index("Generate")] and "translate" in text
    rows = kmers.turned_windows(stages.reference_ext(spark, sf_dir), 32, [20, 30]).where("ref = 'chr1' AND pos < 200").collect()
    assert rows and all(r.rc == r.kmer.translate(str.maketrans("ACGT", "TGCA"))[::-1] and len(r.kmer) == r.k for r in rows)
    plain = kmers.windows(stages.reference_ext(spark, sf_dir), 32, [20, 30])
    assert plain.exceptAll(kmers.turned_windows(stages.reference_ext(spark, sf_dir), 32, [20, 30]).drop("rc")).isEmpty()


def test_a_text_keeps_its_votes_over_pieces(spark, monkeypatch):
    rng = random.Random(3)
    text = rand_seq(rng, 60)
    other = rand_seq(rng, 60)
    reads = [(text[n : n + 40] + "A" * 3, n) for n in range(25) for _ in range(8)]
    rows = [(7, -1, text, None), (9, -1, other, None)] + [(7, n, s, rand_seq(rng, len(s), "5?I")) for s, n in reads] + [(9, 3, other[3:50], None)]
    df = spark.createDataFrame(rows, "text_id long, n int, nucs string, qual string").coalesce(1).sortWithinPartitions("text_id", "n")
    schema = "text_id long, emit string, next string, depths array<long>"
    whole = sorted(df.mapInArrow(stacks.consensus(5, "ACGT"), schema).collect())
    monkeypatch.setattr(stacks, "LETTERS", 100)
    assert sorted(df.mapInArrow(stacks.consensus(5, "ACGT"), schema).collect()) == whole
    votes = [dict.fromkeys("ACGT", 0) for _ in range(90)]
    for i, c in enumerate(text):
        votes[i][c] += 40
    for _, n, s, q in rows[2:-1]:
        if sum(a != b for a, b in zip(text[n:], s)) < 5:
            for i, (c, w) in enumerate(zip(s, q)):
                if n + i < 90:
                    votes[n + i][c] += ord(w) - 33
    best = [max((w, c) for c, w in v.items()) for v in votes]
    won = "".join(c if w > 0 else "N" for w, c in best)
    assert tuple(whole[0]) == (7, won[:30], won[30:90], [w for w, _ in best[:30]])
    assert tuple(whole[1]) == (9, other[:30], other[30:] + "N" * 30, [40] * 30)


def test_mismatch_points_of_odd_texts(spark):
    rows = [("ACGT", "II5", "AGGA"), ("ACGT", "", "TTTT"), ("AC", "IIII", "AGGG"), ("", "", "A"), (None, "I", "A"), ("A", None, "C"), ("A", "I", None), ("ACG", "III", "ACG")]
    df = spark.createDataFrame(rows, "n string, q string, r string").coalesce(1)
    got = [r[0] for r in df.select(stacks.mismatch_points(F.col("n"), F.col("q"), F.col("r"), 30, 1).alias("p")).collect()]
    assert got == [3, 3 + 0, 2, 0, None, None, None, 0]


def test_depth_changes_of_pieces(spark, monkeypatch):
    rng = random.Random(8)
    rows = []
    for _ in range(400):
        s = rand_seq(rng, rng.randrange(1, 30))
        r = "".join(c if rng.random() < 0.8 else "N" for c in s)[: rng.randrange(1, 31)]
        rows.append((rng.choice(["a", "b"]), rng.choice([1, 1000, 1020, 2030]) + rng.randrange(30), s, rand_seq(rng, rng.choice([len(s), 3]), "#I"), r))
    df = spark.createDataFrame(rows, "ref string, pos int, nucs string, qual string, ref_bases string")
    depth = {}
    for ref, pos, s, q, r in rows:
        for i, (a, b, w) in enumerate(zip(s, r, q)):
            if a == b and ord(w) - 33 > 30:
                depth[ref, pos + i] = depth.get((ref, pos + i), 0) + 1
    for size in (1 << 21, 50):
        monkeypatch.setattr(stacks, "LETTERS", size)
        got = {(x.ref, x.pos): x.depth for x in pileup.run_positions(pileup.depth_runs(df)).collect()}
        assert got == depth
