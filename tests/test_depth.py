"""Depth by stretches of equal depth, against counting base by base."""

import random
from collections import Counter

from helicase.operators import coverage, loci, pileup

BIN = pileup.DEPTH_BIN
READS = "ref string, pos long, nucs string, qual string, ref_bases string"


def laid(seed=5, n=120, deep=200):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        at = rng.choice([BIN - 40, BIN + 1, 2 * BIN - 10, 5 * BIN]) + rng.randrange(30)
        text = "".join(rng.choice("ACGT") for _ in range(rng.randrange(1, 90)))
        seen = "".join(c if rng.random() < 0.9 else rng.choice("ACGTX") for c in text)
        rows.append((f"chr{i % 2}", at, seen, "".join(rng.choice("#I") if rng.random() < 0.2 else "I" for _ in text), text[: rng.choice([len(text), len(text) // 2])]))
    rows += [("chr0", 7, "ACGT" * 10, "I" * 40, "ACGT" * 10)] * deep  # one hot place
    rows += [("chr0", 1, "A" * (2 * BIN + 5), "I" * (2 * BIN + 5), "A" * (2 * BIN + 5)), ("chr1", 3, "", "", ""), ("chr1", 3, "AC", "II", "")]
    return rows


def depths(rows):
    c = Counter()
    for ref, pos, nucs, qual, text in rows:
        for i, (a, b, q) in enumerate(zip(nucs, text, qual)):
            if a == b and ord(q) - 33 > 30:
                c[ref, pos + i] += 1
    return c


def test_runs_agree_with_counting(spark):
    rows = laid()
    runs = pileup.depth_runs(spark.createDataFrame(rows, READS))
    got = {(r.ref, r.pos): r.depth for r in pileup.run_positions(runs).collect()}
    assert got == dict(depths(rows))
    # stretches tile the bins they lie in
    per = {}
    for r in runs.collect():
        per.setdefault((r.ref, r.bin), []).append((r.pos, r.stop))
    for (_, b), spans in per.items():
        spans.sort()
        assert spans[0][0] == b * BIN + 1 and spans[-1][1] == (b + 1) * BIN + 1
        assert all(x[1] == y[0] for x, y in zip(spans, spans[1:]))


def test_runs_of_nothing(spark):
    none = pileup.depth_runs(spark.createDataFrame([], READS))
    assert none.count() == 0 and pileup.run_positions(none).count() == 0


def test_region_depths_over_bins(spark):
    rows = laid()
    regions = [("chr0", 1, BIN - 5, 2 * BIN + 9), ("chr1", 2, 3 * BIN, 3 * BIN + 4), ("chr1", 3, BIN - 3, BIN + 60), ("chr2", 4, 1, 3), ("chr0", 5, 9, 9)]
    runs = pileup.depth_runs(spark.createDataFrame(rows, READS))
    got = loci.region_depths(spark.createDataFrame(regions, "ref string, cluster long, start long, stop long"), runs).collect()
    c = depths(rows)
    want = sorted((ref, k, p, c[ref, p]) for ref, k, a, b in regions for p in range(a, b))
    assert sorted((r.ref, r.cluster, r.pos, r.depth) for r in got) == want


def test_depth_by_gc_counts_every_window(spark):
    rng = random.Random(3)
    text, size = "".join(rng.choice("ACGT") for _ in range(300)), 64
    rows = [("c", p, text[p - 1 : p + 49], "I" * 50, text[p - 1 : p + 49]) for p in (1, 15, 22, 60, 120, 240)]
    chunks = [("c", i, text[i * size : (i + 1) * size], text[i * size : (i + 2) * size]) for i in range(5)]
    got = coverage.depth_by_gc(pileup.depth_runs(spark.createDataFrame(rows, READS)), spark.createDataFrame(chunks, "ref string, chunk long, s string, ext string"), size)
    c, by = depths(rows), {}
    for i in range(len(text) - 39):
        by.setdefault(sum(x in "GC" for x in text[i : i + 40]), []).append(c["c", i + 21])
    mean = {g / 40: sum(v) / len(v) for g, v in by.items()}
    sd = {g / 40: (sum(x * x for x in v) / len(v) - (sum(v) / len(v)) ** 2) ** 0.5 for g, v in by.items()}
    rows = {r.gc: r for r in got.collect()}
    assert rows.keys() == mean.keys()
    assert all(abs(rows[g].depth - mean[g]) < 1e-9 and abs(rows[g].sd - sd[g]) < 1e-6 for g in mean)
