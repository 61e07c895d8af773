"""Operators that have no SQL form, against plain Python on small data."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from test_edit import clear_indel as read_indel
from helicase.operators import clusters, coverage, kmers, merging, pairing, prefixes, selfref
from helicase.plans.mapper import Mapping
from helicase.session import materialise
from helicase.sources import genome

RC = str.maketrans("ACGT", "TGCA")


def rc(s):
    return s.translate(RC)[::-1]


def chunked(spark, seqs, size):
    rows = [(n, i // size, s[i : i + size]) for n, s in seqs.items() for i in range(0, len(s), size)]
    return spark.createDataFrame(rows, "ref string, chunk long, s string")


def rand_seq(rng, n):
    return "".join(rng.choice("ACGT") for _ in range(n))


# --- mapping with indels ------------------------------------------------------


def brute_candidates(read, qual, seqs, lengths, qlimit=30, k=11):
    out = []
    if "N" in read:
        return out
    for ref, g in seqs.items():
        if len(read) in lengths:
            for rev, t in ((False, read), (True, rc(read))):
                out += [(ref, i + 1, rev, 0) for i in range(len(g) - len(t) + 1) if g.startswith(t, i)]
    if out:
        return out
    gap = (len(read) - 3 * k) // 3
    if len(read) < 3 * k:
        return out
    found = set()
    for ref, g in seqs.items():
        for a in range(0, gap, 3):
            for rev in (False, True):
                t = rc(read) if rev else read
                hits = []
                for letter in range(3):
                    seed = t[letter * gap + a : letter * gap + a + k]
                    hits += [(i + 1, letter) for i in range(len(g) - k + 1) if g.startswith(seed, i)]
                hits.sort()
                for x, y, z in zip(hits, hits[1:], hits[2:]):
                    if (x[1], y[1], z[1]) == (0, 1, 2) and y[0] - x[0] < 1.2 * gap and z[0] - y[0] < 1.2 * gap and x[0] - a >= 1:
                        found.add((ref, x[0] - a, rev))
    for ref, pos, rev in found:
        t, q = (rc(read), qual[::-1]) if rev else (read, qual)
        g = seqs[ref][pos - 1 : pos - 1 + len(t)]
        score = sum(x != y and ord(c) - 33 > qlimit for x, y, c in zip(t, g, q))
        if score >= 5 and read_indel(t, g)[0]:
            score = 1
        out.append((ref, pos, rev, score))
    return out


def brute_place(pairs, seqs, lengths):
    placed = {}
    for pid, mates in pairs.items():
        c = {m: brute_candidates(*mates[m], seqs, lengths) for m in mates}
        both = [
            (a[3] + b[3], a[0], a[1], b[1], a[2], a[3], b[3])
            for a in c[1]
            for b in c[2]
            if a[0] == b[0] and a[2] != b[2] and abs(a[1] - b[1]) < 1400
        ]
        if both:
            _, ref, p1, p2, r1, s1, s2 = min(both)
            placed[pid, 1], placed[pid, 2] = (ref, p1, r1, s1, True), (ref, p2, not r1, s2, True)
        else:
            for m in (1, 2):
                if c[m]:
                    s, ref, pos, rev = min((x[3], x[0], x[1], x[2]) for x in c[m])
                    placed[pid, m] = (ref, pos, rev, s, False)
    return placed


@pytest.fixture(scope="module")
def small(spark):
    rng = random.Random(7)
    a = rand_seq(rng, 3000)
    seqs = {"r1": a, "r2": rand_seq(rng, 700) + a[500:800] + rand_seq(rng, 300)}
    pairs = {}
    for pid in range(120):
        ref = rng.choice(list(seqs))
        g = seqs[ref]
        start = rng.randrange(len(g) - 260)
        frag = g[start : start + rng.randrange(90, 240)]
        n = rng.choice([70, 70, 70, 61, 40, 30])
        mates = [frag[:n], rc(frag[-n:])]
        for m in (0, 1):
            kind = rng.randrange(6)
            s = mates[m]
            p = rng.randrange(len(s))
            if kind == 1:
                s = s[:p] + rng.choice("ACGT") + s[p + 1 :]
            elif kind == 2 and len(s) > 45:
                s = s[:20] + s[22:] + rand_seq(rng, 2)
            elif kind == 3 and len(s) > 45:
                s = s[:25] + "GT" + s[25:-2]
            elif kind == 4 and rng.random() < 0.3:
                s = s[:5] + "N" + s[6:]
            elif kind == 5 and rng.random() < 0.2:
                s = rand_seq(rng, len(s))
            mates[m] = s
        if pid % 2:
            mates.reverse()
        pairs[pid] = {m + 1: (s, "".join(chr(33 + rng.randrange(2, 42)) for _ in s)) for m, s in enumerate(mates)}
    reads = spark.createDataFrame(
        [(p, m, f"p{p}/{m}", s, q) for p, ms in pairs.items() for m, (s, q) in ms.items()],
        "pair_id long, mate int, name string, nucs string, qual string",
    )
    m = Mapping(reads, chunked(spark, seqs, 64), 64, [70, 61], 80, stage=materialise)
    return seqs, pairs, m


def test_placement_matches_brute_force(small):
    seqs, pairs, m = small
    want = brute_place(pairs, seqs, [70, 61])
    got = {(r.pair_id, r.mate): (r.ref, r.pos, r.reverse, r.score, r.paired) for r in m.placed.collect()}
    assert got == want
    unfound = {(r.pair_id, r.mate) for r in m.unfound.collect()}
    assert unfound == {(p, x) for p in pairs for x in (1, 2)} - set(want)


def brute_lay(seqs, pairs, placed):
    cov, diffs = {}, []
    for (pid, mate), (ref, pos, rev, *_rest) in placed.items():
        s, q = pairs[pid][mate]
        q = [ord(c) - 33 for c in q]
        if rev:
            s, q = rc(s), q[::-1]
        g = seqs[ref][pos - 1 : pos - 1 + len(s)]
        points = sum((1 if c > 30 else 0.5) for x, y, c in zip(s, g, q) if x != y)
        ok = points < 5
        if not ok:
            indel, n = read_indel(s, g)
            if indel > 0:
                diffs.append((ref, pos + indel, s[indel], q[indel], rev != (indel > len(s) // 2), s[indel : indel + n]))
                s, q = s[:indel] + s[indel + n :], q[:indel] + q[indel + n :]
            elif indel < 0:
                s, q = s[:-indel] + "X" * n + s[-indel:], q[:-indel] + [40] * n + q[-indel:]
            ok = indel != 0
        for i, (x, y, c) in enumerate(zip(s, g, q)):
            if x == y:
                if c > 30:
                    cov[ref, pos + i] = cov.get((ref, pos + i), 0) + 1
            elif c > 30 and ok:
                diffs.append((ref, pos + i, x, c, rev != (i > len(s) // 2), None))
    return cov, diffs


def test_coverage_and_differences_match_brute_force(small):
    seqs, pairs, m = small
    cov, diffs = brute_lay(seqs, pairs, brute_place(pairs, seqs, [70, 61]))
    assert {(r.ref, r.pos): r.depth for r in m.coverage.collect()} == cov
    got = sorted((tuple(r) for r in m.differences.select("ref", "pos", "base", "q", "head", "inserted").collect()), key=repr)
    assert got == sorted(diffs, key=repr)
    assert any(d[5] for d in diffs) and any(d[2] == "X" for d in diffs)


@pytest.mark.parametrize("n,attempts", [(32, 0), (33, 0), (35, 0), (36, 1), (60, 3)])
def test_seed_attempts_by_read_length(spark, n, attempts):
    from helicase.operators.seeds import seed_hits

    g = rand_seq(random.Random(3), 400)
    ext = genome.with_overhang(chunked(spark, {"r": g}, 64), 64, 80)
    reads = spark.createDataFrame([(g[100 : 100 + n],)], "nucs string")
    hits = seed_hits(reads, ext, 64).where("not reverse")
    assert hits.select("shift").distinct().count() == attempts


@pytest.mark.parametrize("most", [4**11, 0])
def test_rarest_seed_finds_the_same_starts(spark, monkeypatch, most):
    from helicase.operators import seeds

    monkeypatch.setattr(seeds, "MAX_COUNTS", most)
    rng = random.Random(17)
    unit, far = rand_seq(rng, 13), rand_seq(rng, 90)
    # Tandem repeats put several hits of one seed between neighbours; copies make seeds frequent.
    a = rand_seq(rng, 50) + unit * 9 + far + rand_seq(rng, 40) + "A" * 60 + rc(far) + rand_seq(rng, 30)
    b = far[:70] + "C" + far[70:] + rand_seq(rng, 33) + unit * 6
    ext = genome.with_overhang(chunked(spark, {"a": a, "b": b}, 32), 32, 80)
    cuts = [(g, i, n) for g in (a, b) for n in (36, 41, 60, 80) for i in range(0, len(g) - n, 7)]
    texts = [g[i : i + n] for g, i, n in cuts]
    for n, t in enumerate(texts[::3]):
        at = rng.randrange(len(t))
        texts.append(t[:at] + "ACGT"[n % 4] + t[at + 1 :])
        texts.append(rc(t[: at - 1] + t[at:]))
    seqs = spark.createDataFrame([(t,) for t in sorted(set(texts)) + ["ACGT", "", "N" * 60, None]], "nucs string")
    got = sorted(tuple(r) for r in seeds.rarest_starts(seqs, ext, 32).collect())
    want = sorted(tuple(r) for r in seeds.triple_starts(seeds.seed_hits(seqs, ext, 32)).collect())
    assert got == want and len(want) > 300
    assert seeds.rarest_starts(seqs.where("false"), ext, 32).count() == 0


@pytest.mark.parametrize("k", [11, 4])
def test_pairs_of_seeds_find_the_same_starts(spark, k):
    from helicase.operators import seeds

    rng = random.Random(23)
    unit, far = rand_seq(rng, 13), rand_seq(rng, 90)
    # Tandem repeats, runs of one base and short seeds put several hits of one seed between neighbours.
    a = rand_seq(rng, 50) + unit * 9 + far + rand_seq(rng, 40) + "A" * 60 + rc(far) + "AC" * 20 + rand_seq(rng, 30)
    b = far[:70] + "C" + far[70:] + rand_seq(rng, 33) + unit * 6 + "NNNN" + far[:50]
    ext = genome.with_overhang(chunked(spark, {"a": a, "b": b}, 32), 32, 80)
    texts = [g[i : i + n] for g in (a, b) for n in (15, 24, 36, 41, 60, 80) for i in range(0, len(g) - n, 5)]
    texts += [rc(t[: len(t) // 2] + t[len(t) // 2 + 1 :]) for t in texts[::3]]
    seqs = spark.createDataFrame([(t,) for t in texts + ["ACGT", "", "N" * 60, None]], "nucs string")
    got = sorted(tuple(r) for r in seeds.pair_starts(seqs, ext, 32, k).collect())
    want = sorted(tuple(r) for r in seeds.triple_starts(seeds.seed_hits(seqs.distinct(), ext, 32, k)).collect())
    assert got == want and len(want) > 300
    assert seeds.pair_starts(seqs.where("false"), ext, 32, k).count() == 0


def test_pairs_of_seeds_with_a_chunk_given_twice(spark):
    from helicase.operators import seeds

    g = rand_seq(random.Random(29), 640)
    chunks = chunked(spark, {"r": g}, 32)
    ext = genome.with_overhang(chunks.unionByName(chunks.where("chunk IN (3, 9, 19)")), 32, 80)
    seqs = spark.createDataFrame([(g[i : i + 60],) for i in range(0, 580, 3)], "nucs string")
    got = sorted(tuple(r) for r in seeds.pair_starts(seqs, ext, 32).collect())
    assert seeds.repeated_chunks(ext) and not seeds.repeated_chunks(genome.with_overhang(chunks, 32, 80))
    assert got == sorted(tuple(r) for r in seeds.rarest_starts(seqs, ext, 32).collect()) and len(got) > 100


def test_places_of_seeds_are_dealt_out_once(spark, sf_dir):
    # A row for each place and attempt crosses the network, no row for each pair of both and no counts of seeds.
    from helicase.operators import seeds
    from helicase.plans import stages

    found = seeds.pair_hits(stages.reads(spark, sf_dir).select("nucs"), stages.reference_ext(spark, sf_dir), 32)
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in text and "BroadcastExchange" not in text and text.count("Exchange hashpartitioning(_deal") == 2


def test_windows_meet_reads_without_their_text(spark, sf_dir):
    from helicase.plans import stages

    found = kmers.exact_matches(stages.reads(spark, sf_dir), stages.reference_ext(spark, sf_dir), 32, [60, 64, 72])
    text = found._jdf.queryExecution().executedPlan().toString()
    keys = [x for x in text.splitlines() if "Exchange hashpartitioning(_h" in x]
    assert len(keys) == 2 and "_wkey" not in text


def test_palindrome_matches_both_ways(spark):
    pal = "ACGGATCCGT"
    assert rc(pal) == pal
    ext = genome.with_overhang(chunked(spark, {"r": "TT" + pal + "GGGGGG"}, 8), 8, 10)
    reads = spark.createDataFrame([(1, 1, pal, "I" * 10)], "pair_id long, mate int, nucs string, qual string")
    got = sorted((r.pos, r.reverse) for r in kmers.exact_matches(reads, ext, 8, [10]).collect())
    assert got == [(3, False), (3, True)]


def test_duplicate_limit_keeps_first_copies(spark):
    rows = [(i, 1, "ACGT" if i % 3 else f"G{i}") for i in range(30)]
    df = spark.createDataFrame(rows, "pair_id long, mate int, nucs string")
    kept = pairing.limit_duplicates(df, 2)
    assert sorted(r.pair_id for r in kept.where("nucs = 'ACGT'").collect()) == [1, 2]
    assert "WindowGroupLimit" in kept._jdf.queryExecution().toString()


# --- clusters, coverage -------------------------------------------------------


def test_gap_of_the_limit_does_not_split(spark):
    df = spark.createDataFrame([("r", p) for p in (1, 50, 151, 251, 352)], "ref string, pos long")
    got = [(r.pos, r.cluster) for r in clusters.cluster_ids(df, 100).orderBy("pos").collect()]
    assert got == [(1, 1), (50, 1), (151, 2), (251, 2), (352, 3)]


def test_clusters_across_bins(spark):
    rng = random.Random(2)
    pos = sorted(rng.sample(range(1, 5000), 300))
    want, n, last = {}, 0, None
    for p in pos:
        n += last is None or p - last > 20
        want[p], last = n, p
    df = spark.createDataFrame([("r", p) for p in pos], "ref string, pos long")
    for size in (16, 64, 1 << 16):
        assert {r.pos: r.cluster for r in clusters.cluster_ids(df, 20, bin_size=size).collect()} == want


def test_low_regions_need_both_flanks(spark):
    depth = [0] * 50 + [9] * 60 + [1] * 7 + [9] * 60 + [2] * 30
    chunks = chunked(spark, {"r": "A" * len(depth)}, 64)
    dense = spark.createDataFrame([("r", i + 1, "A", d) for i, d in enumerate(depth)], "ref string, pos long, base string, depth long")
    assert [tuple(r) for r in coverage.low_regions(dense, chunks).select("ref", "pos", "stop").collect()] == [("r", 111, 118)]


# --- merging ------------------------------------------------------------------


def test_merge_cases(spark):
    g = rand_seq(random.Random(5), 100)
    rows = [(1, g[:60], rc(g[30:90])), (2, g[30:70], rc(g[10:60])), (3, g[:40], rc(g[60:]))]
    got = {r.pair_id: (r.overlap, r.merged) for r in merging.merge_pairs(spark.createDataFrame(rows, "pair_id long, one string, two string")).collect()}
    assert got == {1: (30, g[:90]), 2: (30, g[10:60]), 3: (None, None)}


# --- stitching ----------------------------------------------------------------


def brute_stitch(seed, reads, end, maxlen, k=35):
    both = [(s, q) for s, q in reads if len(s) >= k] + [(rc(s), q[::-1]) for s, q in reads if len(s) >= k]
    total = ""
    while True:
        n = len(seed)
        votes = [dict.fromkeys("ACGT", 0) for _ in range(int(n * 1.5))]
        for i, c in enumerate(seed):
            if c in votes[i]:
                votes[i][c] += 40
        for off in range(n - k):
            part = seed[off : off + k]
            if "N" in part:
                continue
            for s, q in both:
                if s[:k] == part and sum(a != b for a, b in zip(seed[off:], s)) < 5:
                    for p, (c, w) in enumerate(zip(s, q)):
                        if off + p < len(votes) and c in votes[off + p]:
                            votes[off + p][c] += ord(w) - 33
        text = "".join("N" if not any(v.values()) else max((w, b) for b, w in v.items())[1] for v in votes)
        total += text[: n // 2]
        seed = text[n // 2 : n // 2 + n]
        if end and end in total:
            return total[: total.index(end) + len(end)], True
        if len(total) > maxlen:
            return total, False


def test_stitch_matches_brute_force(spark):
    rng = random.Random(11)
    g = rand_seq(rng, 700)
    reads = []
    for i in range(900):
        p = rng.randrange(len(g) - 120)
        s = list(g[p : p + 120])
        if i % 4 == 0:
            s[rng.randrange(120)] = rng.choice("ACGT")
        s = "".join(s)
        reads.append((s if i % 2 else rc(s), "".join(chr(33 + rng.randrange(5, 40)) for _ in range(120))))
    df = spark.createDataFrame([(i, 1, s, q) for i, (s, q) in enumerate(reads)], "pair_id long, mate int, nucs string, qual string")
    seeds = {"a": g[20:120], "b": g[100:180]}
    end = g[330:350]
    out = prefixes.stitch(spark.createDataFrame(list(seeds.items()), "seed_id string, seed string"), df, end=end, maxlen=400)
    got = {r.seed_id: (r.consensus, r.found_end) for r in out.collect()}
    assert got == {k: brute_stitch(s, reads, end, 400) for k, s in seeds.items()}
    assert got["a"] == (g[20:350], True)


@pytest.mark.parametrize("slice_rows", [10_000, 7])
def test_a_prefix_in_half_of_the_reads_is_sliced(spark, slice_rows):
    rng = random.Random(23)
    entry = rand_seq(rng, 120)
    texts = []
    for n in range(120):
        # Half of the reads share their first 35 bases; most of those differ behind them.
        at = 20 if n % 2 else rng.randrange(0, 60)
        t = list(entry[at : at + 60])
        for i in rng.sample(range(35, 60), rng.choice((0, 1, 1, 2, 5))):
            t[i] = "ACGT"["ACGT".index(t[i]) ^ 1]
        texts.append((n, 1, "".join(t) if n % 3 else rc("".join(t)), "".join(rng.choice("5AI") for _ in t)))
    reads = spark.createDataFrame([*texts, (500, 1, "ACGT", "IIII"), (501, 1, None, None)], "pair_id long, mate int, nucs string, qual string")
    entries = spark.createDataFrame([(1, entry), (2, entry[:40] + "N" + entry[41:]), (3, "ACGT"), (4, None)], "id long, nucs string")
    want = {}
    for e, text in ((1, entry), (2, entry[:40] + "N" + entry[41:])):
        for n in range(len(text) - 35):
            rest = text[n:]
            if "N" in rest:
                continue
            fit = [
                (p, m, r, t)
                for p, m, nucs, _ in texts
                for r, t in ((False, nucs), (True, rc(nucs)))
                if t[:35] == rest[:35] and sum(x != y for x, y in zip(t, rest)) < 2
            ]
            if fit:
                want[e, n] = min(fit)
    got = {(r.id, r.n): (r.pair_id, r.mate, r.reverse, r.read) for r in prefixes.rrna_matches(entries, reads, slice_rows=slice_rows).collect()}
    assert got == want and any(n == 20 for _, n in want)


# --- self-reference encoding --------------------------------------------------


def brute_best(genome_text, u, longest):
    unit = genome_text[u : u + 16]
    best = None
    for m in range(u):
        at = genome_text[m : m + 16]
        if len(at) < 16:
            continue
        if at == unit:
            rev, text = False, genome_text[m : m + longest]
        elif rc(at) == unit:
            rev, text = True, rc(genome_text[max(0, m + 16 - longest) : m + 16])
        else:
            continue
        n, e = selfref.extend(genome_text[u : u + longest], text, longest)
        key = (-n, e, m, rev)
        best = key if best is None or key < best else best
    return best


def brute_encode(g, longest):
    beg, steps = 0, []
    while beg < len(g):
        options = []
        for j in range(6):
            u = beg + 16 * j
            b = brute_best(g, u, longest) if u + 16 <= len(g) else None
            if b:
                options.append((-b[0] // 4 - 9 - b[1], -j, b))
        if options:
            gain, j, b = max(options, key=lambda o: o[:2])
            cost, step = -j * 4 + 9 + b[1], -j * 16 - b[0]
        if not options or step < 4 * cost:
            cost, step, b = 24, 96, None
        steps.append((beg, b and b[2], b and b[3], cost, step))
        beg += step
    return steps


def test_encoding_matches_brute_force(spark):
    rng = random.Random(13)
    a = rand_seq(rng, 400)
    mutated = list(a[60:330])
    for i in (70, 150, 220):
        mutated[i] = "ACGT"["ACGT".index(mutated[i]) ^ 1]
    g = a + "".join(mutated) + rc(a[100:300]) + rand_seq(rng, 100) + a[40:240]
    chunks = chunked(spark, {"r": g}, 32)
    steps, totals = selfref.encode(chunks, 32, genome.with_offsets(genome.chromosomes(chunks)), longest=64, block=256)
    got = [(r.pos, r.at, r.reverse, r.cost, r.step) for r in steps.orderBy("pos").collect()]
    want = brute_encode(g, 64)
    assert got == want
    assert any(s[2] for s in want) and any(s[2] is False for s in want)
    t = totals.first()
    assert (t.emitted, t.bases) == (sum(s[3] for s in want), want[-1][0] + want[-1][4])


@pytest.mark.parametrize("bases, longest", [(128, 600), (1 << 15, 8192), (1 << 15, 200)])
def test_references_beyond_the_fine_lengths(spark, monkeypatch, bases, longest):
    monkeypatch.setattr(selfref, "BASES", bases)
    rng = random.Random(17)
    a = rand_seq(rng, 700)
    mutated = list(a)
    for i in range(40, 700, 90):
        mutated[i] = "ACGT"["ACGT".index(mutated[i]) ^ 1]
    del mutated[300]
    g = rand_seq(rng, 50) + a + rc("".join(mutated)) + rand_seq(rng, 37) + a[:640] + rand_seq(rng, 100) + a[:560] + rc(a[100:400])
    chunks = chunked(spark, {"r": g}, 32)
    order = genome.with_offsets(genome.chromosomes(chunks))
    got = {r.pos: (-r.length, r.edits, r.at, r.reverse) for r in selfref.best_references(chunks, 32, order, longest).collect()}
    spots = [*range(0, 750, 150), *range(745, len(g) - 16, 83), 787, 788, 1487, 1488]
    want = {u: b for u in spots if (b := brute_best(g, u, longest))}
    assert {u: b for u, b in got.items() if u in set(spots)} == want
    if longest > 256:
        assert {n for n, *_ in want.values()} >= {-128, -256, -512} and any(e and n <= -256 for n, e, *_ in want.values()) and any(r and n <= -256 for n, _, _, r in want.values())


def test_copies_of_a_long_stretch_do_not_multiply(spark):
    # Places that read the same for all lengths are one candidate, those that differ far behind are not.
    rng = random.Random(4)
    a, b = rand_seq(rng, 400), rand_seq(rng, 64)
    chunks = chunked(spark, {"r": a + b + a + b + a + a + rand_seq(rng, 32)}, 32)
    rows = selfref.stretches(chunks, 32, 256).collect()
    ahead = [x for r in sorted(rows, key=lambda r: r.node) for x in r.ahead]
    assert ahead[0] == ahead[464] == ahead[928] and ahead[144] == ahead[608] and ahead[200] != ahead[1128] and ahead[208] != ahead[209]
    assert selfref.text_ids(np.array([1, 2, 3, 4, 1, 2, 3, 4, 1, 2]), 6).tolist()[0] == selfref.text_ids(np.array([1, 2, 3, 4, 1, 2]), 6).tolist()[0]


def test_j15_searches_for_whole_references(spark, sf_dir, monkeypatch):
    # It was called with 64 bases at most, the operator's own limit is that of the original.
    import __spark_entry__ as entry

    seen = []
    monkeypatch.setattr(selfref, "best_references", lambda chunks, size, order, longest=selfref.LONGEST: seen.append(longest))
    entry.queries()["j15_best_reference"](spark, sf_dir)
    assert seen == [8192]
