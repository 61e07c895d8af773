"""Seeded approximate mapping: three short exact seeds per attempt, then scoring."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from helicase.functions import dna, stacks
from helicase.operators.kmers import expanded, windows
from helicase.sources import genome

SEED = 11
STRIDE = 3
# A candidate with this many confident mismatches is tried for an indel.
INDEL_TRIAL = 5
# Position bins that keep the neighbour search of one seed triple bounded.
BIN = 128
# Most counts of seeds that are sent to every executor.
MAX_COUNTS = 4**11
# Attempts that one task of the pair search holds, and numbers by which first seeds are dealt out.
PAIR_ROWS = 1_000_000
DEALT = 1 << 20


def idiv(a: Column, b: int) -> Column:
    return F.call_function("div", a, F.lit(b))


def attempts(seqs: DataFrame, k: int = SEED) -> DataFrame:
    """Every attempt at every distinct sequence: ``(nucs, gap, shift, reverse, seeds)`` with its three seeds in order.

    Seeds of one attempt start at ``shift``, ``gap + shift`` and ``2*gap +
    shift``; each attempt is made in both orientations.
    """
    sides = F.array(
        F.struct(F.lit(False).alias("reverse"), F.col("nucs").alias("_o")), F.struct(F.lit(True).alias("reverse"), dna.revcomp("nucs").alias("_o"))
    )
    tries = (
        seqs.select("nucs")
        .where((F.length("nucs") >= 3 * k + 3) & ~F.contains(F.col("nucs"), F.lit("N")))
        .select("nucs", idiv(F.length("nucs") - 3 * k, 3).cast("int").alias("gap"), F.inline(sides))
        .withColumn("shift", F.explode(F.sequence(F.lit(0), F.col("gap") - 1, F.lit(STRIDE))))
    )
    seeds = F.array(*[F.substring(F.col("_o"), F.col("gap") * n + F.col("shift") + 1, F.lit(k)) for n in range(3)])
    return tries.select("nucs", "gap", "shift", "reverse", seeds.alias("seeds"))


def seed_hits(seqs: DataFrame, chunks_ext: DataFrame, size: int, k: int = SEED) -> DataFrame:
    """All reference hits of all seeds: ``(nucs, gap, shift, reverse, letter, ref, pos)``; ``seqs`` holds distinct sequences."""
    seeds = attempts(seqs, k).select("nucs", "gap", "shift", "reverse", F.posexplode("seeds").alias("letter", "kmer"))
    index = windows(chunks_ext, size, [k]).select("kmer", "ref", "pos")
    return seeds.join(expanded(index), "kmer").drop("kmer")


def triple_starts(hits: DataFrame) -> DataFrame:
    """Read starts ``(nucs, ref, pos, reverse)`` supported by three neighbouring seeds.

    Among the hits of one attempt in order of (position, letter), first, second
    and third seed must be direct neighbours with both gaps below 1.2 times the
    seed distance. The search runs inside position bins that overlap by the
    longest possible triple, so a seed with millions of hits is spread over as
    many groups.
    """
    reach = F.floor(F.col("gap") * 12 / 5).cast("int") + 1
    own = idiv(F.col("pos"), BIN)
    binned = hits.withColumn(
        "_bin", F.explode(F.when(F.col("pos") % BIN < reach, F.array(own - 1, own)).otherwise(F.array(own)))
    )
    w = W.partitionBy("nucs", "shift", "reverse", "ref", "_bin").orderBy("pos", "letter")
    near = lambda a, b: (b - a) * 5 < F.col("gap") * 6
    return (
        binned.select(
            "nucs", "gap", "shift", "reverse", "ref", "_bin", "pos", "letter",
            F.lead("letter", 1).over(w).alias("_l1"), F.lead("pos", 1).over(w).alias("_p1"),
            F.lead("letter", 2).over(w).alias("_l2"), F.lead("pos", 2).over(w).alias("_p2"),
        )
        .where((F.col("letter") == 0) & (F.col("_l1") == 1) & (F.col("_l2") == 2))
        .where(near(F.col("pos"), F.col("_p1")) & near(F.col("_p1"), F.col("_p2")))
        .where(idiv(F.col("pos"), BIN) == F.col("_bin"))
        .select("nucs", "ref", (F.col("pos") - F.col("shift")).alias("pos"), "reverse")
        .where(F.col("pos") >= 1)
        .distinct()
    )


def rarest_seeds(seqs: DataFrame, chunks_ext: DataFrame, size: int, k: int = SEED) -> DataFrame:
    """Attempts whose seeds all occur, with the least frequent: ``(nucs, gap, shift, reverse, _s0, _s1, _s2, letter, kmer)``.

    Most attempts at a read that belongs nowhere lack a seed and end here, on
    counts, before any place is looked at.
    """
    counts = windows(chunks_ext, size, [k]).groupBy("kmer").agg(F.count("*").alias("n"))
    # There are at most 4^k counts, however long the genome; more than MAX_COUNTS meet the seeds in shuffles.
    counts = F.broadcast(counts) if 4**k <= MAX_COUNTS else expanded(counts)
    tries = attempts(seqs, k).select("nucs", "gap", "shift", "reverse", *[F.col("seeds")[n].alias(f"_s{n}") for n in range(3)])
    for n in range(3):
        tries = tries.join(counts.select(F.col("kmer").alias(f"_s{n}"), F.col("n").alias(f"_n{n}")), f"_s{n}")
    least = F.least(*[F.col(f"_n{n}") * 4 + n for n in range(3)])
    letter = (least % 4).cast("int")
    kmer = F.when(letter == 0, F.col("_s0")).when(letter == 1, F.col("_s1")).otherwise(F.col("_s2"))
    return tries.select("nucs", "gap", "shift", "reverse", "_s0", "_s1", "_s2", letter.alias("letter"), kmer.alias("kmer"))


def surroundings(chunks_ext: DataFrame, size: int, k: int, margin: int) -> DataFrame:
    """Every k-mer with ``margin`` bases on either side: ``(kmer, ref, pos, around, off)``; it stands at the 0-based ``off`` of ``around``."""
    wide = genome.with_overhang(chunks_ext.select("ref", "chunk", "s"), size, 2 * margin + k)
    # A row serves the k-mers that begin `margin` bases behind its own bases; the first of a chromosome those in front as well.
    low = F.when(F.col("chunk") == 0, F.lit(-margin)).otherwise(F.lit(0))
    i, first = F.col("_i"), F.greatest(F.col("_i"), F.lit(0))
    return (
        wide.select("ref", "chunk", "ext", F.explode(F.sequence(low, F.lit(size - 1))).alias("_i"))
        .where(i + margin + k <= F.length("ext"))
        .select(
            F.substring(F.col("ext"), i + margin + 1, F.lit(k)).alias("kmer"),
            "ref",
            (F.col("chunk") * size + i + margin + 1).alias("pos"),
            F.substring(F.col("ext"), first + 1, i - first + 2 * margin + k).alias("around"),
            (i - first + margin).alias("off"),
        )
    )


def rarest_starts(seqs: DataFrame, chunks_ext: DataFrame, size: int, k: int = SEED, longest: int | None = None) -> DataFrame:
    """The rows of :func:`triple_starts` over :func:`seed_hits`, found from the hits of each attempt's rarest seed alone.

    A seed's places carry the bases around them, as far as a triple can reach,
    so both neighbours are read there: a place whose surroundings lack one of
    them goes inside the join, and the other seeds' hits never cross the
    network. ``longest`` bounds the length of the sequences; by default it is
    looked up.
    """
    if longest is None:
        longest = seqs.agg(F.max(F.length("nucs"))).first()[0] or 0
    widest = max((longest - 3 * k) // 3, 1)
    margin = 2 * ((6 * widest - 1) // 5)
    rare = rarest_seeds(seqs, chunks_ext, size, k)
    hits = rare.join(expanded(surroundings(chunks_ext, size, k, margin)), "kmer")
    firsts = [F.call_function("instr", "around", f"_s{n}") for n in range(3)]
    hits = hits.select("*", F.inline(F.array(F.struct(*[f.alias(f"_f{n}") for n, f in enumerate(firsts)]))))
    hits = hits.where((F.col("_f0") > 0) & (F.col("_f1") > 0) & (F.col("_f2") > 0))
    once = F.lit(True)
    for n in range(3):
        once = once & (F.call_function("locate", f"_s{n}", "around", F.col(f"_f{n}") + 1) == 0)
    plain = F.sort_array(F.array(*[(F.col(f"_f{n}") - 1) * 3 + n for n in range(3)]))
    # All hits of the three seeds in order of (place, letter), as one number each.
    text = lambda i: F.substring(F.col("around"), i + 1, F.lit(k))
    at = lambda i: F.concat(*[F.when(text(i) == F.col(f"_s{n}"), F.array(i * 3 + n)).otherwise(F.array().cast("array<int>")) for n in range(3)])
    order = F.when(once, plain).otherwise(F.flatten(F.transform(F.sequence(F.lit(0), F.length("around") - k), at)))

    def neighbours(c):
        head = (F.array_position(c, F.col("off") * 3 + F.col("letter")) - 1 - F.col("letter")).cast("int")
        return F.struct(*[F.get(c, head + n).alias(f"_c{n}") for n in range(3)])

    near = lambda a, b: (idiv(F.col(b), 3) - idiv(F.col(a), 3)) * 5 < F.col("gap") * 6
    return (
        hits.select("nucs", "gap", "shift", "reverse", "ref", "pos", "off", F.inline(F.transform(F.array(order), neighbours)))
        .where((F.col("_c0") % 3 == 0) & (F.col("_c1") % 3 == 1) & (F.col("_c2") % 3 == 2))
        .where(near("_c0", "_c1") & near("_c1", "_c2"))
        .select("nucs", "ref", (F.col("pos") - F.col("off") + idiv(F.col("_c0"), 3) - F.col("shift")).alias("pos"), "reverse")
        .where(F.col("pos") >= 1)
        .distinct()
    )


def repeated_chunks(chunks_ext: DataFrame) -> bool:
    """Whether some chunk was given more than once (or repeats its own bases): its text then does not go on behind its own bases."""
    twice = ~F.startswith(F.col("ext"), F.col("s")) | F.startswith(F.col("ext"), F.concat("s", "s"))
    return bool(chunks_ext.where(F.length("s") > 0).agg(F.max(twice)).first()[0])


def pair_hits(seqs: DataFrame, chunks_ext: DataFrame, size: int, k: int = SEED) -> DataFrame:
    """The read starts of :func:`triple_starts` over :func:`seed_hits` by text hash: ``(text_id, ref, pos, reverse)``, some of them repeated.

    ``text_id`` is the 64-bit hash of ``nucs``. First and second seed are looked up together, so a genome in which every
    single seed stands in many places costs no more per attempt than a small one. Attempts and places are dealt out by their
    first seed, a row for each; only there does a place pair its seed with each one within reach behind it. What a triple
    can span travels with the place, so all neighbours are read in the task.
    """
    spark = seqs.sparkSession
    # Rows dealt by the first seed meet on both seeds where they are; by default Spark would deal out each pair again.
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    longest, rows = seqs.agg(F.max(F.length("nucs")), F.count("*")).first()
    widest = max(((longest or 0) - 3 * k) // 3, 1)
    reach = (6 * widest - 1) // 5
    each = 2 * (1 + (widest - 1) // STRIDE)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows * each // PAIR_ROWS + 1)
    deal = lambda seed: F.pmod(F.xxhash64(seed), F.lit(DEALT)).cast("int").alias("_deal")
    seed = lambda n: F.col("seeds")[n]
    tries = attempts(seqs.distinct(), k)
    if repeated_chunks(chunks_ext):
        # Behind a chunk that stands twice the windows read its text twice; a seed has to be one of the windows.
        known = windows(chunks_ext, size, [k]).select("kmer").distinct()
        for n in range(3):
            tries = expanded(tries).join(known, seed(n) == F.col("kmer"), "left_semi")
    tries = tries.select(
        deal(seed(0)), F.xxhash64(F.concat(seed(0), seed(1))).alias("_pair"), seed(2).alias("_third"), F.xxhash64("nucs").alias("text_id"),
        # one number, as each column of a shuffled row takes 8 bytes at least
        (F.shiftleft(F.col("gap").cast("long"), 32) + F.col("shift") * 2 + F.col("reverse").cast("int")).alias("_try"),
    ).repartition(parts, "_deal")
    # Spans are cut from rows that carry enough following bases, short at the end of a chromosome.
    wide = genome.with_overhang(chunks_ext.select("ref", "chunk", "s"), size, 2 * reach + k)
    i = F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("_i")
    spans = wide.select("ref", (F.col("chunk") * size).alias("_base"), "ext", i).where(F.col("_i") + k <= F.length("ext"))
    spans = spans.select("ref", (F.col("_base") + F.col("_i") + 1).alias("pos"), F.substring(F.col("ext"), F.col("_i") + 1, F.lit(2 * reach + k)).alias("_span"))
    places = spans.select(deal(F.left("_span", F.lit(k))), "ref", "pos", "_span").repartition(parts, "_deal")
    text = lambda at: F.substring(F.col("_span"), at + 1, F.lit(k))
    places = places.select("*", F.explode(F.sequence(F.lit(0), F.least(F.lit(reach), F.length("_span") - k))).alias("_d"))
    places = places.withColumn("_pair", F.xxhash64(F.concat(F.left("_span", F.lit(k)), text(F.col("_d")))))
    met = places.join(tries.hint("shuffle_hash"), ["_deal", "_pair"]).select(
        "ref", "pos", "_span", "_d", "_third", "text_id", F.shiftright("_try", 32).cast("int").alias("gap"),
        (F.shiftright("_try", 1).bitwiseAND(F.lit((1 << 31) - 1))).cast("int").alias("shift"), (F.col("_try") % 2 == 1).alias("reverse"),
    )
    # The next hit of any seed is the second seed's, and the one after it the third seed's, in order of (place, letter).
    d = F.col("_d")
    met = met.withColumn("_at", F.call_function("instr", "_span", "_third") - 1).where((F.col("_at") >= d) & (d * 5 < F.col("gap") * 6) & ((F.col("_at") - d) * 5 < F.col("gap") * 6))
    first, second, at = F.left("_span", F.lit(k)), text(d), F.col("_at")
    later = lambda seed, start: F.call_function("locate", seed, F.col("_span"), start + 1) - 1
    behind = lambda found: (found < 0) | (found > at)
    met = met.where((F.call_function("instr", F.col("_span"), second) - 1 == d) & behind(later(first, F.lit(1))) & behind(later(second, d + 1)))
    return met.select("text_id", "ref", (F.col("pos") - F.col("shift")).alias("pos"), "reverse").where("pos >= 1")


def pair_starts(seqs: DataFrame, chunks_ext: DataFrame, size: int, k: int = SEED) -> DataFrame:
    """The rows of :func:`triple_starts` over :func:`seed_hits`, found by :func:`pair_hits`."""
    texts = seqs.where("nucs IS NOT NULL").select(F.xxhash64("nucs").alias("text_id"), "nucs").distinct()
    found = expanded(texts).join(pair_hits(seqs, chunks_ext, size, k), "text_id")
    return found.select("text_id", "nucs", "ref", "pos", "reverse").distinct().drop("text_id")


def oriented(df: DataFrame, flag: str = "reverse") -> DataFrame:
    """Turn ``nucs`` and ``qual`` to the orientation in which the read maps."""
    f = F.col(flag)
    return df.withColumn("nucs", F.when(f, dna.revcomp("nucs")).otherwise(F.col("nucs"))).withColumn(
        "qual", F.when(f, F.reverse("qual")).otherwise(F.col("qual"))
    )


def mismatch_points(nucs: Column, qual: Column, ref: Column, qlimit: int, low: int) -> Column:
    """Sum over differing bases of 2 where quality exceeds ``qlimit``, else of ``low``.

    Twice the usual weights, so half points stay whole numbers.
    """
    return stacks.mismatch_points(nucs, qual, ref, qlimit, low)


def score_candidates(cands: DataFrame, chunks_ext: DataFrame, size: int, qlimit: int = 30, indels: bool = True) -> DataFrame:
    """Score = confident mismatches; five or more become 1 if one clear indel explains them.

    ``cands`` carries the read (``nucs``, ``qual``) next to ``ref, pos, reverse``.
    Only rows over the threshold are tried for an indel.
    """
    j = oriented(genome.snippets(cands, chunks_ext, size, F.length("nucs"), "_ref"))
    points = mismatch_points(F.col("nucs"), F.col("qual"), F.col("_ref"), qlimit, 0)
    j = j.withColumn("score", idiv(points, 2).cast("int"))
    if indels:
        hard = F.col("score") >= INDEL_TRIAL
        j = dna.with_indel(j, "nucs", "_ref", hard)
        j = j.withColumn("score", F.when(F.col("indel") != 0, 1).otherwise(F.col("score"))).drop("indel", "amount")
    return j.drop("_ref", "nucs", "qual")


def seeded_matches(
    reads: DataFrame, chunks_ext: DataFrame, size: int, k: int = SEED, qlimit: int = 30, indels: bool = True,
    stage: Callable[[DataFrame, str], DataFrame] = lambda df, name: df,
) -> DataFrame:
    """Scored candidates ``(pair_id, mate, ref, pos, reverse, score)`` of reads without an exact match.

    Seeds are searched once per distinct sequence, so copies of a read cost
    nothing until scoring, where each copy has its own qualities. ``stage``
    receives the starts that the search found, so that what it shuffled may go
    before candidates are scored.
    """
    starts = stage(pair_hits(reads.select("nucs"), chunks_ext, size, k).distinct(), "starts")
    cands = expanded(reads.select("pair_id", "mate", "nucs", "qual", F.xxhash64("nucs").alias("text_id"))).join(starts, "text_id").drop("text_id")
    return score_candidates(cands, chunks_ext, size, qlimit, indels).select(
        "pair_id", "mate", "ref", "pos", "reverse", "score"
    )
