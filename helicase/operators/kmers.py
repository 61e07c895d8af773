"""K-mer indexes and the joins that probe them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from helicase.functions import dna


def windows(chunks_ext: DataFrame, size: int, ks: list[int], step: int = 1) -> DataFrame:
    """Every full window of each length in ``ks``: ``(ref, pos, k, kmer)``.

    ``ks`` is a short literal list, so the explode is a constant factor per base.
    """
    w = chunks_ext.select(
        "ref",
        "chunk",
        "ext",
        F.explode(F.sequence(F.lit(0), F.lit(size - 1), F.lit(step))).alias("_i"),
    ).where(F.col("_i") < F.length("s") if "s" in chunks_ext.columns else F.lit(True))
    w = w.select("ref", (F.col("chunk") * size + F.col("_i") + 1).alias("pos"), "ext", "_i")
    k = F.explode(F.array(*[F.lit(x) for x in ks])).alias("k")
    return (
        w.select("ref", "pos", "ext", "_i", k)
        .withColumn("kmer", F.substring(F.col("ext"), F.col("_i") + 1, F.col("k")))
        .where(F.length("kmer") == F.col("k"))
        .select("ref", "pos", "k", "kmer")
    )


def turned_windows(chunks_ext: DataFrame, size: int, ks: list[int]) -> DataFrame:
    """:func:`windows` with the reverse complement beside each: ``(ref, pos, k, kmer, rc)``, cut from that of its chunk, which is made once."""
    w = chunks_ext.withColumn("_turned", dna.revcomp("ext"))
    w = w.select("*", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("_i")).where(F.col("_i") < F.length("s") if "s" in chunks_ext.columns else F.lit(True))
    w = w.select("*", F.explode(F.array(*[F.lit(x) for x in ks])).alias("k"))
    i, k = F.col("_i"), F.col("k")
    return w.where(i + k <= F.length("ext")).select(
        "ref", (F.col("chunk") * size + i + 1).alias("pos"), "k",
        F.substring(F.col("ext"), i + 1, k).alias("kmer"), F.substring(F.col("_turned"), F.length("_turned") - i - k + 1, k).alias("rc"),
    )


def expanded(df: DataFrame) -> DataFrame:
    """Mark a side whose rows multiply behind the scan.

    Spark sizes such a side by the file below it, a hundred times too small, and
    would broadcast it through the driver; a merge join has no such bound to
    get wrong.
    """
    return df.hint("merge")


def exact_matches(reads: DataFrame, chunks_ext: DataFrame, size: int, lengths: list[int], how: str = "inner") -> DataFrame:
    """Places where a whole read equals the reference, in either orientation.

    Both sides are keyed on the smaller of sequence and reverse complement, so
    reads and windows cross the network once and not once per orientation. A
    sequence that equals its own reverse complement matches both ways.
    Rows: the read's columns plus ``ref, pos, reverse``; with ``how='left'`` reads
    without a match keep one row with nulls. Sequences meet on two 64-bit hashes
    of different seeds, 128 bits in all, so that no window's text is shuffled.
    Reads that cannot match never enter the join, so they do not pile up under a
    null key.
    """
    both = lambda key: [F.xxhash64(key).alias("_h"), F.xxhash64(F.lit(1), key).alias("_h2")]
    canonical = F.least("kmer", "rc")
    idx = turned_windows(chunks_ext, size, lengths).select(*both(canonical), (canonical != F.col("kmer")).alias("_wflip"), "ref", "pos")
    rc = dna.revcomp("nucs")
    fits = F.length("nucs").isin([int(x) for x in lengths]) & ~F.contains(F.col("nucs"), F.lit("N"))
    probe = (
        reads.where(fits)
        .withColumn("_key", F.least("nucs", rc))
        .select(*reads.columns, *both(F.col("_key")), (F.col("_key") != F.col("nucs")).alias("_rflip"), (F.col("nucs") == rc).alias("_palindrome"))
    )
    j = probe.join(expanded(idx), ["_h", "_h2"], how)
    palindrome = F.col("_palindrome")
    turns = (
        F.when(F.col("pos").isNull(), F.array(F.lit(None).cast("boolean")))
        .when(palindrome, F.array(F.lit(False), F.lit(True)))
        .otherwise(F.array(F.col("_rflip") != F.col("_wflip")))
    )
    hits = j.withColumn("reverse", F.explode(turns)).select(*reads.columns, "ref", "pos", "reverse")
    if how == "inner":
        return hits
    none = reads.where(~fits).select(
        "*",
        F.lit(None).cast("string").alias("ref"),
        F.lit(None).cast("long").alias("pos"),
        F.lit(None).cast("boolean").alias("reverse"),
    )
    return hits.unionByName(none)


def kmer_counts(kmers: DataFrame) -> DataFrame:
    """Canonical k-mer counts, split into forward and reverse occurrences.

    Canonical means smaller in 2-bit storage order; a palindrome counts as
    reverse, as it does not sort before itself.
    """
    fwd = dna.is_canonical_packed("kmer")
    return (
        kmers.select(F.when(fwd, F.col("kmer")).otherwise(dna.revcomp("kmer")).alias("kmer"), fwd.alias("_f"))
        .groupBy("kmer")
        .agg(F.count_if("_f").alias("canon"), F.count_if(~F.col("_f")).alias("anticanon"))
        .withColumn("n", F.col("canon") + F.col("anticanon"))
    )


def top_kmers(counts: DataFrame, limit: int = 1 << 20, min_count: int = 2) -> DataFrame:
    """The ``limit`` most frequent k-mers with the exclusive running total.

    ``limit`` is the report's own size, so the final single-partition window
    runs over at most that many rows.
    """
    top = (
        counts.where(F.col("n") >= min_count)
        .orderBy(F.desc("n"), "kmer")
        .limit(limit)
    )
    w = W.orderBy(F.desc("n"), "kmer").rowsBetween(W.unboundedPreceding, -1)
    return top.select(
        "kmer",
        dna.revcomp("kmer").alias("rc"),
        "canon",
        "anticanon",
        F.coalesce(F.sum("n").over(w), F.lit(0)).alias("cumul"),
    )


def lookup_positions(queries: DataFrame, kmers: DataFrame, before: Column | None = None) -> DataFrame:
    """Positions of each query k-mer on either strand: adds ``pos, reverse``.

    ``queries`` carries ``kmer``; ``before`` may bound the position by a
    column of the query row.
    """
    q = queries.withColumn("_key", dna.canonical("kmer"))
    k = kmers.select(dna.canonical("kmer").alias("_key"), F.col("kmer").alias("_hit"), "ref", "pos")
    j = q.join(expanded(k), "_key")
    if before is not None:
        j = j.where(F.col("pos") < before)
    return j.withColumn("reverse", F.col("_hit") != F.col("kmer")).drop("_key", "_hit")


def earlier_places(kmers: DataFrame, order: DataFrame) -> DataFrame:
    """All places of each k-mer, on either strand, in front of it in the whole genome: ``(ref, pos, hit_ref, hit_pos, reverse)``.

    ``kmers(kmer, ref, pos)``; ``order(ref, offset)`` places chromosomes in the concatenated genome, so hits may lie on other chromosomes.
    """
    placed = kmers.join(order.select("ref", "offset"), "ref").select("kmer", "ref", "pos", (F.col("pos") + F.col("offset")).alias("place"))
    queries = placed.select(F.col("kmer").alias("kmer"), F.col("ref").alias("_ref"), F.col("pos").alias("_pos"), "place")
    hits = lookup_positions(queries, placed.select("kmer", F.struct("ref", "pos").alias("ref"), F.col("place").alias("pos")), F.col("place"))
    return hits.select(F.col("_ref").alias("ref"), F.col("_pos").alias("pos"), F.col("ref.ref").alias("hit_ref"), F.col("ref.pos").alias("hit_pos"), "reverse")


def single_change_upgrades(counts: DataFrame, k: int, count: int = 2) -> DataFrame:
    """K-mers seen ``count`` times that one substitution, or turning round, makes more frequent.

    ``counts(kmer, n)``; returns ``(kmer, best)`` with the highest count reached.
    A k-mer has ``3k`` neighbours, so the probe side grows by a constant factor.
    """
    at = F.sequence(F.lit(1), F.lit(k))
    near = F.flatten(
        F.transform(
            at,
            lambda i: F.transform(
                F.array(*[F.lit(b) for b in dna.BASES]),
                lambda b: F.concat(F.left(F.col("kmer"), i - 1), b, F.substring(F.col("kmer"), i + 1, F.lit(k))),
            ),
        )
    )
    turned = dna.revcomp("kmer")
    probe = counts.where(F.col("n") == count).select(
        "kmer", turned.alias("_rc"), F.explode(F.concat(F.array(turned), near)).alias("_other")
    ).where(F.col("_other") != F.col("kmer"))
    other = counts.select(F.col("kmer").alias("_other"), F.col("n").alias("_m"))
    return (
        expanded(probe).join(other, "_other")
        .where((F.col("_m") > count) | (F.col("_other") == F.col("_rc")))
        .groupBy("kmer")
        .agg(F.max("_m").alias("best"))
    )
