"""Overlap merging of read pairs and strand-aware read search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from helicase.functions import dna

MIN_OVERLAP = 20


def pair_rows(reads: DataFrame) -> DataFrame:
    """``(pair_id, one, two)`` from long-form reads; pairs end with mate 1."""
    one = reads.where("mate = 1").select("pair_id", F.col("nucs").alias("one"))
    two = reads.where("mate = 2").select("pair_id", F.col("nucs").alias("two"))
    return one.join(two, "pair_id", "left").withColumn("two", F.coalesce("two", F.lit("")))


def merge_pairs(pairs: DataFrame, least: int = MIN_OVERLAP) -> DataFrame:
    """Adds ``overlap`` and ``merged`` (null where mates do not overlap).

    The second mate is turned first. If the first mate begins with the end of
    the turned mate, the turned mate is the result; otherwise the first mate's
    end may continue into it. The longest overlap wins.
    """
    inv = dna.revcomp("two")
    p = pairs.withColumn("_inv", inv)
    n = F.least(F.length("one"), F.length("_inv"))
    lengths = F.when(n >= least, F.sequence(F.lit(least), n)).otherwise(F.array().cast("array<int>"))
    # Any overlap holds the first or last bases of the first mate whole, so most
    # pairs are settled by one substring search.
    near = lambda end: F.contains(F.col("_inv"), end)
    ahead = F.when(
        near(F.left("one", F.lit(least))),
        F.array_max(F.filter(lengths, lambda o: F.left("one", o) == F.right("_inv", o))),
    )
    behind = F.when(
        near(F.right("one", F.lit(least))),
        F.array_max(F.filter(lengths, lambda o: F.right("one", o) == F.left("_inv", o))),
    )
    found = F.struct(F.col("_inv"), ahead.alias("_a"), behind.alias("_b"))
    # One-element generator: later filters do not repeat the search.
    p = p.select(*pairs.columns, F.inline(F.array(found)))
    return p.select(
        *pairs.columns,
        F.coalesce("_a", "_b").alias("overlap"),
        F.when(F.col("_a").isNotNull(), F.col("_inv"))
        .when(F.col("_b").isNotNull(), F.concat("one", F.substring(F.col("_inv"), F.col("_b") + 1, F.length("_inv"))))
        .alias("merged"),
    )


def overlap_histogram(merged: DataFrame) -> DataFrame:
    """Merged pairs per overlap length."""
    return merged.where("overlap is not null").groupBy("overlap").agg(F.count("*").alias("n"))


def search_hit(nucs: Column, pattern: str) -> tuple[Column, Column]:
    """(strand, text from the hit on) of a pattern; the forward strand wins."""
    turned = dna.revcomp(nucs)
    fwd, rev = F.instr(nucs, F.lit(pattern)), F.instr(turned, F.lit(pattern))
    strand = F.when(fwd > 0, "F").when(rev > 0, "R")
    text = F.when(fwd > 0, F.substring(nucs, fwd, F.length(nucs))).when(rev > 0, F.substring(turned, rev, F.length(nucs)))
    return strand, text


def grep_reads(reads: DataFrame, pattern: str, column: str = "nucs") -> DataFrame:
    """Reads that contain ``pattern`` on either strand, with ``strand`` and ``hit``."""
    strand, text = search_hit(F.col(column), pattern)
    return reads.withColumn("strand", strand).withColumn("hit", text).where("strand is not null")


def grep_pairs(merged: DataFrame, pattern: str) -> DataFrame:
    """Search merged pairs once and the mates of all others each: ``(pair_id, part, strand, hit)``."""
    parts = F.when(
        F.col("merged").isNotNull(), F.array(F.struct(F.lit("merged").alias("part"), F.col("merged").alias("nucs")))
    ).otherwise(
        F.array(
            F.struct(F.lit("1").alias("part"), F.col("one").alias("nucs")),
            F.struct(F.lit("2").alias("part"), F.col("two").alias("nucs")),
        )
    )
    return grep_reads(merged.select("pair_id", F.inline(parts)), pattern).drop("nucs")
