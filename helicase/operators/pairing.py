"""Choosing where reads go: pairs first, single mates second."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from helicase.operators.seeds import idiv

MAX_PAIR_SPAN = 1400


def limit_duplicates(reads: DataFrame, limit: int) -> DataFrame:
    """Keep the first ``limit`` copies of each sequence in read order; 0 keeps all.

    The rank filter makes Spark thin every map task's own rows to ``limit`` per
    sequence before the shuffle, so a sequence with any number of copies sends
    only a few rows to its task.
    """
    if limit <= 0:
        return reads
    w = W.partitionBy("nucs").orderBy("pair_id", "mate")
    return reads.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= limit).drop("_rn")


def pair_candidates(cands: DataFrame, span: int = MAX_PAIR_SPAN) -> DataFrame:
    """All mate combinations in opposite orientation less than ``span`` apart on one chromosome.

    A band join on position bins of the span's width: one mate is sent to its
    bin and both neighbours, the other to its own, so partners per candidate are
    limited by the span and not by the number of hits of the pair.
    """
    own = idiv(F.col("pos"), span)
    c = cands.select("pair_id", "mate", "ref", "pos", "reverse", "score")
    one = c.where("mate = 1").select(
        "pair_id", "ref", F.explode(F.array(own - 1, own, own + 1)).alias("_bin"),
        F.col("pos").alias("pos1"), F.col("reverse").alias("reverse1"), F.col("score").alias("score1"),
    )
    two = c.where("mate = 2").select(
        "pair_id", "ref", own.alias("_bin"),
        F.col("pos").alias("pos2"), F.col("reverse").alias("reverse2"), F.col("score").alias("score2"),
    )
    return (
        one.join(two, ["pair_id", "ref", "_bin"])
        .where((F.col("reverse1") != F.col("reverse2")) & (F.abs(F.col("pos1") - F.col("pos2")) < span))
        .drop("_bin")
    )


def best_pairs(pairs: DataFrame) -> DataFrame:
    """Lowest score sum per pair; ties go to the lowest (ref, pos1, pos2, reverse1)."""
    key = F.struct(
        (F.col("score1") + F.col("score2")).alias("score"), "ref", "pos1", "pos2", "reverse1", "score1", "score2"
    )
    return (
        pairs.groupBy("pair_id")
        .agg(F.min(key).alias("b"))
        .select("pair_id", "b.*")
        .withColumn("reverse2", ~F.col("reverse1"))
    )


def pair_distances(best: DataFrame, reads: DataFrame) -> DataFrame:
    """Adds ``distance``: first read's length plus the signed offset of its mate."""
    len1 = reads.where("mate = 1").select("pair_id", F.length("nucs").alias("_len1"))
    offset = F.when(F.col("reverse2"), F.col("pos2") - F.col("pos1")).otherwise(F.col("pos1") - F.col("pos2"))
    return best.join(len1, "pair_id").withColumn("distance", (F.col("_len1") + offset).cast("long")).drop("_len1")


def distance_histogram(distances: DataFrame) -> DataFrame:
    """Count per distance, negative ones included."""
    return distances.groupBy("distance").agg(F.count("*").alias("n"))


def best_singles(cands: DataFrame) -> DataFrame:
    """Lowest score per mate; ties go to the lowest (ref, pos, reverse)."""
    key = F.struct("score", "ref", "pos", "reverse")
    return cands.groupBy("pair_id", "mate").agg(F.min(key).alias("b")).select("pair_id", "mate", "b.*")


def placements(cands: DataFrame) -> DataFrame:
    """One row per placed read: ``(pair_id, mate, ref, pos, reverse, score, paired, mate_pos)``.

    Good pairs place both mates; the mates of all other pairs are placed each on
    its own best candidate. Candidates are dealt out once, by their pair; position
    bins, pairs and mates are groups inside.
    """
    # Rows dealt by the pair meet in their bins where they are; by default Spark would deal them out again for every join.
    cands.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    cands = cands.repartition("pair_id")
    best = best_pairs(pair_candidates(cands))
    side = lambda m: F.struct(
        F.lit(m).alias("mate"), "ref", F.col(f"pos{m}").alias("pos"), F.col(f"reverse{m}").alias("reverse"),
        F.col(f"score{m}").alias("score"), F.lit(True).alias("paired"), F.col(f"pos{3 - m}").alias("mate_pos"),
    )
    both = best.select("pair_id", F.inline(F.array(side(1), side(2))))
    rest = best_singles(cands.join(best.select("pair_id"), "pair_id", "left_anti"))
    alone = rest.withColumn("paired", F.lit(False)).withColumn("mate_pos", F.lit(None).cast("long"))
    return both.unionByName(alone.select(both.columns))


def unplaced(reads: DataFrame, placed: DataFrame) -> DataFrame:
    """Reads that found no place at all."""
    return reads.join(placed.select("pair_id", "mate"), ["pair_id", "mate"], "left_anti")
