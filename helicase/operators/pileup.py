"""Applying placements: realigned reads and their bases laid over the reference."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from helicase.functions import dna, stacks
from helicase.operators.kmers import expanded
from helicase.operators.seeds import idiv, mismatch_points, oriented
from helicase.sources import genome

# A placement maps while its mismatch points stay below this; half points for
# bases of low quality.
MAX_POINTS = 5
DELETED_QUALITY = 40
# Depth is summed up inside bins of so many positions.
DEPTH_BIN = 1024


def realign(placed: DataFrame, reads: DataFrame, chunks_ext: DataFrame, size: int, qlimit: int = 30, indels: bool = True, near: int = 0) -> DataFrame:
    """Lay each placed read on the reference.

    Adds the oriented ``nucs`` and ``qual``, the reference text ``ref_bases``,
    ``indel`` and ``amount``, ``inserted`` (bases cut out of the read), ``ok``
    (counts as mapped) and ``read_len``. A read with one clear insertion loses
    the extra bases; one with a clear deletion gets ``X`` of quality 40 in their
    place. With ``near`` the reads that begin in a stretch of about so many
    positions end up in one task.
    """
    j = placed.join(reads.select("pair_id", "mate", "name", "nucs", "qual"), ["pair_id", "mate"])
    j = oriented(genome.snippets(j, chunks_ext, size, F.length("nucs"), "ref_bases", near))
    points = mismatch_points(F.col("nucs"), F.col("qual"), F.col("ref_bases"), qlimit, 1)
    j = j.withColumn("points", points).withColumn("read_len", F.length("nucs"))
    close = F.col("points") < 2 * MAX_POINTS
    if indels:
        j = dna.with_indel(j, "nucs", "ref_bases", ~close)
    else:
        j = j.withColumn("indel", F.lit(0)).withColumn("amount", F.lit(0))
    i, a, n = F.col("indel"), F.col("amount"), F.col("read_len")
    j = j.withColumn("inserted", F.when(i > 0, F.substring(F.col("nucs"), i + 1, a)))
    j = j.withColumn("inserted_q", F.when(i > 0, F.ascii(F.substring(F.col("qual"), i + 1, F.lit(1))) - 33))

    def edited(col, filler):
        c = F.col(col)
        cut = F.concat(F.left(c, i), F.substring(c, i + a + 1, n))
        stretched = F.concat(F.left(c, -i), F.repeat(F.lit(filler), a), F.substring(c, -i + 1, n))
        return F.when(i > 0, cut).when(i < 0, stretched).otherwise(c)

    return (
        j.withColumn("nucs", edited("nucs", "X"))
        .withColumn("qual", edited("qual", chr(DELETED_QUALITY + 33)))
        .withColumn("ok", close | (i != 0))
        .drop("points")
    )


def bases(aligned: DataFrame) -> DataFrame:
    """One row per aligned base: ``(ref, pos, base, ref_base, q, ok, head, read_pos)``.

    ``head`` tells whether the base lies in the first half of the read as
    sequenced on the forward strand, or the second half on the reverse strand.
    """
    n = F.least(F.length("nucs"), F.length("ref_bases"))
    cut = lambda c: F.split(F.left(F.col(c), n), "")
    zipped = F.arrays_zip(cut("nucs").alias("b"), cut("qual").alias("q"), cut("ref_bases").alias("r"))
    e = aligned.where(n > 0).select(
        "ref", "pos", "reverse", "ok", F.length("nucs").alias("_n"), F.length("ref_bases").alias("_m"),
        F.posexplode(zipped).alias("_i", "_z"),
    )
    i = F.col("_i")
    return e.select(
        "ref",
        (F.col("pos") + i).alias("pos"),
        F.col("_z.b").alias("base"),
        F.col("_z.r").alias("ref_base"),
        (F.ascii("_z.q") - 33).alias("q"),
        "ok",
        (F.col("reverse") != (i > idiv(F.col("_n"), 2))).alias("head"),
        F.when(F.col("reverse"), F.col("_m") - 1 - i).otherwise(i).alias("read_pos"),
    )


def coverage(base_rows: DataFrame, qlimit: int = 30) -> DataFrame:
    """Depth per position: matching bases of sufficient quality. Sparse: no zero rows."""
    return (
        base_rows.where((F.col("base") == F.col("ref_base")) & (F.col("q") > qlimit))
        .groupBy("ref", "pos")
        .agg(F.count("*").alias("depth"))
    )


def depth_runs(aligned: DataFrame, qlimit: int = 30) -> DataFrame:
    """Stretches of equal depth ``(ref, bin, pos, stop, depth)``, ``stop`` excluded; they tile every bin that a read touches, zero included.

    A read sends +1 where a stretch of matching bases of sufficient quality begins and -1 where it ends; one that reaches
    into the next bin begins there anew, so bins need nothing from their neighbours. Changes add up per position before they are
    shuffled, and a bin has at most ``DEPTH_BIN`` rows, however deep it is.
    """
    start = lambda b: b * DEPTH_BIN + 1
    laid = aligned.where((F.length("nucs") > 0) & (F.length("ref_bases") > 0))
    laid = laid.select("ref", F.col("pos").cast("long").alias("pos"), "nucs", "qual", "ref_bases")
    changes = laid.mapInArrow(stacks.depth_changes(qlimit, DEPTH_BIN), "ref string, at long, change long")
    summed = (
        changes.groupBy("ref", genome.chunk_of(F.col("at"), DEPTH_BIN).alias("bin"), F.col("at").alias("pos"))
        .agg(F.sum("change").alias("_change"))
        .where((F.col("_change") != 0) | ((F.col("pos") - 1) % DEPTH_BIN == 0))
    )
    w = W.partitionBy("ref", "bin").orderBy("pos")
    return summed.select(
        "ref", "bin", "pos", F.coalesce(F.lead("pos").over(w), start(F.col("bin") + 1)).alias("stop"), F.sum("_change").over(w).alias("depth")
    )


def run_positions(runs: DataFrame) -> DataFrame:
    """Depth per position of :func:`depth_runs`. Sparse: no zero rows."""
    r = runs.where("depth > 0").select("ref", F.explode(F.sequence("pos", F.col("stop") - 1)).alias("pos"), "depth")
    return expanded(r)


def dense_coverage(cov: DataFrame, chunks: DataFrame, size: int) -> DataFrame:
    """Depth of every reference position, zero included: ``(ref, pos, base, depth)``."""
    return (
        genome.positions(chunks, size)
        .join(cov, ["ref", "pos"], "left")
        .withColumn("depth", F.coalesce("depth", F.lit(0).cast("long")))
    )


def differences(base_rows: DataFrame, aligned: DataFrame | None = None, qlimit: int = 30) -> DataFrame:
    """Samples that differ from the reference: ``(ref, pos, base, q, head, inserted)``.

    Substitutions and deleted bases (``X``) come from the base rows, insertions
    from the realigned reads.
    """
    subs = base_rows.where((F.col("base") != F.col("ref_base")) & (F.col("q") > qlimit) & F.col("ok")).select(
        "ref", "pos", "base", "q", "head", F.lit(None).cast("string").alias("inserted")
    )
    if aligned is None:
        return subs
    ins = aligned.where(F.col("indel") > 0).select(
        "ref",
        (F.col("pos") + F.col("indel")).alias("pos"),
        F.left("inserted", F.lit(1)).alias("base"),
        F.col("inserted_q").alias("q"),
        (F.col("reverse") != (F.col("indel") > idiv(F.col("read_len"), 2))).alias("head"),
        "inserted",
    )
    return subs.unionByName(ins)


def quality_counts(base_rows: DataFrame) -> DataFrame:
    """Bases of mapped reads that agree and differ: ``(q, read_pos, good, bad)``."""
    hit = F.col("base") == F.col("ref_base")
    return base_rows.where("ok").groupBy("q", "read_pos").agg(F.count_if(hit).alias("good"), F.count_if(~hit).alias("bad"))


def quality_calibration(counts: DataFrame) -> DataFrame:
    """Observed Q per reported Q from :func:`quality_counts`: ``(q, observed, n)``; 41 without errors, 0 without hits."""
    good, bad = F.col("good"), F.col("bad")
    return (
        counts.groupBy("q")
        .agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
        .select(
            "q",
            F.when(good == 0, F.lit(0.0))
            .when(bad == 0, F.lit(41.0))
            .otherwise(-10.0 * F.log10(F.nullif(bad, F.lit(0)) / (good + bad)))
            .alias("observed"),
            (good + bad).alias("n"),
        )
    )


def quality_by_position(counts: DataFrame) -> DataFrame:
    """Empirical Q per read position from :func:`quality_counts`, where both right and wrong bases were seen."""
    return (
        counts.groupBy("read_pos")
        .agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
        .where((F.col("good") > 0) & (F.col("bad") > 0))
        .select("read_pos", (-10.0 * F.log10(F.col("bad") / (F.col("good") + F.col("bad")))).alias("observed"))
    )
