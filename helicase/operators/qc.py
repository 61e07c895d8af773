"""Quality control over reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from helicase.functions import dna

KMER = 4


def _whole():
    """Window for totals over results that are already small.

    Those have a row per Q, length or read position; reads or bases never pass
    through it.
    """
    return W.partitionBy()


def per_base(reads: DataFrame, *keep: str) -> DataFrame:
    """One row per base: ``(i, base, q)`` with the 0-based read position."""
    z = F.arrays_zip(F.split("nucs", "").alias("b"), F.split("qual", "").alias("q"))
    return (
        reads.where(F.length("nucs") > 0)
        .select(*keep, F.posexplode(z).alias("i", "_z"))
        .select(*keep, "i", F.col("_z.b").alias("base"), (F.ascii("_z.q") - 33).alias("q"))
    )


def _phred(x):
    return -10.0 * F.log10(x)


def quality_by_position(reads: DataFrame) -> DataFrame:
    """Mean error as Q per read position with its range.

    Position and Q are counted first, so the shuffle carries a row per
    (position, Q) and not per base.
    """
    counts = per_base(reads).groupBy("i", "q").agg(F.count("*").alias("n"))
    return _error_stats(counts, "i")


def _error_stats(counts: DataFrame, *keys: str) -> DataFrame:
    err = dna.q_to_err("q")
    mean = F.col("_e") / F.col("_n")
    var = F.col("_e2") / F.col("_n") - mean * mean
    return (
        counts.groupBy(*keys)
        .agg(
            F.sum("n").alias("_n"),
            F.sum(F.col("n") * err).alias("_e"),
            F.sum(F.col("n") * err * err).alias("_e2"),
        )
        .select(
            *keys,
            F.col("_n").alias("n"),
            _phred(mean).alias("quality"),
            F.when(var > 0, _phred(mean) - F.sqrt(_phred(var))).alias("lo"),
            F.when(var > 0, _phred(mean) + F.sqrt(_phred(var))).alias("hi"),
        )
    )


def quality_overall(reads: DataFrame) -> DataFrame:
    """The same statistics over all bases, one row."""
    return _error_stats(per_base(reads).groupBy("q").agg(F.count("*").alias("n")))


def quality_histogram(reads: DataFrame) -> DataFrame:
    """Share of bases per Q."""
    counts = per_base(reads).groupBy("q").agg(F.count("*").alias("n"))
    return counts.select("q", (F.col("n") / F.sum("n").over(_whole())).alias("share"))


def read_lengths(reads: DataFrame) -> DataFrame:
    return reads.groupBy(F.length("nucs").alias("length")).agg(F.count("*").alias("n"))


def gc_histogram(reads: DataFrame) -> DataFrame:
    """Reads per number of G and C bases."""
    return reads.groupBy(dna.gc_bases("nucs").alias("gc_bases")).agg(F.count("*").alias("n"))


def reference_gc_histogram(chunks_ext: DataFrame, size: int, k: int) -> DataFrame:
    """GC histogram of windows of ``k`` bases every ``k/4`` bases, quartered.

    The first window starts on the pad in front of base 1; windows at the end
    are cut short.
    """
    step = k // 4
    at = F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("_i")
    first = chunks_ext.where("chunk = 0").select("ref", F.left("ext", F.lit(k - 1)).alias("w"))
    rest = (
        chunks_ext.select("ref", "chunk", "s", "ext", at)
        .where(((F.col("chunk") * size + F.col("_i") + 1) % step == 0) & (F.col("_i") < F.length("s")))
        .select("ref", F.substring(F.col("ext"), F.col("_i") + 1, F.lit(k)).alias("w"))
    )
    return (
        first.unionByName(rest)
        .groupBy("ref", F.round(dna.gc_content("w") * k).cast("int").alias("gc_bases"))
        .agg(F.call_function("div", F.count("*"), F.lit(4)).alias("n"))
    )


def gc_by_position(reads: DataFrame) -> DataFrame:
    """GC ratio per read position; anything but G and C counts against it."""
    gc = F.count_if(F.col("base").isin("G", "C"))
    return per_base(reads).groupBy("i").agg((gc / (F.count("*") + F.lit(0.001))).alias("ratio"))


def kmer_spread(reads: DataFrame, k: int = KMER) -> DataFrame:
    """Coefficient of variation of k-mer counts per read position, over all 4**k k-mers."""
    n = F.length("nucs")
    starts = reads.where(n > k).select(
        "nucs", F.explode(F.sequence(F.lit(0), F.length("nucs") - k - 1)).alias("i")
    )
    counts = (
        starts.select("i", dna.kmer_code(F.substring(F.col("nucs"), F.col("i") + 1, F.lit(k))).alias("code"))
        .groupBy("i", "code")
        .agg(F.count("*").alias("c"))
    )
    cells = 4**k
    mean = F.col("_s") / cells
    return (
        counts.groupBy("i")
        .agg(F.sum("c").alias("_s"), F.sum(F.col("c") * F.col("c")).alias("_s2"))
        .select("i", (F.sqrt(F.col("_s2") / cells - mean * mean) / mean).alias("spread"))
    )


def begin_trim(ratios: DataFrame, lookahead: int = 10, sigmas: float = 5.0) -> DataFrame:
    """Recommended number of leading bases to cut: one row, null if none.

    ``ratios`` is the GC ratio per read position, so all windows here run over
    one row per position of a read.
    """
    ahead = W.orderBy("i").rowsBetween(1, lookahead)
    centre = F.when((F.col("i") > F.col("_top") * 0.1) & (F.col("i") < F.col("_top") * 0.9), F.col("ratio"))
    z = F.abs(F.try_divide(F.col("ratio") - F.avg(centre).over(_whole()), F.stddev_pop(centre).over(_whole())))
    return (
        ratios.withColumn("_top", F.max("i").over(_whole()) + 1)
        .withColumn("_z", z)
        .withColumn("_worst", F.max("_z").over(ahead))
        .withColumn("_rows", F.count("*").over(ahead))
        .where((F.col("_rows") == lookahead) & (F.col("_worst") <= sigmas))
        .agg((F.min("i") + 1).alias("begin_trim"))
    )


def index_lengths(lengths: DataFrame, most: int = 3, enough: float = 0.99) -> DataFrame:
    """The most frequent read lengths until ``enough`` of the reads are covered."""
    w = W.orderBy(F.desc("n"), F.desc("length"))
    before = F.coalesce(F.sum("n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return (
        lengths.withColumn("_total", F.sum("n").over(_whole()))
        .orderBy(F.desc("n"), F.desc("length"))
        .limit(most)
        .withColumn("_before", before)
        .withColumn("covered", (F.col("_before") + F.col("n")) / F.col("_total"))
        .where(F.col("_before") <= F.col("_total") * enough)
        .select("length", "n", "covered")
    )


def duplicate_histogram(reads: DataFrame) -> DataFrame:
    """Share of reads per multiplicity of their sequence."""
    mult = reads.groupBy("nucs").agg(F.count("*").alias("c"))
    by = mult.groupBy(F.col("c").alias("multiplicity")).agg(F.sum("c").alias("n"))
    return by.select("multiplicity", "n", (F.col("n") / F.sum("n").over(_whole())).alias("share"))


def trim(reads: DataFrame, begin: int = 0, end: int = 0) -> DataFrame:
    """Cut bases off both ends of reads long enough to keep some."""
    if not begin and not end:
        return reads
    long_enough = F.length("nucs") > begin + end

    def cut(c):
        return F.when(long_enough, F.substring(F.col(c), F.lit(begin + 1), F.length(c) - begin - end)).otherwise(F.col(c))

    return reads.select(
        *[cut(c).alias(c) if c in ("nucs", "qual") else F.col(c) for c in reads.columns]
    )


def poisson_limit(mean: Column, share: float = 0.999) -> Column:
    """Smallest count whose Poisson probability sum reaches ``share``.

    Probabilities come from their logarithms, so large means neither underflow nor
    take long: only counts within a dozen deviations of the mean are summed, and what lies
    below them is far less than rounding.
    """
    reach = 12 * F.sqrt(mean) + 12
    low = F.greatest(F.floor(mean - reach), F.lit(0)).cast("long")
    k = lambda x: x.cast("double")
    # Stirling's series; small counts have their exact factorial
    stirling = lambda x: (x + 0.5) * F.ln(x) - x + 0.5 * F.ln(2 * F.pi()) + 1 / (12 * x) - 1 / (360 * F.pow(x, F.lit(3.0)))
    log_factorial = lambda x: F.when(x <= 20, F.ln(F.factorial(F.least(x, F.lit(20)).cast("int")))).otherwise(stirling(k(x)))
    term = lambda x: F.exp(k(x) * F.ln(mean) - mean - log_factorial(x))
    state = lambda total, at: F.named_struct(F.lit("total"), total, F.lit("at"), at)
    walked = F.aggregate(
        F.sequence(low, F.ceil(mean + reach).cast("long")),
        state(F.lit(0.0), F.lit(None).cast("long")),
        lambda s, x: state(s["total"] + term(x), F.coalesce(s["at"], F.when(s["total"] + term(x) >= share, x))),
        lambda s: s["at"],
    )
    return F.when(mean > 0, walked).otherwise(F.lit(0).cast("long"))


def duplicate_limit(reads: DataFrame, chunks: DataFrame, share: float = 0.999) -> DataFrame:
    """One row ``duplimit``: copies to accept of one read, from the reads per reference base."""
    both = reads.select(F.lit(1).alias("n"), F.lit(0).alias("size")).unionByName(chunks.select(F.lit(0).alias("n"), F.length("s").alias("size")))
    rate = F.sum("n") / F.sum("size")
    return both.agg(rate.alias("rate")).select(poisson_limit(F.col("rate"), share).alias("duplimit"))
