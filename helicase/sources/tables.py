"""Sequencing data derived by Spark from the star-schema tables.

Every row of ``part`` becomes 32 reference bases and every row of ``orders`` a
read pair, so the volume of DNA grows with the tables. The rules use only hash
and string functions, and the sample differs from the reference by fixed rules
(substitutions, deletions, insertions), so that every operator has work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from helicase.functions import dna
from helicase.sources import genome

CHUNK = 32
CHUNKS_PER_REF = 1000
READ_LENGTHS = [60, 64, 72]
# Longest read plus room for a deletion.
MAX_SPAN = 80
SAMPLE_PIECES = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables.

    A row here becomes many bases, so a file that Spark would read in fewer tasks
    than it has cores is spread out first. Tables with more splits are left as
    they are.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def idiv(a: Column, b: int) -> Column:
    """Integer division of non-negative whole numbers."""
    return F.call_function("div", a, F.lit(b))


def hash_bases(key: Column) -> Column:
    """32 bases from an md5."""
    return F.translate(F.md5(key.cast("string")), "0123456789abcdef", "ACGTACGTACGTACGT")


def _settle(df: DataFrame) -> DataFrame:
    """Pass the rows through a one-element generator.

    The hashing expressions above are then evaluated once per row: filters that
    later operators infer cannot be pushed through and copied into them.
    """
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def ref_of(g: Column) -> Column:
    """Chromosome that holds the genome-wide chunk number ``g``."""
    return F.concat(F.lit("chr"), (idiv(g, CHUNKS_PER_REF) + 1).cast("string"))


def both_genomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(ref, chunk, s, t)``: reference bases ``s`` and sample bases ``t``.

    Four of every 32 blocks of four chunks repeat one sequence, so some reads
    map to several places.
    """
    k = F.col("p_partkey")
    blk = idiv(k, 4)
    src = F.when(blk % 8 == 5, (idiv(blk, 32) * 32 + 5) * 4 + k % 4).otherwise(k)
    s = F.col("s")
    t = (
        F.when(k % 16 == 7, F.concat(F.left(s, F.lit(15)), F.translate(F.substring(s, 16, 1), "ACGT", "CGTA"), F.substring(s, 17, 16)))
        .when(k % 64 == 21, F.concat(F.left(s, F.lit(16)), F.substring(s, 18, 15)))
        .when(k % 64 == 43, F.concat(F.left(s, F.lit(16)), F.lit("GT"), F.substring(s, 17, 16)))
        .otherwise(s)
    )
    return _settle(
        table(spark, sf_dir, "part")
        .select("p_partkey", hash_bases(src).alias("s"))
        .select(ref_of(k).alias("ref"), (k % CHUNKS_PER_REF).alias("chunk"), "s", t.alias("t"))
    )


def reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``chunks(ref, chunk, s)``."""
    return both_genomes(spark, sf_dir).select("ref", "chunk", "s")


def reference_ext(spark: SparkSession, sf_dir: str, span: int = MAX_SPAN) -> DataFrame:
    """Reference chunks with the overhang that read-length windows need."""
    return genome.with_overhang(reference(spark, sf_dir), CHUNK, span)


def _substitute(s: Column, pos: Column, width: Column) -> Column:
    return F.concat(
        F.left(s, pos - 1),
        F.translate(F.substring(s, pos, width), "ACGT", "GTAC"),
        F.substring(s, pos + width, F.length(s)),
    )


def _hex(h: Column, i: int) -> Column:
    return F.instr(F.lit("0123456789abcdef"), F.substring(h, i, 1)) - 1


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``reads(pair_id, mate, name, nucs, qual)``; quality in Sanger letters."""
    n_parts = table(spark, sf_dir, "part").agg(F.count("*")).scalar()
    sample = genome.with_overhang(
        both_genomes(spark, sf_dir).select("ref", "chunk", "t"), CHUNK, CHUNK * (SAMPLE_PIECES - 1) + 1, col="t"
    ).select("ref", "chunk", F.col("ext").alias("sample"))
    key = F.col("o_orderkey")
    eff = F.when(key % 10 == 9, idiv(key, 40) * 40).otherwise(key)
    start = (
        table(spark, sf_dir, "orders")
        .select(key.alias("pair_id"), eff.alias("eff"))
        .withColumn("g", (F.col("eff") * 7919) % n_parts)
        .select("pair_id", "eff", ref_of(F.col("g")).alias("ref"), (F.col("g") % CHUNKS_PER_REF).alias("chunk"))
    )
    e = F.col("eff")
    want = (
        F.when(e % 100 < 70, 72).when(e % 100 < 90, 64).when(e % 100 < 99, 60).otherwise(48)
    )
    frag_len = F.when(e % 7 == 3, 60 + e % 40).otherwise(150 + (e * 31) % 60)
    frag = F.substring(F.col("sample"), (e % 32 + 1).cast("int"), F.col("frag_len").cast("int"))
    left_end = F.left(F.col("frag"), F.col("want"))
    right_end = dna.revcomp(F.right(F.col("frag"), F.col("want")))
    # A row becomes two reads: they are made in as many tasks as there are partitions, however few bytes are shuffled.
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    pairs = (
        start.repartition(n, "ref", "chunk").join(sample, ["ref", "chunk"])
        .withColumn("want", want)
        .withColumn("frag_len", frag_len)
        .withColumn("frag", frag)
        .select(
            "pair_id",
            "eff",
            F.when(e % 2 == 0, left_end).otherwise(right_end).alias("m1"),
            F.when(e % 2 == 0, right_end).otherwise(left_end).alias("m2"),
        )
    )
    mates = pairs.select(
        "pair_id", "eff", F.posexplode(F.array("m1", "m2")).alias("_m", "clean")
    ).withColumn("mate", F.col("_m") + 1)
    h = F.col("h")
    kind = F.col("kind")
    n = F.length("clean")
    width = F.when(kind < 8, 0).when(kind < 12, 1).when(kind < 14, 3).otherwise(7)
    noisy = (
        mates.withColumn("h", F.md5(F.concat_ws(":", "eff", "mate")))
        .withColumn("kind", _hex(h, 1))
        .withColumn("width", width)
        .withColumn("at", F.when(n > 0, 1 + (16 * _hex(h, 2) + _hex(h, 3)) % F.greatest(n, F.lit(1))).otherwise(1))
    )
    half = idiv(n, 2).cast("int")
    inserted = F.concat(F.left("clean", half), F.lit("A"), F.substring(F.col("clean"), half + 1, n - half - 1))
    dirty = F.when((kind == 15) & (n > 1), inserted).otherwise(_substitute(F.col("clean"), F.col("at"), F.col("width")))
    with_n = F.when(
        (e % 97 == 0) & (F.col("mate") == 1) & (F.length("nucs0") > 10),
        F.concat(F.left("nucs0", F.lit(9)), F.lit("N"), F.substring(F.col("nucs0"), F.lit(11), F.length("nucs0"))),
    ).otherwise(F.col("nucs0"))
    letters = F.translate(
        F.repeat(F.md5(F.concat_ws(":", "pair_id", "mate", F.lit("q"))), F.lit(3)), "0123456789abcdef", "#&),/258;>ADGJMP"
    )
    return _settle(
        noisy.withColumn("nucs0", dirty)
        .withColumn("nucs", with_n)
        .select(
            "pair_id",
            "mate",
            F.concat(F.lit("pair"), F.col("pair_id").cast("string"), F.lit("/"), F.col("mate").cast("string")).alias("name"),
            "nucs",
            F.left(letters, F.length("nucs")).alias("qual"),
        )
    )


def feature_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features laid over the reference, one per customer, plus one per chromosome.

    Types, strands and lengths follow from the key; no feature leaves its
    chromosome.
    """
    n = table(spark, sf_dir, "part").agg(F.count("*")).scalar()
    key = F.col("c_custkey")
    g = F.col("g")
    size = F.least(F.lit(CHUNKS_PER_REF), n - idiv(g, CHUNKS_PER_REF) * CHUNKS_PER_REF) * CHUNK
    start = (g % CHUNKS_PER_REF) * CHUNK + 1 + key % 32
    kinds = F.array(*[F.lit(x) for x in ("gene", "CDS", "exon", "mRNA", "repeat_region")])
    kind = F.element_at(kinds, (key % 5 + 1).cast("int"))
    parent = F.when((key % 5).isin(1, 2, 3), F.concat(F.lit("gene:"), (key - key % 5).cast("string")))
    attributes = (
        F.when(key % 11 == 5, F.lit("."))
        .when(key % 50 == 13, F.concat(F.lit("ID=whole"), key.cast("string"), F.lit(";genome=chromosome")))
        .otherwise(
            F.concat_ws(
                ";",
                F.concat(F.lit("ID="), kind, F.lit(":"), key.cast("string")),
                F.concat(F.lit("Parent="), parent),
                F.when(key % 3 == 0, F.concat(F.lit("Note="), "c_mktsegment")),
                F.concat(F.lit("Name="), "c_name"),
            )
        )
    )
    return (
        table(spark, sf_dir, "customer")
        .select("c_custkey", "c_name", "c_mktsegment")
        .withColumn("g", (key * 37) % n)
        .select(
            ref_of(g).alias("chromosome"),
            F.lit("derived").alias("source"),
            kind.alias("type"),
            start.alias("start"),
            F.least(start + 59 + (key % 9) * 15, size).alias("stop"),
            F.lit(".").alias("score"),
            F.when(key % 2 == 0, "+").otherwise("-").alias("strand"),
            F.lit(".").alias("phase"),
            attributes.alias("attributes"),
        )
    )


def gtf_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GTF text, one line per customer: a gene row per ten keys, the rest exons."""
    key = F.col("c_custkey")
    gene = idiv(key, 10)
    start = gene * 1000 + (key % 10) * 90 + 1
    stop = F.when(key % 10 == 0, start + 900).otherwise(start + 30 + key % 7)
    attrs = F.concat(
        F.lit('gene_id "E'), gene.cast("string"), F.lit('"; gene_name "G'), gene.cast("string"), F.lit('"; '),
        F.when(key % 10 == 0, F.lit("")).otherwise(
            F.concat(F.lit('transcript_version "'), (key % 3 + 1).cast("string"), F.lit('"; '))
        ),
        F.lit('gene_biotype "'), F.when(gene % 7 == 3, "lincRNA").otherwise("protein_coding"), F.lit('";'),
        F.when(key % 4 == 0, F.lit(" # remark")).otherwise(F.lit("")),
    )
    return table(spark, sf_dir, "customer").select(
        F.concat_ws(
            "\t",
            F.concat(F.lit("c"), (gene % 5).cast("string")),
            F.lit("derived"),
            F.when(key % 10 == 0, "gene").otherwise("exon"),
            start.cast("string"),
            stop.cast("string"),
            F.lit("."),
            F.when(gene % 2 == 0, "+").otherwise("-"),
            F.lit("."),
            attrs,
        ).alias("value")
    )


def rrna_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """16S-like database ``(id, name, nucs)``: one stretch of the sample per customer.

    Every third entry has one base changed, every seventh carries an N.
    """
    n = table(spark, sf_dir, "part").agg(F.count("*")).scalar()
    sample = genome.with_overhang(
        both_genomes(spark, sf_dir).select("ref", "chunk", "t"), CHUNK, CHUNK * (SAMPLE_PIECES - 1) + 1, col="t"
    ).select("ref", "chunk", F.col("ext").alias("sample"))
    key = F.col("c_custkey")
    keyed = table(spark, sf_dir, "customer").select(
        key.alias("id"), F.col("c_name").alias("name"), ref_of((key * 53) % n).alias("ref"), (((key * 53) % n) % CHUNKS_PER_REF).alias("chunk")
    )
    text = F.left(F.col("sample"), (120 + F.col("id") % 40).cast("int"))
    changed = (
        F.when(F.col("id") % 7 == 2, F.concat(F.left(text, F.lit(29)), F.lit("N"), F.substring(text, F.lit(31), F.length(text))))
        .when(F.col("id") % 3 == 1, _substitute(text, F.lit(50), F.lit(1)))
        .otherwise(text)
    )
    return _settle(keyed.join(sample, ["ref", "chunk"]).select("id", "name", changed.alias("nucs")))


def pool_loci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loci of several samples from ``lineitem``: pool = line number, locus = part."""
    count = lambda flag: F.count_if(F.col("l_returnflag") == flag)
    n = F.sum("l_quantity").cast("long")
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_linenumber").alias("pool"), F.col("l_partkey").alias("locus"))
        .agg(
            n.alias("num_diff"),
            F.sum(F.round("l_extendedprice").cast("long") % 100).alias("depth"),
            count("R").alias("dels"),
            count("A").alias("_a"),
            F.max("l_linestatus").alias("_s"),
        )
        .select(
            "pool",
            "locus",
            "num_diff",
            "depth",
            "dels",
            (F.col("locus") % 3 != 0).alias("gene"),
            (F.col("_s") != "F").alias("nonsynonymous"),
            F.when(F.col("_a") > 0, F.concat(F.lit("AC: "), F.col("_a").cast("string"))).otherwise("").alias("insert_report"),
        )
    )
