"""FASTA genomes and 16S databases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from helicase.functions import dna
from helicase.sources.lines import blocks

CHUNK = 1024


def read_fasta(spark: SparkSession, path: str, size: int = CHUNK, packed: bool = False) -> DataFrame:
    """``chunks(ref, fullname, chunk, s)`` of any number of chromosomes.

    Chromosomes of any length are read in parallel: each line finds its record
    and offset from prefix sums over the file's splits, and lines are regrouped
    into chunks of ``size`` bases. ``packed`` folds case and unknown letters the
    way 2-bit storage does.
    """
    b = blocks(spark, path).withColumn("_h", F.startswith("value", F.lit(">")))
    b = b.withColumn("_n", F.when(F.col("_h"), 0).otherwise(F.length(F.trim("value"))).cast("long"))
    inner = W.partitionBy("file", "block").orderBy("mid")
    b = (
        b.withColumn("_rec", F.sum(F.col("_h").cast("long")).over(inner))
        .withColumn("_cum", F.sum("_n").over(inner) - F.col("_n"))
        .withColumn("_at", F.max(F.when(F.col("_h"), F.col("_cum"))).over(inner))
    )
    outer = W.partitionBy("file").orderBy("block")
    before = outer.rowsBetween(W.unboundedPreceding, -1)
    z = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    summary = (
        b.groupBy("file", "block")
        .agg(F.sum("_n").alias("_tot"), F.sum(F.col("_h").cast("long")).alias("_hs"), F.max("_at").alias("_last"))
        .withColumn("_p", z(F.sum("_tot").over(before)))
        .withColumn("_rbase", z(F.sum("_hs").over(before)))
        .withColumn("_hprev", F.max(F.col("_p") + F.col("_last")).over(before))
        .select("file", "block", "_p", "_rbase", "_hprev")
    )
    j = b.join(summary, ["file", "block"]).withColumn("rec", F.col("_rec") + F.col("_rbase"))
    names = j.where("_h").select(
        "file",
        "rec",
        F.substring(F.col("value"), F.lit(2), F.length("value")).alias("fullname"),
    )
    offset = F.col("_p") + F.col("_cum") - F.coalesce(F.col("_p") + F.col("_at"), F.col("_hprev"))
    body = j.where("not _h and _n > 0").select("file", "rec", F.trim("value").alias("_t"), offset.alias("_o"))
    lo = F.call_function("div", F.col("_o"), F.lit(size))
    hi = F.call_function("div", F.col("_o") + F.length("_t") - 1, F.lit(size))
    pieces = (
        body.withColumn("chunk", F.explode(F.sequence(lo, hi)))
        .withColumn("_from", F.greatest(F.col("chunk") * size - F.col("_o"), F.lit(0)))
        .select(
            "file", "rec", "chunk", F.greatest(F.col("_o"), F.col("chunk") * size).alias("_k"),
            F.substring(
                F.col("_t"), (F.col("_from") + 1).cast("int"), ((F.col("chunk") + 1) * size - F.greatest(F.col("_o"), F.col("chunk") * size)).cast("int")
            ).alias("_s"),
        )
    )
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", "_s"))), lambda x: x["_s"]), "")
    out = pieces.groupBy("file", "rec", "chunk").agg(text.alias("s")).join(names, ["file", "rec"])
    s = dna.pack_bases("s") if packed else F.col("s")
    return out.select(F.substring_index("fullname", " ", 1).alias("ref"), "fullname", "chunk", s.alias("s"))


def fasta_records(records: DataFrame) -> DataFrame:
    """``(header, nucs)`` of records split at '>' in ``value``."""
    head = F.substring_index("value", "\n", 1)
    return records.where(F.trim("value") != "").select(
        F.rtrim(head, F.lit("\r")).alias("header"),
        F.regexp_replace(F.substring(F.col("value"), F.length(head) + 1, F.length("value")), r"\s+", "").alias("nucs"),
    )


def parse_rrna_db(records: DataFrame) -> DataFrame:
    """16S database entries ``(id, name, nucs)``.

    Headers are a number, or 'S' and a number followed by a name that ends at a
    tab. Bases are upper-cased; the last record counts like any other.
    """
    rdp = F.startswith("header", F.lit("S"))
    return fasta_records(records).select(
        F.regexp_extract("header", r"^S?(\d+)", 1).try_cast("long").alias("id"),
        F.when(rdp, F.regexp_extract("header", r"^\S* ([^\t]*)\t", 1)).otherwise("").alias("name"),
        F.upper("nucs").alias("nucs"),
    )


def read_rrna_db(spark: SparkSession, path: str) -> DataFrame:
    """A record is small, so each is one row of a file split at '>'."""
    return parse_rrna_db(spark.read.option("lineSep", ">").text(path))


def parse_accessions(lines: DataFrame) -> DataFrame:
    """``(id, accession)`` of a tab-separated map with '#' comments; the last of equal ids wins."""
    f = F.split("value", "\t", 2)
    return (
        lines.where(~F.startswith("value", F.lit("#")) & F.contains("value", F.lit("\t")))
        .select(f[0].try_cast("long").alias("id"), f[1].alias("accession"))
        .groupBy("id")
        .agg(F.max("accession").alias("accession"))
    )


def read_accessions(spark: SparkSession, path: str) -> DataFrame:
    return parse_accessions(spark.read.text(path))


def with_accessions(rows: DataFrame, accessions: DataFrame) -> DataFrame:
    """Adds ``accession``, empty where unknown."""
    return rows.join(accessions, "id", "left").withColumn("accession", F.coalesce("accession", F.lit("")))


def extract(chunks: DataFrame, regions: DataFrame, size: int, reverse: str | None = None) -> DataFrame:
    """``[start, stop)`` of each region row as pieces: adds ``at`` and ``bases``, turned where the flag column says so.

    A piece lies in one chunk; in order of ``at`` they make up the region (turned ones against it).
    """
    from helicase.operators.coverage import region_pieces

    r = region_pieces(regions.withColumnRenamed("start", "pos"), chunks, size).withColumnRenamed("pos", "start")
    if reverse:
        r = r.withColumn("bases", F.when(F.col(reverse), dna.revcomp("bases")).otherwise(F.col("bases")))
    return r


def packed_rows(chunks: DataFrame) -> DataFrame:
    """Two bits a base, four bases a byte with the first lowest: ``(ref, chunk, packed)``; the last byte of a chunk is filled up with A."""
    digits = F.translate(dna.pack_bases("s"), "ACGT", "0123")
    groups = F.transform(
        F.sequence(F.lit(0), F.ceil(F.length("s") / 4).cast("int") - 1),
        lambda i: F.lpad(F.conv(F.reverse(F.rpad(F.substring(digits, i * 4 + 1, F.lit(4)), 4, "0")), 4, 16), 2, "0"),
    )
    return chunks.where(F.length("s") > 0).select("ref", "chunk", F.unhex(F.array_join(groups, "")).alias("packed"))


def write_packed(chunks: DataFrame, path: str) -> None:
    """A folder per chromosome with its packed chunks in order."""
    packed_rows(chunks).repartitionByRange("ref", "chunk").sortWithinPartitions("ref", "chunk").write.partitionBy("ref").parquet(path)


def splice(chunks: DataFrame, size: int, ref: str, cut: int, resume: int, insert: str) -> DataFrame:
    """``ref`` with the bases between ``cut`` and ``resume`` replaced by the turned ``insert``.

    Bases before ``cut`` and from ``resume`` on are kept. The chromosome stays a
    chunk table: the kept parts are moved, cut at the new chunk borders and
    regrouped.
    """
    piece = chunks.where(F.col("ref") == ref).select(
        (F.col("chunk") * size + 1).alias("_a"), "s"
    )
    head = piece.where(F.col("_a") < cut).select("_a", F.left("s", (F.lit(cut) - F.col("_a")).cast("int")).alias("s"))
    skip = F.greatest(F.lit(resume) - F.col("_a"), F.lit(0)).cast("int")
    shift = cut + len(insert) - resume
    tail = piece.where(F.col("_a") + F.length("s") > resume).select(
        (F.col("_a") + skip + shift).alias("_a"), F.substring(F.col("s"), skip + 1, F.length("s")).alias("s")
    )
    spark = chunks.sparkSession
    mid = spark.range(1).select(F.lit(cut).cast("long").alias("_a"), dna.revcomp(F.lit(insert)).alias("s"))
    return rechunk(head.unionByName(mid).unionByName(tail), size).withColumn("ref", F.lit(ref)).select("ref", "chunk", "s")


def rechunk(pieces: DataFrame, size: int) -> DataFrame:
    """Chunks from gapless pieces ``(_a, s)`` that start at 1-based positions."""
    p = pieces.where("s <> ''").withColumn(
        "chunk",
        F.explode(
            F.sequence(
                F.call_function("div", F.col("_a") - 1, F.lit(size)),
                F.call_function("div", F.col("_a") + F.length("s") - 2, F.lit(size)),
            )
        ),
    )
    k = F.greatest(F.col("_a") - 1, F.col("chunk") * size)
    cut = p.select(
        "chunk",
        k.alias("_k"),
        F.substring(F.col("s"), (k - F.col("_a") + 2).cast("int"), ((F.col("chunk") + 1) * size - k).cast("int")).alias("_s"),
    )
    return cut.groupBy("chunk").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", "_s"))), lambda x: x["_s"]), "").alias("s")
    )


def fasta_lines(chunks: DataFrame, size: int, width: int = 70) -> DataFrame:
    """FASTA text lines ``(ref, line_no, value)``: line 0 is the header.

    The sequence is regrouped into lines of ``width`` letters chunk by chunk.
    """
    bases = chunks.select("ref", (F.col("chunk") * size).alias("_o"), "s")
    lo = F.call_function("div", F.col("_o"), F.lit(width))
    hi = F.call_function("div", F.col("_o") + F.length("s") - 1, F.lit(width))
    p = bases.where("s <> ''").withColumn("_l", F.explode(F.sequence(lo, hi)))
    k = F.greatest(F.col("_o"), F.col("_l") * width)
    cut = p.select(
        "ref", "_l", k.alias("_k"),
        F.substring(F.col("s"), (k - F.col("_o") + 1).cast("int"), ((F.col("_l") + 1) * width - k).cast("int")).alias("_s"),
    )
    body = cut.groupBy("ref", (F.col("_l") + 1).alias("line_no")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", "_s"))), lambda x: x["_s"]), "").alias("value")
    )
    heads = chunks.select("ref").distinct().select("ref", F.lit(0).cast("long").alias("line_no"), F.concat(F.lit(">"), "ref").alias("value"))
    return heads.unionByName(body)


def write_fasta(chunks: DataFrame, path: str, size: int, width: int = 70) -> None:
    """FASTA part files, sorted by chromosome and line."""
    fasta_lines(chunks, size, width).repartitionByRange("ref", "line_no").sortWithinPartitions("ref", "line_no").select("value").write.text(path)
