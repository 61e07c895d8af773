"""Variable loci: gating, summaries, codon consequences, regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from helicase.functions import dna
from helicase.operators import pileup
from helicase.operators.annotations import stab
from helicase.operators.clusters import cluster_ids
from helicase.operators.kmers import expanded
from helicase.sources import genome

LETTERS = "ACGT"
MIN_QUALITY_SUM = 90
MIN_DELETES = 3


def insert_reports(diffs: DataFrame) -> DataFrame:
    """``(ref, pos, insert_report)`` such as ``AC: 3, T: 1``, in order of the bases."""
    n = diffs.where("inserted is not null").groupBy("ref", "pos", "inserted").agg(F.count("*").alias("n"))
    item = F.concat("inserted", F.lit(": "), F.col("n").cast("string"))
    return n.groupBy("ref", "pos").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("inserted", item.alias("t")))), lambda x: x["t"]), ", "
        ).alias("insert_report")
    )


def locus_counts(diffs: DataFrame) -> DataFrame:
    """Counts and quality sums per position and observed base, heads and deletes."""
    aggs = [F.count("*").alias("num_diff"), F.count_if("head").alias("heads"), F.count_if(F.col("base") == "X").alias("dels")]
    for b in LETTERS:
        hit = F.col("base") == b
        aggs.append(F.count_if(hit).alias(b.lower()))
        aggs.append(F.coalesce(F.sum(F.when(hit, F.col("q"))), F.lit(0).cast("long")).alias(b.lower() + "q"))
    return diffs.groupBy("ref", "pos").agg(*aggs)


def gated(counts: DataFrame) -> DataFrame:
    """Loci with two or more samples, enough evidence for one change, and both strands."""
    strong = F.greatest("aq", "cq", "gq", "tq") >= MIN_QUALITY_SUM
    frac = F.col("heads") / F.col("num_diff")
    return (
        counts.where((F.col("num_diff") > 1) & (strong | (F.col("dels") >= MIN_DELETES)))
        .withColumn("frac_head", frac)
        .where((F.col("frac_head") >= 0.1) & (F.col("frac_head") <= 0.9))
        .withColumn("tot_q", F.col("aq") + F.col("cq") + F.col("gq") + F.col("tq"))
    )


def loci(diffs: DataFrame, cov: DataFrame, chunks_ext: DataFrame, size: int, with_inserts: bool = True) -> DataFrame:
    """The variable-loci table with depth, original base and change summary."""
    g = gated(locus_counts(diffs)).join(cov, ["ref", "pos"], "left").withColumn("depth", F.coalesce("depth", F.lit(0).cast("long")))
    g = genome.snippets(g, chunks_ext, size, F.lit(1), "orig")
    parts = [
        F.when((F.col(b.lower()) > 0) & (F.col("orig") != b), F.concat("orig", F.lit(f">{b}"))) for b in LETTERS
    ]
    parts.append(F.when(F.col("dels") > 0, F.concat(F.lit("-"), F.col("orig"))))
    g = g.withColumn("summary", F.concat_ws(",", *parts))
    if with_inserts:
        g = g.join(insert_reports(diffs), ["ref", "pos"], "left").withColumn("insert_report", F.coalesce("insert_report", F.lit("")))
    return g


def variability(locus_rows: DataFrame, diffs: DataFrame) -> DataFrame:
    """Adds ``variability``: percent of votes that are not for the leading letter.

    Depth votes for the reference base. Too little depth or a one-sided sample
    gives 0.
    """
    votes = diffs.groupBy("ref", "pos", "base").agg(F.count("*").alias("_v"))
    own = locus_rows.select("ref", "pos", F.col("orig").alias("base"), F.col("depth").alias("_v"))
    tally = (
        votes.unionByName(own)
        .groupBy("ref", "pos", "base")
        .agg(F.sum("_v").alias("_v"))
        .groupBy("ref", "pos")
        .agg(F.sum("_v").alias("_all"), F.max("_v").alias("_top"))
    )
    one_sided = (F.col("frac_head") < 0.05) | (F.col("frac_head") > 0.95)
    pct = F.call_function("div", (F.col("_all") - F.col("_top")) * 100, F.nullif("_all", F.lit(0)))
    return (
        locus_rows.join(tally, ["ref", "pos"])
        .withColumn("variability", F.when((F.col("_all") < 20) | one_sided, F.lit(0).cast("long")).otherwise(pct))
        .drop("_all", "_top")
    )


def base_weights(diffs: DataFrame) -> DataFrame:
    """Sum of quality/30 per position for each of A, C, G, T and deletions."""
    aggs = [
        F.sum(F.when(F.col("base") == b, F.col("q")).otherwise(0)).alias(f"_{b}") for b in LETTERS + "X"
    ]
    return diffs.groupBy("ref", "pos").agg(*aggs).select(
        "ref", "pos", *[(F.col(f"_{b}") / 30.0).alias(f"{b.lower()}_prob") for b in LETTERS + "X"]
    )


def regions(locus_rows: DataFrame, chunks: DataFrame, limit: int = 100, flank: int = 100) -> DataFrame:
    """Clusters of loci widened by ``flank`` and clamped to the chromosome."""
    c = cluster_ids(locus_rows, limit)
    r = c.groupBy("ref", "cluster").agg(
        F.min("pos").alias("_lo"), F.max("pos").alias("_hi"), F.count("*").alias("loci"),
        F.max("variability").alias("max_variability"),
    )
    r = r.join(genome.chromosomes(chunks), "ref")
    start = F.when(F.col("_lo") > flank, F.col("_lo") - flank).otherwise(1)
    # Chromosome sizes count the pad position in front of base 1.
    size = F.col("len") + 1
    stop = F.least(F.col("_hi") + flank, size)
    return r.select(
        "ref", "cluster", start.alias("start"), stop.alias("stop"),
        F.call_function("div", start + stop, F.lit(2)).alias("pos"), "loci", "max_variability",
    )


def region_depths(region_rows: DataFrame, runs: DataFrame) -> DataFrame:
    """Depth of every position of each region: ``(ref, cluster, pos, depth)``.

    Regions meet the stretches of equal depth (``pileup.depth_runs``) in their bins; a bin without any has no depth.
    """
    size = pileup.DEPTH_BIN
    bins = F.sequence(genome.chunk_of(F.col("start"), size), genome.chunk_of(F.col("stop") - 1, size))
    parts = region_rows.where("stop > start").select("ref", "cluster", "start", "stop", F.explode(bins).alias("bin"))
    parts = parts.select(
        "ref", "cluster", "bin", F.greatest("start", F.col("bin") * size + 1).alias("_a"), F.least("stop", (F.col("bin") + 1) * size + 1).alias("_b")
    )
    r = runs.select("ref", "bin", F.col("pos").alias("_p"), F.col("stop").alias("_q"), "depth")
    a, b = F.greatest("_a", F.coalesce("_p", "_a")), F.least("_b", F.coalesce("_q", "_b"))
    return (
        expanded(parts)
        .join(r, ["ref", "bin"], "left")
        .where(b > a)
        .select("ref", "cluster", F.explode(F.sequence(a, b - 1)).alias("pos"), F.coalesce("depth", F.lit(0).cast("long")).alias("depth"))
    )


def region_weights(region_rows: DataFrame, diffs: DataFrame) -> DataFrame:
    """:func:`base_weights` of the positions of each region that have differing samples, with the region's ``cluster``."""
    spread = region_rows.select("ref", "cluster", F.explode(F.sequence("start", F.col("stop") - 1)).alias("pos"))
    return spread.join(base_weights(diffs), ["ref", "pos"])


def insert_counts(aligned: DataFrame) -> DataFrame:
    """Reads with an insertion per locus: ``(ref, pos, n, significant)``."""
    return (
        aligned.where("indel > 0")
        .groupBy("ref", (F.col("pos") + F.col("indel")).alias("pos"))
        .agg(F.count("*").alias("n"))
        .withColumn("significant", F.col("n") > 4)
    )


def top_inserts(counts: DataFrame, at_least: int = 3) -> DataFrame:
    """Insertion loci worth a region, most frequent first."""
    return counts.where(F.col("n") >= at_least).orderBy(F.desc("n"), "ref", "pos")


def amino_changes(locus_genes: DataFrame, chunks_ext: DataFrame, size: int) -> DataFrame:
    """Codon consequence of each observed base at a locus inside a gene.

    ``locus_genes`` has the locus columns (``a c g t depth orig``) next to the
    gene's ``start, stop, strand``. The last codon of a gene stays unresolved as
    ``XXX``.
    """
    at = F.when(F.col("strand"), F.col("pos") - F.col("start")).otherwise(F.col("stop") - F.col("pos"))
    j = (
        locus_genes.withColumn("_at", at)
        .withColumn("residue", F.call_function("div", F.col("_at"), F.lit(3)) + 1)
        .withColumn("offset", (F.col("_at") % 3).cast("int"))
        .withColumn("residues", F.call_function("div", F.col("stop") - F.col("start") + 1, F.lit(3)))
        .withColumn("_locus", F.col("pos"))
        .withColumn("_len", F.col("stop") - F.col("start") + 1)
        .withColumn(
            "pos",
            F.when(F.col("strand"), F.col("start") + (F.col("residue") - 1) * 3).otherwise(
                F.greatest(F.col("stop") - (F.col("residue") - 1) * 3 - 2, F.lit(1))
            ),
        )
    )
    j = genome.snippets(j, chunks_ext, size, F.lit(3), "_codon")
    whole = F.col("residue") * 3 < F.col("_len")
    codon = F.when(whole, F.when(F.col("strand"), F.col("_codon")).otherwise(dna.revcomp("_codon"))).otherwise(F.lit("XXX"))
    j = j.withColumn("codon", codon)
    seen = F.array_compact(
        F.array(*[F.when((F.col(b.lower()) > 0) | ((F.col("orig") == b) & (F.col("depth") > 0)), F.lit(b)) for b in LETTERS])
    )
    j = j.withColumn("base", F.explode(seen))
    letter = F.when(F.col("strand"), F.col("base")).otherwise(F.translate("base", dna.BASES, dna.COMPLEMENT))
    j = j.withColumn(
        "new_codon", F.overlay(F.col("codon"), letter, F.col("offset") + 1, F.lit(1))
    ).where(F.col("new_codon") != F.col("codon"))
    return j.withColumn("pos", F.col("_locus")).withColumn(
        "amino", dna.amino_name(dna.amino_acid("codon"))
    ).withColumn("new_amino", dna.amino_name(dna.amino_acid("new_codon"))).drop("_at", "_locus", "_len", "_codon")


def amino_text(changes: DataFrame, *keys: str) -> DataFrame:
    """One report line per locus and gene from its codon changes, and whether any changes the amino acid."""
    line = F.concat(
        F.col("base"), F.lit(": "), "codon", F.lit(" -> "), "new_codon", F.lit(", "), "amino", F.lit(" -> "), "new_amino"
    )
    return changes.groupBy(*keys, "residue", "residues").agg(
        F.concat(
            F.lit("R"), F.first("residue").cast("string"), F.lit("/"), F.first("residues").cast("string"), F.lit(" "),
            F.array_join(F.array_sort(F.collect_list(line)), "; "),
        ).alias("amino_report"),
        F.bool_or(F.col("amino") != F.col("new_amino")).alias("nonsynonymous"),
    )


def annotated(locus_rows: DataFrame, annotations: DataFrame, chunks_ext: DataFrame, size: int) -> DataFrame:
    """Locus rows with what their genes say: adds ``annotation``, ``gene`` and ``amino_report``, empty outside of features.

    ``annotations(ref, start, stop, strand, id, tag, gene)``. The features of a locus follow each other by start, stop
    and id, each as its id and its tag in brackets; amino reports by the genes' start, stop and strand.
    """
    hits = stab(locus_rows, annotations.select("ref", "start", "stop", "strand", "id", "tag", F.col("gene").alias("_gene")))
    clean = F.replace(F.col("tag"), F.lit("\n"), F.lit("\\n"))
    one = F.struct("start", "stop", "id", F.concat("id", F.lit("\t["), clean, F.lit("]\t")).alias("t"))
    named = hits.groupBy("ref", "pos").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["t"]), "").alias("annotation"), F.bool_or("_gene").alias("gene")
    )
    changes = amino_changes(hits.where("_gene"), chunks_ext, size).dropDuplicates(["ref", "pos", "start", "stop", "strand", "base"])
    lines = amino_text(changes, "ref", "pos", "start", "stop", "strand")
    line = F.struct("start", "stop", "strand", "residue", F.col("amino_report").alias("t"))
    amino = lines.groupBy("ref", "pos").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["t"]), " ").alias("amino_report"))
    out = locus_rows.join(named, ["ref", "pos"], "left").join(amino, ["ref", "pos"], "left")
    return out.withColumns({"annotation": F.coalesce("annotation", F.lit("")), "gene": F.coalesce("gene", F.lit(False)), "amino_report": F.coalesce("amino_report", F.lit(""))})


def loci_tsv(annotated_rows: DataFrame) -> DataFrame:
    """One line of text per annotated locus: counts, qualities, head share, insertions, then ``#``, annotation and amino report."""
    counts = "ref pos num_diff depth a aq c cq g gq t tq dels tot_q".split()
    cells = [F.col(c).cast("string") for c in counts] + [F.format_string("%.4f", F.round("frac_head", 4)), F.coalesce("insert_report", F.lit("")), F.concat(F.lit("#"), "annotation"), F.col("amino_report")]
    return annotated_rows.select(F.concat_ws("\t", *cells).alias("value"))


def locus_report(locus_rows: DataFrame, diffs: DataFrame) -> DataFrame:
    """Text block per locus: samples in order of base and quality, then percentages.

    Samples collect per locus of the (already gated) locus table, one letter
    each, in runs of equal (base, quality, head).
    """
    runs = (
        diffs.join(locus_rows.select("ref", "pos"), ["ref", "pos"])
        .groupBy("ref", "pos", "base", "q", "head")
        .agg(F.count("*").cast("int").alias("n"))
        .groupBy("ref", "pos")
        .agg(F.array_sort(F.collect_list(F.struct("base", "q", "head", "n"))).alias("r"))
    )
    text = lambda f: F.array_join(F.transform("r", lambda x: F.repeat(f(x), x["n"])), "")
    total = F.col("num_diff") + F.col("depth")
    pct = lambda b: F.call_function(
        "div", (F.col(b) + F.when(F.col("orig") == b.upper(), F.col("depth")).otherwise(0)) * 100, total
    )
    body = F.concat_ws(
        "\n",
        F.concat(F.rpad(F.col("pos").cast("string"), 10, " "), F.lit(": "), F.lpad(F.col("depth").cast("string"), 3, " "), F.lit("*"), "orig", F.lit(" "), text(lambda x: x["base"])),
        F.concat(F.lit(" " * 18), text(lambda x: F.char(x["q"] + 33))),
        F.concat(F.lit(" " * 18), text(lambda x: F.when(x["head"], "H").otherwise("."))),
        F.concat(
            F.lit(" " * 18 + "A: "), pct("a").cast("string"), F.lit("%, C: "), pct("c").cast("string"), F.lit("%, G: "),
            pct("g").cast("string"), F.lit("%, T: "), pct("t").cast("string"), F.lit("%, X: "),
            F.call_function("div", F.col("dels") * 100, total).cast("string"), F.lit("%"),
        ),
    )
    return locus_rows.join(runs, ["ref", "pos"]).select("ref", "pos", body.alias("report"))
