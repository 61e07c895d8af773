"""All result tables of a mapping run, and their files."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from helicase.operators import annotations as A, coverage, loci, pairing, pileup, qc
from helicase.plans.mapper import Mapping
from helicase.sources import bam, fastq, genome, sam


def tables(m: Mapping, annotations: DataFrame | None = None, trim_begin: int = 0, trim_end: int = 0, undermatched=False, variable=True, inserts=True) -> dict[str, DataFrame]:
    """The report as DataFrames by name; each is lazy.

    ``annotations`` has ``ref, start, stop, type, id, tag, strand, gene``.
    """
    sample = m.reads
    k = max(m.lengths)
    out = {
        "kmerstats": qc.kmer_spread(sample),
        "gc_ratios": qc.gc_by_position(sample),
        "genome_gc": genome.base_totals(m.chunks),
        "pair_distances": pairing.distance_histogram(pairing.pair_distances(m.best_pairs, m.kept)),
        "read_lengths": qc.read_lengths(m.reads),
        "quality_histogram": qc.quality_histogram(m.reads),
        "duplicates": qc.duplicate_histogram(m.reads),
        "gc_reads": qc.gc_histogram(m.kept),
        "gc_reference": qc.reference_gc_histogram(m.chunks_ext, m.size, k),
        "qualities": qc.quality_by_position(m.reads),
        "depth_by_gc": coverage.depth_by_gc(m.depth_runs, m.chunks_ext, m.size),
        "depth_histogram": coverage.depth_histogram(m.depth_runs, m.chunks),
        "depth_summary": coverage.depth_summary(m.depth_runs, m.chunks),
        "reference_q": pileup.quality_by_position(m.quality_counts),
        "qq": pileup.quality_calibration(m.quality_counts),
    }
    locus = loci.loci(m.differences, m.coverage, m.chunks_ext, m.size, with_inserts=m.indels)
    locus = loci.variability(locus, m.differences)
    if annotations is not None:
        hit = A.stab(locus, annotations.where("gene").select("ref", "start", "stop", "strand"))
        out["amino_changes"] = loci.amino_changes(hit, m.chunks_ext, m.size)
        named = A.stab(locus.select("ref", "pos"), annotations)
        out["locus_annotations"] = named.select("ref", "pos", "type", "tag", "start", "stop", "strand", "gene")
        locus = loci.annotated(locus, annotations, m.chunks_ext, m.size)
    out["loci"] = locus
    out["locus_reports"] = loci.locus_report(locus, m.differences)
    if undermatched:
        low = coverage.low_regions(m.dense, m.chunks)
        out["undermatched"] = low
        out |= region_tables("undermatched", low.withColumnRenamed("pos", "start").withColumn("cluster", F.col("start")), m)
    if variable:
        out["variable_regions"] = loci.regions(locus, m.chunks)
        out |= region_tables("variable", out["variable_regions"], m)
    if inserts and m.indels:
        out["insert_loci"] = loci.top_inserts(loci.insert_counts(m.aligned))
        spots = out["insert_loci"].select("ref", "pos", F.col("n").alias("variability"))
        out["insert_regions"] = loci.regions(spots, m.chunks)
        out |= region_tables("insert", out["insert_regions"], m)
    out["run_summary"] = run_summary(m)
    return out


def region_tables(name: str, regions: DataFrame, m: Mapping) -> dict[str, DataFrame]:
    """Depth and base weights of every position of the regions ``(ref, cluster, start, stop)``, and their text by pieces."""
    r = regions.select("ref", "cluster", "start", "stop")
    text = coverage.region_pieces(r.withColumnRenamed("start", "pos"), m.chunks, m.size)
    return {
        f"{name}_depths": loci.region_depths(r, m.depth_runs),
        f"{name}_weights": loci.region_weights(r, m.differences),
        f"{name}_text": text.select("ref", "cluster", "at", "bases"),
    }


def run_summary(m: Mapping) -> DataFrame:
    """``(metric, value)`` of one run; each branch is a one-row aggregate."""
    n = F.count("*")
    one = lambda df, name, value: df.agg(value.cast("double").alias("value")).select(F.lit(name).alias("metric"), "value")
    parts = [
        one(m.reads, "total_reads", n),
        one(m.kept, "reads_within_duplicate_limit", n),
        one(m.kept, "reads_with_n", F.count_if(F.contains("nucs", F.lit("N")))),
        one(m.placed, "placed", n),
        one(m.placed, "placed_in_pairs", F.count_if("paired")),
        one(m.unfound, "unfound", n),
        qc.quality_overall(m.reads).select(F.lit("mean_q").alias("metric"), F.col("quality").alias("value")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def sam_rows(m: Mapping) -> DataFrame:
    """Placed reads with mate fields, indel and original bases, ready for SAM or BAM."""
    raw = m.kept.select("pair_id", "mate", F.col("nucs").alias("raw_nucs"), F.col("qual").alias("raw_qual"))
    mapped = m.aligned.where("ok").join(raw, ["pair_id", "mate"])
    return sam.original_bases(sam.mate_fields(mapped, pairing.pair_distances(m.best_pairs, m.kept)))


def write(m: Mapping, path: str, annotations: DataFrame | None = None, bam_uri: str | None = None, unmatched: bool = False, **options) -> None:
    """Write every table as JSON lines below ``path``, loci also as TSV."""
    for name, df in tables(m, annotations, **options).items():
        df.write.json(f"{path}/{name}")
        if name == "loci":
            df.write.option("sep", "\t").option("header", True).csv(f"{path}/loci_tsv")
    if unmatched:
        fastq.write_fastq(m.unfound, f"{path}/unfound_fastq")
    if bam_uri:
        bam.write_bam(sam_rows(m), m.chunks, bam_uri)
