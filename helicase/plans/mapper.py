"""The read-mapping analysis as one lazy plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, functions as F

from helicase.operators import kmers, pairing, pileup, seeds
from helicase.sources import genome


@dataclass
class Mapping:
    """Every stage of a mapping run as a DataFrame.

    ``chunks(ref, chunk, s)`` is the reference (several chromosomes and control
    sequences are just more ``ref`` values), ``reads(pair_id, mate, name, nucs,
    qual)`` the input. ``lengths`` are the read lengths tried for exact matches.
    ``stage`` receives each result that several later stages consume; pass
    ``helicase.session.materialise`` to compute those once, or leave it to keep
    the whole plan lazy.
    """

    reads: DataFrame
    chunks: DataFrame
    size: int
    lengths: list[int]
    span: int
    qlimit: int = 30
    duplimit: int = 0
    seed: int = seeds.SEED
    indels: bool = True
    stage: Callable[[DataFrame, str], DataFrame] = lambda df, name: df
    chunks_ext: DataFrame | None = None

    def __post_init__(self):
        if self.chunks_ext is None:
            self.chunks_ext = self.stage(genome.with_overhang(self.chunks, self.size, self.span), "chunks")

    @cached_property
    def kept(self) -> DataFrame:
        """Reads left after the duplicate limit."""
        return self.stage(pairing.limit_duplicates(self.reads, self.duplimit), "kept") if self.duplimit > 0 else self.reads

    @cached_property
    def _probe(self) -> DataFrame:
        """Exact hits, and the left-over reads with their text, from one outer join."""
        j = kmers.exact_matches(self.kept, self.chunks_ext, self.size, self.lengths, "left")
        left = lambda c: F.when(F.col("pos").isNull(), F.col(c)).alias(c)
        return self.stage(j.select("pair_id", "mate", "ref", "pos", "reverse", left("nucs"), left("qual")), "probe")

    @cached_property
    def exact(self) -> DataFrame:
        return (
            self._probe.where(F.col("pos").isNotNull())
            .select("pair_id", "mate", "ref", "pos", "reverse", F.lit(0).alias("score"))
        )

    @cached_property
    def fuzzy(self) -> DataFrame:
        """Seeded candidates of the reads the exact join left over."""
        rest = self._probe.where(F.col("pos").isNull()).select("pair_id", "mate", "nucs", "qual")
        return seeds.seeded_matches(rest, self.chunks_ext, self.size, self.seed, self.qlimit, self.indels, self.stage)

    @cached_property
    def candidates(self) -> DataFrame:
        return self.stage(self.exact.unionByName(self.fuzzy), "candidates")

    @cached_property
    def pairs(self) -> DataFrame:
        return pairing.pair_candidates(self.candidates)

    @cached_property
    def best_pairs(self) -> DataFrame:
        return pairing.best_pairs(self.pairs)

    @cached_property
    def placed(self) -> DataFrame:
        return self.stage(pairing.placements(self.candidates), "placed")

    @cached_property
    def unfound(self) -> DataFrame:
        return pairing.unplaced(self.kept, self.placed)

    @cached_property
    def aligned(self) -> DataFrame:
        """Realigned reads, stretches of positions together and in order, so that what is counted per position combines before it is shuffled."""
        # They are dealt out once, where they meet the reference, and by hash: a range would be sampled first, which realigns every read one more time.
        laid = pileup.realign(self.placed, self.kept, self.chunks_ext, self.size, self.qlimit, self.indels, pileup.DEPTH_BIN)
        return self.stage(laid.sortWithinPartitions("ref", "pos"), "aligned")

    @cached_property
    def base_rows(self) -> DataFrame:
        return pileup.bases(self.aligned)

    @cached_property
    def depth_runs(self) -> DataFrame:
        """Stretches of equal depth, from which all depth tables are read."""
        return self.stage(pileup.depth_runs(self.aligned, self.qlimit), "depth")

    @cached_property
    def coverage(self) -> DataFrame:
        return pileup.run_positions(self.depth_runs)

    @cached_property
    def dense(self) -> DataFrame:
        return pileup.dense_coverage(self.coverage, self.chunks, self.size)

    @cached_property
    def differences(self) -> DataFrame:
        # only reads that differ are taken apart into bases
        changed = pileup.bases(self.aligned.where(F.col("nucs") != F.col("ref_bases")))
        found = pileup.differences(changed, self.aligned if self.indels else None, self.qlimit)
        return self.stage(found, "differences")

    @cached_property
    def quality_counts(self) -> DataFrame:
        """Right and wrong bases per reported Q and read position."""
        return self.stage(pileup.quality_counts(self.base_rows), "quality")

    def control_counts(self, controls: list[str]) -> DataFrame:
        """Reads placed on the control sequences and on the rest: ``(ref, control, reads, paired)``.

        Their tables are those of a mapping of :meth:`sample_reads` without the controls in ``chunks``.
        """
        return self.placed.groupBy("ref", F.col("ref").isin(controls).alias("control")).agg(
            F.count("*").alias("reads"), F.count_if("paired").alias("paired")
        )

    def sample_reads(self, controls: list[str]) -> DataFrame:
        """The reads that were not placed on a control sequence."""
        taken = self.placed.where(F.col("ref").isin(controls)).select("pair_id", "mate")
        return self.reads.join(taken, ["pair_id", "mate"], "left_anti")
