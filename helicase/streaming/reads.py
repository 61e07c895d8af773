"""Mapping reads as they arrive.

Expressions that look at one row apply to streams unchanged; this module adds the
stream-static join against a reference and the running coverage on top of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from helicase.operators import kmers, pileup
from helicase.operators.seeds import oriented
from helicase.sources import genome


def exact_placements(reads: DataFrame, chunks_ext: DataFrame, size: int, lengths: list[int]) -> DataFrame:
    """Exact hits of a stream of reads against a static reference."""
    return kmers.exact_matches(reads, chunks_ext, size, lengths)


def running_coverage(placed: DataFrame, chunks_ext: DataFrame, size: int, qlimit: int = 30) -> DataFrame:
    """Depth per position so far; run in update or complete mode.

    The state is one counter per covered position, whatever the number of reads.
    """
    a = oriented(genome.snippets(placed, chunks_ext, size, F.length("nucs"), "ref_bases")).withColumn("ok", F.lit(True))
    return pileup.coverage(pileup.bases(a), qlimit)
