"""Text picture of the reads that cover a region."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from helicase.operators import coverage
from helicase.operators.kmers import expanded

SURE, FAINT = 30, 22
TEXT_GAP = 17
BLANK = "_"


def region_reads(regions: DataFrame, aligned: DataFrame, chunk: int = 1024) -> DataFrame:
    """Reads that start inside ``[start, stop)`` of a region, with its ``start`` and ``stop``.

    Reads meet regions in an equi-join on position bins.
    """
    bins = F.sequence(F.call_function("div", F.col("start"), F.lit(chunk)), F.call_function("div", F.col("stop") - 1, F.lit(chunk)))
    r = regions.where("stop > start").select("ref", "start", "stop", F.explode(bins).alias("_bin"))
    a = aligned.withColumn("_bin", F.call_function("div", F.col("pos"), F.lit(chunk)))
    return expanded(r).join(a, ["ref", "_bin"]).where((F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("stop")))


def gaps(reads: DataFrame) -> DataFrame:
    """Columns to open in each region: ``(ref, start, gaps)``, a map from position to the longest insertion in front of it.

    A map has an entry for a position at most, so it is no longer than the region's text.
    """
    longest = (
        reads.where((F.col("indel") > 0) & (F.col("pos") + F.col("indel") < F.col("stop")))
        .groupBy("ref", "start", (F.col("pos") + F.col("indel")).alias("_at"))
        .agg(F.max(F.length("inserted")).alias("_width"))
    )
    return longest.groupBy("ref", "start").agg(F.map_from_entries(F.collect_list(F.struct("_at", "_width"))).alias("gaps"))


def _width(at: Column) -> Column:
    return F.coalesce(F.try_element_at("gaps", at), F.lit(0))


def _letter(base: Column, q: Column) -> Column:
    return F.when(q > SURE, base).when(q < FAINT, F.lit(" ")).otherwise(F.lower(base))


def read_rows(regions: DataFrame, aligned: DataFrame, chunk: int = 1024) -> DataFrame:
    """One text row per read that starts inside ``[start, stop)`` of a region.

    Columns ``ref, start, pos, pair_id, mate, row``. A base equal to the reference
    shows as '.', a sure difference as its letter, a doubtful one in lower case,
    a poor one as a blank; 'R' marks reverse reads. Where a read of the region has an insertion, every row that runs
    over the place is stretched: the read shows the inserted bases, by the quality of the first of them, and '_' fills up.
    """
    reads = region_reads(regions, aligned, chunk)
    j = reads.join(gaps(reads), ["ref", "start"], "left")
    n = F.least(F.length("nucs"), F.length("ref_bases"), (F.col("stop") - F.col("pos")).cast("int"))
    cut = lambda c: F.split(F.left(F.col(c), n), "")
    pairs = F.zip_with(cut("nucs"), cut("ref_bases"), lambda x, y: F.when(x == y, F.lit(".")).otherwise(x))
    shown = F.zip_with(pairs, F.transform(cut("qual"), lambda q: F.ascii(q) - 33), lambda x, q: F.when(x == ".", x).otherwise(_letter(x, q)))
    extra = F.transform(F.split("inserted", ""), lambda x: _letter(x, F.col("inserted_q")))
    j = j.withColumn("_own", F.when(F.col("indel") > 0, F.array_join(extra, "")).otherwise("")).withColumn("_shown", shown)

    def stretched(x, i):
        own = F.when(i == F.col("indel"), F.col("_own")).otherwise("")
        return F.when(i > 0, F.concat(F.rpad(own, _width(F.col("pos") + i), F.lit(BLANK)), x)).otherwise(x)

    opened = F.filter(F.map_entries("gaps"), lambda g: g["key"] <= F.col("pos"))
    before = F.coalesce(F.aggregate(opened, F.lit(0), lambda s, g: s + g["value"]), F.lit(0))
    row = F.concat(
        F.repeat(F.lit(" "), (F.col("pos") - F.col("start")).cast("int") + before),
        F.array_join(F.when(F.col("gaps").isNull(), F.col("_shown")).otherwise(F.transform("_shown", stretched)), ""),
        F.lit(" " * TEXT_GAP),
        F.when(F.col("reverse"), "R").otherwise(" "),
    )
    return j.select("ref", "start", "pos", "pair_id", "mate", row.alias("row"))


def reference_rows(regions: DataFrame, aligned: DataFrame, chunks: DataFrame, size: int, chunk: int = 1024) -> DataFrame:
    """The reference line ``(ref, start, row)`` over the rows of each region, with '_' where reads have insertions."""
    open_gaps = gaps(region_reads(regions, aligned, chunk))
    pieces = coverage.region_pieces(regions.where("stop > start").select("ref", F.col("start").alias("pos"), "stop"), chunks, size)
    lines = pieces.withColumnRenamed("pos", "start").join(open_gaps, ["ref", "start"], "left")
    cells = F.transform(F.split("bases", ""), lambda x, i: F.concat(F.repeat(F.lit(BLANK), _width(F.col("at") + i)), x))
    text = F.when(F.col("gaps").isNull(), F.col("bases")).otherwise(F.array_join(cells, ""))
    parts = F.array_sort(F.collect_list(F.struct("at", text.alias("text"))))
    return lines.groupBy("ref", "start").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("row"))
