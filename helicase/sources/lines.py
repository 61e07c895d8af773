"""Text files with exact line numbers, without a single-task pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F


def blocks(spark: SparkSession, path: str) -> DataFrame:
    """Lines with the file, the split they came from and their order in it.

    ``(file, block, mid, value)``. Rows of one split stay together and in order,
    so ``mid`` is gapless inside a split.
    """
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("mid"),
        F.rtrim(F.col("value"), F.lit("\r")).alias("value"),
    )


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """``(file, line_no, value)`` with 0-based line numbers per file.

    One pass counts the lines of each split; a prefix sum over the splits (one
    row per split) gives each its first number.
    """
    b = blocks(spark, path)
    first = first_lines(b.groupBy("file", "block").agg(F.min("mid").alias("_lo"), F.count("*").alias("_n")))
    return b.join(first, ["file", "block"]).select(
        "file", (F.col("mid") - F.col("_lo") + F.col("_before")).alias("line_no"), "value"
    )


def first_lines(counts: DataFrame) -> DataFrame:
    """``counts(file, block, _n)``, a row for each split, with the lines ``_before`` it instead of ``_n``."""
    w = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    return counts.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n")


def carried(lines: DataFrame, **marks) -> DataFrame:
    """Adds, for every named column expression, its last value that isn't null at or before each line of a file.

    ``lines(file, block, mid, value)``. Values run on inside a split by a window over the split, and from split to split by a
    window over one row per split.
    """
    names = list(marks)
    marked = lines.select("*", *[e.alias(f"_m_{n}") for n, e in marks.items()])
    at = W.partitionBy("file", "block").orderBy("mid")
    own = marked.select(*lines.columns, *[F.last(f"_m_{n}", ignorenulls=True).over(at).alias(f"_o_{n}") for n in names])
    ends = marked.groupBy("file", "block").agg(*[F.max_by(f"_m_{n}", F.when(F.col(f"_m_{n}").isNotNull(), F.col("mid"))).alias(f"_e_{n}") for n in names])
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    ends = ends.select("file", "block", *[F.last(f"_e_{n}", ignorenulls=True).over(before).alias(f"_c_{n}") for n in names])
    return own.join(ends, ["file", "block"]).select(*lines.columns, *[F.coalesce(f"_o_{n}", f"_c_{n}").alias(n) for n in names])
