"""Which lines occur in which files."""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, functions as F


def line_key(line):
    """Comparison key: ASCII case folded, digit strings by their number."""
    folded = F.translate(line, string.ascii_uppercase, string.ascii_lowercase)
    bare = F.ltrim(folded, F.lit("0"))
    return F.when(folded.rlike("^[0-9]+$"), F.when(bare == "", "0").otherwise(bare)).otherwise(folded)


def split_lines(docs: DataFrame, text: str = "text", file: str = "file") -> DataFrame:
    """Trimmed, non-empty lines: ``(file, line)``."""
    return (
        docs.select(F.col(file).alias("file"), F.explode(F.split(text, "\n")).alias("line"))
        .withColumn("line", F.regexp_replace("line", r"^\s+|\s+$", ""))
        .where("line <> ''")
    )


def members(lines: DataFrame) -> DataFrame:
    """Each distinct line with each file that holds it: ``(line, file)``."""
    return lines.select(line_key(F.col("line")).alias("line"), "file").distinct()


def presence(lines: DataFrame) -> DataFrame:
    """Per distinct line how many files hold it, and which set of files it is: ``(line, set_id, n_files)``.

    ``set_id`` combines 60-bit hashes of the files, so that a line that stands in every file
    stays one short row. The set itself is in :func:`members`.
    """
    digest = F.conv(F.substring(F.md5(F.col("file").cast("string").cast("binary")), 1, 15), 16, 10).cast("long")
    return members(lines).groupBy("line").agg(F.bit_xor(digest).alias("set_id"), F.count("*").alias("n_files"))


def presence_groups(present: DataFrame) -> DataFrame:
    """Number of lines per set of files."""
    return present.groupBy("set_id", "n_files").agg(F.count("*").alias("n_lines"))
