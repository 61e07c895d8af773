"""Similarity of genome pieces: shared k-mers and joint compressibility."""

from __future__ import annotations

import bz2
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from helicase.operators.kmers import expanded

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PAIR = T.StructType().add("x", T.IntegerType()).add("y", T.IntegerType()).add("shared", T.LongType())


def shared_kmers(kmers: DataFrame, piece: Column, grid: int) -> DataFrame:
    """Distinct k-mers of each piece and of each pair of pieces: ``(x, y, x_kmers, y_kmers, shared)``.

    ``piece`` numbers the pieces 0..grid-1; pairs without shared k-mers are left
    out. K-mers with the same set of pieces collapse into one weighted set (of
    at most ``grid`` members); every task then adds its sets up in one
    grid-by-grid product, so no k-mer is spread out into pairs of rows.
    """
    member = kmers.select(piece.cast("int").alias("piece"), "kmer").where(F.col("piece").between(0, grid - 1))
    sets = (
        member.groupBy("kmer")
        .agg(F.array_sort(F.collect_set("piece")).alias("pieces"))
        .groupBy("pieces")
        .agg(F.count("*").alias("n"))
    )

    def gram(batches):
        total = np.zeros((grid, grid), dtype="int64")
        for pdf in batches:
            rows = np.repeat(np.arange(len(pdf)), pdf["pieces"].map(len).to_numpy(dtype="int64"))
            cols = np.concatenate(pdf["pieces"].to_list()) if len(pdf) else np.zeros(0, "int64")
            x = np.zeros((len(pdf), grid), dtype="float64")
            x[rows, cols] = 1.0
            total += np.rint(x.T @ (x * pdf["n"].to_numpy(dtype="float64")[:, None])).astype("int64")
        i, j = np.nonzero(total)
        yield pd.DataFrame({"x": i.astype("int32"), "y": j.astype("int32"), "shared": total[i, j]})

    cells = sets.mapInPandas(gram, PAIR).groupBy("x", "y").agg(F.sum("shared").alias("shared"))
    own = F.when(F.col("x") == F.col("y"), F.col("shared"))
    # A row of the grid per window group; the counts above run once.
    return cells.select(
        "x",
        "y",
        F.max(own).over(W.partitionBy("x")).alias("x_kmers"),
        F.max(own).over(W.partitionBy("y")).alias("y_kmers"),
        "shared",
    )


def shared_by_name(kmers: DataFrame, name: str) -> DataFrame:
    """Sizes of the intersections of named sets of k-mers: ``(x, y, shared)`` for each ordered pair that shares any, a set with itself included.

    K-mers with the same names collapse into one weighted set before pairs of names are formed, so the pairs grow with
    the different sets of names and not with the k-mers.
    """
    sets = (
        kmers.groupBy("kmer").agg(F.array_sort(F.collect_set(name)).alias("names"))
        .groupBy("names").agg(F.count("*").alias("n"))
    )
    x = sets.select("n", "names", F.explode("names").alias("x"))
    return x.select("n", "x", F.explode("names").alias("y")).groupBy("x", "y").agg(F.sum("n").alias("shared"))


@F.pandas_udf(T.IntegerType())
def bz2_size(text: pd.Series) -> pd.Series:
    """Size of the bzip2 form of each text."""
    return text.map(lambda t: len(bz2.compress(t.encode(), 9))).astype("int32")


def joint_compression(pieces: DataFrame, grid: int) -> DataFrame:
    """``(x, y, x_size, y_size, joint, ratio)`` for all pairs of ``pieces(piece, text)``.

    The result has grid*grid rows by definition. Each piece is sent to every
    partner number and meets the partner's text in an equi-join.
    """
    one = pieces.select(F.col("piece").alias("x"), F.col("text").alias("_xt"), bz2_size("text").alias("x_size"))
    two = pieces.select(F.col("piece").alias("y"), F.col("text").alias("_yt"), bz2_size("text").alias("y_size"))
    wide = one.withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))))
    return (
        expanded(wide).join(two, "y")
        .withColumn("joint", bz2_size(F.concat("_xt", "_yt")))
        .select("x", "y", "x_size", "y_size", "joint", (F.col("joint") / (F.col("x_size") + F.col("y_size"))).alias("ratio"))
    )
