"""Inputs and mapping results shared by the table-driven queries of one application."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from helicase.plans.mapper import Mapping
from helicase.session import materialise
from helicase.sources import tables

_made: dict[tuple, object] = {}


def _once(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], object]):
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _made:
        _made[key] = make()
    return _made[key]


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived read pairs, written once as a table, as imported FASTQ would be."""
    return _once(spark, sf_dir, "reads", lambda: materialise(tables.reads(spark, sf_dir), "reads"))


def reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.reference(spark, sf_dir)


def reference_ext(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference chunks with overhang, written once as an imported genome would be."""
    return _once(
        spark, sf_dir, "ext", lambda: materialise(tables.reference_ext(spark, sf_dir), "reference", spread=2)
    )


def mapping(spark: SparkSession, sf_dir: str) -> Mapping:
    """One mapping run; its narrow result tables serve all report queries."""
    return _once(
        spark,
        sf_dir,
        "mapping",
        lambda: Mapping(
            reads(spark, sf_dir),
            reference(spark, sf_dir),
            tables.CHUNK,
            tables.READ_LENGTHS,
            tables.MAX_SPAN,
            stage=materialise,
            chunks_ext=reference_ext(spark, sf_dir),
        ),
    )
