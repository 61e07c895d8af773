"""A training corpus from raw documents: quality, near duplicates, benchmark passages, packed sequences."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helicase.llm import decontaminate, jaccard, packing, quality
from helicase.llm.common import numbered, read, staged


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier scores a half or more."""
    return quality.keep(docs, read(spark, sf_dir, "labels"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id.

    Rows with a null doc_id can't be chosen among and stay. Different texts of one doc_id are documents of their own, in the
    order of their hashes; of rows that agree in doc_id and text one stays, if its group keeps it.
    """
    if docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").isEmpty():
        groups = staged(jaccard.join(docs, k=5, percent=80), "groups")
        spare = staged(groups.filter("doc_id is not null and doc_id <> component_id").select("doc_id").distinct(), "spare")
        return docs.join(spare, "doc_id", "left_anti").select(docs.columns)
    # some ids repeat: the documents are numbered in the order of id and text, and the numbers stand for the ids
    keyed = staged(docs.select("*", F.xxhash64("text").alias("text_hash")), "keyed")
    ids = staged(keyed.filter("doc_id is not null").select(F.lit(0).alias("all"), "doc_id", "text_hash").distinct(), "ids")
    ids = staged(numbered(ids, "all", "doc_id", "text_hash").select("doc_id", "text_hash", "idx"), "numbers")
    single = keyed.filter("doc_id is not null").dropDuplicates(["doc_id", "text_hash"]).join(ids, ["doc_id", "text_hash"])
    single = staged(single.unionByName(keyed.filter("doc_id is null").withColumn("idx", F.lit(None).cast("bigint"))), "single")
    groups = jaccard.join(single.select(F.col("idx").alias("doc_id"), "text"), k=5, percent=80)
    spare = staged(groups.filter("doc_id is not null and doc_id <> component_id").select(F.col("doc_id").alias("idx")), "spare")
    return single.join(spare, "idx", "left_anti").select(docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 1024 tokens, with their ids."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2, size=1024, keep_ids=True)


STAGES = [
    ("quality", good_quality),
    ("near duplicates", one_of_each_group),
    ("decontamination", without_benchmark),
    ("packing", packed),
]

#: Training a classifier has no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each over all that the one before kept, as written and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
SQL = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
