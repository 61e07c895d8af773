"""Plans must stay free of nested-loop joins, and of single-task exchanges over data."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry

# Windows over results of a fixed small size: chromosomes, Q values, codons, read
# lengths and positions, top lists.
SMALL_WINDOWS = {
    "w09_chromosome_offsets", "a03_qhisto", "a09_duplicates", "a09_document_copies", "a25_start_codons", "w04_begin_trim",
    "w06_index_lengths", "a27_kmer_top", "j15_best_reference", "j13_earlier_places",
}
EAGER = {"i01_stitch", "i02_self_encoding", "a36_encoding_totals"}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - EAGER))
def test_plan(spark, sf_dir, name):
    text = plan(entry.queries()[name](spark, sf_dir))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    if name not in SMALL_WINDOWS:
        assert not re.search(r"Window [^\n]*\n[^\n]*(Sort[^\n]*\n[^\n]*)?Exchange SinglePartition", text)


def test_scans_read_only_needed_columns(spark, sf_dir):
    text = plan(entry.queries()["j19_pool_pivot"](spark, sf_dir))
    schema = re.search(r"ReadSchema: struct<([^>]*)", text).group(1)
    assert "l_tax" not in schema and "l_comment" not in schema


def test_filters_reach_the_prefix_index(spark, sf_dir, tmp_path):
    from helicase.operators import prefixes
    from helicase.plans import stages

    prefixes.write_prefix_index(stages.reads(spark, sf_dir), str(tmp_path / "idx"), buckets=8)
    index = prefixes.read_prefix_index(spark, str(tmp_path / "idx"), 8)
    hit = plan(index.where("prefix = 'ACGT'"))
    assert "PushedFilters: [IsNotNull(prefix), EqualTo(prefix,ACGT)]" in hit
    texts = stages.reads(spark, sf_dir).select(F.xxhash64("nucs").alias("text_id"), F.col("nucs").alias("text"))
    round_of = plan(prefixes.stitch_step(texts, index))
    assert "Bucketed: true" in round_of and len(re.findall(r"Exchange hashpartitioning\(prefix", round_of)) <= 1


@pytest.mark.parametrize("name", ["j02_exact_map", "j04_seed_triplets", "j13_earlier_places", "j15_best_reference", "a37_neighbour_upgrade"])
def test_window_tables_are_never_broadcast(spark, sf_dir, name):
    # Windows are far larger than the file they come from, which is all that the
    # planner sees of them.
    text = plan(entry.queries()[name](spark, sf_dir))
    assert "SortMergeJoin" in text
    for side in text.split("BroadcastExchange")[1:]:
        first = re.search(r"(?<!Broadcast)Exchange|FileScan", side)
        assert "Generate explode" not in side[: first.start() if first else None]


def test_windows_of_entries_and_reads_are_not_broadcast(spark, sf_dir):
    text = plan(entry.queries()["j11_prefix_lookup"](spark, sf_dir))
    for side in text.split("BroadcastExchange")[1:]:
        first = re.search(r"(?<!Broadcast)Exchange|FileScan", side)
        assert "Generate" not in side[: first.start() if first else None]
    assert re.search(r"SortMergeJoin \[prefix", text)
