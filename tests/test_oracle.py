"""Registered queries against their SQL twins; all of them with PAIRLOOM_ALL_QUERIES=1."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import compare  # noqa: E402

import __spark_entry__ as entry  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
SHORT = (
    "p8_pool_records", "p10_reasons", "w1_shot_chunks", "j3_assignments", "a4_capped_samples", "w6_ordered_uids", "j9_training_samples",
    "a18_full_stats", "a20_quantiles", "a25_pairwise_metrics", "a27_preference_loss", "p33_both_order_messages", "w8_running_best", "x3_metric_rollup",
    "w5_draw_facts", "j3_two_shards", "a9_dataset_counters", "k8_write_missing", "k2_uid_map_json", "s7_bad_documents", "s12_shard_list",
    "a18_group_stats", "a20_quantiles_per_tensor", "p33_profile_messages", "l1_natural_sort", "w10_prompt_selection",
)
NAMES = list(entry.queries()) if os.environ.get("PAIRLOOM_ALL_QUERIES") else SHORT

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are absent")


@pytest.fixture(scope="module")
def tables():
    return compare.connect(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, tables, name):
    ok, note = compare.compare(spark, tables, name, FOLDER)
    assert ok, note


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
