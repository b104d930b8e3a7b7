"""Physical plans: no cross products, pushed filters, pruned columns."""

import re

import pytest

from docattr import catalog
from docattr.catalog import registry

catalog.load()
NO_PAIRS = ["J09_blocked_fuzzy_join", "J11_best_unique_match", "J13_alias_join", "J14_related_pairs_in_group", "J15_grouped_pairs_similarity",
            "R02_inject_negatives", "R03_multiclass_samples", "R05_best_split", "R06_few_shot_entity", "A11_krippendorff_alpha",
            "A21_accuracy_at_k", "W01_cumulative_share", "G03_leakage_safe_split"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NO_PAIRS)
def test_no_cross_products(name, spark, sf_dir):
    text = plan(registry.QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    text = plan(registry.QUERIES["F04_threshold_conjunction"](spark, sf_dir))
    assert "PushedFilters: [IsNotNull(o_totalprice)" in text
    assert "o_orderdate" not in re.search(r"ReadSchema: (.*)", text).group(1)


def test_row_local_operators_do_not_shuffle_by_key(spark, sf_dir):
    for name in ("W05_prefix_offsets", "W06_greedy_packing", "X09_script_segments", "M04_cued_attributes"):
        assert "hashpartitioning" not in plan(registry.QUERIES[name](spark, sf_dir))


def test_roster_not_text_is_the_broadcast_side(spark, sf_dir):
    text = plan(registry.QUERIES["M05_find_mentions"](spark, sf_dir))
    assert "BuildRight" in text and "BuildLeft" not in text
