"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)
# Python workers import the package, too
os.environ["PYTHONPATH"] = os.pathsep.join([HERE, *filter(None, [os.environ.get("PYTHONPATH")])])

from docattr import catalog, session  # noqa: E402
from docattr.catalog import registry  # noqa: E402

HEADLINE = [
    "F05_quality_gate", "J01_inner_distinct", "J03_left_chain", "J07_relational_division", "J14_related_pairs_in_group",
    "A01_partition_summary", "A02_most_common", "A04_summary", "A08_worker_report", "A09_vote_table", "A11_krippendorff_alpha",
    "A13_canonical_identity", "A18_keyed_metrics", "A23_permutation_test_accuracy", "W01_cumulative_share", "W02_keep_first",
    "W03_first_k", "W06_greedy_packing", "W09_failure_breaker", "X01_links_in_order", "X07_definition_block", "X09_script_segments",
    "P04_ascii_fold", "P20_budget_and_labels", "M03_typed_tokens", "M04_cued_attributes", "M05_find_mentions", "M12_entity_segments",
    "M13_contexts_first", "M14_document_prompts", "J10_greedy_matching", "R02_inject_negatives", "R05_best_split",
    "R06_few_shot_entity", "G01_connected_components", "G03_leakage_safe_split", "G04_greedy_cover", "V01_cosine_similarity",
    "V05_best_candidate", "ST1_resumable_ingestion", "R03_multiclass_samples", "M09_anonymise_with_spans", "J12_spans_in_paragraphs", "P21_entity_mask",
    "G02_component_numbers", "G06_tagged_bridge", "ST2_failure_breaker", "M14_segment_prompts",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    catalog.load()
    spark = session.build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g",
        "spark.ui.showConsoleProgress": "false", registry.READ_TASKS: cpus})
    spark.sparkContext.setLogLevel("ERROR")
    # start the engine before the first measurement
    registry.table(spark, sf_dir, "lineitem").groupBy("l_returnflag").count().collect()
    times = {}
    for name in names:
        start = time.time()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({
        "metric": "total wall time of the headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
