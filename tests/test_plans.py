"""What the physical plans must and must not contain."""

import re

import pytest

from __spark_entry__ import queries
from helpers import flow, flows, operators, packet, packets
from netloom.catalog.views import Source
from netloom.operators import flows as O
from netloom.operators import tcp as T
from netloom.operators.detectors import destination_totals
from netloom.config import Tuning
from netloom.operators.rebuild import rebuild
from netloom.operators.scan import Plain
from netloom.sources.networks import Networks

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture
def static(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield spark
    spark.conf.set("spark.sql.adaptive.enabled", "true")


@pytest.mark.parametrize("name", sorted(n for n in queries() if n[0] in "bdefhp" or n.startswith("c") if n != "pipeline"))
def test_no_cross_join_and_no_row_udf(static, name):
    plan = operators(queries()[name](static, FOLDER))
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_flow_aggregate_is_one_hash_shuffle(static):
    plan = operators(O.build_flows(packets(static, [packet(1)])))
    assert plan.count("Exchange") == 1 and "SortAggregate" not in plan


def test_segment_labels_share_one_shuffle_and_sort(static):
    rows = T._paired(Source(static, FOLDER).segments)
    plan = operators(T._label_group(rows, Plain(T.PAIR, "frame_number")))
    assert plan.count("Exchange hashpartitioning") == 1 and len(re.findall(r"\bSort \[", plan)) == 1


def test_ranges_of_segments_fall_away_without_large_groups(spark):
    """One plan, built without a job; the table of large groups is found empty at run time."""
    tracker = spark.sparkContext.statusTracker()
    rows = Source(spark, FOLDER).segments
    spark.sparkContext.setJobGroup("labels", "")
    labels = T.label_segments(rows)
    assert not tracker.getJobIdsForGroup("labels")
    spark.sparkContext.setJobGroup("", "")
    labels.collect()
    final = labels._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in final
    assert "_range" not in final[:final.index("== Initial Plan ==")]


def test_trust_is_judged_after_the_aggregate(static):
    plan = operators(destination_totals(flows(static, [flow(1)]), Networks(), Tuning()))
    below = plan[plan.index("Exchange") :]
    assert "lambda" not in below and "RLIKE" not in below


@pytest.mark.parametrize("name", ["e01_tags_to_alerts", "e08_rate_limit", "f15_threat_summary", "f21_grouped_alerts", "f24_related_alerts", "f29_alert_context"])
def test_ranks_are_limited_before_the_shuffle(static, name):
    plan = operators(queries()[name](static, FOLDER))
    assert "Partial" in "".join(re.findall(r"WindowGroupLimit.*", plan))


def test_pages_are_top_k(static):
    for name in ("f07_top_connections", "f12_top_talkers", "f14_recent_alerts", "f20_alert_page"):
        assert "TakeOrderedAndProject" in operators(queries()[name](static, FOLDER))


def test_session_filter_reaches_the_partitions(static, tmp_path):
    from netloom.functions.predicates import in_session
    from netloom.sinks import tables as T

    T.write_connections(flows(static, [flow(1), flow(2, session_id=2)]), str(tmp_path))
    plan = operators(in_session(T.read_table(static, str(tmp_path), "connections"), 2))
    assert re.search(r"PartitionFilters: \[isnotnull\(session_id#\d+\), \(session_id#\d+ = 2\)\]", plan)


def test_dedup_moves_only_repeated_rows(static):
    two = packets(static, [packet(1), packet(1), packet(2)])
    plan = operators(O.dedup_frames(two))
    assert "BroadcastHashJoin" in plan and plan.count("Exchange hashpartitioning") == 1
    static.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if the list were large
    try:
        assert "SortMergeJoin" in operators(O.dedup_frames(two)) and O.dedup_frames(two).count() == 2
    finally:
        static.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_rebuild_reads_its_packets_once_in_columns(static):
    flows, counters = rebuild(packets(static, [packet(1), packet(1), packet(2)]))
    assert operators(flows.unionByName(flows)).count("Scan") == 2 and operators(counters).count("Scan ExistingRDD") == 0
