"""Plans as they would be for large tables: automatic broadcasts off."""

import re

import pytest

from __spark_entry__ import queries

# query: number of hash shuffles
SHUFFLES = {
    "c9_diff_stats_repeated_keys": 2, "c3_classify": 2, "c5_cell_changes": 2, "c8_delta_rows": 2, "c4_split_changes": 2, "c12_annotated_delta": 2,
    "c1_last_per_key": 1, "m1_merge_newest_columns": 1, "m2_upsert_records": 2, "e2_entity_state": 1, "e3_entity_history": 1,
    "m12_track_keys_by_file": 1, "f5_latest_per_dir": 1, "f7_snapshot_pair": 1, "r12_limit_per_file": 1, "a2_value_counts": 1,
    "j3_filter_shared": 2, "j7_missing_keys": 2, "q2_where_eq": 0, "q4_query": 0, "t6_convert": 0, "a10_categorise": 0,
}


@pytest.fixture(autouse=True)
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", list(SHUFFLES))
def test_shuffles(name, spark, data, plan):
    text = plan(queries()[name](spark, data))
    tree = text.split("\n\n")[0]
    assert len(re.findall(r"Arguments: hashpartitioning", text)) == SHUFFLES[name]
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas"):
        assert bad not in tree


@pytest.mark.parametrize("name", ["c1_last_per_key", "c9_diff_stats_repeated_keys", "f5_latest_per_dir", "f6_recent_per_dir", "r12_limit_per_file"])
def test_groups_are_cut_before_the_shuffle(name, spark, data, plan):
    assert "WindowGroupLimit" in plan(queries()[name](spark, data))


def test_filters_and_columns_reach_the_scan(spark, data, plan):
    text = plan(queries()["q2_where_eq"](spark, data))
    assert "EqualTo(l_returnflag,R)" in text and "EqualTo(l_linenumber,3)" in text and "l_comment" not in text
    assert "l_shipdate" not in text and "l_extendedprice" not in text
    assert "GreaterThanOrEqual(o_orderdate" in plan(queries()["c3_classify"](spark, data))
