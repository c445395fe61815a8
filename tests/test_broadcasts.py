"""Tables that grow are merged: a broadcast one goes through the driver."""

import re

import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"


def broadcast_keys(df):
    """Keys of the broadcast joins in the plan, without their numbers; none for a join with one row."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return {tuple(re.findall(r"(\w+)#\d+", k)) for k in re.findall(r"BroadcastHashJoin \[([^\]]*)\]", plan)}


@pytest.mark.parametrize("name", ["c03_context_block", "c11_game_matrix"])
def test_only_calendar_days_are_broadcast(spark, name):
    assert broadcast_keys(__spark_entry__.queries()[name](spark, SF)) <= {("day",)}


def test_rows_with_all_windows_are_not_exchanged(spark):
    """The last exchange is that of the player windows: what is of teams was joined before it."""
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = __spark_entry__.queries()["c09_basketball_set"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert re.search(r"Exchange hashpartitioning\((\w+)#", plan).group(1) == "player_id"
