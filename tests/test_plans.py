"""Physical-plan properties that matter at scale (checked on the executed plan text)."""

import re

import pytest

from conftest import SF_SMALL
from lodgelake.plans.registry import QUERIES


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_or_nested_loop_join(spark, name):
    p = plan(QUERIES[name](spark, SF_SMALL))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, name


def test_paging_is_one_top_k(spark):
    p = plan(QUERIES["hotel_search_price_low_page2"](spark, SF_SMALL))
    assert "TakeOrderedAndProject(limit=17, offset=9" in p


def test_per_user_top_n_limits_before_shuffle(spark):
    p = plan(QUERIES["user_recent_bookings"](spark, SF_SMALL))
    assert re.search(r"WindowGroupLimit .*Partial", p) and re.search(r"WindowGroupLimit .*Final", p)


def test_reports_aggregate_map_side(spark):
    for name in ("hotel_performance", "top_customers", "user_dashboard_stats", "hotel_inventory"):
        p = plan(QUERIES[name](spark, SF_SMALL))
        assert "partial_count" in p or "partial_sum" in p, name


def test_booking_fold_never_windows_a_whole_booking(spark):
    p = plan(QUERIES["apply_booking_commands"](spark, SF_SMALL))
    specs = re.findall(r"windowspecdefinition\(([^)]*)\)", p)
    assert specs
    for spec in specs:
        # every window is bounded by a slice: rows per (booking, minute), minute summaries per
        # (booking, day), day summaries per booking -- never a booking's rows ordered by time
        assert re.search(r"_b\d", spec), spec
        assert not re.match(r"booking_id#\d+L?, ts#", spec), spec


def test_booking_fold_deals_each_level_once(spark):
    """The outcome of the log needs no joins back to commands: one exchange a level, and commands are scanned once."""
    from lodgelake.operators.changes import apply_booking_commands

    bookings = spark.createDataFrame([], "booking_id long, user_id long, status string")
    cmds = spark.range(9).selectExpr("id AS seq", "timestamp_ntz '2024-01-01' AS ts", "id AS booking_id",
                                     "id AS actor_id", "'user_cancel' AS command")
    p = plan(apply_booking_commands(bookings, cmds))
    assert len(re.findall(r"\bWindow\b", p)) == 3 and len(re.findall(r"\bRange \(", p)) == 1


def test_batches_compare_rows_in_place(spark, views, scratch):
    """A batch finds the rows it changed without another join of all old and new rows on every column."""
    from pyspark.sql import functions as F

    from lodgelake.operators.changes import apply_booking_commands
    from lodgelake.streaming.state import CommandState

    bookings = views.bookings.withColumn("cancellation_date", F.lit(None).cast("timestamp_ntz"))
    state = CommandState(spark, scratch, bookings.schema, "booking_id")
    state.start(bookings)
    seen = []
    state.write_changes = lambda batch_id, rows: seen.append(plan(rows))
    state.apply(0, views.booking_commands, apply_booking_commands)
    assert "LeftAnti" not in seen[0]


def _dealt_by(p: str) -> set[str]:
    return {re.sub(r"#\d+L?", "", m) for m in re.findall(r"Exchange hashpartitioning\(([^)]*), \d+\)", p)}


def test_folds_are_dealt_by_key_and_slice_without_broadcasts(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = plan(QUERIES["apply_booking_commands"](spark, SF_SMALL))
        assert "booking_id, _b0" in _dealt_by(p)
        # the first window over commands reads that exchange, not the join's
        chain = re.findall(r"(Window|Exchange hashpartitioning\([^)]*\)|SortMergeJoin)", p)
        assert not any(a == "Window" and b.startswith("SortMergeJoin") for a, b in zip(chain, chain[1:]))
        p = plan(QUERIES["apply_account_commands"](spark, SF_SMALL))
        assert "user_id, _s0" in _dealt_by(p)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_city_rates_are_not_forced_to_broadcast(spark):
    import inspect

    from lodgelake.operators import pricing
    assert "F.broadcast(" not in inspect.getsource(pricing)
