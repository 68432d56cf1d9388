"""Tier boundaries of every rule."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lodgelake.functions.columns import (
    discount_label, discount_percent, is_peak, refund_charge_rate, season_name,
)
from lodgelake.operators import bookings as B
from lodgelake.operators import reports as R


@pytest.mark.parametrize("days,pct", [(0, 0), (44, 0), (45, 10), (59, 10), (60, 20), (79, 20), (80, 30), (90, 30),
                                      (91, 0), (400, 0)])
def test_discount_tiers(spark, days, pct):
    r = spark.range(1).select(discount_percent(F.lit(days)).alias("p"), discount_label(F.lit(days)).alias("l")).first()
    assert r.p == pct
    assert r.l == "No discount" if pct == 0 else r.l.startswith(f"{pct}% (")


@pytest.mark.parametrize("days,rate", [(0, "1.00"), (6, "1.00"), (7, "0.50"), (14, "0.50"), (15, "0.25"),
                                       (29, "0.25"), (30, "0.00"), (365, "0.00")])
def test_refund_tiers(spark, days, rate):
    assert str(spark.range(1).select(refund_charge_rate(F.lit(days)).alias("r")).first().r) == rate


@pytest.mark.parametrize("month,peak", [(1, False), (3, False), (4, True), (8, True), (9, False), (10, False),
                                        (11, True), (12, True)])
def test_peak_months(spark, month, peak):
    r = spark.range(1).select(is_peak(F.lit(dt.date(2026, month, 15))).alias("p"),
                              season_name(F.lit(dt.date(2026, month, 15))).alias("n")).first()
    assert r.p == peak and r.n == ("Peak Season" if peak else "Off-Peak Season")


def test_check_in_today_is_neither_upcoming_nor_past(spark):
    b = spark.createDataFrame(
        [(1, 7, dt.date(2026, 1, 10), dt.date(2026, 1, 12), 100, "confirmed"),
         (2, 7, dt.date(2026, 1, 11), dt.date(2026, 1, 13), 100, "confirmed"),
         (3, 7, dt.date(2026, 1, 1), dt.date(2026, 1, 3), 50, "cancelled")],
        "booking_id long, user_id long, check_in date, check_out date, total_price int, status string",
    ).withColumn("total_price", F.col("total_price").cast("decimal(10,2)"))
    users = spark.createDataFrame([(7,), (8,)], "id long")
    got = {r.user_id: r for r in R.user_dashboard_stats(users, b, "2026-01-10 08:00:00").collect()}
    assert (got[7].total_bookings, got[7].upcoming_bookings, got[7].past_bookings) == (3, 1, 1)
    assert got[8].total_bookings == 0 and str(got[8].total_spent) == "0.00"
    flags = {r.booking_id: r.is_upcoming for r in B.upcoming_flags(b, "2026-01-10 08:00:00").collect()}
    assert flags == {1: 0, 2: 1, 3: 0}


def test_empty_tables_give_zero(spark):
    b = spark.createDataFrame([], "booking_id long, user_id long, hotel_id long, status string, "
                                  "total_price decimal(10,2), booking_date timestamp_ntz")
    r = R.booking_status_stats(b).first()
    assert (r.confirmed, r.pending, r.cancelled, str(r.revenue)) == (0, 0, 0, "0.00")
    t = R.report_totals(R.monthly_sales(b, "last_6_months", "2026-01-10 08:00:00")).first()
    assert (t.total_bookings, t.avg_booking_value) == (0, 0.0)


def test_custom_range_ends_at_midnight(spark):
    b = spark.createDataFrame(
        [(1, dt.datetime(2026, 1, 31, 0, 0)), (2, dt.datetime(2026, 1, 31, 8, 0)), (3, dt.datetime(2026, 1, 1, 0, 0))],
        "booking_id long, booking_date timestamp_ntz").withColumn("total_price", F.lit(10).cast("decimal(10,2)"))
    m = R.monthly_sales(b, "custom", "2026-02-10 00:00:00", "2026-01-01", "2026-01-31").first()
    assert m.bookings == 2


def test_date_texts_ignore_session_time_zone(spark):
    from lodgelake.functions.columns import day_fmt, day_time_fmt, iso_day, month_key, month_name

    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        # 02:30 on 7 Apr 1996 does not exist in New York (clocks jumped to 03:00)
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        df = spark.sql("SELECT TIMESTAMP_NTZ '1996-04-07 02:30:00' AS t, DATE '2026-01-05' AS d, "
                       "TIMESTAMP_NTZ '2026-01-05 17:09:00' AS p, TIMESTAMP_NTZ '2026-01-05 00:05:00' AS m")
        r = df.select(day_time_fmt("t").alias("a"), day_fmt("d").alias("b"), day_time_fmt("p").alias("c"),
                      day_time_fmt("m").alias("e"), month_key("t").alias("k"), month_name("d").alias("n"),
                      iso_day("t").alias("i")).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert (r.a, r.b, r.c, r.e) == ("07 Apr 1996 at 02:30 AM", "05 Jan 2026", "05 Jan 2026 at 05:09 PM",
                                    "05 Jan 2026 at 12:05 AM")
    assert (r.k, r.n, r.i) == ("1996-04", "Jan", "1996-04-07")
