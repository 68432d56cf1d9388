"""S1 typed scans and S5 schema evolution against stored domain tables."""

import os

from pyspark.sql import functions as F

from lodgelake import schema as S
from lodgelake.sources import sinks
from lodgelake.sources.tables import load


def test_typed_scan_uses_declared_schema(spark, views, scratch):
    root = scratch
    stored = sinks.conform(views.bookings, "bookings")
    stored.write.parquet(os.path.join(root, "bookings"))
    df = load(spark, root, "bookings")
    # file sources read every field as nullable; names and types are the declared ones
    assert [(f.name, f.dataType) for f in df.schema] == [(f.name, f.dataType) for f in S.struct_type("bookings")]
    assert df.count() == views.bookings.count()
    # a projection reads only its columns from the scan
    plan = df.select("booking_id", "status").filter(F.col("status") == "confirmed")._jdf.queryExecution() \
        .executedPlan().toString()
    assert "ReadSchema: struct<booking_id:bigint,status:string>" in plan
    assert "PushedFilters: [IsNotNull(status), EqualTo(status,confirmed)]" in plan


def test_password_never_loaded(spark, scratch):
    users = spark.createDataFrame([(1, "a", "a@x.io", "secret", "user", 1)],
                                  "id long, username string, email string, password string, role string, status int")
    users.write.parquet(os.path.join(scratch, "users"))
    df = load(spark, scratch, "users")
    assert "password" not in df.columns


def test_ensure_columns_adds_typed_nulls(views):
    wide = sinks.ensure_columns(views.bookings, "bookings")
    assert set(S.struct_type("bookings").fieldNames()) <= set(wide.columns)
    assert dict(wide.dtypes)["advance_discount_percent"] == "decimal(5,2)"


def test_json_rows(views):
    r = sinks.to_json_rows(views.hotels.limit(1), key="hotel_id").first()
    assert r.json.startswith('{"hotel_id":')


def test_partitioned_bookings_prune_months(spark, views, scratch):
    from lodgelake.operators.reports import monthly_sales

    sinks.write_bookings(views.bookings, scratch)
    stored = sinks.load_bookings(spark, scratch)
    got = monthly_sales(stored, "last_6_months", "1998-06-15 10:30:00")
    want = monthly_sales(views.bookings, "last_6_months", "1998-06-15 10:30:00")
    assert sorted(got.collect()) == sorted(want.collect())
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(booking_month" in plan


def test_hot_month_is_written_by_many_tasks(spark, views, scratch):
    # every booking in one month: the range partitioning still spreads the write over tasks/files
    hot = views.bookings.withColumn("booking_date", F.lit("1998-03-15 12:00:00").cast("timestamp_ntz"))
    sinks.write_bookings(hot, scratch, num_partitions=4)
    files = [f for f in os.listdir(os.path.join(scratch, "bookings", "booking_month=1998-03"))
             if f.endswith(".parquet")]
    assert len(files) >= 2
    assert sinks.load_bookings(spark, scratch).count() == views.bookings.count()
