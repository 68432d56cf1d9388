"""Deep pages by a seek equal the offset form; files of several schema versions read as one table."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import rows
from lodgelake.operators.pages import page_marks, seek_page
from lodgelake.sources import generations as G


@pytest.mark.parametrize("desc", [False, True])
def test_pages_equal_the_offset_form(spark, scratch, desc):
    rng = random.Random(2)
    data = [(i, rng.randrange(30), rng.choice("abc"), i * 7919 % 5000) for i in range(5000)]
    df = spark.createDataFrame(data, "n long, price int, title string, id long").repartition(5)
    order = [("price", desc), ("title", not desc), ("id", desc)]
    df.write.parquet(scratch + "/t")
    df = spark.read.parquet(scratch + "/t")
    marks = page_marks(df, order, step=100, num_buckets=7)
    assert marks.count() == 50
    by = [F.col(c).desc() if d else F.col(c).asc() for c, d in order]
    whole = [tuple(r) for r in df.orderBy(*by).collect()]
    for offset in (0, 9, 99, 100, 101, 2500, 4990, 4999, 5000, 70_000):
        page = seek_page(df, order, marks, offset, 8)
        assert [tuple(r) for r in page.collect()] == whole[offset:offset + 8]
    plan = seek_page(df, order, marks, 4500, 8)._jdf.queryExecution().executedPlan().toString()
    assert ("LessThanOrEqual(price," if desc else "GreaterThanOrEqual(price,") in plan
    assert "TakeOrderedAndProject(limit=8" in plan.replace("limit=8, offset=0", "limit=8")


def test_page_ten_thousand(spark):
    df = spark.range(200_000).select(F.col("id"), (F.col("id") * 7919 % 1000).cast("int").alias("price"))
    order = [("price", False), ("id", False)]
    marks = page_marks(df, order, step=1000)
    got = [tuple(r) for r in seek_page(df, order, marks, 9 + 9998 * 8, 8).collect()]
    want = [tuple(r) for r in df.orderBy("price", "id").offset(9 + 9998 * 8).limit(8).collect()]
    assert got == want and len(got) == 8


def test_three_generations_read_as_one(spark, scratch):
    one = spark.createDataFrame([(1, 5, "12", "Single", "10.5")], "room_id int, hotel_id int, number string, room_type string, p string") \
        .selectExpr("room_id", "hotel_id", "number", "room_type", "CAST(p AS DECIMAL(7,1)) AS price")
    two = spark.createDataFrame([(2, 5, "13", "Double", "booked", 2)],
                                "room_id long, hotel_id long, room_number string, room_type string, status string, capacity int") \
        .withColumn("price", F.lit("20.25").cast("decimal(10,2)"))
    three = two.withColumn("room_id", F.lit(3).cast("long")).withColumn("features", F.lit("TV")).withColumn("floor", F.lit(9)) \
        .withColumn("status", F.lit(None).cast("string"))
    for k, df in enumerate((one, two, three)):
        G.write_generation(df, scratch, k)
    got = G.load_generations(spark, scratch, "rooms", {"room_number": "number"})
    assert rows(got, "room_id", "room_number", "status", "capacity", "features") == [
        (1, "12", None, 1, None), (2, "13", "booked", 2, None), (3, "13", None, 2, "TV")]
    assert [str(r.price) for r in got.orderBy("room_id").collect()] == ["10.50", "20.25", "20.25"]
    plan = got.where("room_id = 2").select("room_type")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PushedFilters: [IsNotNull(room_id), EqualTo(room_id,2)]") >= 2 and "floor" not in plan
    # more files of an old version may come later
    G.write_generation(one.withColumn("room_id", F.lit(7)), scratch, 0)
    assert G.load_generations(spark, scratch, "rooms", {"room_number": "number"}).count() == 4


def test_a_narrowing_is_refused(spark, scratch):
    G.write_generation(spark.createDataFrame([(1, "cheap")], "room_id long, price string"), scratch, 0)
    with pytest.raises(ValueError, match="rooms.price"):
        G.load_generations(spark, scratch, "rooms")
    d = T.DecimalType
    assert G.widens(T.IntegerType(), T.LongType()) and not G.widens(T.LongType(), T.IntegerType())
    assert G.widens(d(7, 1), d(10, 2)) and not G.widens(d(10, 1), d(10, 2)) and not G.widens(d(10, 3), d(12, 2))
    assert G.widens(T.DateType(), T.TimestampNTZType()) and not G.widens(T.TimestampNTZType(), T.DateType())
    assert G.widens(T.ShortType(), d(7, 2)) and not G.widens(T.LongType(), T.DoubleType())


def test_no_generation_is_an_empty_table(spark, scratch):
    assert G.load_generations(spark, scratch, "bookings").count() == 0
    assert dt.date  # typed columns all the same
    assert "booking_id" in G.load_generations(spark, scratch, "bookings").columns
