"""Month rewrites touch only the months of a change; the text index finds what the scan finds; JSON replies; registration."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from conftest import AS_OF, SF_SMALL, rows
from lodgelake.operators import accounts as A
from lodgelake.operators import catalog as C
from lodgelake.plans.registry import QUERIES
from lodgelake.sources.months import MonthTable


def _files(root):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(os.path.join(root, "data"))
            for f in fs if f.endswith(".parquet")}


def test_an_edit_of_one_month_leaves_the_other_files(spark, views, scratch):
    table = MonthTable(spark, scratch)
    table.write(views.bookings)
    with pytest.raises(ValueError, match="replace"):
        table.write(views.bookings)
    before = _files(scratch)
    month = F.col("booking_date").cast("string").startswith("1996-03")
    edits = views.bookings.where(month).withColumn("status", F.lit("pending"))
    assert table.replace(edits) == ["1996-03"]
    after = _files(scratch)
    assert {f: t for f, t in after.items() if f in before} == before
    new = set(after) - set(before)
    assert new and all("version=1/booking_month=1996-03" in f for f in new)
    got = table.read()
    assert got.count() == views.bookings.count()
    assert got.where(month & (F.col("status") != "pending")).isEmpty()
    # an old version reads as it was
    assert rows(table.read(0), "booking_id", "status") == rows(views.bookings, "booking_id", "status")


def test_moved_added_and_dropped_bookings(spark, views, scratch):
    table = MonthTable(spark, scratch)
    b = views.bookings.where("booking_id % 40 = 0")
    table.write(b)
    one = b.orderBy("booking_id").limit(1)
    moved = one.withColumn("booking_date", F.lit("2031-01-05 00:00:00").cast("timestamp_ntz"))
    added = one.withColumn("booking_id", F.lit(10**9).cast("long")).withColumn("booking_date", F.lit(None).cast("timestamp_ntz"))
    old_month = one.select(F.date_format("booking_date", "yyyy-MM")).first()[0]
    assert table.replace(moved.unionByName(added)) == sorted({old_month, "2031-01", "none"})
    got = table.read()
    assert got.count() == b.count() + 1
    assert {r.booking_month for r in got.where("booking_month IN ('2031-01', 'none')").collect()} == {"2031-01", "none"}
    # a month left empty is no longer listed, and a change that names nothing writes nothing
    assert table.replace(gone=spark.createDataFrame([(10**9,)], "booking_id long")) == ["none"]
    assert "none" not in table.months() and table.read().count() == b.count()
    assert table.replace(gone=spark.createDataFrame([(-5,), (None,)], "booking_id long")) == []
    assert table.version() == 2
    assert table.replace(gone=table.read().select("booking_id")) and table.read().count() == 0


def test_hotel_delete_rewrites_its_months_only(spark, views, scratch):
    table = MonthTable(spark, scratch)
    table.write(views.bookings)
    hotel = views.bookings.where("hotel_id >= 0").select("hotel_id").orderBy("hotel_id").limit(1)
    gone = views.bookings.join(hotel, "hotel_id", "left_semi")
    months = {r[0] for r in gone.select(F.date_format("booking_date", "yyyy-MM")).distinct().collect()}
    assert set(table.delete_hotels(hotel)) == months
    assert {m for m, v in table.months().items() if v == 1} <= months
    assert table.read().count() == views.bookings.count() - gone.count()


def test_touched_months_are_found_without_reading_rows(spark, views, scratch):
    table = MonthTable(spark, scratch)
    table.write(views.bookings)
    ids = spark.createDataFrame([(32,)], "booking_id long")
    plan = table.read().join(ids, "booking_id", "left_semi").select("booking_month").distinct() \
        ._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<booking_id:bigint>" in plan


# ------------------------------------------------------------------ C5

def test_index_finds_what_the_scan_finds(spark):
    rng = random.Random(4)
    hotels = [(i, "".join(rng.choice("aAbB 'é#") for _ in range(rng.randrange(0, 12)))) for i in range(400)] + [(1000, None)]
    terms = ["", "a", "B", "ab", "AB", "é#", "aba", "a b", "abab", "zz", "zab", "a" * 9, None, "'", "a"] + \
        [t[1:5] for _, t in hotels[:60] if t]
    h = spark.createDataFrame(hotels, "hotel_id long, title string")
    got = rows(C.hotel_text_search_many(h, spark.createDataFrame([(t,) for t in terms], "term string")), "term", "hotel_id")
    want = sorted((t, i) for t in {t for t in terms if t is not None} for i, x in hotels if x is not None and t.lower() in x.lower())
    assert got == want
    for t in ("ab", "aba"):
        assert [i for x, i in got if x == t] == rows(C.hotel_text_search(h, t), "hotel_id") or \
            [(i,) for x, i in got if x == t] == rows(C.hotel_text_search(h, t), "hotel_id")


def test_a_stored_index_gives_the_same(spark, views, scratch):
    C.text_index(views.hotels).write.parquet(scratch + "/index")
    terms = spark.createDataFrame([("00",), ("SUPP",), ("#000000001",), ("nothing",)], "term string")
    stored = C.hotel_text_search_many(views.hotels, terms, spark.read.parquet(scratch + "/index"))
    assert rows(stored) == rows(C.hotel_text_search_many(views.hotels, terms))
    assert stored.count() > 0


# ------------------------------------------------------------------ U5, S4

def test_registration_by_the_form(spark):
    users = spark.createDataFrame([(7, "old", "old@x.io", None, None, "user", 1)],
                                  "id long, username string, email string, created_at timestamp_ntz, "
                                  "last_login timestamp_ntz, role string, status int")
    form = spark.createDataFrame([(1, "OLD", "a@x.io"), (2, "new", "Old@X.io"), (3, "ab", "no-at"), (4, "AB", "b@x.io"),
                                  (5, "cd", "NO-AT"), (6, "", ""), (7, "cd", "b@x.io")],
                                 "request_id long, username string, email string")
    out = {r.request_id: (r.registered, r.message) for r in A.registration_outcomes(form, users).collect()}
    refused = (False, "Account already exists!")
    assert out == {1: refused, 2: refused, 3: (True, None), 4: refused, 5: refused, 6: (True, None), 7: (True, None)}
    new = A.register_users(form, users, AS_OF).collect()
    assert sorted((r.id, r.username, r.role, r.status) for r in new) == [(8, "ab", "user", 1), (9, "", "user", 1), (10, "cd", "user", 1)]


def test_json_replies(spark):
    refund = [json.loads(r["json"]) for r in QUERIES["refund_reply_json"](spark, SF_SMALL).limit(20).collect()]
    assert all(r["success"] is True and r["policy_message"].startswith("Cancellation charges apply based on") for r in refund)
    detail = [json.loads(r["json"]) for r in QUERIES["booking_detail_json"](spark, SF_SMALL).limit(20).collect()]
    assert all({"hotel_name", "username", "user_email", "check_in_formatted", "base_price"} <= set(r) for r in detail)
