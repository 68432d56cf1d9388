"""Hand-checked results on small synthetic rows (FIXTURES.md section 3)."""

import datetime as dt
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from conftest import rows
from lodgelake.operators import catalog as C
from lodgelake.operators import inventory as I
from lodgelake.operators import pricing as P
from lodgelake.operators import quality as Q
from lodgelake.operators import reports as R
from lodgelake.sources.views import DriverViews

GOLDEN = [  # id, hotel, type, check_in, nights, guests, total, status
    (1, 1, "single", "2026-01-22", 1, 1, "100", "confirmed"), (2, 1, "single", "2026-01-22", 1, 1, "100", "confirmed"),
    (3, 7, "single", "2026-01-22", 1, 1, "70", "confirmed"), (4, 6, "single", "2026-01-22", 1, 1, "70", "confirmed"),
    (5, 11, "single", "2026-01-22", 1, 1, "100", "confirmed"), (6, 1, "single", "2026-01-24", 4, 1, "400", "cancelled"),
    (7, 1, "family", "2026-01-24", 1, 4, "150", "confirmed"), (8, 11, "family", "2026-01-24", 6, 4, "900", "confirmed"),
    (9, 1, "double", "2026-01-24", 3, 2, "390", "confirmed"), (10, 1, "family", "2026-01-24", 7, 4, "1050", "cancelled"),
    (11, 1, "double", "2026-01-25", 5, 2, "650", "confirmed"), (12, 2, "single", "2026-01-25", 1, 1, "90", "confirmed"),
    (13, 2, "single", "2026-01-25", 1, 1, "90", "confirmed"), (14, 2, "single", "2026-01-25", 1, 1, "90", "confirmed"),
]
CITIES = [(1, "London"), (2, "Manchester"), (6, "Bristol"), (7, "Cardiff"), (11, "Norwich")]


@pytest.fixture(scope="module")
def gold(spark):
    b = spark.createDataFrame(
        [(i, 1, h, t, dt.date.fromisoformat(ci), dt.date.fromisoformat(ci) + dt.timedelta(days=n), g, n, D(tot), s,
          dt.datetime(2026, 1, 20, 9, 0) + dt.timedelta(hours=i)) for i, h, t, ci, n, g, tot, s in GOLDEN],
        "booking_id long, user_id long, hotel_id long, room_type string, check_in date, check_out date, guests int, "
        "num_nights int, total_price decimal(10,2), status string, booking_date timestamp_ntz")
    h = spark.createDataFrame([(i, c, f"Hotel {i}", D("100.00")) for i, c in CITIES],
                              "hotel_id long, city string, title string, price decimal(10,2)")
    return b, h


def test_status_stats(gold):
    b, _ = gold
    r = R.booking_status_stats(b).first()
    assert (r.confirmed, r.pending, r.cancelled, r.revenue) == (12, 0, 2, D("2800.00"))


def test_monthly_totals(gold):
    b, _ = gold
    m = R.monthly_sales(b, "this_month", "2026-01-31 12:00:00")
    t = R.report_totals(m).first()
    assert (t.total_bookings, t.total_revenue) == (14, D("4250.00"))
    assert round(t.avg_booking_value, 6) == 303.571429


def test_hotel_performance(gold):
    b, h = gold
    got = rows(R.hotel_performance(h, b), "hotel_id", "bookings", "revenue", "occupancy", "profit")
    assert got == sorted([(1, 5, D("1390.00"), 41.67, -1), (11, 2, D("1000.00"), 16.67, -1),
                          (2, 3, D("270.00"), 25.0, -1), (6, 1, D("70.00"), 8.33, -1), (7, 1, D("70.00"), 8.33, -1)])


def _rates(spark):
    return DriverViews(spark, "/unused").city_rates


def test_quotes_for_seed_bookings(spark, gold):
    b, h = gold
    q = {r.request_id: r for r in P.price_quotes(P.stay_requests(b), h, _rates(spark), "2026-01-20 09:00:00").collect()}
    r9 = q[9]
    assert (r9.standard_price, r9.room_type_surcharge, r9.guest_surcharge, r9.price_per_night, r9.subtotal) == (
        D("100.00"), D("20.00"), D("10.00"), D("130.00"), D("390.00"))
    r8 = q[8]
    assert r8.rate_is_fallback and (r8.standard_price, r8.room_type_surcharge, r8.subtotal) == (
        D("100.00"), D("50.00"), D("900.00"))


@pytest.mark.parametrize("as_of,pct,total", [("2026-05-10 09:00:00", 0, "640.00"),
                                             ("2026-02-14 09:00:00", 30, "448.00")])
def test_london_double_in_may(spark, as_of, pct, total):
    req = spark.createDataFrame([(1, 1, "double", dt.date(2026, 5, 10), dt.date(2026, 5, 12), 2)],
                                "request_id long, hotel_id long, room_type string, check_in date, check_out date, guests int")
    h = spark.createDataFrame([(1, "London")], "hotel_id long, city string")
    r = P.price_quotes(req, h, _rates(spark), as_of).first()
    assert (r.standard_price, r.peak_surcharge, r.room_type_surcharge, r.guest_surcharge, r.price_per_night,
            r.subtotal) == (D("200.00"), D("60.00"), D("40.00"), D("20.00"), D("320.00"), D("640.00"))
    assert r.discount_percent == pct and r.total_price == D(total)


@pytest.mark.parametrize("days,charge,refund", [(30, "0.00", "390.00"), (29, "97.50", "292.50"),
                                                (14, "195.00", "195.00"), (6, "390.00", "0.00")])
def test_cancellation_tiers(spark, days, charge, refund):
    ci = dt.date(2026, 3, 1)
    b = spark.createDataFrame([(1, 1, 1, ci, D("390.00"), "confirmed")],
                              "booking_id long, user_id long, hotel_id long, check_in date, total_price decimal(10,2), "
                              "status string")
    h = spark.createDataFrame([(1, "H")], "hotel_id long, title string")
    as_of = dt.datetime.combine(ci - dt.timedelta(days=days), dt.time(15, 0))
    r = P.cancellation_quotes(b, h, as_of).first()
    assert (r.days_until_checkin, r.cancellation_charges, r.refund_amount) == (days, D(charge), D(refund))
    assert r.full_refund == (days >= 30)


def test_currency(spark):
    df = spark.createDataFrame([(D("240.00"), 3)], "price decimal(10,2), n int")
    cur = DriverViews(spark, "/unused").currency_rates
    assert P.convert_prices(df, cur, "USD", "price", "n").first().converted_price == D("914.40")
    r = P.convert_prices(df, cur, "EUR", "price", "n").first()
    assert (r.converted_price, r.currency_symbol, r.price_period) == (D("842.40"), "€", "for 3 nights")


def test_paging_over_19_hotels(spark):
    h = spark.range(1, 20).select(F.col("id").alias("hotel_id"), F.lit("London").alias("city"),
                                  F.concat(F.lit("H"), F.col("id")).alias("title"),
                                  F.lit(100).cast("decimal(10,2)").alias("price"), F.lit("x.jpg").alias("image"),
                                  F.lit("d").alias("description"))
    for offset, n, more, nxt in [(0, 9, True, 9), (9, 8, True, 17), (17, 2, False, 25)]:
        assert C.hotel_search(h, offset=offset).count() == n
        m = C.hotel_search_meta(h, offset=offset).first()
        assert (m.total, m.more, m.next_offset) == (19, more, nxt)


def test_inventory_and_orphans(spark):
    rooms = spark.createDataFrame(
        [(1, 1, "available"), (2, 1, "available"), (3, 1, "available"),
         (4, 5, "available"), (5, 5, "available"), (6, 5, "available"), (7, 5, "available"), (8, 5, "booked"),
         (9, 8, "available"), (10, 8, "available"), (11, 8, "maintenance"),
         (74, 20, "available"), (75, 20, "available"), (76, 20, "available")],
        "room_id long, hotel_id long, status string")
    hotels = spark.createDataFrame([(1, "A", "X"), (5, "B", "X"), (8, "C", "X"), (9, "D", "X")],
                                   "hotel_id long, title string, city string") \
        .withColumn("price", F.lit(100).cast("decimal(10,2)")).withColumn("address", F.lit("a"))
    inv = {r.hotel_id: (r.total_rooms, r.available_rooms) for r in I.hotel_inventory(hotels, rooms).collect()}
    assert inv == {1: (3, 3), 5: (5, 4), 8: (3, 2), 9: (0, 0)}
    assert sorted(r.room_id for r in Q.orphans(rooms, hotels, "hotel_id").collect()) == [74, 75, 76]


def test_default_rooms(spark):
    nh = spark.createDataFrame([(20, D("170.00"))], "hotel_id long, price decimal(10,2)")
    got = rows(I.expand_default_rooms(nh), "room_number", "room_type", "price", "capacity")
    assert got == [("200001", "Single", D("136.00"), 1), ("200002", "Double", D("170.00"), 2),
                   ("200003", "Family", D("204.00"), 4)]


def test_advance_days_floor(spark):
    from lodgelake.functions.columns import advance_days, ts_lit

    df = spark.createDataFrame([(dt.date(2026, 4, 1),)], "check_in date")
    r = df.select(advance_days("check_in", ts_lit("2026-01-01 10:00:00")).alias("d"),
                  F.datediff("check_in", F.lit("2026-01-01")).alias("cal")).first()
    assert (r.d, r.cal) == (89, 90)
