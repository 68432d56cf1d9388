"""Hand-checked cases for the smaller catalog, inventory, quality and sink operators."""

import datetime as dt
from decimal import Decimal as D

from conftest import rows
from lodgelake.operators import catalog as C
from lodgelake.operators import inventory as I
from lodgelake.operators import quality as Q
from lodgelake.sources import sinks


def _hotels(spark):
    return spark.createDataFrame(
        [(1, "London", "Beta", "b" * 100, D("120.00"), "a.jpg"), (2, "london", "alpha", None, D("90.00"), None),
         (3, "Leeds", "Gamma", "short", D("90.00"), "c.jpg")],
        "hotel_id long, city string, title string, description string, price decimal(10,2), image string")


def test_search_city_is_case_insensitive_and_sorted(spark):
    h = _hotels(spark)
    assert [r.hotel_id for r in C.hotel_search(h, city="LONDON", sort="name").collect()] == [2, 1]
    assert [r.hotel_id for r in C.hotel_search(h, sort="price-low").collect()] == [2, 3, 1]  # tie by id
    assert [r.hotel_id for r in C.hotel_search(h, sort="price-high").collect()] == [1, 2, 3]
    m = C.hotel_search_meta(h, city="london").first()
    assert (m.total, m.more, m.next_offset) == (2, False, 9)


def test_teasers_detail_and_options(spark):
    h = _hotels(spark)
    t = {r.hotel_id: r.teaser for r in C.hotel_teasers(h).collect()}
    assert t == {1: "b" * 90 + "...", 2: "...", 3: "short..."}
    d = {r.hotel_id: r.hero_image for r in C.hotel_detail(h).collect()}
    assert d == {1: "images/hotels/a.jpg", 2: "images/hotels/default.jpg", 3: "images/hotels/c.jpg"}
    assert [r.title for r in C.hotel_options(h).collect()] == ["alpha", "Beta", "Gamma"]
    assert [r.city for r in C.distinct_cities(h).collect()] == ["Leeds", "London"]  # case-insensitive


def test_room_listing_order_and_availability_map(spark):
    h = _hotels(spark)
    rooms = spark.createDataFrame(
        [(10, 1, "102", "Double", "available"), (11, 1, "101", "Single", "booked"),
         (12, 2, "201", "Double", "available"), (13, 9, "901", "Double", "available"),
         (14, 1, "103", "Double", "available")],
        "room_id long, hotel_id long, room_number string, room_type string, status string")
    assert [r.room_id for r in I.room_listing(rooms, h).collect()] == [12, 11, 10, 14]  # alpha first, then Beta
    assert [r.room_id for r in I.room_listing(rooms, h, hotel_id=1, status="available").collect()] == [10, 14]
    m = {r.hotel_id: dict(r.availability) for r in I.room_availability_map(rooms).collect()}
    assert m == {1: {"Double": 2}, 2: {"Double": 1}, 9: {"Double": 1}}


def test_duplicates_defaults_and_intake(spark):
    users = spark.createDataFrame([(1, "Ann"), (2, "ann"), (3, "bob")], "id long, username string")
    assert rows(Q.duplicate_keys(users, ["username"])) == [("ann", 2)]
    rooms = spark.createDataFrame([(1, None, None)], "room_id long, capacity int, status string")
    r = Q.apply_defaults(rooms, "rooms").first()
    assert (r.capacity, r.max_guests, r.price_multiplier, r.status) == (1, 1, D("1.00"), None)
    msgs = spark.createDataFrame([(1, "n", "e@x.io", "s", "m", None)],
                                 "id long, name string, email string, subject string, message string, "
                                 "submitted_at timestamp_ntz")
    m = sinks.intake_messages(msgs, "2026-01-02 03:04:05").first()
    assert (m.status, m.submitted_at, m.ip_address) == ("new", dt.datetime(2026, 1, 2, 3, 4, 5), None)


def test_inserted_read_back(spark):
    b = spark.createDataFrame([(1,), (2,), (3,)], "booking_id long")
    ids = spark.createDataFrame([(3,), (3,), (9,)], "booking_id long")
    assert [r.booking_id for r in sinks.inserted(b, ids, "booking_id").collect()] == [3]


def test_room_type_defaults_and_labels(spark):
    req = spark.createDataFrame([(1, "101", "standard"), (1, "102", "family"), (1, "103", "Suite")],
                                "hotel_id long, room_number string, room_type string")
    got = {r.room_number: (r.price_multiplier, r.max_guests, r.status, r.price)
           for r in I.room_type_defaults(req).collect()}
    assert got == {"101": (D("1.00"), 1, "available", None), "102": (D("1.50"), 4, "available", None),
                   "103": (D("1.00"), 1, "available", None)}
    rooms = spark.createDataFrame([(1, "double", "maintenance", D("1.20")), (2, "Suite", "closed", None)],
                                  "room_id long, room_type string, status string, price_multiplier decimal(3,2)")
    lab = {r.room_id: (r.multiplier_percent, r.type_label, r.status_label) for r in I.room_labels(rooms).collect()}
    assert lab == {1: (120, "Double", "Maintenance"), 2: (100, "", "")}
