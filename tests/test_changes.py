"""Edge cases of upserts, profile edits and guarded deletes."""

from decimal import Decimal as D

from lodgelake.operators import changes as X


def test_latest_edit_per_room_wins(spark):
    rooms = spark.createDataFrame([(1, 1, "101", "single", D("50.00"), "available", 1)],
                                  "room_id long, hotel_id long, room_number string, room_type string, "
                                  "price decimal(10,2), status string, capacity int")
    edits = spark.createDataFrame(
        [(1, 1, "101", "double", D("80.00"), "booked", 2, 5), (1, 1, "101", "family", D("90.00"), "closed", 4, 9)],
        "room_id long, hotel_id long, room_number string, room_type string, price decimal(10,2), status string, "
        "capacity int, seq long")
    r = X.upsert_rooms(rooms, edits, order_col="seq").first()
    # seq 9 wins; its unknown status falls back to 'available'; max_guests defaults to capacity
    assert (r.room_type, r.price, r.status, r.capacity, r.max_guests) == ("family", D("90.00"), "available", 4, 4)


def test_hotel_insert_defaults_and_update(spark):
    hotels = spark.createDataFrame([(1, "London", "A", "d", D("120.00"), "a.jpg", "addr")],
                                   "hotel_id long, city string, title string, description string, "
                                   "price decimal(10,2), image string, address string")
    edits = spark.createDataFrame([(1, "B", "Leeds", None, None, None), (7, "New", "York", None, None, None)],
                                  "hotel_id long, title string, city string, price decimal(10,2), "
                                  "address string, description string")
    got = {r.hotel_id: r for r in X.upsert_hotels(hotels, edits).collect()}
    # an update keeps the price it does not set; address and description default to ''
    assert (got[1].title, got[1].city, got[1].price, got[1].image, got[1].description, got[1].address) == (
        "B", "Leeds", D("120.00"), "a.jpg", "", "")
    assert (got[7].price, got[7].image, got[7].address) == (D("100.00"), "default.jpg",
                                                            "Hotel Address, City, Country")


def test_profile_edit_clashes(spark):
    users = spark.createDataFrame([(1, "ann", "ann@x.io"), (2, "Bob", "bob@x.io"), (3, "bob", "b3@x.io")],
                                  "id long, username string, email string")
    edits = spark.createDataFrame(
        [(1, "ANN", "ann@x.io"),      # own values, different case: accepted
         (2, "bob", "new@x.io"),      # 'bob' also held by user 3: refused
         (3, "carl", "carl@x.io"),    # free, first in batch: accepted
         (4, "Carl", "c4@x.io")],     # same name as the earlier edit 3: refused
        "id long, username string, email string")
    got = {r.id: r.accepted for r in X.profile_update_outcomes(users, edits).collect()}
    assert got == {1: True, 2: False, 3: True, 4: False}
    after = {r.id: r.username for r in X.update_profiles(users, edits).collect()}
    assert after == {1: "ANN", 2: "Bob", 3: "carl"}


def test_user_delete_guard(spark):
    users = spark.createDataFrame([(1,), (2,)], "id long")
    bookings = spark.createDataFrame([(10, 1), (11, 1)], "booking_id long, user_id long")
    ids = spark.createDataFrame([(1,), (2,), (9,)], "id long")
    out = {r.id: (r.outcome, r.message) for r in X.user_delete_outcomes(users, bookings, ids).collect()}
    assert out == {1: ("refused", "Cannot delete user with 2 bookings!"), 2: ("deleted", None), 9: ("not_found", None)}
    assert [r.id for r in X.delete_users(users, bookings, ids).collect()] == [1]
