"""More hand-checked cases on small synthetic rows."""

import datetime as dt
from decimal import Decimal as D

from pyspark.sql import functions as F

from conftest import rows
from lodgelake.operators import accounts as A
from lodgelake.operators import bookings as B
from lodgelake.operators import catalog as C
from lodgelake.operators import changes as X
from lodgelake.operators import pricing as P
from lodgelake.operators import reports as R
from lodgelake.operators.ids import assign_ids

T0 = dt.datetime(2026, 1, 1, 12, 0)


def test_new_account_messages(spark):
    users = spark.createDataFrame([(1, "taken", "taken@x.io")], "id long, username string, email string")
    new = spark.createDataFrame(
        [(1, "", "", "user"), (2, " ab ", "no-at-sign.com", "user"), (3, "x" * 21, "a@b.c", "root"),
         (4, "TAKEN", "fresh@x.io", "user"), (5, " good ", " Good@X.io ", "admin")],
        "request_id long, username string, email string, role string")
    got = {r.request_id: (r.valid, r.message, r.username, r.email) for r in A.validate_new_users(new, users).collect()}
    assert got[1][:2] == (False, "Username is required Email is required")
    assert got[2][:2] == (False, "Username must be 3-20 characters Invalid email format")
    assert got[3][:2] == (False, "Username must be 3-20 characters Invalid role selected")
    assert got[4][:2] == (False, "Email or username already exists")
    assert got[5] == (True, None, "good", "good@x.io")


def test_append_users_first_request_wins_and_ids_follow_max(spark):
    users = spark.createDataFrame([(41, "old", "old@x.io")], "id long, username string, email string")
    new = spark.createDataFrame([(7, "dup", "d1@x.io", "user"), (3, "Dup", "d2@x.io", "user"),
                                 (9, "solo", "s@x.io", "user")],
                                "request_id long, username string, email string, role string")
    out = A.append_users(A.validate_new_users(new, users), users, "2026-01-01 00:00:00")
    assert rows(out, "request_id", "id", "username") == [(3, 42, "Dup"), (9, 43, "solo")]


def test_dense_ids_many_buckets(spark):
    df = spark.range(0, 1000, 7).withColumnRenamed("id", "k")
    out = assign_ids(df, "k", "new_id", num_buckets=13)
    got = [r.new_id for r in out.orderBy("k").collect()]
    assert got == list(range(1, len(got) + 1))


def test_account_fold_activation_and_self_rules(spark):
    users = spark.createDataFrame([(1, 0, "user"), (2, 1, "user"), (3, 1, "admin")],
                                  "id long, status int, role string")
    cmds = spark.createDataFrame([
        (1, T0, 9, 1, "toggle_status"),          # 0 -> 1
        (2, T0, 9, 1, "activate"),               # -> 1
        (3, T0, 9, 1, "toggle_status"),          # -> 0
        (4, T0, 2, 2, "toggle_status"),          # self: refused
        (5, T0, 2, 2, "set_role_admin"),         # self: refused
        (6, T0, 2, 2, "make_admin"),             # self allowed
        (7, T0, 9, 3, "set_role_user"),          # -> user
    ], "seq long, ts timestamp_ntz, actor_id long, user_id long, command string")
    got = {r.id: (r.status, r.role) for r in X.apply_account_commands(users, cmds).collect()}
    assert got == {1: (0, "user"), 2: (1, "admin"), 3: (1, "user")}
    out = {r.seq: r.reason for r in X.account_command_outcomes(cmds, users).collect()}
    assert out[4] == "Cannot modify your own account status" and out[5] == "Cannot modify your own role"
    assert out[6] is None


def test_room_commands_last_write_wins(spark):
    rooms = spark.createDataFrame([(1, "available"), (2, "booked")], "room_id long, status string")
    cmds = spark.createDataFrame([(1, T0, 1, "booked"), (2, T0 + dt.timedelta(minutes=1), 1, "maintenance"),
                                  (3, T0, 99, "booked")], "seq long, ts timestamp_ntz, room_id long, status string")
    assert rows(X.apply_room_commands(rooms, cmds)) == [(1, "maintenance"), (2, "booked")]


def test_booking_fold_with_dates(spark):
    b = spark.createDataFrame([(1, 10, "confirmed"), (2, 20, "pending")], "booking_id long, user_id long, status string")
    cmds = spark.createDataFrame([
        (1, T0, 1, 11, "user_cancel"),                               # not the owner: refused
        (2, T0 + dt.timedelta(hours=1), 1, 10, "user_cancel"),       # effective
        (3, T0 + dt.timedelta(hours=2), 1, 1, "admin_confirm"),      # back to confirmed, date kept
        (4, T0 + dt.timedelta(hours=3), 2, 20, "user_cancel"),       # pending: refused
    ], "seq long, ts timestamp_ntz, booking_id long, actor_id long, command string")
    got = {r.booking_id: (r.status, r.cancellation_date) for r in X.apply_booking_commands(b, cmds).collect()}
    assert got == {1: ("confirmed", T0 + dt.timedelta(hours=1)), 2: ("pending", None)}
    why = {r.seq: r.reason for r in X.booking_command_outcomes(b, cmds).collect()}
    assert why[1] == "Booking not found or you do not have permission to cancel it"
    assert why[4] == "Cannot cancel booking with status: pending" and why[2] is None


def test_ranking_and_growth(spark):
    top = spark.createDataFrame([(i, D(str(100 * (6 - i)))) for i in range(1, 6)], "id long, total_spent decimal(18,2)")
    medals = [r.medal for r in R.customer_ranking(top).orderBy("rank").collect()]
    assert medals == ["gold", "silver", "bronze", "#4", "#5"]
    m = spark.createDataFrame([("2026-01", D("100.00")), ("2026-02", D("150.00")), ("2026-03", D("150.00"))],
                              "month string, revenue decimal(18,2)")
    g = {r.month: (r.growth_pct, r.direction) for r in R.monthly_growth(m).collect()}
    assert g == {"2026-01": (None, None), "2026-02": (50.0, "up"), "2026-03": (0.0, "flat")}


def test_access_text_search_and_labels(spark):
    b = spark.createDataFrame([(1, 10)], "booking_id long, user_id long")
    req = spark.createDataFrame([(1, 10), (1, 11), (2, 10)], "booking_id long, user_id long")
    assert rows(B.check_access(req, b)) == [(1, 10, "ok"), (1, 11, "forbidden"), (2, 10, "not_found")]
    h = spark.createDataFrame([(1, "Grand Hotel", "London"), (2, "Sea View", "Newcastle")],
                              "hotel_id long, title string, city string")
    assert [r.hotel_id for r in C.hotel_text_search(h, "HOTEL").collect()] == [1]
    assert [r.hotel_id for r in C.hotel_text_search(h, "", "castle").collect()] == [2]
    f = spark.createDataFrame([(1, None, "", "Grand", "", None, 3, D("0"), "weird")],
                              "booking_id long, customer_name string, email string, hotel_name string, "
                              "room_type string, check_in date, num_nights int, total_price decimal(10,2), "
                              "status string").withColumn("check_out", F.lit(None).cast("date")) \
        .withColumn("check_in_formatted", F.lit(None).cast("string")) \
        .withColumn("check_out_formatted", F.lit(None).cast("string"))
    r = B.booking_labels(f).first()
    assert (r.customer_label, r.email_label, r.hotel_label, r.room_type_label, r.check_in_label, r.nights_label,
            r.amount_label, r.status_label) == ("N/A", "N/A", "Grand", "Standard", "N/A", "3 night(s)", "£0.00",
                                                "Weird")


def test_stay_defaults_and_guest_contact(spark):
    req = spark.createDataFrame([(1, None, None, None), (2, "2026-03-10", "2026-03-09", 3),
                                 (3, "2026-03-10", "2026-03-14", None)],
                                "id long, check_in string, check_out string, guests int")
    got = {r.id: (r.check_in, r.check_out, r.guests) for r in P.normalise_stay(req, "2026-02-01 22:00:00").collect()}
    assert got == {1: (dt.date(2026, 2, 2), dt.date(2026, 2, 3), 2), 2: (dt.date(2026, 3, 10), dt.date(2026, 3, 11), 3),
                   3: (dt.date(2026, 3, 10), dt.date(2026, 3, 14), 2)}
    people = spark.createDataFrame([("ann", "a@x.io"), ("bob", ""), (None, None), ("", None)],
                                   "username string, email string")
    assert [r.guest_email for r in P.guest_contact(people).collect()] == ["a@x.io", "bob@example.com",
                                                                         "Guest@example.com", ""]


def test_checkpointed_id_assignment_equals_lazy(spark, views):
    checked = A.validate_new_users(views.new_users, views.users)
    lazy = A.append_users(checked, views.users, "2026-01-01 00:00:00")
    cut = A.append_users(checked, views.users, "2026-01-01 00:00:00", checkpoint=True)
    assert rows(lazy, "request_id", "id") == rows(cut, "request_id", "id")


def test_request_validation_orders_and_text_dates(spark):
    hotels = spark.createDataFrame([(1,)], "hotel_id long")
    req = spark.createDataFrame([
        (1, 1, "double", "2026-03-01", "2026-03-04"),   # valid
        (2, 1, "", "2026-03-01", "2026-03-04"),         # missing type
        (3, 1, "suite", "2026-03-01", "2026-03-04"),    # not whitelisted (quote only)
        (4, 9, "double", "01/03/2026", "2026-03-04"),   # unknown hotel and bad date: order differs
        (5, 1, "double", "2026-03-04", "2026-03-04"),   # zero nights
        (6, 1, "double", "", "2026-03-04"),             # empty date text = missing
    ], "request_id long, hotel_id long, room_type string, check_in string, check_out string")
    quote = {r.request_id: r.reason for r in P.validate_requests(req, hotels).collect()}
    create = {r.request_id: r.reason for r in P.validate_requests(req, hotels, check_type=False).collect()}
    assert quote == {1: None, 2: "Missing booking information. Please select dates and room type.",
                     3: "Invalid room type selected.", 4: "Hotel not found.",
                     5: "Check-out date must be after check-in date.",
                     6: "Missing booking information. Please select dates and room type."}
    assert create == {1: None, 2: "Missing required booking information.", 3: None,
                      4: "An error occurred while processing your booking. Please try again.",
                      5: "Check-out date must be after check-in date.", 6: "Missing required booking information."}


def test_constraint_report_finds_violations(spark):
    from lodgelake.operators import quality as Q

    hotels = spark.createDataFrame([(1, "x" * 51, None, D("10.00"), "i.jpg")],
                                   "hotel_id long, city string, title string, price decimal(10,2), image string")
    rooms = spark.createDataFrame([(5, "12345678901", "closed")], "room_id long, room_number string, status string")
    got = rows(Q.constraint_report({"hotels": hotels, "rooms": rooms}))
    assert got == [("hotels", "1", "city", "longer than 50"), ("hotels", "1", "title", "null"),
                   ("rooms", "5", "room_number", "longer than 10"), ("rooms", "5", "status", "outside domain")]


def test_activation_by_email(spark):
    users = spark.createDataFrame([(1, "a@x.io", 0, "user"), (2, "b@x.io", 0, "user")],
                                  "id long, email string, status int, role string")
    cmds = spark.createDataFrame([(1, T0, None, None, "B@X.io", "activate"), (2, T0, 7, 1, None, "make_admin")],
                                 "seq long, ts timestamp_ntz, actor_id long, user_id long, email string, "
                                 "command string")
    got = {r.id: (r.status, r.role) for r in X.apply_account_commands(users, cmds).collect()}
    assert got == {1: (0, "admin"), 2: (1, "user")}
