"""Booking detail, feed and per-user queries."""

from pyspark.sql import functions as F

from lodgelake.operators import bookings as B
from lodgelake.operators.pages import page_marks, seek_page
from lodgelake.plans.registry import AS_OF, query

MONEY0 = """
  CAST(coalesce(b.base_price, 0) AS DECIMAL(10,2)) AS base_price,
  CAST(coalesce(b.peak_surcharge, 0) AS DECIMAL(10,2)) AS peak_surcharge,
  CAST(coalesce(b.room_type_surcharge, 0) AS DECIMAL(10,2)) AS room_type_surcharge,
  CAST(coalesce(b.guest_surcharge, 0) AS DECIMAL(10,2)) AS guest_surcharge,
  CAST(coalesce(b.subtotal, 0) AS DECIMAL(10,2)) AS subtotal,
  CAST(coalesce(b.advance_discount_percent, 0) AS DECIMAL(5,2)) AS advance_discount_percent,
  CAST(coalesce(b.advance_discount_amount, 0) AS DECIMAL(10,2)) AS advance_discount_amount,
  CAST(coalesce(b.total_price, 0) AS DECIMAL(10,2)) AS total_price"""
CORE = "b.booking_id, b.hotel_id, b.room_type, b.check_in, b.check_out, b.guests, b.num_nights"
GUEST = "b.guest_name, b.guest_email, b.guest_phone, b.special_requests, b.status, b.booking_date"
DAYS = """strftime(b.check_in, '%d %b %Y') AS check_in_formatted,
  strftime(b.check_out, '%d %b %Y') AS check_out_formatted"""


BOOKING_DETAIL = f"""
SELECT {CORE}, {MONEY0}, {GUEST}, h.title AS hotel_name, h.city, {DAYS},
  strftime(b.booking_date, '%d %b %Y') AS booking_date_formatted, u.username, u.email AS user_email
FROM bookings_wide b LEFT JOIN hotels h ON b.hotel_id = h.hotel_id LEFT JOIN users u ON b.user_id = u.id"""


@query("booking_detail", BOOKING_DETAIL)
def booking_detail(v):
    return B.booking_detail(v.bookings, v.hotels, v.users)


@query("booking_receipt", f"""
SELECT {CORE}, {MONEY0}, {GUEST}, h.title AS hotel_name, h.city, h.image AS hotel_image, {DAYS},
  strftime(b.booking_date, '%d %b %Y at %I:%M %p') AS booking_date_full, u.username, u.email AS user_email,
  CASE WHEN b.advance_discount_percent > 0 THEN 'Yes' ELSE 'No' END AS has_discount
FROM bookings_wide b LEFT JOIN hotels h ON b.hotel_id = h.hotel_id LEFT JOIN users u ON b.user_id = u.id""")
def booking_receipt(v):
    return B.booking_detail(v.bookings, v.hotels, v.users, receipt=True)


@query("receipt_labels", f"""
WITH r AS (
SELECT {CORE}, {MONEY0}, {GUEST}, h.title AS hotel_name, h.city, {DAYS},
  strftime(b.booking_date, '%d %b %Y at %I:%M %p') AS booking_date_full, u.username, u.email AS user_email
FROM bookings_wide b LEFT JOIN hotels h ON b.hotel_id = h.hotel_id LEFT JOIN users u ON b.user_id = u.id)
SELECT booking_id, coalesce(nullif(guest_name, ''), nullif(username, ''), 'N/A') AS guest_label,
  coalesce(nullif(guest_email, ''), nullif(user_email, ''), 'N/A') AS email_label,
  coalesce(nullif(hotel_name, ''), 'N/A') AS hotel_label, coalesce(nullif(city, ''), 'N/A') AS city_label,
  CASE WHEN coalesce(room_type, '') <> '' THEN concat(upper(left(room_type, 1)), lower(substr(room_type, 2)))
    ELSE 'N/A' END AS room_type_label,
  coalesce(nullif(check_in_formatted, ''), nullif(CAST(check_in AS VARCHAR), ''), 'N/A') AS check_in_label,
  coalesce(nullif(check_out_formatted, ''), nullif(CAST(check_out AS VARCHAR), ''), 'N/A') AS check_out_label,
  coalesce(nullif(booking_date_full, ''), nullif(CAST(booking_date AS VARCHAR), ''), 'N/A') AS booked_label,
  concat(upper(left(coalesce(status, ''), 1)), lower(substr(coalesce(status, ''), 2))) AS status_label
FROM r""")
def receipt_labels(v):
    return B.receipt_labels(B.booking_detail(v.bookings, v.hotels, v.users, receipt=True))


@query("booking_print_receipt", f"""
SELECT {CORE}, {MONEY0}, {GUEST}, h.title AS hotel_name, h.city, {DAYS},
  strftime(b.booking_date, '%d %b %Y at %I:%M %p') AS booking_date_full, u.username, u.email AS user_email
FROM bookings_wide b JOIN hotels h ON b.hotel_id = h.hotel_id JOIN users u ON b.user_id = u.id""")
def booking_print_receipt(v):
    return B.booking_print_receipt(v.bookings, v.hotels, v.users)


@query("booking_detail_inner", f"""
SELECT b.*, u.username AS customer_name, u.email AS customer_email, h.title AS hotel_name, h.city AS hotel_city,
  h.address AS hotel_address, {DAYS}, strftime(b.booking_date, '%d %b %Y at %I:%M %p') AS booking_date_formatted
FROM bookings_wide b JOIN users u ON b.user_id = u.id JOIN hotels h ON b.hotel_id = h.hotel_id""")
def booking_detail_inner(v):
    return B.booking_detail_inner(v.bookings, v.hotels, v.users)


FEED = f"""
SELECT b.*, u.username AS customer_name, u.email, h.title AS hotel_name, {DAYS}
FROM bookings b JOIN users u ON b.user_id = u.id JOIN hotels h ON b.hotel_id = h.hotel_id"""


@query("bookings_feed", FEED + " ORDER BY b.booking_date DESC NULLS LAST, b.booking_id DESC")
def bookings_feed(v):
    return B.bookings_feed(v.bookings, v.users, v.hotels)


@query("bookings_feed_pending",
       FEED + " WHERE lower(b.status) = 'pending' ORDER BY b.booking_date DESC, b.booking_id DESC")
def bookings_feed_pending(v):
    return B.bookings_feed(v.bookings, v.users, v.hotels, status="Pending")


@query("recent_bookings", f"""
SELECT {CORE}, b.total_price, b.status, b.booking_date, b.guest_name, b.guest_email, b.guest_phone,
  b.special_requests, u.username AS customer_name, h.title AS hotel_name, {DAYS}
FROM bookings_wide b JOIN users u ON b.user_id = u.id JOIN hotels h ON b.hotel_id = h.hotel_id
ORDER BY b.booking_date DESC NULLS LAST, b.booking_id DESC LIMIT 5""")
def recent_bookings(v):
    return B.recent_bookings(v.bookings, v.users, v.hotels)


def _user_recent_sql(n: int, join: str) -> str:
    known = " WHERE b.hotel_id IN (SELECT hotel_id FROM hotels)" if join == "JOIN" else ""
    return f"""
WITH top AS (
  SELECT * FROM (SELECT b.*, row_number() OVER (PARTITION BY user_id ORDER BY booking_date DESC NULLS LAST,
    booking_id DESC) AS rn FROM bookings_wide b{known}) WHERE rn <= {n})
SELECT b.user_id, {CORE}, b.total_price, b.status, b.booking_date, b.guest_name, b.guest_email, b.guest_phone,
  b.special_requests, h.title AS hotel_name, h.city, h.image AS hotel_image, {DAYS},
  strftime(b.booking_date, '%d %b %Y') AS booking_date_formatted,
  CASE WHEN b.check_in > CAST(AS_OF AS DATE) AND b.status = 'confirmed' THEN 1 ELSE 0 END AS is_upcoming
FROM top b {join} hotels h ON b.hotel_id = h.hotel_id"""


@query("user_recent_bookings", _user_recent_sql(20, "LEFT JOIN"))
def user_recent_bookings(v):
    return B.user_recent_bookings(v.bookings, v.hotels, AS_OF, n=20, how="left")


@query("user_recent_bookings_inner", _user_recent_sql(5, "JOIN"))
def user_recent_bookings_inner(v):
    return B.user_recent_bookings(v.bookings, v.hotels, AS_OF, n=5, how="inner")


@query("profile_recent_bookings", """
WITH top AS (
  SELECT * FROM (SELECT b.*, row_number() OVER (PARTITION BY user_id ORDER BY booking_date DESC NULLS LAST,
    booking_id DESC) AS rn FROM bookings b WHERE b.hotel_id IN (SELECT hotel_id FROM hotels)) WHERE rn <= 5)
SELECT top.* EXCLUDE (rn), h.title AS hotel_name, h.city FROM top JOIN hotels h ON top.hotel_id = h.hotel_id""")
def profile_recent_bookings(v):
    return B.profile_recent_bookings(v.bookings, v.hotels)


@query("upcoming_flags", """
SELECT b.*, CASE WHEN check_in > CAST(AS_OF AS DATE) AND status = 'confirmed' THEN 1 ELSE 0 END AS is_upcoming,
  (check_in > CAST(AS_OF AS DATE) AND status = 'confirmed') AS cancellable FROM bookings b""")
def upcoming_flags(v):
    return B.upcoming_flags(v.bookings, AS_OF)


ACCESS_REQUESTS = """
SELECT booking_id, actor_id AS user_id FROM booking_commands
UNION ALL SELECT seq AS booking_id, actor_id AS user_id FROM account_commands"""


def _access_requests(v):
    return v.booking_commands.select("booking_id", F.col("actor_id").alias("user_id")).unionAll(
        v.account_commands.select(F.col("seq").alias("booking_id"), F.col("actor_id").alias("user_id")))


@query("check_access", f"""
SELECT r.booking_id, r.user_id,
  CASE WHEN b.user_id IS NULL THEN 'not_found' WHEN b.user_id <> r.user_id THEN 'forbidden' ELSE 'ok' END AS access
FROM ({ACCESS_REQUESTS}) r LEFT JOIN bookings b ON r.booking_id = b.booking_id""")
def check_access(v):
    return B.check_access(_access_requests(v), v.bookings)


@query("booking_labels", f"""
WITH f AS ({FEED})
SELECT booking_id, coalesce(nullif(customer_name, ''), 'N/A') AS customer_label,
  coalesce(nullif(email, ''), 'N/A') AS email_label, coalesce(nullif(hotel_name, ''), 'N/A') AS hotel_label,
  concat(upper(left(coalesce(nullif(room_type, ''), 'standard'), 1)),
    lower(substr(coalesce(nullif(room_type, ''), 'standard'), 2))) AS room_type_label,
  coalesce(nullif(check_in_formatted, ''), nullif(CAST(check_in AS VARCHAR), ''), 'N/A') AS check_in_label,
  coalesce(nullif(check_out_formatted, ''), nullif(CAST(check_out AS VARCHAR), ''), 'N/A') AS check_out_label,
  concat(CAST(coalesce(CASE WHEN num_nights <> 0 THEN num_nights END, 1) AS VARCHAR), ' night(s)') AS nights_label,
  CASE WHEN coalesce(total_price, 0) <> 0 THEN printf('£%.2f', CAST(total_price AS DOUBLE)) ELSE '£0.00' END
    AS amount_label,
  CASE status WHEN 'confirmed' THEN 'Confirmed' WHEN 'pending' THEN 'Pending' WHEN 'cancelled' THEN 'Cancelled'
    ELSE concat(upper(left(coalesce(nullif(status, ''), 'unknown'), 1)),
      lower(substr(coalesce(nullif(status, ''), 'unknown'), 2))) END AS status_label
FROM f""")
def booking_labels(v):
    return B.booking_labels(B.bookings_feed(v.bookings, v.users, v.hotels, ordered=False))


#: newest first, as the feed
NEWEST = [("booking_date", True), ("booking_id", True)]


@query("bookings_deep_page", """
SELECT booking_id, user_id, hotel_id, status, total_price, booking_date FROM bookings
ORDER BY booking_date DESC, booking_id DESC LIMIT 20 OFFSET (SELECT count(*) // 2 + 7 FROM bookings)""")
def bookings_deep_page(v):
    """A page from the middle of all bookings by a seek from the mark before it."""
    b = v.bookings.select("booking_id", "user_id", "hotel_id", "status", "total_price", "booking_date")
    return seek_page(b, NEWEST, page_marks(b, NEWEST, step=500), b.count() // 2 + 7, 20)
