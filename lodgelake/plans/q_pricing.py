"""Pricing queries (P1-P13) over bookings read as quote requests."""

from pyspark.sql import functions as F

from lodgelake.functions.columns import day_fmt
from lodgelake.operators import pricing as P
from lodgelake.plans.registry import AS_OF, query

PEAK = "month(check_in) IN (4, 5, 6, 7, 8, 11, 12)"
DISCOUNT_PCT = """CASE WHEN days_in_advance BETWEEN 80 AND 90 THEN 30 WHEN days_in_advance BETWEEN 60 AND 79 THEN 20
    WHEN days_in_advance BETWEEN 45 AND 59 THEN 10 ELSE 0 END"""
DISCOUNT_NAME = """CASE WHEN days_in_advance BETWEEN 80 AND 90 THEN '30% (80-90 days in advance)'
    WHEN days_in_advance BETWEEN 60 AND 79 THEN '20% (60-79 days in advance)'
    WHEN days_in_advance BETWEEN 45 AND 59 THEN '10% (45-59 days in advance)' ELSE 'No discount' END"""
ADVANCE = "greatest(0, date_sub('day', AS_OF, CAST(check_in AS TIMESTAMP)))"

HOTEL_RATES = """
SELECT h.*, CAST(coalesce(r.peak, fb.p) AS DECIMAL(10,2)) AS peak_rate,
  CAST(coalesce(r.offpeak, fb.o) AS DECIMAL(10,2)) AS offpeak_rate, r.city IS NULL AS rate_is_fallback
FROM hotels h LEFT JOIN city_rates r ON h.city = r.city,
  (SELECT max(peak) AS p, max(offpeak) AS o FROM city_rates WHERE city = 'London') fb"""

QUOTES_CTES = f"""
req AS (SELECT booking_id AS request_id, hotel_id, room_type, check_in, check_out, guests,
  CAST(datediff('day', check_in, check_out) AS INTEGER) AS num_nights FROM bookings),
hr AS ({HOTEL_RATES}),
s AS (SELECT req.*, hr.city, hr.rate_is_fallback, {PEAK} AS is_peak_season,
  CASE WHEN {PEAK} THEN hr.peak_rate ELSE hr.offpeak_rate END AS standard_price
  FROM req JOIN hr ON req.hotel_id = hr.hotel_id),
c AS (SELECT s.*, CASE WHEN is_peak_season THEN 'Peak Season' ELSE 'Off-Peak Season' END AS season_name,
  CAST(CASE WHEN is_peak_season THEN standard_price * 0.30 ELSE 0 END AS DECIMAL(10,2)) AS peak_surcharge,
  CAST(standard_price * CASE room_type WHEN 'double' THEN 0.20 WHEN 'family' THEN 0.50 ELSE 0.00 END
    AS DECIMAL(10,2)) AS room_type_surcharge,
  CASE room_type WHEN 'double' THEN 20 WHEN 'family' THEN 50 ELSE 0 END AS room_type_multiplier,
  CAST(CASE WHEN room_type = 'double' AND guests >= 2 THEN standard_price * 0.10 ELSE 0 END AS DECIMAL(10,2))
    AS guest_surcharge,
  {ADVANCE} AS days_in_advance FROM s),
d AS (SELECT c.*, standard_price AS base_price,
  CAST(standard_price + peak_surcharge + room_type_surcharge + guest_surcharge AS DECIMAL(10,2)) AS price_per_night,
  {DISCOUNT_PCT} AS discount_percent, {DISCOUNT_NAME} AS discount_name FROM c),
e AS (SELECT d.*, CAST(price_per_night * num_nights AS DECIMAL(12,2)) AS subtotal FROM d),
f AS (SELECT e.*, CAST(subtotal * CAST(discount_percent / 100.0 AS DECIMAL(5,2)) AS DECIMAL(12,2))
  AS advance_discount FROM e),
quotes AS (SELECT request_id, hotel_id, city, room_type, check_in, check_out, guests, num_nights, is_peak_season,
  season_name, rate_is_fallback, standard_price, base_price, peak_surcharge, room_type_multiplier,
  room_type_surcharge, guest_surcharge, price_per_night, subtotal, days_in_advance, discount_percent, discount_name,
  advance_discount, CAST(subtotal - advance_discount AS DECIMAL(12,2)) AS total_price,
  printf('£%.2f', CAST(subtotal - advance_discount AS DOUBLE)) AS total_price_fmt FROM f)"""


def _quotes(v):
    return P.price_quotes(P.stay_requests(v.bookings), v.hotels, v.city_rates, AS_OF)


@query("price_quotes", f"WITH {QUOTES_CTES} SELECT * FROM quotes")
def price_quotes(v):
    return _quotes(v)


@query("season", f"""
SELECT *, {PEAK} AS is_peak_season, CASE WHEN {PEAK} THEN 'Peak Season' ELSE 'Off-Peak Season' END AS season_name
FROM bookings""")
def season(v):
    return P.season(v.bookings)


@query("city_rate", HOTEL_RATES)
def city_rate(v):
    return P.city_rate(v.hotels, v.city_rates)


@query("advance_discount_tiers", f"""
WITH a AS (SELECT booking_id, check_in, {ADVANCE} AS days_in_advance FROM bookings)
SELECT *, {DISCOUNT_PCT} AS discount_percent, {DISCOUNT_NAME} AS discount_name FROM a""")
def advance_discount_tiers(v):
    from lodgelake.functions.columns import advance_days, discount_label, discount_percent, ts_lit

    d = advance_days("check_in", ts_lit(AS_OF))
    return v.bookings.select("booking_id", "check_in", d.alias("days_in_advance")).select(
        "*", discount_percent("days_in_advance").alias("discount_percent"),
        discount_label("days_in_advance").alias("discount_name"))


@query("stay_nights", """
SELECT booking_id, check_in, check_out, CAST(datediff('day', check_in, check_out) AS INTEGER) AS num_nights
FROM bookings""")
def stay_nights(v):
    return P.nights(v.bookings.select("booking_id", "check_in", "check_out"))


@query("stay_nights_lenient", """
WITH t AS (SELECT booking_id,
  CASE WHEN room_id IS NULL THEN strftime(check_in, '%d %b %Y') ELSE CAST(check_in AS VARCHAR) END AS check_in,
  CAST(check_out AS VARCHAR) AS check_out FROM bookings)
SELECT *, CAST(coalesce(datediff('day', CAST(try_strptime(check_in, '%Y-%m-%d') AS DATE),
  CAST(try_strptime(check_out, '%Y-%m-%d') AS DATE)), 0) AS INTEGER) AS num_nights FROM t""")
def stay_nights_lenient(v):
    b = v.bookings
    text_in = F.when(F.col("room_id").isNull(), day_fmt("check_in")) \
        .otherwise(F.col("check_in").cast("string"))
    t = b.select("booking_id", text_in.alias("check_in"), F.col("check_out").cast("string").alias("check_out"))
    return P.nights(t, strict=False)


VALIDATION_REQUESTS = """
SELECT b.booking_id AS request_id, b.hotel_id, coalesce(lower(r.room_type), b.room_type) AS room_type,
  b.check_in, b.check_out, b.guests FROM bookings b LEFT JOIN rooms r ON b.room_id = r.room_id"""


def _validation_requests(v):
    r = v.rooms.select("room_id", F.lower("room_type").alias("_rt"))
    b = v.bookings.join(r, "room_id", "left")
    return b.select(F.col("booking_id").alias("request_id"), "hotel_id",
                    F.coalesce(F.col("_rt"), F.col("room_type")).alias("room_type"),
                    "check_in", "check_out", "guests")


VALIDATE = f"""
WITH q AS ({VALIDATION_REQUESTS})
SELECT q.*, CASE WHEN room_type IS NULL OR check_in IS NULL OR check_out IS NULL
    THEN 'Missing booking information. Please select dates and room type.'
  WHEN room_type NOT IN ('single', 'double', 'family') THEN 'Invalid room type selected.'
  WHEN h.hotel_id IS NULL THEN 'Hotel not found.'
  WHEN datediff('day', check_in, check_out) <= 0 THEN 'Check-out date must be after check-in date.' END AS reason
FROM q LEFT JOIN hotels h ON q.hotel_id = h.hotel_id"""


@query("validate_requests", VALIDATE)
def validate_requests(v):
    return P.validate_requests(_validation_requests(v), v.hotels)


@query("validate_create_requests", f"""
WITH q AS ({VALIDATION_REQUESTS})
SELECT q.*, CASE WHEN room_type IS NULL OR check_in IS NULL OR check_out IS NULL
    THEN 'Missing required booking information.'
  WHEN datediff('day', check_in, check_out) <= 0 THEN 'Check-out date must be after check-in date.'
  WHEN h.hotel_id IS NULL THEN 'Hotel not found.' END AS reason
FROM q LEFT JOIN hotels h ON q.hotel_id = h.hotel_id""")
def validate_create_requests(v):
    return P.validate_requests(_validation_requests(v), v.hotels, check_type=False)


@query("rejected_requests", f"SELECT * FROM ({VALIDATE}) WHERE reason IS NOT NULL")
def rejected_requests(v):
    return P.rejected(P.validate_requests(_validation_requests(v), v.hotels))


@query("convert_prices", f"""
WITH {QUOTES_CTES}
SELECT quotes.*, 'EUR' AS currency,
  CAST(round(price_per_night * (SELECT max(rate) FROM currency_rates WHERE currency = 'EUR') * num_nights, 2)
    AS DECIMAL(14,2)) AS converted_price,
  (SELECT max(symbol) FROM currency_rates WHERE currency = 'EUR') AS currency_symbol,
  concat('for ', CAST(num_nights AS VARCHAR), ' night', CASE WHEN num_nights > 1 THEN 's' ELSE '' END) AS price_period
FROM quotes""")
def convert_prices(v):
    return P.convert_prices(_quotes(v), v.currency_rates, "EUR", "price_per_night", "num_nights")


@query("convert_room_prices_usd", """
SELECT *, 'USD' AS currency,
  CAST(round(price * (SELECT max(rate) FROM currency_rates WHERE currency = 'USD') * 1, 2) AS DECIMAL(14,2))
    AS converted_price,
  (SELECT max(symbol) FROM currency_rates WHERE currency = 'USD') AS currency_symbol, 'for 1 night' AS price_period
FROM rooms""")
def convert_room_prices_usd(v):
    return P.convert_prices(v.rooms, v.currency_rates, "USD", "price")


CANCELLATION_QUOTES = """
WITH c AS (SELECT b.booking_id, b.user_id, h.title AS hotel_name, b.total_price,
    CAST(greatest(0, datediff('day', CAST(AS_OF AS DATE), b.check_in)) AS INTEGER) AS days_until_checkin
  FROM bookings b JOIN hotels h ON b.hotel_id = h.hotel_id WHERE b.status = 'confirmed'),
r AS (SELECT c.*, CASE WHEN days_until_checkin >= 30 THEN 0.00 WHEN days_until_checkin >= 15 THEN 0.25
    WHEN days_until_checkin >= 7 THEN 0.50 ELSE 1.00 END AS rate FROM c)
SELECT booking_id, user_id, hotel_name, total_price, days_until_checkin,
  CAST(round(total_price * rate, 2) AS DECIMAL(12,2)) AS cancellation_charges,
  CAST(round(total_price - total_price * rate, 2) AS DECIMAL(12,2)) AS refund_amount,
  concat('Cancellation charges apply based on how close to check-in you cancel. ',
    CASE WHEN days_until_checkin >= 30 THEN 'Full refund (cancellation 30+ days before check-in)'
      WHEN days_until_checkin >= 15 THEN '75% refund (cancellation 15-29 days before check-in)'
      WHEN days_until_checkin >= 7 THEN '50% refund (cancellation 7-14 days before check-in)'
      ELSE 'No refund (cancellation less than 7 days before check-in)' END) AS policy_message,
  total_price * rate = 0 AS full_refund
FROM r"""


@query("cancellation_quotes", CANCELLATION_QUOTES)
def cancellation_quotes(v):
    return P.cancellation_quotes(v.bookings, v.hotels, AS_OF)


@query("normalise_stay", """
SELECT booking_id, hotel_id, room_type, check_in,
  CASE WHEN coalesce(check_out, check_in + 1) < check_in + 1 THEN check_in + 1 ELSE coalesce(check_out, check_in + 1) END
    AS check_out,
  coalesce(guests, 2) AS guests
FROM (SELECT booking_id, hotel_id, room_type, check_in,
  CASE WHEN room_id IS NOT NULL THEN check_out END AS check_out,
  CASE WHEN status <> 'pending' THEN guests END AS guests FROM bookings)""")
def normalise_stay(v):
    b = v.bookings.select(
        "booking_id", "hotel_id", "room_type", "check_in",
        F.when(F.col("room_id").isNotNull(), F.col("check_out")).alias("check_out"),
        F.when(F.col("status") != "pending", F.col("guests")).alias("guests"))
    return P.normalise_stay(b, AS_OF)


@query("guest_contact", """
SELECT *, coalesce(username, 'Guest') AS guest_name,
  CASE WHEN coalesce(email, '') = '' AND coalesce(username, 'Guest') <> '' THEN concat(coalesce(username, 'Guest'),
    '@example.com') ELSE coalesce(email, '') END AS guest_email
FROM new_users""")
def guest_contact(v):
    return P.guest_contact(v.new_users)


MONEY_COLS = ["standard_price", "peak_surcharge", "room_type_surcharge", "guest_surcharge", "price_per_night",
              "subtotal", "advance_discount"]


@query("quote_money_text", f"""
WITH {QUOTES_CTES}
SELECT request_id, {", ".join(f"printf('£%.2f', CAST({c} AS DOUBLE)) AS {c}_fmt" for c in MONEY_COLS)} FROM quotes""")
def quote_money_text(v):
    q = _quotes(v)
    return P.money_columns(q.select("request_id", *MONEY_COLS), MONEY_COLS).select(
        "request_id", *[f"{c}_fmt" for c in MONEY_COLS])


@query("surcharges", f"""
WITH {QUOTES_CTES}
SELECT request_id, standard_price, peak_surcharge, room_type_surcharge, room_type_multiplier, guest_surcharge,
  base_price, price_per_night, subtotal FROM quotes""")
def surcharges(v):
    req = P.stay_requests(v.bookings)
    h = P.city_rate(v.hotels.select("hotel_id", "city"), v.city_rates)
    df = P.season(req.join(h, "hotel_id"))
    df = df.withColumn("standard_price",
                       F.when(F.col("is_peak_season"), F.col("peak_rate")).otherwise(F.col("offpeak_rate")))
    return P.surcharges(df).select("request_id", "standard_price", "peak_surcharge", "room_type_surcharge",
                                   "room_type_multiplier", "guest_surcharge", "base_price", "price_per_night",
                                   "subtotal")
