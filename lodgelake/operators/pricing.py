"""The pricing rule set as column expressions over whole request tables.

A quote is one projection over requests joined to their hotel (shuffle or
broadcast as the planner measures) and to the city-rate table.  City rates
are one row per city -- a bounded dimension -- so they are broadcast
explicitly; currency rates (one row per currency) are looked up as scalar
subqueries.  Money stays DECIMAL throughout: every rate is an exact tenth,
so each component is exact to the penny before any rounding.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodgelake.functions import rules
from lodgelake.functions.columns import (
    advance_days, col_, dec, discount_label, discount_percent, is_peak, money, refund_charge_rate,
    refund_policy, season_name, ts_lit,
)


def _rate(pct: str) -> F.Column:
    return F.lit(pct).cast("decimal(3,2)")


# ------------------------------------------------------------------ P1
def season(df: DataFrame, check_in: str = "check_in") -> DataFrame:
    return df.withColumn("is_peak_season", is_peak(check_in)).withColumn("season_name", season_name(check_in))


# ------------------------------------------------------------------ P2
def city_rate(hotels: DataFrame, rates: DataFrame) -> DataFrame:
    """Per hotel: peak and off-peak standard rates; unknown cities take the fallback city's rates.

    The lookup is exact and case-sensitive, as the rule set's dictionary lookup was.
    """
    fb = rates.filter(F.col("city") == rules.FALLBACK_CITY)
    fb_peak, fb_off = fb.select(F.max("peak")).scalar(), fb.select(F.max("offpeak")).scalar()
    r = rates.select(F.col("city").alias("_rate_city"), F.col("peak").alias("_peak"),
                     F.col("offpeak").alias("_offpeak"))
    df = hotels.join(r, hotels["city"] == r["_rate_city"], "left")
    return df.select(
        *[hotels[c] for c in hotels.columns],
        dec(F.coalesce(F.col("_peak"), fb_peak)).alias("peak_rate"),
        dec(F.coalesce(F.col("_offpeak"), fb_off)).alias("offpeak_rate"),
        F.col("_rate_city").isNull().alias("rate_is_fallback"),
    )


# ------------------------------------------------------------------ P4
def nights(df: DataFrame, check_in: str = "check_in", check_out: str = "check_out", strict: bool = True,
           name: str = "num_nights") -> DataFrame:
    """Stay length in days.  Strict: dates as given (<= 0 is left for validation).
    Lenient: text dates parsed with try_to_date; missing or bad input gives 0."""
    if strict:
        return df.withColumn(name, F.datediff(col_(check_out), col_(check_in)))
    ci = F.try_to_date(col_(check_in).cast("string"), "yyyy-MM-dd")
    co = F.try_to_date(col_(check_out).cast("string"), "yyyy-MM-dd")
    return df.withColumn(name, F.coalesce(F.datediff(co, ci), F.lit(0)))


# ------------------------------------------------------------------ P3 + P5 + P6
def surcharges(df: DataFrame, standard: str = "standard_price", peak: str = "is_peak_season",
               room_type: str = "room_type", guests: str = "guests", n_nights: str = "num_nights") -> DataFrame:
    std = F.col(standard)
    t = F.col(room_type)
    type_rate = F.lit("0.00").cast("decimal(3,2)")
    for name, rate in rules.ROOM_TYPE_SURCHARGE_RATE.items():
        type_rate = F.when(t == name, _rate(rate)).otherwise(type_rate)
    out = df.select(
        "*",
        dec(F.when(F.col(peak), std * _rate(rules.PEAK_SURCHARGE_RATE)).otherwise(F.lit(0))).alias("peak_surcharge"),
        dec(std * type_rate).alias("room_type_surcharge"),
        (type_rate * 100).cast("int").alias("room_type_multiplier"),
        dec(F.when((t == "double") & (F.col(guests) >= 2), std * _rate(rules.GUEST_SURCHARGE_RATE))
            .otherwise(F.lit(0))).alias("guest_surcharge"),
    )
    ppn = dec(std + F.col("peak_surcharge") + F.col("room_type_surcharge") + F.col("guest_surcharge"))
    return out.withColumn("base_price", std).withColumn("price_per_night", ppn).withColumn(
        "subtotal", dec(F.col("price_per_night") * F.col(n_nights), 12, 2))


def advance_discount(df: DataFrame, as_of, check_in: str = "check_in") -> DataFrame:
    days = advance_days(check_in, ts_lit(as_of))
    out = df.withColumn("days_in_advance", days)
    pct = discount_percent("days_in_advance")
    out = out.withColumn("discount_percent", pct).withColumn("discount_name", discount_label("days_in_advance"))
    disc = dec(F.col("subtotal") * (F.col("discount_percent").cast("decimal(5,2)") / 100).cast("decimal(5,2)"), 12, 2)
    return out.withColumn("advance_discount", disc).withColumn(
        "total_price", dec(F.col("subtotal") - F.col("advance_discount"), 12, 2))


# ------------------------------------------------------------------ P7
QUOTE_COLUMNS = [
    "request_id", "hotel_id", "city", "room_type", "check_in", "check_out", "guests", "num_nights",
    "is_peak_season", "season_name", "rate_is_fallback", "standard_price", "base_price", "peak_surcharge",
    "room_type_multiplier", "room_type_surcharge", "guest_surcharge", "price_per_night", "subtotal",
    "days_in_advance", "discount_percent", "discount_name", "advance_discount", "total_price", "total_price_fmt",
]


def price_quotes(requests: DataFrame, hotels: DataFrame, rates: DataFrame, as_of,
                 keep: tuple[str, ...] = ()) -> DataFrame:
    """Full quote for every request whose hotel exists: season, city rate, surcharges, discount.
    ``keep``: further columns of the requests that go along."""
    h = city_rate(hotels.select("hotel_id", "city"), rates)
    req = requests if "num_nights" in requests.columns else nights(requests)
    req = req.select("request_id", "hotel_id", "room_type", "check_in", "check_out", "guests", "num_nights", *keep)
    df = season(req.join(h, "hotel_id"))
    df = df.withColumn(
        "standard_price", F.when(F.col("is_peak_season"), F.col("peak_rate")).otherwise(F.col("offpeak_rate")))
    df = advance_discount(surcharges(df), as_of)
    return df.withColumn("total_price_fmt", money("total_price")).select(*QUOTE_COLUMNS, *keep)


def stay_requests(bookings: DataFrame) -> DataFrame:
    """Bookings read as quote requests (their stored prices are ignored)."""
    return bookings.select(
        F.col("booking_id").alias("request_id"), "user_id", "hotel_id", "room_type", "check_in", "check_out",
        "guests", F.datediff("check_out", "check_in").alias("num_nights"),
    )


# ------------------------------------------------------------------ P8
def money_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select("*", *[money(c).alias(f"{c}_fmt") for c in cols])


# ------------------------------------------------------------------ P9
def _stay_dates(requests: DataFrame):
    """(check_in, check_out) as dates, whether either is absent, and whether either is text that is
    not a yyyy-MM-dd date."""
    out, absent, bad = [], F.lit(False), F.lit(False)
    for c in ("check_in", "check_out"):
        if isinstance(requests.schema[c].dataType, T.DateType):
            out.append(F.col(c))
            absent = absent | F.col(c).isNull()
            continue
        text = F.col(c).cast("string")
        d = F.try_to_date(text, "yyyy-MM-dd")
        out.append(d)
        absent = absent | text.isNull() | (text == "")
        bad = bad | (text.isNotNull() & (text != "") & d.isNull())
    return out[0], out[1], absent, bad


def validate_requests(requests: DataFrame, hotels: DataFrame, check_type: bool = True) -> DataFrame:
    """Every request with ``reason`` (NULL when valid); split with ``valid`` / ``rejected`` below.

    Quote path (``check_type=True``): missing field, room type not whitelisted, unknown hotel,
    unparsable date, nights <= 0 -- in that order.  Create path (``check_type=False``): missing field
    (hotel id included), unparsable date, nights <= 0, unknown hotel.  Text dates are parsed as
    yyyy-MM-dd; empty text counts as missing.
    """
    known = hotels.select("hotel_id", F.lit(True).alias("_hotel_known"))
    df = requests.join(known, "hotel_id", "left")
    ci, co, absent, bad_text = _stay_dates(requests)
    missing = F.col("room_type").isNull() | (F.col("room_type") == "") | absent
    no_hotel = F.col("_hotel_known").isNull()
    bad_nights = F.datediff(co, ci) <= 0
    if check_type:
        reason = (
            F.when(missing, F.lit(rules.MSG_QUOTE_MISSING))
            .when(~F.col("room_type").isin(*rules.VALID_QUOTE_ROOM_TYPES), F.lit(rules.MSG_ROOM_TYPE_INVALID))
            .when(no_hotel, F.lit(rules.MSG_HOTEL_NOT_FOUND))
            .when(bad_text, F.lit(rules.MSG_QUOTE_PROCESSING_ERROR))
            .when(bad_nights, F.lit(rules.MSG_NIGHTS_INVALID))
        )
    else:
        reason = (
            F.when(missing | F.col("hotel_id").isNull(), F.lit(rules.MSG_CREATE_MISSING))
            .when(bad_text, F.lit(rules.MSG_CREATE_PROCESSING_ERROR))
            .when(bad_nights, F.lit(rules.MSG_NIGHTS_INVALID))
            .when(no_hotel, F.lit(rules.MSG_HOTEL_NOT_FOUND))
        )
    return df.select(*requests.columns, reason.alias("reason"))


def valid(checked: DataFrame) -> DataFrame:
    return checked.filter(F.col("reason").isNull()).drop("reason")


def rejected(checked: DataFrame) -> DataFrame:
    return checked.filter(F.col("reason").isNotNull())


# ------------------------------------------------------------------ P10
def convert_prices(df: DataFrame, currencies: DataFrame, currency: str, price: str = "price",
                   n_nights: str | None = None) -> DataFrame:
    """Price (times nights, if given) in ``currency``, to 2 decimals, with symbol and period text."""
    cur = currencies.filter(F.col("currency") == currency)
    rate = cur.select(F.max("rate")).scalar()
    symbol = cur.select(F.max("symbol")).scalar()
    n = F.col(n_nights) if n_nights else F.lit(1)
    amount = F.round(F.col(price) * rate * n, 2).cast("decimal(14,2)")
    period = F.concat(F.lit("for "), n.cast("string"), F.lit(" night"), F.when(n > 1, F.lit("s")).otherwise(F.lit("")))
    return df.select("*", F.lit(currency).alias("currency"), amount.alias("converted_price"),
                     symbol.alias("currency_symbol"), period.alias("price_period"))


# ------------------------------------------------------------------ P11
def cancellation_quotes(bookings: DataFrame, hotels: DataFrame, as_of, user_id: int | None = None) -> DataFrame:
    """Refund quote for each confirmed booking of a known hotel, by calendar days to check-in."""
    b = bookings.filter(F.lower("status") == "confirmed")
    if user_id is not None:
        b = b.filter(F.col("user_id") == user_id)
    h = hotels.select("hotel_id", F.col("title").alias("hotel_name"))
    df = b.select("booking_id", "user_id", "hotel_id", "check_in", "total_price").join(h, "hotel_id")
    days = F.greatest(F.lit(0), F.datediff(F.col("check_in"), F.to_date(ts_lit(as_of))))
    df = df.withColumn("days_until_checkin", days)
    charge = F.col("total_price") * refund_charge_rate("days_until_checkin")
    return df.select(
        "booking_id", "user_id", "hotel_name", "total_price", "days_until_checkin",
        F.round(charge, 2).cast("decimal(12,2)").alias("cancellation_charges"),
        F.round(F.col("total_price") - charge, 2).cast("decimal(12,2)").alias("refund_amount"),
        refund_policy("days_until_checkin").alias("policy_message"),
        (charge == 0).alias("full_refund"),
    )


# ------------------------------------------------------------------ P12
def normalise_stay(requests: DataFrame, as_of, guests_default: int = 2) -> DataFrame:
    """Missing check-in -> tomorrow; check-out at least one night later; guests default."""
    today = F.to_date(ts_lit(as_of))

    def as_date(c):
        dt = requests.schema[c].dataType
        return F.col(c) if isinstance(dt, T.DateType) else F.try_to_date(F.col(c).cast("string"), "yyyy-MM-dd")

    ci = F.coalesce(as_date("check_in"), F.date_add(today, 1))
    out = requests.withColumn("check_in", ci)
    min_out = F.date_add(F.col("check_in"), 1)
    co = F.coalesce(as_date("check_out"), min_out)
    out = out.withColumn("check_out", F.when(co < min_out, min_out).otherwise(co))
    return out.withColumn("guests", F.coalesce(F.col("guests"), F.lit(guests_default)))


# ------------------------------------------------------------------ P13
def guest_contact(df: DataFrame, username: str = "username", email: str = "email") -> DataFrame:
    name = F.coalesce(F.col(username), F.lit(rules.GUEST_NAME_DEFAULT))
    mail = F.coalesce(F.col(email), F.lit(""))
    made_up = F.concat(name, F.lit(rules.GUEST_EMAIL_DOMAIN))
    return df.select(
        "*",
        name.alias("guest_name"),
        F.when((mail == "") & (name != ""), made_up).otherwise(mail).alias("guest_email"),
    )


__all__ = [
    "season", "city_rate", "nights", "surcharges", "advance_discount", "price_quotes", "stay_requests",
    "money_columns", "validate_requests", "valid", "rejected", "convert_prices", "cancellation_quotes",
    "normalise_stay", "guest_contact",
]
