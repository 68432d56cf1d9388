"""Booking detail joins, feeds, per-user latest, flags, access checks, labels.

Joins of the booking fact to hotels / users are shuffle joins on the foreign
key (dimensions grow with the data, so nothing is force-broadcast); AQE's
skew-join handling splits a hot key's partition on the booking side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodgelake.functions import rules
from lodgelake.functions.columns import day_fmt, day_time_fmt, first_present, money, ts_lit
from lodgelake.sources.sinks import ensure_columns

MONEY_COLS = ["base_price", "peak_surcharge", "room_type_surcharge", "guest_surcharge", "subtotal",
              "advance_discount_percent", "advance_discount_amount", "total_price"]
CORE_COLS = ["booking_id", "hotel_id", "room_type", "check_in", "check_out", "guests", "num_nights"]
GUEST_COLS = ["guest_name", "guest_email", "guest_phone", "special_requests", "status", "booking_date"]


def _wide(bookings: DataFrame) -> DataFrame:
    return ensure_columns(bookings, "bookings")


def booking_detail(bookings: DataFrame, hotels: DataFrame, users: DataFrame, user_id: int | None = None,
                   receipt: bool = False) -> DataFrame:
    """Outer detail: bookings LEFT JOIN hotels LEFT JOIN users, money columns 0 when NULL."""
    b = _wide(bookings)
    if user_id is not None:
        b = b.filter(F.col("user_id") == user_id)
    h = hotels.select("hotel_id", F.col("title").alias("hotel_name"), "city", F.col("image").alias("hotel_image"))
    u = users.select(F.col("id").alias("user_id"), "username", F.col("email").alias("user_email"))
    df = b.join(h, "hotel_id", "left").join(u, "user_id", "left")
    cols = [F.col(c) for c in CORE_COLS]
    cols += [F.coalesce(F.col(c), F.lit(0)).cast(b.schema[c].dataType).alias(c) for c in MONEY_COLS]
    cols += [F.col(c) for c in GUEST_COLS] + [F.col("hotel_name"), F.col("city")]
    if receipt:
        cols.append(F.col("hotel_image"))
    cols += [day_fmt("check_in").alias("check_in_formatted"), day_fmt("check_out").alias("check_out_formatted")]
    cols.append(day_time_fmt("booking_date").alias("booking_date_full") if receipt
                else day_fmt("booking_date").alias("booking_date_formatted"))
    cols += [F.col("username"), F.col("user_email")]
    if receipt:
        cols.append(F.when(F.col("advance_discount_percent") > 0, "Yes").otherwise("No").alias("has_discount"))
    return df.select(*cols)


def booking_print_receipt(bookings: DataFrame, hotels: DataFrame, users: DataFrame,
                          user_id: int | None = None) -> DataFrame:
    """Printable receipt: receipt columns through inner joins (bookings of unknown hotels or users drop out)."""
    b = _wide(bookings)
    if user_id is not None:
        b = b.filter(F.col("user_id") == user_id)
    h = hotels.select("hotel_id", F.col("title").alias("hotel_name"), "city")
    u = users.select(F.col("id").alias("user_id"), "username", F.col("email").alias("user_email"))
    df = b.join(h, "hotel_id").join(u, "user_id")
    return df.select(
        *CORE_COLS,
        *[F.coalesce(F.col(c), F.lit(0)).cast(b.schema[c].dataType).alias(c) for c in MONEY_COLS],
        *GUEST_COLS, "hotel_name", "city",
        day_fmt("check_in").alias("check_in_formatted"), day_fmt("check_out").alias("check_out_formatted"),
        day_time_fmt("booking_date").alias("booking_date_full"), "username", "user_email",
    )


def booking_detail_inner(bookings: DataFrame, hotels: DataFrame, users: DataFrame) -> DataFrame:
    """Admin view: b.* with customer and hotel columns; bookings of unknown users or hotels drop out."""
    b = _wide(bookings)
    u = users.select(F.col("id").alias("user_id"), F.col("username").alias("customer_name"),
                     F.col("email").alias("customer_email"))
    h = hotels.select("hotel_id", F.col("title").alias("hotel_name"), F.col("city").alias("hotel_city"),
                      F.col("address").alias("hotel_address"))
    return b.join(u, "user_id").join(h, "hotel_id").select(
        *[b[c] for c in b.columns], "customer_name", "customer_email", "hotel_name", "hotel_city", "hotel_address",
        day_fmt("check_in").alias("check_in_formatted"), day_fmt("check_out").alias("check_out_formatted"),
        day_time_fmt("booking_date").alias("booking_date_formatted"),
    )


def _feed(bookings: DataFrame, users: DataFrame, hotels: DataFrame) -> DataFrame:
    u = users.select(F.col("id").alias("user_id"), F.col("username").alias("customer_name"), "email")
    h = hotels.select("hotel_id", F.col("title").alias("hotel_name"))
    return bookings.join(u, "user_id").join(h, "hotel_id")


def bookings_feed(bookings: DataFrame, users: DataFrame, hotels: DataFrame, status: str | None = None,
                  ordered: bool = True) -> DataFrame:
    """The feed, newest first; ``ordered=False`` leaves the global sort out where nobody needs the order."""
    b = bookings.filter(F.lower("status") == status.lower()) if status else bookings  # case-insensitive store
    feed = _feed(b, users, hotels).select(
        *[b[c] for c in b.columns], "customer_name", "email", "hotel_name",
        day_fmt("check_in").alias("check_in_formatted"), day_fmt("check_out").alias("check_out_formatted"),
    )
    return feed.orderBy(F.col("booking_date").desc_nulls_last(), F.col("booking_id").desc()) if ordered else feed


def recent_bookings(bookings: DataFrame, users: DataFrame, hotels: DataFrame,
                    n: int = rules.RECENT_BOOKINGS_N) -> DataFrame:
    """Latest n bookings overall: a top-k, so only n rows per task reach the final merge."""
    b = _wide(bookings)
    keep = CORE_COLS + ["total_price", "status", "booking_date", "guest_name", "guest_email", "guest_phone",
                        "special_requests"]
    return _feed(b.select("user_id", *keep), users, hotels).select(
        *keep, "customer_name", "hotel_name",
        day_fmt("check_in").alias("check_in_formatted"), day_fmt("check_out").alias("check_out_formatted"),
    ).orderBy(F.col("booking_date").desc_nulls_last(), F.col("booking_id").desc()).limit(n)


def upcoming_flags(bookings: DataFrame, as_of) -> DataFrame:
    today = F.to_date(ts_lit(as_of))
    up = (F.col("check_in") > today) & (F.lower("status") == "confirmed")
    return bookings.withColumn("is_upcoming", F.when(up, 1).otherwise(0)).withColumn("cancellable", up)


def _latest_per_user(b: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(F.col("booking_date").desc_nulls_last(), F.col("booking_id").desc())
    return b.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def profile_recent_bookings(bookings: DataFrame, hotels: DataFrame, n: int = 5) -> DataFrame:
    """Profile page: each user's latest n bookings of known hotels, ``b.*`` with hotel name and city."""
    b = bookings.join(hotels.select("hotel_id"), "hotel_id", "left_semi")
    h = hotels.select("hotel_id", F.col("title").alias("hotel_name"), "city")
    return _latest_per_user(b, n).join(h, "hotel_id").select(*[F.col(c) for c in bookings.columns],
                                                              "hotel_name", "city")


def user_recent_bookings(bookings: DataFrame, hotels: DataFrame, as_of, n: int = 20, how: str = "left") -> DataFrame:
    """Each user's latest n bookings.

    ``row_number() <= n`` plans as WindowGroupLimit: a partial top-n runs
    before the shuffle, so even a user owning a third of all bookings sends
    at most n rows per map task.
    """
    b = _wide(bookings)
    if how == "inner":  # the limit applies after the join: bookings of unknown hotels never count
        b = b.join(hotels.select("hotel_id"), "hotel_id", "left_semi")
    top = _latest_per_user(b, n)
    h = hotels.select("hotel_id", F.col("title").alias("hotel_name"), "city", F.col("image").alias("hotel_image"))
    df = upcoming_flags(top, as_of).join(h, "hotel_id", how)
    return df.select(
        "user_id", *CORE_COLS, "total_price", "status", "booking_date", "guest_name", "guest_email", "guest_phone",
        "special_requests", "hotel_name", "city", "hotel_image",
        day_fmt("check_in").alias("check_in_formatted"), day_fmt("check_out").alias("check_out_formatted"),
        day_fmt("booking_date").alias("booking_date_formatted"), "is_upcoming",
    )


def check_access(requests: DataFrame, bookings: DataFrame) -> DataFrame:
    """(booking_id, user_id) requests -> 'not_found' / 'forbidden' / 'ok'."""
    owners = bookings.select("booking_id", F.col("user_id").alias("owner_id"))
    df = requests.join(owners, "booking_id", "left")
    return df.select(
        *requests.columns,
        F.when(F.col("owner_id").isNull(), "not_found")
        .when(F.col("owner_id") != F.col("user_id"), "forbidden").otherwise("ok").alias("access"),
    )


def booking_labels(df: DataFrame) -> DataFrame:
    """Display fallbacks of the admin booking table."""
    s = F.col("status")
    status_label = (
        F.when(s == "confirmed", "Confirmed").when(s == "pending", "Pending").when(s == "cancelled", "Cancelled")
        .otherwise(F.initcap(first_present("status", default="unknown")))
    )
    amount = F.when(F.coalesce(F.col("total_price"), F.lit(0)) != 0, money("total_price")).otherwise(F.lit("£0.00"))
    return df.select(
        "booking_id",
        first_present("customer_name").alias("customer_label"),
        first_present("email").alias("email_label"),
        first_present("hotel_name").alias("hotel_label"),
        F.initcap(first_present("room_type", default="standard")).alias("room_type_label"),
        first_present("check_in_formatted", F.col("check_in").cast("string")).alias("check_in_label"),
        first_present("check_out_formatted", F.col("check_out").cast("string")).alias("check_out_label"),
        F.concat(F.coalesce(F.when(F.col("num_nights") != 0, F.col("num_nights")), F.lit(1)).cast("string"),
                 F.lit(" night(s)")).alias("nights_label"),
        amount.alias("amount_label"),
        status_label.alias("status_label"),
    )


def receipt_labels(receipt: DataFrame) -> DataFrame:
    """Display fallbacks of the receipt page over ``booking_detail(..., receipt=True)`` rows."""
    def text(c):
        return F.col(c).cast("string")

    return receipt.select(
        "booking_id",
        first_present("guest_name", "username").alias("guest_label"),
        first_present("guest_email", "user_email").alias("email_label"),
        first_present("hotel_name").alias("hotel_label"),
        first_present("city").alias("city_label"),
        F.when(F.coalesce(F.col("room_type"), F.lit("")) != "", F.initcap("room_type")).otherwise(F.lit("N/A"))
        .alias("room_type_label"),
        first_present("check_in_formatted", text("check_in")).alias("check_in_label"),
        first_present("check_out_formatted", text("check_out")).alias("check_out_label"),
        first_present("booking_date_full", text("booking_date")).alias("booked_label"),
        F.initcap(F.coalesce(F.col("status"), F.lit(""))).alias("status_label"),
    )
