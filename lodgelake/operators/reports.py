"""K1-K9 management reports, B4 status statistics, U1-U3 account figures.

Pattern used throughout: aggregate the fact table (bookings) by its foreign
key first -- partial aggregation runs map-side, so a hot key costs one
combined row per task, not a hot shuffle partition -- then join the
one-row-per-key result to the dimension.  Scalars (totals, maxima) are
scalar subqueries planned inside the same job, never driver round trips.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodgelake.functions import rules
from lodgelake.functions.columns import iso_day, month_key, month_name, ts_lit

def _confirmed() -> F.Column:
    return F.lower("status") == "confirmed"  # the store compares case-insensitively


def money_sum(c) -> F.Column:
    return F.coalesce(F.sum(c), F.lit(0)).cast("decimal(18,2)")


def ratio(num, den) -> F.Column:
    """num / den as a double, 0 when den is 0 (the ``x or 0`` convention of the reports)."""
    return F.when(den > 0, num.cast("double") / den.cast("double")).otherwise(F.lit(0.0))


def pct_half_up(n, total, scale: int = 2) -> F.Column:
    """round(100 * n / total, scale) with exact half-up integer arithmetic; NULL when total is 0."""
    unit = 10 ** scale
    num = n.cast("long") * (100 * unit * 2) + total
    den = total.cast("long") * 2
    whole = F.call_function("div", num, F.when(den > 0, den))  # integral division
    return F.when(total > 0, whole.cast("double") / float(unit))


# --------------------------------------------------------------------- K1
def platform_kpis(users: DataFrame, bookings: DataFrame, hotels: DataFrame) -> DataFrame:
    """One row: users, confirmed bookings, hotels, confirmed revenue (0 when none)."""
    b = bookings.select("status", "total_price")
    return b.agg(
        F.count_if(_confirmed()).alias("total_bookings"),
        money_sum(F.when(_confirmed(), F.col("total_price"))).alias("total_revenue"),
    ).select(
        users.select(F.count(F.lit(1))).scalar().alias("total_users"),
        "total_bookings",
        hotels.select(F.count(F.lit(1))).scalar().alias("total_hotels"),
        "total_revenue",
    )


# --------------------------------------------------------------------- K2
def sales_window(period: str, as_of, date_from=None, date_to=None, compat: bool = False):
    """(lower, upper, upper_inclusive) booking_date bounds of a report period."""
    now = ts_lit(as_of)
    month0 = F.trunc(F.to_date(now), "MM").cast("timestamp_ntz")
    year0 = F.trunc(F.to_date(now), "YEAR").cast("timestamp_ntz")
    if period == "this_month":
        return month0, now, True
    if period == "custom" and date_from and date_to:
        return ts_lit(f"{date_from} 00:00:00"), ts_lit(f"{date_to} 00:00:00"), True
    if not compat and period == "last_month":
        return F.add_months(month0, -1).cast("timestamp_ntz"), month0, False
    if not compat and period == "this_year":
        return year0, now, True
    if not compat and period == "last_year":
        return F.add_months(year0, -12).cast("timestamp_ntz"), year0, False
    return now - F.expr("INTERVAL 6 MONTHS"), now, True


def monthly_sales(
    bookings: DataFrame, period: str = "last_6_months", as_of=None, date_from=None, date_to=None,
    compat: bool = False,
) -> DataFrame:
    """Bookings per 'yyyy-MM' month of booking_date, all statuses, inside the period."""
    lo, hi, inclusive = sales_window(period, as_of, date_from, date_to, compat)
    bd = F.col("booking_date")
    in_range = (bd >= lo) & ((bd <= hi) if inclusive else (bd < hi))
    if "booking_month" in bookings.columns:  # stored layout: prune month directories as well
        in_range = in_range & (F.col("booking_month") >= month_key(lo)) & (F.col("booking_month") <= month_key(hi))
    out = (
        bookings.filter(in_range)
        .select("booking_date", "total_price")
        .groupBy(month_key(bd).alias("month"))
        .agg(
            F.count(F.lit(1)).alias("bookings"),
            money_sum("total_price").alias("revenue"),
            F.sum("total_price").alias("_sum"),
        )
        .select("month", "bookings", "revenue",
                ratio(F.col("_sum"), F.col("bookings")).alias("avg_booking_value"))
    )
    return out.orderBy(F.col("month").desc())


# --------------------------------------------------------------------- K3
def hotel_performance(hotels: DataFrame, bookings: DataFrame, n: int | None = rules.REPORT_TOP_N) -> DataFrame:
    """Top hotels by confirmed revenue with share of all confirmed bookings."""
    per_hotel = (
        bookings.filter(_confirmed())
        .groupBy("hotel_id")
        .agg(F.count("booking_id").alias("n"), F.sum("total_price").alias("rev"))
    )
    # all confirmed bookings: the sum over the grouped rows, whose exchange is read again (one fact scan)
    total = F.coalesce(per_hotel.select(F.sum("n")).scalar(), F.lit(0))
    revenue = F.coalesce(F.col("rev"), F.lit(0)).cast("decimal(18,2)")
    n_b = F.coalesce(F.col("n"), F.lit(0))
    joined = (
        hotels.select("hotel_id", "title", "city")
        .join(per_hotel, "hotel_id", "left")
        .select("hotel_id", "title", "city", n_b.alias("bookings"), revenue.alias("revenue"), total.alias("_total"))
    )
    out = joined.select(
        "hotel_id",
        F.col("title").alias("name"),
        "city",
        "bookings",
        "revenue",
        pct_half_up(F.col("bookings"), F.col("_total")).alias("occupancy"),
        F.when(F.col("revenue") > rules.PROFIT_REVENUE_THRESHOLD, 1).otherwise(-1).alias("profit"),
    ).orderBy(F.col("revenue").desc(), F.col("hotel_id").asc())
    return out.limit(n) if n else out


# --------------------------------------------------------------------- K4
def top_customers(users: DataFrame, bookings: DataFrame, n: int | None = rules.REPORT_TOP_N) -> DataFrame:
    per_user = (
        bookings.filter(_confirmed())
        .groupBy("user_id")
        .agg(F.count("booking_id").alias("n"), F.sum("total_price").alias("spent"))
    )
    out = (
        users.select("id", "username", "email", "created_at")
        .join(per_user, users["id"] == per_user["user_id"], "left")
        .select(
            "id",
            F.col("username").alias("name"),
            "email",
            F.coalesce(F.col("n"), F.lit(0)).alias("total_bookings"),
            F.coalesce(F.col("spent"), F.lit(0)).cast("decimal(18,2)").alias("total_spent"),
            iso_day("created_at").alias("member_since"),
        )
        .orderBy(F.col("total_spent").desc(), F.col("id").asc())
    )
    return out.limit(n) if n else out


# --------------------------------------------------------------------- K5
def booking_trends(bookings: DataFrame, as_of) -> DataFrame:
    """Bookings per month over the last six months, labelled 'MMM', in month order."""
    now = ts_lit(as_of)
    bd = F.col("booking_date")
    return (
        bookings.select("booking_date")
        .filter((bd >= now - F.expr("INTERVAL 6 MONTHS")) & (bd <= now))
        .groupBy(month_key(bd).alias("month_key"), month_name(bd).alias("month"))
        .agg(F.count(F.lit(1)).alias("bookings"))
        .orderBy("month_key")
    )


# --------------------------------------------------------------------- K6
def report_totals(monthly: DataFrame) -> DataFrame:
    return monthly.agg(
        F.coalesce(F.sum("revenue"), F.lit(0)).cast("decimal(18,2)").alias("total_revenue"),
        F.coalesce(F.sum("bookings"), F.lit(0)).cast("long").alias("total_bookings"),
    ).select(
        "total_revenue", "total_bookings",
        ratio(F.col("total_revenue"), F.col("total_bookings")).alias("avg_booking_value"),
    )


# --------------------------------------------------------------------- K7
def trend_scale(trends: DataFrame) -> DataFrame:
    """bookings / max(bookings) for chart bars; the max is a window over the trend's rows, one per day of the
    report (bounded), so the fact is read once."""
    top = F.coalesce(F.max("bookings").over(Window.partitionBy(F.lit(0))), F.lit(0))
    cols = trends.columns
    return trends.select("*", top.alias("_top")).select(*cols, ratio(F.col("bookings"), F.col("_top")).alias("scale"))


# --------------------------------------------------------------------- K8
def customer_ranking(top: DataFrame) -> DataFrame:
    """Rank and medal over an already-limited top-N list (bounded, so one ordered window is fine)."""
    rank = F.row_number().over(Window.orderBy(F.col("total_spent").desc(), F.col("id").asc())).cast("long")
    medal = F.element_at(F.array(*[F.lit(m) for m in rules.MEDALS]), F.col("rank").cast("int"))
    return top.withColumn("rank", rank).withColumn(
        "medal",
        F.when(F.col("rank") <= len(rules.MEDALS), medal)
        .otherwise(F.concat(F.lit("#"), F.col("rank").cast("string"))),
    )


# --------------------------------------------------------------------- K9
def monthly_growth(monthly: DataFrame) -> DataFrame:
    """Month-on-month revenue growth in percent (NULL for the first month or a zero base)."""
    w = Window.orderBy("month")  # one row per month: bounded input
    prev = F.lag("revenue").over(w)
    return monthly.select(
        "month", "revenue", prev.alias("prev_revenue"),
    ).select(
        "month", "revenue", "prev_revenue",
        F.when(F.col("prev_revenue") > 0,
               (F.col("revenue") - F.col("prev_revenue")).cast("double") * 100.0
               / F.col("prev_revenue").cast("double")).alias("growth_pct"),
    ).withColumn("direction", F.when(F.col("growth_pct") > 0, "up").when(F.col("growth_pct") < 0, "down")
                 .when(F.col("growth_pct") == 0, "flat"))


# --------------------------------------------------------------------- B4
def booking_status_stats(bookings: DataFrame) -> DataFrame:
    s = F.col("status")
    return bookings.select("status", "total_price").agg(
        F.count_if(s == "confirmed").alias("confirmed"),
        F.count_if(s == "pending").alias("pending"),
        F.count_if(s == "cancelled").alias("cancelled"),
        money_sum(F.when(s == "confirmed", F.col("total_price"))).alias("revenue"),
    )


# --------------------------------------------------------------------- U1
def user_booking_counts(users: DataFrame, bookings: DataFrame) -> DataFrame:
    """Every user with their number of bookings, newest account first."""
    per_user = bookings.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return (
        users.join(per_user, users["id"] == per_user["user_id"], "left")
        .select(*[users[c] for c in users.columns], F.coalesce(F.col("n"), F.lit(0)).alias("total_bookings"))
        .orderBy(F.col("created_at").desc_nulls_last(), F.col("id").asc())
    )


# --------------------------------------------------------------------- U2
def user_kpis(users: DataFrame, bookings: DataFrame, as_of) -> DataFrame:
    today = F.to_date(ts_lit(as_of))
    return users.select("role", "last_login").agg(
        F.count(F.lit(1)).alias("total_users"),
        F.count_if(F.col("role") == "admin").alias("admin_count"),
        F.count_if(F.to_date("last_login") == today).alias("active_today"),
    ).select(
        "total_users", "admin_count", "active_today",
        bookings.select(F.count(F.lit(1))).scalar().alias("total_bookings"),
    )


# --------------------------------------------------------------------- U3
def user_dashboard_stats(users: DataFrame, bookings: DataFrame, as_of) -> DataFrame:
    """Per user: total, upcoming (confirmed, check-in after today), past (any status), confirmed spend."""
    today = F.to_date(ts_lit(as_of))
    per_user = bookings.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total_bookings"),
        F.count_if((F.col("check_in") > today) & _confirmed()).alias("upcoming_bookings"),
        F.count_if(F.col("check_out") < today).alias("past_bookings"),
        money_sum(F.when(_confirmed(), F.col("total_price"))).alias("total_spent"),
    )
    return users.select("id").join(per_user, users["id"] == per_user["user_id"], "left").select(
        F.col("id").alias("user_id"),
        *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("total_bookings", "upcoming_bookings", "past_bookings")],
        F.coalesce(F.col("total_spent"), F.lit(0)).cast("decimal(18,2)").alias("total_spent"),
    )
