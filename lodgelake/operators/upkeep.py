"""Reports kept up to date: partial sums per day and status, and what a change of rows does to them.

A change takes a booking's old row out of its sums and puts its new one in (an unchanged part cancels out), so sums plus
deltas are the recount, whatever the command did: a status set back and forth, a price edited, a row added or deleted.
Deltas are as small as the change; month and status reports are sums over the days.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodgelake.functions.columns import month_key


def _signed(bookings: DataFrame, sign: int) -> DataFrame:
    return bookings.select(F.to_date("booking_date").cast("timestamp_ntz").alias("day_start"), "status", F.lit(sign).cast("long").alias("bookings"),
                           (F.lit(sign) * F.coalesce(F.col("total_price"), F.lit(0))).cast("decimal(18,2)").alias("revenue"))


def added(*parts: DataFrame) -> DataFrame:
    """Sums of several parts; a day and status without a booking is left out."""
    return (
        reduce(DataFrame.unionByName, parts).groupBy("day_start", "status")
        .agg(F.sum("bookings").alias("bookings"), F.sum("revenue").cast("decimal(18,2)").alias("revenue"))
        .where("bookings <> 0 OR revenue <> 0")
    )


def day_status_sums(bookings: DataFrame) -> DataFrame:
    """Bookings and revenue per day of booking and status."""
    return added(_signed(bookings, 1))


def day_status_deltas(old: DataFrame, new: DataFrame) -> DataFrame:
    """What replacing the rows ``old`` by ``new`` adds to the sums."""
    return added(_signed(old, -1), _signed(new, 1))


def month_status(sums: DataFrame) -> DataFrame:
    """Per month and status from the sums per day."""
    return sums.groupBy(month_key("day_start").alias("month"), "status").agg(
        F.sum("bookings").alias("bookings"), F.sum("revenue").cast("decimal(18,2)").alias("revenue"))


def status_stats(sums: DataFrame) -> DataFrame:
    """Number of bookings by status, from the sums per day."""
    return sums.groupBy("status").agg(F.sum("bookings").alias("bookings"))
