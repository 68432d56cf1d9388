"""Domain tables derived from the driver's TPC-H-like tables.

hotels <- supplier, rooms <- part, users <- customer, bookings <- orders,
command logs <- events, contact messages <- conversations.  The derivations
are pure projections (plus one key join for command actors); table sizes
used as moduli are scalar subqueries, planned once and never collected.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodgelake.functions import rules
from lodgelake.functions.columns import ts_lit
from lodgelake.sources.tables import raw

# Fixed values of the derived test views: city assigned by hotel_id % 14.
VIEW_CITY_CYCLE = [
    "London", "Manchester", "Edinburgh", "Glasgow", "Birmingham", "Bristol", "Cardiff",
    "Aberdeen", "Belfast", "Newcastle", "New Castle", "Norwich", "Oxford", "Kent",
]


def _pick(values: list[str], idx) -> F.Column:
    """values[idx] for a 0-based integer column; null outside, as the planner may ask it of another table's keys."""
    return F.get(F.array(*[F.lit(v) for v in values]), idx.cast("int"))


def _days(n) -> F.Column:
    return F.make_dt_interval(days=n.cast("int"))


def _secs(n) -> F.Column:
    return F.make_dt_interval(secs=n.cast("decimal(18,6)"))


class DriverViews:
    """Lazily built DataFrames of the domain tables over one ``sf_dir``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def raw(self, name: str) -> DataFrame:
        return raw(self.spark, self.sf_dir, name)

    def _count(self, name: str) -> F.Column:
        return self.raw(name).select(F.count(F.lit(1))).scalar()

    @cached_property
    def hotels(self) -> DataFrame:
        s = self.raw("supplier")
        k = F.col("s_suppkey")
        return s.select(
            k.alias("hotel_id"),
            _pick(VIEW_CITY_CYCLE, k % 14).alias("city"),
            F.col("s_name").alias("title"),
            F.concat(F.lit("Stay at "), F.col("s_name")).alias("description"),
            (F.lit(100) + k % 11 * 10).cast("decimal(10,2)").alias("price"),
            F.lit(rules.HOTEL_DEFAULT_IMAGE).alias("image"),
            F.lit(rules.HOTEL_DEFAULT_ADDRESS).alias("address"),
        )

    @cached_property
    def rooms(self) -> DataFrame:
        p = self.raw("part")
        k, size4 = F.col("p_partkey"), F.col("p_size") % 4
        return p.select(
            k.alias("room_id"),
            (k % (self._count("supplier") + 3)).alias("hotel_id"),
            k.cast("string").alias("room_number"),
            _pick(["Single", "Double", "Family", "Suite"], size4).alias("room_type"),
            F.col("p_retailprice").cast("decimal(10,2)").alias("price"),
            F.when(k % 10 == 8, "booked").when(k % 10 == 9, "maintenance")
            .otherwise("available").alias("status"),
            F.when(size4 == 2, 4).when(size4 == 0, 1).otherwise(2).alias("capacity"),
        )

    @cached_property
    def users(self) -> DataFrame:
        c = self.raw("customer")
        k = F.col("c_custkey")
        return c.select(
            k.alias("id"),
            F.col("c_name").alias("username"),
            F.concat(F.lower(F.replace(F.col("c_name"), F.lit("#"), F.lit("."))), F.lit("@example.com"))
            .alias("email"),
            (ts_lit("1995-01-01 00:00:00") + _days(k * 37 % 2000)).alias("created_at"),
            F.when(k % 5 == 0, F.lit(None).cast("timestamp_ntz"))
            .otherwise(ts_lit("1998-06-15 08:00:00") - _days(k % 3)).alias("last_login"),
            F.when(k % 97 == 0, "admin").otherwise("user").alias("role"),
            F.when(k % 11 == 0, 0).otherwise(1).alias("status"),
        )

    @cached_property
    def bookings(self) -> DataFrame:
        o = self.raw("orders")
        k = F.col("o_orderkey")
        day0 = F.to_date(F.col("o_orderdate"))
        offset = (k * 13 % 121).cast("int")
        return o.select(
            k.alias("booking_id"),
            F.col("o_custkey").alias("user_id"),
            F.when(k % 50 == 49, F.lit(-1).cast("long"))
            .otherwise(k * 11 % (self._count("supplier") - 2)).alias("hotel_id"),
            F.when(k % 4 == 0, k % self._count("part")).alias("room_id"),
            _pick(["single", "double", "family"], k % 3).alias("room_type"),
            F.date_add(day0, offset).alias("check_in"),
            F.date_add(day0, offset + 1 + (k % 9).cast("int")).alias("check_out"),
            (1 + k % 4).cast("int").alias("guests"),
            (1 + k % 9).cast("int").alias("num_nights"),
            F.col("o_totalprice").cast("decimal(10,2)").alias("total_price"),
            F.when(F.col("o_orderstatus") == "F", "confirmed")
            .when(F.col("o_orderstatus") == "O", "pending").otherwise("cancelled").alias("status"),
            (F.col("o_orderdate").cast("timestamp_ntz") + _secs(k * 7919 % 86400)).alias("booking_date"),
        )

    @cached_property
    def booking_commands_raw(self) -> DataFrame:
        e = self.raw("events").filter(F.col("event_type").isin("purchase", "error", "click"))
        return e.select(
            F.col("event_id").alias("seq"),
            F.col("ts").cast("timestamp_ntz").alias("ts"),
            (F.col("event_id") % (self._count("supplier") * 20)).alias("booking_id"),
            F.when(F.col("event_type") == "purchase", "admin_confirm")
            .when(F.col("event_type") == "error", "admin_cancel").otherwise("user_cancel").alias("command"),
        )

    @cached_property
    def booking_commands(self) -> DataFrame:
        """Commands with their actor: every tenth comes from someone other than the owner, some from nobody,
        and some name a booking that does not exist."""
        owners = self.bookings.select("booking_id", "user_id")
        c = self.booking_commands_raw
        return c.join(owners, "booking_id", "left").select(
            "seq", "ts", "booking_id", "command",
            F.when(F.col("seq") % 17 == 3, F.lit(None)).when(F.col("seq") % 10 == 0, F.col("user_id") + 1)
            .otherwise(F.col("user_id")).alias("actor_id"),
        )

    @cached_property
    def city_rates(self) -> DataFrame:
        return self.spark.createDataFrame(rules.CITY_RATES, "city string, peak int, offpeak int")

    @cached_property
    def currency_rates(self) -> DataFrame:
        return self.spark.createDataFrame(
            [(c, r, s) for c, r, s in rules.CURRENCIES], "currency string, rate string, symbol string"
        ).select("currency", F.col("rate").cast("decimal(6,4)").alias("rate"), "symbol")

    @cached_property
    def room_commands(self) -> DataFrame:
        e = self.raw("events").filter(F.col("event_type").isin("view", "click", "signup"))
        return e.select(
            F.col("event_id").alias("seq"),
            F.col("ts").cast("timestamp_ntz").alias("ts"),
            (F.col("event_id") * 3 % self._count("part")).alias("room_id"),
            F.when(F.col("event_type") == "view", "available")
            .when(F.col("event_type") == "click", "maintenance").otherwise("booked").alias("status"),
        )

    @cached_property
    def account_commands(self) -> DataFrame:
        e = self.raw("events")
        t = F.col("event_type")
        return e.select(
            F.col("event_id").alias("seq"),
            F.col("ts").cast("timestamp_ntz").alias("ts"),
            F.col("user_id").alias("actor_id"),
            (F.col("event_id") % (self._count("customer") + 7)).alias("user_id"),
            F.when(F.col("event_id") % 11 == 5, "activate").when(F.col("event_id") % 23 == 7, "set_role_root")
            .when(F.col("event_id") % 29 == 3, "promote").when(t == "purchase", "toggle_status").when(t == "error", "make_admin")
            .when(t == "view", "set_role_user").otherwise("set_role_admin").alias("command"),
        )

    @cached_property
    def new_hotels(self) -> DataFrame:
        s = self.raw("supplier")
        k = F.col("s_suppkey")
        return s.select(
            (F.lit(100000) + k).alias("hotel_id"),
            F.col("s_name").alias("title"),
            (F.lit(100) + k % 7 * 15).cast("decimal(10,2)").alias("price"),
        )

    @cached_property
    def new_users(self) -> DataFrame:
        c = self.raw("customer")
        k = F.col("c_custkey")
        ks = k.cast("string")
        return c.select(
            k.alias("request_id"),
            F.when(k % 7 == 0, F.lit("")).when(k % 7 == 1, F.lit(" ab "))
            .when(k % 7 == 2, F.lit("x" * 25)).when(k % 7 == 3, F.upper(F.col("c_name")))
            .when(k % 7 == 4, F.concat(F.lit("Team."), F.floor(k / 21).cast("string")))
            .otherwise(F.concat(F.lit("new."), ks)).alias("username"),
            F.when(k % 5 == 0, F.lit("")).when(k % 5 == 1, F.lit("no-at-sign.com"))
            .when(k % 5 == 2, F.concat(F.lit(" MiXed"), ks, F.lit("@Example.COM ")))
            .when(k % 5 == 3, F.concat(F.lit("n"), F.floor(k / 40).cast("string"), F.lit("@example.com")))
            .otherwise(F.concat(F.lit("n"), ks, F.lit("@example.com"))).alias("email"),
            F.when(k % 9 == 0, "root").otherwise("user").alias("role"),
        )

    @cached_property
    def contact_messages(self) -> DataFrame:
        cv = self.raw("conversations").filter(F.col("role") == "user")
        cid = F.col("conv_id")
        return cv.select(
            (cid * 1000 + F.col("turn")).alias("id"),
            F.concat(F.lit("Guest "), cid.cast("string")).alias("name"),
            F.concat(F.lit("guest"), cid.cast("string"), F.lit("@example.com")).alias("email"),
            F.lit("room booking").alias("subject"),
            F.col("text").alias("message"),
            (ts_lit("2024-01-01 00:00:00") + F.make_dt_interval(mins=cid.cast("int"))).alias("submitted_at"),
        )

    @cached_property
    def resent_messages(self) -> DataFrame:
        """Contact messages of which every third was sent again 30, 60 and 90 seconds later, and every ninth again
        every 25 seconds for ten minutes."""
        m = self.contact_messages
        again = F.when(F.col("id") % 9 == 0, F.sequence(F.lit(0), F.lit(600), F.lit(25))) \
            .when(F.col("id") % 3 == 0, F.sequence(F.lit(0), F.lit(90), F.lit(30))).otherwise(F.array(F.lit(0)))
        return m.select("*", F.explode(again).alias("_later")).select(
            (F.col("id") * 1000 + F.col("_later")).alias("id"), "name", "email", "subject", "message",
            (F.col("submitted_at") + _secs(F.col("_later"))).alias("submitted_at"))
