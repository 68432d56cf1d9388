"""Declared table schemas with column constraints and defaults.

One ``ColumnSpec`` per column carries what the relational store enforced:
nullability, maximum text length, value domain and default.  ``struct_type``
turns a table spec into the ``StructType`` used for reads (never inferred);
the data-quality operators read the same specs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

from lodgelake.functions import rules


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    dtype: T.DataType
    nullable: bool = True
    max_len: int | None = None
    domain: tuple | None = None
    default: object | None = None  # a SQL literal text, e.g. "'confirmed'" or "0.00"


def _c(*args, **kw) -> ColumnSpec:
    return ColumnSpec(*args, **kw)


INT, LONG, STR = T.IntegerType(), T.LongType(), T.StringType()
DATE, TS = T.DateType(), T.TimestampNTZType()
MONEY, PCT, MULT = T.DecimalType(10, 2), T.DecimalType(5, 2), T.DecimalType(3, 2)

TABLES: dict[str, list[ColumnSpec]] = {
    "bookings": [
        _c("booking_id", LONG, False),
        _c("user_id", LONG, False),
        _c("hotel_id", LONG, False),
        _c("room_id", LONG),
        _c("room_type", STR, False, 50),
        _c("check_in", DATE, False),
        _c("check_out", DATE, False),
        _c("guests", INT, False),
        _c("num_nights", INT, False),
        _c("guest_name", STR, False, 255),
        _c("guest_email", STR, False, 255),
        _c("guest_phone", STR, True, 20),
        _c("special_requests", STR),
        _c("base_price", MONEY, default="0.00"),
        _c("peak_surcharge", MONEY, default="0.00"),
        _c("room_type_surcharge", MONEY, default="0.00"),
        _c("guest_surcharge", MONEY, default="0.00"),
        _c("subtotal", MONEY, default="0.00"),
        _c("advance_discount_percent", PCT, default="0.00"),
        _c("advance_discount_amount", MONEY, default="0.00"),
        _c("total_price", MONEY, False),
        _c("status", STR, True, 50, rules.BOOKING_STATUSES, "'confirmed'"),
        _c("booking_date", TS),
        _c("cancellation_date", TS),
    ],
    "hotels": [
        _c("hotel_id", LONG, False),
        _c("city", STR, False, 50),
        _c("title", STR, False, 100),
        _c("description", STR),
        _c("price", MONEY, False),
        _c("image", STR, False, 100),
        _c("address", STR, True, 255, default=f"'{rules.HOTEL_DEFAULT_ADDRESS}'"),
    ],
    "rooms": [
        _c("room_id", LONG, False),
        _c("hotel_id", LONG),
        _c("room_number", STR, True, 10),
        _c("room_type", STR, True, 50),
        _c("price", MONEY),
        _c("price_multiplier", MULT, default="1.00"),
        _c("features", STR),
        _c("status", STR, True, 50, rules.ROOM_STATUSES),
        _c("capacity", INT, default="1"),
        _c("max_guests", INT, default="1"),
    ],
    "users": [
        _c("id", LONG, False),
        _c("username", STR, False, 50),
        _c("email", STR, False, 100),
        _c("created_at", TS),
        _c("last_login", TS),
        _c("role", STR, True, 10, rules.ROLES, "'user'"),
        _c("status", INT, False, None, (0, 1), "0"),
    ],
    "contact_messages": [
        _c("id", LONG, False),
        _c("name", STR, False, 255),
        _c("email", STR, False, 255),
        _c("subject", STR, False, 500),
        _c("message", STR, False),
        _c("submitted_at", TS),
        _c("ip_address", STR, True, 45),
        _c("status", STR, True, None, rules.MESSAGE_STATUSES, "'new'"),
    ],
    "city_rates": [
        _c("city", STR, False, 100),
        _c("peak", INT, default="100"),
        _c("offpeak", INT, default="70"),
    ],
}

# columns never carried into the analytics tables
DROPPED_COLUMNS = ("password",)

PRIMARY_KEYS = {
    "bookings": ["booking_id"],
    "hotels": ["hotel_id"],
    "rooms": ["room_id"],
    "users": ["id"],
    "contact_messages": ["id"],
    "city_rates": ["city"],
}
UNIQUE_KEYS = {"rooms": [["room_number"]], "users": [["username"], ["email"]]}


def struct_type(table: str) -> T.StructType:
    return T.StructType([T.StructField(c.name, c.dtype, c.nullable) for c in TABLES[table]])


def spec(table: str) -> list[ColumnSpec]:
    return TABLES[table]
