"""Appends, schema evolution, JSON export, read-back of inserted rows.

Writers never overwrite the path they read from: a new state is written to
a new versioned path and readers switch to it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodgelake import schema as S
from lodgelake.functions import rules
from lodgelake.functions.columns import month_key, ts_lit
from lodgelake.operators.ids import assign_ids


# ---------------------------------------------------------------- S5
def ensure_columns(df: DataFrame, schema: T.StructType | str) -> DataFrame:
    """Add every declared column the frame lacks as a typed NULL (the 'ALTER TABLE ADD' of a lake)."""
    st = S.struct_type(schema) if isinstance(schema, str) else schema
    present = set(df.columns)
    missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in st.fields if f.name not in present]
    return df.select("*", *missing) if missing else df


def conform(df: DataFrame, table: str) -> DataFrame:
    """Exactly the declared columns, in order, cast to their declared types."""
    df = ensure_columns(df, table)
    return df.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in S.struct_type(table).fields])


# ---------------------------------------------------------------- S2
def append_messages(messages: DataFrame, stored: DataFrame | None, as_of, order_col: str) -> DataFrame:
    """Form rows, which have no id yet, as stored: numbered after the stored messages in order of ``order_col``."""
    return intake_messages(assign_ids(messages, order_col, "id", stored, "id"), as_of)


def intake_messages(messages: DataFrame, as_of) -> DataFrame:
    """Contact messages as stored: status 'new', submitted_at defaulting to the intake time."""
    out = messages.withColumn("status", F.lit("new"))
    sub = F.col("submitted_at") if "submitted_at" in messages.columns else F.lit(None).cast("timestamp_ntz")
    out = out.withColumn("submitted_at", F.coalesce(sub, ts_lit(as_of)))
    return conform(out, "contact_messages")


# ---------------------------------------------------------------- S3
def append_bookings(quotes: DataFrame, bookings: DataFrame | None, as_of, checkpoint: bool = True) -> DataFrame:
    """Priced requests -> booking rows: new ids after the current maximum in order of ``request_id``, 'confirmed',
    booked now."""
    q = quotes
    if "request_id" not in q.columns:
        raise ValueError("quotes need a request_id to be numbered by")
    rows = q.select(
        "request_id", "user_id", "hotel_id", "room_type", "check_in", "check_out", "guests",
        F.col("num_nights").cast("int").alias("num_nights"),
        F.coalesce(F.col("guest_name"), F.lit(rules.GUEST_NAME_DEFAULT)).alias("guest_name")
        if "guest_name" in q.columns else F.lit(rules.GUEST_NAME_DEFAULT).alias("guest_name"),
        F.col("guest_email") if "guest_email" in q.columns else F.lit("").alias("guest_email"),
        F.col("standard_price").alias("base_price"), "peak_surcharge", "room_type_surcharge", "guest_surcharge",
        "subtotal", F.col("discount_percent").alias("advance_discount_percent"),
        F.col("advance_discount").alias("advance_discount_amount"), "total_price",
        F.lit("confirmed").alias("status"), ts_lit(as_of).alias("booking_date"),
    )
    rows = assign_ids(rows, "request_id", "booking_id", bookings, "booking_id", checkpoint=checkpoint)
    return conform(rows, "bookings")


def write_bookings(bookings: DataFrame, root: str, mode: str = "append", max_records_per_file: int = 5_000_000,
                   num_partitions: int | None = None) -> None:
    """Store bookings partitioned by booking month and clustered by hotel inside each file.

    Period reports then read only the months they cover (partition pruning) and hotel lookups
    skip row groups by min/max statistics.  The write is range-partitioned on
    (month, hotel_id, booking_id): a month -- or a hotel within a month -- holding a third of
    all rows is split across many tasks instead of landing in one, and files stay capped.
    """
    df = conform(bookings, "bookings").withColumn(
        "booking_month", F.coalesce(month_key("booking_date"), F.lit("none")))
    ranged = (df.repartitionByRange(num_partitions, "booking_month", "hotel_id", "booking_id") if num_partitions
              else df.repartitionByRange("booking_month", "hotel_id", "booking_id"))
    (ranged.sortWithinPartitions("booking_month", "hotel_id", "booking_id")
     .write.mode(mode).option("maxRecordsPerFile", max_records_per_file)
     .partitionBy("booking_month").parquet(f"{root.rstrip('/')}/bookings"))


def load_bookings(spark, root: str) -> DataFrame:
    """Stored bookings with their partition column; filters on booking_month prune directories."""
    schema = S.struct_type("bookings").add("booking_month", T.StringType())
    return spark.read.schema(schema).parquet(f"{root.rstrip('/')}/bookings")


# ---------------------------------------------------------------- S4
JSON_OPTIONS = {
    # the whole timestamp, six digits of a second's fraction; nulls are written, not dropped
    "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS",
    "timestampFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS",
    "dateFormat": "yyyy-MM-dd",
    "ignoreNullFields": "false",
}


def to_json_rows(df: DataFrame, key: str | None = None, options: dict | None = None) -> DataFrame:
    """Each row as one JSON text (the API reply form), optionally keyed."""
    body = F.to_json(F.struct(*[F.col(c) for c in df.columns]), {**JSON_OPTIONS, **(options or {})}).alias("json")
    return df.select(F.col(key), body) if key else df.select(body)


def from_json_rows(rows: DataFrame, schema: T.StructType, column: str = "json") -> DataFrame:
    """Parse JSON row texts back into typed columns (the inverse of ``to_json_rows``)."""
    parsed = F.from_json(F.col(column), schema, JSON_OPTIONS).alias("_row")
    return rows.select(parsed).select("_row.*")


# ---------------------------------------------------------------- S6
def inserted(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_semi")
