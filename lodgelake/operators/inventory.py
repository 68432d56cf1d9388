"""Room availability, hotel inventory, room listing and room defaults."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodgelake.functions import rules
from lodgelake.operators.ids import assign_ids


def room_availability(rooms: DataFrame, hotel_id: int | None = None) -> DataFrame:
    """Available rooms per (hotel, room type); map-side partial counts make hot hotels cheap."""
    df = rooms.filter(F.lower("status") == "available")
    if hotel_id is not None:
        df = df.filter(F.col("hotel_id") == hotel_id)
    # one group per type whatever its spelling (the smallest is shown), as the store groups
    return df.groupBy("hotel_id", F.lower("room_type").alias("_type")).agg(
        F.min("room_type").alias("room_type"), F.count(F.lit(1)).alias("available_count")).drop("_type")


def room_availability_map(rooms: DataFrame, hotel_id: int | None = None) -> DataFrame:
    """One row per hotel with a room_type -> count map (entries bounded by the room-type domain)."""
    per_type = room_availability(rooms, hotel_id)
    return per_type.groupBy("hotel_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("room_type", "available_count"))))
        .alias("availability")
    )


def hotel_inventory(hotels: DataFrame, rooms: DataFrame) -> DataFrame:
    """Rooms and available rooms per hotel; hotels without rooms show 0 and 0."""
    per_hotel = rooms.groupBy("hotel_id").agg(
        F.count("room_id").alias("total_rooms"),
        F.sum(F.when(F.lower("status") == "available", 1).otherwise(0)).alias("available_rooms"),
    )
    return (
        hotels.select("hotel_id", "title", "city", "price", "address")
        .join(per_hotel, "hotel_id", "left")
        .select(
            "hotel_id", "title", "city", "price", "address",
            F.coalesce(F.col("total_rooms"), F.lit(0)).alias("total_rooms"),
            F.coalesce(F.col("available_rooms"), F.lit(0)).cast("long").alias("available_rooms"),
        )
        .orderBy(F.lower("city"), F.lower("title"), "hotel_id")
    )


def room_listing(rooms: DataFrame, hotels: DataFrame, hotel_id: int | None = None,
                 status: str | None = None) -> DataFrame:
    """Rooms with their hotel's name and city (rooms of unknown hotels drop out)."""
    r = rooms
    if hotel_id is not None:
        r = r.filter(F.col("hotel_id") == hotel_id)
    if status:
        r = r.filter(F.lower("status") == status.lower())
    h = hotels.select("hotel_id", F.col("title").alias("hotel_name"), "city")
    df = r.join(h, "hotel_id")
    # the store ordered text case-insensitively
    order = [F.lower("room_number"), "room_id"]
    if hotel_id is None:
        order = [F.lower("hotel_name")] + order
    return df.orderBy(*order)


def room_type_defaults(requests: DataFrame) -> DataFrame:
    """New-room rows: multiplier and max guests by the exact form room type, status 'available'."""
    t = F.col("room_type")
    mult = F.lit(rules.ROOM_TYPE_DEFAULT_OTHER[0])
    guests = F.lit(rules.ROOM_TYPE_DEFAULT_OTHER[1])
    for name, m, g in reversed(rules.ROOM_TYPE_DEFAULTS):
        mult = F.when(t == name, F.lit(m)).otherwise(mult)
        guests = F.when(t == name, F.lit(g)).otherwise(guests)
    return requests.select(
        *[c for c in ("room_id",) if c in requests.columns], "hotel_id", "room_number", "room_type",
        F.lit(None).cast("decimal(10,2)").alias("price"),
        mult.cast("decimal(3,2)").alias("price_multiplier"),
        F.coalesce(F.col("features"), F.lit("")).alias("features") if "features" in requests.columns
        else F.lit("").alias("features"),
        F.lit("available").alias("status"),
        F.lit(1).alias("capacity"),
        guests.cast("int").alias("max_guests"),
    )


def add_rooms(requests: DataFrame, rooms: DataFrame) -> DataFrame:
    """Requested rooms as stored, with ids after the stored ones in order of ``request_id``."""
    return room_type_defaults(assign_ids(requests, "request_id", "room_id", rooms, "room_id"))


def add_default_rooms(new_hotels: DataFrame, rooms: DataFrame) -> DataFrame:
    """The default rooms of new hotels as stored, with ids after the stored ones by hotel and room number."""
    rows = expand_default_rooms(new_hotels)
    numbered = assign_ids(rows.withColumn("_by", F.col("room_number").cast("bigint")), "_by", "room_id", rooms, "room_id")
    return numbered.select("room_id", *rows.columns)


def expand_default_rooms(new_hotels: DataFrame) -> DataFrame:
    """Three default rooms per new hotel, numbered str(hotel_id*100) + suffix."""
    template = F.array(*[
        F.struct(
            F.lit(sfx).alias("sfx"), F.lit(kind).alias("room_type"), F.lit(f).cast("decimal(3,2)").alias("f"),
            F.lit(cap).alias("capacity"), F.lit(mg).alias("max_guests"),
            F.lit(m).cast("decimal(3,2)").alias("price_multiplier"), F.lit(feat).alias("features"),
        )
        for sfx, kind, f, cap, mg, m, feat in rules.DEFAULT_ROOMS
    ])
    x = new_hotels.select("hotel_id", "price", F.inline(template))
    return x.select(
        "hotel_id",
        F.concat((F.col("hotel_id") * 100).cast("string"), F.col("sfx")).alias("room_number"),
        "room_type",
        (F.col("price") * F.col("f")).cast("decimal(10,2)").alias("price"),
        F.lit("available").alias("status"),
        "capacity", "max_guests", "price_multiplier", "features",
    )


def room_labels(rooms: DataFrame) -> DataFrame:
    t, s = F.col("room_type"), F.col("status")
    mult = F.coalesce(F.col("price_multiplier"), F.lit("1.00").cast("decimal(3,2)")) \
        if "price_multiplier" in rooms.columns else F.lit("1.00").cast("decimal(3,2)")
    return rooms.select(
        "room_id",
        (mult * 100).cast("int").alias("multiplier_percent"),
        F.when(t == "standard", "Standard").when(t == "double", "Double").when(t == "family", "Family")
        .otherwise("").alias("type_label"),
        F.when(s == "available", "Available").when(s == "booked", "Booked")
        .when(s == "maintenance", "Maintenance").otherwise("").alias("status_label"),
    )
