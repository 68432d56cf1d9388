"""Catalog (C1-C7) and room inventory (R1-R5, R9) queries."""

from pyspark.sql import functions as F

from lodgelake.operators import catalog as C
from lodgelake.operators import inventory as I
from lodgelake.plans.registry import query

HOTEL_COLS = "hotel_id, city, title, price, image, description"


@query("hotel_search", f"SELECT {HOTEL_COLS} FROM hotels ORDER BY hotel_id LIMIT 9")
def hotel_search(v):
    return C.hotel_search(v.hotels)


@query("hotel_search_price_low_page2",
       f"SELECT {HOTEL_COLS} FROM hotels ORDER BY price, hotel_id LIMIT 8 OFFSET 9")
def hotel_search_price_low_page2(v):
    return C.hotel_search(v.hotels, sort="price-low", offset=9)


@query("hotel_search_city_by_name", f"""
SELECT {HOTEL_COLS} FROM hotels WHERE lower(city) = 'london' ORDER BY lower(title), hotel_id LIMIT 9""")
def hotel_search_city_by_name(v):
    return C.hotel_search(v.hotels, city="London", sort="name")


@query("hotel_search_price_high", f"SELECT {HOTEL_COLS} FROM hotels ORDER BY price DESC, hotel_id LIMIT 9")
def hotel_search_price_high(v):
    return C.hotel_search(v.hotels, sort="price-high")


@query("hotel_search_meta", """
SELECT count(*) AS total, count(*) > 9 AS more, 9 AS next_offset FROM hotels""")
def hotel_search_meta(v):
    return C.hotel_search_meta(v.hotels)


@query("hotel_search_meta_city", """
SELECT count(*) AS total, count(*) > 17 AS more, 17 AS next_offset FROM hotels WHERE lower(city) = 'kent'""")
def hotel_search_meta_city(v):
    return C.hotel_search_meta(v.hotels, city="kent", offset=9)


@query("distinct_cities", "SELECT min(city) AS city FROM hotels GROUP BY lower(city) ORDER BY lower(city)")
def distinct_cities(v):
    return C.distinct_cities(v.hotels)


@query("hotel_detail", "SELECT *, concat('images/hotels/', coalesce(image, 'default.jpg')) AS hero_image FROM hotels")
def hotel_detail(v):
    return C.hotel_detail(v.hotels)


@query("hotel_detail_by_ids", """
SELECT *, concat('images/hotels/', coalesce(image, 'default.jpg')) AS hero_image FROM hotels
WHERE hotel_id IN (SELECT hotel_id FROM bookings WHERE status = 'cancelled')""")
def hotel_detail_by_ids(v):
    return C.hotel_detail(v.hotels, v.bookings.filter(F.col("status") == "cancelled"))


@query("hotel_text_search", """
SELECT * FROM hotels WHERE contains(lower(title), 'supplier#0000000') AND contains(lower(city), 'new')""")
def hotel_text_search(v):
    return C.hotel_text_search(v.hotels, "Supplier#0000000", "NEW")


def _terms(v):
    """Pieces of hotel names: up to six letters, the empty one among them, some of them in another case."""
    k = F.col("hotel_id")
    piece = F.substring(F.col("title"), (1 + k % 12).cast("int"), (k % 7).cast("int"))
    return v.hotels.select(F.when(k % 2 == 0, F.upper(piece)).otherwise(piece).alias("term"))


@query("hotel_text_search_many", """
WITH terms AS (SELECT DISTINCT CASE WHEN hotel_id % 2 = 0 THEN upper(substr(title, 1 + hotel_id % 12, hotel_id % 7))
  ELSE substr(title, 1 + hotel_id % 12, hotel_id % 7) END AS term FROM hotels)
SELECT t.term, h.* FROM terms t JOIN hotels h ON contains(lower(h.title), lower(t.term))""")
def hotel_text_search_many(v):
    return C.hotel_text_search_many(v.hotels, _terms(v))


@query("hotel_options", "SELECT hotel_id, title, city FROM hotels ORDER BY lower(title), hotel_id")
def hotel_options(v):
    return C.hotel_options(v.hotels)


@query("hotel_teasers", """
SELECT hotel_id, title, concat(substring(coalesce(description, ''), 1, 90), '...') AS teaser FROM hotels""")
def hotel_teasers(v):
    return C.hotel_teasers(v.hotels)


@query("room_availability", """
SELECT hotel_id, room_type, count(*) AS available_count FROM rooms WHERE status = 'available' GROUP BY 1, 2""")
def room_availability(v):
    return I.room_availability(v.rooms)


@query("room_availability_map", """
SELECT hotel_id, map_from_entries(list((room_type, available_count) ORDER BY room_type)) AS availability FROM (
  SELECT hotel_id, room_type, count(*) AS available_count FROM rooms WHERE status = 'available' GROUP BY 1, 2)
GROUP BY hotel_id""")
def room_availability_map(v):
    return I.room_availability_map(v.rooms)


@query("hotel_inventory", """
SELECT h.hotel_id, h.title, h.city, h.price, h.address, count(r.room_id) AS total_rooms,
  CAST(sum(CASE WHEN r.status = 'available' THEN 1 ELSE 0 END) AS BIGINT) AS available_rooms
FROM hotels h LEFT JOIN rooms r ON h.hotel_id = r.hotel_id
GROUP BY h.hotel_id, h.title, h.city, h.price, h.address ORDER BY lower(h.city), lower(h.title), h.hotel_id""")
def hotel_inventory(v):
    return I.hotel_inventory(v.hotels, v.rooms)


@query("room_listing", """
SELECT r.*, h.title AS hotel_name, h.city FROM rooms r JOIN hotels h ON r.hotel_id = h.hotel_id
ORDER BY lower(h.title), lower(r.room_number), r.room_id""")
def room_listing(v):
    return I.room_listing(v.rooms, v.hotels)


@query("room_listing_available", """
SELECT r.*, h.title AS hotel_name, h.city FROM rooms r JOIN hotels h ON r.hotel_id = h.hotel_id
WHERE r.status = 'available' ORDER BY lower(h.title), lower(r.room_number), r.room_id""")
def room_listing_available(v):
    return I.room_listing(v.rooms, v.hotels, status="available")


@query("room_type_defaults", """
SELECT hotel_id, room_number, room_type, CAST(NULL AS DECIMAL(10,2)) AS price,
  CAST(CASE room_type WHEN 'standard' THEN 1.0 WHEN 'double' THEN 1.2 WHEN 'family' THEN 1.5 ELSE 1.0 END
    AS DECIMAL(3,2)) AS price_multiplier,
  '' AS features, 'available' AS status, 1 AS capacity,
  CASE room_type WHEN 'standard' THEN 1 WHEN 'double' THEN 2 WHEN 'family' THEN 4 ELSE 1 END AS max_guests
FROM (SELECT hotel_id, room_number,
        CASE lower(room_type) WHEN 'single' THEN 'standard' ELSE lower(room_type) END AS room_type FROM rooms)""")
def room_type_defaults(v):
    form = F.when(F.lower("room_type") == "single", "standard").otherwise(F.lower("room_type"))
    return I.room_type_defaults(v.rooms.select("hotel_id", "room_number", form.alias("room_type")))


@query("add_rooms", """
SELECT (SELECT max(room_id) FROM rooms) + row_number() OVER (ORDER BY room_id) AS room_id, hotel_id, room_number, room_type,
  CAST(NULL AS DECIMAL(10,2)) AS price,
  CAST(CASE room_type WHEN 'standard' THEN 1.0 WHEN 'double' THEN 1.2 WHEN 'family' THEN 1.5 ELSE 1.0 END
    AS DECIMAL(3,2)) AS price_multiplier,
  '' AS features, 'available' AS status, 1 AS capacity,
  CASE room_type WHEN 'standard' THEN 1 WHEN 'double' THEN 2 WHEN 'family' THEN 4 ELSE 1 END AS max_guests
FROM (SELECT room_id, hotel_id, room_number,
        CASE lower(room_type) WHEN 'single' THEN 'standard' ELSE lower(room_type) END AS room_type FROM rooms)""")
def add_rooms(v):
    """R4 with ids: a room like each stored one is added."""
    form = F.when(F.lower("room_type") == "single", "standard").otherwise(F.lower("room_type"))
    return I.add_rooms(v.rooms.select(F.col("room_id").alias("request_id"), "hotel_id", "room_number", form.alias("room_type")),
                       v.rooms)


@query("add_default_rooms", """
WITH d AS (SELECT n.hotel_id, concat(CAST(n.hotel_id * 100 AS VARCHAR), t.sfx) AS room_number, t.room_type,
  CAST(n.price * t.f AS DECIMAL(10,2)) AS price, 'available' AS status, t.capacity, t.max_guests,
  CAST(t.m AS DECIMAL(3,2)) AS price_multiplier, t.features
FROM new_hotels n, (VALUES
  ('01', 'Single', 0.8, 1, 1, 1.0, 'Single bed, TV, WiFi, En-suite bathroom'),
  ('02', 'Double', 1.0, 2, 2, 1.2, 'Double bed, TV, WiFi, Mini-fridge, En-suite bathroom'),
  ('03', 'Family', 1.2, 4, 4, 1.5, 'Two double beds, TV, WiFi, Mini-fridge, Sofa, En-suite bathroom'))
  AS t(sfx, room_type, f, capacity, max_guests, m, features))
SELECT (SELECT max(room_id) FROM rooms) + row_number() OVER (ORDER BY CAST(room_number AS BIGINT)) AS room_id, * FROM d""")
def add_default_rooms(v):
    return I.add_default_rooms(v.new_hotels, v.rooms)


@query("expand_default_rooms", """
SELECT n.hotel_id, concat(CAST(n.hotel_id * 100 AS VARCHAR), t.sfx) AS room_number, t.room_type,
  CAST(n.price * t.f AS DECIMAL(10,2)) AS price, 'available' AS status, t.capacity, t.max_guests,
  CAST(t.m AS DECIMAL(3,2)) AS price_multiplier, t.features
FROM new_hotels n, (VALUES
  ('01', 'Single', 0.8, 1, 1, 1.0, 'Single bed, TV, WiFi, En-suite bathroom'),
  ('02', 'Double', 1.0, 2, 2, 1.2, 'Double bed, TV, WiFi, Mini-fridge, En-suite bathroom'),
  ('03', 'Family', 1.2, 4, 4, 1.5, 'Two double beds, TV, WiFi, Mini-fridge, Sofa, En-suite bathroom'))
  AS t(sfx, room_type, f, capacity, max_guests, m, features)""")
def expand_default_rooms(v):
    return I.expand_default_rooms(v.new_hotels)


@query("room_labels", """
SELECT room_id, 100 AS multiplier_percent,
  CASE room_type WHEN 'standard' THEN 'Standard' WHEN 'double' THEN 'Double' WHEN 'family' THEN 'Family' ELSE '' END
    AS type_label,
  CASE status WHEN 'available' THEN 'Available' WHEN 'booked' THEN 'Booked' WHEN 'maintenance' THEN 'Maintenance'
    ELSE '' END AS status_label
FROM rooms""")
def room_labels(v):
    return I.room_labels(v.rooms)


@query("room_availability_one_hotel", """
SELECT hotel_id, room_type, count(*) AS available_count FROM rooms WHERE status = 'available'
  AND hotel_id = (SELECT min(hotel_id) FROM hotels WHERE city = 'Oxford') GROUP BY 1, 2""")
def room_availability_one_hotel(v):
    # the source's per-hotel form; the hotel is chosen from the data (first hotel in Oxford)
    first = v.hotels.filter(F.col("city") == "Oxford").select(F.min("hotel_id")).scalar()
    return I.room_availability(v.rooms.filter(F.col("hotel_id") == first))
