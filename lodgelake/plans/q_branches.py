"""Queries over inputs that reach every declared branch of an operator: refused and done, priced and discounted, cut
texts, broken rows.  ``BRANCHES`` says what each must hold; a test fails where a query never gets there."""

from pyspark.sql import functions as F

from lodgelake.operators import accounts as A
from lodgelake.operators import bookings as B
from lodgelake.operators import catalog as C
from lodgelake.operators import changes as X
from lodgelake.operators import quality as Q
from lodgelake.plans.q_bookings import BOOKING_DETAIL
from lodgelake.plans.q_changes import ROOM_DELETE, USER_DELETE
from lodgelake.plans.registry import query

#: query -> conditions that some row must meet
BRANCHES: dict[str, list[str]] = {}


def reaching(*conditions: str):
    def deco(fn):
        BRANCHES[fn.__name__] = list(conditions)
        return fn
    return deco


UNKNOWN = 10**9
ROOMS_ASKED = "SELECT room_id FROM rooms WHERE room_id % 5 < 2 UNION SELECT 1000000000"
# accounts registered since, which have no booking yet
MORE_USERS = "(SELECT * FROM users UNION ALL SELECT * REPLACE (id + 1000000 AS id) FROM users)"
USERS_ASKED = f"SELECT id FROM {MORE_USERS} WHERE id % 4 = 1 UNION SELECT 1000000000"
ROOM_DELETE_MIXED = ROOM_DELETE.replace("SELECT DISTINCT room_id FROM rooms WHERE status = 'maintenance'", ROOMS_ASKED)
USER_DELETE_MIXED = USER_DELETE.replace("SELECT DISTINCT id FROM users WHERE role = 'admin'", USERS_ASKED) \
    .replace("LEFT JOIN users u", f"LEFT JOIN {MORE_USERS} u")


def _rooms_asked(v):
    return v.rooms.where("room_id % 5 < 2").select("room_id").unionAll(v.spark.range(UNKNOWN, UNKNOWN + 1).toDF("room_id"))


def _more_users(v):
    return v.users.unionByName(v.users.withColumn("id", F.col("id") + 1_000_000))


def _users_asked(v):
    return _more_users(v).where("id % 4 = 1").select("id").unionAll(v.spark.range(UNKNOWN, UNKNOWN + 1))


@reaching("outcome = 'deleted'", "outcome = 'refused' AND message LIKE 'Cannot delete room with % bookings!%'", "outcome = 'not_found'")
@query("room_delete_outcomes_mixed", ROOM_DELETE_MIXED)
def room_delete_outcomes_mixed(v):
    return X.room_delete_outcomes(v.rooms, v.bookings, _rooms_asked(v))


@reaching("room_id % 5 < 2", "room_id % 5 >= 2")
@query("delete_rooms_mixed", f"""
WITH o AS ({ROOM_DELETE_MIXED}) SELECT * FROM rooms WHERE room_id NOT IN (SELECT room_id FROM o WHERE outcome = 'deleted')""")
def delete_rooms_mixed(v):
    return X.delete_rooms(v.rooms, v.bookings, _rooms_asked(v))


@reaching("outcome = 'deleted'", "outcome = 'refused' AND message LIKE 'Cannot delete user with % bookings!'", "outcome = 'not_found'")
@query("user_delete_outcomes_mixed", USER_DELETE_MIXED)
def user_delete_outcomes_mixed(v):
    return X.user_delete_outcomes(_more_users(v), v.bookings, _users_asked(v))


@reaching("id % 4 = 1", "id % 4 <> 1")
@query("delete_users_mixed", f"""
WITH o AS ({USER_DELETE_MIXED}) SELECT * FROM {MORE_USERS} WHERE id NOT IN (SELECT id FROM o WHERE outcome = 'deleted')""")
def delete_users_mixed(v):
    return X.delete_users(_more_users(v), v.bookings, _users_asked(v))


@reaching("length(teaser) = 93", "length(teaser) < 93", "teaser = '...'")
@query("hotel_teasers_long", """
SELECT hotel_id, title, concat(substring(coalesce(repeat(concat(description, ' '), CAST(hotel_id % 6 AS INTEGER)), ''), 1, 90), '...')
  AS teaser FROM hotels""")
def hotel_teasers_long(v):
    text = F.expr("repeat(concat(description, ' '), CAST(hotel_id % 6 AS INT))")
    return C.hotel_teasers(v.hotels.withColumn("description", text))


PRICED = """
SELECT b.* REPLACE (CAST(total_price * 0.8 AS DECIMAL(10,2)) AS base_price,
  CAST(booking_id % 7 * 1.5 AS DECIMAL(10,2)) AS peak_surcharge,
  CASE WHEN booking_id % 4 <> 0 THEN CAST(total_price AS DECIMAL(10,2)) END AS subtotal,
  CAST(CASE booking_id % 3 WHEN 0 THEN 10 WHEN 1 THEN 0 END AS DECIMAL(5,2)) AS advance_discount_percent,
  CAST(CASE WHEN booking_id % 3 = 0 THEN total_price * 0.1 END AS DECIMAL(10,2)) AS advance_discount_amount,
  concat('Guest ', CAST(user_id AS VARCHAR)) AS guest_name) FROM bookings_wide b"""


def _priced(v):
    k, total = F.col("booking_id"), F.col("total_price")
    return v.bookings.select(
        "*", (total * F.lit("0.8").cast("decimal(2,1)")).cast("decimal(10,2)").alias("base_price"),
        (k % 7 * F.lit("1.5").cast("decimal(2,1)")).cast("decimal(10,2)").alias("peak_surcharge"),
        F.when(k % 4 != 0, total).cast("decimal(10,2)").alias("subtotal"),
        F.when(k % 3 == 0, 10).when(k % 3 == 1, 0).cast("decimal(5,2)").alias("advance_discount_percent"),
        F.when(k % 3 == 0, total * F.lit("0.1").cast("decimal(2,1)")).cast("decimal(10,2)").alias("advance_discount_amount"),
        F.concat(F.lit("Guest "), F.col("user_id").cast("string")).alias("guest_name"))


PRICED_DETAIL = "WITH priced AS (" + PRICED + ")" + BOOKING_DETAIL.replace("FROM bookings_wide b", "FROM priced b")


@reaching("base_price > 0", "subtotal = 0", "subtotal > 0", "advance_discount_percent > 0", "guest_surcharge = 0")
@query("booking_detail_priced", PRICED_DETAIL)
def booking_detail_priced(v):
    return B.booking_detail(_priced(v), v.hotels, v.users)


@reaching("has_discount = 'Yes'", "has_discount = 'No'")
@query("booking_receipt_priced", "WITH priced AS (" + PRICED + """)
SELECT booking_id, hotel_name, advance_discount_percent, advance_discount_amount, has_discount FROM (
  SELECT b.booking_id, h.title AS hotel_name,
    CAST(coalesce(b.advance_discount_percent, 0) AS DECIMAL(5,2)) AS advance_discount_percent,
    CAST(coalesce(b.advance_discount_amount, 0) AS DECIMAL(10,2)) AS advance_discount_amount,
    CASE WHEN b.advance_discount_percent > 0 THEN 'Yes' ELSE 'No' END AS has_discount
  FROM priced b LEFT JOIN hotels h ON b.hotel_id = h.hotel_id)""")
def booking_receipt_priced(v):
    return B.booking_detail(_priced(v), v.hotels, v.users, receipt=True).select(
        "booking_id", "hotel_name", "advance_discount_percent", "advance_discount_amount", "has_discount")


@reaching("column = 'status' AND rule = 'outside domain'", "column = 'room_number' AND rule LIKE 'longer than%'")
@query("constraint_violations_rooms", """
WITH r AS (SELECT room_id, repeat(room_number, CAST(1 + room_id % 7 AS INTEGER)) AS room_number,
  CASE WHEN room_id % 5 = 0 THEN 'closed' ELSE status END AS status FROM rooms)
SELECT room_id, 'status' AS "column", 'outside domain' AS rule FROM r WHERE status NOT IN ('available', 'booked', 'maintenance')
UNION ALL SELECT room_id, 'room_number', 'longer than 10' FROM r WHERE length(room_number) > 10""")
def constraint_violations_rooms(v):
    r = v.rooms.select("room_id", F.expr("repeat(room_number, CAST(1 + room_id % 7 AS INT))").alias("room_number"),
                       F.when(F.col("room_id") % 5 == 0, "closed").otherwise(F.col("status")).alias("status"))
    return Q.constraint_violations(r, "rooms")


@reaching("n > 1")
@query("duplicate_room_numbers_found", """
SELECT lower(room_number) AS room_number, count(*) AS n FROM (
  SELECT concat(CASE WHEN room_id % 2 = 0 THEN 'R' ELSE 'r' END, CAST(room_id // 3 AS VARCHAR)) AS room_number FROM rooms)
GROUP BY 1 HAVING count(*) > 1""")
def duplicate_room_numbers_found(v):
    k = F.col("room_id")
    r = v.rooms.select(F.concat(F.when(k % 2 == 0, "R").otherwise("r"), F.expr("room_id DIV 3").cast("string")).alias("room_number"))
    return Q.duplicate_keys(r, ["room_number"]).withColumnRenamed("rows", "n")


# ------------------------------------------------------------------ accents and case in keys (DQ2, C1, U4, U5, U9)
SPELLED = "CASE {k} % 4 WHEN 0 THEN 'José' WHEN 1 THEN 'JOSE' WHEN 2 THEN 'josÈ' ELSE 'jose' END"


def _spelled(k):
    return F.when(k % 4 == 0, "José").when(k % 4 == 1, "JOSE").when(k % 4 == 2, "josÈ").otherwise("jose")


def _named(df, key, of):
    """Names that are one to the store where ``of`` is equal, spelled by ``key``."""
    name = F.concat(_spelled(F.col(key)), F.lit("."), of.cast("string"))
    return df.withColumn("username", name).withColumn("email", F.concat(name, F.lit("@mäil.com")))


def _named_sql(table, key, of):
    name = f"concat({SPELLED.format(k=key)}, '.', {of})"
    return f"(SELECT * REPLACE ({name} AS username, concat({name}, '@mäil.com') AS email) FROM {table})"


@reaching("n > 2")
@query("duplicate_names_accented", f"""
SELECT strip_accents(lower(username)) AS name, count(*) AS n FROM {_named_sql("users", "id", "id // 3")}
GROUP BY username COLLATE NOCASE.NOACCENT, 1 HAVING count(*) > 1""")
def duplicate_names_accented(v):
    d = Q.duplicate_keys(_named(v.users, "id", F.expr("id DIV 3")), ["username"])
    fold = F.translate("username", "éè", "ee")  # any spelling may be shown
    return d.select(fold.alias("name"), F.col("rows").alias("n"))


CITIES = "(SELECT * REPLACE (concat(" + SPELLED.format(k="hotel_id") + ", ' ', hotel_id % 3) AS city) FROM hotels)"


def _cities(v):
    k = F.col("hotel_id")
    return v.hotels.withColumn("city", F.concat(_spelled(k), F.lit(" "), (k % 3).cast("string")))


@reaching("city LIKE 'JOSE %'")
@query("distinct_cities_accented", f"SELECT min(city) AS city FROM {CITIES} GROUP BY city COLLATE NOCASE.NOACCENT")
def distinct_cities_accented(v):
    return C.distinct_cities(_cities(v))


@reaching("city = 'José 1'", "city = 'JOSE 1'", "city = 'jose 1'")
@query("hotel_search_accented", f"""
SELECT hotel_id, city, title, price, image, description FROM {CITIES} WHERE city COLLATE NOCASE.NOACCENT = 'jôsé 1'
ORDER BY price, hotel_id LIMIT 9""")
def hotel_search_accented(v):
    return C.hotel_search(_cities(v), city="jôsé 1", sort="price-low")


ASKED = "concat('ĴOSÊ.', CAST(request_id % 60 AS BIGINT), CASE WHEN request_id % 2 = 0 THEN '@MAIL.com' ELSE '' END)"


@reaching("identifier LIKE '%@MAIL.com'", "identifier NOT LIKE '%@MAIL.com'")
@query("resolve_identity_accented", f"""
SELECT DISTINCT r.identifier, u.id, u.username, u.email, u.created_at, u.last_login, u.role, u.status
FROM (SELECT {ASKED} AS identifier FROM new_users) r JOIN {_named_sql("users", "id", "id // 3")} u
ON r.identifier = u.username COLLATE NOCASE.NOACCENT OR r.identifier = u.email COLLATE NOCASE.NOACCENT""")
def resolve_identity_accented(v):
    return A.resolve_identity(v.new_users.select(F.expr(ASKED).alias("identifier")), _named(v.users, "id", F.expr("id DIV 3")))


REGISTER_NAMED = f"""
WITH r AS (SELECT * FROM {_named_sql("new_users", "request_id", "request_id // 5")}),
f AS (SELECT *, EXISTS (SELECT 1 FROM {_named_sql("users", "id", "id * 2")} u WHERE strip_accents(lower(u.username)) = strip_accents(lower(r.username))) AS held,
  row_number() OVER (PARTITION BY strip_accents(lower(username)) ORDER BY request_id) AS k FROM r)
SELECT request_id, username, email, NOT held AND k = 1 AS registered,
  CASE WHEN held OR k > 1 THEN 'Account already exists!' END AS message FROM f"""


@reaching("registered", "NOT registered")
@query("registration_outcomes_accented", REGISTER_NAMED)
def registration_outcomes_accented(v):
    return A.registration_outcomes(_named(v.new_users, "request_id", F.expr("request_id DIV 5")),
                                   _named(v.users, "id", F.col("id") * 2))
