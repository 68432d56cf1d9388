"""Account queries (U4-U6, U10), data quality (DQ1-DQ4) and sinks."""

import uuid

from pyspark.sql import functions as F

from lodgelake.operators import accounts as A
from lodgelake.operators import quality as Q
from lodgelake.operators.bookings import booking_detail
from lodgelake.operators.pricing import cancellation_quotes, price_quotes, stay_requests
from lodgelake.plans.q_bookings import BOOKING_DETAIL
from lodgelake.plans.q_pricing import CANCELLATION_QUOTES, QUOTES_CTES
from lodgelake.plans.registry import AS_OF, query
from lodgelake.session import checkpoint_dir
from lodgelake.sources import sinks as S
from lodgelake.sources.generations import load_generations, write_generation
from lodgelake.sources.tables import load_declared

IDENTIFIERS = "SELECT username AS identifier FROM new_users UNION ALL SELECT email FROM new_users"


def _identifiers(v):
    n = v.new_users
    return n.select(F.col("username").alias("identifier")).unionAll(n.select(F.col("email").alias("identifier")))


@query("resolve_identity", f"""
WITH req AS (SELECT DISTINCT identifier, lower(trim(identifier)) AS k FROM ({IDENTIFIERS}))
SELECT DISTINCT req.identifier, u.id, u.username, u.email, u.created_at, u.last_login, u.role, u.status
FROM req JOIN users u ON req.k = lower(u.username) OR req.k = lower(u.email)""")
def resolve_identity(v):
    return A.resolve_identity(_identifiers(v), v.users)


@query("user_profiles", "SELECT id, username, email, created_at, last_login, role, status FROM users")
def user_profiles(v):
    return A.user_profiles(v.users)


VALIDATE_USERS = """
WITH r AS (SELECT request_id, trim(coalesce(username, '')) AS username, lower(trim(coalesce(email, ''))) AS email,
    coalesce(role, 'user') AS role FROM new_users),
t AS (SELECT DISTINCT r.request_id FROM r JOIN users u ON lower(r.username) = lower(u.username)
  UNION SELECT r.request_id FROM r JOIN users u ON r.email = lower(u.email)),
e AS (SELECT r.*, nullif(concat_ws(' ',
    CASE WHEN username = '' THEN 'Username is required'
      WHEN length(username) < 3 OR length(username) > 20 THEN 'Username must be 3-20 characters' END,
    CASE WHEN email = '' THEN 'Email is required'
      WHEN NOT contains(email, '@') OR NOT contains(email, '.') THEN 'Invalid email format' END,
    CASE WHEN role NOT IN ('user', 'admin') THEN 'Invalid role selected' END,
    CASE WHEN t.request_id IS NOT NULL THEN 'Email or username already exists' END), '') AS msg
  FROM r LEFT JOIN t ON r.request_id = t.request_id),
checked AS (SELECT request_id, username, email, role, msg IS NULL AS valid, msg AS message FROM e)"""


@query("validate_new_users", VALIDATE_USERS + " SELECT * FROM checked")
def validate_new_users(v):
    return A.validate_new_users(v.new_users, v.users)


# one request after the other: the state before request k is what the accepted ones before it took
@query("append_users", VALIDATE_USERS.replace("WITH r AS", "WITH RECURSIVE r AS", 1) + """
, ok AS (SELECT *, lower(username) AS lu, row_number() OVER (ORDER BY request_id) AS k FROM checked WHERE valid),
st(k, names, mails) AS (
  SELECT CAST(1 AS BIGINT), CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[])
  UNION ALL
  SELECT st.k + 1,
    CASE WHEN list_contains(names, ok.lu) OR list_contains(mails, ok.email) THEN names ELSE list_append(names, ok.lu) END,
    CASE WHEN list_contains(names, ok.lu) OR list_contains(mails, ok.email) THEN mails ELSE list_append(mails, ok.email) END
  FROM st JOIN ok ON ok.k = st.k),
w AS (SELECT ok.* FROM ok JOIN st ON st.k = ok.k
  WHERE NOT list_contains(st.names, ok.lu) AND NOT list_contains(st.mails, ok.email))
SELECT (SELECT max(id) FROM users) + row_number() OVER (ORDER BY request_id) AS id, username, email,
  AS_OF AS created_at, CAST(NULL AS TIMESTAMP) AS last_login, role, 1 AS status, request_id FROM w""")
def append_users(v):
    return A.append_users(A.validate_new_users(v.new_users, v.users), v.users, AS_OF)


@query("user_labels", """
SELECT id, coalesce(nullif(username, ''), 'N/A') AS name_label, coalesce(nullif(email, ''), 'N/A') AS email_label,
  CASE WHEN role = 'admin' THEN 'Administrator' ELSE 'Standard User' END AS role_label,
  CASE WHEN status = 1 THEN 'Active' ELSE 'Inactive' END AS status_label,
  coalesce(strftime(created_at, '%Y-%m-%d'), 'N/A') AS joined,
  coalesce(strftime(created_at, '%d %b %Y'), 'Recently') AS member_since,
  CASE WHEN coalesce(username, '') <> '' THEN upper(left(username, 1)) ELSE 'U' END AS initial
FROM users""")
def user_labels(v):
    return A.user_labels(v.users)


# ------------------------------------------------------------------ data quality
@query("constraint_violations", """
SELECT request_id AS id, 'role' AS "column", 'outside domain' AS rule FROM new_users
WHERE role NOT IN ('user', 'admin')""")
def constraint_violations(v):
    n = v.new_users.select(F.col("request_id").alias("id"), "username", "email", "role",
                           F.lit(1).alias("status"))
    return Q.constraint_violations(n, "users")


@query("constraint_violations_bookings", """
SELECT booking_id, 'status' AS "column", 'outside domain' AS rule FROM bookings
WHERE status NOT IN ('confirmed', 'pending', 'cancelled')""")
def constraint_violations_bookings(v):
    return Q.constraint_violations(v.bookings, "bookings")


# columns each derived view carries (checks on absent columns are skipped, as in the operator)
VIEW_COLUMNS = {
    "hotels": ["hotel_id", "city", "title", "description", "price", "image", "address"],
    "rooms": ["room_id", "hotel_id", "room_number", "room_type", "price", "status", "capacity"],
    "users": ["id", "username", "email", "created_at", "last_login", "role", "status"],
    "bookings": ["booking_id", "user_id", "hotel_id", "room_id", "room_type", "check_in", "check_out", "guests",
                 "num_nights", "total_price", "status", "booking_date"],
    "contact_messages": ["id", "name", "email", "subject", "message", "submitted_at"],
}


def _constraint_report_sql() -> str:
    from lodgelake import schema as SC

    parts = []
    for table, cols in VIEW_COLUMNS.items():
        key = " || '|' || ".join(f"CAST({k} AS VARCHAR)" for k in SC.PRIMARY_KEYS[table])
        for c in SC.spec(table):
            if c.name not in cols:
                continue
            checks = []
            if not c.nullable:
                checks.append((f"{c.name} IS NULL", "null"))
            if c.max_len:
                checks.append((f"length({c.name}) > {c.max_len}", f"longer than {c.max_len}"))
            if c.domain:
                dom = ", ".join(f"'{d}'" if isinstance(d, str) else str(d) for d in c.domain)
                checks.append((f"{c.name} IS NOT NULL AND {c.name} NOT IN ({dom})", "outside domain"))
            for cond, rule in checks:
                parts.append(f"SELECT '{table}' AS table_name, {key} AS record_key, '{c.name}' AS \"column\", "
                             f"'{rule}' AS rule FROM {table} WHERE {cond}")
    return "\nUNION ALL\n".join(parts)


@query("constraint_report", _constraint_report_sql())
def constraint_report(v):
    return Q.constraint_report({"hotels": v.hotels, "rooms": v.rooms, "users": v.users, "bookings": v.bookings,
                                "contact_messages": v.contact_messages})


@query("duplicate_usernames", """
SELECT lower(username) AS username, count(*) AS rows FROM new_users GROUP BY 1 HAVING count(*) > 1""")
def duplicate_usernames(v):
    return Q.duplicate_keys(v.new_users, ["username"])


@query("duplicate_room_numbers", """
SELECT lower(room_number) AS room_number, count(*) AS rows FROM rooms GROUP BY 1 HAVING count(*) > 1""")
def duplicate_room_numbers(v):
    return Q.duplicate_keys(v.rooms, ["room_number"])


@query("orphan_booking_hotels", "SELECT * FROM bookings WHERE hotel_id NOT IN (SELECT hotel_id FROM hotels)")
def orphan_booking_hotels(v):
    return Q.orphans(v.bookings, v.hotels, "hotel_id")


@query("orphan_booking_rooms", """
SELECT * FROM bookings WHERE room_id IS NOT NULL AND room_id NOT IN (SELECT room_id FROM rooms)""")
def orphan_booking_rooms(v):
    return Q.orphans(v.bookings, v.rooms, "room_id")


@query("orphan_booking_users", "SELECT * FROM bookings WHERE user_id NOT IN (SELECT id FROM users)")
def orphan_booking_users(v):
    return Q.orphans(v.bookings, v.users, "user_id", "id")


@query("orphan_rooms", "SELECT * FROM rooms WHERE hotel_id NOT IN (SELECT hotel_id FROM hotels)")
def orphan_rooms(v):
    return Q.orphans(v.rooms, v.hotels, "hotel_id")


@query("apply_defaults_rooms", """
SELECT *, CAST(1.00 AS DECIMAL(3,2)) AS price_multiplier, CAST(NULL AS VARCHAR) AS features, 1 AS max_guests
FROM rooms""")
def apply_defaults_rooms(v):
    return Q.apply_defaults(v.rooms, "rooms")


@query("apply_defaults_bookings", """
SELECT booking_id, user_id, hotel_id, room_id, room_type, check_in, check_out, guests, num_nights,
  CAST(NULL AS VARCHAR) AS guest_name, CAST(NULL AS VARCHAR) AS guest_email, CAST(NULL AS VARCHAR) AS guest_phone,
  CAST(NULL AS VARCHAR) AS special_requests, CAST(0 AS DECIMAL(10,2)) AS base_price,
  CAST(0 AS DECIMAL(10,2)) AS peak_surcharge, CAST(0 AS DECIMAL(10,2)) AS room_type_surcharge,
  CAST(0 AS DECIMAL(10,2)) AS guest_surcharge, CAST(0 AS DECIMAL(10,2)) AS subtotal,
  CAST(0 AS DECIMAL(5,2)) AS advance_discount_percent, CAST(0 AS DECIMAL(10,2)) AS advance_discount_amount,
  total_price, status, booking_date, CAST(NULL AS TIMESTAMP) AS cancellation_date
FROM bookings""")
def apply_defaults_bookings(v):
    return Q.apply_defaults(v.bookings, "bookings")


# ------------------------------------------------------------------ sinks
REGISTER = """
WITH RECURSIVE r AS (SELECT request_id, username, email, lower(username) AS lu, lower(email) AS le,
    row_number() OVER (ORDER BY request_id) AS k,
    EXISTS (SELECT 1 FROM users u WHERE lower(u.username) = lower(n.username) OR lower(u.email) = lower(n.email)) AS held
  FROM new_users n),
st(k, names, mails, ok) AS (
  SELECT CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), FALSE
  UNION ALL
  SELECT r.k,
    CASE WHEN r.held OR list_contains(names, r.lu) OR list_contains(mails, r.le) THEN names ELSE list_append(names, r.lu) END,
    CASE WHEN r.held OR list_contains(names, r.lu) OR list_contains(mails, r.le) THEN mails ELSE list_append(mails, r.le) END,
    NOT (r.held OR list_contains(names, r.lu) OR list_contains(mails, r.le))
  FROM st JOIN r ON r.k = st.k + 1)"""


@query("registration_outcomes", REGISTER + """
SELECT r.request_id, r.username, r.email, st.ok AS registered,
  CASE WHEN NOT st.ok THEN 'Account already exists!' END AS message FROM r JOIN st ON r.k = st.k""")
def registration_outcomes(v):
    return A.registration_outcomes(v.new_users, v.users)


@query("register_users", REGISTER + """
SELECT (SELECT max(id) FROM users) + row_number() OVER (ORDER BY r.request_id) AS id, r.username, r.email,
  AS_OF AS created_at, CAST(NULL AS TIMESTAMP) AS last_login, 'user' AS role, 1 AS status, r.request_id
FROM r JOIN st ON r.k = st.k WHERE st.ok""")
def register_users(v):
    return A.register_users(v.new_users, v.users, AS_OF)


@query("append_messages", """
SELECT (SELECT max(id) FROM contact_messages) + row_number() OVER (ORDER BY id) AS id, name, email, subject, message,
  submitted_at, CAST(NULL AS VARCHAR) AS ip_address, 'new' AS status FROM contact_messages""")
def append_messages(v):
    """Forms without an id, one like each stored message."""
    forms = v.contact_messages.withColumnRenamed("id", "form_id")
    return S.append_messages(forms, v.contact_messages, AS_OF, "form_id")


@query("intake_messages", """
SELECT id, name, email, subject, message, coalesce(submitted_at, AS_OF) AS submitted_at,
  CAST(NULL AS VARCHAR) AS ip_address, 'new' AS status FROM contact_messages""")
def intake_messages(v):
    return S.intake_messages(v.contact_messages, AS_OF)


@query("schema_evolution", "SELECT * FROM bookings_wide")
def schema_evolution(v):
    return S.ensure_columns(v.bookings, "bookings")


APPENDED = ["booking_id", "user_id", "hotel_id", "room_type", "check_in", "check_out", "guests", "num_nights",
            "guest_name", "base_price", "peak_surcharge", "room_type_surcharge", "guest_surcharge", "subtotal",
            "advance_discount_percent", "advance_discount_amount", "total_price", "status", "booking_date"]


@query("append_bookings", f"""
WITH {QUOTES_CTES}
SELECT (SELECT max(booking_id) FROM bookings) + row_number() OVER (ORDER BY q.request_id) AS booking_id, b.user_id,
  q.hotel_id, q.room_type, q.check_in, q.check_out, q.guests, CAST(q.num_nights AS INTEGER) AS num_nights,
  'Guest' AS guest_name, CAST(q.standard_price AS DECIMAL(10,2)) AS base_price,
  CAST(q.peak_surcharge AS DECIMAL(10,2)) AS peak_surcharge,
  CAST(q.room_type_surcharge AS DECIMAL(10,2)) AS room_type_surcharge,
  CAST(q.guest_surcharge AS DECIMAL(10,2)) AS guest_surcharge, CAST(q.subtotal AS DECIMAL(10,2)) AS subtotal,
  CAST(q.discount_percent AS DECIMAL(5,2)) AS advance_discount_percent,
  CAST(q.advance_discount AS DECIMAL(10,2)) AS advance_discount_amount,
  CAST(q.total_price AS DECIMAL(10,2)) AS total_price, 'confirmed' AS status, AS_OF AS booking_date
FROM quotes q JOIN bookings b ON b.booking_id = q.request_id""")
def append_bookings(v):
    q = price_quotes(stay_requests(v.bookings), v.hotels, v.city_rates, AS_OF, keep=("user_id",))
    return S.append_bookings(q, v.bookings, AS_OF).select(*APPENDED)


def _json_sql(fields: list[tuple[str, str]]) -> str:
    """SQL for one JSON object as text; kinds: n number or money, s text, d date, t timestamp, b boolean."""
    text = {
        "n": "CAST({c} AS VARCHAR)", "b": "CASE WHEN {c} THEN 'true' WHEN NOT {c} THEN 'false' END",
        "s": "'\"' || replace(replace({c}, chr(92), chr(92) || chr(92)), '\"', chr(92) || '\"') || '\"'",
        "d": "'\"' || strftime({c}, '%Y-%m-%d') || '\"'",
        "t": "'\"' || strftime({c}, '%Y-%m-%d %H:%M:%S.%f') || '\"'",
    }
    parts = [f"'\"{c}\":' || coalesce({text[k].format(c=c)}, 'null')" for c, k in fields]
    return "'{' || " + " || ',' || ".join(parts) + " || '}'"


BOOKING_JSON = _json_sql([("booking_id", "n"), ("user_id", "n"), ("hotel_id", "n"), ("room_id", "n"), ("room_type", "s"),
                          ("check_in", "d"), ("check_out", "d"), ("guests", "n"), ("num_nights", "n"),
                          ("total_price", "n"), ("status", "s"), ("booking_date", "t")])
REFUND_JSON = _json_sql([("booking_id", "n"), ("user_id", "n"), ("hotel_name", "s"), ("total_price", "n"),
                         ("days_until_checkin", "n"), ("cancellation_charges", "n"), ("refund_amount", "n"),
                         ("policy_message", "s"), ("full_refund", "b")])


@query("booking_json", f"SELECT booking_id, {BOOKING_JSON} AS json FROM bookings")
def booking_json(v):
    return S.to_json_rows(v.bookings, key="booking_id")


@query("refund_quote_json", f"""
WITH quotes AS ({CANCELLATION_QUOTES}) SELECT booking_id, {REFUND_JSON} AS json FROM quotes""")
def refund_quote_json(v):
    """The reply to a refund request, as text."""
    return S.to_json_rows(cancellation_quotes(v.bookings, v.hotels, AS_OF), key="booking_id")


DETAIL_JSON = _json_sql(
    [("booking_id", "n"), ("hotel_id", "n"), ("room_type", "s"), ("check_in", "d"), ("check_out", "d"), ("guests", "n"),
     ("num_nights", "n"), *[(c, "n") for c in (
         "base_price", "peak_surcharge", "room_type_surcharge", "guest_surcharge", "subtotal", "advance_discount_percent",
         "advance_discount_amount", "total_price")],
     ("guest_name", "s"), ("guest_email", "s"), ("guest_phone", "s"), ("special_requests", "s"), ("status", "s"),
     ("booking_date", "t"), ("hotel_name", "s"), ("city", "s"), ("check_in_formatted", "s"), ("check_out_formatted", "s"),
     ("booking_date_formatted", "s"), ("username", "s"), ("user_email", "s")])
DETAIL_FIELDS = [c for c in DETAIL_JSON.split("'") if c.startswith('"') and c.endswith('":')]


@query("booking_detail_json", f"""
WITH d AS ({BOOKING_DETAIL}) SELECT booking_id, {DETAIL_JSON} AS json FROM d""")
def booking_detail_json(v):
    """The reply to a booking detail request, with its hotel and user, as text."""
    detail = booking_detail(v.bookings, v.hotels, v.users).select(*[c[1:-2] for c in DETAIL_FIELDS])
    return S.to_json_rows(detail, key="booking_id")


REFUND_REPLY_JSON = _json_sql([("success", "b"), ("booking_id", "n"), ("hotel_name", "s"), ("total_price", "n"),
                               ("days_until_checkin", "n"), ("cancellation_charges", "n"), ("refund_amount", "n"),
                               ("policy_message", "s"), ("full_refund", "b")])


@query("refund_reply_json", f"""
WITH quotes AS ({CANCELLATION_QUOTES}) SELECT booking_id, {REFUND_REPLY_JSON} AS json FROM (SELECT true AS success, * FROM quotes)""")
def refund_reply_json(v):
    q = cancellation_quotes(v.bookings, v.hotels, AS_OF)
    return S.to_json_rows(q.select(F.lit(True).alias("success"), *[c for c in q.columns if c != "user_id"]), key="booking_id")


@query("typed_scan_orders", """
SELECT o_orderkey, o_custkey, o_orderstatus, CAST(o_totalprice AS DOUBLE) AS o_totalprice, o_orderdate FROM orders""")
def typed_scan_orders(v):
    """A scan with a declared schema; columns it does not name are never read."""
    return load_declared(v.spark, v.sf_dir, "orders")


@query("booking_json_roundtrip", "SELECT * FROM bookings")
def booking_json_roundtrip(v):
    # export each row as JSON text, parse it back: the typed rows must survive unchanged
    b = v.bookings
    return S.from_json_rows(S.to_json_rows(b), b.schema)


@query("rooms_of_three_generations", """
SELECT room_id, hotel_id, room_number, room_type,
  CASE room_id % 3 WHEN 0 THEN CAST(CAST(price AS DECIMAL(7,1)) AS DECIMAL(10,2)) ELSE price END AS price,
  CAST(CASE room_id % 3 WHEN 2 THEN 1.5 ELSE 1.0 END AS DECIMAL(3,2)) AS price_multiplier, CAST(NULL AS VARCHAR) AS features,
  CASE WHEN room_id % 3 <> 0 THEN status END AS status,
  CAST(CASE room_id % 3 WHEN 0 THEN 1 ELSE capacity END AS INTEGER) AS capacity, 1 AS max_guests FROM rooms""")
def rooms_of_three_generations(v):
    """Rooms stored under three versions of their schema, read as one table."""
    root, r, of = f"{checkpoint_dir(v.spark)}/rooms-{uuid.uuid4().hex}", v.rooms, F.col("room_id") % 3
    first = r.where(of == 0).select(F.col("room_id").cast("int"), F.col("hotel_id").cast("int"),
                                    F.col("room_number").alias("number"), "room_type", F.col("price").cast("decimal(7,1)"))
    second = r.where(of == 1)
    third = r.where(of == 2).withColumn("price_multiplier", F.lit("1.5").cast("decimal(2,1)")).withColumn("floor", F.lit(3))
    for k, df in enumerate((first, second, third)):
        write_generation(df, root, k)
    out = load_generations(v.spark, root, "rooms", {"room_number": "number"})
    return out.select("room_id", "hotel_id", "room_number", "room_type", "price", "price_multiplier", "features", "status",
                      "capacity", "max_guests")


@query("inserted_read_back", "SELECT * FROM bookings WHERE booking_id IN (SELECT booking_id FROM booking_commands)")
def inserted_read_back(v):
    return S.inserted(v.bookings, v.booking_commands, "booking_id")
