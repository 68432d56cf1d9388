"""State-change queries (R6-R8, B9-B11, U7-U9).  Oracles for the folds are sequential
replays (recursive SQL), an independent statement of the same semantics."""

import uuid

from pyspark.sql import functions as F

from lodgelake.operators import changes as X
from lodgelake.operators import upkeep
from lodgelake.plans.registry import query
from lodgelake.session import checkpoint_dir, stored
from lodgelake.sources.months import MonthTable
from lodgelake.streaming.state import CommandState

ROOM_COLS = "r.room_id, r.hotel_id, r.room_number, r.room_type, r.price"


@query("apply_room_commands", f"""
WITH last AS (SELECT room_id, status FROM (
  SELECT room_id, status, row_number() OVER (PARTITION BY room_id ORDER BY ts DESC, seq DESC) AS rn
  FROM room_commands WHERE status IN ('available', 'booked', 'maintenance')) WHERE rn = 1)
SELECT {ROOM_COLS}, coalesce(l.status, r.status) AS status, r.capacity
FROM rooms r LEFT JOIN last l ON r.room_id = l.room_id""")
def apply_room_commands(v):
    return X.apply_room_commands(v.rooms, v.room_commands)


ROOM_EDITS = """
SELECT room_id, hotel_id, room_number, lower(room_type) AS room_type, CAST(price * 1.10 AS DECIMAL(10,2)) AS price,
  CASE WHEN status = 'maintenance' THEN 'closed' ELSE 'booked' END AS status, capacity FROM rooms
WHERE room_type = 'Suite'"""


def _room_edits(v):
    r = v.rooms.filter(F.col("room_type") == "Suite")
    return r.select("room_id", "hotel_id", "room_number", F.lower("room_type").alias("room_type"),
                    (F.col("price") * F.lit("1.10").cast("decimal(3,2)")).cast("decimal(10,2)").alias("price"),
                    F.when(F.col("status") == "maintenance", "closed").otherwise("booked").alias("status"),
                    "capacity")


@query("upsert_rooms", f"""
WITH e AS ({ROOM_EDITS})
SELECT r.room_id,
  CASE WHEN e.room_id IS NULL THEN r.hotel_id ELSE e.hotel_id END AS hotel_id,
  CASE WHEN e.room_id IS NULL THEN r.room_number ELSE e.room_number END AS room_number,
  CASE WHEN e.room_id IS NULL THEN r.room_type ELSE e.room_type END AS room_type,
  CASE WHEN e.room_id IS NULL THEN r.price ELSE e.price END AS price,
  CASE WHEN e.room_id IS NULL THEN r.status WHEN e.status IN ('available', 'booked', 'maintenance') THEN e.status
    ELSE 'available' END AS status,
  CASE WHEN e.room_id IS NULL THEN r.capacity ELSE e.capacity END AS capacity,
  e.capacity AS max_guests, CASE WHEN e.room_id IS NULL THEN NULL ELSE CAST(1.0 AS DECIMAL(3,2)) END
    AS price_multiplier,
  CASE WHEN e.room_id IS NULL THEN NULL ELSE '' END AS features
FROM rooms r LEFT JOIN e ON r.room_id = e.room_id""")
def upsert_rooms(v):
    return X.upsert_rooms(v.rooms, _room_edits(v))


ROOM_DELETE = """
WITH req AS (SELECT DISTINCT room_id FROM rooms WHERE status = 'maintenance'),
refs AS (SELECT room_id, count(*) AS n FROM bookings WHERE room_id IS NOT NULL GROUP BY room_id)
SELECT req.room_id, coalesce(refs.n, 0) AS bookings,
  CASE WHEN r.room_id IS NULL THEN 'not_found' WHEN coalesce(refs.n, 0) > 0 THEN 'refused' ELSE 'deleted' END AS outcome,
  CASE WHEN coalesce(refs.n, 0) > 0 THEN concat('Cannot delete room with ', CAST(refs.n AS VARCHAR),
    ' bookings! Please cancel bookings first.') END AS message
FROM req LEFT JOIN rooms r ON req.room_id = r.room_id LEFT JOIN refs ON req.room_id = refs.room_id"""


def _maintenance_rooms(v):
    return v.rooms.filter(F.col("status") == "maintenance").select("room_id")


@query("room_delete_outcomes", ROOM_DELETE)
def room_delete_outcomes(v):
    return X.room_delete_outcomes(v.rooms, v.bookings, _maintenance_rooms(v))


@query("delete_rooms", f"""
WITH o AS ({ROOM_DELETE})
SELECT * FROM rooms WHERE room_id NOT IN (SELECT room_id FROM o WHERE outcome = 'deleted')""")
def delete_rooms(v):
    return X.delete_rooms(v.rooms, v.bookings, _maintenance_rooms(v))


REPLAY = """
WITH RECURSIVE cmd AS (
  SELECT c.*, b.user_id AS owner, row_number() OVER (PARTITION BY c.booking_id ORDER BY c.ts, c.seq) AS k
  FROM booking_commands c JOIN bookings b ON b.booking_id = c.booking_id),
st(booking_id, k, status, cdate, prev_status) AS (
  SELECT booking_id, CAST(0 AS BIGINT), status, CAST(NULL AS TIMESTAMP), CAST(NULL AS VARCHAR) FROM bookings
  UNION ALL
  SELECT st.booking_id, st.k + 1,
    CASE WHEN c.command = 'admin_confirm' THEN 'confirmed' WHEN c.command = 'admin_cancel' THEN 'cancelled'
      WHEN c.actor_id = c.owner AND st.status = 'confirmed' THEN 'cancelled' ELSE st.status END,
    CASE WHEN c.command = 'user_cancel' AND c.actor_id = c.owner AND st.status = 'confirmed' THEN c.ts
      ELSE st.cdate END,
    st.status
  FROM st JOIN cmd c ON c.booking_id = st.booking_id AND c.k = st.k + 1)"""


@query("apply_booking_commands", REPLAY + """
, fin AS (SELECT * FROM (SELECT st.*, row_number() OVER (PARTITION BY booking_id ORDER BY k DESC) AS rn FROM st)
  WHERE rn = 1)
SELECT b.booking_id, b.user_id, b.hotel_id, b.room_id, b.room_type, b.check_in, b.check_out, b.guests,
  b.num_nights, b.total_price, fin.status, fin.cdate AS cancellation_date, b.booking_date
FROM bookings b JOIN fin ON b.booking_id = fin.booking_id""")
def apply_booking_commands(v):
    return X.apply_booking_commands(v.bookings, v.booking_commands)


BOOKINGS_AFTER = REPLAY + """
, fin AS (SELECT * FROM (SELECT st.*, row_number() OVER (PARTITION BY booking_id ORDER BY k DESC) AS rn FROM st)
  WHERE rn = 1),
after AS (SELECT b.booking_id, b.user_id, b.hotel_id, b.room_id, b.room_type, b.check_in, b.check_out, b.guests,
  b.num_nights, b.total_price, fin.status, fin.cdate AS cancellation_date, b.booking_date
FROM bookings b JOIN fin ON b.booking_id = fin.booking_id)"""


def _with_cancellation(v):
    return v.bookings.withColumn("cancellation_date", F.lit(None).cast("timestamp_ntz"))


@query("booking_state_by_batches", BOOKINGS_AFTER + " SELECT * FROM after")
def booking_state_by_batches(v):
    """The command log in three batches of its time, each folded onto a state of changed rows (ST2), read back."""
    bookings, cmds = _with_cancellation(v), stored(v.booking_commands)  # read by every batch
    state = CommandState(v.spark, f"{checkpoint_dir(v.spark)}/state-{uuid.uuid4().hex}", bookings.schema, "booking_id")
    state.start(bookings)
    lo, hi = cmds.select(F.min("ts"), F.max("ts")).first()
    cuts = [lo + (hi - lo) * k / 3 for k in (1, 2)] if lo else []
    t = F.col("ts")
    for k, (a, b) in enumerate(zip([None, *cuts], [*cuts, None], strict=True)):
        part = cmds.where((t > F.lit(a) if a else F.lit(True)) & (t <= F.lit(b) if b else F.lit(True)))
        state.apply(k, part, X.apply_booking_commands, compact_every=2)
    return state.read().select(*bookings.columns)


def _sums_after_commands(v):
    """Sums per day and status of the bookings before, and what the commands did to them."""
    bookings, cmds = _with_cancellation(v), v.booking_commands
    touched = bookings.join(cmds.select("booking_id").distinct(), "booking_id", "left_semi")
    return upkeep.added(upkeep.day_status_sums(bookings),
                        upkeep.day_status_deltas(touched, X.apply_booking_commands(touched, cmds)))


@query("day_status_kept_up", BOOKINGS_AFTER + """
SELECT date_trunc('day', booking_date) AS day_start, status, count(*) AS bookings,
  CAST(sum(total_price) AS DECIMAL(18,2)) AS revenue FROM after GROUP BY 1, 2""")
def day_status_kept_up(v):
    return _sums_after_commands(v)


@query("month_status_kept_up", BOOKINGS_AFTER + """
SELECT strftime(booking_date, '%Y-%m') AS month, status, CAST(count(*) AS BIGINT) AS bookings,
  CAST(sum(total_price) AS DECIMAL(18,2)) AS revenue FROM after GROUP BY 1, 2""")
def month_status_kept_up(v):
    return upkeep.month_status(_sums_after_commands(v))


@query("status_stats_kept_up", BOOKINGS_AFTER + """
SELECT status, CAST(count(*) AS BIGINT) AS bookings FROM after GROUP BY 1""")
def status_stats_kept_up(v):
    return upkeep.status_stats(_sums_after_commands(v))


@query("booking_command_outcomes", REPLAY + """
SELECT c.seq, c.ts, c.booking_id, c.actor_id, c.command,
  c.command <> 'user_cancel' OR coalesce(c.actor_id = c.owner AND st.prev_status = 'confirmed', FALSE) AS applied,
  CASE WHEN c.command <> 'user_cancel' THEN NULL
    WHEN c.actor_id IS DISTINCT FROM c.owner THEN 'Booking not found or you do not have permission to cancel it'
    WHEN st.prev_status <> 'confirmed' THEN concat('Cannot cancel booking with status: ', st.prev_status) END AS reason,
  st.status AS status_after
FROM cmd c JOIN st ON st.booking_id = c.booking_id AND st.k = c.k
UNION ALL
SELECT c.seq, c.ts, c.booking_id, c.actor_id, c.command, FALSE, CASE WHEN c.command = 'user_cancel'
  THEN 'Booking not found or you do not have permission to cancel it' ELSE 'booking not found' END, NULL
FROM booking_commands c WHERE c.booking_id NOT IN (SELECT booking_id FROM bookings)""")
def booking_command_outcomes(v):
    return X.booking_command_outcomes(v.bookings, v.booking_commands)


def _kent_hotels(v):
    return v.hotels.filter(F.col("city") == "Kent").select("hotel_id")


@query("delete_hotels", "SELECT * FROM hotels WHERE hotel_id NOT IN (SELECT hotel_id FROM hotels WHERE city = 'Kent')")
def delete_hotels(v):
    return X.delete_hotels(v.hotels, _kent_hotels(v))


@query("cascade_hotel_bookings", """
SELECT * FROM bookings WHERE hotel_id NOT IN (SELECT hotel_id FROM hotels WHERE city = 'Kent')""")
def cascade_hotel_bookings(v):
    return X.cascade_hotel_bookings(v.bookings, _kent_hotels(v))


@query("bookings_rewritten_by_month", """
SELECT booking_id, user_id, hotel_id, room_type, check_in, check_out,
  CASE WHEN strftime(booking_date, '%Y-%m') = '1997-05' THEN CAST(guests + 1 AS INTEGER) ELSE guests END AS guests,
  num_nights, total_price, status, booking_date FROM bookings
WHERE hotel_id NOT IN (SELECT hotel_id FROM hotels WHERE city = 'Kent') OR strftime(booking_date, '%Y-%m') = '1997-05'""")
def bookings_rewritten_by_month(v):
    """B10 and an edit of one month on stored bookings: the hotels' bookings are dropped, then a month's rows come
    back changed; read from the files of three versions."""
    table = MonthTable(v.spark, f"{checkpoint_dir(v.spark)}/months-{uuid.uuid4().hex}")
    table.write(v.bookings)
    table.delete_hotels(_kent_hotels(v))
    edits = v.bookings.where(F.date_trunc("month", "booking_date") == F.lit("1997-05-01")).withColumn("guests", F.col("guests") + 1)
    table.replace(edits)
    return table.read().select("booking_id", "user_id", "hotel_id", "room_type", "check_in", "check_out", "guests",
                               "num_nights", "total_price", "status", "booking_date")


HOTEL_EDITS = """
SELECT n.hotel_id, n.title, h.city, n.price, CAST(NULL AS VARCHAR) AS address, CAST(NULL AS VARCHAR) AS description
FROM new_hotels n JOIN hotels h ON h.hotel_id = n.hotel_id - 100000
UNION ALL
SELECT hotel_id, concat(title, ' (renovated)'), city, CAST(price + 5 AS DECIMAL(10,2)), address, description
FROM hotels WHERE city = 'Kent'"""


def _hotel_edits(v):
    n, h = v.new_hotels, v.hotels
    ins = n.join(h.select(F.col("hotel_id").alias("_base"), "city"), n["hotel_id"] - 100000 == F.col("_base")) \
        .select("hotel_id", "title", "city", "price", F.lit(None).cast("string").alias("address"),
                F.lit(None).cast("string").alias("description"))
    upd = h.filter(F.col("city") == "Kent").select(
        "hotel_id", F.concat("title", F.lit(" (renovated)")).alias("title"), "city",
        (F.col("price") + 5).cast("decimal(10,2)").alias("price"), "address", "description")
    return ins.unionByName(upd)


@query("upsert_hotels", f"""
WITH e AS ({HOTEL_EDITS})
SELECT coalesce(h.hotel_id, e.hotel_id) AS hotel_id,
  CASE WHEN e.hotel_id IS NULL THEN h.city ELSE e.city END AS city,
  CASE WHEN e.hotel_id IS NULL THEN h.title ELSE e.title END AS title,
  CASE WHEN e.hotel_id IS NULL THEN h.description ELSE coalesce(e.description, '') END AS description,
  CASE WHEN h.hotel_id IS NULL THEN CAST(coalesce(e.price, 100.00) AS DECIMAL(10,2))
    WHEN e.hotel_id IS NULL THEN h.price ELSE coalesce(e.price, h.price) END AS price,
  coalesce(h.image, 'default.jpg') AS image,
  CASE WHEN h.hotel_id IS NULL THEN coalesce(e.address, 'Hotel Address, City, Country')
    WHEN e.hotel_id IS NULL THEN h.address ELSE coalesce(e.address, '') END AS address
FROM hotels h FULL OUTER JOIN e ON h.hotel_id = e.hotel_id""")
def upsert_hotels(v):
    return X.upsert_hotels(v.hotels, _hotel_edits(v))


USER_COLS = "u.id, u.username, u.email, u.created_at, u.last_login"


@query("apply_account_commands", f"""
WITH RECURSIVE cmd AS (
  SELECT c.*, row_number() OVER (PARTITION BY c.user_id ORDER BY c.ts, c.seq) AS k FROM account_commands c),
st(id, k, status, role) AS (
  SELECT id, CAST(0 AS BIGINT), status, role FROM users
  UNION ALL
  SELECT st.id, st.k + 1,
    CASE WHEN c.command = 'activate' THEN 1
      WHEN c.command = 'toggle_status' AND c.actor_id <> c.user_id THEN CASE WHEN st.status = 1 THEN 0 ELSE 1 END
      ELSE st.status END,
    CASE WHEN c.command = 'make_admin' THEN 'admin'
      WHEN c.command = 'set_role_admin' AND c.actor_id <> c.user_id THEN 'admin'
      WHEN c.command = 'set_role_user' AND c.actor_id <> c.user_id THEN 'user' ELSE st.role END
  FROM st JOIN cmd c ON c.user_id = st.id AND c.k = st.k + 1),
fin AS (SELECT * FROM (SELECT st.*, row_number() OVER (PARTITION BY id ORDER BY k DESC) AS rn FROM st) WHERE rn = 1)
SELECT {USER_COLS}, fin.role, fin.status FROM users u JOIN fin ON u.id = fin.id""")
def apply_account_commands(v):
    return X.apply_account_commands(v.users, v.account_commands)


@query("account_command_outcomes", """
SELECT *, reason IS NULL AS applied FROM (SELECT c.*,
  CASE WHEN c.command IN ('set_role_user', 'set_role_admin', 'set_role_root') AND c.actor_id = c.user_id
      THEN 'Cannot modify your own role'
    WHEN c.command = 'set_role_root' THEN 'Invalid role'
    WHEN c.command = 'toggle_status' AND c.actor_id = c.user_id THEN 'Cannot modify your own account status'
    WHEN c.command = 'toggle_status' AND u.id IS NULL THEN 'User not found'
    WHEN c.command = 'promote' THEN 'unknown command' END AS reason
FROM account_commands c LEFT JOIN users u ON c.user_id = u.id)""")
def account_command_outcomes(v):
    return X.account_command_outcomes(v.account_commands, v.users)


USER_DELETE = """
WITH req AS (SELECT DISTINCT id FROM users WHERE role = 'admin'),
n AS (SELECT user_id, count(*) AS c FROM bookings GROUP BY user_id)
SELECT req.id, coalesce(n.c, 0) AS bookings,
  CASE WHEN u.id IS NULL THEN 'not_found' WHEN coalesce(n.c, 0) > 0 THEN 'refused' ELSE 'deleted' END AS outcome,
  CASE WHEN coalesce(n.c, 0) > 0 THEN concat('Cannot delete user with ', CAST(n.c AS VARCHAR), ' bookings!') END
    AS message
FROM req LEFT JOIN users u ON req.id = u.id LEFT JOIN n ON req.id = n.user_id"""


def _admins(v):
    return v.users.filter(F.col("role") == "admin").select("id")


@query("user_delete_outcomes", USER_DELETE)
def user_delete_outcomes(v):
    return X.user_delete_outcomes(v.users, v.bookings, _admins(v))


@query("delete_users", f"""
WITH o AS ({USER_DELETE}) SELECT * FROM users WHERE id NOT IN (SELECT id FROM o WHERE outcome = 'deleted')""")
def delete_users(v):
    return X.delete_users(v.users, v.bookings, _admins(v))


PROFILE_EDITS = "SELECT request_id AS id, username, email FROM new_users"
# one edit after the other: the state before edit k is what the accepted edits before it asked for
PROFILE_OUTCOMES = f"""
WITH RECURSIVE e AS (SELECT *, lower(username) AS lu, lower(email) AS le, row_number() OVER (ORDER BY id) AS k
  FROM ({PROFILE_EDITS})),
h AS (SELECT e.*, EXISTS (SELECT 1 FROM users u WHERE u.id <> e.id AND lower(u.username) = e.lu)
    OR EXISTS (SELECT 1 FROM users u WHERE u.id <> e.id AND lower(u.email) = e.le) AS held FROM e),
st(k, names, mails) AS (
  SELECT CAST(1 AS BIGINT), CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[])
  UNION ALL
  SELECT st.k + 1,
    CASE WHEN h.held OR list_contains(names, h.lu) OR list_contains(mails, h.le) THEN names
      ELSE list_append(names, h.lu) END,
    CASE WHEN h.held OR list_contains(names, h.lu) OR list_contains(mails, h.le) THEN mails
      ELSE list_append(mails, h.le) END
  FROM st JOIN h ON h.k = st.k),
o AS (SELECT h.id, h.username, h.email,
  CASE WHEN h.held THEN 'username or email already in use'
    WHEN list_contains(st.names, h.lu) OR list_contains(st.mails, h.le)
      THEN 'username or email taken earlier in the batch' END AS reason
  FROM h JOIN st ON st.k = h.k)"""


def _profile_edits(v):
    return v.new_users.select(F.col("request_id").alias("id"), "username", "email")


@query("profile_update_outcomes", PROFILE_OUTCOMES + """
SELECT id, username, email, reason IS NULL AS accepted, reason FROM o""")
def profile_update_outcomes(v):
    return X.profile_update_outcomes(v.users, _profile_edits(v))


@query("update_profiles", PROFILE_OUTCOMES + """
SELECT u.id, coalesce(o.username, u.username) AS username, coalesce(o.email, u.email) AS email, u.created_at,
  u.last_login, u.role, u.status
FROM users u LEFT JOIN (SELECT * FROM o WHERE reason IS NULL) o ON u.id = o.id""")
def update_profiles(v):
    return X.update_profiles(v.users, _profile_edits(v))
