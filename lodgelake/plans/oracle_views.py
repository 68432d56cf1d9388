"""The derived domain views in DuckDB SQL, prefixed as CTEs to each oracle query.

They mirror ``lodgelake.sources.views`` row for row.
"""

AS_OF_SQL = "TIMESTAMP '1998-06-15 10:30:00'"

VIEW_SQL = {
    "hotels": """
SELECT s_suppkey AS hotel_id,
  CASE s_suppkey % 14 WHEN 0 THEN 'London' WHEN 1 THEN 'Manchester' WHEN 2 THEN 'Edinburgh' WHEN 3 THEN 'Glasgow'
    WHEN 4 THEN 'Birmingham' WHEN 5 THEN 'Bristol' WHEN 6 THEN 'Cardiff' WHEN 7 THEN 'Aberdeen' WHEN 8 THEN 'Belfast'
    WHEN 9 THEN 'Newcastle' WHEN 10 THEN 'New Castle' WHEN 11 THEN 'Norwich' WHEN 12 THEN 'Oxford' ELSE 'Kent' END AS city,
  s_name AS title, concat('Stay at ', s_name) AS description,
  CAST(100 + s_suppkey % 11 * 10 AS DECIMAL(10,2)) AS price, 'default.jpg' AS image,
  'Hotel Address, City, Country' AS address FROM supplier""",
    "rooms": """
SELECT p_partkey AS room_id, p_partkey % ((SELECT count(*) FROM supplier) + 3) AS hotel_id,
  CAST(p_partkey AS VARCHAR) AS room_number,
  CASE p_size % 4 WHEN 0 THEN 'Single' WHEN 1 THEN 'Double' WHEN 2 THEN 'Family' ELSE 'Suite' END AS room_type,
  CAST(p_retailprice AS DECIMAL(10,2)) AS price,
  CASE WHEN p_partkey % 10 = 8 THEN 'booked' WHEN p_partkey % 10 = 9 THEN 'maintenance' ELSE 'available' END AS status,
  CASE p_size % 4 WHEN 2 THEN 4 WHEN 0 THEN 1 ELSE 2 END AS capacity FROM part""",
    "users": """
SELECT c_custkey AS id, c_name AS username, concat(lower(replace(c_name, '#', '.')), '@example.com') AS email,
  TIMESTAMP '1995-01-01 00:00:00' + (c_custkey * 37 % 2000) * INTERVAL '1' DAY AS created_at,
  CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE TIMESTAMP '1998-06-15 08:00:00' - (c_custkey % 3) * INTERVAL '1' DAY END AS last_login,
  CASE WHEN c_custkey % 97 = 0 THEN 'admin' ELSE 'user' END AS role,
  CASE WHEN c_custkey % 11 = 0 THEN 0 ELSE 1 END AS status FROM customer""",
    "bookings": """
SELECT o_orderkey AS booking_id, o_custkey AS user_id,
  CASE WHEN o_orderkey % 50 = 49 THEN -1 ELSE o_orderkey * 11 % ((SELECT count(*) FROM supplier) - 2) END AS hotel_id,
  CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % (SELECT count(*) FROM part) END AS room_id,
  CASE o_orderkey % 3 WHEN 0 THEN 'single' WHEN 1 THEN 'double' ELSE 'family' END AS room_type,
  CAST(o_orderdate AS DATE) + CAST(o_orderkey * 13 % 121 AS INT) AS check_in,
  CAST(o_orderdate AS DATE) + CAST(o_orderkey * 13 % 121 + 1 + o_orderkey % 9 AS INT) AS check_out,
  CAST(1 + o_orderkey % 4 AS INT) AS guests, CAST(1 + o_orderkey % 9 AS INT) AS num_nights,
  CAST(o_totalprice AS DECIMAL(10,2)) AS total_price,
  CASE o_orderstatus WHEN 'F' THEN 'confirmed' WHEN 'O' THEN 'pending' ELSE 'cancelled' END AS status,
  CAST(o_orderdate AS TIMESTAMP) + (o_orderkey * 7919 % 86400) * INTERVAL '1' SECOND AS booking_date FROM orders""",
    "bookings_wide": """
SELECT b.*, CAST(NULL AS VARCHAR) AS guest_name, CAST(NULL AS VARCHAR) AS guest_email,
  CAST(NULL AS VARCHAR) AS guest_phone, CAST(NULL AS VARCHAR) AS special_requests,
  CAST(NULL AS DECIMAL(10,2)) AS base_price, CAST(NULL AS DECIMAL(10,2)) AS peak_surcharge,
  CAST(NULL AS DECIMAL(10,2)) AS room_type_surcharge, CAST(NULL AS DECIMAL(10,2)) AS guest_surcharge,
  CAST(NULL AS DECIMAL(10,2)) AS subtotal, CAST(NULL AS DECIMAL(5,2)) AS advance_discount_percent,
  CAST(NULL AS DECIMAL(10,2)) AS advance_discount_amount, CAST(NULL AS TIMESTAMP) AS cancellation_date
FROM bookings b""",
    "booking_commands_raw": """
SELECT event_id AS seq, CAST(ts AS TIMESTAMP) AS ts, event_id % ((SELECT count(*) FROM supplier) * 20) AS booking_id,
  CASE event_type WHEN 'purchase' THEN 'admin_confirm' WHEN 'error' THEN 'admin_cancel' ELSE 'user_cancel' END AS command
  FROM events WHERE event_type IN ('purchase','error','click')""",
    "booking_commands": """
SELECT c.seq, c.ts, c.booking_id, c.command,
  CASE WHEN c.seq % 17 = 3 THEN NULL WHEN c.seq % 10 = 0 THEN b.user_id + 1 ELSE b.user_id END AS actor_id
  FROM booking_commands_raw c LEFT JOIN bookings b ON b.booking_id = c.booking_id""",
    "city_rates": """
SELECT * FROM (VALUES ('Aberdeen',140,70),('Belfast',130,70),('Birmingham',150,75),('Bristol',140,70),('Cardiff',130,70),
  ('Edinburgh',160,80),('Glasgow',150,75),('London',200,100),('Manchester',180,90),('Newcastle',120,70),('Oxford',180,90),
  ('Kent',140,80)) AS t(city, peak, offpeak)""",
    "currency_rates": """
SELECT * FROM (VALUES ('GBP', CAST(1.00 AS DECIMAL(6,4)), '£'), ('USD', CAST(1.27 AS DECIMAL(6,4)), '$'),
  ('EUR', CAST(1.17 AS DECIMAL(6,4)), '€')) AS t(currency, rate, symbol)""",
    "room_commands": """
SELECT event_id AS seq, CAST(ts AS TIMESTAMP) AS ts, event_id * 3 % (SELECT count(*) FROM part) AS room_id,
  CASE event_type WHEN 'view' THEN 'available' WHEN 'click' THEN 'maintenance' ELSE 'booked' END AS status
  FROM events WHERE event_type IN ('view','click','signup')""",
    "account_commands": """
SELECT event_id AS seq, CAST(ts AS TIMESTAMP) AS ts, user_id AS actor_id, event_id % ((SELECT count(*) FROM customer) + 7) AS user_id,
  CASE WHEN event_id % 11 = 5 THEN 'activate' WHEN event_id % 23 = 7 THEN 'set_role_root'
    WHEN event_id % 29 = 3 THEN 'promote' ELSE CASE event_type WHEN 'purchase' THEN 'toggle_status' WHEN 'error' THEN 'make_admin' WHEN 'view' THEN 'set_role_user'
    ELSE 'set_role_admin' END END AS command FROM events""",
    "new_hotels": """
SELECT 100000 + s_suppkey AS hotel_id, s_name AS title, CAST(100 + s_suppkey % 7 * 15 AS DECIMAL(10,2)) AS price FROM supplier""",
    "new_users": """
SELECT c_custkey AS request_id,
  CASE c_custkey % 7 WHEN 0 THEN '' WHEN 1 THEN ' ab ' WHEN 2 THEN repeat('x', 25) WHEN 3 THEN upper(c_name)
    WHEN 4 THEN concat('Team.', CAST(c_custkey // 21 AS VARCHAR))
    ELSE concat('new.', CAST(c_custkey AS VARCHAR)) END AS username,
  CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'no-at-sign.com'
    WHEN 2 THEN concat(' MiXed', CAST(c_custkey AS VARCHAR), '@Example.COM ')
    WHEN 3 THEN concat('n', CAST(c_custkey // 40 AS VARCHAR), '@example.com')
    ELSE concat('n', CAST(c_custkey AS VARCHAR), '@example.com') END AS email,
  CASE WHEN c_custkey % 9 = 0 THEN 'root' ELSE 'user' END AS role FROM customer""",
    "contact_messages": """
SELECT conv_id * 1000 + turn AS id, concat('Guest ', CAST(conv_id AS VARCHAR)) AS name,
  concat('guest', CAST(conv_id AS VARCHAR), '@example.com') AS email,
  'room booking' AS subject, text AS message, TIMESTAMP '2024-01-01 00:00:00' + conv_id * INTERVAL '1' MINUTE AS submitted_at
  FROM conversations WHERE role = 'user'""",
    "resent_messages": """
SELECT m.id * 1000 + l.s AS id, m.name, m.email, m.subject, m.message, m.submitted_at + l.s * INTERVAL '1' SECOND AS submitted_at
  FROM contact_messages m, (SELECT range AS s FROM range(0, 601)) l
  WHERE l.s = 0 OR (m.id % 9 = 0 AND l.s % 25 = 0) OR (m.id % 9 <> 0 AND m.id % 3 = 0 AND l.s <= 90 AND l.s % 30 = 0)""",
}


def with_views(body: str) -> str:
    """Prefix every view as a CTE; DuckDB only evaluates the ones the body uses.

    A body that starts with its own ``WITH`` has its CTEs appended after the views.
    """
    ctes = ",\n".join(f"{name} AS ({sql.strip()})" for name, sql in VIEW_SQL.items())
    body = body.strip().replace("AS_OF", AS_OF_SQL)
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
