"""Report queries."""

from lodgelake.operators import reports as R
from lodgelake.plans.registry import AS_OF, query

CONFIRMED_PER_HOTEL = """
SELECT hotel_id, count(booking_id) AS n, sum(total_price) AS rev FROM bookings WHERE status = 'confirmed' GROUP BY hotel_id"""

MONTHLY_6M = """
SELECT strftime(booking_date, '%Y-%m') AS month, count(*) AS bookings,
  CAST(coalesce(sum(total_price), 0) AS DECIMAL(18,2)) AS revenue,
  CAST(sum(total_price) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS avg_booking_value
FROM bookings WHERE booking_date >= AS_OF - INTERVAL 6 MONTH AND booking_date <= AS_OF
GROUP BY 1"""


@query("platform_kpis", """
SELECT (SELECT count(*) FROM users) AS total_users,
  count(*) FILTER (WHERE status = 'confirmed') AS total_bookings,
  (SELECT count(*) FROM hotels) AS total_hotels,
  CAST(coalesce(sum(total_price) FILTER (WHERE status = 'confirmed'), 0) AS DECIMAL(18,2)) AS total_revenue
FROM bookings""")
def platform_kpis(v):
    return R.platform_kpis(v.users, v.bookings, v.hotels)


@query("monthly_sales", MONTHLY_6M + " ORDER BY month DESC")
def monthly_sales(v):
    return R.monthly_sales(v.bookings, "last_6_months", AS_OF)


@query("monthly_sales_this_month", """
SELECT strftime(booking_date, '%Y-%m') AS month, count(*) AS bookings,
  CAST(coalesce(sum(total_price), 0) AS DECIMAL(18,2)) AS revenue,
  CAST(sum(total_price) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS avg_booking_value
FROM bookings WHERE booking_date >= CAST(date_trunc('month', AS_OF) AS TIMESTAMP) AND booking_date <= AS_OF
GROUP BY 1""")
def monthly_sales_this_month(v):
    return R.monthly_sales(v.bookings, "this_month", AS_OF)


@query("monthly_sales_custom", """
SELECT strftime(booking_date, '%Y-%m') AS month, count(*) AS bookings,
  CAST(coalesce(sum(total_price), 0) AS DECIMAL(18,2)) AS revenue,
  CAST(sum(total_price) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS avg_booking_value
FROM bookings WHERE booking_date BETWEEN TIMESTAMP '1997-01-01 00:00:00' AND TIMESTAMP '1997-12-31 00:00:00'
GROUP BY 1""")
def monthly_sales_custom(v):
    return R.monthly_sales(v.bookings, "custom", AS_OF, "1997-01-01", "1997-12-31")


@query("monthly_sales_last_year", """
SELECT strftime(booking_date, '%Y-%m') AS month, count(*) AS bookings,
  CAST(coalesce(sum(total_price), 0) AS DECIMAL(18,2)) AS revenue,
  CAST(sum(total_price) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS avg_booking_value
FROM bookings WHERE booking_date >= CAST(date_trunc('year', AS_OF) - INTERVAL 1 YEAR AS TIMESTAMP)
  AND booking_date < CAST(date_trunc('year', AS_OF) AS TIMESTAMP)
GROUP BY 1""")
def monthly_sales_last_year(v):
    return R.monthly_sales(v.bookings, "last_year", AS_OF)


@query("monthly_sales_last_month", """
SELECT strftime(booking_date, '%Y-%m') AS month, count(*) AS bookings,
  CAST(coalesce(sum(total_price), 0) AS DECIMAL(18,2)) AS revenue,
  CAST(sum(total_price) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS avg_booking_value
FROM bookings WHERE booking_date >= CAST(date_trunc('month', AS_OF) - INTERVAL 1 MONTH AS TIMESTAMP)
  AND booking_date < CAST(date_trunc('month', AS_OF) AS TIMESTAMP)
GROUP BY 1""")
def monthly_sales_last_month(v):
    return R.monthly_sales(v.bookings, "last_month", AS_OF)


@query("monthly_sales_this_year", """
SELECT strftime(booking_date, '%Y-%m') AS month, count(*) AS bookings,
  CAST(coalesce(sum(total_price), 0) AS DECIMAL(18,2)) AS revenue,
  CAST(sum(total_price) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS avg_booking_value
FROM bookings WHERE booking_date >= CAST(date_trunc('year', AS_OF) AS TIMESTAMP) AND booking_date <= AS_OF
GROUP BY 1""")
def monthly_sales_this_year(v):
    return R.monthly_sales(v.bookings, "this_year", AS_OF)


@query("hotel_performance", f"""
WITH ph AS ({CONFIRMED_PER_HOTEL}),
tot AS (SELECT count(*) AS t FROM bookings WHERE status = 'confirmed')
SELECT h.hotel_id, h.title AS name, h.city, coalesce(ph.n, 0) AS bookings,
  CAST(coalesce(ph.rev, 0) AS DECIMAL(18,2)) AS revenue,
  CASE WHEN tot.t > 0 THEN CAST((coalesce(ph.n, 0) * 20000 + tot.t) // (2 * tot.t) AS DOUBLE) / 100.0 END AS occupancy,
  CASE WHEN coalesce(ph.rev, 0) > 10000 THEN 1 ELSE -1 END AS profit
FROM hotels h LEFT JOIN ph ON h.hotel_id = ph.hotel_id, tot
ORDER BY revenue DESC, h.hotel_id LIMIT 10""")
def hotel_performance(v):
    return R.hotel_performance(v.hotels, v.bookings)


TOP_CUSTOMERS = """
SELECT u.id, u.username AS name, u.email, coalesce(p.n, 0) AS total_bookings,
  CAST(coalesce(p.spent, 0) AS DECIMAL(18,2)) AS total_spent, strftime(u.created_at, '%Y-%m-%d') AS member_since
FROM users u LEFT JOIN (SELECT user_id, count(booking_id) AS n, sum(total_price) AS spent
  FROM bookings WHERE status = 'confirmed' GROUP BY user_id) p ON u.id = p.user_id
ORDER BY total_spent DESC, u.id LIMIT 10"""


@query("top_customers", TOP_CUSTOMERS)
def top_customers(v):
    return R.top_customers(v.users, v.bookings)


TRENDS = """
SELECT strftime(booking_date, '%Y-%m') AS month_key, strftime(booking_date, '%b') AS month, count(*) AS bookings
FROM bookings WHERE booking_date >= AS_OF - INTERVAL 6 MONTH AND booking_date <= AS_OF GROUP BY 1, 2"""


@query("booking_trends", TRENDS + " ORDER BY 1")
def booking_trends(v):
    return R.booking_trends(v.bookings, AS_OF)


@query("report_totals", f"""
WITH m AS ({MONTHLY_6M})
SELECT CAST(coalesce(sum(revenue), 0) AS DECIMAL(18,2)) AS total_revenue,
  CAST(coalesce(sum(bookings), 0) AS BIGINT) AS total_bookings,
  CASE WHEN sum(bookings) > 0 THEN CAST(sum(revenue) AS DOUBLE) / CAST(sum(bookings) AS DOUBLE) ELSE 0.0 END
    AS avg_booking_value
FROM m""")
def report_totals(v):
    return R.report_totals(R.monthly_sales(v.bookings, "last_6_months", AS_OF))


@query("trend_scale", f"""
WITH t AS ({TRENDS}), m AS (SELECT max(bookings) AS mx FROM t)
SELECT t.*, CASE WHEN m.mx > 0 THEN CAST(t.bookings AS DOUBLE) / CAST(m.mx AS DOUBLE) ELSE 0.0 END AS scale FROM t, m""")
def trend_scale(v):
    return R.trend_scale(R.booking_trends(v.bookings, AS_OF))


@query("customer_ranking", f"""
WITH top AS ({TOP_CUSTOMERS})
SELECT top.*, row_number() OVER (ORDER BY total_spent DESC, id) AS rank,
  CASE row_number() OVER (ORDER BY total_spent DESC, id) WHEN 1 THEN 'gold' WHEN 2 THEN 'silver' WHEN 3 THEN 'bronze'
    ELSE concat('#', CAST(row_number() OVER (ORDER BY total_spent DESC, id) AS VARCHAR)) END AS medal
FROM top""")
def customer_ranking(v):
    return R.customer_ranking(R.top_customers(v.users, v.bookings))


@query("monthly_growth", f"""
WITH m AS ({MONTHLY_6M}), g AS (
  SELECT month, revenue, lag(revenue) OVER (ORDER BY month) AS prev_revenue FROM m)
SELECT month, revenue, prev_revenue,
  CASE WHEN prev_revenue > 0 THEN CAST(revenue - prev_revenue AS DOUBLE) * 100.0 / CAST(prev_revenue AS DOUBLE) END
    AS growth_pct,
  CASE WHEN prev_revenue > 0 AND revenue > prev_revenue THEN 'up' WHEN prev_revenue > 0 AND revenue < prev_revenue
    THEN 'down' WHEN prev_revenue > 0 THEN 'flat' END AS direction
FROM g""")
def monthly_growth(v):
    return R.monthly_growth(R.monthly_sales(v.bookings, "last_6_months", AS_OF))


@query("booking_status_stats", """
SELECT count(*) FILTER (WHERE status = 'confirmed') AS confirmed,
  count(*) FILTER (WHERE status = 'pending') AS pending,
  count(*) FILTER (WHERE status = 'cancelled') AS cancelled,
  CAST(coalesce(sum(total_price) FILTER (WHERE status = 'confirmed'), 0) AS DECIMAL(18,2)) AS revenue
FROM bookings""")
def booking_status_stats(v):
    return R.booking_status_stats(v.bookings)


@query("user_booking_counts", """
SELECT u.*, (SELECT count(*) FROM bookings b WHERE b.user_id = u.id) AS total_bookings
FROM users u ORDER BY u.created_at DESC NULLS LAST, u.id""")
def user_booking_counts(v):
    return R.user_booking_counts(v.users, v.bookings)


@query("user_kpis", """
SELECT count(*) AS total_users, count(*) FILTER (WHERE role = 'admin') AS admin_count,
  count(*) FILTER (WHERE CAST(last_login AS DATE) = CAST(AS_OF AS DATE)) AS active_today,
  (SELECT count(*) FROM bookings) AS total_bookings
FROM users""")
def user_kpis(v):
    return R.user_kpis(v.users, v.bookings, AS_OF)


@query("user_dashboard_stats", """
SELECT u.id AS user_id, coalesce(s.total_bookings, 0) AS total_bookings,
  coalesce(s.upcoming_bookings, 0) AS upcoming_bookings, coalesce(s.past_bookings, 0) AS past_bookings,
  CAST(coalesce(s.total_spent, 0) AS DECIMAL(18,2)) AS total_spent
FROM users u LEFT JOIN (
  SELECT user_id, count(*) AS total_bookings,
    count(*) FILTER (WHERE check_in > CAST(AS_OF AS DATE) AND status = 'confirmed') AS upcoming_bookings,
    count(*) FILTER (WHERE check_out < CAST(AS_OF AS DATE)) AS past_bookings,
    coalesce(sum(total_price) FILTER (WHERE status = 'confirmed'), 0) AS total_spent
  FROM bookings GROUP BY user_id) s ON u.id = s.user_id""")
def user_dashboard_stats(v):
    return R.user_dashboard_stats(v.users, v.bookings, AS_OF)


@query("monthly_sales_compat_last_year", MONTHLY_6M + " ORDER BY month DESC")
def monthly_sales_compat_last_year(v):
    # the source served every menu period other than this month / custom as the last six months
    return R.monthly_sales(v.bookings, "last_year", AS_OF, compat=True)
