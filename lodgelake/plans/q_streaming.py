"""Batch forms of the streaming operators (the same functions on static frames)."""

from lodgelake.plans.registry import query
from lodgelake.streaming import feeds


@query("live_booking_counts", """
SELECT date_trunc('day', booking_date) AS day_start, date_trunc('day', booking_date) + INTERVAL 1 DAY AS day_end,
  status, count(*) AS bookings, CAST(sum(total_price) AS DECIMAL(18,2)) AS revenue
FROM bookings GROUP BY 1, 2, 3""")
def live_booking_counts(v):
    return feeds.live_booking_counts(v.bookings)


# message by message: from a kept one the next kept is the first a minute or more later
@query("dedupe_resubmits", """
WITH RECURSIVE m AS (
  SELECT name, email, subject, message, submitted_at AS t, min(id) AS id FROM resent_messages GROUP BY ALL
), kept AS (
  SELECT name, email, subject, message, min(t) AS t FROM m GROUP BY ALL
  UNION ALL
  SELECT k.name, k.email, k.subject, k.message, min(m.t) AS t FROM kept k JOIN m ON m.name = k.name AND m.email = k.email
    AND m.subject = k.subject AND m.message = k.message AND m.t >= k.t + INTERVAL 1 MINUTE
  GROUP BY k.name, k.email, k.subject, k.message
)
SELECT m.id, m.name, m.email, m.subject, m.message FROM kept k JOIN m ON m.name = k.name AND m.email = k.email
  AND m.subject = k.subject AND m.message = k.message AND m.t = k.t""")
def dedupe_resubmits(v):
    return feeds.dedupe_resubmits_batch(v.resent_messages)
