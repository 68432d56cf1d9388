"""Hot keys: one booking / hotel holding a third of all rows must still give exact results."""

from pyspark.sql import functions as F

from lodgelake.operators import changes as X
from lodgelake.operators import reports as R
from test_properties import replay_bookings


def test_hot_booking_fold_equals_replay(spark, views):
    b = views.bookings
    owner0 = b.filter(F.col("booking_id") == 0).first().user_id
    cmds = views.booking_commands
    # every third command is re-targeted at booking 0; half of those come from its owner
    hot = F.col("seq") % 3 == 0
    cmds = cmds.withColumn("booking_id", F.when(hot, F.lit(0).cast("long")).otherwise(F.col("booking_id"))) \
        .withColumn("actor_id", F.when(hot & (F.col("seq") % 2 == 0), F.lit(owner0)).otherwise(F.col("actor_id")))
    assert cmds.filter(hot).count() * 10 >= cmds.count() * 3  # about a third of all commands
    got = {r.booking_id: (r.status, r.cancellation_date)
           for r in X.apply_booking_commands(b, cmds).collect()}
    bl = [(r.booking_id, r.user_id, r.status) for r in b.collect()]
    cl = [(r.seq, r.ts, r.booking_id, r.actor_id, r.command) for r in cmds.collect()]
    assert got == replay_bookings(bl, cl)
    # the hot booking's commands are spread over many slices, so no window holds them all
    slices = cmds.filter(F.col("booking_id") == 0).select(F.date_trunc("hour", "ts")).distinct().count()
    assert slices > 50


def test_hot_hotel_reports(spark, views):
    b = views.bookings.withColumn(
        "hotel_id", F.when(F.col("booking_id") % 3 == 0, F.lit(1).cast("long")).otherwise(F.col("hotel_id")))
    perf = {r.hotel_id: (r.bookings, r.revenue) for r in R.hotel_performance(views.hotels, b, n=None).collect()}
    conf = b.filter(F.col("status") == "confirmed")
    want = {r.hotel_id: (r.n, r.rev) for r in conf.groupBy("hotel_id").agg(
        F.count("*").alias("n"), F.sum("total_price").cast("decimal(18,2)").alias("rev")).collect()}
    assert perf[1] == want[1] and perf[1][0] * 4 > conf.count()
    total = sum(v[0] for k, v in want.items())
    occ = R.hotel_performance(views.hotels, b, n=None).filter("hotel_id = 1").first().occupancy
    assert occ == round(100.0 * want[1][0] / total + 1e-12, 2)


def test_hot_user_latest_bookings(spark, views):
    from lodgelake.operators import bookings as B

    b = views.bookings.withColumn(
        "user_id", F.when(F.col("booking_id") % 3 == 0, F.lit(7).cast("long")).otherwise(F.col("user_id")))
    got = {}
    for r in B.user_recent_bookings(b, views.hotels, "1998-06-15 10:30:00", n=20).collect():
        got.setdefault(r.user_id, []).append(r.booking_id)
    allrows = [(r.user_id, r.booking_date, r.booking_id) for r in b.select("user_id", "booking_date", "booking_id")
               .collect()]
    want = {}
    for u, d, i in sorted(allrows, key=lambda t: (t[0], -t[1].timestamp(), -t[2])):
        if len(want.setdefault(u, [])) < 20:
            want[u].append(i)
    assert {u: sorted(v) for u, v in got.items()} == {u: sorted(v) for u, v in want.items()}
    assert b.filter(F.col("user_id") == 7).count() * 3 >= b.count() - 3


def test_hot_account_fold_equals_replay(spark, views):
    from test_properties import replay_accounts

    users = views.users
    cmds = views.account_commands.withColumn(
        "user_id", F.when(F.col("seq") % 3 == 0, F.lit(5).cast("long")).otherwise(F.col("user_id")))
    got = {r.id: (r.status, r.role) for r in X.apply_account_commands(users, cmds).collect()}
    ul = [(r.id, r.status, r.role) for r in users.collect()]
    cl = [(r.seq, r.ts, r.actor_id, r.user_id, r.command) for r in cmds.collect()]
    assert got == replay_accounts(ul, cl)
