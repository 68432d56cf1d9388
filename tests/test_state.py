"""Command state as changed rows: size of what a batch writes, replay, compaction, sums; resubmits at any length."""

import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from conftest import AS_OF, rows
from lodgelake.operators import upkeep
from lodgelake.operators.changes import apply_account_commands, apply_booking_commands, apply_room_commands
from lodgelake.sources.sinks import intake_messages
from lodgelake.streaming import feeds
from lodgelake.streaming.state import CommandState

ROOM_COMMANDS = "seq long, ts timestamp_ntz, room_id long, status string"


def _commands(spark, rows_):
    t = datetime(2024, 1, 1)
    return spark.createDataFrame([(i, t + timedelta(seconds=i), r, s) for i, r, s in rows_], ROOM_COMMANDS)


def test_a_batch_writes_only_what_it_changes(spark, scratch):
    rooms = spark.range(1_000_000).select(F.col("id").alias("room_id"), F.lit("available").alias("status"),
                                          F.concat(F.lit("room "), "id").alias("features"))
    state = CommandState(spark, scratch, rooms.schema, "room_id")
    state.start(rooms)
    cmds = _commands(spark, [(i, i * 7919, "booked" if i % 10 else "available") for i in range(100)])
    state.apply(0, cmds, apply_room_commands)
    written = spark.read.parquet(os.path.join(scratch, "changes", "*"))
    assert written.count() == 90  # ten commands change nothing
    files = [f for _, _, fs in os.walk(os.path.join(scratch, "changes")) for f in fs if f.endswith(".parquet")]
    assert len(files) <= 4
    got = state.read()
    assert got.count() == 1_000_000 and got.where("status = 'booked'").count() == 90


def test_replay_and_compaction(spark, scratch):
    rooms = spark.range(50).select(F.col("id").alias("room_id"), F.lit("available").alias("status"))
    rng = random.Random(3)
    batches = [[(100 * b + i, rng.randrange(60), rng.choice(["booked", "maintenance", "available", "burnt"]))
                for i in range(20)] for b in range(7)]

    def fold(n):
        out = {i: "available" for i in range(50)}
        for b in batches[:n]:
            for _, r, s in b:
                if r in out and s != "burnt":
                    out[r] = s
        return sorted(out.items())

    state = CommandState(spark, scratch, rooms.schema, "room_id")
    state.start(rooms)
    for k, b in enumerate(batches):
        state.apply(k, _commands(spark, b), apply_room_commands, compact_every=3)
        assert rows(state.read()) == fold(k + 1)
    assert state.version() == (6, [6])  # bases at 0, 3 and 6
    # any batch run again, after later versions and bases: nothing differs
    for k in (6, 2, 3, 6):
        state.apply(k, _commands(spark, batches[k]), apply_room_commands, compact_every=3)
        assert rows(state.read(k + 1)) == fold(k + 1) and rows(state.read()) == fold(7)
    # files that were written but not listed don't count, nor does starting again
    spark.createDataFrame([(1, "booked", 9)], "room_id long, status string, _batch long").write.parquet(
        os.path.join(scratch, "changes", "b000000000009"))
    state.start(rooms)
    assert rows(state.read()) == fold(7)
    assert state.compact(20) and state.version() == (20, []) and rows(state.read()) == fold(7)
    assert not state.compact(20)
    none = CommandState(spark, scratch + "-none", rooms.schema, "room_id")
    with pytest.raises(ValueError, match="no state"):
        none.read()


def test_booking_batches_and_sums(spark, views, scratch):
    bookings = views.bookings.withColumn("cancellation_date", F.lit(None).cast("timestamp_ntz"))
    cmds = views.booking_commands
    lo, hi = cmds.select(F.percentile_approx("seq", [0.3, 0.6])).first()[0]
    state = CommandState(spark, scratch, bookings.schema, "booking_id")
    state.start(bookings)
    parts = [cmds.where(F.col("seq") <= lo), cmds.where((F.col("seq") > lo) & (F.col("seq") <= hi)), cmds.where(F.col("seq") > hi)]
    want = bookings
    for k, part in enumerate(parts):
        state.apply(k, part, apply_booking_commands, compact_every=2, sums=True)
        want = spark.createDataFrame(apply_booking_commands(want, part).collect(), bookings.schema)
        assert rows(state.read()) == rows(want)
        assert rows(state.day_status_sums()) == rows(upkeep.day_status_sums(want))
    recount = want.groupBy("status").agg(F.count(F.lit(1)).alias("bookings"))
    assert rows(upkeep.status_stats(state.day_status_sums())) == rows(recount)


def test_sums_of_any_change(spark, views):
    """Prices edited, dates moved, rows added and deleted, a status set back: sums plus deltas are the recount."""
    old = views.bookings.select("booking_id", "booking_date", "status", "total_price")
    new = old.where("booking_id % 7 <> 0").withColumn(
        "total_price", F.when(F.col("booking_id") % 3 == 0, F.lit(None).cast("decimal(10,2)")).otherwise(F.col("total_price"))) \
        .withColumn("status", F.when(F.col("booking_id") % 5 == 0, "pending").otherwise(F.col("status"))) \
        .withColumn("booking_date", F.col("booking_date") + F.make_dt_interval(days=(F.col("booking_id") % 2).cast("int"))) \
        .unionByName(old.limit(5).withColumn("booking_id", F.col("booking_id") + 10**9))
    got = upkeep.added(upkeep.day_status_sums(old), upkeep.day_status_deltas(old, new))
    want = upkeep.day_status_sums(new)
    assert rows(got) == rows(want)
    months = upkeep.month_status(got).agg(F.sum("bookings")).first()[0]
    assert months == new.count()


def test_account_stream_by_email_reads_the_whole_state(spark, views, scratch):
    users = views.users
    c = users.where("id % 10 = 3").select(
        (F.col("id") * 10).alias("seq"), F.lit(AS_OF).cast("timestamp_ntz").alias("ts"), F.lit(None).cast("long").alias("user_id"),
        F.upper("email").alias("email"), F.lit(-1).cast("long").alias("actor_id"), F.lit("toggle_status").alias("command"))
    src = os.path.join(scratch, "in")
    c.write.parquet(src)
    stream = spark.readStream.schema(c.schema).parquet(src)
    feeds.command_stream(stream, users, os.path.join(scratch, "s"), os.path.join(scratch, "ck"),
                         fold=apply_account_commands).awaitTermination()
    got = feeds.current_state(spark, os.path.join(scratch, "s"), users.schema)
    assert rows(got, "id", "status") == rows(apply_account_commands(users, c), "id", "status")
    assert rows(got, "id", "status") != rows(users, "id", "status")


# ------------------------------------------------------------------ ST1

MESSAGES = "id long, name string, email string, subject string, message string, submitted_at timestamp_ntz"


def _one_by_one(messages, within, last=None):
    last, kept = dict(last or {}), []
    for m in sorted(messages, key=lambda m: (m[5], m[0])):
        if m[1:5] not in last or m[5] - last[m[1:5]] >= timedelta(seconds=within):
            last[m[1:5]] = m[5]
            kept.append(m[0])
    return sorted(kept), last


@pytest.mark.parametrize("gap", [1.0, 0.3, 61.0, 59.9])
def test_long_runs_of_one_content(spark, gap):
    rng = random.Random(gap)
    t = datetime(2023, 12, 31, 23, 0)
    messages, at = [], 0.0
    for i in range(6000):
        at += rng.choice([gap, gap, gap / 2, gap * rng.random(), 60.0 if i % 50 == 0 else gap])
        messages.append((i, "n", None if i % 3000 else "e", "s", "same", t + timedelta(microseconds=int(at * 1e6))))
    df = spark.createDataFrame(messages, MESSAGES).repartition(5)
    got = sorted(r["id"] for r in feeds.dedupe_resubmits_batch(df).collect())
    assert got == _one_by_one(messages, 60)[0]


def test_repeats_at_0_30_60_90(spark):
    t = datetime(1969, 12, 31, 23, 59, 31)  # before the epoch too
    messages = [(i, "n", "e", "s", "m", t + timedelta(seconds=30 * i)) for i in range(4)]
    got = feeds.dedupe_resubmits_batch(spark.createDataFrame(messages, MESSAGES))
    assert sorted(r["id"] for r in got.collect()) == [0, 2]


def test_no_window_holds_a_content(spark):
    df = spark.createDataFrame([(1, "n", "e", "s", "m", datetime(2024, 1, 1))], MESSAGES)
    times = feeds._content(df).select("_c", "_u")
    from lodgelake import session
    seen = []
    real = session.materialize
    feeds.materialize = lambda x: (seen.append(x._jdf.queryExecution().executedPlan().toString()), real(x))[1]
    try:
        feeds._kept_times(times, 60_000_000)
    finally:
        feeds.materialize = real
    import re
    specs = re.findall(r"windowspecdefinition\(([^)]*)\)", "".join(seen))
    assert specs and all(re.match(r"_c#\d+, _s#\d+L?", s) for s in specs)


def test_intake_once_over_batches(spark, scratch):
    rng = random.Random(11)
    t = datetime(2024, 3, 1)
    messages = sorted(((i, rng.choice("ab"), "e", "s", rng.choice(["x", "y"]), t + timedelta(seconds=rng.randrange(1500)))
                       for i in range(300)), key=lambda m: m[5])
    messages = [(k, *m[1:]) for k, m in enumerate(messages)]
    src, out = os.path.join(scratch, "in"), os.path.join(scratch, "out")
    stream = spark.readStream.schema(MESSAGES).parquet(os.path.join(src, "*"))
    for k in range(3):
        spark.createDataFrame(messages[100 * k:100 * k + 100], MESSAGES).write.parquet(os.path.join(src, f"w{k}"))
        feeds.intake_once_stream(stream, AS_OF, out, os.path.join(scratch, "st"), os.path.join(scratch, "ck")).awaitTermination()
    got = spark.read.parquet(out)
    assert sorted(r["id"] for r in got.collect()) == _one_by_one(messages, 60)[0]
    assert got.drop("batch_id").columns == intake_messages(spark.createDataFrame(messages, MESSAGES), AS_OF).columns
