"""Streaming forms equal their batch operators over the same rows."""

import os

from pyspark.sql import functions as F

from conftest import AS_OF, rows
from lodgelake.operators.changes import apply_booking_commands
from lodgelake.operators.pricing import price_quotes, stay_requests
from lodgelake.sources.sinks import intake_messages
from lodgelake.streaming import feeds


def _split_to_files(df, path, key, parts=4):
    # several files, written in key order, so a stream sees several inputs
    df.withColumn("_part", F.pmod(F.col(key), F.lit(parts))).write.partitionBy("_part").parquet(path)


def test_intake_stream_equals_batch(spark, views, scratch):
    src = os.path.join(scratch, "msgs")
    msgs = views.contact_messages
    _split_to_files(msgs, src, "id")
    stream = spark.readStream.schema(msgs.schema).parquet(src)
    q = feeds.intake_stream(stream, AS_OF, os.path.join(scratch, "out"), os.path.join(scratch, "ck"))
    q.awaitTermination()
    got = spark.read.parquet(os.path.join(scratch, "out"))
    assert rows(got, "id", "status", "submitted_at") == rows(intake_messages(msgs, AS_OF), "id", "status",
                                                             "submitted_at")


def test_intake_dedupe_drops_resubmits(spark, scratch):
    base = spark.sql("""SELECT * FROM VALUES
        (1, 'a', 'a@x.io', 's', 'hello', TIMESTAMP_NTZ '2024-01-01 10:00:00'),
        (2, 'a', 'a@x.io', 's', 'hello', TIMESTAMP_NTZ '2024-01-01 10:00:02'),
        (3, 'a', 'a@x.io', 's', 'hello', TIMESTAMP_NTZ '2024-01-01 10:00:04'),
        (4, 'b', 'b@x.io', 's', 'other', TIMESTAMP_NTZ '2024-01-01 10:00:05')
        AS t(id, name, email, subject, message, submitted_at)""").withColumn("id", F.col("id").cast("long"))
    src = os.path.join(scratch, "in")
    base.write.parquet(src)
    stream = spark.readStream.schema(base.schema).parquet(src)
    q = feeds.intake_stream(stream, AS_OF, os.path.join(scratch, "out"), os.path.join(scratch, "ck"), dedupe=True)
    q.awaitTermination()
    got = spark.read.parquet(os.path.join(scratch, "out"))
    ids = sorted(r.id for r in got.collect())
    # one message of the resubmitted group survives (which one is not specified within a batch)
    assert len(ids) == 2 and ids[0] in (1, 2, 3) and ids[1] == 4


def test_command_stream_equals_batch_fold(spark, views, scratch):
    cmds = views.booking_commands
    bookings = views.bookings.withColumn("cancellation_date", F.lit(None).cast("timestamp_ntz"))
    src = os.path.join(scratch, "cmds")
    # two time-ordered waves: the stream folds wave 1, then wave 2 onto the wave-1 snapshot
    cut = cmds.select(F.percentile_approx("seq", 0.5)).first()[0]
    cmds.filter(F.col("seq") <= cut).write.parquet(os.path.join(src, "w1"))
    stream = spark.readStream.schema(cmds.schema).parquet(os.path.join(src, "*"))
    state_root, ck = os.path.join(scratch, "state"), os.path.join(scratch, "ck")
    feeds.command_stream(stream, bookings, state_root, ck).awaitTermination()
    cmds.filter(F.col("seq") > cut).write.parquet(os.path.join(src, "w2"))
    feeds.command_stream(stream, bookings, state_root, ck).awaitTermination()
    got = feeds.current_state(spark, state_root, bookings.schema)
    want = apply_booking_commands(bookings, cmds)
    cols = ("booking_id", "status", "cancellation_date")
    assert rows(got, *cols) == rows(want, *cols)


def test_live_counts_stream_equals_batch(spark, views, scratch):
    b = views.bookings.select("booking_id", "booking_date", "status", "total_price")
    src = os.path.join(scratch, "b")
    b.write.parquet(src)
    stream = spark.readStream.schema(b.schema).parquet(src)
    out = os.path.join(scratch, "out")
    feeds.live_counts_stream(stream, out, os.path.join(scratch, "ck")).awaitTermination()
    got = spark.read.parquet(out)
    want = feeds.live_booking_counts(b)
    # append mode emits a day once the watermark passes it: every day except the last ones
    last = b.select(F.max("booking_date")).first()[0]
    want = want.filter(F.col("day_end") <= F.lit(last) - F.expr("INTERVAL 1 DAY"))
    got = got.filter(F.col("day_end") <= F.lit(last) - F.expr("INTERVAL 1 DAY"))
    assert rows(got) == rows(want)
    assert got.count() > 0


def test_quote_stream_equals_batch(spark, views, scratch):
    req = stay_requests(views.bookings)
    src = os.path.join(scratch, "req")
    req.write.parquet(src)
    stream = spark.readStream.schema(req.schema).parquet(src)
    out = os.path.join(scratch, "out")
    feeds.quote_stream(stream, views.hotels, views.city_rates, AS_OF, out, os.path.join(scratch, "ck")) \
        .awaitTermination()
    got = spark.read.parquet(out)
    want = price_quotes(req, views.hotels, views.city_rates, AS_OF)
    cols = ("request_id", "total_price", "discount_percent", "standard_price")
    assert rows(got, *cols) == rows(want, *cols)


def test_room_and_account_streams_equal_batch(spark, views, scratch):
    from lodgelake.operators.changes import apply_account_commands, apply_room_commands

    for name, state, cmds, fold, key, cols in [
        ("rooms", views.rooms, views.room_commands, apply_room_commands, "seq", ("room_id", "status")),
        ("users", views.users, views.account_commands, apply_account_commands, "seq", ("id", "status", "role")),
    ]:
        src = os.path.join(scratch, name)
        cut = cmds.select(F.percentile_approx(key, 0.5)).first()[0]
        cmds.filter(F.col(key) <= cut).write.parquet(os.path.join(src, "w1"))
        stream = spark.readStream.schema(cmds.schema).parquet(os.path.join(src, "*"))
        root, ck = os.path.join(scratch, name + "_state"), os.path.join(scratch, name + "_ck")
        feeds.command_stream(stream, state, root, ck, fold=fold).awaitTermination()
        cmds.filter(F.col(key) > cut).write.parquet(os.path.join(src, "w2"))
        feeds.command_stream(stream, state, root, ck, fold=fold).awaitTermination()
        got = feeds.current_state(spark, root, state.schema)
        assert rows(got, *cols) == rows(fold(state, cmds), *cols)


def test_batch_dedupe_drops_only_near_resubmits(spark):
    from datetime import datetime, timedelta

    start = datetime(1998, 1, 1, 10, 0, 50)
    at = {1: 0, 2: 0, 3: 30, 4: 59, 5: 60, 6: 100, 7: 121, 8: 30 * 86400}
    rows = [(i, "n", None, "s", "m", start + timedelta(seconds=x)) for i, x in at.items()]
    rows += [(20, "other", None, "s", "m", start), (21, "n", None, "s", "m", None), (22, "n", None, "s", "m", None)]
    df = spark.createDataFrame(
        rows, "id int, name string, email string, subject string, message string, submitted_at timestamp_ntz")
    got = sorted(r["id"] for r in feeds.dedupe_resubmits_batch(df.repartition(3)).collect())
    assert got == [1, 5, 7, 8, 20, 21]
