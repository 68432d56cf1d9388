"""ST1-ST4: the request-at-a-time writes of the booking application as Structured Streaming jobs.

The transformations are the same DataFrame functions the batch operators use;
only the source (``readStream``) and sink (``writeStream`` with a checkpoint
location) differ, so a stream over the same rows equals the batch result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from lodgelake.operators.changes import (apply_account_commands, apply_booking_commands, apply_room_commands,
                                         resolve_account_targets)
from lodgelake.operators.pricing import price_quotes
from lodgelake.session import materialize
from lodgelake.sources.sinks import intake_messages
from lodgelake.streaming.state import CommandState

RESUBMIT_KEYS = ["name", "email", "subject", "message"]


# ------------------------------------------------------------------ ST1
EVENT_TIME = "_event_time"


def with_event_time(df: DataFrame, col: str) -> DataFrame:
    """Watermarks need TIMESTAMP (with time zone); tables hold TIMESTAMP_NTZ.  A cast copy carries the
    watermark; the session time zone (UTC in our sessions) makes the round trip exact."""
    return df.withColumn(EVENT_TIME, F.col(col).cast("timestamp"))


def dedupe_resubmits(messages: DataFrame, within: str = "1 minute") -> DataFrame:
    """Drop a message re-sent with identical content inside ``within`` (state bounded by the watermark)."""
    return (
        with_event_time(messages, "submitted_at").withWatermark(EVENT_TIME, within)
        .dropDuplicatesWithinWatermark(RESUBMIT_KEYS).drop(EVENT_TIME)
    )


def _content(messages: DataFrame) -> DataFrame:
    """``_c``: a digest of what is compared, nulls told apart from texts; ``_u``: the time in microseconds, zone-free."""
    whole = F.to_json(F.struct(*RESUBMIT_KEYS), {"ignoreNullFields": "false"})
    t = F.col("submitted_at")
    seconds = F.datediff(F.to_date(t), F.lit("1970-01-01")).cast("long") * 86400 + F.hour(t) * 3600 + F.minute(t) * 60
    return messages.withColumn("_c", F.sha2(whole, 256)).withColumn(
        "_u", seconds * 1_000_000 + (F.expr("extract(SECOND FROM submitted_at)") * 1_000_000).cast("long"))


def _kept_times(times: DataFrame, span: int) -> DataFrame:
    """Of distinct (_c, _u): those that remain if each is dropped less than ``span`` after the last kept one.

    A time ``span`` or more after the one before it is kept whatever was.  From a kept time the next kept one is the
    first ``span`` or more later, which is in the next slot of that length, or is the first of the slot after it, or
    follows a gap: so each time has at most one pointer, found within slots.  Kept times are marked by pointer doubling:
    after k rounds the first 2^k of every run are, by joins on (content, time).  No window or array holds
    the times of one content, only those of one slot.
    """
    times = times.withColumn("_s", F.col("_u") - F.pmod("_u", F.lit(span)))
    slots = times.groupBy("_c", "_s").agg(F.min("_u").alias("_min"), F.max("_u").alias("_max"))
    # every time, and its question for the first time span later, which falls into the next slot
    both = times.select("_c", "_s", "_u", F.lit(1).alias("_is"), F.lit(None).cast("long").alias("_of")).unionByName(
        times.select("_c", F.col("_s") + span, (F.col("_u") + span).alias("_u"), F.lit(0).alias("_is"), F.col("_u").alias("_of"))
        .toDF("_c", "_s", "_u", "_is", "_of"))
    slot = Window.partitionBy("_c", "_s")
    here = F.when(F.col("_is") == 1, F.col("_u"))
    both = both.select(
        "*", F.last(here, True).over(slot.orderBy(F.desc("_u"), F.desc("_is"))
                                     .rowsBetween(Window.unboundedPreceding, 0)).alias("_at_or_after"),
        F.last(here, True).over(slot.orderBy("_u", "_is").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    earlier = slots.select("_c", (F.col("_s") + span).alias("_s"), F.col("_max").alias("_last"))
    later = slots.select("_c", (F.col("_s") - span).alias("_s"), F.col("_min").alias("_first"))
    fresh = both.where("_is = 1").join(earlier, ["_c", "_s"], "left").select(
        "_c", "_u", F.coalesce(F.col("_u") - F.coalesce("_before", "_last") >= span, F.lit(True)).alias("_fresh"))
    fresh = materialize(fresh)
    kept = fresh.where("_fresh").select("_c", "_u")
    jump = both.where("_is = 0").join(later, ["_c", "_s"], "left").select(
        "_c", F.col("_of").alias("_u"), F.coalesce("_at_or_after", "_first").alias("_to")).where("_to IS NOT NULL")
    # a run ends where the next time is kept anyway
    target = fresh.where("NOT _fresh").select("_c", F.col("_u").alias("_to"))
    jump = materialize(jump.join(target, ["_c", "_to"], "left_semi").select("_c", "_u", "_to"))
    while not jump.isEmpty():  # log2 of the longest run
        kept = materialize(kept.unionByName(kept.join(jump, ["_c", "_u"]).select("_c", F.col("_to").alias("_u"))))
        ahead = jump.select("_c", F.col("_u").alias("_to"), F.col("_to").alias("_next"))
        jump = materialize(jump.join(ahead, ["_c", "_to"]).select("_c", "_u", F.col("_next").alias("_to")))
    return kept


def dedupe_resubmits_batch(messages: DataFrame, within: int = 60, last_kept: DataFrame | None = None) -> DataFrame:
    """Messages without resubmits: (RESUBMIT_KEYS, id) of those not sent less than ``within`` seconds after the last kept
    one of the same content.  Of equal times the smallest id is kept; messages without a time count as sent
    at one time of their own.

    ``last_kept`` (_c, last: microseconds) is what batches before this one kept: a message less than ``within``
    from its content's last kept one, on either side, is a resubmit.
    """
    span = within * 1_000_000
    m = _content(messages)
    undated = m.where("_u IS NULL").groupBy("_c").agg(F.min_by(F.struct(*RESUBMIT_KEYS, "id"), "id").alias("_m"))
    nodes = m.where("_u IS NOT NULL").groupBy("_c", "_u").agg(F.min_by(F.struct(*RESUBMIT_KEYS, "id"), "id").alias("_m"))
    if last_kept is not None:
        nodes = nodes.join(last_kept, "_c", "left").where(
            F.col("last").isNull() | (F.abs(F.col("_u") - F.col("last")) >= span)).drop("last")
    nodes = materialize(nodes)
    kept = nodes.join(_kept_times(nodes.select("_c", "_u"), span), ["_c", "_u"], "left_semi")
    return kept.select("_m.*").unionByName(undated.select("_m.*"))


def intake_once_stream(messages: DataFrame, as_of, sink_path: str, state_root: str, checkpoint: str, within: int = 60,
                       trigger: dict | None = None) -> StreamingQuery:
    """Intake by the rule of ``dedupe_resubmits_batch``, batch by batch: the time each content was last kept is a
    ``CommandState``, of which a batch writes the contents it kept.  A batch run again gives the same rows: its
    output is a folder of its own and its state is read as before it."""
    spark = messages.sparkSession
    schema = T.StructType([T.StructField("_c", T.StringType()), T.StructField("last", T.LongType())])
    state = CommandState(spark, state_root, schema, "_c")
    state.start(spark.createDataFrame([], schema))

    def apply_batch(batch: DataFrame, batch_id: int) -> None:
        batch = materialize(_content(batch))
        state.compact(batch_id, 100)
        before = materialize(state.read(batch_id, batch.select("_c")))
        kept = dedupe_resubmits_batch(batch.drop("_c", "_u"), within, before)
        rows = materialize(batch.join(kept.select("id"), "id", "left_semi"))
        intake_messages(rows.drop("_c", "_u"), as_of).write.mode("overwrite").parquet(
            f"{sink_path.rstrip('/')}/batch_id={batch_id}")
        last = rows.where("_u IS NOT NULL").select("_c", F.col("_u").alias("last")).unionByName(before)
        state.write_changes(batch_id, last.groupBy("_c").agg(F.max("last").alias("last")))

    w = messages.writeStream.foreachBatch(apply_batch).option("checkpointLocation", checkpoint)
    return w.trigger(**(trigger or {"availableNow": True})).start()


def intake_stream(messages: DataFrame, as_of, sink_path: str, checkpoint: str, dedupe: bool = False,
                  trigger: dict | None = None) -> StreamingQuery:
    df = dedupe_resubmits(messages) if dedupe else messages
    out = intake_messages(df, as_of)
    w = out.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append")
    w = w.trigger(**(trigger or {"availableNow": True}))
    return w.start(sink_path)


# ------------------------------------------------------------------ ST2
#: key column of the state, and of the commands, for each fold
FOLD_KEYS = {
    apply_booking_commands: ("booking_id", "booking_id"),
    apply_room_commands: ("room_id", "room_id"),
    apply_account_commands: ("id", "user_id"),
}


def command_stream(commands: DataFrame, initial_state: DataFrame, state_root: str, checkpoint: str,
                   trigger: dict | None = None, fold=apply_booking_commands, compact_every: int = 100,
                   sums: bool = False) -> StreamingQuery:
    """Fold each micro-batch of commands onto the state under ``state_root`` (see ``state.CommandState``).

    ``fold(state, commands) -> state`` is one of ``FOLD_KEYS``: each composes batch by batch and treats every key
    apart, so it is given only the rows that a batch names.  A batch writes the rows it changes; ``sums`` keeps the
    bookings per day and status up to date along with them.  Batches apply in arrival order, as the application
    applied requests as they arrived; inside a batch, commands apply in (ts, seq) order.
    """
    key, command_key = FOLD_KEYS[fold]
    state = CommandState(commands.sparkSession, state_root, initial_state.schema, key)
    state.start(initial_state)

    def apply_batch(batch: DataFrame, batch_id: int) -> None:
        if fold is apply_account_commands and "email" in batch.columns:  # commands that name an address
            batch = resolve_account_targets(batch, state.read(batch_id))
        state.apply(batch_id, batch, fold, command_key, compact_every, sums)

    w = commands.writeStream.foreachBatch(apply_batch).option("checkpointLocation", checkpoint)
    return w.trigger(**(trigger or {"availableNow": True})).start()


def current_state(spark: SparkSession, state_root: str, schema, key: str | None = None) -> DataFrame:
    """The state after all listed batches; ``key`` is needed where the schema's first column isn't it."""
    return CommandState(spark, state_root, schema, key or schema.fieldNames()[0]).read()


# ------------------------------------------------------------------ ST3
def live_booking_counts(bookings: DataFrame, late: str = "1 day") -> DataFrame:
    """Bookings and revenue per day and status.

    On a stream: a tumbling one-day window on the watermarked event time; rows later than ``late``
    are dropped and each day is emitted once (append mode).  On a static frame: the same result
    grouped by the calendar day of the TIMESTAMP_NTZ, independent of the session time zone.
    """
    agg = [F.count(F.lit(1)).alias("bookings"), F.sum("total_price").cast("decimal(18,2)").alias("revenue")]
    if bookings.isStreaming:
        return (
            with_event_time(bookings, "booking_date").withWatermark(EVENT_TIME, late)
            .groupBy(F.window(EVENT_TIME, "1 day").alias("day"), "status").agg(*agg)
            .select(F.col("day.start").cast("timestamp_ntz").alias("day_start"),
                    F.col("day.end").cast("timestamp_ntz").alias("day_end"), "status", "bookings", "revenue")
        )
    day = F.to_date("booking_date").cast("timestamp_ntz")
    return (
        bookings.groupBy(day.alias("day_start"), "status").agg(*agg)
        .select("day_start", (F.col("day_start") + F.expr("INTERVAL 1 DAY")).alias("day_end"), "status",
                "bookings", "revenue")
    )


def live_counts_stream(bookings: DataFrame, sink_path: str, checkpoint: str,
                       trigger: dict | None = None) -> StreamingQuery:
    w = live_booking_counts(bookings).writeStream.format("parquet").outputMode("append") \
        .option("checkpointLocation", checkpoint)
    return w.trigger(**(trigger or {"availableNow": True})).start(sink_path)


# ------------------------------------------------------------------ ST4
def quote_stream(requests: DataFrame, hotels: DataFrame, rates: DataFrame, as_of, sink_path: str,
                 checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Price each arriving request against the static hotel and rate dimensions (stream-static join)."""
    q = price_quotes(requests, hotels, rates, as_of)
    w = q.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    return w.trigger(**(trigger or {"availableNow": True})).start(sink_path)
