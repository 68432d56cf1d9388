"""Command logs folded onto current state, upserts, guarded deletes.

Folds are closed forms, not sequential replays:
  * last-write-wins columns are ``max_by(value, struct(ts, seq))`` aggregates
    (partial aggregation map-side, so a hot key never reaches one task whole);
  * the booking fold needs "first owner cancel after the latest admin command",
    expressed as a hierarchical prefix scan over nested time slices, so no window
    ever holds one whole booking;
  * toggles are parity counts after the last reset.
Upserts are keyed outer joins; deletes are anti/semi joins.  Nothing mutates
in place: each operator returns the new state as a DataFrame.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lodgelake.functions import rules
from lodgelake.functions.columns import plain_text, store_text
from lodgelake.session import materialize


def _pos() -> F.Column:
    return F.struct(F.col("ts"), F.col("seq"))


def latest_per_key(edits: DataFrame, key: str, order_col: str | None) -> DataFrame:
    """One edit per key: the one with the greatest ``order_col`` (an aggregate, so a key edited
    very often is combined map-side).  Without ``order_col`` the edits must already be unique."""
    if order_col is None:
        return edits
    cols = [c for c in edits.columns if c != key]
    latest = edits.groupBy(key).agg(F.max_by(F.struct(*cols), F.col(order_col)).alias("_e"))
    return latest.select(key, *[F.col(f"_e.{c}").alias(c) for c in cols])


# ------------------------------------------------------------------ R6
def apply_room_commands(rooms: DataFrame, cmds: DataFrame) -> DataFrame:
    """Each room takes the status of its latest command; rooms without commands keep theirs."""
    last = (
        cmds.filter(F.col("status").isin(*rules.ROOM_STATUSES))
        .groupBy("room_id")
        .agg(F.max_by("status", _pos()).alias("_new_status"))
    )
    return rooms.join(last, "room_id", "left").select(
        *[F.coalesce(F.col("_new_status"), F.col("status")).alias("status") if c == "status" else F.col(c)
          for c in rooms.columns]
    )


# ------------------------------------------------------------------ R7
def upsert_rooms(rooms: DataFrame, edits: DataFrame, order_col: str | None = None) -> DataFrame:
    """Full-row edits by room_id (unknown ids are ignored, as an UPDATE would); with ``order_col``
    the latest edit of each room wins."""
    edits = latest_per_key(edits, "room_id", order_col)
    e = edits.select(
        "room_id",
        F.lit(True).alias("_hit"),
        F.col("hotel_id").alias("_hotel_id"),
        F.col("room_number").alias("_room_number"),
        F.col("room_type").alias("_room_type"),
        F.col("price").cast("decimal(10,2)").alias("_price"),
        F.when(F.col("status").isin(*rules.ROOM_STATUSES), F.col("status")).otherwise("available").alias("_status"),
        F.col("capacity").cast("int").alias("_capacity"),
        F.coalesce(F.col("max_guests") if "max_guests" in edits.columns else F.lit(None), F.col("capacity"))
        .cast("int").alias("_max_guests"),
        F.coalesce(F.col("price_multiplier") if "price_multiplier" in edits.columns else F.lit(None),
                   F.lit("1.0")).cast("decimal(3,2)").alias("_price_multiplier"),
        F.coalesce(F.col("features") if "features" in edits.columns else F.lit(None), F.lit("")).alias("_features"),
    )
    df = rooms.join(e, "room_id", "left")
    out = []
    for c in rooms.columns:
        if f"_{c}" in e.columns:
            out.append(F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).cast(rooms.schema[c].dataType).alias(c))
        else:
            out.append(F.col(c))
    extra = [n for n in ("max_guests", "price_multiplier", "features") if n not in rooms.columns]
    out += [F.col(f"_{n}").alias(n) for n in extra]
    return df.select(*out)


# ------------------------------------------------------------------ R8
def room_delete_outcomes(rooms: DataFrame, bookings: DataFrame, ids: DataFrame) -> DataFrame:
    """Each requested room id: deleted, refused (with the number of bookings on it) or not found."""
    refs = bookings.filter(F.col("room_id").isNotNull()).groupBy("room_id").agg(F.count(F.lit(1)).alias("bookings"))
    req = ids.select("room_id").distinct()
    known = rooms.select("room_id", F.lit(True).alias("_known"))
    df = req.join(known, "room_id", "left").join(refs, "room_id", "left")
    n = F.coalesce(F.col("bookings"), F.lit(0))
    head, tail = rules.MSG_ROOM_DELETE_REFUSED.split("{n}")
    return df.select(
        "room_id", n.alias("bookings"),
        F.when(F.col("_known").isNull(), "not_found").when(n > 0, "refused").otherwise("deleted").alias("outcome"),
        F.when(n > 0, F.concat(F.lit(head), n.cast("string"), F.lit(tail))).alias("message"),
    )


def delete_rooms(rooms: DataFrame, bookings: DataFrame, ids: DataFrame) -> DataFrame:
    """Rooms left after deleting the requested rooms that no booking references."""
    gone = room_delete_outcomes(rooms, bookings, ids).filter(F.col("outcome") == "deleted")
    return rooms.join(gone.select("room_id"), "room_id", "left_anti")


# ------------------------------------------------------------------ B9
# nested time slices of the booking fold, finest first; each divides the next
SLICE_LEVELS = (60, 86400)


def _epoch_seconds(ts: str) -> F.Column:
    """Seconds since 1970-01-01 of a TIMESTAMP_NTZ, with no time-zone conversion (monotone in ts)."""
    t = F.col(ts)
    return (F.datediff(F.to_date(t), F.lit("1970-01-01")).cast("long") * 86400
            + F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t))


def _levels(slices) -> tuple[int, ...]:
    levels = (slices,) if isinstance(slices, int) else tuple(slices)
    assert levels and all(b % a == 0 for a, b in zip(levels, levels[1:])), "each slice must divide the next"
    return levels


def _booking_command_steps(bookings: DataFrame, cmds: DataFrame, slices=SLICE_LEVELS) -> DataFrame:
    """Every command against an existing booking, with what it did (``_booking_changes`` has the outcome only).

    Per command the fold needs: the latest admin status before it (``la``), the number of owner
    cancels so far (``c``) and how many of them came before that admin command (``bf``).  Over a
    range of commands these three form an associative summary -- (A then B) = (B.la ?? A.la,
    A.c + B.c, B.bf is set ? A.c + B.bf : A.bf) -- so the running values are a prefix scan.  A
    window over a whole booking would put a booking holding a third of all commands in one task;
    the scan is hierarchical instead:
      level 0: running values inside each (booking, finest slice);
      level j: exclusive prefixes of the level j-1 slice summaries inside each (booking, slice j),
               and per booking over the coarsest summaries;
      carries are composed top-down and joined back to the rows.
    With the default (1 minute, 1 day) no window holds more than one booking-minute of rows,
    1440 minute summaries, or one summary per day the booking spans.
    """
    levels = _levels(slices)
    k = len(levels)
    key = "booking_id"
    bcols = [f"_b{i}" for i in range(k)]
    owners = bookings.select(key, F.col("user_id").alias("_owner"), F.col("status").alias("_s0"))
    c = cmds.join(owners, key)
    is_admin = F.col("command").isin("admin_confirm", "admin_cancel")
    # a command without an actor is nobody's own
    is_owner_cancel = F.coalesce((F.col("command") == "user_cancel") & (F.col("actor_id") == F.col("_owner")),
                                 F.lit(False))
    admin_status = F.when(F.col("command") == "admin_confirm", "confirmed").when(
        F.col("command") == "admin_cancel", "cancelled")
    es = _epoch_seconds("ts")
    c = c.select("*", is_admin.alias("_admin"), is_owner_cancel.alias("_cancel"), admin_status.alias("_astat"),
                 *[F.floor(es / w).alias(b) for w, b in zip(levels, bcols)])
    # the join leaves the rows dealt by booking, which would satisfy every window below and keep a hot
    # booking in one task: deal them anew by (booking, finest slice)
    c = c.repartition(key, bcols[0])

    # level 0: inclusive running summary inside (booking, finest slice)
    w0 = Window.partitionBy(key, bcols[0]).orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    c = c.select("*", F.last("_astat", ignorenulls=True).over(w0).alias("_s_la"),
                 F.sum(F.col("_cancel").cast("long")).over(w0).alias("_s_c"))
    c = c.withColumn("_s_bf", F.last(F.when(F.col("_admin"), F.col("_s_c")), ignorenulls=True).over(w0))

    # slice totals of level 0
    pos = _pos()
    cur = c.groupBy(key, *bcols).agg(
        F.max_by("_astat", F.when(F.col("_admin"), pos)).alias("la"),
        F.count_if("_cancel").alias("c"),
        F.max_by("_s_c", F.when(F.col("_admin"), pos)).alias("bf"),
    )
    # levels 1..k: exclusive prefixes of child summaries inside each parent (the last parent is the booking)
    prefixes = []
    for j in range(1, k + 1):
        child, parents = bcols[j - 1], bcols[j:]
        wj = Window.partitionBy(key, *parents[:1]).orderBy(child).rowsBetween(Window.unboundedPreceding, -1)
        e = cur.select("*", F.last("la", ignorenulls=True).over(wj).alias("e_la"),
                       F.coalesce(F.sum("c").over(wj), F.lit(0)).alias("e_c"))
        e = e.withColumn("e_bf", F.last(F.when(F.col("la").isNotNull(), F.col("e_c") + F.col("bf")),
                                        ignorenulls=True).over(wj))
        prefixes.append(e.select(key, child, *parents, "e_la", "e_c", "e_bf"))
        if j < k:
            admin_at = F.when(F.col("la").isNotNull(), F.col(child))
            cur = e.groupBy(key, *parents).agg(
                F.max_by("la", admin_at).alias("la"),
                F.sum("c").alias("c"),
                F.max_by(F.col("e_c") + F.col("bf"), admin_at).alias("bf"),
            )

    # carries, top-down: carry(slice) = carry(parent) then prefix-within-parent(slice)
    top = prefixes[-1]
    carry = top.select(key, bcols[k - 1], F.col("e_la").alias("g_la"), F.col("e_c").alias("g_c"),
                       F.col("e_bf").alias("g_bf"))
    for j in range(k - 1, 0, -1):
        t = prefixes[j - 1].join(carry, [key, bcols[j]])
        carry = t.select(
            key, bcols[j - 1],
            F.coalesce(F.col("e_la"), F.col("g_la")).alias("g_la"),
            (F.col("g_c") + F.col("e_c")).alias("g_c"),
            F.when(F.col("e_bf").isNotNull(), F.col("g_c") + F.col("e_bf")).otherwise(F.col("g_bf")).alias("g_bf"),
        )

    # global running values of each row = carry of its finest slice, then its own running summary
    c = c.join(carry, [key, bcols[0]])
    last_admin = F.coalesce(F.col("_s_la"), F.col("g_la"))
    cum = F.col("g_c") + F.col("_s_c")
    before = F.coalesce(F.when(F.col("_s_bf").isNotNull(), F.col("g_c") + F.col("_s_bf")).otherwise(F.col("g_bf")),
                        F.lit(0))
    base = F.coalesce(last_admin, F.col("_s0"))  # status at the start of this row's segment
    first_in_segment = (cum - before) == 1
    effective = F.col("_cancel") & first_in_segment & (base == "confirmed")
    # a segment that started confirmed is cancelled from its first owner cancel on; refused commands
    # (a non-owner's cancel included) leave the status as it is at their position
    after = (
        F.when(F.col("_admin"), F.col("_astat"))
        .when((base == "confirmed") & ((cum - before) >= 1), F.lit("cancelled"))
        .otherwise(base)
    )
    reason = (
        F.when(F.col("_admin"), F.lit(None).cast("string"))
        .when(~F.col("_cancel"), F.lit(rules.MSG_CANCEL_NOT_ALLOWED))
        .when(~effective, F.concat(
            F.lit(rules.MSG_CANCEL_WRONG_STATUS),
            F.when(~first_in_segment & (base == "confirmed"), F.lit("cancelled")).otherwise(base)))
    )
    return c.select(
        "seq", "ts", key, "actor_id", "command",
        (F.col("_admin") | effective).alias("applied"),
        reason.alias("reason"),
        after.alias("status_after"),
    )


def booking_command_outcomes(bookings: DataFrame, cmds: DataFrame, slices=SLICE_LEVELS) -> DataFrame:
    """Per command: applied or refused with a reason.  On an unknown booking a user's cancel gets the
    reply of the source; an administrator's command changes no row and is reported as not found."""
    steps = _booking_command_steps(bookings, cmds, slices)
    lost = cmds.join(bookings.select("booking_id"), "booking_id", "left_anti").select(
        "seq", "ts", "booking_id", "actor_id", "command", F.lit(False).alias("applied"),
        F.when(F.col("command") == "user_cancel", F.lit(rules.MSG_CANCEL_NOT_ALLOWED))
        .otherwise(F.lit(rules.MSG_BOOKING_UNKNOWN)).alias("reason"), F.lit(None).cast("string").alias("status_after"))
    return steps.unionByName(lost)


# what a command is to the fold of states; others change nothing
CONFIRM, REFUSE, CANCEL = 1, 2, 3


def _booking_changes(bookings: DataFrame, cmds: DataFrame, slices=SLICE_LEVELS) -> DataFrame:
    """What the log did to each booking it names: its first and last command that counts (an admin's or an owner's
    cancel), the time of the first, the latest cancel that took effect, whether an admin's command is there.

    An owner's cancel takes effect if the command before it that counts is a confirmation.  So a range of commands is
    summed up by these values, and two summaries make one: the later's first follows the earlier's last.  They are
    combined slice by slice, each level dealt once and no value joined back to commands; windows are bounded as in
    ``_booking_command_steps``."""
    levels = _levels(slices)
    key = "booking_id"
    names = [f"_b{i}" for i in range(len(levels))]
    c = cmds.join(bookings.select(key, F.col("user_id").alias("_owner")), key)
    dated = F.col("ts").isNotNull()  # an admin's command without a time has no place in the log
    kind = F.when(dated & (F.col("command") == "admin_confirm"), CONFIRM) \
        .when(dated & (F.col("command") == "admin_cancel"), REFUSE) \
        .when((F.col("command") == "user_cancel") & (F.col("actor_id") == F.col("_owner")), CANCEL)
    seconds = _epoch_seconds("ts")
    parts = c.select(key, "ts", "seq", kind.alias("_first"), kind.alias("_last"), F.col("ts").alias("_at"),
                     F.lit(None).cast(cmds.schema["ts"].dataType).alias("_done"),
                     F.coalesce(kind < CANCEL, F.lit(False)).alias("_admin"), dated.alias("_dated"),
                     *[F.floor(seconds / w).alias(n) for w, n in zip(levels, names)])
    # dealt anew, as the join leaves a hot booking in one task
    parts = parts.repartition(key, names[0])
    for order, groups in zip([["ts", "seq"], *([n] for n in names)], [names[k:] for k in range(len(names) + 1)]):
        w = Window.partitionBy(key, *groups[:1]).orderBy(*order)
        before = F.last("_last", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
        parts = parts.select("*", before.alias("_before"), F.row_number().over(w).alias("_n"))
        n = F.when(F.col("_first").isNotNull(), F.col("_n"))
        took = F.when((F.col("_before") == CONFIRM) & (F.col("_first") == CANCEL), F.col("_at"))
        parts = parts.groupBy(key, *groups).agg(
            F.min_by("_first", n).alias("_first"), F.max_by("_last", n).alias("_last"), F.min_by("_at", n).alias("_at"),
            F.max(F.greatest(F.col("_done"), took)).alias("_done"), F.max("_admin").alias("_admin"),
            F.max("_dated").alias("_dated"))
    return parts


def apply_booking_commands(bookings: DataFrame, cmds: DataFrame, slices=SLICE_LEVELS) -> DataFrame:
    """Bookings after the command log: admin confirm/cancel are unconditional; an owner's cancel
    applies only to a confirmed booking and stamps cancellation_date."""
    b = bookings if "cancellation_date" in bookings.columns else bookings.withColumn(
        "cancellation_date", F.lit(None).cast("timestamp_ntz"))
    df = b.join(_booking_changes(bookings, cmds, slices), "booking_id", "left")
    was_confirmed = F.col("status") == "confirmed"
    status = (
        F.when(~F.col("_dated"), F.col("status"))  # by commands without a time alone nothing changes
        .when(F.col("_last") == CONFIRM, "confirmed")
        .when(F.col("_last") == REFUSE, "cancelled")
        .when((F.col("_last") == CANCEL) & (F.col("_admin") | was_confirmed), "cancelled")
        .otherwise(F.col("status"))
    )
    done = F.greatest(F.col("_done"), F.when((F.col("_first") == CANCEL) & was_confirmed, F.col("_at")))
    cols = []
    for c in b.columns:
        if c == "status":
            cols.append(status.alias("status"))
        elif c == "cancellation_date":
            cols.append(F.coalesce(done, F.col("cancellation_date")).alias(c))
        else:
            cols.append(F.col(c))
    return df.select(*cols)


# ------------------------------------------------------------------ B10
def delete_hotels(hotels: DataFrame, ids: DataFrame) -> DataFrame:
    return hotels.join(ids.select("hotel_id").distinct(), "hotel_id", "left_anti")


def cascade_hotel_bookings(bookings: DataFrame, ids: DataFrame) -> DataFrame:
    """Bookings left after their hotels are deleted (rooms are not cascaded)."""
    return bookings.join(ids.select("hotel_id").distinct(), "hotel_id", "left_anti")


# ------------------------------------------------------------------ B11
def upsert_hotels(hotels: DataFrame, edits: DataFrame, order_col: str | None = None) -> DataFrame:
    """Edits of known ids replace title, city, price, address, description; other ids are inserted
    with the insert defaults (price 100.00, default image and address).  With ``order_col`` the
    latest edit of each hotel wins."""
    edits = latest_per_key(edits, "hotel_id", order_col)
    edit_cols = ["title", "city", "price", "address", "description"]
    e = edits.select("hotel_id", F.lit(True).alias("_hit"), *[F.col(c).alias(f"_{c}") for c in edit_cols
                                                              if c in edits.columns])
    h = hotels.withColumn("_known", F.lit(True))
    df = h.join(e, "hotel_id", "full_outer")

    def new(c):
        return F.col(f"_{c}") if f"_{c}" in e.columns else F.lit(None)

    inserted, updated = F.col("_known").isNull(), F.col("_hit").isNotNull()

    def pick(c, on_insert, on_update):
        return (F.when(inserted, on_insert).when(updated, on_update).otherwise(F.col(c))
                .cast(hotels.schema[c].dataType).alias(c))

    cols = []
    for c in hotels.columns:
        if c in ("title", "city"):
            cols.append(pick(c, new(c), new(c)))
        elif c == "price":
            cols.append(pick(c, F.coalesce(new(c), F.lit(rules.HOTEL_DEFAULT_PRICE)), F.coalesce(new(c), F.col(c))))
        elif c == "address":
            cols.append(pick(c, F.coalesce(new(c), F.lit(rules.HOTEL_DEFAULT_ADDRESS)), F.coalesce(new(c), F.lit(""))))
        elif c == "description":
            cols.append(pick(c, F.coalesce(new(c), F.lit("")), F.coalesce(new(c), F.lit(""))))
        elif c == "image":
            cols.append(F.coalesce(F.col("image"), F.lit(rules.HOTEL_DEFAULT_IMAGE)).alias(c))
        else:
            cols.append(F.col(c))
    return df.select(*cols)


# ------------------------------------------------------------------ U7
def resolve_account_targets(cmds: DataFrame, users: DataFrame) -> DataFrame:
    """Commands may name their account by ``email`` instead of ``user_id`` (activation links carry
    the address): resolve it as the store compares text against one row per address."""
    if "email" not in cmds.columns:
        return cmds
    by_mail = users.groupBy(store_text("email").alias("_mail")).agg(F.min("id").alias("_uid"))
    df = cmds.join(by_mail, store_text(cmds["email"]) == by_mail["_mail"], "left")
    uid = F.coalesce(F.col("user_id"), F.col("_uid")) if "user_id" in cmds.columns else F.col("_uid")
    return df.select(*[c for c in cmds.columns if c not in ("user_id", "email")], uid.alias("user_id"))


def apply_account_commands(users: DataFrame, cmds: DataFrame, slices=SLICE_LEVELS) -> DataFrame:
    """Status: toggles (not on oneself) after the last activation, by parity.
    Role: the latest allowed role command (set_role_* not on oneself; make_admin always).
    Commands may target an account by ``email`` (see ``resolve_account_targets``).

    The log is summed up per (account, finest slice): the last activation, the toggles after it, the last role.  Two such
    summaries make one (the later one's, and the earlier one's toggles if the later has no activation), so they are
    combined slice by slice: no window holds more than one account-minute of commands, 1440 minutes or one summary a
    day, whether an account has a third of the log over years or within one day."""
    cmds = resolve_account_targets(cmds, users).where(F.col("user_id").isNotNull())
    levels = _levels(slices)
    names = [f"_s{i}" for i in range(len(levels))]
    self_cmd = F.coalesce(F.col("actor_id") == F.col("user_id"), F.lit(False))
    cmd = F.col("command")
    new_role = (
        F.when((cmd == "set_role_user") & ~self_cmd, "user")
        .when((cmd == "set_role_admin") & ~self_cmd, "admin")
        .when(cmd == "make_admin", "admin")
    )
    seconds = _epoch_seconds("ts")
    parts = cmds.select("user_id", _pos().alias("_at"), *[F.floor(seconds / w).alias(n) for w, n in zip(levels, names)],
                        (cmd == "activate").alias("_has"), F.when((cmd == "toggle_status") & ~self_cmd, 1).otherwise(0).alias("_n"),
                        new_role.alias("_role"))
    parts = parts.repartition("user_id", names[0])
    for at, groups in zip(["_at", *names], [names[k:] for k in range(len(names) + 1)]):
        start = F.max(F.when(F.col("_has"), F.col(at))).over(Window.partitionBy("user_id", *groups[:1]))
        later = F.col("_start").isNull() | (F.col(at) > F.col("_start") if at == "_at" else F.col(at) >= F.col("_start"))
        parts = parts.withColumn("_start", start).groupBy("user_id", *groups).agg(
            F.max("_start").isNotNull().alias("_has"), F.sum(F.when(later, F.col("_n")).otherwise(0)).alias("_n"),
            F.max_by("_role", F.when(F.col("_role").isNotNull(), F.col(at))).alias("_role"))
    per_user = parts.select("user_id", F.col("_has").alias("_activated"), F.col("_n").alias("_toggles"),
                            F.col("_role").alias("_new_role"))
    df = users.join(per_user, users["id"] == per_user["user_id"], "left").drop("user_id")
    base = F.when(F.coalesce("_activated", F.lit(False)), F.lit(1)).otherwise(F.col("status"))
    n = F.coalesce(F.col("_toggles"), F.lit(0))
    odd = (n % 2) == 1
    status = (
        F.when(n == 0, base)
        .when(base == 1, F.when(odd, F.lit(0)).otherwise(F.lit(1)))
        .otherwise(F.when(odd, F.lit(1)).otherwise(F.lit(0)))
    )
    cols = []
    for c in users.columns:
        if c == "status":
            cols.append(status.cast(users.schema["status"].dataType).alias("status"))
        elif c == "role":
            cols.append(F.coalesce(F.col("_new_role"), F.col("role")).alias("role"))
        else:
            cols.append(F.col(c))
    return df.select(*cols)


def account_command_outcomes(cmds: DataFrame, users: DataFrame) -> DataFrame:
    """Per command: applied or refused with the source's reply.  Role changes of an unknown account are
    reported as done there, as they update no row; only a toggle looks the account up."""
    cmds = resolve_account_targets(cmds, users)
    self_cmd = F.coalesce(F.col("actor_id") == F.col("user_id"), F.lit(False))
    cmd = F.col("command")
    known = users.select(F.col("id").alias("user_id"), F.lit(True).alias("_known"))
    df = cmds.join(known, "user_id", "left")
    sets_role = F.coalesce(cmd.startswith("set_role_"), F.lit(False))
    reason = (
        F.when(sets_role & (F.col("user_id").isNull() | (cmd == "set_role_")), rules.MSG_ROLE_DATA_MISSING)
        .when(sets_role & self_cmd, rules.MSG_OWN_ROLE)
        .when(sets_role & ~cmd.isin(*[f"set_role_{r}" for r in rules.ROLES]), rules.MSG_ROLE_UNKNOWN)
        .when((cmd == "toggle_status") & self_cmd, rules.MSG_OWN_STATUS)
        .when((cmd == "toggle_status") & F.col("_known").isNull(), rules.MSG_USER_NOT_FOUND)
        .when(cmd.isNull() | ~(sets_role | cmd.isin("toggle_status", "make_admin", "activate")),
              rules.MSG_COMMAND_UNKNOWN)
    )
    return df.select(*cmds.columns, reason.isNull().alias("applied"), reason.alias("reason"))


# ------------------------------------------------------------------ U8
def user_delete_outcomes(users: DataFrame, bookings: DataFrame, ids: DataFrame) -> DataFrame:
    counts = bookings.groupBy("user_id").agg(F.count(F.lit(1)).alias("bookings"))
    req = ids.select(F.col("id").alias("user_id")).distinct()
    known = users.select(F.col("id").alias("user_id"), F.lit(True).alias("_known"))
    df = req.join(known, "user_id", "left").join(counts, "user_id", "left")
    n = F.coalesce(F.col("bookings"), F.lit(0))
    return df.select(
        F.col("user_id").alias("id"), n.alias("bookings"),
        F.when(F.col("_known").isNull(), "not_found").when(n > 0, "refused").otherwise("deleted").alias("outcome"),
        F.when(n > 0, F.concat(F.lit(rules.MSG_USER_DELETE_REFUSED.split("{n}")[0]), n.cast("string"),
                               F.lit(rules.MSG_USER_DELETE_REFUSED.split("{n}")[1]))).alias("message"),
    )


def delete_users(users: DataFrame, bookings: DataFrame, ids: DataFrame) -> DataFrame:
    gone = user_delete_outcomes(users, bookings, ids).filter(F.col("outcome") == "deleted")
    return users.join(gone.select("id"), "id", "left_anti")


# ------------------------------------------------------------------ U9
#: rivals that one task takes one by one: a bound on its memory; more are settled value by value first
REPLAYED = 1_000_000


def _replay(id_col: str, keys: list[str]):
    """Takes requests in the order they come; gives the ids of those whose values are all free."""
    def run(batches):
        taken = [set() for _ in keys]
        for batch in batches:
            won = []
            for id_, *values in zip(*(batch.column(c).to_pylist() for c in (id_col, *keys)), strict=True):
                if not any(v in t for v, t in zip(values, taken, strict=True)):
                    won.append(id_)
                    for v, t in zip(values, taken, strict=True):
                        if v is not None:
                            t.add(v)
            yield pa.RecordBatch.from_arrays([pa.array(won, batch.schema.field(id_col).type)], [id_col])

    return run


def first_come(requests: DataFrame, id_col: str, keys: list[str], replayed: int = REPLAYED) -> DataFrame:
    """Ids of the requests that get all their key values: none of them went to an accepted request with a smaller id.

    Same as taking the requests one by one, and the rivals are: a request none of whose values another one asks
    for is accepted at once, and the others, sorted by id, are replayed by one task that holds the values taken.
    Chains of rivals may be of any length.  Only while there are more than ``replayed`` rivals, those that are first for
    every value they ask for are accepted and those that ask for a value now taken are dropped; both are
    minima per value, so a value that a third of all requests ask for is gone after one such round.
    """
    rivals = requests.select(id_col, *keys)
    text = {k for k in keys if isinstance(requests.schema[k].dataType, StringType)}
    wanted = F.lit(False)
    for k in keys:
        # equal values under the column's collation are replaced by one spelling, which is compared by its bytes below
        one = plain_text(k) if k in text else F.col(k)
        asked = requests.groupBy(F.col(k).alias(f"_v_{k}")).agg(F.count(F.lit(1)).alias(f"_n_{k}"), F.min(one).alias(f"_o_{k}"))
        rivals = rivals.join(asked.where(F.col(f"_v_{k}").isNotNull()), F.col(k) == F.col(f"_v_{k}"), "left")
        wanted = wanted | (F.coalesce(F.col(f"_n_{k}"), F.lit(0)) > 1)
    marked = materialize(rivals.select(id_col, *[F.col(f"_o_{k}").alias(k) for k in keys], wanted.alias("_rival")))
    accepted = [marked.where("NOT _rival").select(id_col)]
    rivals = marked.where("_rival").drop("_rival")
    while rivals.count() > replayed:
        for k in keys:
            first = rivals.groupBy(F.col(k).alias(f"_v_{k}")).agg(F.min(id_col).alias(f"_f_{k}"))
            rivals = rivals.join(first, F.col(k) == F.col(f"_v_{k}"), "left").drop(f"_v_{k}")
        won = F.lit(True)
        for k in keys:
            won = won & (F.col(k).isNull() | (F.col(f"_f_{k}") == F.col(id_col)))
        decided = materialize(rivals.select(id_col, *keys, won.alias("_won")))
        accepted.append(decided.where("_won").select(id_col))
        rivals = decided.where("NOT _won").drop("_won")
        for k in keys:  # values that are gone
            gone = decided.where("_won").select(F.col(k).alias("_t")).where("_t IS NOT NULL").distinct()
            rivals = rivals.join(gone, F.col(k) == F.col("_t"), "left_anti")
        rivals = materialize(rivals)
    schema = f"{id_col} {requests.schema[id_col].dataType.simpleString()}"
    accepted.append(rivals.repartitionByRange(1, id_col).sortWithinPartitions(id_col).mapInArrow(_replay(id_col, keys), schema))
    return reduce(DataFrame.unionAll, accepted)


def profile_update_outcomes(users: DataFrame, edits: DataFrame, order_col: str | None = None) -> DataFrame:
    """Each (id, username, email) edit: accepted, or refused when the new username or email (compared
    whatever the case and accents, untrimmed, as the store compares) belongs to another stored user or went to an accepted edit
    with a smaller id.  A refused edit blocks nobody.  Of several edits of one user the latest counts
    (``order_col``; without it the greatest pair of values)."""
    if order_col:
        e = latest_per_key(edits.select("id", "username", "email", order_col), "id", order_col)
    else:
        e = edits.groupBy("id").agg(F.max(F.struct("username", "email")).alias("_e")).select("id", "_e.*")
    e = e.select("id", "username", "email", store_text("username").alias("_lu"), store_text("email").alias("_le"))

    # another user already holds the name / address: holders are aggregated to one row per value
    # (min/max id), so a popular value is compared once per edit, never edit x holder pairs
    def holders(col, name):
        return users.groupBy(store_text(col).alias(name)).agg(F.min("id").alias(f"{name}_min"),
                                                          F.max("id").alias(f"{name}_max"))

    def taken_by_other(name):
        lo, hi = F.col(f"{name}_min"), F.col(f"{name}_max")
        return lo.isNotNull() & ((lo != F.col("id")) | (hi != F.col("id")))

    hu, he = holders("username", "_lu_h"), holders("email", "_le_h")
    e2 = e.join(hu, F.col("_lu") == F.col("_lu_h"), "left").join(he, F.col("_le") == F.col("_le_h"), "left") \
        .select("id", "username", "email", "_lu", "_le", (taken_by_other("_lu_h") | taken_by_other("_le_h")).alias("_held"))
    e2 = materialize(e2)  # read by the contest and by the result
    ok = first_come(e2.where("NOT _held"), "id", ["_lu", "_le"]).withColumn("_ok", F.lit(True))
    reason = (
        F.when(F.col("_held"), rules.MSG_PROFILE_HELD)
        .when(F.col("_ok").isNull(), rules.MSG_PROFILE_TAKEN_IN_BATCH)
    )
    return e2.join(ok, "id", "left").select("id", "username", "email", reason.isNull().alias("accepted"),
                                           reason.alias("reason"))


def update_profiles(users: DataFrame, edits: DataFrame, order_col: str | None = None) -> DataFrame:
    ok = profile_update_outcomes(users, edits, order_col).filter("accepted").select(
        "id", F.col("username").alias("_u"), F.col("email").alias("_e"))
    df = users.join(ok, "id", "left")
    return df.select(*[
        F.coalesce(F.col("_u"), F.col("username")).alias("username") if c == "username"
        else F.coalesce(F.col("_e"), F.col("email")).alias("email") if c == "email" else F.col(c)
        for c in users.columns
    ])
