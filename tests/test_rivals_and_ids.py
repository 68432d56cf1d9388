"""Ordered claims without a loop over rivals, ids by a range exchange, account folds of one hot day."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from lodgelake.operators import changes as X
from lodgelake.operators.ids import assign_ids
from lodgelake.plans.registry import QUERIES

CLAIMS = "id long, _lu string, _le string"


def _replay(rows):
    names, mails, want = set(), set(), []
    for i, n, m in sorted(rows):
        if (n is None or n not in names) and (m is None or m not in mails):
            want.append(i)
            names.add(n)
            mails.add(m)
    return want


def _first_come(spark, rows, **kw):
    df = spark.createDataFrame(rows, CLAIMS).repartition(7)
    return sorted(r.id for r in X.first_come(df, "id", ["_lu", "_le"], **kw).collect())


def test_a_long_chain_takes_no_rounds(spark, monkeypatch):
    """10,000 requests of which each is the next one's rival, by name and by address in turn."""
    rows = [(i, f"n{(i + 1) // 2}", f"m{i // 2}") for i in range(10_000)]
    written = []
    real = X.materialize
    monkeypatch.setattr(X, "materialize", lambda df: (written.append(1), real(df))[1])
    got = _first_come(spark, rows)
    assert got == _replay(rows) and len(got) == 5000
    assert len(written) == 1


def test_more_rivals_than_one_task_takes(spark):
    rng = random.Random(5)
    rows = [(i, "hot" if i % 3 == 0 else f"n{rng.randrange(400)}", rng.choice([None, f"m{rng.randrange(300)}"]))
            for i in range(3000)]
    want = _replay(rows)
    for replayed in (10**6, 900, 40):
        assert _first_come(spark, rows, replayed=replayed) == want


def test_empty_and_null_claims(spark):
    assert _first_come(spark, []) == []
    assert _first_come(spark, [(3, None, None), (1, None, None), (2, None, "m"), (4, None, "m")]) == [1, 2, 3]


@pytest.mark.parametrize("name", ["append_users", "update_profiles", "append_bookings"])
def test_few_exchanges(spark, name):
    plan = QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange (?:hash|range|Single)", plan)) < 15
    assert "percentile" not in plan and "_cuts" not in plan


@pytest.mark.parametrize("buckets", [None, 1, 5, 40])
@pytest.mark.parametrize("checkpoint", [True, False])
def test_ids_follow_the_order_whatever_the_keys(spark, buckets, checkpoint):
    rng = random.Random(1)
    keys = sorted({rng.choice([rng.randrange(50), -rng.randrange(10**12), 10**15 + rng.randrange(200)]) for _ in range(900)})
    shuffled = keys[:]
    rng.shuffle(shuffled)
    df = spark.createDataFrame([(k,) for k in shuffled], "k long").repartition(6)
    stored = spark.createDataFrame([(5,), (41,)], "id long")
    out = assign_ids(df, "k", "new_id", stored, "id", num_buckets=buckets, checkpoint=checkpoint)
    got = sorted((r.k, r.new_id) for r in out.collect())
    assert got == [(k, 42 + i) for i, k in enumerate(keys)]


def test_ids_need_a_key(spark):
    with pytest.raises(ValueError, match="is null"):
        assign_ids(spark.createDataFrame([(1,), (None,)], "k long"), "k", "i")
    with pytest.raises(ValueError, match="need the key"):
        assign_ids(spark.range(3), "k", "i")
    assert assign_ids(spark.range(0).withColumnRenamed("id", "k"), "k", "i").collect() == []


def test_one_account_day_with_a_third_of_the_log(spark):
    rng = random.Random(8)
    t0 = dt.datetime(2024, 5, 1)
    kinds = ["toggle_status"] * 12 + ["activate", "make_admin", "set_role_user", "set_role_admin"]
    cmds = [(i, t0 + dt.timedelta(seconds=rng.randrange(80_000), days=0 if i % 3 else 0), rng.randrange(5),
             1 if i % 3 == 0 else rng.randrange(6), rng.choice(kinds)) for i in range(3000)]
    users = [(u, rng.randrange(2), "user") for u in range(6)]
    status, role = {u: s for u, s, _ in users}, {u: r for u, _, r in users}
    for _, _, actor, user, cmd in sorted(cmds, key=lambda c: (c[1], c[0])):
        if cmd == "activate":
            status[user] = 1
        elif cmd == "toggle_status" and actor != user:
            status[user] = 1 - status[user]
        elif cmd == "make_admin" or cmd == "set_role_admin" and actor != user:
            role[user] = "admin"
        elif cmd == "set_role_user" and actor != user:
            role[user] = "user"
    u = spark.createDataFrame(users, "id long, status int, role string")
    c = spark.createDataFrame(cmds, "seq long, ts timestamp_ntz, actor_id long, user_id long, command string")
    for slices in ((60, 86400), 3600, (1, 60, 86400)):
        got = {r.id: (r.status, r.role) for r in X.apply_account_commands(u, c.repartition(4), slices).collect()}
        assert got == {k: (status[k], role[k]) for k in status}
    plan = X.apply_account_commands(u, c)._jdf.queryExecution().executedPlan().toString()
    for spec in re.findall(r"windowspecdefinition\(([^)]*)\)", plan):
        assert re.match(r"user_id#\d+L?, _s[01]", spec) or re.match(r"user_id#\d+L?, specifiedwindowframe", spec)


def test_no_window_orders_a_whole_account(spark):
    """The window over whole accounts sees one summary a day."""
    users = spark.createDataFrame([(1, 1, "user")], "id long, status int, role string")
    c = spark.range(10).select(F.col("id").alias("seq"), F.lit(dt.datetime(2024, 1, 1)).cast("timestamp_ntz").alias("ts"),
                               F.lit(9).cast("long").alias("actor_id"), F.lit(1).cast("long").alias("user_id"),
                               F.lit("toggle_status").alias("command"))
    plan = X.apply_account_commands(users, c)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window [") >= 3
