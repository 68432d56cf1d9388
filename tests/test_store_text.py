"""Keys compare text as the store's collation does: blind to case and accents, in joins, groups, filters and replays."""

import random
import unicodedata

import duckdb
from pyspark.sql import functions as F

from conftest import AS_OF, rows
from lodgelake.functions.columns import store_text
from lodgelake.operators import accounts as A
from lodgelake.operators import changes as X
from lodgelake.operators import quality as Q


def test_letters_equal_their_base_letter(spark):
    letters = [chr(c) for c in range(0xC0, 0x180) if len(unicodedata.normalize("NFD", chr(c))) > 1]
    pairs = [(x, unicodedata.normalize("NFD", x)[0].lower()) for x in letters]
    df = spark.createDataFrame(pairs, "a string, b string")
    assert len(pairs) > 100 and df.where(store_text("a") == F.col("b")).count() == len(pairs)
    con = duckdb.connect()
    assert all(con.execute("SELECT ? COLLATE NOCASE.NOACCENT = ?", p).fetchone()[0] for p in pairs)
    apart = spark.createDataFrame([("a", "b"), ("a", "a "), ("", " "), ("jose", "jose1")], "a string, b string")
    assert apart.where(store_text("a") == F.col("b")).isEmpty()


def test_registrations_by_a_replay(spark):
    rng = random.Random(4)
    forms = ["josé", "JOSE", "Zoë", "zoe", "ann", "ÁNN", "bob", "müller", "Muller", "MÜLLER"]
    asked = [(i, rng.choice(forms) + str(rng.randrange(12)), rng.choice(forms) + f"@{rng.randrange(12)}.de") for i in range(200)]
    stored = [(1, "JOSÉ3", "a@b.c"), (2, "x", "ZOÉ@1.de")]

    def fold(s):
        return "".join(c for c in unicodedata.normalize("NFD", s.lower()) if not unicodedata.combining(c))

    names, mails, want = {fold(u) for _, u, _ in stored}, {fold(e) for _, _, e in stored}, set()
    for i, u, e in asked:
        if fold(u) not in names and fold(e) not in mails:
            want.add(i)
            names.add(fold(u))
            mails.add(fold(e))
    users = spark.createDataFrame(stored, "id long, username string, email string").withColumn("created_at", F.lit(None).cast("timestamp_ntz")) \
        .withColumn("last_login", F.col("created_at")).withColumn("role", F.lit("user")).withColumn("status", F.lit(1))
    requests = spark.createDataFrame(asked, "request_id long, username string, email string").repartition(4)
    out = A.registration_outcomes(requests, users)
    assert {r[0] for r in rows(out.where("registered"), "request_id")} == want and out.count() == 200
    assert A.register_users(requests, users, AS_OF).count() == len(want)
    # value by value, as with more rivals than one task replays
    keys = requests.select("request_id", store_text("username").alias("u"), store_text("email").alias("e"))
    one = rows(X.first_come(keys, "request_id", ["u", "e"]), "request_id")
    assert one == rows(X.first_come(keys, "request_id", ["u", "e"], replayed=5), "request_id")


def test_null_keys_and_results_stay_plain(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "É"), (4, "e")], "id long, username string")
    d = Q.duplicate_keys(df, ["username"])
    assert {tuple(r) for r in d.collect()} == {("e", 2), (None, 2)}
    assert d.schema["username"].dataType.simpleString() == "string"
    edits = spark.createDataFrame([(3, "ê", None)], "id long, username string, email string")
    users = df.withColumn("email", F.lit(None).cast("string"))
    out = X.profile_update_outcomes(users, edits)
    assert rows(out, "id", "accepted") == [(3, False)] and "collate" not in out.schema.simpleString()


def test_accented_keys_are_hashed(spark):
    """No nested loops: the collated keys are joined and exchanged by their hash or order."""
    users = spark.range(1000).select("id", F.concat(F.lit("Zoë"), F.col("id").cast("string")).alias("email"))
    cmds = spark.range(1000).select(F.col("id").alias("seq"), F.concat(F.lit("ZOE"), F.col("id").cast("string")).alias("email"))
    out = X.resolve_account_targets(cmds, users)
    assert out.where("user_id = seq").count() == 1000
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
