"""Identity lookup, new-account validation and append, account labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodgelake.functions import rules
from lodgelake.functions.columns import day_fmt, first_present, iso_day, store_text, ts_lit
from lodgelake.operators.changes import first_come
from lodgelake.operators.ids import assign_ids
from lodgelake.session import materialize

PROFILE_COLUMNS = ["id", "username", "email", "created_at", "last_login", "role", "status"]


# ------------------------------------------------------------------ U4
def resolve_identity(ids: DataFrame, users: DataFrame, identifier: str = "identifier") -> DataFrame:
    """Match each identifier to users by username OR email (whatever the case and accents, as the store compares).

    The disjunctive join is two equi-joins (each a hash join on one key) unioned
    and de-duplicated, instead of a nested-loop join on an OR condition.
    """
    key = store_text(F.trim(F.col(identifier)))
    req = ids.select(F.col(identifier).alias("identifier"), key.alias("_k")).dropDuplicates(["identifier"])
    prof = users.select(*PROFILE_COLUMNS)
    by_name = req.join(prof.withColumn("_k", store_text("username")), "_k")
    by_mail = req.join(prof.withColumn("_k", store_text("email")), "_k")
    return by_name.unionByName(by_mail).drop("_k").dropDuplicates(["identifier", "id"])


def user_profiles(users: DataFrame) -> DataFrame:
    return users.select(*PROFILE_COLUMNS)


# ------------------------------------------------------------------ U5
def validate_new_users(new: DataFrame, users: DataFrame) -> DataFrame:
    """Trim / lower the request, collect every failed rule's message (joined by spaces)."""
    r = new.select(
        "request_id",
        F.trim(F.coalesce(F.col("username"), F.lit(""))).alias("username"),
        F.lower(F.trim(F.coalesce(F.col("email"), F.lit("")))).alias("email"),
        F.coalesce(F.col("role"), F.lit("user")).alias("role"),
    )
    # existing names and addresses, one row per value, so each request meets at most one of each
    names = users.select(store_text("username").alias("_lu"), F.lit(True).alias("_taken_u")).distinct()
    mails = users.select(store_text("email").alias("_le"), F.lit(True).alias("_taken_e")).distinct()
    df = (
        r.join(names, store_text(r["username"]) == names["_lu"], "left")
        .join(mails, store_text(r["email"]) == mails["_le"], "left")
        .withColumn("_taken", F.when(F.col("_taken_u") | F.col("_taken_e"), F.lit(True)))
    )
    u, e = F.col("username"), F.col("email")
    ulen = F.length(u)
    errors = F.array_compact(F.array(
        F.when(u == "", F.lit(rules.MSG_USERNAME_REQUIRED))
        .when((ulen < rules.USERNAME_MIN) | (ulen > rules.USERNAME_MAX), F.lit(rules.MSG_USERNAME_LENGTH)),
        F.when(e == "", F.lit(rules.MSG_EMAIL_REQUIRED))
        .when(~e.contains("@") | ~e.contains("."), F.lit(rules.MSG_EMAIL_FORMAT)),
        F.when(~F.col("role").isin(*rules.ROLES), F.lit(rules.MSG_ROLE_INVALID)),
        F.when(F.col("_taken").isNotNull(), F.lit(rules.MSG_TAKEN)),
    ))
    return df.select(
        "request_id", "username", "email", "role",
        (F.size(errors) == 0).alias("valid"),
        F.when(F.size(errors) > 0, F.array_join(errors, " ")).alias("message"),
    )


# ------------------------------------------------------------------ U6
def append_users(checked: DataFrame, users: DataFrame, as_of, status: int = 1, role: str | None = None,
                 checkpoint: bool = True) -> DataFrame:
    """Valid requests as new accounts, taken one after the other by request_id: a request whose username or email
    went to an accepted one before it is left out; a request left out blocks nobody.

    Self-registration is ``role="user", status=1``; the admin form passes each request's own role
    (``role=None``) and the chosen status."""
    v = materialize(checked.filter("valid"))  # read by the contest and by the result
    won = first_come(v.select("request_id", store_text("username").alias("_lu"), store_text("email").alias("_le")),
                     "request_id", ["_lu", "_le"])
    winners = v.join(won, "request_id", "left_semi").select("request_id", "username", "email", "role")
    rows = winners.select(
        "request_id", "username", "email",
        ts_lit(as_of).alias("created_at"), F.lit(None).cast("timestamp_ntz").alias("last_login"),
        F.lit(role).alias("role") if role else F.col("role"), F.lit(status).alias("status"),
    )
    return assign_ids(rows, "request_id", "id", users, "id", checkpoint=checkpoint).select(
        *PROFILE_COLUMNS, "request_id")


def registration_outcomes(requests: DataFrame, users: DataFrame) -> DataFrame:
    """Self-registration, one after the other by request_id: refused where the email or the username, as typed but for the
    case and accents, belongs to a stored account or to one registered before it.  Nothing else is checked there."""
    r = requests.select("request_id", "username", "email", store_text("username").alias("_lu"), store_text("email").alias("_le"))
    names = users.select(store_text("username").alias("_lu"), F.lit(True).alias("_u")).distinct()
    mails = users.select(store_text("email").alias("_le"), F.lit(True).alias("_e")).distinct()
    r = r.join(names, "_lu", "left").join(mails, "_le", "left")
    r = materialize(r.withColumn("_held", F.coalesce(F.col("_u"), F.col("_e"), F.lit(False))).drop("_u", "_e"))
    won = first_come(r.where("NOT _held"), "request_id", ["_lu", "_le"]).withColumn("_won", F.lit(True))
    registered = F.coalesce("_won", F.lit(False))
    return r.join(won, "request_id", "left").select(
        "request_id", "username", "email", registered.alias("registered"),
        F.when(~registered, F.lit(rules.MSG_ACCOUNT_EXISTS)).alias("message"))


def register_users(requests: DataFrame, users: DataFrame, as_of) -> DataFrame:
    """Registered requests as new accounts: role 'user', status 1, ids after the stored ones in order of request_id."""
    rows = registration_outcomes(requests, users).where("registered").select(
        "request_id", "username", "email", ts_lit(as_of).alias("created_at"),
        F.lit(None).cast("timestamp_ntz").alias("last_login"), F.lit("user").alias("role"), F.lit(1).alias("status"))
    return assign_ids(rows, "request_id", "id", users, "id").select(*PROFILE_COLUMNS, "request_id")


# ------------------------------------------------------------------ U10
def user_labels(users: DataFrame) -> DataFrame:
    name = first_present("username")
    initial = F.when(F.coalesce(F.col("username"), F.lit("")) != "", F.upper(F.substring("username", 1, 1))) \
        .otherwise(F.lit("U"))
    return users.select(
        "id",
        name.alias("name_label"),
        first_present("email").alias("email_label"),
        F.when(F.col("role") == "admin", "Administrator").otherwise("Standard User").alias("role_label"),
        F.when(F.col("status") == 1, "Active").otherwise("Inactive").alias("status_label"),
        F.coalesce(iso_day("created_at"), F.lit("N/A")).alias("joined"),
        F.coalesce(day_fmt("created_at"), F.lit(rules.MEMBER_SINCE_UNKNOWN)).alias("member_since"),
        initial.alias("initial"),
    )
