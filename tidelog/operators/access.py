"""Roles, permissions and the decision whether an action is allowed."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Actions by bit, roles by bit, and what each role may do; fixed values.
ACTIONS = {"read": 1, "write": 2, "iread": 4, "transfer": 8, "accept": 16, "truncate": 32, "stat": 64, "user": 128, "pass": 256}
ROLES = {"reader": 1, "writer": 2, "admin": 8, "instance": 16}
ALLOWED = {"reader": ("read", "pass"), "writer": ("write", "pass"), "admin": ("read", "truncate", "stat", "user", "pass"), "instance": tuple(ACTIONS)}
ANONYMOUS, ADMIN = "all", "admin"


def actions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(ACTIONS.items()), "action string, bit int")


def roles(spark: SparkSession) -> DataFrame:
    """role, role_bit, permissions."""
    return spark.createDataFrame([(r, b, sum(ACTIONS[a] for a in ALLOWED[r])) for r, b in ROLES.items()], "role string, role_bit int, permissions int")


def role_mask(names: Iterable[str]) -> int:
    """Unknown names are ignored."""
    return sum(ROLES[n] for n in {*names} if n in ROLES)


def users(spark: SparkSession, rows: Iterable[tuple[str, Iterable[str], str]]) -> DataFrame:
    """user, roles, password_hash (hex, null without a password) of (name, roles, password)."""
    made = spark.createDataFrame([(u, role_mask(r), p) for u, r, p in rows], "user string, roles int, password string")
    return made.select("user", "roles", F.when(F.col("password") != "", F.sha1("password")).alias("password_hash"))


def permissions(spark: SparkSession, users_: DataFrame) -> DataFrame:
    """user, permissions: the union over the user's roles."""
    held = users_.join(F.broadcast(roles(spark)), F.col("roles").bitwiseAND(F.col("role_bit")) != 0, "left")  # four roles
    return held.groupBy("user").agg(F.coalesce(F.bit_or("permissions"), F.lit(0)).alias("permissions"))


def decide(spark: SparkSession, requests: DataFrame, users_: DataFrame) -> DataFrame:
    """``requests`` (user, password, action, ...) with ``allowed``.

    An unknown user is denied.  A password is compared unless the user has
    none and none is given.  The anonymous user may never set a password.  An
    action without a permission bit is open to every known user.
    """
    known = users_.join(permissions(spark, users_), "user").select(F.col("user").alias("_user"), "password_hash", "permissions")
    bits = actions(spark).select(F.col("action").alias("_action"), "bit")
    rows = requests.join(known, F.col("user") == F.col("_user"), "left").join(F.broadcast(bits), F.col("action") == F.col("_action"), "left")  # nine actions
    checked = (F.col("password") != "") | F.col("password_hash").isNotNull()
    fits = ~checked | F.coalesce(F.sha1("password") == F.col("password_hash"), F.lit(False))
    barred = (F.col("user") == ANONYMOUS) & (F.col("action") == "pass")
    may = F.col("bit").isNull() | (F.col("permissions").bitwiseAND(F.col("bit")) != 0)
    return rows.withColumn("allowed", F.col("_user").isNotNull() & fits & ~barred & may).select(*requests.columns, "allowed")


def set_roles(users_: DataFrame, user: str, names: Iterable[str]) -> DataFrame:
    return _put(users_, user, roles=F.lit(role_mask(names)))


def set_password(users_: DataFrame, user: str, password: str) -> DataFrame:
    return _put(users_, user, password_hash=F.sha1(F.lit(password)) if password else F.lit(None).cast("string"))


def delete_user(users_: DataFrame, user: str) -> DataFrame:
    """The two default users stay."""
    return users_ if user in (ADMIN, ANONYMOUS) else users_.where(F.col("user") != user)


def _put(users_: DataFrame, user: str, **values: Column) -> DataFrame:
    named = users_.sparkSession.range(1).select(F.lit(user).alias("_u"))
    joined = users_.join(named, F.col("user") == F.col("_u"), "full_outer")
    old = {"user": F.coalesce("user", "_u"), "roles": F.coalesce("roles", F.lit(0)), "password_hash": F.col("password_hash")}
    return joined.select(*[(F.when(F.col("_u").isNotNull(), values[c]).otherwise(old[c]) if c in values else old[c]).alias(c) for c in old])
