"""Login lockout rules over a log of attempts: username, ip, success (0 or 1), created_at.

Streaks come from an aggregate of each key's last success joined with its failures, not
from a window over the key, so one busy key doesn't meet in one task unreduced."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EPOCH = "1970-01-01"


def failures_since_success(attempts: DataFrame, key: str) -> DataFrame:
    """Failures strictly later than the key's last success."""
    last = attempts.where("success = 1").groupBy(key).agg(F.max("created_at").alias("last_success"))
    return attempts.where("success = 0").join(last, key, "left").where(F.col("created_at") > F.coalesce("last_success", F.lit(EPOCH).cast("timestamp")))


def streaks(attempts: DataFrame, key: str, least: int) -> DataFrame:
    """key, fail_count and first_failure of the streaks of at least so many failures."""
    return failures_since_success(attempts, key).groupBy(key).agg(F.count("*").alias("fail_count"), F.min("created_at").alias("first_failure")).where(F.col("fail_count") >= least)


def daily_failures(attempts: DataFrame, day: str, least: int, key: str = "username") -> DataFrame:
    """key and fail_count in the half-open UTC day."""
    low = F.lit(day).cast("timestamp")
    inside = (F.col("created_at") >= low) & (F.col("created_at") < low + F.expr("interval 1 day"))
    return attempts.where((F.col("success") == 0) & inside).groupBy(key).agg(F.count("*").alias("fail_count")).where(F.col("fail_count") >= least)


def nth_recent_failure(attempts: DataFrame, key: str, n: int) -> DataFrame:
    """key and the time of the n-th most recent failure, of all failures."""
    w = Window.partitionBy(key).orderBy(F.desc("created_at"))
    return attempts.where("success = 0").select(key, "created_at", F.row_number().over(w).alias("n")).where(F.col("n") == n).select(key, F.col("created_at").alias("nth_failure"))


def active_bans(attempts: DataFrame, manual: DataFrame, as_of: str, streak: int = 10, daily: int = 50, per_ip: int = 100) -> DataFrame:
    """type, username, ip, fail_count and unlocks_at of the bans that hold at as_of.

    manual: username, ip, unlocks_at. A user's streak locks for an hour from its first
    failure, a day's failures until midnight, an ip's streak for ten days from its
    per_ip-th most recent failure."""
    now = F.lit(as_of).cast("timestamp")
    none = F.lit(None).cast("string")
    by_hand = manual.where(F.col("unlocks_at") > now).select(
        F.when(F.col("username") != "", "manual_user").otherwise("manual_ip").alias("type"), "username", "ip", F.lit(None).cast("long").alias("fail_count"), "unlocks_at"
    )
    user = streaks(attempts, "username", streak).withColumn("unlocks_at", F.col("first_failure") + F.expr("interval 1 hour")).where(F.col("unlocks_at") > now)
    user = user.select(F.lit("user_consecutive").alias("type"), "username", none.alias("ip"), "fail_count", "unlocks_at")
    tomorrow = F.date_trunc("day", now) + F.expr("interval 1 day")
    day = daily_failures(attempts, as_of[:10], daily).select(F.lit("user_daily").alias("type"), "username", none.alias("ip"), "fail_count", tomorrow.alias("unlocks_at"))
    ip = streaks(attempts, "ip", per_ip).join(nth_recent_failure(attempts, "ip", per_ip), "ip").withColumn("unlocks_at", F.col("nth_failure") + F.expr("interval 10 days")).where(F.col("unlocks_at") > now)
    ip = ip.select(F.lit("ip").alias("type"), none.alias("username"), "ip", "fail_count", "unlocks_at")
    return by_hand.unionByName(user).unionByName(day).unionByName(ip)


def unban(attempts: DataFrame, manual: DataFrame, who: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame]:
    """attempts and manual bans after lifting those of who (username or ip, the other empty).

    Manual bans of either go, and a success at as_of ends the running streak."""
    left = manual
    for key in ("username", "ip"):
        left = left.join(who.where(F.col(key) != "").select(key).distinct(), key, "left_anti")
    marks = who.select("username", "ip", F.lit(1).alias("success"), F.lit(as_of).cast("timestamp").alias("created_at"))
    return attempts.unionByName(marks), left.select(*manual.columns)


def banned(manual: DataFrame, who: DataFrame, as_of: str) -> DataFrame:
    """who (username, ip) with unlocks_at, the last of the bans by either that hold at as_of.

    Two equi-joins take the place of the disjunction."""
    live = manual.where(F.col("unlocks_at") > F.lit(as_of).cast("timestamp"))
    hits = [who.join(live.where(F.col(key) != "").select(key, "unlocks_at"), key).select("username", "ip", "unlocks_at") for key in ("username", "ip")]
    return hits[0].unionByName(hits[1]).groupBy("username", "ip").agg(F.max("unlocks_at").alias("unlocks_at"))


def attempts_of(events: DataFrame) -> DataFrame:
    """Attempts in an event log: errors fail, sign-ups and purchases succeed."""
    kind = F.when(F.col("event_type") == "error", 0).when(F.col("event_type").isin("signup", "purchase"), 1)
    made = events.select(F.col("user_id").cast("string").alias("username"), F.concat(F.lit("10.0.0."), (F.col("user_id") % 20).cast("string")).alias("ip"), kind.alias("success"), F.col("ts").cast("timestamp").alias("created_at"))
    return made.where("success is not null")
