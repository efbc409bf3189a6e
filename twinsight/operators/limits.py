"""Usage limits over a log of claims (event_id, caller, ts, cost): counters, verdicts and spend, as windows.

Every attempt counts, also a denied one. Fixed windows are calendar hours and days in UTC; rolling windows are the last
3600 and 86400 seconds. A day of all callers never meets in one task: counts and spend are summed by minute first, and
the rank or sum within the minute is added.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Caps


def global_counts(claims: DataFrame) -> DataFrame:
    """Adds global_n, the attempts of the day so far: totals of earlier minutes plus the rank within the minute."""
    c = claims.withColumns({"day_key": F.date_trunc("day", "ts"), "minute_key": F.date_trunc("minute", "ts")})
    minutes = c.groupBy("day_key", "minute_key").agg(F.count("*").alias("n"))
    before = Window.partitionBy("day_key").orderBy("minute_key").rowsBetween(Window.unboundedPreceding, -1)
    minutes = minutes.withColumn("earlier", F.coalesce(F.sum("n").over(before), F.lit(0))).select(F.col("minute_key").alias("m"), "earlier")
    within = F.row_number().over(Window.partitionBy("minute_key").orderBy("ts", "event_id"))
    met = c.withColumn("r", within).join(minutes, F.col("minute_key").eqNullSafe(F.col("m")))  # an unknown time is a day of its own
    return met.withColumn("global_n", (F.col("r") + F.col("earlier")).cast("long")).drop("r", "earlier", "day_key", "minute_key", "m")


def fixed_windows(claims: DataFrame) -> DataFrame:
    """Adds hour_n, day_n (of the caller) and global_n, each counting this attempt."""
    n = lambda unit: F.row_number().over(Window.partitionBy("caller", F.date_trunc(unit, "ts")).orderBy("ts", "event_id")).cast("long")
    return global_counts(claims).withColumn("day_n", n("day")).withColumn("hour_n", n("hour"))


def rolling_windows(claims: DataFrame) -> DataFrame:
    """Adds hour_n and day_n over the last hour and day of the caller (strictly less old), and global_n."""
    ms = claims.withColumn("ms", F.unix_millis("ts"))
    w = Window.partitionBy("caller").orderBy("ms")
    out = ms.withColumns({"hour_n": F.count("*").over(w.rangeBetween(-3_599_999, 0)), "day_n": F.count("*").over(w.rangeBetween(-86_399_999, 0))})
    return global_counts(out.drop("ms"))


def verdicts(counted: DataFrame, caps: Caps = Caps()) -> DataFrame:
    """Adds spend_before, ok, code and message, in the order spend, hour, day, global.

    A call is charged if the rates allow it; spend is the charge of the month's earlier such calls. Once it reaches the
    ceiling it never falls, so the prefix sum is exact although later calls are then denied.
    """
    hour, day, all_ = F.col("hour_n") > caps.per_caller_hour, F.col("day_n") > caps.per_caller_day, F.col("global_n") > caps.global_day
    c = counted.withColumn("charged", F.when(~(hour | day | all_), F.coalesce("cost", F.lit(0.0))).otherwise(0.0)).withColumns({f"{u}_key": F.date_trunc(u, "ts") for u in ("month", "day", "minute")})
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    minutes = c.groupBy("month_key", "day_key", "minute_key").agg(F.sum("charged").alias("sum"))
    days = minutes.groupBy("month_key", "day_key").agg(F.sum("sum").alias("sum"))
    days = days.select(F.col("day_key").alias("d"), F.coalesce(F.sum("sum").over(before("month_key").orderBy("day_key")), F.lit(0.0)).alias("days"))
    minutes = minutes.select("day_key", "minute_key", F.coalesce(F.sum("sum").over(before("day_key").orderBy("minute_key")), F.lit(0.0)).alias("minutes"))
    earlier = minutes.join(days, F.col("day_key").eqNullSafe(F.col("d"))).select(F.col("minute_key").alias("m"), (F.col("days") + F.col("minutes")).alias("earlier"))
    within = F.sum("charged").over(before("minute_key").orderBy("ts", "event_id"))
    c = c.join(earlier, F.col("minute_key").eqNullSafe(F.col("m"))).withColumn("spend_before", F.round(F.col("earlier") + F.coalesce(within, F.lit(0.0)), 6)).drop("charged", "month_key", "day_key", "minute_key", "m", "earlier")
    over = F.col("spend_before") >= caps.monthly_usd
    code = F.when(over, "BUDGET").when(hour | day, "RATE").when(all_, "BUDGET")
    message = F.when(over, "monthly budget reached").when(hour, f"rate limit: {caps.per_caller_hour}/hour").when(day, f"rate limit: {caps.per_caller_day}/day").when(all_, "daily budget reached")
    return c.withColumns({"ok": ~(over | hour | day | all_), "code": code, "message": message})


def decisions(claims: DataFrame, caps: Caps = Caps(), windows: Callable[[DataFrame], DataFrame] = fixed_windows) -> DataFrame:
    """Verdicts of claims with an ``own_key`` column: callers that bring their own key are let through, and neither counted
    nor charged (their counters and spend are null). An unknown ``own_key`` is none."""
    mine = F.coalesce(F.col("own_key"), F.lit(False))
    counted = verdicts(windows(claims.filter(~mine)), caps)
    return counted.unionByName(claims.filter(mine).withColumn("ok", F.lit(True)), allowMissingColumns=True)


def monthly_spend(charges: DataFrame) -> DataFrame:
    """(month, calls, usd) of completed calls (ts, cost)."""
    return charges.groupBy(F.date_format("ts", "yyyyMM").alias("month")).agg(F.count("*").alias("calls"), F.round(F.sum("cost"), 6).alias("usd"))


def used_on(claims: DataFrame) -> DataFrame:
    """(day, used) attempts of all callers."""
    return claims.groupBy(F.date_format("ts", "yyyyMMdd").alias("day")).agg(F.count("*").alias("used"))
