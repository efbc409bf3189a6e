"""Usage limits on a stream of claims (event_id, caller, ts, cost)."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import Caps

OUT = "event_id long, caller string, ts timestamp, hour_n long, day_n long, ok boolean, code string"
STATE = "hours string, days string"


def window_counts(claims: DataFrame, late: str = "1 day") -> DataFrame:
    """(window, caller, attempts) of calendar hours, with a watermark so that closed windows leave the state."""
    return claims.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "caller").agg(F.count("*").alias("attempts"))


def day_counts(claims: DataFrame, late: str = "1 day") -> DataFrame:
    """(window, attempts) of all callers by calendar day: the global counter, pre-summed where claims arrive."""
    return claims.withWatermark("ts", late).groupBy(F.window("ts", "1 day")).agg(F.count("*").alias("attempts"))


def decide(claims: DataFrame, caps: Caps = Caps(), late: str = "1 day") -> DataFrame:
    """A decision for every claim as it comes: attempts of its caller in the calendar hour and day, this one included.

    State has a count for every hour and day of a caller that the watermark has not closed, so a late claim counts in its
    own hour and takes nothing from a later one. Within a batch claims are taken in time order; state expires two days
    after a caller's last claim. The day's counter of all callers is :func:`day_counts`, a stream of its own.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        hours, days = ({int(k): n for k, n in json.loads(x).items()} for x in (state.get if state.exists else ("{}", "{}")))
        rows = pd.concat(list(parts)).sort_values(["ts", "event_id"], kind="stable")
        out = []
        for e, ts in zip(rows["event_id"], rows["ts"], strict=True):
            s = int(ts.timestamp())
            hour, day = s // 3600, s // 86400
            hours[hour], days[day] = hours.get(hour, 0) + 1, days.get(day, 0) + 1
            ok = hours[hour] <= caps.per_caller_hour and days[day] <= caps.per_caller_day
            out.append((e, key[0], ts, hours[hour], days[day], ok, None if ok else "RATE"))
        closed = (state.getCurrentWatermarkMs() or 0) // 1000
        hours, days = ({k: n for k, n in x.items() if (k + 1) * unit > closed} for x, unit in ((hours, 3600), (days, 86400)))
        state.update((json.dumps(hours), json.dumps(days)))
        state.setTimeoutTimestamp(max(int(rows["ts"].max().timestamp() * 1000), state.getCurrentWatermarkMs() or 0) + 172_800_000)
        yield pd.DataFrame(out, columns=["event_id", "caller", "ts", "hour_n", "day_n", "ok", "code"])

    rows = claims.select("event_id", F.col("caller").cast("string").alias("caller"), "ts").withWatermark("ts", late)
    return rows.groupBy("caller").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
