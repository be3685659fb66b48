"""Structured Streaming forms of the causal transforms; a batch over the same rows gives the same results."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kilnworks.operators.series import EVENT_TYPES


def event_time(events: DataFrame, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Watermarks need instants, not local times."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def resample(events: DataFrame, seconds: int = 3600, ts: str = "ts") -> DataFrame:
    """Means in right-closed bins (t - s, t]: times are moved by one microsecond, since windows are left-closed."""
    moved = event_time(events.withColumn("_e", F.timestamp_micros(F.unix_micros(F.col(ts).cast("timestamp")) - 1)), "_e")
    means = moved.groupBy(F.window("_e", f"{seconds} seconds").alias("_t")).agg(*[F.avg(F.when(F.col("event_type") == t, F.col("value"))).alias(t) for t in EVENT_TYPES])
    return means.select((F.unix_seconds(F.col("_t.end")) / seconds).cast("long").alias("h"), *EVENT_TYPES)


def sessions(events: DataFrame, gap: str = "2 hours", ts: str = "ts") -> DataFrame:
    """Segments of each user's events, which end after a gap."""
    s = event_time(events, ts).groupBy("user_id", F.session_window(ts, gap)).agg(F.count(F.lit(1)).alias("n"))
    return s.select("user_id", F.unix_micros(F.col("session_window.start")).alias("start_us"), F.unix_micros(F.col("session_window.end")).alias("end_us"), "n")


def first_seen(events: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    """Repeats within the watermark go."""
    return event_time(events, ts).dropDuplicatesWithinWatermark(keys)


def enrich(events: DataFrame, static: DataFrame, on: str) -> DataFrame:
    """A stream joined with a table that does not change."""
    return events.join(static, on, "left")


def asof_static(events: DataFrame, static: DataFrame, values: Sequence[str], tolerance: int, ts: str = "ts") -> DataFrame:
    """A stream with the last row of a table that does not change at or before ts, at most tolerance seconds old, and age in minutes.

    Each row of the table holds from its own time until the next one's, or until it is too old; it goes to the blocks of
    time, as long as the tolerance, that this reaches into. So the stream meets one row at most by an equi-join, and
    keeps no state. Of table rows at one time that with the largest values holds.
    """
    micros, width = F.unix_micros(F.col(ts).cast("timestamp")), tolerance * 1_000_000
    rows = static.select(micros.alias("_from"), F.struct(*values).alias("_v")).groupBy("_from").agg(F.max("_v").alias("_v"))
    rows = rows.withColumn("_block", F.floor(F.col("_from") / width).cast("long"))
    later = rows.groupBy((F.col("_block") - 1).alias("_block")).agg(F.min("_from").alias("_next"))
    following = F.coalesce(F.lead("_from").over(Window.partitionBy("_block").orderBy("_from")), F.col("_next"))
    until = F.least(F.coalesce(following, F.col("_from") + width + 1), F.col("_from") + width + 1)
    rows = rows.join(later, "_block", "left").withColumn("_until", until).select("_from", "_until", "_v", F.explode(F.array("_block", F.col("_block") + 1)).alias("_block"))
    left = events.withColumn("_us", micros).withColumn("_own", F.floor(micros / width).cast("long"))
    met = left.join(rows, (F.col("_own") == F.col("_block")) & (F.col("_us") >= F.col("_from")) & (F.col("_us") < F.col("_until")), "left")
    return met.select(*events.columns, *[F.col("_v").getField(v).alias(v) for v in values], ((F.col("_us") - F.col("_from")) / 6e7).alias("age_minutes"))


def causal_fill(events: DataFrame, limit: int = 6, ts: str = "ts", late: str = "1 hour", idle_days: int = 60, low: float = 10, high: float = 400) -> DataFrame:
    """Each user's readings with values out of low to high replaced by the last good one of at most `limit` readings before.

    State is a user's last good value and how many readings ago it was: bounded, and never looks ahead. Readings must
    come in order for each user, as from a log; within a batch they are sorted. A batch gives a user's readings in any
    number of frames, cut anywhere and in no order, so they are put together first: a task holds one user's readings of one
    batch. A user's state ends when the watermark is idle_days past its last reading.
    """

    def clean(key, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        good, age = state.get if state.exists else (None, 0)
        rows = pd.concat(list(frames)).sort_values(["us", "event_id"])
        value, place = rows["value"].to_numpy(float), np.arange(len(rows))
        at = np.maximum.accumulate(np.where((value >= low) & (value <= high), place, -1))
        ages = np.where(at >= 0, place - at, age + 1 + place)
        held = np.where(at >= 0, value[np.maximum(at, 0)], np.nan if good is None else good)
        yield pd.DataFrame({"user_id": key[0], "event_id": rows["event_id"].to_numpy(), "value": pd.array(np.where(ages <= limit, held, np.nan), dtype="Float64")})
        state.update((float(held[-1]) if at[-1] >= 0 else good, int(ages[-1])))
        state.setTimeoutTimestamp(max(int(rows["us"].max()) // 1000, state.getCurrentWatermarkMs()) + idle_days * 86_400_000)

    rows = event_time(events, ts, late).select("user_id", "event_id", F.unix_micros(ts).alias("us"), "value", ts)
    return rows.groupBy("user_id").applyInPandasWithState(clean, "user_id long, event_id long, value double", "good double, age long", "append", GroupStateTimeout.EventTimeTimeout)


RING, LEAST, TIMES, FILL = 9, 3, 6.0, 6
REPAIRED = "user_id long, event_id long, flagged boolean, value double"


class SpikeRepair(StatefulProcessor):
    """Flags readings of a user that are out of their limits or spikes, and puts the last good one in their place.

    State is a ring of the last nine readings with their distances from the rolling median, and the last good reading
    with its age; a timer clears both when the watermark is `idle_days` past the last reading.
    """

    def __init__(self, idle_days: int = 60) -> None:
        self.idle_ms = idle_days * 86_400_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ring = handle.getListState("ring", "value double, away double")
        self.good = handle.getValueState("good", "value double, age int")

    def handleInputRows(self, key, rows, timerValues):
        readings = pd.concat(list(rows)).sort_values(["us", "event_id"])
        ring = [tuple(None if x is None or x != x else float(x) for x in r) for r in self.ring.get()]
        good, age = self.good.get() if self.good.exists() else (None, 0)
        flags, values = [], []
        for value, low, high in zip(readings["value"], readings["low"], readings["high"]):
            value = None if value is None or value != value else float(value)
            ring = ring[1 - RING :]
            known = [v for v, _ in ring if v is not None] + ([] if value is None else [value])
            away = abs(value - float(np.median(known))) if value is not None and len(known) >= LEAST else None
            ring.append((value, away))
            distances = [a for _, a in ring if a is not None]
            scale = float(np.median(distances)) if len(distances) >= LEAST else None
            spike = away is not None and scale is not None and scale > 0 and away > TIMES * scale
            bad = spike or (value is not None and ((low == low and low is not None and value < low) or (high == high and high is not None and value > high)))
            if value is not None and not bad:
                good, age = value, 0
            else:
                age += 1
            flags.append(bad)
            values.append(good if good is not None and age <= FILL else None)
        self.ring.put(ring)
        self.good.update((good, age))
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(max(int(readings["us"].max()) // 1000, timerValues.getCurrentWatermarkInMs()) + self.idle_ms)
        yield pd.DataFrame({"user_id": key[0], "event_id": readings["event_id"].to_numpy(), "flagged": flags, "value": pd.array(values, dtype="Float64")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.ring.clear()
        self.good.clear()
        yield pd.DataFrame({"user_id": pd.array([], "int64"), "event_id": pd.array([], "int64"), "flagged": pd.array([], "bool"), "value": pd.array([], "float64")})

    def close(self) -> None:
        pass


#: Where streams keep more than a value for each key.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def spike_repair(events: DataFrame, limits: DataFrame, kind: str = "event_type", ts: str = "ts", late: str = "1 hour", idle_days: int = 60) -> DataFrame:
    """user_id, event_id, flagged and the repaired value of each reading, in order for each user.

    limits: `kind`, low and high, a table that does not change; kinds that it lacks have none. Set STATE_STORE before the
    stream is started. A batch over the same readings gives the same flags.
    """
    rows = event_time(events, ts, late).join(F.broadcast(limits), kind, "left").select("user_id", "event_id", F.unix_micros(ts).alias("us"), "value", "low", "high", ts)
    return rows.groupBy("user_id").transformWithStateInPandas(SpikeRepair(idle_days), REPAIRED, "Append", "EventTime")
