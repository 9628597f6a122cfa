"""Streams whose state ends: first sights that are forgotten, and changes in the order of events.

Both keep one small value for each key, in the state store, and a timer that clears it, so what
is held follows the keys of a lifetime, not those of all time."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _field(name: str, kind: T.DataType) -> T.StructField:
    return T.StructField(name, kind)


def _ms(ts: pd.Series) -> list[int]:
    return [int(t.timestamp() * 1000) for t in ts]


class _FirstSeen(StatefulProcessor):
    def __init__(self, lifetime_ms: int):
        self.lifetime_ms = lifetime_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.until = handle.getValueState("until", T.StructType([_field("until", T.LongType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        table = pd.concat(list(rows)).sort_values(["ts", "id"])
        until, first = self.until.get()[0] if self.until.exists() else None, []
        old = until
        for at, (ts, id_) in zip(_ms(table["ts"]), zip(table["ts"], table["id"])):
            if until is None or at >= until:
                until = at + self.lifetime_ms
                first.append((*key, id_, ts))
        if until != old:
            if old is not None:
                self.handle.deleteTimer(old)
            self.until.update((until,))
            self.handle.registerTimer(until)
        yield pd.DataFrame(first, columns=["key", "id", "ts"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.until.clear()
        yield pd.DataFrame([], columns=["key", "id", "ts"])

    def close(self) -> None:
        pass


def first_in_lifetime(events: DataFrame, key: str, lifetime: str = "30 days", id_col: str = "id") -> DataFrame:
    """(key, id, ts): an event of each key that isn't within `lifetime` of the last one given out; then
    the key is forgotten. events has `ts` with a watermark; key is taken as text.

    A key's events of a micro-batch are taken in the order of (ts, id). Whether an event is
    within a lifetime is a matter of its own time, so it doesn't depend on when state is
    cleared; that happens once the watermark has passed the lifetime's end. Rows later than the
    watermark are left out by Spark."""
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    ms = spark.sql(f"SELECT CAST(unix_millis(TIMESTAMP '1970-01-01 00:00:00 UTC' + INTERVAL {lifetime}) AS LONG)").first()[0]
    rows = events.select(F.col(key).cast("string").alias("key"), F.col(id_col).cast("long").alias("id"), "ts")
    out = T.StructType([_field("key", T.StringType()), _field("id", T.LongType()), _field("ts", T.TimestampType())])
    return rows.groupBy("key").transformWithStateInPandas(_FirstSeen(ms), out, "append", "eventTime")


def _ceil_ms(us: int) -> int:
    return -(-us // 1000)


class _OrderedChanges(StatefulProcessor):
    """What waits is kept as columns, in parts named by their first time and a running number, so that adding
    reads nothing and only parts with something due are read. A key has one timer: the first of its
    waiting events, else the end of its last one's lifetime. Once it rings, all that is due is taken."""

    COLUMNS = ["key", "id", "previous", "current"]
    PART = 10_000

    def __init__(self, lifetime_us: int):
        self.lifetime_us = lifetime_us

    def init(self, handle) -> None:
        self.handle = handle
        # The last event taken (at is null if there is none), the timer in milliseconds and the next part's number.
        self.held = handle.getValueState("held", T.StructType([_field("value", T.StringType()), *(_field(c, T.LongType()) for c in ("at", "timer", "part"))]))
        longs = T.ArrayType(T.LongType())
        self.waiting = handle.getMapState("waiting", T.StructType([_field("first", T.LongType()), _field("part", T.LongType())]), T.StructType([_field("at", longs), _field("id", longs), _field("value", T.ArrayType(T.StringType()))]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last, last_at, timer, part = self.held.get() or (None, None, None, 0)
        first = []
        for part, table in enumerate(rows, part):
            at = table["at"].tolist()
            first.append(min(at))
            self.waiting.updateValue((first[-1], part), (at, table["id"].tolist(), [None if pd.isna(v) else v for v in table["value"]]))
        wake = _ceil_ms(min(first))
        if timer is None or wake < timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(wake)
            timer = wake
        self.held.update((last, last_at, timer, part + 1))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        last, last_at, _, part = self.held.get()
        names = list(self.waiting.keys())
        begun, later = [x for x in names if x[0] <= now], [x[0] for x in names if x[0] > now]
        parts = [self.waiting.getValue(x) for x in begun]
        at, ids = (np.array([x for p in parts for x in p[k]], dtype="int64") for k in (0, 1))
        order = np.lexsort((ids, at))
        at, ids = at[order].tolist(), ids[order].tolist()
        values = [x for p in parts for x in p[2]]
        values = [values[k] for k in order.tolist()]
        n = bisect_right(at, now)
        if begun and not later:
            self.waiting.clear()
        else:
            for x in begun:
                self.waiting.removeKey(x)
        for k in range(n, len(at), self.PART):
            later.append(at[k])
            self.waiting.updateValue((at[k], part), tuple(c[k : k + self.PART] for c in (at, ids, values)))
            part += 1
        new, new_at = (values[n - 1], at[n - 1]) if n else (last, last_at)
        if new_at is not None and now >= new_at + self.lifetime_us:
            new, new_at = None, None
        if later or new_at is not None:
            timer = _ceil_ms(min(later) if later else new_at + self.lifetime_us)
            self.handle.registerTimer(timer)
            self.held.update((new, new_at, timer, part if later else 0))
        else:
            self.held.clear()
        out = []
        for at_, id_, value in zip(at[:n], ids, values):
            if last_at is not None and at_ < last_at + self.lifetime_us and last != value:
                out.append((*key, id_, last, value))
                if len(out) == self.PART:
                    yield pd.DataFrame(out, columns=self.COLUMNS)
                    out = []
            last, last_at = value, at_
        if out:
            yield pd.DataFrame(out, columns=self.COLUMNS)

    def close(self) -> None:
        pass


def changes_in_order(rows: DataFrame, key: str, value: str, lifetime: str = "365 days", id_col: str = "id") -> DataFrame:
    """(key, id, previous, current): a row whenever a key's value differs from that of the event before
    it, if that is less than `lifetime` older. rows has `ts` with a watermark.

    Events wait until the watermark, in whole milliseconds, has passed them and are then taken in the
    order of (ts, id), to the microsecond, so late ones, within the watermark, are where they
    belong, however they are spread over micro-batches. Those without ts are left out. What waits is
    bounded by the watermark's delay, what stays by the keys of a lifetime. A key's events that fall due in
    one micro-batch are in memory together."""
    spark = rows.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    us = spark.sql(f"SELECT CAST(unix_micros(TIMESTAMP '1970-01-01 00:00:00 UTC' + INTERVAL {lifetime}) AS LONG)").first()[0]
    some = rows.where("ts is not null").select(F.col(key).cast("string").alias("key"), F.col(id_col).cast("long").alias("id"), "ts", F.unix_micros("ts").alias("at"), F.col(value).cast("string").alias("value"))
    out = T.StructType([_field("key", T.StringType()), _field("id", T.LongType()), _field("previous", T.StringType()), _field("current", T.StringType())])
    return some.groupBy("key").transformWithStateInPandas(_OrderedChanges(us), out, "append", "eventTime")
