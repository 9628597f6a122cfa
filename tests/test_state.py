"""State with a lifetime, and upserts by bucket."""

import random
from collections import Counter
from datetime import datetime, timedelta, timezone

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F
from sitewarden.operators import cache
from sitewarden.plans import catalogue
from sitewarden.streaming import events, lifetimes, upserts

DAY = datetime(2024, 1, 1, tzinfo=timezone.utc)


def stream_of(spark, folder, batches, schema):
    """One micro-batch for each list of rows, in their order."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.json(f"{folder}/in/b{k:03d}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).option("recursiveFileLookup", True).json(f"{folder}/in")


def ended(stream, folder):
    return events.run_to_end(stream, f"file://{folder}/out", f"file://{folder}/checkpoint").collect()


def at(days, hours=0):
    return DAY + timedelta(days=days, hours=hours)


SCHEMA = "url string, id long, ts timestamp, value string"


def test_a_key_expires_and_is_seen_again(spark, tmp_path):
    batches = [[("a", 1, at(0), ""), ("b", 2, at(0, 1), ""), ("a", 3, at(1), "")], [("a", 4, at(9), ""), ("c", 5, at(9), "")], [("a", 6, at(11), ""), ("b", 7, at(12), ""), ("a", 8, at(12), "")], [("z", 9, at(60), "")], [("a", 10, at(61), ""), ("b", 11, at(2), "")]]
    stream = stream_of(spark, tmp_path, batches, SCHEMA).withWatermark("ts", "2 days")
    got = sorted((r["key"], r["id"]) for r in ended(lifetimes.first_in_lifetime(stream, "url", "10 days"), tmp_path))
    # 11 is later than the watermark and left out; a and b come again after ten days of their own.
    assert got == [("a", 1), ("a", 6), ("a", 10), ("b", 2), ("b", 7), ("c", 5), ("z", 9)]


def test_changes_in_order_with_late_rows(spark, tmp_path):
    rng, rows = random.Random(3), []
    for k in range(300):
        rows.append((f"u{rng.randrange(6)}", k, at(k // 3, rng.randrange(24)), rng.choice(["x", "y", None])))
    rows.append(("end", 1000, at(400), "x"))
    # Each row arrives up to four days late: within the watermark.
    arrival = sorted(rows, key=lambda r: r[2] + timedelta(hours=random.Random(r[1]).randrange(96)))
    batches = [arrival[k : k + 25] for k in range(0, len(arrival), 25)]
    want, last = [], {}
    for url, id_, ts, value in sorted(rows, key=lambda r: (r[2], r[1])):
        if url in last and ts < last[url][1] + timedelta(days=7) and last[url][0] != value:
            want.append((url, id_, last[url][0], value))
        last[url] = (value, ts)
    stream = stream_of(spark, tmp_path, batches, SCHEMA).withWatermark("ts", "5 days")
    got = [(r["key"], r["id"], r["previous"], r["current"]) for r in ended(lifetimes.changes_in_order(stream, "url", "value", "7 days"), tmp_path)]
    assert sorted(got, key=str) == sorted(want, key=str) and len(want) > 50


class Held:
    """State of one key, as a processor sees it; counts what is asked of it."""

    def __init__(self):
        self.calls, self.timers, self.cells = Counter(), set(), {}

    def getValueState(self, name, schema):
        return Cell(self.calls, self.cells, name)

    def getMapState(self, name, key_schema, value_schema):
        return self.getValueState(name, value_schema)

    getListState = getValueState

    def registerTimer(self, ms):
        self.calls["registerTimer"] += 1
        self.timers.add(ms)

    def deleteTimer(self, ms):
        self.calls["deleteTimer"] += 1
        self.timers.discard(ms)

    def ring(self, processor, watermark):
        """Every timer that the watermark (ms) has passed, as Spark does."""

        class Times:
            getCurrentWatermarkInMs = staticmethod(lambda: watermark)

        out = []
        for ms in sorted(t for t in self.timers if t <= watermark):
            expired = type("Expired", (), {"getExpiryTimeInMs": staticmethod(lambda ms=ms: ms)})
            out += [row for table in processor.handleExpiredTimer(("u",), Times, expired) for row in table.itertuples(index=False, name=None)]
            self.deleteTimer(ms)
        return out


class Cell:
    def __init__(self, calls, cells, name):
        self.calls, self.cells, self.name = calls, cells, name

    def exists(self):
        self.calls["exists"] += 1
        return bool(self.cells.get(self.name))

    def get(self):
        self.calls["get"] += 1
        held = self.cells.get(self.name)
        self.calls["rows"] += len(held) if isinstance(held, list) else 0
        return iter(held or []) if self.name == "waiting" else held

    def keys(self):
        self.calls["keys"] += 1
        return iter(self.cells.get(self.name, {}))

    def getValue(self, key):
        self.calls["getValue"] += 1
        return self.cells[self.name][key]

    def updateValue(self, key, value):
        self.calls["updateValue"] += 1
        assert key not in self.cells.setdefault(self.name, {})
        self.cells[self.name][key] = value

    def removeKey(self, key):
        self.calls["removeKey"] += 1
        del self.cells[self.name][key]

    def update(self, value):
        self.calls["update"] += 1
        self.cells[self.name] = value

    def put(self, values):
        self.update(list(values))

    def appendList(self, values):
        self.update(self.cells.get(self.name, []) + list(values))

    def appendValue(self, value):
        self.appendList([value])

    def clear(self):
        self.calls["clear"] += 1
        self.cells.pop(self.name, None)


def test_many_events_of_a_key_are_taken_at_once():
    held, processor = Held(), lifetimes._OrderedChanges(10**15)
    processor.init(held)
    n, rng = 2000, random.Random(4)
    us = [int(DAY.timestamp()) * 10**6 + k * 1_000_000 for k in range(n)]
    values = [rng.choice(["x", "y", None]) for _ in range(n)]
    order = rng.sample(range(n), n)
    for k in range(0, n, 500):
        part = order[k : k + 500]
        frame = pd.DataFrame({"key": "u", "id": part, "at": [us[j] for j in part], "value": [values[j] for j in part]})
        frame["ts"] = pd.to_datetime(frame["at"], unit="us")
        assert not [row for table in processor.handleInputRows(("u",), iter([frame]), None) for row in table.itertuples()]
    want = [("u", k, values[k - 1], values[k]) for k in range(1, n) if values[k] != values[k - 1]]
    plain = lambda rows: [tuple(None if pd.isna(v) else v for v in r) for r in rows]
    processor.PART = 300
    cut = us[1200] // 1000
    assert plain(held.ring(processor, cut)) == [w for w in want if w[1] <= 1200]
    before = held.calls["getValue"]
    assert plain(held.ring(processor, us[1300] // 1000)) == [w for w in want if 1200 < w[1] <= 1300]
    # What waits on was parted by time, and only the first part is read.
    assert held.calls["getValue"] == before + 1
    assert plain(held.ring(processor, us[-1] // 1000)) == [w for w in want if w[1] > 1300]
    # Not a timer and a reading of all that waits for each event: one timer, and all at once.
    assert len(held.timers) == 1 and sum(held.calls.values()) < 60
    assert not held.ring(processor, us[-1] // 1000 + 10**12) and not held.timers and not held.cells


def test_changes_within_a_millisecond_and_rows_without_time(spark, tmp_path):
    us = lambda k: at(1) + timedelta(microseconds=k)
    batches = [
        [("u", 1, us(0), "x"), ("u", 2, us(400), "z"), ("u", 50, None, "q"), ("end", 100, at(1, 1), "x")],
        [("v", 3, at(1, 1), "x"), ("u", 0, us(-1500), "w")],
        [("u", 9, us(200), "y")],
        [("end", 101, at(2), "x")],
    ]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/b{k:03d}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in").withWatermark("ts", "1 hour")
    got = [(r["key"], r["id"], r["previous"], r["current"]) for r in ended(lifetimes.changes_in_order(stream, "url", "value", "7 days"), tmp_path)]
    # The watermark stands at the first event for two batches. A row behind it comes in time in the first of
    # them, as Spark leaves out what the batch before had passed; the millisecond after it isn't over.
    assert sorted(got) == [("u", 1, "w", "x"), ("u", 2, "y", "z"), ("u", 9, "x", "y")]


def test_stream_changes_ordered_ends_at_the_watermark(spark, tmp_path):
    us = lambda k: datetime(2024, 1, 1, 5) + timedelta(microseconds=k)
    hour = 3_600_000_000
    rows = [(1, us(0), 7, "view"), (6, us(100), 7, "click"), (3, us(300), 7, "view"), (4, us(702), 7, "signup"), (5, us(703), 7, "view"), (8, us(702 + hour), 9, "error"), (9, None, 7, "click")]
    table = spark.createDataFrame([(*r, 0.0, "{}") for r in rows], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    table.coalesce(1).write.parquet(f"{tmp_path}/t/events.parquet")
    got = catalogue.QUERIES["stream_changes_ordered"](spark, f"file://{tmp_path}/t")
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/t/events.parquet/*.parquet'")
    want = con.sql(f"select key, id, previous, current from ({catalogue.ORACLES['stream_changes_ordered']}) x").fetchall()
    assert sorted(tuple(r) for r in got.select("key", "id", "previous", "current").collect()) == sorted(want) and len(want) == 3


CACHE = "url string, created_at timestamp, updated_at timestamp, page_type string, content_hash string, status int"


def merge(old, new):
    """cache.upsert() on tables that have updated_at already."""
    return cache.upsert(old.drop("updated_at"), new.drop("updated_at")).select("url", "created_at", "updated_at", "page_type", "content_hash", "status")


def files(folder):
    return {p.parent.name: {x.name for x in p.parent.glob("*.parquet")} for p in folder.glob("data/bucket=*/*.parquet")}


@pytest.fixture
def table(spark, tmp_path):
    return upserts.BucketedTable(spark, f"file://{tmp_path}/t", CACHE, "url", merge, buckets=8)


def batch(spark, rows):
    return spark.createDataFrame([(u, at(d), at(d), "about", h, s) for u, d, h, s in rows], CACHE)


def state(table):
    return sorted((r["url"], r["content_hash"], r["created_at"].day) for r in table.read().collect())


def test_replays_and_untouched_buckets(spark, table, tmp_path):
    first = batch(spark, [(f"u{k}", 0, f"h{k}", 200) for k in range(40)])
    table.apply(first, 0)
    before, held = files(tmp_path / "t"), state(table)
    assert len(before) == 8 and len(held) == 40
    second = batch(spark, [("u1", 5, "new", 200), ("v", 5, "own", 200), ("u2", 5, "bad", 500)])
    table.apply(second, 1)
    after = files(tmp_path / "t")
    hit = {f"bucket={r[0]}" for r in second.where("status = 200").select(F.pmod(F.xxhash64("url"), F.lit(8))).collect()}
    allowed = hit | {f"bucket={r[0]}" for r in second.select(F.pmod(F.xxhash64("url"), F.lit(8))).collect()}
    assert {b for b in after if after[b] != before.get(b)} <= allowed and {b for b in before if b not in allowed and after[b] == before[b]}
    now = state(table)
    assert ("u1", "new", 1) in now and ("u2", "h2", 1) in now and ("v", "own", 6) in now and len(now) == 41
    table.apply(second, 1)
    table.apply(first, 0)
    assert files(tmp_path / "t") == after and state(table) == now


def test_a_lost_exchange_is_made_good(spark, table, tmp_path, monkeypatch):
    table.apply(batch(spark, [(f"u{k}", 0, "a", 200) for k in range(30)]), 0)
    second = batch(spark, [(f"u{k}", 2, "b", 200) for k in range(10)])

    def lost(staged):
        import shutil

        for p in list((tmp_path / "t/data").glob("bucket=*"))[:3]:
            shutil.rmtree(p)
        raise RuntimeError("lost")

    real = table._exchange
    monkeypatch.setattr(table, "_exchange", lost)
    with pytest.raises(RuntimeError):
        table.apply(second, 1)
    monkeypatch.setattr(table, "_exchange", real)
    table.apply(second, 1)
    # The folders that were gone are those that the batch touches or hold what they held.
    got = state(table)
    assert {x for x in got if x[1] == "b"} == {(f"u{k}", "b", 1) for k in range(10)}


def test_a_stream_of_batches_as_one_table(spark, table, tmp_path):
    rng = random.Random(2)
    rows = [[(f"u{rng.randrange(30)}", at(d), at(d), "about", rng.choice(["x", "y", None]), rng.choice([200, 200, 404])) for _ in range(12)] for d in range(6)]
    table.run(stream_of(spark, tmp_path, rows, CACHE), f"file://{tmp_path}/check")
    want = {}
    for part in rows:
        for u, c, _, _, h, s in sorted((r for r in part if r[4] and r[5] == 200), key=lambda r: (r[1], r[4])):
            want[u] = (u, h, min(c, want[u][2]) if u in want else c)
    assert state(table) == sorted((u, h, c.day) for u, h, c in want.values())
