"""Stateful streams: late rows, times on the watermark itself, series that come back, parts of a minute."""

import datetime
import random
from types import SimpleNamespace

import pandas as pd
from pyspark.sql import functions as F

from evalspark.session import work_dir
from evalspark.streaming import alerts

START = 1_700_000_000  # a full minute is at 1_699_999_980


def stream_of(spark, batches, columns, **options):
    """Each batch of (microseconds, ...) rows is a file; files are read one a trigger."""
    path = work_dir(spark, "batches")
    for batch in batches:
        rows = [(datetime.datetime.fromtimestamp(0, datetime.timezone.utc) + datetime.timedelta(microseconds=r[0]), *r[1:]) for r in batch]
        spark.createDataFrame(rows, f"ts timestamp, {columns}").coalesce(1).write.mode("append").parquet(path)
    return alerts.event_stream(spark, path, one_file=True, **options)


def us(seconds, more=0):
    return (START + seconds) * 1_000_000 + more


def test_steps_and_late_rows(spark):
    """Steps follow event time over batches; what comes behind the watermark is named, not lost and not used."""
    batches = [
        [(us(0), "a", 1, 10.0), (us(30), "a", 3, 30.0), (us(20), "a", 2, 25.0)],
        [(us(10), "a", 4, 15.0), (us(2_000), "a", 5, 100.0), (us(5), "b", 6, 1.0)],
        [(us(1_399), "a", 7, 50.0), (us(1_401), "a", 8, 60.0), (us(1_400), "a", 9, 55.0), (us(3), "b", 10, 0.5), (us(4_000), "c", 11, 0.0)],
        [(us(6_000), "c", 12, 4.0), (us(3_400, 1), "b", 13, 7.0), (us(5_000), "d", 14, 1.0), (us(5_400), "d", 15, 3.0), (us(5_400, 1), "d", 16, 5.0)]]
    samples = stream_of(spark, batches, "name string, id long, v double")
    table = alerts.run_to_table(alerts.counter_steps_stream(samples, "name", "v", "id"), "steps")
    steps = {(r["name"], round(r.ts.replace(tzinfo=datetime.timezone.utc).timestamp()) - START, r.step) for r in alerts.on_time(table).collect()}
    # the watermark is 1,400 s when the third batch comes and 3,400 s for the last
    assert steps == {("a", 10, 5.0), ("a", 20, 10.0), ("a", 30, 5.0), ("a", 1_401, 30.0), ("a", 2_000, 40.0), ("b", 3_400, 6.0), ("d", 5_400, 2.0)}
    late = {(r["name"], r.late, r.first_us, r.last_us) for r in alerts.late_rows(table, "name").collect()}
    assert late == {("a", 2, us(1_399), us(1_400)), ("b", 1, us(3), us(3))}


def test_hold_fires_by_time_alone(spark):
    """A condition that stays silent after it began fires when the watermark passes its time, once."""
    batches = [
        [(us(0), "x", 1, True), (us(0), "y", 2, True), (us(50), "y", 3, False)],
        [(us(2_000), "z", 4, False)], [(us(2_100), "z", 5, True), (us(2_050), "x", 6, True)], [(us(9_000), "z", 7, False)]]
    samples = stream_of(spark, batches, "name string, id long, hot boolean")
    table = alerts.on_time(alerts.run_to_table(alerts.hold_for_stream(samples, "name", "hot", 300, "id"), "hold"))
    assert {tuple(r) for r in table.collect()} == {("x", us(0), us(300)), ("z", us(2_100), us(2_400))}


def test_many_batches_in_one_minute(spark):
    """Parts of a minute from many batches are put in order before they are used."""
    batches = [[(us(15 + (3 * i) % 8, i), "s", i, float((3 * i) % 8))] for i in range(8)] + [[(us(3_000), "t", 99, 0.0)]]
    table = alerts.run_to_table(alerts.counter_steps_stream(stream_of(spark, batches, "name string, id long, v double"), "name", "v", "id"), "parts")
    assert [r.step for r in alerts.on_time(table).orderBy("ts").collect()] == [1.0] * 7


def test_trace_ends(spark):
    """A graded end is out with the batch that completes it; an ungraded one once no grade can come."""
    batches = [
        [(us(0), 1, "trace_end", 1, 0.5), (us(10), 2, "grading_result", 2, 0.9)],
        [(us(100), 2, "trace_end", 3, 0.1), (us(200), 1, "tool", 4, 0.0), (us(200), 3, "tool", 5, 0.0)],
        [(us(300), 1, "grading_result", 6, 0.7), (us(310), 1, "grading_result", 7, 0.8), (us(400), 4, "trace_end", 8, 0.3)],
        [(us(9_000), 5, "trace_end", 9, 0.2), (us(9_000), 6, "grading_result", 10, 0.2)], [(us(9_900), 7, "trace_end", 11, 0.2), (us(9_900), 7, "grading_result", 12, 0.4)]]
    events = stream_of(spark, batches, "trace_id long, type string, line_no long, score double", delay=None)
    table = alerts.run_to_table(alerts.trace_ends(events), "ends")
    pairs = {(r.trace_id, r.end_line, r.grade_line, r.score, r.graded) for r in table.collect()}
    assert pairs == {(1, 1, 6, 0.7, True), (1, 1, 7, 0.8, True), (2, 3, 2, 0.9, True), (4, 8, None, 0.3, False), (7, 11, 12, 0.4, True)}
    assert {(r.trace_id, r.score, r.graded) for r in alerts.last_grades(table).collect()} == {(1, 0.8, True), (2, 0.9, True), (4, 0.3, False), (7, 0.4, True)}


class Store:
    """A state store of one bucket in memory, with the number of calls it had."""

    def __init__(self):
        self.calls, self.timers = 0, set()

    def getValueState(self, name, ddl):  # noqa: N802
        return Value(self)

    def getMapState(self, name, key, ddl):  # noqa: N802
        return Value(self)

    def registerTimer(self, at):  # noqa: N802
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):  # noqa: N802
        self.calls += 1
        self.timers.discard(at)


class Value:
    def __init__(self, store):
        self.store, self.held = store, {}

    def _call(self, f, *at):
        self.store.calls += 1
        return f(*at)

    def get(self):
        return self._call(self.held.get, None)

    def update(self, value):
        self._call(self.held.__setitem__, None, value)

    def getValue(self, key):  # noqa: N802
        return self._call(self.held.get, key)

    def updateValue(self, key, value):  # noqa: N802
        self._call(self.held.__setitem__, key, value)

    def removeKey(self, key):  # noqa: N802
        self._call(self.held.pop, key)


def run_bucket(batches):
    """Steps of a counter in one bucket, batch by batch; the watermark is ten seconds behind."""
    def step(last, row):
        return (row[2],), [] if last is None else [(row[0], row[2] - last[0])]

    store, mark, out = Store(), 0, []
    processor = alerts._EventTime("name", ["id", "v"], ["long", "double"], "us long, step double", "_last double", step, None)
    processor.init(store)
    for rows in [*batches, []]:
        times = SimpleNamespace(getCurrentWatermarkInMs=lambda: mark // 1000)
        if rows:
            frame = pd.DataFrame(rows, columns=["us", "id", "v", "name"])
            out += processor.handleInputRows((0,), iter([frame]), times)
        for at in [t for t in sorted(store.timers) if t <= mark // 1000]:
            out += processor.handleExpiredTimer((0,), times, None)
            store.timers.discard(at)
        mark = max([mark, *(r[0] - 10_000_000 for r in rows)])
    table = pd.concat(out)
    return store, mark, table[table[alerts.LATE].isna()], table[table[alerts.LATE].notna()]


def test_many_series_share_calls_to_the_state(monkeypatch):
    """A thousand series of a bucket take a few calls a batch, and every series keeps its own order, in chunks of any size."""
    rng = random.Random(5)
    batches = [[(20_000_000 * b + rng.randrange(18_000_000), 1000 * b + i, float(rng.randrange(50)), f"s{rng.randrange(1000)}") for i in range(1000)] for b in range(6)]
    tables = []
    for chunk in (4096, 7):
        monkeypatch.setattr(alerts, "CHUNK", chunk)
        store, mark, steps, late = run_bucket(batches)
        assert chunk < 4096 or store.calls < 100
        assert len(store.timers) <= 1 and not len(late)
        tables.append(sorted(zip(steps["name"], steps["us"], steps["step"])))
    last, wanted = {}, []
    for us_, _, v, name in sorted(r for rows in batches for r in rows):
        if us_ <= mark:
            wanted += [(name, us_, v - last[name])] if name in last else []
            last[name] = v
    assert tables == [sorted(wanted)] * 2


def test_null_series_is_a_series(spark):
    """Keys keep their type and a null key is a series of its own."""
    batches = [[(us(0), None, 1, 1.0), (us(1), 2**60 + 1, 2, 5.0), (us(2), None, 3, 4.0), (us(3), 2**60 + 1, 4, 6.0)], [(us(9_000), 7, 5, 0.0)]]
    table = alerts.run_to_table(alerts.counter_steps_stream(stream_of(spark, batches, "name long, id long, v double"), "name", "v", "id"), "nulls")
    assert {(r["name"], r.step) for r in alerts.on_time(table).collect()} == {(None, 3.0), (2**60 + 1, 1.0)}
