"""Windowed rates, ratios, quantiles and alert conditions, as streams and as their batch twins.

Stateful streams hold rows back until the watermark has passed them and then take them in event-time order, so results
do not depend on how the input is cut into micro-batches. Rows behind the watermark are dropped by Spark in windows; the
stateful operators put them out in the column ``late_us``. Streams that append end with the last watermark: what is younger than
it, open windows included, is not out yet.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.ranking import running_max, values_at_ranks, with_previous, with_scalars
from ..session import work_dir

DELAY = "10 minutes"
CHUNK = 4096  # rows
BUCKETS = 4096
LATE = "late_us"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def event_stream(spark: SparkSession, path: str, batch_bytes: int = 256 << 20, one_file: bool = False, delay: str | None = DELAY) -> DataFrame:
    """A Parquet table as a file stream with a watermark on ts, or without one where ``delay`` is None.

    Micro-batches end after the file that passes ``batch_bytes``, or hold one file each; results do not depend on it.
    The path is given as a pattern so that a table of one file works like a folder of files.
    """
    schema = spark.read.parquet(path).schema
    limit = ("maxFilesPerTrigger", 1) if one_file else ("maxBytesPerTrigger", batch_bytes)
    raw = spark.readStream.schema(schema).option(*limit).parquet(f"{path[:-1]}[{path[-1]}]")
    rows = raw.withColumn("ts", F.col("ts").cast("timestamp"))
    return rows if delay is None else rows.withWatermark("ts", delay)


def run_to_table(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Run a stream over everything available into a Parquet table and read it back."""
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)  # state on disk, written as changes; asked for by transformWithState
    out, marks = work_dir(spark, label), work_dir(spark, f"{label}_marks")
    # the number of state partitions stays with the checkpoint: no more than the cluster has cores
    width = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(min(int(width), spark.sparkContext.defaultParallelism)))
    try:
        query = stream.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", marks).trigger(availableNow=True).start()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", width)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def windowed(df: DataFrame, size: str, slide: str | None, by: Sequence[str], *aggs: Column) -> DataFrame:
    """Tumbling or sliding aggregation with window start and end as columns."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    out = df.groupBy(w.alias("_w"), *by).agg(*aggs)
    return out.select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *by, *[c for c in out.columns if c != "_w" and c not in by])


# --- counters ----------------------------------------------------------------------------------------

def counter_steps(samples: DataFrame, key: str, value: str, tie: str) -> DataFrame:
    """Reset-safe increase from the previous sample of the series; the first sample has none."""
    prev = with_previous(samples.select(key, "ts", tie, value), [key], ["ts", tie], [value])
    step = F.when(F.col(value) >= F.col(f"prev_{value}"), F.col(value) - F.col(f"prev_{value}")).otherwise(F.col(value))
    return prev.filter(F.col(f"prev_{value}").isNotNull()).select(key, "ts", step.alias("step"))


class _EventTime(StatefulProcessor):
    """Rows of many series in event-time order; see ``in_event_time``.

    A bucket's young rows lie in a map by chunk, sorted by time and at most CHUNK rows each. A chunk is read when the
    watermark passes its first row; only the rows of such chunks that are still young are written again.
    """

    def __init__(self, key: str, names: Sequence[str], kinds: Sequence[str], output: str, memory: str, step: Callable, alarm: Callable | None):
        self.key, self.names, self.kinds, self.memory_ddl, self.step, self.alarm = key, names, kinds, memory, step, alarm
        self.columns = [c.split()[0] for c in output.split(", ")]

    def init(self, handle: StatefulProcessorHandle) -> None:
        def arrays(ddl: Sequence[str]) -> str:
            return ", ".join("{} array<{}>".format(*c.split()) for c in ddl)

        self.handle = handle
        rows = ["us long", *(f"{n} {kind}" for n, kind in zip(self.names, self.kinds)), "series string"]
        self.held = handle.getMapState("held", "chunk int", arrays(rows))
        self.index = handle.getValueState("index", "at_ms long, next int, chunks array<int>, first_us array<long>")
        self.memory = handle.getValueState("memory", arrays(["series string", *self.memory_ddl.split(", ")]))

    def _load(self) -> tuple[int | None, int, list[tuple[int, int]]]:
        """The time of the timer, the next chunk's number, and (first time, number) of the chunks."""
        at, free, chunks, first = self.index.get() or (None, 0, [], [])
        return at, free, list(zip(first, chunks))

    def _hold(self, rows: list[tuple], free: int, chunks: list[tuple[int, int]]) -> int:
        """Rows as chunks of their own; gives the next free number."""
        rows.sort(key=_in_time)
        for start in range(0, len(rows), CHUNK):
            part = rows[start : start + CHUNK]
            self.held.updateValue((free,), tuple(list(c) for c in zip(*part)))
            chunks.append((part[0][0], free))
            free += 1
        return free

    def _save(self, was: int | None, wake: int | None, free: int, chunks: list[tuple[int, int]], fired: bool) -> None:
        """Keep the index, with one timer at ``wake`` (microseconds) at most; ``was`` is the timer there is."""
        at = None if wake is None else -(-wake // 1000)  # the first watermark, in milliseconds, that has reached the time
        if not fired and was is not None and (at is None or was <= at):
            at = was
        if at is not None and (fired or at != was):
            self.handle.registerTimer(at)
            if was is not None and not fired:
                self.handle.deleteTimer(was)
        self.index.update((at, free, [c for _, c in chunks], [first for first, _ in chunks]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        at, free, chunks = self._load()
        young, wake = [], None
        for pdf in rows:
            late = []
            for r in zip(*(pdf[c].tolist() for c in ["us", *self.names, self.key])):
                if r[0] <= mark:
                    late.append((r[-1], *[None] * len(self.columns), r[0]))
                else:
                    young.append(r)
                    wake = r[0] if wake is None else min(wake, r[0])
            if late:
                yield self._frame(late)
            if len(young) >= 16 * CHUNK:
                free, young = self._hold(young, free, chunks), []
        if wake is not None:
            self._save(at, wake, self._hold(young, free, chunks), chunks, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        _, free, chunks = self._load()
        memory = {name: tuple(rest) for name, *rest in zip(*(self.memory.get() or ()))}
        rest, out = [], []

        def steps(ready: list[tuple]) -> Iterator[pd.DataFrame]:
            for r in ready:
                memory[r[-1]], found = self.step(memory.get(r[-1]), r[:-1])
                out.extend((r[-1], *f, None) for f in found)
                if len(out) >= CHUNK:
                    yield self._frame(out)
                    out.clear()

        chunks.sort()
        due = [c for c in chunks if c[0] <= mark]
        chunks = chunks[len(due):]
        for first, chunk in due:
            n = bisect_left(rest, first, key=lambda r: r[0])  # no later chunk holds a row before these
            yield from steps(rest[:n])
            rest = rest[n:] + list(zip(*self.held.getValue((chunk,))))
            rest.sort(key=_in_time)
            self.held.removeKey((chunk,))
        n = bisect_right(rest, mark, key=lambda r: r[0])
        yield from steps(rest[:n])
        free = self._hold(rest[n:], free, chunks)
        wake = [first for first, _ in chunks]
        if self.alarm is not None:
            for name, remembered in memory.items():
                memory[name], found, again = self.alarm(remembered, mark)
                out.extend((name, *f, None) for f in found)
                wake += [again] if again is not None else []
        if memory:
            self.memory.update((list(memory), *(list(c) for c in zip(*memory.values()))))
        # a timer at the watermark itself would go with the one that expires now
        self._save(None, max(min(wake), mark + 1) if wake else None, free, chunks, True)
        if out:
            yield self._frame(out)

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[self.key, *self.columns, LATE], dtype=object)

    def close(self) -> None:
        pass


def _in_time(row: tuple) -> tuple:
    return row[:2]


def in_event_time(samples: DataFrame, key: str, columns: str, output: str, memory: str, step: Callable, alarm: Callable | None = None,
                  buckets: int = BUCKETS) -> DataFrame:
    """Run ``step`` over the rows of each series in event-time order.

    samples has key, us (microseconds) and the columns of ``columns`` (DDL; the first one breaks ties). ``step`` takes the
    remembered tuple (or None) and a row (us, *columns) and gives the new tuple and rows to emit. ``alarm`` takes the tuple
    and the watermark in microseconds and gives the same when time alone has passed, plus the time at which to ask again.
    Series share ``buckets`` by the hash of their key, so that a call to the state store serves many of them. State per
    bucket: the rows younger than the watermark in chunks, one tuple a series, and one timer at the time of the oldest
    row or alarm. A row that comes behind the watermark is not lost: it comes out with its time in ``late_us`` and nulls
    in the other columns; ``on_time`` and ``late_rows`` tell the two kinds apart.
    """
    names = [c.split()[0] for c in columns.split(", ")]
    kinds = [c.split()[1] for c in columns.split(", ")]
    key_type = dict(samples.dtypes)[key]
    processor = _EventTime(key, names, kinds, output, memory, step, alarm)
    # without ts Spark does not take late rows away before the processor has seen them; the watermark itself stays
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("_bucket")
    rows = samples.select(bucket, F.col(key).cast("string").alias(key), "us", *names).groupBy("_bucket").transformWithStateInPandas(
        processor, f"{key} string, {output}, {LATE} long", "append", "EventTime")
    return rows.withColumn(key, F.col(key).cast(key_type))


def on_time(rows: DataFrame) -> DataFrame:
    """What a stateful stream has put out, without its late rows."""
    return rows.filter(F.col(LATE).isNull()).drop(LATE)


def late_rows(rows: DataFrame, key: str) -> DataFrame:
    """Rows that came behind the watermark, by series: how many, and their first and last time."""
    late = rows.filter(F.col(LATE).isNotNull())
    return late.groupBy(key).agg(F.count(F.lit(1)).alias("late"), F.min(LATE).alias("first_us"), F.max(LATE).alias("last_us"))


def counter_steps_stream(samples: DataFrame, key: str, value: str, tie: str) -> DataFrame:
    """The same steps on a stream: the last value of each series is the state."""
    def step(last, row):
        us, _, now = row
        return (now,), [] if last is None else [(us, now - last[0] if now >= last[0] else now)]

    chosen = samples.select(key, "ts", F.unix_micros("ts").alias("us"), F.col(tie).cast("long").alias(tie), F.col(value).cast("double").alias(value))
    steps = in_event_time(chosen, key, f"{tie} long, {value} double", "us long, step double", "_last double", step)
    return steps.select(key, F.timestamp_micros("us").alias("ts"), "step", LATE)


def rate_window(steps: DataFrame, key: str, seconds: int = 300, slide: int = 60) -> DataFrame:
    """Per-second increase over a sliding window, by series."""
    rate = F.round(F.sum("step") / seconds, 6).alias("rate")
    return windowed(steps, f"{seconds} seconds", f"{slide} seconds", [key], rate)


def increase_over(steps: DataFrame, key: str, limit: float, seconds: int = 900, slide: int = 300) -> DataFrame:
    """Windows whose increase passes the limit."""
    rows = windowed(steps, f"{seconds} seconds", f"{slide} seconds", [key], F.round(F.sum("step"), 6).alias("increase"))
    return rows.filter(F.col("increase") > limit)


# --- ratios, quantiles, gauges -------------------------------------------------------------------------

def error_ratio(events: DataFrame, failed: Column, by: Sequence[str] = (), limit: float = 0.3, size: str = "5 minutes", slide: str | None = None) -> DataFrame:
    n, bad = F.count(F.lit(1)), F.count_if(failed)
    rows = windowed(events, size, slide, by, n.alias("n"), bad.alias("failed"))
    return rows.withColumn("ratio", F.round(F.col("failed") / F.col("n"), 6)).withColumn("alert", F.col("failed") / F.col("n") > limit)


def quantile_window(events: DataFrame, value: str, by: Sequence[str], limit: float, q: float = 0.95, seconds: int = 300) -> DataFrame:
    """Exact interpolated quantile per tumbling window and label (batch)."""
    start = (F.floor(F.unix_seconds("ts") / seconds) * seconds).alias("window_start")
    keyed = events.select(start, *by, value)
    at = F.lit(q) * (F.col("n") - 1)
    both = values_at_ranks(keyed, ["window_start", *by], value, {"_lo": (q, F.floor(at)), "_hi": (q, F.ceil(at))})
    got = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (at - F.floor(at))
    return both.select("window_start", *by, "n", F.round(got, 6).alias("quantile"), (got > limit).alias("alert"))


def quantile_window_stream(events: DataFrame, value: str, by: Sequence[str], limit: float, q: float = 0.95, size: str = "5 minutes") -> DataFrame:
    rows = windowed(events, size, None, by, F.count(F.lit(1)).alias("n"), F.percentile_approx(value, q, 10_000).alias("quantile"))
    return rows.withColumn("alert", F.col("quantile") > limit)


def gauge_threshold(rows: DataFrame, used: Column, total: Column, limit: float, over: bool = True) -> DataFrame:
    """percent and alert; stateless, the same on streams."""
    percent = used / F.nullif(total, F.lit(0)) * 100
    return rows.withColumn("percent", F.round(percent, 6)).withColumn("alert", percent > limit if over else percent < limit)


# --- conditions over time --------------------------------------------------------------------------------

def hold_for(samples: DataFrame, key: str, condition: str, seconds: int, tie: str) -> DataFrame:
    """Alerts that fired: the condition held without a break for ``seconds`` (batch).

    It holds from a true sample until the next false one, or until the data end, as a timer sees it. A run of true
    samples is named by the last false sample before it, found with balanced slices.
    """
    limit = seconds * 1_000_000
    us = F.unix_micros("ts")
    marked = samples.select(key, us.alias("us"), tie, F.coalesce(F.col(condition), F.lit(False)).alias("c"))
    marked = marked.withColumn("_false", F.when(~F.col("c"), F.struct("us", tie)))
    runs = running_max(marked, [key], ["us", tie], "_false", "_since")
    starts = runs.filter("c").groupBy(key, "_since").agg(F.min("us").alias("start_us"), F.max("us").alias("end_us"))
    # a false sample ends the run that has the same false sample before it
    ends = runs.filter(~F.col("c")).select(F.col(key).alias("_key"), F.col("_since").alias("_s"), F.col("us").alias("broken_us"))
    both = starts.join(ends, (F.col(key) == F.col("_key")) & F.col("_since").eqNullSafe(F.col("_s")), "left")
    last = with_scalars(both, marked.agg(F.max("us").alias("_end")))
    until = F.coalesce(F.col("broken_us") - 1, F.col("_end"))
    return last.filter(until - F.col("start_us") >= limit).select(key, "start_us", "end_us", (F.col("start_us") + limit).alias("fired_us"))


def hold_for_stream(samples: DataFrame, key: str, condition: str, seconds: int, tie: str) -> DataFrame:
    """(key, start_us, fired_us) of conditions that held for ``seconds``. The alert fires by timer when the time is up,
    as long as no sample says otherwise; ``fired_us`` is that time."""
    limit = seconds * 1_000_000

    def fire(start, fired, now):
        if start is not None and not fired and now >= start + limit:
            return True, [(start, start + limit)]
        return fired, []

    def step(memory, row):
        start, fired = memory or (None, False)
        us, _, holds = row
        fired, out = fire(start, fired, us if holds else us - 1)
        if not holds:
            return (None, False), out
        return (us if start is None else start, fired), out

    def alarm(memory, mark):
        start, fired = memory
        fired, out = fire(start, fired, mark)
        return (start, fired), out, start + limit if start is not None and not fired else None

    chosen = samples.select(key, "ts", F.unix_micros("ts").alias("us"), F.col(tie).cast("long").alias(tie), F.coalesce(F.col(condition), F.lit(False)).alias("c"))
    return in_event_time(chosen, key, f"{tie} long, c boolean", "start_us long, fired_us long", "_start long, _fired boolean", step, alarm)


def absent_heartbeat(samples: DataFrame, key: str, seconds: int, tie: str) -> DataFrame:
    """Silences longer than ``seconds``: last beat, when the alert fired, next beat (batch). A target that is still
    silent when the data end has no next beat."""
    limit = seconds * 1_000_000
    beats = samples.select(key, F.unix_micros("ts").alias("us"), tie)
    prev = with_previous(beats, [key], ["us", tie], ["us"])
    closed = prev.filter(F.col("us") - F.col("prev_us") > limit).select(
        key, F.col("prev_us").alias("last_us"), (F.col("prev_us") + limit).alias("fired_us"), F.col("us").alias("next_us"))
    last = with_scalars(beats.groupBy(key).agg(F.max("us").alias("last_us")), beats.agg(F.max("us").alias("_end")))
    still = last.filter(F.col("_end") - F.col("last_us") > limit).select(
        key, "last_us", (F.col("last_us") + limit).alias("fired_us"), F.lit(None).cast("long").alias("next_us"))
    return closed.unionByName(still)


def absent_heartbeat_stream(samples: DataFrame, key: str, seconds: int) -> DataFrame:
    """(key, last_us, fired_us) once the watermark has passed the last beat + ``seconds``."""
    limit = seconds * 1_000_000

    def step(memory, row):
        us = row[0]
        silent = memory is not None and not memory[1] and us - memory[0] > limit
        return (us, False), [(memory[0], memory[0] + limit)] if silent else []

    def alarm(memory, mark):
        last, told = memory
        due = not told and mark > last + limit
        return (last, told or due), [(last, last + limit)] if due else [], None if told or due else last + limit

    chosen = samples.select(key, "ts", F.unix_micros("ts").alias("us"), F.lit(0).cast("long").alias("tie"))
    return in_event_time(chosen, key, "tie long", "last_us long, fired_us long", "_last long, _told boolean", step, alarm)


# --- traces, ingest, dedup, telemetry ----------------------------------------------------------------------

def trace_completion(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """One row per ended trace, emitted when its session closes; traces without an end are dropped.

    events: ts, trace_id, type, line_no, score.
    """
    def last(kind):
        hit = F.col("type") == kind
        return F.max_by(F.when(hit, F.col("score")), F.when(hit, F.col("line_no")))

    rows = events.groupBy("trace_id", F.session_window("ts", gap).alias("_w")).agg(
        last("trace_end").alias("end_score"), last("grading_result").alias("graded_score"), F.count_if(F.col("type") == "trace_end").alias("ends"))
    return rows.filter("ends > 0").select(
        "trace_id", F.unix_micros("_w.start").alias("start_us"), F.coalesce("graded_score", "end_score").alias("score"), F.col("graded_score").isNotNull().alias("graded"))


def trace_ends(events: DataFrame, gap: str = "30 minutes", delay: str = DELAY) -> DataFrame:
    """Ended traces as a join of two streams, end and grade events of a trace that lie within ``gap`` of each other.

    A graded end is out as soon as both events have arrived, whatever else the trace still sends. An end without a grade
    is out with its own score once the watermark, which is that of the slower side, shows that no grade can come any more.
    Traces that never end are never out. Both sides forget events that have left the gap. A trace with several ends or grades has a row for each pair;
    ``last_grades`` keeps the last one. events: ts, trace_id, type, line_no, score, without a watermark: each side gets its
    own after its filter.
    """
    def side(kind: str, prefix: str) -> DataFrame:
        found = events.filter(F.col("type") == kind).select(*(F.col(c).alias(f"{prefix}_{c}") for c in ("ts", "trace_id", "line_no", "score")))
        return found.withWatermark(f"{prefix}_ts", delay)

    near = F.expr(f"e_trace_id = g_trace_id and g_ts between e_ts - interval {gap} and e_ts + interval {gap}")
    pairs = side("trace_end", "e").join(side("grading_result", "g"), near, "left_outer")
    return pairs.select(
        F.col("e_trace_id").alias("trace_id"), F.unix_micros("e_ts").alias("end_us"), F.col("e_line_no").alias("end_line"), F.col("g_line_no").alias("grade_line"),
        F.coalesce("g_score", "e_score").alias("score"), F.col("g_trace_id").isNotNull().alias("graded"))


def last_grades(pairs: DataFrame) -> DataFrame:
    """One row a trace from the table of ``trace_ends``: its last end, with the last grade of that end."""
    chosen = F.max(F.struct("end_line", F.coalesce("grade_line", F.lit(-1)).alias("grade"), "end_us", "score", "graded")).alias("c")
    return pairs.groupBy("trace_id").agg(chosen).select("trace_id", "c.end_us", "c.score", "c.graded")


def holds_files(spark: SparkSession, path: str) -> bool:
    """Whether a folder exists and has a finished batch, asked of its file system."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.exists(folder) and any(files.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")) for s in files.listStatus(folder))


def incremental_ingest(stream: DataFrame, done_path: str, marks: str, key: str, transform: Callable[[DataFrame], DataFrame]) -> None:
    """Append results of items not seen before. A batch that is replayed after a failure is skipped by its id.

    The done table is read per batch and anti-joined, so files listed twice do no harm either.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates([key])
        if holds_files(spark, done_path):  # the first batch finds no table
            done = spark.read.parquet(done_path)
            fresh = fresh.join(done.filter(F.col("batch_id") != batch_id).select(key), key, "left_anti")
        transform(fresh).write.mode("overwrite").parquet(f"{done_path}/batch_id={batch_id}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()


def stream_dedup(stream: DataFrame, hash_col: str) -> DataFrame:
    return stream.dropDuplicatesWithinWatermark([hash_col])


def downsample(telemetry: DataFrame, gauges: Sequence[str], by: Sequence[str] = (), size: str = "1 minute") -> DataFrame:
    aggs = [f(g).alias(f"{g}_{n}") for g in gauges for n, f in (("min", F.min), ("mean", lambda c: F.round(F.avg(c), 6)), ("max", F.max))]
    return windowed(telemetry, size, None, by, F.count(F.lit(1)).alias("n"), *aggs)


def last_gap(telemetry: DataFrame, tie: str) -> DataFrame:
    """Seconds between the last row and the row before it: two rows are compared, nothing is sorted as a whole."""
    last_two = telemetry.select(F.unix_micros("ts").alias("us"), tie).orderBy(F.col("us").desc(), F.col(tie).desc()).limit(2)
    return last_two.agg(F.max("us").alias("last_us"), F.round((F.max("us") - F.min("us")) / 1e6, 6).alias("gap_s"))
