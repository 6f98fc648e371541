"""Windows and alerts over events: batch twins, and streams over the same table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import short_hash
from ..operators.ranking import with_scalars
from ..session import work_dir
from ..streaming import alerts
from .registry import Tables, query


FILES = 8


def event_files(t: Tables, lateness, **options):
    """events in eight files, written one after the other in order of arrival, ``lateness`` seconds after their time."""
    path = work_dir(t.spark, "event_files")
    at = F.unix_micros("ts") + lateness * 1_000_000
    rows = t.events.select("event_type", "event_id", "user_id", "value", "ts", at.alias("_at"))
    span = rows.agg(F.min("_at").alias("_first"), ((F.max("_at") - F.min("_at")) / FILES).alias("_span"))
    filed = with_scalars(rows, span).withColumn("_file", F.least(F.floor((F.col("_at") - F.col("_first")) / F.col("_span")), F.lit(FILES - 1)))
    staged = work_dir(t.spark, "event_parts")  # the table is cut once, by all tasks; each file then reads its own part
    filed.select("event_type", "event_id", "user_id", "value", "ts", "_file").write.partitionBy("_file").parquet(staged)
    parts = t.spark.read.schema(filed.select("event_type", "event_id", "user_id", "value", "ts", "_file").schema).parquet(staged)
    for k in range(FILES):
        parts.filter(F.col("_file") == k).drop("_file").coalesce(1).write.mode("append").parquet(path)
    return alerts.event_stream(t.spark, path, one_file=True, **options)


def late_stream(t: Tables, **options):
    """Every row arrives up to nine minutes after its time, within the watermark of ten."""
    return event_files(t, F.pmod(F.xxhash64("event_id"), F.lit(540)), **options)


def stray_stream(t: Tables):
    """Rows arrive up to two days after their time: those of the end of a file's span may come behind the watermark."""
    return event_files(t, F.pmod(F.col("event_id") * 7919, F.lit(172_800)))


# the same rows in SQL: the file of each row, the watermark that holds when the file is read, and what comes behind it
SQL_STRAY = f"""a0 as (select *, epoch_us(ts) as us, epoch_us(ts) + (event_id * 7919 % 172800) * 1000000 as arrival from events),
a1 as (select *, least(floor((arrival - min(arrival) over ()) / ((max(arrival) over () - min(arrival) over ()) / {FILES})), {FILES - 1}) as file from a0),
a2 as (select *, coalesce(floor(max(us) over (order by file range between unbounded preceding and 1 preceding) / 1000)::bigint * 1000 - 600000000, 0) as mark from a1),
fresh as (select * from a2 where us > mark)"""


# the last watermark of a stream over events, in microseconds
SQL_MARK = "(select floor(epoch_us(max(ts)) / 1000)::bigint * 1000 - 600000000 from events)"


def stream(t: Tables):
    return alerts.event_stream(t.spark, f"{t.sf_dir}/events.parquet")


def counters(df):
    """A counter per event type that falls back to zero now and then."""
    return df.select(F.col("event_type").alias("name"), "ts", "event_id", (F.col("event_id") % 1000).cast("double").alias("counter"))


def seconds(df, *names):
    return df.withColumns({n: F.unix_seconds(n) for n in names})


SQL_ANY_STEPS = """s0 as (select event_type as name, ts, (event_id % 1000)::double as v, lag((event_id % 1000)::double) over (partition by event_type order by ts, event_id) as p from {0}),
st as (select name, ts, case when v >= p then v - p else v end as step from s0 where p is not null)"""
SQL_STEPS = SQL_ANY_STEPS.format("events")
SQL_RATE = """with {0}, w as (select name, step, (floor(epoch(ts) / 60) * 60 - 60 * k)::bigint as ws from st, range(0, 5) r(k))
select name, ws as window_start, ws + 300 as window_end, round(sum(step) / 300, 6) as rate from w group by 1, 2, 3"""


@query("Q1_rate_window", SQL_RATE.format(SQL_STEPS))
def _(t: Tables):
    steps = alerts.counter_steps(counters(t.events), "name", "counter", "event_id")
    return seconds(alerts.rate_window(steps, "name"), "window_start", "window_end")


@query("Q1_rate_window_stream", SQL_RATE.format(SQL_ANY_STEPS.format(f"(select * from events where epoch_us(ts) <= {SQL_MARK})")))
def _(t: Tables):
    """The steps come from a stateful stream, the windows from its output table."""
    steps = alerts.on_time(alerts.run_to_table(alerts.counter_steps_stream(counters(late_stream(t)), "name", "counter", "event_id"), "steps"))
    return seconds(alerts.rate_window(steps, "name"), "window_start", "window_end")


SQL_CLOSED = "window_end <= (select floor(epoch(max(ts)) * 1000) / 1000 - 600 from events)"


@query("Q2_error_ratio", f"""
with w as (select (floor(epoch(ts) / 300) * 300)::bigint as window_start, event_type = 'error' as bad from events),
a as (select window_start, window_start + 300 as window_end, count(*) as n, count(*) filter (where bad) as failed from w group by 1)
select *, round(failed / n, 6) as ratio, failed / n > 0.3 as alert from a where {SQL_CLOSED}""")
def _(t: Tables):
    """A stream in append mode: windows appear once the watermark passed their end."""
    out = alerts.run_to_table(alerts.error_ratio(stream(t), F.col("event_type") == "error"), "error_ratio")
    return seconds(out, "window_start", "window_end")


@query("Q3_p95_window", """
with w as (select (floor(epoch(ts) / 3600) * 3600)::bigint as window_start, event_type, value from events)
select window_start, event_type, count(*) as n, round(quantile_cont(value, 0.95), 6) as quantile, quantile_cont(value, 0.95) > 150 as alert from w group by 1, 2""")
def _(t: Tables):
    return alerts.quantile_window(t.events, "value", ["event_type"], 150.0, seconds=3600)


@query("Q3_p95_window_stream")
def _(t: Tables):
    out = alerts.run_to_table(alerts.quantile_window_stream(stream(t), "value", ["event_type"], 150.0, size="1 hour"), "p95")
    return seconds(out, "window_start", "window_end")


@query("Q4_increase_over", f"""with {SQL_STEPS}, w as (select name, step, (floor(epoch(ts) / 300) * 300 - 300 * k)::bigint as ws from st, range(0, 3) r(k))
select name, ws as window_start, ws + 900 as window_end, round(sum(step), 6) as increase from w group by 1, 2, 3 having sum(step) > 30""")
def _(t: Tables):
    steps = alerts.counter_steps(counters(t.events), "name", "counter", "event_id")
    return seconds(alerts.increase_over(steps, "name", 30.0), "window_start", "window_end")


@query("Q5_gauge_threshold", """
select event_id, round((1 - value / 500) * 100, 6) as percent, (1 - value / 500) * 100 < 10 as alert from events""")
def _(t: Tables):
    rows = stream(t).select("event_id", "value")
    low = alerts.gauge_threshold(rows, F.lit(1.0) - F.col("value") / 500, F.lit(1.0), 10.0, over=False)
    return alerts.run_to_table(low.select("event_id", "percent", "alert"), "gauge")


def hot(df):
    return df.select(F.col("event_type").alias("name"), "ts", "event_id", (F.col("value") > 25).alias("hot"))


SQL_HOLD = """m as (select event_type as name, epoch_us(ts) as us, event_id, value > 25 as c from events where epoch_us(ts) <= {0}),
r as (select *, count(*) filter (where not c) over (partition by name order by us, event_id rows between unbounded preceding and 1 preceding) as g from m),
i as (select name, g, min(us) as start_us, max(us) as end_us from r where c group by 1, 2),
b as (select name, g, us as broken from r where not c),
f as (select i.name, i.start_us, i.end_us, i.start_us + 3600000000 as fired_us from i left join b using (name, g) where coalesce(b.broken - 1, {0}) - i.start_us >= 3600000000)"""


@query("Q6_hold_for", f"with {SQL_HOLD.format('(select epoch_us(max(ts)) from events)')} select name, start_us, end_us, fired_us from f")
def _(t: Tables):
    return alerts.hold_for(hot(t.events), "name", "hot", 3600, "event_id")


@query("Q6_hold_for_stream", f"with {SQL_HOLD.format(SQL_MARK)} select name, start_us, fired_us from f")
def _(t: Tables):
    return alerts.on_time(alerts.run_to_table(alerts.hold_for_stream(hot(late_stream(t)), "name", "hot", 3600, "event_id"), "hold"))


def by_user(df):
    """One series a user: many series, few rows each."""
    return df.select(F.concat(F.lit("user-"), F.col("user_id")).alias("name"), "ts", "event_id", (F.col("value") > 25).alias("hot"))


USERS = "(select event_id, ts, value, 'user-' || user_id as event_type from fresh)"


@query("Q6_hold_for_users_stream", f"with {SQL_STRAY}, {SQL_HOLD.format(SQL_MARK).replace('from events where', f'from {USERS} where')} select name, start_us, fired_us from f")
def _(t: Tables):
    """Rows that come behind the watermark do not count here; Q6_late_rows has them."""
    return alerts.on_time(alerts.run_to_table(alerts.hold_for_stream(by_user(stray_stream(t)), "name", "hot", 3600, "event_id"), "hold_users"))


@query("Q6_late_rows", f"""with {SQL_STRAY} select 'user-' || user_id as name, count(*) as late, min(us) as first_us, max(us) as last_us from a2 where us <= mark group by 1""")
def _(t: Tables):
    return alerts.late_rows(alerts.run_to_table(alerts.hold_for_stream(by_user(stray_stream(t)), "name", "hot", 3600, "event_id"), "hold_late"), "name")


SQL_GAPS = """e as (select event_type as name, epoch_us(ts) as us, event_id from events where epoch_us(ts) <= {0}),
b as (select name, us, lag(us) over (partition by name order by us, event_id) as p from e),
g as (select name, p as last_us, p + 3600000000 as fired_us, us as next_us from b where us - p > 3600000000
  union all select name, max(us), max(us) + 3600000000, null from e group by 1 having {0} - max(us) > 3600000000)"""


@query("Q7_absent_heartbeat", f"with {SQL_GAPS.format('(select epoch_us(max(ts)) from events)')} select * from g")
def _(t: Tables):
    return alerts.absent_heartbeat(t.events.select(F.col("event_type").alias("name"), "ts", "event_id"), "name", 3600, "event_id")


@query("Q7_absent_heartbeat_stream", f"with {SQL_GAPS.format(SQL_MARK)} select name, last_us, fired_us from g")
def _(t: Tables):
    beats = late_stream(t).select(F.col("event_type").alias("name"), "ts")
    return alerts.on_time(alerts.run_to_table(alerts.absent_heartbeat_stream(beats, "name", 3600), "heartbeat"))


@query("Q7_absent_heartbeat_users_stream", f"with {SQL_STRAY}, {SQL_GAPS.format(SQL_MARK).replace('from events where', f'from {USERS} where')} select name, last_us, fired_us from g")
def _(t: Tables):
    beats = by_user(stray_stream(t)).select("name", "ts")
    return alerts.on_time(alerts.run_to_table(alerts.absent_heartbeat_stream(beats, "name", 3600), "heartbeat_users"))


@query("Q8_trace_completion", """
with e as (select user_id as trace_id, ts, case event_type when 'purchase' then 'trace_end' when 'signup' then 'grading_result' else 'tool' end as type, event_id, value as score from events),
g as (select *, case when epoch_us(ts) - lag(epoch_us(ts)) over (partition by trace_id order by ts) < 1800000000 then 0 else 1 end as brk from e),
s as (select *, sum(brk) over (partition by trace_id order by ts rows unbounded preceding) as sess from g),
a as (select trace_id, sess, min(epoch_us(ts)) as start_us, max(epoch_us(ts)) + 1800000000 as end_us, max_by(score, event_id) filter (where type = 'trace_end') as e, max_by(score, event_id) filter (where type = 'grading_result') as gr from s group by 1, 2)
select trace_id, start_us, coalesce(gr, e) as score, gr is not null as graded from a where e is not null and end_us <= (select floor(epoch_us(max(ts)) / 1000) * 1000 - 600000000 from events)""")
def _(t: Tables):
    kind = F.when(F.col("event_type") == "purchase", "trace_end").when(F.col("event_type") == "signup", "grading_result").otherwise("tool")
    rows = stream(t).select("ts", F.col("user_id").alias("trace_id"), kind.alias("type"), F.col("event_id").alias("line_no"), F.col("value").alias("score"))
    return alerts.run_to_table(alerts.trace_completion(rows), "traces")


@query("Q8_trace_ends_stream", f"""
with e as (select user_id as trace_id, epoch_us(ts) as us, event_id, value, event_type from events),
p as (
  select e.trace_id, e.us as end_us, e.event_id as end_line, g.event_id as grade_line, coalesce(g.value, e.value) as score, g.trace_id is not null as graded
  from (select * from e where event_type = 'purchase') e left join (select * from e where event_type = 'signup') g
  on e.trace_id = g.trace_id and g.us between e.us - 1800000000 and e.us + 1800000000)
select * from p where graded or end_us + 1800000000 < (
  select floor(least(max(us) filter (where event_type = 'purchase'), max(us) filter (where event_type = 'signup')) / 1000)::bigint * 1000 - 600000000 from e)""")
def _(t: Tables):
    """Ends and grades of eight late files: a graded end is out in the batch that brings the second of the two."""
    kind = F.when(F.col("event_type") == "purchase", "trace_end").when(F.col("event_type") == "signup", "grading_result").otherwise("tool")
    rows = late_stream(t, delay=None).select("ts", F.col("user_id").alias("trace_id"), kind.alias("type"), F.col("event_id").alias("line_no"), F.col("value").alias("score"))
    return alerts.run_to_table(alerts.trace_ends(rows), "trace_ends")


@query("Q9_incremental_ingest", "select doc_id, length(text) as chars from documents")
def _(t: Tables):
    """Two arrivals of the same table, the second with every row; each document is processed once."""
    spark, inbox = t.spark, work_dir(t.spark, "inbox")
    done, marks = work_dir(spark, "done"), work_dir(spark, "done_marks")
    docs = t.documents.select("doc_id", "text")
    for part in (docs.filter("doc_id % 2 = 0"), docs):
        part.write.mode("append").parquet(inbox)
        source = spark.readStream.schema(docs.schema).parquet(inbox)
        alerts.incremental_ingest(source, done, marks, "doc_id", lambda d: d.select("doc_id", F.length("text").alias("chars")))
    return spark.read.parquet(done).select("doc_id", F.col("chars").cast("long").alias("chars"))


@query("Q10_stream_dedup")
def _(t: Tables):
    hashed = stream(t).select("ts", short_hash(F.concat_ws("|", "event_type", "props")).alias("content_hash"))
    return alerts.run_to_table(alerts.stream_dedup(hashed, "content_hash"), "dedup").select("content_hash")


@query("Q11_downsample", f"""
with w as (select (floor(epoch(ts) / 3600) * 3600)::bigint as window_start, event_type, value from events)
select * from (select window_start, window_start + 3600 as window_end, event_type, count(*) as n, min(value) as value_min, round(avg(value), 6) as value_mean, max(value) as value_max from w group by 1, 2, 3) where {SQL_CLOSED}""")
def _(t: Tables):
    out = alerts.run_to_table(alerts.downsample(stream(t), ["value"], ["event_type"], "1 hour"), "downsample")
    return seconds(out, "window_start", "window_end")


@query("Q11_last_gap", """
with l as (select epoch_us(ts) as us from events order by ts desc, event_id desc limit 2) select max(us) as last_us, round((max(us) - min(us)) / 1e6, 6) as gap_s from l""")
def _(t: Tables):
    return alerts.last_gap(t.events, "event_id")
