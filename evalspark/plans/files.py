"""File shapes: every query writes data from the given tables in that shape and reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import labels, rollups
from ..session import work_dir
from ..sources import readers, writers
from .label_tables import attrs, SQL_ATTRS
from .registry import Tables, query

TURN = "conv_id long, turn long, role string, text string"


def turn_json():
    return F.to_json(F.struct("conv_id", "turn", "role", "text"))


@query("S1_read_jsonl", """
select case when conv_id % 6 = 5 and turn = 0 then 'bad' else 'good' end as kind, role, count(*) as n, sum(length(text))::bigint as chars from conversations where not (conv_id % 6 = 5 and turn = 0) group by 1, 2
union all select 'bad', null, count(*), null from conversations where conv_id % 6 = 5 and turn = 0""")
def _(t: Tables):
    path = work_dir(t.spark, "jsonl")
    broken = (F.col("conv_id") % 6 == 5) & (F.col("turn") == 0)
    t.conversations.select(F.when(broken, F.concat(F.lit("{oops "), turn_json())).otherwise(turn_json()).alias("value")).write.text(path)
    good, bad = readers.read_jsonl(t.spark, path, TURN)
    ok = good.groupBy(F.lit("good").alias("kind"), "role").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))
    return ok.unionByName(bad.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("bad").alias("kind"), F.lit(None).cast("string").alias("role"), "n", F.lit(None).cast("long").alias("chars")))


@query("S2_read_jsonl_gz", """
select role, count(*) as n, sum(length(text))::bigint as chars from conversations where conv_id % 9 <> 4 group by role union all select 'malformed', count(*), null from conversations where conv_id % 9 = 4""")
def _(t: Tables):
    path = work_dir(t.spark, "gz")
    lines = t.conversations.select(F.when(F.col("conv_id") % 9 == 4, F.concat(F.lit('{"conv_id": x '), turn_json())).otherwise(turn_json()).alias("value"))
    lines.write.option("compression", "gzip").text(path)
    good, bad = readers.read_jsonl_gz(t.spark, path, TURN)
    counts = good.groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))
    return counts.unionByName(bad.agg(F.count(F.lit(1)).alias("n")).select(F.lit("malformed").alias("role"), "n", F.lit(None).cast("long").alias("chars")))


@query("S3_read_json_arrays", """
with s as (select event_id // 10 as task_id, sum(value) as v, count(*) as n from events group by 1) select count(*) as sims, sum(n)::bigint as events, round(sum(v), 4) as total from s""")
def _(t: Tables):
    """One file per writing task: plain arrays of simulations, or objects around them."""
    path = work_dir(t.spark, "arrays")
    sims = t.events.groupBy((F.col("event_id") / 10).cast("long").alias("task_id")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    # a file holds the simulations of one hundred neighbouring tasks: a bounded group
    packed = sims.groupBy((F.col("task_id") / 100).cast("long").alias("f")).agg(F.collect_list(F.struct("task_id", "n", "total")).alias("simulations"))
    plain = packed.select("f", F.when(F.col("f") % 2 == 0, F.to_json("simulations")).otherwise(F.to_json(F.struct("simulations"))).alias("value"))
    plain.write.partitionBy("f").option("lineSep", "\n").text(path)
    back = readers.read_json_arrays(t.spark, f"{path}/f=*", "task_id long, n long, total double")
    return back.agg(F.count(F.lit(1)).alias("sims"), F.sum("n").alias("events"), F.round(F.sum("total"), 4).alias("total"))


@query("S4_read_pipe_table", """
select c_custkey as speaker_id, case c_custkey % 3 when 0 then 'F' when 1 then 'M' else '?' end as sex, c_mktsegment as subset, c_name as name from customer where c_custkey % 10 <> 9""")
def _(t: Tables):
    path, k = work_dir(t.spark, "pipes"), F.col("c_custkey")
    sex = F.when(k % 3 == 0, "F").when(k % 3 == 1, "M").otherwise("?")
    ident = F.when(k % 10 == 9, F.lit("n/a")).otherwise(k.cast("string"))
    rows = t.customer.select(F.concat_ws(" | ", F.concat(ident, F.lit("  ")), sex, "c_mktsegment", "c_name").alias("value"))
    notes = t.nation.select(F.concat(F.lit("; comment | "), "n_name").alias("value"))
    notes.unionByName(rows).write.text(path)
    return readers.read_pipe_table(t.spark, path, ["speaker_id", "sex", "subset", "name"])


@query("S5_read_csv_manifest", """
select 'train' as split, count(*) as n, sum(length(text))::bigint as chars, count(distinct role) as roles from conversations where conv_id % 5 <> 0
union all select 'test', count(*), sum(length(text)), count(distinct role) from conversations where conv_id % 5 = 0""")
def _(t: Tables):
    """Texts with quotes, commas and line breaks survive the round trip."""
    paths = {"train": work_dir(t.spark, "csv_train"), "test": work_dir(t.spark, "csv_test")}
    for split, path in paths.items():
        rows = t.conversations.filter("conv_id % 5 <> 0" if split == "train" else "conv_id % 5 = 0")
        rows.write.option("header", True).option("escape", '"').option("quoteAll", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    back = readers.read_csv_manifest(t.spark, paths, TURN)
    return back.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"), F.countDistinct("role").alias("roles"))


@query("S6_read_write_labels", f"with {SQL_ATTRS} select volume, pitch, count(*) as n, round(sum(snr_db), 4) as snr from attrs group by 1, 2")
def _(t: Tables):
    path = work_dir(t.spark, "labels")
    writers.write_table(attrs(t), path)
    return readers.read_labels(t.spark, path).groupBy("volume", "pitch").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("snr_db"), 4).alias("snr"))


@query("S7_harvest_files", """
with f as (select lang, doc_id // 40 as grp, sum(octet_length(encode(text)) + 1) as bytes from documents where lang <> 'de' group by 1, 2)
select lang as folder, count(*) as n, sum(bytes)::bigint as bytes from f where bytes between 200 and 50000 group by 1""")
def _(t: Tables):
    """Forty neighbouring documents share a file per language; the de folder is on the skip list."""
    path = work_dir(t.spark, "tree")
    folder = F.when(F.col("lang") == "de", "node_modules").otherwise(F.col("lang"))
    rows = t.documents.select(folder.alias("lang"), F.concat(F.lit("g"), (F.col("doc_id") / 40).cast("long").cast("string"), F.lit(".md")).alias("name"), F.col("text").alias("value"))
    rows.repartition("lang", "name").write.partitionBy("lang", "name").text(path)
    found = readers.harvest_files(t.spark, path, suffixes=("txt",), skip=("lang=node_modules",))
    lang = F.regexp_extract("path", r"lang=([a-z]+)", 1)
    return found.groupBy(lang.alias("folder")).agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("bytes"))


@query("S8_union_knowledge", r"""
select 'paper:' || p_partkey as doc_id, regexp_replace('# ' || p_name || chr(10) || chr(10) || case when p_size % 2 = 0 then p_type else '' end || chr(10) || chr(10) || p_brand, '^\s+|\s+$', '', 'g') as text from part
union all select 'finding:' || s_suppkey, '[' || case when s_nationkey % 3 = 0 then 'general' else 'n' || s_nationkey end || '] ' || s_name || case when s_suppkey % 2 = 0 then chr(10) || '(Source: x' || s_suppkey || ')' else '' end from supplier
union all select 'digest:' || n_nationkey, '# ' || n_name || chr(10) || chr(10) || n_regionkey from nation""")
def _(t: Tables):
    papers = t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).alias("abstract"), F.col("p_brand").alias("summary"))
    findings = t.supplier.select(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("content"), F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("x"), F.col("s_suppkey").cast("string"))).alias("source"),
        F.when(F.col("s_nationkey") % 3 != 0, F.concat(F.lit("n"), F.col("s_nationkey").cast("string"))).alias("topic"))
    digests = t.nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("title"), F.col("n_regionkey").cast("string").alias("content"))
    return readers.union_knowledge(papers, findings, digests)


@query("S10_append_results", """
select o_orderstatus as profile, strftime(o_orderdate, '%Y-%m') as month, count(*) as n, round(sum(o_totalprice), 2) as total, count(*) filter (where o_orderkey % 2 = 1) as with_extra from orders group by 1, 2""")
def _(t: Tables):
    """Two appends with different columns into month shards."""
    out = work_dir(t.spark, "results")
    base = t.orders.select("o_orderkey", F.col("o_orderstatus").alias("profile"), F.col("o_orderdate").cast("timestamp").alias("timestamp"), "o_totalprice")
    writers.append_results(base.filter("o_orderkey % 2 = 0"), out)
    writers.append_results(base.filter("o_orderkey % 2 = 1").withColumn("score_extra", F.lit(1)), out)
    return writers.read_results(t.spark, out).groupBy("profile", F.date_format("timestamp", "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.count("score_extra").alias("with_extra"))


@query("S11_merge_suite_results", """
with e as (select o_custkey % 50 as suite, o_orderkey as task_id, o_totalprice > 150000 as ok from orders where o_orderstatus <> 'P'), n as (select o_custkey % 50 as suite, o_orderkey as task_id, o_totalprice > 90000 as ok from orders where o_orderstatus = 'P' and o_custkey % 50 < 20),
m as (select * from e where suite not in (select suite from n) union all select * from n)
select count(*) as total_tasks, count(*) filter (where ok) as passed_tasks, round(count(*) filter (where ok) / count(*), 6) as pass_rate from m""")
def _(t: Tables):
    rows = t.orders.select((F.col("o_custkey") % 50).alias("suite"), F.col("o_orderkey").alias("task_id"), "o_orderstatus", "o_totalprice")
    old = rows.filter("o_orderstatus <> 'P'").select("suite", "task_id", (F.col("o_totalprice") > 150000).alias("all_passed"))
    new = rows.filter("o_orderstatus = 'P' and suite < 20").select("suite", "task_id", (F.col("o_totalprice") > 90000).alias("all_passed"))
    return writers.suite_summary(writers.merge_suite_results(old, new))


@query("S12_parse_metric_exposition", "select 'app:' || event_type || '_total' as name, round(sum(value), 4) as total from events group by 1")
def _(t: Tables):
    path = work_dir(t.spark, "metrics")
    labels_ = F.when(F.col("event_id") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit('{user="'), F.col("user_id").cast("string"), F.lit('"}')))
    line = F.concat(F.lit("app:"), "event_type", F.lit("_total"), labels_, F.lit(" "), F.col("value").cast("string"))
    noise = F.when(F.col("event_id") % 50 == 0, F.array(F.concat(F.lit("# HELP "), "event_type"), line, F.lit(""), F.lit("app:broken nope"))).otherwise(F.array(line))
    t.events.select(F.explode(noise).alias("value")).write.text(path)
    totals = readers.parse_metric_exposition(t.spark.read.text(path))
    return totals.select("name", F.round("total", 4).alias("total"))


TELEMETRY = "ts double, wall string, gpu0_temp double, gpu1_temp double, load1 double"


@query("S13_read_telemetry", """
select count(*) as n, count(case when event_id % 4 <> 0 then value end) as gpu0, round(avg(case when event_id % 4 <> 0 then value end), 6) as gpu0_mean, count(case when user_id % 3 <> 0 then user_id end) as gpu1, round(max(value / 7), 6) as load_max from events""")
def _(t: Tables):
    path = work_dir(t.spark, "telemetry")
    rows = t.events.select(
        (F.unix_micros("ts") / 1e6).alias("ts"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS").alias("wall"), F.when(F.col("event_id") % 4 != 0, F.col("value")).alias("gpu0_temp"),
        F.when(F.col("user_id") % 3 != 0, F.col("user_id").cast("double")).alias("gpu1_temp"), (F.col("value") / 7).alias("load1"))
    rows.write.option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)
    back = readers.read_telemetry(t.spark, path, TELEMETRY)
    return back.agg(F.count(F.lit(1)).alias("n"), F.count("gpu0_temp").alias("gpu0"), F.round(F.avg("gpu0_temp"), 6).alias("gpu0_mean"),
                    F.count("gpu1_temp").alias("gpu1"), F.round(F.max("load1"), 6).alias("load_max"))


@query("S14_read_grader_tasks", """
with r as (select o_orderkey as suite, l.l_linenumber, l.l_partkey as id, case when l_partkey % 2 = 0 then 'own' when o_orderkey % 3 = 0 then 'none' else 'file' end as sp, case when l_suppkey % 2 = 0 then 'match' else 'outcome' end as g from orders join lineitem l on l_orderkey = o_orderkey)
select sp as system_prompt, g as grader, count(*) as n, sum(id)::bigint as ids from r group by 1, 2""")
def _(t: Tables):
    """An order is a suite file, its line items are tests with or without their own graders."""
    kind = lambda name: F.array(F.struct(F.lit(name).alias("type")))
    test = F.struct(
        F.col("l_partkey").alias("id"), F.lit("p").alias("prompt"), F.when(F.col("l_partkey") % 2 == 0, "own").alias("system_prompt"),
        F.when(F.col("l_suppkey") % 2 == 0, kind("match")).alias("graders"))
    tests = t.lineitem.groupBy("l_orderkey").agg(F.collect_list(test).alias("tests"))
    suites = t.orders.join(tests, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_orderkey").alias("suite"), F.when(F.col("o_orderkey") % 3 != 0, "file").alias("system_prompt"), kind("outcome").alias("graders"), "tests")
    tasks = readers.read_grader_tasks(suites)
    return tasks.groupBy(F.coalesce("system_prompt", F.lit("none")).alias("system_prompt"), F.col("graders")[0]["type"].alias("grader")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))


@query("A33_sweep_table", """
with r as (select event_type as regime, user_id % 16 + 1 as concurrency, value from events)
select regime, concurrency, case when concurrency % 2 = 0 then round(min(value), 6) else round(max(value), 6) end as ttft_p50, round(max(value) * 2, 6) as ttft_p99, count(*) as completed from r group by 1, 2""")
def _(t: Tables):
    """One result file per event type and concurrency, as a load test would leave them."""
    path = work_dir(t.spark, "sweep")
    runs = t.events.select("event_type", (F.col("user_id") % 16 + 1).alias("c"), "value")
    stats = runs.groupBy("event_type", "c").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count(F.lit(1)).alias("n"))
    even = F.col("c") % 2 == 0
    body = F.to_json(F.struct(F.when(even, F.col("lo")).alias("p50_ttft_ms"), F.when(~even, F.col("hi")).alias("median_ttft_ms"), (F.col("hi") * 2).alias("p99_ttft_ms"), F.col("n").alias("completed")))
    name = F.concat("event_type", F.lit("-c"), F.col("c").cast("string"), F.lit(".json"))
    stats.select(name.alias("name"), body.alias("value")).write.partitionBy("name").text(path)
    schema = "p50_ttft_ms double, median_ttft_ms double, p99_ttft_ms double, completed long"
    rows = t.spark.read.schema(schema).option("multiLine", True).json(f"{path}/name=*").select("*", F.regexp_extract(F.col("_metadata.file_path"), r"name=([^/]+)/", 1).alias("path"))
    out = rollups.sweep_table(rows)
    return out.select("regime", "concurrency", F.round("ttft_p50", 6).alias("ttft_p50"), F.round("ttft_p99", 6).alias("ttft_p99"), "completed")
