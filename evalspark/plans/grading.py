"""Graders over documents, events and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graders, rollups
from ..operators.graders import graded
from .registry import Tables, query


def outputs(t: Tables):
    return t.texts.select("doc_id", "text", "lang", "source")


@query("G1_grade_exact", """
with r as (select doc_id, 'correctness' as dimension, case when doc_id % 2 = 0 then 1.0 else 0.0 end::double as score from documents)
select *, score >= 0.999 as passed from r""")
def _(t: Tables):
    rows = outputs(t).withColumn("out", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("  "), F.upper("source"), F.lit("\n"))).otherwise(F.concat("source", F.lit("x"))))
    return graded(rows, "correctness", graders.grade_exact("out", "source", case_sensitive=False), 0.999).select("doc_id", "dimension", "score", "passed")


@query("G1_grade_contains", "select doc_id, case when contains(text, lang || 't') then 1.0 else 0.0 end::double as score, contains(text, lang || 't') as passed from documents")
def _(t: Tables):
    return graded(outputs(t), "contains", graders.grade_contains("text", F.concat("lang", F.lit("t")))).select("doc_id", "score", "passed")


@query("G2_grade_regex", r"""select doc_id, regexp_matches(text, '(?i)(^|\s)' || lang || '[a-z]{2,4}(\s|$)')::int::double as score from documents""")
def _(t: Tables):
    pattern = F.concat(F.lit(r"(^|\s)"), "lang", F.lit(r"[a-z]{2,4}(\s|$)"))
    return graded(outputs(t), "regex", graders.grade_regex("text", pattern, case_sensitive=False)).select("doc_id", "score")


@query("G3_grade_number", """
select o_orderkey, (case when o_orderkey % 5 = 0 then 0 when abs(floor(o_totalprice) - o_totalprice) <= 0.5 then 1 else 0 end)::double as score from orders""")
def _(t: Tables):
    text = F.when(F.col("o_orderkey") % 5 == 0, "no digits").otherwise(
        F.concat(F.lit("Step 1: 3 + 4.\nTotal: "), F.regexp_replace(F.floor("o_totalprice").cast("string"), r"(\d)(?=(\d{3})+$)", "$1,"), F.lit(".")))
    rows = t.orders.select("o_orderkey", "o_totalprice", text.alias("out"))
    return graded(rows, "number", graders.grade_number("out", "o_totalprice", 0.5)).select("o_orderkey", "score")


ITEMS = ("th", "que", "und", "zz")
SQL_HITS = "(contains(lower(text), 'th')::int + contains(lower(text), 'que')::int + contains(lower(text), 'und')::int + contains(lower(text), 'zz')::int)"


def items():
    return F.array(*[F.lit(x.upper()) for x in ITEMS])


@query("G4_grade_all_of", f"select doc_id, {SQL_HITS} / 4 as score from documents")
def _(t: Tables):
    return graded(outputs(t), "all", graders.grade_all_of("text", items(), False)).select("doc_id", "score")


@query("G5_grade_none_of", f"select doc_id, case when {SQL_HITS} > 0 then 0.0 else 1.0 end::double as score from documents")
def _(t: Tables):
    return graded(outputs(t), "none", graders.grade_none_of("text", items(), False)).select("doc_id", "score")


@query("G6_grade_outcome", """
select event_id, round(((event_type in ('click', 'purchase'))::int + (regexp_matches(props, '[5-9]\\d'))::int + (user_id % 2 = 0)::int + (event_id % 3 <> 0)::int + (event_type = 'view')::int) / 5, 6) as score from events""")
def _(t: Tables):
    def check(kind, key, value):
        return F.struct(F.lit(kind).alias("type"), F.lit(key).alias("key"), F.lit(value).alias("value"))

    checks = F.array(check("contains", "name", "C"), check("regex", "args", r"[5-9]\d"), check("equals", "user", ""), check("json_valid", "body", ""), check("tool_called", "", "view"))
    u = F.col("user_id").cast("string")
    body = F.when(F.col("event_id") % 3 == 0, F.lit("{broken")).otherwise(F.col("props"))
    rows = t.events.select(
        "event_id", F.create_map(F.lit("name"), "event_type", F.lit("args"), "props", F.lit("user"), u, F.lit("body"), body).alias("output"),
        F.create_map(F.lit("user"), F.when(F.col("user_id") % 2 == 0, u).otherwise(F.lit("x"))).alias("expected"),
        F.array("event_type").alias("tools"), checks.alias("assertions"))
    return rows.select("event_id", F.round(graders.grade_outcome("output", "expected", "tools", "assertions"), 6).alias("score"))


def calls(t: Tables):
    """Ten events make a case: even ids are the expected calls, odd ids the calls made."""
    e = F.col("event_id")
    args = F.when(e % 4 < 2, F.col("props")).otherwise(F.concat(F.lit('{"k": "'), (F.get_json_object("props", "$.k").cast("int") % 3).cast("string"), F.lit('", "p": "X"}')))
    return t.event_rows.select((e / 10).cast("long").alias("case_id"), e.alias("call_id"), F.col("event_type").alias("name"), args.alias("arguments"))


SQL_CALLS = """c as (select event_id // 10 as case_id, event_id as call_id, event_type as name, cast(regexp_extract(props, '[0-9]+', 0) as int) as k, event_id % 4 < 2 as plain from events),
x as (select case_id, call_id, name, plain, case when plain then k else k % 3 end as k from c),
best as (select e.case_id, e.call_id, e.name, max(case when a.call_id is null then 0 when e.plain then 0.5 + 0.5 * (abs(a.k - e.k) < 0.01)::int
   else 0.5 + 0.25 * ((case when a.plain then a.k = e.k else a.k = e.k end)::int + (not a.plain)::int) end) as score
  from (select * from x where call_id % 2 = 0) e left join (select * from x where call_id % 2 = 1) a on a.case_id = e.case_id and a.name = e.name group by 1, 2, 3)"""


@query("J14_best_match_calls", f"with {SQL_CALLS} select case_id, name, count(*) as n_expected, round(sum(score)::double, 6) as score from best group by 1, 2")
def _(t: Tables):
    c = calls(t)
    best = graders.best_match_calls(c.filter("call_id % 2 = 0"), c.filter("call_id % 2 = 1"))
    return best.groupBy("case_id", "name").agg(
        F.sum("n_expected").alias("n_expected"), F.round(F.sum(F.col("best_score") * F.col("n_expected")), 6).alias("score"))


@query("G7_grade_function_calls", f"""with {SQL_CALLS}, b as (select case_id, avg(score) as m from best where case_id % 11 <> 0 group by 1),
extra as (select a.case_id, count(*) filter (where a.case_id % 11 <> 0 and a.name <> 'view' and a.name not in (select e.name from x e where e.case_id = a.case_id and e.call_id % 2 = 0)) as n, count(*) as made from x a where a.call_id % 2 = 1 group by 1),
s as (select e.case_id, round(case when e.case_id % 11 = 0 then 0 else greatest(0, m - least(0.2, 0.05 * n)) end, 6) as score from extra e left join b using (case_id))
select case_id, score, score >= 0.75 as passed from s""")
def _(t: Tables):
    call = F.struct("name", "arguments")
    side = lambda odd: F.array_sort(F.collect_list(F.when(F.col("call_id") % 2 == odd, F.struct("call_id", call.alias("c")))))
    rows = calls(t).groupBy("case_id").agg(side(0).alias("e"), side(1).alias("a")).select(
        "case_id", F.transform("e", lambda x: x["c"]).alias("expected"), F.transform("a", lambda x: x["c"]).alias("actual"), F.array(F.lit("view")).alias("allowed"))
    rows = rows.withColumn("expected", F.when(F.col("case_id") % 11 == 0, F.slice("expected", 1, 0)).otherwise(F.col("expected")))
    out = graded(rows, "function_call", F.round(graders.grade_function_calls("expected", "actual", "allowed"), 6))
    return out.select("case_id", "score", "passed")


@query("G8_args_match", """
with p as (select event_id, event_type as s, value, event_id % 4 as m from events)
select event_id, case m when 0 then true when 1 then abs(value - round(value, 1)) < 0.01 when 2 then s = 'view' else s = 'click' end as matched from p""")
def _(t: Tables):
    m, s, v = F.col("event_id") % 4, F.col("event_type"), F.col("value")
    quote = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    actual = F.when(m == 0, quote(F.concat(F.lit(" "), F.upper(s)))).when(m == 1, v.cast("decimal(18,4)").cast("string")).when(m == 2, quote(s)).otherwise(F.to_json(F.array(s)))
    expected = F.when(m == 0, quote(s)).when(m == 1, quote(F.round(v.cast("decimal(18,4)"), 1).cast("string"))).when(m == 2, F.lit('"view"')).otherwise(F.lit('["click"]'))
    return t.events.select("event_id", graders.args_match(F.try_parse_json(actual), F.try_parse_json(expected)).alias("matched"))


@query("G9_grade_tool_channel", """
with r as (select event_id, event_type as tool, event_id % 5 as m, event_id % 7 = 0 as leaked, cast(regexp_extract(props, '[0-9]+', 0) as varchar) as k, event_type in ('click', 'view') as hit from events)
select event_id, (case m when 0 then case when event_id % 2 = 1 and not leaked then 1 else 0.5 end
  when 1 then case when tool = 'error' then 0 when not hit and leaked then 0.5 else case when hit then 0.5 else 0 end end
  when 2 then case when tool = 'click' then 0.5 + 0.5 * contains(k, '1')::int when leaked then 0.5 else 0 end
  when 3 then 1 else case when leaked then 0.5 else 0 end end)::double as score from r""")
def _(t: Tables):
    m, tool = F.col("event_id") % 5, F.col("event_type")
    none = F.array().cast("array<string>")
    detail = F.array(F.struct(tool.alias("name"), F.col("props").alias("arguments")))
    spec_type = "array<struct<tool:string,key:string,needles:array<string>>>"
    spec = F.array(F.struct(F.lit("click").alias("tool"), F.lit("k").alias("key"), F.array(F.lit("1")).alias("needles"))).cast(spec_type)
    rows = t.events.select(
        "event_id", F.when((m == 0) & (F.col("event_id") % 2 == 1) | (m == 4), none).otherwise(F.array(tool)).alias("called"), detail.alias("details"),
        (F.col("event_id") % 7 == 0).alias("leaked"), F.when(m == 1, F.array(F.lit("click"), F.lit("view"))).when(m == 2, F.array(F.lit("click"))).otherwise(none).alias("required"),
        (m == 0).alias("no_tool"), F.when(m == 1, F.array(F.lit("error"))).otherwise(none).alias("forbidden"), F.when(m == 2, spec).otherwise(F.array().cast(spec_type)).alias("arg_specs"))
    return rows.select("event_id", graders.grade_tool_channel(rows).alias("score"))


@query("G10_grade_json", """
with k as (select event_id, cast(regexp_extract(props, '[0-9]+', 0) as int) as k from events)
select event_id, case when event_id % 6 = 0 then 0 else round(((k > 20)::int + (k % 2 = 0)::int + 1) / 3, 6) end::double as score, event_id % 6 <> 0 and k > 20 and k % 2 = 0 as passed from k""")
def _(t: Tables):
    text = F.when(F.col("event_id") % 6 == 0, F.lit("sorry")).otherwise(F.concat(F.lit("Answer: "), "props", F.lit(" ok")))
    checks = ["variant_get(data, '$.k', 'int') > 20", "variant_get(data, '$.k', 'int') % 2 = 0", "json_array_length(to_json(data)) is null"]
    out = graders.grade_json(t.events.select("event_id", text.alias("text")), "text", checks)
    return out.select("event_id", F.round("score", 6).alias("score"), "passed")


def simulations(t: Tables):
    """Ten events make a simulation; its checks are the events, its basis depends on the case."""
    e, v = F.col("event_id"), F.col("value")
    row = F.struct(e.alias("o"), (v >= 30).alias("met"), F.when(e % 4 == 0, "WRITE").when(e % 4 == 1, "read").when(e % 4 == 2, "other").alias("kind"))
    g = t.events.groupBy((e / 10).cast("long").alias("case_id")).agg(F.array_sort(F.collect_list(row)).alias("c"), F.max("value").alias("top"))
    case = F.col("case_id") % 4
    flags = F.transform("c", lambda x: F.struct(x["met"].alias("met")))
    basis = F.when(case == 0, F.array(F.lit("DB"), F.lit("ACTION"))).when(case == 1, F.array(F.lit("ENV_ASSERTION"), F.lit("COMMUNICATE"), F.lit("NL_ASSERTION"))).when(
        case == 2, F.array(F.lit("ACTION"), F.lit("ENV_ASSERTION"))).otherwise(F.array().cast("array<string>"))
    return g.select(
        "case_id", basis.alias("reward_basis"), F.struct(F.when(F.col("case_id") % 8 != 0, (F.col("top") >= 100).cast("double")).alias("db_reward")).alias("db_check"),
        flags.alias("env_assertions"), F.transform("c", lambda x: F.struct(x["met"].alias("action_match"), x["kind"].alias("tool_type"))).alias("action_checks"),
        F.slice(flags, 1, 4).alias("communicate_checks"), "top")


SQL_SIMS = """e as (select event_id // 10 as case_id, event_id, value >= 30 as met, case event_id % 4 when 0 then 1.0 when 1 then 0.3 else 0.5 end as w, value from events),
p as (select *, min(met::int) over (partition by case_id order by event_id rows unbounded preceding) as pre from e),
g as (select case_id, case when case_id % 8 <> 0 then (max(value) >= 100)::int else 0 end as db, sum(w * met::int) / sum(w) as act, avg(met::int) as env, avg(pre) as pre, avg(met::int) filter (where event_id % 10 < 4) as com from p group by 1)"""


@query("G11_reward_dense", f"""with {SQL_SIMS} select case_id, round(case case_id % 4 when 0 then (db + act) / 2 when 1 then (env + com) / 3 when 2 then (act + env) / 2 end, 6) as dense,
  round(case case_id % 4 when 0 then (db + pre) / 2 when 1 then (pre + com) / 3 when 2 then pre end, 6) as prefix,
  round(case case_id % 4 when 0 then (3 * db + act) / 4 when 1 then (env + com) / 2 when 2 then (act + env) / 2 end, 6) as weighted from g""")
def _(t: Tables):
    return simulations(t).select(
        "case_id", F.round(graders.reward_dense(), 6).alias("dense"), F.round(graders.reward_dense("monotone_prefix"), 6).alias("prefix"),
        F.round(graders.reward_dense(basis_weights={"DB": 3.0}, exclude_judged=True), 6).alias("weighted"))


def results(t: Tables):
    return t.lineitem.select(
        F.col("l_orderkey").alias("case_id"), F.format_string("t%03d-%d", (F.col("l_partkey") % 1000).cast("int"), F.col("l_suppkey").cast("int")).alias("test"), (F.col("l_quantity") >= 12).alias("passed"))


@query("G12_sparse_binary", "select l_orderkey as case_id, count(*) filter (where l_quantity >= 12) as passed, count(*) as total, bool_and(l_quantity >= 12)::int::double as reward from lineitem group by 1")
def _(t: Tables):
    return graders.sparse_binary(results(t))


@query("G13_partial_credit", """
with r as (select l_orderkey as case_id, printf('t%03d-%d', l_partkey % 1000, l_suppkey) as test, l_quantity >= 12 as ok from lineitem),
f as (select case_id, test, row_number() over (partition by case_id order by test) as rn from r where not ok), a as (select case_id, string_agg(test, ';' order by rn) as ff from f where rn <= 3 group by 1)
select r.case_id, count(*) filter (where ok) as passed, count(*) as total, round(count(*) filter (where ok) / count(*), 6) as score, coalesce(any_value(ff), '') as first_failures from r left join a using (case_id) group by 1""")
def _(t: Tables):
    out = graders.partial_credit(results(t))
    return out.select("case_id", "passed", "total", F.round("score", 6).alias("score"), F.array_join("first_failures", ";").alias("first_failures"))


@query("G14_compare_stdout", """select doc_id, case when doc_id % 4 = 3 then false else true end as same from documents where length(trim(text)) > 0""")
def _(t: Tables):
    m = F.col("doc_id") % 4
    other = (
        F.when(m == 0, F.replace("text", F.lit("\n"), F.lit(" \t\r\n"))).when(m == 1, F.concat("text", F.lit("  \n\n \n"))).when(m == 2, F.col("text"))
        .otherwise(F.concat(F.lit(" "), "text")))
    rows = t.texts.filter(F.length(F.trim("text")) > 0)
    return rows.select("doc_id", graders.compare_stdout(other, "text").alias("same"))


@query("G15_claw_score", """
with s as (select event_id, (0.8 * least(1, value / 100) + 0.2 * (user_id % 5) / 5) * (event_type <> 'error')::int as s from events) select event_id, round(s, 6) as score, s >= 0.75 as passed from s""")
def _(t: Tables):
    rows = t.events.select("event_id", F.least(F.lit(1.0), F.col("value") / 100).alias("c"), ((F.col("user_id") % 5) / 5).alias("r"), (F.col("event_type") != "error").cast("int").alias("s"))
    return graded(rows, "claw", graders.claw_score("c", "r", "s")).select("event_id", F.round("score", 6).alias("score"), "passed")


@query("G16_judge_scores", """
with k as (select event_type as model, event_id % 5 as m, cast(regexp_extract(props, '[0-9]+', 0) as int) / 100 as s from events)
select model, count(*) as n, count(*) filter (where m = 3) as errors, round(avg(case when m <> 3 then s end), 6) as mean_score from k group by 1""")
def _(t: Tables):
    m, s = F.col("event_id") % 5, F.concat(F.lit('{"score": '), (F.get_json_object("props", "$.k").cast("int") / 100).cast("string"), F.lit(', "reasoning": "r"}'))
    text = (
        F.when(m == 0, s).when(m == 1, F.concat(F.lit('<think>{"score": 9}</think> '), s)).when(m == 2, F.concat(F.lit("```json\n"), s, F.lit("\n```")))
        .when(m == 3, F.lit("I would say good")).otherwise(F.concat(F.lit("So: "), s, F.lit(" done"))))
    scored = t.events.select(F.col("event_type").alias("model"), graders.judge_score(text).alias("score"))
    return scored.groupBy("model").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("score").isNull()).alias("errors"), F.round(F.avg("score"), 6).alias("mean_score"))


@query("G17_pairwise_winrate", """
with r as (select event_type as model, case when value > 60 then 'A' when value > 20 then 'B' else 'TIE' end as v, user_id % 2 = 0 as sw, value / 100 as c from events),
o as (select *, case when v = 'TIE' then 'tie' when sw then case v when 'A' then 'B' else 'A' end else v end as w from r)
select model, count(*) as n, round(avg((w = 'A')::int), 6) as winrate, round(2 * avg((w = 'A')::int), 6) as double_winrate, count(*) filter (where w = 'tie') as ties, round(avg(greatest(0.5, least(1, c))), 6) as confidence,
  round(avg((v = 'A')::int), 6) as first_slot_rate from o group by model""")
def _(t: Tables):
    v = F.col("value")
    rows = t.events.select(F.col("event_type").alias("model"), F.when(v > 60, "a").when(v > 20, "B").otherwise("tie").alias("verdict"), (F.col("user_id") % 2 == 0).alias("swapped"), (v / 100).alias("confidence"))
    return graders.pairwise_winrate(rows, ["model"])


@query("G18_score_fidelity")
def _(t: Tables):
    """Whole conversation turns as real output; simulated output drops a line, differs in its exit code or is missing."""
    c = t.conversations.withColumn("exit_code", (F.col("turn") % 2).cast("int"))
    sim = c.filter("turn % 5 <> 4").select(
        "conv_id", "turn", F.when(F.col("turn") % 3 == 0, F.col("text")).otherwise(F.regexp_replace("text", r"^[^\n]*\n?", "")).alias("sim_stdout"),
        F.when(F.col("turn") % 4 == 0, F.lit(1)).otherwise(F.col("exit_code")).alias("sim_exit"))
    steps = graders.score_fidelity(c.select("conv_id", "turn", F.col("text").alias("stdout"), "exit_code"), sim, ["conv_id", "turn"])
    return rollups.fidelity_summary(steps.withColumn("conv", F.col("conv_id") % 10), ["conv"])


@query("G_eval_run", f"""
with o as (select doc_id // 2 as task_id, doc_id % 2 as trial, source as suite, text, lang from documents),
g as (select task_id, trial, suite, 'contains' as dimension, contains(text, lang || 't')::int::double as score, contains(text, lang || 't') as passed from o
  union all select task_id, trial, suite, 'all', {SQL_HITS} / 4, {SQL_HITS} / 4 >= 0.5 from o
  union all select task_id, trial, suite, 'length', least(1.0, length(text) / 800), length(text) >= 600 from o),
s as (select suite, task_id, trial, sum(score::decimal(28,10))::double / count(*) as score, bool_and(passed) as passed from g group by 1, 2, 3),
k as (select suite, task_id, bool_and(passed) as all_passed, sum(score::decimal(28,10))::double / count(*) as avg_score, count(*) as trials from s group by 1, 2)
select suite, count(*) as n_tasks, count(*) filter (where all_passed) as all_passed, sum(trials)::bigint as trials, floor(sum(avg_score::decimal(28,10))::double / count(*) * 1e6 + 0.5) / 1e6 as avg_score from k group by suite""")
def _(t: Tables):
    """A whole evaluation run: three graders in one scan, task scores per trial, pass^k per task, leaderboard per suite."""
    rows = outputs(t).select((F.col("doc_id") / 2).cast("long").alias("task_id"), (F.col("doc_id") % 2).alias("trial"), F.col("source").alias("suite"), "text", "lang")
    grades = graders.run_graders(rows, {
        "contains": (graders.grade_contains("text", F.concat("lang", F.lit("t"))), 0.75),
        "all": (graders.grade_all_of("text", items(), False), 0.5),
        "length": (F.least(F.lit(1.0), F.length("text") / 800), 0.75)}, ["suite", "task_id", "trial"])
    trials = grades.groupBy("suite", "task_id", "trial").agg(rollups.exact_mean("score").alias("score"), F.bool_and("passed").alias("passed"))
    tasks = rollups.task_pass_k(trials, ["suite", "task_id"])
    board = tasks.groupBy("suite").agg(
        F.count(F.lit(1)).alias("n_tasks"), F.count_if("all_passed").alias("all_passed"), F.sum("trials").alias("trials"), rollups.exact_mean("avg_score").alias("m"))
    return board.select("suite", "n_tasks", "all_passed", "trials", (F.floor(F.col("m") * 1e6 + 0.5) / 1e6).alias("avg_score"))
