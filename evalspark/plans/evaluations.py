"""Roll-ups, ordered operators and experiment statistics over events, orders and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vectors import cosine
from ..operators import experiments, rollups, sequences, tables, textstats
from .registry import Tables, query
from .views import SQL_TRIALS, trials

MODELS = ["click", "error", "purchase", "signup", "view"]


def rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


def nearest_millionth(df, *names):
    """Rounding in plain double steps, which every engine takes alike; round() differs where a mean ends in half a unit."""
    return df.withColumns({n: F.floor(F.col(n) * 1e6 + 0.5) / 1e6 for n in names})


def grades(t: Tables):
    """Ten events make one attempt; every event type is a graded dimension."""
    return t.events.select(
        (F.col("event_id") / 10).cast("long").alias("task_id"), (F.col("event_id") % 2).alias("trial"), F.col("event_type").alias("dimension"),
        F.least(F.lit(1.0), F.col("value") / 100).alias("score"), (F.col("value") >= 15).alias("passed"))


@query("A1_task_score", """
with g as (select event_id // 10 as task_id, event_id % 2 as trial, least(1.0, value / 100) as score, value >= 15 as passed, event_type from events),
t as (select distinct task_id, trial from g union all select -1, 0), s as (select task_id, trial, (sum(score::decimal(28,10))::double / nullif(count(score), 0)) as score, bool_and(passed) as passed from g where event_type <> 'error' group by 1, 2)
select t.task_id, t.trial, floor(s.score * 1e6 + 0.5) / 1e6 as score, s.passed from t left join s using (task_id, trial)""")
def _(t: Tables):
    g = grades(t)
    attempts = g.select("task_id", "trial").distinct().union(g.agg(F.lit(-1).cast("long"), F.lit(0).cast("long")))
    return nearest_millionth(rollups.task_score(g.filter("dimension <> 'error'"), attempts), "score").select("task_id", "trial", "score", "passed")


@query("A2_task_pass_k", f"with {SQL_TRIALS} select model, task_id, count(*) as trials, bool_and(passed) as all_passed, floor((sum(score::decimal(28,10))::double / nullif(count(score), 0)) * 1e6 + 0.5) / 1e6 as avg_score from trials group by 1, 2")
def _(t: Tables):
    return nearest_millionth(rollups.task_pass_k(trials(t), ["model", "task_id"]), "avg_score")


@query("A3_trace_rollup", f"""with {SQL_TRIALS} select model, count(distinct task_id) as tasks, count(*) as trials, count(*) filter (where trial % 3 <> 0) as graded,
  count(*) filter (where passed) as passed, round(count(*) filter (where passed) / count(*), 6) as pass_rate, round(avg(score), 6) as avg_task_score,
  round(avg(wall * 10), 6) as avg_tokens, round(avg(wall), 6) as avg_duration from trials group by model""")
def _(t: Tables):
    rows = trials(t).withColumns({"graded": F.col("trial") % 3 != 0, "task_score": F.col("score"), "tokens": F.col("wall") * 10, "duration": F.col("wall")})
    return rounded(rollups.trace_rollup(rows, ["model"]), "pass_rate", "avg_task_score", "avg_tokens", "avg_duration")


@query("A4_pass_cubed", f"""with {SQL_TRIALS}, f as (select * from trials qualify row_number() over (partition by model, task_id order by trial) <= 3),
k as (select model, task_id, count(*) as n, bool_and(passed) as ok from f group by 1, 2)
select model, count(*) filter (where n >= 3 and ok) as pass3, count(*) filter (where n >= 3) as pass3_eligible from k group by model""")
def _(t: Tables):
    return rollups.pass_cubed(trials(t), ["model"])


@query("A5_trial_band", f"""with {SQL_TRIALS}, m as (select model, trial % 3 + 1 as trial, (sum(score::decimal(28,10))::double / nullif(count(score), 0)) as m from trials group by 1, 2)
select model, count(*) as trials, round(avg(m), 6) as mean, round((max(m) - min(m)) / 2, 6) as half_range, round(min(m), 6) as low, round(max(m), 6) as high, round(stddev_pop(m), 6) as std from m group by model""")
def _(t: Tables):
    rows = trials(t).withColumn("trial", F.col("trial") % 3 + 1)
    return rounded(rollups.trial_band(rows, ["model"]), "mean", "half_range", "low", "high", "std")


def tests(t: Tables):
    e = F.col("event_id")
    bucket = F.when(e % 4 == 0, "inprocess").when(e % 4 == 1, "external").when(e % 4 == 2, "")
    return t.events.select(F.col("event_type").alias("alias"), bucket.alias("bucket"), (F.col("value") >= 20).alias("all_passed"))


SQL_TESTS = """tests as (select event_type as alias, case event_id % 4 when 0 then 'inprocess' when 1 then 'external' else 'untagged' end as bucket, value >= 20 as ok from events)"""


@query("A6_bucket_stats", f"with {SQL_TESTS} select alias, bucket, count(*) as total, count(*) filter (where ok) as passed, round(count(*) filter (where ok) / count(*), 3) as pass_rate from tests group by 1, 2")
def _(t: Tables):
    return rollups.bucket_stats(tests(t), ["alias"])


@query("A7_gate_check", f"""with {SQL_TESTS}, tiers(alias, tier, fc_gate, gi, ge) as (values ('click','reasoning',0.6,0.7,0.5),('view','fast',0.7,null,0.66),('signup','fast',null,0.6,null)),
a as (select alias, 'overall' as gate, count(*) filter (where ok) / count(*) as actual from tests group by 1
  union all select alias, bucket, round(count(*) filter (where ok) / count(*), 3) from tests where bucket <> 'untagged' group by 1, 2),
g as (select alias, 'overall' as gate, fc_gate as threshold from tiers union all select alias, 'inprocess', gi from tiers union all select alias, 'external', ge from tiers)
select alias, gate, round(actual, 6) as actual, threshold::double as threshold, actual >= threshold as passed from a join g using (alias, gate) where threshold is not null""")
def _(t: Tables):
    tiers = t.spark.createDataFrame(
        [("click", 0.6, 0.7, 0.5), ("view", 0.7, None, 0.66), ("signup", None, 0.6, None)],
        "alias string, fc_gate double, fc_gate_inprocess double, fc_gate_external double")
    return rounded(rollups.gate_check(tests(t), tiers), "actual").select("alias", "gate", "actual", "threshold", "passed")


def suite_tasks(t: Tables):
    """Task records: an order is a task, its line items are trials with two graded dimensions."""
    grade = F.array(
        F.struct(F.lit("price").alias("dimension"), (F.col("l_discount") * 10).alias("score")),
        F.struct(F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("dimension"), (F.col("l_quantity") / 50).alias("score")))
    tr = t.lineitem.groupBy("l_orderkey").agg(
        F.collect_list(F.struct(grade.alias("grades"))).alias("trials"), F.bool_and(F.col("l_quantity") >= 10).alias("all_passed"),
        F.avg(F.col("l_quantity") / 50).alias("avg_score"))
    return t.orders.select("o_orderkey", F.col("o_orderpriority").alias("suite"), "o_orderstatus").join(tr, F.col("o_orderkey") == F.col("l_orderkey"))


SQL_SUITE = """tk as (select o_orderpriority as suite, o_orderstatus, o_orderkey, bool_and(l_quantity >= 10) as ok, avg(l_quantity / 50) as sc from orders join lineitem on l_orderkey = o_orderkey group by 1, 2, 3)"""


@query("A8_suite_leaderboard", f"with {SQL_SUITE} select suite, count(*) as n_tasks, round(avg(sc), 3) as avg_score, count(*) filter (where ok) as all_passed from tk group by suite")
def _(t: Tables):
    return rollups.suite_leaderboard(suite_tasks(t))[0]


@query("A8_suite_dimensions", """
with g as (select o_orderpriority as suite, 'price' as dimension, l_discount * 10 as s from orders join lineitem on l_orderkey = o_orderkey
  union all select o_orderpriority, case when l_returnflag <> 'N' then l_returnflag else 'unknown' end, l_quantity / 50 from orders join lineitem on l_orderkey = o_orderkey)
select suite, dimension, round(avg(s), 3) as avg_score from g group by 1, 2""")
def _(t: Tables):
    return rollups.suite_leaderboard(suite_tasks(t))[1]


@query("A9_refusal_rates", """
with r as (select d.source, d.lang = 'en' as harmful, d.n_chars < 300 as refused from documents d)
select source, count(*) filter (where harmful) as n_harmful, round(coalesce(count(*) filter (where harmful and refused) / nullif(count(*) filter (where harmful), 0), 0), 6) as refusal_rate,
  round(coalesce(count(*) filter (where harmful and not refused) / nullif(count(*) filter (where harmful), 0), 0), 6) as compliance_rate, count(*) filter (where not harmful) as n_safe,
  round(coalesce(count(*) filter (where not harmful and refused) / nullif(count(*) filter (where not harmful), 0), 0), 6) as over_refusal_rate from r group by source""")
def _(t: Tables):
    rows = t.documents.select("source", (F.col("lang") == "en").alias("harmful"), (F.col("n_chars") < 300).alias("refused"))
    return rollups.refusal_rates(rows, ["source"])


@query("A10_model_status", """
with m as (select c_custkey as model from customer), a as (select distinct o_custkey as k from orders where o_orderstatus = 'P'), b as (select distinct o_custkey as k from orders where o_totalprice > 400000)
select model, case when a.k is not null and b.k is not null then 'complete' when a.k is null and b.k is null then 'no data' else 'partial' end as status
from m left join a on a.k = model left join b on b.k = model""")
def _(t: Tables):
    o = t.orders.withColumnRenamed("o_custkey", "model")
    return rollups.model_status(t.customer.select(F.col("c_custkey").alias("model")), o.filter("o_orderstatus = 'P'"), o.filter("o_totalprice > 400000"))


SUITES = ["1-URGENT", "2-HIGH", "3-MEDIUM"]


@query("A11_run_row", f"""with {SQL_SUITE} select o_orderstatus as run, round(avg(ok::int) filter (where suite = '1-URGENT'), 3) as "score_1-URGENT",
  round(avg(ok::int) filter (where suite = '2-HIGH'), 3) as "score_2-HIGH", round(avg(ok::int) filter (where suite = '3-MEDIUM'), 3) as "score_3-MEDIUM" from tk group by 1""")
def _(t: Tables):
    return rollups.run_row(suite_tasks(t).withColumnRenamed("o_orderstatus", "run"), ["run"], SUITES)


SQL_CELLS = ", ".join(f"coalesce(cast(sum(passed::int) filter (where model = '{m}' and n > 0) as varchar), '-') as {m}" for m in MODELS)


@query("A12_model_matrix", f"""with {SQL_TRIALS}, c as (select task_id, model, passed, 1 as n from trials where not (model = 'view' and task_id % 4 = 0)) select task_id, {SQL_CELLS} from c group by task_id""")
def _(t: Tables):
    cells = trials(t).filter("not (model = 'view' and task_id % 4 = 0)")
    return rollups.model_matrix(cells, "task_id", MODELS, F.sum(F.col("passed").cast("int")))


SQL_METRIC = "\nunion all ".join(
    f"select '{m}' as metric, " + ", ".join(f"cast(max({m}) filter (where model = '{x}') as varchar) as {x}" for x in MODELS) + " from s" for m in ("trials", "tasks", "passed"))


@query("A12_metric_matrix", f"with {SQL_TRIALS}, s as (select model, count(*) as trials, count(distinct task_id) as tasks, count(*) filter (where passed) as passed from trials group by 1) {SQL_METRIC}")
def _(t: Tables):
    rows = trials(t).withColumn("graded", F.lit(True))
    return rollups.metric_matrix(rollups.trace_rollup(rows, ["model"]), ["trials", "tasks", "passed"], MODELS)


@query("A13_arm_summary", f"""with {SQL_TRIALS}, s as (select model as arm, count(*) as trials, round(avg(score), 3) as mean_task_score, round(avg(wall / 500), 3) as mean_completion, round(avg(passed::int), 3) as pass_rate from trials group by 1)
select *, round(mean_task_score - (select mean_task_score from s where arm = 'view'), 3) as delta from s""")
def _(t: Tables):
    rows = trials(t).select(F.col("model").alias("arm"), F.col("score").alias("task_score"), (F.col("wall") / 500).alias("completion"), "passed")
    return rollups.arm_summary(rows, "view")


@query("A16_corpus_stats", "select source, count(*) as docs, sum(n_chars)::bigint as chars, (sum(n_chars) // count(*))::bigint as avg_chars from documents group by source")
def _(t: Tables):
    return rollups.corpus_stats(t.documents, "source", "n_chars")


@query("A24_score_distribution", """
with r as (select case when value >= 100 then 1.0 else 0.0 end as official, case when event_id % 13 = 0 then null when value >= 100 then 1.0 when value < 10 then 0.0 else value / 100 end as dense from events)
select case when official >= 1 then 'passed' when dense <= 0 then '0' when dense <= 0.25 then '(0,.25]' when dense <= 0.5 then '(.25,.5]' when dense <= 0.75 then '(.5,.75]' else '(.75,1)' end as bucket,
  count(*) as n, count(*) filter (where official < 1 and dense > 1e-9) as recovered, count(*) filter (where official < 1 and dense <= 1e-9) as dead,
  count(*) filter (where official >= 1 and abs(dense - 1) > 1e-9) as breaches from r where dense is not null group by 1""")
def _(t: Tables):
    v = F.col("value")
    dense = F.when(F.col("event_id") % 13 == 0, F.lit(None).cast("double")).when(v >= 100, 1.0).when(v < 10, 0.0).otherwise(v / 100)
    return rollups.score_distribution(t.events.select(F.when(v >= 100, 1.0).otherwise(0.0).alias("official"), dense.alias("dense")))


def requests(t: Tables):
    return t.events.select(
        F.col("event_type").alias("arm"), (F.col("event_id") % 17 != 0).alias("ok"), F.col("value").alias("ttft_ms"), (F.col("value") / (1 + F.col("user_id") % 7)).alias("tpot_ms"),
        (F.col("user_id") + 1).alias("out_tokens"), F.unix_seconds("ts").alias("start_s"), (F.unix_seconds("ts") + 60).alias("end_s"))


@query("A25_latency_summary", """
with r as (select event_type as arm, event_id % 17 <> 0 as ok, value as ttft, value / (1 + user_id % 7) as tpot, user_id + 1 as tok, floor(epoch(ts)) as s from events),
g as (select *, row_number() over (partition by arm order by ttft) - 1 as r1, row_number() over (partition by arm order by tpot) - 1 as r2, count(*) over (partition by arm) as n from r where ok),
p as (select arm, max(case when r1 = round_even(0.5 * (n - 1), 0) then ttft end) as ttft_p50_ms, max(case when r1 = round_even(0.99 * (n - 1), 0) then ttft end) as ttft_p99_ms,
  max(case when r2 = round_even(0.5 * (n - 1), 0) then tpot end) as tpot_p50_ms, max(case when r2 = round_even(0.99 * (n - 1), 0) then tpot end) as tpot_p99_ms from g group by arm)
select r.arm, count(*) filter (where ok) as n_ok, count(*) filter (where not ok) as n_failed, round(avg(ttft) filter (where ok), 6) as mean_ttft_ms, round(avg(tpot) filter (where ok), 6) as mean_tpot_ms,
  round(sum(tok) filter (where ok) / (max(s) + 60 - min(s)), 6) as tokens_per_s, any_value(ttft_p50_ms) as ttft_p50_ms, any_value(ttft_p99_ms) as ttft_p99_ms, any_value(tpot_p50_ms) as tpot_p50_ms, any_value(tpot_p99_ms) as tpot_p99_ms
from r join p on p.arm = r.arm group by r.arm""")
def _(t: Tables):
    return rollups.latency_summary(requests(t), "arm")


COUNTERS = {"ttft_sum": "click", "ttft_count": "view", "tpot_sum": "error", "tpot_count": "signup", "generated": "purchase", "drafts": "view", "accepted": "click", "drafted": "error"}


@query("A26_counter_delta", """
with d as (select event_type as name, (max_by(event_id, ts) - min_by(event_id, ts))::double as d from events group by 1), w as (select
  max(case when name = 'click' then d end) as c, max(case when name = 'view' then d end) as v, max(case when name = 'error' then d end) as e, max(case when name = 'signup' then d end) as s, max(case when name = 'purchase' then d end) as p from d)
select round(c / v * 1000, 6) as avg_ttft_ms, round(e / s * 1000, 6) as avg_tpot_ms, round(p / 3600, 6) as tokens_per_s, round(c / v, 6) as accept_length, round(c / e * 100, 6) as accept_rate from w""")
def _(t: Tables):
    samples = t.events.select("ts", F.col("event_type").alias("name"), F.col("event_id").cast("double").alias("value"))
    return rollups.speed_from_counters(rollups.counter_delta(samples), [], 3600.0, COUNTERS)


@query("A27_embedding_discrimination", """
with p as (select a.label = b.label as sim, list_dot_product(a.embedding::double[], b.embedding::double[]) / (sqrt(list_dot_product(a.embedding::double[], a.embedding::double[])) * sqrt(list_dot_product(b.embedding::double[], b.embedding::double[]))) as c
  from embeddings a join embeddings b on b.vec_id = a.vec_id + 1)
select round(avg(c) filter (where sim), 4) as avg_similar, round(avg(c) filter (where not sim), 4) as avg_dissimilar, round(avg(c) filter (where sim) - avg(c) filter (where not sim), 4) as discrimination from p""")
def _(t: Tables):
    a = t.embeddings.select("vec_id", "embedding", "label")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"), F.col("label").alias("other_label"))
    pairs = a.join(b, "vec_id").select(cosine("embedding", "other").alias("cosine"), (F.col("label") == F.col("other_label")).alias("similar"))
    return rollups.embedding_discrimination(pairs, "cosine", "similar")


def two_measurements(t: Tables):
    """Tokens per order: pieces of its total against its lines; some are invalid (0)."""
    base = t.orders.select(F.col("o_orderkey").alias("i"), F.when(F.col("o_orderkey") % 7 == 0, 0).otherwise(F.floor("o_totalprice")).alias("tokens"))
    cap = t.lineitem.groupBy(F.col("l_orderkey").alias("i")).agg(F.floor(F.sum(F.when(F.col("l_quantity") > 5, F.col("l_extendedprice")).otherwise(0.0))).alias("tokens"))
    return base, cap


SQL_PAIRED = """b as (select o_orderkey as i, case when o_orderkey % 7 = 0 then 0 else floor(o_totalprice) end as base from orders),
c as (select l_orderkey as i, floor(sum(case when l_quantity > 5 then l_extendedprice else 0 end)) as other from lineitem group by 1),
p as (select i, base::bigint as base, other::bigint as other from b join c using (i) where base > 0 and other > 0)"""


@query("J12_pair_runs", f"with {SQL_PAIRED} select i, base, other from p")
def _(t: Tables):
    return tables.pair_runs(*two_measurements(t), "i", "tokens")


@query("A28_token_saving", f"with {SQL_PAIRED} select count(*) as n, round(avg((base - other) / base), 6) as saving, round(avg(base), 6) as base_mean, round(avg(other), 6) as other_mean from p")
def _(t: Tables):
    return rollups.token_saving(tables.pair_runs(*two_measurements(t), "i", "tokens"))


@query("A29_fidelity_summary", """
with s as (select event_type as m, event_id % 3 <> 0 as parsed_ok, event_id % 3 <> 0 and user_id % 2 = 0 as exit_match, value > 50 as exact_stdout, least(1, value / 200) as stdout_seq, least(1, value / 300) as stdout_lines from events)
select m as model, count(*) as steps, round(avg(parsed_ok::int), 6) as parsed_ok, round(avg(exit_match::int), 6) as exit_match, round(avg(exact_stdout::int), 6) as exact_stdout,
  round(avg(stdout_seq), 6) as stdout_seq, round(avg(stdout_lines), 6) as stdout_lines from s group by m""")
def _(t: Tables):
    ok = F.col("event_id") % 3 != 0
    rows = t.events.select(
        F.col("event_type").alias("model"), ok.alias("parsed_ok"), (ok & (F.col("user_id") % 2 == 0)).alias("exit_match"), (F.col("value") > 50).alias("exact_stdout"),
        F.least(F.lit(1.0), F.col("value") / 200).alias("stdout_seq"), F.least(F.lit(1.0), F.col("value") / 300).alias("stdout_lines"))
    return rollups.fidelity_summary(rows, ["model"])


def rewards(t: Tables):
    return t.events.select("event_id", F.col("event_type").alias("model"), F.when(F.col("value") >= 60, 1.0).otherwise(0.0).alias("reward"),
                           (F.col("user_id") % 4 == 0).alias("gamed"), (F.col("user_id") % 4 == 0).alias("excluded"))


@query("A30_reward_batch", """
with r as (select event_type as model, case when value >= 60 then 1.0 else 0.0 end as reward, user_id % 4 = 0 as gamed from events)
select model, count(*) as n, round(avg(gamed::int), 6) as gaming_rate, round(avg((reward >= 1)::int), 6) as solve_rate, round(avg(case when gamed then -1.0 else reward end), 6) as mean_train_reward from r group by model""")
def _(t: Tables):
    shaped, rates = rollups.reward_batch(rewards(t), ["model"])
    return rates.join(shaped.groupBy("model").agg(F.round(F.avg("train_reward"), 6).alias("mean_train_reward")), "model")


def games(t: Tables):
    """Head-to-head results: one game per user, best click value against best view value."""
    side = lambda kind: F.coalesce(F.max(F.when(F.col("event_type") == kind, F.col("value"))), F.lit(0.0))
    return t.events.groupBy("user_id").agg(side("click").alias("a_bank"), side("view").alias("b_bank")).withColumns({
        "a_status": F.when(F.col("user_id") % 20 == 0, "ERROR").otherwise("DONE"), "b_status": F.lit("DONE")})


SQL_GAMES = """games as (select user_id, coalesce(max(case when event_type = 'click' then value end), 0) as a, coalesce(max(case when event_type = 'view' then value end), 0) as b,
  user_id % 20 = 0 as err from events group by 1)"""


@query("A31_margin_summary", f"""with {SQL_GAMES}, n as (select count(*) as n from games)
select count(*) as games, count(*) filter (where a > b) as wins, count(*) filter (where a = b) as ties, count(*) filter (where a < b) as losses, count(*) filter (where err) as errors,
  round(100.0::double * count(*) filter (where a > b) / count(*), 6) as win_percent, round(avg(a), 6) as a_mean, min(a) as a_min, max(a) as a_max, round(avg(b), 6) as b_mean, min(b) as b_min, max(b) as b_max,
  (list_sort(list(a)))[count(*) // 2 + 1] as a_median, (list_sort(list(b)))[count(*) // 2 + 1] as b_median from games""")
def _(t: Tables):
    return rollups.margin_summary(games(t))


@query("A32_config_ranking", """
with g as (select event_type as config, user_id as seed, avg(value) as ours, avg(user_id) as theirs from events group by 1, 2), s as (select seed from g group by 1 having count(*) = (select count(distinct config) from g))
select config, round(avg(ours - theirs), 6) as margin, round(avg(ours), 6) as ours, round(avg(theirs), 6) as theirs, count(*) filter (where ours > theirs) as wins, count(*) as n, avg(ours - theirs) > -30 + 5 as accept
from g join s using (seed) group by config""")
def _(t: Tables):
    rows = t.events.groupBy(F.col("event_type").alias("config"), F.col("user_id").alias("seed")).agg(F.avg("value").alias("ours"), F.avg("user_id").alias("theirs"))
    return rollups.config_ranking(rows, incumbent=-30.0, threshold=5.0)


# --- ordered operators -------------------------------------------------------------------------------

@query("W1_latest_per_key", "select user_id, event_type, event_id, value from events qualify row_number() over (partition by user_id, event_type order by event_id desc) = 1")
def _(t: Tables):
    return sequences.latest_per_key(t.events.select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], ["event_id"])


def trace_events(t: Tables):
    """Twenty events form a trace; purchase ends it, signup grades it, the rest are tool steps."""
    kind = F.when(F.col("event_type") == "purchase", "trace_end").when(F.col("event_type") == "signup", "grading_result").otherwise("tool_dispatch")
    v = F.col("value")
    return t.events.select(
        F.concat(F.lit("T"), (F.col("event_id") / 20).cast("long").cast("string"), F.lit("_run")).alias("trace_id"), F.col("event_id").alias("line_no"), "ts",
        kind.alias("type"), F.col("event_type").alias("tool_name"), F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("task"), F.col("user_id"))).alias("task_id"),
        F.least(F.lit(1.0), v / 100).alias("task_score"), (v >= 50).alias("passed"), (v / 500).alias("completion"), F.lit(0.5).alias("robustness"),
        F.lit(None).cast("double").alias("communication"), F.lit(None).cast("double").alias("safety"), v.alias("wall_time_s"), F.col("user_id").alias("total_tokens"),
        (F.col("user_id") % 9).alias("total_turns"), F.when(F.col("user_id") % 2 == 0, F.array(F.col("event_type"))).otherwise(F.array().cast("array<string>")).alias("failure_modes"))


@query("W2_last_event_of_type", """
with e as (select 'T' || (event_id // 20) as tr, event_type, event_id, value, user_id from events where event_type in ('purchase', 'signup')),
l as (select *, row_number() over (partition by tr, event_type order by event_id desc) as rn from e),
x as (select * from l where rn = 1 and event_type = 'purchase'), g as (select * from l where rn = 1 and event_type = 'signup')
select x.tr || '_run' as trace_id, case when g.user_id % 3 = 0 then 'task' || g.user_id else x.tr end as task_id, round(least(1, coalesce(g.value, x.value) / 100), 6) as task_score, coalesce(g.value, x.value) >= 50 as passed,
  round(coalesce(g.value, x.value) / 500, 6) as completion, 0.0::double as communication, 1.0::double as safety, g.tr is not null as graded, x.value as duration, x.user_id as tokens,
  case when g.user_id % 2 = 0 then 'signup' when x.user_id % 2 = 0 then 'purchase' else '' end as modes from x left join g on g.tr = x.tr""")
def _(t: Tables):
    out = sequences.last_event_of_type(trace_events(t))
    return rounded(out, "task_score", "completion").select(
        "trace_id", "task_id", "task_score", "passed", "completion", "communication", "safety", "graded", "duration", "tokens", F.array_join("failure_modes", ",").alias("modes"))


@query("W3_step_index", "select user_id as trace_id, event_id, (row_number() over (partition by user_id order by event_id) - 1) as idx from events where event_type in ('click', 'view')")
def _(t: Tables):
    rows = t.events.filter(F.col("event_type").isin("click", "view")).select(F.col("user_id").alias("trace_id"), "event_id", F.lit("tool_dispatch").alias("type"))
    return sequences.step_index(rows, "trace_id", "event_id").select("trace_id", "event_id", F.col("idx").cast("long").alias("idx"))


@query("W4_monotone_prefix", """
with c as (select user_id, event_id, (event_type <> 'error')::int as met from events), m as (select *, min(met) over (partition by user_id order by event_id rows unbounded preceding) as ok from c)
select user_id, sum(ok)::bigint as prefix, count(*) as total, round(sum(ok) / count(*), 6) as score from m group by user_id""")
def _(t: Tables):
    return sequences.monotone_prefix(t.events.select("user_id", "event_id", (F.col("event_type") != "error").alias("met")), "user_id", "event_id")


@query("W5_teacher_topk", """
with p as (select l_orderkey as traj, l_linenumber::bigint as pos, l_partkey as id, -max(l_extendedprice) as lp from lineitem where l_returnflag <> 'N' group by 1, 2, 3),
r as (select *, row_number() over (partition by traj, pos order by lp desc, id) as rn from p)
select traj, pos, string_agg(id, ',' order by rn) || repeat(',-1', (2 - count(*))::int) as ids, round(sum(lp) - 1e4 * (2 - count(*)), 4) as lp_sum from r where rn <= 2 group by 1, 2""")
def _(t: Tables):
    rows = t.lineitem.groupBy(F.col("l_orderkey").alias("traj"), F.col("l_linenumber").cast("long").alias("pos"), F.col("l_partkey").alias("token_id"), (F.col("l_returnflag") != "N").alias("mask")).agg(
        (-F.max("l_extendedprice")).alias("lp"))
    top = sequences.teacher_topk(rows, 2)
    return top.select("traj", "pos", F.array_join(F.transform("topk_ids", lambda x: x.cast("string")), ",").alias("ids"),
                      F.round(F.aggregate("topk_lp", F.lit(0.0), lambda a, x: a + x), 4).alias("lp_sum"))


@query("W8_running_best", """
with l as (select event_type as log, list([event_id::double, value] order by event_id) as xs from events group by 1),
f as (select log, list_reduce(xs, lambda acc, x: case when x[2] > acc[len(acc)] + 20 then list_concat(acc, x) else acc end) as a from l)
select log, a[2 * i - 1]::bigint as event_id, a[2 * i] as value from f, unnest(range(1, len(a) // 2 + 1)) as u(i)""")
def _(t: Tables):
    return sequences.running_best(t.events.select(F.col("event_type").alias("log"), "event_id", "value"), "log", "event_id", "value", 20.0)


@query("W9_exclude_seen", """
with r as (select user_id as session_id, event_id as chunk_id, value as score from events where event_type <> 'view'), s as (select distinct user_id as session_id, event_id as chunk_id from events where event_type in ('click', 'view') and value > 60),
f as (select * from r anti join s using (session_id, chunk_id))
select session_id, chunk_id, score, row_number() over (partition by session_id order by score desc, chunk_id) as rank from f qualify rank <= 3""")
def _(t: Tables):
    e = t.events.select(F.col("user_id").alias("session_id"), F.col("event_id").alias("chunk_id"), F.col("value").alias("score"), "event_type")
    seen = e.filter("event_type in ('click', 'view') and score > 60")
    out = sequences.exclude_seen(e.filter("event_type <> 'view'").drop("event_type"), seen, 3)
    return out.withColumn("rank", F.col("rank").cast("long"))


# --- statistics --------------------------------------------------------------------------------------

@query("X1_run_metrics", """
with p as (select doc_id, lang as arm, source as run, n_chars, text, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') as w from documents),
b as (select *, list_transform(w, lambda x: lower(regexp_replace(x, '^[.,;:!?"'']+|[.,;:!?"'']+$', '', 'g'))) as bw from p),
g as (select doc_id, unnest(list_transform(range(1, len(bw) - 2), lambda i: array_to_string(bw[i:i+3], ' '))) as gram from b),
c as (select doc_id, max(n) as worst from (select doc_id, gram, count(*) as n from g group by 1, 2) group by 1)
select arm, run, count(*) as n, round(avg(p.doc_id % 10), 6) as rubric, round(avg(len(w)), 6) as words, count(*) filter (where worst >= 10) as degen, coalesce(max(coalesce(worst, 0)), 0)::bigint as worst4,
  count(*) filter (where contains(lower(text), 'as an ai ')) as refusals, round(median(n_chars / 7), 6) as slop from p left join c using (doc_id) group by 1, 2""")
def _(t: Tables):
    rows = t.texts.select(F.col("lang").alias("arm"), F.col("source").alias("run"), "text", (F.col("n_chars") / 7).alias("slop"), (F.col("doc_id") % 10).cast("double").alias("rubric"))
    return experiments.run_metrics(rows).withColumn("worst4", F.col("worst4").cast("long"))


def runs(t: Tables):
    """Nine runs per arm: mean value by event type and user group."""
    return t.events.groupBy(F.col("event_type").alias("arm"), (F.col("user_id") % 9).alias("run")).agg(F.avg("value").alias("value"))


SQL_RUNS = "runs as (select event_type as arm, user_id % 9 as run, avg(value) as value from events group by 1, 2)"


@query("X2_permutation_test", f"""with {SQL_RUNS}, pool as (select list_concat(list_sort(list(value) filter (where arm = 'click')), list_sort(list(value) filter (where arm = 'view'))) as v from runs),
o as (select v, abs(list_sum(v[1:9]) / 9 - list_sum(v[10:18]) / 9) as obs from pool),
s as (select i, list_sum(list_transform(range(0, 18), lambda j: case when (i >> j) & 1 = 1 then v[j + 1] else 0 end)) as l, list_sum(v) as total, obs from range(0, 262144) r(i), o where bit_count(i) = 9)
select 'exact' as mode, round(any_value(obs), 6) as observed, count(*) filter (where abs(l / 9 - (total - l) / 9) >= obs - 1e-12) as hits, count(*) as splits, round(count(*) filter (where abs(l / 9 - (total - l) / 9) >= obs - 1e-12) / count(*), 9) as p_value from s""")
def _(t: Tables):
    return experiments.permutation_test(runs(t), "click", "view")


@query("X2_permutation_test_sampled")
def _(t: Tables):
    """Thirty runs per arm: too many splits to list, so seeded random splits."""
    many = t.events.groupBy(F.col("event_type").alias("arm"), (F.col("user_id") % 30).alias("run")).agg(F.avg("value").alias("value"))
    return experiments.permutation_test(many, "click", "view", mode="sampled", iterations=20_000, seed=7)


@query("X3_wilson_interval", """
with c as (select event_type as arm, count(*) filter (where value > 150)::double as k, count(value)::double as n from events group by 1), w as (select *, k / n as p, 1 + 1.96 * 1.96 / n as d from c)
select arm, k::bigint as k, n::bigint as n, round(greatest(0, (p + 1.96 * 1.96 / (2 * n)) / d - 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4 * n * n)) / d), 6) as lo,
  round(least(1, (p + 1.96 * 1.96 / (2 * n)) / d + 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4 * n * n)) / d), 6) as hi from w""")
def _(t: Tables):
    return experiments.wilson_interval(t.events.select(F.col("event_type").alias("arm"), (F.col("value") > 150).alias("hit")), "arm", "hit")


@query("X4_paired_margin_test", f"""with {SQL_GAMES}, s as (select user_id % 3 as variant, count(*) as n, avg(a - b) as m, stddev_samp(a - b) as sd, count(*) filter (where a - b > 0) as wins from games group by 1)
select variant, n, wins, round(m, 6) as mean, round(sd, 6) as sd, round(sd / sqrt(n), 6) as sem, round(abs(m) / (sd / sqrt(n)), 6) as sigma, round(m - 1.96 * sd / sqrt(n), 6) as lo, round(m + 1.96 * sd / sqrt(n), 6) as hi,
  case when m - 1.96 * sd / sqrt(n) > 0 then 'WIN' when m + 1.96 * sd / sqrt(n) < 0 then 'LOSS' else 'unresolved' end as verdict from s""")
def _(t: Tables):
    return experiments.paired_margin_test(games(t).withColumn("variant", F.col("user_id") % 3), ["variant"])


@query("X5_pooled_effect", f"""with {SQL_RUNS}, s as (select avg(value) filter (where arm = 'click') as ma, avg(value) filter (where arm = 'view') as mb, stddev_samp(value) filter (where arm = 'click') as sa, stddev_samp(value) filter (where arm = 'view') as sb,
  min(value) filter (where arm = 'click') as la, max(value) filter (where arm = 'click') as ha, min(value) filter (where arm = 'view') as lb, max(value) filter (where arm = 'view') as hb from runs)
select round(mb - ma, 6) as delta, round((mb - ma) / ma * 100, 6) as percent, round(sqrt((sa * sa + sb * sb) / 2), 6) as pooled_sd, abs(mb - ma) > 2 * sqrt((sa * sa + sb * sb) / 2) as clears_noise,
  case when hb < la or ha < lb then 'disjoint' else 'overlap' end as ranges from s""")
def _(t: Tables):
    return experiments.pooled_effect(runs(t), "click", "view")


@query("X6_percent_delta", f"""with {SQL_RUNS}, m as (select arm, avg(value) as m from runs group by 1), b as (select m as b from m where arm = 'view')
select arm, round(m, 6) as mean, round(m - b, 6) as delta, round((m - b) / b * 100, 6) as percent from m, b""")
def _(t: Tables):
    return experiments.percent_delta(runs(t), "view")


@query("X7_concurrency_crossover", """
with r as (select user_id % 16 + 1 as concurrency, avg(value) filter (where event_type = 'click') as a, avg(value) filter (where event_type = 'view') as b from events group by 1),
s as (select *, sign(a - b) as sg, lag(sign(a - b)) over (order by concurrency) as prev from r)
select concurrency, round(a, 6) as on_value, round(b, 6) as off_value, round((a / b - 1) * 100, 6) as delta_percent, coalesce(prev <> sg, false) as crossover from s""")
def _(t: Tables):
    rows = t.events.select((F.col("user_id") % 16 + 1).alias("concurrency"), F.col("event_type").alias("arm"), "value")
    return experiments.concurrency_crossover(rows, "click", "view")


@query("X8_scaling_curve", """
with a as (select lang as arm, quality_band as size, avg(score) as score from (select d.lang, (d.n_chars // 2000)::bigint as quality_band, l.quality as score from documents d join labels l using (doc_id)) group by 1, 2)
select arm, size, round(score, 6) as score, round(score - lag(score) over (partition by arm order by size), 6) as step, round(score - 0.604::double, 6) as gap from a""")
def _(t: Tables):
    docs = t.documents.select("doc_id", F.col("lang").alias("arm"), (F.col("n_chars") / 2000).cast("long").alias("size"))
    arms = t.labels.join(docs, "doc_id").groupBy("arm", "size").agg(F.avg("quality").alias("score"))
    return experiments.scaling_curve(arms, 0.604)
