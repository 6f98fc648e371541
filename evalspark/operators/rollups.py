"""Trial, task, suite and run roll-ups, gates, leaderboards, latency and counter summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import nearest_rank, top_k, values_at_ranks, with_scalars


def rate(hits, total):
    return F.coalesce(hits / F.nullif(total, F.lit(0)), F.lit(0.0))


def exact_mean(c) -> Column:
    """Mean of a double through an exact decimal sum: the same whatever the order of the rows. Ten decimals count."""
    return F.sum(F.col(c).cast("decimal(28,10)")).cast("double") / F.nullif(F.count(c), F.lit(0))


def task_score(grades: DataFrame, tasks: DataFrame | None = None) -> DataFrame:
    """Mean dimension score and all-passed per (task, trial); an attempt without grades is NULL."""
    scored = grades.groupBy("task_id", "trial").agg(exact_mean("score").alias("score"), F.bool_and("passed").alias("passed"))
    return scored if tasks is None else tasks.select("task_id", "trial").join(scored, ["task_id", "trial"], "left")


def task_pass_k(trials: DataFrame, by: Sequence[str] = ("task_id",)) -> DataFrame:
    return trials.groupBy(*by).agg(
        F.count(F.lit(1)).alias("trials"), F.bool_and("passed").alias("all_passed"), exact_mean("score").alias("avg_score"))


def trace_rollup(trials: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts, pass rate and means over trials in one aggregation."""
    n, passed = F.count(F.lit(1)), F.count_if("passed")
    means = [F.avg(F.coalesce(c, F.lit(0.0))).alias(f"avg_{c}") for c in
             ("task_score", "completion", "robustness", "communication", "safety", "tokens", "duration") if c in trials.columns]
    return trials.groupBy(*by).agg(
        F.countDistinct("task_id").alias("tasks"), n.alias("trials"), F.count_if("graded").alias("graded"),
        passed.alias("passed"), rate(passed, n).alias("pass_rate"), *means)


def pass_cubed(trials: DataFrame, by: Sequence[str] = (), k: int = 3) -> DataFrame:
    """Tasks whose first k trials (by trial number) all pass, and tasks with at least k trials."""
    first = top_k(trials, [*by, "task_id"], [F.col("trial")], k, "_r")
    tasks = first.groupBy(*by, "task_id").agg(F.count(F.lit(1)).alias("_n"), F.bool_and("passed").alias("_ok"))
    full = F.col("_n") >= k
    return tasks.groupBy(*by).agg(F.count_if(full & F.col("_ok")).alias("pass3"), F.count_if(full).alias("pass3_eligible"))


def trial_band(trials: DataFrame, by: Sequence[str] = (), trial: str = "trial") -> DataFrame:
    """Run-to-run noise: mean, half range, range and population deviation of per-trial means."""
    per = trials.groupBy(*by, trial).agg(exact_mean("score").alias("_m"))
    return per.groupBy(*by).agg(
        F.count(F.lit(1)).alias("trials"), F.avg("_m").alias("mean"), ((F.max("_m") - F.min("_m")) / 2).alias("half_range"),
        F.min("_m").alias("low"), F.max("_m").alias("high"), F.stddev_pop("_m").alias("std"))


def bucket_stats(tests: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    n, passed = F.count(F.lit(1)), F.count_if("all_passed")
    bucket = F.coalesce(F.nullif("bucket", F.lit("")), F.lit("untagged")).alias("bucket")
    return tests.groupBy(*by, bucket).agg(n.alias("total"), passed.alias("passed"), F.round(rate(passed, n), 3).alias("pass_rate"))


def gate_check(tests: DataFrame, tiers: DataFrame, alias: str = "alias") -> DataFrame:
    """Overall and per-bucket pass rates of every alias against its tier thresholds; absent gates drop out."""
    buckets = bucket_stats(tests, [alias]).filter(F.col("bucket").isin("inprocess", "external"))
    n, passed = F.count(F.lit(1)), F.count_if("all_passed")
    overall = tests.groupBy(alias).agg(rate(passed, n).alias("actual")).withColumn("gate", F.lit("overall"))
    actual = overall.unionByName(buckets.select(alias, F.col("pass_rate").alias("actual"), F.col("bucket").alias("gate")))
    gates = tiers.select(alias, F.expr(
        "stack(3, 'overall', fc_gate, 'inprocess', fc_gate_inprocess, 'external', fc_gate_external) as (gate, threshold)"))
    return actual.join(gates.filter(F.col("threshold").isNotNull()), [alias, "gate"]).withColumn(
        "passed", F.col("actual") >= F.col("threshold"))


def suite_leaderboard(tasks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(per suite: tasks, mean score, all-passed tasks; per suite and dimension: mean score)."""
    suites = tasks.groupBy("suite").agg(
        F.count(F.lit(1)).alias("n_tasks"), F.round(F.avg("avg_score"), 3).alias("avg_score"), F.count_if("all_passed").alias("all_passed"))
    grades = tasks.select("suite", F.explode("trials").alias("t")).select("suite", F.explode("t.grades").alias("g"))
    dims = grades.groupBy("suite", F.coalesce("g.dimension", F.lit("unknown")).alias("dimension")).agg(
        F.round(F.avg("g.score"), 3).alias("avg_score"))
    return suites, dims


def refusal_rates(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Refusal and compliance over harmful prompts, over-refusal over safe prompts."""
    harmful, safe = F.count_if("harmful"), F.count_if(~F.col("harmful"))
    refused = F.count_if(F.col("harmful") & F.col("refused"))
    return rows.groupBy(*by).agg(
        harmful.alias("n_harmful"), F.round(rate(refused, harmful), 6).alias("refusal_rate"),
        F.round(rate(harmful - refused, harmful), 6).alias("compliance_rate"), safe.alias("n_safe"),
        F.round(rate(F.count_if(~F.col("harmful") & F.col("refused")), safe), 6).alias("over_refusal_rate"))


def model_status(models: DataFrame, a: DataFrame, b: DataFrame, key: str = "model") -> DataFrame:
    """complete / partial / no data by presence in two result sets; one shuffle over flags."""
    flags = [df.select(key, F.lit(bit).alias("_f")) for df, bit in ((models, 0), (a, 1), (b, 2))]
    seen = flags[0].unionByName(flags[1]).unionByName(flags[2]).groupBy(key).agg(F.bit_or("_f").alias("_f"))
    status = F.when(F.col("_f") == 3, "complete").when(F.col("_f") == 0, "no data").otherwise("partial")
    return seen.select(key, status.alias("status"))


def run_row(tasks: DataFrame, run: Sequence[str], suites: Sequence[str]) -> DataFrame:
    """One flat row per run with a pass-rate column per named suite."""
    cells = tasks.groupBy(*run).pivot("suite", list(suites)).agg(F.round(F.avg(F.col("all_passed").cast("double")), 3))
    return cells.withColumnsRenamed({s: f"score_{s.replace('/', '_')}" for s in suites})


def model_matrix(cells: DataFrame, row: str, models: Sequence[str], value, missing: str = "-") -> DataFrame:
    """row x model table of text cells; a dash where a model has no value."""
    wide = cells.groupBy(row).pivot("model", list(models)).agg(value)
    return wide.select(row, *[F.coalesce(F.col(f"`{m}`").cast("string"), F.lit(missing)).alias(m) for m in models])


def metric_matrix(summary: DataFrame, metrics: Sequence[str], models: Sequence[str]) -> DataFrame:
    """metric x model from one summary row per model."""
    long = summary.select("model", F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("string").alias("v")) for m in metrics])).alias("p")).select("model", "p.*")
    return model_matrix(long, "metric", models, F.first("v"))


def arm_summary(rows: DataFrame, baseline: str, arm: str = "arm") -> DataFrame:
    sums = rows.groupBy(arm).agg(
        F.count(F.lit(1)).alias("trials"), F.round(F.avg("task_score"), 3).alias("mean_task_score"),
        F.round(F.avg(F.coalesce("completion", F.lit(0.0))), 3).alias("mean_completion"),
        F.round(F.avg(F.col("passed").cast("double")), 3).alias("pass_rate"))
    base = sums.filter(F.col(arm) == baseline).select(F.col("mean_task_score").alias("_b"))
    return with_scalars(sums, base).withColumn("delta", F.round(F.col("mean_task_score") - F.col("_b"), 3)).drop("_b")


def corpus_stats(docs: DataFrame, by: str, chars: str) -> DataFrame:
    """Documents, characters and floored mean length per source, most documents first."""
    return docs.groupBy(by).agg(
        F.count(F.lit(1)).alias("docs"), F.sum(chars).alias("chars"), F.floor(F.sum(chars) / F.count(F.lit(1))).alias("avg_chars")
    ).orderBy(F.col("docs").desc(), by)


def score_distribution(rows: DataFrame, official: str = "official", dense: str = "dense") -> DataFrame:
    """Dense scores of failed attempts by bucket, with recovered, dead and invariant-breach counts."""
    d = F.col(dense)
    bucket = (
        F.when(F.col(official) >= 1.0, "passed").when(d <= 0, "0").when(d <= 0.25, "(0,.25]").when(d <= 0.5, "(.25,.5]")
        .when(d <= 0.75, "(.5,.75]").otherwise("(.75,1)"))
    failed = F.col(official) < 1.0
    return rows.filter(d.isNotNull()).groupBy(bucket.alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(failed & (d > 1e-9)).alias("recovered"), F.count_if(failed & (d <= 1e-9)).alias("dead"),
        F.count_if((F.col(official) >= 1.0) & (F.abs(d - 1.0) > 1e-9)).alias("breaches"))


def latency_summary(reqs: DataFrame, by: str) -> DataFrame:
    """ok/failed, nearest-rank p50/p99 of TTFT and TPOT, means, output tokens per second of wall time."""
    sums = reqs.groupBy(by).agg(
        F.count_if("ok").alias("n_ok"), F.count_if(~F.col("ok")).alias("n_failed"),
        F.round(F.avg(F.when(F.col("ok"), F.col("ttft_ms"))), 6).alias("mean_ttft_ms"),
        F.round(F.avg(F.when(F.col("ok"), F.col("tpot_ms"))), 6).alias("mean_tpot_ms"),
        F.sum(F.when(F.col("ok"), F.col("out_tokens"))).alias("_tok"), (F.max("end_s") - F.min("start_s")).alias("_wall"))
    out = sums.withColumn("tokens_per_s", F.round(F.col("_tok") / F.col("_wall"), 6)).drop("_tok", "_wall")
    # both times as rows of one table, so that all ranks come from one selection
    names = ["ttft", "tpot"]
    times = F.explode(F.array(*[F.struct(F.lit(name).alias("time"), F.col(f"{name}_ms").cast("double").alias("ms")) for name in names])).alias("_t")
    each = reqs.filter("ok").select(by, times).select(by, "_t.time", "_t.ms")
    ranks = nearest_rank(each, [by, "time"], "ms", {"p50": 50, "p99": 99})
    wide = ranks.groupBy(by).agg(*[F.max(F.when(F.col("time") == name, F.col(p))).alias(f"{name}_{p}_ms") for name in names for p in ("p50", "p99")])
    return out.join(wide, by, "left")


def counter_delta(samples: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """last minus first value of every cumulative counter; samples: ts, name, value."""
    return samples.groupBy(*by, "name").agg((F.max_by("value", "ts") - F.min_by("value", "ts")).alias("delta"))


def speed_from_counters(deltas: DataFrame, by: Sequence[str], wall: float, names: dict[str, str]) -> DataFrame:
    """Zero-safe rates from counter deltas. names: ttft_sum, ttft_count, tpot_sum, tpot_count, generated,
    drafts, accepted, drafted -> counter name."""
    got = {k: F.coalesce(F.sum(F.when(F.col("name") == v, F.col("delta"))), F.lit(0.0)) for k, v in names.items()}

    def ratio(a, b, scale=1.0):
        return F.round(F.when(got[b] > 0, got[a] / got[b] * scale).otherwise(F.lit(0.0)), 6)

    return deltas.groupBy(*by).agg(
        ratio("ttft_sum", "ttft_count", 1000.0).alias("avg_ttft_ms"), ratio("tpot_sum", "tpot_count", 1000.0).alias("avg_tpot_ms"),
        F.round(got["generated"] / wall, 6).alias("tokens_per_s"), ratio("accepted", "drafts").alias("accept_length"),
        ratio("accepted", "drafted", 100.0).alias("accept_rate"))


def embedding_discrimination(pairs: DataFrame, cosine: str, similar: str) -> DataFrame:
    a, b = F.avg(F.when(F.col(similar), F.col(cosine))), F.avg(F.when(~F.col(similar), F.col(cosine)))
    return pairs.agg(F.round(a, 4).alias("avg_similar"), F.round(b, 4).alias("avg_dissimilar"), F.round(a - b, 4).alias("discrimination"))


def token_saving(pairs: DataFrame) -> DataFrame:
    """Mean relative saving over pairs valid on both sides; pairs: base, other."""
    return pairs.agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("base") - F.col("other")) / F.col("base")), 6).alias("saving"),
        F.round(F.avg("base"), 6).alias("base_mean"), F.round(F.avg("other"), 6).alias("other_mean"))


def fidelity_summary(steps: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    flag = lambda c: F.round(F.avg(F.col(c).cast("double")), 6).alias(c)
    return steps.groupBy(*by).agg(F.count(F.lit(1)).alias("steps"), *[flag(c) for c in ("parsed_ok", "exit_match", "exact_stdout", "stdout_seq", "stdout_lines")])


def reward_batch(rows: DataFrame, by: Sequence[str] = (), policy: str = "penalize", penalty: float = -1.0) -> tuple[DataFrame, DataFrame]:
    """(rows with their training reward, gaming and solve rates). mask keeps the true reward."""
    if policy not in ("penalize", "mask"):
        raise ValueError(f"unknown policy {policy!r}")
    shaped = F.col("reward")
    if policy == "penalize":
        shaped = F.when(F.col("excluded"), F.lit(penalty)).otherwise(shaped)
    rates = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("gamed").cast("double")), 6).alias("gaming_rate"),
        F.round(F.avg((F.col("reward") >= 1.0).cast("double")), 6).alias("solve_rate"))
    return rows.withColumn("train_reward", shaped), rates


def margin_summary(games: DataFrame) -> DataFrame:
    """W/T/L, win percent, errors, and mean, min, upper median, max of both sides, as one row."""
    a, b = F.col("a_bank"), F.col("b_bank")
    n = F.count(F.lit(1))
    sums = games.agg(
        n.alias("games"), F.count_if(a > b).alias("wins"), F.count_if(a == b).alias("ties"), F.count_if(a < b).alias("losses"),
        F.count_if((F.col("a_status") != "DONE") | (F.col("b_status") != "DONE")).alias("errors"),
        F.round(100.0 * F.count_if(a > b) / n, 6).alias("win_percent"),
        *[f(F.col(f"{s}_bank")).alias(f"{s}_{k}") for s in "ab" for k, f in
          (("mean", lambda c: F.round(F.avg(c), 6)), ("min", F.min), ("max", F.max))])
    for side in "ab":
        median = values_at_ranks(games, [], f"{side}_bank", {f"{side}_median": (0.5, F.floor(F.col("n") / 2))}).drop("n")
        sums = with_scalars(sums, median)
    return sums


def config_ranking(games: DataFrame, incumbent: float | None = None, threshold: float = 400.0) -> DataFrame:
    """Mean margin, own, other, wins per config over the seeds all configs played; best first."""
    configs = games.agg(F.countDistinct("config").alias("_configs"))
    seeds = with_scalars(games.groupBy("seed").agg(F.countDistinct("config").alias("_c")), configs).filter("_c = _configs").select("seed")
    sums = games.join(seeds, "seed").groupBy("config").agg(
        F.round(F.avg(F.col("ours") - F.col("theirs")), 6).alias("margin"), F.round(F.avg("ours"), 6).alias("ours"),
        F.round(F.avg("theirs"), 6).alias("theirs"), F.count_if(F.col("ours") > F.col("theirs")).alias("wins"), F.count(F.lit(1)).alias("n"))
    if incumbent is not None:
        sums = sums.withColumn("accept", F.col("margin") > incumbent + threshold)
    return sums.orderBy(F.col("margin").desc(), "config")


def sweep_table(results: DataFrame, path_col: str = "path") -> DataFrame:
    """One row per benchmark file: regime and concurrency from its name, p50 with median fallback."""
    name = F.regexp_extract(path_col, r"([^/]+)\.json$", 1)

    def first(*names):
        return F.coalesce(*[F.col(c).cast("double") for c in names if c in results.columns], F.lit(0.0))

    return results.select(
        F.regexp_extract(name, r"^(.*)-c\d+$", 1).alias("regime"), F.regexp_extract(name, r"-c(\d+)$", 1).try_cast("long").alias("concurrency"),
        first("p50_ttft_ms", "median_ttft_ms").alias("ttft_p50"), first("p99_ttft_ms").alias("ttft_p99"),
        first("p50_tpot_ms", "median_tpot_ms").alias("tpot_p50"), first("p99_tpot_ms").alias("tpot_p99"),
        first("output_throughput").alias("throughput"), first("request_goodput").alias("goodput"),
        first("completed").cast("long").alias("completed"),
    ).orderBy("regime", "concurrency")
