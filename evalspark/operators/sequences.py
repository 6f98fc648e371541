"""Ordered operators: latest rows, step numbers, prefixes, packing, search logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable
from .ranking import first_per_key, numbered, running_max


def latest_per_key(df: DataFrame, keys: Sequence[str], newest: Sequence[str]) -> DataFrame:
    return first_per_key(df, keys, [F.col(c).desc() for c in newest])


def last_event_of_type(events: DataFrame, trace: str = "trace_id", order: str = "line_no") -> DataFrame:
    """One row per trace that ended: scores of the last grading_result, else of the last trace_end;
    time and tokens always from trace_end. Aggregated map-side, no trace is gathered."""
    kept = events.filter(F.col("type").isin("trace_end", "grading_result"))
    payload = F.struct("task_id", "task_score", "passed", "completion", "robustness", "communication", "safety", "wall_time_s",
                       "total_tokens", "total_turns", "failure_modes")

    def last(kind):
        at = F.when(F.col("type") == kind, F.col(order))
        return F.max_by(F.when(F.col("type") == kind, payload), at)

    both = kept.groupBy(trace).agg(last("trace_end").alias("_e"), last("grading_result").alias("_g")).filter(F.col("_e").isNotNull())
    graded = F.col("_g").isNotNull()
    source = F.when(graded, F.col("_g")).otherwise(F.col("_e"))

    def score(name, default):
        return F.coalesce(source[name], F.lit(default)).alias(name)

    modes = F.when(F.coalesce(F.array_size("_g.failure_modes"), F.lit(0)) > 0, F.col("_g.failure_modes")).otherwise(F.col("_e.failure_modes"))
    return both.select(
        trace, F.coalesce(F.nullif(F.col("_g.task_id"), F.lit("")), F.regexp_replace(F.col(trace).cast("string"), r"_[^_]*$", "")).alias("task_id"),
        score("task_score", 0.0), score("passed", False), score("completion", 0.0), score("robustness", 0.0),
        score("communication", 0.0), score("safety", 1.0), graded.alias("graded"),
        F.coalesce("_e.wall_time_s", F.lit(0.0)).alias("duration"), F.coalesce("_e.total_tokens", F.lit(0)).alias("tokens"),
        F.coalesce("_e.total_turns", F.lit(0)).alias("turns"), modes.alias("failure_modes"))


def step_index(events: DataFrame, trace: str, order: str, kind: str = "tool_dispatch", tool: str | None = None) -> DataFrame:
    """idx from 0 for the tool steps of a trace; a trace may hold any share of the table."""
    steps = events.filter(F.col("type") == kind)
    if tool is not None:
        steps = steps.filter(F.col("tool_name") == tool)
    return numbered(steps, [trace], [order], "_n").withColumn("idx", F.col("_n") - 1).drop("_n")


def monotone_prefix(checks: DataFrame, key: str, order: str, met: str = "met") -> DataFrame:
    """Longest satisfied prefix / all checks. Two aggregations; no key is sorted or gathered."""
    ok = F.coalesce(F.col(met).cast("double") >= 1.0, F.lit(False))
    first = checks.groupBy(key).agg(F.min(F.when(~ok, F.col(order))).alias("_fail"))
    before = F.count_if(F.col("_fail").isNull() | (F.col(order) < F.col("_fail")))
    return checks.join(first, key).groupBy(key).agg(
        before.alias("prefix"), F.count(F.lit(1)).alias("total"), F.round(before / F.count(F.lit(1)), 6).alias("score"))


def prefix_share(flags) -> Column:
    """The same share inside an array<boolean>; an empty array is 0."""
    a = F.col(flags) if isinstance(flags, str) else flags
    first = F.array_position(F.transform(a, lambda x: F.coalesce(x, F.lit(False))), False)
    run = F.when(first == 0, F.size(a)).otherwise(first - 1)
    return F.when(F.size(a) == 0, F.lit(0.0)).otherwise(run / F.size(a))


def teacher_topk(logprobs: DataFrame, k: int, keys: Sequence[str] = ("traj", "pos")) -> DataFrame:
    """The k best (id, logprob) per masked position, padded with (-1, -1e4). logprobs: mask, token_id, lp."""
    from .ranking import top_k

    best = top_k(logprobs.filter("mask"), keys, [F.col("lp").desc(), F.col("token_id")], k, "_r")
    rows = best.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_r", "token_id", "lp"))).alias("_t"))
    missing = F.lit(k) - F.size("_t")
    return rows.select(
        *keys,
        F.concat(F.transform("_t", lambda x: x["token_id"]), F.array_repeat(F.lit(-1).cast("long"), missing)).alias("topk_ids"),
        F.concat(F.transform("_t", lambda x: x["lp"]), F.array_repeat(F.lit(-1e4), missing)).alias("topk_lp"))


def reorder_lost_in_middle(ranked: DataFrame, query: str = "query_id", rank: str = "rank") -> DataFrame:
    """position 1..n: odd ranks ascending, then even ranks descending; lists of two stay. A ranked list is a top-k."""
    counts = ranked.groupBy(query).agg(F.max(rank).alias("_n"))
    r, n = F.col(rank), F.col("_n")
    moved = F.when(r % 2 == 1, (r + 1) / 2).otherwise(n - r / 2 + 1)
    return ranked.join(counts, query).withColumn("position", F.when(n <= 2, r).otherwise(moved).cast("long")).drop("_n")


def pack_context(ranked: DataFrame, text: str, budget: int, soft: float = 0.75, hard: float = 0.90,
                 query: str = "query_id", rank: str = "rank") -> DataFrame:
    """Token estimate (4 characters each), running use in rank order, and the limits it passes."""
    w = Window.partitionBy(query).orderBy(rank)
    used = F.sum("tokens").over(w)
    return (
        ranked.withColumn("tokens", F.floor(F.length(text) / 4)).withColumn("used", used)
        .withColumn("fits", F.col("used") <= budget).withColumn("over_soft", F.col("used") >= soft * budget)
        .withColumn("over_hard", F.col("used") >= hard * budget))


def running_best(log: DataFrame, key: str, order: str, value: str, threshold: float) -> DataFrame:
    """Rows accepted by a search: the first, then every row above the last accepted value + threshold.

    An accepted row always beats every earlier value, so only records (strict running maxima) can be accepted. Each record
    points to the first one that passes it by the threshold, the record with the least value above. Accepted are those on
    the path of pointers from the first record, which doubles in each round: pointers are joined with themselves, so a
    path of n rows takes log2(n) rounds, and no log is ever held in one row or task. Rows without a value are left out.
    """
    if threshold < 0:
        raise ValueError("a threshold below 0 would accept rows that are no records")
    found = log.select(F.col(key).alias("_key"), F.col(order).alias("_o"), F.col(value).alias("_v")).filter("_v is not null")
    tops = running_max(found, ["_key"], ["_o"], "_v", "_top")
    records = durable(tops.filter(F.col("_top").isNull() | (F.col("_v") > F.col("_top"))).select("_key", "_o", "_v"))
    # walk down the values: the record met last before value + threshold is the next one to be accepted
    met = records.select("_key", (-F.col("_v")).alias("_down"), F.lit(1).alias("_kind"), F.col("_v").alias("_from"), (-F.col("_v")).alias("_seen"))
    asked = records.select("_key", (-(F.col("_v") + threshold)).alias("_down"), F.lit(0).alias("_kind"), F.col("_v").alias("_from"), F.lit(None).cast(met.schema["_seen"].dataType).alias("_seen"))
    pointers = running_max(met.unionByName(asked), ["_key"], ["_down", "_kind"], "_seen", "_next").filter("_kind = 0 and _next is not null")
    jump = durable(pointers.select("_key", F.col("_from").alias("_a"), (-F.col("_next")).alias("_b")))
    path = durable(records.groupBy("_key").agg(F.min("_v").alias("_v")))

    def follow(left: DataFrame, at: str, onto: str) -> DataFrame:
        steps = jump.select(F.col("_key").alias("_k"), F.col("_a").alias("_from"), F.col("_b").alias("_to"))
        return left.join(steps, F.col("_key").eqNullSafe(F.col("_k")) & (F.col(at) == F.col("_from"))).select("_key", *([onto] if onto else []), "_to")

    while not (further := durable(follow(path, "_v", "").withColumnRenamed("_to", "_v"))).isEmpty():
        path = durable(path.unionByName(further))
        jump = durable(follow(jump, "_b", "_a").withColumnRenamed("_to", "_b"))
    chosen = path.select(F.col("_key").alias("_k"), F.col("_v").alias("_best"))
    kept = records.join(chosen, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_v") == F.col("_best")))
    return kept.select(F.col("_key").alias(key), F.col("_o").alias(order), F.col("_v").alias(value))


def exclude_seen(results: DataFrame, seen: DataFrame, k: int, keys: Sequence[str] = ("session_id",), item: str = "chunk_id",
                 score: str = "score") -> DataFrame:
    """Top k per key without the items shown in earlier turns."""
    from .ranking import top_k

    fresh = results.join(seen.select(*keys, item).distinct(), [*keys, item], "left_anti")
    return top_k(fresh, keys, [F.col(score).desc(), F.col(item)], k)
