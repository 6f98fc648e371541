"""Experiment statistics over arms, runs and pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import words
from .curate import refusal
from .ranking import medians, with_scalars
from .textstats import worst_ngram

DEGENERATE_REPEATS = 10
MODES = ("exact", "sampled")


def run_metrics(pieces: DataFrame, slop: str = "slop", arm: str = "arm", run: str = "run", text: str = "text", rubric: str | None = "rubric") -> DataFrame:
    """Per run: median slop, mean rubric and words, degenerate pieces, worst repeat, refusals."""
    ready = pieces.select(
        arm, run, slop, F.size(words(text)).alias("_w"), worst_ngram(text).alias("_g"), refusal(text).alias("_r"),
        (F.col(rubric) if rubric else F.lit(None).cast("double")).alias("_rubric"))
    complete = F.when(F.count("_rubric") == F.count(F.lit(1)), F.round(F.avg("_rubric"), 6))
    sums = ready.groupBy(arm, run).agg(
        F.count(F.lit(1)).alias("n"), complete.alias("rubric"), F.round(F.avg("_w"), 6).alias("words"),
        F.count_if(F.col("_g") >= DEGENERATE_REPEATS).alias("degen"), F.max("_g").alias("worst4"), F.count_if("_r").alias("refusals"))
    middle = medians(ready, [arm, run], slop, "slop").drop("n")
    return sums.join(middle.withColumn("slop", F.round("slop", 6)), [arm, run])


def _two_arms(runs: DataFrame, a: str, b: str, arm: str, value: str) -> DataFrame:
    side = lambda x: F.array_sort(F.collect_list(F.when(F.col(arm) == x, F.col(value).cast("double"))))
    return runs.filter(F.col(arm).isin(a, b)).agg(side(a).alias("_a"), side(b).alias("_b"))


def permutation_test(
    runs: DataFrame, a: str, b: str, arm: str = "arm", value: str = "value", mode: str = "exact", iterations: int | None = None, seed: int = 0
) -> DataFrame:
    """Two-sided test on run-level means; the result names its ``mode``.

    ``exact`` takes all splits, whatever their number, ``sampled`` takes ``iterations`` seeded random ones. The pool is
    one array of run values, so runs are few by design; the splits are the distributed rows. A split is a number of as
    many bits as there are runs, which ends the exact mode at 62 runs.
    """
    if mode not in MODES or (mode == "sampled") != (iterations is not None):
        raise ValueError("mode is exact, or sampled with a number of iterations")
    spark = runs.sparkSession
    pool = _two_arms(runs, a, b, arm, value)
    sizes = pool.select(F.size("_a").alias("na"), F.size("_b").alias("nb")).first()
    na, n = sizes["na"], sizes["na"] + sizes["nb"]
    mean = lambda x, k: F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v) / F.lit(float(k))
    facts = pool.select(
        F.concat("_a", "_b").alias("_pool"), F.abs(mean("_a", na) - mean("_b", n - na)).alias("observed"))
    if mode == "exact":
        if n > 62:
            raise ValueError(f"{n} runs have 2**{n} splits: choose mode='sampled'")
        splits = spark.range(1 << n).filter(F.bit_count("id") == na)
        left = F.filter("_pool", lambda v, i: F.call_function("getbit", F.col("id"), i) == 1)
        right = F.filter("_pool", lambda v, i: F.call_function("getbit", F.col("id"), i) == 0)
    else:
        splits = spark.range(iterations)
        dealt = F.array_sort(F.transform("_pool", lambda v, i: F.struct(F.xxhash64(F.col("id"), i, F.lit(seed)).alias("h"), i.alias("i"), v.alias("v"))))
        left = F.transform(F.slice(dealt, 1, na), lambda x: x["v"])
        right = F.transform(F.slice(dealt, na + 1, n - na), lambda x: x["v"])
    judged = with_scalars(splits, facts)
    hit = F.abs(mean(left, na) - mean(right, n - na)) >= F.col("observed") - 1e-12
    return judged.agg(
        F.lit(mode).alias("mode"), F.round(F.first("observed"), 6).alias("observed"), F.count_if(hit).alias("hits"), F.count(F.lit(1)).alias("splits"),
        F.round(F.count_if(hit) / F.count(F.lit(1)), 9).alias("p_value"))


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    p = k / n
    d = 1.0 + z * z / n
    center = (p + z * z / (2.0 * n)) / d
    half = z * F.sqrt(p * (1.0 - p) / n + z * z / (4.0 * n * n)) / d
    empty = F.coalesce(n == 0, F.lit(True))
    return (F.when(empty, 0.0).otherwise(F.greatest(F.lit(0.0), center - half)),
            F.when(empty, 0.0).otherwise(F.least(F.lit(1.0), center + half)))


def wilson_interval(rows: DataFrame, by: str, hit: str, z: float = 1.96) -> DataFrame:
    counts = rows.groupBy(by).agg(F.count_if(hit).alias("k"), F.count(hit).alias("n"))
    # NULLIF keeps the division safe; the empty case is (0, 0)
    lo, hi = wilson(F.col("k").cast("double"), F.nullif(F.col("n"), F.lit(0)).cast("double"), z)
    return counts.select(by, "k", "n", F.round(F.coalesce(lo, F.lit(0.0)), 6).alias("lo"), F.round(F.coalesce(hi, F.lit(0.0)), 6).alias("hi"))


def paired_margin_test(pairs: DataFrame, by: list[str] | None = None, a: str = "a_bank", b: str = "b_bank") -> DataFrame:
    """Mean margin, sample deviation, standard error, sigma, 95% interval and verdict."""
    m = F.col(a) - F.col(b)
    s = pairs.filter(m.isNotNull()).groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n"), F.avg(m).alias("mean"), F.stddev_samp(m).alias("sd"), F.count_if(m > 0).alias("wins"))
    sem = F.col("sd") / F.sqrt("n")
    out = s.withColumn("sem", sem).withColumn("sigma", F.when(F.col("sem") > 0, F.abs("mean") / F.col("sem")).otherwise(F.lit(0.0)))
    out = out.withColumn("lo", F.col("mean") - 1.96 * F.col("sem")).withColumn("hi", F.col("mean") + 1.96 * F.col("sem"))
    verdict = F.when(F.col("lo") > 0, "WIN").when(F.col("hi") < 0, "LOSS").otherwise("unresolved")
    return out.withColumn("verdict", verdict).withColumns({c: F.round(c, 6) for c in ("mean", "sd", "sem", "sigma", "lo", "hi")})


def pooled_effect(runs: DataFrame, a: str, b: str, arm: str = "arm", value: str = "value") -> DataFrame:
    """Change from arm a to arm b against the pooled deviation and the overlap of their ranges."""
    v = lambda x: F.when(F.col(arm) == x, F.col(value))
    s = runs.agg(
        F.avg(v(a)).alias("ma"), F.avg(v(b)).alias("mb"), F.stddev_samp(v(a)).alias("sa"), F.stddev_samp(v(b)).alias("sb"),
        F.min(v(a)).alias("la"), F.max(v(a)).alias("ha"), F.min(v(b)).alias("lb"), F.max(v(b)).alias("hb"))
    s = s.withColumn("_d", F.col("mb") - F.col("ma")).withColumn("_sd", F.sqrt((F.col("sa") * F.col("sa") + F.col("sb") * F.col("sb")) / 2))
    disjoint = (F.col("hb") < F.col("la")) | (F.col("ha") < F.col("lb"))
    return s.select(
        F.round("_d", 6).alias("delta"), F.round(F.col("_d") / F.col("ma") * 100, 6).alias("percent"), F.round("_sd", 6).alias("pooled_sd"),
        (F.abs("_d") > 2 * F.col("_sd")).alias("clears_noise"), F.when(disjoint, "disjoint").otherwise("overlap").alias("ranges"))


def percent_delta(arms: DataFrame, baseline: str, arm: str = "arm", value: str = "value") -> DataFrame:
    means = arms.groupBy(arm).agg(F.avg(value).alias("_m"))
    base = means.filter(F.col(arm) == baseline).select(F.col("_m").alias("_b"))
    delta = F.col("_m") - F.col("_b")
    return with_scalars(means, base).select(
        arm, F.round("_m", 6).alias("mean"), F.round(delta, 6).alias("delta"),
        F.round(delta / F.nullif("_b", F.lit(0.0)) * 100, 6).alias("percent"))


def concurrency_crossover(runs: DataFrame, on: str, off: str, level: str = "concurrency", arm: str = "arm", value: str = "value") -> DataFrame:
    """Delta of two arms per concurrency level and whether its sign flips there. Levels are few."""
    wide = runs.groupBy(level).agg(
        F.avg(F.when(F.col(arm) == on, F.col(value))).alias("on_value"), F.avg(F.when(F.col(arm) == off, F.col(value))).alias("off_value"))
    sign = F.signum(F.col("on_value") - F.col("off_value"))
    before = F.lag(sign).over(Window.orderBy(level))
    return wide.select(
        level, F.round("on_value", 6).alias("on_value"), F.round("off_value", 6).alias("off_value"),
        F.round((F.col("on_value") / F.col("off_value") - 1) * 100, 6).alias("delta_percent"), F.coalesce(before != sign, F.lit(False)).alias("crossover"))


def scaling_curve(arms: DataFrame, baseline: float | Column, size: str = "size", score: str = "score", arm: str = "arm") -> DataFrame:
    """Score by data size within an arm: step from the previous size and gap to the baseline."""
    previous = F.lag(score).over(Window.partitionBy(arm).orderBy(size))
    base = baseline if isinstance(baseline, Column) else F.lit(baseline)
    return arms.select(
        arm, size, F.round(score, 6).alias("score"), F.round(F.col(score) - previous, 6).alias("step"), F.round(F.col(score) - base, 6).alias("gap"))
