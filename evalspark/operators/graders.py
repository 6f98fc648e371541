"""Deterministic graders over a table of outputs. A grader adds dimension, score and passed."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col, let, rstrip, strip
from . import textstats
from .documents import pick_json
from .ranking import top_k
from .sequences import prefix_share

GRADE_PASS = 0.75
MATCH_PASS = 0.999
Grader = Callable[[DataFrame], DataFrame]


def graded(df: DataFrame, dimension: str, score: Column, threshold: float = GRADE_PASS) -> DataFrame:
    return df.withColumn("dimension", F.lit(dimension)).withColumn("score", score.cast("double")).withColumn(
        "passed", F.col("score") >= threshold)


def run_graders(df: DataFrame, graders: Mapping[str, tuple[Column, float]], key: Sequence[str]) -> DataFrame:
    """Long table (key..., dimension, score, passed) of several graders (score, threshold) in one scan of the outputs."""
    grades = [
        F.struct(F.lit(name).alias("dimension"), score.cast("double").alias("score"), (score.cast("double") >= least).alias("passed"))
        for name, (score, least) in graders.items()]
    return df.select(*key, F.explode(F.array(*grades)).alias("_g")).select(*key, "_g.*")


def _fold(c: Column, case_sensitive: bool) -> Column:
    c = strip(F.coalesce(c, F.lit("")))
    return c if case_sensitive else F.lower(c)


def grade_exact(output, expected, case_sensitive: bool = True) -> Column:
    return (_fold(col(output), case_sensitive) == _fold(col(expected), case_sensitive)).cast("double")


def grade_contains(output, expected, case_sensitive: bool = True) -> Column:
    return F.contains(_fold(col(output), case_sensitive), _fold(col(expected), case_sensitive)).cast("double")


def grade_regex(output, pattern, case_sensitive: bool = True) -> Column:
    p = col(pattern) if case_sensitive else F.concat(F.lit("(?i)"), col(pattern))
    return F.regexp_like(F.coalesce(col(output), F.lit("")), p).cast("double")


def last_number(output) -> Column:
    found = F.regexp_extract_all(F.coalesce(col(output), F.lit("")), F.lit(r"-?\d[\d,]*\.?\d*"), 0)
    return F.replace(F.try_element_at(found, F.lit(-1)), F.lit(","), F.lit("")).try_cast("double")


def grade_number(output, target, tolerance=0.0) -> Column:
    limit = tolerance if isinstance(tolerance, Column) else F.lit(float(tolerance))
    return F.coalesce((F.abs(last_number(output) - col(target).cast("double")) <= limit).cast("double"), F.lit(0.0))


def _fragments(output, items, case_sensitive) -> Column:
    return let(_fold(col(output), case_sensitive), lambda text: F.filter(items, lambda x: F.contains(text, _fold(x, case_sensitive))))


def grade_all_of(output, items, case_sensitive: bool = True) -> Column:
    hits = F.size(_fragments(output, items, case_sensitive))
    return F.coalesce(hits / F.nullif(F.size(items), F.lit(0)), F.lit(0.0))


def grade_none_of(output, items, case_sensitive: bool = True) -> Column:
    return F.when(F.size(_fragments(output, items, case_sensitive)) > 0, 0.0).otherwise(1.0)


def grade_outcome(output: str, expected: str, tools: str, assertions: str) -> Column:
    """Fraction of assertions that hold.

    output and expected are map<string,string>, tools array<string>, assertions
    array<struct<type, key, value>> with type contains, regex, equals, json_valid or tool_called.
    """
    def held(a: Column) -> Column:
        got = F.coalesce(F.try_element_at(F.col(output), a["key"]), F.lit(""))
        return (
            F.when(a["type"] == "contains", F.contains(F.lower(got), F.lower(a["value"])))
            .when(a["type"] == "regex", F.regexp_like(got, a["value"]))
            .when(a["type"] == "equals", F.col(expected).isNotNull()
                  & F.try_element_at(F.col(output), a["key"]).eqNullSafe(F.try_element_at(F.col(expected), a["key"])))
            .when(a["type"] == "json_valid", F.try_parse_json(got).isNotNull())
            .when(a["type"] == "tool_called", F.array_contains(F.coalesce(tools, F.array().cast("array<string>")), a["value"]))
        )

    hits = F.size(F.filter(assertions, lambda a: F.coalesce(held(a), F.lit(False))))
    return F.coalesce(hits / F.nullif(F.size(assertions), F.lit(0)), F.lit(0.0))


# --- function calls ----------------------------------------------------------------------------------

def args_match(actual: Column, expected: Column) -> Column:
    """Two JSON values (VARIANT): equal, equal text ignoring case and ends, or numbers within 0.01."""
    is_text = lambda v: F.schema_of_variant(v) == "STRING"
    text = lambda v: strip(F.coalesce(F.try_variant_get(v, "$", "string"), F.to_json(v)))
    number = lambda v: F.try_variant_get(v, "$", "double")
    same_text = text(actual) == text(expected)
    loose = F.coalesce(F.abs(number(actual) - number(expected)) < 0.01, F.lit(False)) | same_text
    both = is_text(actual) & is_text(expected)
    return F.coalesce(F.when(both, F.lower(text(actual)) == F.lower(text(expected))).otherwise(loose), F.lit(False))


def arg_share(actual_args: Column, expected_args: Column) -> Column:
    """Share of expected argument keys whose value matches; 1 when none are expected. Both JSON text."""
    keys = F.coalesce(F.json_object_keys(expected_args), F.array().cast("array<string>"))
    at = lambda v, k: F.try_variant_get(v, F.concat(F.lit("$['"), F.replace(k, F.lit("'"), F.lit("\\'")), F.lit("']")), "variant")

    def share(both: Column) -> Column:
        same = F.filter(both["k"], lambda k: let(F.struct(at(both["a"], k).alias("a"), at(both["e"], k).alias("e")), lambda v: args_match(v["a"], v["e"])))
        return F.when(F.size(both["k"]) == 0, F.lit(1.0)).otherwise(F.size(same) / F.size(both["k"]))

    return let(F.struct(keys.alias("k"), F.try_parse_json(actual_args).alias("a"), F.try_parse_json(expected_args).alias("e")), share)


def grade_function_calls(expected: str, actual: str, allowed: str) -> Column:
    """expected/actual: array<struct<name, arguments>>, allowed: array<string>.

    Each expected call takes its best actual call of the same name (half name, half arguments);
    calls that are neither expected nor allowed cost 0.05 each, 0.2 at most.
    """
    exp, act = F.col(expected), F.coalesce(F.col(actual), F.expr(f"slice({expected}, 1, 0)"))

    def best(e: Column) -> Column:
        same = F.filter(act, lambda a: a["name"] == e["name"])
        return F.coalesce(F.array_max(F.transform(same, lambda a: 0.5 + 0.5 * arg_share(a["arguments"], e["arguments"]))), F.lit(0.0))

    total = F.aggregate(F.transform(exp, best), F.lit(0.0), lambda acc, x: acc + x)
    fine = F.array_union(F.coalesce(F.col(allowed), F.array().cast("array<string>")), F.transform(exp, lambda e: e["name"]))
    extra = F.size(F.filter(act, lambda a: ~F.array_contains(fine, F.coalesce(a["name"], F.lit("")))))
    none_expected = F.coalesce(F.array_size(exp), F.lit(0)) == 0
    return F.when(none_expected, F.when(F.size(act) == 0, 1.0).otherwise(0.0)).otherwise(
        F.greatest(F.lit(0.0), total / F.size(exp) - F.least(F.lit(0.2), extra * 0.05)))


def best_match_calls(expected: DataFrame, actual: DataFrame, case: str = "case_id") -> DataFrame:
    """Best score per expected call over exploded call tables; misses stay at 0.

    Equal calls are merged before the join, so repeated calls cost nothing.
    """
    wanted = expected.select(case, "name", "arguments").groupBy(case, "name", "arguments").agg(F.count(F.lit(1)).alias("n_expected"))
    made = actual.select(case, "name", F.col("arguments").alias("_got")).distinct()
    joined = wanted.join(made, [case, "name"], "left")
    score = F.when(F.col("_got").isNull(), 0.0).otherwise(0.5 + 0.5 * arg_share(F.col("_got"), F.col("arguments")))
    return joined.groupBy(case, "name", "arguments", "n_expected").agg(F.max(score).alias("best_score"))


def grade_tool_channel(df: DataFrame) -> Column:
    """Columns: called array<string>, details array<struct<name, arguments>>, leaked, required array<string>,
    no_tool, forbidden array<string>, arg_specs array<struct<tool, key, needles array<string>>>."""
    none = F.array().cast("array<string>")
    called, required = F.coalesce("called", none), F.coalesce("required", none)
    leaked = F.coalesce("leaked", F.lit(False))
    n_called = F.size(called)
    share = F.when(F.size(required) > 0, F.size(F.filter(required, lambda r: F.array_contains(called, r))) / F.size(required)).otherwise(
        F.when(n_called > 0, 1.0).otherwise(0.0))

    def args_of(tool: Column) -> Column:
        return F.try_element_at(F.filter("details", lambda d: d["name"] == tool), F.lit(1))["arguments"]

    def spec_ok(s: Column) -> Column:
        got = F.call_function("get_json_object", args_of(s["tool"]), F.concat(F.lit("$."), s["key"]))
        text = F.lower(F.coalesce(got, F.lit("")))
        return args_of(s["tool"]).isNotNull() & F.forall(s["needles"], lambda n: F.contains(text, F.lower(n)))

    tools = F.array_distinct(F.transform("arg_specs", lambda s: s["tool"]))
    good = F.filter(tools, lambda x: F.forall("arg_specs", lambda s: (s["tool"] != x) | spec_ok(s)))
    has_specs = F.coalesce(F.array_size("arg_specs"), F.lit(0)) > 0
    score = F.round(F.when(has_specs, 0.5 * share + 0.5 * F.size(good) / F.size(tools)).otherwise(share), 3)
    return (
        F.when(F.coalesce("no_tool", F.lit(False)), F.when((n_called == 0) & ~leaked, 1.0).otherwise(0.5))
        .when(F.size(F.array_intersect(called, F.coalesce("forbidden", none))) > 0, 0.0)
        .when((score == 0.0) & leaked, 0.5)
        .otherwise(score)
    )


def grade_json(df: DataFrame, text: str, assertions: Sequence[str], dimension: str = "structure") -> DataFrame:
    """Fraction of SQL boolean expressions over ``data`` (the picked JSON as VARIANT) that hold."""
    ready = df.withColumn("data", F.try_parse_json(pick_json(F.col(text))["json"]))
    hits = F.lit(0)
    for a in assertions:
        hits = hits + F.coalesce(F.expr(a).cast("boolean"), F.lit(False)).cast("int")
    share = hits / F.lit(len(assertions)) if assertions else F.lit(0.0)
    return graded(ready, dimension, F.when(F.col("data").isNull(), 0.0).otherwise(share), MATCH_PASS).drop("data")


# Weight of an action check by the kind of its tool.
TOOL_WEIGHTS = {"write": 1.0, "read": 0.3, "think": 0.5, "generic": 0.5}


def reward_dense(mode: str = "fraction", basis_weights: Mapping[str, float] | None = None, exclude_judged: bool = False) -> Column:
    """Dense reward from reward_basis, db_check, env_assertions, action_checks, communicate_checks.

    A named basis without checks scores 0; the judged basis scores 0 unless excluded; no basis is NULL.
    """
    def met(checks: str, field: str) -> Column:
        return F.transform(checks, lambda c: F.coalesce(c[field], F.lit(False)))

    def fraction(flags: Column) -> Column:
        return F.size(F.filter(flags, lambda f: f)) / F.nullif(F.size(flags), F.lit(0))

    weights = F.transform("action_checks", lambda c: F.coalesce(
        F.coalesce(*[F.when(F.lower(F.coalesce(c["tool_type"], F.lit("generic"))) == k, F.lit(v)) for k, v in TOOL_WEIGHTS.items()]), F.lit(0.5)))
    pairs = F.zip_with(met("action_checks", "action_match"), weights, lambda f, w: F.struct(F.when(f, w).otherwise(F.lit(0.0)).alias("got"), w.alias("w")))
    add = lambda field: F.aggregate(pairs, F.lit(0.0), lambda acc, p: acc + p[field])
    prefix = mode == "monotone_prefix"
    part = lambda flags: prefix_share(flags) if prefix else fraction(flags)
    component = {
        "DB": F.col("db_check.db_reward").cast("double"),
        "ENV_ASSERTION": part(met("env_assertions", "met")),
        "ACTION": prefix_share(met("action_checks", "action_match")) if prefix else add("got") / F.nullif(add("w"), F.lit(0.0)),
        "COMMUNICATE": fraction(met("communicate_checks", "met")),
    }
    given = F.col("reward_basis")
    if exclude_judged:
        given = F.filter(given, lambda b: b != "NL_ASSERTION")

    def scored(b: Column) -> Column:
        value = F.coalesce(*[F.when(b == k, v) for k, v in component.items()], F.lit(0.0))
        weight = F.coalesce(*[F.when(b == k, F.lit(float(w))) for k, w in (basis_weights or {}).items()], F.lit(1.0))
        return F.struct((value * weight).alias("s"), weight.alias("w"))

    rows = F.transform(given, scored)
    total = lambda field: F.aggregate(rows, F.lit(0.0), lambda acc, r: acc + r[field])
    return F.when(F.array_size(given) > 0, total("s") / F.nullif(total("w"), F.lit(0.0)))


def sparse_binary(results: DataFrame, case: str = "case_id") -> DataFrame:
    return results.groupBy(case).agg(
        F.count_if("passed").alias("passed"), F.count(F.lit(1)).alias("total"), F.bool_and("passed").cast("double").alias("reward"))


def partial_credit(results: DataFrame, case: str = "case_id", test: str = "test") -> DataFrame:
    """passed/total and the first three failing tests."""
    sums = results.groupBy(case).agg(F.count_if("passed").alias("passed"), F.count(F.lit(1)).alias("total"))
    failing = top_k(results.filter(~F.col("passed")).select(case, test), [case], [F.col(test)], 3, "_r")
    first = failing.groupBy(case).agg(F.array_sort(F.collect_list(test)).alias("first_failures"))
    return sums.join(first, case, "left").withColumn("score", F.col("passed") / F.col("total")).withColumn(
        "first_failures", F.coalesce("first_failures", F.array().cast("array<string>")))


def normalized_stdout(text) -> Column:
    lines = F.regexp_replace(F.replace(F.coalesce(col(text), F.lit("")), F.lit("\r\n"), F.lit("\n")), r"(?U)[^\S\n]+(?=\n|\z)", "")
    return F.regexp_replace(lines, r"\n+\z", "")


def compare_stdout(actual, expected) -> Column:
    return normalized_stdout(actual) == normalized_stdout(expected)


def claw_score(completion, robustness, safety) -> Column:
    return (0.8 * col(completion) + 0.2 * col(robustness)) * col(safety)


def judge_score(text) -> Column:
    """Score in stored judge text: after thinking, inside a fence, first to last brace. Failure is NULL."""
    c = F.element_at(F.split(F.coalesce(col(text), F.lit("")), "</think>"), -1)
    fenced = F.try_element_at(F.split(c, "```"), F.lit(2))
    inner = F.regexp_replace(F.coalesce(fenced, c), r"^json", "")
    value = F.try_parse_json(F.regexp_extract(inner, r"(?s)\{.*\}", 0))
    return F.coalesce(F.try_variant_get(value, "$.score", "double"), F.try_variant_get(value, "$.score", "string").try_cast("double"))


def pairwise_outcome(verdict, swapped) -> Column:
    """A, B or tie in the caller's order."""
    v = F.upper(col(verdict))
    return F.when(v.isin("A", "B"), F.when(col(swapped), F.when(v == "A", "B").otherwise("A")).otherwise(v)).otherwise("tie")


def pairwise_winrate(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Win rate of side A, its double, ties, mean clamped confidence and how often the first slot won."""
    ready = rows.withColumn("_w", pairwise_outcome("verdict", "swapped")).withColumn(
        "_c", F.greatest(F.lit(0.5), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(0.5)))))
    n, win = F.count(F.lit(1)), F.avg((F.col("_w") == "A").cast("double"))
    return ready.groupBy(*by).agg(
        n.alias("n"), F.round(win, 6).alias("winrate"), F.round(2 * win, 6).alias("double_winrate"), F.count_if(F.col("_w") == "tie").alias("ties"),
        F.round(F.avg("_c"), 6).alias("confidence"), F.round(F.avg((F.upper("verdict") == "A").cast("double")), 6).alias("first_slot_rate"))


def score_fidelity(real: DataFrame, sim: DataFrame, key: Sequence[str]) -> DataFrame:
    """Per step: parsed, exit match, exact output, sequence and line similarity; unparsed steps score 0.

    real: stdout, exit_code; sim: sim_stdout, sim_exit (NULL row or stdout = unparsed).
    """
    both = real.join(sim, list(key), "left")
    ok = F.col("sim_stdout").isNotNull()
    same = rstrip("stdout") == rstrip("sim_stdout")
    return both.select(
        *key, ok.alias("parsed_ok"), (ok & F.col("sim_exit").eqNullSafe(F.col("exit_code"))).alias("exit_match"), F.coalesce(same, F.lit(False)).alias("exact_stdout"),
        F.when(ok, F.round(textstats.rstripped_ratio("stdout", "sim_stdout"), 3)).otherwise(0.0).alias("stdout_seq"),
        F.when(ok, F.round(textstats.line_jaccard("stdout", "sim_stdout"), 3)).otherwise(0.0).alias("stdout_lines"))
