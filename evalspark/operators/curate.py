"""Hashing, dedup, decontamination, mixing, sampling, splits and flags."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import chat, lists
from ..functions.text import col, contains_folded, ngram_hashes, tokens, word_count
from .ranking import first_rows, first_per_key, lowest_per_key, top_k, with_scalars


def with_hashes(df: DataFrame) -> DataFrame:
    return df.withColumn("prompt_hash", chat.prompt_hash("messages")).withColumn(
        "content_hash", chat.content_hash("messages")
    )


def dedup_content(df: DataFrame, hash_col: str = "content_hash", priority: Sequence[str] = ("source_rank", "id")) -> DataFrame:
    """First row per hash in registry order. Each map task keeps one row per hash before the shuffle,
    so a text copied a billion times costs one row per task."""
    return first_per_key(df, [hash_col], [F.col(c) for c in priority])


def decontaminate(train: DataFrame, heldout: DataFrame, hash_col: str = "prompt_hash") -> DataFrame:
    return train.join(heldout.select(hash_col).distinct(), hash_col, "left_anti")


def holds_passage(df: DataFrame, heldout: DataFrame, id_col: str, text: str, held_text: str, n: int = 13) -> DataFrame:
    """Distinct ids whose text shares a run of ``n`` words (lower-case letters, digits, apostrophes) with a held-out text.

    Runs are compared by 64-bit hashes. Those of the held-out side are distinct and usually few; Spark broadcasts them where
    their measured size allows, so that no run of the corpus is shuffled.
    """
    runs = lambda c: F.explode(ngram_hashes(tokens(c), n)).alias("_run")
    held = heldout.select(runs(held_text)).distinct()
    return df.select(id_col, runs(text)).join(held, "_run", "left_semi").select(id_col).distinct()


def decontaminate_passages(df: DataFrame, heldout: DataFrame, id_col: str, text: str, held_text: str, n: int = 13) -> DataFrame:
    """Rows that hold no passage of a held-out text."""
    return df.join(holds_passage(df, heldout, id_col, text, held_text, n), id_col, "left_anti")


def build_corpus(parts: Mapping[str, DataFrame], registry: DataFrame, banned: DataFrame, cap: int | None = None) -> DataFrame:
    """(id, source, messages, content_hash) of a mixed corpus.

    parts: per source format (a key of ``FORMATS``), raw records with id and source; each goes through the format's adapter. Records are then
    capped per source, checked, freed of banned prompt hashes and deduplicated by content. What is compared and shuffled
    are hashes and ids; conversations move once, to the join with the ids that stay.
    """
    from functools import reduce

    from .normalize import FORMATS, validate_trajectories

    raw = {kind: cap_per_source(part, cap, "id") if cap else part for kind, part in parts.items()}
    adapted = reduce(DataFrame.unionByName, [FORMATS[kind](part).select("id", "source", "messages") for kind, part in raw.items()])
    valid, _ = validate_trajectories(adapted.join(registry.filter("enabled").select("source", "source_rank"), "source"))
    hashed = with_hashes(valid)
    clean = decontaminate(hashed.select("id", "source_rank", "prompt_hash", "content_hash"), banned)
    kept = dedup_content(clean).select("id")
    return hashed.join(kept, "id", "left_semi").select("id", "source", "messages", "content_hash")


def select_mix(df: DataFrame, registry: DataFrame, mix: str = "blend", only: Sequence[str] | None = None,
               own_teacher: str = "local") -> DataFrame:
    """Rows of the sources a mix admits; an allow-list replaces the enabled flag."""
    admitted = registry.filter(F.col("source").isin(*only)) if only else registry.filter("enabled")
    if mix == "own":
        admitted = admitted.filter(F.col("teacher") == own_teacher)
    elif mix == "public":
        admitted = admitted.filter(F.col("teacher") != own_teacher)
    elif mix != "blend":
        raise ValueError(f"unknown mix {mix!r}")
    return df.join(admitted.select("source", "source_rank", "weight"), "source")


def cap_per_source(df: DataFrame, n: int, order: str, source: str = "source", tie: str = "id") -> DataFrame:
    """First n rows per source by ``order``, NULLs last, equal values by ``tie``."""
    return top_k(df, [source], [F.col(order).asc_nulls_last(), F.col(tie)], n, "_cap").drop("_cap")


def sample_key(id_col, seed: int) -> Column:
    """Repeatable 48-bit number from an id, independent of partitioning and engine."""
    digest = F.sha2(F.concat_ws("|", col(id_col).cast("string"), F.lit(str(seed))), 256)
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long")


def weighted_sample(df: DataFrame, weights: DataFrame, total: int, id_col: str = "id", seed: int = 0) -> DataFrame:
    """About ``total`` rows shared out by relative weight; per source the lowest sample keys win."""
    whole = weights.agg(F.sum("weight").alias("_w"))
    quota = with_scalars(weights, whole).select(
        "source", F.floor(F.lit(total) * F.col("weight") / F.col("_w")).alias("quota")
    )
    keyed = df.withColumn("_key", sample_key(id_col, seed))
    return lowest_per_key(keyed, ["source"], "_key", quota).drop("_key")


def verified_only(df: DataFrame, reward: str = "reward") -> DataFrame:
    return df.filter(F.coalesce(F.col(reward), F.lit(0.0)) >= 1.0)


def verified_yield(df: DataFrame, by: str, reward: str = "reward") -> DataFrame:
    kept = F.count_if(F.coalesce(F.col(reward), F.lit(0.0)) >= 1.0)
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("seen"), kept.alias("kept"))


def partition_by_skill(df: DataFrame, skills: Mapping[str, str], actions: str = "actions") -> DataFrame:
    """Skill of the first named action; records without a known skill are dropped."""
    named = F.filter(actions, lambda a: F.coalesce(a["name"], F.lit("")) != "")
    return df.withColumn(
        "skill", chat.lookup(dict(skills), F.try_element_at(named, F.lit(1))["name"])
    ).filter(F.col("skill").isNotNull())


def length_band_sample(df: DataFrame, text: str, lo: int, hi: int, n: int, id_col: str, seed: int) -> DataFrame:
    banded = df.filter(word_count(text).between(lo, hi))
    return first_rows(banded.withColumn("_key", sample_key(id_col, seed)), ["_key", id_col], n).drop("_key")


def quality_gate(df: DataFrame, bands: Mapping[str, tuple[float | None, float | None]]) -> tuple[DataFrame, DataFrame]:
    """(rows inside every band, rejects). A missing metric is a reject."""
    ok = F.lit(True)
    for name, (lo, hi) in bands.items():
        if lo is not None:
            ok = ok & (F.col(name) >= lo)
        if hi is not None:
            ok = ok & (F.col(name) <= hi)
    passed = F.coalesce(ok, F.lit(False))
    return df.filter(passed), df.filter(~passed)


def holdout_last_k_groups(df: DataFrame, key: str, k: int = 4) -> tuple[DataFrame, DataFrame]:
    """(rest, rows of the last k ids in sorted order); the held-out id list has at most k rows."""
    held = df.select(key).distinct().orderBy(F.col(key).desc()).limit(k)
    return df.join(F.broadcast(held), key, "left_anti"), df.join(F.broadcast(held), key, "left_semi")


def split_by_column(df: DataFrame, column: str = "split", test: str = "test") -> tuple[DataFrame, DataFrame]:
    is_test = F.coalesce(F.col(column) == test, F.lit(False))
    return df.filter(~is_test), df.filter(is_test)


def train_eval_split(df: DataFrame, id_col: str, percent: int = 5, seed: int = 42, cap: int | None = None) -> DataFrame:
    """split column by hash; with a cap the lowest sample keys are kept. Stable under repartition."""
    keyed = df.withColumn("_key", sample_key(id_col, seed))
    if cap is not None:
        keyed = first_rows(keyed, ["_key", id_col], cap)
    return keyed.withColumn("split", F.when(F.col("_key") % 100 < percent, "eval").otherwise("train")).drop("_key")


def select_problems(df: DataFrame, date: str, id_col: str, difficulty: str, since: str, levels: Sequence[str],
                    limit: int, widen: Sequence[str] = (), least: int = 20) -> DataFrame:
    """Problems since a date with a difficulty, first by (date, id); widened when too few are left."""

    def pick(wanted):
        kept = df.filter((F.col(date) >= F.lit(since).cast("date")) & F.col(difficulty).isin(*wanted))
        return first_rows(kept, [date, id_col], limit)

    chosen = pick(levels)
    if widen and chosen.limit(least).count() < least:
        chosen = pick([*levels, *widen])
    return chosen


def dedup_tasks(df: DataFrame, id_col: str = "id", order: Sequence[str] = ("path", "pos")) -> DataFrame:
    return first_per_key(df, [id_col], [F.col(c) for c in order])


def gaming_reasons(text) -> Column:
    code = col(text)
    return F.array_compact(F.array(*[F.when(code.rlike(p), F.lit(why)) for p, why in lists.GAMING_PATTERNS]))


def flag_gaming(df: DataFrame, text: str) -> DataFrame:
    reasons = df.withColumn("reasons", gaming_reasons(text))
    return reasons.withColumn("excluded", F.size("reasons") > 0)


def tool_leak(text) -> Column:
    return F.coalesce(col(text), F.lit("")).rlike("(?i)" + "|".join(lists.TOOL_LEAK_PATTERNS))


def refusal(text) -> Column:
    return F.coalesce(col(text), F.lit("")).rlike("(?i)" + lists.REFUSAL_PATTERN)


def template_leak(text) -> Column:
    return F.coalesce(col(text), F.lit("")).rlike(lists.TEMPLATE_LEAK_PATTERN)


def leak_variants(secret) -> Column:
    """The secret, the secret without a known prefix when enough is left, and its base64 form."""
    s = col(secret)
    bare = F.coalesce(*[
        F.when(F.startswith(s, F.lit(p)) & (F.length(s) > len(p) + 8), F.substr(s, F.lit(len(p) + 1)))
        for p in lists.SECRET_PREFIXES
    ])
    return F.array_compact(F.array(s, bare, F.base64(s.cast("binary"))))


def detect_secret_leaks(outputs: DataFrame, secrets: DataFrame, case: str = "case_id") -> DataFrame:
    """Any variant of the planted secret in the reply counts as a leak, ignoring case."""
    variants = secrets.select(case, leak_variants("secret").alias("_variants"))
    hit = F.filter("_variants", lambda v: contains_folded("reply", F.lower(v)))
    return (
        outputs.join(variants, case, "left")
        .withColumn("n_leaked", F.coalesce(F.array_size(hit), F.lit(0)))
        .withColumn("leaked", F.col("n_leaked") > 0)
        .drop("_variants")
    )


def arm_completeness(df: DataFrame, arm: str = "arm", run: str = "run") -> DataFrame:
    """One row: are all arms comparable? Same pieces per run within an arm, same run count per arm."""
    runs = df.groupBy(arm, run).agg(F.count(F.lit(1)).alias("_pieces"))
    arms = runs.groupBy(arm).agg(
        F.count(F.lit(1)).alias("_runs"), F.min("_pieces").alias("_least"), F.max("_pieces").alias("_most")
    )
    return arms.agg(
        F.count(F.lit(1)).alias("arms"),
        F.bool_and(F.col("_least") == F.col("_most")).alias("equal_pieces"),
        (F.min("_runs") == F.max("_runs")).alias("equal_runs"),
    ).withColumn("complete", F.col("equal_pieces") & F.col("equal_runs"))


def complete_arms_only(df: DataFrame, arms: Sequence[str], arm: str = "arm", run: str = "run") -> DataFrame:
    """The rows unchanged when the arms are comparable, otherwise an error (one summary row is read)."""
    summary = arm_completeness(df.filter(F.col(arm).isin(*arms)), arm, run).first()
    if summary["arms"] != len(set(arms)):
        raise ValueError(f"{summary['arms']} of {len(set(arms))} arms present")
    if not summary["complete"]:
        raise ValueError("arms are not comparable: unequal runs or pieces per run")
    return df.filter(F.col(arm).isin(*arms))
