"""Cumulative-snapshot collapse: of logged conversations that are prefixes of longer ones, only the longest stay.

Chat logs often hold a snapshot after every turn. Each conversation gets a rolling hash per turn prefix; one whose full
hash is a proper prefix of another is dropped by an anti-join, equal ones keep their smallest id, and what remains is
rendered with a chat template. DataFrame functions only.

Texts are shuffled once, for the conversations that stay: turns are hashed in the scan. Prefix hashes are deduplicated in the map tasks, so a first turn that a third of all conversations share is one
row a task, and the anti-join has one row per hash on either side.

Edge cases. Turns are ordered by turn number, then role and text; a null turn number comes first, null texts are empty
and a null role is ``unknown``. A repeated row (same turn, role and text) counts once. Rows without a conv_id belong to
no conversation and are left out. Roles are compared in lower case, texts as they are. Other columns are ignored. An
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _clean(turns: DataFrame) -> DataFrame:
    return turns.where("conv_id is not null").select(
        "conv_id", "turn", F.lower(F.coalesce("role", F.lit("unknown"))).alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def _turn_hash(role: Column, text: Column) -> Column:
    """Role and text with the role's length in front, so that no two turns read alike."""
    return F.substring(F.sha2(F.concat_ws(":", F.length(role).cast("string"), role, text), 256), 1, 32)


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, k, h1, h2: one row per distinct turn with the rolling hash of the first k turns.

    The hash is a running sum of two 64-bit hashes of each turn and its place, so prefixes are rows of a window and
    no conversation is gathered, however long it is. All windows share one shuffle and one sort.
    """
    hashed = _clean(turns).select("conv_id", "turn", "role", F.sha2("text", 256).alias("by"), _turn_hash(F.col("role"), F.col("text")).alias("h"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "by")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    here = F.struct("turn", "role", "by")
    new = hashed.withColumn("new", F.when(F.lag(here).over(order).eqNullSafe(here), 0).otherwise(1))
    placed = new.withColumn("k", F.sum("new").over(so_far)).where("new = 1")
    wide = lambda c: c.cast("decimal(20,0)")  # noqa: E731  sums of 64-bit numbers must not overflow
    summed = placed.select(
        "conv_id", "k", F.sum(wide(F.xxhash64("h", "k"))).over(so_far).alias("h1"), F.sum(wide(F.xxhash64("k", "h", F.lit("second")))).over(so_far).alias("h2"))
    return summed.withColumn("n_turns", F.max("k").over(Window.partitionBy("conv_id")))


def maximal(hashes: DataFrame) -> DataFrame:
    """conv_id, n_turns and copies of the conversations that are no proper prefix of another, equal ones once."""
    key = ["k", "h1", "h2"]
    whole = hashes.where("k = n_turns").groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("copies"))
    prefixes = hashes.where("k < n_turns").select(*key).distinct()
    return whole.join(prefixes, key, "left_anti").select("conv_id", F.col("k").alias("n_turns"), "copies")


def render(turns: DataFrame, open_mark: str = OPEN, close_mark: str = CLOSE) -> DataFrame:
    """conv_id and text: the turns in order, each between marks. Marks inside a text lose their bars and cannot end a turn."""
    def safe(c: Column) -> Column:
        for mark in (open_mark, close_mark):
            c = F.replace(c, F.lit(mark), F.lit(mark.replace("|", "")))
        return c

    clean = _clean(turns).select("conv_id", "turn", safe(F.col("role")).alias("role"), F.col("text").alias("raw"), F.sha2("text", 256).alias("by"))
    one = F.array_sort(F.collect_set(F.struct("turn", "role", "by", "raw")))
    lines = F.transform(one, lambda t: F.concat(F.lit(open_mark), t["role"], F.lit("\n"), safe(t["raw"]), F.lit(close_mark + "\n")))
    return clean.groupBy("conv_id").agg(F.array_join(lines, "").alias("text"))


def collapse(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, copies and the rendered text of every maximal conversation.

    The kept ids are stored, so the join that filters the turns is planned by their measured size; it shares its
    partitioning with the grouping after it.
    """
    kept = stored(maximal(stored(prefix_hashes(turns), "prefixes")), "maximal")
    texts = render(turns.join(kept, "conv_id", "left_semi"))
    return kept.join(texts, "conv_id").select("conv_id", "n_turns", "copies", "text")
