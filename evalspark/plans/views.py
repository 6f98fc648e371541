"""Views derived from the given tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.chat import message
from .registry import Tables

# Source registry of the mixed corpus: source, teacher, weight, enabled, rank.
REGISTRY = [
    ("src0", "local", 1.0, True, 0),
    ("src1", "public-a", 0.5, True, 1),
    ("src2", "public-b", 1.0, True, 2),
    ("src3", "local", 2.0, True, 3),
    ("src4", "public-c", 0.75, False, 4),
]

SQL_REGISTRY = """registry(source, teacher, weight, enabled, source_rank) as (values
  ('src0','local',1.0,true,0), ('src1','public-a',0.5,true,1), ('src2','public-b',1.0,true,2),
  ('src3','local',2.0,true,3), ('src4','public-c',0.75,false,4))"""


def registry(t: Tables) -> DataFrame:
    return t.spark.createDataFrame(REGISTRY, "source string, teacher string, weight double, enabled boolean, source_rank int")


def source_of(conv_id) -> F.Column:
    return F.concat(F.lit("src"), (conv_id % 5).cast("string"))


def chats(t: Tables) -> DataFrame:
    """One record per conversation with its turns in order (a chat record is one row by nature)."""
    turns = t.conversations.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns")
    )
    return turns.select(
        "conv_id",
        source_of(F.col("conv_id")).alias("source"),
        (F.col("conv_id") % 3).alias("teacher"),
        F.transform("turns", lambda x: message(x["role"], x["text"])).alias("messages"),
    )


def trajectories(t: Tables) -> DataFrame:
    """Valid chat records: cut after the last assistant turn, at least two turns."""
    from ..operators.normalize import trim_to_last_assistant

    return trim_to_last_assistant(chats(t)).join(F.broadcast(registry(t).select("source", "source_rank")), "source")


# turns up to the last assistant turn, conversations with at least two of them
SQL_TRIMMED = """kept0 as (
  select c.*, 'src' || cast(c.conv_id % 5 as varchar) as source, max(case when role = 'assistant' then turn end) over (partition by conv_id) as last_a
  from conversations c),
trimmed as (select * from kept0 where turn <= last_a qualify count(*) over (partition by conv_id) >= 2)"""

SQL_HASHED = SQL_TRIMMED + """,
hashed as (
  select conv_id, any_value(source) as source, count(*) as n,
    substr(sha256(trim(regexp_replace(lower(string_agg(role || ':' || text, chr(10) order by turn)), '\\s+', ' ', 'g'))), 1, 16) as content_hash,
    substr(sha256(trim(regexp_replace(lower(coalesce(min_by(text, turn) filter (where role = 'user'), '')), '\\s+', ' ', 'g'))), 1, 16) as prompt_hash
  from trimmed group by conv_id)"""


def trials(t: Tables) -> DataFrame:
    """Graded attempts: event type as model, 40 tasks, event id as ordered trial number."""
    return t.events.select(
        F.col("event_type").alias("model"),
        (F.col("user_id") % 40).alias("task_id"),
        F.col("event_id").alias("trial"),
        F.least(F.lit(1.0), F.col("value") / 100.0).alias("score"),
        (F.col("value") >= 40.0).alias("passed"),
        F.col("value").alias("wall"),
    )


SQL_TRIALS = """trials as (
  select event_type as model, user_id % 40 as task_id, event_id as trial, least(1.0, value / 100.0) as score,
    value >= 40.0 as passed, value as wall from events)"""


def predictions(t: Tables) -> DataFrame:
    """Quality labels against a length rule, and toxicity against language."""
    docs = t.documents.select("doc_id", "lang", "n_chars")
    return t.labels.join(docs, "doc_id").select(
        "doc_id", "lang",
        F.col("quality").alias("truth"),
        F.when(F.col("n_chars") >= 400, 1).otherwise(0).alias("pred"),
        F.col("n_chars"),
    )


SQL_PREDICTIONS = """pred as (
  select l.doc_id, d.lang, l.quality as truth, case when d.n_chars >= 400 then 1 else 0 end as pred, d.n_chars
  from labels l join documents d on l.doc_id = d.doc_id)"""
