"""Expressions over chat records: array<struct<role, content, tool_calls, tool_call_id>>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, short_hash, squeeze, words  # noqa: F401

CALLS_TYPE = "array<struct<id:string,name:string,arguments:string>>"
MESSAGES_TYPE = f"array<struct<role:string,content:string,tool_calls:{CALLS_TYPE},tool_call_id:string>>"

# Source role label -> canonical role.
ROLE_MAP = {
    "human": "user",
    "gpt": "assistant",
    "system": "system",
    "tool": "tool",
    "function": "tool",
    "observation": "tool",
    "user": "user",
    "assistant": "assistant",
}
CANONICAL = ("system", "user", "assistant", "tool")


def lookup(mapping: dict[str, str], key: Column) -> Column:
    literal = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.try_element_at(literal, key)


def canonical_role(role) -> Column:
    return F.coalesce(lookup(ROLE_MAP, col(role)), F.lit("user"))


def message(role, content, tool_calls=None, tool_call_id=None) -> Column:
    return F.struct(
        role.alias("role"),
        content.alias("content"),
        (F.lit(None) if tool_calls is None else tool_calls).cast(CALLS_TYPE).alias("tool_calls"),
        (F.lit(None) if tool_call_id is None else tool_call_id).cast("string").alias("tool_call_id"),
    )


def trim_to_last_assistant(messages) -> Column:
    m = col(messages)
    from_end = F.array_position(F.transform(F.reverse(m), lambda x: x["role"]), "assistant")
    kept = F.when(from_end > 0, F.size(m) - from_end + 1).otherwise(F.lit(0))
    return F.slice(m, F.lit(1), kept.cast("int"))


def transcript(messages) -> Column:
    """``role:content`` lines, the text the content hash is taken over."""
    return F.array_join(
        F.transform(col(messages), lambda m: F.concat(m["role"], F.lit(":"), F.coalesce(m["content"], F.lit("")))), "\n"
    )


def content_hash(messages) -> Column:
    return short_hash(transcript(messages))


def first_user_text(messages) -> Column:
    users = F.filter(col(messages), lambda m: m["role"] == "user")
    return F.coalesce(F.try_element_at(users, F.lit(1))["content"], F.lit(""))


def prompt_hash(messages) -> Column:
    return short_hash(first_user_text(messages))


def assistant_turns(messages) -> Column:
    return F.size(F.filter(col(messages), lambda m: m["role"] == "assistant"))


def tool_call_count(messages) -> Column:
    sizes = F.transform(col(messages), lambda m: F.coalesce(F.array_size(m["tool_calls"]), F.lit(0)))
    return F.aggregate(sizes, F.lit(0), lambda acc, n: acc + n)


def templated(messages) -> Column:
    """Chat text with one marked block per turn."""
    return F.array_join(
        F.transform(
            col(messages),
            lambda m: F.concat(F.lit("<start_of_turn>"), m["role"], F.lit("\n"), m["content"], F.lit("<end_of_turn>")),
        ),
        "\n",
    )
