"""Chat records: adapters, hashing, dedup, mixing, splits, exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import chat
from ..functions.chat import content_hash, message
from ..operators import curate, normalize
from ..session import work_dir
from ..sources import writers
from .registry import Tables, query
from .views import SQL_HASHED, SQL_REGISTRY, SQL_TRIMMED, chats, registry, source_of, trajectories

def raw_role():
    return F.when(F.col("turn") % 7 == 6, "moderator").when(F.col("role") == "user", "human").when(
        F.col("role") == "assistant", "gpt").otherwise(F.col("role"))


@query("N1_normalize_roles", """
select conv_id, turn, case when turn % 7 = 6 then 'user' else role end as role, text as content from conversations
""")
def _(t: Tables):
    raw = t.conversations.select("conv_id", "turn", F.array(message(raw_role(), F.col("text"))).alias("messages"))
    one = raw.select("conv_id", "turn", F.explode(normalize.normalize_roles("messages")).alias("m"))
    return one.select("conv_id", "turn", "m.role", "m.content")


def sharegpt_rows(t: Tables):
    return chats(t).select(
        "conv_id",
        F.try_element_at(F.filter("messages", lambda m: m["role"] == "system"), F.lit(1))["content"].alias("system"),
        F.transform(
            F.filter("messages", lambda m: m["role"] != "system"),
            lambda m: F.struct(
                F.when(m["role"] == "user", "human").otherwise("gpt").alias("from"), m["content"].alias("value")
            ),
        ).alias("conversations"),
    )


def summary(df, key: str = "conv_id"):
    return df.select(
        key, F.size("messages").cast("long").alias("n"), F.array_join(F.transform("messages", lambda m: m["role"]), ",").alias("roles"),
        content_hash("messages").alias("content_hash"),
    )


SQL_SUMMARY = """select conv_id, count(*) as n, string_agg(role, ',' order by turn) as roles,
  substr(sha256(trim(regexp_replace(lower(string_agg(role || ':' || text, chr(10) order by turn)), '\\s+', ' ', 'g'))), 1, 16) as content_hash
from {0} group by conv_id"""


@query("N2_from_sharegpt", f"with {SQL_TRIMMED} {SQL_SUMMARY.format('trimmed')}")
def _(t: Tables):
    return summary(normalize.from_sharegpt(sharegpt_rows(t)))


@query("N3_from_when2call", """
with r as (select doc_id, text, lang, source, n_chars,
  ['tool_call','direct','cannot_answer','clarify'][(doc_id % 4 + 1)::int] as ca,
  case when doc_id % 8 = 0 then '' else source end as a_tool, lang as a_direct,
  case when doc_id % 3 = 0 then cast(n_chars as varchar) end as a_cannot, case when doc_id % 5 = 0 then 'which ' || lang end as a_clarify
  from documents),
g as (select *, case when ca = 'tool_call' then nullif(a_tool, '') when ca = 'direct' then nullif(a_direct, '')
  else coalesce(nullif(a_cannot, ''), nullif(a_clarify, ''), nullif(a_direct, '')) end as gold from r)
select doc_id, ca as decision, gold, 2::bigint as n, text as question from g where gold is not null and text <> ''
""")
def _(t: Tables):
    d = F.col("doc_id")
    rows = t.documents.select(
        "doc_id", F.col("text").alias("question"),
        F.element_at(F.array(*[F.lit(x) for x in ("tool_call", "direct", "cannot_answer", "clarify")]),
                     (d % 4 + 1).cast("int")).alias("correct_answer"),
        F.struct(
            F.when(d % 8 == 0, "").otherwise(F.col("source")).alias("tool_call"), F.col("lang").alias("direct"),
            F.when(d % 3 == 0, F.col("n_chars").cast("string")).alias("cannot_answer"),
            F.when(d % 5 == 0, F.concat(F.lit("which "), "lang")).alias("clarify"),
        ).alias("answers"),
    )
    m = F.col("messages")
    return normalize.from_when2call(rows).select(
        "doc_id", F.col("meta")["decision"].alias("decision"), m[1]["content"].alias("gold"),
        F.size(m).cast("long").alias("n"), m[0]["content"].alias("question"),
    )


SQL_FILTERED = """raw as (select conv_id, turn, case when turn % 7 = 6 then 'critic' else role end as role,
  case when turn % 5 = 4 then '  ' else text end as text from conversations),
filled as (select *, max(case when role = 'assistant' then turn end) over (partition by conv_id) as last_a from raw
  where role in ('system','user','assistant','tool') and trim(text) <> ''),
kept as (select * from filled where turn <= last_a qualify count(*) over (partition by conv_id) >= 2)"""


def noisy_chats(t: Tables):
    """Chat records with an unknown role at turn 6 and a blank text at turn 4."""
    return chats(t).withColumn(
        "messages",
        F.transform(
            "messages",
            lambda m, i: message(
                F.when(i % 7 == 6, "critic").otherwise(m["role"]), F.when(i % 5 == 4, "  ").otherwise(m["content"])
            ),
        ),
    )


@query("N4_from_openai_messages", f"with {SQL_FILTERED} {SQL_SUMMARY.format('kept')}")
def _(t: Tables):
    return summary(normalize.from_openai_messages(noisy_chats(t)))


@query("N5_from_json_string_messages", f"with {SQL_FILTERED}, ok as (select * from kept where conv_id % 6 <> 0) {SQL_SUMMARY.format('ok')}")
def _(t: Tables):
    text = F.to_json("messages")
    broken = F.when(F.col("conv_id") % 6 == 0, F.substring(text, 1, 40)).otherwise(text)
    return summary(normalize.from_json_string_messages(noisy_chats(t).withColumn("messages", broken)))


@query("N6_from_gui_traces", f"""
with raw as (select conv_id, turn, role, case when turn % 3 = 1 then '' else trim(text) end as text from conversations
    where role <> 'system'),
filled as (select *, max(case when role = 'assistant' then turn end) over (partition by conv_id) as last_a from raw
  where text <> '' or role = 'assistant'),
kept as (select * from filled where turn <= last_a qualify count(*) over (partition by conv_id) >= 2)
{SQL_SUMMARY.format('kept')}""")
def _(t: Tables):
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    rows = t.conversations.filter("role <> 'system'").groupBy("conv_id").agg(turns.alias("turns")).select(
        "conv_id",
        F.transform("turns", lambda x: F.struct(
            F.when(x["role"] == "user", "human").otherwise("gpt").alias("from"),
            F.when(x["turn"] % 3 == 1, "<image>").otherwise(F.concat(F.lit("<image>\n"), x["text"])).alias("value"),
        )).alias("conversations"),
    )
    return summary(normalize.from_gui_traces(rows))


@query("N7_from_fleet", """
select event_id, event_type as name, case when event_id % 5 = 0 then '{"k": ' else replace(props, ' ', '') end as arguments
from events""")
def _(t: Tables):
    args = F.when(F.col("event_id") % 5 == 0, F.lit('{"k": ')).otherwise(F.col("props"))
    call = F.array(F.struct(F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("name"), args.alias("arguments")))
    rows = t.events.select("event_id", F.array(message(F.lit("assistant"), F.lit("go"), call)).alias("messages"))
    c = F.col("messages")[0]["tool_calls"][0]
    return normalize.from_fleet(rows).select("event_id", c["name"].alias("name"), c["arguments"].alias("arguments"))


# ten consecutive events make one simulated episode; a case is bounded because event ids are unique
def step():
    return F.struct("event_id", "event_type", "props", "value")


SQL_STEP_ROLE = """case event_type when 'click' then 'user' when 'view' then 'assistant' when 'purchase' then 'assistant'
  when 'signup' then 'tool' else 'critic' end"""


def step_role(e):
    return (
        F.when(e["event_type"] == "click", "user").when(e["event_type"].isin("view", "purchase"), "assistant")
        .when(e["event_type"] == "signup", "tool").otherwise("critic")
    )


def episodes(t: Tables, nested: bool):
    def call(e):
        ident = e["event_id"].cast("string").alias("id")
        if nested:
            inner = F.struct(e["event_type"].alias("name"), e["props"].alias("arguments"))
            return F.struct(ident, inner.alias("function"))
        return F.struct(ident, e["event_type"].alias("name"), e["props"].alias("arguments"))

    steps = t.events.groupBy((F.col("event_id") / 10).cast("long").alias("task_id")).agg(
        F.array_sort(F.collect_list(step())).alias("steps"), F.max("value").alias("top")
    )
    traj = F.transform("steps", lambda e: F.struct(
        step_role(e).alias("role"), e["props"].alias("content"),
        F.when(e["event_type"] == "purchase", F.array(call(e))).alias("tool_calls"),
        F.lit(None).cast("string").alias("tool_call_id"),
    ))
    return steps.select(
        "task_id", (F.col("task_id") % 3).alias("trial"), traj.alias("traj" if nested else "messages"),
        F.when(F.col("top") >= 100, 1.0).otherwise(0.0).alias("reward"),
    )


SQL_EPISODES = f"""steps as (select event_id // 10 as task_id, event_id, event_type, {SQL_STEP_ROLE} as role, props, value,
    max(value) over (partition by event_id // 10) as top from events),
known as (select *, max(case when role = 'assistant' then event_id end) over (partition by task_id) as last_a from steps where role <> 'critic'),
kept as (select * from known where event_id <= last_a qualify count(*) over (partition by task_id) >= 2)"""


def episode_summary(df):
    return df.select(
        "id", "domain", "source", F.size("messages").cast("long").alias("n"),
        chat.tool_call_count("messages").cast("long").alias("n_calls"),
        F.array_join(F.transform("messages", lambda m: m["role"]), ",").alias("roles"),
        F.array_join(F.flatten(F.transform("messages", lambda m: F.transform(
            F.coalesce(m["tool_calls"], F.array().cast(chat.CALLS_TYPE)), lambda c: F.concat(c["name"], c["arguments"])))), ";").alias("calls"),
    )


def episode_sql(ident: str, domain: str) -> str:
    return f"""with {SQL_EPISODES}
select {ident} as id, '{domain}' as domain, 'local_sim' as source, count(*) as n, count(*) filter (where event_type = 'purchase') as n_calls,
  string_agg(role, ',' order by event_id) as roles,
  coalesce(string_agg(event_type || props, ';' order by event_id) filter (where event_type = 'purchase'), '') as calls
from kept where top >= 100 group by task_id"""


@query("N8_from_tau_results", episode_sql("'local_sim__shop_' || task_id", "shop"))
def _(t: Tables):
    rows = curate.verified_only(episodes(t, nested=True).drop("trial"))
    return episode_summary(normalize.from_tau_results(rows, "shop", "local_sim"))


@query("N9_from_tau2_results", episode_sql("'sim2__shop_' || task_id || '_' || (task_id % 3)", "tau2_shop"))
def _(t: Tables):
    rows = curate.verified_only(episodes(t, nested=False))
    return episode_summary(normalize.from_tau2_results(rows, "shop", "local_sim", "sim2"))


@query("N10_trim_to_last_assistant", f"with {SQL_TRIMMED} {SQL_SUMMARY.format('trimmed')}")
def _(t: Tables):
    return summary(normalize.trim_to_last_assistant(chats(t)))


@query("N11_parse_tools", """
select event_id, case event_id % 4 when 0 then 1 when 1 then 1 when 2 then 0 else 1 end::bigint as n_tools,
  case when event_id % 4 = 2 then '' else replace(props, ' ', '') end as tools from events""")
def _(t: Tables):
    e, p = F.col("event_id") % 4, F.col("props")
    escaped = F.replace(p, F.lit('"'), F.lit('\\"'))
    raw = (
        F.when(e == 0, F.concat(F.lit("["), p, F.lit("]")))
        .when(e == 1, F.concat(F.lit('["'), escaped, F.lit('", "oops"]')))
        .when(e == 2, F.lit("not json"))
        .otherwise(F.concat(F.lit("["), p, F.lit(", 5]")))
    )
    parsed = t.events.select("event_id", normalize.parse_tools(raw).alias("tools"))
    return parsed.select("event_id", F.size("tools").cast("long").alias("n_tools"), F.array_join("tools", ";").alias("tools"))


@query("N12_source_pick_id", """
select conv_id, case when conv_id % 4 <> 0 then 'id-' || conv_id when conv_id % 8 = 0 then 'uuid-' || conv_id
  else sha256(to_json(list(struct_pack("from" := role, value := text) order by turn))) end as picked
from conversations group by conv_id""")
def _(t: Tables):
    c = F.col("conv_id")
    rows = chats(t).select(
        "conv_id",
        F.when(c % 4 != 0, F.concat(F.lit("id-"), c)).alias("id"),
        F.when(c % 8 == 0, F.concat(F.lit("uuid-"), c)).alias("uuid"),
        F.transform("messages", lambda m: F.struct(m["role"].alias("from"), m["content"].alias("value"))).alias("conversations"),
    )
    return rows.select("conv_id", normalize.source_pick_id("id", "uuid", record="conversations").alias("picked"))


@query("N13_validate_trajectories", """
select conv_id, case when max_by(role, turn) = 'assistant' then 'ok' else 'must end on an assistant turn' end as reason
from conversations group by conv_id""")
def _(t: Tables):
    good, bad = normalize.validate_trajectories(chats(t))
    return good.select("conv_id", F.lit("ok").alias("reason")).unionByName(bad.select("conv_id", "reason"))


@query("N14_with_turn_stats", """
select event_id // 10 as task_id, count(*) filter (where event_type in ('view','purchase')) as turns,
  count(*) filter (where event_type = 'purchase') as n_tool_calls from events group by 1""")
def _(t: Tables):
    return normalize.with_turn_stats(episodes(t, nested=False)).select(
        "task_id", F.col("turns").cast("long").alias("turns"), F.col("n_tool_calls").cast("long").alias("n_tool_calls")
    )


@query("N15_flatten_tool_calls", """
with s as (select event_id // 10 as task_id, event_id, case when event_type = 'purchase'
  then trim(case when event_id % 2 = 0 then '' else props end || ' {"id":"' || event_id || '","name":"purchase","arguments":"' || replace(props, '"', '\\"') || '"}')
  else case when event_id % 2 = 0 then '' else props end end as content,
  case event_type when 'click' then 'user' when 'view' then 'assistant' when 'purchase' then 'assistant' when 'signup' then 'tool' else 'critic' end as role from events)
select task_id, count(*) as n, string_agg(content, '|' order by event_id) as content from s where trim(content) <> '' or role = 'assistant' group by 1""")
def _(t: Tables):
    rows = episodes(t, nested=False).withColumn("messages", F.transform(
        "messages",
        lambda m, i: message(m["role"], F.when((F.col("task_id") * 10 + i) % 2 == 0, "").otherwise(m["content"]), m["tool_calls"]),
    ))
    flat = rows.select("task_id", normalize.flatten_tool_calls("messages").alias("m"))
    return flat.filter(F.size("m") > 0).select(
        "task_id", F.size("m").cast("long").alias("n"), F.array_join(F.transform("m", lambda x: x["content"]), "|").alias("content")
    )


SQL_MASK = """w as (select conv_id, turn, role, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') as ws from conversations),
o as (select *, len(ws) as n, coalesce(sum(len(ws)) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0) as before from w),
m as (select conv_id, sum(least(n, greatest(0, 128 - before)))::bigint as n_tokens,
   sum(case when role = 'assistant' then least(n, greatest(0, 128 - before)) else 0 end)::bigint as n_assistant,
   sum(case when role = 'assistant' then n else 0 end) as whole from o group by 1 having whole > 0)"""


@query("N16_assistant_loss_mask", f"with {SQL_MASK} select conv_id, n_tokens, n_assistant from m")
def _(t: Tables):
    masked = normalize.assistant_loss_mask(chats(t), 128)
    return masked.select(
        "conv_id", F.size("tokens").cast("long").alias("n_tokens"),
        F.size(F.filter("is_assistant", lambda x: x)).cast("long").alias("n_assistant"),
    )


@query("N16_loss_share", f"""with {SQL_MASK} select count(*) as records, sum(n_tokens)::bigint as tokens,
  sum(n_assistant)::bigint as assistant_tokens, round(sum(n_assistant) / sum(n_tokens), 6) as share from m""")
def _(t: Tables):
    return normalize.mask_share(normalize.assistant_loss_mask(chats(t), 128))


SQL_BLOCK = "string_agg('<start_of_turn>' || role || chr(10) || content || '<end_of_turn>', chr(10) order by turn)"
SQL_TOOLS = "'[{\"name\":\"t' || conv_id || '\",\"description\":\"d\"},{\"name\":\"u\"}]'"


def tools_text():
    return F.concat(F.lit('[{"name":"t'), F.col("conv_id"), F.lit('","description":"d"},{"name":"u"}]'))


def sft_summary(df):
    return df.select("conv_id", F.size("messages").cast("long").alias("n"), F.sha2("text", 256).alias("digest"))


def sft_sql(turns: str, need: str) -> str:
    return f"""with turns as ({turns}), g as (select conv_id, count(*) as n, {SQL_BLOCK} as text, bool_or(is_tool) as has_tool
  from turns group by conv_id) select conv_id, n, sha256(text) as digest from g where {need} and length(text) > 100"""


def with_tool_turns(t: Tables):
    """Chat records where the third turn counts as a tool result."""
    return chats(t).withColumn("messages", F.transform(
        "messages", lambda m, i: message(F.when((i == 2) & (F.col("conv_id") % 2 == 0), "tool").otherwise(m["role"]), m["content"])))


SQL_TOOL_TURNS = "(select conv_id, turn, case when turn = 2 and conv_id % 2 = 0 then 'tool' else role end as role, text from conversations)"


@query("N17_to_sft_text_system", sft_sql(f"""
  select conv_id, -1 as turn, 'system' as role, coalesce(max(text) filter (where role = 'system'), '') || chr(10) || chr(10) || 'Available tools:' || chr(10)
    || chr(10) || '- t' || conv_id || ': d' || chr(10) || '- u: ' as content, false as is_tool from conversations group by conv_id
  union all select conv_id, turn, case when role = 'tool' then 'user' else role end, text, role = 'tool' from {SQL_TOOL_TURNS} where role <> 'system'""",
  "n >= 3").replace("|| '- u: ' as content", "|| '- u:' as content").replace("coalesce(max(text)", "ltrim(coalesce(max(text)").replace("'- u:' as content", "'- u:', ' ' || chr(10)) as content"))
def _(t: Tables):
    rows = with_tool_turns(t).select(
        "conv_id", tools_text().alias("tools"),
        F.try_element_at(F.filter("messages", lambda m: m["role"] == "system"), F.lit(1))["content"].alias("system"),
        F.transform(F.filter("messages", lambda m: m["role"] != "system"), lambda m: F.struct(
            F.when(m["role"] == "user", "human").otherwise(m["role"]).alias("from"), m["content"].alias("value"))).alias("conversations"),
    )
    return sft_summary(normalize.to_sft_text(rows, "from_value_system"))


@query("N17_to_sft_text_json_roles", sft_sql(f"""
  select distinct conv_id, -1 as turn, 'system' as role, 'Available tools:' || chr(10) || chr(10) || '- t' || conv_id || ': d' || chr(10) || '- u: ' as content, false as is_tool from conversations
  union all select conv_id, turn, case when role = 'tool' then 'user' else role end,
    case when role = 'tool' then '[Tool Result]: ' else '' end || text, role = 'tool' from {SQL_TOOL_TURNS} where role <> 'system'""",
  "has_tool and n >= 4"))
def _(t: Tables):
    listed = F.to_json(F.transform("messages", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))))
    rows = with_tool_turns(t).select("conv_id", tools_text().alias("tools"), listed.alias("conversations"))
    return sft_summary(normalize.to_sft_text(rows, "json_roles"))


@query("N17_to_sft_text_from_value", sft_sql(f"""
  select conv_id, turn, case when role = 'tool' then 'user' else role end as role,
    case when role = 'tool' then '[Tool Result]: ' else '' end || text as content, role = 'tool' as is_tool from {SQL_TOOL_TURNS}""",
  "has_tool and n >= 4"))
def _(t: Tables):
    rows = with_tool_turns(t).select("conv_id", F.transform("messages", lambda m: F.struct(
        F.when(m["role"] == "user", "human").when(m["role"] == "assistant", "gpt").otherwise(m["role"]).alias("from"),
        m["content"].alias("value"))).alias("conversations"))
    return sft_summary(normalize.to_sft_text(rows, "from_value_tools"))


ITEM = "array<struct<type:string,role:string,content:string,name:string,arguments:string,output:string>>"


def item_rows(t: Tables):
    """Typed items from episodes; the last event is the expected action."""
    def typed(e):
        kind = (
            F.when(e["event_type"] == "click", "user").when(e["event_type"] == "view", "message")
            .when(e["event_type"] == "purchase", "function_call").when(e["event_type"] == "signup", "function_call_output")
            .otherwise("reasoning")
        )
        return F.struct(
            kind.alias("type"), F.when(kind == "message", "assistant").alias("role"), e["props"].alias("content"),
            e["event_type"].alias("name"), e["props"].alias("arguments"), e["props"].alias("output"))

    steps = t.events.groupBy((F.col("event_id") / 10).cast("long").alias("conv_id")).agg(
        F.array_sort(F.collect_list(step())).alias("steps"))
    return steps.select(
        "conv_id", F.transform(F.slice("steps", F.lit(1), F.size("steps") - 1), typed).cast(ITEM).alias("items"),
        F.transform(F.slice("steps", -1, 1), typed).cast(ITEM)[0].alias("expected_action"),
    )


SQL_ITEMS = """
  with s as (select event_id // 10 as conv_id, event_id as turn, event_type, props, event_id = max(event_id) over (partition by event_id // 10) as is_last from events)
  select conv_id, turn, case when is_last or event_type <> 'click' and event_type <> 'signup' then 'assistant' else 'user' end as role,
    case when event_type = 'purchase' then '[Calling purchase(' || props || ')]' when event_type = 'signup' and not is_last then '[Tool Result]: ' || props else props end as content,
    event_type = 'signup' and not is_last as is_tool from s where is_last or event_type <> 'error'"""


@query("N17_to_sft_text_items", sft_sql(SQL_ITEMS, "has_tool and n >= 4"))
def _(t: Tables):
    return sft_summary(normalize.to_sft_text(item_rows(t), "items"))


@query("N18_responses_items_to_messages", f"""with turns as ({SQL_ITEMS})
select conv_id, count(*) as n, string_agg(role || ':' || content, chr(10) order by turn) as transcript from turns group by conv_id""")
def _(t: Tables):
    return normalize.responses_items_to_messages(item_rows(t)).select(
        "conv_id", F.size("messages").cast("long").alias("n"), chat.transcript("messages").alias("transcript"))


def responses(t: Tables):
    """Chosen answers from documents of even ids, rejected answers from the next id; both carry errors."""
    d = t.documents.select("doc_id", "text", "lang", "source")
    prompt = F.array(F.struct(F.lit("user").alias("role"), F.col("lang").alias("content")),
                     F.struct(F.lit("assistant").alias("role"), F.lit("ok").alias("content")),
                     F.struct(F.lit("user").alias("role"), F.col("source").alias("content")))
    rows = d.withColumn("session_id", (F.col("doc_id") / 2).cast("long")).withColumn(
        "error", F.when(F.col("doc_id") % 11 == 0, "timeout"))
    full = rows.select("doc_id", "session_id", F.col("text").alias("output"), "error", prompt.alias("conversation_input"), "lang")
    return full.filter("doc_id % 2 = 0"), full.filter("doc_id % 2 = 1")


SQL_DPO = """j as (select a.doc_id // 2 as session_id, a.text as chosen, b.text as rejected, a.lang, a.source,
  case when a.doc_id % 11 = 0 or b.doc_id % 11 = 0 then 'error' when length(a.text) < 100 then 'short_chosen' when length(b.text) < 80 then 'short_rejected' end as why
  from documents a join documents b on b.doc_id = a.doc_id + 1 where a.doc_id % 2 = 0)"""


@query("N19_build_dpo_pairs", f"""with {SQL_DPO} select session_id, chosen, rejected, 'human:' || lang || '|gpt:ok|human:' || source as history
from j where why is null""")
def _(t: Tables):
    pairs, _ = normalize.build_dpo_pairs(*responses(t), 100, 80)
    return pairs.select("session_id", "chosen", "rejected", F.array_join(
        F.transform("conversations", lambda c: F.concat(c["from"], F.lit(":"), c["value"])), "|").alias("history"))


@query("N19_dpo_skip_counts", f"with {SQL_DPO} select coalesce(why, 'kept') as outcome, count(*) as n from j group by 1")
def _(t: Tables):
    _, tally = normalize.build_dpo_pairs(*responses(t), 100, 80)
    return tally.select("outcome", F.col("count").alias("n"))


@query("N20_completion_windows", """
with w as (select a.doc_id, list_filter(string_split_regex(a.lang || ' ' || a.source, '\\s+'), lambda x: x <> '') as p,
  list_filter(string_split_regex(a.text, '\\s+'), lambda x: x <> '') as c from documents a)
select doc_id, len(p) as completion_start, least(64, len(p) + len(c)) as n_tokens from w where least(64, len(p) + len(c)) - len(p) >= 4""")
def _(t: Tables):
    rows = t.documents.select("doc_id", F.concat_ws(" ", "lang", "source").alias("prompt"), F.col("text").alias("completion"))
    return normalize.completion_windows(rows, 64).select(
        "doc_id", F.col("completion_start").cast("long").alias("completion_start"), F.size("tokens").cast("long").alias("n_tokens"))


@query("N21_prompt_rows", """
select conv_id, 1::bigint as n, 'user:' || min_by(text, turn) as first from conversations where role = 'user' group by conv_id
having conv_id % 9 <> 0 order by conv_id limit 50""")
def _(t: Tables):
    c = F.col("conv_id")
    first = t.conversations.filter("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("q"))
    rows = first.select(
        "conv_id",
        F.when((c % 9 != 0) & (c % 2 == 0), F.array(F.struct(F.lit("user").alias("role"), F.col("q").alias("content")))).alias("messages"),
        F.when((c % 9 != 0) & (c % 2 == 1), F.col("q")).alias("prompt"),
    )
    m = F.col("messages")
    return normalize.prompt_rows(rows, "conv_id", 50).select(
        "conv_id", F.size(m).cast("long").alias("n"), F.concat_ws(":", m[0]["role"], m[0]["content"]).alias("first"))


@query("N37_pairs_from_ratings", """
with c as (select o.o_orderkey as id, o.o_orderpriority as instruction,
  row_number() over (partition by l_orderkey order by l_linenumber, l_returnflag, cast(l_quantity as int) % 6) as pos, l.l_returnflag || l.l_linenumber as response, cast(l.l_quantity as int) % 6 as rating
  from orders o join lineitem l on l.l_orderkey = o.o_orderkey),
g as (select id, any_value(instruction) as instruction, count(*) as n, max(rating) as best, min(rating) as worst,
  arg_max(response, rating * 1000 - pos) as chosen, arg_min(response, rating * 1000 - pos) as rejected from c group by id)
select id, instruction, chosen, rejected, 'rated' as source, (best - worst)::bigint as score_gap from g
where regexp_matches(lower(instruction), 'urgent|high') and n >= 2 and best - worst >= 2 and best >= 4""")
def _(t: Tables):
    lines = t.lineitem.select("l_orderkey", F.struct(
        "l_linenumber", F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("response"),
        (F.col("l_quantity").cast("int") % 6).alias("rating")).alias("c"))
    rated = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("c")).alias("completions"))
    rows = t.orders.join(rated, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("instruction"), "completions")
    out = normalize.pairs_from_ratings(rows, keywords=("urgent", "high"))
    return out.withColumn("score_gap", F.col("score_gap").cast("long"))


@query("N38_choose_teacher_pairs", """
with r as (select doc_id // 3 as session_id, text, lang from documents where doc_id % 3 = 0 and length(text) >= 100),
a as (select doc_id // 3 as session_id, text from documents where doc_id % 3 = 1 and doc_id % 5 <> 0),
b as (select doc_id // 3 as session_id, text from documents where doc_id % 3 = 2 and doc_id % 7 <> 0),
j as (select r.session_id, r.text as rejected, case when r.lang = 'en' and a.text is not null then a.text else b.text end as chosen,
  case when r.lang = 'en' and a.text is not null then 'teacher_first' when b.text is not null then 'teacher_second' end as source
  from r left join a using (session_id) left join b using (session_id))
select source, count(*) as n, sum(length(chosen))::bigint as chosen_chars, sum(length(rejected))::bigint as rejected_chars from j
where source is not null and length(chosen) >= 100 group by source""")
def _(t: Tables):
    d = t.documents.select("doc_id", (F.col("doc_id") / 3).cast("long").alias("session_id"), F.col("text").alias("output"), "lang")
    rejected = d.filter("doc_id % 3 = 0")
    pairs = normalize.choose_teacher_pairs(
        rejected.drop("doc_id"), d.filter("doc_id % 3 = 1 and doc_id % 5 <> 0"), d.filter("doc_id % 3 = 2 and doc_id % 7 <> 0"),
        rejected.filter("lang = 'en'"))
    return pairs.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("chosen")).alias("chosen_chars"), F.sum(F.length("rejected")).alias("rejected_chars"))


# --- hashing, dedup, mixing -------------------------------------------------------------------

@query("F1_prompt_hash", f"with {SQL_HASHED} select conv_id, prompt_hash from hashed")
def _(t: Tables):
    return curate.with_hashes(trajectories(t)).select("conv_id", "prompt_hash")


@query("F2_content_hash", f"with {SQL_HASHED} select conv_id, content_hash from hashed")
def _(t: Tables):
    return curate.with_hashes(trajectories(t)).select("conv_id", "content_hash")


@query("F3_dedup_content", f"""with {SQL_REGISTRY}, d as (select doc_id as id, 'src' || (doc_id % 5) as source,
  substr(sha256(trim(regexp_replace(lower('user:' || text), '\\s+', ' ', 'g'))), 1, 16) as content_hash from documents)
select id, source, content_hash from d join registry using (source)
qualify row_number() over (partition by content_hash order by source_rank, id) = 1""")
def _(t: Tables):
    docs = t.documents.select(
        F.col("doc_id").alias("id"), F.concat(F.lit("src"), (F.col("doc_id") % 5).cast("string")).alias("source"),
        F.array(message(F.lit("user"), F.col("text"))).alias("messages"))
    ranked = docs.join(F.broadcast(registry(t).select("source", "source_rank")), "source")
    hashed = curate.with_hashes(ranked).drop("messages")
    return curate.dedup_content(hashed).select("id", "source", "content_hash")


@query("F4_decontaminate", """
with h as (select doc_id, source, substr(sha256(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))), 1, 16) as prompt_hash from documents),
held as (select prompt_hash from h where source in (select distinct source from documents order by source limit 2)
  union select substr(sha256(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))), 1, 16) from benchmark)
select doc_id, source, prompt_hash from h where source not in (select distinct source from documents order by source limit 2)
  and prompt_hash not in (select prompt_hash from held)""")
def _(t: Tables):
    docs = t.documents.select("doc_id", "source", chat.short_hash("text").alias("prompt_hash"))
    held_sources = t.documents.select("source").distinct().orderBy("source").limit(2)
    held = docs.join(held_sources, "source", "left_semi").select("prompt_hash").union(
        t.benchmark.select(chat.short_hash("text").alias("prompt_hash")))
    return curate.decontaminate(docs.join(held_sources, "source", "left_anti"), held).select("doc_id", "source", "prompt_hash")


@query("F4_decontaminate_passages", """
with d as (select doc_id, regexp_extract_all(lower(text), '[a-z0-9'']+') as w from documents), b as (select regexp_extract_all(lower(text), '[a-z0-9'']+') as w from benchmark),
h as (select distinct array_to_string(w[i:i+12], ' ') as run from (select w, unnest(range(1, len(w) - 11)) as i from b)),
g as (select doc_id, array_to_string(w[i:i+12], ' ') as run from (select doc_id, w, unnest(range(1, len(w) - 11)) as i from d))
select doc_id from documents where doc_id not in (select doc_id from g join h using (run))""")
def _(t: Tables):
    return curate.decontaminate_passages(t.texts.select("doc_id", "text"), t.benchmark.select(F.col("text").alias("held")), "doc_id", "text", "held").select("doc_id")


@query("F5_select_mix", f"""with {SQL_REGISTRY}, c as (select distinct conv_id, 'src' || (conv_id % 5) as source from conversations),
m as (select 'blend' as mix, source from registry where enabled union all select 'own', source from registry where enabled and teacher = 'local'
  union all select 'public', source from registry where enabled and teacher <> 'local' union all select 'only', source from registry where source in ('src4'))
select mix, source, count(*) as n from m join c using (source) group by mix, source""")
def _(t: Tables):
    rows = t.conversations.select("conv_id", F.concat(F.lit("src"), (F.col("conv_id") % 5).cast("string")).alias("source")).distinct()
    reg, out = registry(t), None
    for label, kw in {"blend": {}, "own": {"mix": "own"}, "public": {"mix": "public"}, "only": {"only": ["src4"]}}.items():
        part = curate.select_mix(rows, reg, **kw).groupBy("source").agg(F.count(F.lit(1)).alias("n")).withColumn("mix", F.lit(label))
        out = part if out is None else out.unionByName(part)
    return out.select("mix", "source", "n")


SQL_CAP = "select {0} from (select *, case when {1} % 7 = 0 then null else {1} % 50 end as o from {2}) qualify row_number() over (partition by {3} order by o nulls last, {1}) <= {4}"


def capped(df, key, n, **names):
    """Cap by an order with ties and NULLs."""
    rows = df.withColumn("o", F.when(F.col(key) % 7 != 0, F.col(key) % 50))
    return curate.cap_per_source(rows, n, "o", tie=key, **names)


@query("F6_cap_per_source", SQL_CAP.format("source, doc_id", "doc_id", "documents", "source", 20))
def _(t: Tables):
    return capped(t.documents.select("source", "doc_id"), "doc_id", 20).select("source", "doc_id")


@query("F6_cap_per_source_large", SQL_CAP.format("event_type as source, event_id", "event_id", "events", "event_type", 1500))
def _(t: Tables):
    return capped(t.events.select(F.col("event_type").alias("source"), "event_id"), "event_id", 1500).select("source", "event_id")


SQL_KEY = "('0x' || substr(sha256({0} || '|' || '{1}'), 1, 12))::bigint"


@query("F7_weighted_sample", f"""with {SQL_REGISTRY}, d as (select doc_id as id, 'src' || (doc_id % 5) as source, {SQL_KEY.format('doc_id', 7)} as k from documents),
q as (select source, floor(300 * weight / sum(weight) over ()) as quota from registry)
select id, source from d join q using (source) qualify row_number() over (partition by source order by k) <= any_value(quota) over (partition by source)""")
def _(t: Tables):
    rows = t.documents.select(F.col("doc_id").alias("id"), F.concat(F.lit("src"), (F.col("doc_id") % 5).cast("string")).alias("source"))
    return curate.weighted_sample(rows, registry(t), 300, seed=7).select("id", "source")


@query("F8_verified_only", """
with e as (select event_id // 10 as task_id, case when max(value) >= 100 then 1.0 else 0.0 end as reward from events group by 1)
select 'd' || (task_id % 3) as domain, count(*) as seen, count(*) filter (where reward >= 1) as kept from e group by 1""")
def _(t: Tables):
    rows = episodes(t, nested=False).withColumn("domain", F.concat(F.lit("d"), (F.col("task_id") % 3).cast("string")))
    return curate.verified_yield(rows, "domain")


SKILLS = {"click": "browse", "view": "browse", "purchase": "buy", "signup": "join"}


@query("F9_partition_by_skill", """
with f as (select event_id // 10 as task_id, min_by(event_type, event_id) as first from events group by 1),
s as (select task_id, case first when 'click' then 'browse' when 'view' then 'browse' when 'purchase' then 'buy' when 'signup' then 'join' end as skill from f)
select skill, count(*) as n from s where skill is not null group by skill""")
def _(t: Tables):
    actions = t.events.groupBy((F.col("event_id") / 10).cast("long").alias("task_id")).agg(
        F.transform(F.array_sort(F.collect_list(step())), lambda e: F.struct(e["event_type"].alias("name"))).alias("actions"))
    out = work_dir(t.spark, "skills")
    curate.partition_by_skill(actions, SKILLS).select("task_id", "skill").write.partitionBy("skill").parquet(out)
    return t.spark.read.parquet(out).groupBy("skill").agg(F.count(F.lit(1)).alias("n"))


@query("F10_length_band_sample", f"""
with w as (select doc_id, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) as n, {SQL_KEY.format('doc_id', 3)} as k from documents)
select doc_id from w where n between 40 and 200 order by k, doc_id limit 100""")
def _(t: Tables):
    return curate.length_band_sample(t.documents, "text", 40, 200, 100, "doc_id", 3).select("doc_id")


@query("F11_quality_gate", """
select case when l_quantity >= 10 and l_discount >= 0.02 and l_discount <= 0.08 and l_tax <= 0.05 then 'kept' else 'rejected' end as outcome,
  count(*) as n, round(sum(l_extendedprice), 2) as price from lineitem group by 1""")
def _(t: Tables):
    kept, rejected = curate.quality_gate(
        t.lineitem, {"l_quantity": (10, None), "l_discount": (0.02, 0.08), "l_tax": (None, 0.05)})

    def tally(df, label):
        return df.groupBy(F.lit(label).alias("outcome")).agg(
            F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("price"))

    return tally(kept, "kept").unionByName(tally(rejected, "rejected"))


SQL_HELD = "held as (select distinct user_id from events order by user_id desc limit 4)"


@query("F12_holdout_last_k_groups", f"""with {SQL_HELD}
select user_id, case when user_id in (select user_id from held) then 'test' else 'train' end as part, count(*) as n from events group by 1, 2""")
def _(t: Tables):
    rest, held = curate.holdout_last_k_groups(t.events.select("user_id"), "user_id", 4)
    return (
        rest.withColumn("part", F.lit("train")).unionByName(held.withColumn("part", F.lit("test")))
        .groupBy("user_id", "part").agg(F.count(F.lit(1)).alias("n")))


@query("F13_split_by_column", """
select case when lang = 'fr' then 'test' else 'rest' end as part, count(*) as n, sum(n_chars)::bigint as chars from documents group by 1""")
def _(t: Tables):
    rest, test = curate.split_by_column(t.documents, "lang", "fr")
    both = rest.withColumn("part", F.lit("rest")).unionByName(test.withColumn("part", F.lit("test")))
    return both.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query("F14_train_eval_split", f"""with k as (select doc_id, {SQL_KEY.format('doc_id', 42)} as k from documents)
select doc_id, case when k % 100 < 5 then 'eval' else 'train' end as split from k order by k, doc_id limit 800""")
def _(t: Tables):
    return curate.train_eval_split(t.documents.select("doc_id"), "doc_id", 5, 42, cap=800)


@query("F15_select_problems", """
select o_orderkey, o_orderdate::date as o_orderdate, o_orderpriority from orders
where o_orderdate >= date '1998-01-01' and o_orderpriority in ('1-URGENT') order by o_orderdate, o_orderkey limit 40""")
def _(t: Tables):
    rows = t.orders.select("o_orderkey", F.col("o_orderdate").cast("date").alias("o_orderdate"), "o_orderpriority")
    return curate.select_problems(rows, "o_orderdate", "o_orderkey", "o_orderpriority", "1998-01-01", ["1-URGENT"], 40, ["2-HIGH"])


@query("F16_dedup_tasks", """
select user_id, event_type, event_id from events qualify row_number() over (partition by user_id order by event_type, event_id) = 1""")
def _(t: Tables):
    return curate.dedup_tasks(t.events.select("user_id", "event_type", "event_id"), "user_id", ["event_type", "event_id"])


@query("S9_write_versioned", f"""with {SQL_REGISTRY}, {SQL_HASHED},
kept as (select h.* from hashed h join registry r using (source) where enabled qualify row_number() over (partition by content_hash order by source_rank, conv_id) = 1),
n as (select source, count(*) as kept from kept group by 1)
select 'v1' as version, 'blend' as mix, source, teacher, weight::double as weight, coalesce(kept, 0)::bigint as kept, (select count(*) from kept) as total
from registry left join n using (source) where enabled""")
def _(t: Tables):
    """Corpus build: records -> mix -> dedup -> versioned JSON lines and manifest."""
    reg = registry(t)
    mixed = curate.select_mix(trajectories(t).drop("source_rank"), reg).withColumn("id", F.col("conv_id"))
    hashed = curate.with_hashes(mixed)
    unique = curate.dedup_content(hashed.select("id", "source_rank", "content_hash")).select("id")
    rows = hashed.join(unique, "id", "left_semi").select("id", "source", "messages", "content_hash")
    return writers.write_versioned(rows, reg.filter("enabled"), work_dir(t.spark, "corpus"), "v1")


BUILD_CAP = 150


@query("S9_corpus_build", f"""with {SQL_REGISTRY}, {SQL_HASHED},
capped as (select conv_id from (select distinct conv_id from conversations) qualify row_number() over (partition by conv_id % 5 order by conv_id) <= {BUILD_CAP}),
banned as (select prompt_hash from hashed where conv_id % 10 = 3),
kept as (select h.* from hashed h join capped using (conv_id) join registry r using (source) where enabled and prompt_hash not in (select prompt_hash from banned)
  qualify row_number() over (partition by content_hash order by source_rank, conv_id) = 1),
n as (select source, count(*) as kept from kept group by 1)
select 'v2' as version, 'blend' as mix, source, teacher, weight::double as weight, coalesce(kept, 0)::bigint as kept, (select count(*) from kept) as total
from registry left join n using (source) where enabled""")
def _(t: Tables):
    """The whole build: each source in its own format through its adapter, then cap, check, decontamination by prompts of
    an evaluation set, dedup, and the versioned write with its manifest."""
    plain = chats(t).withColumn("id", F.col("conv_id"))
    share = sharegpt_rows(t).withColumn("id", F.col("conv_id")).withColumn("source", source_of(F.col("conv_id")))
    of = lambda df, *names: df.filter(F.col("source").isin(*names))
    parts = {
        "sharegpt": of(share, "src0", "src1"), "openai_messages": of(plain, "src2"),
        "json_string_messages": of(plain, "src3", "src4").withColumn("messages", F.to_json("messages"))}
    held = trajectories(t).filter("conv_id % 10 = 3").select(chat.prompt_hash("messages").alias("prompt_hash"))
    reg = registry(t)
    rows = curate.build_corpus(parts, reg, held, BUILD_CAP)
    return writers.write_versioned(rows, reg.filter("enabled"), work_dir(t.spark, "corpus"), "v2")
