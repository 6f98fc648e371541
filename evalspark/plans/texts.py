"""Flags, cleaning, sections, JSON and code picks, degeneration and distribution metrics over documents."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..functions import lists
from ..functions.arrow import arrow_udf
from ..functions.text import tokens
from ..operators import curate, documents, tables, textstats
from ..operators.ranking import numbered
from .registry import Tables, query

SNIPPETS = ("import os; os._exit(0)", "raise SystemExit", "x = __results", "sum(range(3))", "import builtins", "monkeypatch.setattr")


def pick(values, index):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values) + 1).cast("int"))


def sql_pick(values, index) -> str:
    quoted = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"[{quoted}][({index} % {len(values)} + 1)::int]"


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def solutions(t: Tables):
    return t.texts.select("doc_id", F.concat("text", F.lit("\n"), pick(SNIPPETS, F.col("doc_id"))).alias("text"))


SQL_SOLUTIONS = f"s as (select doc_id, text || chr(10) || {sql_pick(SNIPPETS, 'doc_id')} as text from documents)"


@query("F17_flag_gaming", f"with {SQL_SOLUTIONS}, p(pattern, why, i) as (values {', '.join('(' + sql_text(p) + ',' + sql_text(w) + ',' + str(i) + ')' for i, (p, w) in enumerate(lists.GAMING_PATTERNS))})"
       " select doc_id, coalesce(string_agg(why, ';' order by i) filter (where regexp_matches(text, pattern)), '') as reasons,"
       " bool_or(regexp_matches(text, pattern)) as excluded from s, p group by doc_id")
def _(t: Tables):
    return curate.flag_gaming(solutions(t), "text").select("doc_id", F.array_join("reasons", ";").alias("reasons"), "excluded")


LEAKS = ("<tool_call>{}", "```TOOL x", 'say {"name": "f", "arguments": {}}', "[tool_call]", "print(default_api.x())", "plain", "name: f")
REFUSALS = ("I cannot browse the web.", "As an AI I must stop", "I'm sorry, but I will not", "Sure thing", "a language model", "I don't have real-time data")
MARKS = ("<|im_end|>", "<|channel|>", " <think>", "x<think>", "<|im_mid|>", "fine")


@query("F18_flag_tool_leak", f"select doc_id, regexp_matches({sql_pick(LEAKS, 'doc_id')} || text, '(?i)' || {sql_text('|'.join(lists.TOOL_LEAK_PATTERNS))}) as leaked from documents")
def _(t: Tables):
    return t.texts.select("doc_id", curate.tool_leak(F.concat(pick(LEAKS, F.col("doc_id")), "text")).alias("leaked"))


@query("F19_flag_refusal", f"select doc_id, regexp_matches(text || ' ' || {sql_pick(REFUSALS, 'doc_id')}, '(?i)' || {sql_text(lists.REFUSAL_PATTERN)}) as refused from documents")
def _(t: Tables):
    return t.texts.select("doc_id", curate.refusal(F.concat_ws(" ", "text", pick(REFUSALS, F.col("doc_id")))).alias("refused"))


@query("F20_flag_template_leak", f"select doc_id, regexp_matches(text || {sql_pick(MARKS, 'doc_id')}, {sql_text(lists.TEMPLATE_LEAK_PATTERN)}) as leaked from documents")
def _(t: Tables):
    return t.texts.select("doc_id", curate.template_leak(F.concat("text", pick(MARKS, F.col("doc_id")))).alias("leaked"))


def secret_text():
    return F.concat(pick(("sk_live_", "AKIA", "ghp_", "plain_"), F.col("doc_id")), F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 14))


@query("F21_detect_secret_leaks", """
with b as (select doc_id as case_id, text, ['sk_live_','AKIA','ghp_','plain_'][(doc_id % 4 + 1)::int] as pfx, substr(sha256(cast(doc_id as varchar)), 1, 14) as body from documents),
r as (select *, pfx || body as secret, text || case doc_mod when 0 then upper(pfx || body) when 1 then body when 2 then base64(encode(pfx || body)) else '' end as reply
  from (select *, (case_id // 4) % 4 as doc_mod from b)),
v as (select case_id, reply, secret, case when pfx <> 'plain_' and length(secret) > length(pfx) + 8 then body end as bare, base64(encode(secret)) as b64 from r)
select case_id, (contains(lower(reply), lower(secret))::int + coalesce(contains(lower(reply), lower(bare))::int, 0) + contains(lower(reply), lower(b64))::int)::bigint as n_leaked,
  contains(lower(reply), lower(secret)) or coalesce(contains(lower(reply), lower(bare)), false) or contains(lower(reply), lower(b64)) as leaked from v""")
def _(t: Tables):
    secret, kind = secret_text(), (F.col("doc_id") / 4).cast("long") % 4
    bare = F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 14)
    tail = F.when(kind == 0, F.upper(secret)).when(kind == 1, bare).when(kind == 2, F.base64(secret.cast("binary"))).otherwise("")
    outputs = t.documents.select(F.col("doc_id").alias("case_id"), F.concat("text", tail).alias("reply"))
    secrets = t.documents.select(F.col("doc_id").alias("case_id"), secret.alias("secret"))
    return curate.detect_secret_leaks(outputs, secrets).select("case_id", F.col("n_leaked").cast("long").alias("n_leaked"), "leaked")


@query("F22_complete_arms_only", """
with r as (select lang as arm, source as run, count(*) as n from documents group by 1, 2), a as (select arm, count(*) as runs, min(n) as lo, max(n) as hi from r group by 1)
select count(*) as arms, bool_and(lo = hi) as equal_pieces, min(runs) = max(runs) as equal_runs, bool_and(lo = hi) and min(runs) = max(runs) as complete from a""")
def _(t: Tables):
    return curate.arm_completeness(t.documents, "lang", "source")


# --- cleaning and extraction ----------------------------------------------------------------------

@query("N22_clean_prompt_text", """
with c as (select doc_id, '[ wp ] The ' || source || '  of ' || lang || ' , it ''s ``so'' '' .' as p, '[WP]' || replace(text, chr(10), ' <newline> ') || ' it ''s  ' as s from documents),
k as (select doc_id, trim(regexp_replace(replace(replace(regexp_replace(p, '(?i)\\[\\s*(WP|EU|CW|TT|IP|RF|PI|PM|MP|OT|SP|CC)\\s*\\]', '', 'g'), '<newline>', chr(10)), ' ''s', '''s'), '\\s+\\n', chr(10), 'g')) as p,
  regexp_replace(regexp_replace(replace(replace(regexp_replace(s, '(?i)\\[\\s*(WP|EU|CW|TT|IP|RF|PI|PM|MP|OT|SP|CC)\\s*\\]', '', 'g'), '<newline>', chr(10)), ' ''s', '''s'), '\\s+\\n', chr(10), 'g'), '^\\s+|\\s+$', '', 'g') as s from c)
select doc_id, trim(regexp_replace(regexp_replace(replace(replace(p, '``', '"'), '''''', '"'), '\\s+([,.!?;:’''])', '\\1', 'g'), '[ \\t]+', ' ', 'g')) as prompt, sha256(s) as story_hash
from k where length(p) > 15 and len(list_filter(string_split_regex(s, '\\s+'), lambda x: x <> '')) between 150 and 700""")
def _(t: Tables):
    rows = t.texts.select(
        "doc_id", F.concat(F.lit("[ wp ] The "), "source", F.lit("  of "), "lang", F.lit(" , it 's ``so' ' .")).alias("prompt"),
        F.concat(F.lit("[WP]"), F.replace("text", F.lit("\n"), F.lit(" <newline> ")), F.lit(" it 's  ")).alias("story"))
    return documents.clean_prompt_text(rows, "prompt", "story").select("doc_id", "prompt", F.sha2("story", 256).alias("story_hash"))


def json_outputs(t: Tables):
    e, p = F.col("event_id"), F.col("props")
    text = (
        F.when(e % 5 == 0, F.concat(F.lit("Here:\n```json\n"), p, F.lit("\n```\nand {bad")))
        .when(e % 5 == 1, F.concat(F.lit("The value {is "), p, F.lit(" done")))
        .when(e % 5 == 2, F.concat(F.lit("list ["), p, F.lit(", [1, 2]] end")))
        .when(e % 5 == 3, F.concat(F.lit('{"shots": ['), p, F.lit(', "3 days"], "ok": true}')))
        .otherwise(F.lit("nothing here"))
    )
    return t.event_rows.select("event_id", text.alias("text"))


@query("N31_pick_json", """
select event_id, case event_id % 5 when 0 then replace(props, ' ', '') when 1 then replace(props, ' ', '') when 2 then replace(props, ' ', '')
  when 3 then '{"shots":[' || replace(props, ' ', '') || ',"3 days"],"ok":true}' end as json, event_id % 5 <> 4 as found from events""")
def _(t: Tables):
    picked = json_outputs(t).select("event_id", documents.pick_json("text").alias("p"))
    return picked.select("event_id", F.col("p.json").alias("json"), F.col("p.error").isNull().alias("found"))


@query("N39_json_path_get", """
with e as (select event_id, event_id % 5 as m, cast(regexp_extract(props, '[0-9]+', 0) as bigint) as k from events)
select event_id, case m when 3 then cast(k as varchar) else 'none' end as first_text, case m when 3 then k else 0 end::bigint as first_int, m = 3 as first_ok,
  case m when 3 then '3 days' else '7' end as last_text, case m when 3 then 3 else 7 end::double as last_float, case m when 3 then 2 else 0 end::bigint as n_shots from e""")
def _(t: Tables):
    rows = documents.json_path_get(json_outputs(t), "text", "shots[0].k", "none")
    rows = rows.select("event_id", "text", F.col("value_text").alias("first_text"), F.col("value_int").alias("first_int"), F.col("ok").alias("first_ok"))
    last = documents.json_path_get(rows, "text", "shots[-1]", "7")
    return last.select("event_id", "first_text", "first_int", "first_ok", F.col("value_text").alias("last_text"), F.col("value_float").alias("last_float"),
                       documents.json_path_count("text", "shots").cast("long").alias("n_shots"))


@query("N39_json_path_rows", """
with e as (select event_id, event_id % 5 as m, regexp_extract(props, '[0-9]+', 0) as k from events)
select event_id, m in (0, 2, 3) as ok, case when m in (1, 4) then 'none' when m = 3 and event_id % 2 = 0 then '3 days' else k end as value_text from e""")
def _(t: Tables):
    """Every row brings its own path."""
    shots = F.when(F.col("event_id") % 2 == 0, "shots[-1]").otherwise("shots[0].k")
    rows = json_outputs(t).withColumn("path", F.when(F.col("event_id") % 5 == 3, shots).when(F.col("event_id") % 5 == 2, "[0].k").otherwise("k"))
    return documents.json_path_rows(rows, "text", "path", "none").select("event_id", "ok", "value_text")


SQL_CODE = """c as (select doc_id, case doc_id % 3 when 0 then 'Draft:' || chr(10) || '```python' || chr(10) || 'def solve(x): pass' || chr(10) || '```' || chr(10) || 'Final:' || chr(10) || '```py' || chr(10) || 'def solve(y):' || chr(10) || ' return ' || doc_id || chr(10) || '```' || chr(10) || '```' || chr(10) || lang || repeat(source, 9) || chr(10) || '```'
  when 1 then '```' || chr(10) || source || chr(10) || '```' || chr(10) || '```' || chr(10) || text || chr(10) || '```' else text end as out from documents)"""


@query("N32_pick_code", f"""with {SQL_CODE} select doc_id, case doc_id % 3 when 0 then 'def solve(y):' || chr(10) || ' return ' || doc_id
  else (select case when doc_id % 3 = 1 and length(source) >= length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) then source else regexp_replace(text, '^\\s+|\\s+$', '', 'g') end
    from documents d where d.doc_id = c.doc_id) end as code from c""")
def _(t: Tables):
    i = F.col("doc_id") % 3
    draft = F.concat(F.lit("Draft:\n```python\ndef solve(x): pass\n```\nFinal:\n```py\ndef solve(y):\n return "), F.col("doc_id").cast("string"),
                     F.lit("\n```\n```\n"), "lang", F.repeat("source", 9), F.lit("\n```"))
    out = F.when(i == 0, draft).when(i == 1, F.concat(F.lit("```\n"), "source", F.lit("\n```\n```\n"), "text", F.lit("\n```"))).otherwise(F.col("text"))
    return t.texts.select("doc_id", documents.pick_code(out, "solve").alias("code"))


@query("N33_strip_reasoning", """
select doc_id, regexp_replace(case doc_id % 4 when 3 then 'tail' else text end, '^\\s+|\\s+$', '', 'g') as body from documents""")
def _(t: Tables):
    i, tag = F.col("doc_id") % 4, documents.RESPONSE_TAG
    raw = (
        F.when(i == 0, F.concat(F.lit("<think>a\nb</think>\n"), F.lit(documents.RESPONSE_MARKER), F.lit("\n"), "text"))
        .when(i == 1, F.concat(F.lit(f"<{tag}>old</{tag}> then <{tag}>"), "text", F.lit(f"</{tag}> bye")))
        .when(i == 2, F.concat(F.lit(f"<Think>never closed <{tag}>{documents.RESPONSE_MARKER}"), "text"))
        .otherwise(F.concat(F.lit("tail <think>"), "text"))
    )
    return t.texts.select("doc_id", documents.strip_reasoning(raw).alias("body"))


@query("N33_last_envelope")
def _(t: Tables):
    body = F.concat(F.lit('before {"stdout": "old"} then '), F.to_json(F.struct(F.lit(0).alias("exit_code"), F.col("text").alias("stdout"))), F.lit(" end {x}"))
    last = t.texts.select("doc_id", F.get_json_object(documents.last_envelope(body), "$.stdout").alias("stdout"), "text")
    return last.select("doc_id", (F.col("stdout") == F.col("text")).alias("same"))


@query("N34_split_sections", """
with d as (select doc_id, case when doc_id % 3 = 0 then text else replace(text, chr(10), chr(10) || '## Part ' || lang || ' ' || chr(10)) end as md from documents),
x as (select doc_id, regexp_extract_all(md, '\\n(#{1,3}\\s+[^\\n]+)\\n', 1) as h, string_split_regex(md, '\\n#{1,3}\\s+[^\\n]+\\n') as b from d),
s as (select doc_id, h, unnest(b) as body, generate_subscripts(b, 1) - 1 as ordinal from x),
c as (select doc_id, ordinal, len(h) > 0 as has, case when ordinal = 0 then cast(doc_id as varchar) else trim(regexp_replace(trim(h[ordinal]), '^#+', '')) end as heading, regexp_replace(body, '^\\s+|\\s+$', '', 'g') as body from s)
select doc_id, ordinal, case when has then doc_id || '::' || heading || '::' || ordinal else cast(doc_id as varchar) end as section_id,
  sha256(case when has then heading || chr(10) || chr(10) || body else body end) as content from c where length(body) > 100""")
def _(t: Tables):
    md = F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(
        F.replace("text", F.lit("\n"), F.concat(F.lit("\n## Part "), "lang", F.lit(" \n"))))
    out = documents.split_sections(t.texts.select("doc_id", md.alias("text")))
    return out.select("doc_id", F.col("ordinal").cast("long").alias("ordinal"), "section_id", F.sha2("content", 256).alias("content"))


SQL_MARKDOWN = "regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>|<nav.*?</nav>|<footer.*?</footer>|<head>.*?</head>|<!--.*?-->', '', 'g')"
for _level in (1, 2, 3):
    SQL_MARKDOWN = f"regexp_replace({SQL_MARKDOWN}, '(?i)<h{_level}(\\s[^>]*)?>', chr(10) || '{'#' * _level} ', 'g')"
SQL_MARKDOWN = f"regexp_replace(regexp_replace({SQL_MARKDOWN}, '(?i)</(h[1-3]|p|div|li|tr)>|<br[^>]*>|<p>', chr(10), 'g'), '<[^>]*>', '', 'g')"
for _name, _mark in (("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "chr(34)"), ("&#x27;", "chr(39)"), ("&nbsp;", "' '"), ("&amp;", "'&'")):
    SQL_MARKDOWN = f"replace({SQL_MARKDOWN}, '{_name}', {_mark})"
SQL_MARKDOWN = f"regexp_replace(regexp_replace({SQL_MARKDOWN}, '[ \\t]+', ' ', 'g'), '\\n\\s*\\n', chr(10), 'g')"


@query("N34_html_sections", f"""with d as (select page_id, {SQL_MARKDOWN} as md from pages),
x as (select page_id, regexp_extract_all(md, '\\n(#{{1,3}}\\s+[^\\n]+)\\n', 1) as h, string_split_regex(md, '\\n#{{1,3}}\\s+[^\\n]+\\n') as b from d),
s as (select page_id, h, unnest(b) as body, generate_subscripts(b, 1) - 1 as ordinal from x),
c as (select page_id, ordinal, len(h) > 0 as has, case when ordinal = 0 then cast(page_id as varchar) else trim(regexp_replace(trim(h[ordinal]), '^#+', '')) end as heading, regexp_replace(body, '^\\s+|\\s+$', '', 'g') as body from s)
select page_id, ordinal, case when has then page_id || '::' || heading || '::' || ordinal else cast(page_id as varchar) end as section_id,
  sha256(case when has then heading || chr(10) || chr(10) || body else body end) as content from c where length(body) > 100""")
def _(t: Tables):
    out = documents.html_sections(t.pages.select("page_id", "html"))
    return out.select("page_id", F.col("ordinal").cast("long").alias("ordinal"), "section_id", F.sha2("content", 256).alias("content"))


@query("N35_extract_docstrings", """
with d as (select doc_id, lang, regexp_replace(text, '^\\s+|\\s+$', '', 'g') as body, text from documents)
select doc_id, doc_id || '::module-doc' as entry_id, sha256(lang) as content from d where doc_id % 3 = 0
union all select doc_id, doc_id || '::f' || doc_id, sha256('f' || doc_id || chr(10) || chr(10) || body) from d where doc_id % 3 = 0 and length(body) > 50
union all select doc_id, cast(doc_id as varchar), sha256(repeat('# note' || chr(10), 4) || text) from d where doc_id % 3 = 1 and length(text) + 28 > 200""")
def _(t: Tables):
    i = F.col("doc_id") % 3
    code = (
        F.when(i == 0, F.concat(F.lit('"""'), "lang", F.lit('"""\ndef f'), F.col("doc_id").cast("string"), F.lit('(x):\n    """'), "text", F.lit('"""\n')))
        .when(i == 1, F.concat(F.repeat(F.lit("# note\n"), 4), "text")).otherwise(F.col("text"))
    )
    out = documents.extract_docstrings(t.texts.select("doc_id", code.alias("text")))
    return out.select("doc_id", "entry_id", F.sha2("content", 256).alias("content"))


@arrow_udf("string")
def packed(text: pd.Series) -> pd.Series:
    import base64
    import zlib

    return text.map(lambda x: base64.b64encode(zlib.compress(x.encode())).decode())


@query("N36_decode_test_cases", """
select event_id, case when event_id % 7 = 0 then 1 else 2 end::bigint as n_tests, event_type || case when event_id % 7 = 0 then '' else ',' || props end as inputs from events""")
def _(t: Tables):
    def case(source, output):
        return F.struct(source.alias("input"), output.alias("output"), F.lit("stdin").alias("testtype"))

    kind, props = F.col("event_type"), F.col("props")
    public = F.to_json(F.array(case(kind, props)))
    private = packed(F.to_json(F.array(case(kind, props), case(props, kind))))
    broken = F.when(F.col("event_id") % 7 == 0, F.lit("gASVCgAAAAAAAACMBnBpY2tsZZQu")).otherwise(private)
    out = documents.decode_test_cases(t.events.select("event_id", public.alias("pub"), broken.alias("priv")), "pub", "priv")
    return out.select("event_id", F.size("tests").cast("long").alias("n_tests"), F.array_join(F.transform("tests", lambda x: x["input"]), ",").alias("inputs"))


# --- token and slop metrics ----------------------------------------------------------------------------

SQL_TOK = "tok as (select doc_id, lang, unnest(regexp_extract_all(lower(text), '[a-z0-9'']+')) as w from documents)"


@query("T1_tokenize", f"with {SQL_TOK} select lang, w as word, count(*) as n from tok group by 1, 2")
def _(t: Tables):
    return textstats.token_counts(t.texts, "text", "lang")


@query("J9_freq_outer", f"""with {SQL_TOK}, a as (select w, count(*) as n from tok where lang = 'en' group by 1), b as (select w, count(*) as n from tok where lang = 'fr' group by 1)
select coalesce(a.w, b.w) as word, coalesce(a.n, 0) as n_a, coalesce(b.n, 0) as n_b from a full join b on a.w = b.w""")
def _(t: Tables):
    freq = textstats.token_counts(t.documents.filter(F.col("lang").isin("en", "fr")), "text", "lang")
    return tables.freq_outer(freq.filter("lang = 'en'"), freq.filter("lang = 'fr'"), "word")


@query("T2_token_l2", f"""with {SQL_TOK}, f as (select w, count(*) filter (where lang = 'en') as a, count(*) filter (where lang <> 'en') as b from tok group by w)
select round(sqrt(sum(power(a / (select sum(a) from f) - b / (select sum(b) from f), 2))), 6) as token_l2 from f""")
def _(t: Tables):
    return textstats.token_l2(t.texts, "text", F.when(F.col("lang") == "en", "a").otherwise("b"))


SLOPPY = (" a tapestry of — light", " it was not cold, but warm", " she couldn't help - well - delve", " plain", " a myriad myriad; not dark, it's grey")
SQL_PHRASES = " + ".join(f"(length(lo) - length(replace(lo, {sql_text(p)}, ''))) / {len(p)}" for p in lists.STOCK_PHRASES)


@query("T3_slop_rate", f"""with s as (select lang, text || {sql_pick(SLOPPY, 'doc_id')} as tx, lower(text || {sql_pick(SLOPPY, 'doc_id')}) as lo from documents),
c as (select lang, (length(tx) - length(replace(tx, '—', ''))) + len(regexp_extract_all(tx, '\\s-\\s')) as em, len(regexp_extract_all(lo, {sql_text(lists.NOT_X_BUT_Y)})) as nx, {SQL_PHRASES} as ph,
  len(regexp_extract_all(lo, '[a-z0-9'']+')) as w from s)
select lang, sum(em)::bigint as em_dash, sum(nx)::bigint as not_x_y, sum(ph)::bigint as phrases, round((sum(em) + sum(nx) + sum(ph)) * 1000.0::double / sum(w), 2) as total_per_1k from c group by lang""")
def _(t: Tables):
    rows = t.texts.select("lang", F.concat("text", pick(SLOPPY, F.col("doc_id"))).alias("text"))
    return textstats.slop_rate(rows, "text", "lang")


def phrase_table(t: Tables):
    """Words and neighbouring word pairs of the benchmark texts, most frequent first, as a phrase list."""
    toks = t.benchmark.select("item_id", tokens("text").alias("w"))
    count = F.greatest(F.size("w") - 1, F.lit(0))
    pairs = F.transform(F.arrays_zip(F.slice("w", F.lit(1), count), F.slice("w", F.lit(2), count)), lambda z: F.concat_ws(" ", z["0"], z["1"]))
    grams = toks.select(F.explode(F.concat("w", pairs)).alias("phrase")).groupBy("phrase").agg(F.count(F.lit(1)).alias("n"))
    ranked = numbered(grams.withColumn("_fewer", -F.col("n")), [], ["_fewer", "phrase"], "_rn").withColumn("rank", F.col("_rn") - 1)
    return ranked.select("phrase", "rank", (F.col("rank") / 1733.0).alias("adjustment"))


SQL_PIECES = "'[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_]'"
SQL_SLOP = f"""bt as (select item_id, regexp_extract_all(lower(text), '[a-z0-9'']+') as w from benchmark),
bg as (select unnest(w) as phrase from bt union all select unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i+1])) from bt),
br as (select phrase, row_number() over (order by count(*) desc, phrase) - 1 as rank from bg group by phrase),
ph as (select phrase, rank, 1.0 - rank / 1733.0::double as weight, regexp_extract_all(phrase, {SQL_PIECES}) as pieces from br),
dn as (select doc_id, greatest(1, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> ''))) as n, regexp_extract_all(lower(text), {SQL_PIECES}) as p from documents),
pp as (select doc_id, unnest(p) as a, generate_subscripts(p, 1) as i from dn),
tr as (select doc_id, i, a, lead(a, 1) over w as b, lead(a, 2) over w as c from pp window w as (partition by doc_id order by i)),
gr as (select doc_id, i, a as phrase, false as border from tr union all select doc_id, i, a || ' ' || c, a = c from tr where b = ' '),
hit as (select gr.* from gr join ph using (phrase)),
runs as (select doc_id, phrase, border, case when border then i - 2 * row_number() over (partition by doc_id, phrase order by i) end as run from hit),
part as (select doc_id, phrase, case when border then ceil(count(*) / 2) else count(*) end as hits from runs group by doc_id, phrase, border, run),
cnt as (select doc_id, phrase, sum(hits) as hits from part group by 1, 2)"""


@query("T4_slop_index", f"""with {SQL_SLOP}
select d.doc_id, round(coalesce(sum(c.hits * ph.weight), 0) / any_value(d.n) * 1000, 6) as slop_index
from dn d left join (cnt c join ph on ph.phrase = c.phrase and ph.rank < 600) on c.doc_id = d.doc_id group by d.doc_id""")
def _(t: Tables):
    return textstats.slop_index(t.texts, "doc_id", "text", textstats.phrase_weights(phrase_table(t), 0, 600))


@query("T5_slop_bands", f"""with {SQL_SLOP}, bands(band, lo, hi) as (values ('0-300',0,300),('300-700',300,700))
select d.doc_id, b.band, round(coalesce(sum(c.hits * ph.weight), 0) / any_value(d.n) * 1000, 6) as slop_index
from dn d cross join bands b left join (cnt c join ph on ph.phrase = c.phrase) on c.doc_id = d.doc_id and ph.rank >= b.lo and ph.rank < b.hi group by 1, 2""")
def _(t: Tables):
    return textstats.slop_bands(t.texts, "doc_id", "text", phrase_table(t), [(0, 300), (300, 700)])


SQL_GRAMS = """w as (select doc_id, lang, regexp_extract_all(lower(text), '[a-z0-9'']+') as w from documents),
g as (select doc_id, lang, list_sort(list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3]))) as s from w)"""


@query("T6_self_bleu", f"""with {SQL_GRAMS}, e as (select doc_id, len(s) as n, unnest(s) as gram from g),
p as (select a.doc_id as x, b.doc_id as y, count(*) as sh, any_value(a.n) as na, any_value(b.n) as nb from e a join e b on a.gram = b.gram and a.doc_id < b.doc_id group by 1, 2)
select round((select sum(sh / (na + nb - sh)) from p) / ((select count(*) from documents) * ((select count(*) from documents) - 1) / 2), 6) as self_bleu""")
def _(t: Tables):
    return textstats.self_bleu(t.texts, "doc_id", "text")


@query("J11_shared_ngram_pairs", f"""with {SQL_GRAMS}, k as (select min(doc_id) as doc_id, count(*) as c, s from g where len(s) > 0 group by s),
e as (select doc_id, c, len(s) as n, unnest(s) as gram from k)
select a.doc_id as a, b.doc_id as b, count(*) as shared, any_value(a.n) + any_value(b.n) - count(*) as union_size, any_value(a.c) as copies_a, any_value(b.c) as copies_b
from e a join e b on a.gram = b.gram and a.doc_id < b.doc_id group by 1, 2""")
def _(t: Tables):
    return textstats.shared_ngram_pairs(t.texts, "doc_id", "text")


@query("T7_mmd2", """
with v as (select vec_id, label < 5 as x, list_transform(embedding, lambda e: e::double) as e from embeddings),
d as (select a.x as ax, b.x as bx, greatest(0, list_dot_product(a.e, a.e) + list_dot_product(b.e, b.e) - 2 * list_dot_product(a.e, b.e)) as d from v a join v b on a.vec_id < b.vec_id),
m as (select median(d) as med, (select count(*) from v where x) as m, (select count(*) from v where not x) as n from d)
select round(greatest(0, 2 * sum(case when ax and bx then exp(-d / (med + 1e-12)) else 0 end) / (any_value(m) * (any_value(m) - 1)) + 2 * sum(case when not ax and not bx then exp(-d / (med + 1e-12)) else 0 end) / (any_value(n) * (any_value(n) - 1))
  - 2 * sum(case when ax <> bx then exp(-d / (med + 1e-12)) else 0 end) / (any_value(m) * any_value(n))), 6) as mmd2, round(any_value(med) + 1e-12, 6) as bandwidth from d, m""")
def _(t: Tables):
    e = t.embeddings.select("vec_id", "embedding", "label")
    return textstats.mmd2(e.filter("label < 5"), e.filter("label >= 5"), "vec_id", "embedding")


SQL_WORDS = "ws as (select doc_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') as w from documents)"


@query("T8_worst_ngram", f"""with {SQL_WORDS}, b as (select doc_id, list_transform(w, lambda x: lower(regexp_replace(x, '^[.,;:!?"'']+|[.,;:!?"'']+$', '', 'g'))) as w from ws),
g as (select doc_id, unnest(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))) as gram from b),
c as (select doc_id, gram, count(*) as n from g group by 1, 2), m as (select doc_id, max(n) as worst from c group by 1)
select d.doc_id, coalesce(worst, 0)::bigint as worst, coalesce(worst, 0) >= 10 as degenerate from documents d left join m using (doc_id)""")
def _(t: Tables):
    rows = t.texts.select("doc_id", textstats.worst_ngram("text").cast("long").alias("worst"))
    return rows.withColumn("degenerate", F.col("worst") >= 10)


def loop_sql(windows: str) -> str:
    return f"""with {SQL_WORDS}, g as (select doc_id, unnest(list_transform(range(1, {windows}), lambda i: array_to_string(w[i:i+7], ' '))) as gram from ws where len(w) >= 24),
c as (select doc_id, gram, count(*) as n from g group by 1, 2), m as (select doc_id, max(n) as top from c group by 1)
select d.doc_id, top, coalesce(top > 4, false) as looped from documents d left join m using (doc_id)"""


@query("T9_ngram_loop", loop_sql("len(w) - 6"))
def _(t: Tables):
    rows = t.texts.select("doc_id", textstats.ngram_loop("text").cast("long").alias("top"))
    return rows.withColumn("looped", F.coalesce(F.col("top") > 4, F.lit(False)))


@query("T9_ngram_loop_legacy", loop_sql("len(w) - 7"))
def _(t: Tables):
    rows = t.texts.select("doc_id", textstats.ngram_loop("text", legacy=True).cast("long").alias("top"))
    return rows.withColumn("looped", F.coalesce(F.col("top") > 4, F.lit(False)))


@query("T10_char_run", """
with c as (select doc_id, i, substr(text, i, 1) as ch from (select doc_id, text, unnest(range(1, length(text) + 1)) as i from documents)),
b as (select doc_id, i, ch, i - row_number() over (partition by doc_id, ch order by i) as grp from c where ch <> chr(10)),
r as (select doc_id, ch, grp, count(*) as n from b group by 1, 2, 3)
select doc_id, max(n) as run, max(n) > 12 as spam from r group by doc_id""")
def _(t: Tables):
    rows = t.texts.select("doc_id", textstats.char_run("text").cast("long").alias("run"))
    return rows.withColumn("spam", F.col("run") > 12)


@query("T11_compression_ratio")
def _(t: Tables):
    rows = t.texts.select("doc_id", F.round(textstats.compression_ratio("text"), 3).alias("ratio"))
    return rows.withColumn("repetitive", F.col("ratio") < 0.18)


@query("T12_weird_char_frac", """
with s as (select doc_id, case when doc_id % 6 = 0 then text || chr(7) || chr(65533) || chr(1) else text end as tx from documents)
select doc_id, round(len(regexp_extract_all(tx, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x{FFFD}]')) / length(tx), 6) as frac, len(regexp_extract_all(tx, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x{FFFD}]')) / length(tx) > 0.005 as weird from s""")
def _(t: Tables):
    tx = F.when(F.col("doc_id") % 6 == 0, F.concat("text", F.lit("\x07�\x01"))).otherwise(F.col("text"))
    rows = t.documents.select("doc_id", textstats.weird_char_frac(tx).alias("raw"))
    return rows.select("doc_id", F.round("raw", 6).alias("frac"), (F.col("raw") > 0.005).alias("weird"))


@query("T13_degenerate_flags")
def _(t: Tables):
    rows = textstats.degenerate_flags(t.texts.select("doc_id", "text"), "text")
    return rows.select("doc_id", F.array_join("flags", ";").alias("flags"))


def text_versions(t: Tables):
    """A document against the same text with one line dropped, repeated or added."""
    i, lines = F.col("doc_id") % 4, F.split("text", "\n")
    other = (
        F.when(i == 0, F.array_join(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), "\n"))
        .when(i == 1, F.concat("text", F.lit("\n"), "text")).when(i == 2, F.concat("text", F.lit("\n  extra  \n"))).otherwise(F.lit(""))
    )
    return t.texts.select("doc_id", F.col("text").alias("real"), other.alias("sim"))


SQL_VERSIONS = """v as (select doc_id, text as real, case doc_id % 4 when 0 then array_to_string(string_split(text, chr(10))[2:], chr(10)) when 1 then text || chr(10) || text
  when 2 then text || chr(10) || '  extra  ' || chr(10) else '' end as sim from documents),
l as (select doc_id, list_distinct(list_filter(list_transform(string_split(real, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')) as a,
  list_distinct(list_filter(list_transform(string_split(sim, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')) as b from v)"""


@query("T14_line_jaccard", f"""with {SQL_VERSIONS} select doc_id, round(case when len(a) + len(b) = 0 then 1.0::double
  else len(list_intersect(a, b))::double / (len(a) + len(b) - len(list_intersect(a, b))) end, 6) as jaccard from l""")
def _(t: Tables):
    return text_versions(t).select("doc_id", F.round(textstats.line_jaccard("real", "sim"), 6).alias("jaccard"))


@query("T15_sequence_ratio")
def _(t: Tables):
    """Whole conversation turns against the same turn with its first line dropped."""
    turn = t.conversations.select("conv_id", "turn", "text", F.regexp_replace("text", r"^[^\n]*\n?", "").alias("sim"))
    return turn.select("conv_id", "turn", F.round(textstats.rstripped_ratio("text", "sim"), 3).alias("ratio"))


@query("T16_needle_recall", """
with r as (select (n_chars // 500)::bigint as length, (doc_id % 5)::bigint as depth, contains(text, substr(lang, 1, 1) || 'e') as hit from documents)
select length, depth, count(*) as n, round(avg(case when hit then 1.0::double else 0.0::double end), 6) as recall from r group by 1, 2""")
def _(t: Tables):
    rows = t.documents.select(
        "text", F.concat(F.substring("lang", 1, 1), F.lit("e")).alias("needle"), (F.col("n_chars") / 500).cast("long").alias("length"), (F.col("doc_id") % 5).alias("depth"))
    return textstats.needle_recall(rows, "text", "needle")
