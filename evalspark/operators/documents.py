"""Text rows -> cleaned prompts, sections, docstrings, code blocks and JSON values."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import arrow_udf
from ..functions.text import col, let, strip, word_count

# Bracket tags of writing prompts, split-off clitics, and the expressions of the two functions below.
PROMPT_TAGS = "WP|EU|CW|TT|IP|RF|PI|PM|MP|OT|SP|CC"
CLITICS = ("'ve", "'s", "'re", "'ll", "'d", "'m", "n't")
# Marks of a predicted observation.
RESPONSE_TAG = "predicted_observation"
RESPONSE_MARKER = "**Environment Observation:**"


def clean_tags(text) -> Column:
    c = F.regexp_replace(col(text), rf"(?i)\[\s*({PROMPT_TAGS})\s*\]", "")
    c = F.replace(F.replace(c, F.lit("<newline>"), F.lit("\n")), F.lit(" 's"), F.lit("'s"))
    return strip(F.regexp_replace(c, r"\s+\n", "\n"))


def join_split_tokens(text) -> Column:
    """Undo spaces in front of punctuation and clitics, and paired quote marks."""
    c = F.replace(F.replace(col(text), F.lit("``"), F.lit('"')), F.lit("''"), F.lit('"'))
    c = F.regexp_replace(c, r"\s+([,.!?;:’'])", "$1")
    for clitic in CLITICS:
        c = F.replace(c, F.lit(" " + clitic), F.lit(clitic))
    return strip(F.regexp_replace(c, r"[ \t]+", " "))


def clean_prompt_text(df: DataFrame, prompt: str, story: str, lo: int = 150, hi: int = 700) -> DataFrame:
    """Cleaned prompt and story; the story within a word band, the prompt longer than 15 characters."""
    cleaned = df.withColumn(prompt, clean_tags(prompt)).withColumn(story, clean_tags(story))
    kept = cleaned.filter((F.length(prompt) > 15) & word_count(story).between(lo, hi))
    return kept.withColumn(prompt, join_split_tokens(prompt))


# --- JSON in text ------------------------------------------------------------------------------

def bracket_pairs(text: str, kind: str):
    """(start, end, outermost) of every closed pair of one kind of brackets, in the order in which they close."""
    waiting: list[int] = []
    for mark in re.finditer(f"[{re.escape(kind)}]", text):
        if mark.group() == kind[0]:
            waiting.append(mark.start())
        elif waiting:
            yield waiting.pop(), mark.end(), not waiting


def _leftmost_pair(text: str) -> str | None:
    """The closed pair that opens first: braces before square brackets."""
    for kind in ("{}", "[]"):
        pair = min(bracket_pairs(text, kind), default=None)
        if pair:
            return text[pair[0] : pair[1]]
    return None


def _pick(text: str | None) -> tuple[str | None, str | None]:
    text = text or ""
    found = [b.strip() for b in re.findall(r"(?is)```(?:json)?\s*\n(.*?)```", text)]
    if not found:
        span = _leftmost_pair(text)
        found = [span] if span else []
    error = "no JSON found in output"
    for piece in found:
        try:
            return json.dumps(json.loads(piece), ensure_ascii=False, separators=(",", ":")), None
        except ValueError as e:
            error = str(e)
    return None, error


@arrow_udf("struct<json:string,error:string>")
def pick_json(text: pd.Series) -> pd.DataFrame:
    """First fenced JSON block, else the first balanced object, else the first balanced array."""
    return pd.DataFrame([_pick(t) for t in text], columns=["json", "error"], dtype=object)


FENCE = re.compile(r"\A```[a-zA-Z]*\n?(.*?)(?:```)?\Z", re.S)


def _envelope(text: str | None) -> str | None:
    body = (text or "").strip()
    fenced = FENCE.match(body)
    body = fenced.group(1).strip() if fenced else body
    ends = [(a, b) for a, b, outermost in bracket_pairs(body, "{}") if outermost]
    for a, b in [*reversed(ends), (0, len(body))]:  # the last one that fits wins; the whole body comes first in order
        try:
            found = json.loads(body[a:b], strict=False)
        except ValueError:
            continue
        if isinstance(found, dict) and "stdout" in found:
            return json.dumps(found, ensure_ascii=False)
    return None


@arrow_udf("string")
def last_envelope(body: pd.Series) -> pd.Series:
    """The last JSON object with a stdout key; raw line breaks inside strings are accepted."""
    return body.map(_envelope).astype(object)


def open_json(text) -> Column:
    """VARIANT of a possibly fenced or padded JSON text: fence, whole text, then the outermost span."""
    def opened(t: Column) -> Column:
        fence = F.nullif(F.regexp_extract(t, r"(?s)```(?:json)?\s*(.*?)\s*```", 1), F.lit(""))
        return let(F.coalesce(fence, t), lambda x: F.coalesce(
            F.try_parse_json(x), F.try_parse_json(F.regexp_extract(x, r"(?s)[\[{].*[\]}]", 0))))

    return let(strip(F.coalesce(col(text), F.lit(""))), opened)


def json_path(value: Column, path: str) -> Column:
    """VARIANT at a dotted or bracketed path; negative list indices count from the end."""
    for token in re.findall(r"[^.\[\]]+", path or ""):
        token = token.strip().strip("'\"")
        if re.fullmatch(r"-?\d+", token):
            at = int(token)
            value = let(value, _at_index(at))
        else:
            value = F.try_variant_get(value, "$['" + token.replace("'", "\\'") + "']", "variant")
    return value


def _at_index(at: int):
    """Item of a list, or the key of that name in an object."""
    def found(v: Column) -> Column:
        listed = F.try_variant_get(v, "$", "array<variant>")
        return F.coalesce(F.try_element_at(listed, F.lit(at + 1 if at >= 0 else at)), F.try_variant_get(v, f"$['{at}']", "variant"))

    return found


def json_path_get(df: DataFrame, text: str, path: str, default: str = "") -> DataFrame:
    """Columns value_text, value_int, value_float, ok for one path over a JSON text column."""

    def described(at: Column) -> Column:
        kind, ok = F.schema_of_variant(at), at.isNotNull()
        as_text = F.when(kind == "STRING", F.try_variant_get(at, "$", "string")).otherwise(F.to_json(at))
        shown = F.when(ok, as_text).otherwise(F.lit(default))
        number = F.when(kind == "BOOLEAN", F.try_variant_get(at, "$", "boolean").cast("double")).when(
            kind.isNull() | (kind == "STRING"), _first_number(shown)).otherwise(F.coalesce(F.try_variant_get(at, "$", "double"), F.lit(0.0)))
        return F.struct(ok.alias("ok"), shown.alias("text"), number.alias("number"))

    found = let(json_path(open_json(text), path), described)
    out = df.withColumn("_f", found)
    number = F.col("_f.number")
    return (
        out.withColumn("ok", F.col("_f.ok")).withColumn("value_text", F.col("_f.text")).withColumn("value_float", number)
        .withColumn("value_int", F.when(F.col("_f.ok"), F.rint(number)).otherwise(number).cast("long")).drop("_f"))


NOTHING = object()


def _item(value, step: str):
    """One step of a path: a list takes whole numbers, an object its keys."""
    if isinstance(value, list) and re.fullmatch(r"-?\d+", step) and -len(value) <= int(step) < len(value):
        return value[int(step)]
    return value.get(step, NOTHING) if isinstance(value, dict) else NOTHING


@arrow_udf("struct<ok:boolean,text:string>")
def _at_row_path(body: pd.Series, path: pd.Series) -> pd.DataFrame:
    def one(text, steps):
        found = json.loads(text) if text is not None else NOTHING
        for step in re.findall(r"[^.\[\]]+", steps or ""):
            found = _item(found, step.strip().strip("'\""))
        if found is NOTHING:
            return False, None
        return True, found if isinstance(found, str) else json.dumps(found, ensure_ascii=False)

    return pd.DataFrame([one(t, p) for t, p in zip(body, path)], columns=["ok", "text"])


def json_path_rows(df: DataFrame, text: str, path: str, default: str = "") -> DataFrame:
    """Columns ok and value_text for a path of its own in every row."""
    found = df.withColumn("_f", _at_row_path(F.to_json(open_json(text)), F.col(path)))
    return found.withColumn("ok", F.col("_f.ok")).withColumn("value_text", F.coalesce("_f.text", F.lit(default))).drop("_f")


def _first_number(text) -> Column:
    return F.coalesce(F.regexp_extract(col(text), r"-?\d+(?:\.\d+)?", 0).try_cast("double"), F.lit(0.0))


def json_path_count(text, path: str) -> Column:
    """Items of the list, keys of the object or characters of the string at the path; otherwise 0."""
    def counted(at: Column) -> Column:
        kind = F.schema_of_variant(at)
        return F.coalesce(
            F.when(kind == "STRING", F.length(F.try_variant_get(at, "$", "string")))
            .when(F.startswith(kind, F.lit("ARRAY")), F.json_array_length(F.to_json(at)))
            .when(F.startswith(kind, F.lit("OBJECT")), F.array_size(F.json_object_keys(F.to_json(at)))),
            F.lit(0),
        )

    return let(json_path(open_json(text), path), counted)


# --- code, reasoning, sections -----------------------------------------------------------------

def pick_code(text, entry: str | None = None) -> Column:
    """Last fenced block that defines entry, else the longest block, else the whole text."""
    raw = F.coalesce(col(text), F.lit(""))
    blocks = F.transform(
        F.regexp_extract_all(raw, F.lit(r"(?is)```(?:python|py)?\s*\n(.*?)```"), 1), lambda b: strip(b)
    )
    by_length = F.transform(blocks, lambda b, i: F.struct(F.length(b).alias("n"), (-i).alias("p"), b.alias("b")))
    longest = F.array_max(by_length)["b"]
    if entry:
        named = F.filter(blocks, lambda b: b.rlike(rf"\b(def|class)\s+{re.escape(entry)}\b"))
        longest = F.coalesce(F.try_element_at(named, F.lit(-1)), longest)
    return F.coalesce(longest, strip(raw))


def strip_reasoning(text) -> Column:
    """Answer body: thinking removed, last response tag opened, marker dropped.

    An unclosed thinking block ends at the response tag, or at the end without one.
    """
    c = F.regexp_replace(F.coalesce(col(text), F.lit("")), r"(?is)<think>.*?</think>", "")
    c = F.regexp_replace(c, rf"(?is)<think>.*?(?=<{RESPONSE_TAG}>)|<think>(?!.*<{RESPONSE_TAG}>).*", "")
    after = F.element_at(F.split(c, rf"(?i)<{RESPONSE_TAG}>"), -1)
    has_tag = c.rlike(rf"(?i)<{RESPONSE_TAG}>")
    body = strip(F.when(has_tag, F.element_at(F.split(after, rf"(?i)</{RESPONSE_TAG}>"), 1)).otherwise(c))
    return strip(F.replace(body, F.lit(RESPONSE_MARKER), F.lit("")))


def split_sections(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 100) -> DataFrame:
    """One row per markdown section (heading levels 1-3) with a body longer than ``least``.

    Headings may repeat inside a document, so the id carries the ordinal of the section.
    """
    heading = r"\n(#{1,3}\s+[^\n]+)\n"
    doc = col(doc_id).cast("string")
    parts = docs.select(
        doc.alias("_doc"), col(doc_id),
        F.regexp_extract_all(text, F.lit(heading), 1).alias("_heads"),
        F.split(text, heading, -1).alias("_bodies"),
    )
    heads = F.concat(F.array("_doc"), F.transform("_heads", lambda h: strip(F.regexp_replace(strip(h), r"^#+", ""))))
    rows = parts.withColumn("_has", F.size("_heads") > 0).select(
        doc_id, "_doc", "_has", F.posexplode(F.arrays_zip(heads.alias("h"), F.col("_bodies").alias("b"))).alias("ordinal", "s")
    ).select(doc_id, "_doc", "_has", "ordinal", F.col("s.h").alias("heading"), strip(F.col("s.b")).alias("_body"))
    kept = rows.filter(F.length("_body") > least)
    return kept.select(
        doc_id,
        "ordinal",
        F.when(F.col("_has"), F.concat_ws("::", "_doc", "heading", F.col("ordinal").cast("string"))).otherwise(F.col("_doc")).alias("section_id"),
        F.when(F.col("_has"), F.concat_ws("\n\n", "heading", "_body")).otherwise(F.col("_body")).alias("content"),
    )


def html_to_markdown(html) -> Column:
    """Headings of levels 1 to 3 as marked lines, blocks as lines, everything else as plain text."""
    c = F.regexp_replace(col(html), r"(?is)<script.*?</script>|<style.*?</style>|<nav.*?</nav>|<footer.*?</footer>|<head>.*?</head>|<!--.*?-->", "")
    for level in (1, 2, 3):
        c = F.regexp_replace(c, rf"(?i)<h{level}(\s[^>]*)?>", "\n" + "#" * level + " ")
    c = F.regexp_replace(c, r"(?i)</(h[1-3]|p|div|li|tr)>|<br[^>]*>|<p>", "\n")
    c = F.regexp_replace(c, r"<[^>]*>", "")
    for name, mark in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(mark))
    return F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r"\n\s*\n", "\n")


def html_sections(pages: DataFrame, doc_id: str = "page_id", html: str = "html", least: int = 100) -> DataFrame:
    """The sections of web pages; see split_sections."""
    return split_sections(pages.select(doc_id, html_to_markdown(html).alias("_md")), doc_id, "_md", least)


def extract_docstrings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 50) -> DataFrame:
    """Module docstring, documented definitions, else the whole commented file."""
    named = r'(?s)(?:class|def)\s+(\w+).*?:\s*\n\s*"""(.*?)"""'
    doc = col(doc_id).cast("string")
    module = F.regexp_extract(text, r'(?s)^"""(.*?)"""', 1)
    has_module = col(text).rlike(r'(?s)^""".*?"""')
    names = F.regexp_extract_all(text, F.lit(named), 1)
    bodies = F.transform(F.regexp_extract_all(text, F.lit(named), 2), lambda b: strip(b))
    pairs = F.filter(F.arrays_zip(names.alias("n"), bodies.alias("b")), lambda p: F.length(p["b"]) > least)
    entry = "struct<id:string,content:string>"
    first = F.when(has_module, F.array(F.struct(F.concat(doc, F.lit("::module-doc")).alias("id"), strip(module).alias("content"))))
    rest = F.transform(pairs, lambda p: F.struct(
        F.concat_ws("::", doc, p["n"]).alias("id"), F.concat_ws("\n\n", p["n"], p["b"]).alias("content")))
    none = F.array().cast(f"array<{entry}>")
    comments = F.size(F.filter(F.split(text, "\n"), lambda x: F.startswith(strip(x), F.lit("#"))))
    whole = F.when((comments > 3) & (F.length(text) > 200), F.array(F.struct(doc.alias("id"), col(text).alias("content"))))
    found = docs.select(doc_id, F.concat(F.coalesce(first, none), rest).alias("_found"), F.coalesce(whole, none).alias("_whole"))
    return found.select(
        doc_id, F.posexplode(F.when(F.size("_found") > 0, F.col("_found")).otherwise(F.col("_whole"))).alias("ordinal", "e")
    ).select(doc_id, "ordinal", F.col("e.id").alias("entry_id"), F.col("e.content").alias("content"))


CASES = "array<struct<input:string,output:string,testtype:string>>"


@arrow_udf("string")
def unpack_payload(raw: pd.Series) -> pd.Series:
    """Plain JSON, or base64 of zlib of JSON. Pickled payloads are refused and give NULL."""
    import base64
    import binascii
    import zlib

    def one(text):
        if text is None:
            return None
        try:
            json.loads(text)
            return text
        except ValueError:
            pass
        try:
            inner = zlib.decompress(base64.b64decode(text, validate=True)).decode("utf-8")
            value = json.loads(inner)
        except (ValueError, binascii.Error, zlib.error):
            return None
        return value if isinstance(value, str) else inner

    return raw.map(one).astype(object)


def decode_test_cases(df: DataFrame, public: str, private: str) -> DataFrame:
    """tests = public cases, then private cases that do not repeat a public one."""
    opened = df.withColumn("_pub", F.from_json(unpack_payload(public), CASES)).withColumn(
        "_priv", F.from_json(unpack_payload(private), CASES)
    )
    none = F.array().cast(CASES)
    pub, priv = F.coalesce("_pub", none), F.coalesce("_priv", none)
    fresh = F.filter(
        priv, lambda t: ~F.exists(pub, lambda p: p["input"].eqNullSafe(t["input"]) & p["output"].eqNullSafe(t["output"]))
    )
    return opened.withColumn("tests", F.concat(pub, fresh)).drop("_pub", "_priv")
