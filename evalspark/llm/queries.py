"""The registered queries of this subpackage: thin calls of the operators, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, bytenet, chat, html, jaccard, mixing, neighbours, phrases, quality, repair, toxicity, urls, warc
from .common import stored, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle.strip()
        return fn

    return wrap


@query("op1_arc_to_warc", oracle="""
with p as (select page_id, coalesce(html, '') as h from pages),
d as (select page_id, strlen(h) as payload_bytes, sha1(h) as payload_digest from p),
k as (select *, max(page_id) over (partition by payload_digest, payload_bytes) as kept from d)
select page_id, payload_bytes, payload_digest, case when payload_bytes >= 1000 and page_id <> kept then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 1000 and page_id <> kept then kept end as refers_to from k""")
def op1_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page through ARC files of both versions into WARC files, and what these hold when read back."""
    records = warc.archive_pages(spark, table(spark, sf_dir, "pages"))
    return records.select(F.col("order_key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op5_tree_bpe")
def op5_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded again, as counts and digests."""
    tokens = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"))
    texts = bpe.decode(tokens.select("doc_id", "n_tokens", "ids"))
    return texts.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


RULES = [
    ("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


@query("op7_host_reputation", oracle=r"""
with parts as (
  select page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') as path,
    try_cast(nullif(regexp_extract(url, '(?s)^.*?://[^/?#]*/[^/?#]+/([0-9]{1,18})', 1), '') as bigint) as doc_id
  from pages),
folded as (select doc_id, max(greatest(coalesce(toxic, 0), 1 - coalesce(quality, 1))) as bad from labels where doc_id is not null group by 1),
hosts as (
  select host, count(bad) as n, coalesce(sum(bad), 0) as bad, array_to_string(string_split(host, '.')[-2:], '.') as domain, string_split(host, '.')[-1] as suffix
  from parts left join folded using (doc_id) group by host),
domains as (select suffix, domain, sum(n) as n, sum(bad) as bad from hosts group by 1, 2),
suffixes as (select suffix, sum(n) as n, sum(bad) as bad from domains group by 1),
s1 as (select *, least(greatest(coalesce((select sum(bad) / nullif(sum(n), 0) from suffixes), 0.5), 1e-6), 1 - 1e-6) as p from suffixes),
s2 as (select least(greatest(coalesce(sum((bad - n * p) * (bad - n * p) / (p * (1 - p)) - n) / nullif(sum(n * (n - 1)), 0), 0.9), 1e-4), 0.9) as rho from s1),
s3 as (select suffix, ((1 / rho - 1) * p + bad) / ((1 / rho - 1) + n) as prior from s1, s2),
d1 as (select domain, n, bad, least(greatest(prior, 1e-6), 1 - 1e-6) as p from domains join s3 using (suffix)),
d2 as (select least(greatest(coalesce(sum((bad - n * p) * (bad - n * p) / (p * (1 - p)) - n) / nullif(sum(n * (n - 1)), 0), 0.9), 1e-4), 0.9) as rho from d1),
d3 as (select domain, ((1 / rho - 1) * p + bad) / ((1 / rho - 1) + n) as prior from d1, d2),
h1 as (select host, n, bad, least(greatest(prior, 1e-6), 1 - 1e-6) as p from hosts join d3 using (domain)),
h2 as (select least(greatest(coalesce(sum((bad - n * p) * (bad - n * p) / (p * (1 - p)) - n) / nullif(sum(n * (n - 1)), 0), 0.9), 1e-4), 0.9) as rho from h1),
h3 as (select host, (1 / rho - 1) * p + bad as a, (1 / rho - 1) * (1 - p) + n - bad as b from h1, h2),
h4 as (select host, a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) as low from h3),
rules(kind, rule, rhost, rpath) as (values ('allow', 'com/', 'com', '/'), ('block', 'example.com/en/', 'example.com', '/en/'),
  ('allow', 'www.example.com/en/', 'www.example.com', '/en/'), ('block', 'net/es/', 'net', '/es/'), ('block', 'net/fr/', 'net', '/fr/')),
judged as (
  select page_id, host, path, low, (select max_by(struct_pack(rule := rule, kind := kind), length(rule)) from rules
    where (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath)) as r
  from parts join h4 using (host))
select page_id, host, path, r.rule as rule, coalesce(r.kind, case when low > 0.3 then 'block' else 'allow' end) as verdict from judged""")
def op7_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url, judged by rule or by the shrunk bad-page rate of its host."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    reputation = urls.host_reputation(urls.page_outcomes(pages, table(spark, sf_dir, "labels")))
    return urls.judge_urls(pages, reputation, RULES)


@query("op10_ngram_llr")
def op10_ngram_llr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and hashed n-gram log-likelihood ratio of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.judge(docs, table(spark, sf_dir, "labels")).drop("text")


def held_out(doc_id) -> F.Column:
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0


@query("op2_toxic_segments")
def op2_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; labels of the held-out fifth are never read."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    known = table(spark, sf_dir, "labels").where(~held_out("doc_id"))
    model = toxicity.fit(stored(toxicity.labelled(docs, known), "toxic-labels"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", "predicted", F.size("passages").alias("n_passages"))


@query("op6_host_paths", oracle=r"""
with a as (select page_id, url, regexp_replace(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '\s+', ' ', 'g') as body from pages),
b as (select page_id, url, string_split(regexp_replace(regexp_replace(body, '<br>', ' ', 'g'), '</?(h1|p)>', chr(10), 'g'), chr(10)) as blocks from a),
c as (select page_id, url, list_transform(blocks, lambda x: trim(regexp_replace(replace(replace(replace(replace(replace(
    regexp_replace(x, '<[^>]*>', '', 'g'), '&quot;', '"'), '&#x27;', chr(39)), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\s+', ' ', 'g'))) as blocks from b),
d as (select page_id, url, array_to_string(list_filter(blocks, lambda x: x <> ''), chr(10)) as text from c)
select page_id, url, text, length(text) as n_chars from d""")
def op6_host_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page by its host's winning container path."""
    return html.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).drop("html")


@query("op8_signature_join")
def op8_signature_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document: 4-word shingles, Jaccard similarity of 0.85 or more."""
    return jaccard.similarity_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op4_snapshot_collapse", oracle=r"""
with t as (select distinct conv_id, turn, lower(coalesce(role, 'unknown')) as role, coalesce(text, '') as text from conversations where conv_id is not null),
l as (select conv_id, list(struct_pack(r := role, t := text) order by turn nulls first, role, sha256(text)) as turns from t group by 1),
f as (select turns, min(conv_id) as conv_id, count(*) as copies from l group by 1),
p as (select distinct turns[1:k] as turns from (select turns, unnest(range(1, len(turns))) as k from f)),
m as (select * from f where turns not in (select turns from p))
select conv_id, len(turns) as n_turns, copies, sha256(array_to_string(list_transform(turns, lambda x: '<|im_start|>' || x.r || chr(10)
  || replace(replace(x.t, '<|im_start|>', '<im_start>'), '<|im_end|>', '<im_end>') || '<|im_end|>' || chr(10)), '')) as text_sha256 from m""")
def op4_snapshot_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal conversations, rendered; the text as a digest."""
    out = chat.collapse(table(spark, sf_dir, "conversations"))
    return out.select("conv_id", "n_turns", "copies", F.sha2("text", 256).alias("text_sha256"))


TARGETS = {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}


@query("op9_soft_mixing")
def op9_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate of every document for equal parts of three languages and a double part of the fourth."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    rows = stored(mixing.labelled(docs, table(spark, sf_dir, "labels"), "lang"), "mix-labels")
    return mixing.mix_to_targets(docs.select("doc_id", "text"), rows, TARGETS)[0].drop("text", "posteriors")


@query("op3_projected_neighbours")
def op3_projected_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows by inner product of every twentieth embedding, among all embeddings."""
    return neighbours.nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), lambda i: i % 20 == 0)


@query("op13_phrase_collocations", oracle=r"""
with d as (select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
p as (select lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) as piece from d),
w as (select lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') as ws from p),
f as (
  select lang, k, array_to_string(ws[i:i + k - 1], ' ') as phrase, count(*) as f
  from (select lang, ws, k, unnest(range(1, len(ws) - k + 2)) as i from w, (select unnest([1, 2, 3]) as k)) group by 1, 2, 3),
n as (select lang, sum(len(ws))::bigint as n from w group by 1),
o as (select lang, k, phrase, f, string_split(phrase, ' ') as ws from f where f >= 10),
cover as (
  select lang, phrase, max(f) as best from (
    select lang, array_to_string(ws[1:2], ' ') as phrase, f from o where k = 3 union all select lang, array_to_string(ws[2:3], ' '), f from o where k = 3) group by 1, 2),
c as (select o.* from o left join cover using (lang, phrase) where k >= 2 and (k = 3 or best is null or 100 * best < 50 * f)),
cuts as (select lang, phrase, f as a, j, array_to_string(ws[1:j], ' ') as p1, array_to_string(ws[j + 1:], ' ') as p2 from (select *, unnest(range(1, k)) as j from c)),
s as (
  select c.lang, c.phrase, a, j, x.f as l, y.f as r, ((1000000::hugeint * a * a) // (x.f::hugeint * y.f))::bigint as score
  from cuts c join o x on x.lang = c.lang and x.phrase = c.p1 join o y on y.lang = c.lang and y.phrase = c.p2),
m as (select * from s qualify row_number() over (partition by lang, phrase order by score, j) = 1)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score from m join n using (lang)
qualify rank <= 2000""")
def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 collocations of 2 to 3 words of every language."""
    found = phrases.mine(table(spark, sf_dir, "documents").select("lang", "text"))
    return found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


@query("op12_conversation_repair", oracle=r"""
with recursive crc(t) as (
  select list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, b: case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by i) from range(256) r(i)),
k as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as key from conversations),
h as (
  select *, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(key, ''), lambda x: ascii(x)::bigint)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 as fault from k, crc),
g as (
  select conv_id, turn, case when fault = 4 then 'user' else role end as role,
    case when fault = 1 then '' when fault = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
  from h, (select unnest([0, 1]) as copy) where fault <> 0 and (copy = 0 or fault = 3)),
e as (select *, row_number() over (partition by conv_id, role, text order by turn nulls first) as nth from g),
o as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text, nth) as i, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as body,
    lag(role) over (partition by conv_id order by turn nulls first, role, text, nth) as before from e),
f as (select *, case when body = '' then 'b' when nth > 1 then 'd' when right(body, 1) not in ('.', '!', '?') then 't' else '-' end as mark, left(role, 1) as g from o),
stats as (
  select conv_id, count(*) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (mark = 'b') as blank,
    count(*) filter (mark = 'd') as duplicate, count(*) filter (mark = 't') as truncated,
    count(*) filter (before is not null and left(before, 1) || g not in ('su', 'ua', 'au')) as illegal from f group by 1),
dp as (
  select conv_id, 0::bigint as i, {'c': 0, 'a': '', 'r': ''} as z, {'c': 1000000, 'a': '', 'r': ''} as s,
    {'c': 2, 'a': 'I', 'r': chr(10) || 'user:'} as u, {'c': 4, 'a': 'II', 'r': chr(10) || 'user:' || chr(10) || 'assistant:'} as a
  from (select distinct conv_id from f)
  union all
  select conv_id, i, z, s, u, least(a, {'c': u.c + 2, 'a': u.a || 'I', 'r': u.r || chr(10) || 'assistant:'}) from (
    select conv_id, i, z, s, a, least(u, {'c': z.c + 2, 'a': z.a || 'I', 'r': z.r || chr(10) || 'user:'}, {'c': s.c + 2, 'a': s.a || 'I', 'r': s.r || chr(10) || 'user:'},
      {'c': a.c + 2, 'a': a.a || 'I', 'r': a.r || chr(10) || 'user:'}) as u
    from (
      select dp.conv_id, f.i, {'c': z.c + 3, 'a': z.a || 'D', 'r': z.r} as z,
        least({'c': s.c + 3, 'a': s.a || 'D', 'r': s.r}, {'c': z.c + tr + case when g = 's' then 0 else 1000000 end, 'a': z.a || 'K', 'r': z.r || chr(10) || role || ':' || text}) as s,
        least({'c': u.c + 3, 'a': u.a || 'D', 'r': u.r},
          {'c': z.c + tr + case when g = 'u' then 0 else 1000000 end, 'a': z.a || 'K', 'r': z.r || chr(10) || role || ':' || text},
          {'c': s.c + tr + case when g = 'u' then 0 else 1000000 end, 'a': s.a || 'K', 'r': s.r || chr(10) || role || ':' || text},
          {'c': a.c + tr + case when g = 'u' then 0 else 1000000 end, 'a': a.a || 'K', 'r': a.r || chr(10) || role || ':' || text},
          {'c': z.c + tr + 2, 'a': z.a || 'R', 'r': z.r || chr(10) || 'user:' || text}, {'c': s.c + tr + 2, 'a': s.a || 'R', 'r': s.r || chr(10) || 'user:' || text},
          {'c': a.c + tr + 2, 'a': a.a || 'R', 'r': a.r || chr(10) || 'user:' || text}) as u,
        least({'c': a.c + 3, 'a': a.a || 'D', 'r': a.r},
          {'c': u.c + tr + case when g = 'a' then 0 else 1000000 end, 'a': u.a || 'K', 'r': u.r || chr(10) || role || ':' || text},
          {'c': u.c + tr + 2, 'a': u.a || 'R', 'r': u.r || chr(10) || 'assistant:' || text}) as a
      from dp join (select *, case mark when 't' then 1 when '-' then 0 else 1000000 end as tr from f) f on f.conv_id is not distinct from dp.conv_id and f.i = dp.i + 1))),
best as (select dp.conv_id, least(z, a) as b from dp join stats on dp.conv_id is not distinct from stats.conv_id and dp.i = stats.n)
select ids.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
  coalesce(illegal, 0) as illegal, coalesce(b.c, 0)::bigint as cost, coalesce(b.a, '') as audit, sha256(coalesce(b.r[2:], '')) as repaired_sha256
from (select distinct conv_id from conversations) ids left join stats on ids.conv_id is not distinct from stats.conv_id
left join best on ids.conv_id is not distinct from best.conv_id""")
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of every damaged conversation, its cheapest repair and the digest of the repaired turns."""
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return repair.audit(repair.damaged(conversations), conversations).drop("n_rows")


@query("op11_byte_network")
def op11_byte_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; labels of the held-out quarter are never read."""
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    network = bytenet.fit(docs, table(spark, sf_dir, "labels").where(~held))
    return bytenet.score(docs, network).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", "predicted")
