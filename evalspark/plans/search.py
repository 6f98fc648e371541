"""Retrieval over document chunks with benchmark questions and derived vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import words
from ..functions.vectors import cosine
from ..operators import keyword_index, retrieval, sequences, tables
from ..operators.ranking import with_scalars
from ..session import work_dir
from .registry import Tables, query

K = 10


def once(t: Tables, name: str, build):
    """A table that a query uses several times: written to the shared folder at its first use and read from there."""
    if name not in t.__dict__:
        df, path = build(), work_dir(t.spark, name)
        df.write.parquet(path)
        t.__dict__[name] = t.spark.read.schema(df.schema).parquet(path)
    return t.__dict__[name]


def chunks(t: Tables):
    return once(t, "_chunks", lambda: retrieval.chunk_sentences(t.texts.select("doc_id", "text")))


def with_vector(df, t: Tables, position):
    """Give every row the embedding at ``position`` modulo the number of embeddings."""
    size = t.embeddings.agg(F.count(F.lit(1)).alias("_n"))
    keyed = with_scalars(df, size).withColumn("vec_id", position % F.col("_n")).drop("_n")
    return keyed.join(t.embeddings.select("vec_id", F.col("embedding").alias("vector")), "vec_id").drop("vec_id")


def vectors(t: Tables):
    """Chunk vectors."""
    rows = lambda: with_vector(chunks(t).select("chunk_id", "doc_id", "idx"), t, F.col("doc_id") * 7 + F.col("idx")).select("chunk_id", "vector")
    return once(t, "_vectors", rows)


def asked(t: Tables):
    """Questions for keyword search alone."""
    return t.benchmark.select(F.col("item_id").alias("query_id"), F.array_join(words("text"), " ").alias("query"))


def questions(t: Tables):
    return with_vector(asked(t), t, F.col("query_id") * 3)


SQL_CHUNKS = """folded as (select doc_id, list_reduce(list_prepend(['0', null], list_transform(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: [s])),
    lambda acc, x: case when acc[2] is not null and acc[1]::int + length(x[1]) > 512 then list_concat([length(x[1])::varchar, x[1]], acc[2:])
      when acc[2] is null then [length(x[1])::varchar, x[1]] else list_concat([(acc[1]::int + length(x[1]))::varchar, acc[2] || ' ' || x[1]], acc[3:]) end) as f from documents),
chunks as (select doc_id || '::chunk_' || (len(f) - 1 - i) as chunk_id, doc_id, (len(f) - 1 - i)::bigint as idx, f[i + 1] as content from folded, unnest(range(1, len(f))) as u(i))"""
SQL_Q = """q as (select item_id as query_id, array_to_string(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> ''), ' ') as query, item_id * 3 % (select count(*) from embeddings) as vec_id from benchmark)"""
SQL_BASE = f"""with {SQL_CHUNKS}, {SQL_Q},
terms as (select query_id, unnest(list_distinct(string_split(lower(query), ' '))) as term from q),
cw as (select chunk_id, list_filter(string_split_regex(lower(content), '\\s+'), lambda x: x <> '') as w from chunks),
ct as (select chunk_id, len(w) as n, unnest(list_distinct(w)) as term from cw),
ks as (select query_id, chunk_id, count(*) / (any_value(n) + 50) as score from ct join terms using (term) group by 1, 2),
kw as (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from ks qualify rank <= 20),
cv as (select chunk_id, (doc_id * 7 + idx) % (select count(*) from embeddings) as vec_id from chunks),
vs as (select q.query_id, e.vec_id, round(list_dot_product(qe.embedding::double[], e.embedding::double[]), 9) as score from q join embeddings qe on qe.vec_id = q.vec_id cross join embeddings e),
ds as (select query_id, chunk_id, score from vs join cv using (vec_id)),
dn as (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from ds qualify rank <= 20),
votes as (select query_id, chunk_id, 1.0::double / (60 + rank) as v from kw union all select query_id, chunk_id, 1.0::double / (60 + rank) from dn),
hy as (select query_id, chunk_id, round(sum(v), 12) as score, row_number() over (partition by query_id order by round(sum(v), 12) desc, chunk_id) as rank from votes group by 1, 2 qualify rank <= 20)"""


def listed(df, digits: int = 9):
    return df.select("query_id", "chunk_id", F.round("score", digits).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("R1_chunk_sentences", f"with {SQL_CHUNKS} select chunk_id, doc_id, idx, sha256(content) as digest from chunks")
def _(t: Tables):
    return chunks(t).select("chunk_id", "doc_id", F.col("idx").cast("long").alias("idx"), F.sha2("content", 256).alias("digest"))


@query("R2_keyword_search", f"{SQL_BASE} select query_id, chunk_id, round(score, 9) as score, rank from kw where rank <= {K}")
def _(t: Tables):
    return listed(retrieval.keyword_search(asked(t), retrieval.chunk_sentences(t.texts.select("doc_id", "text")), K))


@query("R2_stored_index", f"{SQL_BASE} select query_id, chunk_id, round(score, 9) as score, rank from kw where rank <= {K} and query_id % 7 = 0")
def _(t: Tables):
    """A seventh of the questions against an index that is written once and read by the buckets of their terms."""
    path = work_dir(t.spark, "keyword_index")
    keyword_index.write_index(retrieval.chunk_sentences(t.texts.select("doc_id", "text")), path)
    some = asked(t).filter("query_id % 7 = 0")
    return listed(keyword_index.search(some, keyword_index.read_index(t.spark, path, some), K))


@query("R3_dense_search", f"{SQL_BASE} select query_id, chunk_id, score, rank from dn where rank <= {K}")
def _(t: Tables):
    return listed(retrieval.dense_search(questions(t), vectors(t), K))


@query("R3_dense_search_excluding", f"""{SQL_BASE}, ex as (select query_id, chunk_id from dn where rank <= 3),
d2 as (select ds.*, row_number() over (partition by ds.query_id order by score desc, chunk_id) as rank from ds anti join ex using (query_id, chunk_id) qualify rank <= {K})
select query_id, chunk_id, score, rank from d2""")
def _(t: Tables):
    """The three best chunks of a first turn are excluded from the second."""
    first = retrieval.dense_search(questions(t), vectors(t), 3)
    seen = first.groupBy("query_id").agg(F.collect_list("chunk_id").alias("seen"))
    return listed(retrieval.dense_search(questions(t).join(seen, "query_id", "left"), vectors(t), K, exclude="seen"))


@query("R4_rrf", f"{SQL_BASE} select query_id, chunk_id, round(score, 9) as score, rank from hy where rank <= {K}")
def _(t: Tables):
    return listed(retrieval.hybrid_search(questions(t), chunks(t), vectors(t), K))


def variants(t: Tables):
    q = t.benchmark.select(F.col("item_id").alias("query_id"), words("text").alias("w"))
    half = F.ceil(F.size("w") / 2).cast("int")
    halves = F.array(F.slice("w", F.lit(1), half), F.slice("w", half + 1, F.size("w")))
    each = q.select("query_id", F.posexplode(halves).alias("variant", "w"))
    text = each.filter(F.size("w") > 0).select("query_id", "variant", F.array_join("w", " ").alias("query"))
    return with_vector(text, t, F.col("query_id") * 3 + F.col("variant"))


SQL_VARIANTS = SQL_BASE.replace(SQL_Q, """q0 as (select item_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') as w from benchmark),
q as (select item_id * 2 as query_id, array_to_string(w[1:ceil(len(w) / 2)::int], ' ') as query, (item_id * 3) % (select count(*) from embeddings) as vec_id from q0
  union all select item_id * 2 + 1, array_to_string(w[ceil(len(w) / 2)::int + 1:], ' '), (item_id * 3 + 1) % (select count(*) from embeddings) from q0 where len(w) > 1)""")


@query("R5_multi_query", f"""{SQL_VARIANTS}, h as (select query_id, chunk_id, rank from (select *, row_number() over (partition by query_id order by score desc, chunk_id) as r2 from hy) where r2 <= {K}),
f as (select query_id // 2 as query_id, chunk_id, round(sum(1.0::double / (60 + rank)), 12) as score from h group by 1, 2)
select query_id, chunk_id, round(score, 9) as score, row_number() over (partition by query_id order by score desc, chunk_id) as rank from f qualify rank <= {K}""")
def _(t: Tables):
    return listed(retrieval.multi_query(variants(t), chunks(t), vectors(t), K))


@query("R6_fuse_hypothetical", f"""{SQL_VARIANTS}, h as (select * from hy where rank <= {K}),
f as (select query_id // 2 as query_id, chunk_id, round(sum(1.0::double / (60 + rank)), 12) as score from h group by 1, 2)
select query_id, chunk_id, round(score, 9) as score, row_number() over (partition by query_id order by score desc, chunk_id) as rank from f qualify rank <= {K}""")
def _(t: Tables):
    v = variants(t)
    return listed(retrieval.fuse_hypothetical(v.filter("variant = 0"), v.filter("variant = 1"), chunks(t), vectors(t), K))


def rerank_scores(t: Tables):
    """A supplied score for every second chunk: its length."""
    c = chunks(t).filter("idx % 2 = 0").select("chunk_id", F.length("content").cast("double").alias("score"))
    return c


def scored(cands, t: Tables):
    return cands.select("query_id", "chunk_id").join(rerank_scores(t), "chunk_id")


@query("R7_adaptive_route", f"""{SQL_BASE}, cx as (select query_id, ['SIMPLE', 'COMPLEX', 'MEDIUM'][(query_id % 3 + 1)::int] as c from q),
deep as (select hy.query_id, hy.chunk_id, row_number() over (partition by hy.query_id order by hy.rank) as rank from hy join cx using (query_id) where c = 'COMPLEX')
select query_id, chunk_id, rank, 'simple' as route from dn join cx using (query_id) where c = 'SIMPLE' and rank <= 5
union all select query_id, chunk_id, rank, 'complex' from deep where rank <= {K // 2} union all select query_id, chunk_id, rank, 'default' from h10 join cx using (query_id) where c = 'MEDIUM' and rank <= {K // 2}""".replace("hy as (select", "hy as (select").replace("h10", "hy5").replace("deep as (", """k10 as (select * from kw where rank <= 10), d10 as (select * from dn where rank <= 10),
v5 as (select query_id, chunk_id, 1.0::double / (60 + rank) as v from k10 union all select query_id, chunk_id, 1.0::double / (60 + rank) from d10),
hy5 as (select query_id, chunk_id, row_number() over (partition by query_id order by round(sum(v), 12) desc, chunk_id) as rank from v5 group by 1, 2), deep as ("""))
def _(t: Tables):
    kind = F.element_at(F.array(F.lit("SIMPLE"), F.lit("COMPLEX"), F.lit("MEDIUM")), (F.col("query_id") % 3 + 1).cast("int"))
    q = questions(t).withColumn("complexity", kind)
    out = retrieval.adaptive_route(q, chunks(t), vectors(t), None, K // 2)
    return out.withColumn("rank", F.col("rank").cast("long"))


@query("R8_rerank", f"""{SQL_BASE}, s as (select kw.*, case when idx % 2 = 0 then length(content)::double end as s2 from kw join chunks using (chunk_id))
select query_id, chunk_id, s2 as score, row_number() over (partition by query_id order by s2 desc nulls last, rank) as rank from s qualify rank <= 5""".replace("qualify rank <= 5", "qualify row_number() over (partition by query_id order by s2 desc nulls last, s.rank) <= 5").replace("nulls last, rank) as rank", "nulls last, s.rank) as rank"))
def _(t: Tables):
    cands = retrieval.keyword_search(asked(t), chunks(t), 20)
    return listed(retrieval.rerank(cands, scored(cands, t), 5))


PATTERNS = {"the": r"\sthe\s", "und": "UND", "dots": r"[.]{3}", "broken": "(oops", "que": "que[a-z]+"}


@query("R9_grep_chunks", f"""with {SQL_CHUNKS}, p(pattern, rx) as (values ('the', '(?i)\\sthe\\s'), ('und', '(?i)UND'), ('dots', '(?i)[.]{{3}}'), ('que', '(?i)que[a-z]+'))
select pattern, chunk_id, row_number() over (partition by pattern order by doc_id, idx) as rank from chunks, p where regexp_matches(content, rx) qualify rank <= 5""")
def _(t: Tables):
    out = retrieval.grep_chunks(PATTERNS, chunks(t))
    return out.select("pattern", "chunk_id", F.col("rank").cast("long").alias("rank"))


@query("J10_pattern_join", """
with p(pattern, rx) as (values ('the', '(?i)\\sthe\\s'), ('email', '[a-z]+@[a-z]+'), ('digits', '[0-9]{3,}'), ('que', 'que[a-z]+'))
select pattern, source, count(*) as n from documents, p where regexp_matches(text, rx) group by 1, 2""")
def _(t: Tables):
    rx = {"the": r"(?i)\sthe\s", "email": "[a-z]+@[a-z]+", "digits": "[0-9]{3,}", "que": "que[a-z]+"}
    return tables.pattern_hits(t.texts, "text", rx).groupBy("pattern", "source").agg(F.count(F.lit(1)).alias("n"))


# a table of patterns made from the benchmark: its first words with any ending, and one that does not compile
SQL_RX = """pt as (select item_id as pattern, '(^|\\s)' || regexp_extract(text, '[A-Za-z]+', 0) || '[a-z]*' as rx from benchmark)"""


def pattern_table(t: Tables):
    rx = F.concat(F.lit(r"(^|\s)"), F.regexp_extract("text", "[A-Za-z]+", 0), F.lit("[a-z]*"))
    good = t.benchmark.select(F.col("item_id").alias("pattern"), rx.alias("rx"))
    return good.union(good.agg(F.lit(-1).cast("long"), F.lit("(oops")))


@query("R9_grep_table", f"""with {SQL_CHUNKS}, {SQL_RX}
select pattern, chunk_id, row_number() over (partition by pattern order by doc_id, idx) as rank from chunks, pt where regexp_matches(content, '(?i)' || rx) qualify rank <= 5""")
def _(t: Tables):
    return retrieval.grep_table(pattern_table(t), chunks(t)).select("pattern", "chunk_id", F.col("rank").cast("long").alias("rank"))


@query("J10_pattern_table", f"with {SQL_RX} select pattern, source, count(*) as n from documents, pt where regexp_matches(text, rx) group by 1, 2")
def _(t: Tables):
    hits = tables.pattern_join(t.texts.select("source", "text"), "text", pattern_table(t))
    return hits.groupBy("pattern", "source").agg(F.count(F.lit(1)).alias("n"))


@query("R10_fetch_documents", """
select doc_id, sha256(case when length(text) > 2000 then substr(text, 1, 2000) || chr(10) || '... [truncated]' else text end) as digest from documents where doc_id in (select doc_id from labels)""")
def _(t: Tables):
    out = retrieval.fetch_documents(t.labels, t.documents, 2000)
    return out.select("doc_id", F.sha2("text", 256).alias("digest"))


def contexts(t: Tables):
    return chunks(t).filter("idx % 3 <> 0").select("chunk_id", F.when(F.col("idx") % 3 == 1, F.lit(" From an earlier part of the text. ")).otherwise(" ").alias("context"))


SQL_ENRICHED = "en as (select chunk_id, doc_id, idx, case when idx % 3 = 1 then 'From an earlier part of the text. ' || content else content end as content from chunks)"


@query("R11_enrich_chunks", f"with {SQL_CHUNKS}, {SQL_ENRICHED} select chunk_id, sha256(content) as digest from en")
def _(t: Tables):
    return retrieval.enrich_chunks(chunks(t), contexts(t)).select("chunk_id", F.sha2("content", 256).alias("digest"))


@query("J13_compare_topk", f"""{SQL_BASE}, {SQL_ENRICHED}, ew as (select chunk_id, list_filter(string_split_regex(lower(content), '\\s+'), lambda x: x <> '') as w from en),
et as (select chunk_id, len(w) as n, unnest(list_distinct(w)) as term from ew), es as (select query_id, chunk_id, count(*) / (any_value(n) + 50) as score from et join terms using (term) group by 1, 2),
ek as (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from es qualify rank <= 5)
select kw.query_id, count(ek.chunk_id) as overlap from kw left join ek on ek.query_id = kw.query_id and ek.chunk_id = kw.chunk_id where kw.rank <= 5 group by 1""")
def _(t: Tables):
    """Top-5 overlap before and after the chunks got their context."""
    plain = chunks(t)
    before = retrieval.keyword_search(asked(t), plain, 5)
    after = retrieval.keyword_search(asked(t), retrieval.enrich_chunks(plain, contexts(t)), 5)
    return tables.compare_topk(before, after, 5)


@query("R12_assemble_context", f"""{SQL_BASE} select query_id, sha256(string_agg('[' || chunk_id || ']' || chr(10) || content, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by rank)) as digest
from kw join chunks using (chunk_id) where rank <= 5 group by 1""")
def _(t: Tables):
    c = chunks(t)
    out = retrieval.assemble_context(retrieval.keyword_search(asked(t), c, 5), c)
    return out.select("query_id", F.sha2("context", 256).alias("digest"))


@query("W6_reorder_lost_in_middle", f"""{SQL_BASE}, n as (select *, max(rank) over (partition by query_id) as n from kw where rank <= 7)
select query_id, chunk_id, rank, case when n <= 2 then rank when rank % 2 = 1 then (rank + 1) // 2 else n - rank // 2 + 1 end as position from n""")
def _(t: Tables):
    ranked = retrieval.keyword_search(asked(t), chunks(t), 7)
    out = sequences.reorder_lost_in_middle(ranked)
    return out.select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"), "position")


@query("W7_pack_context", f"""{SQL_BASE}, u as (select query_id, chunk_id, rank, length(content) // 4 as tokens, sum(length(content) // 4) over (partition by query_id order by rank)::bigint as used from kw join chunks using (chunk_id))
select query_id, chunk_id, tokens, used, used <= 1000 as fits, used >= 750 as over_soft, used >= 900 as over_hard from u""")
def _(t: Tables):
    c = chunks(t)
    ranked = retrieval.keyword_search(asked(t), c, 20).join(c.select("chunk_id", "content"), "chunk_id")
    return sequences.pack_context(ranked, "content", 1000).select("query_id", "chunk_id", "tokens", "used", "fits", "over_soft", "over_hard")


@query("R13_keyword_overlap", """
with w as (select d.doc_id, list_distinct(list_filter(string_split_regex(lower(b.text), '\\s+'), lambda x: x <> '')) as want, list_distinct(list_filter(string_split_regex(lower(d.text), '\\s+'), lambda x: x <> '')) as got
  from documents d join benchmark b on b.item_id = d.doc_id % (select count(*) from benchmark))
select doc_id, round(len(list_intersect(want, got)) / greatest(len(want), 1), 3) as overlap from w""")
def _(t: Tables):
    size = t.benchmark.agg(F.count(F.lit(1)).alias("_n"))
    docs = with_scalars(t.texts.select("doc_id", "text"), size).withColumn("item_id", F.col("doc_id") % F.col("_n"))
    pairs = docs.join(t.benchmark.select("item_id", F.col("text").alias("expected")), "item_id")
    return pairs.select("doc_id", retrieval.keyword_overlap("expected", "text").alias("overlap"))


@query("R14_compare_modes", """
with m as (select event_type as mode, count(*) as n, round(avg(user_id * 10), 6) as avg_length, round(avg(value), 6) as avg_elapsed_s, round(avg(value / 7), 6) as avg_search_ms from events group by 1)
select *, round((avg_length / (select avg_length from m where mode = 'view') - 1) * 100, 6) as length_delta_percent from m""")
def _(t: Tables):
    rows = t.events.select(F.col("event_type").alias("mode"), (F.col("user_id") * 10).alias("answer_length"), F.col("value").alias("elapsed_s"), (F.col("value") / 7).alias("search_ms"))
    return retrieval.compare_modes(rows, "view")


@query("R15_recall_at_k", f"""{SQL_BASE}, h as (select query_id, count(*) as c from (select * from dn where rank <= 10) a join (select query_id, chunk_id from hy where rank <= 10) b using (query_id, chunk_id) group by 1)
select 10 as k, count(*) as queries, round(avg(coalesce(c, 0) / 10), 6) as recall from (select distinct query_id from dn) left join h using (query_id)""")
def _(t: Tables):
    """How much of the dense top 10 the hybrid top 10 keeps."""
    q, c, v = questions(t), chunks(t), vectors(t)
    truth, words20 = retrieval.dense_search(q, v, 20), retrieval.keyword_search(q, c, 20)
    return retrieval.recall_at_k(truth, retrieval.rrf([words20, truth], 10), 10)


@query("V1_cosine", """
select a.vec_id, round(list_dot_product(a.embedding::double[], b.embedding::double[]) / (sqrt(list_dot_product(a.embedding::double[], a.embedding::double[])) * sqrt(list_dot_product(b.embedding::double[], b.embedding::double[]))), 6) as cosine
from embeddings a join embeddings b on b.vec_id = a.vec_id + 1""")
def _(t: Tables):
    a = t.embeddings.select("vec_id", "embedding")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return a.join(b, "vec_id").select("vec_id", F.round(cosine("embedding", "other"), 6).alias("cosine"))
