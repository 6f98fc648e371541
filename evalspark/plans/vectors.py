"""Quantized search over the embeddings table; the queries belong to the benchmark questions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators import quantize
from ..operators.retrieval import recall_at_k
from .registry import Tables, query
from .search import with_vector


def data(t: Tables):
    """One query per benchmark question (the vector that the question is given), and all vectors."""
    e = t.embeddings.select("vec_id", F.col("embedding").alias("vector"))
    asked = with_vector(t.benchmark.select(F.col("item_id").alias("query_id")), t, F.col("query_id") * 3)
    return asked.select("query_id", F.col("vector").cast("array<double>").alias("vector")), e


SQL_DATA = """e as (select vec_id, embedding::double[] as v from embeddings), q as (select item_id as query_id, e.v from benchmark join e on e.vec_id = item_id * 3 % (select count(*) from embeddings)),
s as (select query_id, vec_id, round(list_dot_product(q.v, e.v), 9) as score from q, e), flat as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s qualify rank <= 10)"""


def listed(df):
    return df.select("query_id", "vec_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("V2_flat_topk", f"with {SQL_DATA} select query_id, vec_id, round(score, 6) as score, rank from flat")
def _(t: Tables):
    return listed(quantize.flat_topk(*data(t)))


@query("J15_cartesian_sims", f"with {SQL_DATA} select query_id, vec_id, round(score, 6) as score, rank from flat where rank <= 3")
def _(t: Tables):
    """All query x vector scores are computed in tiles; the best of every query are the result."""
    return listed(quantize.flat_topk(*data(t), k=3))


@query("V3_sq8_search", """with e as (select vec_id, embedding::double[] as v from embeddings), q as (select item_id as query_id, e.v from benchmark join e on e.vec_id = item_id * 3 % (select count(*) from embeddings)),
x as (select unnest(v) as x, generate_subscripts(v, 1) as i from e), r as (select list(lo order by i) as lo, list(w order by i) as w from (select i, min(x) as lo, max(x) - min(x) as w from x group by i)),
c as (select vec_id, list_transform(range(1, len(v) + 1), lambda i: (least(255, greatest(0, floor(((v[i] - lo[i]) / w[i]) * 255))) + 0.5) / 255 * w[i] + lo[i]) as v from e, r),
s as (select query_id, vec_id, round(list_dot_product(q.v, c.v), 9) as score from q, c)
select query_id, vec_id, round(score, 6) as score, row_number() over (partition by query_id order by score desc, vec_id) as rank from s qualify rank <= 10""")
def _(t: Tables):
    return listed(quantize.sq8_search(*data(t)))


@query("V4_pq_search")
def _(t: Tables):
    return listed(quantize.pq_search(*data(t), m=16, bits=8))


@query("V5_opq_search")
def _(t: Tables):
    return listed(quantize.opq_search(*data(t), m=16, bits=8))


@query("V6_ivf_pq_search")
def _(t: Tables):
    return listed(quantize.ivf_pq_search(*data(t), m=16, bits=8))


@query("V7_rotated_lowbit_search")
def _(t: Tables):
    """Recall at 10 for 2, 3 and 4 bits per coordinate."""
    q, e = data(t)
    truth, out = quantize.flat_topk(q, e), None
    for bits in (2, 3, 4):
        r = recall_at_k(truth, quantize.rotated_lowbit_search(q, e, bits), 10, "vec_id").withColumn("bits", F.lit(bits))
        out = r if out is None else out.unionByName(r)
    return out


@query("V8_storage_report", """
with s as (select count(*) as n, max(len(embedding)) as d from embeddings), m(method, bits) as (values ('pq16x8', 128), ('rot2', 144), ('rot3', 208), ('rot4', 272), ('sq8', 512))
select method, bits::bigint as bits_per_vector, (n * bits // 8)::bigint as bytes, (n * d * 4)::bigint as fp32_bytes, round(n * d * 4 / (n * bits // 8), 6) as compression_fp32, round(n * d * 2 / (n * bits // 8), 6) as compression_fp16 from m, s""")
def _(t: Tables):
    size = t.embeddings.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("d"))
    d = quantize.dimension(t.embeddings, "embedding")
    rows = [("pq16x8", 16 * 8), ("sq8", 8 * d)] + [(f"rot{b}", quantize.rotated_bits(d, b)) for b in (2, 3, 4)]
    return quantize.storage_report(t.spark.createDataFrame(rows, "method string, bits_per_vector long"), size)


def reported(t: Tables):
    q, e = data(t)
    d = quantize.dimension(e)
    truth = quantize.flat_topk(q, e)
    pq = quantize.train_pq(e, 16, 8)
    found = {
        "flat": (truth, 32 * d),
        "sq8": (quantize.sq8_search(q, e), 8 * d),
        "pq16x8": (quantize.quantized_search(q, e, pq), pq.bits_per_vector),
        "opq16x8": (quantize.opq_search(q, e, m=16, bits=8), pq.bits_per_vector),
        "ivfpq16x8": (quantize.ivf_pq_search(q, e, m=16, bits=8), pq.bits_per_vector),
        "rot2": (quantize.rotated_lowbit_search(q, e, 2), quantize.rotated_bits(d, 2)),
        "rot3": (quantize.rotated_lowbit_search(q, e, 3), quantize.rotated_bits(d, 3)),
        "rot4": (quantize.rotated_lowbit_search(q, e, 4), quantize.rotated_bits(d, 4)),
    }
    return quantize.method_report(truth, found, e)


@query("V9_method_report")
def _(t: Tables):
    return reported(t)


# recall at 10 that a method must reach on the given vectors, which are random directions and hard to quantize
BOUNDS = {"flat": 1.0, "sq8": 0.95, "pq16x8": 0.35, "opq16x8": 0.35, "ivfpq16x8": 0.1, "rot2": 0.3, "rot3": 0.5, "rot4": 0.7}


@query("V9_recall_bounds", "select * from (values " + ", ".join(f"('{m}', true)" for m in BOUNDS) + ") v(method, reached)")
def _(t: Tables):
    """Whether every method reaches its bound."""
    bound = F.create_map(*[x for m, b in BOUNDS.items() for x in (F.lit(m), F.lit(b))])
    return reported(t).select("method", (F.col("recall_10") >= F.try_element_at(bound, F.col("method"))).alias("reached"))


@query("V4_convergence", "select * from (values ('opq', true, true, true), ('pq', true, true, true)) v(method, converged, falling, not_above_pq)")
def _(t: Tables):
    """Whether training ended by itself, and whether no round made the distortion larger."""
    _, e = data(t)
    fits = {"pq": quantize.train_pq(e, 16, 8), "opq": quantize.train_opq(e, 16, 8)}
    falling = lambda h: all(b <= a * (1 + 1e-9) for a, b in zip(h, h[1:]))
    # random directions leave a rotation nothing to gain; it may lose the luck of a start, no more
    rows = [(name, f.converged, falling(f.history), bool(f.history[-1] <= fits["pq"].history[-1] * 1.02)) for name, f in fits.items()]
    return t.spark.createDataFrame(rows, "method string, converged boolean, falling boolean, not_above_pq boolean")


@query("V6_all_cells_equal_pq", "select count(*) * 10 as rows, true as equal from benchmark")
def _(t: Tables):
    """Probing all cells of an index of whole vectors against the product codes alone."""
    q, e = data(t)
    fit = quantize.train_pq(e, 16, 8)
    index = quantize.cell_index(e, 16, residual=False, quantizer=fit)
    cells, codes = quantize.search_cells(index, q, len(index.centers), 10), quantize.quantized_search(q, e, fit)
    both = cells.select("query_id", "rank", "vec_id").join(codes.select("query_id", "rank", F.col("vec_id").alias("other")), ["query_id", "rank"], "full_outer")
    return both.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.bool_and(F.col("vec_id").eqNullSafe(F.col("other"))), F.lit(True)).alias("equal"))


@query("V9_reranked_bounds", "select * from (values ('ivf', true), ('opq', true), ('pq', true), ('rot2', true)) v(method, reached)")
def _(t: Tables):
    """Whether lossy rankings that are scored again to a measured depth reach a recall of 0.9 at 10."""
    q, e = data(t)
    truth = quantize.flat_topk(q, e)
    found = {"pq": quantize.reranked_search(q, e, quantize.train_pq(e, 16, 8)), "opq": quantize.reranked_search(q, e, quantize.train_opq(e, 16, 8)),
             "rot2": quantize.reranked_search(q, e, quantize.rotated_quantizer(quantize.dimension(e), 2)), "ivf": quantize.ivf_reranked_search(q, e, m=16)}
    parts = [recall_at_k(truth, df, 10, "vec_id").select(F.lit(name).alias("method"), (F.col("recall") >= 0.9).alias("reached")) for name, df in found.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)
