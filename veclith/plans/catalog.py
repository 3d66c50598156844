"""Queries of the vector engine and the DuckDB SQL that checks them.

The SQL redoes rotation, quantization and scoring from the embeddings; only the random signs,
boundaries and centroids are written into it, so it is an independent check.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CacheConfig, IndexConfig, QuantizerConfig
from ..functions import codec, vectors
from ..operators import filters as f
from ..operators import hnsw, ivf, kvcache, metrics, search
from ..operators.collection import live, store_info
from ..operators.quantize import asymmetric_cosine, dequantize, inner_product, quantize, quantize_product

DIM, QUERIES, EVERY, DIGITS = 64, 100, 50, 6
CONFIG = QuantizerConfig(DIM, bits=8)
CONFIG4 = QuantizerConfig(DIM, bits=4)
CACHE = CacheConfig(layers=2, heads=4, head_dim=DIM, bits=8)


def _embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/embeddings.parquet")


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def _codes(spark, sf, config=CONFIG) -> DataFrame:
    return quantize(_embeddings(spark, sf).select("vec_id", "label", "embedding"), config)


def _stated(spark, sf, n=QUERIES) -> list[tuple[int, list[float]]]:
    """The stated query set: the vectors of the first ids."""
    return [(r[0], r[1]) for r in _embeddings(spark, sf).where(F.col("vec_id") < n).select("vec_id", F.col("embedding").cast("array<double>")).orderBy("vec_id").collect()]


def _every(spark, sf) -> DataFrame:
    """The query set that grows with the table: every row whose id is divisible by EVERY."""
    return _embeddings(spark, sf).where(F.col("vec_id") % EVERY == 0).select("vec_id", "embedding")


def _one(spark, sf, vec_id=7) -> list[float]:
    return _embeddings(spark, sf).where(F.col("vec_id") == vec_id).select(F.col("embedding").cast("array<double>")).first()[0]


def _corpus(spark, sf) -> DataFrame:
    """Codes with typed metadata: the document whose id is the vector's, where there is one."""
    docs = _documents(spark, sf).select(F.col("doc_id").alias("vec_id"), "lang", "source", "n_chars")
    return _codes(spark, sf).join(docs, "vec_id", "left")


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Filtered top-k over 8-bit codes."""
    return search.search(_codes(spark, sf), _one(spark, sf), CONFIG, filter=f.eq("label", 3), digits=DIGITS).select("vec_id", "label", "score", "rank")


# --- queries ---------------------------------------------------------------------------


def exact_cosine_topk(spark, sf, stated=_stated):
    return search.exact_batch(_embeddings(spark, sf), stated(spark, sf), digits=DIGITS)


def exact_cosine_sql_lane(spark, sf):
    """The same arithmetic in Catalyst expressions, for one query."""
    q = F.array(*(F.lit(float(x)) for x in _one(spark, sf)))
    rows = _embeddings(spark, sf).select("vec_id", F.round(vectors.cosine("embedding", q), DIGITS).alias("score"))
    return rows.orderBy(F.desc("score"), "vec_id").limit(10)


def vector_functions(spark, sf):
    e = _embeddings(spark, sf).select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    r = lambda c: F.round(c, DIGITS)
    twice = vectors.scale("v", 2.0)
    return e.select(
        "vec_id",
        r(vectors.norm(twice)).alias("norm2"),
        r(vectors.dot("v", twice)).alias("dot2"),
        r(vectors.l2_squared("v", vectors.normalize(twice))).alias("l2"),
        r(F.get(vectors.multiply("v", twice), F.lit(0))).alias("product0"),
        r(F.get(vectors.hadamard("v", DIM), F.lit(5))).alias("walsh5"),
    )


def quantize_codes(spark, sf):
    return _codes(spark, sf, CONFIG4).select("vec_id", F.hex("codes").alias("codes"), F.round(F.col("norm").cast("double"), 5).alias("norm"))


def knn_batch(spark, sf, stated=_stated):
    return search.knn_batch(_codes(spark, sf), stated(spark, sf), CONFIG, digits=DIGITS)


def knn_batch_4bit(spark, sf, stated=_stated):
    return search.knn_batch(_codes(spark, sf, CONFIG4), stated(spark, sf), CONFIG4, digits=DIGITS)


def rotated_score_topk(spark, sf):
    return search.search(_codes(spark, sf), _one(spark, sf), CONFIG, digits=DIGITS).select("vec_id", "score", "rank")


def min_score_search(spark, sf):
    return search.search(_codes(spark, sf), _one(spark, sf), CONFIG, top_k=50, min_score=0.2, digits=DIGITS).select("vec_id", "score", "rank")


def paged_search(spark, sf):
    return search.search(_codes(spark, sf), _one(spark, sf), CONFIG, top_k=5, offset=5, digits=DIGITS).select("vec_id", "score", "rank")


def filtered_search(spark, sf):
    want = f.and_(f.eq("lang", "en"), f.or_(f.gt("n_chars", 1000), f.eq("source", "src0")))
    return search.search(_corpus(spark, sf), _one(spark, sf), CONFIG, filter=want, digits=DIGITS).select("vec_id", "lang", "score", "rank")


def rescore_topk(spark, sf):
    return search.search(_codes(spark, sf, CONFIG4), _one(spark, sf), CONFIG4, top_k=10, rescore=30, digits=DIGITS).select("vec_id", "score", "rank")


def asym_cosine_topk(spark, sf):
    rows = asymmetric_cosine(_codes(spark, sf, CONFIG4), _one(spark, sf), CONFIG4).select("vec_id", F.round("cosine", DIGITS).alias("cosine"))
    return rows.orderBy(F.desc("cosine"), "vec_id").limit(10)


def dequantize_cosine(spark, sf):
    """How close what the codes stand for is to each vector."""
    e = _embeddings(spark, sf)
    back = dequantize(quantize(e.select("vec_id", "embedding"), CONFIG4), CONFIG4, "back")
    return back.join(e, "vec_id").select("vec_id", F.round(vectors.cosine("back", "embedding"), DIGITS).alias("cosine"))


def filter_only_query(spark, sf):
    return search.query(_corpus(spark, sf), f.eq("lang", "fr"), page_size=20).select("vec_id", "lang", "n_chars")


_LEAVES = {
    "eq": (lambda: f.eq("lang", "de"), "lang = 'de'"),
    "ne": (lambda: f.ne("lang", "de"), "lang <> 'de'"),
    "gt": (lambda: f.gt("n_chars", 2000), "n_chars > 2000"),
    "gte": (lambda: f.gte("n_chars", 2000), "n_chars >= 2000"),
    "lt": (lambda: f.lt("n_chars", 500), "n_chars < 500"),
    "lte": (lambda: f.lte("n_chars", 500), "n_chars <= 500"),
    "in": (lambda: f.in_("source", "src1", "src2"), "source IN ('src1', 'src2')"),
    "nin": (lambda: f.nin("source", "src1", "src2"), "source NOT IN ('src1', 'src2')"),
    "contains": (lambda: f.contains("source", "rc1"), "contains(source, 'rc1')"),
    "not_contains": (lambda: f.not_contains("source", "rc1"), "NOT contains(source, 'rc1')"),
    "and": (lambda: f.and_(f.eq("lang", "en"), f.gt("n_chars", 1000)), "lang = 'en' AND n_chars > 1000"),
    "or": (lambda: f.or_(f.eq("lang", "es"), f.lt("n_chars", 100)), "lang = 'es' OR n_chars < 100"),
}


def _leaf(name):
    return lambda spark, sf: _LEAVES[name][0]().apply(_documents(spark, sf)).select("doc_id", "lang", "source", "n_chars")


def filter_variant(spark, sf):
    """The same language over metadata without a declared type."""
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.try_parse_json("props").alias("data"))
    return f.and_(f.gte("k", 10), f.lt("k", 60), f.ne("k", 42)).apply(events, "data").select("event_id")


def filter_variant_mismatch(spark, sf):
    """Strings never equal numbers, and a missing key fails every leaf."""
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.try_parse_json("props").alias("data"))
    return f.or_(f.eq("k", "42"), f.ne("nothing", 1), f.and_(f.nin("k", 1, 2), f.not_contains("k", "x"), f.lte("k", 5))).apply(events, "data").select("event_id")


def _truth(spark, sf, stated=_stated):
    return search.exact_batch(_embeddings(spark, sf), stated(spark, sf), digits=DIGITS)


def recall_at_k(spark, sf, stated=_stated):
    return metrics.recall(_truth(spark, sf, stated), knn_batch_4bit(spark, sf, stated)).select("qid", F.round("recall", DIGITS).alias("recall"))


def recall_summary(spark, sf, stated=_stated):
    return metrics.perfect(metrics.recall(_truth(spark, sf, stated), knn_batch(spark, sf, stated))).select("queries", "perfect", F.round("mean_recall", DIGITS).alias("mean_recall"))


def ndcg_at_k(spark, sf, stated=_stated):
    return metrics.ndcg(_truth(spark, sf, stated), knn_batch_4bit(spark, sf, stated)).select("qid", F.round("ndcg", DIGITS).alias("ndcg"))


def score_pearson(spark, sf, stated=_stated):
    got = metrics.scores(_truth(spark, sf, stated), knn_batch_4bit(spark, sf, stated))
    return got.select(F.round("avg_diff", DIGITS).alias("avg_diff"), F.round("max_diff", DIGITS).alias("max_diff"))


def score_correlation(spark, sf, stated=_stated):
    """Pearson's r of the best scores; 0 where either has no spread, as where every query finds itself."""
    return metrics.scores(_truth(spark, sf, stated), knn_batch_4bit(spark, sf, stated)).select(F.round("pearson", DIGITS).alias("pearson"))


def rank_displacement(spark, sf, stated=_stated):
    got = metrics.displacement(_truth(spark, sf, stated), knn_batch_4bit(spark, sf, stated))
    return got.select("found", F.round("avg_displacement", DIGITS).alias("avg_displacement"), F.col("max_displacement").cast("long").alias("max_displacement"))


def near_misses(spark, sf, stated=_stated):
    eleven = search.exact_batch(_embeddings(spark, sf), stated(spark, sf), k=11, digits=DIGITS)
    return metrics.near_misses(eleven).select("qid", F.round("gap", DIGITS).alias("gap"))


def score_percentiles(spark, sf, stated=_stated):
    truth = _truth(spark, sf, stated)
    parts = [metrics.percentile(truth, "score", p).select(F.lit(p).alias("p"), F.round("value", DIGITS).alias("value")) for p in (50, 95, 99)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@lru_cache(maxsize=4)
def _centers(count: int) -> np.ndarray:
    """Fixed centroids for the query that SQL can redo; trained ones are in ``ivf_trained``."""
    return codec.rotation(CONFIG).forward(np.eye(DIM)[:count])


def ivf_assign(spark, sf):
    return ivf.assign(_codes(spark, sf), _centers(16), CONFIG).select("vec_id", "ivf_part")


def ivf_search(spark, sf):
    rows = ivf.assign(_codes(spark, sf), _centers(16), CONFIG)
    return ivf.search(rows, _centers(16), _one(spark, sf), CONFIG, probe=4, digits=DIGITS).select("vec_id", "score", "rank")


def ivf_trained(spark, sf):
    """Trained centroids, and as many probes as a measured recall of ivf.RECALL takes."""
    codes = _codes(spark, sf)
    return _tuned(spark, sf, codes, ivf.train(codes, CONFIG, IndexConfig(kind="ivf")))


def _tuned(spark, sf, codes, centers):
    rows, queries = ivf.assign(codes, centers, CONFIG), _every(spark, sf)
    probe = ivf.probes_for(rows, centers, _embeddings(spark, sf), queries, CONFIG, digits=DIGITS)
    return ivf.knn_batch(rows, centers, queries, CONFIG, probe=probe, digits=DIGITS)


def ivf_search_every50(spark, sf):
    """The fixed centroids of ``ivf_search``, probed as far as a measured recall of ivf.RECALL takes."""
    return _tuned(spark, sf, _codes(spark, sf), _centers(16))


def ivf_all_probes(spark, sf, stated=_stated):
    """With every partition probed the index finds what the scan finds."""
    rows = ivf.assign(_codes(spark, sf), _centers(16), CONFIG)
    return ivf.knn_batch(rows, _centers(16), stated(spark, sf), CONFIG, probe=16, digits=DIGITS)


def hnsw_search(spark, sf):
    nodes = hnsw.build(_codes(spark, sf), CONFIG, IndexConfig(kind="hnsw"))
    return hnsw.knn_batch(nodes, _every(spark, sf), CONFIG, digits=DIGITS)


def product_inner(spark, sf):
    coded = quantize_product(_embeddings(spark, sf).select("vec_id", "embedding"), CONFIG4)
    return inner_product(coded, _one(spark, sf), CONFIG4).select("vec_id", F.round("inner", 4).alias("inner"))


def _cache_rows(spark, sf) -> DataFrame:
    """A head's keys are the vectors of a label, scaled so that lengths differ; positions by id."""
    from pyspark.sql import Window as W

    e = _embeddings(spark, sf).select("vec_id", (F.col("label") % 2).alias("layer"), (F.col("label") % 4).alias("head"), vectors.scale("embedding", (1 + F.col("vec_id") % 5).cast("double")).alias("vector"))
    return e.withColumn("pos", (F.row_number().over(W.partitionBy("layer", "head").orderBy("vec_id")) - 1).cast("int")).withColumn("kind", F.lit("key"))


def attention_scores(spark, sf):
    got = kvcache.attention_scores(kvcache.append(_cache_rows(spark, sf), CACHE), _one(spark, sf), CACHE, layer=1, head=3)
    return got.select("layer", "head", "pos", F.round("score", 5).alias("score"))


def seq_len(spark, sf):
    return kvcache.lengths(kvcache.append(_cache_rows(spark, sf), CACHE))


def cache_memory(spark, sf):
    return kvcache.memory(kvcache.append(_cache_rows(spark, sf), CACHE), CACHE)


def _log(spark, sf) -> DataFrame:
    """Orders as operations on customers: three kinds by order number."""
    o = spark.read.parquet(f"{sf}/orders.parquet")
    kind = F.when(F.col("o_orderkey") % 7 == 0, "delete").when(F.col("o_orderkey") % 3 == 0, "upsert").otherwise("add")
    none = lambda t: F.lit(None).cast(t)
    return o.select(F.col("o_orderkey").alias("seq"), kind.alias("op"), F.col("o_custkey").cast("string").alias("id"), F.col("o_orderpriority").alias("content"), none("string").alias("data"), none("binary").alias("codes"), none("float").alias("norm"))


def live_view_after_crud(spark, sf):
    return live(_log(spark, sf)).select("seq", "id", "content")


def info(spark, sf):
    return store_info(_codes(spark, sf, CONFIG4), CONFIG4)


#: Queries over the stated set, which are also there over the set that grows with the table.
GROWING = (
    exact_cosine_topk, knn_batch, knn_batch_4bit, recall_at_k, recall_summary, ndcg_at_k, score_pearson, score_correlation, rank_displacement, near_misses, score_percentiles, ivf_all_probes,
)


def _over_every(query):
    return lambda spark, sf: query(spark, sf, _every)


def queries() -> dict:
    """By name, each a callable (spark, sf_dir)."""
    plain = [
        exact_cosine_topk, exact_cosine_sql_lane, vector_functions, quantize_codes, knn_batch, knn_batch_4bit, rotated_score_topk, min_score_search, paged_search,
        filtered_search, rescore_topk, asym_cosine_topk, dequantize_cosine, filter_only_query, filter_variant, filter_variant_mismatch, recall_at_k, recall_summary,
        ndcg_at_k, score_pearson, score_correlation, rank_displacement, near_misses, score_percentiles, ivf_assign, ivf_search, ivf_search_every50, ivf_trained, ivf_all_probes, hnsw_search, product_inner,
        attention_scores, seq_len, cache_memory, live_view_after_crud,
    ]
    return {q.__name__: q for q in plain} | {f"{q.__name__}_every{EVERY}": _over_every(q) for q in GROWING} | {"store_info": info} | {f"filter_{name}": _leaf(name) for name in _LEAVES}


# --- SQL -------------------------------------------------------------------------------


def _list(x) -> str:
    return "[" + ", ".join(repr(float(v)) for v in x) + "]"


def _coded(config: QuantizerConfig, name: str = "") -> str:
    """CTEs rot (unit vectors rotated), codes and kept (centroids of the codes) by vec_id and j."""
    r = codec.rotation(config)
    c, b = codec.codebook(config.work_dim, config.bits, config.exact_pdf)
    if r.matrix is None:
        rotated = f"""any_value(({_list(r.second)})[j + 1]) * sum(x / norm * ({_list(r.first)})[i + 1] * CASE WHEN bit_count(i & j) % 2 = 0 THEN 1 ELSE -1 END) / sqrt({config.work_dim}) AS r
  FROM e{name} e JOIN n{name} n ON e.vec_id = n.vec_id, range({config.work_dim}) t(j) GROUP BY e.vec_id, j"""
    else:
        rotated = f"""sum(x / norm * m) AS r
  FROM e{name} e JOIN n{name} n ON e.vec_id = n.vec_id JOIN (SELECT j, i, ({_list(r.matrix.ravel())})[j * {DIM} + i + 1] AS m FROM range({DIM}) a(j), range({DIM}) b(i)) g ON g.i = e.i GROUP BY e.vec_id, j"""
    return f"""
e{name} AS (SELECT vec_id, i, CAST(embedding[i + 1] AS DOUBLE) AS x FROM embeddings, range({DIM}) t(i)),
n{name} AS (SELECT vec_id, sqrt(sum(x * x)) AS norm FROM e{name} GROUP BY vec_id),
rot{name} AS (
  SELECT e.vec_id, j, {rotated}
),
codes{name} AS (SELECT vec_id, j, r, len(list_filter({_list(b)}, lambda y: y < r)) AS c FROM rot{name}),
kept{name} AS (SELECT vec_id, j, r, c, ({_list(c)})[c + 1] AS v FROM codes{name})"""


def _scored(config: QuantizerConfig, where: str, name: str = "", source: str = "") -> str:
    """CTE scored: asymmetric scores of the queries that ``where`` picks."""
    return f"""
scored{name} AS (
  SELECT q.vec_id AS qid, k.vec_id, round(sum(q.r * k.v), {DIGITS}) AS score
  FROM rot{source} q JOIN kept{source} k ON q.j = k.j WHERE {where} GROUP BY q.vec_id, k.vec_id
)"""


def _top(source: str, name: str, k: int = 10) -> str:
    return f"""
{name} AS (SELECT * FROM (SELECT qid, vec_id, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM {source}) WHERE rank <= {k})"""


def _exact(where: str) -> str:
    """CTE exact: cosines of the queries that ``where`` picks."""
    return f"""
qx AS (SELECT vec_id, i, CAST(embedding[i + 1] AS DOUBLE) AS x FROM embeddings, range({DIM}) t(i)),
nx AS (SELECT vec_id, sqrt(sum(x * x)) AS norm FROM qx GROUP BY vec_id),
ux AS (SELECT qx.vec_id, i, x / norm AS x FROM qx JOIN nx ON qx.vec_id = nx.vec_id),
exact AS (SELECT a.vec_id AS qid, b.vec_id, round(sum(a.x * b.x), {DIGITS}) AS score FROM ux a JOIN ux b ON a.i = b.i WHERE {where} GROUP BY a.vec_id, b.vec_id)"""


def oracle_sql() -> dict[str, str]:
    """For each query that SQL can express."""
    grown = _sql(f"vec_id % {EVERY} = 0")
    return _sql(f"vec_id < {QUERIES}") | {f"{q.__name__}_every{EVERY}": grown[q.__name__] for q in GROWING}


def _sql(chosen: str) -> dict[str, str]:
    """By name, with the query set that ``chosen`` picks by vec_id."""
    exact = _exact(f"a.{chosen}")
    truth = exact + "," + _top("exact", "truth")
    four = _coded(CONFIG4) + "," + _scored(CONFIG4, f"q.{chosen}") + "," + _top("scored", "found")
    eight = _coded(CONFIG) + "," + _scored(CONFIG, f"q.{chosen}") + "," + _top("scored", "found")
    pair = "pair AS (SELECT t.qid, t.vec_id, t.rank AS t_rank, p.rank AS p_rank FROM truth t LEFT JOIN found p ON t.qid = p.qid AND t.vec_id = p.vec_id)"
    one = _coded(CONFIG) + "," + _scored(CONFIG, "q.vec_id = 7")
    one4 = _coded(CONFIG4) + "," + _scored(CONFIG4, "q.vec_id = 7")
    centers = ", ".join(_list(c) for c in _centers(16))
    parts = f"""
cen AS (SELECT p, j, ([{centers}])[p + 1][j + 1] AS x FROM range(16) a(p), range({DIM}) b(j)),
dist AS (SELECT vec_id, p, round(sum(v * x), 9) AS d FROM kept JOIN cen ON kept.j = cen.j GROUP BY vec_id, p),
assigned AS (SELECT vec_id, CAST(p AS INTEGER) AS ivf_part FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d DESC, p) AS n FROM dist) WHERE n = 1)"""
    joined = "corpus AS (SELECT e.vec_id, lang, source, n_chars FROM embeddings e LEFT JOIN documents d ON e.vec_id = d.doc_id)"
    sql = {
        "exact_cosine_topk": f"WITH {truth} SELECT * FROM truth",
        "exact_cosine_sql_lane": f"WITH {exact} SELECT vec_id, score FROM exact WHERE qid = 7 ORDER BY score DESC, vec_id LIMIT 10",
        "vector_functions": f"""WITH v AS (SELECT vec_id, i, CAST(embedding[i + 1] AS DOUBLE) AS x FROM embeddings, range({DIM}) t(i)),
n AS (SELECT vec_id, sqrt(sum(4 * x * x)) AS norm FROM v GROUP BY vec_id)
SELECT v.vec_id, round(any_value(norm), {DIGITS}) AS norm2, round(sum(2 * x * x), {DIGITS}) AS dot2, round(sum((x - 2 * x / norm) * (x - 2 * x / norm)), {DIGITS}) AS l2,
  round(max(CASE WHEN i = 0 THEN 2 * x * x END), {DIGITS}) AS product0, round(sum(x * CASE WHEN bit_count(i & 5) % 2 = 0 THEN 1 ELSE -1 END) / 8, {DIGITS}) AS walsh5
FROM v JOIN n ON v.vec_id = n.vec_id GROUP BY v.vec_id""",
        "quantize_codes": f"WITH {_coded(CONFIG4)} SELECT k.vec_id, string_agg(printf('%02X', c), '' ORDER BY j) AS codes, round(CAST(CAST(any_value(norm) AS FLOAT) AS DOUBLE), 5) AS norm FROM kept k JOIN n ON k.vec_id = n.vec_id GROUP BY k.vec_id",
        "knn_batch": f"WITH {eight} SELECT * FROM found",
        "knn_batch_4bit": f"WITH {four} SELECT * FROM found",
        "rotated_score_topk": f"WITH {one}, {_top('scored', 'found')} SELECT vec_id, score, rank FROM found",
        "min_score_search": f"WITH {one}, {_top('scored', 'found', 50)} SELECT vec_id, score, rank FROM found WHERE score >= 0.2",
        "paged_search": f"WITH {one}, {_top('scored', 'found')} SELECT vec_id, score, rank FROM found WHERE rank > 5",
        "filtered_search": f"WITH {one}, {joined}, chosen AS (SELECT s.*, lang FROM scored s JOIN corpus c ON s.vec_id = c.vec_id WHERE lang = 'en' AND (n_chars > 1000 OR source = 'src0')) SELECT vec_id, lang, score, CAST(row_number() OVER (ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM chosen ORDER BY score DESC, vec_id LIMIT 10",
        "rescore_topk": f"""WITH {one4}, {_top('scored', 'found', 30)}, size AS (SELECT vec_id, sqrt(sum(v * v)) AS s FROM kept GROUP BY vec_id),
again AS (SELECT f.vec_id, round(sum(q.r * k.v) / any_value(s), {DIGITS}) AS score FROM found f JOIN kept k ON f.vec_id = k.vec_id JOIN rot q ON q.j = k.j AND q.vec_id = 7 JOIN size ON size.vec_id = f.vec_id GROUP BY f.vec_id)
SELECT vec_id, score, CAST(row_number() OVER (ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM again ORDER BY score DESC, vec_id LIMIT 10""",
        "asym_cosine_topk": f"WITH {_coded(CONFIG4)} SELECT k.vec_id, round(sum(q.r * k.v) / sqrt(sum(k.v * k.v)), {DIGITS}) AS cosine FROM kept k JOIN rot q ON q.j = k.j AND q.vec_id = 7 GROUP BY k.vec_id ORDER BY cosine DESC, k.vec_id LIMIT 10",
        # a rotation keeps angles, so the cosine can be taken in rotated space
        "dequantize_cosine": f"WITH {_coded(CONFIG4)} SELECT vec_id, round(sum(r * v) / sqrt(sum(v * v)) / sqrt(sum(r * r)), {DIGITS}) AS cosine FROM kept GROUP BY vec_id",
        "filter_only_query": f"WITH {joined} SELECT vec_id, lang, n_chars FROM corpus WHERE lang = 'fr' ORDER BY vec_id LIMIT 20",
        "filter_variant": "SELECT event_id FROM events WHERE CAST(props ->> 'k' AS DOUBLE) >= 10 AND CAST(props ->> 'k' AS DOUBLE) < 60 AND CAST(props ->> 'k' AS DOUBLE) <> 42",
        "filter_variant_mismatch": "SELECT event_id FROM events WHERE CAST(props ->> 'k' AS DOUBLE) NOT IN (1, 2) AND CAST(props ->> 'k' AS DOUBLE) <= 5",
        "recall_at_k": f"WITH {truth}, {four}, {pair} SELECT qid, round(CAST(count(p_rank) AS DOUBLE) / count(*), {DIGITS}) AS recall FROM pair GROUP BY qid",
        "recall_summary": f"WITH {truth}, {eight}, {pair}, r AS (SELECT qid, CAST(count(p_rank) AS DOUBLE) / count(*) AS recall FROM pair GROUP BY qid) SELECT count(*) AS queries, count(*) FILTER (WHERE recall >= 1) AS perfect, round(avg(recall), {DIGITS}) AS mean_recall FROM r",
        "ndcg_at_k": f"WITH {truth}, {four}, {pair} SELECT qid, round(sum(CASE WHEN p_rank IS NULL THEN 0 ELSE (11 - t_rank) / log2(p_rank + 1) END) / sum((11 - t_rank) / log2(t_rank + 1)), {DIGITS}) AS ndcg FROM pair GROUP BY qid",
        "score_pearson": f"WITH {truth}, {four}, b AS (SELECT t.score AS t, p.score AS p FROM truth t JOIN found p ON t.qid = p.qid WHERE t.rank = 1 AND p.rank = 1) SELECT round(avg(p - t), {DIGITS}) AS avg_diff, round(max(abs(p - t)), {DIGITS}) AS max_diff FROM b",
        "score_correlation": f"WITH {truth}, {four}, b AS (SELECT t.score AS t, p.score AS p FROM truth t JOIN found p ON t.qid = p.qid WHERE t.rank = 1 AND p.rank = 1) SELECT round(CASE WHEN stddev_pop(t) * stddev_pop(p) < 1e-15 THEN 0.0 ELSE corr(t, p) END, {DIGITS}) AS pearson FROM b",
        "rank_displacement": f"WITH {truth}, {four}, {pair} SELECT count(*) AS found, round(avg(abs(t_rank - p_rank)), {DIGITS}) AS avg_displacement, CAST(max(abs(t_rank - p_rank)) AS BIGINT) AS max_displacement FROM pair WHERE p_rank IS NOT NULL",
        "near_misses": f"WITH {exact}, {_top('exact', 'truth', 11)}, g AS (SELECT qid, max(score) - min(score) AS gap FROM truth WHERE rank IN (10, 11) GROUP BY qid) SELECT qid, round(gap, {DIGITS}) AS gap FROM g WHERE gap < 0.01",
        "score_percentiles": f"WITH {truth}, s AS (SELECT list(score ORDER BY score) AS v FROM truth) SELECT CAST(p AS INTEGER) AS p, round(v[least(CAST(floor(len(v) * p / 100) AS BIGINT), len(v) - 1) + 1], {DIGITS}) AS value FROM s, (VALUES (50), (95), (99)) t(p)",
        "ivf_assign": f"WITH {_coded(CONFIG)}, {parts} SELECT vec_id, ivf_part FROM assigned",
        "ivf_search": f"""WITH {one}, {parts}, near AS (SELECT p FROM (SELECT p, round(sum(r * x), 9) AS d FROM rot JOIN cen ON rot.j = cen.j WHERE vec_id = 7 GROUP BY p) ORDER BY d DESC, p LIMIT 4)
SELECT s.vec_id, score, CAST(row_number() OVER (ORDER BY score DESC, s.vec_id) AS INTEGER) AS rank FROM scored s JOIN assigned a ON s.vec_id = a.vec_id WHERE ivf_part IN (SELECT p FROM near) ORDER BY score DESC, s.vec_id LIMIT 10""",
        "ivf_all_probes": f"WITH {eight} SELECT * FROM found",
        "attention_scores": f"""WITH {_coded(CONFIG)}, keys AS (SELECT vec_id, CAST(row_number() OVER (PARTITION BY label % 2, label % 4 ORDER BY vec_id) - 1 AS INTEGER) AS pos, label % 2 AS layer, label % 4 AS head, 1 + vec_id % 5 AS f FROM embeddings),
q AS (SELECT j, r * norm AS r FROM rot JOIN n ON rot.vec_id = n.vec_id WHERE rot.vec_id = 7)
SELECT layer, head, pos, round(sum(q.r * k.v) * any_value(CAST(CAST(norm * f AS FLOAT) AS DOUBLE)) / 8, 5) AS score FROM keys JOIN kept k ON keys.vec_id = k.vec_id JOIN q ON q.j = k.j JOIN n ON n.vec_id = k.vec_id WHERE layer = 1 AND head = 3 GROUP BY layer, head, pos""",
        "seq_len": "SELECT label % 2 AS layer, label % 4 AS head, count(*) AS seq_len FROM embeddings GROUP BY 1, 2",
        "cache_memory": f"SELECT CAST(count(*) * {DIM + 4} AS BIGINT) AS code_bytes, CAST(count(*) * {DIM + 4} AS BIGINT) AS packed_bytes, CAST(count(*) * {DIM * 2} AS BIGINT) AS fp16_bytes FROM embeddings",
        "live_view_after_crud": """WITH log AS (SELECT o_orderkey AS seq, CASE WHEN o_orderkey % 7 = 0 THEN 'delete' WHEN o_orderkey % 3 = 0 THEN 'upsert' ELSE 'add' END AS op, CAST(o_custkey AS VARCHAR) AS id, o_orderpriority AS content FROM orders),
alive AS (SELECT l.* FROM log l LEFT JOIN (SELECT id, max(seq) AS gone FROM log WHERE op = 'delete' GROUP BY id) d ON l.id = d.id WHERE op <> 'delete' AND seq > coalesce(gone, -1)),
pick AS (SELECT id, coalesce(max(CASE WHEN op = 'upsert' THEN seq END), min(seq)) AS seq FROM alive GROUP BY id)
SELECT a.seq, a.id, a.content FROM alive a JOIN pick p ON a.id = p.id AND a.seq = p.seq""",
        "store_info": f"SELECT count(*) AS vectors, {DIM} AS dim, 4 AS bits, CAST(count(*) * {DIM} AS BIGINT) AS code_bytes, CAST(count(*) * 36 AS BIGINT) AS packed_bytes, CAST(count(*) * {4 * DIM} AS BIGINT) AS raw_bytes, CAST({4 * DIM / 36!r} AS DOUBLE) AS ratio FROM embeddings",
    }
    return sql | {f"filter_{name}": f"SELECT doc_id, lang, source, n_chars FROM documents WHERE {where}" for name, (_, where) in _LEAVES.items()}
