"""Queries through collections, stored indexes, files and streams, and the DuckDB SQL that checks them.

What they write goes to new folders of the shared directory.
"""

from __future__ import annotations

import math
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import QR, IndexConfig, QuantizerConfig
from ..functions import codec, vectors
from ..operators import index, ivf, kvcache, metrics, model, search
from ..operators.collection import Collection
from ..operators.quantize import dequantize, marshal, quantize, unmarshal
from ..sources import jsonl, safetensors, store, vecs
from ..storage import file_system, shared
from ..streaming import ingest
from . import catalog as c

PROBES, FEWER = (1, 2, 4, 8, 16), (4, 5, 8)


def _hex(codes: DataFrame) -> DataFrame:
    return codes.select("vec_id", F.hex("codes").alias("codes"))


def quantize_all_bits(spark, sf):
    """Codes of every width."""
    out = None
    for bits in range(1, 9):
        one = _hex(c._codes(spark, sf, QuantizerConfig(c.DIM, bits))).select(F.lit(bits).alias("bits"), "vec_id", "codes")
        out = one if out is None else out.unionByName(one)
    return out


def quantize_qr(spark, sf):
    """Codes after a rotation by a random orthogonal matrix."""
    return _hex(c._codes(spark, sf, QuantizerConfig(c.DIM, 4, rotation=QR)))


def dequantize_qr_cosine(spark, sf):
    config, e = QuantizerConfig(c.DIM, 4, rotation=QR), c._embeddings(spark, sf)
    back = dequantize(quantize(e.select("vec_id", "embedding"), config), config, "back")
    return back.join(e, "vec_id").select("vec_id", F.round(vectors.cosine("back", "embedding"), c.DIGITS).alias("cosine"))


def quantize_exact_density(spark, sf):
    """Codes by the levels that fit the exact marginal density."""
    return _hex(c._codes(spark, sf, QuantizerConfig(c.DIM, 4, exact_pdf=True)))


def codebook_levels(spark, sf):
    """Levels for one and two bits in units of the deviation, and the distortion of one bit."""
    rows = [(bits, i, round(float(v) * math.sqrt(c.DIM), 3)) for bits in (1, 2) for i, v in enumerate(codec.codebook(c.DIM, bits)[0])]
    return spark.createDataFrame([*rows, (0, 0, round(codec.distortion(c.DIM, 1) * c.DIM, 3))], "bits int, level int, value double")


def packed_codes(spark, sf):
    """Three-bit codes as they are packed into bytes."""
    config = QuantizerConfig(c.DIM, 3)
    return marshal(c._codes(spark, sf, config), config).select("vec_id", F.hex(F.substring("packed", 8, 24)).alias("packed"))


def unmarshalled_codes(spark, sf):
    config = QuantizerConfig(c.DIM, 5)
    return unmarshal(marshal(c._codes(spark, sf, config), config)).select("vec_id", F.hex("codes").alias("codes"), F.round(F.col("norm").cast("double"), 5).alias("norm"))


def vector_negative(spark, sf):
    e = c._embeddings(spark, sf)
    return e.select("vec_id", F.round(vectors.negative_dot("embedding", vectors.scale("embedding", 2.0)), c.DIGITS).alias("negative"))


def store_round_trip(spark, sf):
    """Codes from a written store."""
    path = shared(spark, "store")
    store.write(c._codes(spark, sf, c.CONFIG4), path, c.CONFIG4, sort_by=["label"])
    rows, config = store.read(spark, path)
    return rows.select("vec_id", F.hex("codes").alias("codes"), F.round(F.col("norm").cast("double"), 5).alias("norm"), F.lit(config.bits).alias("bits"))


def semantic_search(spark, sf):
    """Search by a text whose embedding is that of a stored vector."""
    one = c._one(spark, sf)
    return search.semantic(c._codes(spark, sf), "any text", lambda text: one, c.CONFIG, digits=c.DIGITS).select("vec_id", "score", "rank")


def _cached(spark, sf) -> tuple[DataFrame, DataFrame]:
    rows = c._cache_rows(spark, sf)
    return rows, kvcache.append(rows.unionByName(rows.withColumn("kind", F.lit("value"))), c.CACHE)


def cache_values(spark, sf):
    """How close the values that a cache gives back are to those that went in."""
    rows, cache = _cached(spark, sf)
    both = kvcache.values(cache, c.CACHE).withColumnRenamed("vector", "back").join(rows, ["layer", "head", "pos"])
    return both.select("vec_id", F.round(vectors.cosine("back", "vector"), c.DIGITS).alias("cosine"))


def cache_sizes(spark, sf):
    """Lengths and memory of a cache that has keys and values."""
    _, cache = _cached(spark, sf)
    sizes = kvcache.memory(cache, replace(c.CACHE, bits=4)).select(F.lit(-1).alias("layer"), F.lit(-1).alias("head"), F.col("packed_bytes").alias("n"))
    return kvcache.lengths(cache).select("layer", "head", F.col("seq_len").alias("n")).unionByName(sizes)


# --- collections and streams -----------------------------------------------------------


def _documents(spark, sf, where: str, content) -> DataFrame:
    return c._embeddings(spark, sf).where(where).select(F.col("vec_id").cast("string").alias("id"), "vec_id", content.alias("content"), "embedding")


def collection_crud(spark, sf):
    """What is live after adding, deleting, updating and adding again."""
    held = Collection(spark, shared(spark, "collection"), c.CONFIG4)
    held.add(_documents(spark, sf, "true", F.concat(F.lit("first "), F.col("label").cast("string"))), "vec_id")
    held.delete(_documents(spark, sf, "vec_id % 7 = 0", F.lit("")))
    held.upsert(_documents(spark, sf, "vec_id % 5 = 0", F.lit("second")), "vec_id")
    held.add(_documents(spark, sf, "vec_id % 7 = 0", F.lit("third")), "vec_id")
    return held.compact().select("id", "content")


def collection_order(spark, sf):
    """Of the operations of an insert in order: how many there are, without a number, and with different ones."""
    held = Collection(spark, shared(spark, "collection"), c.CONFIG4)
    held.add(_documents(spark, sf, "true", F.format_string("%012d", "vec_id")), "vec_id")
    held.upsert(_documents(spark, sf, "true", F.format_string("%012d", "vec_id")), "vec_id")
    log = held.log()
    # numbers follow content within an operation: the order of one is that of the other
    spread = log.groupBy("op").agg(F.count(F.lit(1)).alias("operations"), F.count_if(F.col("seq").isNull()).alias("missing"), F.count_distinct("seq").alias("different"), F.min_by("content", "seq").alias("first"), F.max_by("content", "seq").alias("last"))
    return spread


def collection_info(spark, sf):
    held = Collection(spark, shared(spark, "collection"), c.CONFIG4)
    held.add(_documents(spark, sf, "true", F.lit("x")), "vec_id")
    held.delete(_documents(spark, sf, "vec_id % 2 = 0", F.lit("")))
    return held.info()


def embedded_documents(spark, sf):
    """Documents are embedded and added in one go; the first of each language by id."""
    from ..operators.embed import embed

    held = Collection(spark, shared(spark, "collection"), c.CONFIG4)
    docs = c._documents(spark, sf).select(F.col("doc_id").cast("string").alias("id"), F.coalesce("text", F.lit("")).alias("content"), F.to_json(F.struct("lang")).alias("data"))
    held.add(embed(docs), "id")
    return held.live().select("id", F.length("content").alias("length"), F.get_json_object("data", "$.lang").alias("lang"), F.octet_length("codes").alias("code_bytes"))


def _lines(spark, sf) -> str:
    """The vectors as JSON lines; as doubles, for the shortest decimals of a float read back as other doubles."""
    path = shared(spark, "lines")
    rows = c._embeddings(spark, sf).select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").cast("array<double>").alias("vector"), F.concat(F.lit("text "), F.col("label").cast("string")).alias("content"), F.struct("label").alias("metadata"))
    rows.write.json(path)
    return path


def jsonl_import(spark, sf):
    got = jsonl.read(spark, _lines(spark, sf))
    return got.select("id", F.size("embedding").alias("dim"), F.round(F.get("embedding", F.lit(0)), 5).alias("x0"), "content", F.get_json_object("data", "$.label").alias("label"))


def jsonl_export(spark, sf):
    path = shared(spark, "exported")
    jsonl.write(quantize(jsonl.read(spark, _lines(spark, sf)), c.CONFIG4), path)
    return spark.read.json(path).select(F.col("id").cast("long").alias("vec_id"), F.hex(F.unbase64("indices")).alias("codes"))


def streaming_ingest(spark, sf):
    """What a stream of JSON lines files leaves in a log."""
    path = shared(spark, "stream")
    rows = ingest.stream(spark, _lines(spark, sf))
    ingest.ingest(rows, f"{path}/log", f"{path}/checkpoint", c.CONFIG4, c._centers(16)).awaitTermination()
    return ingest.log(spark, f"{path}/log").select(F.col("id").cast("long").alias("vec_id"), "content", F.hex("codes").alias("codes"))


# --- binary files ----------------------------------------------------------------------


def _files(spark, sf, suffix: str, encode) -> str:
    """Each task's vectors as a file."""
    path = shared(spark, suffix)

    def put(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        parts = [b.column(0) for b in batches if b.num_rows]
        if parts:
            x = np.concatenate([p.flatten().to_numpy(zero_copy_only=False).reshape(len(p), -1) for p in parts]).astype(np.float32)
            files, folder = file_system(path)
            files.create_dir(folder, recursive=True)
            with files.open_output_stream(f"{folder}/{TaskContext.get().partitionId():05d}.{suffix}") as out:
                out.write(encode(x))
        yield pa.RecordBatch.from_pydict({"n": [len(parts)]})

    c._embeddings(spark, sf).select("embedding").mapInArrow(put, "n long").agg(F.sum("n")).first()
    return path


def fvecs_rows(spark, sf):
    got = vecs.read(spark, _files(spark, sf, "fvecs", vecs.encode))
    return got.select(F.round(F.get("values", F.lit(0)).cast("double"), 6).alias("first"), F.round(F.get("values", F.lit(c.DIM - 1)).cast("double"), 6).alias("last"))


def safetensors_rows(spark, sf):
    got = safetensors.rows(spark, _files(spark, sf, "safetensors", lambda x: safetensors.encode({"w": x, "bias": x[0]})))
    return got.select("tensor", F.round(F.get("values", F.lit(0)), 6).alias("first"), F.round(F.get("values", F.lit(c.DIM - 1)), 6).alias("last"))


def model_weights(spark, sf):
    """How close weights are after they were compressed, and the sizes of what they became."""
    path = _files(spark, sf, "safetensors", lambda x: safetensors.encode({"w": x}))
    rows = safetensors.rows(spark, path)
    packed = model.compress(rows, bits=8)
    both = model.restore(packed, bits=8).withColumnRenamed("values", "back").join(rows, ["file", "tensor", "row"])
    return both.select(F.round(vectors.cosine("back", "values"), c.DIGITS).alias("cosine"))


def model_summary(spark, sf):
    path = _files(spark, sf, "safetensors", lambda x: safetensors.encode({"w": x}))
    got = model.summary(model.compress(safetensors.rows(spark, path), bits=8))
    return got.groupBy("tensor").agg(F.sum("rows").alias("rows"), F.max("cols").alias("cols"), F.sum("bytes").alias("bytes"))


# --- stored indexes and recall ---------------------------------------------------------


def recall_by_bits(spark, sf):
    """Mean recall@10 of 4, 5 and 8 bits against exact search."""
    truth, out = c._truth(spark, sf, c._every), None
    for bits in FEWER:
        config = QuantizerConfig(c.DIM, bits)
        found = search.knn_batch(c._codes(spark, sf, config), c._every(spark, sf), config, digits=c.DIGITS)
        one = metrics.recall(truth, found).agg(F.round(F.avg("recall"), c.DIGITS).alias("recall")).select(F.lit(bits).alias("bits"), "recall")
        out = one if out is None else out.unionByName(one)
    return out


def ivf_sweep(spark, sf):
    """Mean recall@10 by the number of probed partitions."""
    truth, out = c._truth(spark, sf, c._every), None
    rows = ivf.assign(c._codes(spark, sf), c._centers(16), c.CONFIG)
    for probe in PROBES:
        found = ivf.knn_batch(rows, c._centers(16), c._every(spark, sf), c.CONFIG, probe, digits=c.DIGITS)
        one = metrics.recall(truth, found).agg(F.round(F.avg("recall"), c.DIGITS).alias("recall")).select(F.lit(probe).alias("probe"), "recall")
        out = one if out is None else out.unionByName(one)
    return out


def _index(spark, sf, kind: str, **options) -> index.Index:
    return index.create(c._codes(spark, sf), shared(spark, "index"), c.CONFIG, IndexConfig(kind=kind, **options))


def index_recall(spark, sf):
    """Whether searches of stored indexes reach a mean recall@10 of 0.9 against exact search."""
    truth, out = c._truth(spark, sf, c._every), None
    for kind in ("ivf", "hnsw"):
        stored = index.tune(_index(spark, sf, kind), c._embeddings(spark, sf), c._every(spark, sf), digits=c.DIGITS)
        opened = index.open_index(spark, stored.path)
        one = metrics.recall(truth, opened.knn_batch(c._every(spark, sf), digits=c.DIGITS)).agg((F.avg("recall") >= ivf.RECALL).alias("reached"))
        one = one.select(F.lit(opened.kind).alias("kind"), "reached")
        out = one if out is None else out.unionByName(one)
    return out


def index_exhaustive(spark, sf):
    """An inverted file that got half of its rows later finds what a scan finds, if asked for all."""
    codes = c._codes(spark, sf)
    half = index.create(codes.where("vec_id % 2 = 0"), shared(spark, "index"), c.CONFIG, IndexConfig(kind="ivf"))
    half.add(codes.where("vec_id % 2 = 1"))
    return half.knn_batch(c._every(spark, sf), exhaustive=True, digits=c.DIGITS)


def index_plan(spark, sf):
    """The kind of index that is built and the way that searches take."""
    from ..operators import filters as f

    rows = []
    for kind in ("auto", "none", "ivf", "hnsw"):
        made = _index(spark, sf, kind, build_width=32)
        rows.append((kind, made.path_of(), made.path_of(f.eq("label", 3)), made.path_of(exhaustive=True)))
    return spark.createDataFrame(rows, "asked string, way string, filtered string, exhaustive string")


def index_self(spark, sf):
    """One query through every kind of index: the vector itself comes first."""
    out = None
    for kind in ("none", "ivf", "hnsw"):
        one = _index(spark, sf, kind, build_width=32).search(c._one(spark, sf), top_k=1, digits=c.DIGITS).select(F.lit(kind).alias("kind"), "vec_id", "rank")
        out = one if out is None else out.unionByName(one)
    return out


QUERIES = [
    quantize_all_bits, quantize_qr, dequantize_qr_cosine, quantize_exact_density, codebook_levels, packed_codes, unmarshalled_codes, vector_negative, store_round_trip, semantic_search, cache_values, cache_sizes,
    collection_crud, collection_order, collection_info, embedded_documents, jsonl_import, jsonl_export, streaming_ingest, fvecs_rows, safetensors_rows, model_weights, model_summary,
    recall_by_bits, ivf_sweep, index_recall, index_exhaustive, index_plan, index_self,
]


def queries() -> dict:
    return {q.__name__: q for q in QUERIES}


def _codes_sql(config: QuantizerConfig, name: str = "") -> str:
    return f"SELECT vec_id, string_agg(printf('%02X', c), '' ORDER BY j) AS codes FROM kept{name} GROUP BY vec_id"


def _cosine_sql(config: QuantizerConfig) -> str:
    # a rotation keeps angles, so the cosine can be taken in rotated space
    return f"WITH {c._coded(config)} SELECT vec_id, round(sum(r * v) / sqrt(sum(v * v)) / sqrt(sum(r * r)), {c.DIGITS}) AS cosine FROM kept GROUP BY vec_id"


def _product_sql() -> str:
    """Estimated inner products with vector 7: codes of one bit less and signs of projected residuals."""
    from ..operators.quantize import Product

    product = Product(c.CONFIG4)
    r, width = codec.rotation(product.base), product.base.work_dim
    return f"""WITH {c._coded(product.base)},
back AS (SELECT k.vec_id, i, any_value(({c._list(r.first)})[i + 1]) * sum(v * ({c._list(r.second)})[j + 1] * CASE WHEN bit_count(i & j) % 2 = 0 THEN 1 ELSE -1 END) / sqrt({width}) * any_value(CAST(CAST(norm AS FLOAT) AS DOUBLE)) AS x
  FROM kept k JOIN n ON n.vec_id = k.vec_id, range({c.DIM}) t(i) GROUP BY k.vec_id, i),
res AS (SELECT e.vec_id, e.i, e.x - b.x AS d FROM e JOIN back b ON e.vec_id = b.vec_id AND e.i = b.i),
size AS (SELECT vec_id, CAST(CAST(sqrt(sum(d * d)) AS FLOAT) AS DOUBLE) AS s FROM res GROUP BY vec_id),
g AS (SELECT k, i, ({c._list(product.projection.ravel())})[k * {c.DIM} + i + 1] AS m FROM range({c.DIM}) a(k), range({c.DIM}) b(i)),
signs AS (SELECT vec_id, k, CASE WHEN sum(d * m) >= 0 THEN 1 ELSE -1 END AS s FROM res JOIN g ON g.i = res.i GROUP BY vec_id, k),
q AS (SELECT k, sum(m * x) AS p FROM g JOIN e ON e.i = g.i WHERE vec_id = 7 GROUP BY k),
one AS (SELECT b.vec_id, sum(b.x * e.x) AS known FROM back b JOIN e ON e.i = b.i AND e.vec_id = 7 GROUP BY b.vec_id),
two AS (SELECT vec_id, sum(s * p) AS guessed FROM signs JOIN q ON q.k = signs.k GROUP BY vec_id)
SELECT one.vec_id, round(known + {float(product.factor)!r} * size.s * guessed, 4) AS inner FROM one JOIN two ON one.vec_id = two.vec_id JOIN size ON size.vec_id = one.vec_id"""


def oracle_sql() -> dict[str, str]:
    every = f"vec_id % {c.EVERY} = 0"
    base, qr = c._sql(every), QuantizerConfig(c.DIM, 4, rotation=QR)
    sigma = f"sqrt({c.DIM})"
    three, five = QuantizerConfig(c.DIM, 3), QuantizerConfig(c.DIM, 5)
    truth = c._exact(f"a.{every}") + "," + c._top("exact", "truth")
    recalls = " UNION ALL ".join(f"SELECT {b} AS bits, round(avg(recall), {c.DIGITS}) AS recall FROM (SELECT CAST(count(p.rank) AS DOUBLE) / count(*) AS recall FROM truth t LEFT JOIN found{b} p ON t.qid = p.qid AND t.vec_id = p.vec_id GROUP BY t.qid)" for b in FEWER)
    by_bits = ",".join(c._coded(QuantizerConfig(c.DIM, b), f"_{b}") + "," + c._scored(QuantizerConfig(c.DIM, b), f"q.{every}", str(b), f"_{b}") + "," + c._top(f"scored{b}", f"found{b}") for b in FEWER)
    all_bits = ",".join(c._coded(QuantizerConfig(c.DIM, b), f"_{b}") for b in range(1, 9))
    centers = ", ".join(c._list(x) for x in c._centers(16))
    sweep = f"""WITH {truth}, {c._coded(c.CONFIG)}, {c._scored(c.CONFIG, f'q.{every}')},
cen AS (SELECT p, j, ([{centers}])[p + 1][j + 1] AS x FROM range(16) a(p), range({c.DIM}) b(j)),
assigned AS (SELECT vec_id, p FROM (SELECT vec_id, p, row_number() OVER (PARTITION BY vec_id ORDER BY d DESC, p) AS n FROM (SELECT vec_id, p, round(sum(v * x), 9) AS d FROM kept JOIN cen ON kept.j = cen.j GROUP BY vec_id, p)) WHERE n = 1),
near AS (SELECT vec_id AS qid, p, row_number() OVER (PARTITION BY vec_id ORDER BY d DESC, p) AS n FROM (SELECT vec_id, p, round(sum(r * x), 9) AS d FROM rot JOIN cen ON rot.j = cen.j WHERE {every} GROUP BY vec_id, p)),
cand AS (SELECT probe, s.qid, s.vec_id, row_number() OVER (PARTITION BY probe, s.qid ORDER BY score DESC, s.vec_id) AS rank FROM scored s JOIN assigned a ON a.vec_id = s.vec_id JOIN near ON near.qid = s.qid AND near.p = a.p JOIN (SELECT unnest([{', '.join(map(str, PROBES))}]) AS probe) ON n <= probe),
hits AS (SELECT probe, t.qid, count(f.vec_id) / 10.0 AS recall FROM truth t CROSS JOIN (SELECT unnest([{', '.join(map(str, PROBES))}]) AS probe) LEFT JOIN (SELECT probe AS at, qid, vec_id FROM cand WHERE rank <= 10) f ON f.at = probe AND f.qid = t.qid AND f.vec_id = t.vec_id GROUP BY probe, t.qid)
SELECT probe, round(avg(CAST(recall AS DOUBLE)), {c.DIGITS}) AS recall FROM hits GROUP BY probe"""
    first, last = (f"round(CAST(embedding[{i}] AS DOUBLE), 6)" for i in (1, c.DIM))
    return {
        "product_inner": _product_sql(),
        "quantize_all_bits": f"WITH {all_bits} " + " UNION ALL ".join(f"SELECT {b} AS bits, * FROM ({_codes_sql(None, f'_{b}')})" for b in range(1, 9)),
        "quantize_qr": f"WITH {c._coded(qr)} {_codes_sql(qr)}",
        "dequantize_qr_cosine": _cosine_sql(qr),
        "quantize_exact_density": f"WITH {c._coded(QuantizerConfig(c.DIM, 4, exact_pdf=True))} {_codes_sql(None)}",
        # one bit: the mean of half a normal distribution; two bits: the published optimum
        "codebook_levels": "SELECT * FROM (VALUES (1, 0, round(-sqrt(2 / pi()), 3)), (1, 1, round(sqrt(2 / pi()), 3)), (2, 0, -1.51), (2, 1, -0.453), (2, 2, 0.453), (2, 3, 1.51), (0, 0, round(1 - 2 / pi(), 3))) t(bits, level, value)",
        "packed_codes": f"WITH {c._coded(three)}, bytes AS (SELECT vec_id, k, sum(((c >> (p % 3)) & 1) << b) AS v FROM kept JOIN (SELECT k, b, 8 * k + b AS p FROM range(24) x(k), range(8) y(b)) ON j = p // 3 GROUP BY vec_id, k) SELECT vec_id, string_agg(printf('%02X', CAST(v AS INTEGER)), '' ORDER BY k) AS packed FROM bytes GROUP BY vec_id",
        "unmarshalled_codes": f"WITH {c._coded(five)} SELECT k.vec_id, string_agg(printf('%02X', c), '' ORDER BY j) AS codes, round(CAST(CAST(any_value(norm) AS FLOAT) AS DOUBLE), 5) AS norm FROM kept k JOIN n ON k.vec_id = n.vec_id GROUP BY k.vec_id",
        "vector_negative": f"SELECT vec_id, round(-sum(2 * x * x), {c.DIGITS}) AS negative FROM (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY vec_id",
        "store_round_trip": f"SELECT *, 4 AS bits FROM ({base['quantize_codes']})",
        "semantic_search": base["rotated_score_topk"],
        "cache_values": _cosine_sql(c.CONFIG),
        "cache_sizes": f"SELECT label % 2 AS layer, label % 4 AS head, count(*) AS n FROM embeddings GROUP BY 1, 2 UNION ALL SELECT -1, -1, CAST(count(*) * 2 * {c.DIM // 2 + 4} AS BIGINT) FROM embeddings",
        "collection_crud": "SELECT CAST(vec_id AS VARCHAR) AS id, CASE WHEN vec_id % 5 = 0 THEN 'second' WHEN vec_id % 7 = 0 THEN 'third' ELSE 'first ' || label END AS content FROM embeddings",
        "collection_order": "SELECT op, count(*) AS operations, CAST(0 AS BIGINT) AS missing, count(*) AS different, printf('%012d', min(vec_id)) AS first, printf('%012d', max(vec_id)) AS last FROM embeddings CROSS JOIN (VALUES ('add'), ('upsert')) t(op) GROUP BY op",
        "collection_info": f"SELECT count(*) FILTER (WHERE vec_id % 2 = 1) AS documents, count(*) + count(*) FILTER (WHERE vec_id % 2 = 0) AS operations, {c.DIM} AS dim, {c.DIM} AS work_dim, 4 AS bits, CAST({c.DIM} * count(*) FILTER (WHERE vec_id % 2 = 1) AS BIGINT) AS code_bytes FROM embeddings",
        "embedded_documents": f"SELECT CAST(doc_id AS VARCHAR) AS id, CAST(length(coalesce(text, '')) AS INTEGER) AS length, lang, {c.DIM} AS code_bytes FROM documents",
        "jsonl_import": f"SELECT CAST(vec_id AS VARCHAR) AS id, {c.DIM} AS dim, round(CAST(embedding[1] AS DOUBLE), 5) AS x0, 'text ' || label AS content, CAST(label AS VARCHAR) AS label FROM embeddings",
        "jsonl_export": f"WITH {c._coded(c.CONFIG4)} {_codes_sql(c.CONFIG4)}",
        "streaming_ingest": f"WITH {c._coded(c.CONFIG4)}, t AS ({_codes_sql(c.CONFIG4)}) SELECT t.vec_id, 'text ' || label AS content, codes FROM t JOIN embeddings e ON e.vec_id = t.vec_id",
        "fvecs_rows": f"SELECT {first} AS first, {last} AS last FROM embeddings",
        "model_weights": f"SELECT cosine FROM ({_cosine_sql(c.CONFIG)})",
        "model_summary": f"SELECT 'w' AS tensor, count(*) AS rows, {c.DIM} AS cols, CAST(count(*) * {c.DIM + 4} AS BIGINT) AS bytes FROM embeddings",
        "safetensors_rows": f"SELECT 'w' AS tensor, {first} AS first, {last} AS last FROM embeddings",
        "recall_by_bits": f"WITH {truth}, {by_bits} {recalls}",
        "ivf_sweep": sweep,
        "index_recall": "SELECT * FROM (VALUES ('ivf', true), ('hnsw', true)) t(kind, reached)",
        "index_exhaustive": base["knn_batch"],
        "index_plan": "SELECT * FROM (VALUES ('auto', CASE WHEN (SELECT count(*) FROM embeddings) < 10000 THEN 'scan' ELSE 'ivf' END, CASE WHEN (SELECT count(*) FROM embeddings) < 10000 THEN 'filter' ELSE 'ivf' END, 'scan'), ('none', 'scan', 'filter', 'scan'), ('ivf', 'ivf', 'ivf', 'scan'), ('hnsw', 'hnsw', 'filter', 'scan')) t(asked, way, filtered, exhaustive)",
        "index_self": "SELECT kind, CAST(7 AS BIGINT) AS vec_id, 1 AS rank FROM (VALUES ('none'), ('ivf'), ('hnsw')) t(kind)",
    }
