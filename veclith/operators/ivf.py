"""Inverted-file index: vectors by nearest centroid, a search reads a few partitions.

Training is k-means with assignment by dot product. Seeding works on a bounded sample;
every round after it is a pass over all rows that sends one partial sum a task and partition
to the driver. The index is the data again, written by partition, so a probe is a partition
filter of the scan.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import AUTO, HNSW, IVF, NONE, IndexConfig, QuantizerConfig
from ..functions import codec
from . import search as _search
from .quantize import _apply, code_matrix, unit

#: Rows from which seeds are drawn, a bound that doesn't depend on the data's size.
SEED_ROWS = 20_000
ROUNDS = 20
#: Queries at most by which :func:`probes_for` measures, and the recall that it looks for.
TUNE_QUERIES, RECALL = 1000, 0.9
AUTO_ROWS, LEAST_ROWS = 10_000, 100


def choose(rows: int, config: IndexConfig) -> str:
    """The kind of index for so many rows."""
    kind = config.kind
    if kind == AUTO:
        kind = NONE if rows < AUTO_ROWS else IVF
    return NONE if kind == IVF and rows < LEAST_ROWS else kind if kind in (IVF, HNSW) else NONE


def sizes(rows: int, config: IndexConfig) -> tuple[int, int]:
    """Partitions and how many a search probes."""
    partitions = config.partitions or max(4, math.isqrt(rows))
    return partitions, config.probe or max(1, math.isqrt(partitions))


def _seeds(x: np.ndarray, count: int, seed: int) -> np.ndarray:
    """k-means++: each next seed in proportion to its squared distance to the seeds so far; fewer if rows run out."""
    random, chosen = np.random.default_rng(seed), [0]
    far = ((x - x[0]) ** 2).sum(1)
    while len(chosen) < count and far.sum() > 0:
        chosen.append(int(random.choice(len(x), p=far / far.sum())))
        far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(1))
    return x[chosen]


def train(codes: DataFrame, config: QuantizerConfig, index: IndexConfig, id_col: str = "vec_id") -> np.ndarray:
    """Centroids in rotated space, one row each."""
    rows = codes.count()
    if not rows:
        return np.zeros((0, config.work_dim))
    count, _ = sizes(rows, index)
    levels = codec.codebook(config.work_dim, config.bits, config.exact_pdf)[0]
    some = codes.select("codes", id_col).orderBy(F.xxhash64(id_col), id_col).limit(SEED_ROWS).select("codes").toArrow()
    x = levels[code_matrix(some.column("codes").combine_chunks(), config.work_dim)]
    centers = _seeds(x, count, index.seed)
    for _ in range(ROUNDS):
        shared = codes.sparkSession.sparkContext.broadcast(centers)

        def sums(batches, shared=shared):
            import pyarrow as pa

            c = shared.value
            total, number = np.zeros(c.shape), np.zeros(len(c), np.int64)
            for batch in batches:
                for start in range(0, batch.num_rows, 4096):
                    x = levels[code_matrix(batch.column(0).slice(start, 4096), config.work_dim)]
                    near = (x @ c.T).argmax(1)
                    np.add.at(total, near, x)
                    number += np.bincount(near, minlength=len(c))
            have = np.flatnonzero(number)
            yield pa.RecordBatch.from_pydict({"part": have.astype(np.int32), "n": number[have], "total": list(total[have])})

        parts = codes.select("codes").mapInArrow(sums, "part int, n long, total array<double>")
        # summed by position on the executors: one row a partition comes back
        merged = parts.groupBy("part").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.get("total", F.lit(i))) for i in range(config.work_dim))).alias("total")).orderBy("part").toPandas()
        new = centers.copy()
        for part, n, total in merged.itertuples(index=False):
            new[part] = np.array(total) / n
        if np.allclose(new, centers, rtol=0, atol=1e-12):
            break
        centers = new
    return centers


def assign(codes: DataFrame, centers: np.ndarray, config: QuantizerConfig) -> DataFrame:
    """``codes`` with ``ivf_part``, the centroid with the highest dot product, the first of equal ones."""
    levels = codec.codebook(config.work_dim, config.bits, config.exact_pdf)[0]
    shared = codes.sparkSession.sparkContext.broadcast(centers)

    def make(batch):
        import pyarrow as pa

        near = [np.round(levels[code_matrix(batch.column("codes").slice(s, 4096), config.work_dim)] @ shared.value.T, 9).argmax(1) for s in range(0, batch.num_rows, 4096)]
        return (pa.array(np.concatenate(near).astype(np.int32)),)

    return _apply(codes, ("ivf_part",), "ivf_part int", make)


def write(codes: DataFrame, path: str, centers: np.ndarray, config: QuantizerConfig) -> None:
    """Write the index: rows by partition, and the centroids beside them."""
    spark = codes.sparkSession
    assign(codes, centers, config).write.mode("overwrite").partitionBy("ivf_part").parquet(f"{path}/rows")
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centers)], "part int, center array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centers")


def read(spark: SparkSession, path: str) -> tuple[DataFrame, np.ndarray]:
    rows = spark.read.parquet(f"{path}/centers").orderBy("part").collect()
    return spark.read.parquet(f"{path}/rows"), np.array([r["center"] for r in rows])


def probed(centers: np.ndarray, query, config: QuantizerConfig, probe: int) -> list[int]:
    """The partitions to read for a query, nearest first."""
    q = codec.rotation(config).forward(unit(np.asarray(query, np.float64)[None])[0])[0]
    return np.argsort(-np.round(centers @ q, 9), kind="stable")[:probe].tolist()


def search(rows: DataFrame, centers: np.ndarray, query, config: QuantizerConfig, probe: int, exhaustive: bool = False, **options) -> DataFrame:
    """:func:`search.search` over the probed partitions; fewer than top_k rows may pass a filter there.

    ``exhaustive`` reads all partitions.
    """
    some = rows if exhaustive else rows.where(F.col("ivf_part").isin(probed(centers, query, config, probe)))
    return _search.search(some, query, config, **options)


def knn_batch(rows: DataFrame, centers: np.ndarray, queries, config: QuantizerConfig, probe: int, k: int = 10, id_col: str = "vec_id", digits: int | None = None) -> DataFrame:
    """(qid, id, score, rank): each query against its own probed partitions, one pass over the rows."""
    out = None
    for qids, q in _search._queries(queries):
        one = _search._ranked(_probed_batch(rows, centers, qids, q, config, probe, k, id_col, digits), id_col, k)
        out = one if out is None else out.unionByName(one)
    return out if out is not None else _search._ranked(_probed_batch(rows.limit(0), centers, [0], np.zeros((1, config.dim)), config, probe, k, id_col, digits), id_col, k)


def _order(centers: np.ndarray, q: np.ndarray, config: QuantizerConfig) -> np.ndarray:
    """For each query the partitions, nearest first."""
    return np.argsort(-np.round(codec.rotation(config).forward(unit(q)[0]) @ centers.T, 9), axis=1, kind="stable")


def probes_for(rows: DataFrame, centers: np.ndarray, vectors: DataFrame, queries: DataFrame, config: QuantizerConfig, k: int = 10, target: float = RECALL, id_col: str = "vec_id", digits: int | None = None) -> int:
    """The fewest partitions to probe for a mean recall@k of ``target`` against exact search over ``vectors``.

    Measured on ``queries`` (id, vector), of more than TUNE_QUERIES on those that a hash of
    their ids picks. A true row that a scan of all codes finds is found as soon as its
    partition is probed, so one scan bounds the recall of every number of probes from below.
    """
    some = queries.orderBy(F.xxhash64(queries.columns[0]), queries.columns[0]).limit(TUNE_QUERIES)
    asked = [(r[0], r[1]) for r in some.collect()]
    if not asked or not len(centers):
        return len(centers)
    truth = _search.exact_batch(vectors, asked, k, id_col, some.columns[1], digits)
    scanned = _search.knn_batch(rows, asked, config, k, id_col, digits=digits).select("qid", id_col, F.lit(True).alias("scanned"))
    found = truth.join(scanned, ["qid", id_col], "left").join(rows.select(id_col, "ivf_part"), id_col).select("qid", "ivf_part", "scanned").toPandas()
    order = _order(centers, np.array([q for _, q in asked], np.float64), config)
    places = dict(zip((q for q, _ in asked), np.argsort(order, axis=1), strict=True))
    at = np.array([places[q][p] for q, p, s in found.itertuples(index=False) if s is True], np.int64)
    reached = np.cumsum(np.bincount(at, minlength=len(centers))) >= target * len(found)
    return int(reached.argmax()) + 1 if reached.any() else len(centers)


def _probed_batch(rows: DataFrame, centers: np.ndarray, qids: list, q: np.ndarray, config: QuantizerConfig, probe: int, k: int, id_col: str, digits: int | None) -> DataFrame:
    """(qid, id, score): for each batch and query its k best rows of the probed partitions."""
    rotated, near = codec.rotation(config).forward(unit(q)[0]), _order(centers, q, config)[:, :probe]
    of = [np.flatnonzero((near == p).any(1)) for p in range(len(centers))]
    levels = codec.codebook(config.work_dim, config.bits, config.exact_pdf)[0]
    shared = rows.sparkSession.sparkContext.broadcast((rotated, np.array(qids, np.int64), of))
    kind = dict(rows.dtypes)[id_col]

    def run(batches):
        import pyarrow as pa

        q, names, of = shared.value
        best = _search.Running(len(q), k, 0.0, digits)
        for batch in batches:
            ids, parts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2).to_numpy()
            for p in np.unique(parts):
                if not len(of[p]):
                    continue
                own = np.flatnonzero(parts == p)
                for start in range(0, len(own), _search._PIECE):
                    some = own[start : start + _search._PIECE]
                    values = levels[code_matrix(batch.column(1).take(pa.array(some)), config.work_dim)]
                    for tile in range(0, len(of[p]), _search._TILE):
                        asked = of[p][tile : tile + _search._TILE]
                        best.add(values @ q[asked].T, ids[some], [batch.column(0).take(pa.array(some))], asked)
        if (found := best.rows()) is not None:
            who, scores, more = found
            yield pa.RecordBatch.from_arrays([pa.array(names[who]), more[0], pa.array(scores)], names=["qid", id_col, "score"])

    # partitions that no query of this block probes aren't read
    probed_parts = [p for p in range(len(centers)) if len(of[p])]
    rows = rows.where(F.col("ivf_part").isin(probed_parts)) if len(probed_parts) < len(centers) else rows
    return rows.select(id_col, "codes", "ivf_part").mapInArrow(run, f"qid long, `{id_col}` {kind}, score double")
