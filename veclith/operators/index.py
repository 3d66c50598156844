"""Stored indexes: pick a kind, build it once, search it by the best path there is.

An index is a folder: ``rows`` has the coded rows (by partition for an inverted file), ``graph``
the shards of a small-world graph, ``centers`` the centroids, ``meta`` what it is. A search takes
the graph if there is one, else the inverted file, and scans where neither is there or a filter
asks for rows that a probe may miss. Rows that are added get a place in the index that is there.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import HNSW, IVF, NONE, IndexConfig, QuantizerConfig
from . import hnsw, ivf
from . import search as _search
from .filters import Filter


@dataclass(frozen=True)
class Index:
    """An index that :func:`create` has written."""

    spark: SparkSession
    path: str
    kind: str
    quantizer: QuantizerConfig
    config: IndexConfig
    probe: int
    id_col: str

    @property
    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    @property
    def centers(self) -> np.ndarray:
        return np.array([r["center"] for r in self.spark.read.parquet(f"{self.path}/centers").orderBy("part").collect()])

    def path_of(self, filter: Filter | None = None, exhaustive: bool = False) -> str:
        """Which way a search takes: hnsw, ivf, filter or scan."""
        if filter is not None:
            return IVF if self.kind == IVF and not exhaustive else "filter"
        return "scan" if exhaustive or self.kind == NONE else self.kind

    def knn_batch(self, queries, k: int = 10, exhaustive: bool = False, digits: int | None = None) -> DataFrame:
        """(qid, id, score, rank) of a query set, see :func:`search.knn_batch`."""
        way = self.path_of(exhaustive=exhaustive)
        if way == HNSW:
            return hnsw.knn_batch(f"{self.path}/graph", queries, self.quantizer, self.config, k, id_col=self.id_col, digits=digits, spark=self.spark)
        if way == IVF:
            return ivf.knn_batch(self.rows, self.centers, queries, self.quantizer, self.probe, k, self.id_col, digits)
        return _search.knn_batch(self.rows, queries, self.quantizer, k, self.id_col, digits=digits)

    def search(self, query, top_k: int = 10, filter: Filter | None = None, exhaustive: bool = False, **options) -> DataFrame:
        """Best rows for one query with score and rank, see :func:`search.search`."""
        way = self.path_of(filter, exhaustive)
        options |= {"id_col": self.id_col}
        if way == HNSW:
            # the graph names candidates, which are then scored like any rows
            most = max(top_k + options.get("offset", 0), options.get("rescore", 0))
            few = [r[0] for r in self.knn_batch([(0, query)], most).select(self.id_col).collect()]
            return _search.search(self.rows.where(F.col(self.id_col).isin(few)), query, self.quantizer, top_k, **options)
        if way == IVF:
            return ivf.search(self.rows, self.centers, query, self.quantizer, self.probe, top_k=top_k, filter=filter, **options)
        return _search.search(self.rows, query, self.quantizer, top_k, filter=filter, **options)

    def add(self, codes: DataFrame) -> None:
        """Add coded rows: to their nearest partitions, or as shards of their own."""
        if self.kind == IVF:
            ivf.assign(codes, self.centers, self.quantizer).write.mode("append").partitionBy("ivf_part").parquet(f"{self.path}/rows")
            return
        if self.kind == HNSW:
            last = hnsw.read(self.spark, f"{self.path}/graph").agg(F.max("shard")).first()[0]
            hnsw.write(hnsw.build(codes, self.quantizer, self.config, self.id_col, 0 if last is None else last + 1), f"{self.path}/graph", "append")
        codes.write.mode("append").parquet(f"{self.path}/rows")


def create(codes: DataFrame, path: str, quantizer: QuantizerConfig, config: IndexConfig | None = None, id_col: str = "vec_id") -> Index:
    """Pick the kind for so many rows, build it, write it to ``path``; ``meta`` comes last.

    Codes are written first and everything is built from what was written. An inverted file
    probes ``config.probe`` partitions or, if that is 0, as many as the size suggests;
    :func:`tune` measures them.
    """
    config, spark = config or IndexConfig(), codes.sparkSession
    codes.write.parquet(f"{path}/coded")
    codes = spark.read.parquet(f"{path}/coded")
    n = codes.count()
    kind, probe = ivf.choose(n, config), 0
    if kind == IVF:
        centers = ivf.train(codes, quantizer, config, id_col)
        probe = min(len(centers), ivf.sizes(n, config)[1])
        ivf.write(codes, path, centers, quantizer)
    else:
        codes.write.parquet(f"{path}/rows")
    if kind == HNSW:
        hnsw.write(hnsw.build(codes, quantizer, config, id_col), f"{path}/graph")
    index = Index(spark, path, kind, quantizer, config, probe, id_col)
    _describe(index)
    return index


def _describe(index: Index) -> None:
    meta = {"kind": index.kind, "quantizer": asdict(index.quantizer), "config": asdict(index.config), "probe": index.probe, "id_col": index.id_col}
    index.spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{index.path}/meta")


def open_index(spark: SparkSession, path: str) -> Index:
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    return Index(spark, path, meta["kind"], QuantizerConfig(**meta["quantizer"]), IndexConfig(**meta["config"]), meta["probe"], meta["id_col"])


def tune(index: Index, vectors: DataFrame, queries: DataFrame, k: int = 10, target: float = ivf.RECALL, digits: int | None = None) -> Index:
    """An inverted file with as many probes as a measured recall of ``target`` takes; others as they are."""
    if index.kind != IVF:
        return index
    tuned = replace(index, probe=ivf.probes_for(index.rows, index.centers, vectors, queries, index.quantizer, k, target, index.id_col, digits))
    _describe(tuned)
    return tuned
