"""Navigable small-world graphs, one a shard.

A graph is built and walked in order, which is work for one task; so rows are dealt into
shards of bounded size by a hash of the id, each task builds the graph of its shard, and a
search walks all shards with the same width and merges. More shards cost more work and
raise recall. The index is a table with a row a node, written a folder a shard.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import IndexConfig, QuantizerConfig
from ..functions import codec
from ..storage import file_system
from . import search as _search
from .quantize import code_matrix, unit

SHARD_ROWS = 5000


class Graph:
    """Layers of neighbours over the rows of ``x``; closer is a higher dot product."""

    def __init__(self, x: np.ndarray, config: IndexConfig, links: list[list[np.ndarray]] | None = None):
        self.x, self.most, self.width = x, config.neighbours, config.build_width
        self.links: list[list] = links or []
        self.entry = int(np.argmax([len(n) for n in self.links])) if self.links else -1
        if links is None:
            random = np.random.default_rng(config.seed)
            for i in range(len(x)):
                self._add(i, int(-math.log(1 - random.random()) / math.log(max(2, self.most))))

    def _walk(self, q: np.ndarray, start: list[int], width: int, level: int) -> list[tuple[float, int]]:
        """The ``width`` closest nodes that greedy walks from ``start`` meet, closest first."""
        seen = set(start)
        first = [(float(self.x[i] @ q), i) for i in start]
        ahead = [(-s, i) for s, i in first]
        best = list(first)
        heapq.heapify(ahead)
        heapq.heapify(best)
        while ahead:
            score, i = heapq.heappop(ahead)
            if len(best) >= width and -score < best[0][0]:
                break
            new = [j for j in self.links[i][level] if j not in seen]
            if not new:
                continue
            seen.update(new)
            for s, j in zip((self.x[new] @ q).tolist(), new, strict=True):
                if len(best) < width or s > best[0][0]:
                    heapq.heappush(ahead, (-s, j))
                    heapq.heappush(best, (s, j))
                    if len(best) > width:
                        heapq.heappop(best)
        return sorted(best, key=lambda p: (-p[0], p[1]))

    def _spread(self, near: list[tuple[float, int]], most: int) -> list[int]:
        """Neighbours that are closer to the node than to one another, filled up with the nearest."""
        kept: list[int] = []
        for s, j in near:
            if len(kept) < most and all(float(self.x[j] @ self.x[i]) < s for i in kept):
                kept.append(j)
        return kept + [j for _, j in near if j not in kept][: most - len(kept)]

    def _add(self, i: int, level: int) -> None:
        self.links.append([[] for _ in range(level + 1)])
        if self.entry < 0:
            self.entry = i
            return
        q, at, top = self.x[i], [self.entry], len(self.links[self.entry]) - 1
        for layer in range(top, level, -1):
            at = [self._walk(q, at, 1, layer)[0][1]]
        for layer in range(min(top, level), -1, -1):
            near = self._walk(q, at, self.width, layer)
            most = self.most * (2 if layer == 0 else 1)
            for j in (mine := self._spread(near, self.most)):
                own = self.links[j][layer]
                own.append(i)
                if len(own) > most:
                    scores = self.x[own] @ self.x[j]
                    self.links[j][layer] = self._spread(sorted(zip(scores.tolist(), own, strict=True), key=lambda p: (-p[0], p[1])), most)
            self.links[i][layer] = mine
            at = [j for _, j in near]
        if level > top:
            self.entry = i

    def search(self, q: np.ndarray, k: int, width: int, gone: np.ndarray | None = None) -> list[tuple[float, int]]:
        """The k closest nodes; those in ``gone`` are walked through and not returned."""
        if self.entry < 0:
            return []
        at = [self.entry]
        for layer in range(len(self.links[self.entry]) - 1, 0, -1):
            at = [self._walk(q, at, 1, layer)[0][1]]
        found = self._walk(q, at, max(width, k), 0)
        return [p for p in found if gone is None or not gone[p[1]]][:k]


def _sharded(codes: DataFrame, id_col: str, first: int) -> DataFrame:
    count = max(1, -(-codes.count() // SHARD_ROWS))
    return codes.select(id_col, "codes", (F.pmod(F.xxhash64(id_col), F.lit(count)) + first).cast("int").alias("shard"))


def build(codes: DataFrame, config: QuantizerConfig, index: IndexConfig, id_col: str = "vec_id", first: int = 0) -> DataFrame:
    """A row a node: id, codes, shard, node, links (array of layers of node numbers); shards are numbered from ``first`` on."""
    levels = codec.codebook(config.work_dim, config.bits, config.exact_pdf)[0]
    rows = _sharded(codes, id_col, first)
    kind = dict(codes.dtypes)[id_col]

    def graph(key, table):
        import pyarrow as pa

        table = table.sort_by(id_col)
        x = unit(levels[code_matrix(table.column("codes").combine_chunks(), config.work_dim)])[0]
        links = Graph(x, index).links
        plain = [[[int(j) for j in layer] for layer in node] for node in links]
        return pa.table([table.column(id_col), table.column("codes"), table.column("shard"), pa.array(np.arange(len(x), dtype=np.int32)), pa.array(plain, pa.list_(pa.list_(pa.int32())))], names=[id_col, "codes", "shard", "node", "links"])

    return rows.groupBy("shard").applyInArrow(graph, f"`{id_col}` {kind}, codes binary, shard int, node int, links array<array<int>>")


def write(nodes: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write the graphs of :func:`build`, a folder a shard; ``append`` adds shards that aren't there yet."""
    nodes.repartition("shard").sortWithinPartitions("shard", "node").write.mode(mode).partitionBy("shard").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The nodes of a written index."""
    return spark.read.parquet(path)


def knn_batch(nodes: DataFrame | str, queries, config: QuantizerConfig, index: IndexConfig | None = None, k: int = 10, width: int = 0, id_col: str = "vec_id", gone: DataFrame | None = None, digits: int | None = None, spark: SparkSession | None = None) -> DataFrame:
    """(qid, id, score, rank) from the graphs of :func:`build`; rows of ``gone`` (ids) are not returned.

    ``nodes`` is a DataFrame, whose shards are brought together by a shuffle, or the path of a
    written index, of which each task reads the shards it walks and nothing is shuffled.
    ``width`` of 0 is 10 * k, 100 at least.
    """
    index = index or IndexConfig()
    walk = (lambda qids, q: _walked_files(spark or SparkSession.getActiveSession(), nodes, qids, q, config, index, k, width, id_col, gone, digits)) if isinstance(nodes, str) else (lambda qids, q: _walked(nodes, qids, q, config, index, k, width, id_col, gone, digits))
    out = None
    for qids, q in _search._queries(queries):
        one = _search._ranked(walk(qids, q), id_col, k)
        out = one if out is None else out.unionByName(one)
    return out if out is not None else _search._ranked(walk([0], np.zeros((1, config.dim))).limit(0), id_col, k)


def _walker(qs: np.ndarray, names: list, config: QuantizerConfig, index: IndexConfig, k: int, width: int, id_col: str, digits: int | None):
    """A function of a shard's table (id, codes, node, links, gone) that returns (qid, id, score) as a table."""
    levels = codec.codebook(config.work_dim, config.bits, config.exact_pdf)[0]

    def walk(table):
        import pyarrow as pa

        table = table.sort_by("node")
        values = levels[code_matrix(table.column("codes").combine_chunks(), config.work_dim)]
        graph = Graph(unit(values)[0], index, [[np.array(layer, np.int64) for layer in node] for node in table.column("links").to_pylist()])
        out, ids = table.column("gone").to_numpy(), table.column(id_col)
        rows = [(name, j, float(values[j] @ q)) for q, name in zip(qs, names, strict=True) for _, j in graph.search(q, k, width, out)]
        who, place, score = zip(*rows, strict=True) if rows else ((), (), ())
        score = np.array(score, np.float64)
        return pa.table([pa.array(who, pa.int64()), ids.take(pa.array(place, pa.int64())), pa.array(score if digits is None else np.round(score, digits))], names=["qid", id_col, "score"])

    return walk


def _walked(nodes: DataFrame, qids: list, q: np.ndarray, config: QuantizerConfig, index: IndexConfig, k: int, width: int, id_col: str, gone: DataFrame | None, digits: int | None) -> DataFrame:
    """(qid, id, score): for each shard and query what the walk finds."""
    rotated, width = codec.rotation(config).forward(unit(q)[0]), width or max(100, 10 * k)
    shared = nodes.sparkSession.sparkContext.broadcast((rotated, qids))
    kind = dict(nodes.dtypes)[id_col]
    marked = nodes.withColumn("gone", F.lit(False)) if gone is None else nodes.join(gone.select(id_col, F.lit(True).alias("gone")).distinct(), id_col, "left").fillna({"gone": False})

    def walk(key, table):
        return _walker(*shared.value, config, index, k, width, id_col, digits)(table)

    return marked.groupBy("shard").applyInArrow(walk, f"qid long, `{id_col}` {kind}, score double")


def _walked_files(spark: SparkSession, path: str, qids: list, q: np.ndarray, config: QuantizerConfig, index: IndexConfig, k: int, width: int, id_col: str, gone: DataFrame | None, digits: int | None) -> DataFrame:
    """:func:`_walked` over a written index: a row of work a shard."""
    from pyarrow import fs

    rotated, width = codec.rotation(config).forward(unit(q)[0]), width or max(100, 10 * k)
    files, place = file_system(path)
    shards = sorted(int(i.base_name.partition("=")[2]) for i in files.get_file_info(fs.FileSelector(place)) if i.base_name.startswith("shard="))
    shared = spark.sparkContext.broadcast((rotated, qids))
    kind = dict(read(spark, path).dtypes)[id_col]

    def walk(batches):
        import pyarrow as pa
        import pyarrow.dataset as ds

        for batch in batches:
            for shard in batch.column(0).to_pylist():
                files, place = file_system(f"{path}/shard={shard}")
                table = ds.dataset(place, filesystem=files, format="parquet").to_table(use_threads=False)
                table = table.append_column("gone", pa.array(np.zeros(table.num_rows, bool)))
                yield from _walker(*shared.value, config, index, k if gone is None else width, width, id_col, digits)(table).to_batches()

    work = spark.createDataFrame([(s,) for s in shards], "shard int").repartition(max(1, len(shards)))
    found = work.mapInArrow(walk, f"qid long, `{id_col}` {kind}, score double")
    # deleted rows are walked through and go afterwards
    return found if gone is None else found.join(gone.select(id_col).distinct(), id_col, "left_anti").select("qid", id_col, "score")
