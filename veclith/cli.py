"""Command line over stored collections: ``python -m veclith.cli COMMAND``, or by ``spark-submit``.

    init --dim N [--bits B] [--rotation hadamard|qr]
    import FILES.jsonl [--index auto|ivf|hnsw|none]
    search QUERY.json [--top-k K] [--offset N] [--min-score S] [--rescore R] [--where KEY=VALUE]
    info, count, export FOLDER [--no-vectors] [--limit N], bench [--queries N], version

A collection is a folder with a log of operations, its quantizer, and the index of its last
import; ``--path`` names it, or the environment in ``VECLITH_PATH``.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
import time

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .config import HADAMARD, QR, IndexConfig, QuantizerConfig
from .operators import filters, index, search
from .operators.collection import Collection
from .sources import jsonl

VERSION = "0.2"


def _session() -> SparkSession:
    return SparkSession.builder.appName("veclith").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def _open(spark: SparkSession, path: str) -> Collection:
    meta = json.loads(spark.read.text(f"{path}/quantizer").first()[0])
    return Collection(spark, path, QuantizerConfig(**meta))


def _last_index(spark: SparkSession, path: str) -> str:
    return spark.read.text(f"{path}/current").first()[0]


def init(spark: SparkSession, path: str, dim: int, bits: int = 8, rotation: str = HADAMARD) -> None:
    """Make a collection; one that is there raises an error."""
    config = QuantizerConfig(dim, bits, rotation=rotation)
    meta = {"dim": config.dim, "bits": config.bits, "seed": config.seed, "rotation": config.rotation, "exact_pdf": config.exact_pdf}
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.text(f"{path}/quantizer")


def load(spark: SparkSession, path: str, source: str, kind: str = "auto") -> dict:
    """Add the records of JSON lines files and build the index anew; returns how many were added and skipped."""
    held = _open(spark, path)
    docs = jsonl.read(spark, source, held.config.dim)
    before = held.count()
    held.add(docs)
    live = held.live().drop("seq")
    # a new folder each time; the name of the last one is what searches read
    target = f"{path}/index/{time.time_ns()}"
    made = index.create(live.withColumnRenamed("id", "vec_id"), target, held.config, IndexConfig(kind=kind))
    spark.createDataFrame([(target,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/current")
    return {"added": held.count() - before, "skipped": jsonl.skipped(spark, source, held.config.dim), "index": made.kind}


def find(spark: SparkSession, path: str, query: list[float], top_k: int = 10, offset: int = 0, min_score: float = 0.0, rescore: int = 0, where: str | None = None) -> list[dict]:
    """Best documents for a vector; ``where`` is KEY=VALUE over their metadata."""
    opened = index.open_index(spark, _last_index(spark, path))
    if where is None:
        found = opened.search(query, top_k, offset=offset, min_score=min_score, rescore=rescore)
    else:
        key, _, value = where.partition("=")
        try:
            value = json.loads(value)
        except ValueError:
            pass  # not JSON: a string as it is
        rows = opened.rows.withColumn("data", F.try_parse_json("data"))
        found = search.search(rows, query, opened.quantizer, top_k, offset, min_score, filters.eq(key, value), rescore, variant="data").withColumn("data", F.to_json("data"))
    rows = found.orderBy("rank").select("rank", F.col("vec_id").alias("id"), "score", "content", "data").collect()
    return [r.asDict() for r in rows]


def bench(spark: SparkSession, path: str, queries: int = 20) -> dict:
    """Seconds of searches for random vectors, one at a time and as a batch."""
    opened = index.open_index(spark, _last_index(spark, path))
    x = np.random.default_rng(0).standard_normal((queries, opened.quantizer.dim))
    opened.search(x[0]).collect()
    times = []
    for q in x:
        began = time.perf_counter()
        opened.search(q).collect()
        times.append(time.perf_counter() - began)
    began = time.perf_counter()
    opened.knn_batch(list(enumerate(x))).write.format("noop").mode("overwrite").save()
    batch = time.perf_counter() - began
    # the element at place p * n / 100 of the sorted times
    at = lambda p: sorted(times)[min(len(times) - 1, len(times) * p // 100)]
    return {"p50": at(50), "p95": at(95), "p99": at(99), "qps": queries / sum(times), "batch_qps": queries / batch}


def main(arguments: list[str] | None = None, spark: SparkSession | None = None, out=sys.stdout) -> int:
    """Run a command; results are lines of JSON on ``out``."""
    known = argparse.ArgumentParser(prog="veclith")
    commands = known.add_subparsers(dest="command", required=True)
    home = os.environ.get("VECLITH_PATH")

    def command(name: str):
        own = commands.add_parser(name)
        own.add_argument("--path", default=home, required=home is None)
        return own

    own = command("init")
    own.add_argument("--dim", type=int, required=True)
    own.add_argument("--bits", type=int, default=8)
    own.add_argument("--rotation", choices=(HADAMARD, QR), default=HADAMARD)
    own = command("import")
    own.add_argument("source")
    own.add_argument("--index", default="auto", choices=("auto", "ivf", "hnsw", "none"))
    own = command("search")
    own.add_argument("query")
    for name, kind, usual in (("--top-k", int, 10), ("--offset", int, 0), ("--min-score", float, 0.0), ("--rescore", int, 0)):
        own.add_argument(name, type=kind, default=usual)
    own.add_argument("--where")
    command("info")
    command("count")
    own = command("export")
    own.add_argument("folder")
    own.add_argument("--no-vectors", action="store_true")
    own.add_argument("--limit", type=int)
    own = command("bench")
    own.add_argument("--queries", type=int, default=20)
    commands.add_parser("version")
    asked = known.parse_args(arguments)
    say = lambda x: print(json.dumps(x), file=out)
    if asked.command == "version":
        say({"version": VERSION})
        return 0
    spark = spark or _session()
    if asked.command == "init":
        init(spark, asked.path, asked.dim, asked.bits, asked.rotation)
    elif asked.command == "import":
        say(load(spark, asked.path, asked.source, asked.index))
    elif asked.command == "search":
        with open(asked.query) as f:
            query = json.load(f)
        for row in find(spark, asked.path, query, asked.top_k, asked.offset, asked.min_score, asked.rescore, asked.where):
            say(row)
    elif asked.command == "info":
        say(_open(spark, asked.path).info().first().asDict() | {"index": index.open_index(spark, _last_index(spark, asked.path)).kind})
    elif asked.command == "count":
        say({"count": _open(spark, asked.path).count()})
    elif asked.command == "export":
        jsonl.write(_open(spark, asked.path).live(), asked.folder, not asked.no_vectors, asked.limit)
    elif asked.command == "bench":
        say(bench(spark, asked.path, asked.queries))
    return 0


if __name__ == "__main__":
    sys.exit(main())
