"""Incremental ingest: files that arrive become operations of a collection, exactly once a batch."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import QuantizerConfig
from ..operators import ivf
from ..operators.quantize import quantize
from ..sources.jsonl import SCHEMA


def stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """(id, embedding, content, data) of JSON lines files as they arrive."""
    rows = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).json(folder)
    return rows.select("id", F.col("vector").alias("embedding"), "content", F.col("metadata").alias("data"))


def ingest(rows: DataFrame, path: str, checkpoint: str, config: QuantizerConfig, centers: np.ndarray | None = None, op: str = "add") -> StreamingQuery:
    """Write each batch's coded rows to ``path/batch=<n>``; a batch that runs again overwrites its own folder.

    With ``centers`` rows get the partition of their nearest centroid, so an existing index
    stays usable. Vectors of another dimension are skipped. Ends when no file is left.
    """

    def put(batch: DataFrame, number: int) -> None:
        coded = quantize(batch.where(F.size("embedding") == config.dim), config)
        if centers is not None:
            coded = ivf.assign(coded, centers, config)
        coded.withColumn("op", F.lit(op)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def log(spark: SparkSession, path: str) -> DataFrame:
    """The batches as a collection's log: seq orders by batch, then by id."""
    from pyspark.sql import Window as W

    rows = spark.read.option("basePath", path).parquet(path)
    # a batch is bounded, its number and a place in it make a number that always grows
    place = F.row_number().over(W.partitionBy("batch").orderBy("id")) - 1
    return rows.withColumn("seq", F.shiftleft(F.col("batch").cast("long"), 32) + place).drop("batch")
