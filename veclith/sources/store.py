"""Stores: coded vectors as immutable Parquet with their quantizer beside them."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession

from ..config import QuantizerConfig

VERSION = 1


def write(codes: DataFrame, path: str, config: QuantizerConfig, sort_by: list[str] | None = None) -> None:
    """Write rows and then the quantizer; a store without the latter isn't complete.

    Sorting within files by columns that filters use lets scans skip row groups.
    """
    spark = codes.sparkSession
    rows = codes.sortWithinPartitions(*sort_by) if sort_by else codes
    rows.write.mode("errorifexists").parquet(f"{path}/rows")
    spark.createDataFrame([(json.dumps({"version": VERSION, **asdict(config)}),)], "value string").coalesce(1).write.text(f"{path}/quantizer")


def read(spark: SparkSession, path: str) -> tuple[DataFrame, QuantizerConfig]:
    meta = json.loads(spark.read.text(f"{path}/quantizer").first()[0])
    if meta.pop("version") != VERSION:
        raise ValueError("unknown version")
    return spark.read.parquet(f"{path}/rows"), QuantizerConfig(**meta)
