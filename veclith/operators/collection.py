"""Mutable collections as an append-only log of operations.

A row is ``seq, op, id, content, data, codes, norm``; op is add, upsert or delete, and seq
grows with every row. The live row of an id comes from the operations after its last delete:
the last upsert, or else the first add. One window over the id finds it, and compaction
writes what it finds, so a search reads compacted rows only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import QuantizerConfig
from .quantize import quantize

#: DDL of the log; data is a JSON object or null.
SCHEMA = "seq long, op string, id string, content string, data string, codes binary, norm float"

#: A sequence number has a batch in its upper bits, then a partition, then a row of it.
_PARTITION_BITS, _ROW_BITS = 17, 26


def live(log: DataFrame) -> DataFrame:
    """The live row of each id; its seq is its place in insertion order."""
    w = W.partitionBy("id")
    gone = F.coalesce(F.max(F.when(F.col("op") == "delete", F.col("seq"))).over(w), F.lit(-1).cast("long"))
    rows = log.withColumn("_gone", gone).where((F.col("op") != "delete") & (F.col("seq") > F.col("_gone")))
    upsert = F.col("op") == "upsert"
    order = [F.when(upsert, 0).otherwise(1), F.when(upsert, -F.col("seq")).otherwise(F.col("seq"))]
    return rows.withColumn("_n", F.row_number().over(w.orderBy(*order))).where("_n = 1").drop("_n", "_gone", "op")


@dataclass(frozen=True)
class Collection:
    """A log in a folder. Writes append; a writer at a time gives increasing batch numbers."""

    spark: SparkSession
    path: str
    config: QuantizerConfig

    def log(self) -> DataFrame:
        try:
            return self.spark.read.schema(SCHEMA).parquet(f"{self.path}/log")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], SCHEMA)

    def _append(self, rows: DataFrame, op: str, order_col: str) -> None:
        """Append rows; numbers follow ``order_col``, not how rows are dealt over tasks.

        A number is (batch, partition, row), packed, given by the one job that writes: however
        the range shuffle is coalesced, partitions stay in order and rows in theirs.
        """
        last = self.log().agg(F.max("seq")).first()[0]
        batch = 0 if last is None else (last >> _PARTITION_BITS + _ROW_BITS) + 1
        if batch >= 1 << 63 - _PARTITION_BITS - _ROW_BITS:
            raise ValueError("too many batches")
        ordered = rows.repartitionByRange(order_col).sortWithinPartitions(order_col).withColumn("_place", F.monotonically_increasing_id())
        part, row = F.shiftright("_place", 33), F.col("_place").bitwiseAND((1 << 33) - 1)
        packed = F.lit(batch << _PARTITION_BITS + _ROW_BITS).cast("long").bitwiseOR(F.shiftleft(part, _ROW_BITS)).bitwiseOR(row)
        fits = (part < 1 << _PARTITION_BITS) & (row < 1 << _ROW_BITS)
        numbered = ordered.withColumn("seq", F.when(fits, packed).otherwise(F.raise_error(F.lit("too many rows in a partition")).cast("long")))
        named = [F.col(c) if c in numbered.columns else F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in SCHEMA.split(", ")) if c != "op"]
        numbered.select(*named).withColumn("op", F.lit(op)).select(*(x.split()[0] for x in SCHEMA.split(", "))).write.mode("append").parquet(f"{self.path}/log")

    def add(self, docs: DataFrame, order_col: str = "id", vector_col: str = "embedding") -> None:
        """Add documents; those whose id is live stay as they are."""
        self._append(quantize(docs, self.config, vector_col), "add", order_col)

    def add_raw(self, docs: DataFrame, order_col: str = "id") -> None:
        """Add rows that have codes and norm."""
        self._append(docs, "add", order_col)

    def upsert(self, docs: DataFrame, order_col: str = "id", vector_col: str = "embedding") -> None:
        self._append(quantize(docs, self.config, vector_col), "upsert", order_col)

    def delete(self, ids: DataFrame) -> None:
        """Delete ids (column ``id``); unknown ones don't matter."""
        self._append(ids.select("id"), "delete", "id")

    def live(self) -> DataFrame:
        return live(self.log())

    def get(self, doc_id: str) -> DataFrame:
        return live(self.log().where(F.col("id") == doc_id)).drop("codes", "norm")

    def ids(self) -> DataFrame:
        return self.live().select("id")

    def count(self) -> int:
        return self.live().count()

    def compact(self) -> DataFrame:
        """The live rows, written; later reads of the returned DataFrame need no window."""
        self.live().write.mode("overwrite").parquet(f"{self.path}/compact")
        return self.spark.read.parquet(f"{self.path}/compact")

    def info(self) -> DataFrame:
        """(documents, operations, dim, work_dim, bits, code_bytes)"""
        log = self.log().agg(F.count(F.lit(1)).alias("operations"))
        counts = self.live().agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum(F.octet_length("codes").cast("long")), F.lit(0).cast("long")).alias("code_bytes"))
        # one row with one row
        return counts.crossJoin(log).select("documents", "operations", F.lit(self.config.dim).alias("dim"), F.lit(self.config.work_dim).alias("work_dim"), F.lit(self.config.bits).alias("bits"), "code_bytes")


def store_info(codes: DataFrame, config: QuantizerConfig, norm_bytes: int = 4) -> DataFrame:
    """(vectors, dim, bits, code_bytes, packed_bytes, raw_bytes, ratio): sizes of coded vectors against float32."""
    packed = -(-config.work_dim * config.bits // 8) + norm_bytes
    n = F.count(F.lit(1))
    return codes.agg(
        n.alias("vectors"),
        F.lit(config.dim).alias("dim"),
        F.lit(config.bits).alias("bits"),
        F.coalesce(F.sum(F.octet_length("codes").cast("long")), F.lit(0).cast("long")).alias("code_bytes"),
        (n * packed).alias("packed_bytes"),
        (n * 4 * config.dim).alias("raw_bytes"),
        F.lit(4 * config.dim / packed).alias("ratio"),
    )
