"""JSON lines: documents in, coded vectors out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SCHEMA = "id string, vector array<double>, content string, metadata string"


def read(spark: SparkSession, path: str, dim: int | None = None) -> DataFrame:
    """(id, embedding, content, data) of records whose vector has ``dim`` coordinates.

    A line that isn't JSON fails the read. ``dim`` is that of the first record if not given.
    Metadata stays a JSON object in a string, so numbers keep their width. An empty id
    becomes ``vec-`` and the record's number among those kept.
    """
    rows = spark.read.schema(SCHEMA).option("mode", "FAILFAST").json(path)
    if dim is None:
        first = rows.where("vector is not null").select(F.size("vector")).head()
        dim = first[0] if first else 0
    kept = rows.where(F.size("vector") == dim)
    # numbers in file order without one task for all: counts of tasks first, then places in each
    placed = kept.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    before, total = {}, 0
    for part, n in sorted((r[0], r[1]) for r in placed.groupBy("_part").count().collect()):
        before[part], total = total, total + n
    start = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x).cast("long") for kv in before.items() for x in kv)), F.col("_part").cast("long")), F.lit(0)) if before else F.lit(0)
    number = start + F.row_number().over(W.partitionBy("_part").orderBy("_at")) - 1
    named = F.when(F.coalesce("id", F.lit("")) == "", F.concat(F.lit("vec-"), number.cast("string"))).otherwise(F.col("id"))
    return placed.select(named.alias("id"), F.col("vector").alias("embedding"), "content", F.col("metadata").alias("data"))


def skipped(spark: SparkSession, path: str, dim: int) -> int:
    """How many records have another number of coordinates."""
    return spark.read.schema(SCHEMA).option("mode", "FAILFAST").json(path).where(~F.coalesce(F.size("vector") == dim, F.lit(False))).count()


def write(codes: DataFrame, path: str, vectors: bool = True, limit: int | None = None) -> None:
    """id, content, metadata and, with ``vectors``, norm and base64 codes; ``limit`` in id order."""
    rows = codes.orderBy("id").limit(limit) if limit is not None else codes
    columns = ["id", "content", F.col("data").alias("metadata")]
    if vectors:
        columns += ["norm", F.base64("codes").alias("indices")]
    rows.select(*columns).write.mode("overwrite").json(path)
