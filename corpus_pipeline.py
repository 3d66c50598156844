"""From raw documents to piece ids: five stages, each one operator, each written before the next.

Rejected as toxic, repeated exactly, similar to an earlier document, or sharing a passage
with the benchmark: such documents go, all others stay with their columns as they are. The
last stage encodes what is left.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from veclith.llm import common, decontaminate, exact_dedup, near_dedup, pieces, toxicity


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression-distance model doesn't reject."""
    model = toxicity.fit(docs, common.table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where("predicted = 0").select(*docs.columns)


def _exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest id."""
    return exact_dedup.deduplicate(docs)


def _near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked texts the one with the smallest id."""
    return near_dedup.deduplicate(docs)


def _decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of words with a benchmark item."""
    return decontaminate.decontaminate(docs, common.table(spark, sf_dir, "benchmark"))


def _pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 and decoded_sha256 of each document left."""
    return pieces.round_trip(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", _toxicity),
    ("exact_dedup", _exact_dedup),
    ("near_dedup", _near_dedup),
    ("decontaminate", _decontaminate),
    ("pieces", _pieces),
]

#: SQL has no compression distance; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table ``documents``; what each returns is written and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.stored(stage(spark, docs, sf_dir), f"stage_{name}")
    return docs
