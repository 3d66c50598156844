"""Exact deduplication by content hash, in DataFrame operations only.

Rows are grouped by 128 bits of the SHA-256 of the normalised text *and* by that text itself,
so the bytes are compared inside every hash group by the aggregation: two texts that
collide stay two groups. Partial aggregation folds copies before the shuffle, so a text
that holds a third of all rows sends one row a task. Rows then find their group by an
ordinary join on (hash, SHA-256), which AQE splits where one group is very large.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Columns of this operator; input columns with these names are replaced in the output.
ADDED = ("keep_id", "group_size", "kept", "text_sha256")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    norm = docs.select(F.col(id_col).alias("_id"), common.squeezed(common.text_of(text_col)).alias("_norm"))
    hashed = norm.select("_id", "_norm", F.unhex(F.sha2(F.col("_norm").cast("binary"), 256)).alias("_sha"))
    return hashed.select("_id", "_norm", F.substring("_sha", 1, 16).alias("_hash"), "_sha")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each different normalised text: _hash, _sha, keep_id, group_size.

    Null text is empty. Null ids count in ``group_size`` and are never ``keep_id`` unless
    the group has no other id.
    """
    # equal texts have equal digests, so the whole digest as a third key splits no group
    one = _keyed(docs, id_col, text_col).groupBy("_hash", "_norm", "_sha").agg(F.min("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return one.select("_hash", "_sha", "keep_id", "group_size")


def decide(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row, dropped ones too: id, keep_id, group_size, kept, text_sha256.

    Null and empty texts are one group. Rows that repeat both id and text all count in
    ``group_size`` and are all ``kept`` together, being one document. A row with a null id
    is kept only if its group has no id at all. An empty table gives an empty result;
    other columns of ``docs`` are not read.
    """
    rows = _keyed(docs, id_col, text_col).select("_id", "_hash", "_sha")
    found = rows.join(groups(docs, id_col, text_col), ["_hash", "_sha"])
    return found.select(
        F.col("_id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Losers go by an anti join on id and content hash, so another text under the same id, or
    another one without an id, stays. Rows without an id lose only to a row that has one.
    """
    lost = decide(docs, id_col, text_col).where(~F.col("kept")).select(F.col(id_col).alias("__lost"), F.unhex("text_sha256").alias("__lost_sha")).distinct()
    sha = F.unhex(F.sha2(common.squeezed(common.text_of(text_col)).cast("binary"), 256))
    return docs.join(lost, docs[id_col].eqNullSafe(lost["__lost"]) & (sha == lost["__lost_sha"]), "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    return decide(common.table(spark, sf_dir, "documents"))


SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
), g AS (
  SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm
)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.norm) AS text_sha256
FROM n JOIN g ON n.norm = g.norm
"""
