"""Benchmark decontamination by winnowing, in DataFrame operations only.

Texts become arrays of lower-cased words. Every ``GRAM`` consecutive words are hashed; of
each ``WINDOW - GRAM + 1`` consecutive hashes the smallest (the leftmost of equal ones) is
a fingerprint. Two texts that share ``WINDOW`` consecutive words thus share a fingerprint at
the same place in them. Document and benchmark fingerprints are equi-joined, and each hit is
extended word by word to both sides: it counts if the shared span reaches ``WINDOW`` words.
Comparing words, not hashes, makes the result exact. Benchmark items shorter than a window
are one window each; for their few lengths all runs of document words are hashed.

A hash and its position share one long (36 and 28 bits), so the minimum of a window brings
its position along and no row is made for a word. Benchmark fingerprints are written first,
so their count is known: up to ``BROADCAST_ROWS`` they are broadcast and documents are read
once and never shuffled; beyond that, narrow document fingerprints are shuffled to them and
only documents with a hit are read again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW, GRAM = 10, 5
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 64 << 20
_POS_BITS = 28


def words_of(text: Column) -> Column:
    """Lower-cased words: runs of digits, a-z and all characters beyond ASCII."""
    # lower() does the same as lower_ascii() for ASCII texts and is much faster
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(common.lower_ascii(text))
    return F.array_remove(F.split(low, NOT_WORD, -1), "")


def _packed(words: Column, size: int) -> Column:
    """For each ``size`` consecutive words, their hash and position in one long."""
    starts = F.slice(words, F.lit(1), F.greatest(F.size(words) - (size - 1), F.lit(0)))
    return F.transform(starts, lambda w, i: F.shiftleft(F.xxhash64(F.lit(size), w, *(F.get(words, i + k) for k in range(1, size))), _POS_BITS).bitwiseOR(i.cast("long")))


def _winnowed(packed: Column, width: int) -> Column:
    """The smallest of each ``width`` consecutive values, each position once."""
    starts = F.slice(packed, F.lit(1), F.greatest(F.size(packed) - (width - 1), F.lit(0)))
    return F.array_distinct(F.transform(starts, lambda p, i: F.least(p, *(F.get(packed, i + k) for k in range(1, width)))))


def _hash(packed: Column) -> Column:
    return F.shiftright(packed, _POS_BITS)


def _position(packed: Column) -> Column:
    return packed.bitwiseAND((1 << _POS_BITS) - 1).cast("int")


def fingerprints(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row a fingerprint of an item: _hash, _item, _core, _left, _right, _need.

    ``_core`` has the hashed words, ``_left`` (nearest first) and ``_right`` the words
    beside them, and ``_need`` the length that a shared span must reach. Null ids become
    the empty string; items without words have no row.
    """
    side = window - gram
    rows = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_item"), words_of(common.text_of(text_col)).alias("_w"))
    rows = rows.where(F.size("_w") > 0).distinct().withColumn("_g", _packed(F.col("_w"), gram))
    long = rows.where(F.size("_w") >= window).select("_item", "_w", F.explode(_winnowed(F.col("_g"), side + 1)).alias("_p"))
    long = long.withColumn("_at", _position(F.col("_p"))).select(
        _hash(F.col("_p")).alias("_hash"),
        "_item",
        F.expr(f"slice(_w, _at + 1, {gram})").alias("_core"),
        F.expr(f"reverse(slice(_w, greatest(_at - {side}, 0) + 1, least(_at, {side})))").alias("_left"),
        F.expr(f"slice(_w, _at + {gram} + 1, {side})").alias("_right"),
        F.lit(window).alias("_need"),
    )
    none = F.array().cast("array<string>")
    short = [rows.where(F.size("_w") == n).select(_hash(F.get(_packed(F.col("_w"), n), F.lit(0))).alias("_hash"), "_item", F.col("_w").alias("_core"), none.alias("_left"), none.alias("_right"), F.lit(n).alias("_need")) for n in range(1, window)]
    return reduce(DataFrame.unionByName, short, long)


def _extended(side: str, first: Column, step: int, most: int) -> Column:
    """How many words beside a hit are the same, up to ``most``."""
    count = F.lit(0)
    for k in reversed(range(most)):
        count = F.when(F.get("_w", first + step * k) == F.get(side, F.lit(k)), count + 1).otherwise(0)
    return count


def mark(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, gram: int = GRAM, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row for each document: id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null and empty texts have no words and no hits. Rows that repeat an id and a text each
    give a row; rows that share only the id are separate documents. Null ids stay null.
    With an empty benchmark nothing is contaminated; an empty table gives an empty result.
    Other columns are not read.
    """
    return _marked(docs, items, id_col, text_col, item_id, item_text, window, gram, broadcast_rows).drop("_th")


def _marked(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, gram: int = GRAM, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """:func:`mark` with _th, the hash of the text, beside the id."""
    side = window - gram
    marks = common.stored(fingerprints(items, item_id, item_text, window, gram), "benchmark_fingerprints")
    length = sum(F.coalesce(F.aggregate(c, F.lit(0), lambda a, w: a + F.octet_length(w) + 24), F.lit(0)) for c in ("_core", "_left", "_right"))
    known = marks.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(length.cast("long")), F.lit(0)).alias("bytes"), F.collect_set(F.when(F.col("_need") < window, F.col("_need"))).alias("short")).first()
    small = known["rows"] <= broadcast_rows and known["bytes"] <= BROADCAST_BYTES

    texts = docs.select(F.col(id_col).alias("_id"), common.text_of(text_col).alias("_text"))
    rows = texts.select("_id", F.xxhash64("_text").alias("_th"), words_of(F.col("_text")).alias("_w"))
    grams = rows.withColumn("_g", _packed(F.col("_w"), gram))
    chosen = F.when(F.size("_w") >= window, _winnowed(F.col("_g"), side + 1)).otherwise(F.array().cast("array<long>"))
    # a null in front stands for the document itself
    chosen = F.concat(F.array(F.lit(None).cast("long")), chosen, *(_packed(F.col("_w"), n) for n in sorted(known["short"])))

    if small:
        hits = grams.select("_id", "_th", "_w", F.explode(chosen).alias("_p")).withColumn("_hash", _hash(F.col("_p")))
        hits = hits.join(F.broadcast(marks), "_hash", "left").where("_p is null or _item is not null")
    else:
        narrow = grams.select("_id", "_th", F.explode(F.filter(chosen, lambda p: p.isNotNull())).alias("_p")).withColumn("_hash", _hash(F.col("_p")))
        found = narrow.join(marks, "_hash").select("_id", "_th", "_p", *marks.drop("_hash").columns)
        found = found.withColumnsRenamed({"_id": "_fid", "_th": "_fth"})
        same = rows["_id"].eqNullSafe(found["_fid"]) & (rows["_th"] == found["_fth"])
        # left, so that a document without a hit still has its row; the null row is added to those with one
        hits = rows.join(found, same, "left").drop("_fid", "_fth")

    at = F.col("_at")
    left = _extended("_left", at - 1, -1, side)
    right = _extended("_right", at + F.size("_core"), 1, side)
    checked = hits.withColumn("_at", _position(F.col("_p"))).withColumns({"_l": left, "_r": right}).select(
        "_id",
        "_th",
        F.size("_w").alias("_n"),
        F.col("_p").isNull().alias("_own"),
        "_item",
        (at - F.col("_l")).alias("_from"),
        (at + F.size("_core") + F.col("_r") - 1).alias("_to"),
        ((F.expr("slice(_w, _at + 1, size(_core))") == F.col("_core")) & (F.col("_l") + F.size("_core") + F.col("_r") >= F.col("_need"))).alias("_hit"),
    )
    copies = F.count_if("_own") if small else F.max(F.lit(1).cast("long"))
    per_doc = checked.where("_own or _hit").groupBy("_id", "_th").agg(
        copies.alias("_copies"),
        F.max("_n").cast("long").alias("n_words"),
        F.collect_set(F.when(F.col("_hit"), F.struct("_from", "_to"))).alias("_spans"),
        F.collect_set(F.when(F.col("_hit"), F.col("_item"))).alias("_items"),
    )
    if not small:
        # documents whose candidates all failed, and how often each document is there
        counted = rows.groupBy("_id", "_th").agg(F.count(F.lit(1)).alias("_times"), F.max(F.size("_w")).cast("long").alias("_size")).withColumnsRenamed({"_id": "_cid", "_th": "_cth"})
        per_doc = counted.join(per_doc, counted["_cid"].eqNullSafe(per_doc["_id"]) & (counted["_cth"] == per_doc["_th"]), "left").select(
            F.col("_cid").alias("_id"), F.col("_cth").alias("_th"), F.col("_times").alias("_copies"), F.col("_size").alias("n_words"),
            F.coalesce("_spans", F.array().cast("array<struct<_from:int,_to:int>>")).alias("_spans"), F.coalesce("_items", F.array().cast("array<string>")).alias("_items"),
        )
    hit = F.size(F.array_distinct(F.flatten(F.transform("_spans", lambda s: F.sequence(s["_from"], s["_to"]))))).cast("long")
    out = per_doc.select(
        F.col("_id").alias(id_col),
        "_th",
        "n_words",
        hit.alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("_items"), ",").cast("binary"), 256).alias("items_sha256"),
        "_copies",
    )
    out = out.withColumn("contaminated", F.col("n_hit") > 0)
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "_copies"))).drop("_copies", "_copy")


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that share no window with an item, with all their columns; decided by id and text."""
    marked = _marked(docs, items, id_col, text_col, **options).where("contaminated").select(F.col(id_col).alias("__hit"), F.col("_th").alias("__hit_th")).distinct()
    same = docs[id_col].eqNullSafe(marked["__hit"]) & (F.xxhash64(common.text_of(text_col)) == marked["__hit_th"])
    return docs.join(marked, same, "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    return mark(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), iw AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), lens AS (
  SELECT DISTINCT least(len(w), 10) AS n FROM iw WHERE len(w) > 0
), ig AS (
  SELECT DISTINCT item, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS g
  FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM iw WHERE len(w) > 0)
), dg AS (
  SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, lens WHERE len(w) >= n)
), hits AS (
  SELECT dg.doc_id, dg.i, dg.n, ig.item FROM dg JOIN ig ON dg.g = ig.g
), words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id
)
SELECT dw.doc_id, CAST(len(dw.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
