"""Retrieval quality as joins and aggregates over (qid, id, rank, score) tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Ranges of values that are counted first when a percentile is looked for.
RANGES = 100_000


def _pair(truth: DataFrame, found: DataFrame, k: int, id_col: str) -> DataFrame:
    """Truth's first k rows with the rank and score that ``found`` gives them, if any."""
    t = truth.where(F.col("rank") <= k).select("qid", id_col, F.col("rank").alias("t_rank"), F.col("score").alias("t_score"))
    p = found.where(F.col("rank") <= k).select("qid", id_col, F.col("rank").alias("p_rank"), F.col("score").alias("p_score"))
    return t.join(p, ["qid", id_col], "left")


def recall(truth: DataFrame, found: DataFrame, k: int = 10, id_col: str = "vec_id") -> DataFrame:
    """(qid, recall): share of the true k rows that were found; fewer true rows are all that count."""
    return _pair(truth, found, k, id_col).groupBy("qid").agg((F.count("p_rank") / F.count(F.lit(1))).alias("recall"))


def perfect(recalls: DataFrame) -> DataFrame:
    """(queries, perfect, mean_recall) over :func:`recall`."""
    return recalls.agg(F.count(F.lit(1)).alias("queries"), F.count_if(F.col("recall") >= 1.0).alias("perfect"), F.avg("recall").alias("mean_recall"))


def ndcg(truth: DataFrame, found: DataFrame, k: int = 10, id_col: str = "vec_id") -> DataFrame:
    """(qid, ndcg): a row that is r-th in the truth is worth k - r + 1."""
    value = F.lit(k + 1) - F.col("t_rank")
    gain = F.sum(F.when(F.col("p_rank").isNotNull(), value / F.log2(F.col("p_rank") + 1)).otherwise(0.0))
    best = F.sum(value / F.log2(F.col("t_rank") + 1))
    return _pair(truth, found, k, id_col).groupBy("qid").agg(F.when(best > 0, gain / best).otherwise(0.0).alias("ndcg"))


def scores(truth: DataFrame, found: DataFrame) -> DataFrame:
    """(pearson, avg_diff, max_diff) of the best scores of all queries."""
    t = truth.where("rank = 1").select("qid", F.col("score").alias("t"))
    p = found.where("rank = 1").select("qid", F.col("score").alias("p"))
    # corr itself divides by zero before a condition is looked at
    spread = F.stddev_pop("t") * F.stddev_pop("p")
    return t.join(p, "qid").agg(
        F.when(spread < 1e-15, 0.0).otherwise(F.covar_pop("t", "p") / spread).alias("pearson"),
        F.avg(F.col("p") - F.col("t")).alias("avg_diff"),
        F.max(F.abs(F.col("p") - F.col("t"))).alias("max_diff"),
    )


def displacement(truth: DataFrame, found: DataFrame, k: int = 10, id_col: str = "vec_id") -> DataFrame:
    """(found, avg_displacement, max_displacement): how far found rows are from their true rank."""
    moved = F.abs(F.col("t_rank") - F.col("p_rank"))
    return _pair(truth, found, k, id_col).where("p_rank is not null").agg(F.count(F.lit(1)).alias("found"), F.avg(moved).alias("avg_displacement"), F.max(moved).cast("int").alias("max_displacement"))


def near_misses(truth: DataFrame, k: int = 10, gap: float = 0.01) -> DataFrame:
    """(qid, gap) of queries whose k-th and next scores are closer than ``gap``; needs k + 1 ranks."""
    both = truth.where(F.col("rank").isin(k, k + 1)).groupBy("qid").agg((F.max("score") - F.min("score")).alias("gap"), F.count(F.lit(1)).alias("n"))
    return both.where((F.col("n") == 2) & (F.col("gap") < gap)).select("qid", "gap")


def percentile(df: DataFrame, column: str, p: int) -> DataFrame:
    """(value): the element at place floor(p * n / 100) of the sorted values, the last at most; null without values.

    Values are counted, and what is summed up in order is one row a range: equal-width ranges of
    values first, then the different values of the one range that has the place.
    """
    known = df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("v"))
    whole = known.agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count(F.lit(1)).alias("n"))
    at = F.least(F.floor(F.col("n") * p / 100), F.col("n") - 1)
    # one row with the bounds for every value
    placed = known.join(F.broadcast(whole), F.lit(True))
    share = F.when(F.col("high") > F.col("low"), (F.col("v") - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(0.0)
    placed = placed.select("v", at.alias("at"), F.least(F.floor(share * RANGES), F.lit(RANGES - 1)).alias("range"))
    ranges = placed.groupBy("range", "at").agg(F.count(F.lit(1)).alias("count"))
    # at most RANGES rows
    before = F.sum("count").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1))
    chosen = ranges.select("range", "at", "count", F.coalesce(before, F.lit(0)).alias("before")).where((F.col("before") <= F.col("at")) & (F.col("at") < F.col("before") + F.col("count")))
    own = placed.join(F.broadcast(chosen.select("range", "before")), "range").groupBy("v", "at", "before").agg(F.count(F.lit(1)).alias("count"))
    up_to = F.col("before") + F.sum("count").over(W.orderBy("v"))
    return own.select("v", "at", up_to.alias("up_to")).where("up_to > at").agg(F.min("v").alias("value"))
