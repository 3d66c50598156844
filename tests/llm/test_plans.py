"""Sizes of plans, which the driver holds, and what squeezed() makes of blanks."""

from pyspark.sql import functions as F

from veclith.llm import common, exact_dedup


def test_plans_of_exact_dedup_stay_small(spark):
    docs = spark.createDataFrame([(1, "a  b"), (2, "a\tb")], "doc_id long, text string")
    for found in (exact_dedup.decide(docs), exact_dedup.deduplicate(docs)):
        assert len(found._jdf.queryExecution().optimizedPlan().toString()) < 20_000


def test_squeezed_is_the_regular_expression(spark):
    texts = [None, "", " ", "\t", "a", "a b", "a  b", "\ta\n\nb\x0b \f\r", " a \r\n b ", "\u00a0a\u2003\x85b", "日\t本  é", "a" + "\t" * 50]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select(common.squeezed(F.col("text")).alias("got"), F.regexp_replace("text", common.WHITE, " ").alias("want")).collect()
    assert [r["got"] for r in rows] == [r["want"] for r in rows]
