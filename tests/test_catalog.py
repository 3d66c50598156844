"""Registered queries over a small table of vectors."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from veclith.operators import metrics, search
from veclith.plans import catalog

ROWS = 1000


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path, x = tmp_path_factory.mktemp("sf"), np.random.default_rng(5).standard_normal((ROWS, catalog.DIM))
    rows = [(i, v.tolist(), i % 10) for i, v in enumerate(x)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return str(path)


def ranks(df):
    return sorted((r["qid"], r["rank"], r["vec_id"]) for r in df.collect())


def test_query_sets_grow_with_the_table(spark, folder):
    found, every = catalog.queries(), set(range(0, ROWS, catalog.EVERY))
    for name in ("exact_cosine_topk_every50", "knn_batch_every50", "knn_batch_4bit_every50", "ivf_all_probes_every50", "ivf_trained", "hnsw_search"):
        assert {r["qid"] for r in found[name](spark, folder).collect()} == every, name
    assert found["recall_summary_every50"](spark, folder).first()["queries"] == len(every)


def test_queries_over_every_50th_match_sql(spark, folder):
    found, sql = catalog.queries(), catalog.oracle_sql()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet/*.parquet'")
    for query in catalog.GROWING:
        name = f"{query.__name__}_every50"
        got, want = found[name](spark, folder).toPandas(), con.execute(sql[name]).df()
        by = [c for c in ("qid", "rank", "p") if c in want]
        got, want = ((x.sort_values(by) if by else x).reset_index(drop=True) for x in (got[list(want)], want))
        assert len(got) == len(want) and np.allclose(got.astype(float), want.astype(float), rtol=0, atol=2e-6), name


def test_queries_in_blocks(spark, folder, monkeypatch):
    one = [ranks(catalog.queries()[name](spark, folder)) for name in ("knn_batch_every50", "exact_cosine_topk_every50", "ivf_all_probes_every50")]
    monkeypatch.setattr(search, "QUERY_BYTES", 8 * catalog.DIM * 7)
    assert len(list(search._queries(catalog._every(spark, folder)))) > 1
    assert one == [ranks(catalog.queries()[name](spark, folder)) for name in ("knn_batch_every50", "exact_cosine_topk_every50", "ivf_all_probes_every50")]


def test_index_searches_reach_their_recall(spark, folder):
    found = catalog.queries()
    truth = found["exact_cosine_topk_every50"](spark, folder).cache()
    for name in ("ivf_trained", "ivf_search_every50"):
        assert metrics.recall(truth, found[name](spark, folder)).agg(F.avg("recall")).first()[0] >= 0.9, name


def test_score_correlation(spark, folder):
    found = catalog.queries()
    # every query finds itself with cosine 1: no spread
    assert found["score_correlation"](spark, folder).first()["pearson"] == found["score_correlation_every50"](spark, folder).first()["pearson"] == 0
    t, p = (spark.createDataFrame([(i, 1, float(v)) for i, v in enumerate(x)], "qid long, rank int, score double") for x in ([1, 2, 3], [1, 2, 4]))
    assert abs(metrics.scores(t, p).first()["pearson"] - np.corrcoef([1, 2, 3], [1, 2, 4])[0, 1]) < 1e-12
