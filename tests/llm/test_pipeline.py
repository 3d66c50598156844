"""The pipeline's stages on a small table with the awkward cases, and the registry."""

import random

import pytest

import __spark_entry__
import corpus_pipeline
from veclith.llm import queries

RNG = random.Random(9)
SYLLABLES = ["ta", "ri", "mo", "len", "sku", "dor", "pe", "vin"]
WORDS = ["".join(RNG.choice(SYLLABLES) for _ in range(3)) for _ in range(300)]


def prose(n, rude=False):
    found = [RNG.choice(WORDS) for _ in range(n)]
    for _ in range(n // 10 if rude else 0):
        found[RNG.randrange(n)] = RNG.choice(["blockhead", "nitwit", "dunderhead"])
    return " ".join(found)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    item = prose(20)
    rows = [(i, prose(60, i % 4 == 0)) for i in range(240)]
    base = prose(100)
    rows += [(1000, base), (1001, base), (1002, base + " end"), (1003, prose(30) + " " + item), (1004, None), (1005, ""), (1006, prose(20_000)), (1007, "ascii é 日本"), (None, prose(40))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 == 0), 1) for i in range(240)], "doc_id long, toxic int, quality int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    docs.limit(0).write.parquet(f"{path}/empty.parquet")
    return str(path)


def test_stages_keep_clean_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, gone = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        before = {r["doc_id"] for r in docs.select("doc_id").collect()}
        out = corpus_pipeline.common.stored(out, name)
        gone[name] = before - {r["doc_id"] for r in out.select("doc_id").collect()}
        assert name == "pieces" or out.columns == columns
        docs = out
    # wherever rude words are frequent they go, and nearly nothing else
    rude = {i for i in range(240) if i % 4 == 0}
    assert len(rude & gone["toxicity"]) >= 50 and len(gone["toxicity"] - rude) <= 2
    assert gone["exact_dedup"] == {1001, 1005} and gone["near_dedup"] == {1002} and gone["decontaminate"] == {1003} and gone["pieces"] == set()


def test_stages_take_an_empty_table(spark, folder):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.read.parquet(f"{folder}/empty.parquet"), folder).count() == 0, name


def test_registry():
    names = __spark_entry__.queries()
    assert {n.split("_")[0] for n in queries.queries()} == {f"op{k}" for k in range(1, 11)}
    assert "pipeline" in names and set(queries.oracle_sql()) <= set(names)
