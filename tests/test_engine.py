"""Search, filters, indexes, collections, caches, weights and sources."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from veclith.config import CacheConfig, IndexConfig, QuantizerConfig
from veclith.operators import embed, hnsw, ivf, kvcache, metrics, model, search
from veclith.operators import filters as f
from veclith.operators.collection import Collection
from veclith.operators.quantize import dequantize, marshal, quantize, unmarshal
from veclith.sources import jsonl, safetensors, store, vecs
from veclith.streaming import ingest

RNG = np.random.default_rng(11)


def frame(spark, x, **more):
    rows = [(i, v.tolist(), *(c[i] for c in more.values())) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>" + "".join(f", {k} string" for k in more))


def test_needle_filter_pages_and_scores(spark):
    x = RNG.standard_normal((300, 64))
    config = QuantizerConfig(64, 4)
    codes = quantize(frame(spark, x, repo=["a" if i % 2 else "b" for i in range(300)]), config).cache()
    assert search.search(codes, x[17], config, top_k=1).first()["vec_id"] == 17
    got = search.search(codes, x[17], config, top_k=10, filter=f.eq("repo", "b")).collect()
    assert len(got) == 10 and {r["repo"] for r in got} == {"b"}
    first = {r["rank"]: r["vec_id"] for r in search.search(codes, x[3], config, top_k=10).collect()}
    second = {r["rank"]: r["vec_id"] for r in search.search(codes, x[3], config, top_k=5, offset=5).collect()}
    assert second == {k: first[k] for k in range(6, 11)}
    assert not search.search(codes, np.zeros(64), config).collect()
    assert all(r["score"] >= 0.9 for r in search.search(codes, x[3], config, min_score=0.9).collect())
    assert search.search(codes, x[3], config, top_k=3, rescore=20).count() == 3
    assert search.query(codes, f.eq("repo", "a"), page_size=7).count() == 7
    back = dequantize(unmarshal(marshal(codes, config)), config)
    assert np.allclose([r["embedding"] for r in back.orderBy("vec_id").collect()], [r["embedding"] for r in dequantize(codes, config).orderBy("vec_id").collect()])
    assert search.semantic(codes, "", lambda t: x[5], config, top_k=1).first()["vec_id"] == 5
    with pytest.raises(ValueError):
        search.semantic(codes, "", None, config)
    empty = quantize(frame(spark, x[:0]), config)
    assert search.search(empty, x[0], config).count() == 0


def test_filters_over_variants(spark):
    docs = ['{"a": "30", "n": 30, "b": true, "s": "xyz"}', '{"a": null, "n": 1.5}', "{}", None, '{"n": [1]}']
    df = spark.createDataFrame(list(enumerate(docs)), "i long, j string").select("i", F.parse_json("j").alias("d"))
    ids = lambda x: sorted(r[0] for r in x.apply(df, "d").collect())
    assert ids(f.eq("a", "30")) == [0] and ids(f.eq("a", 30)) == [] and ids(f.eq("n", 30.0)) == [0]
    assert ids(f.ne("a", "x")) == [0, 1] and ids(f.nin("a")) == [0, 1] and ids(f.in_("a")) == []
    assert ids(f.gt("n", 1)) == [0, 1] and ids(f.lte("n", 1.5)) == [1] and ids(f.gt("a", 1)) == []
    assert ids(f.eq("b", True)) == [0] and ids(f.eq("b", 1)) == [] and ids(f.ne("n", 30)) == [1, 4]
    assert ids(f.contains("s", "")) == [0] and ids(f.not_contains("n", "x")) == [0, 1, 4] and ids(f.not_contains("s", "y")) == []
    assert ids(f.and_()) == [0, 1, 2, 3, 4] and ids(f.or_()) == [] and ids(f.gt("n", float("nan"))) == []


def test_typed_filters_reach_the_scan(spark, tmp_path):
    spark.range(100).select(F.col("id"), (F.col("id") % 7).cast("double").alias("d"), F.col("id").cast("string").alias("s")).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    plan = f.and_(f.eq("s", "5"), f.gt("id", 3)).apply(df)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(s,5)" in plan and "GreaterThan(id,3)" in plan
    assert f.eq("s", 5).apply(df).count() == 0 and f.ne("s", 5).apply(df).count() == 100 and f.eq("gone", 1).apply(df).count() == 0
    assert f.lt("d", 1).apply(df).count() == 15


def test_indexes_find_what_the_scan_finds(spark):
    x = RNG.standard_normal((600, 32))
    config, queries = QuantizerConfig(32, 8), [(i, x[i]) for i in range(20)]
    codes = quantize(frame(spark, x), config).cache()
    truth = search.exact_batch(frame(spark, x), queries).cache()
    brute = search.knn_batch(codes, queries, config).cache()
    mean = lambda found: metrics.recall(truth, found).agg(F.avg("recall")).first()[0]
    assert mean(brute) >= 0.95
    centers = ivf.train(codes, config, IndexConfig(kind="ivf", partitions=8))
    rows = ivf.assign(codes, centers, config)
    some, all_of = mean(ivf.knn_batch(rows, centers, queries, config, 2)), ivf.knn_batch(rows, centers, queries, config, len(centers))
    ids = lambda found: sorted((r["qid"], r["rank"], r["vec_id"]) for r in found.collect())
    assert 0.2 < some <= 1 and ids(all_of) == ids(brute)
    graph = hnsw.build(codes, config, IndexConfig(kind="hnsw", build_width=60))
    assert mean(hnsw.knn_batch(graph, queries, config)) >= 0.9
    gone = spark.createDataFrame([(0,)], "vec_id long")
    assert 0 not in {r["vec_id"] for r in hnsw.knn_batch(graph, queries[:1], config, gone=gone).collect()}
    assert ivf.choose(500, IndexConfig()) == "none" and ivf.choose(20_000, IndexConfig()) == "ivf" and ivf.choose(50, IndexConfig("ivf")) == "none"


def test_collection_operations(spark, tmp_path):
    c = Collection(spark, str(tmp_path / "c"), QuantizerConfig(8))
    docs = lambda ids, content: spark.createDataFrame([(i, content, RNG.standard_normal(8).tolist()) for i in ids], "id string, content string, embedding array<double>")
    c.add(docs("abcde", "one"))
    c.add(docs("ab", "two"))
    c.delete(spark.createDataFrame([("c",), ("zz",)], "id string"))
    c.upsert(docs("dg", "three"))
    assert c.count() == 5 and {r[0] for r in c.ids().collect()} == set("abdeg")
    assert c.get("a").first()["content"] == "one" and c.get("d").first()["content"] == "three"
    c.add(docs("c", "back"))
    assert c.get("c").first()["content"] == "back" and c.compact().count() == 6
    assert c.info().first()["operations"] == 12
    seqs = [r[0] for r in c.log().select("seq").collect()]
    assert len(set(seqs)) == len(seqs) == 12


def test_cache_needle(spark):
    config = CacheConfig(1, 1, 64)
    x = RNG.standard_normal((501, 64))
    q = RNG.standard_normal(64)
    x[250] = q * 2
    rows = spark.createDataFrame([(0, 0, i, k, v.tolist()) for i, v in enumerate(x) for k in ("key", "value")], "layer int, head int, pos int, kind string, vector array<double>")
    cache = kvcache.append(rows, config).cache()
    assert kvcache.attention_scores(cache, q, config).orderBy(F.desc("score")).first()["pos"] == 250
    v = np.array(kvcache.values(cache, config).where("pos = 3").first()["vector"])
    assert v @ x[3] / np.linalg.norm(v) / np.linalg.norm(x[3]) > 0.99
    assert kvcache.lengths(cache).first()["seq_len"] == 501
    m = kvcache.memory(cache, config).first()
    assert m["fp16_bytes"] / m["packed_bytes"] > 1.8
    assert {r["score"] for r in kvcache.attention_scores(cache, np.zeros(64), config).collect()} == {0.0}


def test_sources_and_weights(spark, tmp_path):
    x = RNG.standard_normal((7, 6)).astype(np.float32)
    (tmp_path / "a.fvecs").write_bytes(vecs.encode(x))
    got = vecs.read(spark, str(tmp_path / "a.fvecs")).orderBy("row").collect()
    assert np.allclose([r["values"] for r in got], x)
    w = RNG.standard_normal((150, 32)).astype(np.float32)
    (tmp_path / "m.safetensors").write_bytes(safetensors.encode({"w": w, "bias": w[0]}))
    path = str(tmp_path / "m.safetensors")
    assert [r["tensor"] for r in safetensors.tensors(spark, path).collect()] == ["bias", "w"]
    packed = model.compress(safetensors.rows(spark, path), bits=8).cache()
    assert model.summary(packed).first()["avg_cosine"] > 0.999
    back = np.array([r["values"] for r in model.restore(packed, bits=8).orderBy("row").collect()])
    assert np.abs(back - w).max() < 0.2
    with pytest.raises(ValueError):
        safetensors.header(b"\xff" * 16)
    lines = [{"id": "", "vector": [1, 0, 0, 0], "content": "x", "metadata": {"k": 1}}, {"id": "b", "vector": [1, 0]}, {"id": "c", "vector": [0, 1, 0, 0]}]
    (tmp_path / "d.jsonl").write_text("\n".join(map(json.dumps, lines)))
    docs = jsonl.read(spark, str(tmp_path / "d.jsonl"))
    assert [r["id"] for r in docs.collect()] == ["vec-0", "c"] and jsonl.skipped(spark, str(tmp_path / "d.jsonl"), 4) == 1
    codes = quantize(docs, QuantizerConfig(4))
    jsonl.write(codes, str(tmp_path / "out"), limit=1)
    assert spark.read.json(str(tmp_path / "out")).count() == 1
    store.write(codes, str(tmp_path / "s"), QuantizerConfig(4))
    rows, config = store.read(spark, str(tmp_path / "s"))
    assert config == QuantizerConfig(4) and rows.count() == 2
    some = embed.embed(spark.createDataFrame([("a b",), (None,)], "content string"))
    assert all(len(r["embedding"]) == 64 for r in some.collect())


def test_streaming_ingest(spark, tmp_path):
    (tmp_path / "in").mkdir()
    config = QuantizerConfig(4)
    centers = np.eye(4)
    for n in range(2):
        (tmp_path / "in" / f"{n}.jsonl").write_text(json.dumps({"id": f"d{n}", "vector": [1, n, 0, 0]}) + "\n" + json.dumps({"id": "bad", "vector": [1]}))
        ingest.ingest(ingest.stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck"), config, centers).awaitTermination()
    log = ingest.log(spark, str(tmp_path / "out"))
    assert [r["id"] for r in log.orderBy("seq").collect()] == ["d0", "d1"] and "ivf_part" in log.columns


def test_metrics_by_hand(spark):
    table = lambda ids: spark.createDataFrame([(0, i, 1.0 - k / 10, k + 1) for k, i in enumerate(ids)], "qid long, vec_id long, score double, rank int")
    truth, found = table([1, 2, 3, 4]), table([2, 1, 9, 4])
    assert metrics.recall(truth, found, 4).first()["recall"] == 0.75
    assert metrics.displacement(truth, found, 4).first()["max_displacement"] == 1
    best = sum((4 - k) / np.log2(k + 2) for k in range(4))
    got = 3 / np.log2(2) + 4 / np.log2(3) + 1 / np.log2(5)
    assert abs(metrics.ndcg(truth, found, 4).first()["ndcg"] - got / best) < 1e-12


def test_sequence_numbers_under_small_partitions(spark, tmp_path):
    settings = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "1m", "spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k"}
    was = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        c = Collection(spark, str(tmp_path / "c"), QuantizerConfig(8))
        rows = spark.range(200_000).select(F.format_string("%09d", "id").alias("id"), F.repeat(F.lit("x"), 50).alias("content"), F.lit(b"12345678").alias("codes"), F.lit(1.0).cast("float").alias("norm"))
        c.add_raw(rows.repartition(7), "id")
        c.delete(rows.where("id < '000001000'").select("id"))
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    log = c.log()
    assert log.where("seq is null").count() == 0 and log.select("seq").distinct().count() == 201_000
    ids = [r[0] for r in log.where("op = 'add'").orderBy("seq").select("id").collect()]
    assert ids == sorted(ids) and c.count() == 199_000


def test_repeated_ids_count_row_by_row(spark):
    x = RNG.standard_normal((50, 16))
    config = QuantizerConfig(16, 8)
    twice = spark.createDataFrame([(i % 50, v.tolist(), i) for i, v in enumerate([*x, *x])], "vec_id long, embedding array<double>, n long")
    codes = quantize(twice, config).cache()
    got = search.search(codes, x[3], config, top_k=4).orderBy("rank").collect()
    assert len(got) == 4 and [r["vec_id"] for r in got[:2]] == [3, 3] and {r["n"] for r in got[:2]} == {3, 53}
    assert [r["vec_id"] for r in search.search(codes, x[3], config, top_k=1, offset=1).collect()] == [3]
    assert [r["n"] for r in search.search(codes, x[3], config, top_k=1, filter=f.gt("n", 49)).collect()] == [53]
    named = quantize(spark.createDataFrame([(f"é{i}", v.tolist()) for i, v in enumerate(x)], "vec_id string, embedding array<double>"), config)
    assert search.knn_batch(named, [(0, x[7])], config, k=1).first()["vec_id"] == "é7"


def test_running_top_k_is_the_sorted_one():
    import pyarrow as pa

    scores = RNG.integers(0, 40, (3000, 7)).astype(float) / 10
    ids = RNG.permutation(3000)
    for k, minimum in ((5, 0.0), (5, 3.85), (3000, 0.0), (None, 3.5)):
        best = search.Running(7, k, minimum, 1)
        for a in range(0, 3000, 300):
            best.add(scores[a : a + 300], ids[a : a + 300], [pa.array(ids[a : a + 300])])
        who, found, (names,) = best.rows()
        for q in range(7):
            rows = [i for i in np.lexsort((ids, -scores[:, q])) if minimum <= 0 or scores[i, q] >= minimum][:k]
            own = np.flatnonzero(who == q)
            assert [(names[i].as_py(), found[i]) for i in own] == [(ids[i], scores[i, q]) for i in rows]


def test_huge_literals(spark):
    df = spark.range(5).withColumn("d", F.col("id").cast("decimal(20,2)"))
    for key in ("id", "d"):
        assert f.lt(key, 1e300).apply(df).count() == 5 and f.gt(key, 1e300).apply(df).count() == 0 and f.gte(key, -1e300).apply(df).count() == 5 and f.gt(key, float(2**63)).apply(df).count() == 0


def test_percentiles(spark):
    for values in ([3.0], [1.0, 2.0], [5.0] * 7, [float(x) for x in RNG.standard_normal(501)], [1e9, *range(100)]):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
        for p in (0, 50, 95, 99, 100):
            assert metrics.percentile(df, "v", p).first()["value"] == sorted(values)[min(len(values) - 1, len(values) * p // 100)]
    assert metrics.percentile(df.limit(0), "v", 50).first()["value"] is None


def test_stored_indexes(spark, tmp_path, monkeypatch):
    from veclith.operators import index

    x = RNG.standard_normal((900, 32))
    config, queries = QuantizerConfig(32, 8), [(i, x[i]) for i in range(0, 900, 45)]
    codes = quantize(frame(spark, x), config)
    truth = search.exact_batch(frame(spark, x), queries).cache()
    mean = lambda found: metrics.recall(truth, found).agg(F.avg("recall")).first()[0]
    monkeypatch.setattr(hnsw, "SHARD_ROWS", 250)
    graph = index.create(codes.where("vec_id < 600"), str(tmp_path / "h"), config, IndexConfig("hnsw", build_width=60))
    graph.add(codes.where("vec_id >= 600"))
    graph = index.open_index(spark, str(tmp_path / "h"))
    assert graph.kind == "hnsw" and hnsw.read(spark, str(tmp_path / "h/graph")).select("shard").distinct().count() >= 4
    assert mean(graph.knn_batch(queries)) >= 0.9 and graph.search(x[700], top_k=1).first()["vec_id"] == 700
    part = index.create(codes, str(tmp_path / "i"), config, IndexConfig("ivf", partitions=12))
    part = index.tune(part, frame(spark, x), spark.createDataFrame([(i, v.tolist()) for i, v in queries], "qid long, embedding array<double>"))
    assert mean(part.knn_batch(queries)) >= 0.9 and mean(part.knn_batch(queries, exhaustive=True)) >= 0.95
    plan = part.rows.where(F.col("ivf_part").isin(1, 2))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [ivf_part" in plan
    assert index.open_index(spark, str(tmp_path / "i")).probe == part.probe
    assert part.search(x[5], top_k=1, filter=f.lt("vec_id", 10)).first()["vec_id"] == 5


def test_command_line(spark, tmp_path):
    import io

    from veclith import cli

    x = RNG.standard_normal((40, 8))
    (tmp_path / "d.jsonl").write_text("\n".join(json.dumps({"id": f"d{i}", "vector": v.tolist(), "content": f"text {i}", "metadata": {"even": i % 2 == 0}}) for i, v in enumerate(x)) + '\n{"id": "short", "vector": [1]}')
    (tmp_path / "q.json").write_text(json.dumps(x[9].tolist()))

    def run(*arguments):
        out = io.StringIO()
        assert cli.main([arguments[0], "--path", str(tmp_path / "c"), *arguments[1:]], spark, out) == 0
        return [json.loads(line) for line in out.getvalue().splitlines()]

    run("init", "--dim", "8")
    assert run("import", str(tmp_path / "d.jsonl")) == [{"added": 40, "skipped": 1, "index": "none"}]
    assert run("search", str(tmp_path / "q.json"), "--top-k", "3")[0]["id"] == "d9"
    assert {json.loads(r["data"])["even"] for r in run("search", str(tmp_path / "q.json"), "--where", "even=true")} == {True}
    assert run("count") == [{"count": 40}] and run("info")[0]["documents"] == 40
    run("export", str(tmp_path / "out"), "--limit", "5")
    assert spark.read.json(str(tmp_path / "out")).count() == 5
    assert run("bench", "--queries", "2")[0]["batch_qps"] > 0
