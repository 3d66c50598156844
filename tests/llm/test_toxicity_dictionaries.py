"""Why the dictionaries are raw content: what zstandard's own trainer makes of the same rows separates less."""

import zlib

import numpy as np
import pytest
import zstandard

from veclith.llm import toxicity

ROOT = "/root/testdata/sf0.1"


def area(scores, truth) -> float:
    """The chance that a toxic row scores higher than an ordinary one; ties count half."""
    order = np.argsort(scores, kind="stable")
    values = np.asarray(scores)[order]
    rank = np.empty(len(order))
    rank[order] = (np.searchsorted(values, values, "left") + np.searchsorted(values, values, "right") + 1) / 2
    n = truth.sum()
    return (rank[truth].sum() - n * (n + 1) / 2) / (n * (len(truth) - n))


@pytest.fixture(scope="module")
def rows(spark):
    docs, labels = (spark.read.parquet(f"{ROOT}/{name}.parquet") for name in ("documents", "labels"))
    found = docs.join(labels.where("toxic in (0, 1)"), "doc_id").where("text is not null").orderBy("doc_id").select("doc_id", "text", "toxic").collect()
    held = [zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in found]
    return [r for r, h in zip(found, held, strict=True) if not h], [r for r, h in zip(found, held, strict=True) if h]


def test_trained_dictionaries_separate_less(spark, rows):
    train, test = rows
    truth = np.array([r["toxic"] == 1 for r in test])
    model = toxicity.fit(spark.read.parquet(f"{ROOT}/documents.parquet"), spark.read.parquet(f"{ROOT}/labels.parquet"))
    scorer = toxicity.Scorer(model)
    raw = area([scorer.score(r["text"]) for r in test], truth)
    best = 0.0
    for size in (16384, 28672):
        windows = [[w for r in train if r["toxic"] == k for w in toxicity.windows(toxicity.words(r["text"]))][:60_000] for k in (0, 1)]
        ordinary, toxic = (zstandard.ZstdCompressor(level=toxicity.LEVEL, dict_data=zstandard.train_dictionary(size, some), write_content_size=False, write_dict_id=False).compress for some in windows)
        gains = [np.sort([len(ordinary(w)) - len(toxic(w)) for w in toxicity.windows(toxicity.words(r["text"]))] or [0])[::-1] for r in test]
        best = max(best, *(area([f(g) for g in gains], truth) for f in (np.max, np.mean, lambda g: g[:3].mean())))
    print(f"areas under the curve on held-out rows: raw content {raw:.3f}, trained {best:.3f}")
    assert raw > 0.75 and raw > best + 0.1
