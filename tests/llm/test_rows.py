"""Documents without an id, and different documents under one id, are decided row by row."""

import random

import pytest

from veclith.llm import decontaminate, exact_dedup, near_dedup, substring_dedup

BASE = " ".join(f"w{k}" for k in range(40))
ITEM = "one two three four five six seven eight nine ten eleven twelve"


@pytest.fixture(scope="module")
def rows(spark):
    texts = [(1, BASE), (None, BASE), (None, "clean and without an id"), (7, BASE), (7, "another text under the same id"), (None, BASE + " end"), (8, BASE + " end"), (8, "clean as well, under an id that loses"), (9, "so " + ITEM), (9, "nothing of it"), (None, "so it is " + ITEM)]
    return spark.createDataFrame(texts, "doc_id long, text string").cache()


def left(df):
    return sorted(((r["doc_id"] or 0, r["text"]) for r in df.collect()))


CLEAN = [(None, "clean and without an id"), (7, "another text under the same id"), (8, "clean as well, under an id that loses"), (9, "nothing of it")]


def want(*more):
    return sorted((i or 0, t) for i, t in [*CLEAN, *more])


def test_exact_dedup_by_row(rows):
    assert left(exact_dedup.deduplicate(rows)) == want((1, BASE), (8, BASE + " end"), (9, "so " + ITEM), (None, "so it is " + ITEM))


def test_near_dedup_by_row(rows):
    assert left(near_dedup.deduplicate(rows)) == want((1, BASE), (9, "so " + ITEM), (None, "so it is " + ITEM))


def test_decontaminate_by_row(spark, rows):
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    for limit in (500_000, 0):
        assert left(decontaminate.decontaminate(rows, bench, broadcast_rows=limit)) == want((1, BASE), (None, BASE), (7, BASE), (None, BASE + " end"), (8, BASE + " end"))


def test_substring_dedup_by_row(spark):
    passage = "Here is a sentence that many documents have. And a second one with several words in it! "
    clean = ["First words of a clean text. Then more of it. And a third one. ", "Other words under an id. They are like nothing else. So they stay. "]
    texts = [(1, "It starts. " + passage), (None, passage + "The end of one."), (None, clean[0]), (2, passage + "Its end."), (2, clean[1])]
    assert left(substring_dedup.remove(spark.createDataFrame(texts, "doc_id long, text string"))) == sorted([(1, texts[0][1]), (0, "The end of one."), (0, clean[0]), (2, "Its end."), (2, clean[1])])


def test_substring_dedup_finds_passages_without_sentence_ends(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(3))
    words = lambda n: " ".join(word() for _ in range(n))
    signs = lambda n: "".join(chr(rng.randrange(0x4E00, 0x9FA0)) for _ in range(n))
    one, two, bars, line = words(51), words(20) + ". " + words(31), " | ".join(word() for _ in range(40)), signs(60)
    texts = []
    for passage in (one, two, bars):
        texts += [words(5) + " " + passage + " " + words(9) + ".", words(40) + " " + passage + " " + words(40) + "."]
    texts += [signs(20) + line + signs(10), signs(30) + line]
    rows = list(enumerate([*texts, words(200)]))
    got = {r["doc_id"]: r for r in substring_dedup.remove(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        # the first of each stays, as what nobody shares does; a copy keeps no 51 words of the passage
        assert (got[i]["text"] == text) == (i % 2 == 0) == (got[i]["n_removed"] == 0), i
    cut = lambda t, n: {tuple(t[k : k + n]) for k in range(len(t) - n + 1)}
    for i in (1, 3, 5):
        assert not cut(got[i]["text"].split(), 51) & cut(texts[i - 1].split(), 51)
        assert got[i]["text"].split()[:40] == texts[i].split()[:40] and got[i]["text"].split()[-40:] == texts[i].split()[-40:]
    assert not cut(got[7]["text"], 51) & cut(texts[6], 51) and got[7]["text"].startswith(texts[7][:30])


def test_windows_are_shared(spark):
    rng = random.Random(8)
    words = lambda n: [rng.choice("abcdefghij") * rng.randint(1, 5) + rng.choice(["", "é", "日本"]) for _ in range(n)]
    for _ in range(200):
        passage, a, b = words(51), words(rng.randint(0, 60)), words(rng.randint(0, 60))
        taken = substring_dedup.Windows([" ".join([*a, *passage, *b]), "", "\n".join(passage)])
        assert set(taken.value[taken.row == 0]) & set(taken.value[taken.row == 2])


def test_pii_of_awkward_addresses(spark):
    from veclith.llm import pii

    texts = ["x@" + "a." * 100_000 + "1", "éü@example.com and éü@example.com", "日本@example.com", "x@" + "ab." * 126 + "com", "Ωμέγα@x.org", "ПОЧТА@x.org"]
    docs = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(texts)], "doc_id long, text string, __found string")
    out = pii.pseudonymise(docs, "key")
    got = {r["doc_id"]: r for r in out.collect()}
    assert got[0]["text"] == texts[0] and got[2]["text"] == texts[2] and got[2]["n_email"] == 0
    assert all(got[i]["text"] != texts[i] for i in (1, 3, 4, 5)) and got[1]["n_email"] == 2 and len(set(got[1]["text"].split(" and "))) == 1
    assert {r["__found"] for r in got.values()} == {"kept"}
    back = {r["doc_id"]: r["text"] for r in pii.pseudonymise(out, "key", reverse=True).collect()}
    assert back == dict(enumerate(texts))


def test_only_letters_have_a_language():
    from veclith.llm import language_id

    assert all(language_id.counts(t) is None for t in ("½ ² Ⅷ ①", "12 ٣", "_", "", None)) and language_id.counts("½a") is not None
    assert [language_id._BETWEEN.sub("", c) for c in "aÉ日ǅªʰ"] == list("aÉ日ǅªʰ")


def test_squeezed_is_the_pattern(spark):
    import re

    from pyspark.sql import functions as F

    from veclith.llm import common

    rng = random.Random(5)
    texts = ["".join(rng.choice("ab \t\n\x0b\f\r\x1c\u0085é") for _ in range(rng.randint(0, 12))) for _ in range(400)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", common.squeezed(F.col("t")).alias("s")).collect()
    assert all(r["s"] == re.sub("[\x20\x09-\x0d]+", " ", r["t"]) for r in got)


def test_extra_columns_with_clashing_names(spark):
    from veclith.llm import pieces, pii

    names = ["_id", "_key", "_text", "_chunk", "_unit", "_th", "_s", "_x", "__gone", "__found", "__lost", "_n", "_comp"]
    docs = spark.createDataFrame([(i, f"Text number {i}. It has two sentences of ten words or so in it. " * 2, *names) for i in range(3)], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    import public_tokenizers

    assert pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model")).count() == 3
    for out in (pii.pseudonymise(docs, "k"), substring_dedup.remove(docs), near_dedup.deduplicate(docs), exact_dedup.deduplicate(docs)):
        rows = out.collect()
        assert rows and all(r[n] == n for r in rows for n in names)
