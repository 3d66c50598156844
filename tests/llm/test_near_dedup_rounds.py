"""What the second round of near_dedup expands, and that it finds every link all the same."""

import os
import random
import re

from veclith.llm import near_dedup

WORDS = [f"w{i}" for i in range(4000)]


def jaccard(x, y):
    a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (x.split(), y.split()))
    return len(a & b) / len(a | b)


def components(texts):
    least = list(range(len(texts)))
    links = [(i, j) for i in range(len(texts)) for j in range(i) if jaccard(texts[i], texts[j]) >= 0.75]
    for _ in texts:
        for i, j in links:
            least[i] = least[j] = min(least[i], least[j])
    return least


def edited(rng, text, n):
    words = text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = rng.choice(WORDS)
    return " ".join(words)


def stored_names(monkeypatch):
    found, stored = {}, near_dedup.common.stored

    def note(df, name):
        found[name] = stored(df, name)
        return found[name]

    monkeypatch.setattr(near_dedup.common, "stored", note)
    return found


def test_settled_pairs_of_single_nodes_are_not_expanded_again(spark, monkeypatch):
    rng = random.Random(4)
    # pairs that share more than half of their shingles, but are not similar
    texts = []
    for _ in range(20):
        words = rng.choices(WORDS, k=130)
        texts += [" ".join(words[:110]), " ".join(words[20:])]
    assert components(texts) == list(range(len(texts)))
    found = stored_names(monkeypatch)
    got = near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == dict(enumerate(range(len(texts))))
    assert found["met"].count() == 0


def test_components_that_meet_often_lose_no_link(spark, monkeypatch):
    rng = random.Random(5)
    texts = []
    for _ in range(12):
        base = " ".join(rng.choices(WORDS, k=200))
        chain = [base]
        # a chain of copies: the ends are not similar to each other, its links are
        for _ in range(5):
            chain.append(edited(rng, chain[-1], rng.randrange(2, 7)))
        texts += chain + [edited(rng, base, 10) for _ in range(3)]
    rng.shuffle(texts)
    found = stored_names(monkeypatch)
    got = near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == dict(enumerate(components(texts)))
    assert found["met"].count() > 0 and found["few_pairs"].count() > 0


def test_shingles_of_two_sets_count_as_frequent(spark):
    # a group of near copies has two members in few of the windows that are counted, and three in hardly any
    words = random.Random(6).choices(WORDS, k=60)
    docs = spark.createDataFrame([(1, " ".join(words[:50])), (2, " ".join(words[10:]))], "doc_id long, text string").coalesce(1)
    values, ranks = near_dedup._frequent(near_dedup._survey(docs, "doc_id", "text"))
    assert len(values) == 36 and sorted(ranks) == list(range(1, 37))


def test_components_meet_where_their_lists_do_not_go_on_together(spark):
    lists = {1: range(10, 20), 2: [s for s in range(10, 20) if s != 15], 3: range(10, 20)}
    rows = [(s, key, 50, 50 - k, list(held)[k - 1] if k else None) for key, held in lists.items() for k, s in enumerate(held)]
    nodes = spark.createDataFrame(rows, "_s long, _key long, _n int, _l int, _p long")
    labels = spark.createDataFrame([(1, 1), (2, 1)], "_node long, _comp long")
    for tried in (False, True):
        met = near_dedup._met(nodes, labels, tried).select("_s", "_comp_a", "_comp_b").collect()
        # the first list, and the one where a node comes from another list than the others
        assert sorted(map(tuple, met)) == [(10, 1, 3), (16, 1, 3)]


def test_fragments_are_dealt_out_once_and_go_when_read(spark, monkeypatch):
    rng = random.Random(7)
    base = " ".join(rng.choices(WORDS, k=80))
    texts = [base, edited(rng, base, 1), " ".join(rng.choices(WORDS, k=80))]
    plans, paths, stored, scratch = [], [], near_dedup.common.stored, near_dedup.common.scratch

    def note(df, name):
        if name == "fragments":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stored(df, name)

    def made(session, name):
        paths.append((name, scratch(session, name)))
        return paths[-1][1]

    monkeypatch.setattr(near_dedup.common, "stored", note)
    monkeypatch.setattr(near_dedup.common, "scratch", made)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert {r["doc_id"]: r["component_id"] for r in got} == {0: 0, 1: 0, 2: 2}
    # one exchange of the fragments and one of the nodes, both by the node
    for plan in plans:
        assert [re.sub(r"#\d+L?", "", x) for x in re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan)] == ["_key", "_key"]
    kept = {name for name, path in paths if os.path.exists(re.sub("^file:/+", "/", path))}
    assert plans and "star" in kept and not kept & {"lists", "fragments"}
