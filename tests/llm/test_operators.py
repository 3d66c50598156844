"""Training-data operators against brute force on small tables with the awkward cases."""

import collections
import hashlib
import re
import struct
import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from veclith.llm import decontaminate, exact_dedup, language_id, near_dedup, pieces, pii, substring_dedup, token_records, toxicity, warc

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = "word " * 30_000
TEXTS = [
    "One two three four five six seven eight nine ten eleven.",
    "One  two\nthree four five six seven eight nine ten eleven.",
    "one two three four five six seven eight nine ten eleven.",
    "",
    None,
    " \t\n",
    "x",
    "É é ÉÉ ı İ 日本語 text",
    LONG,
    LONG + "end",
    "a b c d",
    "a b c d",
    "The needle is one two three four five six seven eight nine ten and more.",
]


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empty and long texts, repeated rows, clashing names of further columns."""
    rows = [(i, t, "en", "s", i, True, "k") for i, t in enumerate(TEXTS)]
    rows += [(1000, TEXTS[0], None, None, None, None, None), (1000, TEXTS[0], None, None, None, None, None), (None, "no id at all", "en", "s", 1, True, "k")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, _id long, kept boolean, _key string").cache()


def words5(text):
    found = [w for w in re.split("[\x20\x09-\x0d]+", (text or "").translate(UP)) if w]
    return frozenset(tuple(found[k : k + 5]) for k in range(len(found) - 4)) if len(found) >= 5 else frozenset([tuple(found)] if found else [])


def test_exact_dedup(docs):
    norm = lambda t: re.sub("[\x20\x09-\x0d]+", " ", t or "")
    rows = [(r["doc_id"], norm(r["text"])) for r in docs.collect()]
    ids = collections.defaultdict(list)
    for i, t in rows:
        ids[t].append(i)
    want = sorted((repr(i), repr(k := min((x for x in ids[t] if x is not None), default=None)), len(ids[t]), i == k, hashlib.sha256(t.encode()).hexdigest()) for i, t in rows)
    got = sorted((repr(r["doc_id"]), repr(r["keep_id"]), r["group_size"], r["kept"], r["text_sha256"]) for r in exact_dedup.decide(docs).collect())
    assert got == want
    left = exact_dedup.deduplicate(docs)
    assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} == {i for i, t in rows if i == min((x for x in ids[t] if x is not None), default=None)}
    assert exact_dedup.decide(docs.limit(0)).count() == 0


def brute_marks(docs, items, window=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(UP))
    out = []
    for i, t in docs:
        w, hit, found = split(t), set(), set()
        for item, text in items:
            x = split(text)
            n = min(window, len(x))
            grams = {tuple(x[k : k + n]) for k in range(len(x) - n + 1)} if n else set()
            for k in range(len(w) - n + 1) if n else ():
                if tuple(w[k : k + n]) in grams:
                    hit.update(range(k, k + n))
                    found.add("" if item is None else str(item))
        out.append((repr(i), len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


@pytest.mark.parametrize("limit", [500_000, 0])
def test_decontaminate(spark, docs, limit):
    items = [(1, "So one two three four five six seven eight nine ten, it is"), (2, "a b c"), (10, "x"), (3, ""), (4, None), (5, "word " * 12), (5, "word " * 12), (None, "no id"), (6, "four five six seven eight nine ten eleven twelve thirteen")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((repr(r["doc_id"]), r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in decontaminate.mark(docs, bench, broadcast_rows=limit).collect())
    assert got == brute_marks([(r["doc_id"], r["text"]) for r in docs.collect()], items)
    assert not any(r["contaminated"] for r in decontaminate.mark(docs, bench.limit(0), broadcast_rows=limit).collect())
    assert decontaminate.mark(docs.limit(0), bench, broadcast_rows=limit).count() == 0
    left = decontaminate.decontaminate(docs, bench)
    assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} == {3, 4, 5, 7}


def brute_components(rows):
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [words5(t) for _, t in rows]
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted((repr(i), len(sets[k]), repr(least.get(find(k), i) if sets[k] else i)) for k, (i, _) in enumerate(rows))


def test_near_duplicates(spark, docs):
    base = [f"w{k}" for k in range(60)]
    more = []
    for k in range(30):
        # a chain whose ends aren't similar, and copies with one to many changed words
        more.append((2000 + k, " ".join(base[k : k + 40])))
        more.append((3000 + k, " ".join("changed" if j % (2 + k) == 1 and j > 30 else w for j, w in enumerate(base))))
        more.append((4000 + k, " ".join([*(f"own{k}_{j}" for j in range(25)), *base[:12]])))
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    got = sorted((repr(r["doc_id"]), r["n_shingles"], repr(r["component_id"])) for r in near_dedup.near_duplicates(table).collect())
    assert got == brute_components([(r["doc_id"], r["text"]) for r in table.collect()])
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0
    assert near_dedup.deduplicate(docs).columns == docs.columns


def test_substring_dedup(spark, docs):
    passage = "Here is a sentence that many have. And a second one with several words in it! Is this the third of them? "
    rows = [(1, "First words alone. " + passage + "The end of one."), (2, "Another start here. " + passage + "And its end."), (3, passage + passage + "Last."), (4, "Clean text. Nothing else is like it. At all."), (5, None)]
    got = {r["doc_id"]: r for r in substring_dedup.remove(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["text"] == rows[0][1] and got[4]["text"] == rows[3][1] and got[5]["text"] is None
    assert got[2]["text"] == "Another start here. And its end." and got[2]["n_removed"] == 3
    assert got[3]["text"] == "Last." and got[3]["n_sentences"] == 7
    out = substring_dedup.remove(docs)
    assert out.columns == [*docs.columns, "n_sentences", "n_removed"] and out.count() == docs.count()
    assert "".join(substring_dedup.sentences("A. B!\n\nC? d e.f")) == "A. B!\n\nC? d e.f"
    assert substring_dedup.remove(docs.limit(0)).count() == 0


def test_substring_spans_brute(spark):
    import random

    rng = random.Random(3)
    pool = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 4) for _ in range(rng.randint(1, 9))) + ". " for _ in range(12)]
    rows = [(i, "".join(rng.choice(pool) for _ in range(rng.randint(1, 15)))) for i in range(40)]
    first, want = {}, {}
    for i, t in rows:
        parts = substring_dedup.sentences(t)
        own, gone = {}, set()
        for value, a, b in substring_dedup.spans(parts):
            if first.setdefault(value, i) != i:
                gone.update(range(a, b + 1))
            elif own.setdefault(value, (a, b))[0] != a:
                gone.update(range(max(a, own[value][1] + 1), b + 1))
            own.setdefault(value, (a, b))
        # a span of another document is marked at its first place only, later ones repeat it
        for value, a, b in substring_dedup.spans(parts):
            if own[value][0] != a:
                gone.update(range(max(a, own[value][1] + 1), b + 1))
        want[i] = "".join(p for k, p in enumerate(parts) if k not in gone)
    got = {r["doc_id"]: r["text"] for r in substring_dedup.remove(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i for i in want if got[i] != want[i]} == set()


def test_token_records(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    hashed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    rows = [(i, t) for i, _, t in sorted(((r["doc_id"], r["h"], r["text"]) for r in hashed.collect()), key=lambda r: (r[0] is not None, r[0] or 0, *r[1:]))]
    folder = f"file://{tmp_path}/records"
    manifest = token_records.write(docs, folder, path, shard_bytes=2000)
    want, start = [], 0
    for i, t in rows:
        ids = tokenizer.encode(t, add_special_tokens=False).ids + [1]
        want.append((i, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    got = token_records.summary(spark, folder).orderBy("start").collect()
    assert [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got] == want and len(manifest["shards"]) > 1
    # random access through the index agrees with the stream
    for r in got[:6]:
        doc_id, ids = token_records.read_record(f"{folder}/{r['shard']}", r["offset"])
        assert doc_id == r["doc_id"] and len(ids) == r["n_tokens"] and r["offset"] in token_records.read_index(f"{folder}/{r['shard']}")
    assert token_records.write(docs.limit(0), f"{folder}0", path)["shards"] == [] and token_records.read(spark, f"{folder}0").count() == 0
    name = manifest["shards"][0]["name"]
    data = bytearray((tmp_path / "records" / name).read_bytes())
    data[20] ^= 1
    (tmp_path / "records" / name).write_bytes(data)
    with pytest.raises(Exception, match="wrong data check"):
        token_records.summary(spark, folder).collect()


def test_word_encoder_is_the_library():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, own = Tokenizer.from_file(path), token_records.WordEncoder(path, None, cache_words=8)
    texts = ["a\x1cb \x1f c", "<|endoftext|> x<|endoftext|>y", "é é ǅ İstanbul ΣΑΣ it's don't 'll", " x y\u0085z", "ß Straße ÀÉ++ 12ab", "w" * 300, "don' t's x.y ÿ×÷"]
    for text, ids in zip(texts, own.encode(texts), strict=True):
        assert list(struct.unpack(f"<{len(ids) // 2}H", ids)) == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_pieces_are_the_library(spark, docs):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    more = ["  a", "Hello  world\nfoo é", "aaaaaaaaaaaaaaaaaaaaaaaa", "\t\ttab\r\n", "日本語 😀", "   ", "<s> <0x0A>", "ababababab" * 30, " leading and trailing "]
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(5000 + i, t) for i, t in enumerate(more)], "doc_id long, text string"))
    ids = pieces.encode(table, path)
    got = collections.Counter((r["doc_id"], tuple(r["ids"])) for r in ids.collect())
    assert got == collections.Counter((r["doc_id"], tuple(library.encode(r["text"] or ""))) for r in table.collect())
    texts = {r["doc_id"]: r["text"] for r in ids.select("doc_id", pieces.decoded(F.col("ids"), path).alias("text")).collect()}
    assert all(texts[r["doc_id"]] == (r["text"] or "") for r in table.collect())
    assert pieces.encode(docs.limit(0), path).count() == 0


def small_model(path, kind, with_bytes):
    """A model of hand-set pieces; nothing is trained."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    model.trainer_spec.model_type = {"unigram": 1, "bpe": 2}[kind]
    model.trainer_spec.byte_fallback = with_bytes
    model.normalizer_spec.name = "identity"
    model.normalizer_spec.remove_extra_whitespaces = False
    model.normalizer_spec.add_dummy_prefix = model.normalizer_spec.escape_whitespaces = True
    kinds = pb.ModelProto.SentencePiece
    model.pieces.add(piece="<unk>", score=0, type=kinds.UNKNOWN)
    for b in range(256 if with_bytes else 0):
        model.pieces.add(piece=f"<0x{b:02X}>", score=0, type=kinds.BYTE)
    words = ["ab", "ba", "aba", "abab", "▁a", "▁ab", "bc", "abc", "cab", "▁▁", "aa", "aaa", "aaaa", "ee", "eé", "▁c", "cc"]
    for k, piece in enumerate([*words, *"abce▁é"]):
        model.pieces.add(piece=piece, score=-0.375 * k - 1 if kind == "unigram" else -float(k), type=kinds.NORMAL)
    path.write_bytes(model.SerializeToString())
    return str(path)


@pytest.mark.parametrize("kind", ["unigram", "bpe"])
@pytest.mark.parametrize("with_bytes", [True, False])
def test_pieces_of_small_models(spark, tmp_path, kind, with_bytes):
    import random

    import sentencepiece

    path = small_model(tmp_path / "m.model", kind, with_bytes)
    library, rng = sentencepiece.SentencePieceProcessor(model_file=path), random.Random(7)
    texts = ["abc日本語 de", "日本", "a 日 本 b", "", None, "aaaaaaa", "xyz", *("".join(rng.choice("abc eé日a") for _ in range(rng.randint(1, 60))) for _ in range(300))]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["ids"] for r in pieces.encode(table, path).collect()}
    if kind == "bpe":
        with pytest.raises(ValueError):  # "aba" would be made before "ab" was, in another order of pieces
            pieces._merges("aba", {"aba": 0, "ab": 1})
    assert [i for i, t in enumerate(texts) if got[i] != library.encode(t or "")] == []


def test_pieces_of_long_units(spark):
    import random
    import time

    import sentencepiece

    path, rng = public_tokenizers.path("piece_bpe_32k.model"), random.Random(2)
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = ["a" * 200_000, "".join(rng.choice("aehinorst") for _ in range(200_000)), "日本語" * 70_000, "-" * 300 + "x", "ab" * 200]
    own, vocabulary = pieces.splitter(pieces.load(path)), pieces.load(path)
    began = time.perf_counter()
    pieces.Units(own.words(own.parts(texts[1]))[0], own)
    assert time.perf_counter() - began < 10
    got = {r["doc_id"]: r["ids"] for r in pieces.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path).collect()}
    assert all(got[i] == library.encode(t) for i, t in enumerate(texts))
    ends = pieces.np.cumsum([0, *(len(got[i]) for i in range(len(texts)))])
    back = pieces.texts_of(vocabulary, pieces.np.concatenate([got[i] for i in range(len(texts))]), ends)
    assert [b.decode() for b in back] == texts


def test_warc(spark, tmp_path):
    html = ["<p>a</p>", "<p>é</p>", "<p>a</p>", None, "", "x" * 100_000]
    rows = [(-5 if i == 1 else i, f"http://x/{i}", h, "clash") for i, h in enumerate(html)] + [(None, None, "<p>a</p>", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, _id string")
    folder = f"file://{tmp_path}/warc"
    manifest = warc.write(pages, folder, shard_bytes=200)
    got = {r["page_id"]: r for r in warc.read(spark, folder).collect()}
    assert len(got) == 7 and got[2]["record_type"] == "revisit" and got[2]["refers_to"] == 0 and got[2]["payload_bytes"] == 8
    assert got[4]["refers_to"] == 3 and got[None]["record_type"] == "response" and got[-5]["payload"].decode() == "<p>é</p>"
    assert got[2]["payload_digest"] == got[0]["payload_digest"] == warc.payload_digest(b"<p>a</p>")
    again = warc.write(pages.repartition(3), f"{folder}2", shard_bytes=200)
    assert {s["sha256"] for s in again["shards"]} == {s["sha256"] for s in manifest["shards"]}
    assert warc.write(pages.limit(0), f"{folder}0")["shards"] == [] and warc.read(spark, f"{folder}0").count() == 0
    for i in (0, 1, -1, 2**63 - 1, -(2**63)):
        assert warc.page_of(warc.record_id(i)) == i
    assert {r["record_type"] for r in (warc.write(pages, f"{folder}3", min_bytes=9), warc.read(spark, f"{folder}3"))[1].collect()} == {"response"}


def plain_feistel(values, radices, key, tweak):
    v = list(values)
    half = len(v) // 2
    for r in range(pii.ROUNDS):
        left = r % 2 == 0
        text = ",".join(map(str, v[half:] if left else v[:half]))
        for i in range(half) if left else range(half, len(v)):
            at = i if left else i - half
            block = hashlib.sha256(f"{key}|{tweak}|{r}|{at // 8}|{text}".encode()).hexdigest()
            v[i] = (v[i] + int(block[at % 8 * 8 : at % 8 * 8 + 8], 16)) % radices[i]
    return v


def test_pii(spark, docs):
    texts = [
        "mail und.34@mail7.example.com, und.34@mail7.example.com!!",
        "+1 (017) 555-7713%%% and 4845168114407329 9807915762804490 4111 1111 1111 1111.",
        "ip 233.254.104.120!! 300.1.1.1 v 1.2.3.4.5 4.0.",
        "born 1990-02-28, 31.12.1999, 02/30/2001, 13/02/2001 ssn 123-45-6789 000-11-2222",
        "IBAN DE89370400440532013000 GB82WEST12345698765432 DE89370400440532013001",
        "again +1 (017) 555-7713 und.34@mail7.example.com 0000000000000000",
    ]
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(6000 + i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    out = pii.pseudonymise(table, "key")
    got = {r["doc_id"]: r for r in out.collect()}
    octets = ".".join(map(str, plain_feistel([233, 254, 104, 120], [256] * 4, "key", "ip")))
    assert got[6002]["text"] == f"ip {octets}!! 300.1.1.1 v 1.2.3.4.5 4.0."
    digits = "".join(map(str, plain_feistel(map(int, "0175557713"), [10] * 10, "key", "phone")))
    phone = f"+1 ({digits[:3]}) {digits[3:6]}-{digits[6:]}"
    assert got[6001]["text"].startswith(phone + "%%% and ") and phone in got[6005]["text"]
    card = "".join(map(str, plain_feistel(map(int, "484516811440732"), [10] * 15, "key", "card")))
    assert card in got[6001]["text"] and "9807915762804490" in got[6001]["text"] and "0000000000000000" in got[6005]["text"]
    assert (got[6001]["n_card"], got[6003]["n_date"], got[6003]["n_ssn"], got[6004]["n_iban"], got[6000]["n_email"]) == (2, 2, 1, 2, 2)
    assert "02/30/2001, 13/02/2001" in got[6003]["text"] and "000-11-2222" in got[6003]["text"]
    mail = re.search(r"\S+@mail7.example.com", got[6000]["text"])[0]
    assert got[6000]["text"].count(mail) == 2 and mail in got[6005]["text"] and "und.34@" not in got[6000]["text"]
    assert all(got[r["doc_id"]]["text"] == r["text"] for r in docs.collect())
    back = {r["doc_id"]: r["text"] for r in pii.pseudonymise(out, "key", reverse=True).collect()}
    assert all(back[r["doc_id"]] == r["text"] for r in table.collect())
    assert pii.pseudonymise(docs.limit(0), "key").count() == 0


SMALL = "/root/testdata/sf0.01"


def test_language_id(spark, docs):
    table = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = language_id.fit(table)
    got = language_id.predict(table.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1), model).agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert got >= 0.97
    out = {r["doc_id"]: r for r in language_id.predict(docs, model).collect()}
    assert {i for i, r in out.items() if r["lang_pred"] == "und"} == {3, 4, 5} and all(0 <= r["score"] <= 1 for r in out.values())
    assert language_id.predict(docs.limit(0), model).count() == 0
    assert language_id.predict(docs, language_id.fit(docs.limit(0))).where("lang_pred <> 'und'").count() == 0
    alone = language_id.fit(docs.where("lang is not null"))
    assert {r["lang_pred"] for r in language_id.predict(docs, alone).collect()} == {"en", "und"}
    assert language_id.family("pt-BR") == "romance" and language_id.family("xx") == "only xx"


def test_toxicity(spark, docs):
    rude = ["blockhead", "nitwit", "dunderhead", "numskull"]
    import random

    rng = random.Random(4)
    common_words = ["".join(rng.choice(["ta", "ri", "mo", "len", "sku", "dor", "pe"]) for _ in range(3)) for _ in range(200)]
    texts, labels = [], []
    for i in range(400):
        w = [rng.choice(common_words) for _ in range(60)]
        if toxic := i % 4 == 0:
            for _ in range(5):
                w[rng.randrange(60)] = rng.choice(rude)
        texts.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    table = spark.createDataFrame(texts, "doc_id long, text string")
    told = spark.createDataFrame([*labels, (77, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(table, told)
    got = toxicity.score(table, model).join(told, "doc_id").where(toxicity.common.held_out()).where("toxic is not null").collect()
    right = sum(r["predicted"] == r["toxic"] for r in got) / len(got)
    assert right >= 0.95
    out = toxicity.score(docs, model)
    assert out.columns == [*docs.columns, "score", "predicted"] and all(0 <= r["score"] < 0.7 for r in out.collect())
    assert {r["score"] for r in toxicity.score(docs, toxicity.fit(table, told.limit(0))).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_components(spark):
    from veclith.llm.components import components

    edges = [(k, k + 1) for k in range(40) if k not in (10, 25)] + [(100, 200), (200, 100), (7, 7)]
    got = {r[0]: r[1] for r in components(spark.createDataFrame(edges, "_a long, _b long")).collect()}
    assert {got[k] for k in range(11)} == {0} and {got[k] for k in range(11, 26)} == {11} and got[40] == 26 and got[200] == 100
    assert components(spark.createDataFrame([], "_a long, _b long")).count() == 0
