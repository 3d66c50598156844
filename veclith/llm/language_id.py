"""Language identification in two levels.

Texts become counts of hashed character n-grams. Linear support vector machines, one
against the rest, pick the language family; inside a family, machines for each pair of
languages vote, so closely related languages are told apart by a model that has seen only
those two. Margins are scaled to probabilities on the training rows.

Training reads at most ``TRAINING_ROWS`` rows in an order by hash of the id, in equal shares
for the languages; their features are made on the executors. Prediction is one pass over
the documents without a shuffle.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

#: Bound of the training sample, the same at every size of input.
TRAINING_ROWS = 6000
BUCKETS = 2048
#: Families of languages; a language that isn't listed is its own family.
FAMILIES = {
    "germanic": "af da de en fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr uz",
    "indic": "bn gu hi mr ne pa ur",
    "semitic": "am ar he mt",
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes.split()}


def _runs(codes: list[int]) -> str:
    """A character class body of ascending code points."""
    cuts = [0, *(k for k in range(1, len(codes)) if codes[k] != codes[k - 1] + 1), len(codes)]
    return "".join(f"{chr(codes[a])}-{chr(codes[b - 1])}" for a, b in zip(cuts, cuts[1:], strict=False) if a < b)


#: Everything but letters: signs that Python counts as word characters (halves, Roman numerals, digits) too.
_BETWEEN = re.compile(r"[\W_" + _runs([c for c in range(0x110000) if chr(c).isalnum() and not chr(c).isalpha()]) + "]+")
#: Odd multipliers, one a place in an n-gram.
_FACTORS = tuple(np.uint32(0x9E3779B1 * (2 * k + 1) & 0xFFFFFFFF) for k in range(3))


def family(code: str) -> str:
    return _FAMILY.get(code.lower()[:2] if len(code) > 2 and code[2] in "-_" else code.lower(), f"only {code}")


def counts(text: str | None) -> np.ndarray | None:
    """How often each bucket of 1- to 3-grams of lower-cased letters occurs; null without letters."""
    letters = _BETWEEN.sub(" ", (text or "").lower()).strip()
    if not letters:
        return None
    total, size = np.zeros(BUCKETS, np.float64), 1 << 20
    letters = f" {letters} "
    # pieces that overlap by two, so that no n-gram is lost and memory stays bounded
    for at in range(0, len(letters), size):
        c = np.frombuffer(letters[at : at + size + 2].encode("utf-32-le"), np.uint32)
        h = np.zeros(len(c), np.uint32)
        for n, factor in enumerate(_FACTORS):
            if len(c) <= n:
                break
            h = h[: len(c) - n] + c[n:] * factor
            mixed = (h ^ h >> np.uint32(15)) * np.uint32(0x85EBCA6B + 2 * n)
            # n-grams that start in the overlap belong to the next piece
            total += np.bincount(mixed[:size] >> np.uint32(21), minlength=BUCKETS)
    return total


def features(found: np.ndarray) -> np.ndarray:
    """Square roots of the counts at length one, so that long texts weigh as short ones."""
    x = np.sqrt(found)
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


@dataclass(frozen=True)
class Machine:
    """A linear machine for ``one`` against ``other`` (null: the rest) and its scaling."""

    one: str
    other: str | None
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((x @ self.weights + self.bias) * self.slope + self.offset, -30, 30)))


@dataclass(frozen=True)
class Model:
    languages: dict[str, list[str]]
    between: list[Machine]
    within: dict[str, list[Machine]]

    def predict(self, x: np.ndarray) -> tuple[list[str | None], np.ndarray]:
        """Language and score of each row."""
        n, names = len(x), sorted(self.languages)
        if not names:
            return ["und"] * n, np.zeros(n)
        p = np.column_stack([m.probability(x) for m in self.between]) if self.between else np.ones((n, 1))
        p = p / np.maximum(p.sum(1, keepdims=True), 1e-12)
        best, score = p.argmax(1), p.max(1)
        out: list = [None] * n
        for k, name in enumerate(names):
            rows = np.flatnonzero(best == k)
            codes = self.languages[name]
            votes = np.zeros((len(rows), len(codes)))
            for m in self.within.get(name, ()):
                q = m.probability(x[rows])
                votes[:, codes.index(m.one)] += q
                votes[:, codes.index(m.other)] += 1 - q
            pairs = max(1, len(codes) - 1)
            won = votes.argmax(1) if len(codes) > 1 else np.zeros(len(rows), int)
            for i, w in zip(rows, won, strict=True):
                out[i] = codes[w]
            if len(codes) > 1:
                score[rows] *= votes.max(1) / pairs if len(rows) else 1
        return out, np.clip(score, 0, 1)


def _machine(x: np.ndarray, y: np.ndarray, one: str, other: str | None, cost: float = 20.0, steps: int = 200) -> Machine:
    """Squared-hinge support vector machine by accelerated gradient descent; classes weigh the same."""
    s = np.where(y, 1.0, -1.0)
    weight = np.where(y, 0.5 / max(1, y.sum()), 0.5 / max(1, (~y).sum()))
    w, before, b, b_before, rate = np.zeros(x.shape[1]), np.zeros(x.shape[1]), 0.0, 0.0, 1 / (2 * cost * 2 + 1)
    for k in range(steps):
        v, c = w + k / (k + 3) * (w - before), b + k / (k + 3) * (b - b_before)
        slack = np.maximum(0, 1 - s * (x @ v + c)) * weight * s
        before, b_before = w, b
        w, b = v - rate * (v - 2 * cost * (x.T @ slack)), c + rate * 2 * cost * slack.sum()
    margin = x @ w + b
    slope, offset = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(margin * slope + offset, -30, 30)))
        g, h = weight * (y - p), weight * p * (1 - p)
        hess = np.array([[(h * margin * margin).sum() + 1e-4, (h * margin).sum()], [(h * margin).sum(), h.sum() + 1e-4]])
        step = np.linalg.solve(hess, [(g * margin).sum() - 1e-4 * slope, g.sum()])
        slope, offset = slope + np.clip(step[0], -2, 2), offset + np.clip(step[1], -2, 2)
    return Machine(one, other, w, float(b), float(slope), float(offset))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", learn=lambda c: ~common.held_out(c), rows: int = TRAINING_ROWS) -> Model:
    """Learn from rows with a language of which ``learn(id column)`` holds.

    Rows without letters teach nothing. With a single language every text gets it; without
    any the model predicts ``und``.
    """
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).where(learn(id_col)).select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang"))
    counts_of = [(r[0], r[1]) for r in known.groupBy("_lang").count().orderBy(F.desc("count"), "_lang").limit(rows).collect()]
    if not counts_of:
        return Model({}, [], {})
    share = max(1, rows // len(counts_of))
    # of each language the rows with the smallest hashes: all that can be are below twice the share expected
    bounds = [(code, max(-(1 << 63), min((1 << 63) - 1, int(-(1 << 63) + min(1.0, (2 * share + 1000) / n) * (1 << 64))))) for code, n in counts_of]
    limits = docs.sparkSession.createDataFrame(bounds, "_lang string, _bound long")
    few = known.withColumn("_hash", F.xxhash64("_id")).join(F.broadcast(limits), "_lang").where("_hash <= _bound")
    order = W.partitionBy("_lang").orderBy("_hash", "_id")
    chosen = few.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= share).select("_id", "_lang")

    def measure(batches):
        import pyarrow as pa

        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                some = batch.slice(start, 200)
                found = [(c.astype(np.float32).tobytes(), code) for t, code in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True) if (c := counts(t)) is not None]
                yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in found], pa.binary()), pa.array([c for _, c in found], pa.string())], names=["x", "lang"])

    sample = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_id").select("_text", "_lang")
    seen = sample.mapInArrow(measure, "x binary, lang string").toPandas().sort_values(["lang", "x"])
    x = features(np.frombuffer(b"".join(seen["x"]), np.float32).reshape(-1, BUCKETS))
    lang = seen["lang"].to_numpy()
    groups: dict[str, list[str]] = {}
    for code in sorted(set(lang)):
        groups.setdefault(family(code), []).append(code)
    of = np.array([family(c) for c in lang])
    between = [_machine(x, of == name, name, None) for name in sorted(groups)] if len(groups) > 1 else []
    within = {}
    for name, members in groups.items():
        pairs = [(a, b) for i, a in enumerate(members) for b in members[i + 1 :]]
        within[name] = [_machine(x[(lang == a) | (lang == b)], lang[(lang == a) | (lang == b)] == a, a, b) for a, b in pairs]
    return Model(groups, between, within)


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score after it.

    Null texts and texts without a letter are ``und`` with score 0. Whole texts count,
    whatever their length; repeated rows get equal results; an empty table gives an empty
    result; input columns named lang_pred or score are replaced.
    """
    base = docs.drop("lang_pred", "score")
    names, at = base.columns, base.columns.index(text_col)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields), "lang_pred string, score double"])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                some = batch.slice(start, 500)
                found = [counts(t) for t in some.column(at).to_pylist()]
                langs, scores = ["und"] * len(found), np.zeros(len(found))
                rows = [i for i, c in enumerate(found) if c is not None]
                if rows:
                    got, p = model.predict(features(np.array([found[i] for i in rows], np.float32)))
                    scores[rows] = p
                    for i, code in zip(rows, got, strict=True):
                        langs[i] = code
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(langs, pa.string()), pa.array(scores)], names=[*names, "lang_pred", "score"])

    return base.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    model = fit(docs)
    return predict(docs.select("doc_id", "text"), model).select("doc_id", common.held_out().alias("held_out"), "lang_pred", "score")
