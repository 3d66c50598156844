"""Toxicity by compression distance: zstandard with a toxic and an ordinary dictionary.

Texts are cut into overlapping windows of a few words. A window that holds toxic words is
shorter under the toxic dictionary than under the ordinary one; how much, and in how many
windows, goes through a logistic calibration to a score.

Both dictionaries are raw content of the same length and share their larger part, frequent
ordinary words, so ordinary text compresses alike under both and differences are not noise.
The rest is, in the toxic one, the words that mark toxic training texts and, in the
ordinary one, further ordinary words. zstandard's own dictionary trainer picks what is
frequent, which is the same in both kinds of text, and does not separate them.
Of near copies in the training sample one is counted (they share one of ``SIGNS`` smallest
hashes of word pairs), or a much copied toxic text would make all its words look toxic.

Training reads labelled rows only, at most ``TOXIC_ROWS`` and ``ORDINARY_ROWS`` of them in an
order by hash of the id. Words are counted on the executors; the driver gets dictionaries of
bounded size and one short feature row a training row.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Bounds of the training sample, the same at every size of input.
TOXIC_ROWS, ORDINARY_ROWS = 4000, 12000
WINDOW, STEP, LEVEL = 8, 4, 9
COMMON_BYTES, MARK_BYTES = 12288, 16384
#: A word marks toxic text if it is that many times as frequent there.
CONTRAST = 20
SIGNS = 4
#: A rarer word marks toxic text if it begins like many that do: inflections of one stem.
BEGINNINGS = (4, 5, 6)
THRESHOLD = 0.7
_BETWEEN = re.compile(r"[\W\d_]+")
_LONGEST = 32


def words(text: str | None) -> list[str]:
    """Lower-cased runs of letters; longer ones than 32 are cut."""
    found = _BETWEEN.sub(" ", (text or "").lower()).split()
    if any(len(w) > _LONGEST for w in found):
        found = [w[k : k + _LONGEST] for w in found for k in range(0, len(w), _LONGEST)]
    return found


def windows(found: list[str], size: int = WINDOW, step: int = STEP) -> list[bytes]:
    """Runs of ``size`` words from every ``step``-th word on, none that only repeats the end of another."""
    return [" ".join(found[k : k + size]).encode() for k in range(0, max(1, len(found) - size + step), step)] if found else []


@dataclass(frozen=True)
class Model:
    """Dictionaries, calibration weights, and the means and deviations of the features."""

    toxic: bytes
    ordinary: bytes
    weights: tuple[float, ...] = ()
    means: tuple[float, ...] = ()
    deviations: tuple[float, ...] = ()


class Scorer:
    """Features and scores of texts; one a Python worker."""

    def __init__(self, model: Model):
        import zstandard

        def compressor(content: bytes):
            # an empty dictionary is refused; one blank does nothing
            known = zstandard.ZstdCompressionDict(content or b"        ", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(level=LEVEL)
            return zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_checksum=False, write_content_size=False, write_dict_id=False).compress

        self.model, self.toxic, self.ordinary = model, compressor(model.toxic), compressor(model.ordinary)

    def features(self, text: str | None) -> np.ndarray:
        """Of the gains of all windows: largest, means of the largest, mean, and how many reach 1 to 6 bytes."""
        toxic, ordinary = self.toxic, self.ordinary
        gain = np.array([len(ordinary(w)) - len(toxic(w)) for w in windows(words(text))] or [0], np.float64)
        top = np.sort(gain)[::-1]
        reached = np.array([(gain >= k).sum() for k in range(1, 7)])
        return np.concatenate([[top[0], top[:3].mean(), top[:8].mean(), gain.mean()], np.log1p(reached), reached / len(gain) ** 0.5])

    def score(self, text: str | None) -> float:
        if not self.model.weights:
            return 0.0
        x = (self.features(text) - self.model.means) / self.model.deviations
        return float(1 / (1 + np.exp(-np.clip(x @ self.model.weights[1:] + self.model.weights[0], -30, 30))))


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, learn, limits: tuple[int, int]) -> DataFrame:
    """(_id, _text, _toxic) of a bounded number of labelled rows, those with the smallest hash of the id."""
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_toxic")).where(F.col("_id").isNotNull() & F.col("_toxic").isin(0, 1)).where(learn("_id")).groupBy("_id").agg(F.max("_toxic").alias("_toxic"))
    order = [F.xxhash64("_id"), F.col("_id")]
    chosen = known.where("_toxic = 1").orderBy(*order).limit(limits[0]).unionByName(known.where("_toxic = 0").orderBy(*order).limit(limits[1]))
    # at most sum(limits) rows of two numbers
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_id")


def _different(sample: DataFrame) -> DataFrame:
    """(_text, _toxic) of the sample without rows that share a smallest hash with an earlier one."""

    def sign(batches):
        import pyarrow as pa
        import xxhash

        for batch in batches:
            ids, signs = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = words(text)
                pairs = np.array([xxhash.xxh3_64_intdigest(a + " " + b) for a, b in zip(found, found[1:], strict=False)] or [xxhash.xxh3_64_intdigest(repr(doc_id))], np.uint64)
                for k in range(SIGNS):
                    mixed = (pairs ^ pairs >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15 + 2 * k & (1 << 64) - 1)
                    ids.append(doc_id)
                    signs.append(int(mixed.min() >> np.uint64(4)) * SIGNS % (1 << 62) + k)
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column(0).type), pa.array(signs, pa.int64())], names=["_id", "_sign"])

    kind = sample.schema["_id"].dataType.simpleString()
    signs = sample.select("_id", "_text").mapInArrow(sign, f"_id {kind}, _sign long")
    first = signs.groupBy("_sign").agg(F.min("_id").alias("_first"))
    copies = signs.join(first, "_sign").where("_id <> _first").select("_id").distinct()
    return sample.join(copies, "_id", "left_anti").select("_text", "_toxic")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", learn=lambda c: ~common.held_out(c), limits: tuple[int, int] = (TOXIC_ROWS, ORDINARY_ROWS)) -> Model:
    """Learn from rows of which ``learn(id column)`` holds.

    Without toxic or ordinary rows, or without a word that marks toxic texts, the model
    gives every text the score 0. A label that differs between rows of an id is toxic.
    """
    sample = common.stored(_sample(docs, labels, id_col, text_col, label_col, learn, limits), "toxicity_sample")
    sample = common.stored(_different(sample), "toxicity_different")

    def count(batches):
        import pyarrow as pa

        for batch in batches:
            found, starts, kinds = [], [], []
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = set(words(text))
                begin = {w[:k] for w in own for k in BEGINNINGS if len(w) > k}
                found += [*own, *begin]
                starts += [False] * len(own) + [True] * len(begin)
                kinds += [toxic] * (len(own) + len(begin))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(starts, pa.bool_()), pa.array(kinds, pa.int32())], names=["_word", "_begins", "_toxic"])

    found = sample.mapInArrow(count, "_word string, _begins boolean, _toxic int")
    counts = found.groupBy("_word", "_begins").agg(F.count_if(F.col("_toxic") == 1).alias("_t"), F.count_if(F.col("_toxic") == 0).alias("_o"))
    rows = {r[0]: r[1] for r in sample.groupBy("_toxic").count().collect()}
    if not rows.get(1) or not rows.get(0):
        return Model(b"", b"")
    counts = common.stored(counts, "toxicity_words")
    ratio = (F.col("_t") + 0.5) / rows[1] / ((F.col("_o") + 0.5) / rows[0])
    least = max(3, round(rows[1] / 200))
    telling = (F.col("_t") >= least) & (ratio > CONTRAST)
    # what is most telling comes last, where matches are cheapest; the bound is in bytes
    order = [(F.log(ratio) * F.sqrt("_t")).desc(), F.col("_word")]
    begin = [r[0] for r in counts.where(F.col("_begins") & telling).orderBy(*order).limit(MARK_BYTES // 8).collect()]
    inflected = (ratio > CONTRAST) & F.arrays_overlap(F.array(*(F.substring("_word", 1, k) for k in BEGINNINGS)), F.array(*map(F.lit, begin)).cast("array<string>"))
    marks = [r[0] for r in counts.where(~F.col("_begins") & (telling | inflected)).orderBy(*order).limit(MARK_BYTES // 4).collect()]
    if not marks:
        return Model(b"", b"")
    plain = [r[0] for r in counts.where(~F.col("_begins") & (ratio < CONTRAST)).orderBy(F.desc("_o"), "_word").limit((COMMON_BYTES + MARK_BYTES) // 3).collect()]

    def content(found: list[str]) -> bytes:
        return (" " + " ".join(reversed(found)) + " ").encode()

    mark = content(marks)[-MARK_BYTES:]
    both = content(plain)[-COMMON_BYTES:]
    more = content(plain)[: -COMMON_BYTES][-len(mark) :]
    draft = Model(both + mark, both + more)

    def measure(batches):
        import pyarrow as pa

        scorer = Scorer(draft)
        for batch in batches:
            some = [scorer.features(t).tolist() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.list_(pa.float64())), batch.column(1)], names=["x", "y"])

    spread = sample.repartition(sample.sparkSession.sparkContext.defaultParallelism * 4)
    seen = spread.mapInArrow(measure, "x array<double>, y int").toPandas()
    # rows come in any order: sorted, the sums of the fit are the same each time
    data = np.column_stack([np.array(seen["x"].tolist(), np.float64), seen["y"].to_numpy(np.float64)])
    data = data[np.lexsort(data.T)]
    x, y = data[:, :-1], data[:, -1]
    means, deviations = x.mean(0), x.std(0) + 1e-9
    weights = _logistic((x - means) / deviations, y)
    return Model(draft.toxic, draft.ordinary, tuple(weights), tuple(means), tuple(deviations))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Ridge logistic regression by Newton's method; the first weight is the constant."""
    x = np.column_stack([np.ones(len(x)), x])
    w, penalty = np.zeros(x.shape[1]), np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 from ``THRESHOLD`` on) after it.

    Whole texts are scored, in windows, whatever their length. Null and empty texts and
    texts without letters have no window and get the score of no gain. Repeated rows get
    equal scores; an empty table gives an empty result; input columns named score or
    predicted are replaced.
    """
    base = docs.drop("score", "predicted")
    names, at = base.columns, base.columns.index(text_col)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields), "score double, predicted int"])

    def run(batches):
        import pyarrow as pa

        scorer = Scorer(model)
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                some = batch.slice(start, 1000)
                scores = np.array([scorer.score(t) for t in some.column(at).to_pylist()], np.float64)
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(scores), pa.array((scores >= THRESHOLD).astype(np.int32))], names=[*names, "score", "predicted"])
        del scorer
        common.tidy()

    return base.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, common.table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", common.held_out().alias("held_out"), "score", "predicted")
