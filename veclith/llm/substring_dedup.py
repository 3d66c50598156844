"""Substring deduplication over sliding spans of sentences.

From every sentence a span starts: that sentence and the ones behind it until there are at
least ``RUN`` sentences and ``MIN_WORDS`` words. Where a span ends depends on its own words
only, so a passage gives the same spans wherever it stands. Spans are hashed, and a global
aggregation finds for each repeated hash its first document. A join marks the spans that
stand anywhere else; every sentence under a marked span goes. Inside one document the first
of equal spans stays, which is decided while the document is read.

Passages that hold no whole span, as one long sentence between others, are found by windows
of ``WINDOW`` words: of every ``DRAW`` windows in a row the one with the smallest hash is
taken, so two texts that share WINDOW + DRAW - 1 = 51 words take a window in common.
Windows go the way of spans, and the words under a marked one go. Where scripts have no
blanks, each character is a word.

What moves is (hash, id, hash of the text, position), a few numbers a sentence. The aggregation folds equal
hashes before the shuffle; the join with the repeated hashes is an ordinary equi-join that
AQE splits where one passage is in very many documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .shingles import _VALUE, _WHITE, _power, mix

RUN, MIN_WORDS = 2, 12
WINDOW = DRAW = 26
#: A sentence ends with its mark and one white space, or with a line.
_END = re.compile(r"(?<=[.!?][ \t\r\f\v])|(?<=\n)")


def sentences(text: str) -> list[str]:
    """The sentences with the white space behind them; joined they are the text."""
    return [s for s in _END.split(text) if s]


def spans(parts: list[str], run: int = RUN, min_words: int = MIN_WORDS) -> Iterator[tuple[int, int, int]]:
    """(hash, first, last) of the span from each sentence; none where the text ends too soon.

    White space doesn't matter, and sentences without words are passed over.
    """
    import xxhash

    words = [s.split() for s in parts]
    filled = [i for i, w in enumerate(words) if w]
    texts, sizes = [" ".join(words[i]) for i in filled], [len(words[i]) for i in filled]
    end, held = 0, 0
    for start in range(len(filled)):
        while end < len(filled) and (held < min_words or end - start < run):
            held += sizes[end]
            end += 1
        if held < min_words or end - start < run:
            return
        # as signed 64-bit, which is what a long column holds
        value = xxhash.xxh3_64_intdigest("\n".join(texts[start:end]))
        yield value - (1 << 64) if value >> 63 else value, filled[start], filled[end - 1]
        held -= sizes[start]


def _own(parts: list[str], run: int, min_words: int) -> tuple[dict[int, list[tuple[int, int]]], set[int]]:
    """For each hash its first place; sentences under spans that repeat one of this text."""
    places: dict[int, tuple[int, int]] = {}
    again: set[int] = set()
    for value, first, last in spans(parts, run, min_words):
        at = places.setdefault(value, (first, last))
        # a span over itself, as in a run of equal sentences, leaves the first one whole
        if at[0] != first:
            again.update(range(max(first, at[1] + 1), last + 1))
    return places, again


def _solo(data: np.ndarray) -> np.ndarray:
    """First bytes of characters of scripts without blanks: Thai, Lao, Burmese, Khmer, kana, Chinese characters."""
    a, b = data[:-1], data[1:]
    found = (a == 0xE0) & (b >= 0xB8) & (b <= 0xBB) | (a == 0xE1) & ((b >= 0x80) & (b <= 0x82) | (b >= 0x9E) & (b <= 0x9F))
    found |= (a == 0xE3) & (b >= 0x81) & ((b <= 0x83) | (b >= 0x90)) | (a >= 0xE4) & (a <= 0xE9) | (a == 0xEF) & (b >= 0xA4) & (b <= 0xAB) | (a == 0xF0) & (b >= 0xA0)
    return np.flatnonzero(found)


def _slid(x: np.ndarray, size: int, fold) -> np.ndarray:
    """``fold`` over every ``size`` values in a row."""
    have = 1
    while have * 2 <= size:
        x, have = fold(x[:-have], x[have:]), have * 2
    return fold(x[: len(x) - (size - have)], x[size - have :]) if have < size else x


class Windows:
    """The windows taken from texts: ``row``, ``value`` (hash) and ``first`` (word number) of each."""

    def __init__(self, texts: list[str]):
        bodies = [t.encode() for t in texts]
        self.offsets = np.cumsum([0, *(len(b) + 1 for b in bodies)])
        data = np.frombuffer(b"\n".join([*bodies, b""]), np.uint8)
        white = _WHITE[data]
        start = ~white
        start[1:] &= white[:-1]
        if len(data) and data.max() >= 0x80:
            solo = _solo(data)
            start[solo] = True
            after = solo + np.where(data[solo] >= 0xF0, 4, 3)
            start[after[~white[after]]] = True
        last = ~white
        last[:-1] &= white[1:] | start[1:]
        self.starts, stops = np.flatnonzero(start), np.flatnonzero(last) + 1
        power, inverse = _power(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_VALUE[data] * power[: len(data)], out=sums[1:], dtype=np.uint64)
        words = mix((sums[stops] - sums[self.starts]) * inverse[self.starts] + (stops - self.starts).astype(np.uint64))
        rows = np.searchsorted(self.offsets, self.starts, "right") - 1
        #: number of each row's first word
        self.begins = np.searchsorted(rows, np.arange(len(texts) + 1))
        n, both = len(words), WINDOW + DRAW - 1
        if n < both:
            self.row, self.value, self.first = (np.zeros(0, np.int64) for _ in range(3))
            return
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(words * power[:n], out=sums[1:], dtype=np.uint64)
        value = mix((sums[WINDOW:] - sums[:-WINDOW]) * inverse[: n - WINDOW + 1])
        # the smallest of each DRAW windows of one text; a window is taken if it is that of any DRAW it is in
        least = np.where(rows[: n - both + 1] == rows[both - 1 :], _slid(value, DRAW, np.minimum), np.uint64(0))
        none = np.zeros(DRAW - 1, np.uint64)
        taken = np.flatnonzero((_slid(np.concatenate([none, least, none]), DRAW, np.maximum) == value) & (value > 0))
        self.row, self.value = rows[taken], value[taken].view(np.int64)
        self.first = taken - self.begins[self.row]

    def own(self) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the windows that are the first with their hash in a text; and of those that repeat one behind it."""
        order = np.lexsort((self.first, self.value, self.row))
        row, value, first = self.row[order], self.value[order], self.first[order]
        new = np.ones(len(order), bool)
        new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
        at = first[new][np.cumsum(new) - 1] if len(order) else first
        return np.sort(order[new]), np.sort(order[first >= at + WINDOW])

    def bytes_of(self, row: int, first: int) -> tuple[int, int]:
        """From the window's first byte to the next word or the end of the text."""
        begin, after = self.begins[row] + first, self.begins[row] + first + WINDOW
        stop = self.starts[after] if after < self.begins[row + 1] else self.offsets[row + 1] - 1
        return self.starts[begin] - self.offsets[row], stop - self.offsets[row]


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN, min_words: int = MIN_WORDS) -> DataFrame:
    """One row a span that stands in an earlier document too: _id, _th (hash of the text), _first, _last (sentence numbers).

    For a window _first is -1 - the number of its first word.
    """
    text = common.text_of(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.xxhash64(text).alias("_th"), text.alias("_text"))

    def places(batches):
        import pyarrow as pa

        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                ids, hashes, values, firsts, lasts = [], [], [], [], []
                some = batch.slice(start, 500)
                names, marks, texts = (some.column(k).to_pylist() for k in range(3))
                for doc_id, th, text in zip(names, marks, texts, strict=True):
                    found, _ = _own(sentences(text), run, min_words)
                    ids += [doc_id] * len(found)
                    hashes += [th] * len(found)
                    values += found
                    firsts += [a for a, _ in found.values()]
                    lasts += [b for _, b in found.values()]
                taken = Windows(texts)
                own = taken.own()[0]
                ids += [names[r] for r in taken.row[own].tolist()]
                hashes += [marks[r] for r in taken.row[own].tolist()]
                values += taken.value[own].tolist()
                firsts += (-1 - taken.first[own]).tolist()
                lasts += (-1 - taken.first[own]).tolist()
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.array(hashes, np.int64)), pa.array(np.array(values, np.int64)), pa.array(np.array(firsts, np.int32)), pa.array(np.array(lasts, np.int32))], names=["_id", "_th", "_hash", "_first", "_last"])

    found = rows.mapInArrow(places, "_id long, _th long, _hash long, _first int, _last int")
    repeated = found.groupBy("_hash").agg(F.min("_id").alias("_owner"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    # without any id there is no first document; with one, rows without come after it
    return found.join(repeated, "_hash").where("_owner is not null and not (_id <=> _owner)").select("_id", "_th", "_first", "_last")


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with its text without repeated sentences and windows, and n_sentences and n_removed after it.

    Documents come in the order of their ids; null ids are last and equal among themselves.
    Rows that share an id count as one document for spans between documents, and each of them
    loses only what stands in its own text. Null text
    stays null with 0 sentences; texts without a repeated span stay byte for byte; a text
    of which nothing stays becomes empty. Very long texts are processed whole. Sentences of which
    only words go count in n_removed too. An empty table gives an empty result. Columns named like the two counts are replaced.
    """
    found = repeats(docs, id_col, text_col, run, min_words)
    base = docs.drop("n_sentences", "n_removed")
    places = common.unused(base, "__gone")
    gone = found.groupBy(F.col("_id").alias("__gone_id"), F.col("_th").alias("__gone_th")).agg(F.collect_set(F.struct("_first", "_last")).alias(places))
    same = base[id_col].cast("long").eqNullSafe(gone["__gone_id"]) & (F.xxhash64(common.text_of(text_col)) == gone["__gone_th"])
    rows = base.join(gone, same, "left")
    names = base.columns
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields), "n_sentences int", "n_removed int"])
    at = names.index(text_col)

    def rebuild(batches):
        import pyarrow as pa

        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                some = batch.slice(start, 500)
                texts, total, removed = [], [], []
                old = some.column(at).to_pylist()
                taken = Windows([t or "" for t in old])
                again = taken.own()[1]
                cut = {}
                for row, first in zip(taken.row[again].tolist(), taken.first[again].tolist(), strict=True):
                    cut.setdefault(row, []).append(first)
                for row, (text, marked) in enumerate(zip(old, some.column(len(names)).to_pylist(), strict=True)):
                    parts = sentences(text or "")
                    _, out = _own(parts, run, min_words)
                    firsts = cut.get(row, [])
                    for s in marked or ():
                        if s["_first"] < 0:
                            firsts.append(-1 - s["_first"])
                        else:
                            out.update(range(s["_first"], s["_last"] + 1))
                    if firsts:
                        body = text.encode()
                        ends = np.cumsum([0, *(len(p.encode()) for p in parts)])
                        stay = np.ones(len(body), bool)
                        for i in out:
                            stay[ends[i] : ends[i + 1]] = False
                        for first in firsts:
                            a, b = taken.bytes_of(row, first)
                            stay[a:b] = False
                        text = np.frombuffer(body, np.uint8)[stay].tobytes().decode()
                        out = np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(~stay)])[ends]))
                    elif out:
                        text = "".join(p for i, p in enumerate(parts) if i not in out)
                    texts.append(text)
                    total.append(len(parts))
                    removed.append(len(out))
                columns = [some.column(k) for k in range(len(names))]
                columns[at] = pa.array(texts, some.column(at).type)
                yield pa.RecordBatch.from_arrays([*columns, pa.array(total, pa.int32()), pa.array(removed, pa.int32())], names=[*names, "n_sentences", "n_removed"])

    return rows.select(*(base[c] for c in names), gone[places]).mapInArrow(rebuild, schema)


def query(spark, sf_dir: str) -> DataFrame:
    return remove(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
