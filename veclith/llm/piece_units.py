"""Units of texts for a piece model: cut, hashed and looked up for many texts at once, in NumPy.

A unit ends where no token can cross, so units are encoded independently of each other:

* where no piece of the model has the two characters on either side next to each other. Letters
  stay with the blank before them; marks, digits and most pairs of ideographs come apart. What
  is left between such places is a word here.
* in the words of BPE models, also between two runs that certainly become parts of one token
  each, if no piece has both runs next to each other. Two neighbouring runs become one for
  certain if their merge comes before that of every piece that could take one of them away.
"""

from __future__ import annotations

import heapq

import numpy as np

BLANK = "▁"
#: Characters of the longest unit that goes through the lattice; longer runs are merged directly.
UNIT = 255
#: Characters that are cut at once, about, and those that arithmetic takes at a time to stay in cache.
WINDOW, BLOCK = 1 << 21, 1 << 15
#: The rank of what never merges.
NEVER = 1 << 30
_MATRIX = 2048
_RANDOM = np.random.default_rng(5)
_BASES = tuple(int(b) | 1 for b in _RANDOM.integers(1 << 62, 1 << 63, 2))
#: Units that a worker remembers the ids of, and words that it remembers of a chunk.
_KEPT, _KNOWN = 100_000, 1_000_000
#: How often neighbouring runs are joined before borders are decided; fewer rounds leave longer units.
ROUNDS = 8


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(32)


class Spans:
    """Hashes of any run of some code points, by prefix sums."""

    _powers: tuple = ()

    def __init__(self, codes: np.ndarray):
        n = len(codes) + 1
        if not Spans._powers or len(Spans._powers[0][0]) < n:
            size = max(n, 4 * BLOCK)
            steps = [(np.uint64(b), np.uint64(pow(b, -1, 1 << 64))) for b in _BASES]
            Spans._powers = tuple(tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, f)]), dtype=np.uint64) for f in pair) for pair in steps)
        values = _mixed(codes.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        self.sums = []
        for power, _ in Spans._powers:
            sums = np.zeros(n, np.uint64)
            np.cumsum(values * power[: n - 1], out=sums[1:], dtype=np.uint64)
            self.sums.append(sums)

    def hash(self, k: int, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[k][stop] - self.sums[k][start]) * Spans._powers[k][1][start] + (stop - start).astype(np.uint64))


class Places:
    """Where keys stand in a sorted array: a table of their leading bits, then a few steps."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.append(keys, np.uint64((1 << 64) - 1))
        bits = max(1, len(keys).bit_length())
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int64)

    def at(self, wanted: np.ndarray) -> np.ndarray:
        """The first place whose key is not less."""
        at = self.first[wanted >> self.shift]
        rest = np.flatnonzero(self.keys[at] < wanted)
        while len(rest):
            at[rest] += 1
            rest = rest[self.keys[at[rest]] < wanted[rest]]
        return at


class Pairs:
    """Numbers from 1 on of the pairs of characters that some piece has next to each other; 0 for others."""

    def __init__(self, pieces: list[str]):
        chars = sorted({c for p in pieces if len(p) > 1 for c in p})
        self.kind = np.zeros(0x110000, np.uint16)
        self.kind[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.width = len(chars) + 1
        self.known = {pair: k + 1 for k, pair in enumerate(sorted({p[i : i + 2] for p in pieces for i in range(len(p) - 1)}))}
        keys = np.array([int(self.kind[ord(p[0])]) * self.width + int(self.kind[ord(p[1])]) for p in self.known], np.int64)
        if self.width <= _MATRIX:
            self.matrix = np.zeros(self.width * self.width, np.int32)
            self.matrix[keys] = np.arange(1, len(keys) + 1)
        else:
            self.matrix, self.order = None, np.argsort(keys)
            self.keys = keys[self.order]

    def numbers(self, codes: np.ndarray) -> np.ndarray:
        """The number of each pair of neighbours."""
        out = np.zeros(max(0, len(codes) - 1), np.int32)
        for a in range(0, len(out), BLOCK):
            kinds = self.kind[codes[a : a + BLOCK + 1]].astype(np.int32 if self.matrix is not None else np.int64)
            keys = kinds[:-1] * self.width + kinds[1:]
            if self.matrix is not None:
                out[a : a + BLOCK] = self.matrix[keys]
            elif len(self.keys):
                at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
                out[a : a + BLOCK] = np.where(self.keys[at] == keys, self.order[at] + 1, 0)
        return out


def strings(codes: np.ndarray, size: np.ndarray):
    """pyarrow strings of consecutive runs of code points."""
    import pyarrow as pa

    data = codes.astype("<u4").tobytes().decode("utf-32-le").encode()
    wide = 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)
    ends = np.concatenate([[0], np.cumsum(wide)])[np.concatenate([[0], np.cumsum(size)])]
    return pa.StringArray.from_buffers(len(size), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data))


def taken(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places of all elements of the runs ``start``, ``size``, one after the other."""
    ends = np.cumsum(size)
    kind = np.int32 if len(ends) and max(ends[-1], start.max()) < 1 << 31 else np.int64
    out = np.repeat((start - (ends - size)).astype(kind), size)
    out += np.arange(len(out), dtype=kind)
    return out


class Units:
    """The units of different words, a pyarrow string array: ``start`` and ``size`` in ``codes``.

    ``direct``: those that the lattice doesn't get. ``word`` has the first unit of each word and the end.
    """

    def __init__(self, words, splitter: Splitter):
        import pyarrow as pa
        import pyarrow.compute as pc

        size = pc.utf8_length(words).to_numpy().astype(np.int64)
        data = words.buffers()[2]
        ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int32)
        body = pa.py_buffer(b"") if data is None else data.slice(int(ends[0]), int(ends[-1] - ends[0]))
        self.codes = np.frombuffer(body.to_pybytes().decode().encode("utf-32-le"), "<u4")
        begin = np.cumsum(size) - size
        cut = splitter.cuts(self.codes, begin)
        self.start = np.flatnonzero(cut)
        self.size = np.diff(np.append(self.start, len(self.codes)))
        self.word = np.append(np.searchsorted(self.start, begin), len(self.start))
        self.direct = self.size > UNIT
        strange = ~splitter.single[self.codes]
        if strange.any():
            self.direct |= np.logical_or.reduceat(strange, self.start)

    def text(self, k: int) -> str:
        return self.codes[self.start[k] : self.start[k] + self.size[k]].tobytes().decode("utf-32-le")

    def usual(self):
        """Strings of the units that are for the lattice."""
        chosen = np.flatnonzero(~self.direct)
        size = self.size[chosen]
        return strings(self.codes[taken(self.start[chosen], size)], size)


class Splitter:
    """What cutting needs of a vocabulary; made once a Python worker."""

    def __init__(self, vocabulary):
        pieces = [vocabulary.pieces[i] for i in vocabulary.normal]
        self.vocabulary, self.pairs = vocabulary, Pairs(pieces)
        self.single = np.zeros(0x110000, bool)
        self.single[[ord(p) for p in pieces if len(p) == 1]] = True
        self.kept: dict[str, list[int]] = {}
        if vocabulary.kind == "bpe":
            self._runs([p for p in pieces if len(p) > 1])

    def _runs(self, pieces: list[str]) -> None:
        """Of every run inside a piece: its rank if it is one, and the least rank of a piece that ends or begins with it."""
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        codes = np.frombuffer("".join(pieces).encode("utf-32-le"), "<u4")
        begin, spans = np.cumsum(size) - size, Spans(codes)
        piece = np.repeat(np.arange(len(pieces)), size)
        offset = np.arange(len(codes)) - begin[piece]
        rank_of = np.array([self.vocabulary.ranks[p] for p in pieces], np.int32)
        found = []
        for length in range(2, int(size.max(initial=0)) + 1):
            at = np.flatnonzero(offset + length <= size[piece])
            own = rank_of[piece[at]]
            head, last = offset[at] == 0, offset[at] + length == size[piece[at]]
            found.append([spans.hash(0, at, at + length), spans.hash(1, at, at + length), *(np.where(c, own, NEVER).astype(np.int32) for c in (head & last, last, head))])
        one, two, *ranks = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.uint64), np.zeros(0, np.uint64), *(np.zeros(0, np.int32) for _ in range(3)))
        order = np.argsort(one, kind="stable")
        new = np.flatnonzero(np.append(True, one[order][1:] != one[order][:-1])) if len(order) else order
        self.places, self.check = Places(one[order][new]), np.append(two[order][new], np.uint64(0))
        #: rank, least rank of those that end, and of those that begin with it; the last row is for runs in no piece
        self.ranks = [np.append(np.minimum.reduceat(r[order], new) if len(new) else r, NEVER).astype(np.int32) for r in ranks]

        known = np.frombuffer("".join(self.pairs.known).encode("utf-32-le"), "<u4")
        self.row_of_pair = np.append(len(self.check) - 1, self._number(Spans(known), np.arange(0, len(known), 2), np.arange(2, len(known) + 1, 2)))

    def _number(self, spans: Spans, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """The row of ``ranks`` of each run."""
        wanted = spans.hash(0, start, stop)
        at = self.places.at(wanted)
        none = len(self.check) - 1
        have = np.flatnonzero(self.places.keys[at] == wanted)
        out = np.full(len(at), none)
        have = have[self.check[at[have]] == spans.hash(1, start[have], stop[have])]
        out[have] = at[have]
        return out

    def cuts(self, codes: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """True where a unit starts, in words that begin at ``begin``."""
        out = np.zeros(len(codes), bool)
        out[begin] = True
        if self.vocabulary.kind == "bpe" and len(codes):
            at = begin[np.unique(np.searchsorted(begin, np.arange(0, len(codes), 2 * BLOCK), "right") - 1)]
            for a, b in zip(at, [*at[1:], len(codes)], strict=True):
                self._cut(codes[a:b], out[a:b])
        return out

    def _cut(self, codes: np.ndarray, out: np.ndarray) -> None:
        """Add to ``out``, which is true where words begin, where units do."""
        spans, none = Spans(codes), len(self.check) - 1
        # borders of runs; at the end one more, so that every run has one behind it
        border, fixed = np.arange(len(codes) + 1, dtype=np.int32), np.append(out, True)
        row = np.full(len(border), none)
        row[1:-1] = self.row_of_pair[self.pairs.numbers(codes)]
        row[fixed] = none
        for _ in range(ROUNDS):
            rank, left, right = (r[row] for r in self.ranks)
            merged = np.zeros(len(border), bool)
            merged[1:-1] = (rank[1:-1] < NEVER) & (left[:-2] > rank[1:-1]) & (right[2:] >= rank[1:-1])
            if not merged.any():
                break
            stale = np.zeros(len(border), bool)
            stale[1:] |= merged[:-1]
            stale[:-1] |= merged[1:]
            stay = np.flatnonzero(~merged)
            border, fixed, row, stale = border[stay], fixed[stay], row[stay], stale[stay]
            at = np.flatnonzero(stale & ~fixed)
            row[at] = self._number(spans, border[at - 1], border[at + 1])
            fixed[at] = row[at] == none
        out[border[fixed][:-1]] = True

    def words(self, parts: list[str]):
        """(different words, the number of the word at each place, the first place of each part and the end)."""
        import pyarrow as pa

        text = "".join(parts)
        data, codes = text.encode(), np.frombuffer(text.encode("utf-32-le"), "<u4")
        first = np.ones(len(codes), bool)
        first[1:] = self.pairs.numbers(codes) == 0
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        ends = np.concatenate([[0], np.cumsum(sizes)])
        first[ends[:-1][sizes > 0]] = True
        start = np.flatnonzero(first)
        if len(data) == len(codes):
            at = start
        else:
            # the byte that each of the characters starts at
            wide = (codes >= 0x80).view(np.int8) + (codes >= 0x800).view(np.int8) + (codes >= 0x10000).view(np.int8)
            at = start + (np.cumsum(wide, dtype=np.int32) - wide)[start]
        offsets = np.append(at, len(data)).astype(np.int32)
        found = pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(data)).dictionary_encode()
        return found.dictionary, found.indices.to_numpy(), np.searchsorted(start, ends)

    def parts(self, text: str | None) -> list[str]:
        """A text with its blanks in the model's form, in parts of about ``WINDOW`` characters that end with a word."""
        if not text:
            return [""]
        text = text.replace(" ", BLANK)
        text = BLANK + text if self.vocabulary.prefix else text
        out, begin = [], 0
        while len(text) - begin > WINDOW:
            at = begin + WINDOW
            while at < len(text) and text[at - 1 : at + 1] in self.pairs.known:
                at += 1
            out.append(text[begin:at])
            begin = at
        return [*out, text[begin:]] if begin < len(text) or not out else out

    def slices(self, texts: list[str | None]):
        """(parts, number of parts of each text) for so many texts at a time as ``WINDOW`` allows."""
        parts, counts, size = [], [], 0
        for text in texts:
            own = self.parts(text)
            parts += own
            counts.append(len(own))
            size += sum(map(len, own))
            if size >= WINDOW:
                yield parts, counts
                parts, counts, size = [], [], 0
        if counts:
            yield parts, counts

    def plain(self, unit: str) -> list[int]:
        """:func:`plain`, remembered for short units."""
        found = self.kept.get(unit)
        if found is None:
            found = plain(self.vocabulary, unit)
            if len(unit) <= UNIT:
                if len(self.kept) >= _KEPT:
                    self.kept.clear()
                self.kept[unit] = found
        return found


def plain(vocabulary, unit: str) -> list[int]:
    """The ids of one unit without the lattice: merging by rank, or the best path of a unigram model."""
    missing = lambda c: [vocabulary.bytes[b] for b in c.encode()] if vocabulary.bytes else [vocabulary.unknown]
    found = _merge(vocabulary.ranks, unit) if vocabulary.kind == "bpe" else _best(vocabulary, unit)
    return [i for p in found for i in ([vocabulary.ids[p]] if p in vocabulary.ids else missing(p))]


def _merge(ranks: dict[str, int], unit: str) -> list[str]:
    """Merge the neighbours of the least rank, the first of equal ones, until none are left."""
    symbols, after, before = list(unit), [*range(1, len(unit)), -1], list(range(-1, len(unit) - 1))
    heap = []

    def push(a: int) -> None:
        b = after[a]
        if b >= 0 and (rank := ranks.get(symbols[a] + symbols[b])) is not None:
            heapq.heappush(heap, (rank, a, len(symbols[a]) + len(symbols[b])))

    for a in range(len(symbols) - 1):
        push(a)
    while heap:
        rank, a, size = heapq.heappop(heap)
        b = after[a] if symbols[a] else -1
        if b < 0 or len(symbols[a]) + len(symbols[b]) != size or ranks.get(symbols[a] + symbols[b]) != rank:
            continue
        symbols[a], symbols[b], after[a] = symbols[a] + symbols[b], "", after[b]
        if after[b] >= 0:
            before[after[b]] = a
        push(a)
        if before[a] >= 0:
            push(before[a])
    return [s for s in symbols if s]


def _best(vocabulary, unit: str) -> list[str]:
    """The path with the highest sum of scores, in the library's single precision."""
    totals, starts = [np.float32(0)], [0]
    unknown = np.float32(vocabulary.least - 10.0)
    for end in range(1, len(unit) + 1):
        best, start = None, end - 1
        for a in range(max(0, end - vocabulary.longest), end):
            i = vocabulary.ids.get(unit[a:end])
            if i is None and a < end - 1:
                continue
            total = totals[a] + (unknown if i is None else np.float32(vocabulary.scores[i]))
            if best is None or total > best:
                best, start = total, a
        totals.append(best)
        starts.append(start)
    out, end = [], len(unit)
    while end:
        out.append(unit[starts[end] : end])
        end = starts[end]
    return out[::-1]


class Lexicon:
    """Ids of units, and of the words made of them that were met so far."""

    def __init__(self, units, ids, splitter: Splitter):
        import pyarrow as pa

        self.units, self.splitter = units, splitter
        ids = ids.to_pylist()
        count = np.fromiter(map(len, ids), np.int64, len(ids))
        self.of_units = from_chars(np.frombuffer("".join(ids).encode("utf-32-le"), "<u4")), np.cumsum(count) - count, count
        self.none = pa.array([], pa.string())
        self._forget()

    def _forget(self) -> None:
        self.words, self.values = self.none, np.zeros(0, np.int32)
        self.start, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, words) -> None:
        """Add ids of words that aren't known yet; a unit without ids raises KeyError."""
        import pyarrow as pa
        import pyarrow.compute as pc

        units = Units(words, self.splitter)
        values, own_start, own_count = self.of_units
        start, count = np.zeros(len(units.start), np.int64), np.zeros(len(units.start), np.int64)
        chosen = np.flatnonzero(~units.direct)
        at = pc.index_in(units.usual(), value_set=self.units)
        if at.null_count:
            raise KeyError("a unit without ids")
        at = at.to_numpy()
        start[chosen], count[chosen] = own_start[at], own_count[at]
        more, size = [values], len(values)
        for k in np.flatnonzero(units.direct).tolist():
            own = self.splitter.plain(units.text(k))
            start[k], count[k] = size, len(own)
            more.append(np.array(own, np.int32))
            size += len(own)
        ids = np.concatenate(more)[taken(start, count)]
        ends = np.concatenate([[0], np.cumsum(count)])[units.word]
        self.start = np.concatenate([self.start, len(self.values) + ends[:-1]])
        self.count = np.concatenate([self.count, np.diff(ends)])
        self.values = np.concatenate([self.values, ids])
        self.words = pa.concat_arrays([self.words, words])

    def ids(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each part)."""
        import pyarrow.compute as pc

        if len(self.words) > _KNOWN:
            self._forget()
        words, which, part = self.splitter.words(parts)
        at, known = pc.index_in(words, value_set=self.words), len(self.words)
        new = at.is_null()
        at = at.fill_null(-1).to_numpy(zero_copy_only=False).copy()
        if (at < 0).any():
            self._learn(words.filter(new))
            at[at < 0] = known + np.arange(int((at < 0).sum()))
        which = at[which]
        size = self.count[which]
        return self.values[taken(self.start[which], size)], np.diff(np.concatenate([[0], np.cumsum(size)])[part])


#: Ids travel as strings, a character each: nothing below U+0100, no surrogates.
def to_char(i: int) -> str:
    return chr(i + 0x100 if i + 0x100 < 0xD800 else i + 0x900)


def from_chars(codes: np.ndarray) -> np.ndarray:
    return np.where(codes < 0xD800, codes.astype(np.int64) - 0x100, codes.astype(np.int64) - 0x900).astype(np.int32)
