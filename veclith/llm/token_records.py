"""Token-id output as length-delimited binary records with a separate offset index.

A record file is a run of frames; a frame is

    length       unsigned 64-bit, little-endian: bytes of data
    length check unsigned 32-bit: masked CRC-32 of the eight length bytes
    data         document id (signed 64-bit), flags (unsigned 32-bit, 1: the id is null,
                 2: ids take 16 bits), then the ids as unsigned 32-bit integers or, where the
                 vocabulary allows, 16-bit ones, all little-endian
    data check   unsigned 32-bit: masked CRC-32 of data

A masked checksum is the CRC-32 rotated right by 15 bits plus a constant, so that a check
stored inside checked data isn't mistaken for a check of it. Beside each ``*.rec`` file a
``*.idx`` file has the offset of every frame and of the end (unsigned 64-bit) and its own
masked check, so a shuffled reader can seek to any record. ``manifest.json``, written last,
lists the files in document order with their records and tokens.

Documents are range-partitioned and sorted by id; each task streams its range into files of
bounded size under temporary names and renames them, so a lost executor or a speculative
copy repeats bytes and leaves no half file. Encoding goes by the different words of many texts
with a bounded cache: the tokenizer drops white space and never joins across it, so the ids of a
text are those of its words in order.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .piece_units import taken
from .shingles import _WHITE

#: Fixed value: the constant that the mask adds.
MASK = 0xA282EAD8
END_ID = 1
SHARD_BYTES = 256 << 20
#: Pieces that a worker remembers (about 40 bytes each), and rows whose different pieces are looked up together.
CACHE_WORDS, ROWS = 200_000, 1024
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]*)")
_RUN = re.compile("[a-zß-öø-ÿ]+")
#: Kinds of bytes: those of letters, of marks, and all others; and ASCII letters in lower case.
_LETTER, _MARK, _OTHER = 0, 1, 2
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[[b for b in range(0x21, 0x7F) if not chr(b).isalnum()]] = _MARK
_KIND[[b for b in range(0x41, 0x7B) if chr(b).isalpha()]] = _LETTER
_LOWER_BYTES = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK) & 0xFFFFFFFF


def _split(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, where pieces start in them, the first piece of each text and the end) of texts at ``at`` in ``data``.

    White space is left out. A word of Latin-1 letters with ASCII marks behind it is in lower
    case and two pieces, for its letters are one piece for the model and its marks another; any
    other word is one.
    """
    inside = ~_WHITE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    # a word never goes on from one text to the next
    begin = at[:-1][at[:-1] < at[1:]]
    first[begin] = inside[begin]
    starts_before = np.concatenate([[0], np.cumsum(inside, dtype=np.int64)])[at]
    body, first = data[inside], first[inside]
    kind = _KIND[body]
    if (body >= 0x80).any():
        # a letter of two bytes: 0xC3 and what follows, but for the signs of multiplication and division
        after = np.flatnonzero(body == 0xC3) + 1
        after = after[(body[after] != 0x97) & (body[after] != 0xB7)]
        kind[after], kind[after - 1] = _LETTER, _LETTER
        capital = after[body[after] <= 0x9E]
    else:
        capital = np.zeros(0, np.int64)
    letter = kind == _LETTER
    turn = np.zeros(len(body), bool)
    turn[1:] = letter[1:] != letter[:-1]
    turn &= ~first
    word = np.flatnonzero(first)
    size = np.diff(np.append(word, len(body)))
    # other characters, or letters behind marks, make a word one that isn't plain
    wrong = np.concatenate([[0], np.cumsum((kind == _OTHER) | turn & letter, dtype=np.int32)])
    plain = (wrong[word + size] == wrong[word]) & letter[word]
    of_plain = np.repeat(plain, size)
    lower = _LOWER_BYTES[body]
    lower[capital] = body[capital] + 32
    body = np.where(of_plain, lower, body)
    starts = np.flatnonzero(first | turn & of_plain)
    return body, starts, np.searchsorted(starts, starts_before)


class WordEncoder:
    """Ids of texts by their different pieces, of which up to ``cache_words`` are remembered.

    New runs of letters go to the library many at a time, as one text: a token that ends a word
    ends a run. Words that aren't plain take the library's whole chain one by one.
    """

    def __init__(self, path: str, end_id: int | None = END_ID, cache_words: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        chain = json.loads(self.tokenizer.to_str())
        # the short way holds only for the chain it was written for
        self.plain = [x["type"] for x in (chain["normalizer"] or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and not any(re.search("[a-z]", a["content"]) and re.fullmatch(_PLAIN, a["content"]) for a in chain["added_tokens"])
        suffix = chain["model"].get("end_of_word_suffix")
        size = max(self.tokenizer.get_vocab_size() - 1, end_id or 0) + 1
        #: Type of the ids: 16 bits where every id fits.
        self.code = "H" if size <= 1 << 16 else "I"
        self.end = b"" if end_id is None else array(self.code, [end_id]).tobytes()
        self.ends_word = np.zeros(size, bool)
        if suffix:
            self.ends_word[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(suffix)]] = True
        self.limit = cache_words
        self._forget()

    def _forget(self) -> None:
        import pyarrow as pa

        self.known, self.values = pa.array([], pa.string()), np.zeros(0, self.code)
        self.start, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _learn(self, pieces) -> np.ndarray:
        """Add the ids of pieces that aren't known yet; returns the places they get."""
        import pyarrow as pa

        names, places = pieces.to_pylist(), []
        values, counts = [self.values], [self.count]
        runs = [k for k, name in enumerate(names) if _RUN.fullmatch(name)]
        for at in range(0, len(runs), 1000):
            some = runs[at : at + 1000]
            ids = np.array(self._ids(" ".join([names[k] for k in some])), self.code)
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) == len(some):
                places += some
                values.append(ids)
                counts.append(np.diff(ends, prepend=0))
        run = set(places)
        rest = [k for k in range(len(names)) if k not in run]
        values += [np.array(self._ids(names[k]), self.code) for k in rest]
        counts.append(np.fromiter(map(len, values[len(values) - len(rest) :]), np.int64, len(rest)))
        order = np.array([*places, *rest], np.int64)
        out = np.empty(len(order), np.int64)
        out[order] = len(self.known) + np.arange(len(order))
        self.values, self.count = np.concatenate(values), np.concatenate(counts)
        self.start = np.cumsum(self.count) - self.count
        self.known = pa.concat_arrays([self.known, pieces.take(pa.array(order))])
        return out

    def arrays(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts of a pyarrow string array without nulls, where those of each begin and the end); no end ids."""
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = texts.cast(pa.large_binary())
        at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
        body, starts, part = _split(data, at - at[0])
        if not self.plain:
            raise ValueError("only the chain of normalisers that pieces are cut for is supported")
        offsets = np.append(starts, len(body)).astype(np.int32)
        found = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(body))).dictionary_encode()
        if len(self.known) > self.limit:
            self._forget()
            common.tidy()
        place = pc.index_in(found.dictionary, value_set=self.known)
        new = place.is_null()
        place = place.fill_null(-1).to_numpy(zero_copy_only=False).copy()
        if (place < 0).any():
            place[place < 0] = self._learn(found.dictionary.filter(new))
        which = place[found.indices.to_numpy()]
        size = self.count[which]
        return self.values[taken(self.start[which], size)], np.concatenate([[0], np.cumsum(size)])[part]

    def encode(self, texts) -> list[bytes]:
        """Ids of each text (of a list or a pyarrow string array) with the end id, as little-endian integers of type ``code``."""
        import pyarrow as pa

        ids, ends = self.arrays(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        data, places = ids.tobytes(), (ends * ids.itemsize).tolist()
        return [data[a:b] + self.end for a, b in zip(places, places[1:], strict=False)]


_encoders: dict[tuple, WordEncoder] = {}


def _encoder(*key) -> WordEncoder:
    """One encoder a Python worker: its cache outlives a task."""
    if key not in _encoders:
        _encoders[key] = WordEncoder(*key)
    return _encoders[key]


def frame(doc_id: int | None, ids: bytes, code: str = "I") -> bytes:
    data = struct.pack("<qI", doc_id or 0, (doc_id is None) | (code == "H") << 1) + ids
    length = struct.pack("<Q", len(data))
    return b"".join((length, struct.pack("<I", masked(length)), data, struct.pack("<I", masked(data))))


def unframe(stream) -> Iterator[tuple[int | None, bytes, int]]:
    """(id, ids as unsigned 32-bit integers, bytes of the frame) of every frame of a stream.

    A wrong check or a cut frame raises ValueError.
    """
    while head := stream.read(12):
        if len(head) < 12 or masked(head[:8]) != struct.unpack_from("<I", head, 8)[0]:
            raise ValueError("wrong length check")
        size = struct.unpack_from("<Q", head)[0]
        body = stream.read(size + 4)
        if len(body) < size + 4 or masked(body[:size]) != struct.unpack_from("<I", body, size)[0]:
            raise ValueError("wrong data check")
        doc_id, flags = struct.unpack_from("<qI", body)
        ids = np.frombuffer(body[12:size], "<u2").astype("<u4").tobytes() if flags & 2 else body[12:size]
        yield (None if flags & 1 else doc_id), ids, size + 16


def read_index(uri: str) -> list[int]:
    """Offsets of the frames of a record file, and of its end."""
    files, path = common.file_system(uri.removesuffix(".rec") + ".idx")
    data = files.open_input_stream(path).read()
    if masked(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
        raise ValueError("wrong index check")
    return list(struct.unpack(f"<{len(data) // 8}Q", data[:-4]))


def read_record(uri: str, offset: int) -> tuple[int | None, array]:
    """The record at an offset of the index: for reading in shuffled order."""
    files, path = common.file_system(uri)
    with files.open_input_file(path) as f:
        f.seek(offset)
        doc_id, ids, _ = next(unframe(f))
    return doc_id, array("I", ids)


def _write_shards(rows: Iterable[tuple[int | None, bytes]], code: str, folder: str, part: int, attempt: str, shard_bytes: int):
    """Write the rows to files of about ``shard_bytes``; yields (name, records, tokens, bytes)."""
    rows = iter(rows)
    pending, number = next(rows, None), 0
    while pending is not None:
        offsets, tokens, size = array("Q"), 0, 0

        def write(out):
            nonlocal pending, tokens, size
            while pending is not None and (size < shard_bytes or not offsets):
                data = frame(*pending, code)
                offsets.append(size)
                out.write(data)
                tokens += len(pending[1]) // array(code).itemsize
                size += len(data)
                pending = next(rows, None)

        name = f"part-{part:06d}-{number:04d}"
        common.publish(f"{folder}/{name}.rec", attempt, write)
        index = array("Q", [*offsets, size]).tobytes()
        common.publish(f"{folder}/{name}.idx", attempt, lambda out, index=index: out.write(index + struct.pack("<I", masked(index))))
        yield f"{name}.rec", len(offsets), tokens, size
        number += 1


def write(docs: DataFrame, folder: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = END_ID, shard_bytes: int = SHARD_BYTES) -> dict:
    """Encode every whole text into ``folder`` in ascending id order; returns the manifest.

    Null and empty texts give a record of the end id alone. Null ids come first and are
    flagged in their records. Rows that repeat an id are each written, in an order by hash of the text. An
    empty table gives a manifest without files. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), common.text_of(text_col).alias("_text"))
    # the hash spreads rows of one id, or of none, over tasks
    order = [F.col("_id").asc_nulls_first(), F.xxhash64("_text"), F.col("_text")]
    rows = rows.repartitionByRange(*order[:2]).sortWithinPartitions(*order)

    def encode(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        task, encoder = TaskContext.get(), _encoder(tokenizer_path, end_id)

        def records():
            for batch in batches:
                for start in range(0, batch.num_rows, ROWS):
                    some = batch.slice(start, ROWS)
                    yield from zip(some.column(0).to_pylist(), encoder.encode(some.column(1)), strict=True)

        for name, *counts in _write_shards(records(), encoder.code, folder, task.partitionId(), str(task.taskAttemptId()), shard_bytes):
            yield pa.RecordBatch.from_pydict({"name": [name]} | {k: [v] for k, v in zip(("records", "tokens", "bytes"), counts, strict=True)})
        common.tidy()

    shards = [r.asDict() for r in rows.mapInArrow(encode, "name string, records long, tokens long, bytes long").collect()]
    manifest = {"format": 1, "end_id": end_id, "shards": sorted(shards, key=lambda s: s["name"])}
    common.publish(f"{folder}/manifest.json", "driver", lambda out: out.write(json.dumps(manifest).encode()))
    return manifest


def read_manifest(folder: str) -> dict:
    files, path = common.file_system(f"{folder}/manifest.json")
    return json.loads(files.open_input_stream(path).read())


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Every record in document order: doc_id, shard, offset, start, ids.

    ``start`` counts the ids of all records before it; a file is one task.
    """
    return _scan(spark, folder, "ids array<long>", lambda ids: array("I", ids).tolist())


def summary(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, shard, offset, start, n_tokens of every record and the CRC-32 of its ids."""
    return _scan(spark, folder, "n_tokens long, ids_crc32 long", lambda ids: (len(ids) // 4, zlib.crc32(ids)))


def _scan(spark: SparkSession, folder: str, columns: str, digest) -> DataFrame:
    shards, start = [], 0
    for s in read_manifest(folder)["shards"]:
        shards.append((s["name"], start, s["records"], s["tokens"]))
        start += s["tokens"]
    names = [c.split()[0] for c in columns.split(", ")]
    schema = f"doc_id long, shard string, offset long, start long, {columns}"
    arrow = common.arrow_schema(schema)

    def scan(batches):
        import pyarrow as pa
        for batch in batches:
            for number in batch.column(0).to_pylist():
                name, at, records, tokens = shards[number]
                files, path = common.file_system(f"{folder}/{name}")
                rows, offset, first, seen = [], 0, at, 0
                with files.open_input_stream(path, buffer_size=1 << 20) as stream:
                    for doc_id, ids, size in unframe(stream):
                        got = digest(ids)
                        rows.append((doc_id, name, offset, at, *(got if len(names) > 1 else (got,))))
                        offset, at, seen = offset + size, at + len(ids) // 4, seen + 1
                        if len(rows) >= 2000:
                            yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, r, strict=True)) for r in rows], arrow)
                            rows = []
                if (seen, at - first) != (records, tokens):
                    raise ValueError(f"{name} differs from the manifest")
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, r, strict=True)) for r in rows], arrow)

    return spark.range(0, len(shards), 1, max(1, len(shards))).mapInArrow(scan, schema)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = common.scratch(spark, "token_records")
    write(common.table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"))
    return summary(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32")
