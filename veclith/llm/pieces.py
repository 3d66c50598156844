"""SentencePiece encoding and decoding by a relational lattice.

Texts become units, runs that no token crosses (``piece_units``), of which most recur, so each
different unit is encoded once a corpus and not once an occurrence:

1. Documents go in chunks of ``CHUNK_ROWS`` rows of a file; each chunk's different units are
   written.
2. Over the different units of the corpus: substrings up to the longest piece are exploded,
   equi-joined to the piece table (of the model's size, so it is broadcast), grouped as edges
   by unit, and folded by Viterbi with ``aggregate``, all in the partitioning of one shuffle of
   the units. An ordinary join takes the ids back to (chunk, unit).
3. Ids are written by chunk, many chunks a folder. Documents are read a second time; a
   chunk's lexicon is as large as that chunk's text allows, not more.

The fold keeps for every node of a unit the best path to it. For unigram models the best is
the highest sum of scores (in single precision, added up within the unit: paths whose sums differ by
rounding alone may be told apart otherwise than over a whole text). For BPE models a sum of scores finds other paths than merging does.
Their weight here is the set of merges that build a path's pieces, each merge as (rank, place);
of two sets the better has the smallest merge that only one of them has. Merging takes just
that one first, so the best path is the merged one. The order stays when the same merges are
added to both sets, which is what Viterbi asks of a weight. It holds for models in which every
merge comes after those that made its parts; others are refused. The ids are those of the
sentencepiece library for either kind.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .piece_units import BLANK, NEVER, Lexicon, Splitter, Units, to_char

CHUNK_ROWS = 8192
#: Rows whose texts are taken out of an Arrow batch at once.
ROWS = 1024
#: Different units that a task of the first stage holds before it passes them on.
HELD = 2_000_000
_EVER = -1


@dataclass(frozen=True)
class Vocabulary:
    """The pieces of a model and what the lattice needs of them."""

    path: str
    kind: str
    pieces: list[str]
    scores: list[float]
    normal: list[int]
    bytes: dict[int, int]
    unknown: int
    prefix: bool
    longest: int
    least: float
    ranks: dict[str, int] = field(repr=False)
    ids: dict[str, int] = field(repr=False)


def load(path: str) -> Vocabulary:
    """Read a model file whose normalisation is the identity; others raise ValueError."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    spec, kind = model.normalizer_spec, pb.ModelProto.SentencePiece
    if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
        raise ValueError("only models with identity normalisation are supported")
    kinds = {1: "unigram", 2: "bpe"}
    if model.trainer_spec.model_type not in kinds:
        raise ValueError("only unigram and BPE models are supported")
    if any(p.type == kind.USER_DEFINED for p in model.pieces):
        raise ValueError("user-defined pieces are not supported")
    pieces = [p.piece for p in model.pieces]
    normal = [i for i, p in enumerate(model.pieces) if p.type == kind.NORMAL]
    order = sorted(normal, key=lambda i: (-model.pieces[i].score, i))
    return Vocabulary(
        path=path,
        kind=kinds[model.trainer_spec.model_type],
        pieces=pieces,
        scores=[p.score for p in model.pieces],
        normal=normal,
        bytes={int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == kind.BYTE},
        unknown=next(i for i, p in enumerate(model.pieces) if p.type == kind.UNKNOWN),
        prefix=spec.add_dummy_prefix,
        longest=max(len(pieces[i]) for i in normal),
        least=min(model.pieces[i].score for i in normal),
        ranks={pieces[i]: k for k, i in enumerate(order)},
        ids={pieces[i]: i for i in normal},
    )


_splitters: dict[str, Splitter] = {}


def splitter(vocabulary: Vocabulary) -> Splitter:
    """One a Python worker and model."""
    if vocabulary.path not in _splitters:
        _splitters[vocabulary.path] = Splitter(vocabulary)
    return _splitters[vocabulary.path]


def _merges(piece: str, ranks: dict[str, int]) -> list[tuple[int, int]] | None:
    """(rank, place) of every merge that builds a piece; null if merging ends in something else."""
    parts, out = [(_EVER, c, 0) for c in piece], []
    while len(parts) > 1:
        rank, k = min((ranks.get(a[1] + b[1], NEVER), k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if rank == NEVER:
            return None
        if rank <= max(parts[k][0], parts[k + 1][0]):
            raise ValueError(f"a part of {piece!r} is made after it")
        out.append((rank, sum(len(p[1]) for p in parts[:k])))
        parts[k : k + 2] = [(rank, parts[k][1] + parts[k + 1][1], 0)]
    return out


#: Where an edge is, in one long: its end, and in the lower bits its start.
_END = 20
#: A merge in one negative long, so that what merges first is the greatest.
_PLACE = 10


def piece_table(spark, vocabulary: Vocabulary) -> DataFrame:
    """(_piece, _char, _merges or _score) for each piece that texts can have.

    ``_char`` names the piece's id, ``_merges`` has what builds the piece of a BPE model.
    """
    import pandas as pd

    rows, bpe = [], vocabulary.kind == "bpe"
    for i in vocabulary.normal:
        piece = vocabulary.pieces[i]
        more = _merges(piece, vocabulary.ranks) if bpe else vocabulary.scores[i]
        if more is not None:
            rows.append((piece, to_char(i), [-(rank << _PLACE | place) for rank, place in more] if bpe else more))
    name, kind = ("_merges", "array<bigint>") if bpe else ("_score", "float")
    return spark.createDataFrame(pd.DataFrame(rows, columns=["_piece", "_char", name]), f"_piece string, _char string, {name} {kind}")


def lattice(units: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(_unit, _ids) for each of the different units in column ``_unit``.

    A unit is a text of up to ``UNIT`` characters, each a piece by itself. ``_ids`` is a string
    with a character an id (``to_char``). ``units`` should be partitioned by ``_unit``: then
    nothing here is shuffled.
    """
    table = piece_table(units.sparkSession, vocabulary)
    size = F.length("_unit")
    starts = units.select("_unit", size.alias("_size"), F.explode(F.sequence(F.lit(0), size - 1)).alias("_i"))
    spans = starts.select("_unit", "_i", F.explode(F.sequence(F.col("_i") + 1, F.least(F.col("_size"), F.col("_i") + vocabulary.longest))).alias("_j"))
    spans = spans.select("_unit", "_i", "_j", F.substring("_unit", F.col("_i") + 1, F.col("_j") - F.col("_i")).alias("_piece"))
    # the piece table has as many rows as the model has pieces, whatever the corpus
    edges = spans.join(F.broadcast(table), "_piece")
    place = F.shiftleft(F.col("_j").cast("long"), _END).bitwiseOR(F.col("_i").cast("long"))
    worth = "_merges" if vocabulary.kind == "bpe" else "_score"
    by_unit = edges.select("_unit", F.struct(place.alias("place"), "_char", worth).alias("_edge")).groupBy("_unit").agg(F.collect_list("_edge").alias("_edges"))

    def end_of(x: Column) -> Column:
        return F.shiftright(x["place"], _END)

    def start_of(x: Column) -> Column:
        return x["place"].bitwiseAND((1 << _END) - 1).cast("int")

    if vocabulary.kind == "bpe":
        nothing = F.array().cast("array<bigint>")

        def way(state: Column, x: Column) -> Column:
            so_far, at = F.get(state, start_of(x))["weight"], x["place"].bitwiseAND((1 << _END) - 1)
            weight = F.when(F.size(x["_merges"]) == 0, so_far).otherwise(F.sort_array(F.concat(so_far, F.transform(x["_merges"], lambda m: m - at)), False))
            return F.struct(weight.alias("weight"), start_of(x).alias("start"), x["_char"].alias("char"))
    else:
        nothing = F.struct(F.lit(0.0).cast("float").alias("total"), F.lit(0).alias("order"))

        def way(state: Column, x: Column) -> Column:
            # of equal sums the longest last piece
            total = F.get(state, start_of(x))["weight"]["total"] + x["_score"]
            return F.struct(F.struct(total.alias("total"), (-start_of(x)).alias("order")).alias("weight"), start_of(x).alias("start"), x["_char"].alias("char"))

    def step(state: Column, end: Column) -> Column:
        best = F.array_max(F.transform(F.filter("_edges", lambda x: end_of(x) == end), lambda x: way(state, x)))
        # an array of one, so that the choice is made once
        return F.concat(state, F.transform(F.array(best), lambda b: F.struct(b["weight"].alias("weight"), F.concat(F.get(state, b["start"])["ids"], b["char"]).alias("ids"))))

    begin = F.array(F.struct(nothing.alias("weight"), F.lit("").alias("ids")))
    nodes = F.sequence(F.lit(1).cast("long"), F.length("_unit").cast("long"))
    return by_unit.select("_unit", F.aggregate(nodes, begin, step, lambda s: F.element_at(s, -1)["ids"]).alias("_ids"))


def _chunked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, _text, _chunk), the same chunk for a row whenever it is read."""
    from pyspark.errors import AnalysisException

    chunk = F.xxhash64("_metadata.file_path", (F.col("_metadata.row_index") / CHUNK_ROWS).cast("long")).alias("_chunk")
    columns = [F.col(id_col).alias("_id"), common.text_of(text_col).alias("_text")]
    try:
        return docs.select(*columns, chunk)
    except AnalysisException:
        # not a plain Parquet relation: written once, it is one
        return common.stored(docs.select(*columns), "texts").select("_id", "_text", chunk)


def _lexicon(rows: DataFrame, vocabulary: Vocabulary) -> tuple[str, int]:
    """Write (_chunk, _unit, _ids) of all units; returns the folder and its number of buckets of chunks."""
    spark = rows.sparkSession

    def different(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        own = splitter(vocabulary)
        chunk, held, size, seen = None, [], 0, None

        def made():
            units = pc.unique(pa.concat_arrays(held)) if held else ()
            for at in range(0, len(units), 50_000):
                some = units.slice(at, 50_000)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), chunk, np.int64)), some], names=["_chunk", "_unit"])

        for batch in batches:
            chunks = batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero(chunks[1:] != chunks[:-1]) + 1).tolist(), len(chunks)]
            for begin, stop in zip(cuts, cuts[1:], strict=False):
                if begin == stop:
                    continue
                if chunks[begin] != chunk:
                    yield from made()
                    chunk, held, size, seen = int(chunks[begin]), [], 0, None
                for at in range(begin, stop, ROWS):
                    for parts, _ in own.slices(batch.column(0).slice(at, min(ROWS, stop - at)).to_pylist()):
                        if not any(parts):
                            continue
                        words = own.words(parts)[0]
                        # words of this chunk that were cut before have no new units
                        new = words if seen is None else words.filter(pc.invert(pc.is_in(words, value_set=seen)))
                        seen = words if seen is None else pa.concat_arrays([seen, new])
                        held.append(pc.unique(Units(new, own).usual()))
                        size += len(held[-1])
                        if size >= HELD or len(seen) >= HELD:
                            yield from made()
                            held, size, seen = [], 0, None
        yield from made()
        held, seen = [], None
        common.tidy()

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = common.stored(rows.select("_text", "_chunk").mapInArrow(different, "_chunk long, _unit string"), "units")
    encoded = lattice(found.select("_unit").distinct(), vocabulary)
    placed = found.join(encoded.hint("merge"), "_unit").select(F.pmod("_chunk", F.lit(parts)).alias("_bucket"), "_chunk", "_unit", "_ids")
    folder = common.scratch(spark, "lexicon")
    placed.repartition(parts, "_bucket").sortWithinPartitions("_bucket", "_chunk").write.partitionBy("_bucket").option("parquet.block.size", 8 << 20).parquet(folder)
    return folder, parts


def _encoded(docs: DataFrame, path: str, id_col: str, text_col: str, columns: str, finish) -> DataFrame:
    """(id, columns): what ``finish(ids, ends)`` makes of the ids of some texts, as Arrow arrays."""
    vocabulary = load(path)
    rows = _chunked(docs, id_col, text_col)
    kind = rows.schema["_id"].dataType.simpleString()
    folder, buckets = _lexicon(rows, vocabulary)
    names = ["_id", *(c.split()[0] for c in columns.split(", "))]

    def load_chunk(chunk: int) -> Lexicon:
        import pyarrow as pa
        import pyarrow.dataset as ds
        from pyarrow import fs

        files, place = common.file_system(f"{folder}/_bucket={chunk % buckets}")
        if files.get_file_info(place).type == fs.FileType.NotFound:
            return Lexicon(pa.array([], pa.string()), pa.array([], pa.string()), splitter(vocabulary))
        own = ds.dataset(place, filesystem=files, format="parquet").to_table(columns=["_unit", "_ids"], filter=ds.field("_chunk") == chunk, use_threads=False)
        return Lexicon(*(own.column(k).combine_chunks() for k in range(2)), splitter(vocabulary))

    def look_up(batches):
        import pyarrow as pa

        own, chunk, lexicon = splitter(vocabulary), None, None
        for batch in batches:
            chunks = batch.column(2).to_numpy()
            cuts = [0, *(np.flatnonzero(chunks[1:] != chunks[:-1]) + 1).tolist(), len(chunks)]
            for begin, stop in zip(cuts, cuts[1:], strict=False):
                if begin < stop and chunks[begin] != chunk:
                    lexicon = None
                    chunk, lexicon = int(chunks[begin]), load_chunk(int(chunks[begin]))
                for at in range(begin, stop, ROWS):
                    some = batch.slice(at, min(ROWS, stop - at))
                    row = 0
                    for parts, counts in own.slices(some.column(1).to_pylist()):
                        ids, sizes = lexicon.ids(parts) if any(parts) else (np.zeros(0, np.int32), np.zeros(len(parts), np.int64))
                        ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)])]
                        if not vocabulary.bytes:
                            ids, ends = _fused(ids, ends, vocabulary.unknown)
                        yield pa.RecordBatch.from_arrays([some.column(0).slice(row, len(counts)), *finish(vocabulary, ids, ends)], names=names)
                        row += len(counts)
        lexicon = None
        common.tidy()

    return rows.mapInArrow(look_up, f"_id {kind}, {columns}").withColumnRenamed("_id", id_col)


def _fused(ids: np.ndarray, ends: np.ndarray, unknown: int) -> tuple[np.ndarray, np.ndarray]:
    """A run of unknown pieces in a text counts once."""
    stays = np.ones(len(ids), bool)
    stays[1:] = (ids[1:] != unknown) | (ids[:-1] != unknown)
    stays[ends[:-1][ends[:-1] < len(ids)]] = True
    return ids[stays], np.concatenate([[0], np.cumsum(stays)])[ends]


def _as_lists(vocabulary, ids, ends) -> list:
    import pyarrow as pa

    return [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids) for each row of ``docs``: ids as array<int>, those of the sentencepiece library.

    Null and empty texts have no ids. Repeated rows give repeated results, null ids stay
    null, an empty table gives an empty result; other columns are not read. Characters
    without a piece become byte pieces, or the unknown piece where the model has none, once
    a run of them. Unbroken runs of more than ``UNIT`` characters that pieces could all join,
    and units with a character that is no piece, are merged directly and not in the lattice.
    """
    return _encoded(docs, path, id_col, text_col, "ids array<int>", _as_lists)


_tables: dict[str, tuple] = {}


def texts_of(vocabulary: Vocabulary, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """The texts, in UTF-8, that ids decode to; text ``k`` has those from ``ends[k]`` to ``ends[k + 1]``.

    Byte pieces join to characters, wrong ones are replaced; control pieces are left out.
    """
    if vocabulary.path not in _tables:
        normal, back = set(vocabulary.normal), {i: bytes([b]) for b, i in vocabulary.bytes.items()}
        all_bytes = [p.replace(BLANK, " ").encode() if i in normal else back.get(i, " ⁇ ".encode() if i == vocabulary.unknown else b"") for i, p in enumerate(vocabulary.pieces)]
        size = np.fromiter(map(len, all_bytes), np.int64, len(all_bytes))
        _tables[vocabulary.path] = np.frombuffer(b"".join(all_bytes), np.uint8), np.cumsum(size) - size, size
    body, start, size = _tables[vocabulary.path]
    sizes = size[ids]
    before = np.cumsum(sizes) - sizes
    data = body[np.arange(int(sizes.sum())) + np.repeat(start[ids] - before, sizes)].tobytes()
    places = np.concatenate([[0], np.cumsum(sizes)])[ends].tolist()
    out = []
    for a, b in zip(places, places[1:], strict=False):
        text = data[a:b]
        text = text[1:] if vocabulary.prefix and text[:1] == b" " else text
        try:
            text.decode()
        except UnicodeDecodeError:
            text = text.decode(errors="replace").encode()
        out.append(text.replace(BLANK.encode(), b" "))
    return out


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """``encoded`` with the text that the ids in ``ids_col`` decode to; null ids give a null text."""
    return encoded.withColumn(text_col, decoded(F.col(ids_col), path))


def decoded(ids: Column, path: str) -> Column:
    """The text of an array of ids; byte pieces join to characters, wrong ones are replaced."""
    vocabulary = load(path)
    back = {i: f"{b:02X}" for b, i in vocabulary.bytes.items()}
    normal = set(vocabulary.normal)
    unknown = " ⁇ ".encode().hex().upper()
    hexes = [vocabulary.pieces[i].encode().hex().upper() if i in normal else back.get(i, unknown if i == vocabulary.unknown else "") for i in range(len(vocabulary.pieces))]
    # a constant: one string that the optimizer splits once
    table = F.split(F.lit(" ".join(hexes)), " ")
    text = F.make_valid_utf8(F.unhex(F.array_join(F.transform(ids, lambda i: F.get(table, i)), "")).cast("string"))
    text = F.replace(text, F.lit(BLANK), F.lit(" "))
    return F.regexp_replace(text, "^ ", "") if vocabulary.prefix else text


def _digests(vocabulary, ids, ends) -> list:
    import pyarrow as pa

    data, places = ids.astype(">u4").tobytes(), (4 * ends).tolist()
    sums = [zlib.crc32(data[a:b]) for a, b in zip(places, places[1:], strict=False)]
    return [pa.array(np.diff(ends)), pa.array(sums, pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in texts_of(vocabulary, ids, ends)], pa.string())]


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_pieces, ids_crc32 (of the ids as big-endian unsigned 32-bit integers), decoded_sha256.

    Ids are those of :func:`encode`; the last is of the UTF-8 text that they decode to.
    """
    return _encoded(docs, path, id_col, text_col, "n_pieces long, ids_crc32 long, decoded_sha256 string", _digests)


def reference_crc(ids: list[int]) -> int:
    """The checksum of :func:`round_trip` in plain Python, for tests."""
    return zlib.crc32(np.array(ids, ">u4").tobytes())


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(common.table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
