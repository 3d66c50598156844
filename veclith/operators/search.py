"""Top-k search over codes: one vector or a batch, exact or asymmetric.

A query is rotated once on the driver. Codes are scored where they are read, in Arrow
batches: centroids are gathered and multiplied with all queries at once, and each task keeps
its k best rows a query and passes them on when it ends, so what is sorted grows with the
number of tasks and not with the number of rows. ``content`` and metadata never go through
scoring: a second scan fetches them for the best rows, by a list of ids that reaches the
Parquet scan where codes are stored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import QuantizerConfig
from ..functions import codec
from ..functions.vectors import TINY
from .filters import Filter
from .quantize import code_matrix, decode, matrix, unit

#: Most bytes of rotated queries in one pass; larger batches are taken in blocks.
QUERY_BYTES = 64 << 20
#: Rows and queries that are scored at once.
_PIECE, _TILE = 4096, 1024


class Running:
    """The k best rows of each of some queries so far; of equal scores those with the smallest id."""

    def __init__(self, queries: int, k: int | None, minimum: float, digits: int | None):
        self.k, self.minimum, self.digits = k, minimum, digits
        self.bar = np.full(queries, minimum if minimum > 0 else -np.inf)
        self.who = np.zeros(0, np.int64)
        self.scores, self.ids, self.more = np.zeros(0), None, []

    def add(self, scores: np.ndarray, ids: np.ndarray, more: list, which: np.ndarray | None = None) -> None:
        """Take in a block of scores (row by query); ``more`` are Arrow arrays that go with the rows."""
        which = np.arange(scores.shape[1]) if which is None else which
        bar = self.bar[which]
        if self.k is not None and len(scores) > 4 * self.k and np.isinf(bar).any():
            # the first rows of a task: nothing below the k-th best of a block can count
            bar = np.maximum(bar, np.partition(scores, -self.k, axis=0)[-self.k] - (0 if self.digits is None else 10.0**-self.digits))
        # rounding can lift a score to the bar
        rows, columns = np.nonzero(scores >= (bar if self.digits is None else bar - 10.0**-self.digits))
        found = scores[rows, columns]
        if self.digits is not None:
            found = np.round(found, self.digits)
        stay = found >= self.bar[which[columns]]
        rows, columns, found = rows[stay], columns[stay], found[stay]
        if not len(rows):
            return
        ids = ids.astype(str) if ids.dtype == object else ids
        self.who = np.concatenate([self.who, which[columns]])
        self.scores = np.concatenate([self.scores, found])
        self.ids = ids[rows] if self.ids is None else np.concatenate([self.ids, ids[rows]])
        self.more.append([m.take(rows) for m in more])
        if self.k is not None and len(self.who) > 4 * self.k * len(self.bar):
            self._cut()

    def _cut(self) -> None:
        import pyarrow as pa

        order = np.lexsort((self.ids, -self.scores, self.who))
        who = self.who[order]
        first = np.flatnonzero(np.append(True, who[1:] != who[:-1]))
        place = np.arange(len(who)) - np.repeat(first, np.diff(np.append(first, len(who))))
        keep = order if self.k is None else order[place < self.k]
        if self.k is not None:
            # a query with k rows takes nothing below its last
            last = order[place == self.k - 1]
            self.bar[self.who[last]] = self.scores[last]
        columns = [pa.concat_arrays(c) for c in zip(*self.more, strict=True)]
        self.who, self.scores, self.ids = self.who[keep], self.scores[keep], self.ids[keep]
        self.more = [[c.take(pa.array(keep)) for c in columns]]

    def rows(self) -> tuple[np.ndarray, np.ndarray, list] | None:
        """(numbers of queries, scores, what went with the rows), or null if there are none."""
        if not len(self.who):
            return None
        self._cut()
        return self.who, self.scores, self.more[0]


def _score(df: DataFrame, id_col: str, columns: list[str], block, queries: np.ndarray, qids: list, k: int | None, minimum: float, digits: int | None, kept: tuple[str, ...] = ()) -> DataFrame:
    """(qid, id, kept, score): for each task and query its k best rows, or all if k is null."""
    shared = df.sparkSession.sparkContext.broadcast((queries, np.array(qids, np.int64)))
    kinds = dict(df.dtypes)

    def run(batches):
        import pyarrow as pa

        q, names = shared.value
        best = Running(len(q), k, minimum, digits)
        for batch in batches:
            for start in range(0, batch.num_rows, _PIECE):
                some = batch.slice(start, _PIECE)
                values, ids = block(some), some.column(0).to_numpy(zero_copy_only=False)
                more = [some.column(0), *(some.column(c) for c in kept)]
                for tile in range(0, len(q), _TILE):
                    which = np.arange(tile, min(tile + _TILE, len(q)))
                    best.add(values @ q[which].T, ids, more, which)
        if (found := best.rows()) is not None:
            who, scores, more = found
            yield pa.RecordBatch.from_arrays([pa.array(names[who]), *more, pa.array(scores.astype(np.float64))], names=["qid", id_col, *kept, "score"])

    fields = ", ".join(f"`{c}` {kinds[c]}" for c in (id_col, *kept))
    return df.select(id_col, *columns).mapInArrow(run, f"qid long, {fields}, score double")


def _blocks(n: int, width: int) -> list[range]:
    size = max(1, QUERY_BYTES // (8 * width))
    return [range(a, min(n, a + size)) for a in range(0, n, size)]


def _ranked(scored: DataFrame, id_col: str, k: int) -> DataFrame:
    w = W.partitionBy("qid").orderBy(F.desc("score"), F.col(id_col))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _batch(df, id_col, columns, block, blocks, width: int, k: int, minimum: float, digits: int | None) -> DataFrame:
    out = None
    for qids, rows in blocks:
        one = _ranked(_score(df, id_col, columns, block, rows, qids, k, minimum, digits), id_col, k)
        out = one if out is None else out.unionByName(one)
    if out is None:  # no query
        out = _ranked(_score(df.limit(0), id_col, columns, block, np.zeros((1, width)), [0], k, minimum, digits), id_col, k)
    return out


def _codes_block(config: QuantizerConfig):
    centroids = codec.codebook(config.work_dim, config.bits, config.exact_pdf)[0]
    return lambda batch: centroids[code_matrix(batch.column("codes"), config.work_dim)]


def _raw_block(vector_col: str):
    return lambda batch: unit(matrix(batch.column(vector_col)))[0]


def _queries(queries):
    """Blocks of (ids, vectors) of about QUERY_BYTES: of (id, vector) pairs, or of a DataFrame of two columns.

    Of a DataFrame one block at a time is on the driver.
    """
    if not isinstance(queries, DataFrame):
        rows = list(queries)
        qids, q = [r[0] for r in rows], np.array([r[1] for r in rows], np.float64).reshape(len(rows), -1 if rows else 0)
        for part in _blocks(len(q), q.shape[1]):
            yield [qids[i] for i in part], q[part.start : part.stop]
        return
    rows = queries.select(F.col(queries.columns[0]).cast("long").alias("qid"), F.col(queries.columns[1]).cast("array<double>").alias("vector"))
    known = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("vector")), F.lit(0)).alias("width")).first()
    count = -(-known["n"] * 8 * known["width"] // QUERY_BYTES)
    for number in range(count):
        table = rows.where(F.pmod(F.xxhash64("qid"), F.lit(count)) == number).toArrow()
        if table.num_rows:
            yield table.column(0).to_pylist(), matrix(table.column(1).combine_chunks())


def knn_batch(codes: DataFrame, queries, config: QuantizerConfig, k: int = 10, id_col: str = "vec_id", minimum: float = 0.0, digits: int | None = None) -> DataFrame:
    """(qid, id, score, rank): for each query the k rows of ``codes`` with the highest asymmetric score.

    ``queries`` are (id, vector) pairs that the driver can hold, or a DataFrame of both, of
    any size, taken in blocks. Equal scores go by id. Queries that count as zero find
    nothing. ``digits`` rounds scores before they are compared.
    """

    def rotated():
        for qids, q in _queries(queries):
            u, lengths = unit(q)
            keep = np.flatnonzero(lengths >= TINY)
            if len(keep):
                yield [qids[i] for i in keep], codec.rotation(config).forward(u[keep])

    return _batch(codes, id_col, ["codes"], _codes_block(config), rotated(), config.work_dim, k, minimum, digits)


def exact_batch(vectors: DataFrame, queries, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", digits: int | None = None) -> DataFrame:
    """(qid, id, score, rank) by exact cosine over full vectors: the ground truth of recall."""
    units = ((qids, unit(q)[0]) for qids, q in _queries(queries))
    return _batch(vectors, id_col, [vector_col], _raw_block(vector_col), units, 1, k, 0.0, digits)


def search(
    codes: DataFrame,
    query,
    config: QuantizerConfig,
    top_k: int = 10,
    offset: int = 0,
    min_score: float = 0.0,
    filter: Filter | None = None,
    rescore: int = 0,
    id_col: str = "vec_id",
    variant: str | None = None,
    digits: int | None = None,
) -> DataFrame:
    """Rows of ``codes`` with the highest score for one query, best first, with ``score`` and ``rank``.

    ``top_k`` of 0 or less is 10. The filter comes before scoring. ``min_score`` counts if
    positive, for the asymmetric score. With ``rescore`` that many candidates (at least
    top_k + offset) are scored again by cosine with what their codes stand for. A query that
    counts as zero finds nothing. Ids may repeat; each row counts. Scoring runs when this is
    called and sends at most top_k + offset (or ``rescore``) rows to the driver.
    """
    top_k = top_k if top_k > 0 else 10
    q, length = unit(np.asarray(query, np.float64)[None])
    rows = filter.apply(codes, variant) if filter else codes
    most = max(top_k + offset, rescore)
    best = []
    if length[0] >= TINY:
        rotated = codec.rotation(config).forward(q)
        found = _score(rows, id_col, ["codes"], _codes_block(config), rotated, [0], most, min_score, digits, ("codes",))
        # at most ``most`` rows
        best = [(r[0], bytes(r[1]), r[2]) for r in found.orderBy(F.desc("score"), id_col).limit(most).select(id_col, "codes", "score").collect()]
    if rescore > 0 and best:
        width = config.work_dim
        x = unit(decode(np.frombuffer(b"".join(c for _, c, _ in best), np.uint8).reshape(-1, width), np.ones(len(best)), config))[0]
        again = (x @ q[0]) if digits is None else np.round(x @ q[0], digits)
        best = [(i, c, float(s)) for (i, c, _), s in zip(best, again, strict=True)]
    # ids may repeat: a row is found again by its id and its codes, equal ones have equal scores
    kind = codes.select(id_col, "codes").schema
    listed = codes.sparkSession.createDataFrame(sorted(set(best)), f"`{id_col}` {kind[0].dataType.simpleString()}, codes binary, score double")
    wanted = rows.drop("score", "rank").where(F.col(id_col).isin([i for i, _, _ in best])) if best else rows.drop("score", "rank").limit(0)
    found = wanted.join(F.broadcast(listed), [id_col, "codes"]).drop("codes")
    ranked = found.orderBy(F.desc("score"), id_col).offset(offset).limit(top_k)
    return ranked.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), id_col)) + offset)


def query(codes: DataFrame, filter: Filter | None = None, page_size: int = 100, order_col: str = "vec_id", variant: str | None = None) -> DataFrame:
    """The first rows that pass a filter, in insertion order; no scores."""
    rows = filter.apply(codes, variant) if filter else codes
    return rows.orderBy(order_col).limit(page_size if page_size > 0 else 100)


def semantic(codes: DataFrame, text: str, embed, config: QuantizerConfig, **options) -> DataFrame:
    """:func:`search` with the vector that ``embed`` gives for a text."""
    if embed is None:
        raise ValueError("no embedding function")
    return search(codes, embed(text), config, **options)
