"""Jaccard self-join of word shingles by vertical partitioning, and its components.

Documents with the same set of shingles are one node. Shingles have a global order: rare
ones by hash, then the frequent ones by how often the corpus has them. The order is cut into
fragments:

* The *head* of a set, its first quarter and one, must meet the head of every set it is
  similar to. Heads are range-partitioned by (shingle, node) and streamed in order, so even a
  shingle that a third of all sets have is spread over many tasks and no list is ever held.
* Overlaps are counted fragment by fragment, for each pair of nodes and fragment of the
  order a partial count, and summed for each pair.

Groups of near copies would make all their pairs. Instead there are two rounds. In the first,
every list links its nodes to one of them, the pivot, which has the fewest shingles of its own; pairs that
are similar are links, and connected nodes a component. The second takes, of every list, pairs of nodes in
*different* components; a pair inside one can't change any component. Both rounds verify with exact overlaps.
The second first tries one pair of nodes for two components that meet; two nodes without links are settled by
that. What still meets then is expanded list by list, or, where two components have fewer pairs of nodes than
lists in common, as all those pairs, once. Copies share runs of the global order; a list that all nodes of two
components reach from one and the same list is left out, as that one has the same pairs with more room.

Heads carry positions. If a list is the first that two sets have in common, their overlap is at most what
either has from there on. Every similar pair has such a list, so a pair counts only in lists where both
positions leave room for the overlap that similar sets of their sizes have. Two copies that differ from a
third by edits of their own have those edits in front, and meet too late to be expanded.

Nothing here is approximate but the 64-bit hashes. Frequency only shapes the order, any order
gives the same result; the table of frequent shingles is therefore bounded
(``FREQUENT``), as is the bit map that keeps texts without candidates from being cut again.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common
from .components import components
from .shingles import set_key, shingles

SIZE = 5
#: Similar: 100 * intersection >= PERCENT * union.
PERCENT = 75
FRAGMENTS = 4
#: Most frequent shingles in the order's table (12 bytes each), and shingles counted together.
FREQUENT, COUNTED = 1 << 19, 1 << 20
#: Bits of the map of nodes with candidates, at most.
MAP_BITS = 1 << 26


def head_size(n: Column) -> Column:
    """Shingles in the head of a set of n: n - ceil(n * PERCENT / 100) + 1."""
    return n - F.floor((n * PERCENT + 99) / 100).cast("int") + 1


def _similar(both: Column, n: Column, m: Column) -> Column:
    return both * 100 >= (n + m - both) * PERCENT


def _order(found: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A set in the global order, with the rank of each frequent shingle (0: rare)."""
    values, ranks = frequent
    if not len(values) or not len(found):
        return found, np.zeros(len(found), np.int32)
    at = np.minimum(np.searchsorted(values, found), len(values) - 1)
    rank = np.where(values[at] == found, ranks[at], 0)
    order = np.argsort(rank, kind="stable")
    return found[order], rank[order]


def _sets(docs: DataFrame, text_col: str, extra: list[str]):
    """``docs`` as (extra columns, text) for a mapInArrow over sets."""
    return docs.select(*extra, F.col(text_col).cast("string").alias("_text"))


def _survey(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Of each document (_id, _th, _key, _n), and (_s, _c) of shingles that may be frequent, in one pass.

    ``_th`` is the hash of the text, ``_key`` that of its set of ``_n`` shingles. Tasks count
    their shingles ``COUNTED`` at a time and pass on those that two sets have; equal sets count
    once a task. A group of near copies that grows with the corpus has two in some of those, however
    it is spread; of three it would take many more members, and what all of them share would count as rare.
    """
    kind = docs.select(id_col).dtypes[0][1]

    def measure(batches):
        import pyarrow as pa

        held, size, seen, names = [], 0, set(), ["_id", "_th", "_key", "_n", "_s", "_c"]

        def passed_on(id_type):
            values, times = np.unique(np.concatenate(held), return_counts=True)
            many = times >= 2
            n = int(many.sum())
            return pa.RecordBatch.from_arrays([pa.nulls(n, id_type), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.array(values[many].view(np.int64)), pa.array(times[many].astype(np.int64))], names=names)

        id_type = None
        for batch in batches:
            keys, sizes, id_type = [], [], batch.column(0).type
            for _, found in shingles(batch.column(2)):
                keys.append(key := set_key(found))
                sizes.append(len(found))
                if key in seen:
                    continue
                seen.add(key)
                held.append(found)
                size += len(found)
                if size >= COUNTED:
                    yield passed_on(id_type)
                    held, size = [], 0
                    seen.clear()
            n = len(keys)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.int64()), pa.array(sizes, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], names=names)
        if held:
            yield passed_on(id_type)
            held.clear()
        common.tidy()

    rows = _sets(docs, text_col, [F.col(id_col).alias("_id"), F.xxhash64(common.text_of(text_col)).alias("_th")])
    return rows.mapInArrow(measure, f"_id {kind}, _th long, _key long, _n int, _s long, _c long")


def _frequent(survey: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles, ascending, and their ranks from 1 on by frequency."""
    counts = survey.where("_c is not null").groupBy("_s").agg(F.sum("_c").alias("_c"))
    top = counts.orderBy(F.desc("_c"), "_s").limit(FREQUENT).toPandas().sort_values(["_c", "_s"])
    values = top["_s"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(values)
    return values[order], (np.arange(len(values), dtype=np.int32) + 1)[order]


#: A node's entry in a list, in one long: share of rare shingles in thousandths, size of the set, position.
_SHARE, _SIZE = 53, 26


def _heads(docs: DataFrame, text_col: str, frequent) -> DataFrame:
    """(_s, _key, _x): the shingles in the head of each set; equal sets once a task, at least.

    The upper part of ``_x`` is the share of rare shingles. Of near copies the one with fewest
    changes of its own has the smallest, and is similar to most of them.
    """
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def head(batches):
        import pyarrow as pa

        seen: set[int] = set()
        for batch in batches:
            parts, keys, entries, lengths = [], [], [], []

            def made():
                out = [np.concatenate(parts).view(np.int64), np.repeat(np.array(keys, np.int64), np.array(lengths)), np.concatenate(entries)]
                return pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["_s", "_key", "_x"])

            for _, found in shingles(batch.column(0)):
                n, key = len(found), set_key(found)
                if not n or key in seen:
                    continue
                if n >= 1 << _SHARE - _SIZE:
                    raise ValueError("a text has more shingles than an entry can tell")
                seen.add(key)
                ordered, rank = _order(found, shared.value)
                some = ordered[: n - -(-n * PERCENT // 100) + 1]
                parts.append(some)
                keys.append(key)
                entries.append((1000 * int((rank == 0).sum()) // n << _SHARE | n << _SIZE) + np.arange(len(some), dtype=np.int64))
                lengths.append(len(some))
                if len(parts) >= 1000:
                    yield made()
                    parts, keys, entries, lengths = [], [], [], []
            if parts:
                yield made()
            if len(seen) > 1 << 20:
                seen.clear()
        common.tidy()

    return _sets(docs, text_col, []).mapInArrow(head, "_s long, _key long, _x long")


def _size_of(x: str) -> Column:
    return F.shiftright(x, _SIZE).bitwiseAND((1 << _SHARE - _SIZE) - 1).cast("int")


def _left_of(x: str) -> Column:
    """How many shingles a set has from the position of an entry on."""
    return (_size_of(x) - F.col(x).bitwiseAND((1 << _SIZE) - 1)).cast("int")


def _lists(heads: DataFrame) -> DataFrame:
    """(_s, _key, _x, _pivot, _y): each node of a list that isn't its pivot, with the pivot, and the entries of both; stored.

    A list that goes on from one task to the next has a pivot in each; those come last, in a
    join of two rows a task.
    """
    names, ddl = ["_s", "_key", "_x", "_pivot", "_y"], "_s long, _key long, _x long, _pivot long, _y long"

    def stream(batches):
        import pyarrow as pa

        s = key = pivot = y = None

        def edge():
            return pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in (s, None, None, pivot, y)], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            ss, keys, xs = (batch.column(k).to_numpy() for k in range(3))
            if s is None:
                s, pivot, y = int(ss[0]), int(keys[0]), int(xs[0])
                yield edge()
                key = pivot
            new = np.empty(len(ss), bool)
            new[0] = ss[0] != s
            new[1:] = ss[1:] != ss[:-1]
            start = np.maximum.accumulate(np.where(new, np.arange(len(ss)), -1))
            pivots = np.where(start < 0, pivot, keys[start])
            ys = np.where(start < 0, y, xs[start])
            again = np.empty(len(ss), bool)
            again[0] = ss[0] == s and keys[0] == key
            again[1:] = (ss[1:] == ss[:-1]) & (keys[1:] == keys[:-1])
            some = ~new & ~again & (keys != pivots)
            if some.any():
                yield pa.RecordBatch.from_arrays([pa.array(v[some].astype(np.int64)) for v in (ss, keys, xs, pivots, ys)], names=names)
            s, key, pivot, y = int(ss[-1]), int(keys[-1]), int(pivots[-1]), int(ys[-1])
        if s is not None:
            yield edge()

    ordered = heads.repartitionByRange("_s", "_x", "_key").sortWithinPartitions("_s", "_x", "_key")
    found = common.stored(ordered.mapInArrow(stream, ddl), "lists")
    edges = found.where("_key is null").select("_s", F.col("_pivot").alias("_key"), F.col("_y").alias("_x")).distinct()
    first = edges.groupBy("_s").agg(F.min_by("_key", "_key").alias("_pivot"), F.min_by("_x", "_key").alias("_y"), F.count(F.lit(1)).alias("_c")).where("_c > 1").drop("_c")
    more = edges.join(first, "_s").where("_key <> _pivot").select(*names)
    whole = common.stored(found.where("_key is not null").unionByName(more), "pairs")
    common.remove(found)
    return whole


def _verified(docs: DataFrame, text_col: str, members: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
    """(_a, _b): which of the candidate pairs (_a, _b, _n, _m) are similar, by their exact overlaps; stored."""
    spark = docs.sparkSession
    nodes = pairs.select(F.col("_a").alias("_key")).union(pairs.select("_b")).distinct()
    # of the texts that have a node's set one is enough
    nodes = common.stored(members.join(nodes, "_key", "left_semi").groupBy("_key").agg(F.min("_th").alias("_th")), "candidates")
    bits = 1 << 10
    known = nodes.count()
    while bits < 16 * known and bits < MAP_BITS:
        bits *= 2

    def bitmap(batches):
        import pyarrow as pa

        have = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            place = batch.column(0).to_numpy().view(np.uint64) & np.uint64(bits - 1)
            np.bitwise_or.at(have, place >> np.uint64(3), np.uint8(1) << (place & np.uint64(7)).astype(np.uint8))
        yield pa.RecordBatch.from_pydict({"map": [have.tobytes()]})

    have = np.zeros(bits // 8, np.uint8)
    for row in nodes.select("_th").coalesce(4).mapInArrow(bitmap, "map binary").toLocalIterator():
        have |= np.frombuffer(row[0], np.uint8)
    shared = spark.sparkContext.broadcast(have)

    def cut(batches):
        import pyarrow as pa

        seen: set[int] = set()
        for batch in batches:
            keys, parts, values = [], [], []
            place = batch.column(0).to_numpy().view(np.uint64) & np.uint64(bits - 1)
            some = shared.value[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1
            for _, found in shingles(batch.column(1).filter(pa.array(some.astype(bool)))):
                key = set_key(found)
                if not len(found) or key in seen:
                    continue
                seen.add(key)
                # fragments of the global order: ranges of the hash, whatever the frequency
                bounds = np.searchsorted(found, np.arange(1, FRAGMENTS, dtype=np.uint64) * np.uint64((1 << 64) // FRAGMENTS))
                for part, own in enumerate(np.split(found.view(np.int64), bounds)):
                    keys.append(key)
                    parts.append(part)
                    values.append(own)
                if len(keys) >= 1000:
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(parts, pa.int32()), pa.array(values, pa.list_(pa.int64()))], names=["_key", "_part", "_values"])
                    keys, parts, values = [], [], []
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(parts, pa.int32()), pa.array(values, pa.list_(pa.int64()))], names=["_key", "_part", "_values"])
            if len(seen) > 1 << 20:
                seen.clear()
        common.tidy()

    texts = _sets(docs, text_col, [F.xxhash64(common.text_of(text_col)).alias("_th")])
    pieces = texts.mapInArrow(cut, "_key long, _part int, _values array<long>")
    # the join first: rows dealt out by the node are dealt for both steps
    pieces = common.stored(pieces.join(nodes.select("_key"), "_key", "left_semi").dropDuplicates(["_key", "_part"]), "fragments")
    each = pairs.withColumn("_part", F.explode(F.array(*map(F.lit, range(FRAGMENTS)))))
    left = each.join(pieces.select(F.col("_key").alias("_a"), "_part", F.col("_values").alias("_va")), ["_a", "_part"])
    both = left.join(pieces.select(F.col("_key").alias("_b"), "_part", F.col("_values").alias("_vb")), ["_b", "_part"])
    counted = both.select("_a", "_b", "_n", "_m", F.size(F.array_intersect("_va", "_vb")).alias("_some"))
    counted = counted.groupBy("_a", "_b", "_n", "_m").agg(F.sum("_some").alias("_both"))
    links = common.stored(counted.where(_similar(F.col("_both"), F.col("_n"), F.col("_m"))).select("_a", "_b"), name)
    common.remove(pieces)
    return links


def _room(left: Column, n: Column, m: Column) -> Column:
    """What one set has left is enough for the overlap of similar sets of these sizes."""
    return left * (100 + PERCENT) >= (n + m) * PERCENT


def _close(n: Column, m: Column) -> Column:
    """Sizes that allow similar sets."""
    return F.least(n, m) * 100 >= F.greatest(n, m) * PERCENT


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: id, n_shingles, component_id (its component's smallest id).

    Null and empty texts and texts of white space have no shingles and are linked with
    nothing: their component is their own id. Rows that repeat an id or a text are nodes of
    their own with equal results. Null ids take part and are never a ``component_id`` unless
    their component has no other. An empty table gives an empty result; other columns are
    not read.
    """
    return _labelled(docs, id_col, text_col, False)


def _between(links: DataFrame, labels: DataFrame) -> DataFrame:
    """The links (_a, _b) as links of components."""
    found = links.join(labels, F.col("_a") == F.col("_node"), "left").select(F.coalesce("_comp", "_a").alias("_a"), "_b")
    return found.join(labels, F.col("_b") == F.col("_node"), "left").select("_a", F.coalesce("_comp", "_b").alias("_b"))


def _met(nodes: DataFrame, labels: DataFrame, tried: bool = False) -> DataFrame:
    """Pairs of components that share a list with room for a similar pair: sizes, room, and of each the node with most room.

    If one pair of nodes was ``tried`` for each, two components of one node each are left out. So are
    lists where all nodes of both components come from one and the same list (``_p``): there they meet
    with all these nodes and more room.
    """
    named = nodes.join(labels, nodes["_key"] == labels["_node"], "left").select("_s", "_key", "_n", "_l", "_p", F.coalesce("_comp", "_key").alias("_comp"), F.col("_comp").isNotNull().alias("_linked"))
    same = F.when((F.count("_p") == F.count(F.lit(1))) & (F.min("_p") == F.max("_p")), F.min("_p"))
    groups = named.groupBy("_s", "_comp", "_linked").agg(same.alias("_p"), F.min("_n").alias("_lo"), F.max("_n").alias("_hi"), F.max("_l").alias("_l"), F.max(F.struct("_l", "_key", "_n")).alias("_best"))
    groups = groups.withColumns({"_rep": F.col("_best._key"), "_rn": F.col("_best._n")})
    a, b = (groups.select("_s", *(F.col(c).alias(f"{c}_{x}") for c in ("_comp", "_linked", "_p", "_lo", "_hi", "_l", "_rep", "_rn"))) for x in "ab")
    sizes = (F.col("_lo_a") * PERCENT <= F.col("_hi_b") * 100) & (F.col("_lo_b") * PERCENT <= F.col("_hi_a") * 100)
    fits = (F.col("_comp_a") < F.col("_comp_b")) & sizes & _room(F.least("_l_a", "_l_b"), F.col("_lo_a"), F.col("_lo_b")) & ~F.coalesce(F.col("_p_a") == F.col("_p_b"), F.lit(False))
    if tried:
        fits &= F.col("_linked_a") | F.col("_linked_b")
    return a.join(b, "_s").where(fits)


def _few_pairs(met: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs of components (_comp_a, _comp_b) that have at most as many pairs of nodes as lists in common."""
    sizes = labels.groupBy("_comp").agg(F.count(F.lit(1)).alias("_size"))
    pairs = met.groupBy("_comp_a", "_comp_b").agg(F.count(F.lit(1)).alias("_c"))
    for x in "ab":
        pairs = pairs.join(sizes.withColumnsRenamed({"_comp": f"_comp_{x}", "_size": f"_size_{x}"}), f"_comp_{x}", "left")
    one = F.lit(1).cast("long")
    return pairs.where(F.coalesce("_size_a", one) * F.coalesce("_size_b", one) <= F.col("_c")).select("_comp_a", "_comp_b")


def _enough(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (_a, _b, _n, _m) that share lists enough: with the larger rest beyond the heads they reach the overlap."""
    n, m = F.col("_n"), F.col("_m")
    pairs = common.stored(pairs, "met_pairs")
    some = pairs.select(F.col("_a").alias("_key")).union(pairs.select("_b")).distinct()
    held = nodes.join(some, "_key", "left_semi").groupBy("_key").agg(F.collect_list("_s").alias("_lists"))
    both = pairs.join(held.select(F.col("_key").alias("_a"), F.col("_lists").alias("_of_a")), "_a").join(held.select(F.col("_key").alias("_b"), F.col("_lists").alias("_of_b")), "_b")
    rest = F.greatest(n - head_size(n), m - head_size(m))
    return both.where((F.size(F.array_intersect("_of_a", "_of_b")) + rest) * (100 + PERCENT) >= (n + m) * PERCENT).select("_a", "_b", "_n", "_m")


def _labelled(docs: DataFrame, id_col: str, text_col: str, hashed: bool) -> DataFrame:
    """:func:`near_duplicates`, with _th, the hash of the text, in front if ``hashed``."""
    th = ["_th"] if hashed else []
    survey = common.stored(_survey(docs, id_col, text_col), "survey")
    members = survey.where("_c is null").drop("_s", "_c")
    lists = _lists(_heads(docs, text_col, _frequent(survey)))

    # first round: nodes and pivots that share a fair part of their heads
    n, m = F.col("_n"), F.col("_m")
    star = lists.select(F.col("_pivot").alias("_a"), F.col("_key").alias("_b"), _size_of("_x").alias("_n"), _size_of("_y").alias("_m"), _left_of("_x").alias("_l"), _left_of("_y").alias("_k"))
    room = _room(F.least("_l", "_k"), n, m)
    star = star.where(_close(n, m)).groupBy("_a", "_b", "_n", "_m").agg(F.count(F.lit(1)).alias("_c"), F.max(room).alias("_room"))
    star = common.stored(star.where(F.col("_room") & (F.col("_c") * 8 >= F.least(head_size(n), head_size(m)))).drop("_c", "_room"), "star")
    links = _verified(docs, text_col, members, star, "star_links")
    labels = components(links)

    # second round: nodes of different components that share a list
    nodes = lists.select("_s", "_key", "_x").union(lists.select("_s", "_pivot", "_y")).distinct()
    # with the list that each node has before, in the global order
    before = F.lag("_s").over(W.partitionBy("_key").orderBy("_x"))
    nodes = common.stored(nodes.select("_s", "_key", _size_of("_x").alias("_n"), _left_of("_x").alias("_l"), before.alias("_p")), "listed")
    # first one pair of nodes for two components, the one with most room: often that merges them
    met = _met(nodes, labels)
    best = F.max_by(F.struct("_rep_a", "_rep_b", "_rn_a", "_rn_b"), F.least("_l_a", "_l_b")).alias("_best")
    few = met.groupBy("_comp_a", "_comp_b").agg(best).select(F.col("_best._rep_a").alias("_a"), F.col("_best._rep_b").alias("_b"), F.col("_best._rn_a").alias("_n"), F.col("_best._rn_b").alias("_m"))
    few = common.stored(_enough(few.where(_close(n, m)), nodes), "few")
    labels = components(links.union(_verified(docs, text_col, members, few, "few_links")))
    met = common.stored(_met(nodes, labels, tried=True).select("_s", "_comp_a", "_comp_b", "_lo_a", "_lo_b", "_l_b"), "met")
    few = common.stored(_few_pairs(met, labels), "few_pairs")
    sets = members.where("_n > 0").select("_key", "_n").distinct()
    sets = common.stored(sets.join(labels, sets["_key"] == labels["_node"], "left").select("_key", "_n", F.coalesce("_comp", "_key").alias("_comp")), "sets")
    one = sets.select(F.col("_comp").alias("_comp_a"), F.col("_key").alias("_a"), "_n")
    two = sets.select(F.col("_comp").alias("_comp_b"), F.col("_key").alias("_b"), F.col("_n").alias("_m"))
    whole = few.join(one, "_comp_a").join(two, "_comp_b").where(_close(n, m)).select("_a", "_b", "_n", "_m")
    met = met.join(few, ["_comp_a", "_comp_b"], "left_anti")
    # nodes of the components that still meet
    meet = met.select(F.col("_comp_a").alias("_comp")).union(met.select("_comp_b")).distinct()
    named = nodes.join(sets.join(meet, "_comp", "left_semi").select("_key", "_comp"), "_key").select("_s", "_key", "_n", "_l", "_comp")
    one = named.select("_s", F.col("_comp").alias("_comp_a"), F.col("_key").alias("_a"), "_n", "_l")
    two = named.select("_s", F.col("_comp").alias("_comp_b"), F.col("_key").alias("_b"), F.col("_n").alias("_m"), F.col("_l").alias("_k"))
    cross = met.join(one, ["_s", "_comp_a"]).where(_room(F.least("_l", "_l_b"), n, F.col("_lo_b")))
    cross = cross.join(two, ["_s", "_comp_b"]).where(_close(n, m) & _room(F.least("_l", "_k"), n, m)).select("_a", "_b", "_n", "_m").distinct().union(whole)
    cross = _enough(cross, nodes)
    more = _verified(docs, text_col, members, common.stored(cross, "cross"), "cross_links")
    merged = components(_between(more, labels)).withColumnsRenamed({"_node": "_was", "_comp": "_now"})

    rows = members.join(labels, members["_key"] == labels["_node"], "left").select(*th, "_id", "_n", F.coalesce("_comp", "_key").alias("_comp"))
    rows = rows.join(merged, F.col("_comp") == F.col("_was"), "left").select(*th, "_id", "_n", F.coalesce("_now", "_comp").alias("_comp"))
    least = rows.where("_n > 0").groupBy("_comp").agg(F.min("_id").alias("_least"), F.count(F.lit(1)).alias("_size")).where("_size > 1").drop("_size")
    rows = rows.join(least, "_comp", "left")
    return rows.select(*th, F.col("_id").alias(id_col), F.col("_n").cast("long").alias("n_shingles"), F.when(F.col("_n") > 0, F.coalesce("_least", "_id")).otherwise(F.col("_id")).alias("component_id"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, the one with the smallest id of each component, with all their columns; decided by id and text."""
    found = _labelled(docs, id_col, text_col, True)
    lost = found.where(~F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col).alias("__lost"), F.col("_th").alias("__lost_th")).distinct()
    same = docs[id_col].eqNullSafe(lost["__lost"]) & (F.xxhash64(common.text_of(text_col)) == lost["__lost_th"])
    return docs.join(lost, same, "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + least(len(w), 5) - 1), ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g WHERE a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
), l AS (
  SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)
), e AS (
  SELECT x, y FROM l UNION ALL SELECT y, x FROM l
), r AS (
  SELECT doc_id, doc_id AS comp FROM documents
  UNION
  SELECT e.y, r.comp FROM r JOIN e ON r.doc_id = e.x
), c AS (
  SELECT doc_id, min(comp) AS component_id FROM r GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id JOIN c ON d.doc_id = c.doc_id
"""
