"""Approximate nearest neighbours by cosine: an NN-descent graph and greedy search.

Equal vectors are one node with the smallest ids that hold it, so a vector that
a third of all rows share is searched once.  The graph starts from few rough
orders of all nodes by the signs of random projections, cut into small blocks
that are joined inside.  Then it descends: in each round the neighbours of a
node, forward and reverse, meet each other through joins on the node; only
pairs with an entry that is new since the last round are measured, and every
node keeps its ``DEGREE`` nearest.  Rounds end when less than ``DELTA`` of the
list entries are new.  A query begins at its own node and opens the nearest
unopened nodes of its beam until none is left.  Graph and search use vectors
rounded to 16 bits; all of the beam is then measured exactly, in double
precision on the original vectors.

Defined cases: vectors that are null, empty, zero, or hold a null or non-finite
component take no part, nor do those whose length is not the most frequent one
(the smaller of equals), as a cosine needs equal lengths; fewer candidates than
asked give fewer rows; ties go to the smaller id; repeated rows of one id and vector count as one; an empty table
gives an empty result; further columns are ignored; very long vectors are as any.

What bounds it: DEGREE forward and as many reverse neighbours of a node, chosen
before vectors are moved, and a beam of BEAM nodes.  So the result is
approximate: recall is measured in the tests and stated in the README.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querymill.llm.chunks import shuffle_partitions
from querymill.llm.session import prepare, stable

DEGREE = 32
#: Random orders of the start, their blocks, and the neighbours that one order gives a node.
ORDERS, BLOCK, FROM_ORDER = 3, 96, 16
#: Rounds end when less than this share of the list entries is new.
DELTA = 0.05
BEAM = 150
#: Reverse neighbours that a node takes in a round, of the new ones and of the others.
REVERSE = 16
HASH_BITS = 62
#: Rows of written tables in a partition, at least: of nodes and of queries with their beams.
NODE_ROWS, QUERY_ROWS = 4096, 128
SEED = 11

LISTS = "node long, ids binary, sims binary"


def _floats(column) -> np.ndarray:
    """Rounded vectors (binary column) as float rows of unit length, nearly."""
    raw = column.to_pylist()
    x = np.frombuffer(b"".join(raw), np.int16).reshape(len(raw), -1).astype(np.float32)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _best(owner: np.ndarray, ids: np.ndarray, sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of (owner, id, sim) triples the k most similar distinct ids of each owner, by owner."""
    order = np.lexsort((ids, owner))
    owner, ids, sims = owner[order], ids[order], sims[order]
    keep = np.ones(len(owner), bool)
    keep[1:] = (owner[1:] != owner[:-1]) | (ids[1:] != ids[:-1])
    owner, ids, sims = owner[keep], ids[keep], sims[keep]
    order = np.lexsort((ids, -sims, owner))
    owner, ids, sims = owner[order], ids[order], sims[order]
    first = np.searchsorted(owner, owner)
    keep = np.arange(len(owner)) - first < k
    return owner[keep], ids[keep], sims[keep]


def _packed(owner: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> list[tuple[int, bytes, bytes]]:
    """Rows (node, ids, sims) of triples that are ordered by owner."""
    at = np.concatenate([[0], np.flatnonzero(owner[1:] != owner[:-1]) + 1, [len(owner)]]) if len(owner) else [0]
    sims = sims.astype(np.float32)
    return [(int(owner[a]), ids[a:b].tobytes(), sims[a:b].tobytes()) for a, b in zip(at, at[1:])]


def _triples(nodes: list[int], ids: list[bytes], sims: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = [len(x) // 8 for x in ids]
    return np.repeat(np.array(nodes, np.int64), n), np.frombuffer(b"".join(ids), np.int64), np.frombuffer(b"".join(sims), np.float32)


def _lists(rows: list[tuple[int, bytes, bytes]]) -> pa.Table:
    columns = list(zip(*rows)) or [(), (), ()]
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.binary(), pa.binary()))], names=["node", "ids", "sims"])


def _gathered(df: DataFrame, rows: int) -> DataFrame:
    """A written table with about ``rows`` rows in a partition or more, so that a small one is not read by hundreds of tasks."""
    return df.coalesce(max(1, -(-df.count() // rows)))


def _block(df: DataFrame, column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(4 * shuffle_partitions(df)))


def valid_rows(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Distinct rows (id, v) that take part."""
    v = F.col(vector_col)
    sound = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.coalesce(sound, F.lit(False)))
    sizes = rows.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), "n").limit(1)
    return rows.join(F.broadcast(sizes), F.size("v") == F.col("n")).select("id", "v").distinct()


def vector_nodes(rows: DataFrame, members: int) -> DataFrame:
    """Nodes (node, v, members): a distinct vector with its smallest ids.

    Spark limits each task's rows of a vector before they are shuffled.
    """
    rank = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    nodes = rows.withColumn("r", rank).where(F.col("r") <= members).groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("members"))
    return nodes.select(F.col("members")[0].alias("node"), "v", "members")


def rounded(nodes: DataFrame) -> DataFrame:
    """(node, q): vectors as 16-bit numbers, scaled by their largest component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array(b.column("v").to_pylist(), np.float64).reshape(b.num_rows, -1)
            q = np.rint(x / np.abs(x).max(axis=1, keepdims=True) * 32767).astype(np.int16) if b.num_rows else x
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array([r.tobytes() for r in q], pa.binary())], names=["node", "q"])

    return nodes.select("node", "v").mapInArrow(run, "node long, q binary")


def first_graph(points: DataFrame, degree: int = DEGREE) -> DataFrame:
    """Lists from ORDERS random orders: nodes with like signs stand side by side and are joined in blocks."""

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _floats(b.column("q"))
            for t in range(ORDERS):
                planes = np.random.default_rng([SEED, t]).normal(size=(x.shape[1], HASH_BITS)).astype(np.float32)
                code = ((x @ planes > 0).astype(np.int64) << np.arange(HASH_BITS)[::-1]).sum(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array(code), b.column("node"), b.column("q")], names=["t", "code", "node", "q"])

    ordered = points.mapInArrow(codes, "t int, code long, node long, q binary")
    ordered = ordered.repartitionByRange(shuffle_partitions(points), "t", "code", "node").sortWithinPartitions("t", "code", "node")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, bytes]]] = {}

        def blocks(last: bool) -> Iterator[pa.RecordBatch]:
            for t, rows in held.items():
                while len(rows) >= 2 * BLOCK or last and rows:
                    own, held[t] = rows[:BLOCK], rows[BLOCK:]
                    if last and len(held[t]) < BLOCK // 2:  # no small block at the end
                        own, held[t] = rows, []
                    rows = held[t]
                    ids = np.array([r[0] for r in own], np.int64)
                    x = _floats(pa.array([r[1] for r in own], pa.binary()))
                    s = x @ x.T
                    np.fill_diagonal(s, -2)
                    k = min(FROM_ORDER, len(ids) - 1)
                    if k > 0:
                        top = np.argpartition(-s, k - 1, axis=1)[:, :k]
                        sims = np.take_along_axis(s, top, 1)
                        rows_out = [(int(i), ids[p].tobytes(), z.tobytes()) for i, p, z in zip(ids, top, sims)]
                        yield from _lists(rows_out).to_batches()

        for b in batches:
            for t, node, q in zip(b.column("t").to_pylist(), b.column("node").to_pylist(), b.column("q").to_pylist()):
                held.setdefault(t, []).append((node, q))
            yield from blocks(False)
        yield from blocks(True)

    return _merged(ordered.mapInArrow(join, LISTS), degree)


def _merged(lists: DataFrame, degree: int) -> DataFrame:
    """One list for each node: the nearest of all its lists."""

    def run(table: pa.Table) -> pa.Table:
        t = _triples(*(table.column(c).to_pylist() for c in ("node", "ids", "sims")))
        return _lists(_packed(*_best(*t, degree)))

    return lists.withColumn("b", _block(lists, "node")).groupBy("b").applyInArrow(run, LISTS)


def _edges(graph: DataFrame) -> DataFrame:
    """(node, other, sim) of all lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, ids, sims = _triples(*(b.column(c).to_pylist() for c in ("node", "ids", "sims")))
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(ids), pa.array(sims)], names=["node", "other", "sim"])

    return graph.mapInArrow(run, "node long, other long, sim float")


GRAPH = "node long, ids binary, sims binary, fresh binary"


def _flagged(lists: DataFrame) -> DataFrame:
    """Lists whose entries are all new."""
    return lists.select("node", "ids", "sims", F.unhex(F.repeat(F.lit("01"), (F.length("ids") / 8).cast("int"))).alias("fresh"))


def descend(graph: DataFrame, points: DataFrame, degree: int = DEGREE, turn: int = 0) -> DataFrame:
    """One round: the neighbours of each node, both ways, meet each other if one of the two is new; lists take what is nearer.

    The result's new entries are those that this round has found.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, ids, sims = _triples(*(b.column(c).to_pylist() for c in ("node", "ids", "sims")))
            fresh = np.frombuffer(b"".join(b.column("fresh").to_pylist()), np.uint8).astype(bool)
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(ids), pa.array(sims), pa.array(fresh)], names=["node", "other", "sim", "fresh"])

    edges = graph.mapInArrow(spread, "node long, other long, sim float, fresh boolean")
    last = edges.groupBy("node").agg(F.min("sim").alias("bar"), F.count(F.lit(1)).alias("n"))
    bars = points.join(last, "node", "left").select(F.col("node").alias("other"), "q", F.when(F.col("n") >= degree, F.col("bar")).otherwise(-2.0).cast("float").alias("bar"))
    # Slim rows first: a hub's reverse neighbours are cut to a random few before any vector is moved.
    back = edges.select(F.col("other").alias("node"), F.col("node").alias("other"), "fresh")
    rank = F.row_number().over(Window.partitionBy("node", "fresh").orderBy(F.xxhash64("other", F.lit(turn)), "other"))
    back = back.withColumn("r", rank).where(F.col("r") <= REVERSE).drop("r")
    ways = edges.select("node", "other", "fresh").union(back).groupBy("node", "other").agg(F.max("fresh").alias("fresh"))
    ways = ways.withColumn("moves", F.max("fresh").over(Window.partitionBy("node"))).where("moves").drop("moves")
    met = ways.join(bars, "other").withColumn("b", _block(graph, "node"))

    def run(table: pa.Table) -> pa.Table:
        node, other, bar = (table.column(c).to_numpy() for c in ("node", "other", "bar"))
        fresh = np.array(table.column("fresh").to_pylist(), bool)
        x = _floats(table.column("q"))
        order = np.lexsort((other, node))
        at = np.concatenate([[0], np.flatnonzero(node[order][1:] != node[order][:-1]) + 1, [len(order)]])
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for lo, hi in zip(at, at[1:]):
            rows = order[lo:hi]
            new = rows[fresh[rows]]
            s = x[new] @ x[rows].T
            unlike = other[new][:, None] != other[rows][None, :]
            i, j = np.nonzero((s > bar[new][:, None]) & unlike)
            found.append((other[new][i], other[rows][j], s[i, j]))
            i, j = np.nonzero((s > bar[rows][None, :]) & unlike)
            found.append((other[rows][j], other[new][i], s[i, j]))
        if not found:
            return _lists([])
        return _lists(_packed(*_best(*(np.concatenate(c) for c in zip(*found)), degree)))

    nearer = met.groupBy("b").applyInArrow(run, LISTS)

    def merge(table: pa.Table) -> pa.Table:
        node, ids, sims = (table.column(c).to_pylist() for c in ("node", "ids", "sims"))
        own, other, sim = _triples(node, ids, sims)
        fresh = np.repeat(np.array(table.column("found").to_pylist(), bool), [len(x) // 8 for x in ids])
        # An entry that the list has already is not new.
        order = np.lexsort((fresh, other, own))
        own, other, sim, fresh = own[order], other[order], sim[order], fresh[order]
        keep = np.ones(len(own), bool)
        keep[1:] = (own[1:] != own[:-1]) | (other[1:] != other[:-1])
        own, other, sim, fresh = own[keep], other[keep], sim[keep], fresh[keep]
        order = np.lexsort((other, -sim, own))
        own, other, sim, fresh = own[order], other[order], sim[order], fresh[order]
        keep = np.arange(len(own)) - np.searchsorted(own, own) < degree
        own, other, sim, fresh = own[keep], other[keep], sim[keep], fresh[keep]
        at = np.concatenate([[0], np.flatnonzero(own[1:] != own[:-1]) + 1, [len(own)]]) if len(own) else [0]
        flags = [fresh[a:b].astype(np.uint8).tobytes() for a, b in zip(at, at[1:])]
        return _lists(_packed(own, other, sim)).append_column("fresh", pa.array(flags, pa.binary()))

    both = graph.select("node", "ids", "sims", F.lit(False).alias("found")).union(nearer.withColumn("found", F.lit(True)))
    return both.withColumn("b", _block(graph, "node")).groupBy("b").applyInArrow(merge, GRAPH)


def settled(graph: DataFrame, points: DataFrame, degree: int = DEGREE, delta: float = DELTA, rounds: int | None = None) -> DataFrame:
    """Rounds of descend until less than ``delta`` of the entries are new; lists only get nearer, so this ends."""
    graph, turn = _flagged(graph), 0
    while rounds is None or turn < rounds:
        graph = stable(descend(graph, points, degree, turn))
        turn += 1
        new = F.length(F.regexp_replace(F.hex("fresh"), "00", "")) / 2
        r = graph.agg(F.count(F.lit(1)).alias("rows"), F.sum(new).alias("fresh"), F.sum(F.length("ids") / 8).alias("n")).first()
        graph = graph.coalesce(max(1, -(-r["rows"] // NODE_ROWS)))
        if not r["n"] or r["fresh"] < delta * r["n"]:
            break
    return graph.select("node", "ids", "sims")


def search_table(graph: DataFrame, points: DataFrame, degree: int = DEGREE) -> DataFrame:
    """(node, around, qs): a node's neighbours, forward and the nearest reverse ones, with their rounded vectors."""
    edges = _edges(graph)
    back = edges.select(F.col("other").alias("node"), F.col("node").alias("other"), "sim")
    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("sim"), "other"))
    back = back.withColumn("r", rank).where(F.col("r") <= degree)
    ways = edges.select("node", "other").union(back.select("node", "other")).distinct()
    full = ways.join(points.withColumnRenamed("node", "other"), "other").withColumn("b", _block(graph, "node"))

    def run(table: pa.Table) -> pa.Table:
        node, other = table.column("node").to_numpy(), table.column("other").to_numpy()
        q = table.column("q").to_pylist()
        order = np.argsort(node, kind="stable")
        at = np.concatenate([[0], np.flatnonzero(node[order][1:] != node[order][:-1]) + 1, [len(order)]])
        rows = [(int(node[order[a]]), other[order[a:b]].tobytes(), b"".join(q[i] for i in order[a:b])) for a, b in zip(at, at[1:])]
        columns = list(zip(*rows)) or [(), (), ()]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.binary(), pa.binary()))], names=["node", "around", "qs"])

    return full.groupBy("b").applyInArrow(run, "node long, around binary, qs binary")


def greedy_search(starts: DataFrame, around: DataFrame, beam: int = BEAM) -> DataFrame:
    """(start, ids, sims): for each start (node, q) the nearest nodes met, opening a beam until all of it is open."""
    schema = "start long, q binary, ids binary, sims binary, open binary"
    one = np.float32(1).tobytes()

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            ids = [np.int64(x).tobytes() for x in b.column("node").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("q"), pa.array(ids, pa.binary()), pa.array([one] * n, pa.binary()), pa.array([b"\0"] * n, pa.binary())], names=["start", "q", "ids", "sims", "open"])

    state = _gathered(stable(starts.select("node", "q").mapInArrow(begin, schema)), QUERY_ROWS)

    def frontier(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple[int, int, bytes, float]] = []
            for start, q, ids, sims, opened in zip(*(b.column(c).to_pylist() for c in ("start", "q", "ids", "sims", "open"))):
                ids, opened = np.frombuffer(ids, np.int64), np.frombuffer(opened, np.uint8)
                bar = float(np.frombuffer(sims, np.float32)[-1]) if len(ids) >= beam else -2.0
                out += [(start, int(i), q, bar) for i in ids[opened == 0]]
            columns = list(zip(*out)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.float32()))], names=["start", "node", "q", "bar"])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _floats(b.column("q"))
            owner, ids, sims = [], [], []
            for i, (start, bar, near, qs) in enumerate(zip(*(b.column(c).to_pylist() for c in ("start", "bar", "around", "qs")))):
                near = np.frombuffer(near, np.int64)
                y = np.frombuffer(qs, np.int16).reshape(len(near), -1).astype(np.float32)
                s = (y @ x[i]) / np.sqrt((y * y).sum(axis=1))
                ok = s > bar
                owner.append(np.full(int(ok.sum()), start, np.int64))
                ids.append(near[ok])
                sims.append(s[ok])
            best = _best(np.concatenate(owner), np.concatenate(ids), np.concatenate(sims), beam)
            yield from _lists(_packed(*best)).to_batches()

    def merge(table: pa.Table, met: pa.Table) -> pa.Table:
        new = _triples(*(met.column(c).to_pylist() for c in ("node", "ids", "sims")))
        start, q = table.column("start").to_pylist(), table.column("q").to_pylist()
        old = _triples(start, table.column("ids").to_pylist(), table.column("sims").to_pylist())
        opened = set(zip(old[0].tolist(), old[1].tolist()))
        # All of the old beam is open now; equal ids keep one entry.
        best = _best(*(np.concatenate(c) for c in zip(old, new)), beam)
        vector = dict(zip(start, q))
        rows = [(s, vector[s], i, z, bytes((s, j) in opened for j in np.frombuffer(i, np.int64).tolist())) for s, i, z in _packed(*best)]
        columns = list(zip(*rows)) or [()] * 5
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), *[pa.binary()] * 4))], names=["start", "q", "ids", "sims", "open"])

    while True:
        # The frontier goes to the table, which is kept by node and not shuffled again.
        ask = state.mapInArrow(frontier, "start long, node long, q binary, bar float")
        met = ask.join(around, "node").select("start", "bar", "q", "around", "qs").mapInArrow(measure, LISTS).withColumn("b", _block(state, "node"))
        state = stable(state.withColumn("b", _block(state, "start")).groupBy("b").cogroup(met.groupBy("b")).applyInArrow(merge, schema))
        r = state.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.expr("position(X'00', open) > 0")).alias("open")).first()
        state = state.coalesce(max(1, -(-r["rows"] // QUERY_ROWS)))
        if not r["open"]:
            return state.select("start", "ids", "sims")


def cosine(a: Column, b: Column) -> Column:
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, p: s + p)

    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", degree: int = DEGREE, beam: int = BEAM, delta: float = DELTA, rounds: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row whose id is divisible by ``every``."""
    prepare(vectors.sparkSession)
    rows = _gathered(stable(valid_rows(vectors, id_col, vector_col)), NODE_ROWS)
    nodes = _gathered(stable(vector_nodes(rows, k + 1)), NODE_ROWS)
    points = _gathered(stable(rounded(nodes)), NODE_ROWS)
    graph = settled(_gathered(stable(first_graph(points, degree)), NODE_ROWS), points, degree, delta, rounds)
    asked = rows.where(F.col("id") % every == 0).select(F.col("id").alias("query_id"), "v").join(nodes.select("v", "node"), "v").select("query_id", "node")
    asked = _gathered(stable(asked), NODE_ROWS)
    starts = points.join(asked.select("node").distinct(), "node", "left_semi")
    around = search_table(graph, points, degree).repartition(shuffle_partitions(vectors), "node").persist(StorageLevel.DISK_ONLY)
    beams = greedy_search(starts, around, beam)

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, ids, _ = _triples(*(b.column(c).to_pylist() for c in ("start", "ids", "sims")))
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(ids)], names=["start", "node"])

    pairs = beams.mapInArrow(members, "start long, node long")
    a = nodes.select(F.col("node").alias("start"), F.col("v").alias("a"))
    scored = pairs.join(nodes, "node").join(a, "start").select("start", F.explode("members").alias("vec_id"), cosine(F.col("a"), F.col("v")).alias("score"))
    order = [F.desc("score"), F.asc("vec_id")]
    scored = scored.withColumn("r", F.row_number().over(Window.partitionBy("start").orderBy(*order))).where(F.col("r") <= k + 1)
    out = asked.join(scored, F.col("node") == F.col("start")).where("vec_id <> query_id")
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)).cast("int")).where(F.col("rank") <= k)
    out = stable(out.select("query_id", "rank", "vec_id", "score"))
    around.unpersist()
    return out
