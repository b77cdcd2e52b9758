"""Approximate nearest neighbours: an NN-descent graph by Spark joins, and greedy graph search.

Build. Copies of a vector are one node. The first lists come from buckets of random hyperplanes. Then, in
rounds, every node's neighbours and a sample of those that name it meet at the node (a join of edges with
vectors, dealt by the node); each pair of them is measured and the close ones go to the lists of both, which
keep the nearest. So neighbours of neighbours become neighbours. A node's list has ``degree`` entries and
the sample of names it gets is of that size too, so no node meets more than a fixed number.

Search. Each query starts at entry points (a bounded sample of nodes). Every round the nearest unexpanded
nodes of its beam are joined with the adjacency table, whose rows hold the neighbours' vectors, measured,
and merged into the beam, until no beam has an unexpanded node. The first round, which all queries share,
takes its rows of the adjacency table from a broadcast (``ENTRIES`` rows at most). The best of the beam are
measured again in double precision on the original vectors. Beams are written tables between rounds.

Audit. A sample of queries is first measured against all rows; the beam doubles until their recall reaches
``RECALL``, and with that beam all queries are searched. If the widest falls short, all queries are measured
against all rows in blocks.

Graph and search hold vectors less a median vector, each in half precision with a scale of its own, so that a
few large vectors leave the others their digits. Null, zero and non-finite vectors, vectors of another length
than most and null ids take no part. Rows that repeat an id are candidates each; a query's own id is none of
its neighbours. With fewer candidates than ``k`` all are returned. Ties go to the smaller id. An empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm import store
from plumbline.llm.textops import give_back
from plumbline.llm.vectors import binary_rows, blobs, by_groups, matrix, ragged, usable

DEGREE, ROUNDS, TREES, BUCKET = 16, 4, 4, 96
BEAM, WIDTH, ENTRIES, RERANK = 448, 112, 1024, 64
MEMBERS = 12
AUDIT, RECALL, WIDEST, BLOCK = 64, 0.95, 8, 2048
MEASURED = 512  # rows of the adjacency table that are measured at once
STATE = "q long, v binary, ids binary, dists binary, done binary"


def _nodes(vectors: DataFrame, members: int) -> DataFrame:
    """(node, vec, members): each distinct vector with its smallest ids; ``node`` is the smallest."""
    one = vectors.groupBy("vec", F.pmod(F.xxhash64("id"), F.lit(4096)).alias("part")).agg(F.slice(F.sort_array(F.collect_list("id")), 1, members).alias("ids"))
    return one.groupBy("vec").agg(F.slice(F.sort_array(F.flatten(F.collect_list("ids"))), 1, members).alias("members")).select(F.col("members")[0].alias("node"), "vec", "members")


def packed_rows(x: np.ndarray) -> pa.Array:
    """Rows as a float32 scale and float16 shares of it; scales stay where squares of them are finite."""
    scale = np.clip(np.abs(x).max(1, keepdims=True, initial=0), 1e-18, 1e18)
    share = np.clip(x / scale, -1, 1).astype(np.float16)
    return binary_rows(np.concatenate([scale.astype("<f4").view(np.uint8), share.view(np.uint8)], 1))


def unpacked_rows(raw: np.ndarray) -> np.ndarray:
    """The rows of ``packed_rows`` from a matrix of bytes."""
    if not raw.size:
        return np.zeros((len(raw), 0), np.float32)
    scale = np.ascontiguousarray(raw[:, :4]).view("<f4")
    return np.ascontiguousarray(raw[:, 4:]).view(np.float16).astype(np.float32) * scale


def _small(batches: Iterable[pa.RecordBatch], center: np.ndarray) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            yield pa.RecordBatch.from_arrays([b.column("node"), packed_rows(matrix(b.column("vec")) - center)], ["node", "v"])


def _planes(batches: Iterable[pa.RecordBatch], planes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(tree, bucket, node, v): the signs of random projections name a bucket in each tree."""
    for b in batches:
        x = unpacked_rows(blobs(b.column("v"), np.uint8))
        for tree, p in enumerate(planes):
            bits = (x @ p > 0) @ (1 << np.arange(p.shape[1], dtype=np.int64)) if p.shape[1] else np.zeros(len(x), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(bits * len(planes) + tree), b.column("node"), b.column("v")], ["bucket", "node", "v"])


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = (x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T
    return np.maximum(d, 0)


def _proposals(node: np.ndarray, x: np.ndarray, limit: np.ndarray, fresh: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the pairs among ``node``, at most ``most`` nearest for each that beat its limit, one of them fresh."""
    d = _distances(x, x)
    d[np.arange(len(d)), np.arange(len(d))] = np.inf
    d[~(fresh[:, None] | fresh[None])] = np.inf
    d[d >= limit[:, None]] = np.inf
    k = min(most, len(node) - 1)
    at = np.argpartition(d, k - 1, axis=1)[:, :k]
    dist = np.take_along_axis(d, at, 1)
    ok = np.isfinite(dist)
    rows = np.nonzero(ok)[0]
    return node[rows], node[at[ok]], dist[ok]


def _propose(table: pa.Table, key: str, most: int) -> Iterator[pa.RecordBatch]:
    table = table.combine_chunks()
    k = table[key].to_numpy()
    node = table["node"].to_numpy()
    x = unpacked_rows(blobs(table["v"].chunk(0) if table.num_rows else pa.array([], pa.binary()), np.uint8))
    limit = table["limit"].to_numpy() if "limit" in table.column_names else np.full(len(k), np.inf, np.float32)
    fresh = table["fresh"].to_numpy(zero_copy_only=False) if "fresh" in table.column_names else np.ones(len(k), bool)
    cut = np.append(np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])), len(k))
    out: list[tuple] = []
    size = 0

    def batch():
        u, w, d = (np.concatenate(z) for z in zip(*out))
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(w), pa.array(d.astype(np.float32))], ["u", "w", "d"])

    for a, b in zip(cut[:-1], cut[1:]):
        own, first = np.unique(node[a:b], return_index=True)
        if len(own) < 2:
            continue
        at = a + first
        new = np.zeros(len(own), bool)
        np.logical_or.at(new, np.searchsorted(own, node[a:b]), fresh[a:b])
        got = _proposals(own, x[at], limit[at], new, most)
        if len(got[0]):
            out.append(got)
            size += len(got[0])
        if size > 200_000:
            yield batch()
            out, size = [], 0
    if out:
        yield batch()


def _merge(table: pa.Table, degree: int) -> Iterator[pa.RecordBatch]:
    """Each node's nearest of all (u, w, d, old): (node, ids, dists, fresh)."""
    u, w, d, old = (table[c].to_numpy(zero_copy_only=False) for c in ("u", "w", "d", "old"))
    order = np.lexsort((~old, w, u))
    u, w, d, old = u[order], w[order], d[order], old[order]
    keep = np.concatenate([[True], (u[1:] != u[:-1]) | (w[1:] != w[:-1])])
    u, w, d, old = u[keep], w[keep], d[keep], old[keep]
    order = np.lexsort((w, d, u))
    u, w, d, old = u[order], w[order], d[order], old[order]
    first = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]]))
    rank = np.arange(len(u)) - np.repeat(first, np.diff(np.append(first, len(u))))
    keep = rank < degree
    u, w, d, old = u[keep], w[keep], d[keep], old[keep]
    cut = np.append(np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]])), len(u))
    make = lambda v, t: pa.Array.from_buffers(pa.binary(), len(cut) - 1, [None, pa.py_buffer((cut * np.dtype(t).itemsize).astype(np.int32)), pa.py_buffer(v.astype(t).tobytes())])
    yield pa.RecordBatch.from_arrays([pa.array(u[cut[:-1]]), make(w, np.int64), make(d, np.float32), make(~old, np.uint8)], ["node", "ids", "dists", "fresh"])


def _edges(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, w, d, fresh) from lists."""
    for b in batches:
        w, cut = ragged(b.column("ids"), np.int64)
        d, _ = ragged(b.column("dists"), np.float32)
        f, _ = ragged(b.column("fresh"), np.uint8)
        n = np.diff(cut)
        u = np.repeat(b.column("node").to_numpy(), n)
        limit = np.repeat(d[np.maximum(cut[1:] - 1, 0)] if len(d) else np.zeros(len(n), np.float32), n)
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(w), pa.array(d), pa.array(f.astype(bool)), pa.array(limit)], ["u", "w", "d", "fresh", "limit"])


LISTS = "node long, ids binary, dists binary, fresh binary"
EDGES = "u long, w long, d float, fresh boolean, limit float"
PROPOSED = "u long, w long, d float"


def _named(edges: DataFrame, most: int) -> DataFrame:
    """Of the edges into each node a hashed sample of about ``most``: (center, node)."""
    many = edges.groupBy(F.col("w").alias("center")).count()
    share = F.pmod(F.xxhash64("u", "w"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return edges.join(many, edges["w"] == many["center"]).filter(share * F.col("count") < most).select("center", F.col("u").alias("node"), "fresh")


def build(nodes: DataFrame, small: DataFrame, count: int, dim: int, degree: int, rounds: int, seed: int = 3) -> DataFrame:
    """Lists of each node's near neighbours: (node, ids, dists, fresh)."""
    rng = np.random.Generator(np.random.PCG64(seed))
    bits = int(max(0, np.ceil(np.log2(max(1, count / (BUCKET / 2))))))
    planes = rng.normal(size=(TREES, dim, min(bits, 40))).astype(np.float32)
    held = small.mapInArrow(lambda it: _planes(it, planes), "bucket long, node long, v binary")
    # A bucket beyond the size is dealt to parts by a hash.
    many = held.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / BUCKET).alias("parts"))
    held = held.join(many, "bucket").select(F.xxhash64("bucket", F.pmod(F.xxhash64("node", "bucket"), F.col("parts"))).alias("bucket"), "node", "v")
    found = held.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lambda it: by_groups(it, "bucket", lambda t: _propose(t, "bucket", degree // 2)), PROPOSED)

    def merged(rows: DataFrame, name: str):
        return store.write_table(rows.repartition("u").sortWithinPartitions("u").mapInArrow(lambda it: by_groups(it, "u", lambda t: _merge(t, degree)), LISTS), name, "none")

    table = merged(found.withColumn("old", F.lit(False)), "lists0")
    for r in range(rounds):
        edges = table.df.mapInArrow(_edges, EDGES)
        limits = table.df.mapInArrow(_limits, "node long, limit float")
        meet = edges.select(F.col("u").alias("center"), F.col("w").alias("node"), "fresh").unionByName(_named(edges, degree))
        meet = meet.groupBy("center", "node").agg(F.max("fresh").alias("fresh"))
        rows = meet.join(small, "node").join(limits, "node", "left").select("center", "node", "v", "fresh", F.coalesce("limit", F.lit(float("inf")).cast("float")).alias("limit"))
        better = rows.repartition("center").sortWithinPartitions("center").mapInArrow(lambda it: by_groups(it, "center", lambda t: _propose(t, "center", 5)), PROPOSED)
        both = edges.select("u", "w", "d", F.lit(True).alias("old")).unionByName(better.withColumn("old", F.lit(False)))
        old, table = table, merged(both, f"lists{r + 1}")
        old.drop()
    return table.df


def _limits(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The largest distance in each full list."""
    for b in batches:
        d, cut = ragged(b.column("dists"), np.float32)
        n = np.diff(cut)
        full = n >= n.max(initial=0)
        yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(np.where(full, d[np.maximum(cut[1:] - 1, 0)], np.inf).astype(np.float32))], ["node", "limit"])


def _pack(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """Adjacency rows: (node, ids, vs) from (center, node, v)."""
    c, node = table["center"].to_numpy(), table["node"].to_numpy()
    v = blobs(table["v"].combine_chunks(), np.uint8) if table["v"].num_chunks == 1 else blobs(pa.concat_arrays(table["v"].chunks), np.uint8)
    cut = np.append(np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]])), len(c))
    make = lambda x, size: pa.Array.from_buffers(pa.binary(), len(cut) - 1, [None, pa.py_buffer((cut * size).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x).tobytes())])
    yield pa.RecordBatch.from_arrays([pa.array(c[cut[:-1]]), make(node, 8), make(v, v.shape[1])], ["node", "ids", "vs"])


def _start(batches: Iterable[pa.RecordBatch], entry: tuple[np.ndarray, np.ndarray], beam: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        q = unpacked_rows(blobs(b.column("v"), np.uint8))
        if not len(q):
            continue
        d = _distances(q, entry[1])
        d[b.column("node").to_numpy()[:, None] == entry[0][None]] = 0
        order = np.argsort(d, 1, kind="stable")[:, :beam]
        yield pa.RecordBatch.from_arrays([b.column("node"), b.column("v"), binary_rows(entry[0][order]), binary_rows(np.take_along_axis(d, order, 1).astype(np.float32)), binary_rows(np.zeros(order.shape, np.uint8))], ["q", "v", "ids", "dists", "done"])


def _frontier(batches: Iterable[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, cut = ragged(b.column("ids"), np.int64)
        done, _ = ragged(b.column("done"), np.uint8)
        rows, nodes = [], []
        for i in range(b.num_rows):
            open_ = ids[cut[i] : cut[i + 1]][done[cut[i] : cut[i + 1]] == 0][:width]
            nodes.append(open_)
            rows.append(np.full(len(open_), i))
        at = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(nodes) if nodes else np.zeros(0, np.int64)), b.column("q").take(pa.array(at)), b.column("v").take(pa.array(at))], ["node", "q", "v"])


def _measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for first in range(0, whole.num_rows, MEASURED):
            b = whole.slice(first, MEASURED)
            q = unpacked_rows(blobs(b.column("v"), np.uint8))
            ids, cut = ragged(b.column("ids"), np.int64)
            v, _ = ragged(b.column("vs"), np.uint8)
            x = unpacked_rows(v.reshape(len(ids), -1))
            x -= q[np.repeat(np.arange(len(q)), np.diff(cut))]
            d = np.einsum("ij,ij->i", x, x)
            make = lambda y, size: pa.Array.from_buffers(pa.binary(), len(q), [None, pa.py_buffer((cut * size).astype(np.int32)), pa.py_buffer(y.tobytes())])  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([b.column("q"), make(ids, 8), make(d, 4)], ["q", "ids", "dists"])
        give_back()


def _advance(batches: Iterable[pa.RecordBatch], beam: int, width: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, cut = ragged(b.column("ids"), np.int64)
        d, _ = ragged(b.column("dists"), np.float32)
        done, _ = ragged(b.column("done"), np.uint8)
        out: tuple[list, list, list] = ([], [], [])
        for i in range(b.num_rows):
            own, od, oz = ids[cut[i] : cut[i + 1]], d[cut[i] : cut[i + 1]], done[cut[i] : cut[i + 1]].copy()
            oz[np.flatnonzero(oz == 0)[:width]] = 1
            for g in b.column("found")[i].as_py() or ():
                own = np.concatenate([own, np.frombuffer(g["ids"], np.int64)])
                od = np.concatenate([od, np.frombuffer(g["dists"], np.float32)])
            oz = np.concatenate([oz, np.zeros(len(own) - len(oz), np.uint8)])
            order = np.lexsort((1 - oz, own))
            own, od, oz = own[order], od[order], oz[order]
            first = np.concatenate([[True], own[1:] != own[:-1]])
            own, od, oz = own[first], od[first], oz[first]
            best = np.lexsort((own, od))[:beam]
            for o, x in zip(out, (own, od, oz)):
                o.append(x[best].tobytes())
        give_back()
        yield pa.RecordBatch.from_arrays([b.column("q"), b.column("v"), *(pa.array(x, pa.binary()) for x in out), pa.array([0 in x for x in out[2]])], ["q", "v", "ids", "dists", "done", "open"])


def _best(batches: Iterable[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, cut = ragged(b.column("ids"), np.int64)
        take = [ids[x : min(y, x + most)] for x, y in zip(cut[:-1], cut[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column("q").to_numpy(), [len(x) for x in take])), pa.array(np.concatenate(take) if take else np.zeros(0, np.int64))], ["q", "node"])


def _exact(batches: Iterable[pa.RecordBatch], asked: np.ndarray, x: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """(q, node, d): the ``k`` nearest of each batch's nodes to each asked node, which is none itself."""
    for b in batches:
        if not b.num_rows:
            continue
        node, y = b.column("node").to_numpy(), matrix(b.column("vec"))
        for a in range(0, len(asked), 64):
            d = np.stack([np.sqrt(((y - q) ** 2).sum(1)) for q in x[a : a + 64]])
            d[asked[a : a + 64, None] == node[None]] = np.inf
            at = np.argpartition(d, min(k, len(node)) - 1, axis=1)[:, :k]
            q = np.repeat(asked[a : a + 64], at.shape[1])
            dist = np.take_along_axis(d, at, 1).ravel()
            ok = dist < np.inf
            yield pa.RecordBatch.from_arrays([pa.array(q[ok]), pa.array(node[at.ravel()[ok]]), pa.array(dist[ok])], ["q", "node", "d"])


def _all_rows(nodes: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(q, node): the ``k`` nearest nodes of each asked node, which is a nearest node too, by measuring all rows."""
    found = asked.toPandas()
    if not len(found):
        return nodes.select(F.col("node").alias("q"), "node").limit(0)
    name, x = found["node"].to_numpy(np.int64), np.stack([np.asarray(v, np.float64) for v in found["vec"]])
    rows = nodes.select("node", "vec").mapInArrow(lambda it: _exact(it, name, x, k), "q long, node long, d double")
    best = rows.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("d", "node"))).filter(F.col("r") <= k)
    own = nodes.sparkSession.createDataFrame([(int(n), int(n)) for n in name], "q long, node long")
    return best.select("q", "node").unionByName(own)


class Searcher:
    """The graph of a table's nodes, with what all searches share."""

    def __init__(self, nodes: DataFrame, small: DataFrame, lists: DataFrame, count: int, degree: int):
        spark = nodes.sparkSession
        self.small = small
        edges = lists.mapInArrow(_edges, EDGES)
        near = edges.select(F.col("u").alias("center"), F.col("w").alias("node")).unionByName(_named(edges, 2 * degree).select("center", "node")).distinct().join(small, "node")
        parts = int(min(4000, max(12, count // 4000)))
        packed = near.select("center", "node", "v").repartition(parts, "center").sortWithinPartitions("center").mapInArrow(lambda it: by_groups(it, "center", _pack), "node long, ids binary, vs binary")
        self.adjacency = store.write_bucketed(packed, "adjacency", "node", parts).df
        sample = small.orderBy(F.xxhash64("node"), "node").limit(ENTRIES).toPandas()
        self.entry = (sample["node"].to_numpy(np.int64), unpacked_rows(np.frombuffer(b"".join(sample["v"]), np.uint8).reshape(len(sample), -1)))
        names = spark.createDataFrame([(int(n),) for n in self.entry[0]], "node long")
        self.first = store.write_table(self.adjacency.join(F.broadcast(names), "node", "left_semi"), "entries", "none").df

    def search(self, asked: DataFrame, beam: int, width: int) -> DataFrame:
        """(q, ids, ...): the beams of the asked nodes."""
        entry = self.entry
        begun = asked.select("node").distinct().join(self.small, "node").mapInArrow(lambda it: _start(it, entry, beam), STATE)
        state, turn = store.write_table(begun.withColumn("open", F.lit(True)), "beam", "none"), 0
        while not state.df.filter("open").isEmpty():
            front = state.df.filter("open").mapInArrow(lambda it: _frontier(it, width), "node long, q long, v binary")
            rows = front.join(F.broadcast(self.first), "node") if turn == 0 else front.hint("shuffle_hash").join(self.adjacency, "node")
            found = rows.select("q", "v", "ids", "vs").mapInArrow(_measure, "q long, ids binary, dists binary")
            found = found.groupBy("q").agg(F.collect_list(F.struct("ids", "dists")).alias("found"))
            moved = state.df.join(found, "q", "left").select("q", "v", "ids", "dists", "done", "found").mapInArrow(lambda it: _advance(it, beam, width), f"{STATE}, open boolean")
            old, state, turn = state, store.write_table(moved, "beam", "none"), turn + 1
            old.drop()
        return state.df


def _recall(best: DataFrame, exact: DataFrame, nodes: DataFrame, k: int) -> float:
    """The share of the ``k`` nearest nodes that are found, by distance, so that ties count alike."""
    far = _scored(exact, nodes).filter("q <> node").groupBy("q").agg(F.max("score").alias("far"), F.count(F.lit(1)).alias("n"))
    got = _scored(best, nodes).filter("q <> node").join(far, "q").groupBy("q", "n").agg(F.least("n", F.count_if(F.col("score") <= F.col("far"))).alias("got"))
    sums = far.join(got.select("q", "got"), "q", "left").agg(F.sum("n").alias("n"), F.sum("got").alias("got")).first()
    return (sums["got"] or 0) / sums["n"] if sums["n"] else 1.0


def _scored(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(q, node, members, score) of pairs (q, node): distances of the original vectors."""
    rows = pairs.join(nodes.select("node", "vec", "members"), "node").join(nodes.select(F.col("node").alias("q"), F.col("vec").alias("qvec")), "q")
    return rows.select("q", "node", "members", F.sqrt(F.aggregate(F.zip_with("vec", "qvec", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x)).alias("score"))


def nearest(vectors: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vec_col: str = "embedding", degree: int = DEGREE, rounds: int = ROUNDS, beam: int = BEAM, width: int = WIDTH, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each row whose id is divisible by ``every``; score is the Euclidean distance."""
    with store.scope():
        return _nearest(vectors, k, every, id_col, vec_col, degree, rounds, beam, width, recall)


def _nearest(vectors: DataFrame, k: int, every: int, id_col: str, vec_col: str, degree: int, rounds: int, beam: int, width: int, recall: float) -> DataFrame:
    rows = usable(vectors, id_col, vec_col)
    nodes = store.write_table(_nodes(rows, max(MEMBERS, k + 1)), "nodes").df
    count = nodes.count()
    if not count:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = nodes.orderBy(F.xxhash64("node"), "node").limit(ENTRIES).select("vec").toPandas()["vec"]
    center = np.median(np.stack([np.asarray(v, np.float64) for v in sample]), 0) if len(sample) else np.zeros(0)
    # Copies may be a third of all rows: a query finds its node by the node's smallest ids, or, if it is not
    # among these, by its vector.
    ids = rows.filter(F.col("id") % every == 0).select(F.col("id").alias("query_id"), "vec").distinct()
    named = nodes.select("node", F.explode("members").alias("query_id")).filter(F.col("query_id") % every == 0).distinct()
    direct = ids.join(named, "query_id").join(nodes.select("node", F.col("vec").alias("_v")), "node").filter(F.col("vec") == F.col("_v")).select("query_id", "node")
    others = ids.join(direct, "query_id", "left_anti").join(nodes.select("vec", "node"), "vec").select("query_id", "node")
    asked = store.write_table(direct.unionByName(others), "asked").df
    targets = store.write_table(asked.select("node").distinct().join(nodes.select("node", "vec"), "node"), "targets").df
    audited = targets.orderBy(F.xxhash64("node", F.lit(11)), "node").limit(AUDIT)
    small = store.write_table(nodes.select("node", "vec").mapInArrow(lambda it: _small(it, center), "node long, v binary"), "small", "none").df
    lists = build(nodes, small, count, len(center), degree, rounds)
    graph = Searcher(nodes, small, lists, count, degree)
    most = max(RERANK, 2 * k)
    exact = store.write_table(_all_rows(nodes, audited, k), "exact").df
    wide = 1
    while True:
        size, step = beam * wide, width * wide
        tried = store.write_table(graph.search(audited, size, step).select("q", "ids").mapInArrow(lambda it: _best(it, most), "q long, node long"), "tried").df
        reached = _recall(tried, exact, nodes, k) >= recall
        if reached or wide >= WIDEST:
            break
        wide *= 2
    if reached:
        best = graph.search(targets.select("node"), size, step).select("q", "ids").mapInArrow(lambda it: _best(it, most), "q long, node long")
    else:
        # The graph falls short: the stated queries against all rows, in blocks.
        blocks = -(-targets.count() // BLOCK)
        best = None
        for i in range(blocks):
            part = store.write_table(_all_rows(nodes, targets.filter(F.pmod(F.xxhash64("node"), F.lit(blocks)) == i), k), "block").df
            best = part if best is None else best.unionByName(part)
    pairs = asked.join(_scored(best, nodes), asked["node"] == F.col("q")).select("query_id", F.explode("members").alias("vec_id"), "score").filter("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    out = pairs.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    return store.write_table(out, "nearest").keep().df
