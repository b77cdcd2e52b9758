"""Near-duplicate vectors: overlapping shards, a robust-pruned graph united over them, and range search along it.

1. Copies of a vector within a label are one node with a weight. Nodes go to their two nearest centroids
   (k-means per label, fitted on a bounded sample); these shards overlap. A shard beyond ``PART`` nodes is
   dealt to parts by a hash.
2. Each part builds a graph: the nearest of each node, pruned so that a kept neighbour hides those that are
   nearer to it than to the node; what is linked but not joined by edges in range is joined by its nearest
   pairs. The lists of all shards are united per node.
3. Range search. A node starts in its own shards, at their medoids, and there meets every node. Where it finds a
   link, the search expands along the united list of what it found: the shards of those neighbours that it has
   not met come next, until no new shard comes. Each linked node counts once, in the first shard of the
   searcher's way that holds it.
4. A block of nodes against a block gives a count for each searcher, the components of the block as stars, and
   the shards to go to, so its output grows with its nodes, however many links they have. Single precision
   decides all pairs but those within its error of the threshold; these are verified one by one in double
   precision on the original vectors.
5. Audit: the links of a sample of nodes are counted against all rows. Below ``RECALL`` all nodes of a label
   meet in parts instead; if the audit still fails, an error is raised.

Only equal, non-null labels are compared. One row leaves for each that comes. Rows with an unusable vector (null,
zero, non-finite or null components, another length than most), a null label or a null id link with nothing.
Rows that repeat an id are vectors of their own. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import graph, store
from plumbline.llm.vectors import binary_rows, blobs, matrix, usable

COSINE = 0.93
SHARD, PART, OVERLAP = 1024, 2048, 2
SAMPLE, MOST_CENTROIDS, AUDIT, RECALL = 40_000, 16_384, 256, 0.995
NEAR, DEGREE, ALPHA = 40, 14, 1.2
COPY_PARTS = 4096
FOUND = "kind int, a long, b long, n long, shards array<long>"
COUNT, STAR, CLOSE = 0, 1, 2


def slack(dim: int) -> float:
    """More than a cosine of single precision can be off."""
    return max(1e-5, 2e-7 * dim)


def _units(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = matrix(b.column("vec"))
        if len(x):
            x = x / np.abs(x).max(1, keepdims=True)
            x = (x / np.sqrt((x * x).sum(1, keepdims=True))).astype(np.float32)
        yield pa.RecordBatch.from_arrays([b.column("node"), b.column("label"), binary_rows(x), b.column("weight")], ["node", "label", "v", "weight"])


def centroids(labels: np.ndarray, x: np.ndarray, counts: dict[int, int], rounds: int = 6, seed: int = 1) -> dict[int, np.ndarray]:
    """Unit centroids of each label, about one for ``SHARD`` nodes."""
    rng = np.random.Generator(np.random.PCG64(seed))
    share = min(1.0, MOST_CENTROIDS / max(1, sum(-(-n // SHARD) for n in counts.values())))
    out = {}
    for label in np.unique(labels):
        own = x[labels == label]
        k = min(len(own), max(1, int(-(-counts[int(label)] // SHARD) * share)))
        c = own[rng.choice(len(own), k, replace=False)]
        for _ in range(rounds if k > 1 else 1):
            at = (own @ c.T).argmax(1)
            total = np.zeros((k, own.shape[1]), np.float64)
            np.add.at(total, at, own)
            size = np.sqrt((total * total).sum(1, keepdims=True))
            c = np.where(size > 0, total / np.maximum(size, 1e-30), c).astype(np.float32)
        out[int(label)] = c
    return out


def _assign(batches: Iterable[pa.RecordBatch], given: dict[int, np.ndarray], base: dict[int, int]) -> Iterator[pa.RecordBatch]:
    """(node, v, weight, shards): the nearest centroids of each node's label."""
    for b in batches:
        x = blobs(b.column("v"), np.float32)
        label = b.column("label").to_numpy()
        shards: list = [None] * len(label)
        for own in np.unique(label):
            rows = np.flatnonzero(label == own)
            c = given.get(int(own))
            if c is None:
                got = np.full((len(rows), 1), -1 - int(own) % (1 << 40))
            else:
                got = np.argsort(-(x[rows] @ c.T), 1, kind="stable")[:, :OVERLAP] + base[int(own)]
            for r, g in zip(rows, got.tolist()):
                shards[r] = g
        yield pa.RecordBatch.from_arrays([b.column("node"), b.column("v"), b.column("weight"), pa.array(shards, pa.list_(pa.int64()))], ["node", "v", "weight", "shards"])


def pruned(x: np.ndarray, near: int = NEAR, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """Neighbours (rows of ``x``, -1 for none) of each unit vector by robust pruning."""
    n = len(x)
    near = min(near, n - 1)
    if near < 1:
        return np.full((n, 1), -1)
    sim = x @ x.T
    sim[np.arange(n), np.arange(n)] = -np.inf
    cand = np.argpartition(-sim, near - 1, axis=1)[:, :near]
    close = np.take_along_axis(sim, cand, 1)
    order = np.argsort(-close, 1, kind="stable")
    cand, close = np.take_along_axis(cand, order, 1), np.take_along_axis(close, order, 1)
    sim[np.arange(n), np.arange(n)] = 1
    far = np.sqrt(np.maximum(0, 2 - 2 * close))
    alive = np.ones(cand.shape, bool)
    out = np.full((n, min(degree, near)), -1)
    rows = np.arange(n)
    for j in range(out.shape[1]):
        any_ = alive.any(1)
        first = alive.argmax(1)
        p = cand[rows, first]
        out[:, j] = np.where(any_, p, -1)
        alive[rows, first] = False
        between = np.sqrt(np.maximum(0, 2 - 2 * sim[p[:, None], cand]))
        alive &= alpha * between > far
    return out


def joined(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges to add to (a, b) so that one component is left: in rounds, the nearest pair of each with another."""
    n, more_a, more_b = len(x), [], []
    own = np.arange(n)
    while True:
        while True:
            low = own.copy()
            np.minimum.at(low, a, own[b])
            np.minimum.at(low, b, own[a])
            low = low[low]
            if (low == own).all():
                break
            own = low
        if not own.any():
            return np.concatenate([np.zeros(0, np.int64), *more_a]), np.concatenate([np.zeros(0, np.int64), *more_b])
        sim = x @ x.T
        sim[own[:, None] == own[None]] = -np.inf
        to = sim.argmax(1)
        order = np.lexsort((-sim[np.arange(n), to], own))
        first = order[np.concatenate([[True], own[order][1:] != own[order][:-1]])]
        more_a.append(first)
        more_b.append(to[first])
        a, b = np.concatenate([a, first]), np.concatenate([b, to[first]])


def _graph(table: pa.Table, reach: float) -> pa.Table:
    node = table["node"].to_numpy()
    order = np.argsort(node)
    node = node[order]
    x = blobs(table["v"].combine_chunks() if table["v"].num_chunks == 1 else pa.concat_arrays(table["v"].chunks), np.float32)[order]
    nb = pruned(x)
    a = np.repeat(np.arange(len(node)), nb.shape[1])
    b = nb.ravel()
    a, b = a[b >= 0], b[b >= 0]
    near = np.einsum("kd,kd->k", x[a], x[b]) >= reach
    more_a, more_b = joined(x, a[near], b[near])
    a, b = np.concatenate([a, more_a]), np.concatenate([b, more_b])
    # Both directions, so that search can come back.
    return pa.table({"a": np.concatenate([node[a], node[b]]), "b": np.concatenate([node[b], node[a]])})


def _whole(column: pa.ChunkedArray) -> pa.Array:
    return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def _padded(lists: list[list[int]]) -> np.ndarray:
    """Lists as rows of one width, short ones filled with a shard that there is not."""
    out = np.full((len(lists), max(map(len, lists), default=0) or 1), np.iinfo(np.int64).min)
    for row, x in zip(out, lists):
        row[: len(x)] = x
    return out


def first_met(way: np.ndarray, holds: np.ndarray, shard: int, q: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Which pairs (q, m) meet in ``shard`` first: no earlier shard of q's way holds m."""
    at = (way == shard).argmax(1)
    met = np.zeros(len(q), bool)
    for k in range(int(at.max(initial=0))):
        met |= (at[q] > k) & (holds[m] == way[q, k][:, None]).any(1)
    return ~met


def stars(q: np.ndarray, m: np.ndarray, n: int) -> np.ndarray:
    """The smallest row of each row's component under the edges (q, m)."""
    own = np.arange(n)
    while True:
        low = own.copy()
        np.minimum.at(low, q, own[m])
        np.minimum.at(low, m, own[q])
        low = low[low]
        if (low == own).all():
            return own
        own = low


def _met(members: pa.Table, searchers: pa.Table, reach: float) -> pa.Table:
    """What a part's searchers find among a part's members."""
    out: list[list] = [[], [], [], [], []]

    def add(kind: int, a, b, n, shards=None):
        for o, x in zip(out, (np.full(len(a), kind), a, b, n, shards if shards is not None else [None] * len(a))):
            o.extend(x if isinstance(x, list) else x.tolist())

    if members.num_rows and searchers.num_rows:
        node, x, weight = members["node"].to_numpy(), blobs(_whole(members["v"]), np.float32), members["weight"].to_numpy()
        holds, roads = _padded(members["shards"].to_pylist()), members["roads"].to_pylist()
        name, qx, way = searchers["q"].to_numpy(), blobs(_whole(searchers["qv"]), np.float32), searchers["way"].to_pylist()
        shard, off = int(members["shard"][0].as_py()), slack(x.shape[1])
        ways = _padded(way)
        of_road, roads = np.unique(_padded(roads), axis=0, return_inverse=True)
        roads = roads.reshape(-1)
        rows, at = np.unique(np.concatenate([node, name]), return_inverse=True)
        root = np.arange(len(rows))
        for k in range(0, len(name), 512):
            sim = qx[k : k + 512] @ x.T
            q, m = np.nonzero(sim >= reach - off)
            sure = sim[q, m] >= reach + off
            q = q + k
            use = (name[q] != node[m]) & first_met(ways, holds, shard, q, m)
            q, m, sure = q[use], m[use], sure[use]
            add(CLOSE, name[q[~sure]], node[m[~sure]], weight[m[~sure]])
            q, m = q[sure], m[sure]
            size = min(512, len(name) - k)
            n = np.bincount(q - k, weight[m], size).astype(np.int64)
            # Where the lists of what was found lead, less the way so far.
            pairs = np.unique(np.stack([q, roads[m]], 1), axis=0)
            to: list[list[int]] = [[] for _ in range(size)]
            for i, r in pairs.tolist():
                to[i - k] += of_road[r].tolist()
            none = np.iinfo(np.int64).min
            to = [sorted(set(t) - set(way[k + i]) - {none}) for i, t in enumerate(to)]
            some = [i for i in range(size) if n[i]]
            add(COUNT, name[k : k + size][some], name[k : k + size][some], n[some], [to[i] for i in some])
            low = stars(at[len(node) + q], at[m], len(rows))
            both = np.flatnonzero(low != np.arange(len(rows)))
            root = stars(np.concatenate([np.flatnonzero(root != np.arange(len(rows))), both]), np.concatenate([root[root != np.arange(len(rows))], low[both]]), len(rows))
        apart = np.flatnonzero(root != np.arange(len(rows)))
        add(STAR, rows[root[apart]], rows[apart], np.zeros(len(apart), np.int64))
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
    return pa.table({c: pa.array(o, t) for c, o, t in zip(("kind", "a", "b", "n", "shards"), out, kinds)})


def _parts(rows: DataFrame) -> DataFrame:
    """Rows (node, shard, ...) with the number of the shard's parts and their own part."""
    sizes = rows.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / PART).alias("parts"))
    return rows.join(sizes, "shard").withColumn("part", F.pmod(F.xxhash64("node", F.lit(9)), F.col("parts")))


def _meet(members: DataFrame, searchers: DataFrame, reach: float) -> DataFrame:
    """FOUND rows of ``searchers`` (q, qv, way, shard) in ``members`` (node, v, weight, shards, roads, shard)."""
    m = _parts(members)
    s = searchers.join(m.select("shard", F.col("parts").alias("_m")).distinct(), "shard")
    many = searchers.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / PART).alias("_parts"))
    s = s.join(many, "shard").withColumn("qi", F.pmod(F.xxhash64("q", F.lit(5)), F.col("_parts")))
    held = m.join(many, "shard").select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)).alias("i"), F.col("part").alias("j"), "node", "v", "weight", "shards", "roads")
    asked = s.select(F.col("shard").alias("qs"), "qi", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_m") - 1)).alias("qj"), "q", "qv", "way")
    return held.groupBy("shard", "i", "j").cogroup(asked.groupBy("qs", "qi", "qj")).applyInArrow(lambda a, b: _met(a, b, reach), FOUND)


def _cosine(a: str, b: str):
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def _checked(pairs: DataFrame, nodes: DataFrame, reach: float) -> DataFrame:
    """The pairs (a, b, n) whose cosine on the original vectors is ``reach`` or more."""
    v = nodes.select("node", "vec")
    rows = pairs.join(v.toDF("a", "va"), "a").join(v.toDF("b", "vb"), "b")
    return rows.filter(_cosine("va", "vb") >= reach).select("a", "b", "n")


def _gathered(found: DataFrame, nodes: DataFrame, reach: float) -> tuple[DataFrame, DataFrame]:
    """(counts (node, n), links (a, b) that keep all components) from FOUND rows."""
    close = store.write_table(_checked(found.filter(F.col("kind") == CLOSE).select("a", "b", "n"), nodes, reach), "close").df
    counts = found.filter(F.col("kind") == COUNT).select("a", "n").union(close.select("a", "n")).groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    return store.write_table(counts, "counts").df, found.filter(F.col("kind") == STAR).select("a", "b").union(close.select("a", "b"))


def links(nodes: DataFrame, reach: float = COSINE) -> tuple[DataFrame, DataFrame, float]:
    """(counts (node, n), links (a, b), audited recall) of nodes (node, label, vec, weight).

    ``n`` adds the weights of the other nodes linked with one. Links join what is connected; a node's star may
    stand for several links.
    """
    units = store.write_table(nodes.select("node", "label", "vec", "weight").mapInArrow(_units, "node long, label long, v binary, weight long"), "units", "none").df
    counts = {r["label"]: r["n"] for r in units.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label").limit(MOST_CENTROIDS).collect()}
    sample = units.orderBy(F.xxhash64("node"), "node").limit(SAMPLE).toPandas()
    sample = sample[sample["label"].isin(counts)]
    x = np.frombuffer(b"".join(sample["v"]), np.float32).reshape(len(sample), -1) if len(sample) else np.zeros((0, 1), np.float32)
    given = centroids(sample["label"].to_numpy(np.int64), x, counts)
    base, k = {}, 0
    for label, c in given.items():
        base[label], k = k, k + len(c)
    held = store.write_table(units.mapInArrow(lambda it: _assign(it, given, base), "node long, v binary, weight long, shards array<long>"), "shards", "none").df
    each = _parts(held.select("node", "v", F.explode("shards").alias("shard")))
    built = each.select("shard", "part", "node", "v").groupBy("shard", "part").applyInArrow(lambda t: _graph(t, reach), "a long, b long")
    united = store.write_table(built.groupBy("a").agg(F.collect_set("b").alias("nbrs")), "united").df
    # A node's list of neighbours, as the shards that it leads to.
    where = held.select(F.col("node").alias("b"), "shards")
    roads = united.select("a", F.explode("nbrs").alias("b")).join(where, "b").groupBy(F.col("a").alias("node")).agg(F.sort_array(F.array_distinct(F.flatten(F.collect_set("shards")))).alias("roads"))
    members = store.write_table(held.join(roads, "node", "left").select("node", "v", "weight", "shards", F.coalesce("roads", "shards").alias("roads")), "members", "none").df
    by_shard = members.withColumn("shard", F.explode("shards"))
    search = members.select(F.col("node").alias("q"), F.col("v").alias("qv"), F.col("shards").alias("way"), F.explode("shards").alias("shard"))
    every = None
    while True:
        found = store.write_table(_meet(by_shard, search, reach), "found").df
        every = found if every is None else every.unionByName(found)
        ways = search.groupBy("q").agg(F.first("way").alias("way"))
        to = found.filter((F.col("kind") == COUNT) & (F.size("shards") > 0)).groupBy(F.col("a").alias("q")).agg(F.array_distinct(F.flatten(F.collect_list("shards"))).alias("to"))
        on = to.join(ways, "q").select("q", F.sort_array(F.array_except("to", "way")).alias("to"), "way").filter(F.size("to") > 0)
        on = on.join(units.select(F.col("node").alias("q"), F.col("v").alias("qv")), "q")
        search = store.write_table(on.select("q", "qv", F.concat("way", "to").alias("way"), F.explode("to").alias("shard")), "search", "none").df
        if search.isEmpty():
            break
    counted, joined_by = _gathered(every, nodes, reach)
    recall = _recall(units, counted, reach)
    if recall < RECALL:
        whole = units.select("node", "v", "weight", F.array("label").alias("shards"), F.array("label").alias("roads"), F.col("label").alias("shard"))
        ask = units.select(F.col("node").alias("q"), F.col("v").alias("qv"), F.array("label").alias("way"), F.col("label").alias("shard"))
        counted, joined_by = _gathered(store.write_table(_meet(whole, ask, reach), "found").df, nodes, reach)
        recall = _recall(units, counted, reach)
        if recall < RECALL:
            raise RuntimeError(f"near-duplicate vectors: audited recall {recall:.4f} is below {RECALL}")
    return counted, joined_by, recall


def _audit(batches: Iterable[pa.RecordBatch], asked: np.ndarray, label: np.ndarray, x: np.ndarray, reach: float) -> Iterator[pa.RecordBatch]:
    """(q, n): the weight of what is surely linked with each asked node in a batch."""
    for b in batches:
        v = blobs(b.column("v"), np.float32)
        if not len(v):
            continue
        hit = (x @ v.T >= reach + slack(v.shape[1])) & (label[:, None] == b.column("label").to_numpy()[None]) & (asked[:, None] != b.column("node").to_numpy()[None])
        yield pa.RecordBatch.from_arrays([pa.array(asked), pa.array(hit @ b.column("weight").to_numpy())], ["q", "n"])


def _recall(units: DataFrame, counted: DataFrame, reach: float) -> float:
    """The share of a sample's links that are counted, over all links or over the mean node, whichever is less."""
    asked = units.orderBy(F.xxhash64("node", F.lit(3)), "node").limit(AUDIT).toPandas()
    if not len(asked):
        return 1.0
    q = np.frombuffer(b"".join(asked["v"]), np.float32).reshape(len(asked), -1)
    known, label = asked["node"].to_numpy(np.int64), asked["label"].to_numpy(np.int64)
    there = units.mapInArrow(lambda it: _audit(it, known, label, q, reach), "q long, n long").groupBy("q").agg(F.sum("n").alias("there")).filter("there > 0")
    got = there.join(counted.toDF("q", "n"), "q", "left").select("there", F.least("there", F.coalesce("n", F.lit(0))).alias("got"))
    sums = got.agg(F.sum("there").alias("there"), F.sum("got").alias("got"), F.avg(F.col("got") / F.col("there")).alias("mean")).first()
    return min(sums["got"] / sums["there"], sums["mean"]) if sums["there"] else 1.0


def near_duplicate_vectors(vectors: DataFrame, reach: float = COSINE, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row."""
    with store.scope():
        return _near_duplicate_vectors(vectors, reach, id_col, vec_col, label_col)


def _near_duplicate_vectors(vectors: DataFrame, reach: float, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    labelled = vectors.filter(F.col(label_col).isNotNull()).withColumn("label", F.xxhash64(F.col(label_col)))
    # Copies of one vector may be a third of all rows, so they are gathered, and told their node, in parts.
    rows = store.write_table(usable(labelled, id_col, vec_col, "label").withColumn("part", F.pmod(F.xxhash64("id"), F.lit(COPY_PARTS))), "vectors").df
    partial = store.write_table(rows.groupBy("label", "vec", "part").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("n")), "copies").df
    nodes = store.write_table(partial.groupBy("label", "vec").agg(F.min("low").alias("node"), F.sum("n").alias("weight")), "nodes").df
    counted, joined_by, _ = links(nodes, reach)
    # A node is its smallest id, so the smallest node of a component is the smallest id.
    roots = graph.components(joined_by)
    least = roots.groupBy("root").agg(F.min("node").alias("component_id"))
    of_node = nodes.join(counted, "node", "left").join(roots.join(least, "root").select("node", "component_id"), "node", "left")
    of_node = of_node.select("label", "vec", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component_id", "node").alias("component_id"))
    of_part = partial.select("label", "vec", "part").join(of_node, ["label", "vec"])
    found = store.write_table(rows.join(of_part, ["label", "vec", "part"]).select(F.col("id").alias("vec_id"), "n_links", "component_id"), "linked").df
    # The rest links with nothing: as many rows of an id as the table has beyond those found.
    all_ids = vectors.groupBy(F.col(id_col).cast("long").alias("vec_id")).agg(F.count(F.lit(1)).alias("all"))
    used = found.groupBy(F.col("vec_id").alias("_used")).agg(F.count(F.lit(1)).alias("n"))
    rest = all_ids.join(used, F.col("vec_id").eqNullSafe(F.col("_used")), "left").select("vec_id", (F.col("all") - F.coalesce("n", F.lit(0))).alias("left")).filter("left > 0")
    alone = rest.select("vec_id", F.explode(F.expr("array_repeat(0L, cast(left as int))")).alias("n_links"), F.col("vec_id").alias("component_id"))
    out = found.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
    return store.write_table(out, "neardup").keep().df
