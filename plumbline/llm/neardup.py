"""Near-duplicates by bottom-k sketches from one hash function, inverted lists and exact Jaccard.

A text's set: hashes of its distinct shingles of five words (A-Z lower-cased); with one to four words
the whole sequence is the one shingle. Texts with ``100 * intersection >= percent * union`` are linked.

Sketch: the k smallest hashes of the set with k = n - ceil(percent * n / 100) + 1. Two linked sets share
at least one retained value, so the inverted lists of retained values lose no link. Values that very many
sets retain (a license line, say) are found first and stand last in the order, alike for all sets; this
keeps lists short and the guarantee whole. Sets of the same hash are one node, so copies cost nothing.

1. Inverted lists live in hash buckets, packed per chunk. In each list the first node is the hub; every
   other node is verified against the hub it shares most lists with.
2. Links give components. Lists that still hold several components yield all pairs across them, with the
   number of shared retained values and the ranks of the last one. From these the union sketch gives the
   most that the sets can share; pairs that can't reach the threshold fall out, none that can.
3. Exact Jaccard on full sets verifies every link.

Lists of the common values may hold a third of all sets, so they are never one task's: frequent values are found
in parts of the chunks, their lists are plain rows, their hubs come from an aggregate with map-side combine,
and their pairs from joins whose hot keys Spark splits. A list in a bucket is short. Sets that share much without
linking would still meet in as many pairs as the square of their number. So a list's largest component meets only
the rest of the list, and a pair comes out only if its marks allow a link: 1,024 parity bits of a set's hot values.
A value that one set has and the other has not changes one bit, so marks never differ in more bits than values do.

Null and empty texts have n_shingles 0 and are linked with nothing, and so are rows with a null id (their
component is null, and they are kept). Rows that repeat an id each get a result. Columns named as the
outputs are replaced. A node is 64 bits of its set; where two different sets (by a second hash of 64 bits) have
one node, all is done again with other hashes, so nodes are as good as sets compared whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import graph, packed, store
from plumbline.llm.textops import LOWER, give_back, mix, span_hashes, text_blocks, window_hashes, word_spans

WIDTH = 5
PERCENT = 85
HOT, HOT_PARTS = 64, 8
MARK_BITS = 1024
CHUNK_BYTES = 6 << 20
LIST_BYTES = 8 << 20  # text whose retained values one bucket holds
CELLS = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("part", pa.int32()), ("checks", pa.list_(pa.int64())), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("hots", pa.list_(pa.int64())), ("nodes", pa.list_(pa.int64())), ("values", pa.binary()), ("which", pa.binary()), ("ranks", pa.binary()), ("marks", pa.binary())])
CELLS_DDL = "chunk long, bucket int, part int, checks array<long>, ids array<long>, sizes array<long>, hots array<long>, nodes array<long>, values binary, which binary, ranks binary, marks binary"


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all texts, where each text begins with the total last)."""
    data = LOWER[data]
    starts, ends, first = word_spans(data, offsets)
    words = span_hashes(data, starts, ends)
    counts = np.diff(first)
    n = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    edges = np.concatenate([[0], np.cumsum(n)])
    rolling = window_hashes(words, width)
    out = np.empty(edges[-1], np.uint64)
    long = np.repeat(counts >= width, n)
    out[long] = rolling[(np.repeat(first[:-1] - edges[:-1], n) + np.arange(len(out)))[long]]
    for c in range(1, width):
        some = np.flatnonzero(counts == c)
        if len(some):
            out[edges[some]] = window_hashes(words, c)[first[some]]
    fresh = np.ones(len(out), bool)
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        if b - a > 1:
            part = out[a:b]
            part.sort()
            fresh[a + 1 : b] = part[1:] != part[:-1]
    return out[fresh], np.concatenate([[0], np.cumsum(fresh)])[edges]


def set_nodes(values: np.ndarray, edges: np.ndarray, seed: int = 0) -> np.ndarray:
    """One hash for each set; an empty set has 0."""
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(values, 0x5EED + seed), dtype=np.uint64)])
    n = np.diff(edges)
    return np.where(n > 0, mix(run[edges[1:]] - run[edges[:-1]], 77) ^ n.astype(np.uint64), np.uint64(0))


def sketches(values: np.ndarray, edges: np.ndarray, percent: int, hot: np.ndarray | None, whole: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(retained values, their text, their rank from 1, hot values of each text) with hot values last in the order.

    ``whole`` retains instead all values of the texts whose sketch in plain order has a hot value.
    """
    n = np.diff(edges)
    k = n - (percent * n + 99) // 100 + 1
    text = np.repeat(np.arange(len(n)), n)
    rank = np.arange(len(values)) - np.repeat(edges[:-1], n)
    hots = np.zeros(len(n), np.int64)
    if hot is not None:
        late = graph.in_bitmap(values, hot)
        if whole:
            keep = np.repeat(np.bincount(text[late & (rank < np.repeat(k, n))], minlength=len(n)) > 0, n)
            return values[keep], text[keep], rank[keep] + 1, hots
        seen = np.concatenate([[0], np.cumsum(late)])
        late_before = seen[:-1] - np.repeat(seen[edges[:-1]], n)
        hots = seen[edges[1:]] - seen[edges[:-1]]
        early = np.repeat(n - hots, n)
        rank = np.where(late, early + late_before, rank - late_before)
    keep = rank < np.repeat(k, n)
    return values[keep], text[keep], rank[keep] + 1, hots


def hot_marks(values: np.ndarray, edges: np.ndarray, use: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """For each text of ``use``, the parity bits of its hot values as a row of bytes."""
    out = np.zeros((len(use), MARK_BITS // 8), np.uint8)
    for k in range(0, len(use), 1024):
        some = use[k : k + 1024]
        n = edges[some + 1] - edges[some]
        own = np.repeat(np.arange(len(some)), n)
        value = values[np.repeat(edges[some] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        late = graph.in_bitmap(value, hot)
        bit = (mix(value[late]) % np.uint64(MARK_BITS)).astype(np.int64)
        odd = np.bincount(own[late] * MARK_BITS + bit, minlength=len(some) * MARK_BITS) & 1
        out[k : k + 1024] = np.packbits(odd.astype(np.uint8).reshape(-1, MARK_BITS), axis=1)
    return out


def _cells(batches: Iterable[pa.RecordBatch], bits: int, percent: int, hot: np.ndarray | None, width: int, whole: bool = False, seed: int = 0) -> Iterator[pa.RecordBatch]:
    """A row for each chunk with its rows' sets, one with its marks, and rows for each bucket with postings: lists of hot values apart, unless all are sought."""
    ids = store.chunk_counter()
    for rows, data, offsets in text_blocks(batches, max_bytes=CHUNK_BYTES):
        chunk = next(ids)
        values, edges = shingle_sets(data, offsets, width)
        nodes, sizes = set_nodes(values, edges, seed), np.diff(edges)
        checks = nodes if whole else set_nodes(values, edges, seed + 0xC0DE)
        out = {x: [] for x in CELLS.names}

        def row(**x):
            for k in CELLS.names:
                out[k].append(x.get(k))

        row(chunk=chunk, bucket=-1, part=0, ids=rows.column(0).to_pylist(), sizes=sizes, nodes=nodes.view(np.int64), checks=checks.view(np.int64))
        valid = np.asarray(rows.column(0).is_valid()) & (sizes > 0)
        value, text, rank, hots = sketches(values, edges, percent, hot, whole)
        once = np.zeros(len(nodes), bool)
        once[np.flatnonzero(valid)[np.unique(nodes[valid], return_index=True)[1]]] = True
        use = once[text]
        value, text, rank = value[use], text[use], rank[use]
        if hot is not None and not whole:
            # Sets that retain a hot value, so those that can link by hot values alone.
            able = np.flatnonzero(once & (hots > 0) & (100 * hots >= percent * sizes))
            if len(able):
                row(chunk=chunk, bucket=-2, part=0, nodes=nodes[able].view(np.int64), marks=hot_marks(values, edges, able, hot).tobytes())
        order = np.argsort(value, kind="stable")
        value, text, rank = value[order], text[order], rank[order]
        late = np.zeros(len(value), bool) if hot is None or whole else graph.in_bitmap(value, hot)
        apart = (chunk * 0x9E3779B1 >> 7) % HOT_PARTS
        for kind, use in ((0 if hot is not None and not whole else apart, ~late), (-1, late)):
            v, t, r = value[use], text[use], rank[use]
            cut = packed.cuts(v, bits)
            for b in np.flatnonzero(np.diff(cut)):
                i, j = cut[b], cut[b + 1]
                own, which = np.unique(t[i:j], return_inverse=True)
                row(chunk=chunk, bucket=int(b), part=kind, nodes=nodes[own].view(np.int64), sizes=sizes[own], hots=hots[own], values=packed.pack(v[i:j]), which=packed.planes(which), ranks=packed.planes(r[i:j]))
        yield pa.RecordBatch.from_pydict(out, CELLS)


def _lists(table: pa.Table) -> tuple[np.ndarray, ...]:
    """Postings of a bucket in list order, each node once per list: (value, node, set size, hot values, rank).

    In a list the nodes with the fewest values that aren't hot come first: they can link with most others.
    """
    parts = []
    for v, w, r, nodes, sizes, hots in zip(*(table[c].to_pylist() for c in ("values", "which", "ranks", "nodes", "sizes", "hots"))):
        w = packed.unplanes(w)
        parts.append((packed.unpack(v), np.array(nodes, np.int64)[w], np.array(sizes, np.int64)[w], np.array(hots, np.int64)[w], packed.unplanes(r).astype(np.int64)))
    value, node, size, hot, rank = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((node, size - hot, value))
    value, node, size, hot, rank = value[order], node[order], size[order], hot[order], rank[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (node[1:] != node[:-1])
    return value[fresh], node[fresh], size[fresh], hot[fresh], rank[fresh]


def _bounds(value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of each list."""
    start = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]])) if len(value) else np.zeros(0, np.int64)
    return start, np.diff(np.append(start, len(value)))


def _hot_values(table: pa.Table) -> pa.Table:
    """(value, n) of what a part of the chunks has more often than its share of a hot list."""
    give_back()
    value, *_ = _lists(table)
    start, length = _bounds(value)
    use = length > HOT // HOT_PARTS
    return pa.table({"value": value[start[use]].view(np.int64), "n": length[use]})


def _flat(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of hot values as rows (value, node, size, hot, rank)."""
    for batch in batches:
        for i in range(batch.num_rows):
            value, node, size, hot, rank = _lists(pa.Table.from_batches([batch.slice(i, 1)]))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (value.view(np.int64), node, size, hot, rank)], ["value", "node", "size", "hot", "rank"])


def _marks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, marks) of the sets in each chunk's row."""
    for batch in batches:
        for nodes, marks in zip(batch.column("nodes").to_pylist(), batch.column("marks").to_pylist()):
            words = np.frombuffer(marks, np.int64)
            each = pa.ListArray.from_arrays(pa.array(np.arange(0, len(words) + 1, MARK_BITS // 64), pa.int32()), pa.array(words))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), each], ["node", "marks"])


def _alike(x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """Sizes that can reach the threshold."""
    return 100 * np.minimum(x, y) >= percent * np.maximum(x, y)


def _hubs(table: pa.Table, percent: int) -> pa.Table:
    """Pairs of each list's first node with the others, and the number of lists."""
    give_back()
    value, node, size, _, _ = _lists(table)
    start, length = _bounds(value)
    hub = np.repeat(start, length)
    use = (np.arange(len(value)) != hub) & _alike(size, size[hub], percent)
    a, b = node[hub[use]], node[use]
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, np.int64)
    return pa.table({"bucket": pa.array(np.full(len(first), table["bucket"][0].as_py(), np.int32)), "a": a[first], "b": b[first], "shared": np.diff(np.append(first, len(a))).astype(np.int64)})


def _across(table: pa.Table, roots: pa.Table, percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs across components in each list: shared values and ranks of the last one.

    A pair whose first shared value is hot shares hot values only, so it must have enough of them; a pair
    that shares an earlier value comes from that value's list. So a hot list yields few pairs, however long.
    """
    value, node, size, hot, rank = _lists(table)
    known, root = roots["node"].to_numpy(), roots["root"].to_numpy()
    order = np.argsort(known)
    known, root = known[order], root[order]
    at = np.minimum(np.searchsorted(known, node), max(0, len(known) - 1))
    own = np.where(known[at] == node, root[at], node) if len(known) else node
    start, length = _bounds(value)
    differ = np.concatenate([[0], np.cumsum(np.concatenate([own[1:] != own[:-1], [False]]))]) if len(own) else np.zeros(1, np.int64)
    mixed = (length > 1) & (differ[np.maximum(start + length - 1, 0)] > differ[start])
    start, length = start[mixed], length[mixed]
    late = rank > size - hot
    for m in np.unique(length):
        lists = start[length == m]
        if m <= 128:
            i, j = np.triu_indices(m, 1)
            step = max(1, 200_000 // len(i))
            parts = (((lists[k : k + step, None] + i).ravel(), (lists[k : k + step, None] + j).ravel()) for k in range(0, len(lists), step))
        else:
            parts = ((np.full(m - k - 1, s + k), np.arange(s + k + 1, s + m)) for s in lists for k in range(m - 1))
        for x, y in parts:
            need = percent * (size[x] + size[y])
            # At most what precedes the shared value in both, itself, and what follows in both.
            most = np.minimum(rank[x], rank[y]) + np.minimum(size[x] - rank[x], size[y] - rank[y])
            most = np.where(late[x], np.minimum(hot[x], hot[y]), most)
            use = (own[x] != own[y]) & _alike(size[x], size[y], percent) & ((100 + percent) * most >= need)
            x, y = x[use], y[use]
            if len(x):
                # Lists order nodes each in its way: a pair has one name.
                x, y = np.where(node[x] < node[y], x, y), np.where(node[x] < node[y], y, x)
                yield pa.RecordBatch.from_arrays([pa.array(node[x]), pa.array(node[y]), pa.array(size[x]), pa.array(size[y]), pa.array(rank[x]), pa.array(rank[y])], ["a", "b", "na", "nb", "ra", "rb"])


def _texts(batches: Iterable[pa.RecordBatch], wanted: np.ndarray, width: int, seed: int) -> Iterator[pa.RecordBatch]:
    """(node, text) of the texts whose set may be wanted."""
    for rows, data, offsets in text_blocks(batches, max_bytes=CHUNK_BYTES // 2):
        values, edges = shingle_sets(data, offsets, width)
        nodes = set_nodes(values, edges, seed)
        use = np.flatnonzero((np.diff(edges) > 0) & graph.in_bitmap(mix(nodes), wanted))
        nodes, first = np.unique(nodes[use], return_index=True)
        raw = data.tobytes()
        yield pa.RecordBatch.from_arrays([pa.array(nodes.view(np.int64)), pa.array([zstandard.compress(raw[offsets[i] : offsets[i + 1]], 1) for i in use[first]], pa.binary())], ["node", "text"])


def _verify(batches: Iterable[pa.RecordBatch], percent: int, width: int) -> Iterator[pa.RecordBatch]:
    """Links among rows (a, salt, b, text) in order: the hub's own row (b = a) comes first in its group."""
    hub, hub_set = None, None
    for batch in batches:
        a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
        texts = batch.column("text")
        for i in range(0, len(a), 2048):
            raw = [zstandard.decompress(x) for x in texts[i : i + 2048].to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
            values, edges = shingle_sets(np.frombuffer(b"".join(raw), np.uint8), offsets, width)
            out = []
            for k in range(len(raw)):
                x, y, own = a[i + k], b[i + k], values[edges[k] : edges[k + 1]]
                if x == y:
                    hub, hub_set = x, own.copy()
                elif x == hub:
                    at = np.minimum(np.searchsorted(hub_set, own), len(hub_set) - 1)
                    same = int((hub_set[at] == own).sum())
                    if 100 * same >= percent * (len(own) + len(hub_set) - same):
                        out.append((x, y))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["a", "b"])


def _verified(docs: DataFrame, pairs: DataFrame, percent: int, width: int, seed: int) -> DataFrame:
    """The pairs (a, b) of nodes whose full sets reach the threshold, written."""
    with store.scope():
        return store.write_table(_checked(docs, pairs, percent, width, seed), "links").keep().df


def _checked(docs: DataFrame, pairs: DataFrame, percent: int, width: int, seed: int) -> DataFrame:
    spark = docs.sparkSession
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = spark.sparkContext.broadcast(graph.bitmap(nodes.mapInArrow(_mixed, "node long"), "node"))
    texts = docs.mapInArrow(lambda it: _texts(it, wanted.value, width, seed), "node long, text binary").groupBy("node").agg(F.first("text").alias("text"))
    texts = store.write_table(texts.join(nodes, "node", "left_semi"), "texts", "none").df
    # The texts are on disk once, before the exchanges below carry them again.
    store.release(spark)
    many = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / 256).alias("parts"))
    salted = pairs.join(many, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).alias("salt"))
    both = salted.unionByName(salted.select("a", F.col("a").alias("b"), "salt").distinct())
    rows = both.join(texts, both["b"] == texts["node"]).select("a", "salt", "b", "text", (F.col("a") != F.col("b")).alias("other"))
    rows = rows.repartition("a", "salt").sortWithinPartitions("a", "salt", "other")
    return rows.select("a", "b", "text").mapInArrow(lambda it: _verify(it, percent, width), "a long, b long")


def _mixed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(mix(batch.column(0).to_numpy().view(np.uint64)).view(np.int64))], ["node"])


def near_duplicates(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs``."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    seed = 0
    while True:
        with store.scope():
            found = _near_duplicates(docs, percent, width, seed)
        if found is not None:
            return found
        seed += 1


def _can_link(x: str, y: str, percent: int):
    """Whether the sets of two postings of a hot value can reach the threshold: they share hot values only."""
    size = lambda p: F.col(f"{p}.size")
    hot = lambda p: F.col(f"{p}.hot")
    alike = 100 * F.least(size(x), size(y)) >= percent * F.greatest(size(x), size(y))
    enough = (100 + percent) * F.least(hot(x), hot(y)) >= percent * (size(x) + size(y))
    # Hot values that only one of them has: as many at least as bits in which their marks differ.
    apart = F.expr(" + ".join(f"bit_count({x}.marks[{i}] ^ {y}.marks[{i}])" for i in range(MARK_BITS // 64)))
    return alike & enough & ((100 + percent) * (hot(x) + hot(y) - apart) >= 2 * percent * (size(x) + size(y)))


def _hot_hubs(flat: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, shared) of each hot list's first node with the others."""
    first = flat.groupBy("value").agg(F.min(F.struct((F.col("size") - F.col("hot")).alias("own"), "node", "size")).alias("hub"))
    pairs = flat.join(first, "value").filter((F.col("node") != F.col("hub.node")) & (100 * F.least("size", "hub.size") >= percent * F.greatest("size", "hub.size")))
    return pairs.groupBy(F.col("hub.node").alias("a"), F.col("node").alias("b")).agg(F.count(F.lit(1)).alias("shared"))


def _hot_across(flat: DataFrame, marks: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, na, nb, ra, rb, shared) across components in hot lists that still hold several."""
    own = flat.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    sizes = own.groupBy("value", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("value")
    mixed = sizes.agg(F.max(F.struct("n", "root"))["root"].alias("top"), F.count(F.lit(1)).alias("roots")).filter("roots > 1").select("value", "top")
    some = store.write_table(own.join(mixed, "value").join(marks, "node"), "mixed").df
    # A list's largest component meets the others' nodes, never itself.
    x, y = some.filter("root <> top").alias("x"), some.alias("y")
    pairs = x.join(y, F.expr("x.value = y.value AND x.root <> y.root AND (y.root = y.top OR x.node < y.node)") & _can_link("x", "y", percent))
    first = F.col("x.node") < F.col("y.node")
    low, high = (lambda c: F.when(first, F.col(f"x.{c}")).otherwise(F.col(f"y.{c}"))), (lambda c: F.when(first, F.col(f"y.{c}")).otherwise(F.col(f"x.{c}")))
    pairs = pairs.select(low("node").alias("a"), high("node").alias("b"), low("size").alias("na"), high("size").alias("nb"), low("rank").alias("ra"), high("rank").alias("rb"))
    return pairs.groupBy("a", "b").agg(F.first("na").alias("na"), F.first("nb").alias("nb"), F.max("ra").alias("ra"), F.max("rb").alias("rb"), F.count(F.lit(1)).alias("shared"))


def _near_duplicates(docs: DataFrame, percent: int, width: int, seed: int) -> DataFrame | None:
    """The result, or None where two sets have one node."""
    spark = docs.sparkSession
    bits = packed.bucket_bits(store.text_bytes(docs), LIST_BYTES, least=6)

    def cells(hot=None, whole=False):
        return docs.mapInArrow(lambda it: _cells(it, bits, percent, hot.value if hot else None, width, whole, seed), CELLS_DDL)

    def hot_values(rows):
        counted = rows.filter("bucket >= 0").groupBy("bucket", "part").applyInArrow(_hot_values, "value long, n long")
        return counted.groupBy("value").agg(F.sum("n").alias("n")).filter(F.col("n") > HOT // 2)

    # Values of long lists, then those among all values of the sets that have one: so sets that share much
    # have all that they share demoted at once.
    table = store.write_table(cells(), "lists", "none")
    hot = graph.bitmap(hot_values(table.df), "value")
    if hot.any():
        table.drop()
        store.release(spark)
        hot |= graph.bitmap(hot_values(cells(spark.sparkContext.broadcast(hot), whole=True)), "value")
        store.release(spark)
        table = store.write_table(cells(spark.sparkContext.broadcast(hot)), "lists", "none")
    rows = table.df.filter("bucket = -1").select(F.explode(F.arrays_zip("ids", "sizes", "nodes", "checks")).alias("x")).select(F.col("x.ids").alias("doc_id"), F.col("x.sizes").alias("n_shingles"), F.col("x.nodes").alias("node"), F.col("x.checks").alias("check"))
    if not rows.filter("n_shingles > 0").groupBy("node").agg(F.min("check").alias("low"), F.max("check").alias("high")).filter("low <> high").isEmpty():
        return None
    lists = table.df.filter("bucket >= 0 AND part >= 0").select("bucket", "values", "which", "ranks", "nodes", "sizes", "hots")
    hubs = store.write_table(lists.groupBy("bucket").applyInArrow(lambda t: _hubs(t, percent), "bucket int, a long, b long, shared long"), "hubs").df
    store.release(spark)
    total = hubs.groupBy("a", "b").agg(F.sum("shared").alias("shared"))
    flat = None
    if hot.any():
        flat = table.df.filter("bucket >= 0 AND part < 0").select("values", "which", "ranks", "nodes", "sizes", "hots").mapInArrow(_flat, "value long, node long, size long, hot long, rank long")
        # Copies of a set stand in many chunks; a list has each once.
        flat = store.write_table(flat.groupBy("value", "node").agg(F.first("size").alias("size"), F.first("hot").alias("hot"), F.first("rank").alias("rank")), "hot").df
        total = total.unionByName(_hot_hubs(flat, percent)).groupBy("a", "b").agg(F.sum("shared").alias("shared"))
    best = lambda pairs: store.write_table(pairs.groupBy("b").agg(F.max(F.struct("shared", "a")).alias("best")).select(F.col("best.a").alias("a"), "b"), "pairs").df
    first = _verified(docs, best(total), percent, width, seed)
    store.release(spark)
    roots = graph.components(first)
    met = hubs.select("bucket", F.col("a").alias("node")).union(hubs.select("bucket", "b")).distinct().join(roots, "node")
    across = lists.groupBy("bucket").cogroup(met.select("bucket", "node", "root").groupBy("bucket")).applyInArrow(lambda x, y: _summed(_across(x, y, percent) if x.num_rows else ()), "a long, b long, na long, nb long, ra long, rb long, shared long")
    if flat is not None:
        # Copies of a set have the same marks.
        marks = table.df.filter("bucket = -2").select("nodes", "marks").mapInArrow(_marks, "node long, marks array<long>").dropDuplicates(["node"])
        across = across.unionByName(_hot_across(flat, marks, roots, percent))
    seen = across.groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.max("ra").alias("ra"), F.max("rb").alias("rb"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    can = F.col("shared") + F.least(F.col("na") - F.col("ra"), F.col("nb") - F.col("rb"))
    rest = store.write_table(seen.filter(can * (100 + percent) >= percent * (F.col("na") + F.col("nb"))).select("a", "b"), "pairs").df
    if not rest.isEmpty():
        roots = graph.components(first.unionByName(_verified(docs, rest, percent, width, seed)))
    rows = rows.drop("check").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    linked = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    # Written, so that the join below is one whose hot keys (a component of a third of all rows) Spark splits.
    least = store.write_table(rows.filter(linked).groupBy("root").agg(F.min("doc_id").alias("least")), "least").df
    out = rows.join(least, "root", "left").withColumn("component_id", F.when(linked, F.col("least")).otherwise(F.col("doc_id")))
    out = out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
    return store.write_table(out, "neardup").keep().df


def _summed(batches: Iterable[pa.RecordBatch]) -> pa.Table:
    """One row per pair of a bucket: (a, b, na, nb, ra, rb, shared)."""
    names = ("a", "b", "na", "nb", "ra", "rb")
    parts = list(batches)
    a, b, na, nb, ra, rb = (np.concatenate([p.column(c).to_numpy() for p in parts]) if parts else np.zeros(0, np.int64) for c in names)
    order = np.lexsort((b, a))
    a, b, na, nb, ra, rb = a[order], b[order], na[order], nb[order], ra[order], rb[order]
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, np.int64)
    most = lambda x: np.maximum.reduceat(x, first) if len(first) else x
    return pa.table(dict(zip((*names, "shared"), (a[first], b[first], na[first], nb[first], most(ra), most(rb), np.diff(np.append(first, len(a)))))))
