"""Byte-level BPE encoding and decoding through a global distinct-word exchange.

1. Every text is split into pre-tokens (``PATTERN`` of the public tokenizers) by vectorised class
   runs over its bytes. Per chunk of whole texts the pre-tokens are numbered; a text becomes the
   sequence of these numbers, so each position of each pre-token is kept.
2. The chunk's distinct words go to hash buckets, where each distinct word is encoded once.
3. The ids join back to the chunk, which reassembles every text by position.
4. Decoding joins the ids with the token-byte table (one row per rank, so of fixed size).

A word occurs once per chunk at most, so no word can make a bucket hot. Null text counts as empty and
gives no ids. Repeated rows, null ids and extra columns are fine: one row leaves for each that comes.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import packed, store
from plumbline.llm.textops import give_back, span_hashes, text_blocks

LETTER, NUMBER, OTHER, SPACE = 1, 2, 3, 4
CHUNK_BYTES = 8 << 20
_cache: dict = {}


def char_classes() -> np.ndarray:
    """Class of every code point, as the tokenizer library's own expressions see it."""
    if "classes" not in _cache:
        import tiktoken

        table = np.full(0x110000, OTHER, np.uint8)
        points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
        every = "".join(map(chr, points))
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
            one = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
            hit = bytes(one.encode_ordinary(every)).decode()
            table[np.frombuffer(hit.encode("utf-32-le"), np.uint32)] = kind
        _cache["classes"] = table
    return _cache["classes"]


def byte_classes(data: np.ndarray) -> np.ndarray:
    """Class of each byte: that of the character it belongs to."""
    table = char_classes()
    out = table[:256].copy()
    out[128:] = OTHER
    out = out[data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        size = 2 + (data[lead] >= 0xE0).astype(np.int64) + (data[lead] >= 0xF0)
        at = np.minimum(lead[:, None] + np.arange(4), len(data) - 1)
        b = data[at].astype(np.uint32)
        point = np.where(size == 2, (b[:, 0] & 31) << 6 | b[:, 1] & 63, np.where(size == 3, (b[:, 0] & 15) << 12 | (b[:, 1] & 63) << 6 | b[:, 2] & 63, (b[:, 0] & 7) << 18 | (b[:, 1] & 63) << 12 | (b[:, 2] & 63) << 6 | b[:, 3] & 63))
        kind = table[np.minimum(point, 0x10FFFF)]
        for k in range(4):
            has = size > k
            out[at[has, k]] = kind[has]
    return out


def pretoken_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where each pre-token of the block begins; together they tile the texts."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    kind = byte_classes(data)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    run = edge[:n].copy()
    run[1:] |= kind[1:] != kind[:-1]
    start = run.copy()
    # The last blank before a run of another kind: a space joins the run, another blank stands alone.
    first = np.flatnonzero(run[1:] & (kind[1:] != SPACE) & (kind[:-1] == SPACE) & ~edge[1:n]) + 1
    last = first - 1
    for _ in range(3):
        last = np.where((data[last] & 0xC0) == 0x80, last - 1, last)
    start[last] = True
    joined = data[last] == 0x20
    start[first[joined]] = False
    # A lone apostrophe, not joined to a space, with one of the endings below.
    quote = np.flatnonzero((data == 0x27) & start[:n] & run)
    quote = quote[quote + 1 < n]
    quote = quote[run[quote + 1] & (kind[quote + 1] == LETTER) & ~edge[quote + 1]]
    if len(quote):
        a = data[quote + 1]
        more = np.minimum(quote + 2, n - 1)
        b = np.where((quote + 2 < n) & ~edge[more], data[more], 0)
        one = np.isin(a, np.frombuffer(b"stmd", np.uint8))
        two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        for hit, size in ((one, 1), (two, 2)):
            q = quote[hit]
            start[q + 1] = False
            rest = q + 1 + size
            rest = rest[rest < n]
            start[rest] = True
    return np.flatnonzero(start)


def gather(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The spans of ``data`` one after another."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return data[np.repeat(starts - (ends - sizes), sizes) + np.arange(total)]


def load_ranks(path: str) -> bytes:
    """The rank file's bytes; it is read on the driver only."""
    with open(path, "rb") as f:
        return f.read()


def _ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line.strip())}


def _encoder(raw: bytes, pattern: str):
    key = ("encoder", hash(raw), pattern)
    if key not in _cache:
        import tiktoken

        _cache[key] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=_ranks(raw), special_tokens={})
    return _cache[key]


def token_bytes(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The token-byte table: (all bytes, where each id starts, its size)."""
    key = ("bytes", hash(raw))
    if key not in _cache:
        ranks = _ranks(raw)
        table = [b""] * (max(ranks.values(), default=-1) + 1)
        for word, i in ranks.items():
            table[i] = word
        sizes = np.array([len(x) for x in table], np.int64)
        _cache[key] = (np.frombuffer(b"".join(table), np.uint8), np.cumsum(sizes) - sizes, sizes)
    return _cache[key]


def decode_ids(ids: np.ndarray, raw: bytes) -> bytes:
    """Join ids with the token-byte table."""
    data, starts, sizes = token_bytes(raw)
    return gather(data, starts[ids], sizes[ids]).tobytes()


CHUNKS = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("codes", pa.binary()), ("numbers", pa.binary()), ("words", pa.binary()), ("sizes", pa.binary())])
CHUNKS_DDL = "chunk long, bucket int, doc_ids array<long>, counts array<long>, codes binary, numbers binary, words binary, sizes binary"


def _split(batches: Iterable[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Chunks: a row with the texts as sequences of word numbers, and a row per bucket with the distinct words.

    Words stand in the order of their hashes, over all buckets; ``numbers`` has the number of each.
    """
    ids = store.chunk_counter()
    for rows, data, offsets in text_blocks(batches, max_bytes=CHUNK_BYTES):
        chunk = next(ids)
        starts = pretoken_starts(data, offsets)
        counts = np.diff(np.searchsorted(starts, offsets))
        ends = np.append(starts[1:], len(data)) if len(starts) else starts
        hashes = span_hashes(data, starts, ends)
        known, first, code, count = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
        del hashes
        # Frequent words get small numbers, which pack well.
        number = np.empty(len(count), np.uint32)
        number[np.argsort(-count, kind="stable")] = np.arange(len(count), dtype=np.uint32)
        code = number[code]
        out: dict[str, list] = {x: [] for x in CHUNKS.names}

        def row(**x):
            for k in CHUNKS.names:
                out[k].append(x.get(k))

        row(chunk=chunk, bucket=-1, doc_ids=rows.column(0).cast(pa.int64()).to_pylist(), counts=counts, codes=packed.planes(code), numbers=packed.planes(number))
        s, z = starts[first], ends[first] - starts[first]
        del starts, ends, code, first
        edges = packed.cuts(known, bits)
        for b in np.flatnonzero(np.diff(edges)):
            i, j = edges[b], edges[b + 1]
            row(chunk=chunk, bucket=int(b), words=zstandard.compress(gather(data, s[i:j], z[i:j]).tobytes(), 3), sizes=packed.planes(z[i:j]))
        yield pa.RecordBatch.from_pydict(out, CHUNKS)


def _encode_bucket(table: pa.Table, raw: bytes, pattern: str) -> pa.Table:
    """Encode each distinct word of a bucket once; give every chunk the ids of its words."""
    give_back()
    bpe = _encoder(raw, pattern)
    known: dict[bytes, int] = {}
    flat: list[int] = []
    ends: list[int] = [0]
    cells = []
    for words, sizes in zip(table["words"].to_pylist(), table["sizes"].to_pylist()):
        text, z = zstandard.decompress(words), packed.unplanes(sizes)
        e = np.cumsum(z, dtype=np.int64).tolist()
        at, a = np.empty(len(e), np.int64), 0
        for k, b in enumerate(e):
            w = text[a:b]
            a = b
            i = known.get(w)
            if i is None:
                i = known[w] = len(known)
                flat += bpe.encode_ordinary(w.decode("utf-8", "replace"))
                ends.append(len(flat))
            at[k] = i
        cells.append(at)
    ids, edge = np.array(flat, np.uint32), np.array(ends, np.int64)
    del known, flat, ends
    out_ids, out_sizes = [], []
    for at in cells:
        size = edge[at + 1] - edge[at]
        out_ids.append(packed.planes(gather(ids, edge[at], size)))
        out_sizes.append(packed.planes(size))
    return pa.table({"chunk": table["chunk"], "bucket": table["bucket"], "ids": pa.array(out_ids, pa.binary()), "sizes": pa.array(out_sizes, pa.binary())})


def _assemble(batches: Iterable[pa.RecordBatch], raw: bytes | None, emit) -> Iterator[pa.RecordBatch]:
    """Texts of each chunk by position: ids of every word in turn."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = {k: batch.column(k)[i].as_py() for k in ("doc_ids", "counts", "codes", "numbers", "cells")}
            codes, number = packed.unplanes(row["codes"]), packed.unplanes(row["numbers"])
            cells = row["cells"] or ()
            none = np.zeros(0, np.uint32)
            z = np.concatenate([none, *(packed.unplanes(x["sizes"]) for x in cells)]).astype(np.int64)
            ids = np.concatenate([none, *(packed.unplanes(x["ids"]) for x in cells)])
            if len(z) != len(number):
                raise RuntimeError(f"{len(z)} of a chunk's {len(number)} words came back")
            size, start = np.empty(len(z), np.int64), np.empty(len(z), np.int64)
            size[number], start[number] = z, np.cumsum(z) - z
            edges = np.concatenate([[0], np.cumsum(np.array(row["counts"], np.int64))])
            a = 0
            while a < len(row["doc_ids"]):
                b = max(a + 1, int(np.searchsorted(edges, edges[a] + 400_000, "right")) - 1)
                part = codes[edges[a] : edges[b]]
                flat = gather(ids, start[part], size[part])
                per = np.concatenate([[0], np.cumsum(size[part])])[edges[a : b + 1] - edges[a]]
                yield emit(row["doc_ids"][a:b], flat, per, raw)
                a = b
            give_back()


def _digests(doc_ids: list, flat: np.ndarray, edges: np.ndarray, raw: bytes) -> pa.RecordBatch:
    out: tuple[list, list, list] = ([], [], [])
    data, starts, sizes = token_bytes(raw)
    wide, text = memoryview(flat.astype("<u4")).cast("B"), memoryview(gather(data, starts[flat], sizes[flat]))
    at = np.concatenate([[0], np.cumsum(sizes[flat])])[edges]
    for i in range(len(doc_ids)):
        out[0].append(int(edges[i + 1] - edges[i]))
        out[1].append(hashlib.sha256(wide[4 * edges[i] : 4 * edges[i + 1]]).hexdigest())
        out[2].append(hashlib.sha256(text[at[i] : at[i + 1]]).hexdigest())
    return pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(out[0], pa.int64()), pa.array(out[1]), pa.array(out[2])], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def _id_rows(doc_ids: list, flat: np.ndarray, edges: np.ndarray, raw: bytes | None) -> pa.RecordBatch:
    wide = flat.astype("<u4").tobytes()
    return pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(np.diff(edges), pa.int64()), pa.array([wide[4 * a : 4 * b] for a, b in zip(edges[:-1], edges[1:])], pa.binary())], ["doc_id", "n_tokens", "ids"])


def _encoded(docs: DataFrame, rank_path: str, pattern: str, id_col: str, text_col: str, emit, ddl: str) -> DataFrame:
    import public_tokenizers

    if pattern != public_tokenizers.PATTERN:
        raise ValueError("pre-tokens are cut by the rules of public_tokenizers.PATTERN; no other pattern is supported")
    spark = docs.sparkSession
    raw = spark.sparkContext.broadcast(load_ranks(rank_path))
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    total = store.text_bytes(docs)
    bits = packed.bucket_bits(total, 8 << 20)
    parts = int(min(20_000, max(16, total // CHUNK_BYTES)))
    chunks = store.write_bucketed(docs.mapInArrow(lambda it: _split(it, bits), CHUNKS_DDL), "bpe", "chunk", parts).df
    cells = chunks.filter("bucket >= 0").select("chunk", "bucket", "words", "sizes")
    ids = cells.groupBy("bucket").applyInArrow(lambda t: _encode_bucket(t, raw.value, pattern), "chunk long, bucket int, ids binary, sizes binary")
    # As many partitions as the chunks have buckets, so that the chunks stay where they are.
    back = ids.repartition(parts, "chunk").groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("bucket", "ids", "sizes"))).alias("cells"))
    whole = chunks.filter("bucket < 0").select("chunk", "doc_ids", "counts", "codes", "numbers").hint("merge").join(back.hint("merge"), "chunk", "left")
    return whole.select("doc_ids", "counts", "codes", "numbers", "cells").mapInArrow(lambda it: _assemble(it, raw.value, emit), ddl)


def encode(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids): ids as little-endian unsigned 32-bit integers, one row for each row of ``docs``."""
    return _encoded(docs, rank_path, pattern, id_col, text_col, _id_rows, "doc_id long, n_tokens long, ids binary")


def encode_digests(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of the ids and of the bytes they decode to."""
    return _encoded(docs, rank_path, pattern, id_col, text_col, _digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def decode(encoded: DataFrame, rank_path: str) -> DataFrame:
    """(doc_id, data): the bytes of ``ids``. The token-byte table has a row per rank and goes to every task.

    Null ids decode to empty bytes; an id outside the table raises an error.
    """
    raw = encoded.sparkSession.sparkContext.broadcast(load_ranks(rank_path))

    def run(batches):
        for batch in batches:
            ids = [np.frombuffer(x or b"", "<u4") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([decode_ids(x, raw.value) for x in ids], pa.binary())], ["doc_id", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")
