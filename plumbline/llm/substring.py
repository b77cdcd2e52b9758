"""Removal of repeated passages: fixed-block anchors, rolling probes, maximal exact repeats.

A window is ``window`` consecutive words of one text. A word goes if a window that covers it has a word
sequence that also starts at another place, in the same text or another. Windows are judged on the input.

1. Every text is cut into non-overlapping reference blocks of ``(window + 1) // 2`` words. Each window
   holds one such block whole.
2. All rolling windows of the block's width probe the blocks. Per chunk of texts the distinct hashes go,
   packed, to hash buckets; a bucket tells each chunk which of its blocks start at two places or more.
   These hashes are shortened, so a hit may be false; a false hit only costs the work of the next step.
3. Hits are extended: the windows around a hit block are compared by their full 64-bit hashes in a second
   exchange. The union of the windows that start twice is the set of maximal exact repeats of
   ``window`` words or more. Two different windows meet in one hash with probability 2**-64.

A hash occurs once per chunk at most, so neither a bucket nor a task grows with the copies of a passage.
Chunks are whole rows; they are written once, bucketed by chunk, so that answers join them without
moving the texts again. Null text has no words. Rows with null ids, repeated rows and extra columns are
kept as they are; the columns n_words, n_removed and kept are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import packed, store
from plumbline.llm.bpe import gather
from plumbline.llm.textops import span_hashes, text_blocks, window_hashes, word_spans

CHUNK_BYTES = 8 << 20
CELLS = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("values", pa.binary()), ("multi", pa.binary()), ("blocks", pa.binary()), ("rows", pa.binary())])
CELLS_DDL = "chunk long, bucket int, values binary, multi binary, blocks binary, rows binary"


def freeze(rows: pa.RecordBatch) -> bytes:
    """Rows as one compressed value."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as w:
        w.write_batch(rows)
    return zstandard.compress(memoryview(sink.getvalue()), 3)


def thaw(blob: bytes) -> pa.RecordBatch:
    """The rows of ``freeze``."""
    return pa.ipc.open_stream(zstandard.decompress(blob)).read_next_batch()


class Chunk:
    """Word spans, word hashes and window positions of a block of texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, window: int):
        self.data, self.window, self.anchor = data, window, (window + 1) // 2
        self.starts, self.ends, self.first = word_spans(data, offsets)
        self.words = span_hashes(data, self.starts, self.ends)
        self.counts = np.diff(self.first)
        self.place = np.arange(len(self.starts)) - np.repeat(self.first[:-1], self.counts)
        self.left = np.repeat(self.counts, self.counts) - self.place  # words from here to the text's end
        self.long = np.repeat(self.counts, self.counts) >= window

    def probes(self, shift: int) -> tuple[np.ndarray, np.ndarray]:
        """(shortened hashes of all rolling blocks, positions of the reference blocks among all words)."""
        rolling = window_hashes(self.words, self.anchor) >> np.uint64(shift) << np.uint64(shift)
        ok = (self.long & (self.left >= self.anchor))[: len(rolling)]
        at = np.flatnonzero(ok & (self.place[: len(rolling)] % self.anchor == 0))
        self.rolling = rolling
        return rolling[ok], at

    def candidates(self, shift: int, hits: np.ndarray) -> np.ndarray:
        """Starts of the windows that hold a hit block; ``hits``: for each of the sorted distinct blocks."""
        _, at = self.probes(shift)
        hot = np.zeros(len(self.words) + self.anchor, bool)
        if len(at):
            values, which = np.unique(self.rolling[at], return_inverse=True)
            hot[at] = hits[which]
        start = np.flatnonzero(self.left >= self.window)
        return start[hot[start + (-self.place[start]) % self.anchor]]


def _cells(chunk: int, values: np.ndarray, bits: int, shift: int = 0, block_values: np.ndarray | None = None) -> Iterator[dict]:
    """A row for each bucket with the distinct values, without their ``shift`` zero bits."""
    unique, count = np.unique(values, return_counts=True)
    edges = packed.cuts(unique, bits)
    block = None
    if block_values is not None:
        block = np.zeros(len(unique), bool)
        block[np.searchsorted(unique, np.unique(block_values))] = True
    for b in np.flatnonzero(np.diff(edges)):
        i, j = edges[b], edges[b + 1]
        yield {"chunk": chunk, "bucket": int(b), "values": packed.pack(unique[i:j] >> np.uint64(shift)), "multi": np.packbits(count[i:j] > 1).tobytes(), "blocks": None if block is None else np.packbits(block[i:j]).tobytes()}


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


def _split(batches: Iterable[pa.RecordBatch], text: str, window: int, bits: int, shift: int) -> Iterator[pa.RecordBatch]:
    ids = store.chunk_counter()
    for rows, data, offsets in text_blocks(batches, text, CHUNK_BYTES):
        chunk, c = next(ids), Chunk(data, offsets, window)
        values, at = c.probes(shift)
        yield _batch([{"chunk": chunk, "bucket": -1, "rows": freeze(rows)}, *_cells(chunk, values, bits, shift, c.rolling[at])], CELLS)


def _twice(cells: list[np.ndarray], multi: list[np.ndarray]) -> list[np.ndarray]:
    """For each cell, which of its values occur at two places or more in all."""
    values = np.concatenate(cells)
    _, which, count = np.unique(values, return_inverse=True, return_counts=True)
    total = count + np.bincount(which, np.concatenate(multi), len(count)).astype(np.int64)
    return np.split((total > 1)[which], np.cumsum([len(x) for x in cells])[:-1])


def _answer(table: pa.Table) -> pa.Table:
    """What a bucket tells each chunk: bits for its blocks, or for all its values if none are marked."""
    cells = [packed.unpack(x) for x in table["values"].to_pylist()]
    multi = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(v)) for x, v in zip(table["multi"].to_pylist(), cells)]
    out, sizes = [], []
    for hit, block, v in zip(_twice(cells, multi), table["blocks"].to_pylist(), cells):
        if block is not None:
            hit = hit[np.unpackbits(np.frombuffer(block, np.uint8), count=len(v)).astype(bool)]
        out.append(np.packbits(hit).tobytes())
        sizes.append(len(hit))
    return pa.table({"chunk": table["chunk"], "bucket": table["bucket"], "hits": pa.array(out, pa.binary()), "n": pa.array(sizes, pa.int64())})


def _answers(cells: DataFrame) -> DataFrame:
    """(chunk, answers): bits of all buckets of each chunk."""
    out = cells.groupBy("bucket").applyInArrow(_answer, "chunk long, bucket int, hits binary, n long")
    return out.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("bucket", "n", "hits"))).alias("answers"))


def _bits(answers: list[dict] | None) -> np.ndarray:
    parts = [np.unpackbits(np.frombuffer(x["hits"], np.uint8), count=x["n"]) for x in answers or ()]
    return np.concatenate(parts).astype(bool) if parts else np.zeros(0, bool)


def _thawed(batch: pa.RecordBatch, i: int, text: str, window: int) -> tuple[pa.RecordBatch, np.ndarray, Chunk]:
    rows = thaw(batch.column("rows")[i].as_py())
    ((rows, data, offsets),) = text_blocks([rows], text, 1 << 62)
    return rows, offsets, Chunk(data, offsets, window)


def _extend(batches: Iterable[pa.RecordBatch], text: str, window: int, bits: int, shift: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            hits = _bits(batch.column("answers")[i].as_py())
            if not hits.any():
                continue
            _, _, c = _thawed(batch, i, text, window)
            start = c.candidates(shift, hits)
            if len(start):
                yield _batch(list(_cells(batch.column("chunk")[i].as_py(), window_hashes(c.words, window)[start], bits)), CELLS)


def _judge(batches: Iterable[pa.RecordBatch], text: str, window: int, shift: int, emit) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            rows, offsets, c = _thawed(batch, i, text, window)
            gone = np.zeros(len(c.words) + 1, np.int64)
            again = _bits(batch.column("again")[i].as_py())
            if again.any():
                start = c.candidates(shift, _bits(batch.column("answers")[i].as_py()))
                _, which = np.unique(window_hashes(c.words, window)[start], return_inverse=True)
                start = start[again[which]]
                np.add.at(gone, start, 1)
                np.add.at(gone, start + window, -1)
            yield emit(rows, c, np.cumsum(gone[:-1]) == 0)


def _kept(c: Chunk, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(kept words of all texts, each with a space after it; where each text begins, the total last)."""
    starts, sizes = c.starts[keep], (c.ends - c.starts)[keep] + 1
    out = gather(np.append(c.data, np.uint8(0x20)), starts, sizes)
    ends = np.cumsum(sizes)
    if len(ends):
        out[ends - 1] = 0x20
    words = np.concatenate([[0], np.cumsum(keep)])[c.first]
    return out, np.concatenate([[0], ends])[words]


def _digests(rows: pa.RecordBatch, c: Chunk, keep: np.ndarray) -> pa.RecordBatch:
    data, edges = _kept(c, keep)
    view = memoryview(data)
    sha = [hashlib.sha256(view[a : max(a, b - 1)]).hexdigest() for a, b in zip(edges[:-1], edges[1:])]
    removed = np.diff(np.concatenate([[0], np.cumsum(~keep)])[c.first])
    return pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(c.counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha)], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def _dedup(docs: DataFrame, text: str, window: int, emit, ddl) -> DataFrame:
    total = store.text_bytes(docs, text)
    bits = packed.bucket_bits(total, 12 << 20)
    shift = 64 - min(64, max(40, int(max(total, 1)).bit_length() + 14))
    parts = int(min(20_000, max(16, total // CHUNK_BYTES)))
    split = store.write_bucketed(docs.mapInArrow(lambda it: _split(it, text, window, bits, shift), CELLS_DDL), "passages", "chunk", parts).df
    chunks = split.filter("bucket < 0").select("chunk", "rows")
    first = store.write_table(_answers(split.filter("bucket >= 0").select("chunk", "bucket", "values", "multi", "blocks")), "anchors").df
    hot = chunks.hint("merge").join(first.hint("merge"), "chunk")
    wide = hot.select("chunk", "rows", "answers").mapInArrow(lambda it: _extend(it, text, window, bits, shift), CELLS_DDL)
    again = _answers(wide.select("chunk", "bucket", "values", "multi", "blocks")).select("chunk", F.col("answers").alias("again"))
    both = first.join(again.hint("merge"), "chunk")
    whole = chunks.hint("merge").join(both.hint("merge"), "chunk", "left")
    return whole.select("rows", "answers", "again").mapInArrow(lambda it: _judge(it, text, window, shift, emit), ddl)


def repeat_digests(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for each row."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return _dedup(slim, "text", window, _digests, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(docs: DataFrame, window: int = 35, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, n_removed and kept: the kept words joined by one space, or the text itself where nothing goes."""
    docs = docs.drop("n_words", "n_removed", "kept")
    names = docs.columns

    def emit(rows, c, keep):
        data, edges = _kept(c, keep)
        raw = data.tobytes()
        removed = np.diff(np.concatenate([[0], np.cumsum(~keep)])[c.first])
        old = rows.column(names.index(text_col))
        kept = [old[i].as_py() if not n else raw[a : max(a, b - 1)].decode("utf-8", "replace") for i, (n, a, b) in enumerate(zip(removed, edges[:-1], edges[1:]))]
        return pa.RecordBatch.from_arrays([*rows.columns, pa.array(c.counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], [*names, "n_words", "n_removed", "kept"])

    from pyspark.sql import types as T

    schema = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])
    return _dedup(docs, text_col, window, emit, schema)
