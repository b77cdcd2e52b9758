"""Stupid-backoff scores from n-gram counts of the corpus itself.

S(w | context) is count(context, w) / count(context) for the longest context, up to ``order`` - 1 words,
whose n-gram the rest of the corpus has, times ``BACKOFF`` for each word of context dropped; a word alone
has count(w) / all words. A document's own n-grams are taken from the counts, so a text is judged by what
other texts say; a word that no other text has counts as one occurrence. Copies of a text count as texts.
The score is the mean of ln S over the document's words; contexts don't cross documents.

Counts are tables, one for each length n, partitioned by hash. Per chunk of whole texts the distinct n-grams
with their counts go, packed, to the partition (n, leading bits of the hash); there the chunks' counts are
added to the partition's count table, which is joined at once to the n-grams that each chunk asked for. The
chunk joins the totals to its exploded n-grams and adds them up per document. A hash occurs once per chunk and
partition, so a frequent n-gram loads no task. Totals are whole numbers of any size.

A word is a run other than white space, A-Z lower-cased. Null or empty text has n_words 0 and no score
(null). Null ids, repeated rows and extra columns are fine: one row leaves for each that comes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import packed, store
from plumbline.llm.textops import LOWER, give_back, span_hashes, text_blocks, window_hashes, word_spans

ORDER, BACKOFF = 3, 0.4
# An n-gram meets one of 10**12 others in its hash with probability 2**-16; its count then holds both.
HASH_BITS = 56
CHUNK_BYTES = 8 << 20
CHUNKS = pa.schema([("chunk", pa.int64()), ("ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("codes", pa.binary()), ("words", pa.binary())])
CHUNKS_DDL = "chunk long, ids array<long>, counts array<long>, codes binary, words binary"
CELLS = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("values", pa.binary()), ("many", pa.binary())])
CELLS_DDL = "chunk long, bucket int, values binary, many binary"


def _grams(words: np.ndarray, place: np.ndarray, n: int, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions of the n-grams' last words, their hashes without the last ``shift`` bits)."""
    h = window_hashes(words, n)
    h >>= np.uint64(shift)
    last = np.flatnonzero(place >= n - 1).astype(np.int32)
    return last, h[last - (n - 1)]


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct values, place of each value among them), in less memory than np.unique takes."""
    order = np.argsort(values).astype(np.int32)
    ranked = values[order]
    fresh = np.ones(len(ranked), bool)
    np.not_equal(ranked[1:], ranked[:-1], out=fresh[1:])
    at = np.empty(len(ranked), np.int32)
    at[order] = np.cumsum(fresh, dtype=np.int32) - 1
    return ranked[fresh], at


def _place(counts: np.ndarray) -> np.ndarray:
    """Words before each word in its text."""
    first = (np.cumsum(counts) - counts).astype(np.int32)
    return np.arange(int(counts.sum()), dtype=np.int32) - np.repeat(first, counts)


def _split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids = store.chunk_counter()
    for rows, data, offsets in text_blocks(batches, max_bytes=CHUNK_BYTES):
        chunk, data = next(ids), LOWER[data]
        starts, ends, first = word_spans(data, offsets)
        words, counts = span_hashes(data, starts, ends), np.diff(first)
        known, code = _distinct(words)
        rank = np.argsort(-np.bincount(code, minlength=len(known)), kind="stable")
        number = np.empty(len(rank), np.int32)
        number[rank] = np.arange(len(rank))
        out = {x: [] for x in CHUNKS.names}

        def row(**x):
            for k in CHUNKS.names:
                out[k].append(x.get(k))

        row(chunk=chunk, ids=rows.column(0).to_pylist(), counts=counts, codes=packed.planes(number[code]), words=known[rank].tobytes())
        yield pa.RecordBatch.from_pydict(out, CHUNKS)


def _count(batches: Iterable[pa.RecordBatch], order: int, bits: int, shift: int) -> Iterator[pa.RecordBatch]:
    """Distinct n-grams of each chunk with their counts, a row per length and leading bits of the hash."""
    for batch in batches:
        for i in range(batch.num_rows):
            words, counts = _words(batch, i)
            place, chunk = _place(counts), batch.column("chunk")[i].as_py()
            for n in range(1, order + 1):
                _, value = _grams(words, place, n, shift)
                value.sort()
                first = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]])) if len(value) else np.zeros(0, np.int64)
                many, value = np.diff(np.append(first, len(value))), value[first]
                cut = packed.cuts(value << np.uint64(shift), bits)
                rows = [{"chunk": chunk, "bucket": (n - 1 << bits) + int(b), "values": packed.pack(value[cut[b] : cut[b + 1]]), "many": packed.planes(many[cut[b] : cut[b + 1]])} for b in np.flatnonzero(np.diff(cut))]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, CELLS)


def _words(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the chunk's words in place, words of each text)."""
    codes = packed.unplanes(batch.column("codes")[i].as_py())
    return np.frombuffer(batch.column("words")[i].as_py(), np.uint64)[codes], np.array(batch.column("counts")[i].as_py(), np.int64)


def _totals(table: pa.Table) -> pa.Table:
    """Counts over all chunks of the n-grams that each chunk has."""
    give_back()
    cells = [packed.unpack(x) for x in table["values"].to_pylist()]
    edges = np.cumsum([0, *map(len, cells)])
    known, which = _distinct(np.concatenate(cells))
    del cells
    total = np.zeros(len(known), np.int64)
    for k, x in enumerate(table["many"].to_pylist()):
        # A chunk has each of its n-grams once.
        total[which[edges[k] : edges[k + 1]]] += packed.unplanes(x).astype(np.int64)
    parts = [packed.planes(total[which[a:b]]) for a, b in zip(edges[:-1], edges[1:])]
    return pa.table({"chunk": table["chunk"], "bucket": table["bucket"], "totals": pa.array(parts, pa.binary())})


def _elsewhere(words: np.ndarray, place: np.ndarray, doc: np.ndarray, n: int, shift: int, total: np.ndarray) -> np.ndarray:
    """For each word, how often the n-gram that ends there occurs outside its document; 0 where there is none."""
    last, value = _grams(words, place, n, shift)
    known, at = _distinct(value)
    if len(known) != len(total):
        raise RuntimeError(f"{len(total)} of a chunk's {len(known)} n-grams came back")
    _, which = _distinct(doc[last].astype(np.int64) * (len(known) + 1) + at)
    own = np.bincount(which) if len(which) else np.zeros(0, np.int64)
    full = np.zeros(len(words), np.int64)
    full[last] = total[at] - own[which]
    return full


def _score(batches: Iterable[pa.RecordBatch], order: int, backoff: float, corpus: int, bits: int, shift: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            words, counts = _words(batch, i)
            place = _place(counts)
            doc = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
            parts: list[list[np.ndarray]] = [[] for _ in range(order)]
            for x in batch.column("answers")[i].as_py() or ():
                parts[x["bucket"] >> bits].append(packed.unplanes(x["totals"]).astype(np.int64))
            shorter, s = None, np.zeros(len(words))
            for n in range(1, order + 1):
                total = np.concatenate(parts[n - 1]) if parts[n - 1] else np.zeros(0, np.int64)
                here = _elsewhere(words, place, doc, n, shift, total)
                if n == 1:
                    s = np.log(np.maximum(here, 1) / np.maximum(corpus - counts[doc], 1)) + (order - 1) * np.log(backoff)
                else:
                    # An n-gram's context ends one word before.
                    hit = np.flatnonzero(here > 0)
                    s[hit] = np.log(here[hit] / np.maximum(shorter[hit - 1], 1)) + (order - n) * np.log(backoff)
                shorter = here
            # Where the text itself has fewer words before, nothing was dropped.
            s -= np.maximum(order - 1 - place, 0) * np.log(backoff)
            mean = np.bincount(doc, s, len(counts)) / np.maximum(counts, 1)
            give_back()
            yield pa.RecordBatch.from_arrays([pa.array(batch.column("ids")[i].as_py(), pa.int64()), pa.array(counts), pa.array(mean, mask=counts == 0)], ["doc_id", "n_words", "score"])


def backoff_scores(docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, score) for each row."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    total = store.text_bytes(slim)
    bits = packed.bucket_bits(total, 24 << 20)
    shift = 64 - HASH_BITS
    parts = int(min(20_000, max(16, total // CHUNK_BYTES)))
    whole = store.write_bucketed(slim.mapInArrow(_split, CHUNKS_DDL), "ngrams", "chunk", parts).df
    corpus = whole.agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).first()["n"] or 0
    cells = whole.select("chunk", "counts", "codes", "words").mapInArrow(lambda it: _count(it, order, bits, shift), CELLS_DDL)
    answers = cells.groupBy("bucket").applyInArrow(_totals, "chunk long, bucket int, totals binary")
    # As many partitions as the chunks have buckets, so that the chunks stay where they are.
    answers = answers.repartition(parts, "chunk").groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("bucket", "totals"))).alias("answers"))
    rows = whole.select("chunk", "ids", "counts", "codes", "words").hint("merge").join(answers.hint("merge"), "chunk", "left")
    return rows.select("ids", "counts", "codes", "words", "answers").mapInArrow(lambda it: _score(it, order, backoff, corpus, bits, shift), "doc_id long, n_words long, score double")
