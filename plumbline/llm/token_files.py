"""Token counts from flat token files: block scans for separators, stitched by a prefix scan.

A token file is unsigned little-endian integers one after another, nothing else; a separator id ends each
document. ``scan`` cuts every file into blocks, reads each block on its own and finds its separators with
one vectorised comparison. A block reports the lengths between its separators and the loose tokens at both
ends. A prefix scan over the blocks of a file (window functions over one row per block) gives the tokens
that earlier blocks left open and the number of documents before, so each document gets its length and its
place, whatever blocks it spans.

Files live in a folder that driver and executors share, and are read and written through Arrow's file
systems by their URI. A file without tokens has no documents; tokens after the last separator are a last,
open document. A document without tokens has count 0.

``write`` makes such files from documents: one file per task, named by the task, renamed into place when
whole, so that a task that runs again leaves the same file. It returns a manifest with each document's
file and place. Null text counts as empty; null ids, repeated rows and extra columns don't matter.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm import store
from plumbline.llm.bpe import _encoder, load_ranks

BLOCK_TOKENS = 1 << 22


def _open_fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _write_part(batches: Iterable[pa.RecordBatch], folder: str, raw: bytes, pattern: str, separator: int, dtype: str) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    bpe = _encoder(raw, pattern)
    name = f"{folder}/part-{TaskContext.get().partitionId():06d}.bin"
    files, path = _open_fs(name)
    files.create_dir(path.rsplit("/", 1)[0], recursive=True)
    draft = f"{path}.{uuid.uuid4().hex}"
    place = 0
    out = []
    with files.open_output_stream(draft) as f:
        for batch in batches:
            ids = batch.column(0)
            for i in range(0, batch.num_rows, 256):
                texts = batch.column(1).slice(i, 256).to_pylist()
                for t in texts:
                    f.write(np.array([*bpe.encode_ordinary(t or ""), separator], dtype).tobytes())
            out.append(pa.RecordBatch.from_arrays([ids, pa.array([name] * batch.num_rows), pa.array(np.arange(place, place + batch.num_rows))], ["doc_id", "file", "place"]))
            place += batch.num_rows
    files.move(draft, path)
    yield from out


def write(docs: DataFrame, rank_path: str, pattern: str, separator: int, dtype: str = "<u2", id_col: str = "doc_id", text_col: str = "text") -> tuple[str, DataFrame]:
    """(folder, manifest (doc_id, file, place)) of token files made from ``docs``."""
    spark = docs.sparkSession
    raw = spark.sparkContext.broadcast(load_ranks(rank_path))
    folder = f"{store.shared_dir(spark)}/tokens-{uuid.uuid4().hex[:10]}"
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    manifest = slim.mapInArrow(lambda it: _write_part(it, folder, raw.value, pattern, separator, dtype), "doc_id long, file string, place long")
    return folder, store.write_table(manifest, "manifest").df


def _sizes(spark: SparkSession, folder: str) -> list[tuple[str, int]]:
    """Files of the folder with their bytes: names only, from the file system."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(folder)
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(jvm.org.apache.hadoop.fs.Path(folder + "/*.bin"))
    return sorted((x.getPath().getName(), int(x.getLen())) for x in found or ())


def _scan_blocks(batches: Iterable[pa.RecordBatch], separator: int, dtype: str) -> Iterator[pa.RecordBatch]:
    """Per block: lengths of the documents that end in it (the first without what came before) and the open rest."""
    width = np.dtype(dtype).itemsize
    for batch in batches:
        for name, block, start, tokens in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "start", "tokens"))):
            files, path = _open_fs(name)
            with files.open_input_file(path) as f:
                data = np.frombuffer(f.read_at(tokens * width, start * width), dtype)
            at = np.flatnonzero(data == separator)
            ends = np.diff(at, prepend=-1) - 1
            rest = len(data) - (int(at[-1]) + 1 if len(at) else 0)
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([block], pa.int64()), pa.array([ends.tolist()], pa.list_(pa.int64())), pa.array([len(at)], pa.int64()), pa.array([rest], pa.int64())], ["file", "block", "ends", "documents", "rest"])


def scan(spark: SparkSession, folder: str, separator: int, dtype: str = "<u2", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(file, place, n_tokens, closed) of every document in the folder's files; separators aren't counted."""
    width = np.dtype(dtype).itemsize
    sizes = _sizes(spark, folder)
    files = spark.createDataFrame([(f"{folder}/{n}", b // width) for n, b in sizes], "file string, size long")
    blocks = files.filter("size > 0").select("file", "size", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(block_tokens).cast("long"))).alias("block", "start"))
    blocks = blocks.select("file", F.col("block").cast("long").alias("block"), "start", F.least(F.lit(block_tokens), F.col("size") - F.col("start")).cast("long").alias("tokens"))
    tokens = sum(b // width for _, b in sizes)
    parts = int(min(20_000, max(1, min(-(-tokens // block_tokens), 2 * spark.sparkContext.defaultParallelism), tokens // BLOCK_TOKENS)))
    found = blocks.repartition(parts, "file", "block").mapInArrow(lambda it: _scan_blocks(it, separator, dtype), "file string, block long, ends array<long>, documents long, rest long")
    found = store.write_table(found, "blocks").df
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    summed = found.select("file", "block", "documents", "rest")
    # Documents before the block, and tokens left open since the last block with a separator.
    upto = F.sum("rest").over(before)
    closed = F.max(F.when(F.col("documents") > 0, F.col("_upto") - F.col("rest"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    run = summed.withColumn("_upto", F.sum("rest").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_start", closed)
    run = run.withColumn("carry", F.coalesce(upto, F.lit(0)) - F.coalesce(F.lag("_start").over(order), F.lit(0))).withColumn("first", F.coalesce(F.sum("documents").over(before), F.lit(0)))
    last = F.lead("block").over(order).isNull()
    run = run.withColumn("last", last).withColumn("open", F.col("_upto") - F.coalesce("_start", F.lit(0)))
    whole = found.select("file", "block", "ends").join(run.drop("documents", "rest"), ["file", "block"])
    ended = whole.select("file", "first", "carry", F.posexplode("ends").alias("k", "n")).select("file", (F.col("first") + F.col("k")).alias("place"), (F.col("n") + F.when(F.col("k") == 0, F.col("carry")).otherwise(0)).alias("n_tokens"), F.lit(True).alias("closed"))
    loose = run.filter("last AND open > 0").select("file", (F.col("first") + F.col("documents")).alias("place"), F.col("open").alias("n_tokens"), F.lit(False).alias("closed"))
    return ended.unionByName(loose)
