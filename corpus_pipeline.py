"""Corpus preparation in five stages over ``documents``.

Each stage works on all rows that its predecessor kept and, but for the last, returns the columns of
``documents``. A stage's rows are written as Parquet and read again by the next one, so a stage begins by
dropping the tables that the stages before it left.

Null texts count as empty, null ids are kept, ties fall by a hash, repeated rows follow each stage's own rule
below, and an empty table passes through as one. Columns beyond those of ``documents`` are carried along.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import bpe, mixing, neardup, quality, store, substring


#: Word shingles of two near copies are alike by 0.8 or more; the 85 of ``op4_minhash_neardup`` is that query's own.
PERCENT = 80


_left: list[store.Table] = []


def _stage(work):
    """A stage whose own tables stay until the next one begins."""

    @functools.wraps(work)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while _left:
            _left.pop().drop()
        with store.scope() as own:
            out = work(spark, docs, sf_dir)
            _left.extend(own)
            own.clear()
        return out

    return run


@_stage
def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labelled ones among ``docs``.

    A null or empty text is scored like any other. Without labels of both classes all scores are alike.
    """
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model).filter("predicted = 1").select(*docs.columns)


@_stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates, one with its smallest id; of rows that repeat an id and its text, one."""
    keyed = docs.withColumn("_row", F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", "text")))
    groups = neardup.near_duplicates(keyed, percent=PERCENT, id_col="_row").filter(F.col("doc_id").isNotNull())
    found = store.write_table(groups.groupBy(F.col("doc_id").alias("_row"), F.col("component_id").alias("_group")).count(), "groups").df
    ids = keyed.filter(F.col("_row").isNotNull()).select("_row", "doc_id").distinct()
    first = found.join(ids, "_row").groupBy("_group").agg(F.min(F.struct("doc_id", "_row"))["_row"].alias("_row")).select("_row")
    first = store.write_table(first, "first").df
    kept = keyed.join(found.join(first, "_row", "left_anti"), "_row", "left_anti")
    again = found.filter("count > 1").join(first, "_row", "left_semi").select("_row")
    if not again.isEmpty():
        one = kept.join(again, "_row", "left_semi").dropDuplicates(["_row"])
        kept = kept.join(again, "_row", "left_anti").unionByName(one)
    return kept.select(*docs.columns)


@_stage
def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without its repeated passages; texts without any stay as they are."""
    out = substring.remove_repeats(docs)
    changed = F.col("n_removed") > 0
    new = {"text": F.col("kept"), "n_chars": F.when(changed, F.length("kept").cast("long")).otherwise(F.col("n_chars"))}
    return out.select(*[new.get(c, F.col(c)).alias(c) for c in docs.columns])


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as it is taken. Rows without words are taken like others of their size."""
    return mixing.emit(mixing.mix(docs, taken_only=True), docs.columns)


@_stage
def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded bytes."""
    import public_tokenizers

    return bpe.encode_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", keep_quality),
    ("minhash near-dedup", drop_near_duplicates),
    ("substring dedup", drop_repeated_passages),
    ("mixing sources", mix_sources),
    ("byte-level bpe", encode_tokens),
]

#: SQL can't express the classifier; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            table = store.write_table(docs, f"stage{k}")
            if before is not None:
                before.drop()
            docs, before = table.df, table
    return docs
