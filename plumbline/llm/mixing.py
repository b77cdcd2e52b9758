"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Targets: sources in code point order (null last) weigh 5, 2, 1, 5, 2, 1, ... and share all words. A
target stops at ``MOST`` times its source's size; the excess is shared again by weight. That is one
level L with target = min(MOST * size, weight * L), found from running sums over the sources.

Sampling: a source's documents stand in an order by size. Each expects ``rate`` = target / source size
copies. With the running sum of expected copies and one random offset per source, a document is taken
once for each whole number its step crosses, so between floor(rate) and ceil(rate) times. The order by
size makes the words taken follow the target closely.

Rows alike in id, source and text are one group with a count, made in the one pass over the texts; all else
works on these slim groups. Running sums go by blocks: (source, size class, part) holds a few thousand
groups, whatever a source's share is; sums over blocks are added after. What many rows share (a null id with
a null text, say) is one group, so it makes no block hot. Groups join back to the rows on (id, source, hash of
the text); texts move in that join only, and the join's hot keys are Spark's to split.

Rows of one group may swap their copies, which leaves the words taken as they are. Size: number of words,
null text has 0. Null ids are kept. The targets take windows over all sources, one row each, in one task:
that is fine up to some ten million sources. Columns that Spark can't group by (maps) are not supported.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm import store

WEIGHTS = (5, 2, 1)
MOST = 3
BLOCK_ROWS = 2048
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str):
    """Words in a text column; null counts 0."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def text_hash(text):
    """60 bits of a text's MD5, which any SQL engine can compute."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def size_class(size):
    """Eight classes for each doubling of the size, in whole-number arithmetic."""
    bits = F.length(F.conv(size.cast("string"), 10, 2))
    return (bits * 8 + F.when(size > 0, F.floor(size * 8 / F.pow(F.lit(2.0), bits - 1)) % 8).otherwise(0)).cast("int")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size); one row per source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    k = F.row_number().over(by_name)
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    s = sizes.withColumn("weight", F.element_at(cycle, F.pmod(k - 1, F.lit(len(weights))) + 1))
    s = s.withColumn("cap", F.lit(float(most)) * F.col("source_size")).withColumn("cap_ratio", F.col("cap") / F.col("weight"))
    order = Window.orderBy("cap_ratio", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy())
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    s = s.withColumn("level", level)
    # The level of the first source that stays under its cap holds for all after it.
    s = s.withColumn("final", F.min(F.when(F.col("cap_ratio") > F.col("level"), F.struct("cap_ratio", "level"))).over(Window.partitionBy())["level"])
    return s.select("source", "source_size", F.when(F.col("final").isNull() | (F.col("cap") <= F.col("weight") * F.col("final")), F.col("cap")).otherwise(F.col("weight") * F.col("final")).alias("target"))


def _groups(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(_id, _source, _bytes, _text, size, n): rows alike in id, source and text, with their count; the one pass over texts."""
    key = [F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), F.octet_length(text_col).alias("_bytes"), F.xxhash64(text_col).alias("_text")]
    rows = docs.select(*key, word_count(text_col).alias("size"))
    return store.write_table(rows.groupBy("_id", "_source", "_bytes", "_text").agg(F.min("size").alias("size"), F.count(F.lit(1)).alias("n")), "sizes").df


def _placed(groups: DataFrame, seed: int) -> DataFrame:
    """``groups`` with source_size, target, rate, offset and the number of rows of the source that stand before."""
    h = text_hash(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_id").cast("string"), F.lit(""))))
    groups = groups.withColumns({"_class": size_class(F.col("size")), "_hash": h})
    counts = groups.groupBy("_source", "_class").agg(F.sum("n").alias("_rows"), F.sum(F.col("size") * F.col("n")).alias("_words"))
    targets = source_targets(counts.groupBy(F.col("_source").alias("source")).agg(F.sum("_words").alias("source_size")))
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    sized = counts.select(F.col("_source").alias("_ps"), F.col("_class").alias("_pc"), F.greatest(F.lit(1).cast("long"), F.ceil(F.col("_rows") / BLOCK_ROWS)).alias("_parts"))
    parted = groups.join(sized, same("_source", "_ps") & same("_class", "_pc")).withColumn("_part", F.pmod("_hash", "_parts").cast("int"))
    upto = Window.partitionBy("_source", "_class", "_part").orderBy("size", "_hash", "_id", "_bytes", "_text").rowsBetween(Window.unboundedPreceding, -1)
    parted = parted.withColumn("_in", F.coalesce(F.sum("n").over(upto), F.lit(0).cast("long")))
    blocks = parted.groupBy("_source", "_class", "_part").agg(F.sum("n").alias("_all"))
    before = Window.partitionBy("_source").orderBy("_class", "_part").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_all").over(before), F.lit(0).cast("long")))
    t = targets.select(F.col("source").alias("_ts"), F.col("source_size").alias("_tsize"), F.col("target").alias("_target"))
    blocks = blocks.join(t, same("_source", "_ts")).select(F.col("_source").alias("_bs"), F.col("_class").alias("_bc"), F.col("_part").alias("_bp"), "_before", "_tsize", "_target")
    rows = parted.join(blocks, same("_source", "_bs") & same("_class", "_bc") & same("_part", "_bp"))
    rate = F.when(F.col("_tsize") > 0, F.col("_target") / F.col("_tsize")).otherwise(F.lit(0.0))
    offset = F.pmod(text_hash(F.concat(F.lit(f"{seed}:offset:"), F.coalesce(F.col("_source"), F.lit("")))), F.lit(1024)) / F.lit(1024.0)
    return rows.select("_id", "_source", "_bytes", "_text", "size", "n", F.col("_tsize").alias("source_size"), F.col("_target").alias("target"), rate.alias("_rate"), offset.alias("_offset"), (F.col("_before") + F.col("_in")).alias("_first"))


def _crossed(k):
    """Whole numbers up to the ``k``-th row of a source."""
    return F.floor(F.col("_rate") * k + F.col("_offset"))


def _numbered(groups: DataFrame, count: str) -> DataFrame:
    """Each row ``count`` times, with _k from 1; in two steps, so that no array grows with a count."""
    steps = groups.withColumn("_step", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(count) - 1) / BLOCK_ROWS))))
    last = F.least(F.col(count) - F.col("_step") * BLOCK_ROWS, F.lit(BLOCK_ROWS).cast("long"))
    steps = steps.withColumn("_k", F.explode(F.sequence(F.lit(1).cast("long"), last)))
    return steps.withColumn("_k", F.col("_k") + F.col("_step") * BLOCK_ROWS).drop("_step")


def mix_sizes(docs: DataFrame, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, source, size, source_size, target, copies, taken) for each row of ``docs``: texts are read once and never moved."""
    rows = _numbered(_placed(_groups(docs, id_col, text_col, source_col), seed), "n")
    upto = F.col("_first") + F.col("_k")
    rows = rows.withColumn("copies", (_crossed(upto) - _crossed(upto - 1)).cast("int"))
    return rows.select(F.col("_id").alias(id_col), F.col("_source").alias(source_col), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def mix(docs: DataFrame, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", taken_only: bool = False) -> DataFrame:
    """``docs`` with columns size, source_size, target, copies and taken; columns of these names are replaced.

    ``taken_only`` leaves out rows without a copy, before their texts are joined.
    """
    own = ("size", "source_size", "target", "copies", "taken")
    keep = [c for c in docs.columns if c not in own]
    placed = _placed(_groups(docs, id_col, text_col, source_col), seed)
    end = F.col("_first") + F.col("n")
    if taken_only:
        placed = placed.filter(_crossed(end) > _crossed(F.col("_first")))
    placed = store.write_table(placed.withColumn("_group", F.xxhash64("_id", "_source", "_bytes", "_text")), "mix").df
    key = {"_kid": F.col(id_col), "_ks": F.col(source_col), "_kb": F.octet_length(text_col), "_kt": F.xxhash64(text_col)}
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    rows = docs.select(*keep, *[c.alias(n) for n, c in key.items()])
    # The slim side is built into hash tables; texts stream past it unsorted.
    rows = rows.join(placed.hint("shuffle_hash"), same("_kid", "_id") & same("_ks", "_source") & same("_kb", "_bytes") & same("_kt", "_text"))
    own_columns = [*keep, "size", "source_size", "target", "_rate", "_offset", "_first"]
    out = rows.filter("n = 1").select(*own_columns, F.lit(1).cast("long").alias("_k"))
    if not placed.filter("n > 1").isEmpty():
        # Rows of a group may differ in other columns: alike in all, they are counted; others are numbered by blocks.
        many = rows.filter("n > 1").withColumn("_sub", F.pmod(F.xxhash64(*keep), F.ceil(F.col("n") / BLOCK_ROWS)))
        many = many.groupBy(*own_columns, "_group", "_sub").agg(F.count(F.lit(1)).alias("_m"))
        block = Window.partitionBy("_group", "_first", "_sub").orderBy(F.xxhash64(*keep)).rowsBetween(Window.unboundedPreceding, -1)
        whole = many.groupBy("_group", "_first", "_sub").agg(F.sum("_m").alias("_all"))
        whole = whole.withColumn("_past", F.coalesce(F.sum("_all").over(Window.partitionBy("_group", "_first").orderBy("_sub").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")))
        many = many.withColumn("_at", F.coalesce(F.sum("_m").over(block), F.lit(0).cast("long"))).join(whole.drop("_all"), ["_group", "_first", "_sub"])
        many = _numbered(many, "_m").withColumn("_k", F.col("_k") + F.col("_at") + F.col("_past"))
        out = out.unionByName(many.select(*own_columns, "_k"))
    upto = F.col("_first") + F.col("_k")
    out = out.withColumn("copies", (_crossed(upto) - _crossed(upto - 1)).cast("int"))
    return out.select(*keep, "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def emit(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """Each row of ``mixed`` as often as it is taken."""
    return mixed.filter("copies > 0").select(*columns, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy")).select(*columns)
