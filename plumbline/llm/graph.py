"""Connected components and membership bitmaps, by Spark joins."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import store


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node in ``links``: one root per connected component.

    Each round sends a node to the smallest of itself and its neighbours and contracts the links; node
    ids are hashed for the order, so a chain shrinks by a constant share. Rounds are written tables.
    No links give an empty result; a node linked with itself only is its own root.
    """
    with store.scope():
        return _components(links, a, b)


def _components(links: DataFrame, a: str, b: str) -> DataFrame:
    key = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id"))
    edges = store.write_table(links.select(F.col(a).alias("u"), F.col(b).alias("v")).distinct(), "edges")
    nodes = edges.df.select(F.col("u").alias("node")).union(edges.df.select("v")).distinct()
    steps = []
    while not edges.df.isEmpty():
        both = edges.df.select("u", key("v").alias("k")).union(edges.df.select(F.col("v").alias("u"), key("u").alias("k")))
        near = both.groupBy("u").agg(F.min("k").alias("k")).select("u", F.least(key("u"), F.col("k"))["id"].alias("to"))
        step = store.write_table(near, "roots")
        steps.append(step)
        to = step.df
        e = edges.df.join(to.withColumnRenamed("to", "cu"), "u").join(to.select(F.col("u").alias("v"), F.col("to").alias("cv")), "v")
        edges = store.write_table(e.filter("cu <> cv").select(F.least("cu", "cv").alias("u"), F.greatest("cu", "cv").alias("v")).distinct(), "edges")
    out = nodes.withColumn("root", F.col("node"))
    for step in steps:
        to = step.df.select(F.col("u").alias("_from"), F.col("to").alias("_to"))
        out = out.join(to, out["root"] == to["_from"], "left").select("node", F.coalesce("_to", "root").alias("root"))
    return store.write_table(out, "components").keep().df


def bitmap(values: DataFrame, column: str, bits: int = 24) -> np.ndarray:
    """Bitmap of 2**bits positions (so of fixed size) with each value's leading bits set.

    A position may stand for several values: it is a superset.
    """
    word, bit = bits - 5, 5
    at = f"shiftrightunsigned({column}, {64 - bits})"
    rows = values.select(F.expr(f"cast(shiftright({at}, {bit}) as int) AS w"), F.expr(f"shiftleft(1L, cast({at} % 32 as int)) AS m")).groupBy("w").agg(F.bit_or("m").alias("m"))
    table = rows.toPandas()
    out = np.zeros(1 << word, np.uint32)
    out[table["w"].to_numpy(np.int64)] = table["m"].to_numpy(np.int64).astype(np.uint32)
    return out


def in_bitmap(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which uint64 values have their leading bits set."""
    bits = int(len(table)).bit_length() - 1 + 5
    at = values >> np.uint64(64 - bits)
    return (table[(at >> np.uint64(5)).astype(np.int64)] >> (at & np.uint64(31)).astype(np.uint32) & np.uint32(1)).astype(bool)
