"""Chunks, keywords, facts of papers, retrieval and page structure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.constants import CHUNK_STRIDE, CHUNK_WORDS, STOP_WORDS, TOP_PASSAGES

KEYWORD = r"[A-Za-z][A-Za-z\-]{2,}"
TERM = r"[\p{L}\p{N}_\-]{2,}"
# Terms that may be broadcast, and their longest length.
COMMON_TERMS = 1 << 19
COMMON_LENGTH = 64
# Patterns of facts in papers.
DOI = r"\b(10\.\d{4,9}/[-._;()/:A-Za-z0-9]+[A-Za-z0-9])"
YEARS = r"\b((?:19|20)\d{2})\s*(?:-|–|to|through|until)\s*((?:19|20)\d{2})\b"
QUANTITY = r"(?<![\w.])[-+]?\d+(?:[.,]\d+)?\s?(?:mm|cm|km|m|K|%|hPa|ppm|days?|years?|months?)(?![A-Za-z])"


def chunks(docs: DataFrame, doc: str = "doc_id", text: str = "text", size: int = CHUNK_WORDS, stride: int = CHUNK_STRIDE) -> DataFrame:
    """(doc, chunk, n_words, chunk_text): overlapping windows of words; a last window starts before the end."""
    w = F.filter(F.split(F.col(text), r"[ \t\n\x0B\f\r]+"), lambda x: x != "")
    d = docs.select(doc, w.alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("w") - 1), F.lit(stride))
    return d.select(doc, "w", F.posexplode(starts).alias("chunk", "s")).select(doc, "chunk", F.slice("w", F.col("s") + 1, size).alias("c")).select(doc, "chunk", F.size("c").alias("n_words"), F.array_join("c", " ").alias("chunk_text"))


def keywords(docs: DataFrame, text: str = "text", k: int = 25) -> DataFrame:
    """(word, n): the most frequent words that aren't stop words, ties in order of letters."""
    words = docs.select(F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"[a-z][a-z\-]{2,}"), F.lit(0))).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(~F.col("word").isin(*STOP_WORDS)).orderBy(F.desc("n"), "word").limit(k)


def mentions(pages: DataFrame, page: str, text: str, terms: list[str]) -> DataFrame:
    """(term, n_pages, first_page): pages whose text has the term as a word."""
    t = F.explode(F.filter(F.array(*[F.when(F.col(text).rlike(rf"(?i)\b{x}\b"), F.lit(x)) for x in terms]), lambda x: x.isNotNull()))
    return pages.select(F.col(page).alias("p"), t.alias("term")).groupBy("term").agg(F.count_distinct("p").alias("n_pages"), F.min("p").alias("first_page"))


def study_period(texts: DataFrame, text: str) -> DataFrame:
    """One row: first and last year of the year ranges, and how many there are."""
    a = F.regexp_extract_all(F.col(text), F.lit(YEARS), F.lit(1))
    b = F.regexp_extract_all(F.col(text), F.lit(YEARS), F.lit(2))
    y = texts.select(F.explode(F.arrays_zip(a.alias("a"), b.alias("b"))).alias("y")).select(F.col("y.a").cast("int").alias("a"), F.col("y.b").cast("int").alias("b")).filter("a <= b")
    return y.agg(F.min("a").alias("start_year"), F.max("b").alias("end_year"), F.count(F.lit(1)).alias("n"))


def quantities(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, quantity): numbers with units, as written."""
    return texts.select(key, F.explode(F.regexp_extract_all(F.col(text), F.lit(QUANTITY), F.lit(0))).alias("quantity"))


def postings(docs: DataFrame, doc: str, text: str, term: str = TERM) -> DataFrame:
    """(doc, terms): a row per document with its terms, each as often as it occurs.

    Texts are exchanged once by document, so rows of one document meet and what follows per document needs no exchange.
    """
    own = docs.select(doc, text).repartition(doc).groupBy(doc).agg(F.array_join(F.collect_list(text), " ").alias("text"))
    return own.select(doc, F.regexp_extract_all(F.lower("text"), F.lit(term), F.lit(0)).alias("terms"))


def term_counts(rows: DataFrame, doc: str, which: Column) -> DataFrame:
    """(doc, term, tf) from ``postings``: the lengths of runs of equal terms, of documents ``which`` holds for.

    Other documents get no array to sort; a filter would be pushed below and find the terms a second time.
    """
    t = F.col("terms")
    ends = F.filter(F.sequence(F.lit(1), F.size(t)), lambda i: (i == F.size(t)) | (F.get(t, i) != F.get(t, i - 1)))
    runs = rows.select(doc, F.when(which, F.sort_array("terms")).alias("terms")).select(doc, "terms", ends.alias("ends"))
    one = lambda e, j: F.struct(F.get("terms", e - 1).alias("term"), (e - F.coalesce(F.get("ends", j - 1), F.lit(0))).alias("tf"))
    return runs.select(doc, F.explode(F.transform("ends", one)).alias("x")).select(doc, "x.term", "x.tf").filter("term IS NOT NULL")


def search(docs: DataFrame, query: str, doc: str = "doc_id", text: str = "text", k: int = TOP_PASSAGES, term: str = TERM) -> DataFrame:
    """(doc, score): the most similar documents to the query's words with a score above 0.

    Weights are (1 + ln tf) * (ln((1 + n) / (1 + df)) + 1), of unit length per document. Only documents with a word of the query
    need their norms. Terms in at least one of ``COMMON_TERMS`` postings, so at most that many, are broadcast with their df; only
    postings of rarer terms are exchanged.
    """
    found = F.regexp_extract_all(F.lower(F.lit(query)), F.lit(term), F.lit(0))
    rows = postings(docs, doc, text, term)
    n = docs.agg(F.count(F.lit(1)).cast("double").alias("n"))
    df = rows.select(F.explode(F.filter(F.array_distinct("terms"), lambda x: x.isNotNull())).alias("term")).filter("term IS NOT NULL").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1.0
    total = df.agg(F.sum("df").alias("total"))
    least = F.when(F.length("term") <= COMMON_LENGTH, F.col("total").cast("double")).otherwise(float("inf"))
    weighed = df.crossJoin(F.broadcast(n)).select("term", "df", idf.alias("idf"))
    known = weighed.crossJoin(F.broadcast(total)).select("term", "idf", (F.col("df") * COMMON_TERMS >= least).alias("common"))
    q = docs.sparkSession.range(1).select(F.explode(found).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("qtf"))
    asked = weighed.join(F.broadcast(q), "term").select("term", ((1.0 + F.log("qtf")) * F.col("idf") * F.col("idf")).alias("qw"))
    hit = term_counts(rows, doc, F.arrays_overlap("terms", found)).withColumn("w", 1.0 + F.log("tf"))
    common = F.broadcast(known.filter("common").select("term", "idf"))
    near = hit.join(common, "term", "left").join(F.broadcast(asked), "term", "left").groupBy(doc).agg(F.sum(F.pow(F.col("w") * F.col("idf"), 2)).alias("square"), F.sum(F.col("w") * F.col("qw")).alias("dot"))
    rare = hit.join(common, "term", "left_anti").join(known.filter("NOT common"), "term").groupBy(doc).agg(F.sum(F.pow(F.col("w") * F.col("idf"), 2)).alias("square"), F.lit(None).cast("double").alias("dot"))
    both = near.unionByName(rare).groupBy(doc).agg((F.sum("dot") / F.sqrt(F.sum("square"))).alias("score"))
    return both.filter((F.col("score") > 0) & F.when(F.col("score").isNotNull(), F.col(doc).isNotNull())).orderBy(F.desc(F.round("score", 9)), doc).limit(k)


def vector_top(vectors: DataFrame, query: list[float], id_col: str, vec: str, k: int = TOP_PASSAGES) -> DataFrame:
    """(id, score): the largest inner products with a query vector."""
    q = F.array(*[F.lit(float(x)) for x in query])
    score = F.aggregate(F.zip_with(F.col(vec), q, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda a, x: a + x)
    return vectors.select(id_col, score.alias("score")).orderBy(F.desc("score"), id_col).limit(k)


def page_structure(pages: DataFrame, page: str = "page_id", html: str = "html") -> DataFrame:
    """(page, title, h1, n_paragraphs, n_links, lang) by patterns."""
    one = lambda p: F.regexp_extract(F.col(html), p, 1)
    return pages.select(page, one(r"(?is)<title[^>]*>(.*?)</title>").alias("title"), one(r"(?is)<h1[^>]*>(.*?)</h1>").alias("h1"), F.regexp_count(F.col(html), F.lit(r"(?i)<p[ >]")).cast("long").alias("n_paragraphs"), F.regexp_count(F.col(html), F.lit(r"(?i)<a ")).cast("long").alias("n_links"), one(r"(?i)<html[^>]*lang=\"([a-z]+)\"").alias("lang"))


def pack_pages(pages: DataFrame, doc: str, order: str, text: str, budget: int) -> DataFrame:
    """(doc, pack, n_pages, n_words): pages in order, a new pack where the next page would pass the budget of words.

    A greedy scan with state, so one fold over each document's ordered pages.
    """
    p = pages.select(doc, F.col(order).alias("o"), F.size(F.filter(F.split(F.col(text), r"\s+"), lambda x: x != "")).alias("n"))
    seq = p.groupBy(doc).agg(F.sort_array(F.collect_list(F.struct("o", "n"))).alias("x"))
    empty = F.array().cast("array<struct<pack:int,n:int>>")
    step = lambda a, x: F.concat(a, F.array(F.struct(F.when(F.size(a) == 0, F.lit(0)).when(F.element_at(a, -1)["n"] + x["n"] > budget, F.element_at(a, -1)["pack"] + 1).otherwise(F.element_at(a, -1)["pack"]).alias("pack"), F.when(F.size(a) == 0, x["n"]).when(F.element_at(a, -1)["n"] + x["n"] > budget, x["n"]).otherwise(F.element_at(a, -1)["n"] + x["n"]).alias("n"))))
    return seq.select(doc, F.explode(F.aggregate("x", empty, step)).alias("s")).groupBy(doc, F.col("s.pack").alias("pack")).agg(F.count(F.lit(1)).alias("n_pages"), F.max("s.n").cast("long").alias("n_words"))


def latest_turns(conv: DataFrame) -> DataFrame:
    """A row per role: turns, conversations and words."""
    return conv.groupBy("role").agg(F.count(F.lit(1)).alias("turns"), F.count_distinct("conv_id").alias("conversations"), F.sum(F.size(F.filter(F.split("text", r"[ \t\n\x0B\f\r]+"), lambda x: x != ""))).alias("words"))


def with_rank(df: DataFrame, *order) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("int"))
