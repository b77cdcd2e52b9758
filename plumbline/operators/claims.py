"""Written claims against computed facts, as one expression over a table of claims and a table of facts.

A sentence becomes an array of tokens; each number among them is typed by its neighbours: a bound (after a
comparison sign), a level (90, 95 or 99 beside a word such as confidence), a share (with a percent sign) or a
plain value. The facts of one report stand in one broadcast row, so that a claim meets its own fact by path and
its pool of related facts by ``exists``. All of it stays in the JVM.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# How far a written number may be from its fact, and the limits of a table of facts.
RELATIVE = 0.005
SIGNIFICANT = 0.05
MOST_FACTS, LONGEST_LIST, LONGEST_TEXT = 400, 8, 80
COMMON = ("coverage", "summary")

NUMBER = r"(?<![\w.])[-+\u2212]?\d[\d,]*(?:\.\d+)?(?:[eE][-+]?\d+)?\s?%?"
TOKENS = rf"[<>\u2264\u2265]|[A-Za-z_]\w*|{NUMBER}"
LEVEL_WORD = r"^(?:confiden|significan|level|percentile)"
DENIAL = r"(?i)\bn(?:ot|o|on)\b\W+(?:\w+\W+)?(?:significan|robust|clear)|\binsignifican|\bnonsignifican"


def _number(raw: Column) -> Column:
    """A record of a written number: value, slack (half a unit of its last digit, or half a percent) and share."""
    plain = F.regexp_replace(F.regexp_replace(raw, "\u2212", "-"), r"[,%\s]", "")
    value = plain.try_cast("double")
    digits = F.length(F.regexp_extract(plain, r"\.(\d+)", 1))
    power = F.coalesce(F.regexp_extract(plain, r"[eE]([-+]?\d+)$", 1).try_cast("int"), F.lit(0))
    slack = F.greatest(0.5 * F.pow(F.lit(10.0), power - digits), RELATIVE * F.abs(value), F.lit(1e-12))
    return F.struct(value.alias("value"), slack.alias("slack"), raw.endswith("%").alias("share"))


def written_numbers(text: Column) -> Column:
    """Records of the numbers that a sentence claims: neither bounds nor levels."""
    tokens = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKENS), F.lit(0))
    near = lambda i, at: F.lower(F.coalesce(F.get(tokens, i + at), F.lit("")))

    def typed(token: Column, i: Column) -> Column:
        beside = near(i, -3).rlike(LEVEL_WORD) | near(i, -2).rlike(LEVEL_WORD) | near(i, -1).rlike(LEVEL_WORD) | near(i, 1).rlike(LEVEL_WORD)
        level = F.regexp_replace(token, r"[%\s]", "").isin("90", "95", "99") & beside
        stated = token.rlike(r"\d") & ~token.rlike(r"^[A-Za-z_]") & ~near(i, -1).isin("<", ">", "\u2264", "\u2265") & ~level
        return F.when(stated, _number(F.regexp_replace(token, r"\s", "")))

    return F.filter(F.transform(tokens, typed), lambda x: x["value"].isNotNull())


def _agrees(number: Column, target: Column) -> Column:
    """Within the slack; a number with a percent sign may state a share."""
    gap = lambda t: F.abs(number["value"] - t) <= number["slack"]
    return F.coalesce(gap(target) | (number["share"] & (F.abs(target) <= 1) & gap(100.0 * target)), F.lit(False))


def verify(claims: DataFrame, facts: DataFrame) -> DataFrame:
    """``claims`` (text, value, fact) with status, by ``facts`` (path, value).

    With a fact: unsupported if there is none of that path or a number of the text has no support; mismatch if
    the value differs from it, or the text and a trend's p-value disagree about significance; else verified.
    Without: qualitative if the text has no number; verified if facts that it names support all; else unsupported.
    A null text has no numbers. Facts that aren't numbers count by their path only.
    """
    parts = F.split("path", r"\.")
    fact_rows = facts.select(F.struct(F.col("path"), F.lower(F.get(parts, F.lit(1))).alias("name"), F.concat_ws(".", F.slice(parts, 1, 2)).alias("stem"), F.get(parts, F.lit(0)).isin(*COMMON).alias("common"), F.col("value").cast("double").alias("value")).alias("f"))
    pool = fact_rows.agg(F.collect_list("f").alias("_pool"))
    c = claims.crossJoin(F.broadcast(pool)).withColumns({"_numbers": written_numbers(F.col("text")), "_fact": F.nullif(F.col("fact"), F.lit(""))})
    stem = F.concat_ws(".", F.slice(F.split("_fact", r"\."), 1, 2))
    own = F.filter("_pool", lambda f: f["path"] == F.col("_fact"))
    target = F.get(own, F.lit(0))["value"]
    p = F.get(F.filter("_pool", lambda f: f["path"] == F.concat(stem, F.lit(".mk_p"))), F.lit(0))["value"]
    related = F.filter("_pool", lambda f: f["common"] | (f["path"] == F.col("_fact")) | (f["stem"] == stem))
    named = F.filter("_pool", lambda f: F.coalesce(F.contains(F.lower("text"), f["name"]), F.lit(False)))
    supported = lambda facts: F.forall("_numbers", lambda n: F.exists(facts, lambda f: _agrees(n, f["value"])))
    denies = F.coalesce(F.col("text").rlike(DENIAL), F.lit(False))
    status = (
        F.when(F.col("_fact").isNull() & (F.size("_numbers") == 0), "qualitative")
        .when(F.col("_fact").isNull(), F.when((F.size(named) > 0) & supported(F.filter("_pool", lambda f: f["common"] | F.coalesce(F.contains(F.lower("text"), f["name"]), F.lit(False)))), "verified").otherwise("unsupported"))
        .when(F.size(own) == 0, "unsupported")
        .when(F.col("value").isNotNull() & ~F.isnan(F.col("value").cast("double")) & ~_agrees(_number(F.col("value").cast("double").cast("string")), target), "mismatch")
        .when(~supported(related), "unsupported")
        .when(F.col("_fact").startswith("trends.") & p.isNotNull() & (denies == (p < SIGNIFICANT)), "mismatch")
        .otherwise("verified")
    )
    return c.withColumn("status", status).drop("_pool", "_numbers", "_fact")


def tally(judged: DataFrame, status: str = "status") -> DataFrame:
    """(status, n)."""
    return judged.groupBy(status).agg(F.count(F.lit(1)).alias("n"))


def find_quotes(quotes: DataFrame, pages: DataFrame, text: str = "text") -> DataFrame:
    """``quotes`` (quote, page) with found_page: the page, or a neighbour of it, whose text has the quote's words.

    An equi-join on the page and both neighbours; white space and case don't matter. Null where none has it.
    """
    plain = lambda c: F.trim(F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]+", " ")))
    near = quotes.select(plain(F.col("quote")).alias("_w"), "page", F.explode(F.array(*[F.col("page") + i for i in (0, -1, 1)])).alias("_p"))
    held = pages.select(F.col("page").alias("_p"), plain(F.col(text)).alias("_t"))
    hit = near.join(held, "_p").filter((F.col("_w") != "") & F.contains(F.concat(F.lit(" "), F.col("_t"), F.lit(" ")), F.concat(F.lit(" "), F.col("_w"), F.lit(" "))))
    best = hit.groupBy("_w", "page").agg(F.min_by("_p", F.struct(F.abs(F.col("_p") - F.col("page")), F.col("_p"))).alias("found_page"))
    out = quotes.withColumn("_w", plain(F.col("quote")))
    return out.join(best, ["_w", "page"], "left").select(*quotes.columns, "found_page")


def verify_paper(said: DataFrame, pages: DataFrame) -> DataFrame:
    """``said`` (text, quote, page) with found_page and status.

    unsupported without a quote on the page or beside it; mismatch if the text has a number that the quote lacks; else verified.
    """
    found = find_quotes(said, pages)
    lacking = F.exists(written_numbers(F.col("text")), lambda n: ~F.exists(written_numbers(F.col("quote")), lambda m: _agrees(n, m["value"])))
    return found.withColumn("status", F.when(F.col("found_page").isNull(), "unsupported").when(lacking, "mismatch").otherwise("verified"))


def problems(judged: DataFrame) -> DataFrame:
    """(text, problem) of the claims that aren't verified, for a review."""
    return judged.filter(~F.col("status").isin("verified", "qualitative")).select("text", F.concat(F.col("status"), F.lit(": "), F.col("text")).alias("problem"))


def valid_boxes(boxes: DataFrame) -> DataFrame:
    """``boxes`` (x, y, w, h as shares of a picture) with valid: all inside, with an area."""
    inside = (F.col("x") >= 0) & (F.col("y") >= 0) & (F.col("w") > 0) & (F.col("h") > 0) & (F.col("x") + F.col("w") <= 1) & (F.col("y") + F.col("h") <= 1)
    return boxes.withColumn("valid", F.coalesce(inside, F.lit(False)))


def scores(results: DataFrame) -> DataFrame:
    """(case, n, passed, score): the share of each case's checks that passed, from rows (case, check, passed)."""
    return results.groupBy("case").agg(F.count(F.lit(1)).alias("n"), F.count_if("passed").alias("passed"), F.round(F.avg(F.col("passed").cast("double")), 4).alias("score"))


def facts_table(spark: SparkSession, tree: dict, most: int = MOST_FACTS) -> DataFrame:
    """(path, value, text) of a nested result, in order, ``most`` at most; see ``fact_paths``."""
    number = lambda v: float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else None
    rows = [(k, number(v), str(v)) for k, v in fact_paths(tree, most).items()]
    return spark.createDataFrame(rows, "path string, value double, text string")


def fact_paths(tree: dict, most: int = MOST_FACTS) -> dict:
    """Dotted path -> scalar. Short lists of numbers count by position; other lists and long texts are left out."""
    out: dict = {}
    waiting = [("", tree)]
    while waiting and len(out) < most:
        path, x = waiting.pop()
        inner = None
        if isinstance(x, dict):
            inner = [(f"{path}.{k}" if path else str(k), v) for k, v in x.items()]
        elif isinstance(x, (list, tuple)):
            short = len(x) <= LONGEST_LIST and all(isinstance(v, (int, float)) for v in x)
            inner = [(f"{path}.{i}", v) for i, v in enumerate(x)] if short else []
        if inner is not None:
            waiting += reversed(inner)
        elif isinstance(x, str) and len(x) <= LONGEST_TEXT or isinstance(x, int) or isinstance(x, float) and x - x == 0:
            out[path] = x
    return out


_TRAILING = re.compile(r'("(?:\\.|[^"\\])*")|,(?=\s*[}\]])')


def loose_json(text: str | None) -> dict | None:
    """The first JSON object in a reply, whatever stands around it; commas before a closing bracket are forgiven."""
    clean = _TRAILING.sub(lambda m: m[1] or "", text or "")
    read = json.JSONDecoder()
    for m in re.finditer(r"\{", clean):
        try:
            return read.raw_decode(clean, m.start())[0]
        except ValueError:
            continue
    return None
