"""Quality classifier: a sparse ensemble of rules over text statistics, scored as Spark columns.

Statistics are built-in expressions over the whole text, each a share or a mean, so that they don't
grow with its length. Shallow boosted trees are fitted to a bounded sample of labelled rows; the path to
every node is a rule, a conjunction of comparisons. A logistic model with an L1 penalty weighs the rules
and leaves most at zero. What remains compiles into one column expression; scoring runs no Python.

Null text counts as empty and is scored like any other. Labels: rows whose quality is 0 or 1; a document
with both counts as 0; null ids are left out. With no labels of one class the score is the share of
label 1 (1.0 with no labels at all). Score ties don't matter, repeated rows are scored alike, and columns
named as the outputs are replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_ROWS = 20_000
THRESHOLD = 0.7
HELD_OUT_OF, HELD_OUT = 4, 2


#: What is counted in a text, by name. Each is one scan of the text; statistics are ratios of these.
COUNTS = {
    "words": r"[^\x20\x09-\x0D]+",
    "upper": r"\p{Lu}",
    "symbols": r"[^\p{L}\p{N}\x20\x09-\x0D.,;:!?'\"()-]",
    "shouts": r"!",
    "stops": r"[.,;:?]",
    "digits": r"[0-9]",
    "repeats": r"(?<![^\x20\x09-\x0D])([^\x20\x09-\x0D]+)[\x20\x09-\x0D]+(?=\1(?![^\x20\x09-\x0D]))",
    "lines": r"\n",
    "sentences": r"[.?!][\x20\x09-\x0D]+\p{Lu}",
    "marked": r"[\p{L}\p{N}][.,;:!?]*[^\p{L}\p{N}\x20\x09-\x0D.,;:!?'\"()-]{2,}(?![^\x20\x09-\x0D])",
}


def counts(text: Column) -> Column:
    """A record with the code points of a text and all ``COUNTS`` in it; null counts as empty."""
    t = F.coalesce(text, F.lit(""))
    return F.struct(F.length(t).cast("double").alias("chars"), *[F.regexp_count(t, F.lit(p)).cast("double").alias(n) for n, p in COUNTS.items()])


def ratios(of: Column) -> dict[str, Column]:
    """Statistics by name from a record of ``counts``."""
    chars, words = F.greatest(of["chars"], F.lit(1.0)), F.greatest(of["words"], F.lit(1.0))
    return {
        "word_length": of["chars"] / words,
        "upper_share": of["upper"] / chars,
        "symbol_share": of["symbols"] / words,
        "shout_share": of["shouts"] / words,
        "stop_share": of["stops"] / words,
        "digit_share": of["digits"] / chars,
        "repeat_share": of["repeats"] / words,
        "line_share": of["lines"] / words,
        "sentence_share": of["sentences"] / words,
        "marked_share": of["marked"] / words,
    }


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a text column by name, as plain expressions."""
    return ratios(counts(text))


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, is above, threshold) with its weight."""

    terms: tuple[tuple[str, bool, float], ...]
    weight: float = 0.0

    def column(self) -> Column:
        return reduce(lambda a, b: a & b, ((F.col(s) > t) if above else (F.col(s) <= t) for s, above, t in self.terms))

    def holds(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        return np.logical_and.reduce([(x[:, names.index(s)] > t) if above else (x[:, names.index(s)] <= t) for s, above, t in self.terms])


@dataclass
class RuleModel:
    """Intercept and weighted rules; ``constant`` replaces them where nothing can be learnt."""

    intercept: float = 0.0
    rules: list[Rule] = field(default_factory=list)
    constant: float | None = None

    def column(self) -> Column:
        """The score from the columns of ``statistics``."""
        if self.constant is not None:
            return F.lit(float(self.constant))
        z = reduce(lambda a, b: a + b, (F.when(r.column(), F.lit(float(r.weight))).otherwise(F.lit(0.0)) for r in self.rules), F.lit(float(self.intercept)))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))

    def predict(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        """The same score in numpy."""
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-(self.intercept + sum((r.weight * r.holds(x, names) for r in self.rules), np.zeros(len(x))))))


def _tree_rules(x: np.ndarray, names: list[str], y: np.ndarray, trees: int, depth: int, bins: int, rate: float) -> list[tuple]:
    """The path to every node of boosted trees on the logistic loss."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    code = [np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)]
    z, paths = np.full(len(y), math.log((y.mean() + 1e-9) / (1 - y.mean() + 1e-9))), {}
    least = max(3, len(y) // 1000)
    rng = np.random.Generator(np.random.PCG64(7))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        # Each tree sees part of the rows and statistics, so that signs which few rows show get rules as well.
        use, seen = rng.random(len(y)) < 0.7, rng.random(len(cuts)) < 0.5
        nodes = [((), np.ones(len(y), bool))]
        for _ in range(depth):
            after = []
            for path, rows in nodes:
                best = (1e-9, None, None)
                own = rows & use
                for j, c in enumerate(cuts):
                    if not len(c) or not seen[j]:
                        continue
                    k = code[j][own]
                    n, a, b = (np.cumsum(np.bincount(k, w, len(c) + 1)) for w in (None, g[own], h[own]))
                    ok = (n[:-1] >= least) & (n[-1] - n[:-1] >= least)
                    gain = np.where(ok, a[:-1] ** 2 / (b[:-1] + 1) + (a[-1] - a[:-1]) ** 2 / (b[-1] - b[:-1] + 1) - a[-1] ** 2 / (b[-1] + 1), 0)
                    i = int(gain.argmax())
                    if gain[i] > best[0]:
                        best = (gain[i], j, float(c[i]))
                if best[1] is None:
                    after.append((path, rows))
                    continue
                for above in (False, True):
                    now = (*path, (names[best[1]], above, best[2]))
                    paths[tuple(sorted(now))] = True
                    after.append((now, rows & ((x[:, best[1]] > best[2]) == above)))
            nodes = after
        for _, rows in nodes:
            own = rows & use
            z[rows] += rate * g[own].sum() / (h[own].sum() + 1)
    return list(paths)


def _lasso_logistic(r: np.ndarray, y: np.ndarray, penalty: float, steps: int) -> tuple[np.ndarray, float]:
    """Accelerated proximal gradient on logistic loss + penalty * |w|; the intercept is free."""
    n, m = r.shape
    w, b, v, vb, t = np.zeros(m), 0.0, np.zeros(m), 0.0, 1.0
    size = 4.0 / (np.linalg.norm(r, 2) ** 2 / n + 1)
    for _ in range(steps):
        e = (1 / (1 + np.exp(-(r @ v + vb))) - y) / n
        new, nb = v - size * (r.T @ e), vb - size * e.sum()
        new = np.sign(new) * np.maximum(np.abs(new) - size * penalty, 0)
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v, vb = new + (t - 1) / t2 * (new - w), nb + (t - 1) / t2 * (nb - b)
        w, b, t = new, nb, t2
    return w, b


def fit_rules(x: np.ndarray, y: np.ndarray, names: list[str], trees: int = 80, depth: int = 2, bins: int = 48, penalty: float = 1e-3, steps: int = 800) -> RuleModel:
    """Fit on statistics ``x`` and labels ``y`` in memory."""
    if not len(y) or y.min() == y.max():
        return RuleModel(constant=float(y.mean()) if len(y) else 1.0)
    paths = _tree_rules(x, names, y, trees, depth, bins, 0.3)
    rules = [Rule(p) for p in paths]
    if not rules:
        return RuleModel(constant=float(y.mean()))
    w, b = _lasso_logistic(np.column_stack([r.holds(x, names) for r in rules]).astype(float), y, penalty, steps)
    return RuleModel(float(b), [Rule(r.terms, float(a)) for r, a in zip(rules, w) if abs(a) > 1e-6])


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % HELD_OUT_OF == HELD_OUT, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> RuleModel:
    """Fit on at most ``sample_rows`` labelled documents, chosen by a hash of their ids."""
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).cast("int").alias("_y"))
    sample = known.orderBy(F.xxhash64("_id"), "_id").limit(sample_rows)
    rows = docs.select(F.col(id_col).alias("_d"), F.col(text_col).alias("_t")).join(F.broadcast(sample), F.col("_d") == F.col("_id"))
    rows = rows.select("_id", "_y", counts(F.col("_t")).alias("_n"))
    stats = ratios(F.col("_n"))
    rows = rows.select("_id", "_y", *[c.alias(n) for n, c in stats.items()]).toPandas()
    rows = rows.sort_values(["_id", *stats], kind="stable")
    return fit_rules(rows[list(stats)].to_numpy(float), rows["_y"].to_numpy(float), list(stats))


def score(docs: DataFrame, model: RuleModel, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 from ``threshold`` on).

    Each text is counted once. The record of counts passes through a generator, which the optimizer moves
    no filter below: a filter on the result can't write the counts' expressions into every rule that uses them.
    """
    own = ("score", "predicted", "_counts", "_stats")
    keep = [c for c in docs.columns if c not in own]
    counted = docs.select(*keep, counts(F.col(text_col)).alias("_counts"))
    held = counted.select(*keep, F.explode(F.array("_counts")).alias("_counts"))
    stats = held.select(*keep, F.struct(*[c.alias(n) for n, c in ratios(F.col("_counts")).items()]).alias("_stats"))
    named = RuleModel(model.intercept, [Rule(tuple((f"_stats.{s}", a, t) for s, a, t in r.terms), r.weight) for r in model.rules], model.constant)
    out = stats.select(*keep, named.column().alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int"))
