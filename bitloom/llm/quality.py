"""Operator 7, quality: a sparse ensemble of conjunctive rules over text statistics, compiled into Spark columns.

Boosted shallow trees are fitted on a sample; every path from a root to a node is a rule (a conjunction of thresholds
on statistics). Lasso logistic regression weighs the rules and keeps few. The kept rules become one Column expression,
so scoring is native. The statistics are Column expressions over the whole text as well.

At most `PER_CLASS` labelled rows of each class are sampled. Labels, lang, source and doc_id are never inputs.
Edge cases: null and empty texts get the statistics of the empty text (zeros) and a score from them; without rows of
both classes the score is the share of label 1 (0 without labels); a row labelled twice takes its lowest label; ties
and repeats score alike; extra columns go.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import bounded_ids, id_crc, table

PER_CLASS, TREES, DEPTH, RATE, LAMBDA = 4000, 24, 3, 0.3, 2e-3

Rule = tuple[tuple[int, bool, float], ...]  # (statistic, above, threshold) for each condition


def statistics(text: str = "text") -> tuple[dict[str, Column], list[dict[str, Column]]]:
    """The statistics, and the intermediate columns under them, level by level."""
    t = F.coalesce(F.col(text), F.lit(""))
    levels = [
        {"_t": t},
        {"_words": F.filter(F.split("_t", "[ \t\r\n\f\x0b]+"), lambda w: w != ""), "_lines": F.filter(F.split("_t", "\n"), lambda x: F.trim(x) != ""), "_n": F.greatest(F.length("_t"), F.lit(1)).cast("double"), "_plain": F.regexp_replace("_t", r"[\p{L}\s]+", "")},
        {"_nw": F.greatest(F.size("_words"), F.lit(1)).cast("double"), "_nl": F.greatest(F.size("_lines"), F.lit(1)).cast("double"), "_np": F.length("_plain").cast("double")},
    ]
    gone = lambda col, chars: F.length(F.translate(F.col(col), chars, ""))
    repeated = F.aggregate("_words", F.struct(F.lit("").alias("w"), F.lit(0).alias("n")), lambda a, w: F.struct(w.alias("w"), (a["n"] + (w == a["w"]).cast("int")).alias("n")), lambda a: a["n"])
    stats = {
        "log_chars": F.log1p(F.length("_t").cast("double")),
        "log_words": F.log1p(F.size("_words").cast("double")),
        "word_chars": F.length("_t") / F.col("_nw"),
        "line_words": F.col("_nw") / F.col("_nl"),
        "distinct_words": F.size(F.array_distinct("_words")) / F.col("_nw"),
        "richness": F.log1p(F.size(F.array_distinct("_words")).cast("double")) / F.log1p(F.col("_nw")),
        "distinct_lines": F.size(F.array_distinct("_lines")) / F.col("_nl"),
        "repeated_words": repeated / F.col("_nw"),
        "upper": F.length(F.regexp_replace("_t", r"\P{Lu}+", "")) / F.col("_n"),
        "plain": F.col("_np") / F.col("_n"),
        "digits": (F.col("_np") - gone("_plain", "0123456789")) / F.col("_n"),
        "stops": (F.col("_np") - gone("_plain", ".?!")) / F.col("_nw"),
        "commas": (F.col("_np") - gone("_plain", ",;:")) / F.col("_nw"),
        "bangs": (F.col("_np") - gone("_plain", "!?*#$%&@")) / F.col("_nw"),
        "bars": (F.col("_np") - gone("_plain", "|/\\<>{}[]=_")) / F.col("_nw"),
    }
    return stats, levels


NAMES = ["log_chars", "log_words", "word_chars", "line_words", "distinct_words", "richness", "distinct_lines", "repeated_words", "upper", "plain", "digits", "stops", "commas", "bangs", "bars"]


def with_statistics(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` and the statistics of each whole text."""
    stats, levels = statistics()
    out = docs.select(*keep, "text")
    for level in levels:
        out = out.select("*", *[c.alias(n) for n, c in level.items()])
    return out.select(*keep, *[c.cast("double").alias(n) for n, c in stats.items()])


class Tree:
    """A regression tree on binned statistics; paths() are its rules."""

    def __init__(self, bins: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray, depth: int):
        self.rules: list[tuple[Rule, float]] = []
        self.out = np.zeros(len(g))
        self._grow(bins, edges, g, h, np.arange(len(g)), depth, ())

    def _grow(self, bins, edges, g, h, rows, depth, path):
        value = -g[rows].sum() / (h[rows].sum() + 1.0)
        if path:
            self.rules.append((path, value))
        best = None
        if depth and len(rows) >= 20:
            total_g, total_h = g[rows].sum(), h[rows].sum()
            for f, cut in enumerate(edges):
                if not len(cut):
                    continue
                gs = np.cumsum(np.bincount(bins[rows, f], weights=g[rows], minlength=len(cut) + 1))[:-1]
                hs = np.cumsum(np.bincount(bins[rows, f], weights=h[rows], minlength=len(cut) + 1))[:-1]
                gain = gs**2 / (hs + 1) + (total_g - gs) ** 2 / (total_h - hs + 1) - total_g**2 / (total_h + 1)
                gain[(hs < 1) | (total_h - hs < 1)] = -1
                k = int(gain.argmax())
                if gain[k] > 1e-3 and (best is None or gain[k] > best[0]):
                    best = (gain[k], f, k)
        if best is None:
            self.out[rows] = value
            return
        _, f, k = best
        above = bins[rows, f] > k
        for side in (False, True):
            self._grow(bins, edges, g, h, rows[above == side], depth - 1, (*path, (f, side, float(edges[f][k]))))


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    return np.logical_and.reduce([(x[:, f] > at) == above for f, above, at in rule])


def lasso(a: np.ndarray, y: np.ndarray, weight: np.ndarray, lam: float, rounds: int = 600) -> tuple[float, np.ndarray]:
    """Logistic regression with an L1 penalty on all weights but the intercept (FISTA)."""
    n, k = a.shape
    a1 = np.c_[np.ones(n), a]
    v = np.ones(k + 1)
    for _ in range(30):
        v = a1.T @ (weight * (a1 @ v))
        v /= np.linalg.norm(v)
    step = 4 / max(1e-9, float(v @ (a1.T @ (weight * (a1 @ v)))))
    w = z = np.zeros(k + 1)
    t = 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a1 @ z, -30, 30)))
        u = z - step * (a1.T @ (weight * (p - y)))
        new = np.sign(u) * np.maximum(np.abs(u) - step * lam, 0)
        new[0] = u[0]
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return float(w[0]), w[1:]


class Model:
    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.rules: list[Rule] = []
        self.weights = np.zeros(0)
        share = float(y.mean()) if len(y) else 0.0
        self.bias = float(np.log((share + 1e-9) / (1 - share + 1e-9)))
        if not 0 < share < 1:
            return
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, 66)[1:-1], method="lower")) for f in range(x.shape[1])]
        bins = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1)
        weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)) / len(y)
        score, rules = np.zeros(len(y)), {}
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-score))
            tree = Tree(bins, edges, weight * (p - y) * len(y), weight * p * (1 - p) * len(y) + 1e-6, DEPTH)
            score += RATE * tree.out
            rules.update((tuple(sorted(r)), v) for r, v in tree.rules)
        a = {}
        for r in rules:  # rules that hold for the same rows are one
            column = holds(r, x)
            if 0 < column.sum() < len(y):
                a.setdefault(column.tobytes(), (r, column))
        own = list(a.values())
        matrix = np.stack([c for _, c in own], axis=1).astype(float)
        self.bias, w = lasso(matrix, y, weight, LAMBDA)
        keep = np.flatnonzero(np.abs(w) > 1e-6)
        self.rules, self.weights = [own[i][0] for i in keep], w[keep]

    def column(self, names: list[str] = NAMES) -> Column:
        """The score as a Spark column over the statistics."""
        terms = [F.when(reduce(lambda p, q: p & q, [(F.col(names[f]) > at) if above else (F.col(names[f]) <= at) for f, above, at in r]), F.lit(float(w))).otherwise(F.lit(0.0)) for r, w in zip(self.rules, self.weights)]
        z = reduce(lambda p, q: p + q, terms, F.lit(self.bias))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.lit(-60.0), F.least(F.lit(60.0), z))))

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.bias + sum((holds(r, x) * w for r, w in zip(self.rules, self.weights)), np.zeros(len(x)))
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def sample(docs: DataFrame, labels: DataFrame, held_out: int = 2, per_class: int = PER_CLASS) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of at most `per_class` labelled rows of each class."""
    known = labels.where(F.col("quality").isNotNull() & (id_crc("doc_id", 4) != held_out)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    ids = bounded_ids(known.where("doc_id is not null"), per_class, "quality", 31)
    # of rows that repeat an id the least text: as many rows as ids, whatever the table holds
    own = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    rows = sorted(tuple(r) for r in with_statistics(own, ("quality",)).collect())
    return np.array([r[1:] for r in rows], float).reshape(-1, len(NAMES)), np.array([r[0] == 1 for r in rows], float)


def score(docs: DataFrame, model: Model) -> DataFrame:
    return with_statistics(docs).select("doc_id", model.column().alias("score"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "quality")
    return score(docs, Model(*sample(docs, labels))).select("doc_id", (id_crc("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
