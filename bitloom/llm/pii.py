"""Operator 8, PII, in DataFrame functions only: base spans by pattern, and secrets by weak supervision.

Base kinds (email, ip, card, phone) are found by patterns and checks and always stay. Further candidates, long runs of
letters and digits, are voted on by labelers (shape pattern, gazetteer of words before, context characters, mix of
digits). Expectation-maximisation over the counts of all vote patterns of the whole table estimates each labeler's
reliability without labels; the posteriors then train a logistic span classifier on the votes and the span's own
features, which is compiled into a Column. Only the table of patterns and features (bounded by their number, not by the
data) reaches the driver.

Positions are code points, ends exclusive. They follow from the lengths of what `split` leaves between the matches that
`regexp_extract_all` gives; the patterns are written so that both need linear time and no deep recursion: groups are
possessive and a match can't begin inside a run that failed (\\G keeps the places just behind a match).

Edge cases: null and empty texts have no spans, empty span lists, and the hash of the empty string; equal texts give
equal spans; without candidates no secret is found; extra columns go, or stay in `redact`.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import table

KINDS = ("email", "ip", "card", "phone", "secret")
LOCAL = "[A-Za-z0-9._%+-]"
EMAIL = rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
RUN = "[A-Za-z0-9_/+-]"
SECRET = rf"(?<!{RUN})(?=[A-Za-z_/+-]*+[0-9])(?=[0-9_/+-]*+[A-Za-z]){RUN}{{16,}}+"
PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
WORDS = "passw|token|secret|apikey|api_key|api-key|_key|auth|bearer|credential|private"
OTHERS = "isbn|issn|commit|sha1|sha256|md5|checksum|version|http|www"
VOTERS = ("pattern", "gazetteer", "context", "mix")
EDGES = (20, 28, 40)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a value once: a lambda's variable is computed before the body, however often that names it."""
    return F.transform(F.array(value), body).getItem(0)


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0), lambda x, y: x + y)


def _matches(t: Column, pattern: str, guard: Column, more: Callable[[Column, Column, Column], list[Column]] | None = None) -> Column:
    """Array of (s, e, m, further columns) for the matches of a pattern, left to right. more: gets the match and what lies before and after it."""
    p = F.lit(pattern)
    block = 64  # starts come from block sums, so that many matches don't cost their square

    def found(x: Column) -> Column:
        return let(F.struct(x["m"].alias("m"), x["p"].alias("p"), F.zip_with(F.slice(x["p"], F.lit(1), F.size(x["m"])), x["m"], lambda a, b: F.length(a) + F.length(b)).alias("w")), blocks)

    def blocks(x: Column) -> Column:
        sums = F.transform(F.sequence(F.lit(0), F.floor(F.size(x["m"]) / block).cast("int")), lambda b: _total(F.slice(x["w"], F.lit(1), b * block)))
        return let(F.struct(x["m"].alias("m"), x["p"].alias("p"), x["w"].alias("w"), sums.alias("b")), spans)

    def spans(x: Column) -> Column:
        def one(m: Column, i: Column) -> Column:
            k = F.floor(i / block).cast("int")
            before, after = F.get(x["p"], i), F.get(x["p"], i + 1)
            start = F.get(x["b"], k) + _total(F.slice(x["w"], k * block + 1, i - k * block)) + F.length(before)
            further = more(m, before, after) if more else []
            return let(start, lambda s: F.struct(s.alias("s"), (s + F.length(m)).alias("e"), m.alias("m"), *further))

        return F.transform(x["m"], one)

    pair = F.when(guard, F.struct(F.regexp_extract_all(t, p, F.lit(0)).alias("m"), F.split(t, pattern, -1).alias("p"))).otherwise(F.struct(F.array().cast("array<string>").alias("m"), F.array(F.lit("")).alias("p")))
    return let(pair, found)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]+", "")


def _luhn(m: Column) -> Column:
    """12 to 19 digits that pass the check: padded to 20, every odd place from the left is doubled, as `translate` does with its cross sum."""
    def check(d: Column) -> Column:
        pad = F.lpad(d, 20, "0")
        twice = F.translate(pad, "0123456789", "0246813579")
        total = F.aggregate(F.sequence(F.lit(1), F.lit(20)), F.lit(0), lambda a, i: a + F.when(i % 2 == 1, F.substring(twice, i, F.lit(1))).otherwise(F.substring(pad, i, F.lit(1))).cast("int"))
        return F.when(F.length(d).between(12, 19), total % 10 == 0).otherwise(F.lit(False))

    return let(_digits(m), check)


def _kind(spans: Column, k: int) -> Column:
    return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e")))


def base_spans(t: Column) -> Column:
    """Struct of the four arrays of (s, k, e)."""
    ip = rf"^{PART}(?:\.{PART}){{3}}$"
    return F.struct(
        _kind(_matches(t, EMAIL, F.contains(t, F.lit("@"))), 0).alias("email"),
        _kind(F.filter(_matches(t, IP, t.rlike(r"[0-9]\.[0-9]")), lambda x: x["m"].rlike(ip)), 1).alias("ip"),
        _kind(F.filter(_matches(t, CARD, t.rlike(r"[0-9](?:[\x20-]?[0-9]){11}")), lambda x: _luhn(x["m"])), 2).alias("card"),
        _kind(F.filter(_matches(t, PHONE, F.contains(t, F.lit("+"))), lambda x: F.length(_digits(x["m"])).between(9, 15)), 3).alias("phone"),
    )


def _votes(m: Column, before: Column, after: Column) -> list[Column]:
    """Votes (1 yes, 2 no, 0 abstain) and own features of a candidate."""
    near = F.lower(F.substring(before, -24, 24))
    last = F.substring(before, -1, 1)
    share = F.length(_digits(m)) / F.length(m)
    pattern = F.when(m.rlike("^(?:AKIA[0-9A-Z]{16}|[0-9a-f]{16,}|gh[ps]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9]{16,})$"), 1).when(m.rlike("[/+-].*[/+-]|^[A-Za-z]+[0-9]{1,4}$"), 2).otherwise(0)
    gazetteer = F.when(near.rlike(WORDS) | m.rlike("^AKIA"), 1).when(near.rlike(OTHERS), 2).otherwise(0)
    context = F.when(last.rlike("[=:\"'`]"), 1).when(last.rlike("[./@#&?]") | F.substring(after, 1, 1).rlike("[@.][A-Za-z]?"), 2).otherwise(0)
    mix = F.when(share.between(0.2, 0.9), 1).when(share < 0.1, 2).otherwise(0)
    length = reduce(lambda a, e: a + (F.length(m) >= e).cast("int"), EDGES, F.lit(0))
    case = F.when(m.rlike("[a-z]") & m.rlike("[A-Z]"), 2).when(m.rlike("[A-Z]"), 1).otherwise(0)
    return [F.concat(*[x.cast("string") for x in (pattern, gazetteer, context, mix)]).alias("v"), length.alias("l"), case.alias("c"), (last == '"').cast("int").alias("q")]


def candidates(t: Column) -> Column:
    return _matches(t, SECRET, t.rlike("[0-9]"), _votes)


class Classifier:
    """Reliabilities by expectation-maximisation, then logistic weights. counts: ((votes, length, case, quote), n) for each pattern."""

    def __init__(self, counts: list[tuple[tuple[str, int, int, int], int]], rounds: int = 100):
        self.weights: dict[tuple[str, str], float] = {}
        self.bias = -1.0
        if not counts:
            return
        # a weak belief beside the data: no vote or only votes against speak against a span; it decides where all candidates are alike
        total = sum(c for _, c in counts)
        prior = [(("0000", 0, 0, 0), 0.02 * total + 1), (("2222", 0, 0, 0), 0.02 * total + 1)]
        counts = sorted(counts) + prior
        votes = np.array([[int(c) for c in key[0]] for key, _ in counts])
        n = np.array([float(c) for _, c in counts])
        # first guess: the labelers' majority; then prior and confusion tables, smoothed, and posteriors in turn
        post = np.clip(0.5 + 0.2 * ((votes == 1).sum(1) - (votes == 2).sum(1)), 0.02, 0.98)
        for _ in range(rounds):
            like = np.zeros((len(n), 2))
            for c, p in enumerate((1 - post, post)):
                like[:, c] = np.log((n * p).sum() + 1)
                for j in range(votes.shape[1]):
                    rate = np.bincount(votes[:, j], weights=n * p, minlength=3) + np.array([0.5, 1.0 if c else 0.2, 0.2 if c else 1.0])
                    like[:, c] += np.log(rate / rate.sum())[votes[:, j]]
            post = 1 / (1 + np.exp(np.clip(like[:, 0] - like[:, 1], -30, 30)))
            post[-len(prior) :] = 0.0
        self.reliability = {VOTERS[j]: float((n * post * (votes[:, j] == 1)).sum() / max(1e-9, (n * post).sum())) for j in range(votes.shape[1])}
        names = self.features()
        x = np.array([[self.holds(key, f) for f in names] for key, _ in counts], float)
        x = np.c_[np.ones(len(x)), x]
        w = np.zeros(x.shape[1])
        share = n / n.sum()
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            g = x.T @ (share * (p - post)) + 1e-3 * np.r_[0, w[1:]]
            h = (x * (share * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(w))
            w -= np.clip(np.linalg.solve(h, g), -4, 4)
        self.bias, self.weights = float(w[0]), dict(zip(names, w[1:].tolist()))

    @staticmethod
    def features() -> list[tuple[str, str]]:
        return [(v, c) for v in VOTERS for c in "12"] + [("l", str(k)) for k in range(1, len(EDGES) + 1)] + [("c", "1"), ("c", "2"), ("q", "1")]

    @staticmethod
    def holds(key: tuple[str, int, int, int], f: tuple[str, str]) -> bool:
        name, want = f
        return (key[0][VOTERS.index(name)] if name in VOTERS else str(key[1 + "lcq".index(name)])) == want

    def accepts(self, x: Column) -> Column:
        """Whether a candidate (struct of v, l, c, q) is personal."""
        z = F.lit(self.bias)
        for (name, want), w in self.weights.items():
            value = F.substring(x["v"], VOTERS.index(name) + 1, 1) if name in VOTERS else x[name].cast("string")
            z = z + F.when(value == want, F.lit(w)).otherwise(F.lit(0.0))
        return z > 0


def fit(docs: DataFrame) -> Classifier:
    """Counts of the vote patterns over the whole table; at most 81 x 4 x 3 x 2 rows come to the driver."""
    each = docs.select(F.explode(candidates(F.coalesce(F.col("text"), F.lit("")))).alias("x"))
    counts = each.groupBy("x.v", "x.l", "x.c", "x.q").count().collect()
    return Classifier([((r.v, r.l, r.c, r.q), r["count"]) for r in counts])


def spans(t: Column, model: Classifier) -> Column:
    """Struct of the base arrays and of `secret`, all (s, k, e)."""
    secret = _kind(F.filter(candidates(t), model.accepts), 4)
    return let(base_spans(t), lambda b: F.struct(*[b[k].alias(k) for k in KINDS[:4]], secret.alias("secret")))


def _joined(arrays: list[Column]) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(F.concat(*arrays)), lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def find(docs: DataFrame, model: Classifier) -> DataFrame:
    """The digest row of each whole text."""
    found = docs.select("doc_id", spans(F.coalesce(F.col("text"), F.lit("")), model).alias("x"))
    row = let(F.col("x"), lambda x: F.struct(*[F.size(x[k]).cast("bigint").alias(f"n_{k}") for k in KINDS], F.sha2(F.encode(_joined([x[k] for k in KINDS[:4]]), "utf-8"), 256).alias("base_sha256"), _joined([x[k] for k in KINDS]).alias("spans"), reduce(lambda a, k: a + F.size(x[k]), KINDS[1:], F.size(x[KINDS[0]])).cast("bigint").alias("n_spans")))
    return found.select("doc_id", row.alias("r")).select("doc_id", "r.n_email", "r.n_ip", "r.n_card", "r.n_phone", "r.base_sha256", "r.spans", "r.n_secret", "r.n_spans")


def redacted(t: Column, model: Classifier) -> Column:
    """The text with each span, overlapping ones merged, replaced by [KIND]."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def put(x: Column) -> Column:
        def step(a: Column, s: Column) -> Column:
            fresh = s["s"] >= a["at"]
            return F.struct(F.greatest(a["at"], s["e"]).alias("at"), F.when(fresh, F.concat(a["out"], F.substring(x["t"], a["at"] + 1, s["s"] - a["at"]), F.get(names, s["k"]))).otherwise(a["out"]).alias("out"))

        return F.aggregate(x["s"], F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda a: F.concat(a["out"], F.substring(x["t"], a["at"] + 1, F.length(x["t"]))))

    every = let(spans(t, model), lambda x: F.array_sort(F.concat(*[x[k] for k in KINDS])))
    return let(F.struct(t.alias("t"), every.alias("s")), put)


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns, personal spans of the text replaced; a null text stays null."""
    model = fit(docs.select(F.col(text).alias("text")))
    return docs.withColumn(text, F.when(F.col(text).isNotNull(), redacted(F.coalesce(F.col(text), F.lit("")), model)))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return find(docs, fit(docs))
