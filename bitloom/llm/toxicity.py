"""Operator 4, toxicity: class-conditional Kneser-Ney word models, compared by their length-normalised log-likelihoods.

Two bigram models, of toxic and of ordinary rows, are gathered on the executors from all labelled training rows. What
counts is rows: an n-gram has one witness in each row that shows it, so classes of unlike size and texts of unlike length
stay comparable. Bigrams back off to their class's words and these to counts that both classes share, gathered over the
whole corpus. The discounts are Kneser-Ney's, n1 / (n1 + 2 n2), below 1, from the counts of counts before any pruning.

All words and all bigrams of the labelled rows are counted, and the models hold each that tells the classes apart, however
rare: whose witnesses are split unlike the classes' rows beyond chance (a likelihood ratio G of `SURE` or more, which chance
gives one expression in 4e9). A witness is here a distinct pair of neighbouring words, for what a text's copies share says
nothing of the classes; neighbours count by a hash of 16 bits, so G can only be taken for less. For the common language the
models hold those too that stand in `SHARE` of the rows of either class, and in `LEAST` rows. What is left is rare and split
like the classes; it says nothing of them, and as one unknown word and as the backoff's mass it weighs in every text (held
one by one it is noise: the README has figures).

The score is a logistic curve over the difference of the log-likelihoods divided by the length (damped by `DAMP` words for
very short texts). The curve alone is fitted on a sample, of at most `PER_CLASS` rows a class, each with its own witnesses
taken away, weighed to the classes' true shares.

Labels come only from labelled rows; labels, lang, source and doc_id are never inputs of a score.
Edge cases: null and empty texts have difference 0; without rows of both classes every score is the share of toxic rows
(0 without labels); a row labelled twice is toxic if one label is; rows that repeat a doc_id are rows of its label; a
null doc_id has no label and is scored; ties and repeats score alike; extra columns go.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import bounded_ids, drop_settled, id_crc, lean, settle, slices, table

WORD = re.compile(r"\w+")
SHARE, LEAST, SURE, DAMP, PER_CLASS = 1 / 64, 8, 40.0, 40, 2000
#: Labels up to this many rows are broadcast to the texts (about 40 MB); more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
FLUSH, SLICE = 200_000, 2 << 20
#: Words at which a task hands its bigrams on; distinct words a worker keeps; labelled rows a bucket of bigrams.
PAIRS, WORDS, CODES, ROWS_A_BUCKET = 1_000_000, 500_000, 1 << 24, 1_000
SEED = 42  # of Spark's xxhash64
START, UNKNOWN = 0, 1


def tokens(text: str) -> list[str]:
    return WORD.findall(text.lower())


def discount(once: int, twice: int) -> float:
    """Kneser-Ney's absolute discount from the numbers of n-grams seen once and twice; half an n-gram is added to both."""
    return (once + 0.5) / (once + 0.5 + 2 * (twice + 0.5))


class Class:
    """One class over word ids: rows of each word and bigram. keys: the kept bigrams, sorted, of both classes."""

    def __init__(self, rows: np.ndarray, context: np.ndarray, keys: np.ndarray, counts: np.ndarray, d1: float, d2: float, shared: np.ndarray):
        self.size, self.keys, self.counts, self.rows, self.context, self.d1, self.d2 = len(rows), keys, counts.astype(float), rows.astype(float), context.astype(float), d1, d2
        self.total = max(1.0, float(rows.sum()))
        self.backoff = float(np.minimum(rows, d1).sum()) / self.total * shared if rows.any() else shared
        # what the kept bigrams of a context leave: their discounts, and the pruned ones whole
        self.spare = self.context - np.bincount(keys // self.size, weights=np.maximum(self.counts - d2, 0), minlength=self.size)

    def log(self, left: np.ndarray, right: np.ndarray, out: np.ndarray | int = 0) -> np.ndarray:
        """log P(right | left); out: 1 takes one witness away, as for a row that was counted."""
        low = np.maximum(self.rows[right] - out - self.d1, 0) / np.maximum(self.total - out, 1) + self.backoff[right]
        key = left * self.size + right
        count = np.zeros(len(right))
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            count = np.where(self.keys[at] == key, self.counts[at], 0)
        every = np.maximum(self.context[left] - out, 0)
        high = (np.maximum(count - out - self.d2, 0) + self.spare[left] * low) / np.maximum(every, 1)
        return np.log(np.maximum(np.where(every > 0, high, low), 1e-300))


class Model:
    """Both classes over one vocabulary (id 0: row start, 1: any other word) and the curve: intercept and slope."""

    def __init__(self, words: Iterable[str] = (), share: float = 0.0):
        self.vocab = {w: i + 2 for i, w in enumerate(words)}
        self.share, self.sides, self.curve = share, (), (float(np.log((share + 1e-9) / (1 - share + 1e-9))), 0.0)

    @property
    def size(self) -> int:
        return len(self.vocab) + 2

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Word ids of all texts one after another, and the number of words of each."""
        lists = [tokens(t) for t in texts]
        sizes = np.array([len(x) for x in lists], np.int64)
        return np.fromiter((i for x in lists for i in map(self.vocab.get, x, repeat(UNKNOWN))), np.int64, int(sizes.sum())), sizes

    def differences(self, texts: list[str], own: np.ndarray | None = None) -> np.ndarray:
        """Length-normalised log-likelihood, toxic less ordinary, of each text; own: the class (0 or 1) in which each text was counted."""
        ids, sizes = self.ids(texts)
        if not self.sides or not len(ids):
            return np.zeros(len(texts))
        row = np.repeat(np.arange(len(texts)), sizes)
        left = _left(ids, sizes)
        outs = (0, 0) if own is None else tuple((own[row] == y).astype(float) for y in (0, 1))
        each = self.sides[1].log(left, ids, outs[1]) - self.sides[0].log(left, ids, outs[0])
        return np.bincount(row, weights=each, minlength=len(texts)) / (sizes + DAMP)

    def scores(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.curve[0] + self.curve[1] * self.differences(texts), -60, 60)))


def _left(ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    left = np.empty_like(ids)
    left[1:] = ids[:-1]
    left[(np.cumsum(sizes) - sizes)[sizes > 0]] = START
    return left


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-6, rounds: int = 60) -> tuple[float, float]:
    """Intercept and slope by Newton's method."""
    scale = max(1e-9, float(np.abs(x).mean()))
    a, w = np.c_[np.ones(len(x)), x / scale], np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (weight * (p - y)) + ridge * weight.sum() * np.r_[0, w[1:]]
        h = (a * (weight * p * (1 - p))[:, None]).T @ a + (ridge * weight.sum() + 1e-9) * np.eye(2)
        step = np.linalg.solve(h, g)
        w -= step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1]) / scale


def _texts(b: pa.RecordBatch) -> list[str]:
    return [x or "" for x in b.column(b.schema.get_field_index("text")).to_pylist()]


def _word_rows(rows: DataFrame) -> DataFrame:
    """(side, word, n): in how many rows of a class each word stands; the null word counts the rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(seen: tuple[Counter, Counter]) -> pa.RecordBatch:
            cols = [(y, w, n) for y in (0, 1) for w, n in seen[y].items()]
            side, word, n = zip(*cols) if cols else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(side, pa.int32()), pa.array(word, pa.string()), pa.array(n, pa.int64())], names=["side", "word", "n"])

        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for b in batches:
            for y, text in zip(b.column(0).to_pylist(), _texts(b)):
                seen[y].update({None, *tokens(text)})
                if len(seen[0]) + len(seen[1]) > FLUSH:
                    yield flush(seen)
                    seen = (Counter(), Counter())
        yield flush(seen)

    return rows.select("side", "text").mapInArrow(lean(run), "side int, word string, n bigint").groupBy("side", "word").agg(F.sum("n").alias("n"))


def _gram_rows(rows: DataFrame, model: Model) -> DataFrame:
    """(side, gram, n) over all rows: in how many rows each bigram of ids stands, as left * size + right, and each word, as -1 - id. Unlabelled rows (side -1) count words alone."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lm = shared.value
        for b in slices(batches, "text", SLICE):
            side = np.array(b.column(0).to_pylist(), np.int64)
            ids, sizes = lm.ids(_texts(b))
            row, span = np.repeat(np.arange(len(side)), sizes), lm.size * lm.size + lm.size
            gram = _left(ids, sizes) * lm.size + ids + lm.size  # words first, then bigrams
            labelled = side[row] >= 0
            once = np.unique(np.r_[row * span + ids, row[labelled] * span + gram[labelled]])  # once a row
            key, n = np.unique((side[once // span] + 1) * span + once % span, return_counts=True)
            own = key % span
            gram = np.where(own < lm.size, -1 - own, own - lm.size)
            yield pa.RecordBatch.from_arrays([pa.array((key // span - 1).astype(np.int32)), pa.array(gram), pa.array(n.astype(np.int64))], names=["side", "gram", "n"])

    return rows.select("side", "text").mapInArrow(lean(run), "side int, gram bigint, n bigint").groupBy("side", "gram").agg(F.sum("n").alias("n"))


def split(n0: np.ndarray, n1: np.ndarray, share: float) -> np.ndarray:
    """G, the likelihood ratio of rows split n0 to n1 against the classes' own split."""
    n0, n1 = np.asarray(n0, float), np.asarray(n1, float)
    of = lambda k, p: k * np.log(np.maximum(k, 1e-9) / ((n0 + n1) * p))
    return 2 * (of(n0, 1 - share) + of(n1, share))


class _Codes(dict):
    """Numbers words as they come, from 1 (0 is the row start); hashes: by number."""

    def __init__(self) -> None:
        self.hashes = array("Q", [0])

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self.hashes)
        self.hashes.append(xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), SEED))
        return n


def _telling(rows: DataFrame, buckets: int, share: float) -> DataFrame:
    """(a, b): hashes of the bigrams that tell the classes apart, among all of labelled rows, and with b 0 of such words. A row start hashes to 0."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, seen, held = _Codes(), ([], []), 0

        def flush() -> pa.RecordBatch:
            out, hashes = [], np.array(codes.hashes, np.uint64)
            for y in (0, 1):
                key = np.unique(np.concatenate(seen[y] or [np.zeros(0, np.uint64)]))
                seen[y].clear()
                left, right, near = hashes[key >> np.uint64(40)], hashes[key >> np.uint64(16) & np.uint64(CODES - 1)], key.astype(np.uint16)
                bucket = (left % np.uint64(buckets)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")  # a left word's bigrams stay together
                stops = np.r_[0, np.cumsum(np.bincount(bucket, minlength=buckets))]
                for b in np.flatnonzero(np.diff(stops)).tolist():
                    at = order[stops[b] : stops[b + 1]]
                    a = left[at]
                    head = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
                    out.append((b, y, a[head].tobytes(), np.diff(np.r_[head, len(a)]).astype(np.uint32).tobytes(), right[at].tobytes(), near[at].tobytes()))
            cols = list(zip(*out)) if out else [()] * 6
            kinds = (pa.int32(), pa.int32(), *[pa.binary()] * 4)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["bucket", "side", "a", "k", "b", "near"])

        for batch in slices(batches, "text", SLICE):
            lists = [tokens(t) for t in _texts(batch)]
            side, sizes = np.array(batch.column(0).to_pylist(), np.int64), np.array([len(x) for x in lists], np.int64)
            ids = np.fromiter(map(codes.__getitem__, chain.from_iterable(lists)), np.int64, int(sizes.sum()))
            if not len(ids):
                continue
            if len(codes.hashes) > CODES:
                raise ValueError("a row of more than 16 million different words")
            hashes, row, left, after = np.array(codes.hashes, np.uint64), np.repeat(side, sizes), _left(ids, sizes), np.zeros_like(ids)
            after[:-1] = ids[1:]
            after[np.cumsum(sizes)[sizes > 0] - 1] = START
            near = lambda x, z: (hashes[x] * np.uint64(0x9E3779B97F4A7C15) ^ hashes[z]) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(48)
            pair = (left << 40 | ids << 16).astype(np.uint64) | near(_left(left, sizes), after)
            word = (ids << 40).astype(np.uint64) | near(left, after)
            for y in (0, 1):
                seen[y].extend((np.unique(pair[row == y]), np.unique(word[row == y])))
            held += len(ids)
            if held > PAIRS:
                yield flush()
                held = 0
                if len(codes) > WORDS:
                    codes = _Codes()
        yield flush()

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for batch in batches:
            for _, y, a, k, b, near in zip(*(batch.column(i).to_pylist() for i in range(6))):
                b = np.frombuffer(b, np.uint64)
                parts.append((np.repeat(np.frombuffer(a, np.uint64), np.frombuffer(k, np.uint32)), b, np.frombuffer(near, np.uint16).astype(np.int32) + (y << 16)))
        if not parts:
            return
        a, b, near = (np.concatenate(x) for x in zip(*parts))
        parts.clear()
        order = np.lexsort((near, b, a))
        a, b, near = a[order], b[order], near[order]
        new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
        one = new | np.r_[True, near[1:] != near[:-1]]
        group, m = np.cumsum(new) - 1, int(new.sum())
        n0, n1 = (np.bincount(group[one & (near >> 16 == y)], minlength=m) for y in (0, 1))
        tells = split(n0, n1, share) >= SURE
        yield pa.RecordBatch.from_arrays([pa.array(x[new][tells].view(np.int64)) for x in (a, b)], names=["a", "b"])

    made = rows.select("side", "text").mapInArrow(lean(run), "bucket int, side int, a binary, k binary, b binary, near binary")
    return made.repartition(buckets, "bucket").mapInArrow(lean(add), "a bigint, b bigint")


def _counts_of_counts(counts: DataFrame) -> dict[tuple[int, int], int]:
    return {(r.side, r.n): r["count"] for r in counts.where("n <= 2").groupBy("side", "n").count().collect()}


def labelled(docs: DataFrame, labels: DataFrame, held_out: int = 0) -> DataFrame:
    """(doc_id, text, side): 1 toxic, 0 ordinary, -1 not labelled or held out."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (id_crc("doc_id", 5) != held_out))
    known = settle(known.groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("int")).alias("side")))
    side = F.broadcast(known) if known.count() <= BROADCAST_ROWS else known
    return docs.select("doc_id", "text").join(side, "doc_id", "left").withColumn("side", F.coalesce("side", F.lit(-1)))


def gather(rows: DataFrame) -> Model:
    """Both classes' counts over all of `rows` (text, side), without the curve."""
    word_rows = settle(_word_rows(rows.where("side >= 0")))
    totals = {r.side: r.n for r in word_rows.where("word is null").collect()}
    toxic, ordinary = totals.get(1, 0), totals.get(0, 0)
    share = toxic / max(1, toxic + ordinary)
    if not toxic or not ordinary:
        return Model(share=share)
    enough = (F.col("n0") >= max(LEAST, SHARE * ordinary)) | (F.col("n1") >= max(LEAST, SHARE * toxic))
    by_class = [F.sum(F.when(F.col("side") == y, F.col("n")).otherwise(0)).alias(f"n{y}") for y in (0, 1)]
    buckets = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(toxic + ordinary) // ROWS_A_BUCKET))
    telling = settle(_telling(rows.where("side >= 0"), buckets, share))
    hashes = telling.select(F.explode(F.array("a", "b")).alias("h")).distinct()
    words = word_rows.where("word is not null").groupBy("word").agg(*by_class).join(hashes, F.xxhash64("word") == F.col("h"), "left")
    words = sorted(r.word for r in words.where(enough | F.col("h").isNotNull()).select("word").distinct().collect())
    pairs_told = [(r.a, r.b) for r in telling.where("b <> 0").collect()]
    drop_settled(telling)
    ones = _counts_of_counts(word_rows.where("word is not null"))
    drop_settled(word_rows)
    model = Model(words, share)
    size = model.size
    grams = settle(_gram_rows(rows, model))
    alone = np.zeros((3, size), np.int64)  # by side + 1
    for r in grams.where("gram < 0").collect():
        alone[r.side + 1, -1 - r.gram] = r.n
    shared = alone.sum(axis=0) + np.r_[0, np.full(size - 1, 0.5)]
    shared = shared / shared.sum()
    pairs = grams.where("gram >= 0")
    twos = _counts_of_counts(pairs)
    context = np.zeros((2, size), np.int64)
    for r in pairs.groupBy("side", F.expr(f"gram div {size}").alias("left")).agg(F.sum("n").alias("n")).collect():
        context[r.side, r.left] = r.n
    number = {0: START} | {int(np.uint64(xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), SEED)).view(np.int64)): i for w, i in model.vocab.items()}
    told = rows.sparkSession.createDataFrame(pa.table({"gram": pa.array([number[a] * size + number[b] for a, b in pairs_told], pa.int64()), "tells": pa.array([True] * len(pairs_told), pa.bool_())}))
    kept = pairs.groupBy("gram").agg(*by_class).join(F.broadcast(told), "gram", "left")
    found = sorted((r.gram, r.n0, r.n1) for r in kept.where(enough | F.col("tells")).collect())
    drop_settled(grams)
    table_ = np.array(found, np.int64).reshape(-1, 3)
    model.sides = tuple(Class(alone[y + 1], context[y], table_[:, 0], table_[:, y + 1], discount(ones.get((y, 1), 0), ones.get((y, 2), 0)), discount(twos.get((y, 1), 0), twos.get((y, 2), 0)), shared) for y in (0, 1))
    return model


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Class counts from all labelled training rows, shared counts from all of `docs`, the curve from at most `per_class` rows a class."""
    rows = labelled(docs, labels)
    model = gather(rows)
    if not model.sides:
        return model
    # at most per_class (id, side) a class; of rows that repeat an id one is taken
    ids = bounded_ids(rows.where("side >= 0").select("doc_id", "side"), per_class, "side", 23).distinct()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", SLICE):
            side = np.array(b.column(1).to_pylist(), np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(shared.value.differences(_texts(b), side))], names=["doc_id", "side", "d"])

    own = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("doc_id", "side", "text").mapInArrow(lean(run), "doc_id bigint, side int, d double")
    got = np.array(sorted((r.side, r.d) for r in own.groupBy("doc_id", "side").agg(F.min("d").alias("d")).collect()), float).reshape(-1, 2)
    y, x = got[:, 0], got[:, 1]
    if 0 < y.sum() < len(y):
        weight = np.where(y == 1, model.share / y.sum(), (1 - model.share) / (len(y) - y.sum()))
        model.curve = logistic(x, y, weight)
    return model


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` and the score of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", SLICE):
            own = [b.column(b.schema.get_field_index(n)) for n in keep]
            yield pa.RecordBatch.from_arrays([*own, pa.array(shared.value.scores(_texts(b)))], names=[*keep, "score"])

    kinds = dict(docs.dtypes)
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(lean(run), ", ".join([*(f"`{n}` {kinds[n]}" for n in keep), "score double"]))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "toxic")
    return score(docs, fit(docs, labels)).select("doc_id", (id_crc("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
