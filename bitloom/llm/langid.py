"""Operator 2, language ID: a linear-chain conditional random field labels every word; a document takes the label with the most posterior mass.

A word's features are its affixes, its inner character n-grams (both hashed) and its entry in a lexicon of learned
words. Transition weights are learned with them, on code-switched sequences spliced from training rows of different
languages. Forward-backward runs over whole texts: a chain is cut into blocks of `BLOCK` words whose transfer matrices
are multiplied block by block first, so that all blocks of a slice of rows go through each step together.

Fitting uses at most `PER_LABEL` rows a language and `ROWS` of all, picked by a hash of the id, and of each at most
`PER_ROW` spans of `BLOCK` words evenly spaced over the whole text; the executors cut the spans, the driver gets no text.
Prediction reads whole texts, and no lang, source or doc_id.
Edge cases: null texts and texts without a letter are `und` with score 0; a language whose sampled rows have no letter isn't
in the model; with one language all words are its own, without any everything is `und`; a training row without a doc_id isn't
learned from, and of rows that repeat one in a language the least text is; ties go to the first label in order; repeated
rows are predicted alike; extra columns go.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import bounded_ids, id_crc, lean, slices, table

BUCKETS, BLOCK, SLICE, UNKNOWN = 1 << 16, 64, 1 << 20, "und"
PER_LABEL, ROWS, PER_ROW, LEXICON, STEPS, BATCH = 1500, 24_000, 6, 4096, 400, 64
EDGE = 32
_LETTER = np.zeros(0x110000, bool)
_LOWER = np.zeros(0, np.uint32)


def tables() -> tuple[np.ndarray, np.ndarray]:
    """Which code points are letters, and their lower case; made once in a worker."""
    global _LOWER
    if not len(_LOWER):
        chars = [chr(i) for i in range(0x20000)]
        _LETTER[: len(chars)] = [c.isalpha() for c in chars]
        _LETTER[0x20000:0x32000] = True
        low = np.arange(0x110000, dtype=np.uint32)
        low[: len(chars)] = [ord(c.lower()) if len(c.lower()) == 1 else ord(c) for c in chars]
        _LOWER = low
    return _LETTER, _LOWER


MIX = np.uint64(0x9E3779B97F4A7C15)


def _hash(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x ^ np.uint64(salt)) * MIX
    return x ^ (x >> np.uint64(29))


def words(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of letters."""
    letter = tables()[0][codes]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], letter, [False]]).astype(np.int8)))
    return edge[0::2], edge[1::2]


class Features:
    """The active features of the words of a slice: bucket indices with the word of each, for n-grams of 1 to 4 with word edges."""

    def __init__(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        n = len(starts)
        size = ends - starts
        total = int(size.sum()) + 2 * n
        width = size + 2
        begin = np.cumsum(width) - width
        self.word = np.repeat(np.arange(n), width)
        self.at = begin
        flat = np.full(total, EDGE, np.uint64)
        inner = np.ones(total, bool)
        inner[begin] = inner[begin + width - 1] = False
        pick = np.repeat(starts - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        flat[inner] = tables()[1][codes[pick]]
        self.grams = []
        h = _hash(flat, 1)
        left = total
        for k in (2, 3, 4):  # with the edges, these are the affixes of up to three letters and the inner n-grams
            left = total - k + 1
            if left <= 0:
                break
            h = _hash(h[:left] * np.uint64(31) + flat[k - 1 :], k)
            same = self.word[:left] == self.word[k - 1 :]
            self.grams.append((np.flatnonzero(same), (h[same] >> np.uint64(40)).astype(np.int64) % BUCKETS))
        # a word's own hash: a sum over places, for the lexicon
        place = (np.arange(total) - np.repeat(begin, width)).astype(np.uint64)
        self.whole = np.add.reduceat(_hash(flat * np.uint64(1 << 21) + place, 9), begin) if n else np.zeros(0, np.uint64)


class Model:
    """labels, emission weights by bucket, lexicon (sorted hashes and weights), transitions and start weights."""

    def __init__(self, labels: list[str]):
        k = len(labels)
        self.labels, self.emit = labels, np.zeros((BUCKETS, k), np.float32)
        self.lexicon, self.lex = np.zeros(0, np.uint64), np.zeros((0, k), np.float32)
        self.move, self.start, self.bias = np.zeros((k, k)), np.zeros(k), np.zeros(k)

    def lookup(self, whole: np.ndarray) -> np.ndarray:
        """Place of each word in the lexicon, or -1."""
        if not len(self.lexicon):
            return np.full(len(whole), -1)
        at = np.minimum(np.searchsorted(self.lexicon, whole), len(self.lexicon) - 1)
        return np.where(self.lexicon[at] == whole, at, -1)

    def emissions(self, f: Features) -> np.ndarray:
        n, k = len(f.at), len(self.labels)
        out = np.zeros((n, k))
        if not n:
            return out
        for places, bucket in f.grams:
            per = np.bincount(f.word[places], minlength=n)
            got = per > 0
            begin = (np.cumsum(per) - per)[got]
            out[got] += np.add.reduceat(self.emit[bucket], begin, axis=0)
        at = self.lookup(f.whole)
        known = at >= 0
        out[known] += self.lex[at[known]]
        return out + self.bias


def _norm(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(x.sum(axis=-1, keepdims=True), 1e-300)


class Chains:
    """Forward and backward weights of each word's label. score: (words, labels); chain: words of each chain, in order, none empty."""

    def __init__(self, model: Model, score: np.ndarray, chain: np.ndarray):
        k, n = score.shape[1], len(score)
        e = np.exp(score - score.max(axis=1, keepdims=True))
        trans, start = np.exp(model.move - model.move.max()), np.exp(model.start - model.start.max())
        blocks = -(-chain // BLOCK)
        owner = np.repeat(np.arange(len(chain)), blocks)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        first = (np.cumsum(chain) - chain)[owner] + nth * BLOCK
        size = np.minimum(chain[owner] - nth * BLOCK, BLOCK)
        order = np.argsort(-size, kind="stable")  # blocks that still run at a step are the first ones
        first, size, owner, nth = first[order], size[order], owner[order], nth[order]
        live = np.array([int((size > t).sum()) for t in range(BLOCK)])
        head = nth == 0
        # transfer matrix of each block: rows are the label before it; a chain's first word has the start weights and no move
        m = np.where(head[:, None, None], np.eye(k), trans) * e[first][:, None, :]
        m /= m.sum(axis=(1, 2), keepdims=True)
        for t in range(1, BLOCK):
            if not (w := live[t]):
                break
            step = (m[:w].reshape(-1, k) @ trans).reshape(w, k, k) * e[first[:w] + t][:, None, :]
            m[:w] = step / np.maximum(step.sum(axis=(1, 2), keepdims=True), 1e-300)
        # label weights before and after each block, block by block along the chains
        before, after = np.empty((len(first), k)), np.empty((len(first), k))
        slot = np.empty((len(first),), np.int64)
        offset = np.cumsum(blocks) - blocks
        slot[offset[owner] + nth] = np.arange(len(first))
        now = np.broadcast_to(_norm(start), (len(chain), k)).copy()
        for b in range(int(blocks.max(initial=0))):
            own = np.flatnonzero(blocks > b)
            at = slot[offset[own] + b]
            before[at] = now[own]
            now[own] = _norm(np.maximum(np.einsum("ni,nij->nj", now[own], m[at]), 1e-300))
        now = np.ones((len(chain), k)) / k
        for b in range(int(blocks.max(initial=0)) - 1, -1, -1):
            own = np.flatnonzero(blocks > b)
            at = slot[offset[own] + b]
            after[at] = now[own]
            now[own] = _norm(np.einsum("nij,nj->ni", m[at], now[own]))
        self.emission, self.trans = e, trans
        self.forward, self.backward = np.empty((n, k)), np.empty((n, k))
        a = np.where(head[:, None], before, before @ trans)
        for t in range(BLOCK):
            if not (w := live[t]):
                break
            a = _norm(np.maximum((a if t == 0 else a[:w] @ trans) * e[first[:w] + t], 1e-300))
            self.forward[first[:w] + t] = a
        b = after
        for t in range(BLOCK - 1, -1, -1):
            if not (w := live[t]):
                continue
            rows = first[:w] + t
            self.backward[rows] = b[:w]
            b = b.copy()
            b[:w] = _norm((e[rows] * b[:w]) @ trans.T)

    def labels(self) -> np.ndarray:
        """Posterior of each word's label."""
        return _norm(self.forward * self.backward)

    def moves(self, at: np.ndarray) -> np.ndarray:
        """Posteriors (words, label before, label) of the words `at`, none a chain's first, with their predecessors' labels."""
        pair = self.forward[at - 1][:, :, None] * self.trans * (self.emission[at] * self.backward[at])[:, None, :]
        return pair / np.maximum(pair.sum(axis=(1, 2), keepdims=True), 1e-300)


def marginals(model: Model, score: np.ndarray, chain: np.ndarray) -> np.ndarray:
    """Posterior of each word's label."""
    return Chains(model, score, chain).labels()


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def spans_of(text: str, per_row: int = PER_ROW) -> list[str]:
    """At most `per_row` spans of `BLOCK` words, evenly spaced over the whole text, each word after a space."""
    codes = _codes(text)
    starts, ends = words(codes)
    places = np.linspace(0, max(0, len(starts) - BLOCK), per_row).astype(int)
    cut = lambda a, b: codes[a:b].tobytes().decode("utf-32-le", "surrogatepass")
    return [" ".join(cut(a, b) for a, b in zip(starts[p : p + BLOCK], ends[p : p + BLOCK])) for p in dict.fromkeys(places.tolist()) if len(starts)]


def gradients(model: Model, f: Features, y: np.ndarray, sizes: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the chains' negative log-likelihood, over the number of words. y: each word's label; sizes: words of each chain."""
    k, n = len(model.labels), len(y)
    chains = Chains(model, model.emissions(f), sizes)
    g = chains.labels()
    g[np.arange(n), y] -= 1
    g /= n
    heads = np.cumsum(sizes) - sizes
    inner = np.ones(n, bool)
    inner[heads] = False
    at = np.flatnonzero(inner)
    seen = np.zeros((k, k))
    np.add.at(seen, (y[at - 1], y[at]), 1)
    out = {"emit": np.zeros((BUCKETS, k), np.float32), "lex": np.zeros(model.lex.shape, np.float32), "bias": g.sum(0), "start": g[heads].sum(0), "move": (chains.moves(at).sum(0) - seen) / n}
    look = model.lookup(f.whole)
    for c in range(k):
        for places, bucket in f.grams:
            out["emit"][:, c] += np.bincount(bucket, weights=g[f.word[places], c], minlength=BUCKETS)
        out["lex"][:, c] = np.bincount(look[look >= 0], weights=g[look >= 0, c], minlength=len(model.lexicon))
    return out


def fit(rows: list[tuple[str, str]], lexicon: int = LEXICON, steps: int = STEPS, seed: int = 7) -> Model:
    """Adam on the chains' log-likelihood. rows: (span as of `spans_of`, label)."""
    rng = np.random.default_rng(seed)
    by_label: dict[str, list[str]] = {}
    for span, y in rows:
        if span:
            by_label.setdefault(y, []).append(span)
    # a label whose rows hold no letter has nothing to learn from and isn't in the model
    model = Model(sorted(by_label))
    k, spans = len(model.labels), [by_label[y] for y in model.labels]
    if k < 2:
        return model
    seen, count = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    every = [s for own in spans for s in own]
    for at in range(0, len(every), 2048):  # some spans at a time: their characters' arrays are large
        codes = _codes(" ".join(every[at : at + 2048]))
        both = np.r_[seen, Features(codes, *words(codes)).whole]
        seen, place = np.unique(both, return_inverse=True)
        count = np.bincount(place, weights=np.r_[count, np.ones(len(both) - len(count))]).astype(np.int64)
    model.lexicon = np.sort(seen[np.argsort(-count, kind="stable")[:lexicon]])
    model.lex = np.zeros((len(model.lexicon), k), np.float32)
    params = {"emit": model.emit, "lex": model.lex, "move": model.move, "start": model.start, "bias": model.bias}
    mean, square = ({n: np.zeros(p.shape, np.float32) for n, p in params.items()} for _ in range(2))
    for it in range(1, steps + 1):
        chains, labels, sizes = [], [], []
        for _ in range(BATCH):
            seq: list[str] = []
            while len(seq) < BLOCK:  # code-switched: pieces of 4 to 64 words from one language after another
                y = int(rng.integers(k))
                span = spans[y][int(rng.integers(len(spans[y])))].split(" ")
                n = int(rng.integers(4, BLOCK + 1))
                at = int(rng.integers(max(1, len(span) - n + 1)))
                seq += span[at : at + n]
                labels += [y] * len(span[at : at + n])
            chains.append(" ".join(seq))
            sizes.append(len(seq))
        codes = _codes(" ".join(chains))
        grads = gradients(model, Features(codes, *words(codes)), np.array(labels), np.array(sizes))
        for n, w in params.items():
            d = grads[n] + 1e-7 * w
            mean[n] += 0.1 * (d - mean[n])
            square[n] += 0.01 * (d * d - square[n])
            w -= 0.03 * (mean[n] / (1 - 0.9**it)) / (np.sqrt(square[n] / (1 - 0.99**it)) + 1e-7)
    return model


ADDED = "lang_pred string, score double, n_words bigint, switches bigint"


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep`, lang_pred, score, n_words and switches for each whole text; switches: words labelled unlike the one before."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [*keep, *(x.split()[0] for x in ADDED.split(", "))]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = shared.value
        k = len(crf.labels)
        for b in slices(batches, "text", SLICE // max(1, k // 8)):  # the arrays have labels columns, transfer matrices their square
            texts = [x or "" for x in b.column(b.schema.get_field_index("text")).to_pylist()]
            codes = _codes("\n".join(texts))
            starts, ends = words(codes)
            doc_end = np.cumsum([len(t) + 1 for t in texts])
            owner = np.searchsorted(doc_end, starts, "right")
            chain = np.bincount(owner, minlength=len(texts))
            best, score, moves = np.full(len(texts), -1), np.zeros(len(texts)), np.zeros(len(texts), np.int64)
            if len(starts) and k:
                p = marginals(crf, crf.emissions(Features(codes, starts, ends)), chain[chain > 0])
                mass = np.stack([np.bincount(owner, weights=p[:, c], minlength=len(texts)) for c in range(k)], axis=1)
                has = chain > 0
                best[has] = mass[has].argmax(axis=1)
                score[has] = mass[has].max(axis=1) / chain[has]
                y = p.argmax(axis=1)
                moves = np.bincount(owner[1:][(y[1:] != y[:-1]) & (owner[1:] == owner[:-1])], minlength=len(texts))
            pred = [crf.labels[i] if i >= 0 else UNKNOWN for i in best.tolist()]
            own = [b.column(b.schema.get_field_index(n)) for n in keep]
            yield pa.RecordBatch.from_arrays([*own, pa.array(pred, pa.string()), pa.array(np.clip(score, 0, 1)), pa.array(chain), pa.array(moves)], names=names)

    kinds = dict(docs.dtypes)
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(lean(run), ", ".join([*(f"`{n}` {kinds[n]}" for n in keep), ADDED]))


def sample(docs: DataFrame, per_label: int = PER_LABEL, rows: int = ROWS) -> list[tuple[str, str]]:
    """(span, lang) of at most `per_label` training rows a language and `rows` of all, PER_ROW spans of BLOCK words each."""
    train = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (id_crc("doc_id", 3) != 1))
    langs = train.agg(F.count_distinct("lang")).first()[0]
    ids = bounded_ids(train.select("doc_id", "lang"), min(per_label, max(1, rows // max(1, langs))), "lang", 11).distinct()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(s, y) for y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for s in spans_of(t)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.string()) for i in (0, 1)], names=["span", "lang"])

    # `rows` ids at most (one a language at least): bounded whatever the input
    own = train.select("doc_id", "lang", "text").join(F.broadcast(ids), ["doc_id", "lang"], "left_semi").where("text is not null")
    own = own.groupBy("doc_id", "lang").agg(F.min("text").alias("text")).select("lang", "text")
    return sorted((r.span, r.lang) for r in own.mapInArrow(lean(run), "span string, lang string").toLocalIterator())


def identify(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Fit on the training rows of `docs`, predict every row."""
    return predict(docs, fit(sample(docs)), keep)


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    return identify(docs).select("doc_id", (id_crc("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "n_words", "switches")
