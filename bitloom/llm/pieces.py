"""Operator 3, SentencePiece encoding and decoding by a relational lattice.

A text is a dummy prefix and its words, each with the spaces before it (as the meta symbol). A word is cut wherever no
piece holds the two characters side by side: nothing merges across such a place, so its spans are encoded apart. The `HOT`
most frequent spans of a sample of rows are encoded by a lattice: their substrings up to the longest piece are exploded,
equi-joined to the piece table (whose size the model file fixes, so it is broadcast), the edges grouped by span, and a
higher-order aggregate folds them into a segmentation. A character without a piece becomes its bytes' pieces.

One pass then encodes every whole text where it lies: the lattice's table goes to the workers, and a span that isn't in it
(rare, or beyond the fold's 64 bits) is merged by a heap, in n log n, over the same piece table; the tests hold both against
the library. The sample only steers which way a span goes: no result depends on it. The ids of a text are one array, from
which plain columns decode the text again.

The fold follows the model file. For a unigram model it is Viterbi: the best sum of scores, on a tie the longer last
piece. For a BPE model scores are merge ranks, whose best path is often not the encoding (the README has figures), so
the fold merges instead: it goes through the lattice's edges by rank, on a tie from the left, and takes those that span
exactly two of the present symbols. Where a merge makes an edge fit that had been passed over (its rank is better), the
word is folded again, from the best edge at each step; the table says of which pieces that can happen.

Edge cases: null and empty texts have no pieces; the meta symbol in a text reads back as a space; every row gets a row of
its own, also under a null or repeated doc_id; extra columns go.
"""

from __future__ import annotations

import re
import struct
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bits import let
from .base import drop_settled, settle, slices, table

META, HOT, SAMPLE, A_TASK, LONG = "▁", 150_000, 16, 500_000, 60
KNOWN, SLICE, STEP = 300_000, 1 << 20, 1 << 16
ODD = re.compile(f"{META}*[^{META}]+|{META}+")
NORMAL, BYTE, UNIGRAM, BPE = 1, 6, 1, 2
MODEL = "piece_bpe_32k.model"
FALLBACK = "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"


def _fields(body: bytes) -> Iterator[tuple[int, int | float | bytes]]:
    """Field numbers and values of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = body[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(body):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            n = varint()
            yield key >> 3, body[at : at + n]
            at += n
        else:
            size, form = (4, "<f") if kind == 5 else (8, "<d")
            yield key >> 3, struct.unpack_from(form, body, at)[0]
            at += size


class Pieces:
    """The piece table of a model file: (piece, id, score) of normal pieces, and the id of byte 0."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            parts = list(_fields(f.read()))
        found = [dict(_fields(v)) for k, v in parts if k == 1]
        self.merges = next((dict(_fields(v)).get(3, UNIGRAM) for k, v in parts if k == 2), UNIGRAM) == BPE
        rows = [(p[1].decode(), i, float(p.get(2, 0.0)), p.get(3, NORMAL)) for i, p in enumerate(found)]
        self.rows = [(p, i, s) for p, i, s, kind in rows if kind == NORMAL]
        self.bytes = [i for _, i, _, kind in rows if kind == BYTE]
        if len(self.bytes) != 256 or self.bytes != list(range(self.bytes[0], self.bytes[0] + 256)):
            raise ValueError("the model has no byte pieces in a row")
        self.longest = max(len(p) for p, _, _ in self.rows)
        self.unknown = min(s for _, _, s in self.rows) - 10

    def hexes(self) -> Column:
        """The UTF-8 bytes of every piece in hex, as a constant array by id."""
        found = {i: p.encode().hex().upper() for p, i, _ in self.rows} | {i: f"{k:02X}" for k, i in enumerate(self.bytes)}
        return F.split(F.lit(",".join(found.get(i, "") for i in range(max(found) + 1))), ",")

    def ranked(self, spark: SparkSession) -> DataFrame:
        """(piece, code): rank of the score (equal ones share one) above 32 bits, a flag, and the id in the lower 19.

        The flag says that a piece of a better rank has this one as a half: only after such a merge an edge that was passed over can fit.
        """
        ranks = {s: r for r, s in enumerate(sorted({s for _, _, s in self.rows}, reverse=True))}
        rank = {p: ranks[s] for p, _, s in self.rows}
        symbol = lambda p: len(p) == 1 or p in rank
        late = {half for p, r in rank.items() for k in range(1, len(p)) for half in (p[:k], p[k:]) if symbol(p[:k]) and symbol(p[k:]) and rank.get(half, -1) >= r}
        return spark.createDataFrame(pa.table({"piece": pa.array([p for p, _, _ in self.rows]), "code": pa.array([(ranks[s] << 32) + LATE * (p in late) + i for p, i, s in self.rows], pa.int64())}))

    def scores(self) -> Column:
        found = {i: s for _, i, s in self.rows}
        return F.transform(F.split(F.lit(",".join(repr(found.get(i, self.unknown)) for i in range(max(found) + 1))), ","), lambda x: x.cast("double"))


def units(text: str) -> list[str]:
    """The words of a text, each without the meta symbol before it (further ones stay); with it they are the text with its dummy prefix."""
    if not text:
        return []
    if "  " in text or text[0] == " " or text[-1] == " " or META in text:
        return [u[1:] for u in ODD.findall(META + text.replace(" ", META))]
    return text.split(" ")


def bit(k: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), k)


UNKNOWN, LATE = (1 << 19) - 1, 1 << 19  # the id of a character without a piece; the flag of `Pieces.ranked`
START = lambda x: F.shiftright(x, 26).bitwiseAND(63).cast("int")
END = lambda x: F.shiftright(x, 20).bitwiseAND(63).cast("int")


def encode_words(words: DataFrame, pieces: Pieces) -> DataFrame:
    """(word, ids) of distinct words of 1 to LONG characters. All steps keep the partitioning by word."""
    n = F.length("word")
    # two generators over plain numbers: both, and the substrings, stay in whole-stage codegen; outer ones, since others
    # get a filter on their size that computes the array, and all before it, once more
    starts = words.select("word", F.explode_outer(F.sequence(F.lit(0), n - 1)).alias("s"))
    spans = starts.select("word", "s", F.explode_outer(F.sequence(F.col("s") + 1, F.least(F.col("s") + pieces.longest, n))).alias("e"))
    lattice = spans.select("word", "s", "e", F.substring("word", F.col("s") + 1, F.col("e") - F.col("s")).alias("piece"))
    edges = lattice.join(F.broadcast(pieces.ranked(words.sparkSession)), "piece", "left").where(F.col("code").isNotNull() | (F.col("e") - F.col("s") == 1))
    # an edge is one number: rank, start (6 bits), end (6 bits), flag, id (19 bits), so sorting them is by rank and from the left
    edge = F.coalesce("code", F.lit((1 << 52) + UNKNOWN)) + F.shiftleft(F.col("s").cast("bigint"), 26) + F.shiftleft(F.col("e").cast("bigint"), 20)
    grouped = edges.select("word", edge.alias("edge")).groupBy("word").agg(F.collect_list("edge").alias("edges"))
    masks = F.transform(F.sort_array("edges"), lambda x: F.struct(x.alias("x"), (bit(START(x)) + bit(END(x))).alias("ends"), (bit(END(x)) - bit(START(x) + 1)).alias("inner")))
    found = grouped.select("word", masks.alias("m")).select("word", "m", (_merged(n) if pieces.merges else _best(n, pieces)).alias("bounds"))
    b = F.col("bounds")
    # segments: edges between neighbouring bounds
    kept = F.filter("m", lambda y: (b.bitwiseAND(y["ends"]) == y["ends"]) & (b.bitwiseAND(y["inner"]) == 0))
    segments = found.select("word", F.sort_array(F.transform(kept, lambda y: y["x"].bitwiseAND((1 << 32) - 1))).alias("segments"))
    own = lambda y: y.bitwiseAND(UNKNOWN).cast("int")
    byte_ids = lambda c: F.transform(F.sequence(F.lit(1), F.octet_length(c)), lambda i: F.conv(F.substring(F.hex(F.encode(c, "utf-8")), 2 * i - 1, F.lit(2)), 16, 10).cast("int") + pieces.bytes[0])
    spelled = F.flatten(F.transform("segments", lambda y: F.when(own(y) == UNKNOWN, byte_ids(F.substring("word", START(y) + 1, F.lit(1)))).otherwise(F.array(own(y)))))
    return segments.select("word", F.when(F.exists("segments", lambda y: own(y) == UNKNOWN), spelled).otherwise(F.transform("segments", own)).alias("ids"))


def _merged(n: Column) -> Column:
    """Bounds that merging leaves, as the bits of a number: an edge merges two symbols if its ends are bounds and one bound lies between."""
    m, whole = F.col("m"), bit(n + 1) - F.lit(1).cast("bigint")
    fits = lambda b, y: (b.bitwiseAND(y["ends"]) == y["ends"]) & (F.bit_count(b.bitwiseAND(y["inner"])) == 1)
    without = lambda b, y: b.bitwiseAND(F.bitwise_not(y["inner"]))

    def once(a: Column, x: Column) -> Column:
        passed = (x["x"].bitwiseAND(LATE) != 0) & F.exists(m, lambda y: (y["x"] < x["x"]) & fits(without(a["b"], x), y))
        return F.when(fits(a["b"], x), F.struct(without(a["b"], x).alias("b"), (a["again"] | passed).alias("again"))).otherwise(a)

    def best(b: Column, _: Column) -> Column:
        return F.coalesce(without(b, F.get(F.filter(m, lambda y: fits(b, y)), F.lit(0))), b)

    first = F.aggregate(m, F.struct(whole.alias("b"), F.lit(False).alias("again")), once)
    return let(first, lambda a: F.when(a["again"], F.aggregate(F.sequence(F.lit(1), n), whole, best)).otherwise(a["b"]))


def _best(n: Column, pieces: Pieces) -> Column:
    """Bounds of the path of the best sum of scores, by Viterbi."""
    table_, m = pieces.scores(), F.col("m")
    score = lambda x: F.when(x.bitwiseAND(UNKNOWN) == UNKNOWN, F.lit(pieces.unknown)).otherwise(F.get(table_, x.bitwiseAND(UNKNOWN).cast("int")))

    def step(best: Column, e: Column) -> Column:
        into = F.filter(m, lambda y: END(y["x"]) == e)
        ways = F.transform(into, lambda y: F.struct((F.get(best, START(y["x"]))["score"] + score(y["x"])).alias("score"), (-START(y["x"])).alias("back")))
        return F.concat(best, F.array(F.array_max(ways)))

    def trace(best: Column) -> Column:
        def back(a: Column, _: Column) -> Column:
            return F.when(a["at"] > 0, F.struct((-F.get(best, a["at"])["back"]).alias("at"), (a["b"] + bit(a["at"])).alias("b"))).otherwise(a)

        return F.aggregate(F.sequence(F.lit(1), n), F.struct(n.alias("at"), F.lit(1).cast("bigint").alias("b")), back, lambda a: a["b"])

    return let(F.aggregate(F.sequence(F.lit(1), n), F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("back"))), step), trace)


def long_ids(word: str, table_: dict[str, tuple[int, float]], first_byte: int, merges: bool, longest: int, unknown: float) -> list[int]:
    """Ids of a word of any length: merges by a heap, or Viterbi over the pieces that end at each place."""
    n = len(word)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # a symbol is known by its start
    if merges:
        heap: list[tuple[float, int, int, int]] = []

        def push(i: int) -> None:
            if i >= 0 and end[i] < n and end[end[i]] - i <= longest and (found := table_.get(word[i : end[end[i]]])):
                heappush(heap, (-found[1], i, end[i], end[end[i]]))

        for i in range(n):
            push(i)
        while heap:
            _, i, middle, e = heappop(heap)
            if end[i] == middle and middle >= 0 and end[middle] == e:
                end[i], end[middle] = e, -1
                if e < n:
                    before[e] = i
                push(i)
                push(before[i])
    else:
        best, back = [0.0] + [float("-inf")] * n, [0] * (n + 1)
        for e in range(1, n + 1):
            for s in range(max(0, e - longest), e):
                found = table_.get(word[s:e]) or ((0, unknown) if e - s == 1 else None)
                if found and best[s] + found[1] > best[e]:
                    best[e], back[e] = best[s] + found[1], s
        e = n
        while e:
            end[back[e]] = e
            e = back[e]
    out, i = [], 0
    while i < n:
        piece = word[i : end[i]]
        out += [table_[piece][0]] if piece in table_ else [first_byte + x for x in piece.encode("utf-8", "replace")]
        i = end[i]
    return out


class _Known(dict):
    """What `make` gives for a text, kept for those of at most LONG characters."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, key: str) -> bytes:
        found = self.make(key)
        if len(key) <= LONG:
            self[key] = found
        return found

    def forget(self) -> None:
        """Beyond KNOWN entries the later half goes: the frequent ones came first."""
        if len(self) > KNOWN:
            while len(self) > KNOWN // 2:
                self.popitem()


class Encoder:
    """Ids of whole texts. frequent: ids of spans that are known beforehand, as bytes of 32-bit numbers; the others are merged by a heap."""

    def __init__(self, rows: list[tuple[str, int, float]], first_byte: int, merges: bool, longest: int, unknown: float, frequent: dict[str, bytes]):
        self.table, self.rest, self.frequent = {p: (i, s) for p, i, s in rows}, (first_byte, merges, longest, unknown), frequent
        self.pairs = {p[k : k + 2] for p, _, _ in rows for k in range(len(p) - 1)}
        self.spans, self.words = _Known(self._span), _Known(self._word)

    def cut(self, word: str) -> list[str]:
        """The spans of a word, with the meta symbol before it: no piece holds the two characters at a cut."""
        word, pairs = META + word, self.pairs
        at = [0, *(k for k in range(1, len(word)) if word[k - 1 : k + 1] not in pairs), len(word)]
        return [word[a:b] for a, b in zip(at, at[1:])]

    def _span(self, span: str) -> bytes:
        return array("i", long_ids(span, self.table, *self.rest)).tobytes()

    def _word(self, word: str) -> bytes:
        return b"".join([self.frequent.get(s) or self.spans[s] for s in self.cut(word)])

    def encode(self, text: str) -> tuple[bytes, int]:
        """The ids, as bytes of 32-bit numbers, and the number of words."""
        words, out = units(text), []
        for at in range(0, len(words), STEP):
            out += map(self.words.__getitem__, words[at : at + STEP])
            self.words.forget()
            self.spans.forget()
        return b"".join(out), len(words)


def _spelled(ids: str, pieces: Pieces) -> Column:
    """The bytes of the pieces in hex."""
    table_ = pieces.hexes()
    return F.array_join(F.transform(ids, lambda i: F.get(table_, i)), "")


@contextmanager
def grouped_in_memory(spark: SparkSession, keys: int) -> Iterator[None]:
    """While it lasts, lists of up to `keys` words are grouped in a task's memory; else Spark would sort the edges on disk."""
    before = spark.conf.get(FALLBACK)
    spark.conf.set(FALLBACK, keys)
    try:
        yield
    finally:
        spark.conf.set(FALLBACK, before)


def _made(pieces: Pieces) -> tuple:
    return pieces.rows, pieces.bytes[0], pieces.merges, pieces.longest, pieces.unknown


def hot_spans(docs: DataFrame, pieces: Pieces, hot: int) -> DataFrame:
    """(word) of the most frequent spans, of at most LONG characters, of a sample of the rows."""
    shared = docs.sparkSession.sparkContext.broadcast(_made(pieces))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, words = Encoder(*shared.value, {}).cut, Counter()

        def flush() -> pa.RecordBatch:
            spans: Counter = Counter()
            for word, n in words.items():
                for s in cut(word):
                    spans[s] += n * (len(s) <= LONG)
            words.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(spans), pa.string()), pa.array(list(spans.values()), pa.int64())], names=["word", "n"])

        for b in batches:
            for text in b.column(0).to_pylist():
                words.update(units(text or ""))
                if len(words) > KNOWN:
                    yield flush()
        yield flush()

    own = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0)
    counts = own.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where("n > 0")
    return counts.orderBy(F.col("n").desc(), "word").limit(hot).select("word")


def encoded(docs: DataFrame, pieces: Pieces, keep: tuple[str, ...], hot: int = HOT) -> DataFrame:
    """`keep`, ids and n_words of each whole text, a row for every row."""
    spark = docs.sparkSession
    with grouped_in_memory(spark, 4 * A_TASK):
        top = settle(hot_spans(docs, pieces, hot))
        known = settle(encode_words(top.repartition(max(1, -(-top.count() // A_TASK * 4)), "word"), pieces))
    # at most `hot` spans of at most LONG characters: a proven bound for what the driver sees and what is broadcast
    got = known.toArrow()
    flat, stops = got.column("ids").combine_chunks(), np.cumsum([0, *(len(x) for x in got.column("ids"))]).tolist()
    raw = flat.flatten().to_numpy().astype("<i4").tobytes()
    frequent = {w: raw[4 * a : 4 * b] for w, a, b in zip(got.column("word").to_pylist(), stops, stops[1:])}
    drop_settled(top)
    drop_settled(known)
    shared = spark.sparkContext.broadcast((*_made(pieces), frequent))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_ = Encoder(*shared.value).encode
        for b in slices(batches, "text", SLICE):
            made = [encode_(x or "") for x in b.column(b.schema.get_field_index("text")).to_pylist()]
            ends = np.cumsum([0, *(len(x) // 4 for x, _ in made)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(x for x, _ in made), np.int32)))
            own = [b.column(b.schema.get_field_index(n)) for n in keep]
            yield pa.RecordBatch.from_arrays([*own, ids, pa.array([n for _, n in made], pa.int64())], names=[*keep, "ids", "n_words"])

    kinds = dict(docs.dtypes)
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, ", ".join([*(f"`{n}` {kinds[n]}" for n in keep), "ids array<int>, n_words bigint"]))


def encode(docs: DataFrame, pieces: Pieces, hot: int = HOT) -> DataFrame:
    """(doc_id, ids) of each whole text, a row for every row."""
    return encoded(docs, pieces, ("doc_id",), hot).select("doc_id", "ids")


def _read_back(pieces: Pieces) -> Column:
    text = F.translate(F.try_to_binary(_spelled("ids", pieces), F.lit("hex")).cast("string"), META, " ")
    return F.coalesce(F.regexp_replace(text, "^ ", ""), F.lit(""))


def decode(coded: DataFrame, pieces: Pieces) -> DataFrame:
    """(doc_id, text) from (doc_id, ids), without the dummy prefix, row by row. Bytes that are no UTF-8 read as the replacement character."""
    return coded.select("doc_id", _read_back(pieces).alias("text"))


def digest(docs: DataFrame, pieces: Pieces, hot: int = HOT) -> DataFrame:
    """(doc_id, n_words, n_pieces, ids_digest, decoded) of each whole text, from its ids: their number, the hash of them all in order, and whether the text decoded from them is the text."""
    coded = encoded(docs.select("doc_id", "text"), pieces, ("doc_id", "text"), hot)
    same = _read_back(pieces) == F.coalesce(F.translate("text", META, " "), F.lit(""))
    return coded.select("doc_id", "n_words", F.size("ids").cast("bigint").alias("n_pieces"), F.xxhash64("ids").alias("ids_digest"), same.alias("decoded"))


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents", "doc_id", "text"), Pieces(model_path()))
