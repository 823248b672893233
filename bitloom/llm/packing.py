"""Operator 9, best-fit packing: best-fit decreasing in partitions, certified by dual-feasible-function lower bounds.

A piece of `capacity` tokens fills a sequence alone. The others are packed in partitions of at most `per_task` pieces.
Each partition's number of bins is held against its lower bound (the largest over a family of dual feasible functions);
a partition at its bound is certified and stays. Partitions with a gap exchange documents: the pieces of their bins that
aren't full to the last token are spread anew over partitions and packed again, until no gap is left, a single partition
is left, or a round saves no bin. Every row carries its partition's bound and gap.

Edge cases: null and empty texts are one piece of the end id alone; equal texts and repeated ids are packed as rows of
their own; a null doc_id is kept; extra columns go.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import KEPT, lean, settle, slices, table

CAPACITY, END, PER_TASK, KNOWN, SLICE = 4096, 1, 100_000, 300_000, 1 << 20
TOKENIZER = "word_bpe_49k.json"
#: Characters on which Python and the tokenizer might disagree whether they are white space.
ODD_SPACE = re.compile("[\x1c-\x1f\x85\u1680\u180e\u2000-\u200f\u2028\u2029\u202f\u205f\u3000\ufeff]")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


#: A word that surely is one pre-token of letters and one of signs; anything else goes to the tokenizer whole.
SIMPLE = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+)([.,!?:;*%&$#()\"|-]*)")


class _Known(dict):
    """Numbers words as they come; `new` holds those that are still to be encoded."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n

    def forget(self, keep: int) -> None:
        while len(self) > keep:
            self.popitem()


class Encoder:
    """Ids of whole texts. The tokenizer never crosses white space, so it encodes each word once, and of simple words the letters.

    Of words and of letter runs the first `known` / 2 stay, which the frequent ones are among; the others are forgotten
    when there are more than `known`.
    """

    def __init__(self, path: str, known: int = KNOWN):
        from tokenizers import Tokenizer

        self.t, self.limit = Tokenizer.from_file(path), known
        self.model = self.t.model
        # lower-cased, for some capitals have their small letter far beyond
        letters = sorted({low for c in range(0x250) if SIMPLE.fullmatch(chr(c)) for low in chr(c).lower()})
        # how the tokenizer spells a letter's bytes
        self.spell = str.maketrans({c: "".join(x for x, _ in self.t.pre_tokenizer.pre_tokenize_str(c)) for c in letters})
        self.at, self.runs = _Known(), {}
        self.ids, self.used = np.empty(1 << 16, np.uint32), 0
        self.begin = np.zeros((1 << 16) + 1, np.int64)

    def whole(self, text: str) -> bytes:
        return array("I", self.t.encode(text, add_special_tokens=False).ids).tobytes()

    def run(self, low: str) -> bytes:
        """Ids of a lower-case run of letters."""
        found = self.runs.get(low)
        if found is None:
            if len(self.runs) > self.limit:
                while len(self.runs) > self.limit // 2:
                    self.runs.popitem()
            found = self.runs[low] = array("I", [t.id for t in self.model.tokenize(low.translate(self.spell))]).tobytes()
        return found

    def word(self, word: str) -> bytes:
        m = SIMPLE.fullmatch(word)
        if not m:
            return self.whole(word)
        letters, signs = m.groups()
        if not signs:
            return self.run(letters.lower())
        tail = self.runs.get(signs)
        if tail is None:
            tail = self.runs[signs] = self.whole(signs)
        return self.run(letters.lower()) + tail

    def learn(self) -> None:
        new = self.at.new
        found = list(map(self.word, new))
        flat = np.frombuffer(b"".join(found), np.uint32)
        stops = self.used + np.cumsum(np.fromiter(map(len, found), np.int64, len(found))) // 4
        k, n = len(self.at), len(self.at) - len(new)
        while k >= len(self.begin):
            self.begin = np.resize(self.begin, 2 * len(self.begin))
        while self.used + len(flat) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.ids[self.used : self.used + len(flat)] = flat
        self.begin[n + 1 : k + 1] = stops
        self.used += len(flat)
        new.clear()

    def encode(self, text: str) -> np.ndarray:
        return self.encode_many([text])[0]

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        odd = [bool(ODD_SPACE.search(t)) for t in texts]
        words = [[] if o else t.split() for t, o in zip(texts, odd)]
        flat = list(chain.from_iterable(words))
        step, sizes, ids = max(1, self.limit // 4), [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
        for at in range(0, len(flat), step):
            part = flat[at : at + step]
            if len(self.at) > self.limit:
                self.at.forget(self.limit // 2)
                self.used = int(self.begin[len(self.at)])
            codes = np.fromiter(map(self.at.__getitem__, part), np.int64, len(part))
            if self.at.new:
                self.learn()
            begin = self.begin[codes]
            size = self.begin[codes + 1] - begin
            sizes.append(size)
            ids.append(self.ids[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))])
        ids = np.concatenate(ids)
        stops = np.r_[0, np.cumsum(np.concatenate(sizes))][np.cumsum([0] + [len(w) for w in words])]
        return [np.frombuffer(self.whole(t), np.uint32) if o else ids[a:b] for t, o, a, b in zip(texts, odd, stops[:-1], stops[1:])]


#: One encoder for each path in a Python worker: what it knows serves the tasks that the worker runs after another, till one of another operator comes.
_ENCODERS: dict[str, Encoder] = KEPT.setdefault("packing", {})


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """One row per piece: a document's ids and `end`, cut every `capacity` tokens."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(path)
        for b in slices(batches, "text", SLICE):
            rows = []
            for doc, own in zip(b.column(0).to_pylist(), words.encode_many([x or "" for x in b.column(1).to_pylist()])):
                ids = np.append(own, np.uint32(end)).astype("<u4")
                for k, at in enumerate(range(0, len(ids), capacity)):
                    own = ids[at : at + capacity]
                    rows.append((doc, k, at, len(own), zlib.crc32(own.tobytes())))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            cols = list(zip(*rows)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[x.split()[0] for x in PIECES.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(lean(run, "packing"), PIECES)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs: the best of the sum, and of the dual feasible functions f_t (drop items under t, round those over capacity - t up) and u_k (rounding to k + 1 parts)."""
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1)[: capacity + 1].astype(np.int64)
    size = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((count * size).sum()) // capacity)
    n, total = np.cumsum(count), np.cumsum(count * size)
    t = np.arange(1, capacity // 2 + 1)
    middle = total[capacity - t] - total[t - 1]
    best = max(best, int((n[-1] - n[capacity - t] + -(-middle // capacity)).max()))
    for k in range(1, 101):
        whole = (k + 1) * size % capacity == 0
        u = np.where(whole, size * k, (k + 1) * size // capacity * capacity)
        best = max(best, -(-int((count * u).sum()) // (k * capacity)))
    return best


def best_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each item by best-fit decreasing: a stack of bins for each room left, and a bit set of the rooms in use."""
    bins = np.empty(len(lengths), np.int64)
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    used = count = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        fits = used >> need
        if fits:
            room = need + (fits & -fits).bit_length() - 1
            own = rooms[room].pop()
            if not rooms[room]:
                used ^= 1 << room
        else:
            room, own = capacity, count
            count += 1
        bins[i], left = own, room - need
        if left:
            if not rooms[left]:
                used |= 1 << left
            rooms[left].append(own)
    return bins


def _pack(rows: DataFrame, tasks: int, capacity: int, level: int) -> DataFrame:
    """Pack each of `tasks` partitions. Adds bin (unique over the round), load, and the partition's gap to its bound."""
    names = ["doc_id", "piece", "row", "length", "bin", "load", "bound", "gap"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own = [b for b in batches if b.num_rows]
        if not own:
            return
        t = pa.Table.from_batches(own).sort_by([("row", "ascending")])  # the same input is packed alike when a task runs again
        lengths = t.column("length").to_numpy()
        bins = best_fit(lengths, capacity)
        load = np.bincount(bins, weights=lengths).astype(np.int64)
        bound = lower_bound(lengths, capacity)
        base = TaskContext.get().partitionId() << 32
        cols = [*(t.column(n).combine_chunks() for n in names[:4]), pa.array(bins + base), pa.array(load[bins]), pa.array(np.full(len(bins), bound)), pa.array(np.full(len(bins), len(load) - bound))]
        for b in pa.table(cols, names=names).to_batches(max_chunksize=50_000):
            yield b

    part = F.pmod(F.xxhash64("row", F.lit(level)), F.lit(tasks)).cast("int")
    spread = rows.select("doc_id", "piece", "row", "length").withColumn("p", part).repartition(tasks, "p").drop("p")
    return spread.mapInArrow(run, "doc_id bigint, piece int, row bigint, length bigint, bin bigint, load bigint, bound bigint, gap bigint")


def pack(cut: DataFrame, capacity: int = CAPACITY, per_task: int = PER_TASK, exchange: bool = True) -> DataFrame:
    """Add sequence_id and offset to the rows of `pieces`, and bound and gap: the least bins of the partition that packed the row last, and the bins beyond."""
    # row: distinct for repeated (doc_id, piece) too, and settled, so that a repeated task sees the same numbers
    cut = settle(cut.withColumn("row", F.monotonically_increasing_id()))
    named = cut.where(F.col("length") >= capacity).select("row", (-F.col("row") - 1).alias("sequence_id"), F.lit(1).cast("bigint").alias("bound"), F.lit(0).cast("bigint").alias("gap"))
    todo, level, bins = cut.where(F.col("length") < capacity), 0, None
    n = todo.count()
    while n:
        tasks = -(-n // per_task)
        now = settle(_pack(todo, tasks, capacity, level))
        is_open = (F.col("gap") > 0) & (F.col("load") < capacity)
        each = now.groupBy("bin").agg(F.first(is_open).alias("open"), F.first("load").alias("load"), F.count("*").alias("n"))
        made, gaps, tokens, left = each.agg(F.count("*"), F.count_if("open"), F.coalesce(F.sum(F.when(F.col("open"), F.col("load"))), F.lit(0)), F.coalesce(F.sum(F.when(F.col("open"), F.col("n"))), F.lit(0))).first()
        # exchanging can save bins only if what the open bins hold fits into fewer; and the last exchange must have saved one
        again = exchange and tasks > 1 and left and -(-tokens // capacity) < gaps and (bins is None or made < bins)
        kept = now.where(~is_open) if again else now
        named = named.unionByName(kept.select("row", (F.lit(level << 52).cast("bigint") + F.col("bin")).alias("sequence_id"), "bound", "gap"))
        if not again:
            break
        todo, n, level, bins = now.where(is_open).select(*cut.columns[:2], "row", "length"), left, level + 1, gaps
    from pyspark.sql import Window as W

    out = cut.join(named, "row")
    before = W.partitionBy("sequence_id").orderBy("row").rowsBetween(W.unboundedPreceding, -1)
    return out.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("bigint")).drop("row")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path()))
