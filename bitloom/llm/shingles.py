"""Near-duplicates by the Jaccard similarity of 5-word shingles, 0.8 or more: an exact join by prefixes, each candidate verified on whole sets.

Texts of the same words are one class first. All shingles have one order: by hash, those of many texts last. Of two sets
with the similarity, each has one of the other's shingles among its first n - ceil(0.8 n) + 1, so the keys of a class
are these, and every pair that shares a key at places (and of sizes) that allow the similarity is a candidate: no pair is
missed. Which shingles count as those of many texts is found on a sample of the texts; it decides on the time alone.

Candidates are verified in two rounds: each class of a bucket with its smallest one, then all pairs of a bucket that
aren't in one component yet. Pairs within a component are left out, for they can't change it; so many copies of one text
cost a pass and not their square. Many unlike texts in one bucket do cost their square.
SimHash fingerprints of the same shingles, linked by the trie join of operator 5, are candidates of the first round too.

Edge cases: null and empty texts are one class; texts of fewer than five words are one shingle whole; a null doc_id keeps
its row and never names a component unless nothing else is in it.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import apart, drop_settled, lean, settle, slices
from .components import components
from .simhash import trie_join

WIDTH, SEED = 5, 42
#: Of the texts one in SAMPLE is looked at for shingles of many texts: those in OFTEN of them or more, the HOT most frequent ones at most.
SAMPLE, OFTEN, HOT = 16, 3, 200_000
SLICE = 1 << 20
#: Classes up to this many are broadcast to the texts (about 10 MB); more are joined by a shuffle.
BROADCAST_ROWS = 200_000
KEYS_A_BUCKET, TEXTS = 500_000, 1_000


def shingles(words: list[bytes], width: int = WIDTH) -> np.ndarray:
    """Distinct hashes of all runs of `width` words, sorted."""
    if not words:
        return np.zeros(0, np.uint64)
    flat, k, digest = b" ".join(words), min(width, len(words)), xxhash.xxh64_intdigest
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = (ends - np.array([len(w) for w in words])).tolist()
    return np.unique(np.array([digest(flat[s:e], SEED) for s, e in zip(starts, ends[k - 1 :].tolist())], np.uint64))


def simhash_of(own: np.ndarray) -> int:
    """Signed 64-bit SimHash of distinct hashes; zero for none."""
    bits = np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(own), bitorder="little").view("<i8")[0])


def keys(own: np.ndarray, similarity: float, hot: np.ndarray) -> np.ndarray:
    """The signed 64-bit prefix of a set of sorted hashes, in the order of all shingles: those of `hot` (sorted) come last."""
    n = len(own)
    if len(hot) and n:
        late = hot[np.minimum(np.searchsorted(hot, own), len(hot) - 1)] == own
        own = np.concatenate([own[~late], own[late]])
    return own[: n - math.ceil(similarity * n - 1e-9) + 1].view(np.int64)


def _words(x: pa.Scalar) -> list[bytes]:
    return (x.as_py() or b"").lower().split()  # bytes: only A-Z change, as in op5


def often(docs: DataFrame, sample: int = SAMPLE, least: int = OFTEN, most: int = HOT) -> np.ndarray:
    """Sorted hashes of the `most` most frequent shingles at most that stand in `least` or more of a sample of the different texts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", SLICE):
            every = [shingles(_words(x)) for x in b.column(0).cast(pa.binary())]
            h, n = np.unique(np.concatenate(every), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])

    own = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(sample)) == 0).distinct()
    found = own.mapInArrow(lean(run), "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return np.sort(np.array([r.h for r in found.orderBy(F.desc("n"), "h").limit(most).select("h").collect()], np.int64).view(np.uint64))


def same(text: str = "text") -> Column:
    """A digest of a text's words, as `_words` has them: cheap to find again, so that no copy of the texts is kept beside the table."""
    low = F.translate(F.coalesce(F.col(text), F.lit("")), ascii_uppercase, ascii_lowercase)
    return F.unhex(F.md5(F.encode(F.trim(F.regexp_replace(low, r"[\x20\x09-\x0D]+", " ")), "utf-8")))


def _marked(docs: DataFrame, similarity: float) -> DataFrame:
    """doc_id, same, n (shingles), fp (their SimHash) and keys of each text."""
    shared = docs.sparkSession.sparkContext.broadcast(often(docs))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, fps, own_keys = [], [], []
            for x in b.column(2).cast(pa.binary()):
                own = shingles(_words(x))
                n.append(len(own))
                fps.append(simhash_of(own))
                own_keys.append(keys(own, similarity, shared.value) if len(own) else ())
            cols = [b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(fps, pa.int64()), pa.array(own_keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "same", "n", "fp", "keys"])

    return docs.select("doc_id", same().alias("same"), "text").mapInArrow(lean(run), f"doc_id {dict(docs.dtypes)['doc_id']}, same binary, n bigint, fp bigint, keys array<bigint>")


def _met(classes: DataFrame, similarity: float) -> DataFrame:
    """(key, rep, n, at, c, lead, near) of the keys that c classes share, 2 or more: lead is the smallest of them; near, whether sizes and places allow the similarity to it. at: the key's place.

    Most keys are one class's alone, so all go to their buckets packed, and rows are made of the others only. Of two classes only the second has a row.
    """
    buckets = max(int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(classes.agg(F.sum(F.size("keys"))).first()[0] or 0) // KEYS_A_BUCKET))
    kinds = (np.int64, np.int64, np.uint32, np.uint32)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(at, TEXTS) for b in batches for at in range(0, b.num_rows, TEXTS)):
            size = pc.list_value_length(b.column(2)).to_numpy(zero_copy_only=False).astype(np.int64)
            key = b.column(2).flatten().to_numpy(zero_copy_only=False)
            place = np.arange(len(key)) - np.repeat(np.cumsum(size) - size, size)
            bucket = (key.view(np.uint64) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            flat = [x[order].astype(t) for x, t in zip((key, np.repeat(b.column(0).to_numpy(), size), np.repeat(b.column(1).to_numpy(), size), place), kinds)]
            stops = np.r_[0, np.cumsum(np.bincount(bucket, minlength=buckets))]
            own = np.flatnonzero(np.diff(stops)).tolist()
            cols = [pa.array([x[stops[k] : stops[k + 1]].tobytes() for k in own], pa.binary()) for x in flat]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), *cols], names=["bucket", "key", "rep", "n", "at"])

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[bytes]] = [[], [], [], []]
        for b in batches:
            for k, own in enumerate(parts):
                own.extend(b.column(k + 1).to_pylist())
        if not parts[0]:
            return
        key, rep, n, at = (np.frombuffer(b"".join(x), t) for x, t in zip(parts, kinds))
        parts.clear()
        order = np.lexsort((rep, key))
        key, rep, n, at = key[order], rep[order], n[order].astype(np.int64), at[order].astype(np.int64)
        head = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        c = np.diff(np.r_[head, len(key)])
        lead, c = np.repeat(head, c), np.repeat(c, c)
        near = (np.minimum(n - at, n[lead] - at[lead]) * (1 + similarity) >= (n + n[lead]) * similarity - 1e-9) & (lead != np.arange(len(key)))
        some = (c > 2) | (c == 2) & near
        cols = [pa.array(x[some]) for x in (key, rep, n, at, c, rep[lead], near)]
        yield from pa.table(cols, names=["key", "rep", "n", "at", "c", "lead", "near"]).to_batches(max_chunksize=50_000)

    made = classes.select("rep", "n", "keys").mapInArrow(lean(run), "bucket int, key binary, rep binary, n binary, at binary")
    return made.repartition(buckets, "bucket").mapInArrow(lean(meet), "key bigint, rep bigint, n bigint, at bigint, c bigint, lead bigint, near boolean")


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) of classes whose sets reach the Jaccard similarity."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(_words(x)).view(np.int64) for x in b.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["rep", "own"])

    ids = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    known = settle(classes.select("rep", "same").join(ids, "rep"), free=True)
    few = F.broadcast(known) if known.count() <= BROADCAST_ROWS else known
    one = docs.select("text", same().alias("same")).join(few, "same").groupBy("rep").agg(F.first("text").alias("text"))
    sets = settle(one.mapInArrow(lean(run), "rep bigint, own array<bigint>"), free=True)
    both = pairs.join(sets.select(F.col("rep").alias("a"), F.col("own").alias("x")), "a").join(sets.select(F.col("rep").alias("b"), F.col("own").alias("y")), "b")
    both = both.withColumn("shared", F.size(F.array_intersect("x", "y")))
    links = settle(both.where(F.col("shared") * (1 + similarity) >= (F.size("x") + F.size("y")) * similarity - 1e-9).select("a", "b"), free=True)
    drop_settled(sets)
    drop_settled(known)
    return links


def _near(a: str, b: str, i: str, j: str, similarity: float) -> Column:
    """Sizes (a, b), and places (i, j) of a shared key that is the first one, that allow the similarity."""
    return F.least(F.col(a) - F.col(i), F.col(b) - F.col(j)) * (1 + similarity) >= (F.col(a) + F.col(b)) * similarity - 1e-9


def _fingerprint_pairs(classes: DataFrame) -> DataFrame:
    """(a, b): classes of one fingerprint with the smallest of them, and the smallest ones of linked fingerprints."""
    lead = settle(classes.where("n > 0").groupBy("fp").agg(F.min("rep").alias("lead")), free=True)
    edges = trie_join(lead.select("fp"))
    same = classes.join(lead, "fp").where(F.col("rep") != F.col("lead")).select(F.col("lead").alias("a"), F.col("rep").alias("b"))
    linked = edges.join(lead.select(F.col("fp").alias("a"), F.col("lead").alias("x")), "a").join(lead.select(F.col("fp").alias("b"), F.col("lead").alias("y")), "b")
    return same.unionByName(linked.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))


def links(classes: DataFrame, docs: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) that connect all classes (rep, same, n, fp, keys) as all pairs at the similarity do."""
    met = settle(_met(classes, similarity), free=True)
    stars = met.where("near").select(F.col("lead").alias("a"), F.col("rep").alias("b"))
    tried = settle(stars.unionByName(_fingerprint_pairs(classes)).distinct(), free=True)
    first = _verified(tried, classes, docs, similarity)
    root = components(first)
    # two classes of a key have met above
    bucket = settle(met.where("c > 2").join(root.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", "n", "at", F.coalesce("root", "rep").alias("root")), free=True)
    drop_settled(met)
    part = bucket.select("key", "root").distinct()
    cross = part.select("key", F.col("root").alias("p")).join(part.select("key", F.col("root").alias("q")), "key").where("p < q")
    left = bucket.select("key", F.col("root").alias("p"), F.col("rep").alias("i"), F.col("n").alias("ni"), F.col("at").alias("ati"))
    right = bucket.select("key", F.col("root").alias("q"), F.col("rep").alias("j"), F.col("n").alias("nj"), F.col("at").alias("atj"))
    rest = cross.join(left, ["key", "p"]).join(right, ["key", "q"]).where(_near("ni", "nj", "ati", "atj", similarity))
    rest = settle(rest.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).distinct().join(tried, ["a", "b"], "left_anti"), free=True)
    drop_settled(bucket)
    return first.unionByName(_verified(rest, classes, docs, similarity))


def deduplicate(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """One row of each component, with all columns: that of the smallest doc_id (of rows that repeat it, one)."""
    from pyspark.sql import Window as W

    docs, _, back = apart(docs, "same", "_id", "_r")
    own = settle(_marked(docs, similarity), free=True)
    classes = own.groupBy("same").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("keys").alias("keys"))
    classes = settle(classes.withColumn("rep", F.monotonically_increasing_id()), free=True)
    drop_settled(own)
    root = components(links(classes, docs, similarity))
    named = settle(classes.join(root.withColumnRenamed("node", "rep"), "rep", "left").select("same", "least", F.coalesce("root", "rep").alias("root")), free=True)
    # the smallest (doc_id, same) of a component wins: narrow, and pre-aggregated before the shuffle
    least = named.groupBy("root").agg(F.min("least").alias("_id"))
    win = named.join(least, "root").where(F.col("least").eqNullSafe(F.col("_id"))).groupBy("root").agg(F.min("same").alias("same"), F.first("_id").alias("_id"))
    own = docs.withColumn("same", same())
    kept = own.join(win, (own["same"] == win["same"]) & own["doc_id"].eqNullSafe(win["_id"]), "left_semi")
    once = W.partitionBy("doc_id", "same").orderBy("text")
    return kept.withColumn("_r", F.row_number().over(once)).where("_r = 1").select(*back)
