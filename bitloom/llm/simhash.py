"""Operator 5, SimHash near-duplicates: fingerprints of 4-word shingles, joined by a binary trie within a Hamming budget.

Five bits blocks (13, 13, 13, 13 and 12 bits): two fingerprints within 4 bits agree on one block whole. For each block
the fingerprints are rotated so that this block comes first; they form a trie whose nodes at that depth are the tasks.
Below it pairs of nodes are walked together, the differing bits add up, and a pair beyond the budget is dropped.
Small node pairs are compared at once. A task emits a spanning forest of its links, never all pairs.
A node with more than `max_node` fingerprints is split on: its next s bits give sub-nodes, and each pair of sub-nodes
within the budget is a task of its own, so no task holds a large share however the fingerprints cluster.

Edge cases: null and empty texts have fingerprint zero and link like any other; equal texts and repeated ids keep one
row each; a null doc_id keeps its row and never names a component unless nothing else is in it; extra columns go.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import apart, drop_settled, settle, table
from .components import components, forest

BUDGET, WIDTH, SEED, CHUNK = 4, 4, 42, 1 << 15
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
MAX_NODE, PER_TASK, PAIRS = 20_000, 200_000, 1 << 20
MOST_BITS = 12  # of a split: its sub-nodes' masks are literals of the plan


def fingerprint(raw: bytes, width: int = WIDTH, seed: int = SEED) -> int:
    """Unsigned 64-bit SimHash of a UTF-8 text."""
    words = raw.lower().split()  # bytes: only A-Z change, and these are the six ASCII spaces
    if not words:
        return 0
    flat = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = (ends - np.array([len(w) for w in words])).tolist()
    ends = ends.tolist()
    k = min(width, len(words))
    stops, digest, bits, n = ends[k - 1 :], xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(words) - k + 1
    for at in range(0, n, CHUNK):
        h = np.array([digest(flat[s:e], seed) for s, e in zip(starts[at : min(n, at + CHUNK)], stops[at : at + CHUNK])], np.uint64)
        bits += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """`keep` and fp, the fingerprint as a signed 64-bit number."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = b.column(b.schema.get_field_index("text")).cast(pa.binary())
            fps = np.array([fingerprint(x.as_py() or b"", width, seed) for x in text], np.uint64)
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(n)) for n in keep), pa.array(fps.view(np.int64))], names=[*keep, "fp"])

    kinds = dict(docs.dtypes)
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, ", ".join([*(f"`{n}` {kinds[n]}" for n in keep), "fp bigint"]))


def rotated(fp: Column, start: int) -> Column:
    return fp if start == 0 else F.shiftleft(fp, start).bitwiseOR(F.shiftrightunsigned(fp, 64 - start))


def _first_set(val: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """In each sorted range whose numbers agree above `bit`: where that bit turns 1."""
    lo, hi = lo.copy(), hi.copy()
    while True:
        live = lo < hi
        if not live.any():
            return lo
        mid = (lo + hi) >> 1
        one = (val[np.minimum(mid, len(val) - 1)] >> bit) & np.uint64(1) == 1
        hi = np.where(live & one, mid, hi)
        lo = np.where(live & ~one, mid + 1, lo)


def _compare(val: np.ndarray, node: np.ndarray, budget: int) -> Iterator[np.ndarray]:
    """Links between the small node pairs (rows: alo, ahi, blo, bhi)."""
    sizes = (node[1] - node[0]) * (node[3] - node[2])
    at = 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(np.cumsum(sizes[at:]), PAIRS, "right")) + at)
        s, part = sizes[at:end], node[:, at:end]
        own = np.repeat(np.arange(end - at), s)
        k = np.arange(len(own)) - np.repeat(np.cumsum(s) - s, s)
        wide = (part[3] - part[2])[own]
        i, j = part[0][own] + k // wide, part[2][own] + k % wide
        hit = (i < j) & (np.bitwise_count(val[i] ^ val[j]) <= budget)
        yield np.stack([i[hit], j[hit]])
        at = end


def trie_links(val: np.ndarray, node: np.ndarray, depth: np.ndarray, budget: int = BUDGET, leaf: int = 1024) -> np.ndarray:
    """Walk node pairs of the trie over sorted ranges of `val`. node: rows alo, ahi, blo, bhi, differing bits."""
    found = [np.zeros((2, 0), np.int64)]
    stack = [(node, depth)]
    while stack:
        node, depth = stack.pop()
        if node.shape[1] > 1 << 17:
            half = node.shape[1] // 2
            stack += [(node[:, :half], depth[:half]), (node[:, half:], depth[half:])]
            continue
        na, nb = node[1] - node[0], node[3] - node[2]
        live = (na > 0) & (nb > 0) & (node[4] <= budget) & ~((node[0] == node[2]) & (na == 1))
        small = live & ((na * nb <= leaf) | (depth >= 64))
        if small.any():
            found += _compare(val, node[:4, small], budget)
        go = live & ~small
        if not go.any():
            continue
        node, depth = node[:, go], depth[go]
        alo, ahi, blo, bhi, err = node
        bit = (63 - depth).astype(np.uint64)
        am, bm = _first_set(val, alo, ahi, bit), _first_set(val, blo, bhi, bit)
        cross = alo != blo
        kids = np.concatenate([np.stack([alo, am, blo, bm, err]), np.stack([am, ahi, bm, bhi, err]), np.stack([alo, am, bm, bhi, err + 1]), np.stack([am, ahi, blo, bm, err + 1])[:, cross]], axis=1)
        stack.append((kids, np.concatenate([depth + 1] * 3 + [(depth + 1)[cross]])))
    return np.concatenate(found, axis=1)


def _join_tasks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (task, cut, mixed, depth, val, fp): each task is a node with itself, or two sub-nodes with each other."""
    rows = [b for b in batches if b.num_rows]
    if not rows:
        return
    t = pa.Table.from_batches(rows)
    task, depth = (t.column(c).to_numpy() for c in ("task", "depth"))
    val, fp = t.column("val").to_numpy().view(np.uint64), t.column("fp").to_numpy()
    order = np.lexsort((val, task))
    task, depth, val, fp = task[order], depth[order], val[order], fp[order]
    mixed = t.column("mixed").to_numpy(zero_copy_only=False)[order]
    lo = np.flatnonzero(np.r_[True, task[1:] != task[:-1]])
    hi = np.r_[lo[1:], len(task)]
    node = np.stack([lo, hi, lo, hi, np.zeros_like(lo)])
    for g in np.flatnonzero(mixed[lo]):  # two sub-nodes: the first differing bit block separates them in sorted order
        high = val[lo[g] : hi[g]] >> np.uint64(64 - int(depth[lo[g]]))
        mid = lo[g] + int(np.searchsorted(high, high[0], "right"))
        node[:, g] = lo[g], mid, mid, hi[g], int(np.bitwise_count(high[0] ^ high[-1]))
    links = trie_links(val, node, depth[lo])
    uniq, inverse = np.unique(fp, return_inverse=True)
    root = forest(len(uniq), inverse[links[0]], inverse[links[1]])
    has = root != np.arange(len(uniq))
    yield pa.RecordBatch.from_arrays([pa.array(uniq[has]), pa.array(uniq[root[has]])], names=["a", "b"])


def few_bits(s: int, budget: int = BUDGET) -> list[int]:
    """All numbers of `s` bits with at most `budget` bits set."""
    return [sum(1 << k for k in bits) for n in range(min(s, budget) + 1) for bits in combinations(range(s), n)]


def trie_join(fps: DataFrame, max_node: int = MAX_NODE, per_task: int = PER_TASK) -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints within the budget: a spanning forest from each task."""
    spark = fps.sparkSession
    rows = fps.select(F.explode(F.array(*[F.struct(F.lit(k).alias("block"), F.lit(n).alias("depth"), rotated(F.col("fp"), s).alias("val")) for k, (s, n) in enumerate(BLOCKS)])).alias("x"), "fp").select("x.*", "fp")
    rows = rows.withColumn("task", F.shiftrightunsigned("val", 51) * 5 + F.col("block"))
    rows = rows.withColumn("task", F.when(F.col("depth") == 12, F.shiftrightunsigned("val", 52) * 5 + F.col("block")).otherwise(F.col("task")))
    sizes = rows.groupBy("task").count()
    # 5 x 2^13 nodes at most, whatever the input: a proven bound for what is broadcast
    hot = sizes.where(F.col("count") > max_node).select("task", F.least(F.lit(MOST_BITS), F.ceil(F.log2(F.col("count") / max_node)) + 1).cast("int").alias("s"))
    n = fps.count()
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-5 * n // per_task))
    rows = rows.join(F.broadcast(hot), "task", "left")
    plain = rows.where("s is null").select("task", F.lit(False).alias("mixed"), "depth", "val", "fp")
    u = F.expr("shiftrightunsigned(shiftleft(val, depth), 64 - s)")
    # each sub-node meets those within the budget: masks of few bits, made once for each s
    masks = F.coalesce(*[F.when(F.col("s") == s, F.array(*[F.lit(m).cast("bigint") for m in few_bits(s)])) for s in range(1, MOST_BITS + 1)])
    split = rows.where("s is not null").withColumn("u", u).withColumn("v", F.explode(F.transform(masks, lambda m: m.bitwiseXOR(F.col("u")))))
    split = split.select(F.xxhash64("task", F.least("u", "v"), F.greatest("u", "v")).alias("task"), (F.col("u") != F.col("v")).alias("mixed"), (F.col("depth") + F.col("s")).alias("depth"), "val", "fp")
    return plain.unionByName(split).repartition(tasks, "task").mapInArrow(_join_tasks, "a bigint, b bigint")


def roots(own: DataFrame) -> DataFrame:
    """(fp, root, least) of the distinct fingerprints of `own` (doc_id, fp): the component's smallest fingerprint, and the smallest doc_id of the fingerprint."""
    fps = settle(own.groupBy("fp").agg(F.min("doc_id").alias("least")))
    root = components(trie_join(fps.select("fp")))
    named = settle(fps.join(root.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    drop_settled(fps)
    return named


def simhash_components(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) for every row of `docs`."""
    own = settle(fingerprints(docs))
    named = roots(own)
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return own.join(named.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def deduplicate(docs: DataFrame, similarity: float | None = None) -> DataFrame:
    """One row of each component, with all columns: that of the smallest doc_id (of rows that repeat it, one).

    Components are of fingerprints within the budget; with a `similarity`, of texts whose 5-word shingles have that Jaccard
    similarity (see `shingles`), for which the fingerprints' links are candidates among others.
    """
    if similarity is not None:
        from . import shingles

        return shingles.deduplicate(docs, similarity)
    from pyspark.sql import Window as W

    docs, cols, back = apart(docs, "fp", "_id", "_r")
    own = settle(fingerprints(docs, cols))
    # the smallest (doc_id, fp) of a component wins: narrow, and pre-aggregated before the shuffle
    named = roots(own.select("doc_id", "fp"))
    win = named.groupBy("root").agg(F.min(F.struct(F.col("least").isNull(), "least", "fp")).alias("w")).select(F.col("w.least").alias("_id"), F.col("w.fp").alias("fp"))
    kept = own.join(win, (own["fp"] == win["fp"]) & own["doc_id"].eqNullSafe(win["_id"]), "left_semi")
    once = W.partitionBy("doc_id", "fp").orderBy("text")
    return kept.withColumn("_r", F.row_number().over(once)).where("_r = 1").select(*back)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_components(table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
