"""Operator 10, embedding near-duplicates: a forest of random-projection trees with spill, verified by cosine in double.

Equal vectors are one class first. Every tree splits on random directions at the median of a bounded sample, and rows
within the margin `SPILL` of a split go down both sides; every row is indexed in every tree. Rows that share a leaf are
compared; a pair counts in the first leaf that it shares, so link counts need no shuffle of pairs, and a task emits
counts and a spanning forest, never all pairs. A leaf of more than `BLOCK` rows is compared in pairs of its blocks, each
a task of its own: no leaf is cut off and no task is large.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite components link with nothing and keep their
row; vectors of different lengths don't link; equal vectors under one or several ids link if the vector is sound;
a null vec_id keeps its row; an empty table gives an empty result; extra columns go.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import drop_settled, settle, table
from .components import components, forest

THRESHOLD, TREES, LEAF, SPILL, SAMPLE, BLOCK, SEED = 0.9, 8, 512, 0.02, 16_384, 4096, 5
TOP, DEEPER = 12, 2


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, safe from overflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


class Forest:
    """Directions and cuts of all trees, fitted on unit vectors. Its size is bounded: a level of a tree has one direction, and at most 2^TOP cuts.

    A node splits at the median of the sample rows in it; below level TOP, at that of its ancestor's there, and without a
    sample row at that of the whole sample. Deeper forests have more trees (`DEEPER` levels a tree), for a link has to
    survive every level of one.
    """

    def __init__(self, sample: np.ndarray, depth: int, trees: int | None = None, seed: int = SEED):
        self.depth, self.trees = depth, []
        for t in range((trees or TREES + max(0, depth - TREES) // DEEPER) if len(sample) else 0):
            dirs = np.random.default_rng([seed, t]).standard_normal((depth, sample.shape[1]))
            dirs /= np.linalg.norm(dirs, axis=1, keepdims=True)
            p, node, cuts = sample @ dirs.T, np.zeros(len(sample), np.int64), []
            for level in range(depth):
                own = node >> max(0, level - TOP)
                order = np.lexsort((p[:, level], own))
                got, first, n = np.unique(own[order], return_index=True, return_counts=True)
                cut = np.full(1 << min(level, TOP), np.median(p[:, level]))
                cut[got] = (p[order[first + (n - 1) // 2], level] + p[order[first + n // 2], level]) / 2
                cuts.append(cut)
                node = 2 * node + (p[:, level] > cut[own])
            self.trees.append((dirs, cuts))

    def leaves(self, x: np.ndarray, spill: float = SPILL) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) for every leaf of every tree that a row goes down to, sorted by row and leaf."""
        rows, leaves = [], []
        for t, (dirs, cuts) in enumerate(self.trees):
            p = x @ dirs.T
            row, node = np.arange(len(x)), np.zeros(len(x), np.int64)
            for level, cut in enumerate(cuts):
                q = p[row, level] - cut[node >> max(0, level - TOP)]
                left, right = q <= spill, q > -spill
                row, node = np.r_[row[left], row[right]], np.r_[2 * node[left], 2 * node[right] + 1]
            rows.append(row)
            leaves.append((t << 40) + node)
        row, leaf = np.concatenate(rows), np.concatenate(leaves)
        order = np.lexsort((leaf, row))
        return row[order], leaf[order]


def _links(x: np.ndarray, y: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of unit rows whose cosine reaches the threshold."""
    return np.nonzero(x @ y.T >= threshold)


def _earlier(lists: pa.ListArray, here: int) -> np.ndarray:
    """For each row a bit set of the leaves before `here` that it is in, over those that any row is in."""
    sizes = np.diff(lists.offsets.to_numpy())
    row, leaf = np.repeat(np.arange(len(sizes)), sizes), lists.flatten().to_numpy()
    before = leaf < here
    uniq, place = np.unique(leaf[before], return_inverse=True)
    member = np.zeros((len(sizes), max(64, -(-len(uniq) // 64) * 64)), bool)
    member[row[before], place] = True
    return np.packbits(member, axis=1).view(np.uint64)


def compare_task(rows: pa.Table, threshold: float = THRESHOLD) -> pa.Table:
    """One leaf, or two blocks of it: rows (rep, n, leaf, leaves, block, mixed, embedding) to (rep, links, root)."""
    rep, weight = rows.column("rep").to_numpy(), rows.column("n").to_numpy()
    here = rows.column("leaf")[0].as_py()
    x = unit(np.array(rows.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(rep), -1))
    lists = rows.column("leaves").combine_chunks()
    earlier = _earlier(lists, here)
    block = rows.column("block").to_numpy()
    mixed = rows.column("mixed")[0].as_py()
    count, ends = np.zeros(len(rep), np.int64), np.zeros((2, 0), np.int64)
    first = np.flatnonzero(block == block.min()) if mixed else np.arange(len(rep))
    other = np.flatnonzero(block != block.min()) if mixed else first
    for at in range(0, len(first), 1024):
        own = first[at : at + 1024]
        i, j = _links(x[own], x[other], threshold)
        i, j = own[i], other[j]
        if not mixed:
            i, j = i[i < j], j[i < j]
        for s in range(0, len(i), 1 << 16):
            p, q = i[s : s + (1 << 16)], j[s : s + (1 << 16)]
            new = ~(earlier[p] & earlier[q]).any(axis=1)  # a pair counts in the first leaf that it shares
            p, q = p[new], q[new]
            np.add.at(count, p, weight[q])
            np.add.at(count, q, weight[p])
            if len(p):
                root = forest(len(rep), np.r_[ends[0], p], np.r_[ends[1], q])
                has = np.flatnonzero(root != np.arange(len(rep)))
                ends = np.stack([has, root[has]])
    root = np.arange(len(rep))
    root[ends[0]] = ends[1]
    keep = (count > 0) | (root != np.arange(len(rep)))
    return pa.table({"rep": pa.array(rep[keep]), "links": pa.array(count[keep]), "root": pa.array(rep[root[keep]])})


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, leaf: int = LEAF, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of (vec_id, embedding)."""
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", F.col("embedding").alias("embedding"))
    fine = F.expr("embedding is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)")
    sound = rows.where(F.coalesce(fine, F.lit(False)))
    # class number: a hash can't stand for a vector, so classes are numbered by their smallest id, null ids by none
    classes = settle(sound.groupBy("embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("n")).withColumn("rep", F.monotonically_increasing_id()))
    dims = [r.d for r in classes.select(F.size("embedding").alias("d")).distinct().orderBy("d").collect()]
    parts = []
    for d in dims:
        own = classes.where(F.size("embedding") == d)
        total = own.count()
        share = min(1.0, SAMPLE / total)
        picked = own.where(F.pmod(F.xxhash64("embedding"), F.lit(1 << 30)) < int(share * (1 << 30))).select("embedding").limit(2 * SAMPLE).collect()
        sample = np.array(sorted(list(r.embedding) for r in picked), np.float64).reshape(-1, d)
        depth = max(0, ceil(log2(max(1, total) / leaf))) if len(sample) else 0
        trees = spark.sparkContext.broadcast(Forest(unit(sample) if len(sample) else np.eye(1, d), depth))

        def index(batches: Iterator[pa.RecordBatch], d: int = d, trees=trees) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for s in range(0, b.num_rows, 2048):
                    part = b.slice(s, 2048)
                    x = unit(np.array(part.column(2).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(part.num_rows, d))
                    row, leaves = trees.value.leaves(x)
                    counts = np.bincount(row, minlength=part.num_rows)
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(leaves))], names=["rep", "n", "embedding", "leaves"])

        kind = dict(classes.dtypes)["embedding"]
        indexed = settle(own.select("rep", "n", "embedding").mapInArrow(index, f"rep bigint, n bigint, embedding {kind}, leaves array<bigint>"))
        each = indexed.select("rep", "n", "embedding", "leaves", F.explode("leaves").alias("leaf"))
        sizes = indexed.select(F.explode("leaves").alias("leaf")).groupBy("leaf").count()
        # leaves over the block size: at most rows x trees / BLOCK, and usually none
        hot = sizes.where(F.col("count") > block).select("leaf", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
        each = each.join(hot, "leaf", "left").withColumn("block", F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).otherwise(0))
        each = each.withColumn("other", F.explode(F.when(F.col("blocks") > 1, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.lit(0)))))
        tasks = each.select("rep", "n", "embedding", "leaves", "leaf", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), (F.col("block") != F.col("other")).alias("mixed"))
        parts.append(tasks.groupBy("leaf", "lo", "hi").applyInArrow(lambda rows: compare_task(rows, threshold), "rep bigint, links bigint, root bigint"))
    if not parts:
        return rows.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = parts[0]
    for more in parts[1:]:
        found = found.unionByName(more)
    found = settle(found)
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    root = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("rep"), "root")
    named = classes.join(links, "rep", "left").join(root, "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    named = settle(named.select("embedding", "least", "rep", "root", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    label = named.join(least, "root").select("embedding", "n_links", "component_id")
    out = sound.join(label, "embedding").select("vec_id", "n_links", "component_id")
    rest = rows.where(~F.coalesce(fine, F.lit(False))).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    drop_settled(found)
    return out.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op10_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))
