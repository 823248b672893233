"""An index of codes by key, apart from collections: add, remove, and search by the share of equal bytes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.distance import mismatch_similarity
from .search import top_k

SCHEMA = "key string, code array<int>, ordinal bigint"


class CodeIndex:
    """Keys with their codes, in the order in which they were added. A key that is added again gets the new code and keeps its place."""

    def __init__(self, spark: SparkSession):
        self.spark, self.table, self._next = spark, spark.createDataFrame([], SCHEMA), 0

    def add(self, key: str, code: Sequence[int]) -> None:
        self.add_batch([key], [code])

    def add_batch(self, keys: Sequence[str] | DataFrame, codes: Sequence[Sequence[int]] | None = None) -> None:
        """Two lists, or a DataFrame (key, code)."""
        if isinstance(keys, DataFrame):
            new = keys.select(F.col("key").cast("string").alias("key"), "code", (F.monotonically_increasing_id() + self._next).alias("ordinal"))
            self._next += 1 << 53  # above any row number of the table
        else:
            if len(keys) != len(codes or []):
                raise ValueError("keys and codes differ in length")
            last = dict(zip(keys, codes or []))
            new = self.spark.createDataFrame([(k, [int(x) for x in c], self._next + n) for n, (k, c) in enumerate(last.items())], SCHEMA)
            self._next += len(last)
        placed = new.join(self.table.select("key", F.col("ordinal").alias("_o")), "key", "left").select("key", "code", F.coalesce("_o", "ordinal").alias("ordinal"))
        self.table = self.table.join(new.select("key"), "key", "left_anti").unionByName(placed)

    def remove(self, keys: str | Sequence[str]) -> None:
        keys = [keys] if isinstance(keys, str) else list(keys)
        self.table = self.table.where(~F.col("key").isin(*keys)) if keys else self.table

    def search(self, query: Sequence[int], k: int) -> DataFrame:
        """(key, score) of the k codes of the query's width with most equal bytes, best first; equal ones in the order of addition."""
        rows = self.table.where(F.size("code") == len(query))
        q = F.array(*[F.lit(int(x)) for x in query])
        return top_k(rows, mismatch_similarity(F.col("code"), q), k, descending=True).select("key", "score")
