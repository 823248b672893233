"""Text to binary codes: a native hashing embedder, and the protocol for others."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bits import let, pack_bytes, sign_bits

DIMENSIONS = 64


class Embedder(Protocol):
    """Adds a column of dense vectors or codes to a DataFrame of texts."""

    dimensions: int

    def code(self, text: Column) -> Column: ...


class HashEmbedder:
    """Signed feature hashing of words: md5 of a word gives its dimension and sign. Native, no model file."""

    def __init__(self, dimensions: int = DIMENSIONS, prompt: str = ""):
        self.dimensions, self.prompt = dimensions, prompt

    def dense(self, text: Column) -> Column:
        """Sums of signs by dimension: a word becomes a character for its dimension and sign, and a text's characters are counted natively."""
        n = self.dimensions
        alphabet = F.lit("".join(chr(1 + i) for i in range(2 * n)))
        words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
        number = lambda h: F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint")
        place = lambda h: F.substring(alphabet, ((number(h) % n) * 2 + F.when(F.substring(h, 9, 1) < "8", 1).otherwise(2)).cast("int"), F.lit(1))
        signs = F.array_join(F.transform(words, lambda w: let(F.md5(F.encode(w, "utf-8")), place)), "")
        times = lambda s, i: F.length(s) - F.length(F.replace(s, F.substring(alphabet, i, F.lit(1)), F.lit("")))
        return let(signs, lambda s: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda d: times(s, 2 * d + 1) - times(s, 2 * d + 2)))

    def code(self, text: Column) -> Column:
        return pack_bytes(sign_bits(self.dense(text)))

    def codes(self, df: DataFrame, key: str, text: str = "text") -> DataFrame:
        """(key, code) by explode and two hash aggregations: for long texts, where the array form would scan words once a dimension."""
        n = self.dimensions
        w = df.select(key, F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).alias("w"))
        h = w.select(key, F.md5(F.encode("w", "utf-8")).alias("h"))
        place = h.select(key, (F.conv(F.substring("h", 1, 8), 16, 10).cast("bigint") % n).cast("int").alias("d"), F.when(F.conv(F.substring("h", 9, 1), 16, 10).cast("int") < 8, 1).otherwise(-1).alias("s"))
        bits = place.groupBy(key, "d").agg(F.sum("s").alias("v")).where("v > 0")
        bytes_ = bits.groupBy(key).agg(*[F.sum(F.when(F.floor(F.col("d") / 8) == j, F.expr("shiftleft(1, 7 - d % 8)")).otherwise(0)).cast("int").alias(f"b{j}") for j in range(n // 8)])
        code = F.array(*[F.coalesce(F.col(f"b{j}"), F.lit(0)) for j in range(n // 8)])
        return df.select(key).join(bytes_, key, "left").select(key, code.alias("code"))


class PandasEmbedder:
    """Wraps a function of texts to dense vectors (a model that each worker loads once) as an Arrow-batched UDF."""

    def __init__(self, load: Callable[[], Callable[[list[str]], list[list[float]]]], dimensions: int):
        self.load, self.dimensions = load, dimensions

    def code(self, text: Column) -> Column:
        load = self.load

        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = load()
            for texts in batches:
                yield pd.Series(list(model(texts.fillna("").tolist())))

        dense = F.pandas_udf(run, "array<double>")(text)
        return pack_bytes(sign_bits(F.slice(dense, 1, self.dimensions)))


def mean_pool(tokens: DataFrame, key: str, vector: str = "embedding", mask: str | None = None) -> DataFrame:
    """Mean of the token vectors of each key, masked tokens left out: by explode and a partial aggregation, never a list of a group."""
    rows = tokens.where(F.col(mask) != 0) if mask else tokens
    each = rows.select(key, F.posexplode(vector).alias("dim", "x"))
    return each.groupBy(key, "dim").agg(F.avg(F.col("x").cast("double")).alias("x"))


def cls_pool(tokens: DataFrame, key: str, position: str, vector: str = "embedding") -> DataFrame:
    """The vector at position 0 of each key."""
    return tokens.where(F.col(position) == 0).select(key, vector)


def pool(tokens: DataFrame, key: str, strategy: str, position: str = "position", vector: str = "embedding", mask: str | None = None) -> DataFrame:
    if strategy == "cls":
        return cls_pool(tokens, key, position, vector)
    if strategy == "mean":
        return mean_pool(tokens, key, vector, mask)
    raise NotImplementedError(f"pooling strategy {strategy!r}")
