"""Distances and similarities of codes and of dense vectors, as native Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LANES = 0x00FF00FF00FF00FF
GROUP = 64  # words whose byte sums fit the 16-bit lanes


def xor_sum(a: Column, b: Column) -> Column:
    """Sum over bytes of a XOR b."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y)), F.lit(0).cast("bigint"), lambda s, x: s + x)


def byte_mismatch(a: Column, b: Column) -> Column:
    """Number of unequal elements."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x != y).cast("bigint")), F.lit(0).cast("bigint"), lambda s, x: s + x)


def mismatch_similarity(a: Column, b: Column) -> Column:
    """1 - mismatches / width; the second code is cut to the width of the first."""
    return 1 - byte_mismatch(a, F.slice(b, F.lit(1), F.size(a))) / F.size(a)


def bit_scaled_score(a: Column, b: Column) -> Column:
    """1 - byte mismatches / bits."""
    return 1 - byte_mismatch(a, b) / (8 * F.size(a))


def hamming_bits(a: Column, b: Column) -> Column:
    """Number of differing bits."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("bigint")), F.lit(0).cast("bigint"), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double; a zero vector gives null."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.try_divide(dot, norm(a) * norm(b))


def packed_xor_sum(left: list[Column], right: list[Column]) -> Column:
    """xor_sum over packed words: bytes are summed four at a time in 16-bit lanes, inside whole-stage codegen."""
    total = F.lit(0).cast("bigint")
    mask = F.lit(LANES).cast("bigint")
    for at in range(0, len(left), GROUP):
        lanes = F.lit(0).cast("bigint")
        for a, b in zip(left[at : at + GROUP], right[at : at + GROUP]):
            x = a.bitwiseXOR(b)
            lanes = lanes + (x.bitwiseAND(mask) + F.shiftrightunsigned(x, 8).bitwiseAND(mask))
        for shift in (0, 16, 32, 48):
            total = total + (F.shiftrightunsigned(lanes, shift) if shift else lanes).bitwiseAND(F.lit(65535).cast("bigint"))
    return total


def packed_hamming(left: list[Column], right: list[Column]) -> Column:
    """hamming_bits over packed words."""
    return sum((F.bit_count(a.bitwiseXOR(b)).cast("bigint") for a, b in zip(left, right)), F.lit(0).cast("bigint"))


METRICS = {"xor_sum": xor_sum, "hamming": hamming_bits, "byte_mismatch": byte_mismatch, "cosine": lambda a, b: 1 - cosine(a, b)}
