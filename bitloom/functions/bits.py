"""Dense vectors to binary codes: normalise, truncate, take signs, pack. All are native Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a value once: a lambda's variable is computed before the body, however often that names it."""
    return F.transform(F.array(value), body).getItem(0)


def rounded(x: Column, places: int = 6) -> Column:
    """A double rounded as SQL's oracle does: halves away from zero, of the number times a power of ten, and a negative number that rounds to zero is -0.0."""
    scaled = F.abs(x) * 10.0**places
    whole = F.rint(scaled)  # halves to even
    out = F.signum(x) * F.when(scaled - whole == 0.5, whole + 1).otherwise(whole) / 10.0**places
    return F.when(F.abs(out) < float("inf"), out).otherwise(x)


def l2_normalize(v: Column) -> Column:
    """v over its Euclidean length, which counts as 1e-12 at least; nulls add nothing to it."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + F.coalesce(x.cast("double") * x.cast("double"), F.lit(0.0))))
    return let(F.greatest(norm, F.lit(1e-12)), lambda n: F.transform(v, lambda x: x.cast("double") / n))


def truncate(v: Column, n: int) -> Column:
    """The first n dimensions."""
    return F.slice(v, 1, n)


def sign_bits(v: Column) -> Column:
    """1 where strictly positive; zero, null and NaN give 0."""
    return F.transform(v, lambda x: F.when((x > 0) & ~F.isnan(x.cast("double")), 1).otherwise(0))


def pack_bytes(bits: Column) -> Column:
    """Unsigned bytes, most significant bit first, the last byte padded with zeros."""

    def pack(b: Column) -> Column:
        bit = lambda k: F.coalesce(F.get(b, k), F.lit(0))
        byte = lambda j: sum((F.shiftleft(bit(j * 8 + i), 7 - i) for i in range(1, 8)), F.shiftleft(bit(j * 8), 7))
        n = F.ceil(F.size(b) / 8).cast("int")
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), byte)).otherwise(F.array().cast("array<int>"))

    return let(bits, pack)


def code(v: Column, n: int | None = None) -> Column:
    """Binary code of a dense vector: normalisation can't change a sign, so the signs of the raw numbers are packed."""
    return pack_bytes(sign_bits(truncate(v, n) if n else v))


def words(code_: Column, width: int) -> list[Column]:
    """A code of `width` bytes as columns w0.. of 8 bytes each, most significant first, for codegen-ed arithmetic."""
    def word(j: int) -> Column:
        out = F.lit(0).cast("bigint")
        for i in range(min(8, width - 8 * j)):
            out = out.bitwiseOR(F.shiftleft(F.get(code_, F.lit(8 * j + i)).cast("bigint"), 56 - 8 * i))
        return out

    return [word(j).alias(f"w{j}") for j in range(-(-width // 8))]


def word_values(code_: list[int]) -> list[int]:
    """The same on the driver, for a query's code, as signed 64-bit numbers."""
    out = []
    for j in range(0, len(code_), 8):
        part = bytes(code_[j : j + 8]).ljust(8, b"\0")
        out.append(int.from_bytes(part, "big", signed=True))
    return out


def packed(code_: Column, n: int) -> Column:
    """A code of at most `n` words as an array of 8-byte words, the last one padded with zeros; null if it is longer or holds what is no byte."""
    word = lambda j: sum((F.shiftleft(F.coalesce(F.get(code_, F.lit(8 * j + i)), F.lit(0)).cast("bigint"), 56 - 8 * i) for i in range(1, 8)), F.shiftleft(F.coalesce(F.get(code_, F.lit(8 * j)), F.lit(0)).cast("bigint"), 56))
    fits = (F.size(code_) <= 8 * n) & F.forall(code_, lambda x: F.coalesce(x.between(0, 255), F.lit(False)))
    return F.when(fits, F.slice(F.array(*[word(j) for j in range(n)]), F.lit(1), F.ceil(F.size(code_) / 8).cast("int")))


def code_bytes(numbers: Column) -> Column:
    """Codes from outside as integers: numbers are cut toward zero, and codes of bytes less 128 (some number below zero, none outside -128 to 127) are put back to 0 to 255."""
    whole = F.transform(numbers, lambda x: x.cast("int"))
    shifted = F.exists(whole, lambda x: x < 0) & F.forall(whole, lambda x: x.between(-128, 127))
    return F.when(shifted, F.transform(whole, lambda x: x + 128)).otherwise(whole)


def recentred(code_: Column) -> Column:
    """Bytes less 128, as containers store them; XOR distances don't change."""
    return F.transform(code_, lambda x: x - 128)


def quantize(v: Column, n: int | None = None) -> Column:
    """Normalise, truncate to `n` dimensions, take signs, pack."""
    unit = l2_normalize(v)
    return pack_bytes(sign_bits(truncate(unit, n) if n else unit))
