"""Bucket hashes of byte keys: folds over bytes in wrapping 32-bit arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_WORD = 1 << 32


def _bytes(key: Column) -> Column:
    """array<long> of a binary column's bytes, 0 to 255."""
    digits = F.hex(key)
    places = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(digits)), F.lit(2))
    all_ = F.transform(places, lambda i: F.conv(F.substring(digits, i, F.lit(2)), 16, 10).cast("long"))
    return F.when(F.length(digits) == 0, F.array().cast("array<bigint>")).otherwise(all_)


def _signed(b: Column) -> Column:
    return F.when(b > 127, b - 256).otherwise(b)


def _times(x: Column, y: Column) -> Column:
    """x * y modulo 2^32 of two words, in halves so that nothing overflows a long."""
    low = x * (y % 65536)
    high = (x * F.floor(y / 65536)) % 65536
    return (low + high * 65536) % _WORD


def polynomial_bucket(key: Column, bits: int = 15) -> Column:
    """Bucket by the 31-polynomial over signed bytes, started at 1, its lowest bits."""
    h = F.aggregate(_bytes(key), F.lit(1).cast("long"), lambda acc, b: F.pmod(acc * 31 + _signed(b), F.lit(_WORD)))
    return h % (1 << bits)


#: Factors of the rolling-factor hash (fixed values).
_A, _B = 63689, 378551


def rolling_bucket(key: Column, size: int = 65536) -> Column:
    """Bucket by a hash whose factor itself grows with each byte; 31 bits, modulo size."""
    start = F.struct(F.lit(0).cast("long").alias("h"), F.lit(_A).cast("long").alias("a"))

    def step(acc, b):
        h = F.pmod(_times(acc["h"], acc["a"]) + _signed(b), F.lit(_WORD))
        return F.struct(h.alias("h"), _times(acc["a"], F.lit(_B).cast("long")).alias("a"))

    return F.aggregate(_bytes(key), start, step, lambda acc: acc["h"] % (1 << 31) % size)
