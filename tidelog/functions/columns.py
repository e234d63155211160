"""Column expressions: masks, the change test, unsigned 64-bit words, checksums."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

POLY_MASK = 0x7FFFFFFF
# fixed values of the 32-bit FNV-1a hash
FNV_BASIS, FNV_PRIME, U32 = 0x811C9DC5, 0x01000193, 0xFFFFFFFF


def matches(fields: Column, mask: Column) -> Column:
    """A subscription's fields (0: all) against a change's mask."""
    return (fields == 0) | (fields.bitwiseAND(mask) != 0)


def ui_matches(fields: Column, mask: Column) -> Column:
    """As matches; a change of unknown extent (mask 0) passes too."""
    return matches(fields, mask) | (mask == 0)


def intersects(a: Column, b: Column) -> Column:
    """Wide selections share a field."""
    return F.exists(F.zip_with(a, b, lambda x, y: x.bitwiseAND(y)), lambda w: w != 0)


def wide_union(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.bitwiseOR(y))


def is_empty(words: Column) -> Column:
    return ~F.exists(words, lambda w: w != 0)


def contains(mask: Column, bit: int) -> Column:
    return F.getbit(mask, F.lit(bit)) == 1


def wide_contains(words: Column, index: int) -> Column:
    return F.getbit(F.get(words, F.lit(index // 31)), F.lit(index % 31)) == 1


def changed(now: Column, before: Column, real: bool = False) -> Column:
    """Whether a value differs. Floats (real) differ by bits: 0.0 and -0.0 do, equal NaNs do not."""
    plain = ~now.eqNullSafe(before)
    return plain | ((now == 0) & (now.cast("string") != before.cast("string"))) if real else plain


def high_word(x: Column) -> Column:
    """x div 2^32, towards zero; exact for wide decimals too, as the remainder is gone before the division rounds."""
    return ((x - x % F.lit(2**32).cast("decimal(20,0)")) / F.lit(2**32).cast("decimal(20,0)")).cast("long")


def low_word(x: Column) -> Column:
    return (x % F.lit(2**32).cast("decimal(20,0)")).cast("long")


def from_words(high: Column, low: Column) -> Column:
    """Exact unsigned 64-bit value; words outside 32 bits raise."""
    fits = high.between(0, U32) & low.between(0, U32)
    value = (high.cast("decimal(20,0)") * F.lit(2**32).cast("decimal(10,0)") + low.cast("decimal(20,0)")).cast("decimal(20,0)")
    return F.when(fits, value).otherwise(F.raise_error(F.lit("word outside 0..2^32-1")).cast("decimal(20,0)"))


def hex16(x: Column) -> Column:
    """16 lower-case hex digits of an unsigned 64-bit value."""
    return F.lower(F.concat(F.lpad(F.hex(high_word(x)), 8, "0"), F.lpad(F.hex(low_word(x)), 8, "0")))


def leading_hex16(x: Column) -> Column:
    """As hex16; of more digits the first 16, and a negative value has the 32 of its 128-bit two's complement."""
    high, low = high_word(x), low_word(x)
    top = F.shiftright(F.when(low < 0, high - 1).otherwise(high), 32)  # x div 2^64, downwards
    return F.lower(F.when(x < 0, F.hex(top)).otherwise(F.lpad(F.concat(F.hex(high), F.lpad(F.hex(low), 8, "0")), 16, "0")))


def to_bytes(x: Column, big: bool) -> Column:
    whole = F.unhex(hex16(x))
    return whole if big else F.unhex(F.concat(*(F.substring(hex16(x), 15 - 2 * i, 2) for i in range(8))))


def byte_at(b: Column, i: Column) -> Column:
    return F.conv(F.hex(b.substr(i, F.lit(1))), 16, 10).cast("long")


def poly31(b: Column) -> Column:
    """c = (c * 31 + byte) & 0x7fffffff over the bytes, with built-ins; for short values."""
    return F.when(
        F.octet_length(b) > 0, F.aggregate(F.sequence(F.lit(1), F.octet_length(b)), F.lit(0).cast("long"), lambda c, i: (c * 31 + byte_at(b, i)).bitwiseAND(F.lit(POLY_MASK).cast("long")))
    ).otherwise(F.when(b.isNotNull(), F.lit(0).cast("long")))


def fnv1a(b: Column) -> Column:
    """32-bit FNV-1a over the bytes, with built-ins; for short values."""
    step = lambda h, i: (h.bitwiseXOR(byte_at(b, i)) * FNV_PRIME).bitwiseAND(F.lit(U32).cast("long"))
    return F.when(F.octet_length(b) > 0, F.aggregate(F.sequence(F.lit(1), F.octet_length(b)), F.lit(FNV_BASIS).cast("long"), step)).otherwise(
        F.when(b.isNotNull(), F.lit(FNV_BASIS).cast("long"))
    )


def poly31_of(raw: bytes) -> int:
    """poly31 of long bytes: blocks by powers of 31 modulo 2^31 (31 times a sum below 2^31 fits 64 bits)."""
    c = 0
    for s in range(0, len(raw), 1 << 16):
        x = np.frombuffer(raw[s : s + (1 << 16)], np.uint8).astype(np.uint64)
        c = (c * pow(31, len(x), 1 << 31) + int((x * _powers(len(x))).sum() & np.uint64(POLY_MASK))) & POLY_MASK
    return c


_POWERS = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    while len(_POWERS) < n:
        top = (int(_POWERS[-1]) * 31) & POLY_MASK
        _POWERS = np.concatenate([_POWERS, (_POWERS * np.uint64(top)) & np.uint64(POLY_MASK)])
    return _POWERS[:n][::-1]


@F.pandas_udf(T.LongType())
def poly31_long(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """poly31 for long payloads, in Arrow batches."""
    for s in batches:
        yield s.map(lambda raw: None if raw is None else poly31_of(bytes(raw)))


def frame_count(b: Column, size: int) -> Column:
    """Number of frames of a batch; null if the bytes do not divide into frames."""
    n = F.octet_length(b)
    return F.when(n % size == 0, (n / size).cast("long"))
