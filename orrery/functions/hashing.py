"""Hash order, seeds, and bit arithmetic, within 64-bit integers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_order(seed: str, key: Column) -> Column:
    """Blind order: sha256 of 'seed:key' in hex."""
    return F.sha2(F.concat(F.lit(seed + ":"), key), 256)


def effect_seed(seed: Column, sample: Column, effect: Column) -> Column:
    """First four digest bytes of 'seed:sample:effect', big-endian."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", seed, sample, effect), 256), 1, 8), 16, 10).cast("long")


def digest_modulo(text: Column, n: Column) -> Column:
    """The whole 256-bit digest modulo n, folded over 32-bit words so that nothing overflows."""
    words = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.conv(F.substring(F.sha2(text, 256), i * 8 + 1, F.lit(8)), 16, 10).cast("long"))
    return F.aggregate(words, F.lit(0).cast("long"), lambda acc, w: (acc * 4294967296 + w) % n)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def from_hex(text: Column) -> Column:
    """16 hex digits as a signed 64-bit integer."""
    return F.conv(text, 16, -10).cast("long")


def chunks(bits: Column) -> Column:
    """Three (number, bits) parts of 22, 21 and 21 bits: of two hashes at distance 2 one part agrees."""
    part = lambda k, shift, width: F.struct(F.lit(k).alias("k"), F.shiftrightunsigned(bits, shift).bitwiseAND(F.lit((1 << width) - 1).cast("long")).alias("bits"))
    return F.array(part(0, 0, 22), part(1, 22, 21), part(2, 43, 21))


def sign_bits(vector: Column) -> Column:
    """Bit i tells whether entry i + 1 (cyclic) is above entry i; up to 64 entries."""
    n = F.size(vector)
    return F.aggregate(
        F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"),
        lambda acc, i: acc.bitwiseOR(F.when(F.get(vector, (i + 1) % n) > F.get(vector, i), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))),
    )
