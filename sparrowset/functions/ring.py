"""Arithmetic of integers modulo 2^width, as Column expressions.

A value of width w is a long whose bits above w are 0; at width 64 it is the long itself, read as unsigned where order
matters. Shares split a value into two that are combined again by XOR (boolean) or addition (arithmetic); that shows the
arithmetic of two-share computation and hides nothing, as one Spark application sees both shares.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

WIDTHS = (1, 2, 4, 8, 16, 32, 64)
#: The sign bit: XOR with it turns signed order into unsigned order.
SIGN = -(1 << 63)


def _col(x: Column | str | int) -> Column:
    c = F.lit(x) if isinstance(x, int) else F.col(x) if isinstance(x, str) else x
    return c.cast("long")


def _check(width: int) -> None:
    if width not in WIDTHS:
        raise ValueError(f"width must be one of {WIDTHS}, not {width}")


def _halves(c: Column) -> tuple[Column, Column]:
    return F.shiftrightunsigned(c, 32), c.bitwiseAND(F.lit(0xFFFFFFFF))


def _join(high: Column, low: Column) -> Column:
    return F.shiftleft(high, 32).bitwiseOR(low)


def wrap_add(x, y) -> Column:
    """x + y modulo 2^64 in whatever mode: the halves are added apart, so nothing overflows."""
    (a, b), (c, d) = _halves(_col(x)), _halves(_col(y))
    low = b + d
    return _join(a + c + F.shiftrightunsigned(low, 32), low.bitwiseAND(F.lit(0xFFFFFFFF)))


def wrap_neg(x) -> Column:
    return wrap_add(F.bitwise_not(_col(x)), 1)


def wrap_sub(x, y) -> Column:
    return wrap_add(x, wrap_neg(y))


def wrap_mul(x, y) -> Column:
    """x * y modulo 2^64, from products of 32-bit by 16-bit parts, each of which fits."""
    (a, b), (c, d) = _halves(_col(x)), _halves(_col(y))
    mask = F.lit(0xFFFFFFFF)

    def low32(u: Column, v: Column) -> tuple[Column, Column]:
        """(high, low) halves of the 64-bit product of two 32-bit numbers."""
        v1, v0 = F.shiftrightunsigned(v, 16), v.bitwiseAND(F.lit(0xFFFF))
        p0, p1 = u * v0, u * v1
        low = p0.bitwiseAND(mask) + F.shiftleft(p1.bitwiseAND(F.lit(0xFFFF)), 16)
        high = F.shiftrightunsigned(p0, 32) + F.shiftrightunsigned(p1, 16) + F.shiftrightunsigned(low, 32)
        return high, low.bitwiseAND(mask)

    high, low = low32(b, d)
    _, ad = low32(a, d)
    _, bc = low32(b, c)
    return _join((high + ad + bc).bitwiseAND(mask), low)


def wrap_sum(x) -> Column:
    """Aggregate: the sum modulo 2^64, 0 for no rows. The four 16-bit quarters are summed apart, so that no sum of a long
    overflows in ANSI mode below 2^47 rows a group; their sums are shifted into place and added modulo 2^64."""
    c, out = _col(x), None
    for k in range(4):
        quarter = F.shiftrightunsigned(c, 16 * k).bitwiseAND(F.lit(0xFFFF)) if k else c.bitwiseAND(F.lit(0xFFFF))
        part = F.shiftleft(F.coalesce(F.sum(quarter), F.lit(0).cast("long")), 16 * k)
        out = part if out is None else wrap_add(out, part)
    return out


def ring(x, width: int) -> Column:
    """x modulo 2^width."""
    _check(width)
    return _col(x) if width == 64 else _col(x).bitwiseAND(F.lit((1 << width) - 1))


def ring_and(x, y, width: int = 64) -> Column:
    return ring(_col(x).bitwiseAND(_col(y)), width)


def ring_xor(x, y, width: int = 64) -> Column:
    return ring(_col(x).bitwiseXOR(_col(y)), width)


def ring_not(bit) -> Column:
    """The other bit."""
    return ring(bit, 1).bitwiseXOR(F.lit(1))


def ring_add(x, y, width: int = 64) -> Column:
    return ring(wrap_add(x, y), width)


def ring_mul(x, y, width: int = 64) -> Column:
    return ring(wrap_mul(x, y), width)


def unsigned(x) -> Column:
    """A sort key: the order of x read as unsigned."""
    return _col(x).bitwiseXOR(F.lit(SIGN))


def less_unsigned(x, y, width: int = 64) -> Column:
    """1 if x < y as unsigned numbers, else 0."""
    return (unsigned(ring(x, width)) < unsigned(ring(y, width))).cast("int")


def less_signed(x, y, width: int = 64) -> Column:
    """The sign bit of x - y at this width: 1 if x < y, as long as the difference doesn't overflow."""
    _check(width)
    return F.shiftrightunsigned(ring(wrap_sub(x, y), width), width - 1).bitwiseAND(F.lit(1))


def ring_equal(x, y, width: int = 64) -> Column:
    return (ring(x, width) == ring(y, width)).cast("int")


def mux(c, x, y) -> Column:
    """x where c (a column name, or a Column of bits or booleans) is 1 or true, else y; y where it is null."""
    return F.when(_col(c) == 1, _col(x)).otherwise(_col(y))


def swap(c, x, y) -> tuple[Column, Column]:
    """(x, y) where c holds, else (y, x)."""
    return mux(c, x, y), mux(c, y, x)


def get_bit(x, i: int) -> Column:
    return F.shiftrightunsigned(_col(x), i).bitwiseAND(F.lit(1))


def set_bit(x, i: int, bit: bool) -> Column:
    one = (1 << i) - (1 << 64 if i == 63 else 0)
    return _col(x).bitwiseOR(F.lit(one)) if bit else _col(x).bitwiseAND(F.lit(~one))


# --- shares: masks come from a hash of a key of the row, so that reruns give the same ones ---


def _mask(seed: int, width: int, key: tuple) -> Column:
    return ring(F.xxhash64(*[F.col(k) if isinstance(k, str) else k for k in key], F.lit(seed)), width)


def share_bool(x, *key, width: int = 64, seed: int = 1) -> tuple[Column, Column]:
    """(x ^ r, r) with r from the row's key."""
    r = _mask(seed, width, key)
    return ring(_col(x).bitwiseXOR(r), width), r


def reconstruct_bool(s0, s1, width: int = 64) -> Column:
    return ring_xor(s0, s1, width)


def share_arith(x, *key, width: int = 64, seed: int = 1) -> tuple[Column, Column]:
    """(x - r, r) with r from the row's key."""
    r = _mask(seed, width, key)
    return ring(wrap_sub(x, r), width), r


def reconstruct_arith(s0, s1, width: int = 64) -> Column:
    return ring_add(s0, s1, width)


def bool_to_arith(s0, s1, *key, width: int = 64, seed: int = 2) -> tuple[Column, Column]:
    """Additive shares of the value that XOR shares hold."""
    return share_arith(reconstruct_bool(s0, s1, width), *key, width=width, seed=seed)


def arith_to_bool(s0, s1, *key, width: int = 64, seed: int = 2) -> tuple[Column, Column]:
    """XOR shares of the value that additive shares hold."""
    return share_bool(reconstruct_arith(s0, s1, width), *key, width=width, seed=seed)


def random_ints(spark: SparkSession, n: int, seed: int = 0, name: str = "value"):
    """id, value: n whole numbers spread over [0, 2^63), the same ones for the same seed."""
    return spark.range(n).select("id", F.xxhash64("id", F.lit(seed)).bitwiseAND(F.lit((1 << 63) - 1)).alias(name))
