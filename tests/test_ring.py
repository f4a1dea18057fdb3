"""Ring functions against Python integers."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from sparrowset.functions import ring


def signed(x):
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


EDGES = [0, 1, 2, 5, 255, 256, 65535, 2**31, 2**32 - 1, 2**32, 2**62, 2**63 - 1, 2**63, 2**64 - 1, 2**64 - 2]


def pairs():
    r = random.Random(3)
    return [(signed(a), signed(b)) for a, b in [*itertools.product(EDGES, EDGES), *((r.getrandbits(64), r.getrandbits(64)) for _ in range(300))]]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs())], "k long, x long, y long").cache()


@pytest.mark.parametrize("ansi", ["true", "false"])
@pytest.mark.parametrize("width", ring.WIDTHS)
def test_arithmetic(spark, frame, width, ansi):
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        names = {
            "ring": ring.ring("x", width),
            "and": ring.ring_and("x", "y", width),
            "xor": ring.ring_xor("x", "y", width),
            "add": ring.ring_add("x", "y", width),
            "mul": ring.ring_mul("x", "y", width),
            "less_u": ring.less_unsigned("x", "y", width),
            "equal": ring.ring_equal("x", "y", width),
            "less_s": ring.less_signed("x", "y", width),
        }
        got = frame.select("x", "y", *[c.alias(k) for k, c in names.items()]).collect()
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")
    m = (1 << width) - 1
    for r in got:
        x, y = r["x"] & m, r["y"] & m
        assert [r[k] & m if k not in ("less_u", "equal", "less_s") else r[k] for k in names] == [x, x & y, x ^ y, (x + y) & m, (x * y) & m, int(x < y), int(x == y), (x - y & m) >> (width - 1)]


@pytest.mark.parametrize("width", [1, 2, 4])
def test_unsigned_order_of_all_pairs(spark, width):
    n = 1 << width
    got = spark.range(n).crossJoin(spark.range(n).withColumnRenamed("id", "j")).select("id", "j", ring.less_unsigned("id", "j", width).alias("v")).collect()
    assert all(r["v"] == (r["id"] < r["j"]) for r in got)


@pytest.mark.parametrize("width", ring.WIDTHS)
def test_shares(frame, width):
    b, a = ring.share_bool("x", "k", width=width), ring.share_arith("x", "k", width=width)
    got = frame.select(
        ring.ring("x", width).alias("x"),
        ring.reconstruct_bool(*b, width).alias("b"),
        ring.reconstruct_arith(*a, width).alias("a"),
        ring.reconstruct_arith(*ring.bool_to_arith(*b, "k", width=width), width).alias("b2a"),
        ring.reconstruct_bool(*ring.arith_to_bool(*a, "k", width=width), width).alias("a2b"),
        b[0].alias("share"),
    ).collect()
    assert all(r["x"] == r["b"] == r["a"] == r["b2a"] == r["a2b"] for r in got)
    if width >= 16:
        assert sum(r["share"] == r["x"] for r in got) < 5


def test_bits_mux_and_sum(spark, frame):
    lo, hi = ring.swap(F.col("x") < F.col("y"), "x", "y")
    got = frame.select("x", "y", lo.alias("lo"), hi.alias("hi"), ring.get_bit("x", 63).alias("top"), ring.set_bit("x", 63, True).alias("set"), ring.set_bit("x", 0, False).alias("clear"), ring.ring_not("x").alias("not")).collect()
    for r in got:
        assert (r["lo"], r["hi"]) == (min(r["x"], r["y"]), max(r["x"], r["y"]))
        assert (r["top"], r["set"], r["clear"], r["not"]) == (r["x"] >> 63 & 1, signed(r["x"] | 1 << 63), signed(r["x"] & ~1), ~r["x"] & 1)
    assert frame.agg(ring.wrap_sum("x")).first()[0] == signed(sum(r["x"] for r in got))
    assert frame.limit(0).agg(ring.wrap_sum("x")).first()[0] == 0
    with pytest.raises(ValueError):
        ring.ring("x", 7)


def test_random_ints_are_the_same_again(spark):
    a, b = (ring.random_ints(spark, 100, seed=4).collect() for _ in range(2))
    assert a == b and all(0 <= r["value"] < 1 << 63 for r in a) and len({r["value"] for r in a}) == 100


def test_sum_of_more_rows_than_a_long_of_halves_holds(spark):
    """-1 added 2^31 + 9 times, in ANSI mode."""
    n = (1 << 31) + 9
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"
    assert spark.range(n).agg(ring.wrap_sum(F.lit(-1)).alias("s")).first()["s"] == -n


def test_mux_takes_bits_and_booleans(spark):
    df = spark.createDataFrame([(1, True, 5, 6), (0, False, 5, 6), (None, None, 5, 6), (2, True, 5, 6)], "c int, b boolean, x long, y long")
    got = df.select(ring.mux("c", "x", "y"), ring.mux(F.col("c"), "x", "y"), ring.mux("b", "x", "y"), ring.mux(F.col("b"), "x", "y")).collect()
    assert [tuple(r) for r in got] == [(5, 5, 5, 5), (6, 6, 6, 6), (6, 6, 6, 6), (6, 6, 5, 5)]
