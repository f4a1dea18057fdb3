"""Fingerprints and components against direct computation over all pairs."""

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from sparrowset.llm import simhash
from sparrowset.llm.components import components


def slow_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    w = [x for x in low.split(" ") if x]
    if not w:
        return 0
    grams = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(ids, fps, distance):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (int(fps[i]) ^ int(fps[j])).bit_count() <= distance:
                root[find(i)] = find(j)
    least: dict[int, int] = {}
    for k, i in enumerate(ids):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return [least.get(find(k)) for k in range(len(ids))]


@given(st.text(alphabet="aA bB\n\tÉé\x1f .", max_size=80))
@settings(max_examples=200, deadline=None)
def test_fingerprint(text):
    assert simhash.fingerprint(text) == slow_fingerprint(text)


def test_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").unionByName(spark.createDataFrame([(None, None, None, None, None), (10**6, "", None, None, 0), (10**6, "", None, None, 0), (None, "one of a kind without id", None, None, 0)], "doc_id long, text string, lang string, source string, n_chars long"))
    rows = df.collect()
    fps = [slow_fingerprint(r["text"]) for r in rows]
    want = slow_components([r["doc_id"] for r in rows], fps, 4)
    got = simhash.near_duplicates(df).withColumn("hex", simhash.hex_fingerprint()).collect()
    key = lambda x: tuple((y is not None, y) for y in x)
    assert sorted(((r["id"], r["hex"], r["component_id"]) for r in got), key=key) == sorted(((r["doc_id"], f"{f:016x}", c) for r, f, c in zip(rows, fps, want, strict=True)), key=key)
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def noisy(rng, centre, n, flips):
    out = np.full(n, centre, np.uint64)
    for _ in range(flips):
        out ^= np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)
    return out


@pytest.mark.parametrize("block", [16, 1024])
def test_links_of_a_large_group(spark, block):
    """A hot group of near fingerprints, smaller ones and noise, with blocks small enough to need the second step."""
    rng = np.random.default_rng(1)
    parts = [rng.integers(0, 1 << 63, 300).astype(np.uint64), noisy(rng, 12345, 200, 3), noisy(rng, 1 << 50, 100, 6)]
    fps = np.unique(np.concatenate(parts)).view(np.int64)
    df = spark.createDataFrame([(int(x),) for x in fps], "fp long")
    links = simhash.near_links(df, block_rows=block).collect()
    assert len(links) < 12 * len(fps)
    root = {r["u"]: r["root"] for r in components(simhash.near_links(df, block_rows=block)).collect()}
    index = {int(x): k for k, x in enumerate(fps)}
    got = [index[root.get(int(x), int(x))] for x in fps]
    want = slow_components(list(range(len(fps))), fps.view(np.uint64), 4)
    assert len({*zip(got, want, strict=True)}) == len({*got}) == len({*want})


def test_a_dense_group_gives_few_links(spark):
    """One near group in many blocks of each bucket: links follow its size, and connect it."""
    rng = np.random.default_rng(5)
    fps = np.unique(np.concatenate([noisy(rng, 999, 12_000, 4), rng.integers(0, 1 << 63, 2000).astype(np.uint64)])).view(np.int64)
    df = spark.createDataFrame([(int(x),) for x in fps], "fp long").repartition(4)
    links = simhash.near_links(df).collect()
    assert all(((r["u"] ^ r["v"]) & (1 << 64) - 1).bit_count() <= 4 for r in links if r["u"] != r["v"]) or len(links) < 5 * len(fps)
    assert len(links) < 5 * len(fps)
    tie = simhash.UnionFind()
    for r in links:
        tie.join(r["u"], r["v"])
    centre = [int(x) for x in fps if (int(x) ^ 999).bit_count() <= 4 and x >= 0]
    assert len({tie.root(x) for x in centre}) == 1


def test_long_texts(spark):
    """More shingles than are counted at once."""
    text = " ".join(f"w{k % 70_001} {k % 13}" for k in range(simhash.CHUNK))
    assert simhash.fingerprint(text) == slow_fingerprint(text)


@pytest.mark.parametrize("distance", [0, 1, 3, 4, 6])
def test_plan_is_complete(distance):
    rng = np.random.default_rng(distance)
    bits = rng.random((500, 64)) < rng.random(64)
    for n in (10, 10**6, 10**9):
        groups = simhash.plan(n, (bits.T.astype(float) @ bits) / 500 * n, distance)
        masks = [m for m, _ in groups]
        assert sum(t + 1 for _, t in groups) == distance + 1
        assert all(a & b == 0 for i, a in enumerate(masks) for b in masks[:i])


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 150)] + [(7, 7), (60, 61), (61, 60)]
    got = {r["u"]: r["root"] for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{k: 100 for k in range(101, 150)}, 61: 60}


@pytest.mark.parametrize("block", [4, 1024])
def test_near_texts(spark, monkeypatch, block):
    """Pairs within the distance only, stars left out, that connect what all of them connect; texts of one fingerprint too."""
    monkeypatch.setattr(simhash.near_links, "__defaults__", (4, block, *simhash.near_links.__defaults__[2:]))
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(80)]
    texts = [" ".join(f"n{rng.integers(10**6)}" if rng.random() < 0.04 else w for w in words) for _ in range(80)]
    texts += ["", " ", "\n", "Same  words here and there too", "same words here and there too"]
    fps = [simhash.fingerprint(t, 5) for t in texts]
    got = [(r["a"], r["b"]) for r in simhash.near_texts(spark.createDataFrame(list(enumerate(texts)), "s long, text string"), 5, 8, 0.01).collect()]
    assert all(a < b and (fps[a] ^ fps[b]).bit_count() <= 8 for a, b in got) and len(set(got)) == len(got)
    tie = simhash.UnionFind()
    for a, b in got:
        tie.join(a, b)
    assert [tie.root(k) for k in range(len(texts))] == slow_components(list(range(len(texts))), fps, 8)
    assert simhash.near_texts(spark.createDataFrame([], "s long, text string")).count() == 0
