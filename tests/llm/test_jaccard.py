"""Similar texts and the pipeline's near-duplicate stage against all pairs of shingle sets."""

import random

import corpus_pipeline
from sparrowset.llm import jaccard, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def slow_kept(rows):
    """Of each component of similar texts, the rows that may stay: (id, text), smallest id first, null last."""
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups: dict[int, list] = {}
    for k, r in enumerate(rows):
        groups.setdefault(find(k), []).append(r)
    order = lambda r: (r[0] is None, r[0] or 0)
    return [{r[:2] for r in g if order(r) == min(map(order, g))} for g in groups.values()]


def check(spark, rows):
    out = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), "")
    got = [(r["doc_id"], r["text"]) for r in out.collect()]
    want = slow_kept(rows)
    assert len(got) == len(want)
    for g in want:
        assert sum(x in g for x in got) == 1


def test_stage_finds_all_similar_texts(spark):
    """Copies from J 0.7 to 0.95 that 4 bits of a 4-word fingerprint mostly miss, short and wordless texts."""
    rng = random.Random(5)
    rows, new = [], lambda: f"w{rng.randrange(10**6)}"
    for k in range(60):
        base = [new() for _ in range(rng.choice([6, 30, 120, 400]))]
        copy = [new() if rng.random() < 0.03 * rng.random() else w for w in base]
        if copy == base:
            copy[-1] = new()
        rows += [(2 * k, " ".join(base), "en", "x", 1), (2 * k + 1, " ".join(copy), "en", "x", 1)]
    rows += [(500, None, None, None, None), (501, " \n", None, None, None), (502, "One  two", None, None, None), (503, "one two", None, None, None)]
    check(spark, rows)


def test_stage_on_a_large_group_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    test_stage_on_a_large_group(spark)


def test_stage_on_a_large_group(spark):
    """A bucket with more than FEW sets, of which some are similar to few others only, beside a common line."""
    rng = random.Random(6)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(150):
        text = [f"n{rng.randrange(10**6)}" if rng.random() < 0.03 else w for w in base[:-1]] + [f"end{k}"]
        rows.append((k, " ".join(text), "en", "x", 1))
        rows.append((1000 + k, "the same line for all of them " + " ".join(f"o{rng.randrange(10**6)}" for _ in range(9)), "en", "x", 1))
    check(spark, rows)


def test_similar_texts_of_a_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").dropDuplicates(["text"])
    rows = [tuple(r) for r in table.collect()]
    check(spark, rows)


def test_prefix_holds_a_common_shingle():
    for a in range(1, 60):
        for b in range(a, 60):
            common = -(-4 * (a + b) // 9)
            if common <= a:
                assert a - jaccard.prefix(a) < common and b - jaccard.prefix(b) < common


def test_stage_keeps_one_row_of_each_group(spark):
    """Repeated ids on other texts, repeated ids within a group, groups without ids, repeated rows."""
    a, b, c, d = ([f"{x}{k}" for k in range(60)] for x in "abcd")
    near = lambda words: " ".join([*words[:-1], "other"])
    rows = [(3, " ".join(a)), (5, near(a)), (5, "unlike anything else at all"), (7, " ".join(b)), (7, near(b)), (None, " ".join(c)), (None, near(c)), (9, " ".join(d)), (9, " ".join(d))]
    check(spark, [(i, t, "en", "x", 1) for i, t in rows])


def test_large_buckets_come_in_parts(monkeypatch):
    """Every row once, parts that begin with the last rows of the one before."""
    import pyarrow as pa

    monkeypatch.setattr(jaccard, "HELD", 10)
    keys = [1] * 3 + [2] * 57 + [3] * 2 + [4] * 25
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[i : i + 4]), pa.array([*range(i, min(i + 4, len(keys)))])], ["k", "v"]) for i in range(0, len(keys), 4)]
    seen, last = [], []
    for (key, value), skip in jaccard.whole_buckets(batches):
        value = value.to_pylist()
        assert value[:skip] == last[len(last) - skip :] and len(key) <= 10 + 4 + jaccard.NEXT + 4
        seen += value[skip:]
        last = value
    assert seen == [*range(len(keys))]


def test_parity_maps_never_differ_more_than_their_sets():
    rng = random.Random(3)
    np = jaccard.np
    for _ in range(200):
        n = rng.choice([1, 5, 100, 127, 129, 700])
        a = {rng.getrandbits(63) for _ in range(n)}
        b = set(rng.sample(sorted(a), rng.randrange(len(a)) + 1)) | {rng.getrandbits(63) for _ in range(rng.randrange(n + 1))}
        for per in (jaccard.COARSE, jaccard.FINE):
            maps = [jaccard.parity_map(np.array(sorted(x), np.int64), per) for x in (a, b)]
            x, y = jaccard.folded(maps, min(map(len, maps)))
            assert np.bitwise_count(x ^ y).sum() <= len(a ^ b)


def test_partial_roots_are_connected(spark):
    links = [(k, k + 1) for k in range(30)] + [(100, 105), (105, 102), (102, 101)]
    got = {r["s"]: r["root"] for r in jaccard.partial_roots(spark.createDataFrame(links, "u long, v long")).collect()}
    assert all(r <= s and (r < 31) == (s < 31) for s, r in got.items())
    assert [got[k] for k in range(1, 9)] == [0] * 8 and got[105] == 100


def near_copies(n):
    """Texts k and 1000 + k, in whose middle one word of 300 differs."""
    rows = []
    for k in range(n):
        base = [f"w{k}x{j}" for j in range(300)]
        rows += [(k, " ".join(base)), (1000 + k, " ".join([*base[:150], "other", *base[151:]]))]
    return rows


def test_stage_links_by_simhash(spark, monkeypatch):
    """With no other pairs than those that SimHash gives, near copies go and texts that only fingerprints link stay."""
    rows = [*near_copies(20), (5000, "one two three"), (5001, "four five six")]
    asked, first_pairs, fingerprint = [], jaccard.first_pairs, simhash.fingerprint
    monkeypatch.setattr(jaccard, "first_pairs", lambda rows: first_pairs(rows).limit(0))
    monkeypatch.setattr(simhash, "near_links", lambda fps, distance, *, f=simhash.near_links, **k: asked.append(distance) or f(fps, distance, **k))
    assert all((fingerprint(a[1], 5) ^ fingerprint(b[1], 5)).bit_count() <= corpus_pipeline.NEAR_BITS for a, b in zip(rows[:40:2], rows[1:40:2], strict=True))
    out = corpus_pipeline.near_duplicates(spark, spark.createDataFrame([(*r, "en", "x", 1) for r in rows], SCHEMA), "")
    assert sorted(r["doc_id"] for r in out.collect()) == [*range(20), 5000, 5001]
    assert asked == [corpus_pipeline.NEAR_BITS]


def test_exact_search_leaves_out_what_simhash_gave(spark, monkeypatch):
    asked, by_parity = [], jaccard.by_parity
    monkeypatch.setattr(jaccard, "by_parity", lambda pairs, *a: asked.append(pairs.count()) or by_parity(pairs, *a))
    texts = spark.createDataFrame(near_copies(20), "s long, text string")
    assert {tuple(sorted((r["u"], r["v"]))) for r in jaccard.links(texts, 40).collect()} == {(k, 1000 + k) for k in range(20)}
    assert asked and not any(asked)


def group_of_near_copies(copies=60, others=40):
    rng = random.Random(9)
    new = lambda: f"w{rng.randrange(10**6)}"
    base = [new() for _ in range(200)]
    near = [base[:k] + [new()] + base[k + 1 :] for k in range(copies)]
    return [(k, " ".join(w), "en", "x", 1) for k, w in enumerate([*near, *[[new() for _ in range(30)] for _ in range(others)]])]


def test_few_links_take_few_jobs(spark):
    """Rounds of joins over a handful of links took the driver more memory than the links."""
    sc = spark.sparkContext
    df = spark.createDataFrame(group_of_near_copies(), SCHEMA).repartition(4).localCheckpoint()
    sc.setJobGroup("near stage", "")
    try:
        assert corpus_pipeline.near_duplicates(spark, df, "").count() == 41
    finally:
        sc._jsc.clearJobGroup()
    jobs = len(sc.statusTracker().getJobIdsForGroup("near stage"))
    assert jobs < 140, jobs


def test_stage_with_more_links_than_the_driver_takes(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "FEW_LINKS", 0)
    check(spark, [*group_of_near_copies(20, 5), (3, "other text", "", "", 1), (None, "other text", "", "", 1)])


def test_links_on_the_driver_connect_the_same(spark):
    from sparrowset.llm.components import components

    rng = random.Random(3)
    links = [(k, k + 1) for k in range(0, -200, -1)] + [(500, k) for k in range(501, 540)] + [(7, 7)] + [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(150)]
    df = spark.createDataFrame(links, "u long, v long")
    assert sorted(components(df, few=10_000).collect()) == sorted(components(df).collect())
    assert components(df.limit(0), few=10).count() == 0
