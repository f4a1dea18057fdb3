"""Exact deduplication, mixing and quality rules: edge cases against plain Python."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sparrowset.llm import exact_dedup, mixing, quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, kept string, extra map<string,int>"
LONG = "word " * 9 + "line\n" + "one two three four five six\n" * 400
ROWS = [
    (1, "a b c", "en", "s1", 5, "clash", "clash", {"k": 1}),
    (2, "a b c", "en", "s2", 5, None, None, None),
    (7, "A b c", "de", None, 5, None, None, None),
    (3, None, None, None, None, None, None, None),
    (4, "", "fr", "s1", 0, None, None, None),
    (4, "", "fr", "s1", 0, None, None, None),
    (None, "a b c", "en", "s9", 5, None, None, None),
    (None, "no id", "en", "s9", 5, None, None, None),
    (None, "no id", "en", "s9", 5, None, None, None),
    (9, LONG, "es", "é", 9, None, None, None),
    (10, LONG, "es", "Z", 9, None, None, None),
    (11, "x\ty\x0bz\x0c\r w\x1fv " * 30, "xx", "s2", 9, None, None, None),
] + [(100 + k, "hot copy", "en", "hot", 8, None, None, None) for k in range(60)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


def weak(text):
    """A digest that many texts share."""
    return F.pmod(F.length(text), F.lit(3)).cast("string")


@pytest.mark.parametrize("digest", [exact_dedup.sha256, weak])
def test_dedup_groups(docs, digest):
    groups = defaultdict(list)
    for r in ROWS:
        groups[r[1] or ""].append(r[0])
    want = Counter()
    for ids in groups.values():
        keep = max((i for i in ids if i is not None), default=None)
        first = True
        for i in ids:
            want[i, keep, len(ids), i == keep and first] += 1
            first = first and i != keep
    got = exact_dedup.dedup_groups(docs, salts=4, digest=digest).collect()
    assert Counter((r["id"], r["keep_id"], r["group_size"], r["kept"]) for r in got) == want
    assert sum(r["kept"] for r in got) == len(groups)
    if digest is exact_dedup.sha256:
        assert {r["digest"] for r in got} == {hashlib.sha256(t.encode()).hexdigest() for t in groups}


@pytest.mark.parametrize("digest", [exact_dedup.sha256, weak])
def test_dedup_rows(docs, digest):
    kept = exact_dedup.dedup_rows(docs, salts=4, digest=digest)
    assert kept.schema.simpleString() == docs.schema.simpleString()
    rows = kept.collect()
    by_text = {r["text"] or "": r for r in rows}
    assert len(rows) == len(by_text) == len({r[1] or "" for r in ROWS})
    for t, r in by_text.items():
        same = [x for x in ROWS if (x[1] or "") == t]
        assert r["doc_id"] == max((x[0] for x in same if x[0] is not None), default=None)
        assert tuple(r) in [tuple(x) for x in same]


def test_empty_tables(docs):
    none = docs.limit(0)
    assert exact_dedup.dedup_groups(none).count() == exact_dedup.dedup_rows(none).count() == mixing.mix_rows(none).count() == 0
    assert quality.quality_rules(none, labels_of(docs, []))[0].count() == 0


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def slow_targets(sizes):
    """Share by weight, stop sources at their caps, share the excess again until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    target, left, free = dict.fromkeys(names, 0.0), float(sum(sizes.values())), set(names)
    while left > 1e-9 and free:
        total = sum(weight[s] for s in free)
        share = {s: left * weight[s] / total for s in free}
        left = 0.0
        for s in list(free):
            target[s] += share[s]
            if target[s] >= 3 * sizes[s]:
                left += target[s] - 3 * sizes[s]
                target[s] = 3.0 * sizes[s]
                free.discard(s)
    return target


def test_mixing(docs):
    sizes = Counter()
    for r in ROWS:
        sizes[r[3]] += len(words(r[1]))
    want = slow_targets(sizes)
    planned, names = mixing.mix_plan(docs)
    assert names["size"] == "size_" and set(docs.columns) < set(planned.columns)
    rows = planned.collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        assert r["size_"] == len(words(r["text"])) and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]], abs=1e-6)
        rate = r["target"] / r["source_size"] if r["source_size"] else 0
        assert int(rate + 1e-9) <= r["copies"] + 1e-9 and r["copies"] <= min(3, int(rate) + 1)
    again, _ = mixing.mix_plan(docs.repartition(5))
    key = lambda r: (str(r["doc_id"]), str(r["text"]), str(r["source"]), r["copies"])
    assert sorted(map(key, again.collect())) == sorted(map(key, rows))
    mixed = mixing.mix_rows(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in rows)


def test_mixing_comes_near_targets(spark):
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 50 + 1).cast("int")).alias("text"), F.concat(F.lit("s"), (F.sqrt("id") / 20).cast("int")).alias("source"))
    planned, n = mixing.mix_plan(df)
    for r in planned.groupBy("source").agg(F.sum(F.col(n["size"]) * F.col(n["copies"])).alias("taken"), F.first(n["target"]).alias("target"), F.count("*").alias("docs")).filter("docs > 300").collect():
        assert r["taken"] == pytest.approx(r["target"], rel=0.1)


def labels_of(docs, rows):
    return docs.sparkSession.createDataFrame(rows, "doc_id long, quality int, toxic int")


def slow_measures(text):
    w = words(text)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(grams)
    covered = {p for i, g in enumerate(grams) if n[g] > 1 for p in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_measures(spark, docs):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    for df in (docs, table):
        got, names = quality.measures(df)
        rows = got.collect()
        assert len(rows) == df.count()
        for r in rows:
            assert tuple(r[names[c]] for c in quality.MEASURES) == slow_measures(r["text"])


def test_binomial(spark):
    cases = [(k, n, p) for n in (1, 5, 100, 5000, 200_000) for p in (0.005, 0.02, 0.3) for k in {0, 1, int(n * p * 0.5), max(0, int(n * p) - 1)} if k < n * p]
    from math import lgamma, log, log1p

    import numpy as np

    for k, n, p in cases:
        j = np.arange(k + 1)
        logs = np.array([lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) for i in j]) + j * log(p) + (n - j) * log1p(-p)
        want = float(np.exp(logs - logs.max()).sum() * np.exp(logs.max()))
        got = spark.range(1).select(quality.binomial_below(F.lit(k).cast("long"), F.lit(n).cast("long"), p)).first()[0]
        assert got == pytest.approx(want, rel=1e-6, abs=1e-300)


def test_cutoffs_reject_bad_documents_and_keep_good_ones(spark):
    """2000 good documents without symbols, 300 bad ones full of them; another stratum has too few labels."""
    good, bad = "plain words that say something new each time %d here now", "### %%%% buy %d now $$$ *** <<< >>> ||| &&& now ###"
    rows = [(k, good.replace("%d", str(k)), "en") for k in range(2000)] + [(5000 + k, bad.replace("%d", str(k)), "en") for k in range(300)] + [(9000 + k, bad.replace("%d", str(k)), "fr") for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = labels_of(df, [(i, int(i < 5000), 0) for i, *_ in rows] + [(None, 1, 0), (1, None, 0), (77777, 1, 0)])
    judged, names = quality.quality_rules(df, labels)
    kept = {r["doc_id"]: r[names["kept"]] for r in judged.collect()}
    assert all(kept[k] for k in range(2000)) and not any(kept[5000 + k] for k in range(300))
    assert all(kept[9000 + k] for k in range(20))
    unlabelled, names = quality.quality_rules(df, labels_of(df, []))
    assert unlabelled.filter(names["kept"]).count() == len(rows)
