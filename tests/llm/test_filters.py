"""URL filters and toxicity."""

import re
from zlib import crc32

import numpy as np
import pytest

from sparrowset.llm import toxicity, urls
from sparrowset.llm.queries import RULES

URLS = [
    (None, "", "", None, "allow"), ("", "", "", None, "allow"), ("no scheme/casino", "", "", None, "block"),
    ("HTTP://WWW.Example.COM/en/9?casino", "www.example.com", "/en/9", "com/en/", "block"),
    ("http://example.com/en/71#casino", "example.com", "/en/71", "example.com/en/7", "allow"),
    ("http://notexample.com/en/71", "notexample.com", "/en/71", "com/en/", "block"),
    ("https://a.b.example.net/de/81/x", "a.b.example.net", "/de/81/x", "example.net/de/8", "block"),
    ("https://a.net/de/81", "a.net", "/de/81", "net/de/", "allow"),
    ("https://a.net/DE/81", "a.net", "/DE/81", None, "allow"),
    ("https://free-bets.example.org/fr/", "free-bets.example.org", "/fr/", None, "block"),
    ("https://freebets.example.org/fr/free", "freebets.example.org", "/fr/free", None, "allow"),
    ("https://x.org/free/free/free", "x.org", "/free/free/free", None, "allow"),
    ("https://x.org/accasino", "x.org", "/accasino", None, "allow"), ("https://x.org/casino2", "x.org", "/casino2", None, "allow"),
    ("https://É.org?es/é", "É.org", "", None, "allow"), ("a://b://c/d\nXXX", "b:", "//c/d\nXXX", None, "block"),
    ("http://h#f?q", "h", "", None, "allow"), ("http://", "", "", None, "allow"),
    ("http://x.org/es/" + "long/" * 20000 + "porn", "x.org", "/es/" + "long/" * 20000 + "porn", "org/es/", "block"),
]


def test_urls(spark):
    rows = [(k, u, "clash", "clash") for k, (u, *_) in enumerate(URLS)] * 2
    df = spark.createDataFrame(rows, "page_id long, url string, host string, verdict string")
    judged, n = urls.judge_urls(df, RULES)
    got = judged.collect()
    assert len(got) == len(rows) and judged.columns[:4] == df.columns
    for r in got:
        assert (r[n["host"]], r[n["path"]], r[n["rule"]], r[n["verdict"]]) == URLS[r["page_id"]][1:]
    assert urls.judge_urls(df.limit(0), RULES)[0].count() == 0


def test_terms_against_patterns():
    automaton = urls.build()
    rng = np.random.default_rng(5)
    parts = [*urls.STRICT, *urls.SOFT, "-", "/", ".", "a", "9", "_", "é", "x"]
    for _ in range(3000):
        url = "".join(rng.choice(parts, rng.integers(0, 8)))
        alone = lambda t, low=url.lower(): re.findall(rf"(?<![a-z0-9])(?={re.escape(t)}(?![a-z0-9]))", low)
        strict, soft = urls.count_terms(url, automaton)
        assert strict == sum(len(alone(t)) for t in urls.STRICT)
        assert soft == {t for t in urls.SOFT if alone(t)}


def test_vocabularies(spark, tmp_path):
    """None, of upper case, of 100,000 terms from a table; and an input column with a helper's name."""
    df = spark.createDataFrame([(1, "http://a.b/casino-Foo/t99999", 5), (2, "http://a.b/t7/t8", 6), (3, "http://a.b/xt7", 7)], "page_id long, url string, url_hits long")
    judged, n = urls.judge_urls(df, strict=(), soft=())
    assert [r[n["verdict"]] for r in judged.collect()] == ["allow"] * 3 and judged.columns[:3] == df.columns
    assert [r["url_hits"] for r in judged.collect()] == [5, 6, 7]
    judged, n = urls.judge_urls(df, strict=("FOO", ""), soft=("foo",))
    assert [(r[n["strict_hits"]], r[n["soft_hits"]]) for r in judged.collect()] == [(1, 0), (0, 0), (0, 0)]
    rows = [(f"t{k}", k == 99_999) for k in range(100_000)] + [(None, True), ("", False), ("casino", None)]
    spark.createDataFrame(rows, "term string, strict boolean").write.parquet(str(tmp_path / "terms"))
    strict, soft = urls.read_terms(spark, str(tmp_path / "terms"))
    judged, n = urls.judge_urls(df, strict=strict, soft=soft)
    assert [(r[n["strict_hits"]], r[n["soft_hits"]], r[n["verdict"]]) for r in judged.collect()] == [(1, 0, "block"), (0, 2, "block"), (0, 0, "allow")]


def small_model(kind=np.float64):
    model = toxicity.new_model(3)
    model.embed, model.filters, model.bias, model.out, model.out_bias = model.embed.astype(kind), [f.astype(kind) for f in model.filters], model.bias.astype(kind), model.out.astype(kind), 0.1
    return model


def test_gradients_against_differences():
    rng = np.random.default_rng(1)
    model = small_model()
    model.bias += rng.standard_normal(model.bias.shape) * 0.1  # away from the kink that padding alone would sit on
    docs = [toxicity.padded(rng.integers(1, 50, (n, 2))) for n in (0, 1, 4, 9)]
    y, w = np.array([0, 1, 1, 0.0]), np.array([1, 2, 0.5, 1.0])
    loss = lambda: toxicity.loss_and_gradients(model, docs, y, w)[0]
    _, grads = toxicity.loss_and_gradients(model, docs, y, w)

    def slope(table, at, eps=1e-6):
        old = table[at]
        table[at] = old + eps
        up = loss()
        table[at] = old - eps
        down = loss()
        table[at] = old
        return (up - down) / (2 * eps)

    for name, table in [("b", model.bias), ("o", model.out), *((f"f{k}", f) for k, f in enumerate(model.filters))]:
        for _ in range(25):
            at = tuple(int(rng.integers(0, n)) for n in table.shape)
            assert abs(grads[name][at] - slope(table, at)) < 1e-6
    for k in (0, 1):
        rows, grad = grads[f"e{k}"]
        for _ in range(25):
            r, d = int(rng.integers(0, len(rows))), int(rng.integers(0, toxicity.DIM))
            if rows[r] != toxicity.PAD:
                assert abs(grad[r, d] - slope(model.embed[k], (rows[r], d))) < 1e-6
    before = model.out_bias
    model.out_bias = before + 1e-6
    up = loss()
    model.out_bias = before - 1e-6
    assert abs((up - loss()) / 2e-6 - grads["ob"][0]) < 1e-6


def test_score_against_a_slow_forward_pass():
    model = small_model()
    text = "Some WORDS, and w0rds é " * 3
    found = re.findall(r"[^\W\d_]+", text.lower())
    number = lambda x: 1 + crc32(x.encode()) % (toxicity.BUCKETS - 1)
    vectors = [model.embed[0][number(x)] + model.embed[1][number("^" + x[: toxicity.PREFIX])] for x in found]
    zero = np.zeros(toxicity.DIM)
    vectors = [zero] * 2 + vectors + [zero] * 2
    z = model.out_bias
    for k, (width, f) in enumerate(zip(toxicity.WIDTHS, model.filters, strict=True)):
        for c in range(toxicity.FILTERS):
            most = max(sum(float(vectors[i + j] @ f[j][:, c]) for j in range(width)) for i in range(len(vectors) - width + 1))
            z += max(0.0, most + model.bias[k * toxicity.FILTERS + c]) * model.out[k * toxicity.FILTERS + c]
    assert model.score(text) == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-9)


def test_fit_takes_awkward_rows(spark):
    """Null labels and ids, an id with both labels, repeated rows, a bound on characters, clashing columns."""
    rows = [(k, ("bad words here " if k % 2 else "fine words there ") * 5, "en", "x") for k in range(60)] * 2 + [(61, None, None, None), (None, "bad", "en", "x"), (62, "bad " * 5000, "en", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(61)] + [(5, 0), (None, 1), (7, None), (61, 0), (62, 1)], "doc_id long, toxic int")
    model = toxicity.fit(df, labels, max_chars=10_000)
    out, score, toxic = toxicity.score(df, model)
    assert score == "score_" and toxic == "toxic" and out.columns[:4] == df.columns and out.count() == len(rows)
    by_id = {}
    for r in out.filter("doc_id < 60").collect():
        assert by_id.setdefault(r["doc_id"], r[score]) == r[score]
    assert np.mean([by_id[k] for k in by_id if k % 2]) > np.mean([by_id[k] for k in by_id if k % 2 == 0])


def test_chunks_of_a_long_text_pool_like_the_whole():
    rng = np.random.default_rng(0)
    model = toxicity.train([rng.integers(1, 99, (5, 2)) for _ in range(4)], np.array([0, 1, 0, 1], np.float32), np.ones(4, np.float32), 1)
    ids = toxicity.word_ids(" ".join(f"w{''.join(chr(97 + int(c)) for c in str(k))}" for k in range(toxicity.CHUNK * 2 + 5)))
    assert len(ids) == toxicity.CHUNK * 2 + 5
    whole = np.concatenate([r.max(0) for r in model.responses(model.vectors(toxicity.padded(ids)))])
    assert np.allclose(model.pooled(ids), whole, atol=1e-5)


@pytest.fixture(scope="module")
def scored(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    extra = spark.createDataFrame([(None, None, None, None, None), (-5, "", "en", None, 0), (-6, "123 !!!", None, None, 0)], docs.schema)
    model = toxicity.fit(docs, labels)
    out, score, toxic = toxicity.score(docs.unionByName(extra), model)
    rows = out.drop("text").join(labels.select("doc_id", labels["toxic"].alias("y")), "doc_id", "left").withColumnRenamed(score, "s").collect()
    return rows, model


def test_held_out_documents(scored):
    rows, model = scored
    test = [r for r in rows if r["y"] is not None and crc32(str(r["doc_id"]).encode()) % 4 == 2]
    y, s = np.array([r["y"] for r in test]), np.array([r["s"] for r in test])
    order = s[y == 1][:, None] - s[y == 0][None, :]
    assert (order > 0).mean() + 0.5 * (order == 0).mean() > 0.97
    flagged = s >= 0.3
    assert (flagged & (y == 1)).sum() / (y == 1).sum() > 0.85
    assert (flagged & (y == 0)).sum() / (y == 0).sum() < 0.02
    assert set(model.thresholds) <= {"de", "en", "es", "fr"} and model.thresholds


def test_empty_texts_get_one_score(scored):
    rows, _ = scored
    s = {r["s"] for r in rows if r["doc_id"] in (None, -5, -6)}
    assert len(s) == 1 and 0 <= s.pop() <= 1


def test_no_labels(spark):
    df = spark.createDataFrame([(1, "a", "en")], "doc_id long, text string, lang string")
    model = toxicity.fit(df, spark.createDataFrame([], "doc_id long, toxic int"))
    out, score, _ = toxicity.score(df, model)
    assert out.first()[score] == 0.5
    assert toxicity.score(df.limit(0), model)[0].count() == 0
