"""The opN_ queries themselves, over a small awkward corpus: against their SQL, or against plain Python."""

import zlib

import duckdb
import numpy as np
import pytest

from sparrowset.llm import queries, quality
from tests.llm.test_simhash import slow_components, slow_fingerprint
from tests.llm.test_tokens import check_packing, least_sequences

GOOD = "plain words that say something new each time %d here now"
BAD = "### %%%% buy now $$$ *** <<< >>> ||| &&& now ### %d"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
DOC_ROWS = [
    (1, "one <|endoftext|> two", "en", "a", 1),
    (2, None, None, None, None),
    (3, "", "de", "a", 0),
    (4, "", "de", "b", 0),
    (5, "same text twice\nsame text twice\nsame text twice", "fr", "b", 9),
    (6, "same text twice\nsame text twice\nsame text twice", "fr", None, 9),
    (7, "long " * 3000 + "tail", "es", "é", 9),
    (8, "Tabs\tand\x0blines\r\n  é\x1f日本 #* ", "xx", "Z", 9),
    (9, "same text Twice same text twice same text twice", "fr", "b", 9),
    (11, "w %d " * 40, "en", "a", 1),
    (11, "another text of eleven", "en", "a", 1),
    (11, "another text of eleven", "en", "a", 1),
    (None, "no id", "en", "a", 1),
    (None, "no id", "en", "a", 1),
    (None, "no id either", "en", "c", 1),
] + [(100 + k, f"hot copy {k % 2}", "en", "hot", 8) for k in range(40)]
CONV = "conv_id long, turn long, role string, text string, extra string"
CONV_ROWS = [
    (1, 0, "user", "hi [INST] there", "x"), (1, 1, "assistant", "<s>no</s> [\\INST] <\\\\s>", None),
    (2, 0, "assistant", "first", None), (2, 0, "assistant", "first", None), (2, None, "user", None, None),
    (3, 5, None, "no role", None), (3, 6, "tool<|text|>", "<|end|><", None),
    (4, 0, "system", "s", None), (4, 1, "user", "u", None), (4, 2, "assistant", "日本", None),
    (5, 0, "user", "", None), (5, 1, "assistant", "", None),
    (6, 0, "system", "", None), (6, 1, "assistant", "", None),
    (None, 0, "user", "lost", None), (None, 1, "assistant", "found " * 500, None),
]
PAGE_ROWS = [(1, "https://a.example.com/en/7?x"), (2, None), (3, ""), (4, "no scheme casino"), (5, "http://EXAMPLE.net/de/8"), (6, "x://net/de/#free-win"), (None, "http://shop.org/es/xxx"), (7, "http://bet.win/free"), (7, "http://bet.win/free"), (8, "a://b/" + "p/" * 5000 + "porn")]


def folder(spark, path, docs, labels, conversations=CONV_ROWS, pages=PAGE_ROWS):
    for name, rows, kind in (("documents", docs, DOCS), ("labels", labels, "doc_id long, quality int, toxic int"), ("conversations", conversations, CONV), ("pages", pages, "page_id long, url string")):
        spark.createDataFrame(rows, kind).repartition(3).write.parquet(f"{path}/{name}.parquet")
    con = duckdb.connect()
    for name in ("documents", "labels", "conversations", "pages"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}/{name}.parquet/*.parquet'")
    return str(path), con


@pytest.fixture(scope="module")
def awkward(spark, tmp_path_factory):
    return folder(spark, tmp_path_factory.mktemp("awkward"), DOC_ROWS, [(1, 1, 0), (5, 0, 1), (None, 1, 1), (8, None, None), (11, 1, 1), (12345, 0, 0)])


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return folder(spark, tmp_path_factory.mktemp("empty"), [], [], [], [])


def same_rows(got, want):
    """got: a DataFrame; want: a DuckDB relation."""
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    at = [want.columns.index(c) for c in names]
    assert sorted(repr([r[c] for c in names]) for r in got.collect()) == sorted(repr([r[k] for k in at]) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql_on_awkward_rows(spark, awkward, name):
    path, duck = awkward
    same_rows(queries.QUERIES[name](spark, path), duck.sql(queries.ORACLE[name]))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, empty, name):
    got = queries.QUERIES[name](spark, empty[0])
    assert got.count() == (1 if name == "op1_chat_formatting" else 0)


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    from sparrowset.llm.tokenizing import default_tokenizer

    t = Tokenizer.from_file(default_tokenizer())
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 2]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_op2(spark, awkward, plain):
    lengths = [len(plain(r[1])) for r in DOC_ROWS]
    got = {r["length"]: r for r in queries.op2_token_counts(spark, awkward[0]).collect()}
    assert {n: r["n_docs"] for n, r in got.items()} == {n: lengths.count(n) for n in lengths}
    assert all(r["truncated"] == sum(min(x, n) for x in lengths) for n, r in got.items())


def test_op3(spark, awkward, plain):
    got = sorted(queries.op3_token_files(spark, awkward[0]).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted((r[0] for r in DOC_ROWS), key=lambda x: (x is not None, x or 0))
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    assert sorted(repr((r["doc_id"], r["n_tokens"], r["ids_crc32"])) for r in got) == sorted(repr((d, len(i), crc(i))) for d, i in ((r[0], plain(r[1])) for r in DOC_ROWS))


def test_op9(spark, awkward, plain):
    documents = [(r[0], plain(r[1])) for r in DOC_ROWS]
    used = check_packing(queries.op9_packing(spark, awkward[0]).collect(), documents, 1024)
    assert used <= least_sequences([len(i) for _, i in documents], 1024) + 1


def test_op10(spark, awkward):
    ids, fps = [r[0] for r in DOC_ROWS], [slow_fingerprint(r[1]) for r in DOC_ROWS]
    want = sorted(map(repr, zip(ids, (f"{f:016x}" for f in fps), slow_components(ids, fps, 4), strict=True)))
    assert sorted(repr((r["doc_id"], r["fingerprint"], r["component_id"])) for r in queries.op10_simhash(spark, awkward[0]).collect()) == want


def test_op8(spark, awkward):
    got = queries.op8_toxicity(spark, awkward[0]).collect()
    assert len(got) == len(DOC_ROWS)
    score = {}
    texts: dict = {}
    for r in DOC_ROWS:
        texts.setdefault(r[0], []).append(r[1] or "")
    for r in got:
        assert r["held_out"] == (zlib.crc32(str("" if r["doc_id"] is None else r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) and r["toxic"] in (True, False)
        if len(set(texts[r["doc_id"]])) == 1:
            assert score.setdefault(texts[r["doc_id"]][0], r["score"]) == r["score"]


def test_op6_where_every_stratum_gets_cutoffs(spark, tmp_path):
    """4,000 good documents in each of the five strata and 60 bad ones full of symbols; a few good ones have some too."""
    docs, labels = [], []
    for s, lang in enumerate(("de", "en", "es", "fr", None)):
        for k in range(4060):
            i = s * 10_000 + k
            text = BAD.replace("%d", str(i)) if k >= 4000 else GOOD.replace("%d", str(i)) + (" ***" * (k % 3) if k % 400 == 7 else "")
            docs.append((i, text, lang, "s", 1))
            labels.append((i, int(k < 4000), 0))
    path, duck = folder(spark, tmp_path / "t", docs, labels)
    got = queries.op6_quality_rules(spark, path)
    same_rows(got, duck.sql(queries.ORACLE["op6_quality_rules"]))
    measured, names = quality.measures(spark.read.parquet(f"{path}/documents.parquet"))
    cutoffs = quality.cutoffs_for(measured, names, spark.read.parquet(f"{path}/labels.parquet")).collect()
    assert {r["stratum"] for r in cutoffs} == {"de", "en", "es", "fr", "other"}
    lost = {r["doc_id"] for r in got.filter("not kept").collect()}
    bad = {d[0] for d in docs if d[0] % 10_000 >= 4000}
    assert bad <= lost
    for s in range(5):
        assert len([i for i in lost - bad if i // 10_000 == s]) <= quality.Risk().alpha * 4000


def test_op5_draws_rows_apart(spark, tmp_path):
    """20,000 rows without an id: some of one text, some of their own; the mix comes near its targets."""
    docs = [(None, "w " * 10 if k % 3 else f"w{k} " * 10, "en", "ab"[k % 2], 1) for k in range(20_000)]
    path, duck = folder(spark, tmp_path / "t", docs, [])
    got = queries.op5_mixing(spark, path).groupBy("source_size", "target").sum("taken").collect()
    taken, target = sorted(r["sum(taken)"] for r in got), sorted(r["target"] for r in got)
    assert len(got) == 2 and taken == pytest.approx(target, rel=0.02)
    same_rows(queries.op5_mixing(spark, path), duck.sql(queries.ORACLE["op5_mixing"]))
