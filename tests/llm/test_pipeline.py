"""The pipeline's rows against the same stages in plain Python, and its query's contract."""

import hashlib
import os
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from sparrowset.llm import queries
from tests.llm.test_jaccard import slow_kept
from tests.llm.test_native import slow_targets, words
from tests.llm.test_tokens import check_packing, least_sequences

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_gives_what_its_sql_gives(spark, duck, name):
    got, want = queries.QUERIES[name](spark, SF).toPandas(), duck.sql(queries.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda df: sorted(map(repr, ([x.item() if hasattr(x, "item") else x for x in r] for r in df[sorted(df.columns)].itertuples(index=False))))
    assert rows(got) == rows(want)


def test_pipeline(spark, duck):
    from tokenizers import Tokenizer

    from sparrowset.llm.tokenizing import default_tokenizer

    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "simhash_near_dedup", "mixing", "packing"]
    good = {r[0] for r in duck.sql(f"SELECT doc_id FROM ({queries.ORACLE['op6_quality_rules']}) WHERE kept").fetchall()}
    docs = {d: (t, s) for d, t, s in duck.sql("SELECT doc_id, text, source FROM documents").fetchall() if d in good}
    last: dict[str, int] = {}
    for d, (t, _) in docs.items():
        last[t] = max(d, last.get(t, d))
    ids = sorted(last.values())
    ids = sorted(min(g)[0] for g in slow_kept([(d, docs[d][0]) for d in ids]))
    sizes = Counter()
    for d in ids:
        sizes[docs[d][1]] += len(words(docs[d][0]))
    target = slow_targets(sizes)
    copies = {}
    for d in ids:
        rate = target[docs[d][1]] / sizes[docs[d][1]]
        whole = int(rate + 1e-12)
        copies[d] = whole + (int(hashlib.md5(f"{d}:{hashlib.md5((docs[d][0] or '').encode()).hexdigest()}:0:20".encode()).hexdigest()[:13], 16) / 2**52 < rate - whole)
    t = Tokenizer.from_file(default_tokenizer())
    packed = [(d, [*t.encode(docs[d][0], add_special_tokens=False).ids, 2]) for d in ids for _ in range(copies[d])]
    used = check_packing(corpus_pipeline.run(spark, SF).collect(), packed, 1024)
    assert used <= 1.01 * least_sequences([len(i) for _, i in packed], 1024) + 2


def test_stages_on_awkward_rows(spark, tmp_path):
    """Null and repeated ids, null texts, repeated rows, clashing and additional columns."""
    rows = [(k, " ".join(f"w{k}x{j}" for j in range(30)), "en", "ab"[k % 2], 9, "x", 1) for k in range(12)]
    rows += [(3, rows[5][1] + " more", "en", None, 9, None, 2), (3, rows[3][1], "en", "b", 9, None, 3), (None, rows[7][1], None, None, None, None, None), (None, None, None, None, None, None, None), (None, None, None, None, None, None, None), (None, " ".join(f"own{j}" for j in range(20)), "fr", "c", 9, "y", 4), (3, " ".join(f"clean{j}" for j in range(20)), "fr", "c", 9, "y", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string, s long")
    spark.createDataFrame([(3, 1), (None, 0), (5, None)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name == "packing":
            assert out.count() == docs.count()
            break
        assert out.columns == docs.columns, name
        assert {r["text"] for r in out.collect()} <= {r[1] for r in rows}
        docs = spark.createDataFrame(out.collect(), docs.schema)
        texts = {r["text"] for r in docs.collect()}
        assert rows[-1][1] in texts and rows[-2][1] in texts or name == "mixing"


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert stage(spark, docs.limit(0), SF).count() == 0
