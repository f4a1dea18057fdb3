"""Every query over the star-schema tables gives the rows that DuckDB gives for its SQL."""

import os

import duckdb
import pytest

from sparrowset.plans.bindings import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(map(repr, ([x.item() if hasattr(x, "item") else x for x in r] for r in df.itertuples(index=False))))


def test_each_query_has_its_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def plan(df):
    return df._jdf.queryExecution().toString()


def test_plans_push_down_and_prune(spark):
    text = plan(QUERIES["q7_masked_sum"](spark, SF))
    assert "GreaterThanOrEqual(l_shipdate" in text.split("PushedFilters")[1]
    assert "l_returnflag" not in text.split("== Physical Plan ==")[1]
    assert "CartesianProduct" not in plan(QUERIES["join_multi"](spark, SF))
    assert "TakeOrderedAndProject" in plan(QUERIES["top_k"](spark, SF))


def test_entry_without_llm(spark, tmp_path):
    """The entry file works where the llm folders and corpus_pipeline.py aren't there."""
    import shutil
    import subprocess
    import sys

    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{repo}/sparrowset", tmp_path / "sparrowset", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{repo}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(sorted(e.queries()) == sorted(e.oracle_sql()), len(e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert out.stdout.split() == ["True", str(len(QUERIES))], out.stderr
