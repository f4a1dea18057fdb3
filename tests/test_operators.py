"""Operators on small tables with ties, nulls and empty inputs."""

import pytest
from pyspark.sql import functions as F

from sparrowset.operators import filters, groups, joins, order
from sparrowset.relation import Relation
from sparrowset.sources import tables


@pytest.fixture(scope="module")
def left(spark):
    return spark.createDataFrame([(1, 10), (2, 20), (2, 21), (3, None), (None, 40)], "k long, v long")


@pytest.fixture(scope="module")
def right(spark):
    return spark.createDataFrame([(2, 200, "b"), (2, 201, "c"), (3, 300, None), (5, 500, "e"), (None, 0, "n")], "rk long, w long, s string")


def values(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda t: tuple((x is not None, x) for x in t))


@pytest.mark.parametrize("strategy", ["auto", "hash", "merge", "nested_loop"])
def test_join_strategies_agree(left, right, strategy):
    assert values(joins.join(left, right, "k", "rk", strategy)) == values(joins.join(left, right, "k", "rk")) != []


def test_joins(left, right):
    assert values(joins.left_outer(left, right, "k", "rk")) == values(
        left.sparkSession.createDataFrame(
            [(None, 40, 0, 0, None, 0), (1, 10, 0, 0, None, 0), (2, 20, 2, 200, "b", 1), (2, 20, 2, 201, "c", 1), (2, 21, 2, 200, "b", 1), (2, 21, 2, 201, "c", 1), (3, None, 3, 300, None, 1)],
            "k long, v long, rk long, w long, s string, m int",
        )
    )
    assert values(joins.semi_join(left, right, "k", "rk").select("v")) == [(None,), (20,), (21,)]
    assert values(joins.anti_join(left, right, "k", "rk").select("v")) == [(10,), (40,)]
    assert values(joins.in_flag(left, right, "k", "rk").select("v", "flag")) == [(None, 1), (10, 0), (20, 1), (21, 1), (40, 0)]
    nothing = right.limit(0)
    assert joins.join(left, nothing, "k", "rk").count() == 0
    assert {r["flag"] for r in joins.in_flag(left, nothing, "k", "rk").collect()} == {0}


def test_filters(left):
    for op, want in {"<": [10], "<=": [10, 20], ">": [21, 40], ">=": [20, 21, 40], "=": [20], "<>": [10, 21, 40]}.items():
        assert [r[1] for r in values(filters.filter_and(left, ["v"], [op], [20]))] == [None][:0] + want or sorted(r[1] for r in values(filters.filter_and(left, ["v"], [op], [20]))) == want
    marked = filters.filter_and(left, ["v"], [">"], [10], keep_invalid=True)
    twice = filters.filter_and(marked, ["k"], ["="], [2], keep_invalid=True)
    assert twice.count() == 5
    assert values(filters.compact(twice)) == values(filters.filter_and(left, ["v", "k"], [">", "="], [10, 2])) == values(filters.filter_and(marked, ["k"], ["="], [2]))
    assert filters.project(left, []).columns == filters.project(left, ["none"]).columns == ["k", "v"]
    assert filters.project(left, ["v", "none"]).columns == ["v"]
    with pytest.raises(ValueError):
        filters.filter_and(left, ["v"], ["~"], [1])


def test_groups(left):
    assert values(groups.count(left, ["k"])) == [(None, 1), (1, 1), (2, 2), (3, 1)]
    assert values(groups.min_and_max(left, ["k"], "v")) == [(None, 40, 40), (1, 10, 10), (2, 20, 21), (3, None, None)]
    assert values(groups.having_repeats(left, ["k"], ["k"])) == [(2,)]
    assert values(groups.histogram(left, ["k"])) == [(1, 3), (2, 1)]
    assert values(groups.first_per_key(left, ["k"], [F.desc("v") if False else -F.col("v")])) == [(None, 40), (1, 10), (2, 21), (3, None)]
    assert values(groups.next_in_group(left, ["k"], ["v"], "v", "nxt").filter("nxt is not null")) == [(2, 20, 21)]
    assert groups.total(left.limit(0), "v").first()[0] == 0 and groups.total_count(left.limit(0)).first()[0] == 0


def test_order(left, right):
    assert [r["v"] for r in order.sort(left, ["k", "v"], [False, True]).collect()] == [None, 20, 21, 10, 40]
    signs = left.sparkSession.createDataFrame([(-1,), (5,), (0,)], "v long")
    assert [r["v"] for r in order.sort(signs, ["v"], as_unsigned=True).collect()] == [0, 5, -1]
    assert [r["w"] for r in order.top_k(right, ["w"], False, 2).collect()] == [500, 300]
    assert [r["w"] for r in order.slice_rows(right, ["w"], 1, 2).collect()] == [200, 201]
    assert order.union_all(left, right.select("rk", "w")).columns == ["k", "v"]


def test_buckets(spark):
    df = spark.createDataFrame([(-5,), (0,), (1,), (33,)], "k long")
    assert [r["b"] for r in df.select(joins.bucket_of("k").alias("b")).collect()] == [-10, 17, 16, 16]
    dealt = joins.to_buckets(df, "k").withColumn("p", F.spark_partition_id()).collect()
    assert [r["tag"] for r in sorted(dealt, key=lambda r: r["k"])] == [-10, 17, 16, 16]
    assert len({r["p"] for r in dealt if r["tag"] == 16}) == 1


def test_relation_chains(left, right):
    out = Relation(left).filter_and(["v"], [">="], [20]).join(Relation(right), "k", "rk").count(["k"]).sort(["k"])
    assert values(out.df) == [(2, 4)]
    with pytest.raises(AttributeError):
        Relation(left).nothing()


def test_text_table(left):
    text = tables.text_table(left.filter("k = 1"))
    assert text.splitlines() == ["+---+----+", "| k | v  |", "+---+----+", "| 1 | 10 |", "+---+----+", "(1 row)"]


def test_text_tables_are_bounded_and_show_validity(left):
    marked = filters.filter_and(left, ["k"], [">="], [2], keep_invalid=True)
    assert tables.text_table(marked, 2).splitlines()[-1] == "(first 2 of 3 rows)"
    assert tables.text_table(marked.limit(0)).splitlines()[-1] == "(0 rows)"
    text = tables.debug_table(marked).splitlines()
    assert text[1].endswith("| $valid |") and text[-1] == "(5 rows)" and sum(x.endswith("| 0      |") for x in text) == 2
    assert tables.debug_table(left).count("| 1      |") == 5


@pytest.mark.parametrize("offset,n", [(0, 3), (5, 20), (90, 30), (100, 5), (37, 1)])
def test_far_slices(spark, offset, n):
    df = spark.range(100).select((F.col("id") * 37 % 100).alias("v"), F.lit("x").alias("s")).repartition(5)
    want = [r["v"] for r in order.slice_rows(df, ["v"], offset, n).collect()]
    assert [r["v"] for r in order.slice_rows(df, ["v"], offset, n, head_rows=0).collect()] == want == [*range(offset, min(100, offset + n))]


def test_gaps(spark):
    days = {1: [0, 15], 2: [0, 14, 28], 3: [0, 57], 4: [0, 56], 5: [3], 6: [0, 5, 10, 40], 7: [0, 0, 0], 8: [10, 12, 29, 29]}
    df = spark.createDataFrame([(k, d) for k, v in days.items() for d in v] + [(9, None), (None, 0), (None, 20)], "k long, d int").select("k", F.expr("timestamp_ntz '2024-02-20 10:00:00' + make_dt_interval(d)").alias("t"))
    assert values(groups.gaps_within(df, "k", "t", 15, 56)) == [(None,), (1,), (4,), (6,), (8,)]
    assert values(groups.gaps_within(df.limit(0), "k", "t", 15, 56)) == []


def test_first_and_last_and_zeros(spark, left, right):
    df = spark.createDataFrame([(1, "a", 5), (1, "b", 3), (1, "a", 2), (2, "a", 1), (3, "c", 9)], "k long, e string, t long")
    got = groups.first_and_last(df, ["k"], "t", F.col("e") == "a", F.col("e") == "b", "lo", "hi")
    assert values(got) == [(1, 2, 3), (2, 1, None)]
    assert values(groups.histogram_with_zeros(groups.keys(right, ["rk"]), "rk", left, "k")) == [(0, 2), (1, 3), (2, 1)]
    assert values(groups.histogram_with_zeros(right.limit(0), "rk", left.limit(0), "k")) == [(0, 0)]


def test_shared_constants(left):
    found = filters.filter_shared(left, ["v"], [">"], [(20 ^ 77, 77)])
    assert values(found) == [(None, 40), (2, 21)]


def test_ingest(spark):
    kind = tables.schema([("a", 8), ("f", 1)], "a")
    assert values(tables.rows(spark, kind, [(255, 1), (0, 0)])) == [(0, 0), (255, 1)]
    for bad in ([(256, 0)], [(1,)], [(1, 2)]):
        with pytest.raises(ValueError):
            tables.rows(spark, kind, bad)
    assert tables.rows(spark, kind, []).count() == 0


def test_streams_count_like_tables(spark, tmp_path):
    from sparrowset.streaming import counts

    rows = [(f"2024-01-01 00:0{m}:00", k) for m in range(6) for k in ("a", "b")]
    df = spark.createDataFrame(rows, "ts string, k string").select(F.to_timestamp("ts").alias("ts"), "k")
    df.write.parquet(str(tmp_path / "in"))
    stream = counts.filtered(counts.file_stream(spark, str(tmp_path / "in"), df), ["k"], ["="], ["a"])
    q = counts.windowed_count(stream, "ts", "2 minutes", ["k"], "1 minute").writeStream.outputMode("complete").format("memory").queryName("seen").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["cnt"] for r in spark.sql("select * from seen").collect()) == [2, 2, 2]
