"""The queries over the star-schema tables and the SQL that states the same results."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrowset.functions import ring
from sparrowset.operators import filters, groups, joins, order
from sparrowset.sources.tables import debug_table, parquet, random_table, rows, scan, schema, text_table
from sparrowset.sql import Engine

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def long(c: Column, name: str) -> Column:
    return c.cast("long").alias(name)


# --- scans, projection, predicates ---


@query
def scan_all(spark, d):
    return scan(spark, d, "nation")


@query
def scan_prefixed(spark, d):
    return scan(spark, d, "nation", prefix=True)


@query
def scan_columns(spark, d):
    return scan(spark, d, "customer", ["c_custkey", "c_nationkey"])


@query
def project(spark, d):
    return filters.project(parquet(spark, d, "orders"), ["o_orderkey", "o_custkey", "no_such_column"])


def _by_size(op: str, value: int, spark: SparkSession, d: str) -> DataFrame:
    return filters.filter_and(scan(spark, d, "part", ["p_partkey", "p_size"]), ["p_size"], [op], [value])


QUERIES |= {f"filter_{name}": partial(_by_size, op, value) for name, op, value in (("lt", "<", 10), ("le", "<=", 10), ("gt", ">", 40), ("ge", ">=", 40), ("eq", "=", 7), ("ne", "<>", 7))}


@query
def filter_range(spark, d):
    return filters.between(scan(spark, d, "orders", ["o_orderkey", "o_custkey"]), "o_custkey", 100, 200)


@query
def filter_and(spark, d):
    lines = parquet(spark, d, "lineitem")
    return filters.filter_and(lines, ["l_linenumber", "l_suppkey", "l_partkey"], [">=", "<", "<>"], [2, 50, 3]).select("l_orderkey", "l_linenumber")


@query
def filter_colcol(spark, d):
    return filters.filter_and(parquet(spark, d, "lineitem"), ["l_discount"], ["<"], [F.col("l_tax")]).select("l_orderkey", "l_linenumber")


@query
def compaction(spark, d):
    marked = filters.filter_and(parquet(spark, d, "lineitem"), ["l_linenumber"], ["="], [1], keep_invalid=True)
    return groups.count(filters.compact(marked), ["l_returnflag"])


@query
def filter_shared(spark, d):
    """Two constants, 100 and 200, each as XOR shares."""
    return filters.filter_shared(scan(spark, d, "orders", ["o_orderkey", "o_custkey"]), ["o_custkey", "o_custkey"], [">=", "<"], [(100 ^ 987654321, 987654321), (200 ^ -5, -5)])


@query
def rename(spark, d):
    return filters.rename(scan(spark, d, "nation", ["n_nationkey", "n_name"]), {"n_nationkey": "id", "n_name": "label"})


# --- statements, rows and text ---


@query
def insert_rows(spark, d):
    engine = Engine(spark, strict=True)
    engine.execute("CREATE DATABASE shop; USE shop; CREATE TABLE stock (item INT(64) PRIMARY KEY, pieces INT(16), sold BOOLEAN)")
    engine.execute("INSERT INTO stock VALUES (-41, 65535, 1); INSERT INTO stock (sold, item) VALUES (0, 42); INSERT INTO stock (item) VALUES (- 9223372036854775808)")
    return engine.execute("SELECT * FROM stock")


@query
def session_tables(spark, d):
    """Two databases with a table of one name; the one in use counts."""
    engine = Engine(spark, strict=True)
    for name, value in (("spring", 4), ("autumn", 10)):
        engine.execute(f"CREATE DATABASE {name}; USE {name}; CREATE TABLE months (m INT(8) PRIMARY KEY, late BOOLEAN); INSERT INTO months VALUES ({value}, 0); INSERT INTO months VALUES ({value + 1}, 1)")
    return engine.execute("USE spring; SELECT m, late FROM months WHERE late = 1;")


@query
def session_drop(spark, d):
    """A dropped table's name is free for another one; dropping the other database leaves this one in use."""
    engine = Engine(spark, strict=True)
    engine.execute("CREATE DATABASE old; CREATE DATABASE new; USE new; CREATE TABLE t (a INT(4)); INSERT INTO t VALUES (7); DROP TABLE t; DROP DATABASE old")
    return engine.execute("CREATE TABLE t (b INT(32), c INT(2)); INSERT INTO t VALUES (4294967295, 3); SELECT b, c FROM t")


@query
def where_sql(spark, d):
    engine = engine_with(spark, d, "orders", strict=True)
    return engine.execute("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey >= 100 AND (o_custkey < 200) AND o_orderkey <> 7 AND o_orderkey != 9 AND orders.o_orderkey <= 9000 AND o_custkey > 0")


@query
def ingest_rows(spark, d):
    return rows(spark, schema([("k", 64), ("small", 4), ("flag", 1)], "k"), [(k * k - 50, k % 16, k % 2) for k in range(20)])


@query
def random_source(spark, d):
    """How many numbers there are, whether all lie in [0, 2^63), and whether the same seed gives the same ones."""
    first, again = (random_table(spark, 1000, ["a", "b"], 3) for _ in range(2))
    return first.agg(F.count("*").alias("n"), F.coalesce(F.min(F.least("a", "b")) >= 0, F.lit(False)).alias("in_range"), F.lit(again.exceptAll(first).isEmpty()).alias("same"))


def _lines(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame([*enumerate(text.splitlines())], "line long, shown string")


@query
def result_table(spark, d):
    marked = filters.filter_and(scan(spark, d, "region", ["r_regionkey", "r_name"]), ["r_regionkey"], ["<"], [2], keep_invalid=True)
    return _lines(spark, text_table(order.sort(marked, ["r_regionkey"])))


@query
def debug_rows(spark, d):
    marked = filters.filter_and(scan(spark, d, "region", ["r_regionkey", "r_name"]), ["r_regionkey"], ["<"], [2], keep_invalid=True)
    return _lines(spark, debug_table(order.sort(marked, ["r_regionkey"])))


# --- joins ---


def urgent(spark: SparkSession, d: str) -> DataFrame:
    return filters.filter_and(parquet(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"], ["=", "="], ["F", "1-URGENT"])


@query
def join_nested_loop(spark, d):
    found = joins.join(parquet(spark, d, "nation"), parquet(spark, d, "region"), "n_regionkey", "r_regionkey", "nested_loop")
    return found.select("n_nationkey", "r_regionkey", "r_name")


@query
def join_hash(spark, d):
    found = joins.join(parquet(spark, d, "orders"), parquet(spark, d, "customer"), "o_custkey", "c_custkey")
    return found.select("o_orderkey", "c_custkey", "c_mktsegment")


@query
def join_hash_hint(spark, d):
    found = joins.join(parquet(spark, d, "orders"), parquet(spark, d, "customer"), "o_custkey", "c_custkey", "hash")
    return found.select("o_orderkey", "c_custkey", "c_nationkey")


@query
def bucket_hash(spark, d):
    return parquet(spark, d, "customer").select("c_custkey", joins.bucket_of("c_custkey").alias("tag"))


@query
def shuffle_buckets(spark, d):
    return groups.count(scan(spark, d, "orders", ["o_custkey"]).withColumn("tag", joins.bucket_of("o_custkey")), ["tag"])


@query
def join_left_outer(spark, d):
    return joins.left_outer(scan(spark, d, "customer", ["c_custkey"]), urgent(spark, d).select("o_custkey", "o_orderkey"), "c_custkey", "o_custkey").select("c_custkey", "o_orderkey", "matched")


@query
def join_multi(spark, d):
    chain = joins.join_chain(parquet(spark, d, "orders"), (parquet(spark, d, "customer"), "o_custkey", "c_custkey"), (parquet(spark, d, "nation"), "c_nationkey", "n_nationkey"))
    return chain.select("o_orderkey", "c_custkey", "n_name")


@query
def join_filtered(spark, d):
    orders = filters.filter_and(parquet(spark, d, "orders"), ["o_custkey"], ["<"], [100])
    customers = filters.filter_and(parquet(spark, d, "customer"), ["c_nationkey"], ["<>"], [3])
    return joins.join(orders, customers, "o_custkey", "c_custkey").select("o_orderkey", "c_custkey")


@query
def semi_join(spark, d):
    third = filters.filter_and(parquet(spark, d, "lineitem"), ["l_linenumber"], ["="], [3])
    return joins.semi_join(scan(spark, d, "orders", ["o_orderkey"]), third, "o_orderkey", "l_orderkey")


@query
def anti_join(spark, d):
    return joins.anti_join(scan(spark, d, "customer", ["c_custkey"]), urgent(spark, d), "c_custkey", "o_custkey")


@query
def in_flag(spark, d):
    return joins.in_flag(scan(spark, d, "customer", ["c_custkey"]), urgent(spark, d), "c_custkey", "o_custkey")


def engine_with(spark: SparkSession, d: str, *names: str, strict: bool = False) -> Engine:
    """An engine whose database holds the named tables."""
    engine = Engine(spark, strict)
    engine.execute("CREATE DATABASE tpch; USE tpch")
    for name in names:
        engine.catalog.attach(name, parquet(spark, d, name))
    return engine


@query
def join_chain_sql(spark, d):
    engine = engine_with(spark, d, "supplier", "nation", "region", strict=True)
    out = engine.execute("SELECT s_suppkey, n_nationkey, r_regionkey FROM supplier JOIN nation ON supplier.s_nationkey = nation.n_nationkey JOIN region ON nation.n_regionkey = region.r_regionkey WHERE r_regionkey >= 2 AND s_suppkey <> 5")
    return out.toDF("s_suppkey", "n_nationkey", "r_regionkey")


@query
def join_sql(spark, d):
    engine = engine_with(spark, d, "supplier", "nation")
    out = engine.execute("SELECT s_suppkey, n_nationkey FROM supplier JOIN nation ON supplier.s_nationkey = nation.n_nationkey WHERE n_nationkey <> 3")
    return out.toDF("s_suppkey", "n_nationkey")


# --- groups ---


@query
def group_single(spark, d):
    return groups.keys(parquet(spark, d, "orders"), ["o_custkey"])


@query
def group_multi(spark, d):
    return groups.keys(parquet(spark, d, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"])


@query
def agg_count(spark, d):
    return groups.count(parquet(spark, d, "orders"), ["o_custkey"])


@query
def agg_count_outer(spark, d):
    joined = joins.left_outer(scan(spark, d, "customer", ["c_custkey"]), urgent(spark, d).select("o_custkey"), "c_custkey", "o_custkey")
    return groups.count(joined, ["c_custkey"], match="matched")


@query
def agg_max(spark, d):
    return groups.maximum(parquet(spark, d, "lineitem"), ["l_orderkey"], "l_partkey")


@query
def agg_min(spark, d):
    return groups.minimum(parquet(spark, d, "lineitem"), ["l_orderkey"], "l_partkey")


@query
def agg_min_max(spark, d):
    return groups.min_and_max(parquet(spark, d, "lineitem"), ["l_orderkey"], "l_partkey", "l_suppkey", "mn", "mx")


@query
def distinct(spark, d):
    return groups.distinct(parquet(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"])


def second_lines(spark: SparkSession, d: str) -> DataFrame:
    return filters.filter_and(parquet(spark, d, "lineitem"), ["l_linenumber"], ["="], [2])


@query
def agg_sum(spark, d):
    return groups.total(second_lines(spark, d), "l_partkey")


@query
def agg_count_global(spark, d):
    return groups.total_count(second_lines(spark, d))


@query
def argmin_per_key(spark, d):
    return groups.first_per_key(parquet(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_custkey", "o_orderkey"])


# --- order and union ---


@query
def sort_single(spark, d):
    return order.sort(scan(spark, d, "orders", ["o_orderkey", "o_custkey"]), ["o_custkey"])


@query
def sort_multi(spark, d):
    return order.sort(scan(spark, d, "orders", ["o_orderkey", "o_custkey"]), ["o_custkey", "o_orderkey"], [False, True])


@query
def sort_sql(spark, d):
    return engine_with(spark, d, "part").execute("SELECT p_partkey, p_size FROM part ORDER BY p_size DESC")


@query
def top_k(spark, d):
    return order.top_k(groups.count(parquet(spark, d, "orders"), ["o_custkey"]), ["cnt", "o_custkey"], [False, True], 10)


@query
def slice(spark, d):  # noqa: A001
    return order.slice_rows(scan(spark, d, "orders", ["o_orderkey"]), ["o_orderkey"], 10, 20)


@query
def union_all(spark, d):
    return order.union_all(parquet(spark, d, "nation").select(F.col("n_nationkey").alias("k")), parquet(spark, d, "region").select("r_regionkey"))


# --- ring arithmetic ---


def on_lines(*columns: Callable[[], Column]) -> Query:
    return lambda spark, d: parquet(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *[c() for c in columns])


def _shared(share, reconstruct, *, then=None) -> Callable[[], Column]:
    """l_partkey shared, perhaps converted, and put together again, at width 64; masks follow the row's key."""
    key = ("l_orderkey", "l_linenumber")

    def build() -> Column:
        shares = share("l_partkey", *key)
        return reconstruct(*(then(*shares, *key) if then else shares)).alias("v")

    return build


part, supp = "l_partkey", "l_suppkey"
QUERIES |= {
    "ring_mask": on_lines(lambda: ring.ring(part, 8).alias("v")),
    "ring_and": on_lines(lambda: ring.ring_and(part, supp).alias("v")),
    "ring_xor": on_lines(lambda: ring.ring_xor(part, supp).alias("v")),
    "ring_not": on_lines(lambda: ring.ring_not(part).alias("v")),
    "ring_less_s": on_lines(lambda: ring.less_signed(part, supp, 32).alias("v")),
    "ring_equal": on_lines(lambda: ring.ring_equal(F.col(part).bitwiseAND(F.lit(7)), F.col(supp).bitwiseAND(F.lit(7)), 4).alias("v")),
    "ring_mux": on_lines(lambda: ring.mux("l_linenumber", part, supp).alias("v")),
    "ring_swap": on_lines(lambda: ring.swap(F.col(part) < F.col(supp), part, supp)[0].alias("lo"), lambda: ring.swap(F.col(part) < F.col(supp), part, supp)[1].alias("hi")),
    "ring_add": on_lines(lambda: ring.ring_add(part, supp, 8).alias("v")),
    "ring_mul": on_lines(lambda: ring.ring_mul(part, supp, 16).alias("v")),
    "ring_set_bit": on_lines(lambda: ring.set_bit(part, 3, True).alias("v"), lambda: ring.set_bit(part, 0, False).alias("w")),
    "ring_mux_bit": on_lines(lambda: ring.mux(ring.get_bit(part, 0), part, supp).alias("v")),
    "ring_bits": on_lines(lambda: ring.get_bit(part, 3).alias("v")),
    "share_bool": on_lines(_shared(ring.share_bool, ring.reconstruct_bool)),
    "share_arith": on_lines(_shared(ring.share_arith, ring.reconstruct_arith)),
    "share_a2b": on_lines(_shared(ring.share_arith, ring.reconstruct_bool, then=ring.arith_to_bool)),
    "share_b2a": on_lines(_shared(ring.share_bool, ring.reconstruct_arith, then=ring.bool_to_arith)),
}


@query
def ring_less_u(spark, d):
    return parquet(spark, d, "part").select("p_partkey", ring.less_unsigned(F.col("p_partkey") - 500, "p_size").alias("v"))


# --- analytic queries ---


@query
def q1_topk_in(spark, d):
    cohort = filters.filter_and(parquet(spark, d, "customer"), ["c_mktsegment"], ["="], ["BUILDING"])
    return order.top_k(groups.count(joins.semi_join(parquet(spark, d, "events"), cohort, "user_id", "c_custkey"), ["event_type"]), ["cnt", "event_type"], [False, True], 10)


@query
def q2_recurrence(spark, d):
    done = filters.filter_and(parquet(spark, d, "orders"), ["o_orderstatus"], ["="], ["F"])
    return groups.gaps_within(done, "o_custkey", "o_orderdate", 15, 56).select(F.col("o_custkey").alias("pid"))


@query
def q3_first_before_last(spark, d):
    click, purchase = (filters.compare("event_type", "=", x) for x in ("click", "purchase"))
    both = groups.first_and_last(parquet(spark, d, "events"), ["user_id"], "ts", click, purchase, "t_min", "t_max").filter("user_id is not null")
    return filters.filter_and(both, ["t_min"], ["<="], [F.col("t_max")]).select(F.col("user_id").alias("pid"), "t_min", "t_max")


@query
def q4_dup_pairs(spark, d):
    return groups.having_repeats(parquet(spark, d, "events"), ["user_id", "event_type"], ["user_id"])


@query
def q5_spread(spark, d):
    year = parquet(spark, d, "orders").filter((F.col("o_orderdate") >= "1996-01-01") & (F.col("o_orderdate") < "1997-01-01"))
    spread = groups.min_and_max(year.withColumn("plus", F.col("o_totalprice") + 1000), ["o_custkey"], "plus", "o_totalprice", "low", "high")
    return filters.filter_and(spread, ["low"], ["<"], [F.col("high")]).select("o_custkey")


@query
def q6_exists_count(spark, d):
    year = filters.between(parquet(spark, d, "orders"), "o_orderdate", F.lit("1995-01-01").cast("timestamp_ntz"), F.lit("1996-01-01").cast("timestamp_ntz"))
    late = filters.filter_and(parquet(spark, d, "lineitem"), ["l_discount"], ["<"], [F.col("l_tax")])
    return order.sort(groups.count(joins.semi_join(year, late, "o_orderkey", "l_orderkey"), ["o_orderpriority"], "order_count"), ["o_orderpriority"])


@query
def q7_masked_sum(spark, d):
    cents, percent = long(F.round(F.col("l_extendedprice") * 100), "cents"), long(F.round(F.col("l_discount") * 100), "percent")
    lines = parquet(spark, d, "lineitem")
    lines = filters.between(lines, "l_shipdate", F.lit("1995-01-01").cast("timestamp_ntz"), F.lit("1996-01-01").cast("timestamp_ntz"))
    lines = filters.filter_and(lines, ["l_quantity"], ["<"], [24]).select(cents, percent)
    return groups.total(filters.between(lines, "percent", 3, 7, closed=True), F.col("cents") * F.col("percent"), "revenue")


@query
def q8_histogram(spark, d):
    return order.sort(groups.histogram_with_zeros(scan(spark, d, "customer", ["c_custkey"]), "c_custkey", urgent(spark, d), "o_custkey"), ["custdist", "c_count"], False)


def _table_sql(where: str, valid: str = "") -> str:
    """The lines of a boxed table of region; valid: an expression for a further column of one digit."""
    head = " $valid |" if valid else ""
    mark = f" || ' ' || rpad(CAST({valid.removeprefix(', ')} AS VARCHAR), 7, ' ') || '|'" if valid else ""
    rule = "'+' || repeat('-', k + 2) || '+' || repeat('-', n + 2) || '+'" + (" || '--------+'" if valid else "")
    return f"""
WITH r AS (SELECT * FROM region {where}), w AS (
    SELECT CAST(greatest(11, max(length(CAST(r_regionkey AS VARCHAR)))) AS INTEGER) AS k, CAST(greatest(6, max(length(r_name))) AS INTEGER) AS n, count(*) AS rows FROM r
)
SELECT CAST(0 AS BIGINT) AS line, {rule} AS shown FROM w
UNION ALL SELECT 1, '| ' || rpad('r_regionkey', k, ' ') || ' | ' || rpad('r_name', n, ' ') || ' |{head}' FROM w
UNION ALL SELECT 2, {rule} FROM w
UNION ALL SELECT 2 + row_number() OVER (ORDER BY r_regionkey), '| ' || rpad(CAST(r_regionkey AS VARCHAR), k, ' ') || ' | ' || rpad(r_name, n, ' ') || ' |'{mark} FROM r, w
UNION ALL SELECT 3 + rows, {rule} FROM w
UNION ALL SELECT 4 + rows, '(' || rows || CASE WHEN rows = 1 THEN ' row)' ELSE ' rows)' END FROM w
"""


#: DuckDB states each result on its own.
ORACLE: dict[str, str] = {
    "scan_all": "SELECT * FROM nation",
    "scan_prefixed": "SELECT n_nationkey AS nation_n_nationkey, n_name AS nation_n_name, n_regionkey AS nation_n_regionkey FROM nation",
    "scan_columns": "SELECT c_custkey, c_nationkey FROM customer",
    "project": "SELECT o_orderkey, o_custkey FROM orders",
    "filter_lt": "SELECT p_partkey, p_size FROM part WHERE p_size < 10",
    "filter_le": "SELECT p_partkey, p_size FROM part WHERE p_size <= 10",
    "filter_gt": "SELECT p_partkey, p_size FROM part WHERE p_size > 40",
    "filter_ge": "SELECT p_partkey, p_size FROM part WHERE p_size >= 40",
    "filter_eq": "SELECT p_partkey, p_size FROM part WHERE p_size = 7",
    "filter_ne": "SELECT p_partkey, p_size FROM part WHERE p_size <> 7",
    "filter_range": "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey >= 100 AND o_custkey < 200",
    "filter_and": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber >= 2 AND l_suppkey < 50 AND l_partkey <> 3",
    "filter_colcol": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount < l_tax",
    "filter_shared": "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey BETWEEN 100 AND 199",
    "rename": "SELECT n_nationkey AS id, n_name AS label FROM nation",
    "insert_rows": "SELECT * FROM (VALUES (CAST(-41 AS BIGINT), CAST(65535 AS BIGINT), CAST(1 AS BIGINT)), (42, 0, 0), (-9223372036854775807 - 1, 0, 0)) t(item, pieces, sold)",
    "session_tables": "SELECT CAST(5 AS BIGINT) AS m, CAST(1 AS BIGINT) AS late",
    "session_drop": "SELECT CAST(4294967295 AS BIGINT) AS b, CAST(3 AS BIGINT) AS c",
    "where_sql": "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey BETWEEN 100 AND 199 AND o_orderkey NOT IN (7, 9) AND o_orderkey <= 9000",
    "ingest_rows": "SELECT k * k - 50 AS k, k % 16 AS small, k % 2 AS flag FROM range(20) t(k)",
    "random_source": "SELECT CAST(1000 AS BIGINT) AS n, TRUE AS in_range, TRUE AS same",
    "result_table": _table_sql("WHERE r_regionkey < 2"),
    "debug_rows": _table_sql("", ", CASE WHEN r_regionkey < 2 THEN 1 ELSE 0 END"),
    "join_hash_hint": "SELECT o_orderkey, c_custkey, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey",
    "join_chain_sql": "SELECT s_suppkey, n_nationkey, r_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey >= 2 AND s_suppkey <> 5",
    "ring_set_bit": "SELECT l_orderkey, l_linenumber, l_partkey | 8 AS v, (l_partkey >> 1) << 1 AS w FROM lineitem",
    "ring_mux_bit": "SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 2 = 1 THEN l_partkey ELSE l_suppkey END AS v FROM lineitem",
    "compaction": "SELECT l_returnflag, COUNT(*) AS cnt FROM lineitem WHERE l_linenumber = 1 GROUP BY l_returnflag",
    "join_nested_loop": "SELECT n_nationkey, r_regionkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey",
    "join_hash": "SELECT o_orderkey, c_custkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey",
    "bucket_hash": "SELECT c_custkey, CAST((c_custkey * 31 + 17) % 32 AS BIGINT) AS tag FROM customer",
    "shuffle_buckets": "SELECT CAST((o_custkey * 31 + 17) % 32 AS BIGINT) AS tag, COUNT(*) AS cnt FROM orders GROUP BY 1",
    "join_left_outer": """SELECT c_custkey, COALESCE(o_orderkey, 0) AS o_orderkey, CASE WHEN o_orderkey IS NULL THEN 0 ELSE 1 END AS matched FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus='F' AND o_orderpriority='1-URGENT') u ON c_custkey = o_custkey""",
    "join_multi": "SELECT o_orderkey, c_custkey, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey",
    "join_filtered": "SELECT o_orderkey, c_custkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_custkey < 100 AND c_nationkey <> 3",
    "semi_join": "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber = 3)",
    "anti_join": """SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM (SELECT * FROM orders WHERE o_orderstatus='F' AND o_orderpriority='1-URGENT') u WHERE o_custkey = c_custkey)""",
    "in_flag": """SELECT c_custkey, CASE WHEN o_custkey IS NULL THEN 0 ELSE 1 END AS flag FROM customer LEFT JOIN (SELECT DISTINCT o_custkey FROM (SELECT * FROM orders WHERE o_orderstatus='F' AND o_orderpriority='1-URGENT') u) d ON c_custkey = o_custkey""",
    "group_single": "SELECT DISTINCT o_custkey FROM orders",
    "group_multi": "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem",
    "agg_count": "SELECT o_custkey, COUNT(*) AS cnt FROM orders GROUP BY o_custkey",
    "agg_count_outer": """SELECT c_custkey, COUNT(o_orderkey) AS cnt FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus='F' AND o_orderpriority='1-URGENT') u ON c_custkey = o_custkey GROUP BY c_custkey""",
    "agg_max": "SELECT l_orderkey, MAX(l_partkey) AS max_l_partkey FROM lineitem GROUP BY l_orderkey",
    "agg_min": "SELECT l_orderkey, MIN(l_partkey) AS min_l_partkey FROM lineitem GROUP BY l_orderkey",
    "agg_min_max": "SELECT l_orderkey, MIN(l_partkey) AS mn, MAX(l_suppkey) AS mx FROM lineitem GROUP BY l_orderkey",
    "distinct": "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem",
    "agg_sum": "SELECT CAST(COALESCE(SUM(l_partkey), 0) AS BIGINT) AS s FROM lineitem WHERE l_linenumber = 2",
    "agg_count_global": "SELECT COUNT(*) AS cnt FROM lineitem WHERE l_linenumber = 2",
    "argmin_per_key": """SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) x WHERE rn = 1""",
    "sort_single": "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_custkey",
    "sort_multi": "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_custkey DESC, o_orderkey ASC",
    "sort_sql": "SELECT p_partkey, p_size FROM part ORDER BY p_size DESC",
    "top_k": "SELECT o_custkey, COUNT(*) AS cnt FROM orders GROUP BY o_custkey ORDER BY cnt DESC, o_custkey LIMIT 10",
    "slice": "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 10",
    "union_all": "SELECT n_nationkey AS k FROM nation UNION ALL SELECT r_regionkey AS k FROM region",
    "ring_mask": "SELECT l_orderkey, l_linenumber, (l_partkey & 255) AS v FROM lineitem",
    "ring_and": "SELECT l_orderkey, l_linenumber, (l_partkey & l_suppkey) AS v FROM lineitem",
    "ring_xor": "SELECT l_orderkey, l_linenumber, xor(l_partkey, l_suppkey) AS v FROM lineitem",
    "ring_less_u": """SELECT p_partkey, CAST(CASE WHEN xor(p_partkey - 500, CAST((-9223372036854775807-1) AS BIGINT)) < xor(CAST(p_size AS BIGINT), CAST((-9223372036854775807-1) AS BIGINT)) THEN 1 ELSE 0 END AS INT) AS v FROM part""",
    "ring_less_s": "SELECT l_orderkey, l_linenumber, (((l_partkey - l_suppkey) & 4294967295) >> 31) & 1 AS v FROM lineitem",
    "ring_mux": "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN l_partkey ELSE l_suppkey END AS v FROM lineitem",
    "ring_add": "SELECT l_orderkey, l_linenumber, ((l_partkey + l_suppkey) & 255) AS v FROM lineitem",
    "ring_mul": "SELECT l_orderkey, l_linenumber, ((l_partkey * l_suppkey) & 65535) AS v FROM lineitem",
    "join_sql": "SELECT s_suppkey, n_nationkey FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_nationkey <> 3",
    "ring_not": "SELECT l_orderkey, l_linenumber, xor(l_partkey & 1, 1) AS v FROM lineitem",
    "ring_equal": "SELECT l_orderkey, l_linenumber, CASE WHEN (l_partkey & 7) = (l_suppkey & 7) THEN 1 ELSE 0 END AS v FROM lineitem",
    "ring_swap": """SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey < l_suppkey THEN l_partkey ELSE l_suppkey END AS lo, CASE WHEN l_partkey < l_suppkey THEN l_suppkey ELSE l_partkey END AS hi FROM lineitem""",
    "ring_bits": "SELECT l_orderkey, l_linenumber, (l_partkey >> 3) & 1 AS v FROM lineitem",
    "share_bool": "SELECT l_orderkey, l_linenumber, l_partkey AS v FROM lineitem",
    "share_arith": "SELECT l_orderkey, l_linenumber, l_partkey AS v FROM lineitem",
    "share_a2b": "SELECT l_orderkey, l_linenumber, l_partkey AS v FROM lineitem",
    "share_b2a": "SELECT l_orderkey, l_linenumber, l_partkey AS v FROM lineitem",
    "q1_topk_in": """SELECT event_type, COUNT(*) AS cnt FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment='BUILDING') GROUP BY event_type ORDER BY cnt DESC, event_type LIMIT 10""",
    "q2_recurrence": """SELECT DISTINCT pid FROM (SELECT o_custkey AS pid, o_orderdate AS t, LEAD(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS t2 FROM orders WHERE o_orderstatus='F') x WHERE t2 >= t + INTERVAL 15 DAY AND t2 <= t + INTERVAL 56 DAY""",
    "q3_first_before_last": """SELECT d.user_id AS pid, d.t AS t_min, m.t AS t_max FROM (SELECT user_id, MIN(ts) AS t FROM events WHERE event_type='click' GROUP BY user_id) d JOIN (SELECT user_id, MAX(ts) AS t FROM events WHERE event_type='purchase' GROUP BY user_id) m ON d.user_id = m.user_id WHERE d.t <= m.t""",
    "q4_dup_pairs": "SELECT user_id FROM events GROUP BY user_id, event_type HAVING COUNT(*) > 1",
    "q5_spread": "SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1996 GROUP BY o_custkey HAVING MIN(o_totalprice + 1000) < MAX(o_totalprice)",
    "q6_exists_count": """SELECT o_orderpriority, COUNT(*) AS order_count FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01' AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_discount < l_tax) GROUP BY o_orderpriority ORDER BY o_orderpriority""",
    "q7_masked_sum": """SELECT CAST(COALESCE(SUM(CAST(ROUND(l_extendedprice*100) AS BIGINT) * CAST(ROUND(l_discount*100) AS BIGINT)), 0) AS BIGINT) AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01' AND l_shipdate < TIMESTAMP '1996-01-01' AND ROUND(l_discount*100) BETWEEN 3 AND 7 AND l_quantity < 24""",
    "q8_histogram": """WITH cnt AS (SELECT o_custkey, COUNT(*) AS c_count FROM (SELECT * FROM orders WHERE o_orderstatus='F' AND o_orderpriority='1-URGENT') u GROUP BY o_custkey), hist AS (SELECT c_count, COUNT(*) AS custdist FROM cnt GROUP BY c_count), zeros AS (SELECT CAST(0 AS BIGINT) AS c_count, COUNT(*) AS custdist FROM customer WHERE NOT EXISTS (SELECT 1 FROM cnt WHERE o_custkey = c_custkey)) SELECT * FROM hist UNION ALL SELECT * FROM zeros ORDER BY custdist DESC, c_count DESC""",
}
