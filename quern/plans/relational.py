"""Queries on the relational operators: scans, expressions, joins, groups, order, sets, subqueries, windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions.exprs import concat_all, exact_eq, exact_key, float_div, int_div, like, ordered
from quern.operators.ranges import range_join
from quern.operators.recursive import recursive_union

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a query under its function's name, with its SQL for the oracle."""

    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            SQL[key] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def both(name: str, sql: str, spark_sql: str | None = None) -> None:
    """A query given as SQL that both engines run."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from quern.sql import Engine

        return Engine(spark).with_tables(sf_dir).query(spark_sql or sql)

    query(sql, name)(run)


# ---- scans and filters ----

@query("SELECT * FROM nation")
def s01_table_scan(spark, sf):
    return t(spark, sf, "nation")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey BETWEEN 100 AND 200")
def s02_key_range(spark, sf):
    return t(spark, sf, "orders").filter(F.col("o_orderkey").between(100, 200)).select("o_orderkey", "o_totalprice")


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey")
def s03_covering_scan(spark, sf):
    return t(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_custkey FROM orders WHERE o_custkey IN (1, 7, 13, 70)")
def s04_covering_seek(spark, sf):
    return t(spark, sf, "orders").filter(F.col("o_custkey").isin(1, 7, 13, 70)).select("o_custkey")


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_custkey = 7")
def s05_index_lookup(spark, sf):
    return t(spark, sf, "orders").filter("o_custkey = 7").select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("SELECT o_custkey, o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1995-02-01'")
def s06_sorted_entries(spark, sf):
    rows = t(spark, sf, "orders").filter("o_orderdate >= timestamp_ntz '1995-01-01' AND o_orderdate < timestamp_ntz '1995-02-01'")
    return rows.select("o_custkey", "o_orderkey").repartitionByRange("o_custkey").sortWithinPartitions("o_custkey", "o_orderkey")


@query("SELECT n_name FROM nation WHERE n_regionkey = 2")
def s08_temp_view(spark, sf):
    t(spark, sf, "nation").createOrReplaceTempView("quern_temp_nation")
    return spark.table("quern_temp_nation").filter("n_regionkey = 2").select("n_name")


@query("SELECT 1 AS one, 'x' AS letter")
def s10_no_from(spark, sf):
    return spark.range(1).select(F.lit(1).alias("one"), F.lit("x").alias("letter"))


@query("SELECT event_id, user_id FROM events WHERE event_id >= 100 AND event_id < 160 OR event_type LIKE 'pur%'")
def s22_range_and_prefix(spark, sf):
    return t(spark, sf, "events").filter(F.col("event_id").between(100, 159) | F.col("event_type").startswith("pur")).select("event_id", "user_id")


@query("SELECT o_orderkey, o_totalprice * 2 AS dbl, upper(o_orderstatus) AS st FROM orders")
def p01_projection(spark, sf):
    return t(spark, sf, "orders").select("o_orderkey", (F.col("o_totalprice") * 2).alias("dbl"), F.upper("o_orderstatus").alias("st"))


@query("SELECT n.*, r_name FROM nation n JOIN region ON n_regionkey = r_regionkey")
def p02_star(spark, sf):
    n = t(spark, sf, "nation").alias("n")
    return n.join(t(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n.*", "r_name")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > 100000 AND o_orderstatus <> 'F'")
def p03_filter(spark, sf):
    return t(spark, sf, "orders").filter((F.col("o_totalprice") > 100000) & (F.col("o_orderstatus") != "F")).select("o_orderkey")


both("p04_names", "SELECT N.n_name AS NN, R.r_name FROM nation AS N JOIN region AS R ON N.N_REGIONKEY = R.R_REGIONKEY")


@query("SELECT p_partkey, p_size = 10 AS eq, p_size <> 10 AS ne, p_size < 10 AS lt, p_size >= 10 AS ge, CAST(p_size AS DOUBLE) = 10.0 AS mixed FROM part")
def p05_comparisons(spark, sf):
    s = F.col("p_size")
    return t(spark, sf, "part").select("p_partkey", (s == 10).alias("eq"), (s != 10).alias("ne"), (s < 10).alias("lt"), (s >= 10).alias("ge"), exact_eq(s.cast("bigint"), F.lit(10.0)).alias("mixed"))


@query("SELECT n_nationkey, (x > 5) AND (n_nationkey > 10) AS a, (x > 5) OR (n_nationkey > 10) AS o, NOT (x > 5) AS n FROM (SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE n_nationkey END AS x FROM nation) q")
def p06_three_valued(spark, sf):
    rows = t(spark, sf, "nation").select("n_nationkey", F.when(F.col("n_nationkey") % 3 != 0, F.col("n_nationkey")).alias("x"))
    x, k = F.col("x") > 5, F.col("n_nationkey") > 10
    return rows.select("n_nationkey", (x & k).alias("a"), (x | k).alias("o"), (~x).alias("n"))


@query("SELECT n_nationkey, x IS NULL AS isn, x IS NOT NULL AS nn FROM (SELECT n_nationkey, nullif(n_regionkey, 0) AS x FROM nation) q")
def p07_is_null(spark, sf):
    rows = t(spark, sf, "nation").withColumn("x", F.nullif(F.col("n_regionkey"), F.lit(0)))
    return rows.select("n_nationkey", F.col("x").isNull().alias("isn"), F.col("x").isNotNull().alias("nn"))


@query("SELECT n_name FROM nation WHERE n_regionkey IN (1, 3)")
def p08_in_list(spark, sf):
    return t(spark, sf, "nation").filter(F.col("n_regionkey").isin(1, 3)).select("n_name")


both("p08_not_in_null", "SELECT n_name FROM nation WHERE n_regionkey NOT IN (1, NULL)")


@query("SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20 AND p_partkey NOT BETWEEN 50 AND 60")
def p09_between(spark, sf):
    return t(spark, sf, "part").filter(F.col("p_size").between(10, 20) & ~F.col("p_partkey").between(50, 60)).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_name LIKE '%a_e%'")
def p10_like(spark, sf):
    return t(spark, sf, "part").filter(like(F.col("p_name"), "%a_e%")).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_brand ILIKE 'brand%'")
def p10_ilike(spark, sf):
    return t(spark, sf, "part").filter(like(F.col("p_brand"), "brand%", ignore_case=True)).select("p_partkey")


@query("SELECT n_nationkey, concat(n_name, '\\x') LIKE '%\\x' AS hit FROM nation")
def p10_backslash(spark, sf):
    return t(spark, sf, "nation").select("n_nationkey", like(F.concat("n_name", F.lit("\\x")), "%\\x").alias("hit"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'hi' WHEN o_totalprice > 50000 THEN 'mid' ELSE 'lo' END AS band, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS st FROM orders")
def p11_case(spark, sf):
    p, s = F.col("o_totalprice"), F.col("o_orderstatus")
    return t(spark, sf, "orders").select("o_orderkey", F.when(p > 200000, "hi").when(p > 50000, "mid").otherwise("lo").alias("band"), F.when(s == "F", 1).when(s == "O", 2).alias("st"))


@query("SELECT p_partkey, p_partkey // 7 AS q, p_partkey % 7 AS r, -p_size AS neg, p_retailprice / 4 AS quarter, p_retailprice / (p_size % 2) AS ieee FROM part")
def p12_arithmetic(spark, sf):
    k = F.col("p_partkey")
    return t(spark, sf, "part").select("p_partkey", int_div(k, F.lit(7)).alias("q"), (k % 7).alias("r"), (-F.col("p_size")).alias("neg"), (F.col("p_retailprice") / 4).alias("quarter"), float_div(F.col("p_retailprice"), F.col("p_size") % 2).alias("ieee"))


both("p13_concat_operator", "SELECT n_name || '-' || nullif(n_name, 'n1') AS c FROM nation")
both("p14_cast", "SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS b, CAST(o_orderkey AS VARCHAR(20)) AS s FROM orders", "SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS b, o_orderkey::string AS s FROM orders")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > ALL (SELECT o_totalprice FROM orders WHERE o_custkey = 7) AND o_custkey = ANY (SELECT c_custkey FROM customer WHERE c_nationkey = 3)")
def p15_quantified(spark, sf):
    o = t(spark, sf, "orders")
    top = o.filter("o_custkey = 7").agg(F.max("o_totalprice").alias("top"))
    some = t(spark, sf, "customer").filter("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"))
    return o.join(some, "o_custkey", "left_semi").join(F.broadcast(top), F.coalesce(F.col("o_totalprice") > F.col("top"), F.lit(True))).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_custkey = 7 AND o_totalprice > 1000.0")
def p16_placeholders(spark, sf):
    from quern.sql import Engine

    return Engine(spark).with_tables(sf).query("SELECT o_orderkey FROM orders WHERE o_custkey = ? AND o_totalprice > ?", 7, 1000.0)


both("p17_precedence", "SELECT n_nationkey FROM nation WHERE n_nationkey > 3 AND n_regionkey = 1 OR NOT n_nationkey < 20 AND n_name || 'x' <> 'y'")

# ---- joins ----

@query("SELECT c_custkey, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey")
def j01_inner(spark, sf):
    return t(spark, sf, "customer").join(t(spark, sf, "orders"), F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "o_orderkey")


def _outer(spark, sf, how):
    on = (F.col("c_custkey") == F.col("o_custkey")) & (F.col("o_totalprice") > 300000)
    return t(spark, sf, "customer").join(t(spark, sf, "orders"), on, how).select("c_custkey", "o_orderkey")


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000")
def j02_left(spark, sf):
    return _outer(spark, sf, "left")


@query("SELECT c_custkey, o_orderkey FROM customer RIGHT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000")
def j03_right(spark, sf):
    return _outer(spark, sf, "right")


@query("SELECT s_suppkey, p_partkey FROM supplier FULL JOIN part ON s_suppkey = p_partkey AND p_size > 10")
def j04_full(spark, sf):
    return t(spark, sf, "supplier").join(t(spark, sf, "part"), (F.col("s_suppkey") == F.col("p_partkey")) & (F.col("p_size") > 10), "full").select("s_suppkey", "p_partkey")


@query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def j05_cross(spark, sf):
    return t(spark, sf, "region").crossJoin(t(spark, sf, "nation")).select("r_name", "n_name")


both("j06_comma", "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey")
both("j07_theta", "SELECT r_name, n_name FROM region JOIN nation ON r_regionkey < n_regionkey")


@query("SELECT s_suppkey, p_partkey FROM supplier JOIN part ON p_retailprice >= s_suppkey AND p_retailprice < s_suppkey + 2")
def j07_range(spark, sf):
    spans = t(spark, sf, "supplier").select("s_suppkey", F.col("s_suppkey").cast("double").alias("lo"), (F.col("s_suppkey") + 2.0).alias("hi"))
    return range_join(t(spark, sf, "part"), spans, "p_retailprice", "lo", "hi", 16.0).select("s_suppkey", "p_partkey")


@query("SELECT o_orderkey, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND l_extendedprice * 3 > o_totalprice")
def j08_residual(spark, sf):
    on = (F.col("o_orderkey") == F.col("l_orderkey")) & (F.col("l_extendedprice") * 3 > F.col("o_totalprice"))
    return t(spark, sf, "orders").join(t(spark, sf, "lineitem"), on).select("o_orderkey", "l_linenumber")


both("j09_using", "SELECT k, count(*) AS n FROM (SELECT l_orderkey AS k FROM lineitem) l JOIN (SELECT o_orderkey AS k FROM orders WHERE o_totalprice > 150000) o USING (k) GROUP BY k")


@query("SELECT a.k AS left_k, b.k AS right_k FROM (SELECT n_nationkey AS k FROM nation) a FULL JOIN (SELECT n_nationkey + 20 AS k FROM nation) b ON a.k = b.k")
def j09_full_using_keeps_both(spark, sf):
    a = t(spark, sf, "nation").select(F.col("n_nationkey").alias("left_k"))
    b = t(spark, sf, "nation").select((F.col("n_nationkey") + 20).alias("right_k"))
    return a.join(b, F.col("left_k") == F.col("right_k"), "full")


def _hinted(hint):
    def run(spark, sf):
        o = t(spark, sf, "orders").hint(hint)
        joined = t(spark, sf, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
        return joined.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("q"))

    return run


_PRIORITY = "SELECT o_orderpriority, count(*) AS n, sum(l_quantity) AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderpriority"
query(_PRIORITY, "j10_hash_join")(_hinted("shuffle_hash"))
query(_PRIORITY, "j11_merge_join")(_hinted("merge"))


@query("SELECT c_custkey, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_nationkey = 5 AND c_acctbal > 9000")
def j12_lookup_join(spark, sf):
    few = t(spark, sf, "customer").filter("c_nationkey = 5 AND c_acctbal > 9000")
    return few.join(t(spark, sf, "orders"), F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "o_orderkey")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def j13_semi(spark, sf):
    big = t(spark, sf, "orders").filter("o_totalprice > 400000")
    return t(spark, sf, "customer").join(big, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def j14_anti(spark, sf):
    big = t(spark, sf, "orders").filter("o_totalprice > 300000")
    return t(spark, sf, "customer").join(big, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


both("j14_not_in", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
both("j14_not_in_null", "SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT CASE WHEN r_regionkey = 0 THEN NULL ELSE r_regionkey END FROM region)")


@query("SELECT n_nationkey, p_partkey FROM nation JOIN part ON CAST(n_nationkey AS DOUBLE) = p_retailprice - floor(p_retailprice) + p_size")
def j15_int_double_key(spark, sf):
    parts = t(spark, sf, "part").select("p_partkey", (F.col("p_retailprice") - F.floor("p_retailprice") + F.col("p_size")).alias("d"))
    return t(spark, sf, "nation").join(parts, F.col("n_nationkey").cast("bigint") == exact_key(F.col("d"))).select("n_nationkey", "p_partkey")


both("j16_self_chain", "SELECT a.n_name AS x, b.n_name AS y, r_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey JOIN region ON r_regionkey = b.n_regionkey WHERE a.n_nationkey < b.n_nationkey")

# ---- aggregation ----

@query("SELECT count(*) AS n, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS f, count(DISTINCT o_custkey) AS dc FROM orders")
def a01_counts(spark, sf):
    return t(spark, sf, "orders").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("o_orderstatus") == "F", 1)).alias("f"), F.count_distinct("o_custkey").alias("dc"))


both("a04_sum_int", "SELECT l_linenumber, CAST(sum(l_orderkey) AS BIGINT) AS s FROM lineitem GROUP BY l_linenumber")


@query("SELECT l_returnflag, avg(l_quantity) AS q, min(l_shipdate) AS mn, max(l_shipdate) AS mx FROM lineitem GROUP BY l_returnflag")
def a05_avg_min_max(spark, sf):
    return t(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.avg("l_quantity").alias("q"), F.min("l_shipdate").alias("mn"), F.max("l_shipdate").alias("mx"))


both("a07_grand_total_empty", "SELECT count(*) AS n, sum(o_totalprice) AS s, max(o_orderkey) AS m FROM orders WHERE o_orderkey < 0")


@query("SELECT count(*) AS n, sum(l_extendedprice) AS s, min(l_discount) AS d, max(l_tax) AS x FROM lineitem")
def a08_total(spark, sf):
    return t(spark, sf, "lineitem").agg(F.count(F.lit(1)).alias("n"), F.sum("l_extendedprice").alias("s"), F.min("l_discount").alias("d"), F.max("l_tax").alias("x"))


@query("SELECT k, count(*) AS n FROM (SELECT CASE WHEN n_regionkey = 1 THEN NULL ELSE n_regionkey END AS k FROM nation) q GROUP BY k ORDER BY k NULLS FIRST")
def a09_groups_in_key_order(spark, sf):
    rows = t(spark, sf, "nation").select(F.when(F.col("n_regionkey") != 1, F.col("n_regionkey")).alias("k"))
    return rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).orderBy(*ordered(("k", "first")))


@query("SELECT o_orderkey, count(*) AS n, max(l_linenumber) AS m FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def a10_group_sorted_input(spark, sf):
    joined = t(spark, sf, "orders").join(t(spark, sf, "lineitem").hint("merge"), F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n"), F.max("l_linenumber").alias("m"))


both("a11_group_expression", "SELECT o_custkey % 7 AS k, count(*) AS n FROM orders GROUP BY o_custkey % 7")
both("a13_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")
both("a13_having_no_group", "SELECT count(*) AS n FROM orders HAVING count(*) > 1")
both("a14_nested", "SELECT o_orderpriority, upper(max(o_orderstatus)) AS m, CAST(sum(CASE WHEN o_totalprice > 100000 THEN 1 ELSE 0 END) AS BIGINT) AS big FROM orders GROUP BY o_orderpriority")


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def a16_distinct(spark, sf):
    return t(spark, sf, "orders").select("o_orderstatus", "o_orderpriority").distinct()


both("a17_distinct_aggregates", "SELECT p_brand, sum(DISTINCT p_size) AS s, avg(DISTINCT p_size) AS a FROM part GROUP BY p_brand".replace("sum(DISTINCT p_size)", "CAST(sum(DISTINCT p_size) AS BIGINT)"))
both("a18_grouping_sets", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), ())")
both("a18_rollup", "SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY ROLLUP (p_brand, p_size)")
both("a18_cube", "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY CUBE (c_mktsegment, c_nationkey)")

# ---- windows ----

@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn, sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS s FROM orders")
def w01_window(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return t(spark, sf, "orders").select("o_orderkey", F.row_number().over(w).cast("bigint").alias("rn"), F.sum("o_totalprice").over(w.rowsBetween(-1, 0)).alias("s"))


both("w02_range_frame", "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS n FROM part")
both("w03_ranking", "SELECT p_partkey, CAST(rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS BIGINT) AS r, CAST(dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS BIGINT) AS d, lag(p_size) OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS prev, lead(p_size, 2) OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS nxt FROM part")

# ---- order and limits ----

@query("SELECT x FROM (SELECT CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE n_nationkey END AS x FROM nation) q ORDER BY x DESC NULLS LAST")
def o01_order_nulls_last(spark, sf):
    return t(spark, sf, "nation").select(F.when(F.col("n_nationkey") % 4 != 0, F.col("n_nationkey")).alias("x")).orderBy(*ordered(("x", "desc")))


both("o02_nulls_first", "SELECT nullif(n_regionkey, 2) AS x, n_nationkey FROM nation ORDER BY x NULLS FIRST, n_nationkey DESC LIMIT 8")
both("o03_ordinal", "SELECT n_name, n_nationkey FROM nation ORDER BY 2 DESC LIMIT 5")
both("o04_hidden_key", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
both("o05_expression_key", "SELECT p_partkey FROM part ORDER BY p_size * 2 - p_partkey, p_partkey LIMIT 15")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5")
def o06_topk_offset(spark, sf):
    return t(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(*ordered(("o_totalprice", "desc"), "o_orderkey")).offset(5).limit(10)


both("o07_limit_zero", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 0")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey")
def o08_sort_all(spark, sf):
    return t(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(*ordered(("o_totalprice", "desc"), "o_orderkey"))


# ---- sets, CTEs, subqueries ----

both("u01_union_all", "SELECT n_regionkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region")
both("u02_union", "SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey FROM region")
both("u03_intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
both("u04_except", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 0")
both("u05_precedence", "SELECT 1 AS k UNION SELECT n_regionkey FROM nation INTERSECT SELECT r_regionkey FROM region WHERE r_regionkey > 2")
both("u06_intersect_all", "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
both("c01_cte", "WITH big AS (SELECT * FROM orders WHERE o_totalprice > 150000) SELECT b.o_orderstatus, count(*) AS n FROM big b JOIN big d ON b.o_custkey = d.o_custkey GROUP BY b.o_orderstatus")
both("c01_columns_and_shadowing", "WITH nation(k, v) AS (SELECT r_regionkey, r_name FROM region), two AS (SELECT k + 1 AS k, v FROM nation) SELECT two.k, nation.v FROM two JOIN nation ON two.k = nation.k")
both("c02_recursive_all", "WITH RECURSIVE r(n, s) AS (SELECT 1 AS n, CAST(1 AS BIGINT) AS s UNION ALL SELECT n + 1, s + n + 1 FROM r WHERE n < 200) SELECT * FROM r")


@query("WITH RECURSIVE e(a, b) AS (SELECT n_nationkey, (n_nationkey * 7 + 3) % 25 FROM nation), r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a) SELECT a, b FROM r")
def c02_recursive_union_cycle(spark, sf):
    e = t(spark, sf, "nation").select(F.col("n_nationkey").alias("a"), ((F.col("n_nationkey") * 7 + 3) % 25).alias("b"))
    hop = e.select(F.col("a").alias("via"), F.col("b").alias("to"))
    return recursive_union(e, lambda fresh: fresh.join(hop, F.col("b") == F.col("via")).select("a", "to"))


both("q01_derived", "SELECT s, count(*) AS n FROM (SELECT o_custkey, max(o_orderstatus) AS s FROM orders GROUP BY o_custkey) q GROUP BY s")
both("q02_scalar", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT 2 * avg(o_totalprice) FROM orders)")
both("q02_scalar_empty", "SELECT n_nationkey, (SELECT r_name FROM region WHERE r_regionkey = 99) AS x FROM nation")
both("q03_in", "SELECT count(*) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
both("q04_exists", "SELECT r_name FROM region WHERE EXISTS (SELECT 1 FROM nation WHERE n_regionkey = 9) OR r_regionkey = 1")
both("q05_correlated_in", "SELECT c_custkey FROM customer WHERE 'F' IN (SELECT o_orderstatus FROM orders WHERE o_custkey = c_custkey)")
both("q06_correlated_scalar", "SELECT c_custkey, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS m FROM customer")
both("q07_in_having", "SELECT o_custkey, sum(o_totalprice) AS s FROM orders GROUP BY o_custkey HAVING sum(o_totalprice) > (SELECT 3 * avg(o_totalprice) FROM orders)")

# ---- functions ----

@query("SELECT n_nationkey, n_name || '-' || CAST(n_regionkey AS VARCHAR) AS c, coalesce(nullif(n_regionkey, 0), -1) AS z, abs(n_nationkey - 10) AS a, upper(n_name) AS u, lower(n_name) AS l FROM nation")
def f01_functions(spark, sf):
    k = F.col("n_regionkey")
    return t(spark, sf, "nation").select("n_nationkey", concat_all(F.col("n_name"), F.lit("-"), k).alias("c"), F.coalesce(F.nullif(k, F.lit(0)), F.lit(-1)).alias("z"), F.abs(F.col("n_nationkey") - 10).alias("a"), F.upper("n_name").alias("u"), F.lower("n_name").alias("l"))


both("f03_concat_null", "SELECT n_nationkey, n_name || nullif(n_name, n_name) AS c FROM nation", "SELECT n_nationkey, concat(n_name, nullif(n_name, n_name)) AS c FROM nation")

# ---- the reference workload on these tables ----

both("ref_point_lookup", "SELECT * FROM orders WHERE o_orderkey = 1234")
both("ref_index_lookup", "SELECT count(*) AS n, sum(o_totalprice) AS s FROM orders WHERE o_custkey = 77")
both("ref_range_week", "SELECT count(*) AS n, sum(l_quantity * l_extendedprice) AS s FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-03-01' AND l_shipdate < TIMESTAMP '1995-03-08'", "SELECT count(*) AS n, sum(l_quantity * l_extendedprice) AS s FROM lineitem WHERE l_shipdate >= timestamp_ntz '1995-03-01' AND l_shipdate < timestamp_ntz '1995-03-08'")
both("ref_scan_group", "SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS q, avg(l_extendedprice) AS a FROM lineitem GROUP BY l_returnflag")
both("ref_join_group", "SELECT c_mktsegment, count(*) AS n, sum(o_totalprice) AS s FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_mktsegment")
both("ref_topk_join", "SELECT c_name, o_orderkey, o_totalprice FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
both("ref_sort", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey")
both("ref_in", "SELECT count(*) AS n, sum(o_totalprice) AS s FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')")
both("ref_exists", "SELECT count(*) AS n FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
both("ref_not_exists", "SELECT count(*) AS n FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
both("ref_totals", "SELECT count(*) AS n, sum(l_quantity) AS q, sum(l_extendedprice) AS p FROM lineitem")


# ---- the dialect, as text ----

both("p12_division_text", "SELECT o_orderkey, o_custkey // 7 AS a, (o_orderkey - 40) // 8 AS b, CAST(o_totalprice AS DOUBLE) / o_custkey AS c FROM orders WHERE o_custkey // 2 > 100", "SELECT o_orderkey, o_custkey / 7 AS a, (o_orderkey - 40) / 8 AS b, o_totalprice / o_custkey AS c FROM orders WHERE o_custkey / 2 > 100")
both("p10_like_text", "SELECT n_name, concat(n_name, '\\x') LIKE '%\\x' AS a, n_name ILIKE '%AN%' AS b FROM nation", "SELECT n_name, concat(n_name, '\\x') LIKE '%\\x' AS a, n_name ILIKE '%AN%' AS b FROM nation")
both("o01_order_text", "SELECT k FROM (SELECT nullif(n_regionkey, 2) AS k, n_nationkey FROM nation) q ORDER BY k ASC NULLS LAST, n_nationkey LIMIT 22", "SELECT k FROM (SELECT nullif(n_regionkey, 2) AS k, n_nationkey FROM nation) q ORDER BY k, n_nationkey LIMIT 22")
both("p05_exact_text", "SELECT count(*) AS n, CAST(sum(CASE WHEN k <> 5 THEN 1 ELSE 0 END) AS BIGINT) AS m FROM (SELECT o_orderkey AS k, CAST(o_orderkey + (o_orderkey % 2) * 0.5 AS DOUBLE) AS d FROM orders) q WHERE k % 2 = 0", "SELECT count(*) AS n, sum(CASE WHEN k <> 5 THEN 1 ELSE 0 END) AS m FROM (SELECT o_orderkey AS k, CAST(o_orderkey + (o_orderkey % 2) * 0.5 AS DOUBLE) AS d FROM orders) q WHERE k = d")
both("p15_all_text", "SELECT c_custkey FROM customer WHERE c_acctbal > (SELECT max(s_acctbal) FROM supplier)", "SELECT c_custkey FROM customer WHERE c_acctbal > ALL (SELECT s_acctbal FROM supplier)")
both("p15_any_text", "SELECT c_custkey FROM customer WHERE c_acctbal < (SELECT max(s_acctbal) FROM supplier) AND c_nationkey IN (SELECT s_nationkey FROM supplier)", "SELECT c_custkey FROM customer WHERE c_acctbal < ANY (SELECT s_acctbal FROM supplier) AND c_nationkey = SOME (SELECT s_nationkey FROM supplier)")
both("j09_full_using_text", "SELECT r.r_regionkey AS a, n.r_regionkey AS b, n.n_name FROM (SELECT r_regionkey FROM region WHERE r_regionkey > 1) r FULL JOIN (SELECT n_regionkey AS r_regionkey, n_name FROM nation) n ON r.r_regionkey = n.r_regionkey", "SELECT r.r_regionkey AS a, n.r_regionkey AS b, n.n_name FROM (SELECT r_regionkey FROM region WHERE r_regionkey > 1) r FULL JOIN (SELECT n_regionkey AS r_regionkey, n_name FROM nation) n USING (r_regionkey)")
both("c02_recursive_union_text", "WITH RECURSIVE walk(k) AS (SELECT 1 AS k UNION SELECT (k * 7) % 25 FROM walk) SELECT k, n_name FROM walk JOIN nation ON n_nationkey = k", "WITH RECURSIVE walk(k) AS (SELECT 1 AS k UNION SELECT (k * 7) % 25 FROM walk) SELECT k, n_name FROM walk JOIN nation ON n_nationkey = k")
both("s10_no_from_text", "SELECT 1 AS one, 'a' AS two")
both("o09_order_from_key", "SELECT o_orderkey FROM orders ORDER BY o_orderkey")
both("s09_derived_source", "SELECT k, n FROM (SELECT n_regionkey AS k, count(*) AS n FROM nation GROUP BY n_regionkey) q WHERE n > 1")


@query("SELECT o_orderkey FROM orders WHERE o_custkey = 12 OR o_custkey = 15")
def p16_numbered_text(spark, sf):
    from quern.sql import Engine

    return Engine(spark).with_tables(sf).query("SELECT o_orderkey FROM orders WHERE o_custkey = $2 OR o_custkey = $1", 15, 12)


@query("SELECT CAST(sum(n) AS BIGINT) AS n FROM (SELECT 1 AS g, count(*) AS n FROM nation) q GROUP BY g")
def a12_ordinal_is_a_constant(spark, sf):
    from quern.sql import Engine

    return Engine(spark).with_tables(sf).query("SELECT count(*) AS n FROM nation GROUP BY 1")
