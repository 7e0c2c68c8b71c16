import math

import pytest
from pyspark.sql import functions as F

from quern.functions.exprs import concat_all, exact_eq, exact_key, float_div, int_div, like, ordered
from quern.operators.ranges import range_join
from quern.operators.recursive import recursive_union
from quern.sql import Engine


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_exact_equality(spark):
    big = F.lit(2**53 + 1).cast("bigint")
    assert tuple(one(spark, exact_eq(big, F.lit(2.0**53)), exact_eq(F.lit(5).cast("bigint"), F.lit(5.0)), exact_eq(F.lit(5).cast("bigint"), F.lit(5.5)), exact_eq(big, F.lit(None).cast("double")), exact_key(F.lit(2.5)), exact_key(F.lit(1e300)))) == (False, True, False, None, None, None)


def test_divisions(spark):
    row = one(spark, int_div(F.lit(-7), F.lit(2)), float_div(F.lit(1.0), F.lit(0.0)), float_div(F.lit(-1.0), F.lit(0.0)), float_div(F.lit(0.0), F.lit(0.0)), float_div(F.lit(3.0), F.lit(2.0)))
    assert row[0] == -3 and row[1] == math.inf and row[2] == -math.inf and math.isnan(row[3]) and row[4] == 1.5
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        one(spark, int_div(F.lit(1), F.lit(0)))


def test_like_has_no_escape(spark):
    assert tuple(one(spark, like(F.lit("a\\x"), "a\\x"), like(F.lit("a\\b"), "a\\_"), like(F.lit("ABC"), "a%", True), concat_all(F.lit(1), F.lit("x")), concat_all(F.lit(None), F.lit("x")))) == (True, True, True, "1x", None)


def test_nulls_last_both_ways(spark):
    rows = spark.createDataFrame([(1,), (None,), (2,)], "x int")
    assert [r.x for r in rows.orderBy(*ordered("x")).collect()] == [1, 2, None]
    assert [r.x for r in rows.orderBy(*ordered(("x", "desc"))).collect()] == [2, 1, None]
    assert [r.x for r in rows.orderBy(*ordered(("x", "desc", "first"))).collect()] == [None, 2, 1]


def test_recursion_ends_on_cycles_and_nulls(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, None)], "a int, b int")
    hop = edges.select(F.col("a").alias("via"), F.col("b").alias("to"))
    out = recursive_union(edges, lambda f: f.join(hop, F.col("b") == F.col("via")).select("a", "to"))
    assert out.count() == 12
    with pytest.raises(RuntimeError):
        recursive_union(spark.range(1), lambda f: f.select(F.col("id") + 1), max_rounds=3)


def test_range_join_left(spark):
    points = spark.createDataFrame([(0.5,), (3.0,), (9.0,)], "x double")
    spans = spark.createDataFrame([(0.0, 3.0), (-5.0, 1.0), (4.0, 4.0)], "lo double, hi double")
    assert sorted((r.x, r.lo) for r in range_join(points, spans, "x", "lo", "hi", 2.0).collect()) == [(0.5, -5.0), (0.5, 0.0)]
    assert range_join(points, spans, "x", "lo", "hi", 2.0, "left").count() == 4


def test_group_by_number_is_a_constant(spark, sf):
    assert Engine(spark).with_tables(sf).query("SELECT count(*) AS n FROM nation GROUP BY 1").first().n == 25


def test_dialect_text(spark):
    from quern import dialect
    from quern.sql import Engine

    e = Engine(spark).register("t", spark.createDataFrame([(1, None, 2.5, "a\\b"), (7, 2, 0.0, "it's")], "a int, b bigint, d double, s string"))
    one = lambda q, *args, **named: [tuple(r) for r in e.query(q, *args, **named).collect()]
    assert one("SELECT 7/2 AS x, -7/2 AS y, 7/2/2 AS z, 7/2.0 AS w, a/d AS i FROM t") == [(3, -3, 1, 3.5, 0.4), (3, -3, 1, 3.5, float("inf"))]
    assert one("SELECT b FROM t ORDER BY b") == one("SELECT b FROM t ORDER BY b DESC") == [(2,), (None,)]
    assert one("SELECT s FROM t WHERE s LIKE ?", "a\\%") == [("a\\b",)] and one("SELECT s FROM t WHERE s = :v", v="it's") == [("it's",)]
    assert one("SELECT 9007199254740993 = d AS x, 9007199254740993 > d AS y FROM (SELECT CAST(9007199254740992 AS DOUBLE) AS d)") == [(False, True)]
    assert one("SELECT a FROM t WHERE a > ALL (SELECT b FROM t WHERE b IS NOT NULL)") == [(7,)] and one("SELECT a > ALL (SELECT b FROM t) AS x FROM t ORDER BY a") == [(False,), (None,)]
    assert dialect.plain("SELECT 'ORDER BY x' -- ORDER BY y") == "SELECT 'ORDER BY x' -- ORDER BY y"
    assert dialect.literal(-3) == "(-3)" and dialect.literal(None) == "NULL" and dialect.literal("o'k") == "'o''k'"
