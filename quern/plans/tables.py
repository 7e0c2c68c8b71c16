"""Queries on the table service: CSV, DML, constraints, partitions, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.sources.csv import copy_into, create_as_copy, from_text
from quern.storage import new_dir
from quern.tables.database import ColumnDef, Database, ForeignKey, TableDef, foreign_key_violations, table_stats
from quern.tables.partitions import ListPartitions, PartitionedTable, RangePartitions

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _supplier_csv(spark: SparkSession, sf: str) -> str:
    """The suppliers as CSV; every seventh balance is not a number."""
    path = new_dir(spark, "supplier-csv")
    rows = t(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey", F.when(F.col("s_suppkey") % 7 == 3, "bad").otherwise(F.round("s_acctbal", 2).cast("string")).alias("s_acctbal"))
    rows.coalesce(1).write.option("header", True).csv(path)
    return path


@query("SELECT s_suppkey, s_name, CAST(s_nationkey AS BIGINT) AS s_nationkey, round(s_acctbal, 2) AS s_acctbal FROM supplier WHERE s_suppkey % 7 <> 3")
def s11_csv_load(spark, sf):
    schema = T.StructType([T.StructField("s_suppkey", T.LongType(), False), T.StructField("s_name", T.StringType()), T.StructField("s_nationkey", T.LongType()), T.StructField("s_acctbal", T.DoubleType())])
    return copy_into(spark, _supplier_csv(spark, sf), schema)[0]


@query("SELECT count(*) FILTER (WHERE s_suppkey % 7 <> 3) AS loaded, count(*) FILTER (WHERE s_suppkey % 7 = 3) AS failed FROM supplier")
def s11_csv_counts(spark, sf):
    schema = T.StructType([T.StructField(n, k) for n, k in (("k", T.LongType()), ("n", T.StringType()), ("c", T.LongType()), ("b", T.DoubleType()))])
    good, bad = copy_into(spark, _supplier_csv(spark, sf), schema)
    both = good.select(F.lit(1).alias("g")).unionAll(bad.select(F.lit(0)))
    return both.agg(F.count_if(F.col("g") == 1).alias("loaded"), F.count_if(F.col("g") == 0).alias("failed"))


@query("SELECT s_suppkey, s_name, CAST(s_nationkey AS BIGINT) AS s_nationkey, CASE WHEN s_suppkey % 7 = 3 THEN 'bad' ELSE 'number' END AS s_acctbal FROM supplier")
def s12_csv_infer(spark, sf):
    rows = create_as_copy(spark, _supplier_csv(spark, sf))[0]
    return rows.withColumn("s_acctbal", F.when(F.col("s_acctbal") == "bad", "bad").otherwise("number"))


@query("SELECT * FROM (VALUES (CAST(1 AS BIGINT), 1.5, 'x', TIMESTAMP '2024-01-02 00:00:00'), (2, 2.0, NULL, TIMESTAMP '2024-01-03 04:05:06')) v(a, b, c, d)".replace("1.5", "CAST(1.5 AS DOUBLE)"))
def s13_csv_text(spark, sf):
    return from_text(spark, "a,b,c,d\n1,1.5,x,2024-01-02\n2,2,,2024-01-03 04:05:06")[0]


def _nation_database(spark: SparkSession, sf: str) -> Database:
    db = Database(spark, new_dir(spark, "database"))
    db.create_table(TableDef("region", (ColumnDef("r_regionkey", "INT", False), ColumnDef("r_name", "VARCHAR(20)")), primary_key=("r_regionkey",)))
    columns = (ColumnDef("n_nationkey", "INT", False), ColumnDef("n_name", "VARCHAR(30)"), ColumnDef("n_regionkey", "INT"), ColumnDef("note", "TEXT", True, "none"))
    db.create_table(TableDef("nation", columns, primary_key=("n_nationkey",), foreign_keys=(ForeignKey(("n_regionkey",), "region", ("r_regionkey",), "fk"),), checks=("n_nationkey >= 0",)))
    db.insert("region", t(spark, sf, "region"))
    db.insert("nation", t(spark, sf, "nation"), ["n_nationkey", "n_name", "n_regionkey"])
    return db


@query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey, 'none' AS note FROM nation")
def s17_insert_select(spark, sf):
    return _nation_database(spark, sf).table("nation")


@query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, CASE WHEN n_regionkey = 2 THEN upper(n_name) || '!' ELSE n_name END AS n_name, CAST(CASE WHEN n_regionkey = 2 THEN 3 ELSE n_regionkey END AS BIGINT) AS n_regionkey, CASE WHEN n_regionkey = 2 THEN CAST(n_regionkey AS VARCHAR) ELSE 'none' END AS note FROM nation")
def s18_update(spark, sf):
    db = _nation_database(spark, sf)
    db.update("nation", {"n_name": F.concat(F.upper("n_name"), F.lit("!")), "n_regionkey": 3, "note": F.col("n_regionkey").cast("string")}, "n_regionkey = 2")
    return db.table("nation")


@query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey FROM nation WHERE NOT coalesce(nullif(n_regionkey, 0) > 2, false)")
def s19_delete(spark, sf):
    db = _nation_database(spark, sf)
    db.delete("nation", F.nullif(F.col("n_regionkey"), F.lit(0)) > 2)
    return db.table("nation").select("n_nationkey")


def _nation_shell(spark: SparkSession, sf: str):
    from quern.statements import Shell

    return Shell(_nation_database(spark, sf))


@query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, CASE WHEN n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name LIKE 'A%') THEN 'a where b' ELSE 'none' END AS note, CAST(CASE WHEN n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name LIKE 'A%') THEN (SELECT max(r_regionkey) FROM region) ELSE n_regionkey END AS BIGINT) AS n_regionkey FROM nation")
def s18_update_subquery(spark, sf):
    shell = _nation_shell(spark, sf)
    shell.execute("UPDATE nation SET note = 'a where b', n_regionkey = (SELECT max(r_regionkey) FROM region) WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name LIKE ?)", "A%")
    return shell.execute("SELECT n_nationkey, note, n_regionkey FROM main.nation")


@query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey FROM nation n WHERE NOT EXISTS (SELECT 1 FROM region WHERE r_regionkey = n_regionkey AND r_regionkey > 2)")
def s19_delete_subquery(spark, sf):
    shell = _nation_shell(spark, sf)
    shell.execute("DELETE FROM nation WHERE EXISTS (SELECT 1 FROM region WHERE r_regionkey = n_regionkey AND r_regionkey > ?)", 2)
    return shell.execute("SELECT n_nationkey FROM nation")


@query("SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, r_name FROM region")
def t02_reopened_database(spark, sf):
    return Database(spark, _nation_database(spark, sf).path).table("region")


@query("SELECT count(*) AS n FROM nation")
def t11_rollback(spark, sf):
    shell = _nation_shell(spark, sf)
    shell.script("BEGIN; DELETE FROM nation WHERE n_regionkey = 1; CREATE TABLE more (id INT); ROLLBACK")
    return shell.execute("SELECT count(*) AS n FROM nation")


@query("SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey FROM region")
def t06_rename_table(spark, sf):
    shell = _nation_shell(spark, sf)
    shell.script("DROP TABLE nation; ALTER TABLE region RENAME TO area; CREATE UNIQUE INDEX by_name ON area (r_name)")
    return shell.execute("SELECT r_regionkey FROM area")


@query("SELECT CAST(0 AS BIGINT) AS n")
def s20_truncate(spark, sf):
    db = _nation_database(spark, sf)
    db.truncate("nation")
    return db.table("nation").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey <> 4)")
def t04_fk_violations(spark, sf):
    some = t(spark, sf, "customer").filter("c_nationkey <> 4")
    return foreign_key_violations(t(spark, sf, "orders"), ["o_custkey"], some, ["c_custkey"]).select("o_orderkey")


@query("SELECT CAST(n_nationkey AS BIGINT) AS id, n_name, 7 AS extra FROM nation".replace("7 AS", "CAST(7 AS BIGINT) AS"))
def t05_alter(spark, sf):
    db = _nation_database(spark, sf)
    db.add_column("nation", ColumnDef("extra", "INT", False, 7))
    db.rename_column("nation", "n_nationkey", "id")
    db.drop_column("nation", "note")
    return db.table("nation").drop("n_regionkey")


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')")
def t09_list_prune(spark, sf):
    scheme = ListPartitions("o_orderpriority", {"high": ["1-URGENT", "2-HIGH"], "mid": ["3-MEDIUM"]}, "rest")
    table = PartitionedTable(spark, new_dir(spark, "by-priority"), scheme).write(t(spark, sf, "orders").select("o_orderkey", "o_orderpriority"))
    return table.among(["1-URGENT", "5-LOW"])


def _by_key(spark: SparkSession, sf: str) -> PartitionedTable:
    scheme = RangePartitions("p_partkey", [("p0", 50), ("p1", 500), ("p2", 1500), ("p3", None)])
    return PartitionedTable(spark, new_dir(spark, "by-key"), scheme).write(t(spark, sf, "part").select("p_partkey", "p_size"))


@query("SELECT p_partkey, p_size FROM part WHERE p_partkey BETWEEN 40 AND 90")
def t09_range_prune(spark, sf):
    return _by_key(spark, sf).between(40, 90)


@query("SELECT p_partkey, p_size FROM part WHERE p_partkey IN (SELECT n_nationkey FROM nation)")
def s07_runtime_prune(spark, sf):
    return _by_key(spark, sf).matching(t(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("k")), "k")


@query("SELECT partition, count(*) AS rows FROM (SELECT CASE WHEN p_partkey < 50 THEN 'p0' WHEN p_partkey < 500 THEN 'p1' WHEN p_partkey < 1500 THEN 'p2' ELSE 'p3' END AS partition FROM part) q GROUP BY partition")
def t12_show_partitions(spark, sf):
    return _by_key(spark, sf).partitions()


@query("SELECT 'o_orderkey' AS \"column\", count(*) AS rows, count(DISTINCT o_orderkey) AS distinct_values, count(*) - count(o_orderkey) AS nulls, CAST(min(o_orderkey) AS VARCHAR) AS least, CAST(max(o_orderkey) AS VARCHAR) AS greatest FROM orders UNION ALL SELECT 'o_orderstatus', count(*), count(DISTINCT o_orderstatus), count(*) - count(o_orderstatus), min(o_orderstatus), max(o_orderstatus) FROM orders")
def t15_table_stats(spark, sf):
    return table_stats(t(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), exact=True)


@query("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_custkey = 12 AND o_totalprice > 1000 GROUP BY o_orderstatus")
def t16_prepared(spark, sf):
    from quern.sql import Engine

    return Engine(spark).with_tables(sf).query("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_custkey = :who AND o_totalprice > :least GROUP BY o_orderstatus", who=12, least=1000)


@query("SELECT window_start, event_type, count(*) AS n FROM (SELECT date_trunc('hour', ts) AS window_start, event_type FROM events) q GROUP BY ALL")
def x01_event_windows(spark, sf):
    from quern.streaming.windows import windowed_counts

    return windowed_counts(t(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
