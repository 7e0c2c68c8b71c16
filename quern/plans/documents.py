"""Queries on the document operators, over orders with their lines nested."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.docs.bson import sort_key
from quern.docs.expressions import compile_expression
from quern.docs.filters import compile_filter
from quern.docs.paths import resolve
from quern.docs.pipeline import aggregate
from quern.docs.updates import apply_update

QUERIES: dict = {}
SQL: dict[str, str] = {}


def order_documents(spark: SparkSession, sf: str) -> DataFrame:
    """{_id, cust, status, price, note?, meta: {prio, year}, flags: [..], lines: [{n, part, qty, flag}]}."""
    o = spark.read.parquet(f"{sf}/orders.parquet")
    l = spark.read.parquet(f"{sf}/lineitem.parquet")
    line = F.struct(F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("part"), F.col("l_quantity").alias("qty"), F.col("l_returnflag").alias("flag"))
    lines = l.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    docs = o.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    flags = F.array_sort(F.array_distinct(F.transform("lines", lambda x: x["flag"])))
    return docs.select(
        F.col("o_orderkey").alias("_id"), F.col("o_custkey").alias("cust"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"),
        F.when(F.col("o_orderkey") % 4 != 0, F.concat(F.lit("note-"), F.col("o_orderkey") % 10)).alias("note"),
        F.struct(F.col("o_orderpriority").alias("prio"), F.year("o_orderdate").alias("year")).alias("meta"), flags.alias("flags"), "lines",
    )


_HAS = "EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND {})"
_NOTE = "(CASE WHEN o_orderkey % 4 <> 0 THEN 'note-' || (o_orderkey % 10) END)"


def find(name: str, query: dict, where: str) -> None:
    """A filter and the SQL condition that it is held against."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        docs = order_documents(spark, sf)
        return docs.filter(compile_filter(query, docs.schema)).select("_id")

    QUERIES[name] = run
    SQL[name] = f"SELECT o_orderkey AS _id FROM orders WHERE {where}"


find("m01_eq", {"cust": 7, "lines.n": 2}, "o_custkey = 7 AND " + _HAS.format("l_linenumber = 2"))
find("m01_eq_array_element", {"flags": "R"}, _HAS.format("l_returnflag = 'R'"))
find("m01_eq_null", {"note": None}, "o_orderkey % 4 = 0")
find("m02_ne", {"note": {"$ne": "note-3"}}, f"coalesce({_NOTE} <> 'note-3', true)")
find("m03_nin", {"status": {"$nin": ["F", "O"]}}, "o_orderstatus NOT IN ('F', 'O')")
find("m04_compare", {"price": {"$gt": 100000, "$lte": 150000.5}}, "o_totalprice > 100000 AND o_totalprice <= 150000.5")
find("m04_compare_brackets", {"status": {"$gt": 5}}, "false")
find("m04_compare_any_element", {"lines.qty": {"$gte": 49}}, _HAS.format("l_quantity >= 49"))
find("m05_in", {"cust": {"$in": [1, 7, 9, "x"]}}, "o_custkey IN (1, 7, 9)")
find("m06_exists", {"note": {"$exists": True}, "nothing": {"$exists": False}}, "o_orderkey % 4 <> 0")
find("m07_size", {"lines": {"$size": 3}}, "(SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) = 3")
find("m08_all", {"flags": {"$all": ["R", "N"]}}, _HAS.format("l_returnflag = 'R'") + " AND " + _HAS.format("l_returnflag = 'N'"))
find("m09_elem_match", {"lines": {"$elemMatch": {"qty": {"$gt": 45}, "flag": "A"}}}, _HAS.format("l_quantity > 45 AND l_returnflag = 'A'"))
find("m09_elem_match_values", {"flags": {"$elemMatch": {"$gt": "B", "$lt": "P"}}}, _HAS.format("l_returnflag > 'B' AND l_returnflag < 'P'"))
find("m10_not", {"price": {"$not": {"$gt": 50000}}}, "NOT o_totalprice > 50000")
find("m11_regex", {"meta.prio": {"$regex": "^[12]-.*h$", "$options": "i"}}, "regexp_matches(o_orderpriority, '(?i)^[12]-.*h$')")
find("m12_logic", {"$or": [{"cust": 3}, {"$and": [{"status": "F"}, {"meta.year": 1995}]}], "$nor": [{"price": {"$lt": 1000}}, {"note": "note-1"}]}, f"(o_custkey = 3 OR (o_orderstatus = 'F' AND year(o_orderdate) = 1995)) AND NOT o_totalprice < 1000 AND coalesce({_NOTE} <> 'note-1', true)")
find("m13_expr", {"$expr": {"$gt": ["$price", {"$multiply": ["$cust", 3000]}]}}, "o_totalprice > o_custkey * 3000")
find("m14_comment", {"cust": 5, "$comment": "ignored"}, "o_custkey = 5")
find("m15_path_index", {"lines.0.qty": {"$lt": 3}}, "(SELECT l_quantity FROM lineitem WHERE l_orderkey = o_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_returnflag LIMIT 1) < 3")
find("s15_id_seek", {"_id": {"$gte": 100, "$lt": 130}}, "o_orderkey >= 100 AND o_orderkey < 130")


def pipeline(name: str, stages: list, sql: str | None, keep=None, with_customers: bool = False) -> None:
    """A pipeline, its flat result (``keep`` maps it) and SQL."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        others = {}
        if with_customers:
            c = spark.read.parquet(f"{sf}/customer.parquet")
            others["customers"] = c.select(F.col("c_custkey").alias("_id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"))
        out = aggregate(order_documents(spark, sf), stages, **others)
        return keep(out) if keep else out

    QUERIES[name] = run
    if sql:
        SQL[name] = sql


pipeline("s14_collection_scan", [{"$project": {"cust": 1, "status": 1}}], "SELECT o_orderkey AS _id, o_custkey AS cust, o_orderstatus AS status FROM orders")
pipeline("g01_match", [{"$match": {"cust": {"$lt": 20}}}, {"$match": {"status": "O"}}, {"$project": {"_id": 1}}], "SELECT o_orderkey AS _id FROM orders WHERE o_custkey < 20 AND o_orderstatus = 'O'")
pipeline("g02_project", [{"$project": {"_id": 0, "key": "$_id", "year": "$meta.year", "half": {"$divide": ["$price", 2]}}}], "SELECT o_orderkey AS key, CAST(year(o_orderdate) AS INTEGER) AS year, o_totalprice / 2 AS half FROM orders")
pipeline("g02_project_exclude", [{"$project": {"lines": 0, "flags": 0, "meta": 0, "note": 0}}], "SELECT o_orderkey AS _id, o_custkey AS cust, o_orderstatus AS status, o_totalprice AS price FROM orders")
pipeline("g03_add_fields", [{"$addFields": {"double": {"$multiply": ["$price", 2]}, "price": {"$add": ["$price", 1]}}}, {"$project": {"double": 1, "price": 1}}], "SELECT o_orderkey AS _id, o_totalprice * 2 AS double, o_totalprice + 1 AS price FROM orders")
pipeline("g04_unset", [{"$unset": ["lines", "flags", "meta.year", "note"]}], "SELECT o_orderkey AS _id, o_custkey AS cust, o_orderstatus AS status, o_totalprice AS price, o_orderpriority AS prio FROM orders", lambda d: d.select("_id", "cust", "status", "price", F.col("meta.prio").alias("prio")))
pipeline("g05_group", [{"$group": {"_id": "$meta.prio", "n": {"$count": {}}, "total": {"$sum": "$price"}, "mean": {"$avg": "$price"}, "low": {"$min": "$price"}, "high": {"$max": "$cust"}}}], "SELECT o_orderpriority AS _id, count(*) AS n, sum(o_totalprice) AS total, avg(o_totalprice) AS mean, min(o_totalprice) AS low, max(o_custkey) AS high FROM orders GROUP BY o_orderpriority")
pipeline("g05_group_missing_key", [{"$group": {"_id": "$note", "n": {"$sum": 1}, "text": {"$sum": "$status"}}}], f"SELECT {_NOTE} AS _id, count(*) AS n, CAST(0 AS BIGINT) AS text FROM orders GROUP BY 1", lambda d: d.withColumn("text", F.coalesce("text", F.lit(0).cast("bigint"))))
pipeline("g05_group_compound_key", [{"$group": {"_id": {"s": "$status", "y": "$meta.year"}, "n": {"$count": {}}}}], "SELECT o_orderstatus AS s, CAST(year(o_orderdate) AS INTEGER) AS y, count(*) AS n FROM orders GROUP BY 1, 2", lambda d: d.select("_id.s", "_id.y", "n"))
pipeline("g06_sort_skip_limit", [{"$sort": {"price": -1, "_id": 1}}, {"$skip": 5}, {"$limit": 10}, {"$project": {"price": 1}}], "SELECT o_orderkey AS _id, o_totalprice AS price FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5")
pipeline("g09_unwind", [{"$unwind": {"path": "$lines", "includeArrayIndex": "at"}}, {"$project": {"n": "$lines.n", "qty": "$lines.qty", "at": 1}}], "SELECT l_orderkey AS _id, l_linenumber AS n, l_quantity AS qty, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_returnflag) - 1 AS at FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
pipeline("g09_unwind_preserve", [{"$unwind": {"path": "$flags", "preserveNullAndEmptyArrays": True}}, {"$project": {"flags": 1}}], "SELECT DISTINCT o_orderkey AS _id, l_returnflag AS flags FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey")
pipeline("g10_count", [{"$match": {"price": {"$gt": 200000}}}, {"$count": "n"}], "SELECT count(*) AS n FROM orders WHERE o_totalprice > 200000 HAVING count(*) > 0")
pipeline("g10_count_empty", [{"$match": {"price": {"$lt": 0}}}, {"$count": "n"}], "SELECT count(*) AS n FROM orders WHERE o_totalprice < 0 HAVING count(*) > 0")
pipeline("g11_lookup", [{"$lookup": {"from": "customers", "localField": "cust", "foreignField": "_id", "as": "c"}}, {"$project": {"found": {"$size": "$c"}, "name": {"$arrayElemAt": ["$c.name", 0]}}}], "SELECT o_orderkey AS _id, CAST(CASE WHEN c_custkey IS NULL THEN 0 ELSE 1 END AS BIGINT) AS found, c_name AS name FROM orders LEFT JOIN customer ON o_custkey = c_custkey", with_customers=True)
pipeline("g11_lookup_array", [{"$lookup": {"from": "customers", "localField": "lines.n", "foreignField": "_id", "as": "c"}}, {"$project": {"found": {"$size": "$c"}}}], "SELECT o_orderkey AS _id, count(DISTINCT c_custkey) AS found FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN customer ON c_custkey = l_linenumber GROUP BY o_orderkey", with_customers=True)
pipeline("g12_replace_root", [{"$replaceRoot": {"newRoot": "$meta"}}], "SELECT o_orderpriority AS prio, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders")
pipeline("g12_replace_with", [{"$replaceWith": {"k": "$_id", "p": "$meta.prio"}}], "SELECT o_orderkey AS k, o_orderpriority AS p FROM orders")
pipeline("g16_first_last", [{"$sort": {"_id": 1}}, {"$group": {"_id": "$cust", "first": {"$first": "$_id"}, "last": {"$last": "$note"}}}], f"SELECT o_custkey AS _id, min(o_orderkey) AS first, max_by(coalesce({_NOTE}, '~'), o_orderkey) AS last FROM orders GROUP BY o_custkey", lambda d: d.withColumn("last", F.coalesce("last", F.lit("~"))))
pipeline("g17_push", [{"$sort": {"_id": 1}}, {"$group": {"_id": "$cust", "all": {"$push": "$note"}}}], f"SELECT o_custkey AS _id, coalesce(string_agg({_NOTE}, ',' ORDER BY o_orderkey), '') AS all_notes FROM orders GROUP BY o_custkey", lambda d: d.select("_id", F.array_join("all", ",").alias("all_notes")))
pipeline("g18_add_to_set", [{"$sort": {"_id": 1}}, {"$group": {"_id": "$cust", "set": {"$addToSet": "$status"}}}], "SELECT o_custkey AS _id, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS s FROM orders GROUP BY o_custkey", lambda d: d.select("_id", F.array_join(F.array_sort("set"), ",").alias("s")))


def expression(name: str, e, sql: str, cast: str | None = None) -> None:
    """An expression over the documents and its SQL."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        docs = order_documents(spark, sf)
        column, _ = compile_expression(e, docs.schema)
        return docs.select("_id", (column.cast(cast) if cast else column).alias("v"))

    QUERIES[name] = run
    SQL[name] = f"SELECT o_orderkey AS _id, {sql} AS v FROM orders"


expression("e01_paths_and_literals", {"$concat": ["$meta.prio", {"$literal": "$x"}, "$$ROOT.status"]}, "o_orderpriority || '$x' || o_orderstatus")
expression("e02_arithmetic", {"$subtract": [{"$add": ["$_id", "$cust", 5]}, {"$multiply": ["$cust", 2]}]}, "(o_orderkey + o_custkey + 5) - o_custkey * 2")
expression("e03_divide", {"$divide": ["$_id", 8]}, "o_orderkey / 8")
expression("e03_mod", {"$mod": ["$_id", 7]}, "o_orderkey % 7")
expression("e04_abs", {"$abs": {"$subtract": ["$cust", 50]}}, "abs(o_custkey - 50)")
expression("e05_compare", {"$cmp": ["$cust", 50.5]}, "CAST(sign(o_custkey - 50.5) AS BIGINT)")
expression("e05_compare_null", {"$lt": ["$note", "note-5"]}, f"coalesce({_NOTE} < 'note-5', true)")
expression("e06_logic", {"$or": [{"$and": ["$note", {"$gt": ["$price", 100000]}]}, {"$not": ["$cust"]}]}, "(o_orderkey % 4 <> 0 AND o_totalprice > 100000) OR o_custkey = 0")
expression("e07_cond", {"$cond": [{"$gte": ["$price", 150000]}, "big", {"$ifNull": ["$note", "none"]}]}, f"CASE WHEN o_totalprice >= 150000 THEN 'big' ELSE coalesce({_NOTE}, 'none') END")
expression("e08_concat_null", {"$concat": ["$status", "-", "$note"]}, f"o_orderstatus || '-' || {_NOTE}")
expression("e09_case", {"$toUpper": "$note"}, f"coalesce(upper({_NOTE}), '')")
expression("e10_in", {"$in": ["R", "$flags"]}, _HAS.format("l_returnflag = 'R'"))
expression("e10_size", {"$size": {"$literal": ["a", "b", "c"]}}, "CAST(3 AS BIGINT)")
expression("e10_element_at", {"$arrayElemAt": ["$lines.qty", -1]}, "(SELECT l_quantity FROM lineitem WHERE l_orderkey = o_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_quantity DESC, l_returnflag DESC LIMIT 1)")


def update(name: str, query: dict, spec: dict, columns, sql: str) -> None:
    """An update over all documents; ``columns`` picks what is compared."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        return columns(apply_update(order_documents(spark, sf), query, spec))

    QUERIES[name] = run
    SQL[name] = sql


update("d06_set_inc_mul", {"status": "F"}, {"$set": {"meta.prio": "none", "extra.deep": 1}, "$inc": {"cust": 10}, "$mul": {"price": 2}}, lambda d: d.select("_id", "cust", "price", F.col("meta.prio").alias("prio"), F.col("extra.deep").alias("deep")),
       "SELECT o_orderkey AS _id, o_custkey + CASE WHEN o_orderstatus = 'F' THEN 10 ELSE 0 END AS cust, o_totalprice * CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 1 END AS price, CASE WHEN o_orderstatus = 'F' THEN 'none' ELSE o_orderpriority END AS prio, CASE WHEN o_orderstatus = 'F' THEN CAST(1 AS BIGINT) END AS deep FROM orders")
update("d06_unset_min_max_rename", {"cust": {"$lt": 50}}, {"$unset": {"status": ""}, "$min": {"price": 1000.0}, "$max": {"meta.year": 1995}, "$rename": {"note": "memo"}}, lambda d: d.select("_id", "status", "price", F.col("meta.year").alias("year"), "note", "memo"),
       f"SELECT o_orderkey AS _id, CASE WHEN o_custkey >= 50 THEN o_orderstatus END AS status, CASE WHEN o_custkey < 50 THEN least(o_totalprice, 1000.0) ELSE o_totalprice END AS price, CAST(CASE WHEN o_custkey < 50 THEN greatest(year(o_orderdate), 1995) ELSE year(o_orderdate) END AS INTEGER) AS year, CASE WHEN o_custkey >= 50 THEN {_NOTE} END AS note, CASE WHEN o_custkey < 50 THEN {_NOTE} END AS memo FROM orders")
update("d06_arrays", {"_id": {"$gte": 0}}, {"$push": {"flags": {"$each": ["X", "Y"]}}, "$pull": {"lines": {"qty": {"$gt": 10}}}}, lambda d: d.select("_id", F.array_join("flags", "").alias("flags"), F.size(F.coalesce("lines", F.array().cast(d.schema["lines"].dataType))).alias("n")),
       "SELECT o_orderkey AS _id, coalesce((SELECT string_agg(DISTINCT l_returnflag, '' ORDER BY l_returnflag) FROM lineitem WHERE l_orderkey = o_orderkey), '') || 'XY' AS flags, CAST((SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity <= 10) AS INTEGER) AS n FROM orders")
update("d06_add_to_set_pop", {"status": "O"}, {"$addToSet": {"flags": "N"}, "$pop": {"lines": -1}}, lambda d: d.select("_id", F.array_join(F.array_sort("flags"), "").alias("flags"), F.coalesce(F.size("lines"), F.lit(0)).cast("bigint").alias("n")),
       "SELECT o_orderkey AS _id, (SELECT string_agg(DISTINCT f, '' ORDER BY f) FROM (SELECT l_returnflag AS f FROM lineitem WHERE l_orderkey = o_orderkey UNION ALL SELECT 'N' WHERE o_orderstatus = 'O') q) AS flags, (SELECT greatest(count(*) - CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END, 0) FROM lineitem WHERE l_orderkey = o_orderkey) AS n FROM orders")


def d01_find_options(spark: SparkSession, sf: str) -> DataFrame:
    """find with sort, skip, limit and projection."""
    return aggregate(order_documents(spark, sf), [{"$match": {"status": "O"}}, {"$sort": {"meta.year": -1, "price": 1, "_id": 1}}, {"$skip": 3}, {"$limit": 20}, {"$project": {"price": 1}}])


QUERIES["d01_find_options"] = d01_find_options
SQL["d01_find_options"] = "SELECT o_orderkey AS _id, o_totalprice AS price FROM orders WHERE o_orderstatus = 'O' ORDER BY year(o_orderdate) DESC, o_totalprice, o_orderkey LIMIT 20 OFFSET 3"


def a20_distinct_path(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct values of an array's field."""
    docs = order_documents(spark, sf)
    column, _ = resolve(None, docs.schema, "lines.part")
    return docs.select(F.explode(column).alias("value")).filter("value IS NOT NULL").distinct()


QUERIES["a20_distinct_path"] = a20_distinct_path
SQL["a20_distinct_path"] = "SELECT DISTINCT l_partkey AS value FROM lineitem JOIN orders ON o_orderkey = l_orderkey"


def o10_document_sort(spark: SparkSession, sf: str) -> DataFrame:
    """Sort by an array's least element, missing first."""
    docs = order_documents(spark, sf)
    key = sort_key(*resolve(None, docs.schema, "lines.qty"))
    return docs.orderBy(key.asc(), F.col("_id").asc()).limit(25).select("_id")


QUERIES["o10_document_sort"] = o10_document_sort
SQL["o10_document_sort"] = "SELECT o_orderkey AS _id FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey ORDER BY min(l_quantity) NULLS FIRST, o_orderkey LIMIT 25"
