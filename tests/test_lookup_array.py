"""$lookup by an array where plans that read the same rows are cut into partitions differently."""

import duckdb
import pytest
from pyspark.sql import functions as F

from quern.docs.pipeline import aggregate
from quern.plans import catalog

#: Small pieces, so that AQE joins more of a slim plan's partitions than of a wide one's.
SMALL = {
    "spark.sql.shuffle.partitions": "16", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.files.maxPartitionBytes": "16k",
}
LOOKUP = {"$lookup": {"from": "names", "localField": "tags", "foreignField": "_id", "as": "found"}}


@pytest.fixture
def small(spark):
    before = {k: spark.conf.get(k, None) for k in SMALL}
    for k, v in SMALL.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.fixture
def names(spark):
    return spark.createDataFrame([(k, f"n{k}") for k in range(0, 40, 2)] + [(None, "none")], "_id long, name string")


def expected(tags):
    """Names by brute force; an array without values looks for null."""
    return sorted({f"n{t}" if t is not None else "none" for t in tags or [None] if t is None or t % 2 == 0 and t < 40})


def test_query_equals_sql(small, sf):
    con = duckdb.connect()
    for t in ("orders", "lineitem", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    got = sorted((r._id, r.found) for r in catalog.queries()["g11_lookup_array"](small, sf).collect())
    assert got == sorted(con.execute(catalog.oracle_sql()["g11_lookup_array"]).fetchall())


def test_every_row_has_its_own(small, names):
    rows = small.range(3000).withColumn("t", F.when(F.col("id") % 7 > 0, F.col("id") * 31 % 50)).withColumn("pad", F.sha2(F.col("id").cast("string"), 512))
    docs = rows.groupBy((F.col("id") % 900).alias("_id")).agg(F.collect_list("t").alias("tags"), F.array_join(F.collect_list("pad"), "").alias("text"))
    odd = small.createDataFrame([(-1, [], "a"), (-2, None, "b"), (-3, [None, 4, 4], "c")], "_id long, tags array<long>, text string")
    docs = docs.union(docs.filter("_id < 5")).union(odd)
    out = aggregate(docs, [LOOKUP], names=names).collect()
    assert len(out) == 908 and len({r._id for r in out}) == 903
    for r in out:
        assert sorted(f.name for f in r.found) == expected(r.tags), r._id
        assert r._id < 0 or len(r.text) >= 3 * 128


def test_rows_that_another_evaluation_would_not_choose(small, names):
    """A limit over shuffled rows, and arrays in the order of evaluation."""
    docs = small.range(2000).repartition(16).select(F.col("id").alias("_id"), F.array(F.col("id") % 50, F.col("id") % 3).alias("tags"))
    out = aggregate(docs, [{"$limit": 700}, LOOKUP, {"$addFields": {"n": {"$size": "$found"}}}], names=names).collect()
    assert len(out) == 700 and all(sorted(f.name for f in r.found) == expected(r.tags) and r.n == len(r.found) for r in out)


@pytest.mark.parametrize("field", [None, {"z": None}, {}])
def test_fields_without_type_stay(small, names, field):
    docs = small.createDataFrame([(1, [2, 3]), (2, [])], "_id long, tags array<long>")
    out = aggregate(docs, [{"$addFields": {"x": field}}, LOOKUP], names=names)
    assert {r._id: (r.x if r.x is None else r.x.asDict(), [f.name for f in r.found]) for r in out.collect()} == {1: (field, ["n2"]), 2: (field, ["none"])}
