import pytest
from pyspark.sql import functions as F

from quern.sources.csv import from_text, infer_schema
from quern.storage import new_dir
from quern.tables.database import ColumnDef, ConstraintError, Database, ForeignKey, TableDef
from quern.tables.partitions import ListPartitions, PartitionedTable, RangePartitions
from quern.tables.types import capacity, spark_type
from quern.tables.versions import Conflict, VersionedTable


@pytest.fixture()
def db(spark):
    db = Database(spark, new_dir(spark, "db"))
    db.create_table(TableDef("city", (ColumnDef("id", "INT"), ColumnDef("name", "VARCHAR(5)", False)), primary_key=("id",)))
    db.create_table(TableDef("person", (ColumnDef("id", "INT"), ColumnDef("city", "INT"), ColumnDef("age", "DOUBLE", True, 1.5)), primary_key=("id",), foreign_keys=(ForeignKey(("city",), "city", ("id",), "fk"),), checks=("age > 0",)))
    db.insert("city", [(1, "a"), (2, "b")])
    return db


def test_constraints(db):
    assert db.insert("person", [(1, 1), (2, None)], ["id", "city"]) == 2
    assert {r.age for r in db.table("person").collect()} == {1.5}
    for rows in ([(3, 9, 1.0)], [(1, 1, 1.0)], [(None, 1, 1.0)], [(4, 1, -1.0)]):
        with pytest.raises(ConstraintError):
            db.insert("person", rows)
    with pytest.raises(ConstraintError):
        db.insert("city", [(3, "toolong")])
    with pytest.raises(ConstraintError):
        db.update("person", {"id": 1})
    with pytest.raises(ConstraintError):
        db.drop_table("city")
    assert db.table("person").count() == 2


def test_dml_and_transactions(db, spark):
    db.insert("person", [(i, 1 + i % 2, float(i + 1)) for i in range(6)])
    assert db.update("person", {"age": F.col("age") * 2, "city": None}, "id >= 4") == 2
    assert db.delete("person", "city = 1") == 2
    assert db.query("SELECT count(*) AS n, sum(age) AS s FROM person WHERE age > ?", 2.5).first().asDict() == {"n": 3, "s": 26.0}
    db.begin()
    db.truncate("person")
    assert db.table("person").isEmpty()
    db.rollback()
    assert db.table("person").count() == 4
    db.begin()
    db.delete("person", "id = 1")
    other = Database(spark, db.path, db.defs)
    other.delete("person", "id = 3")
    with pytest.raises(Conflict):
        db.commit()
    assert db.table("person").count() == 3


def test_alter_and_reports(db):
    db.add_column("city", ColumnDef("pop", "BIGINT", False, 0))
    db.rename_column("city", "name", "label")
    assert [r.asDict() for r in db.table("city").orderBy("id").collect()] == [{"id": 1, "label": "a", "pop": 0}, {"id": 2, "label": "b", "pop": 0}]
    assert {r.name for r in db.describe("city").collect()} == {"id", "label", "pop"} and [r.name for r in db.show_tables().collect()] == ["city", "person"]
    stats = {r.column: r for r in db.analyze("city").collect()}
    assert stats["label"].distinct_values == 2 and stats["id"].greatest == "2"
    db.create_index("by_label", "city", ["label"], unique=True)
    with pytest.raises(ConstraintError):
        db.insert("city", [(5, "a", 1)])
    db.create_schema("other")
    db.use_schema("other")
    assert db.show_tables().count() == 0 and db.show_schemas().count() == 2


def test_versions(spark):
    table = VersionedTable(spark, new_dir(spark, "versions"))
    assert not table.exists()
    table.commit(spark.range(3))
    old = table.read()
    table.commit(spark.range(5))
    assert old.count() == 3 and table.read().count() == 5 and table.read(1).count() == 3
    with pytest.raises(Conflict):
        table.commit(spark.range(1), expected=1)


def test_partitions(spark):
    rows = spark.createDataFrame([(None, "n"), (1, "a"), (10, "b"), (99, "c")], "k int, v string")
    table = PartitionedTable(spark, new_dir(spark, "ranges"), RangePartitions("k", [("low", 10), ("mid", 50), ("high", None)])).write(rows)
    assert {r.partition: r.rows for r in table.partitions().collect()} == {"low": 2, "mid": 1, "high": 1}
    assert table.scheme.meeting(10, 49) == ["mid"] and table.scheme.meeting(None, 5) == ["low"] and table.scheme.meeting(50) == ["high"]
    plan = table.between(10, 20)._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "__part" in plan and [r.v for r in table.between(10, 20).collect()] == ["b"]
    lists = ListPartitions("v", {"ab": ["a", "b"]})
    with pytest.raises(Exception, match="fits no partition"):
        PartitionedTable(spark, new_dir(spark, "lists"), lists).write(rows)


def test_csv(spark):
    assert infer_schema(["a,b,c", "1,2.5,true", "2,3,false"]).simpleString() == "struct<a:bigint,b:double,c:boolean>"
    good, bad = from_text(spark, 'k,v\n1,"x, ""y"""\n2,\nz,3\n4,5,6')
    assert sorted((r.k, r.v) for r in good.collect()) == [("1", 'x, "y"'), ("2", None), ("z", "3")] and bad.count() == 1
    good, bad = from_text(spark, "k,v\n" + "\n".join(f"{i},1" for i in range(120)) + "\nbad,1\n,2")
    assert good.count() == 121 and bad.count() == 1 and good.schema["k"].dataType.simpleString() == "bigint"


def test_types():
    assert spark_type("uint64").simpleString() == "bigint" and spark_type("DOUBLE PRECISION").simpleString() == "double" and spark_type("date").simpleString() == "timestamp_ntz"
    assert capacity("varchar(7)") == 7 and capacity("CHAR") == 32 and capacity("TEXT") is None
    with pytest.raises(ValueError):
        spark_type("blobby")


def test_csv_files_keep_rows_like_the_header_and_line_breaks(spark, tmp_path):
    from pyspark.sql import types as T

    from quern.sources.csv import copy_into

    path = tmp_path / "rows.csv"
    path.write_text('a,b\n1,x\na,b\n2,"two\nlines"\n3,y\n4,p,q\n')
    good, bad = copy_into(spark, str(path), T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.StringType())]))
    assert sorted((r.a, r.b) for r in good.collect()) == [("1", "x"), ("2", "two\nlines"), ("3", "y"), ("a", "b")] and bad.count() == 1
