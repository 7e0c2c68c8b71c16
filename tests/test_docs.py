import datetime as dt

import pytest
from pyspark.sql import functions as F

from quern.docs.bson import compare, parse_extended, print_extended
from quern.docs.collection import Collection
from quern.docs.filters import compile_filter
from quern.docs.pipeline import aggregate
from quern.docs.updates import apply_update
from quern.storage import new_dir


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(
        [(1, "a", 2.5, ["x", "y"], [(1, 5), (2, 7)]), (2, "b", None, [], []), (3, None, 4.0, None, [(1, 9)]), (4, "a", 1.0, ["y"], None)],
        "_id long, sku string, price double, tags array<string>, lines array<struct<n:int,q:int>>",
    )


def ids(frame):
    return sorted(r._id for r in frame.collect())


@pytest.mark.parametrize(
    ("query", "expected"),
    [
        ({"sku": "a"}, [1, 4]), ({"sku": None}, [3]), ({"sku": {"$ne": "a"}}, [2, 3]), ({"tags": "y"}, [1, 4]), ({"tags": ["x", "y"]}, [1]), ({"tags": {"$size": 0}}, [2]),
        ({"price": {"$gt": "a"}}, []), ({"price": {"$gte": None}}, [2]), ({"nothing": None}, [1, 2, 3, 4]), ({"nothing": {"$exists": True}}, []), ({"lines.q": {"$gt": 8}}, [3]),
        ({"lines": {"$elemMatch": {"n": 1, "q": {"$lt": 6}}}}, [1]), ({"tags": {"$all": []}}, []), ({"tags": {"$not": {"$in": ["x"]}}}, [2, 3, 4]), ({"$nor": [{"sku": "a"}, {"price": 4}]}, [2]),
        ({"sku": {"$regex": "^A", "$options": "i"}}, [1, 4]), ({"price": 4}, [3]), ({"_id": {"$in": [1, 2.0, 2.5]}}, [1, 2]), ({"lines.1.q": 7}, [1]), ({"lines": {"n": 1, "q": 9}}, [3]),
    ],
)
def test_filters(items, query, expected):
    assert ids(items.filter(compile_filter(query, items.schema))) == expected


def test_filter_errors(items):
    for bad in ({"$foo": 1}, {"a": {"$bar": 1}}, {"$or": []}, {"sku": {"$regex": "a", "$options": "q"}}):
        with pytest.raises(ValueError):
            items.filter(compile_filter({"sku": bad["a"]} if "a" in bad else bad, items.schema))


def test_pipeline_stages(items):
    out = aggregate(items, [{"$unwind": "$tags"}, {"$group": {"_id": "$tags", "n": {"$sum": 1}, "skus": {"$push": "$sku"}}}, {"$sort": {"_id": -1}}]).collect()
    assert [(r._id, r.n, r.skus) for r in out] == [("y", 2, ["a", "a"]), ("x", 1, ["a"])]
    kept = aggregate(items, [{"$unwind": {"path": "$lines", "preserveNullAndEmptyArrays": True, "includeArrayIndex": "i"}}]).collect()
    assert sorted((r._id, r.i) for r in kept if r.i is not None) == [(1, 0), (1, 1), (3, 0)] and len(kept) == 5
    assert aggregate(items, [{"$match": {"_id": 99}}, {"$count": "n"}]).collect() == []
    with pytest.raises(ValueError):
        aggregate(items, [{"$project": {"sku": 1, "price": 0}}])


def test_updates(items):
    made = {r._id: r for r in apply_update(items, {"sku": "a"}, {"$inc": {"price": 1}, "$push": {"tags": "z"}, "$set": {"new.deep": "v"}}).collect()}
    assert made[1].price == 3.5 and made[1].tags == ["x", "y", "z"] and made[1].new.deep == "v" and made[2].new is None and made[3].price == 4.0
    for bad in ({"$set": {"_id": 1}}, {"$set": {"a": 1}, "$inc": {"a.b": 1}}, {"$foo": {"a": 1}}):
        with pytest.raises(ValueError):
            apply_update(items, {}, bad)


def test_collection(spark, items):
    c = Collection(spark, new_dir(spark, "collection"))
    assert c.insert(items) == 4 and c.count_documents({"sku": "a"}) == 2
    with pytest.raises(ValueError):
        c.insert(items.limit(1))
    assert c.count_documents() == 4
    assert c.update_one({"sku": "a"}, {"$set": {"price": 9.0}}, sort={"_id": -1}) == 1 and c.find_one({"_id": 4}).price == 9.0
    assert c.find_one_and_delete({"sku": "b"})._id == 2 and c.count_documents() == 3
    assert [r.value for r in c.distinct("tags").collect()] == ["x", "y"]
    c.create_index(["price"], unique=True)
    with pytest.raises(ValueError):
        c.update_many({}, {"$set": {"price": 1.0}})
    assert c.delete_many({"price": {"$gt": 3}}) == 2 and [r._id for r in c.find(sort={"_id": 1}).collect()] == [1]


def test_order_and_extended_json():
    values = [None, float("nan"), -1, 2**53, 2**53 + 1, float(2**54), "a", "b", {"a": 1}, {"a": 2}, [1], [1, 0], False, True, dt.datetime(2020, 1, 1)]
    for i, a in enumerate(values):
        for j, b in enumerate(values):
            assert compare(a, b) == (i > j) - (i < j), (a, b)
    doc = parse_extended('{"a": {"$numberLong": "5"}, "d": {"$date": 1000}, "o": {"$oid": "00ff"}, "n": null}')
    assert doc == {"a": 5, "d": dt.datetime(1970, 1, 1, 0, 0, 1), "o": "00ff", "n": None}
    assert parse_extended(print_extended(doc)) == doc
