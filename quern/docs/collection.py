"""Collections of documents: a table directory with versions, and the calls on it."""

from __future__ import annotations

import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.docs.bson import sort_key
from quern.docs.filters import _is_operators, compile_filter
from quern.docs.paths import resolve
from quern.docs.pipeline import Pipeline
from quern.docs.updates import apply_update
from quern.tables.versions import VersionedTable


class Collection:
    """Documents with a field _id, kept as versions of a Parquet table."""

    def __init__(self, spark: SparkSession, path: str, others: dict[str, Collection] | None = None):
        self.spark, self.table, self.others = spark, VersionedTable(spark, path), {} if others is None else others
        self.indexes: dict[str, tuple[list[str], bool]] = {}

    # ---- reading ----

    def documents(self) -> DataFrame:
        """All documents."""
        return self.table.read()

    def find(self, query: dict | None = None, projection: dict | None = None, sort: dict | None = None, skip: int = 0, limit: int = 0) -> DataFrame:
        """Documents that match, as a lazy DataFrame."""
        docs = self.documents()
        docs = docs.filter(compile_filter(query, docs.schema)) if query else docs
        if sort:
            docs = docs.orderBy(*_order(docs, sort))
        docs = docs.offset(skip) if skip else docs
        docs = docs.limit(limit) if limit else docs
        if projection:
            work = Pipeline(docs)
            work.stage_project(projection)
            docs = work.docs
        return docs

    def find_one(self, query: dict | None = None, **options: Any):
        """One matching document or None."""
        return self.find(query, limit=1, **options).first()

    def count_documents(self, query: dict | None = None) -> int:
        return self.find(query).count()

    def distinct(self, path: str, query: dict | None = None) -> DataFrame:
        """Distinct values at a path, array elements each, in order."""
        docs = self.find(query)
        found = resolve(None, docs.schema, path)
        if found is None:
            return docs.limit(0).select(F.lit(None).alias("value"))
        column, kind = found
        if hasattr(kind, "elementType"):
            docs, kind = docs.select(F.explode(column).alias("value")), kind.elementType
        else:
            docs = docs.select(column.alias("value"))
        return docs.filter(F.col("value").isNotNull()).distinct().orderBy(sort_key(F.col("value"), kind))

    def aggregate(self, stages: list[dict]) -> DataFrame:
        """Run a pipeline; $lookup sees the other collections."""
        return Pipeline(self.documents(), {k: c.documents() for k, c in self.others.items()}).run(stages)

    def explain(self, query: dict | None = None) -> str:
        """The plan of a find."""
        return self.find(query)._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))

    # ---- writing ----

    def insert(self, docs: DataFrame) -> int:
        """Add documents, all or none; _id is made where the frame has none."""
        if "_id" not in docs.columns:
            docs = docs.select(F.expr("uuid()").alias("_id"), "*")
        n = docs.count()
        made = docs if not self.table.exists() else self.documents().unionByName(docs, allowMissingColumns=True)
        self._commit(made)
        return n

    def insert_many(self, documents: list[dict]) -> int:
        """Add documents given as dicts."""
        rows = [{"_id": uuid.uuid4().hex[:24], **d} for d in documents]
        import json

        return self.insert(self.spark.read.json(self.spark.sparkContext.parallelize([json.dumps(r) for r in rows], 1)))

    def update_many(self, query: dict, update: dict, upsert: bool = False) -> int:
        """Update all matching documents; the number that matched."""
        docs = self.documents()
        n = docs.filter(compile_filter(query, docs.schema)).count()
        if not n and upsert:
            return self._upsert(query, update)
        self._commit(apply_update(docs, query, update))
        return n

    def update_one(self, query: dict, update: dict, sort: dict | None = None, upsert: bool = False) -> int:
        """Update the first matching document by ``sort``, else by _id."""
        docs = self.documents()
        first = self._first(query, sort)
        if first is None:
            return self._upsert(query, update) if upsert else 0
        self._commit(apply_update(docs, F.col("_id").eqNullSafe(F.lit(first["_id"])), update))
        return 1

    def replace_one(self, query: dict, document: dict, upsert: bool = False) -> int:
        """Put a document in the place of the first that matches; its _id stays."""
        first = self._first(query, None)
        if first is None:
            return self.insert_many([{**_seed(query), **document}]) if upsert else 0
        import json

        rest = self.documents().filter(~F.col("_id").eqNullSafe(F.lit(first["_id"])))
        one = self.spark.read.json(self.spark.sparkContext.parallelize([json.dumps({"_id": first["_id"], **document})], 1))
        self._commit(rest.unionByName(one, allowMissingColumns=True))
        return 1

    def delete_many(self, query: dict) -> int:
        """Remove all matching documents."""
        docs = self.documents()
        hit = compile_filter(query, docs.schema)
        n = docs.filter(hit).count()
        self._commit(docs.filter(~hit))
        return n

    def delete_one(self, query: dict, sort: dict | None = None) -> int:
        """Remove the first matching document."""
        first = self._first(query, sort)
        if first is None:
            return 0
        self._commit(self.documents().filter(~F.col("_id").eqNullSafe(F.lit(first["_id"]))))
        return 1

    def find_one_and_update(self, query: dict, update: dict, sort: dict | None = None, upsert: bool = False, after: bool = False):
        """Update the first match and return it, as it was or as it is then."""
        first = self._first(query, sort)
        if first is None:
            if upsert:
                self._upsert(query, update)
                return self.find_one(_seed(query)) if after else None
            return None
        self.update_one({"_id": first["_id"]}, update)
        return self.find_one({"_id": first["_id"]}) if after else first

    def find_one_and_delete(self, query: dict, sort: dict | None = None):
        """Remove the first match and return it."""
        first = self._first(query, sort)
        if first is not None:
            self.delete_one({"_id": first["_id"]})
        return first

    def find_one_and_replace(self, query: dict, document: dict, after: bool = False):
        """Replace the first match and return it, as it was or as it is then."""
        first = self._first(query, None)
        if first is not None:
            self.replace_one({"_id": first["_id"]}, document)
        return first if first is None or not after else self.find_one({"_id": first["_id"]})

    def create_index(self, keys: list[str], unique: bool = False) -> str:
        """Note an index; a unique one is checked now and at every write."""
        name = "_".join(keys)
        self.indexes[name] = (keys, unique)
        if self.table.exists():
            self._check(self.documents())
        return name

    def drop_index(self, name: str) -> None:
        del self.indexes[name]

    def _first(self, query: dict, sort: dict | None):
        return self.find(query, sort=sort or {"_id": 1}, limit=1).first()

    def _upsert(self, query: dict, update: dict) -> int:
        import json

        seed = {"_id": uuid.uuid4().hex[:24], **_seed(query)}
        one = self.spark.read.json(self.spark.sparkContext.parallelize([json.dumps(seed)], 1))
        self.insert(apply_update(one, F.lit(True), update, inserting=True))
        return 0

    def _check(self, docs: DataFrame) -> None:
        for name, (keys, unique) in {"_id": (["_id"], True), **self.indexes}.items():
            if unique and not docs.groupBy(*keys).count().filter("count > 1").isEmpty():
                raise ValueError(f"duplicate key in {name}")

    def _commit(self, docs: DataFrame) -> None:
        self._check(docs)
        self.table.commit(docs)


def _seed(query: dict) -> dict:
    """The document that a filter's equalities describe."""
    return {k: v.get("$eq") if _is_operators(v) else v for k, v in query.items() if not k.startswith("$") and "." not in k and (not _is_operators(v) or "$eq" in v)}


def _order(docs: DataFrame, sort: dict) -> list:
    keys = []
    for path, way in sort.items():
        if found := resolve(None, docs.schema, path):
            key = sort_key(*found, descending=way < 0)
            keys.append(key.desc() if way < 0 else key.asc())
    return keys
