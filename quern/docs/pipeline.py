"""Aggregation pipelines over documents as DataFrame plans.

Order counts only where a pipeline has sorted or asks for it ($first, $last, $push): the row order of
the input is then a hidden ordinal column, carried along, never a sort of the whole.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.docs.bson import NUMBERS, sort_key
from quern.docs.expressions import compile_expression
from quern.docs.filters import compile_filter
from quern.docs.paths import resolve
from quern.storage import settle

ORDINAL = "__ordinal"


class Pipeline:
    """Stages applied to a DataFrame of documents."""

    def __init__(self, docs: DataFrame, collections: dict[str, DataFrame] | None = None):
        self.docs, self.collections, self.sorted = docs, collections or {}, False

    @property
    def schema(self) -> T.StructType:
        return T.StructType([f for f in self.docs.schema.fields if not f.name.startswith("__")])

    def run(self, stages: list[dict[str, Any]]) -> DataFrame:
        """The documents after all stages."""
        if any("$group" in s and any(op in str(s["$group"]) for op in ("$first", "$last", "$push", "$addToSet")) for s in stages) and ORDINAL not in self.docs.columns:
            self.docs = self.docs.withColumn(ORDINAL, F.struct(F.monotonically_increasing_id().alias("a")))
        for stage in stages:
            if len(stage) != 1:
                raise ValueError("a stage has one operator")
            (op, arg), = stage.items()
            method = getattr(self, "stage_" + op.lstrip("$"), None)
            if not op.startswith("$") or method is None:
                raise ValueError(f"unknown stage {op}")
            method(arg)
        return self.docs.drop(ORDINAL)

    def _expression(self, e: Any) -> tuple[Column, T.DataType]:
        return compile_expression(e, self.schema)

    def _hidden(self) -> list[str]:
        return [c for c in self.docs.columns if c.startswith("__")]

    def stage_match(self, query: dict) -> None:
        self.docs = self.docs.filter(compile_filter(query, self.schema))

    def stage_project(self, spec: dict) -> None:
        names = {k: v for k, v in spec.items() if k != "_id"}
        excluding = [k for k, v in names.items() if v in (0, False) and not isinstance(v, str)]
        if excluding and len(excluding) != len(names):
            raise ValueError("a projection includes or excludes, not both")
        drop_id = spec.get("_id", 1) in (0, False)
        if excluding or (not names and drop_id):
            self.stage_unset([*excluding, *(["_id"] if drop_id else [])])
            return
        out: dict[str, Any] = {}
        if not drop_id and "_id" in self.docs.columns and "_id" not in names:
            out["_id"] = F.col("_id") if spec.get("_id", 1) in (1, True) else self._expression(spec["_id"])[0]
        tree: dict[str, Any] = {}
        for path, v in names.items():
            value = resolve(None, self.schema, path) if v in (1, True) and not isinstance(v, (str, float)) else self._expression(v)
            if value is None:
                continue
            at = tree
            *parents, leaf = path.split(".")
            for p in parents:
                at = at.setdefault(p, {})
            at[leaf] = value[0]

        def built(node: Any) -> Column:
            return F.struct(*[built(v).alias(k) for k, v in node.items()]) if isinstance(node, dict) else node

        out |= {k: built(v) for k, v in tree.items()}
        self.docs = self.docs.select(*[c.alias(k) for k, c in out.items()], *self._hidden())

    def stage_addFields(self, spec: dict) -> None:
        made = {}
        for path, e in spec.items():
            column, _ = self._expression(e)
            top, *rest = path.split(".")
            if not rest:
                made[top] = column
                continue
            base = made.get(top, F.col(f"`{top}`") if top in self.docs.columns else None)
            fresh = column
            for name in reversed(rest):
                fresh = F.struct(fresh.alias(name))
            made[top] = fresh if base is None else F.when(base.isNotNull(), base.withField(".".join(rest), column))
        self.docs = self.docs.withColumns(made)

    stage_set = stage_addFields

    def stage_unset(self, names: str | list[str]) -> None:
        for path in [names] if isinstance(names, str) else names:
            top, _, rest = path.partition(".")
            if not rest:
                self.docs = self.docs.drop(top)
            elif top in self.docs.columns:
                self.docs = self.docs.withColumn(top, F.col(top).dropFields(rest))

    def stage_group(self, spec: dict) -> None:
        key, kind = self._expression(spec["_id"])
        aggregates, after = [], []
        for name, acc in spec.items():
            if name == "_id":
                continue
            (op, e), = acc.items()
            value, t = (None, None) if op == "$count" else self._expression(e)
            made, fix = _accumulator(op, value, t)
            aggregates.append(made.alias(name))
            after.append((name, fix))
        if isinstance(kind, T.NullType):
            key = F.lit(None).cast("string")
        keyed = self.docs.withColumn("__key", key)
        grouped = keyed.groupBy("__key").agg(*(aggregates or [F.count(F.lit(1)).alias("__n")]))
        self.docs = grouped.select(F.col("__key").alias("_id"), *[fix(F.col(n)).alias(n) for n, fix in after])

    def stage_sort(self, spec: dict) -> None:
        keys = []
        for path, way in spec.items():
            found = resolve(None, self.schema, path)
            if found:
                key = sort_key(*found, descending=way < 0)
                keys.append(key.desc() if way < 0 else key.asc())
        self.docs, self.sorted = self.docs.orderBy(*keys), True
        if ORDINAL in self.docs.columns:
            self.docs = self.docs.withColumn(ORDINAL, F.struct(F.monotonically_increasing_id().alias("a")))

    def stage_skip(self, n: int) -> None:
        self.docs = self.docs.offset(n)

    def stage_limit(self, n: int) -> None:
        if n <= 0:
            raise ValueError("$limit takes a positive number")
        self.docs = self.docs.limit(n)

    def stage_unwind(self, spec: str | dict) -> None:
        spec = {"path": spec} if isinstance(spec, str) else spec
        path = spec["path"].removeprefix("$")
        keep, index = spec.get("preserveNullAndEmptyArrays", False), spec.get("includeArrayIndex")
        found = resolve(None, self.schema, path)
        top, *rest = path.split(".")
        if found is None:
            self.docs = self.docs if keep else self.docs.filter(F.lit(False))
            return
        column, kind = found
        if not isinstance(kind, T.ArrayType):
            self.docs = self.docs if keep else self.docs.filter(column.isNotNull())
            if index:
                self.docs = self.docs.withColumn(index, F.lit(None).cast("bigint"))
            return
        explode = F.posexplode_outer if keep else F.posexplode
        self.docs = self.docs.select("*", explode(column).alias("__at", "__value"))
        value = F.col(top).withField(".".join(rest), F.col("__value")) if rest else F.col("__value")
        self.docs = self.docs.withColumn(top, value)
        if ORDINAL in self.docs.columns:
            self.docs = self.docs.withColumn(ORDINAL, F.struct(F.col(ORDINAL).alias("a"), F.col("__at").alias("b")))
        if index:
            self.docs = self.docs.withColumn(index, F.col("__at").cast("bigint"))
        self.docs = self.docs.drop("__at", "__value")

    def stage_count(self, name: str) -> None:
        self.docs = self.docs.agg(F.count(F.lit(1)).alias(name)).filter(F.col(name) > 0)

    def stage_lookup(self, spec: dict) -> None:
        other = self.collections[spec["from"]]
        other = other.select([c for c in other.columns if not c.startswith("__")])
        local, foreign = resolve(None, self.schema, spec["localField"]), resolve(None, other.schema, spec["foreignField"])
        right = other.select(F.struct(*other.columns).alias("__doc"), (foreign[0] if foreign else F.lit(None).cast("string")).alias("__f"))
        if foreign and isinstance(foreign[1], T.ArrayType):
            right = right.withColumn("__f", F.explode_outer(F.array_distinct("__f")))
        matches = right.groupBy("__f").agg(F.collect_list("__doc").alias("__docs"))
        left = self.docs.withColumn("__l", local[0] if local else F.lit(None).cast("string"))
        as_name = spec["as"]
        if local and isinstance(local[1], T.ArrayType):
            # Rows are joined to what was found by their values: numbers given to rows differ where a plan is evaluated twice.
            left = settle(left.withColumn("__l", F.array_sort(F.array_distinct("__l"))), "lookup")
            each = left.select(F.col("__l").alias("__values")).distinct().select("__values", F.explode_outer("__values").alias("__value"))
            found = each.join(matches, F.col("__value").eqNullSafe(F.col("__f"))).select("__values", F.explode("__docs").alias("__doc"))
            found = found.groupBy("__values").agg(F.collect_set("__doc").alias("__docs"))
            joined = left.join(found, F.col("__l").eqNullSafe(F.col("__values")), "left").drop("__values")
        else:
            joined = left.join(matches, F.col("__l").eqNullSafe(F.col("__f")), "left").drop("__f")
        self.docs = joined.withColumn(as_name, F.coalesce("__docs", F.array())).drop("__l", "__docs")

    def stage_replaceRoot(self, spec: dict) -> None:
        self.stage_replaceWith(spec["newRoot"])

    def stage_replaceWith(self, e: Any) -> None:
        column, kind = self._expression(e)
        if not isinstance(kind, T.StructType):
            raise TypeError("the new root must be a document")
        made = self.docs.select(F.when(column.isNull(), F.raise_error(F.lit("the new root must be a document"))).otherwise(column).alias("__root"), *self._hidden())
        self.docs = made.select("__root.*", *self._hidden())


def _accumulator(op: str, value: Column | None, kind: T.DataType | None):
    """The aggregate and what is done to its result."""
    same = lambda c: c
    if op == "$count":
        return F.count(F.lit(1)), same
    if op in ("$sum", "$avg"):
        if not isinstance(kind, NUMBERS):
            return (F.sum(F.lit(0).cast("bigint")) if op == "$sum" else F.avg(F.lit(None).cast("double"))), same
        real = isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType))
        value = value.cast("double") if real else value.cast("bigint")
        return (F.sum(value), lambda c: F.coalesce(c, F.lit(0).cast("double" if real else "bigint"))) if op == "$sum" else (F.avg(value), same)
    if op in ("$min", "$max"):
        by = F.when(value.isNotNull(), sort_key(value, kind))
        return (F.min_by if op == "$min" else F.max_by)(value, by), same
    ordinal = F.col(ORDINAL)
    if op == "$first":
        return F.min_by(F.struct(value.alias("v")), ordinal), lambda c: c["v"]
    if op == "$last":
        return F.max_by(F.struct(value.alias("v")), ordinal), lambda c: c["v"]
    if op in ("$push", "$addToSet"):
        kept = F.collect_list(F.when(value.isNotNull(), F.struct(ordinal.alias("o"), value.alias("v"))))
        in_order = lambda c: F.transform(F.array_sort(c), lambda x: x["v"])
        return kept, in_order if op == "$push" else (lambda c: F.array_distinct(in_order(c)))
    raise ValueError(f"unknown accumulator {op}")


def aggregate(docs: DataFrame, stages: list[dict[str, Any]], **collections: DataFrame) -> DataFrame:
    """Run a pipeline; other collections are for $lookup."""
    return Pipeline(docs, collections).run(stages)
