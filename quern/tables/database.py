"""Tables with declared columns, constraints and versions: DDL, DML, transactions, reports."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern import dialect
from quern.storage import open_fs
from quern.tables.types import capacity, spark_type
from quern.tables.versions import Conflict, VersionedTable


class ConstraintError(ValueError):
    """Rows that a table refuses."""


@dataclass(frozen=True)
class ColumnDef:
    """A declared column."""

    name: str
    declared: str
    nullable: bool = True
    default: Any = None

    @property
    def type(self) -> T.DataType:
        return spark_type(self.declared)


@dataclass(frozen=True)
class ForeignKey:
    columns: tuple[str, ...]
    table: str
    references: tuple[str, ...]
    name: str = ""


@dataclass(frozen=True)
class TableDef:
    """What CREATE TABLE declares."""

    name: str
    columns: tuple[ColumnDef, ...]
    primary_key: tuple[str, ...] = ()
    unique: tuple[tuple[str, ...], ...] = ()
    foreign_keys: tuple[ForeignKey, ...] = ()
    checks: tuple[str, ...] = ()
    indexes: tuple[tuple[str, tuple[str, ...], bool], ...] = ()
    partition_column: str | None = None

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, c.type, True) for c in self.columns])


class Catalog(dict):
    """Definitions by name; a change is saved at once."""

    def __init__(self, known: dict[str, TableDef], saved: Callable[[], None]):
        super().__init__(known)
        self._saved = saved

    def __setitem__(self, key: str, value: TableDef) -> None:
        super().__setitem__(key, value)
        self._saved()

    def __delitem__(self, key: str) -> None:
        super().__delitem__(key)
        self._saved()


def _read_definition(raw: dict) -> TableDef:
    return TableDef(
        raw["name"], tuple(ColumnDef(**c) for c in raw["columns"]), tuple(raw["primary_key"]), tuple(map(tuple, raw["unique"])),
        tuple(ForeignKey(tuple(f["columns"]), f["table"], tuple(f["references"]), f["name"]) for f in raw["foreign_keys"]), tuple(raw["checks"]),
        tuple((n, tuple(c), u) for n, c, u in raw["indexes"]), raw["partition_column"],
    )


@dataclass
class Database:
    """Schemas of tables under one folder. Statements outside a transaction commit at once.

    Definitions and schemas are kept in a file of the folder, so a database opened again has them.
    """

    spark: SparkSession
    path: str
    defs: dict[str, TableDef] = field(default_factory=dict)
    schemas: set[str] = field(default_factory=lambda: {"main"})
    current: str = "main"
    staged: dict[str, DataFrame] | None = None
    bases: dict[str, int] = field(default_factory=dict)
    before: tuple[dict[str, TableDef], set[str]] | None = None

    def __post_init__(self):
        known = self.defs
        if not known:
            fs, path = open_fs(f"{self.path}/_catalog.json")
            if fs.get_file_info(path).is_file:
                with fs.open_input_file(path) as f:
                    raw = json.loads(f.read())
                known, self.schemas = {k: _read_definition(d) for k, d in raw["tables"].items()}, set(raw["schemas"])
        self.defs = Catalog(known, self._save)

    def _save(self) -> None:
        """Write the catalog beside the old one, then put it in its place; a transaction's commit does so once."""
        if self.staged is not None:
            return
        raw = {"schemas": sorted(self.schemas), "tables": {k: asdict(d) for k, d in self.defs.items()}}
        fs, path = open_fs(f"{self.path}/_catalog.json")
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        with fs.open_output_stream(f"{path}.new") as f:
            f.write(json.dumps(raw, default=str).encode())
        fs.move(f"{path}.new", path)

    # ---- DDL ----

    def create_schema(self, name: str, if_not_exists: bool = False) -> None:
        if name.lower() in self.schemas and not if_not_exists:
            raise ValueError(f"schema {name} exists")
        self.schemas.add(name.lower())
        self._save()

    def use_schema(self, name: str) -> None:
        if name.lower() not in self.schemas:
            raise ValueError(f"no schema {name}")
        self.current = name.lower()

    def _key(self, name: str) -> str:
        return name.lower() if "." in name else f"{self.current}.{name.lower()}"

    def create_table(self, definition: TableDef, if_not_exists: bool = False) -> None:
        """Declare a table; it is empty."""
        key = self._key(definition.name)
        if key in self.defs:
            if if_not_exists:
                return
            raise ValueError(f"table {key} exists")
        names = [c.name.lower() for c in definition.columns]
        if len(set(names)) != len(names):
            raise ValueError("a column is declared twice")
        for unique in (definition.primary_key, *definition.unique):
            if unique and definition.partition_column and definition.partition_column not in unique:
                raise ValueError("a unique key must hold the partition column")
        self._store(key).commit(self.spark.createDataFrame([], definition.schema))  # raises before anything is recorded
        self.defs[key] = definition

    def drop_table(self, *names: str, if_exists: bool = False) -> None:
        for name in names:
            key = self._key(name)
            if key not in self.defs:
                if if_exists:
                    continue
                raise ValueError(f"no table {key}")
            users = [d.name for k, d in self.defs.items() if k != key and any(self._key(f.table) == key for f in d.foreign_keys)]
            if users:
                raise ConstraintError(f"{', '.join(users)} refer to {key}")
            self._store(key).drop()
            del self.defs[key]

    def rename_table(self, name: str, new: str) -> None:
        rows, d = self.table(name), self.defs[self._key(name)]
        self.create_table(replace(d, name=new))
        self._write(self._key(new), rows)
        self.drop_table(name)

    def add_column(self, name: str, column: ColumnDef) -> None:
        """Old rows have the default."""
        key = self._key(name)
        d = self.defs[key]
        if not column.nullable and column.default is None and not self.table(name).isEmpty():
            raise ConstraintError(f"{column.name} is NOT NULL without a default")
        rows = self.table(name).withColumn(column.name, F.lit(column.default).cast(column.type))
        self.defs[key] = replace(d, columns=(*d.columns, column))
        self._write(key, rows)

    def drop_column(self, name: str, column: str) -> None:
        key = self._key(name)
        d = self.defs[key]
        used = {*d.primary_key, *(c for u in d.unique for c in u), *(c for f in d.foreign_keys for c in f.columns), d.partition_column}
        if column in used:
            raise ConstraintError(f"{column} is part of a key")
        rows = self.table(name).drop(column)
        self.defs[key] = replace(d, columns=tuple(c for c in d.columns if c.name != column))
        self._write(key, rows)

    def rename_column(self, name: str, old: str, new: str) -> None:
        key = self._key(name)
        d = self.defs[key]
        swap = lambda cs: tuple(new if c == old else c for c in cs)
        rows = self.table(name).withColumnRenamed(old, new)
        self.defs[key] = replace(
            d, columns=tuple(replace(c, name=new) if c.name == old else c for c in d.columns), primary_key=swap(d.primary_key), unique=tuple(map(swap, d.unique)),
            foreign_keys=tuple(replace(f, columns=swap(f.columns)) for f in d.foreign_keys),
        )
        self._write(key, rows)

    def add_foreign_key(self, name: str, key: ForeignKey) -> None:
        d = replace(self.defs[self._key(name)], foreign_keys=(*self.defs[self._key(name)].foreign_keys, key))
        self._check_foreign(d, self.table(name))
        self.defs[self._key(name)] = d

    def drop_constraint(self, name: str, constraint: str) -> None:
        d = self.defs[self._key(name)]
        if constraint not in [f.name for f in d.foreign_keys]:
            raise ValueError(f"no constraint {constraint}")
        self.defs[self._key(name)] = replace(d, foreign_keys=tuple(f for f in d.foreign_keys if f.name != constraint))

    def create_index(self, name: str, table: str, columns: list[str], unique: bool = False) -> None:
        """Note an index; a unique one is checked now and at every write."""
        d = self.defs[self._key(table)]
        d = replace(d, indexes=(*d.indexes, (name, tuple(columns), unique)))
        self._check_unique(d, self.table(table))
        self.defs[self._key(table)] = d

    def drop_index(self, table: str, name: str) -> None:
        d = self.defs[self._key(table)]
        self.defs[self._key(table)] = replace(d, indexes=tuple(i for i in d.indexes if i[0] != name))

    # ---- reading ----

    def _store(self, key: str) -> VersionedTable:
        return VersionedTable(self.spark, f"{self.path}/{key}")

    def table(self, name: str) -> DataFrame:
        """The rows, as this transaction sees them."""
        key = self._key(name)
        if key not in self.defs:
            raise ValueError(f"no table {key}")
        if self.staged is not None:
            if key in self.staged:
                return self.staged[key]
            version = self.bases.setdefault(key, self._store(key).version())
            return self._store(key).read(version)
        return self._store(key).read()

    def query(self, sql: str, *args: Any, **named: Any) -> DataFrame:
        """A SELECT over the tables."""
        from quern.sql import Engine

        engine, found = Engine(self.spark), dialect.tokens(sql)
        words, edits = {t.text.lower() for t in found}, []
        for key in self.defs:
            schema, _, name = key.partition(".")
            if name in words and schema == self.current:
                engine.register(name, self.table(key))
            for k in range(len(found) - 2):
                if [t.text.lower() for t in found[k : k + 3]] == [schema, ".", name] and (k == 0 or found[k - 1].text != "."):
                    engine.register(f"{schema}__{name}", self.table(key))
                    follows = found[k + 3] if k + 3 < len(found) else None
                    edits.append((found[k].start, found[k + 2].end, name if follows and follows.text == "." else f"{schema}__{name}" if _aliased(follows) else f"{schema}__{name} AS {name}"))
        for start, end, new in sorted(edits, reverse=True):
            sql = sql[:start] + new + sql[end:]
        return engine.query(sql, *args, **named)

    def _marked(self, name: str, where: str | None) -> str:
        """SQL of a table's rows with __hit: whether the condition is true."""
        short = self._key(name).partition(".")[2]
        return f"(SELECT *, coalesce(({where or 'TRUE'}), FALSE) AS __hit FROM {name}) AS {short}"

    # ---- DML ----

    def insert(self, name: str, rows: DataFrame | list[tuple], columns: list[str] | None = None) -> int:
        """Append rows; columns not named get their defaults."""
        key = self._key(name)
        d = self.defs[key]
        given = columns or [c.name for c in d.columns]
        if isinstance(rows, list):
            kinds = {c.name: c.type for c in d.columns}
            rows = self.spark.createDataFrame(rows, T.StructType([T.StructField(c, kinds[c]) for c in given]))
        rows = rows.toDF(*given)
        full = rows.select(*[(F.col(c.name) if c.name in given else F.lit(c.default)).cast(c.type).alias(c.name) for c in d.columns])
        self._check_rows(d, full)
        self._check_foreign(d, full)
        made = self.table(name).unionByName(full)
        self._check_unique(d, made)
        n = full.count()
        self._write(key, made)
        return n

    def update(self, name: str, changes: dict[str, Column | Any], where: Column | str | None = None) -> int:
        """SET column = expression of the old values; the number of rows changed."""
        if isinstance(where, str):
            where = F.expr(where)
        key = self._key(name)
        d, rows = self.defs[key], self.table(name)
        hit = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
        kinds = {c.name: c.type for c in d.columns}
        unknown = set(changes) - set(kinds)
        if unknown:
            raise ValueError(f"no column {', '.join(sorted(unknown))}")
        as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
        made = rows.select(*[(F.when(hit, as_column(changes[c]).cast(kinds[c])).otherwise(F.col(c)) if c in changes else F.col(c)).alias(c) for c in kinds])
        self._check_rows(d, made)
        self._check_foreign(d, made)
        self._check_unique(d, made)
        n = rows.filter(hit).count()
        self._write(key, made)
        return n

    def update_text(self, name: str, changes: dict[str, str], where: str | None, *args: Any, **named: Any) -> int:
        """UPDATE by SQL text, which may hold subqueries and arguments; the number of rows changed."""
        key = self._key(name)
        d = self.defs[key]
        kinds = {c.name: c.type for c in d.columns}
        if unknown := set(changes) - set(kinds):
            raise ValueError(f"no column {', '.join(sorted(unknown))}")
        # values come first, in the order of the statement, so that arguments keep theirs
        values = [f"CASE WHEN __hit THEN CAST(({v}) AS {kinds[c].simpleString()}) ELSE {c} END AS {c}" for c, v in changes.items()]
        marked = self.query(f"SELECT {', '.join([*values, *(c for c in kinds if c not in changes), '__hit'])} FROM {self._marked(name, where)}", *args, **named)
        made = marked.select(*kinds)
        self._check_rows(d, made)
        self._check_foreign(d, made)
        self._check_unique(d, made)
        n = marked.filter("__hit").count()
        self._write(key, made)
        return n

    def delete_text(self, name: str, where: str | None, *args: Any, **named: Any) -> int:
        """DELETE by SQL text, which may hold subqueries and arguments; the number of rows removed."""
        marked = self.query(f"SELECT * FROM {self._marked(name, where)}", *args, **named)
        n = marked.filter("__hit").count()
        self._write(self._key(name), marked.filter("NOT __hit").drop("__hit"))
        return n

    def delete(self, name: str, where: Column | str | None = None) -> int:
        """Remove rows where the condition is true."""
        rows = self.table(name)
        hit = F.lit(True) if where is None else F.coalesce(F.expr(where) if isinstance(where, str) else where, F.lit(False))
        n = rows.filter(hit).count()
        self._write(self._key(name), rows.filter(~hit))
        return n

    def truncate(self, name: str) -> None:
        self._write(self._key(name), self.table(name).limit(0))

    def _write(self, key: str, rows: DataFrame) -> None:
        if self.staged is not None:
            self.bases.setdefault(key, self._store(key).version())
            self.staged[key] = rows
        else:
            self._store(key).commit(rows)

    # ---- transactions ----

    def begin(self) -> None:
        if self.staged is not None:
            raise ValueError("a transaction is open")
        self.staged, self.bases, self.before = {}, {}, (dict(self.defs), set(self.schemas))

    def commit(self) -> None:
        """Publish staged tables; a table that another writer changed since it was read is a conflict."""
        staged, self.staged = self.staged or {}, None
        for key in staged:
            if self._store(key).version() != self.bases[key]:
                raise Conflict(f"{key} changed since this transaction read it")
        for key, rows in staged.items():
            self._store(key).commit(rows, expected=self.bases[key])
        self._save()

    def rollback(self) -> None:
        """Forget staged rows and definitions; tables made since then go."""
        if self.staged is None:
            return
        self.staged, (known, self.schemas) = None, self.before
        for key in set(self.defs) - set(known):
            self._store(key).drop()
        self.defs = Catalog(known, self._save)
        self._save()

    # ---- constraints ----

    def _check_rows(self, d: TableDef, rows: DataFrame) -> None:
        """NOT NULL, capacity and CHECK, in one pass."""
        tests = {}
        for c in d.columns:
            if not c.nullable or c.name in d.primary_key:
                tests[f"{c.name} is NOT NULL"] = F.col(c.name).isNull()
            if (n := capacity(c.declared)) is not None:
                tests[f"{c.name} holds {n} characters"] = F.length(c.name) > n
        for check in d.checks:
            tests[f"CHECK ({check})"] = ~F.expr(check)
        if tests:
            found = rows.agg(*[F.count_if(F.coalesce(t, F.lit(False))).alias(str(i)) for i, t in enumerate(tests.values())]).first()
            broken = [name for i, name in enumerate(tests) if found[i]]
            if broken:
                raise ConstraintError("; ".join(broken))

    def _check_unique(self, d: TableDef, rows: DataFrame) -> None:
        keys = [d.primary_key, *d.unique, *(c for _, c, unique in d.indexes if unique)]
        for key in filter(None, keys):
            full = rows.dropna(subset=list(key))
            if not full.groupBy(*key).count().filter("count > 1").isEmpty():
                raise ConstraintError(f"duplicate key ({', '.join(key)})")

    def _check_foreign(self, d: TableDef, rows: DataFrame) -> None:
        for f in d.foreign_keys:
            if not foreign_key_violations(rows, list(f.columns), self.table(f.table), list(f.references)).isEmpty():
                raise ConstraintError(f"a key of {f.table} ({', '.join(f.references)}) is missing")

    # ---- reports ----

    def show_tables(self) -> DataFrame:
        names = sorted(k.partition(".")[2] for k in self.defs if k.startswith(self.current + "."))
        return self.spark.createDataFrame([(n,) for n in names], "name string")

    def show_schemas(self) -> DataFrame:
        return self.spark.createDataFrame([(n,) for n in sorted(self.schemas)], "name string")

    def show_indexes(self, name: str) -> DataFrame:
        d = self.defs[self._key(name)]
        rows = [("PRIMARY", ",".join(d.primary_key), True)] if d.primary_key else []
        return self.spark.createDataFrame(rows + [(n, ",".join(c), u) for n, c, u in d.indexes], "name string, columns string, is_unique boolean")

    def describe(self, name: str) -> DataFrame:
        d = self.defs[self._key(name)]
        rows = [(c.name, c.declared, c.nullable and c.name not in d.primary_key, None if c.default is None else str(c.default)) for c in d.columns]
        return self.spark.createDataFrame(rows, "name string, type string, nullable boolean, default string")

    def analyze(self, name: str) -> DataFrame:
        """A row per column: rows, distinct values (approximate), nulls, least and greatest."""
        return table_stats(self.table(name))


def _aliased(token: dialect.Token | None) -> bool:
    """Whether a table's name is followed by a name of its own."""
    return token is not None and (token.up == "AS" or (token.kind in ("word", "quoted") and token.up not in _AFTER_TABLE))


_AFTER_TABLE = frozenset("WHERE GROUP ORDER HAVING LIMIT OFFSET UNION INTERSECT EXCEPT JOIN INNER LEFT RIGHT FULL CROSS NATURAL ON USING SET".split())


def foreign_key_violations(rows: DataFrame, columns: list[str], other: DataFrame, references: list[str]) -> DataFrame:
    """Rows whose key, all parts there, is not in the other table."""
    keys = other.select(*[F.col(r).alias(f"__r{i}") for i, r in enumerate(references)])
    on = [F.col(c) == F.col(f"__r{i}") for i, c in enumerate(columns)]
    return rows.dropna(subset=columns).join(keys, on, "left_anti")


def table_stats(rows: DataFrame, exact: bool = False) -> DataFrame:
    """Statistics of every column in one aggregation."""
    distinct = F.count_distinct if exact else F.approx_count_distinct
    whole = [F.count(F.lit(1)).alias("rows")]
    plain = [f for f in rows.schema.fields if isinstance(f.dataType, T.AtomicType)]
    for i, f in enumerate(plain):
        c = F.col(f"`{f.name}`")
        whole += [distinct(c).alias(f"d{i}"), F.count_if(c.isNull()).alias(f"n{i}"), F.min(c).cast("string").alias(f"l{i}"), F.max(c).cast("string").alias(f"h{i}")]
    one = rows.agg(*whole)
    parts = [F.struct(F.lit(f.name).alias("column"), F.col("rows"), F.col(f"d{i}").alias("distinct_values"), F.col(f"n{i}").alias("nulls"), F.col(f"l{i}").alias("least"), F.col(f"h{i}").alias("greatest")) for i, f in enumerate(plain)]
    return one.select(F.explode(F.array(*parts)).alias("x")).select("x.*")
