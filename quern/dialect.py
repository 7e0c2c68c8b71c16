"""The engine's SQL where it differs from Spark's, rewritten as text before Spark plans it.

Two passes. The first needs words only: backslashes are ordinary characters, ``$1`` takes an argument,
ORDER BY puts nulls last in both directions, RIGHT and FULL joins with USING keep both columns, and
quantified comparisons become scalar subqueries. The second needs types, which Spark's analysis of the
first result gives: division of integers truncates, other division follows IEEE, LIKE has no escape
character, and a bigint is compared with a double exactly. Nodes of the analysed plan name the part of the
text that they come from, so only that part is rewritten. What both leave is plain Spark SQL.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession

_TOKEN = re.compile(r"(?P<space>\s+|--[^\n]*|/\*.*?\*/)|(?P<text>'(?:[^']|'')*')|(?P<quoted>`(?:[^`]|``)*`|\"(?:[^\"]|\"\")*\")|(?P<number>\d+(?:\.\d*)?(?:[eE][+-]?\d+)?[A-Za-z]*|\.\d+(?:[eE][+-]?\d+)?)|(?P<word>\w+)|(?P<argument>\$\d+)|(?P<sign><=>|<>|!=|<=|>=|==|\|\||::|.)", re.S)
_COMPARE = frozenset(("=", "==", "<>", "!=", "<", "<=", ">", ">="))
_ENDS_ORDER = frozenset("LIMIT OFFSET UNION INTERSECT EXCEPT ROWS RANGE FETCH".split())
_BEFORE_OPERAND = frozenset("SELECT WHERE AND OR NOT ON HAVING WHEN THEN ELSE CASE DISTINCT BETWEEN BY RETURN".split())
_WHOLE = frozenset(("bigint", "int", "smallint", "tinyint"))
_REAL = frozenset(("double", "float"))
_SUBQUERIES = frozenset(("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery"))
_LIMIT = "9.223372036854775808E18D"


@dataclass(frozen=True)
class Token:
    """A word, sign or literal and its place in the text; ``up`` is upper case but for literals."""

    kind: str
    text: str
    start: int
    end: int

    @property
    def up(self) -> str:
        return self.text.upper() if self.kind == "word" else self.text


def tokens(sql: str) -> list[Token]:
    """The tokens of a statement without white space and comments."""
    return [Token(m.lastgroup, m[0], m.start(), m.end()) for m in _TOKEN.finditer(sql) if m.lastgroup != "space"]


def _edited(sql: str, edits: list[tuple[int, int, str]]) -> str:
    """The text with parts replaced; the parts don't overlap."""
    for start, end, new in sorted(edits, key=lambda e: (-e[0], -e[1])):
        sql = sql[:start] + new + sql[end:]
    return sql


def closing(found: list[Token], at: int) -> int:
    """The place of the parenthesis that closes the one at ``at``."""
    depth = 0
    for k in range(at, len(found)):
        depth += (found[k].text == "(") - (found[k].text == ")")
        if not depth:
            return k
    raise ValueError("a parenthesis is not closed")


# ---- what needs words only ----


def _ordinary(found: list[Token]) -> list[tuple[int, int, str]]:
    out = [(t.start, t.end, t.text.replace("\\", "\\\\")) for t in found if t.kind == "text" and "\\" in t.text]
    return out + [(t.start, t.end, f":arg{t.text[1:]}") for t in found if t.kind == "argument"]


def literal(value: object) -> str:
    """A value as SQL text."""
    if value is None or isinstance(value, bool):
        return {None: "NULL", True: "TRUE", False: "FALSE"}[value]
    if isinstance(value, int):
        return f"({value})" if value < 0 else str(value)
    if isinstance(value, float):
        return f"({value!r}D)" if math.isfinite(value) else f"double('{value}')"
    if isinstance(value, Decimal):
        return f"({value}BD)"
    if isinstance(value, datetime):
        return f"TIMESTAMP_NTZ'{value.isoformat(' ')}'"
    if isinstance(value, date):
        return f"DATE'{value.isoformat()}'"
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "''") + "'"
    raise TypeError(f"an argument of type {type(value).__name__}")


def bound(sql: str, args: list, named: dict) -> str:
    """The statement, after the first pass, with its arguments in place as literals."""
    found, left, edits = tokens(sql), iter(args), []
    by_name = {k.lower(): v for k, v in named.items()} | {f"arg{k}": v for k, v in enumerate(args, 1)}
    for t, after in zip(found, [*found[1:], None], strict=True):
        if t.kind == "sign" and t.text == "?":
            try:
                edits.append((t.start, t.end, literal(next(left))))
            except StopIteration:
                raise ValueError("an argument is missing") from None
        elif t.kind == "sign" and t.text == ":" and after and after.kind == "word" and after.start == t.end:
            if after.text.lower() not in by_name:
                raise ValueError(f"the argument {after.text} is missing")
            edits.append((t.start, after.end, literal(by_name[after.text.lower()])))
    return _edited(sql, edits)


def _orders(found: list[Token]) -> list[tuple[int, int, str]]:
    """Each key of an ORDER BY without a place for nulls gets one."""
    out = []
    for k, t in enumerate(found[:-1]):
        if t.up != "ORDER" or found[k + 1].up != "BY":
            continue
        depth, last, placed = 0, None, False
        for x in [*found[k + 2 :], None]:
            ends = x is None or (depth == 0 and (x.text in (")", ";") or x.up in _ENDS_ORDER))
            if ends or (depth == 0 and x.text == ","):
                if last is not None and not placed:
                    out.append((last.end, last.end, " NULLS LAST"))
                if ends:
                    break
                last, placed = None, False
                continue
            depth += (x.text == "(") - (x.text == ")")
            depth += (x.up == "CASE") - (x.up == "END")
            placed = placed or (depth == 0 and x.up == "NULLS")
            last = x
    return out


def _using(found: list[Token], sql: str) -> list[tuple[int, int, str]]:
    """RIGHT and FULL joins keep the columns of both sides."""
    out = []
    for k, t in enumerate(found):
        if t.up not in ("RIGHT", "FULL") or k + 1 >= len(found) or found[k + 1].up not in ("OUTER", "JOIN"):
            continue
        at = depth = 0
        for j in range(k + 1, len(found)):
            depth += (found[j].text == "(") - (found[j].text == ")")
            if depth < 0 or (depth == 0 and found[j].up in ("ON", "WHERE", "GROUP", "ORDER")):
                break
            if depth == 0 and found[j].up == "USING":
                at = j
                break
        if not at or not found[at + 1].text == "(":
            continue
        left = k - 1
        if found[left].text == ")" or (found[left - 1].up in _COMPARE):  # a join stands before: the first table of the FROM names its columns
            depth = 0
            while left >= 0 and not (depth == 0 and found[left].up == "FROM"):
                depth += (found[left].text == ")") - (found[left].text == "(")
                left -= 1
            left += 1
            left = closing(found, left) + 1 if found[left].text == "(" else left
            if found[left + 1].up == "AS":
                left += 2
            elif found[left + 1].kind in ("word", "quoted") and found[left + 1].up not in ("JOIN", "INNER", "LEFT", "RIGHT", "FULL", "CROSS", "ON", "USING"):
                left += 1
        end = closing(found, at + 1)
        names = [x.text for x in found[at + 2 : end] if x.text != ","]
        on = " AND ".join(f"{found[left].text}.{c} = {found[at - 1].text}.{c}" for c in names)
        out.append((found[at].start, found[end].end, f"ON {on}"))
    return out


def _quantified(found: list[Token], sql: str) -> list[tuple[int, int, str]]:
    """x > ALL (SELECT ..) and the like, by the extremes and nulls of the subquery."""
    out = []
    for k, t in enumerate(found[:-2]):
        if t.up not in ("ALL", "ANY", "SOME") or found[k - 1].text not in _COMPARE or found[k + 1].text != "(" or found[k + 2].up not in ("SELECT", "WITH", "VALUES"):
            continue
        end = closing(found, k + 1)
        start, depth = k - 2, 0
        while start >= 0:
            x = found[start]
            depth += (x.text == ")") - (x.text == "(") + (x.up == "END") - (x.up == "CASE" and depth > 0)
            if depth < 0 or (depth == 0 and (x.text == "," or x.up in _BEFORE_OPERAND)):
                break
            start -= 1
        own = sql[found[start + 1].start : found[k - 2].end]
        rows = f"(SELECT v FROM {sql[found[k + 1].start : found[end].end]} AS q(v))"
        one = lambda what, rows=rows: f"(SELECT {what} FROM {rows})"
        op, every = {"==": "=", "!=": "<>"}.get(found[k - 1].text, found[k - 1].text), t.up == "ALL"
        if op in ("=", "<>") and (op == "=") != every:
            new = f"({own} {'IN' if op == '=' else 'NOT IN'} {sql[found[k + 1].start : found[end].end]})"
        else:
            if op in ("=", "<>"):  # all equal, or some other: by both extremes
                test = f"({own} = {one('min(v)')} AND {own} = {one('max(v)')})"
                every, flip = True, op == "<>"
            else:
                extreme = "max(v)" if (op[0] == ">") == every else "min(v)"
                test, flip = f"{own} {op} {one(extreme)}", False
            known, empty = ("TRUE", "TRUE") if every else ("FALSE", "FALSE")
            decided = f"NOT ({test})" if every else test
            new = f"CASE WHEN {one('count(*)')} = 0 THEN {empty} WHEN {decided} THEN {'FALSE' if every else 'TRUE'} WHEN {one('count(*) - count(v)')} > 0 OR ({own}) IS NULL THEN NULL ELSE {known} END"
            new = f"(NOT ({new}))" if flip else f"({new})"
        out.append((found[start + 1].start, found[end].end, new))
    return out


def plain(sql: str) -> str:
    """The statement after the first pass."""
    for change in (lambda found, _: _ordinary(found), _using, _quantified, lambda found, _: _orders(found)):
        sql = _edited(sql, change(tokens(sql), sql))
    return sql


def recursive_tables(sql: str) -> tuple[list[tuple[str, list[str], str, tuple[str, str] | None]], str] | None:
    """The tables of a WITH RECURSIVE of which one has UNION (distinct), and the query after them; else nothing.

    A table: its name, columns, text, and for such a union the text before and after it.
    """
    found = tokens(sql)
    if len(found) < 2 or found[0].up != "WITH" or found[1].up != "RECURSIVE":
        return None
    at, out = 2, []
    while True:
        name, columns = found[at].text, []
        at += 1
        if found[at].text == "(":
            end = closing(found, at)
            columns = [x.text for x in found[at + 1 : end] if x.text != ","]
            at = end + 1
        at += found[at].up == "AS"
        end = closing(found, at)
        depth, cut = 0, None
        for k in range(at + 1, end):
            depth += (found[k].text == "(") - (found[k].text == ")")
            if depth == 0 and found[k].up == "UNION":
                cut = k
        own = any(x.up == name.upper() for x in found[at + 1 : end])
        body, parts = sql[found[at].end : found[end].start], None
        if own and cut is not None and found[cut + 1].up != "ALL":
            start = found[cut + 1].end if found[cut + 1].up == "DISTINCT" else found[cut].end
            parts = sql[found[at].end : found[cut].start], sql[start : found[end].start]
        elif own:
            columned = f"{name}({', '.join(columns)})" if columns else name
            body = f"WITH RECURSIVE {columned} AS ({body}) SELECT * FROM {name}"
        out.append((name, columns, body, parts))
        at = end + 1
        if found[at].text != ",":
            break
        at += 1
    return (out, sql[found[at].start :]) if any(parts for *_, parts in out) else None


# ---- what needs types ----


def _all(items) -> list:
    return [items.apply(i) for i in range(items.size())]


class _Typed:
    """Finds what to rewrite in an analysed plan."""

    def __init__(self, sql: str):
        self.sql, self.edits = sql, []

    def plan(self, plan) -> None:
        name = plan.getClass().getSimpleName()
        if name == "View":  # a table: its plan comes from another text
            return
        for e in _all(plan.expressions()):
            self.expression(e, name in ("Filter", "Join"))
        for child in _all(plan.children()):
            self.plan(child)

    def span(self, e) -> tuple[int, int] | None:
        o = e.origin()
        if not (o.startIndex().isDefined() and o.stopIndex().isDefined()):
            return None
        if not (o.sqlText().isDefined() and o.sqlText().get() == self.sql):
            return None
        return o.startIndex().get(), o.stopIndex().get() + 1

    def expression(self, e, conjunct: bool) -> None:
        name = e.getClass().getSimpleName()
        if name == "TryDivide" or name == "TryEval":
            return
        edit = None
        if name == "Divide":
            edit = self.divide(e)
        elif name in ("Like", "ILike"):
            edit = self.like(e)
        elif name in ("EqualTo", "LessThan", "LessThanOrEqual", "GreaterThan", "GreaterThanOrEqual"):
            edit = self.compare(e, conjunct)
        if edit:
            self.edits.append(edit)
        if name in _SUBQUERIES:
            self.plan(e.plan())
        for child in _all(e.children()):
            self.expression(child, conjunct and name == "And")

    def split(self, span: tuple[int, int], signs: frozenset[str]) -> tuple[str, str, str] | None:
        """The last of the signs outside parentheses and CASE in a part of the text, and what stands around it."""
        depth, at = 0, None
        for t in tokens(self.sql[span[0] : span[1]]):
            depth += (t.text in "([" and t.kind == "sign") - (t.text in ")]" and t.kind == "sign") + (t.up == "CASE") - (t.up == "END")
            if depth == 0 and t.kind == "sign" and t.text in signs:
                at = t
        if at is None:
            return None
        own = self.sql[span[0] : span[1]]
        return own[: at.start].strip(), at.text, own[at.end :].strip()

    @staticmethod
    def types(e) -> list[tuple[str, str]]:
        """By child: its type, and the type before an implicit cast."""
        out = []
        for child in _all(e.children()):
            name, inner = child.dataType().simpleString(), child
            if child.getClass().getSimpleName() == "Cast":
                inner = child.child()
            out.append((name, inner.dataType().simpleString()))
        return out

    def divide(self, e) -> tuple[int, int, str] | None:
        span = self.span(e)
        found = span and self.split(span, frozenset("/"))
        if not found:
            return None
        left, _, right = found
        if left.startswith("CAST(") and left.endswith("AS DOUBLE)") and right.startswith("CAST(") and right.endswith("AS DOUBLE)"):
            return None
        kinds = [inner for _, inner in self.types(e)]
        if all(k in _WHOLE for k in kinds):
            return (*span, f"{left} div {right}")
        if not all(k in _WHOLE or k in _REAL or k.startswith("decimal") for k in kinds):
            return None
        if re.fullmatch(r"[\d.]*[1-9][\d.]*([eE][+-]?\d+)?[dDfF]?", right):
            return (*span, f"CAST({left} AS DOUBLE) / CAST({right} AS DOUBLE)")
        a, b = f"CAST({left} AS DOUBLE)", f"CAST({right} AS DOUBLE)"
        return (*span, f"(CASE WHEN {b} <> 0 THEN try_divide({a}, {b}) WHEN {b} = 0 AND {a} > 0 AND NOT isnan({a}) THEN double('inf') WHEN {b} = 0 AND {a} < 0 THEN double('-inf') WHEN {b} = 0 AND {a} IS NOT NULL THEN double('nan') END)")

    def like(self, e) -> tuple[int, int, str] | None:
        span = self.span(e)
        if not span or re.search(r"ESCAPE\s*'(?:[^']|'')+'\s*$", self.sql[slice(*span)], re.I):
            return None
        return span[1], span[1], " ESCAPE '\\u0001'"

    def compare(self, e, conjunct: bool) -> tuple[int, int, str] | None:
        (outer, first), (other, second) = self.types(e)
        if outer not in _REAL or other not in _REAL or {first, second} not in ({"bigint", "double"}, {"bigint", "float"}):
            return None
        span = self.span(e)
        found = span and self.split(span, _COMPARE)
        if not found:
            return None
        left, op, right = found
        whole, real = (left, right) if first == "bigint" else (right, left)
        if op in ("=", "==") and conjunct:  # a key to join by
            return (*span, f"{whole} = CAST(CASE WHEN {real} % 1 = 0 AND {real} >= -{_LIMIT} AND {real} < {_LIMIT} THEN {real} END AS BIGINT)")
        if first != "bigint":
            op = {"<": ">", "<=": ">=", ">": "<", ">=": "<="}.get(op, op)
        inside = f"CAST(CASE WHEN {real} >= -{_LIMIT} AND {real} < {_LIMIT} THEN floor({real}) END AS BIGINT)"
        sign = (
            f"CASE WHEN {whole} IS NULL OR {real} IS NULL THEN NULL WHEN isnan({real}) OR {real} >= {_LIMIT} THEN -1 WHEN {real} < -{_LIMIT} THEN 1"
            f" WHEN {whole} < {inside} THEN -1 WHEN {whole} > {inside} THEN 1 WHEN {real} % 1 <> 0 THEN -1 ELSE 0 END"
        )
        return (*span, f"(({sign}) {op} 0)")


def _outermost(edits: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Edits within no other one's part; the rest wait for the next turn."""
    out: list[tuple[int, int, str]] = []
    for e in sorted(set(edits), key=lambda e: (e[1] - e[0], e[0])):
        if not any(a[0] < e[1] and e[0] < a[1] for a in out):
            out.append(e)
    return out


def planned(spark: SparkSession, sql: str) -> DataFrame:
    """The query of a statement that the first pass is done with."""
    words = {t.up for t in tokens(sql)}
    for _ in range(50):
        frame = spark.sql(sql)
        plan = frame._jdf.queryExecution().analyzed()
        if not words & {"/", "LIKE", "ILIKE"} and not re.search(r"cast\(.*? as double\)", plan.toString()):
            return frame
        found = _Typed(sql)
        found.plan(plan)
        if not found.edits:
            return frame
        sql = _edited(sql, _outermost(found.edits))
    raise ValueError("the statement is nested too deeply")
