"""Expressions over the rows of a group, compiled to aggregates, so that the rows are not brought together.

What a query asks of ``rows`` is mostly their number, a sum, whether one of them is so, or the
first few of them. ``length``, ``isEmpty``, ``filter``, ``map``, ``contains``, ``unique().length``,
``reduce(acc + ...)``, ``slice(a, b)`` and ``[n]`` with numbers are aggregates; all else needs the
list itself and raises ``NeedsList``.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mdspark.plans.expression import Compiler, Typed, equal, flag, listed, number, scope_of, truthy


class NeedsList(Exception):
    """The expression is about the list as a whole."""


@dataclass
class _Rows:
    """Some of the rows, and what is asked of each; ``used`` is shared by all that come from one mention of the group."""

    value: Typed
    condition: Column
    used: list[bool]
    distinct: bool = False


class GroupCompiler(Compiler):
    """Compiles expressions of a grouped row, collecting the aggregates and row numbers that they need.

    ``member`` is a row of the group, named ``name`` in expressions; ``keys`` are names that are the
    same for the whole group. ``first`` gives the number of a row among those of its group that
    meet a condition; without it nothing can be sliced.
    """

    def __init__(self, name: str, member: Typed, keys: dict[str, Typed], now: str | None = None, first: Any = None, prefix: str = "_a"):
        super().__init__(keys, now)
        self.group, self.member, self.first, self.prefix = name, member, first, prefix
        self.aggregates: list[Column] = []
        self.numbers: dict[str, Column] = {}
        self.inside, self.mentions = False, []

    def compile(self, source: str) -> Typed:
        out = super().compile(source)
        if not all(used[0] for used in self.mentions):
            raise NeedsList(source)
        return out

    def name(self, value: str) -> Typed:
        if value == self.group:
            if self.inside:
                raise NeedsList(value)
            self.mentions.append([False])
            return Typed(F.lit(None), "group", literal=_Rows(self.member, F.lit(True), self.mentions[-1]))
        found = super().name(value)
        if value == "key" and not self.inside and found.kind != "null":
            return found.at(F.col("key").cast(self.key_type)) if self.key_type else found
        return found

    #: Type of the column key of the aggregated rows, as what it is computed from isn't there any more.
    key_type: Any = None

    def _made(self, aggregate: Column, rows: _Rows) -> Column:
        rows.used[0] = True
        name = f"{self.prefix}{len(self.aggregates)}"
        self.aggregates.append(aggregate.alias(name))
        return F.col(name)

    def _length(self, rows: _Rows) -> Typed:
        if rows.distinct:
            if rows.value.kind not in ("number", "string", "boolean", "date", "null"):
                raise NeedsList("unique")
            return number(self._made(F.count_distinct(F.when(rows.condition, F.to_json(F.struct(rows.value.value.alias("v"))))), rows).cast("double"))
        return number(self._made(F.count_if(rows.condition), rows).cast("double"))

    def _part(self, rows: _Rows, start: int, stop: int) -> Typed:
        """The rows from ``start`` up to ``stop``, of which a task holds no others."""
        if self.first is None or rows.distinct or not 0 <= start:
            raise NeedsList("slice")
        name = f"_n{len(self.numbers)}"
        self.numbers[name] = self.first(rows.condition)
        item = F.struct(F.col(name).alias("n"), rows.value.value.alias("v"))
        some = F.collect_list(F.when(rows.condition & (F.col(name) > start) & (F.col(name) <= stop), item))
        column = self._made(F.transform(F.array_sort(some, lambda a, b: a["n"] - b["n"]), lambda x: x["v"]), rows)
        return listed(column, replace(rows.value.at(rows.value.value), exact=None))

    def field(self, x: Typed, name: str) -> Typed:
        if x.kind != "group":
            return super().field(x, name)
        if name != "length":
            raise NeedsList(name)
        return self._length(x.literal)

    def index(self, x: Typed, at: Typed) -> Typed:
        if x.kind != "group":
            return super().index(x, at)
        if not isinstance(at.literal, float) or at.literal < 0:
            raise NeedsList("index")
        return super().index(self._part(x.literal, int(at.literal), int(at.literal) + 1), Typed(F.lit(0.0), "number", literal=0.0))

    def _body(self, rows: _Rows, more: dict[str, Typed] | None = None) -> Typed:
        outer, self.scope, self.inside = self.scope, self.scope | {"value": rows.value} | (more or {}), True
        out = self._or()
        self.scope, self.inside = outer, False
        return out

    def method(self, x: Typed, name: str) -> Typed:
        if x.kind != "group":
            return super().method(x, name)
        rows: _Rows = x.literal
        if name in ("filter", "map", "reduce") and self._names_index():
            raise NeedsList("index")
        if name in ("filter", "map") and not rows.distinct:
            made = self._body(rows)
            self._need(")")
            more = replace(rows, condition=rows.condition & truthy(made)) if name == "filter" else replace(rows, value=made)
            return Typed(x.column, "group", literal=more)
        if name == "reduce" and not rows.distinct and self._peek() == ("name", "acc") and self._peek(1) == ("op", "+") and not self._later_acc():
            self.place += 2
            each = self._body(rows)
            start = self._or() if self._take(",") else None
            self._need(")")
            if each.kind != "number" or start is None or start.kind != "number":
                raise NeedsList("reduce")
            return number(F.coalesce(self._made(F.sum(F.when(rows.condition, each.column)), rows), F.lit(0.0)) + start.column)
        if name not in ("slice", "contains", "isempty", "unique", "length"):
            raise NeedsList(name)
        args = self._arguments(")")
        if name == "isempty" and not args:
            return flag(self._made(F.count_if(rows.condition), rows) == 0)
        if name == "unique" and not args and not rows.distinct:
            return Typed(x.column, "group", literal=replace(rows, distinct=True))
        if name == "contains" and len(args) == 1 and args[0].literal is not None:
            return flag(F.coalesce(self._made(F.bool_or(rows.condition & equal(rows.value, args[0])), rows), F.lit(False)))
        if name == "slice" and len(args) == 2 and all(isinstance(a.literal, float) and a.literal >= 0 for a in args):
            return self._part(rows, int(args[0].literal), int(args[1].literal))
        raise NeedsList(name)

    def _inner(self) -> list[tuple[str, Any]]:
        """The tokens up to the bracket that closes here."""
        depth, k = 0, self.place
        while k < len(self.tokens):
            value = self.tokens[k][1]
            if value in ("(", "[", "{"):
                depth += 1
            elif value in (")", "]", "}"):
                if not depth:
                    break
                depth -= 1
            k += 1
        return self.tokens[self.place : k]

    def _names_index(self) -> bool:
        return ("name", "index") in self._inner()

    def _later_acc(self) -> bool:
        """Whether ``acc`` is used again, or what is added to it goes on with an operator that binds less."""
        inner, depth = self._inner()[2:], 0
        for kind, value in inner:
            depth += (value in ("(", "[", "{")) - (value in (")", "]", "}"))
            if (kind, value) == ("name", "acc"):
                return True
            if not depth and value in (",",):
                return False
            if not depth and (value in (">", "<", ">=", "<=", "=", "==", "!=", "||", "&&") or str(value).lower() in ("or", "and")):
                return True
        return False


def grouped_rows(frame: DataFrame, key: Typed, as_text: Column, ties: list[str], now: str | None, later: list[tuple[str, str]], columns: list[tuple[str, str]], order) -> DataFrame:
    """The result of what follows a GROUP BY: WHERE, SORT and LIMIT clauses and the (expression, name) ``columns``, without the rows of a group in one value.

    ``order`` makes sort keys of a SORT clause and a function that compiles an expression.
    """
    frame = frame.withColumn("_text", as_text)
    member = Typed(F.struct(*(F.col(f"`{c}`") for c in frame.columns if c != "_text")), "object", fields=scope_of(frame.drop("_text")))

    def first(condition: Column) -> Column:
        return F.row_number().over(Window.partitionBy("_text", condition).orderBy(*ties))

    compiler = GroupCompiler("rows", member, {"key": key}, now, first)
    compiler.key_type = frame.select(key.value.alias("k")).schema["k"].dataType
    steps: list[tuple[str, Any]] = []
    for name, text in later:
        if name == "WHERE":
            steps.append((name, truthy(compiler.compile(text))))
        elif name == "SORT":
            steps.append((name, order(text, compiler.compile)))
        elif name == "LIMIT":
            steps.append((name, int(text)))
        else:
            raise NeedsList(name)
    shown = [compiler.compile(e).value.alias(alias) for e, alias in columns]
    for name, column in compiler.numbers.items():
        frame = frame.withColumn(name, column)
    out = frame.groupBy("_text").agg(F.first(key.value).alias("key"), *compiler.aggregates).orderBy("_text")
    for name, what in steps:
        out = out.where(what) if name == "WHERE" else out.orderBy(*what, "_text") if name == "SORT" else out.limit(what)
    return out.select(*shown)
