"""The expression language of views and queries, compiled to typed Columns.

Kinds come from the table's schema: null, boolean, number, string, date, duration, list, object,
link, file, regexp, html, image, icon. Missing names, unknown functions and operands of other
kinds give null, never an error; only a text that is no expression raises ``ExpressionError``.
What is of several kinds (items of one list, the two results of an ``if``, a property that differs
from note to note) is of kind any: a variant, whose kind is looked up in each row.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TOKEN = re.compile(
    r"""\s*(?:(?P<date>\d{4}-\d{2}-\d{2})(?![\w-])|(?P<number>\d+(?:\.\d+)?)(?![\w#-])|(?P<string>"(?:\\.|[^"])*"|'(?:\\.|[^'])*')"""
    r"""|(?P<op>>=|<=|!=|==|\|\||&&|[=><+\-*/%!.,:()\[\]{}])|(?P<name>[\w#-]+))"""
)
_REGEX = re.compile(r"\s*/((?:\\.|[^/\n])+)/([a-z]*)")
#: Tokens after which a slash begins a regular expression.
_BEFORE_REGEX = frozenset(["(", ",", "=", "==", "!=", "&&", "||", "and", "or", "not", "!", "["])

#: The units of durations, their parts, and how one is written. Short names are told apart by case, long ones are not.
SHORT_UNITS = {"y": "years", "M": "months", "w": "weeks", "d": "days", "h": "hours", "m": "minutes", "s": "seconds", "ms": "milliseconds"}
PARTS = list(SHORT_UNITS.values())
MILLIS = {"weeks": 604_800_000, "days": 86_400_000, "hours": 3_600_000, "minutes": 60_000, "seconds": 1_000, "milliseconds": 1}
_DURATION = r"^\s*(-?\d+(?:\.\d+)?)\s*([A-Za-z]+)\s*$"
#: Kinds whose Column is a struct.
STRUCTURED = frozenset(["object", "link", "file", "html", "image", "icon"])


class ExpressionError(ValueError):
    pass


@dataclass
class Typed:
    """A Column and its static kind; ``item`` is a model of a list's items, ``fields`` those of a structure, ``literal`` a value known beforehand."""

    column: Column
    kind: str
    item: Typed | None = None
    fields: dict[str, Typed] = field(default_factory=dict)
    literal: Any = None
    entries: bool = False
    #: A number that is an integer in the data, and as such has no decimal place when shown; ``exact`` is it as it was.
    whole: bool = False
    exact: Column | None = None

    @property
    def element(self) -> str:
        return self.item.kind if self.item else "null"

    @property
    def value(self) -> Column:
        """The Column as a result: integers of the data are integers."""
        if not self.whole:
            return self.column
        return self.exact if self.exact is not None else self.column.try_cast("bigint")

    def at(self, column: Column) -> Typed:
        """The same kind for another Column."""
        if self.kind == "duration" or (self.kind in STRUCTURED and not self.entries):
            return Typed(column, self.kind, fields={k: f.at(column.getField(k)) for k, f in self.fields.items()})
        return Typed(column, self.kind, self.item, entries=self.entries, whole=self.whole)


def text(value: str) -> Typed:
    return Typed(F.lit(value), "string", literal=value)


def flag(column: Column) -> Typed:
    return Typed(column, "boolean")


def number(column: Column) -> Typed:
    return Typed(column, "number")


def null() -> Typed:
    return Typed(F.lit(None).cast("string"), "null")


def structure(kind: str, **fields: Typed) -> Typed:
    return Typed(F.struct(*(v.column.alias(k) for k, v in fields.items())), kind, fields=fields)


def listed(column: Column, item: Typed) -> Typed:
    return Typed(column, "list", item)


def anything(column: Column) -> Typed:
    return Typed(column, "any")


def no_value() -> Column:
    return F.lit(None).cast("variant")


#: What a variant's type says of its kind.
_VARIANTS = {"number": "^(BIGINT|DOUBLE|FLOAT|DECIMAL)", "string": "^STRING", "boolean": "^BOOLEAN", "date": "^(TIMESTAMP|DATE)", "list": "^ARRAY"}


def version(x: Typed, kind: str) -> Typed:
    """What of kind any is a value of ``kind``; null in rows where it is none."""
    if x.kind != "any":
        return x if x.kind == kind else null()
    fits = F.schema_of_variant(x.column).rlike(_VARIANTS[kind])
    sql = {"number": "double", "date": "timestamp_ntz", "list": "array<variant>"}.get(kind, kind)
    return Typed(F.when(fits, F.try_variant_get(x.column, "$", sql)), kind, anything(no_value()) if kind == "list" else None)


def versions(x: Typed) -> list[Typed]:
    return [version(x, kind) for kind in _VARIANTS] if x.kind == "any" else [x]


def bound(x: Typed, f: Callable[[Typed], Column]) -> Column:
    """``f`` of a value that it uses many times: as the variable of a lambda it is computed once."""
    return F.get(F.transform(F.array(x.column), lambda v: f(x.at(v))), F.lit(0))


def kind_name(x: Typed) -> Column:
    if x.kind != "any":
        return F.when(x.column.isNull() & F.lit(x.kind != "regexp"), "null").otherwise(x.kind)
    t = F.schema_of_variant(x.column)
    out = F.when(t.isNull() | (t == "VOID"), "null")
    for kind, pattern in _VARIANTS.items():
        out = out.when(t.rlike(pattern), kind)
    return out.otherwise("object")


def as_any(x: Typed) -> Column:
    """The value as a variant."""
    if x.kind == "any":
        return x.column
    if x.kind == "null":
        return no_value()
    if x.kind == "number" and x.whole:
        return x.value.cast("bigint").cast("variant")
    if x.kind == "list":
        return F.transform(x.column, lambda v: as_any(x.item.at(v))).cast("variant") if x.item else x.column.cast("variant")
    return F.to_variant_object(x.column) if x.kind in STRUCTURED or x.kind == "duration" else x.column.cast("variant")


def _struct_kind(names: set[str]) -> str:
    if names == {"path", "display", "embed"}:
        return "link"
    if names >= {"path", "name", "basename", "folder"}:
        return "file"
    return "duration" if names == set(PARTS) else "object"


def typed(column: Column, t: T.DataType) -> Typed:
    if isinstance(t, T.BooleanType):
        return flag(column)
    if isinstance(t, T.NumericType):
        whole = isinstance(t, T.IntegralType)
        return Typed(column.cast("double"), "number", whole=whole, exact=column if whole else None)
    if isinstance(t, T.VariantType):
        return anything(column)
    if isinstance(t, T.DateType | T.TimestampType | T.TimestampNTZType):
        return Typed(column.cast("timestamp_ntz"), "date")
    if isinstance(t, T.ArrayType):
        model = typed(F.lit(None), t.elementType)
        if isinstance(t.elementType, T.NumericType):
            column = column.cast("array<double>")
        elif model.kind == "date":
            column = column.cast("array<timestamp_ntz>")
        return listed(column, model)
    if isinstance(t, T.StructType):
        return Typed(column, _struct_kind({f.name for f in t}), fields={f.name: typed(column.getField(f.name), f.dataType) for f in t})
    if isinstance(t, T.MapType):
        return Typed(column, "object", item=typed(F.lit(None), t.valueType), entries=True)
    return null() if isinstance(t, T.NullType) else Typed(column, "string")


def scope_of(frame: DataFrame) -> dict[str, Typed]:
    return {f.name: typed(F.col(f"`{f.name}`"), f.dataType) for f in frame.schema}


def display(x: Typed) -> Column:
    """Text of a value; integers of the data as they are, other whole numbers with one decimal place, null is empty, links show their display."""
    c = x.column
    if x.kind == "any":
        out = bound(x, _display_any)
    elif x.kind == "number" and x.whole:
        out = x.value.cast("string")
    elif x.kind == "number":
        out = F.when(c == F.floor(c), F.format_string("%.1f", c)).otherwise(c.cast("string"))
    elif x.kind == "date":
        out = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS")
    elif x.kind == "link":
        out = F.coalesce(c["display"], c["path"])
    elif x.kind == "regexp":
        out = F.lit(x.literal[0])
    elif x.kind == "list" and x.item and x.item.whole:
        out = F.to_json(c.cast("array<bigint>"))
    elif x.kind in STRUCTURED or x.kind in ("list", "duration"):
        out = F.to_json(c)
    else:
        out = c.cast("string")
    return F.coalesce(out, F.lit(""))


def _display_any(x: Typed) -> Column:
    kind, c = F.schema_of_variant(x.column), x.column
    dated, fraction = version(x, "date"), version(x, "number")
    whole = F.when(kind.isin("BIGINT", "STRING", "BOOLEAN"), F.try_variant_get(c, "$", "string"))
    return F.coalesce(whole, bound(fraction, lambda v: F.when(v.column.isNotNull(), display(v))), F.when(dated.column.isNotNull(), display(dated)), F.when(kind != "VOID", F.to_json(c)))


def truthy(x: Typed) -> Column:
    """Null, false, 0 and the empty string are false; every list and object is true."""
    if x.kind == "any":
        plain = lambda v: F.coalesce(*(F.when(p.column.isNotNull(), truthy(p)) for p in (version(v, k) for k in ("number", "string", "boolean"))), kind_name(v) != "null")
        return bound(x, plain)
    test = {"boolean": lambda c: c, "number": lambda c: c != 0, "string": lambda c: c != "", "regexp": lambda c: F.lit(True)}.get(x.kind, lambda c: c.isNotNull())
    return F.coalesce(test(x.column), F.lit(False))


def as_date(x: Typed) -> Column:
    """Dates, and texts that begin with one; the offset of an instant is dropped."""
    if x.kind == "date":
        return x.column
    if x.kind == "any":
        return bound(x, lambda v: F.coalesce(version(v, "date").column, as_date(version(v, "string"))))
    if x.kind != "string":
        return F.lit(None).cast("timestamp_ntz")
    stamp = F.regexp_extract(x.column, r"^(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?)", 1)
    day = F.regexp_extract(x.column, r"^(\d{4}-\d{2}-\d{2})", 1)
    return F.coalesce(F.when(stamp != "", stamp.try_cast("timestamp_ntz")), F.when(day != "", day.try_cast("timestamp_ntz")))


def millis(c: Column) -> Column:
    """Milliseconds since 1970 of a wall-clock time, whatever the session's zone."""
    clock = (F.hour(c) * 3600 + F.minute(c) * 60).cast("double") + F.extract(F.lit("SECOND"), c).cast("double")
    return F.unix_date(c.cast("date")).cast("double") * MILLIS["days"] + F.round(clock * 1000)


def as_duration(x: Typed) -> Typed | None:
    """Durations, and texts of one amount and unit."""
    if x.kind == "duration":
        return x
    if x.kind != "string":
        return None
    if x.literal is not None:
        m = re.match(_DURATION, x.literal)
        part = m and unit_of(m[2])
        return structure("duration", **{p: number(F.lit(float(m[1]) if p == part else 0.0)) for p in PARTS}) if part else None
    amount = F.regexp_extract(x.column, _DURATION, 1).try_cast("double")
    unit = F.regexp_extract(x.column, _DURATION, 2)
    unit = F.when(unit.isin(*SHORT_UNITS), unit).otherwise(F.regexp_replace(F.lower(unit), "s$", ""))
    names = {p: [k for k, v in SHORT_UNITS.items() if v == p] + [p[:-1]] for p in PARTS}
    known = amount.isNotNull() & unit.isin([n for v in names.values() for n in v])
    return structure("duration", **{p: number(F.when(known, F.when(unit.isin(names[p]), amount).otherwise(0.0))) for p in PARTS})


def unit_of(name: str) -> str | None:
    if name in SHORT_UNITS:
        return SHORT_UNITS[name]
    long = name.lower().removesuffix("s") + "s"
    return long if long in PARTS else None


def shifted(date: Column, by: Typed, sign: int) -> Column:
    """Months first, by the calendar, then all else by milliseconds."""
    part = lambda p: F.coalesce(by.fields[p].column, F.lit(0.0))
    months = F.round((part("years") * 12 + part("months")) * sign).cast("int")
    ms = F.lit(0.0)
    for p, size in MILLIS.items():
        ms = ms + part(p) * size
    moved = date + F.make_ym_interval(F.lit(0), months)
    return F.when(by.fields["days"].column.isNotNull(), moved + F.make_dt_interval(secs=(F.round(ms * sign) / 1000).cast("decimal(18,6)")))


def stem(path: Column) -> Column:
    """The last part of a path, without .md, by which links are compared."""
    return F.element_at(F.split(F.regexp_replace(path, r"(\.md)+$", ""), "/"), -1)


def path_of(x: Typed) -> Column | None:
    if x.kind == "string":
        return x.column
    return x.fields["path"].column if x.kind in STRUCTURED and "path" in x.fields and x.fields["path"].kind == "string" else None


def order(op: str, a: Typed, b: Typed) -> Column:
    if "any" in (a.kind, b.kind):
        return bound(a, lambda x: _order_any(op, x, b)) if a.kind == "any" else bound(b, lambda y: _order_any(op, a, y))
    apply = {">": lambda x, y: x > y, ">=": lambda x, y: x >= y, "<": lambda x, y: x < y, "<=": lambda x, y: x <= y, "=": lambda x, y: x == y}[op]
    if a.kind == b.kind and a.kind in ("number", "boolean"):
        out = apply(a.column, b.column)
    elif {a.kind, b.kind} <= {"date", "string"}:
        x, y = as_date(a), as_date(b)
        plain = apply(a.column, b.column) if a.kind == b.kind == "string" else F.lit(False)
        out = F.when(x.isNotNull() & y.isNotNull(), apply(x, y)).otherwise(plain)
    else:
        out = F.lit(False)
    return F.coalesce(out, F.lit(False))


def _order_any(op: str, a: Typed, b: Typed) -> Column:
    if b.kind == "any":
        return bound(b, lambda y: _order_pairs(op, a, y))
    return _order_pairs(op, a, b)


def _order_pairs(op: str, a: Typed, b: Typed) -> Column:
    """Of all pairs of versions one at most has values."""
    out = F.lit(False)
    for x in versions(a):
        for y in versions(b):
            if x.kind == y.kind != "list" or {x.kind, y.kind} == {"date", "string"}:
                out = out | order(op, x, y)
    return out


def equal(a: Typed, b: Typed) -> Column:
    if a.kind == "any" and "any" != b.kind != "null" and b.kind in _VARIANTS and b.kind != "list":
        return order("=", a, b)
    if "null" in (a.kind, b.kind):
        return (b if a.kind == "null" else a).column.isNull()
    if "any" in (a.kind, b.kind):
        x, y = (F.try_variant_get(v, "$.path", "string") for v in (as_any(a), as_any(b)))
        deep = (kind_name(a) == kind_name(b)) & kind_name(a).isin("list", "object", "link", "null", "boolean") & F.to_json(as_any(a)).eqNullSafe(F.to_json(as_any(b)))
        return deep | F.coalesce(stem(x) == stem(y), F.lit(False)) | order("=", a, b)
    if a.kind in STRUCTURED and b.kind in STRUCTURED:
        x, y = path_of(a), path_of(b)
        same = F.to_json(a.column).eqNullSafe(F.to_json(b.column)) if a.kind == b.kind else F.lit(False)
        return same if x is None or y is None else same | F.coalesce(stem(x) == stem(y), F.lit(False))
    if a.kind != b.kind:
        return order("=", a, b)
    if a.kind in ("list", "duration"):
        return F.to_json(a.column).eqNullSafe(F.to_json(b.column))
    return a.column.eqNullSafe(b.column) | order("=", a, b)


def coerced(x: Typed, kind: str) -> Column:
    """The Column as one of ``kind``; null where that is no such value."""
    if kind == "any":
        return as_any(x)
    if x.kind == kind:
        return x.column
    if x.kind == "any" and kind in ("number", "boolean"):
        return version(x, kind).column
    if kind == "string":
        return F.when(x.column.isNotNull(), display(x))
    if kind == "date":
        return as_date(x)
    sql = {"number": "double", "boolean": "boolean"}.get(kind, "string")
    return F.lit(None).cast(sql)


def together(items: list[Typed]) -> tuple[list[Column], Typed]:
    """Columns of one kind for the items, and a model of them."""
    kinds = {i.kind for i in items} - {"null"}
    if len(kinds) > 1:
        return [coerced(i, "string") for i in items], text("").at(F.lit(None))
    model = next((i for i in items if i.kind != "null"), null())
    return [i.column if i.kind != "null" else F.lit(None) for i in items], model


def _shape(x: Typed) -> tuple:
    """What two values must have in common to be in one Column."""
    inner = _shape(x.item) if x.item else ()
    return x.kind, x.whole, inner, tuple((k, _shape(f)) for k, f in x.fields.items()) if x.kind in STRUCTURED else ()


def united(items: list[Typed]) -> tuple[list[Column], Typed]:
    """Columns of one kind for the items, of kind any where they are of several, and a model of them."""
    if len({_shape(i) for i in items if i.kind != "null"}) > 1 or any(i.kind == "any" for i in items):
        return [as_any(i) for i in items], anything(no_value())
    return together(items)


def valid_pattern(pattern: str) -> bool:
    try:
        re.compile(re.sub(r"\(\?<(?![=!])", "(?P<", pattern))
    except re.error:
        return False
    return True


def java_pattern(literal: tuple[str, str]) -> str:
    pattern, flags = literal
    inline = "".join(f for f in "ims" if f in flags)
    return f"(?{inline}){pattern}" if inline else pattern


class Compiler:
    def __init__(self, scope: dict[str, Typed], now: str | None = None):
        self.scope = {k.lower(): v for k, v in scope.items()} | scope
        self.now = F.lit(now).cast("timestamp_ntz") if now else F.localtimestamp()

    def compile(self, source: str) -> Typed:
        self.tokens, self.place = self._tokens(source), 0
        out = self._or()
        if self.place < len(self.tokens):
            raise ExpressionError(f"unexpected {self.tokens[self.place][1]!r}")
        return out

    def _tokens(self, source: str) -> list[tuple[str, Any]]:
        out: list[tuple[str, Any]] = []
        at = 0
        while source[at:].strip():
            regex = _REGEX.match(source, at) if not out or (out[-1][0] in ("op", "name") and str(out[-1][1]).lower() in _BEFORE_REGEX) else None
            m = regex or _TOKEN.match(source, at)
            if not m:
                raise ExpressionError(f"cannot read {source[at:]!r}")
            out.append(("regex", (m[1], m[2])) if regex else (m.lastgroup or "", m[m.lastgroup or 0]))
            at = m.end()
        return out

    def _peek(self, ahead: int = 0) -> tuple[str, Any]:
        return self.tokens[self.place + ahead] if self.place + ahead < len(self.tokens) else ("end", "")

    def _take(self, *values: str) -> str | None:
        kind, value = self._peek()
        if kind in ("op", "name") and value.lower() in values:
            self.place += 1
            return value.lower()
        return None

    def _need(self, value: str) -> None:
        if not self._take(value):
            raise ExpressionError(f"{value!r} is missing before {self._peek()[1]!r}")

    def _or(self) -> Typed:
        out = self._and()
        while self._take("or", "||"):
            out = flag(truthy(out) | truthy(self._and()))
        return out

    def _and(self) -> Typed:
        out = self._not()
        while self._take("and", "&&"):
            out = flag(truthy(out) & truthy(self._not()))
        return out

    def _not(self) -> Typed:
        if self._take("not", "!"):
            return flag(~truthy(self._not()))
        left = self._sum()
        op = self._take(">=", "<=", "!=", "==", "=", ">", "<")
        if not op:
            return left
        right = self._sum()
        if op in ("=", "=="):
            return flag(equal(left, right))
        return flag(~equal(left, right) if op == "!=" else order(op, left, right))

    def _sum(self) -> Typed:
        out = self._product()
        while op := self._take("+", "-"):
            out = self.add(out, self._product()) if op == "+" else self.subtract(out, self._product())
        return out

    @staticmethod
    def add(a: Typed, b: Typed) -> Typed:
        if a.kind == b.kind == "duration":
            return structure("duration", **{p: number(a.fields[p].column + b.fields[p].column) for p in PARTS})
        if a.kind == b.kind == "number":
            return number(a.column + b.column)
        if "any" in (a.kind, b.kind):
            by = as_duration(b) if b.kind == "duration" or b.literal is not None else None
            if not by and not {a.kind, b.kind} <= {"number", "any"}:
                return Typed(F.concat(display(a), display(b)), "string")
            x, y = coerced(a, "number"), coerced(b, "number")
            joined = F.concat(display(a), display(b)).cast("variant")
            if by:
                joined = F.when(as_date(a).isNotNull(), shifted(as_date(a), by, 1).cast("variant")).otherwise(joined)
            return anything(F.when(x.isNotNull() & y.isNotNull(), (x + y).cast("variant")).otherwise(joined))
        by = as_duration(b) if b.kind == "duration" or b.literal is not None else None
        if by and (a.kind == "date" or (a.kind == "string" and b.kind == "duration")):
            return Typed(shifted(as_date(a), by, 1), "date")
        return Typed(F.concat(display(a), display(b)), "string")

    @staticmethod
    def subtract(a: Typed, b: Typed) -> Typed:
        if a.kind == b.kind == "duration":
            return structure("duration", **{p: number(a.fields[p].column - b.fields[p].column) for p in PARTS})
        if a.kind == b.kind == "number":
            return number(a.column - b.column)
        if "any" in (a.kind, b.kind) and "duration" not in (a.kind, b.kind):
            return number(F.coalesce(coerced(a, "number") - coerced(b, "number"), millis(as_date(a)) - millis(as_date(b))))
        by = as_duration(b) if b.kind == "duration" or b.literal is not None else None
        if by and a.kind in ("date", "string"):
            return Typed(shifted(as_date(a), by, -1), "date")
        return number(millis(as_date(a)) - millis(as_date(b))) if {a.kind, b.kind} <= {"date", "string"} else null()

    def _product(self) -> Typed:
        out = self._postfix()
        while op := self._take("*", "/", "%"):
            right = self._postfix()
            if op == "*" and out.kind == "duration" and right.kind == "number":
                out = structure("duration", **{p: number(out.fields[p].column * right.column) for p in PARTS})
            elif not {out.kind, right.kind} <= {"number", "any"}:
                out = null()
            else:
                a, b = coerced(out, "number"), coerced(right, "number")
                out = number(a * b if op == "*" else F.try_divide(a, b) if op == "/" else F.try_mod(a, b))
        return out

    def _arguments(self, end: str) -> list[Typed]:
        out: list[Typed] = []
        while not self._take(end):
            out.append(self._or())
            if not self._take(","):
                self._need(end)
                break
        return out

    def _postfix(self) -> Typed:
        out = self._primary()
        while True:
            if self._take("."):
                name = str(self._peek()[1])
                self.place += 1
                out = self.method(out, name.lower()) if self._take("(") else self.field(out, name)
            elif self._take("["):
                at = self._or()
                self._need("]")
                out = self.index(out, at)
            else:
                return out

    def field(self, x: Typed, name: str) -> Typed:
        if x.kind == "any":
            inner = F.try_variant_get(x.column, "$['" + name.replace("'", "") + "']", "variant")
            parts = [f.column for k in ("string", "list", "date") if (f := self.field(version(x, k), name)).kind == "number"]
            return anything(F.coalesce(F.coalesce(*parts).cast("variant"), inner)) if parts else anything(inner)
        if x.entries and x.item:
            return x.item.at(F.try_element_at(x.column, F.lit(name)))
        if x.kind in STRUCTURED or x.kind == "duration":
            return x.fields.get(name) or null()
        if name == "length" and x.kind in ("string", "list"):
            return number((F.char_length(x.column) if x.kind == "string" else F.size(x.column)).cast("double"))
        if x.kind != "date":
            return null()
        if name == "millisecond":
            return number(millis(x.column) % 1000)
        part = {"year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "second": F.second}.get(name)
        return number(part(x.column).cast("double")) if part else null()

    def index(self, x: Typed, at: Typed) -> Typed:
        if x.kind == "any":
            if at.literal is not None and at.kind == "string":
                return self.field(x, at.literal)
            x = version(x, "list")
        if x.kind == "list" and at.kind == "number" and x.item:
            i = at.column.cast("int")
            return x.item.at(F.when(i >= 0, F.try_element_at(x.column, i + 1)))
        if at.literal is not None and at.kind == "string":
            return self.field(x, at.literal) if x.kind in STRUCTURED else null()
        return x.item.at(F.try_element_at(x.column, at.column)) if x.entries and x.item and at.kind == "string" else null()

    def _list(self, items: list[Typed]) -> Typed:
        if not items:
            return listed(F.expr("cast(array() as array<string>)"), null())
        columns, model = united(items)
        return listed(F.array(*columns), model)

    def _object(self) -> Typed:
        fields: dict[str, Typed] = {}
        while not self._take("}"):
            kind, value = self._peek()
            if kind not in ("string", "name", "number"):
                raise ExpressionError(f"unexpected {value!r}")
            self.place += 1
            self._need(":")
            fields[value[1:-1] if kind == "string" else value] = self._or()
            if not self._take(","):
                self._need("}")
                break
        return structure("object", **fields) if fields else Typed(F.expr("cast(map() as map<string,string>)"), "object", item=null(), entries=True)

    def _primary(self) -> Typed:
        kind, value = self._peek()
        if self._take("("):
            out = self._or()
            self._need(")")
            return out
        if self._take("["):
            return self._list(self._arguments("]"))
        if self._take("{"):
            return self._object()
        if self._take("-"):
            x = self._postfix()
            return number(-coerced(x, "number")) if x.kind in ("number", "any") else null()
        self.place += 1
        if kind == "number":
            return Typed(F.lit(float(value)), "number", literal=float(value))
        if kind == "date":
            return Typed(F.lit(value).try_cast("timestamp_ntz"), "date")
        if kind == "string":
            return text(re.sub(r"\\(.)", r"\1", value[1:-1]))
        if kind == "regex":
            return Typed(F.lit(java_pattern(value)), "regexp", literal=value)
        if kind != "name":
            raise ExpressionError(f"unexpected {value!r}")
        if self._take("("):
            return self.function(value.lower())
        if value.lower() in ("true", "false"):
            return flag(F.lit(value.lower() == "true"))
        return null() if value.lower() == "null" else self.name(value)

    def name(self, value: str) -> Typed:
        return self.scope.get(value) or null()

    # ---- functions ----
    def function(self, name: str) -> Typed:
        args = self._arguments(")")
        a, b = (args + [null(), null()])[:2]
        if name == "if":
            (yes, no), model = united((args + [null(), null()])[1:3])
            return model.at(F.when(truthy(a), yes).otherwise(no))
        if name in ("max", "min"):
            numbers = [coerced(x, "number") for x in args if x.kind in ("number", "any")]
            pick = F.greatest if name == "max" else F.least
            return number(numbers[0] if len(numbers) == 1 else pick(*numbers)) if numbers else null()
        if name == "date":
            return Typed(as_date(a), "date")
        if name == "duration":
            return as_duration(a) or null()
        if name in ("now", "today"):
            return Typed(self.now if name == "now" else F.date_trunc("day", self.now).cast("timestamp_ntz"), "date")
        if name == "number":
            return self._number(a)
        if name == "length":
            if a.kind in STRUCTURED:
                return number((F.size(a.column) if a.entries else F.lit(len(a.fields))).cast("double"))
            if a.kind == "any":
                return number(F.coalesce(*(self.field(version(a, k), "length").column for k in ("string", "list")), F.lit(0.0)))
            return self.field(a, "length") if a.kind in ("string", "list") else number(F.lit(0.0))
        if name in ("contains", "icontains", "startswith", "endswith"):
            if name == "icontains":
                lower = lambda x: Typed(F.lower(version(x, "string").column), "string") if x.kind in ("string", "any") else x
                a, b = lower(a), lower(b)
            return flag(self.holds({"icontains": "contains"}.get(name, name), a, b))
        if name == "join":
            return self._join(a, b if len(args) > 1 else text(", "))
        if name == "list":
            if a.kind == "any":
                return listed(F.coalesce(version(a, "list").column, F.array(a.column)), anything(no_value()))
            return a if a.kind == "list" else self._list([a])
        if name == "escapehtml":
            out = display(a)
            for c, e in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
                out = F.replace(out, F.lit(c), F.lit(e))
            return Typed(out, "string")
        if name == "random":
            return number(F.rand())
        if name == "link":
            path = self._bare(a)
            return structure("link", path=path, display=Typed(display(b), "string") if len(args) > 1 else path, embed=flag(F.lit(False)))
        if name == "file":
            path = self._bare(a)
            return self.file_at(path.column) if path.kind == "string" else null()
        if name == "html":
            return structure("html", value=Typed(display(a), "string"))
        if name == "image":
            return structure("image", path=self._bare(a))
        return structure("icon", name=Typed(display(a), "string")) if name == "icon" else null()

    @staticmethod
    def _number(a: Typed) -> Typed:
        if a.kind == "any":
            return number(F.coalesce(*(Compiler._number(version(a, k)).column for k in ("number", "string", "boolean", "date"))))
        if a.kind == "date":
            return number(millis(a.column))
        if a.kind == "string":
            return number(F.trim(a.column).try_cast("double"))
        return number(a.column.cast("double")) if a.kind in ("number", "boolean") else null()

    @staticmethod
    def _bare(x: Typed) -> Typed:
        """The path of a link or file, or a text without the brackets and the display of a link."""
        if x.kind == "string":
            return Typed(F.trim(F.regexp_replace(x.column, r"^\s*\[\[([^|]*)(?:\|.*)?\]\]\s*$", "$1")), "string")
        path = path_of(x)
        return null() if path is None else Typed(path, "string")

    def file_at(self, path: Column) -> Typed:
        """The row's own file if that is its path; else path, name and basename alone."""
        last = F.element_at(F.split(path, "/"), -1)
        fields = {"path": Typed(path, "string"), "name": Typed(last, "string"), "basename": Typed(F.regexp_replace(last, r"(\.md)+$", ""), "string")}
        own = self.scope.get("file")
        if not own or own.kind != "file":
            return structure("file", **fields)
        here = F.coalesce(own.fields["path"].column == path, F.lit(False))
        merged = {k: v.at(F.when(here, v.column).otherwise(fields[k].column) if k in fields else F.when(here, v.column)) for k, v in own.fields.items()}
        return structure("file", **merged)

    def _join(self, a: Typed, sep: Typed) -> Typed:
        if a.kind == "any":
            of_list = self._join(version(a, "list"), sep).column
            return Typed(F.when(kind_name(a) == "list", of_list).otherwise(display(a)), "string")
        if a.kind != "list" or not a.item:
            return Typed(display(a), "string")
        return Typed(F.array_join(F.transform(a.column, lambda x: display(a.item.at(x))), sep.literal if sep.literal is not None else ", "), "string") if sep.literal is not None else Typed(
            F.concat_ws("", F.aggregate(F.transform(a.column, lambda x: display(a.item.at(x))), F.lit(None).cast("string"), lambda s, x: F.coalesce(F.concat(s, display(sep), x), x))), "string"
        )

    @staticmethod
    def holds(name: str, a: Typed, b: Typed) -> Column:
        if a.kind == "any":
            parts = (Compiler.holds(name, version(a, "string"), b), Compiler.holds(name, version(a, "list"), b))
            return parts[0] | parts[1]
        if a.kind == "string" and b.kind == "any":
            b = version(b, "string")
        if a.kind == "list" and name == "contains" and a.item:
            return F.coalesce(F.exists(a.column, lambda x: equal(a.item.at(x), b)), F.lit(False))
        if a.kind in STRUCTURED and name == "contains":
            if a.entries:
                return F.coalesce(F.map_contains_key(a.column, b.column), F.lit(False)) if b.kind == "string" else F.lit(False)
            return F.coalesce(b.column.isin(list(a.fields)), F.lit(False)) if b.kind == "string" and a.fields else F.lit(False)
        if a.kind != "string" or b.kind != "string":
            return F.lit(False)
        return F.coalesce(getattr(F, name)(a.column, b.column), F.lit(False))

    # ---- methods ----
    def method(self, x: Typed, name: str) -> Typed:
        if x.kind in ("list", "any") and name in ("filter", "map", "reduce"):
            return self._over_items(version(x, "list"), name)
        return self._called(x, name, self._arguments(")"))

    def _called(self, x: Typed, name: str, args: list[Typed]) -> Typed:
        a = args[0] if args else null()
        if x.kind == "any" and name not in ("istruthy", "istype", "tostring"):
            return self._called_any(x, name, args)
        if name == "istruthy":
            return flag(truthy(x))
        if name == "istype":
            return flag(F.coalesce(kind_name(x) == a.column, F.lit(False))) if a.kind == "string" else null()
        if name == "tostring":
            return Typed(display(x), "string")
        if name in ("containsall", "containsany") and x.kind in ("string", "list"):
            return self._contains_many(x, args, name == "containsall")
        if name in ("contains", "startswith", "endswith") and args and (x.kind == "string" or (x.kind == "list" and name == "contains")):
            return flag(self.holds(name, x, a))
        if name == "slice" and x.kind in ("string", "list"):
            return self._slice(x, args)
        if name == "join" and x.kind == "list":
            return self._join(x, a if args else text(","))
        apply = getattr(self, f"_{x.kind}_method", None) or (self._object_method if x.kind in STRUCTURED else None)
        return (apply(x, name, args, a) or null()) if apply else flag(F.lit(True)) if name == "isempty" else null()

    def _called_any(self, x: Typed, name: str, args: list[Typed]) -> Typed:
        """What the method gives in each row for the kind that its value has there; of kind any where these differ."""
        models: list[Typed] = []

        def result(value: Typed) -> Column:
            made = [(v, self._called(v, name, args)) for v in versions(value)]
            if name == "isempty":
                made.insert(0, (Typed(F.when(kind_name(value) == "null", True), "boolean"), flag(F.lit(True))))
            known = [(v, r) for v, r in made if r.kind != "null"]
            columns, model = united([r for _, r in known]) if known else ([], null())
            models.append(model)
            return F.coalesce(*(F.when(v.column.isNotNull(), c) for (v, _), c in zip(known, columns, strict=True))) if known else model.column

        column = bound(x, result)
        return models[0].at(column)

    def _contains_many(self, x: Typed, args: list[Typed], every: bool) -> Typed:
        """One list, or any number of values."""
        if len(args) == 1 and args[0].kind == "list" and args[0].item:
            wanted = args[0]
            test = F.forall if every else F.exists
            return flag(F.coalesce(test(wanted.column, lambda w: self.holds("contains", x, wanted.item.at(w))), F.lit(False)))
        out = F.lit(every)
        for y in args:
            test = self.holds("contains", x, y)
            out = (out & test) if every else (out | test)
        return flag(out)

    @staticmethod
    def _slice(x: Typed, args: list[Typed]) -> Typed:
        c = x.column
        size = F.char_length(c) if x.kind == "string" else F.size(c)
        bound = lambda v: F.least(F.greatest(F.when(v < 0, size + v).otherwise(v), F.lit(0)), size)
        start = bound(coerced(args[0], "number").cast("int")) if args else F.lit(0)
        end = bound(coerced(args[1], "number").cast("int")) if len(args) > 1 else size
        n = F.greatest(end - start, F.lit(0))
        return Typed(F.substring(c, start + 1, n), "string") if x.kind == "string" else listed(F.slice(c, start + 1, n), x.item)

    def _regexp_method(self, x: Typed, name: str, args: list[Typed], a: Typed) -> Typed | None:
        if name != "matches":
            return None
        if a.kind != "string" or not valid_pattern(x.literal[0]):
            return flag(F.lit(False))
        return flag(F.coalesce(F.regexp_like(a.column, x.column), F.lit(False)))

    def _date_method(self, x: Typed, name: str, args: list[Typed], a: Typed) -> Typed | None:
        c = x.column
        if name == "date":
            return Typed(F.date_trunc("day", c).cast("timestamp_ntz"), "date")
        if name == "time":
            return Typed(F.date_format(c, "HH:mm:ss"), "string")
        if name == "format" and isinstance(a.literal, str):
            return Typed(formatted(c, a.literal), "string")
        if name == "relative":
            return Typed(self._relative(c), "string")
        return flag(c.isNull()) if name == "isempty" else None

    def _relative(self, c: Column) -> Column:
        """Whole seconds, minutes, hours or days until now, by the largest that is not nought."""
        seconds = F.floor((millis(self.now) - millis(c)) / 1000)
        seconds = F.when(seconds < 0, F.ceil((millis(self.now) - millis(c)) / 1000)).otherwise(seconds)
        n = F.abs(seconds)
        size = F.when(n < 60, 1).when(n < 3600, 60).when(n < 86400, 3600).otherwise(86400)
        unit = F.when(n < 60, "second").when(n < 3600, "minute").when(n < 86400, "hour").otherwise("day")
        amount = F.floor(n / size).cast("long")
        words = F.concat(amount.cast("string"), F.lit(" "), unit, F.when(amount == 1, "").otherwise("s"))
        return F.when(seconds >= 0, F.concat(words, F.lit(" ago"))).otherwise(F.concat(F.lit("in "), words))

    def _number_method(self, x: Typed, name: str, args: list[Typed], a: Typed) -> Typed | None:
        c = x.column
        if name == "round":
            scale = F.pow(F.lit(10.0), coerced(a, "number").cast("int") if args else F.lit(0))
            return number(F.signum(c) * F.floor(F.abs(c) * scale + 0.5) / scale)
        simple = {"abs": lambda: F.abs(c), "ceil": lambda: F.ceil(c).cast("double"), "floor": lambda: F.floor(c).cast("double")}
        if name in simple:
            return number(simple[name]())
        if name == "tofixed":
            return Typed(fixed(c, int(a.literal) if isinstance(a.literal, float) else 0), "string")
        return flag(c.isNull()) if name == "isempty" else None

    def _string_method(self, x: Typed, name: str, args: list[Typed], a: Typed) -> Typed | None:
        c = x.column
        simple = {"lower": lambda: F.lower(c), "upper": lambda: F.upper(c), "reverse": lambda: F.reverse(c), "trim": lambda: F.trim(c)}
        if name in simple:
            return Typed(simple[name](), "string")
        if name == "isempty":
            return flag(F.coalesce(c, F.lit("")) == "")
        if name == "title":
            return Typed(F.array_join(F.transform(F.split(c, " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))), " "), "string")
        if name == "repeat":
            return Typed(F.repeat(c, coerced(a, "number").cast("int")), "string")
        if name == "replace" and args:
            return Typed(self._replaced(c, a, args[1] if len(args) > 1 else text("")), "string")
        if name == "split":
            if not args:
                return self._list([x])
            if a.kind == "regexp":
                parts = F.split(c, java_pattern(a.literal)) if valid_pattern(a.literal[0]) else F.array(c)
            else:
                parts = F.split(c, F.concat(F.lit("\\Q"), a.column if a.kind == "string" else F.lit(","), F.lit("\\E")))
            return listed(F.slice(parts, F.lit(1), coerced(args[1], "number").cast("int")) if len(args) > 1 else parts, text("").at(F.lit(None)))
        if name == "date":
            return Typed(as_date(x), "date")
        return Typed(formatted(as_date(x), a.literal), "string") if name == "format" and isinstance(a.literal, str) else None

    @staticmethod
    def _replaced(c: Column, pattern: Typed, by: Typed) -> Column:
        """A text everywhere; a regular expression at its first match, with the flag g at all."""
        new = by.column if by.kind == "string" else F.lit("")
        if pattern.kind == "string":
            return F.replace(c, pattern.column, new)
        if pattern.kind != "regexp" or not valid_pattern(pattern.literal[0]):
            return c
        escaped = F.replace(new, F.lit("\\"), F.lit("\\\\"))
        if "g" in pattern.literal[1]:
            return F.regexp_replace(c, pattern.column, escaped)
        at = F.regexp_instr(c, pattern.column)
        found = F.regexp_substr(c, pattern.column)
        return F.when(at == 0, c).otherwise(
            F.concat(F.substring(c, F.lit(1), at - 1), F.regexp_replace(found, pattern.column, escaped), F.substring(c, at + F.char_length(found), F.char_length(c)))
        )

    def _list_method(self, x: Typed, name: str, args: list[Typed], a: Typed) -> Typed | None:
        c = x.column
        if name == "isempty":
            return flag(F.coalesce(F.size(c) == 0, F.lit(True)))
        if name == "flat":
            if x.element == "any":
                return listed(F.flatten(F.transform(c, lambda v: F.coalesce(version(anything(v), "list").column, F.array(v)))), x.item)
            return listed(F.flatten(c), x.item.item) if x.element == "list" and x.item and x.item.item else x
        if name == "reverse":
            return listed(F.reverse(c), x.item)
        if name == "sort" and x.element == "any":
            return listed(sorted_any(c), x.item)
        if name == "sort":
            return listed(F.array_sort(c), x.item) if x.element in ("number", "string", "date", "boolean", "null") else x
        if name != "unique":
            return None
        if x.element == "any":
            first = lambda v, i: ~F.exists(F.slice(c, F.lit(1), i), lambda u: equal(anything(u), anything(v)))
            return listed(F.filter(c, first), x.item)
        if x.element in ("link", "object", "file") and x.item and path_of(x.item) is not None:
            # links to one note are one value; the first of them stays
            stems = lambda v: stem(F.coalesce(v["path"], F.lit("")))
            keep = F.filter(c, lambda v, i: ~F.exists(F.slice(c, F.lit(1), i), lambda u: stems(u) == stems(v)))
            return listed(keep, x.item)
        return listed(F.array_distinct(c), x.item)

    def _object_method(self, x: Typed, name: str, args: list[Typed], a: Typed) -> Typed | None:
        found = self._link_method(x, name, args, a) if x.kind == "link" else self._file_method(x, name, args, a) if x.kind == "file" else None
        if found:
            return found
        if x.entries and x.item:
            entries = {"keys": lambda: listed(F.map_keys(x.column), text("").at(F.lit(None))), "values": lambda: listed(F.map_values(x.column), x.item), "isempty": lambda: flag(F.size(x.column) == 0)}
            return entries[name]() if name in entries else None
        if name == "isempty":
            return flag(x.column.isNull() | F.lit(not x.fields))
        if name == "keys":
            return listed(F.array(*(F.lit(k) for k in sorted(x.fields))), text("").at(F.lit(None)))
        return self._list([x.fields[k] for k in sorted(x.fields)]) if name == "values" else None

    _html_method = _image_method = _icon_method = _object_method

    def _same_note(self, link: Typed, path: Column) -> Column:
        mine = path_of(link)
        return F.coalesce((mine == path) | (stem(mine) == stem(path)), F.lit(False)) if mine is not None else F.lit(False)

    def _links_to(self, file: Typed | None, to: Typed) -> Typed:
        links, path = (file.fields.get("links") if file else None), path_of(to)
        if not links or links.kind != "list" or not links.item or path is None:
            return flag(F.lit(False))
        return flag(F.coalesce(F.exists(links.column, lambda l: self._same_note(links.item.at(l), path)), F.lit(False)))

    def _link_method(self, x: Typed, name: str, args: list[Typed], a: Typed) -> Typed | None:
        if name == "asfile":
            return self.file_at(x.fields["path"].column)
        return self._links_to(self.scope.get("file"), a) if name == "linksto" else None

    def _file_method(self, x: Typed, name: str, args: list[Typed], a: Typed) -> Typed | None:
        path = x.fields["path"].column
        if name == "aslink":
            return structure("link", path=x.fields["path"], display=Typed(display(a), "string") if args else x.fields["name"], embed=flag(F.lit(False)))
        if name == "haslink":
            return self._links_to(x, a)
        if name == "infolder":
            return flag(F.coalesce((path == a.column) | F.startswith(path, F.concat(a.column, F.lit("/"))), F.lit(False))) if a.kind == "string" else flag(F.lit(False))
        if name == "hastag":
            tags = x.fields.get("tags")
            if not tags or tags.kind != "list":
                return flag(F.lit(False))
            bare = lambda t: F.regexp_replace(t, "^#+", "")
            out = F.lit(False)
            for q in args:
                if q.kind == "string":
                    wanted = bare(q.column)
                    out = out | F.coalesce(F.exists(tags.column, lambda t: (bare(t) == wanted) | F.startswith(bare(t), F.concat(wanted, F.lit("/")))), F.lit(False))  # noqa: B023
            return flag(out)
        if name == "hasproperty":
            known = x.fields.get("properties") or x.fields.get("frontmatter")
            if not known or a.kind != "string":
                return flag(F.lit(False))
            if known.entries:
                return flag(F.coalesce(F.map_contains_key(known.column, a.column), F.lit(False)))
            out = F.lit(False)
            for k, v in known.fields.items():
                out = out | ((a.column == k) & v.column.isNotNull())
            return flag(F.coalesce(out, F.lit(False)))
        return None

    def _over_items(self, x: Typed, name: str) -> Typed:
        """filter, map and reduce with the names value, index and acc."""
        body_at, model = self.place, x.item or null()

        def body(value: Column, index: Column, acc: Typed | None = None) -> Typed:
            outer, self.scope = self.scope, self.scope | {"value": model.at(value), "index": number(index.cast("double"))} | ({"acc": acc} if acc else {})
            self.place = body_at
            out = self._or()
            self.scope = outer
            return out

        if name == "filter":
            column = F.filter(x.column, lambda v, i: truthy(body(v, i)))
            self._need(")")
            return listed(column, model)
        if name == "map":
            made = body(model.column, F.lit(0))
            column = F.transform(x.column, lambda v, i: body(v, i).column)
            self._need(")")
            return listed(column, made)
        first = body(model.column, F.lit(0), number(F.lit(0.0)))
        none = no_value() if first.kind == "any" else F.lit(None).cast("string")
        start = self._or() if self._take(",") else Typed(F.lit(None).cast("double"), "number") if first.kind in ("number", "null") else first.at(none)
        if first.kind == "any" and start.kind != "any":
            start = anything(as_any(start))
        end = self.place
        indexed = F.transform(x.column, lambda v, i: F.struct(v.alias("v"), i.alias("i")))
        column = F.aggregate(indexed, start.column, lambda s, v: coerced(body(v["v"], v["i"], start.at(s)), start.kind))
        self.place = end
        self._need(")")
        return start.at(column)


def fixed(c: Column, digits: int) -> Column:
    """The number with so many decimal places: of its exact binary value, halves to the even digit.

    The fraction is a whole number of 2**-60ths and perhaps a rest, which only tells halves from
    more than halves; it is multiplied in whole numbers, so nothing is rounded before.
    """
    if digits > 18:
        return F.format_string(f"%.{digits}f", c)
    whole, power = lambda x: x.cast("decimal(38,0)"), F.lit(10**digits).cast("decimal(19,0)")
    one, half = (F.lit(1 << k).cast("decimal(19,0)") for k in (60, 59))

    def digits_of(size: Column) -> Column:
        units = (size - F.floor(size)) * F.lit(float(1 << 60))
        return F.get(F.transform(F.array(F.struct(F.floor(units).alias("parts"), (F.floor(units) != units).alias("more"))), lambda u: rounded(size, u)), F.lit(0))

    def rounded(size: Column, u: Column) -> Column:
        scaled = u["parts"].cast("decimal(19,0)") * power
        down = whole(F.call_function("div", scaled, one))
        even = F.struct(down.alias("down"), (scaled - down * one).alias("rest"), (whole(F.floor(size)) * power + down).alias("total"))
        total = lambda e: whole(e["total"] + F.when((e["rest"] > half) | ((e["rest"] == half) & (u["more"] | (e["total"] % 2 == 1))), 1).otherwise(0)).cast("string")
        return F.get(F.transform(F.transform(F.array(even), total), pointed), F.lit(0))

    def pointed(t: Column) -> Column:
        if not digits:
            return t
        padded = F.concat(F.repeat(F.lit("0"), F.greatest(F.lit(digits + 1) - F.length(t), F.lit(0))), t)
        return F.concat(F.substring(padded, F.lit(1), F.length(padded) - digits), F.lit("."), F.substring(padded, -digits, digits))

    def shown(x: Typed) -> Column:
        size = F.abs(x.column)
        text = F.concat(F.when(x.column < 0, "-").otherwise(""), F.get(F.transform(F.array(size), digits_of), F.lit(0)))
        return F.when(size < float(1 << 53), text).otherwise(F.format_string(f"%.{digits}f", x.column))

    return bound(number(c), shown)


def sorted_any(c: Column) -> Column:
    """Values of several kinds in order: each goes after the last one before it that is not greater; what cannot be compared is not greater."""

    def insert(done: Column, v: Column) -> Column:
        greater = F.transform(done, lambda u: order(">", anything(u), anything(v)))
        stays = F.coalesce(F.array_max(F.transform(greater, lambda g, i: F.when(~g, i + 1).otherwise(0))), F.lit(0))
        return F.concat(F.slice(done, F.lit(1), stays), F.array(v), F.slice(done, stays + 1, F.greatest(F.size(done) - stays, F.lit(0))))

    return F.aggregate(c, F.array().cast("array<variant>"), insert)


def formatted(c: Column, pattern: str) -> Column:
    """YYYY MM DD HH mm ss; all other characters stand for themselves."""
    out = [F.lit("")]
    for piece in re.split(r"(YYYY|MM|DD|HH|mm|ss)", pattern):
        java = {"YYYY": "yyyy", "MM": "MM", "DD": "dd", "HH": "HH", "mm": "mm", "ss": "ss"}.get(piece)
        if piece:
            out.append(F.date_format(c, java) if java else F.when(c.isNotNull(), piece))
    return F.concat(*out)


def compile_expression(source: str, frame: DataFrame, extra: dict[str, Typed] | None = None, now: str | None = None) -> Typed:
    return Compiler(scope_of(frame) | (extra or {}), now).compile(source)


def lenient(compile: Callable[[], Typed]) -> Typed:
    """Null for what is no expression."""
    try:
        return compile()
    except ExpressionError:
        return null()
