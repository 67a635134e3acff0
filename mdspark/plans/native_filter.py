"""Predicates over note properties, compiled to one boolean Column.

    expr  := and-expr ("or" and-expr)* ; and-expr := unary ("and" unary)*
    unary := "not" unary | "(" expr ")" | path ("exists" | "missing" | operator value)

Properties are the fields of a JSON document (column frontmatter_json) or, without that column,
the columns of the table. Words are whole words here, so a path may begin with ``not``.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mdspark.sources.yaml_subset import PropertyError, scalar

_TOKEN = re.compile(r"""\s*(?:(?P<op>>=|<=|!=|==|=|>|<)|(?P<paren>[()])|(?P<list>\[(?:"(?:\\.|[^"])*"|'[^']*'|[^\[\]])*\]|\{[^{}]*\})|(?P<text>"(?:\\.|[^"])*"|'[^']*')|(?P<word>[^\s()=!<>]+))""")
_WORDS = ("contains_all", "starts_with", "ends_with", "contains", "overlaps", "matches", "in")
_DAY, _INSTANT = r"^\d{4}-\d{2}-\d{2}$", r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"


class FilterError(ValueError):
    pass


@dataclass
class _Properties:
    """How a path becomes typed Columns."""

    frame: DataFrame

    def __post_init__(self) -> None:
        self.json = "frontmatter_json" in self.frame.columns
        self.types = {f.name: f.dataType for f in self.frame.schema}

    def _path(self, path: str) -> str:
        parts = re.findall(r"[^.\[\]]+|\[\d+\]", path)
        return "$" + "".join(p if p[0] == "[" else f"['{p}']" for p in parts)

    def variant(self, path: str) -> Column:
        document = F.try_parse_json(F.col("frontmatter_json"))
        return F.try_variant_get(document, self._path(path), "variant")

    def get(self, path: str, kind: str) -> Column:
        """The value as string, double, boolean or array<string>, null if it is of another kind."""
        if self.json:
            v = self.variant(path)
            shape = F.schema_of_variant(v)
            is_kind = {"string": shape == "STRING", "boolean": shape == "BOOLEAN", "array": shape.startswith("ARRAY"), "double": shape.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT|SMALLINT|TINYINT)")}[kind]
            target = "array<string>" if kind == "array" else kind
            return F.when(is_kind, F.try_variant_get(F.try_parse_json(F.col("frontmatter_json")), self._path(path), target))
        if path not in self.types:
            return F.lit(None).cast("array<string>" if kind == "array" else kind)
        have = self.types[path]
        same = {"string": T.StringType, "boolean": T.BooleanType, "array": T.ArrayType, "double": T.NumericType}[kind]
        target = "array<string>" if kind == "array" else kind
        return F.col(path).cast(target) if isinstance(have, same) else F.lit(None).cast(target)

    def exists(self, path: str) -> Column:
        if self.json:
            return self.variant(path).isNotNull()
        return F.col(path).isNotNull() if path in self.types else F.lit(False)

    def integral(self, path: str) -> Column:
        if self.json:
            return F.schema_of_variant(self.variant(path)) == "BIGINT"
        return F.lit(isinstance(self.types.get(path), T.IntegralType))


def _text(x: Any) -> str:
    return x if isinstance(x, str) else json.dumps(x)


def _equal(p: _Properties, path: str, value: Any) -> Column:
    """JSON equality: an integer is not a float."""
    if value is None:
        return (F.schema_of_variant(p.variant(path)) == "VOID") if p.json else F.lit(False)
    if isinstance(value, bool):
        return p.get(path, "boolean") == value
    if isinstance(value, int | float):
        whole = p.integral(path)
        return (p.get(path, "double") == float(value)) & (whole if isinstance(value, int) else ~whole)
    if isinstance(value, list):
        return p.get(path, "array") == F.array(*(F.lit(_text(x)) for x in value))
    return p.get(path, "string") == value


def _compare(p: _Properties, path: str, op: str, value: Any) -> Column:
    apply = {">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b}[op]
    if isinstance(value, bool) or value is None or isinstance(value, list):
        return F.lit(False)
    if isinstance(value, int | float):
        return apply(p.get(path, "double"), F.lit(float(value)))
    s = p.get(path, "string")
    if re.match(_INSTANT, value):
        instants = apply(F.try_to_timestamp(s), F.try_to_timestamp(F.lit(value)))
        return F.when(s.rlike(_INSTANT), instants).otherwise(apply(s, F.lit(value)))
    return apply(s, F.lit(value))  # whole days in this form order as text


def _predicate(p: _Properties, path: str, op: str, raw: str) -> Column:
    try:
        value = scalar(raw)
    except PropertyError:
        value = raw
    text, items = p.get(path, "string"), p.get(path, "array")
    if op in ("=", "=="):
        return _equal(p, path, value)
    if op == "!=":
        return ~F.coalesce(_equal(p, path, value), F.lit(False))
    if op in (">", ">=", "<", "<="):
        return _compare(p, path, op, value)
    if op == "contains":
        inside = F.array_contains(items, _text(value))
        return F.coalesce(inside, F.contains(text, F.lit(value)) if isinstance(value, str) else F.lit(False), F.lit(False)) if not p.json else F.coalesce(
            inside, F.contains(text, F.lit(value)) if isinstance(value, str) else F.lit(None).cast("boolean"), F.try_variant_get(p.variant(path), p._path(_text(value)), "variant").isNotNull()
        )
    if op in ("contains_all", "overlaps"):
        if not isinstance(value, list):
            return F.lit(False)
        tests = [F.array_contains(items, _text(x)) for x in value]
        out = F.lit(op == "contains_all")
        for t in tests:
            out = (out & t) if op == "contains_all" else (out | t)
        return items.isNotNull() & out
    if op == "in":
        out = F.lit(False)
        for x in value if isinstance(value, list) else []:
            out = out | F.coalesce(_equal(p, path, x), F.lit(False))
        return out
    if op == "starts_with":
        return F.startswith(text, F.lit(_text(value)))
    if op == "ends_with":
        return F.endswith(text, F.lit(_text(value)))
    try:
        re.compile(_text(value))
    except re.error as e:
        raise FilterError(f"invalid pattern {value!r}: {e}") from e
    pattern = "(?U)" + _text(value)
    return F.coalesce(text.rlike(pattern), F.exists(items, lambda x: x.rlike(pattern)))


def compile_filter(source: str, frame: DataFrame) -> Column:
    """A Column without nulls. Rows without a property document never match."""
    tokens: list[tuple[str, str]] = []
    at = 0
    while source[at:].strip():
        m = _TOKEN.match(source, at)
        if not m:
            raise FilterError(f"cannot read {source[at:]!r}")
        tokens.append((m.lastgroup or "", m[m.lastgroup or 0]))
        at = m.end()
    p, place = _Properties(frame), 0

    def peek() -> tuple[str, str]:
        return tokens[place] if place < len(tokens) else ("end", "")

    def take() -> tuple[str, str]:
        nonlocal place
        place += 1
        return tokens[place - 1] if place <= len(tokens) else ("end", "")

    def word(*names: str) -> bool:
        kind, value = peek()
        if kind == "word" and value.lower() in names:
            take()
            return True
        return False

    def any_of() -> Column:
        out = all_of()
        while word("or"):
            out = out | all_of()
        return out

    def all_of() -> Column:
        out = unary()
        while word("and"):
            out = out & unary()
        return out

    def unary() -> Column:
        if word("not"):
            return ~unary()
        if peek() == ("paren", "("):
            take()
            out = any_of()
            if take() != ("paren", ")"):
                raise FilterError("missing )")
            return out
        kind, path = take()
        if kind != "word":
            raise FilterError(f"a property is needed, not {path!r}")
        if word("exists"):
            return p.exists(path)
        if word("missing"):
            return ~p.exists(path)
        kind, op = take()
        if kind == "word" and op.lower() in _WORDS:
            op = op.lower()
        elif kind != "op":
            raise FilterError(f"an operator is needed after {path!r}")
        kind, raw = take()
        if kind not in ("word", "text", "list"):
            raise FilterError(f"a value is needed after {op!r}")
        return F.coalesce(_predicate(p, path, op, raw), F.lit(False))

    out = any_of()
    if peek()[0] != "end":
        raise FilterError(f"unexpected {peek()[1]!r}")
    return out & F.col("frontmatter_json").isNotNull() if p.json else out
