"""Table views (filters, formulas, sort, limit, summaries, groups) and TABLE/LIST/TASK queries over any DataFrame.

A row is a page: columns are its properties, ``path`` its file. Order is by the given keys, nulls
last, then by ``tie``, so that limits are deterministic.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mdspark.plans.expression import ExpressionError, Typed, as_date, coerced, compile_expression, display, lenient, listed, millis, scope_of, truthy
from mdspark.plans.groups import GroupCompiler, NeedsList, grouped_rows


def view_filter(spec: Any, frame: DataFrame, now: str | None = None) -> Column:
    """A text; a list, all of which hold; or {and: [...]}, {or: [...]}, {not: ...}. Other shapes hold."""
    if isinstance(spec, str):
        return truthy(compile_expression(spec, frame, now=now))
    if isinstance(spec, list):
        spec = {"and": spec}
    if not isinstance(spec, dict):
        return F.lit(True)
    out = F.lit(True)
    for key, parts in spec.items():
        tests = [view_filter(p, frame, now) for p in (parts if isinstance(parts, list) else [parts])]
        if key in ("and", "or", "not"):
            whole = F.lit(key == "and")
            for t in tests:
                whole = (whole & t) if key == "and" else (whole | t)
            out = out & (~whole if key == "not" else whole)
    return out


def summary(name: str, x: Typed) -> Column | None:
    """One of the named summaries, or None. Texts that begin with a date are dates where dates are compared."""
    c = x.column
    value = coerced(x, "number") if x.kind in ("number", "any") else F.lit(None).cast("double")
    date = as_date(x)
    if x.kind == "any":
        c = F.when(c.isNotNull(), display(x))
    span = F.max(millis(date)) - F.min(millis(date)) if x.kind in ("date", "string") else F.max(value) - F.min(value)
    blank = c.isNull() | (c == "") if x.kind == "string" else c.isNull()
    flag = c if x.kind == "boolean" else F.lit(None).cast("boolean")
    plain = c if x.kind in ("number", "string", "date", "boolean", "null", "any") else F.to_json(c)
    moment = c if x.kind in ("date", "string") else F.lit(None).cast("string")
    found = {
        "count": lambda: F.count("*"), "sum": lambda: F.coalesce(F.sum(value), F.lit(0.0)), "average": lambda: F.avg(value), "min": lambda: F.min(plain), "max": lambda: F.max(plain),
        "range": lambda: span, "median": lambda: F.median(value), "stddev": lambda: F.stddev_pop(value),
        "earliest": lambda: F.min_by(moment, date), "latest": lambda: F.max_by(moment, date), "checked": lambda: F.count_if(flag), "unchecked": lambda: F.count_if(~flag),
        "empty": lambda: F.count_if(blank), "filled": lambda: F.count_if(~blank), "unique": lambda: F.count_distinct(F.coalesce(F.to_json(F.struct(c)), F.lit("null"))),
    }.get(name.lower())
    return found() if found else None


def _comparison(keys: list[tuple[str, bool]]):
    """A comparator of structs by fields, each descending or not, nulls last."""

    def compare(a: Column, b: Column) -> Column:
        out = F.lit(0)
        for name, descending in reversed(keys):
            x, y = a[name], b[name]
            less, more = (1, -1) if descending else (-1, 1)
            out = F.when(x.isNull() & y.isNull(), out).when(x.isNull(), 1).when(y.isNull(), -1).when(x < y, less).when(x > y, more).otherwise(out)
        return out

    return compare


@dataclass
class View:
    filters: Any = None
    formulas: dict[str, str] = field(default_factory=dict)
    sort: list[tuple[str, str]] = field(default_factory=list)
    limit: int | None = None
    order: list[str] = field(default_factory=list)
    #: (property, summary): a named one, one of ``custom``, or else null.
    summaries: dict[str, str] = field(default_factory=dict)
    custom: dict[str, str] = field(default_factory=dict)
    group_by: str | None = None
    group_descending: bool = False
    now: str | None = None

    def _scope(self, frame: DataFrame) -> dict[str, Typed]:
        scope = scope_of(frame)
        made = {k.removeprefix("formula_"): v for k, v in scope.items() if k.startswith("formula_")}
        return {"formula": Typed(F.lit(None), "object", fields=made)} if made else {}

    def _value(self, source: str, frame: DataFrame) -> Typed:
        return lenient(lambda: compile_expression(source, frame, self._scope(frame), self.now))

    def calculated(self, frame: DataFrame) -> DataFrame:
        """Filters, then formulas in the order of their references. A formula that cannot be read is null, as is one that refers to itself."""
        if self.filters is not None:
            frame = frame.where(view_filter(self.filters, frame, self.now))
        waiting = dict(self.formulas)
        while waiting:
            free = [k for k, v in waiting.items() if not any(re.search(rf"formula\.{re.escape(o)}(?![\w-])", v) for o in waiting)]
            for name in free or list(waiting):
                frame = frame.withColumn(f"formula_{name}", self._value(waiting.pop(name), frame).value)
        return frame

    def _keys(self, frame: DataFrame) -> list[tuple[Column, bool]]:
        """Values by which rows are sorted, and whether downwards."""
        out = []
        for source, direction in self.sort:
            x = self._value(source, frame)
            if x.kind in ("number", "string", "date", "boolean"):
                out.append((x.column, direction.lower() == "desc"))
            elif x.kind == "any":  # numbers before all else
                out += [(key, direction.lower() == "desc") for key in (coerced(x, "number"), F.when(x.column.isNotNull(), display(x)))]
            elif x.kind != "null":
                out.append((F.to_json(x.column), direction.lower() == "desc"))
        return out

    def rows(self, frame: DataFrame, tie: str = "path") -> DataFrame:
        """Filters, formulas, sort and limit."""
        frame = self.calculated(frame)
        if self.sort or self.limit is not None:
            frame = frame.orderBy(*(c.desc_nulls_last() if down else c.asc_nulls_last() for c, down in self._keys(frame)), tie)
        return frame if self.limit is None else frame.limit(self.limit)

    def table(self, frame: DataFrame, tie: str = "path") -> DataFrame:
        """The columns of ``order``, each named by its path; without it all columns."""
        rows = self.rows(frame, tie)
        return rows.select(*(self._value(c, rows).value.alias(c) for c in self.order)) if self.order else rows

    def summarise(self, frame: DataFrame, tie: str = "path") -> DataFrame:
        """One row: a column for each ``property: summary``, over the limited rows.

        A custom summary is an expression over the list ``values``, in the order of the rows. What
        ``groups`` can compute as aggregates is; else the list is one value, as large as the
        limited rows.
        """
        rows = self.rows(frame, tie)
        keys = self._keys(rows)
        out, after = [], []
        for p, s in self.summaries.items():
            name, x = f"{p}_{s.lower()}", self._value(p, rows)
            named = summary(s, x)
            if named is not None:
                out.append(named.alias(name))
                after.append(F.col(f"`{name}`"))
            elif s in self.custom and (made := self._aggregated(self.custom[s], x, f"_s{len(after)}_")):
                out += made[0]
                after.append(made[1].alias(name))
            elif s in self.custom:
                item = F.struct(*(c.alias(f"k{k}") for k, (c, _) in enumerate(keys)), F.col(tie).alias("tie"), x.column.alias("v"))
                order = _comparison([*((f"k{k}", down) for k, (_, down) in enumerate(keys)), ("tie", False)])
                out.append(F.transform(F.array_sort(F.collect_list(item), order), lambda i: i["v"]).alias(name))
                values = listed(F.col(f"`{name}`"), x)
                after.append(lenient(lambda s=s, values=values: compile_expression(self.custom[s], rows, {"values": values}, self.now)).column.alias(name))
            else:
                out.append(F.lit(None).cast("string").alias(name))
                after.append(F.col(f"`{name}`"))
        return rows.agg(*out).select(*after)

    def _aggregated(self, source: str, x: Typed, prefix: str) -> tuple[list[Column], Column] | None:
        """Aggregates that a custom summary of ``x`` needs, and its value; None if it needs the list."""
        compiler = GroupCompiler("values", x, {}, self.now, prefix=prefix)
        try:
            made = compiler.compile(source)
        except (NeedsList, ExpressionError):
            return None
        return (compiler.aggregates, made.value) if compiler.aggregates else None

    def _group_key(self, frame: DataFrame) -> Column:
        x = self._value(self.group_by or "null", frame)
        if x.kind in ("number", "date", "any"):
            return F.when(x.column.isNotNull(), display(x)).otherwise("null")
        return F.coalesce(x.column if x.kind == "string" else x.column.cast("string") if x.kind in ("boolean", "null") else F.to_json(x.column), F.lit("null"))

    def grouped(self, frame: DataFrame, tie: str = "path") -> DataFrame:
        """The rows with ``key`` in front, in the order of the keys and then of the view; no group is brought together."""
        rows = self.rows(frame, tie)
        rows = rows.select(self._group_key(rows).alias("key"), "*")
        key = F.desc("key") if self.group_descending else F.asc("key")
        return rows.orderBy(key, *(c.desc_nulls_last() if down else c.asc_nulls_last() for c, down in self._keys(rows)), tie)

    def groups(self, frame: DataFrame, tie: str = "path") -> DataFrame:
        """(key, n, rows): the groups in the order of their keys, their rows in the order of the view.

        ``rows`` is one value a group, so the view needs a limit; ``grouped`` has the same rows
        without one, and ``counts`` their number.
        """
        if self.limit is None:
            raise ValueError("groups with their rows need a limit; use grouped() or counts()")
        rows = self.rows(frame, tie)
        keys = self._keys(rows)
        row = F.struct(*(self._value(c, rows).value.alias(c) for c in self.order or rows.columns))
        item = F.struct(*(c.alias(f"k{k}") for k, (c, _) in enumerate(keys)), F.col(tie).alias("tie"), row.alias("row"))
        order = _comparison([*((f"k{k}", down) for k, (_, down) in enumerate(keys)), ("tie", False)])
        out = rows.groupBy(self._group_key(rows).alias("key")).agg(F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(item), order), lambda i: i["row"]).alias("rows"))
        return out.orderBy(F.desc("key") if self.group_descending else F.asc("key"))

    def counts(self, frame: DataFrame, tie: str = "path") -> DataFrame:
        """(key, n): the groups in the order of their keys."""
        rows = self.rows(frame, tie)
        return rows.groupBy(self._group_key(rows).alias("key")).agg(F.count("*").alias("n")).orderBy(F.desc("key") if self.group_descending else F.asc("key"))


#: Words that begin a clause; of two words for groups.
_CLAUSES = ("FROM", "WHERE", "SORT", "LIMIT", "FLATTEN", "GROUP")


def _pieces(source: str) -> tuple[str, list[tuple[str, str]]]:
    """What stands before the first clause, and (name, text) of each; words inside quotes and brackets begin none."""
    words = re.findall(r"\"(?:\\.|[^\"])*\"|'(?:\\.|[^'])*'|[()\[\]{}]|[^\s\"'()\[\]{}]+|\s+|[\"']", source.strip())
    head, out, depth = "", [], 0
    for k, word in enumerate(words):
        depth += (word in "([{") - (word in ")]}") if len(word) == 1 else 0
        following = next((w for w in words[k + 1 :] if w.strip()), "")
        alone = (k == 0 or not words[k - 1].strip()) and (k + 1 == len(words) or not words[k + 1].strip())
        if not depth and alone and word.upper() in _CLAUSES and (word.upper() != "GROUP" or following.upper() == "BY"):
            out.append([word.upper(), ""])
        elif out:
            out[-1][1] += word if word.strip() else " "
        else:
            head += word if word.strip() else " "
    clauses = [(n, re.sub(r"(?i)^\s*by\s", "", t).strip() if n == "GROUP" else t.strip()) for n, t in out]
    return head.strip(), clauses


def _commas(text: str) -> list[str]:
    """Parts between commas that stand outside quotes and brackets."""
    out, depth, quote, last = [], 0, "", 0
    for k, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif c == "," and not depth:
            out.append(text[last:k].strip())
            last = k + 1
    return [*out, text[last:].strip()] if text[last:].strip() else out


def query(source: str, frame: DataFrame, tie: str = "path", now: str | None = None, tasks: DataFrame | None = None) -> DataFrame:
    """TABLE, LIST, CALENDAR or TASK query. FROM comes first; the other clauses run in the order they are written and may repeat.

    FROM takes "" for all, "prefix" of the path, or #tag for rows whose tags hold it. TASK reads
    ``tasks`` (path, line, ...) instead of the pages; FROM #tag finds none of them. GROUP BY gives
    (key, rows). What is asked of ``rows`` is computed as aggregates where it can be (see
    ``groups``); else, and where the rows themselves are shown, they are one value a group, which a
    LIMIT before it bounds.
    """
    head, clauses = _pieces(source)
    m = re.match(r"(TABLE|LIST|TASK|CALENDAR)\s*(WITHOUT\s+ID\b)?\s*(.*)$", head, re.I | re.S)
    if not m:
        raise ValueError(f"a query begins with TABLE, LIST, TASK or CALENDAR, not {head!r}")
    ties = [tie]
    if m[1].upper() == "TASK":
        if tasks is None:
            raise ValueError("a TASK query needs the tasks")
        frame, ties = tasks, [tie, "line"]
    for name, text in clauses:
        if name == "FROM":
            wanted = text.strip().strip("\"'")
            if wanted.startswith("#"):
                tags = compile_expression("file.tags", frame) if "file" in frame.columns else compile_expression("tags", frame)
                known = tags.kind == "list" and m[1].upper() != "TASK"
                frame = frame.where(F.array_contains(tags.column, wanted[1:]) | F.array_contains(tags.column, wanted) if known else F.lit(False))
            elif wanted:
                frame = frame.where(F.startswith(F.col("path"), F.lit(wanted)))
    grouped = False
    for at, (name, text) in enumerate(clauses):
        value = lambda e: compile_expression(e, frame, now=now)  # noqa: E731, B023
        if name == "WHERE":
            frame = frame.where(truthy(value(text)))
        elif name == "SORT":
            keys = _sort_keys(text, value)
            frame = frame.orderBy(*keys, *(["_text"] if grouped else ties))
        elif name == "LIMIT":
            frame = frame.limit(int(text))
        elif name == "FLATTEN":
            e, _, alias = re.match(r"(.*?)(\s+AS\s+([\w-]+))?$", text, re.I).groups()
            x = value(e)
            frame = frame.withColumn(alias or e, F.explode(x.column if x.kind == "list" else F.array(x.column)))
        elif name == "GROUP":
            key = value(text)
            as_text = F.coalesce(F.to_json(F.struct(key.column.alias("k"))), F.lit("{}"))
            if m[3].strip() and not grouped:
                try:
                    return grouped_rows(frame, key, as_text, ties, now, clauses[at + 1 :], _named(m[3]), _sort_keys)
                except NeedsList:
                    pass
            rest = [c for c in frame.columns if c not in ties and c != "_text"]
            rows = F.collect_list(F.struct(*([] if grouped else ties), *rest))
            rows = F.sort_array(rows) if grouped else F.array_sort(rows, _comparison([(t, False) for t in ties]))
            frame = frame.groupBy(as_text.alias("_text")).agg(F.first(key.value).alias("key"), rows.alias("rows")).orderBy("_text")
            grouped = True
    shown = [c for c in frame.columns if c != "_text"]
    if not m[3].strip() or m[1].upper() == "TASK":
        return frame.select(*(F.col(f"`{c}`") for c in shown))
    return frame.select(*(compile_expression(e, frame, now=now).value.alias(name) for e, name in _named(m[3])))


def _named(text: str) -> list[tuple[str, str]]:
    """(expression, name) of each part of a projection."""
    parts = (re.match(r"(.*?)(\s+AS\s+(.+))?$", part, re.I | re.S).groups() for part in _commas(text))
    return [(e, (alias or e).strip("\"'")) for e, _, alias in parts]


def _sort_keys(text: str, value: Callable[[str], Typed]) -> list[Column]:
    """Keys of a SORT clause; ``value`` compiles an expression."""
    keys = []
    for part in _commas(text):
        x = value(re.sub(r"\s+(ASC|DESC)(ENDING)?$", "", part, flags=re.I))
        plain = [coerced(x, "number"), F.when(x.column.isNotNull(), display(x))] if x.kind == "any" else [x.column if x.kind in ("number", "string", "date", "boolean", "null") else F.to_json(x.column)]
        keys += [c.desc_nulls_last() if re.search(r"\sDESC(ENDING)?$", part, re.I) else c.asc_nulls_last() for c in plain]
    return keys
