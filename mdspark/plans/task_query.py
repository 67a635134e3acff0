"""The line-based task query language: every line a filter, a sort, a limit or a group."""

from __future__ import annotations

import calendar
import datetime as dt
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from mdspark.operators.tasks import PRIORITY_GROUPS, TYPE_NAMES, random_key, urgency
from mdspark.plans.expression import ExpressionError, Typed, truthy, valid_pattern
from mdspark.plans.script import FIELDS, Script, compile_script

_DATES = {"due": "due", "scheduled": "scheduled", "start": "start", "starts": "start", "done": "completion", "created": "created", "cancelled": "cancelled"}
_TEXTS = {
    "description": "description", "descriptionwithouttags": "description_without_tags", "path": "path", "root": "file.root", "folder": "file.folder", "filename": "file.filename",
    "heading": "heading", "tags": "tags", "tag": "tags", "id": "id", "recurrence": "recurrence", "oncompletion": "on_completion", "status.name": "status_name",
}
_BOTH = {"done": "completion", "starts": "start", "root": "file.root", "folder": "file.folder", "tag": "tags#1", "status.name": "status_name"}
_SORTS = _BOTH | {"status": "is_done", "status.type": "status_type_group", "recurring": "is_recurring", "filename": "file.filename"}
_GROUPS = _BOTH | {"status": "status_group", "status.type": "status_type", "priority": "priority_group", "recurring": "recurring_group", "recurrence": "recurrence_group", "filename": "file.filename_without_extension", "tag": "tags"}
_DATE_COLUMNS = {"due", "scheduled", "start", "completion", "created", "cancelled", "happens"}
#: Fixed value: the order of groups by the type of status.
_TYPES = ["IN_PROGRESS", "TODO", "ON_HOLD", "DONE", "CANCELLED", "NON_TASK"]
_MONTHS = [m.lower() for m in calendar.month_name]
_DAYS = [d.lower() for d in calendar.day_name]
_UNITS = {"day": 1, "week": 7}


#: Fixed value: the endings of a day's number.
_ORDINAL = re.compile(r"\b(\d{1,2})(st|nd|rd|th)\b")


def english_date(text: str, today: dt.date) -> dt.date | None:
    """A day in words: ``20 June 2026``, ``June 20th``, ``20/6/2026``, ``next friday``, ``2 weeks ago``, ``in 3 days``."""
    text = _ORDINAL.sub(r"\1", re.sub(r"[,\s]+", " ", text.strip().lower()))
    month = lambda name: next((k for k in range(1, 13) if len(name) >= 3 and _MONTHS[k].startswith(name)), None)
    try:
        if m := re.fullmatch(r"(\d{1,2}) (?:of )?([a-z]+)(?: (\d{4}))?", text):
            if k := month(m[2]):
                return dt.date(int(m[3] or today.year), k, int(m[1]))
        if m := re.fullmatch(r"([a-z]+) (\d{1,2})(?: (\d{4}))?", text):
            if k := month(m[1]):
                return dt.date(int(m[3] or today.year), k, int(m[2]))
        if m := re.fullmatch(r"(\d{1,2})/(\d{1,2})/(\d{4})", text):
            return dt.date(int(m[3]), int(m[2]), int(m[1]))
        if m := re.fullmatch(r"(?:(next|last|this) )?([a-z]{3,})", text):
            names = [k for k, d in enumerate(_DAYS) if d.startswith(m[2])]
            if names:
                ahead = (names[0] - today.weekday()) % 7
                if m[1] == "last":
                    return today + dt.timedelta(days=ahead - 7)
                return today + dt.timedelta(days=ahead or (7 if m[1] == "next" else 0))
        if m := re.fullmatch(r"(in )?(\d+) (day|week|month|year)s?( ago| hence)?", text):
            n = int(m[2]) * (-1 if m[4] == " ago" else 1)
            if m[3] in _UNITS:
                return today + dt.timedelta(days=n * _UNITS[m[3]])
            y, k = divmod(today.year * 12 + today.month - 1 + n * (12 if m[3] == "year" else 1), 12)
            return dt.date(y, k + 1, min(today.day, calendar.monthrange(y, k + 1)[1]))
    except (ValueError, OverflowError):
        return None
    return None


def date_range(text: str, today: dt.date) -> tuple[dt.date, dt.date] | None:
    """First and last day of a date, a range of two, a week, month, quarter or year, or a relative name."""
    text = text.strip().lower()
    if m := re.fullmatch(r"(\d{4}-\d{2}-\d{2})(?:\s+(\d{4}-\d{2}-\d{2}))?", text):
        days = []
        for d in filter(None, m.groups()):
            try:
                days.append(dt.date.fromisoformat(d))
            except ValueError:
                pass
        return (min(days), max(days)) if days else None
    if m := re.fullmatch(r"(\d{4})-w(\d{2})", text):
        try:
            first = dt.date.fromisocalendar(int(m[1]), int(m[2]), 1)
        except ValueError:
            return None
        return first, first + dt.timedelta(days=6)
    months = lambda y, a, b: (dt.date(y, a, 1), dt.date(y, b, calendar.monthrange(y, b)[1]))
    if (m := re.fullmatch(r"(\d{4})-q([1-4])", text)) and int(m[1]):
        return months(int(m[1]), 3 * int(m[2]) - 2, 3 * int(m[2]))
    if m := re.fullmatch(r"(\d{4})-(\d{2})", text):
        return months(int(m[1]), int(m[2]), int(m[2])) if int(m[1]) and 1 <= int(m[2]) <= 12 else None
    if re.fullmatch(r"\d{4}", text):
        return months(int(text), 1, 12) if int(text) else None
    near = {"yesterday": -1, "today": 0, "tomorrow": 1}
    if text in near:
        day = today + dt.timedelta(days=near[text])
        return day, day
    if m := re.fullmatch(r"(last|this|next) (week|month|quarter|year)", text):
        step = {"last": -1, "this": 0, "next": 1}[m[1]]
        if m[2] == "week":
            first = today - dt.timedelta(days=today.weekday()) + dt.timedelta(weeks=step)
            return first, first + dt.timedelta(days=6)
        if m[2] == "year":
            return months(today.year + step, 1, 12)
        size = 1 if m[2] == "month" else 3
        y, k = divmod(today.year * 12 // size + (today.month - 1) // size + step, 12 // size)
        return months(y, k * size + 1, k * size + size)
    day = english_date(text, today)
    return (day, day) if day else None


@dataclass
class Plan:
    """What the lines of a query ask for."""

    filters: list[Column] = field(default_factory=list)
    sorts: list[Column] = field(default_factory=list)
    groups: list[tuple[Column, Column, bool]] = field(default_factory=list)
    limit: int | None = None
    group_limit: int | None = None


@dataclass
class TaskQuery:
    """A query; ``diagnostics`` has the lines that could not be read. A filter that could not be read matches nothing.

    ``current`` is the path of the note the query stands in, ``global_query`` comes before the
    query unless that has the line ``ignore global query``. ``functions`` are Python callables
    from a row's Columns to a Column, by the names that ``by function`` lines give.
    """

    source: str
    today: dt.date
    current: str = ""
    global_query: str = ""
    functions: dict[str, Script] = field(default_factory=dict)
    diagnostics: list[str] = field(default_factory=list)

    def lines(self) -> list[str]:
        """Comments out, placeholders filled in, lines that end with a backslash joined to the next."""
        text = re.sub(r"\{\{!.*?\}\}", "", self.source, flags=re.S)
        alone = any(x.strip().lower() == "ignore global query" for x in text.split("\n"))
        if self.global_query and not alone:
            text = re.sub(r"\{\{!.*?\}\}", "", self.global_query, flags=re.S) + "\n" + text
        for name, value in self.file().items():
            text = text.replace("{{query.file." + name + "}}", value)
        out = (x.strip() for x in re.sub(r"[ \t]*\\\n\s*", " ", text).split("\n"))
        return [x for x in out if x and x[0] != "#" and x.lower() != "ignore global query" and not re.match(r"(?i)(hide|show|short|full|explain)\b", x)]

    def file(self) -> dict[str, str]:
        """The parts of the current note's path."""
        folder, slash, last = self.current.rpartition("/")
        bare = lambda p: re.sub(r"(\.md)+$", "", p)
        return {
            "path": self.current, "pathWithoutExtension": bare(self.current), "filename": last, "filenameWithoutExtension": bare(last),
            "folder": folder + "/" if slash else "/", "root": self.current.partition("/")[0] + "/" if slash else "/",
        }

    def plan(self, tasks: DataFrame) -> Plan:
        """``tasks`` have urgency and random."""
        self.diagnostics.clear()
        out = Plan()
        for line in self.lines():
            low = line.lower()
            if m := re.fullmatch(r"(?is)(filter|sort|group) by function( reverse)?\s+(.+)", line):
                self._by_function(out, tasks, m[1].lower(), bool(m[2]), m[3], line)
            elif m := re.fullmatch(r"sort by ([\w.#-]+(?: \d+)?)( reverse)?", low):
                out.sorts += self._sort(tasks, re.sub(r" (\d+)$", r"#\1", m[1]), bool(m[2]), line)
            elif m := re.fullmatch(r"limit groups (?:to )?(\d+)(?: tasks?)?", low):
                out.group_limit = int(m[1])
            elif m := re.fullmatch(r"limit (?:to )?(\d+)(?: tasks?)?", low):
                out.limit = int(m[1])
            elif m := re.fullmatch(r"group by ([\w.#-]+)( reverse)?", low):
                found = self._group(tasks, m[1], line)
                if found:
                    out.groups.append((*found, bool(m[2]) != (m[1] == "urgency")))
            else:
                self.frame = tasks
                out.filters.append(self.condition(line))
        if out.group_limit is not None and not out.groups:
            self.diagnostics.append("limit groups: there are no groups")
        return out

    def run(self, tasks: DataFrame) -> DataFrame:
        """The rows in order. With groups, a row for each group a task is in, group_0, group_1, ... in front of it."""
        day = self.today.isoformat()
        tasks = tasks.withColumn("urgency", urgency(day)).withColumn("random", random_key(day))
        plan = self.plan(tasks)
        for test in plan.filters:
            tasks = tasks.where(test)
        keys = [*plan.sorts, F.asc("status_type_group"), F.desc("urgency"), F.asc_nulls_last("due"), F.asc("priority_number"), F.asc("path"), F.asc("line")]
        if plan.limit is not None:
            tasks = tasks.orderBy(*keys).limit(plan.limit)
        if not plan.groups:
            return tasks.orderBy(*keys)
        names = [f"group_{k}" for k in range(len(plan.groups))]
        order = []
        for name, (values, rank, reverse) in zip(names, plan.groups, strict=True):
            tasks = tasks.withColumn(name, F.explode(values)).withColumn(f"_{name}", rank(F.col(name)))
            order += [F.desc(f"_{name}") if reverse else F.asc(f"_{name}")]
        if plan.group_limit is not None:
            nth = F.row_number().over(Window.partitionBy(*names).orderBy(*keys))
            tasks = tasks.withColumn("_k", nth).where(F.col("_k") <= plan.group_limit).drop("_k")
        return tasks.orderBy(*order, *keys).drop(*(f"_{n}" for n in names))

    # ---- values ----
    def _by_function(self, out: Plan, tasks: DataFrame, what: str, reverse: bool, source: str, line: str) -> None:
        try:
            x = compile_script(self.functions.get(source.strip(), source), tasks, self.today.isoformat(), self.file())
        except ExpressionError as error:
            self.diagnostics.append(f"not understood: {line} ({error})")
            if what == "filter":
                out.filters.append(F.lit(False))
            return
        if what == "filter":
            out.filters.append(truthy(x) if x.kind == "boolean" else F.lit(False))
        elif what == "sort":
            out.sorts += self._keys(x.column if x.kind in ("number", "string", "boolean", "date") else F.to_json(x.column) if x.kind != "null" else F.lit(None).cast("string"), reverse)
        else:
            if x.kind == "list":
                empty = F.array(F.lit("(No tags)"))
                values = F.transform(x.column, lambda v: _label(x.item.at(v) if x.item else Typed(v, "string")))
                values = F.when(F.size(values) > 0, values).otherwise(empty)
            else:
                values = F.array(F.coalesce(_label(x), F.lit("")))
            out.groups.append((values, lambda v: v, reverse))

    def _value(self, tasks: DataFrame, name: str, names: dict[str, str]) -> tuple[Column, T.DataType, str] | None:
        """The Column of a field, its type and its column's name; #N takes the Nth of a list. None for what no task has."""
        path, _, nth = names.get(name, name).partition("#")
        known = {k.lower(): v for k, v in FIELDS.items()} | {c.lower(): c for c in tasks.columns}
        path = known.get(path, path)
        head, _, rest = path.partition(".")
        kind: T.DataType
        if head in tasks.columns and not rest:
            kind, column = tasks.schema[head].dataType, F.col(f"`{head}`")
        elif head in tasks.columns and isinstance(tasks.schema[head].dataType, T.StructType) and rest in tasks.schema[head].dataType.names:
            kind, column = tasks.schema[head].dataType[rest].dataType, F.col(head).getField(rest)
        elif "fields" in tasks.columns and tasks.where(F.map_contains_key("fields", F.lit(path))).limit(1).count():
            kind, column = T.StringType(), F.try_element_at(F.col("fields"), F.lit(path))
        else:
            return None
        if nth:
            if not isinstance(kind, T.ArrayType) or nth == "0":
                return F.lit(None).cast("string"), T.StringType(), path
            kind, column = kind.elementType, F.try_element_at(column, F.lit(int(nth)))
        return column, kind, path

    @staticmethod
    def _keys(c: Column, reverse: bool) -> list[Column]:
        return [c.desc_nulls_last() if reverse else c.asc_nulls_first()]

    def _sort(self, tasks: DataFrame, name: str, reverse: bool, line: str) -> list[Column]:
        found = self._value(tasks, re.sub(r"^tag#", "tags#", name), _SORTS)
        if not found:
            self.diagnostics.append(f"unknown sort field: {line}")
            return []
        column, kind, path = found
        if path == "urgency":
            return self._keys(column, not reverse)
        if path in _DATE_COLUMNS:  # invalid before valid before missing
            there = F.trim(column) != ""
            bucket = F.when(F.coalesce(there, F.lit(False)), F.when(F.try_to_date(F.trim(column)).isNull(), 0).otherwise(1)).otherwise(2)
            return self._keys(bucket, reverse) + self._keys(F.when(there, column), reverse)
        return self._keys(F.to_json(column) if isinstance(kind, T.ArrayType | T.StructType | T.MapType) else column, reverse)

    def _group(self, tasks: DataFrame, name: str, line: str) -> tuple[Column, object] | None:
        """The keys of a task's groups as a list, and what they are sorted by."""
        found = self._value(tasks, name, _GROUPS)
        if not found:
            self.diagnostics.append(f"unknown group field: {line}")
            return None
        column, kind, path = found
        if path in _DATE_COLUMNS:
            label = "done" if path == "completion" else path
            none, bad = f"No {label} date", f"Invalid {label} date"
            key = F.when(F.coalesce(F.trim(column) == "", F.lit(True)), none).when(F.try_to_date(F.trim(column)).isNull(), bad).otherwise(column)
            return F.array(key), lambda v: F.concat(F.when(v == bad, "00:").when(v == none, "99:").otherwise("10:"), v)
        if isinstance(kind, T.ArrayType):
            text = column.cast("array<string>") if not isinstance(kind.elementType, T.StructType) else F.transform(column, lambda x: F.to_json(x))
            return F.when(F.size(text) > 0, text).otherwise(F.array(F.lit("(No tags)"))), lambda v: v
        if path == "urgency":
            return F.array(F.round(column, 5).cast("string")), lambda v: v.cast("double")
        order = {"status_type": _TYPES, "priority_group": list(PRIORITY_GROUPS)}.get(path)
        value = F.array(F.coalesce(F.to_json(column) if isinstance(kind, T.StructType | T.MapType) else column.cast("string"), F.lit("")))
        if not order:
            return value, lambda v: v
        place = lambda v: F.array_position(F.array(*map(F.lit, order)), v)
        return value, lambda v: F.concat(F.lpad(F.when(place(v) > 0, place(v)).otherwise(99).cast("string"), 2, "0"), F.lit(":"), v)

    # ---- filters ----
    def condition(self, line: str) -> Column:
        """A line: conditions in parentheses joined by NOT, AND, OR and XOR, in this order of strength, or a single one."""
        parts = self._split(line)
        if parts is None:
            return self._single(line)
        for operator in ("XOR", "OR", "AND"):
            groups, current = [], []
            for p in parts:
                if p == operator:
                    groups.append(current)
                    current = []
                else:
                    current.append(p)
            groups.append(current)
            if len(groups) > 1:
                tests = [self._joined(g) for g in groups]
                if operator == "XOR":
                    rest = tests[1]
                    for t in tests[2:]:
                        rest = rest | t
                    return tests[0] != rest
                out = tests[0]
                for t in tests[1:]:
                    out = (out | t) if operator == "OR" else (out & t)
                return out
        return self._joined(parts)

    def _joined(self, parts: list[str]) -> Column:
        if parts[:1] == ["NOT"]:
            return ~self._joined(parts[1:])
        if len(parts) == 1:
            inner = parts[0]
            return F.coalesce(self.condition(inner[1:-1] if inner[0] == "(" else inner), F.lit(False))
        return self.condition(" ".join(parts))

    @staticmethod
    def _split(line: str) -> list[str] | None:
        """Parenthesised parts and operators, or None where the line is no such combination."""
        out, at = [], 0
        while at < len(line):
            if m := re.compile(r"\s*(AND|OR|XOR|NOT)\b\s*").match(line, at):
                out.append(m[1])
                at = m.end()
            elif line[at] == "(":
                depth, start = 0, at
                while at < len(line):
                    depth += {"(": 1, ")": -1}.get(line[at], 0)
                    at += 1
                    if not depth:
                        break
                out.append(line[start:at])
            elif line[at].isspace():
                at += 1
            else:
                return None
        return out

    def _single(self, line: str) -> Column:
        low = line.lower().strip()
        there = {
            "tags": lambda: F.size("tags") > 0, "id": lambda: F.trim("id") != "", "depends on": lambda: F.size("depends_on") > 0, "recurring": lambda: F.trim("recurrence") != "",
            "blocking": lambda: self._flag("is_blocking"), "blocked": lambda: self._flag("is_blocked"),
        }
        plain = {"done": lambda: F.col("is_done"), "not done": lambda: ~F.col("is_done"), "exclude sub-items": lambda: ~F.col("is_sub_item")}
        if low in plain:
            return plain[low]()
        if (m := re.fullmatch(r"(has|no) (tags|id|depends on|recurring|blocking|blocked)", low)) or (m := re.fullmatch(r"(is|is not) (recurring|blocking|blocked)", low)):
            test = F.coalesce(there[m[2]](), F.lit(False))
            return test if m[1] in ("has", "is") else ~test
        field_names = "|".join([*_DATES, "happens"])
        if m := re.fullmatch(rf"(has|no) ({field_names}) date", low):
            test = self._any_date(m[2], lambda c: c.isNotNull() & (F.trim(c) != ""))
            return test if m[1] == "has" else ~test
        if m := re.fullmatch(rf"({field_names}) date is invalid", low):
            return self._any_date(m[1], lambda c: (F.trim(c) != "") & F.try_to_date(c).isNull())
        if m := re.fullmatch(rf"({field_names})\s+(on or before|on or after|in or before|in or after|on|in|before|after)?\s*(.+)", low):
            span = date_range(m[3], self.today) or date_range(f"{m[2] or ''} {m[3]}", self.today)
            if span:
                return self._dated(m[1], m[2] or "on", *span)
        if m := re.fullmatch(r"priority is (?:(not|above|below) )?(highest|high|medium|normal|none|lowest|low)", low):
            n, p = F.col("priority_number"), {"highest": 0, "high": 1, "medium": 2, "normal": 2, "none": 3, "low": 4, "lowest": 5}[m[2]]
            return {"not": n != p, "above": n < p, "below": n > p}.get(m[1] or "", n == p)
        if m := re.fullmatch(r"status(?:\.(name|type))? (is not|is|includes|does not include) (.+)", low):
            kind = m[3].strip().replace("-", "_").replace(" ", "_").upper()
            if m[1] != "type" or "include" in m[2] or kind in TYPE_NAMES:
                c = F.lower(F.col("status_type" if m[1] == "type" else "status_name"))
                wanted = kind.lower() if m[1] == "type" and "include" not in m[2] else m[3]
                test = F.contains(c, F.lit(wanted)) if "include" in m[2] else c == wanted
                return ~test if "not" in m[2] else test
        if m := re.fullmatch(r"([\w.]+) (?:regex )?(matches|does not match) /(.+)/([im]*)", line.strip(), re.I):
            if m[1].lower() in _TEXTS and valid_pattern(m[3]):
                pattern = f"(?{m[4]})" * bool(m[4]) + m[3]
                test = self._text(m[1].lower(), lambda c: c.rlike(pattern))
                return ~test if "not" in m[2].lower() else test
        if m := re.fullmatch(r"([\w.]+) (includes|include|does not include|do not include) (.+)", low):
            if m[1] in _TEXTS:
                test = self._text(m[1], lambda c: F.contains(F.lower(c), F.lit(m[3])))
                return ~test if "not" in m[2] else test
        self.diagnostics.append(f"not understood: {line}")
        return F.lit(False)

    def _flag(self, name: str) -> Column:
        return F.col(name) if name in self.frame.columns else F.lit(False)

    @staticmethod
    def _any_date(name: str, test) -> Column:
        names = ("start", "scheduled", "due") if name == "happens" else (_DATES[name],)
        out = F.lit(False)
        for c in names:
            out = out | F.coalesce(test(F.col(c)), F.lit(False))
        return out

    def _dated(self, name: str, relation: str, first: dt.date, last: dt.date) -> Column:
        a, b = F.lit(first.isoformat()).cast("date"), F.lit(last.isoformat()).cast("date")
        tests = {"before": lambda d: d < a, "after": lambda d: d > b, "on or before": lambda d: d <= b, "on or after": lambda d: d >= a, "on": lambda d: d.between(a, b)}
        test = tests[relation.replace("in", "on", 1) if relation.startswith("in") else relation]
        day = lambda c: F.col(f"{c}_day") if f"{c}_day" in self.frame.columns else F.try_to_date(F.col(c))
        out = F.lit(False)
        for c in ("start", "scheduled", "due") if name == "happens" else (_DATES[name],):
            out = out | F.coalesce(test(day(c)), F.lit(False)) if name == "happens" else test(day(c))
        if name in ("start", "starts") and "before" in relation:  # without a start date it may start any time
            out = F.coalesce(out, F.lit(False)) | day("start").isNull()
        return out

    @staticmethod
    def _text(name: str, test) -> Column:
        c = F.col(_TEXTS[name])
        return F.coalesce(F.exists(c, test) if name in ("tags", "tag") else test(c), F.lit(False))


def _label(x: Typed) -> Column:
    """Text of a group's key: whole numbers without a decimal place."""
    if x.kind == "number":
        return F.when(x.column == F.floor(x.column), x.column.cast("long").cast("string")).otherwise(x.column.cast("string"))
    return x.column.cast("string") if x.kind in ("string", "boolean", "null", "date") else F.to_json(x.column)
