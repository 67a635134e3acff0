"""Task lines of notes as rows, with fields, status, priority, urgency, parents and dependencies."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mdspark.functions.text import line_links
from mdspark.shipping import ship_package
from mdspark.sources.index import Index

#: The marks of task fields.
DATES = {"due": "📅", "completion": "✅", "scheduled": "⏳", "start": "🛫", "created": "➕", "cancelled": "❌"}
PRIORITIES = {"🔺": "highest", "⏫": "high", "🔼": "medium", "🔽": "low", "⏬": "lowest"}
PRIORITY_NUMBERS = {"highest": 0, "high": 1, "medium": 2, "normal": 3, "none": 3, "low": 4, "lowest": 5}
PRIORITY_GROUPS = ("Highest priority", "High priority", "Medium priority", "Normal priority", "Low priority", "Lowest priority")
#: Name, type and next symbol of the known statuses, names of types, and their order in sorts.
STATUSES = {" ": ("Todo", "TODO", "x"), "x": ("Done", "DONE", " "), "X": ("Done", "DONE", " "), "/": ("In Progress", "IN_PROGRESS", "x"), "-": ("Cancelled", "CANCELLED", " "), "": ("EMPTY", "EMPTY", "")}
TYPE_NAMES = {"TODO": "Todo", "DONE": "Done", "IN_PROGRESS": "In Progress", "ON_HOLD": "On Hold", "CANCELLED": "Cancelled", "NON_TASK": "Non-Task", "EMPTY": "EMPTY"}
TYPE_ORDER = {"IN_PROGRESS": 1, "TODO": 2, "ON_HOLD": 3, "DONE": 4, "CANCELLED": 5, "NON_TASK": 6}
ACTIONABLE = ("TODO", "IN_PROGRESS", "ON_HOLD")
#: Fixed values, the formats of the language: a task line (indentation, marker, symbol, text), an inline field, a tag.
_TASK = r"^(\s*)([-*+]|\d+[.)])\s+\[([^\]])\]\s+(.*)$"
_TASK_LINE = re.compile(_TASK.replace(r"\d", "[0-9]").replace(".*", r"[^\r\n\x85\u2028\u2029]*"), re.ASCII)
_FIELD = r"\[([^\[\]:]+)::([^\]]*)\]"
_TAG = r"(^|[^\p{IsAlphabetic}\p{N}_])#([\p{IsAlphabetic}\p{N}_/-]+)"


@dataclass(frozen=True)
class Status:
    """``SYMBOL=TYPE`` or ``SYMBOL=NAME:TYPE[:NEXT]``; ``space`` stands for a blank."""

    symbol: str
    name: str
    type: str
    following: str

    @classmethod
    def parse(cls, spec: str) -> Status:
        symbol, sign, rest = spec.partition("=")
        blank = lambda s: " " if s in ("space", "<space>", "␠") else s
        symbol, parts = blank(symbol.strip()), [p.strip() for p in rest.split(":", 2)]
        kind = parts[0 if len(parts) == 1 else 1].replace("-", "_").replace(" ", "_").upper()
        if not sign or not symbol or kind not in TYPE_NAMES:
            raise ValueError(f"a status is SYMBOL=TYPE or SYMBOL=NAME:TYPE[:NEXT], not {spec!r}")
        name = parts[0] if len(parts) > 1 else TYPE_NAMES[kind]
        if not name:
            raise ValueError(f"the status {spec!r} has no name")
        default = " " if kind in ("DONE", "CANCELLED") else "" if kind == "EMPTY" else "x"
        return cls(symbol, name, kind, blank(parts[2]) if len(parts) > 2 else default)


def known_statuses(more: dict[str, tuple] | list[str] | None = None) -> dict[str, tuple[str, str, str]]:
    """The fixed statuses and ``more``: specs, or tuples (name, type[, next]) by symbol."""
    if isinstance(more, dict):
        more = {k: (*v, "x")[:3] for k, v in more.items()}
    else:
        more = {s.symbol: (s.name, s.type, s.following) for s in map(Status.parse, more or ())}
    return STATUSES | more


def _lookup(key: Column, values: dict, default: Column) -> Column:
    pairs = F.create_map(*(F.lit(x) for kv in values.items() for x in kv))
    return F.coalesce(F.try_element_at(pairs, key), default)


def _after(text: Column, mark: str, pattern: str) -> Column:
    """What follows a mark. Only texts that have the mark are searched for the pattern, as few have any one."""
    found = F.regexp_extract(text, rf"{mark}\x{{fe0f}}?\s*{pattern}", 1)
    return F.when(F.contains(text, F.lit(mark)), F.nullif(found, F.lit("")))


def inline_fields(text: Column) -> Column:
    """map of the ``[key:: value]`` fields, keys lower-cased; of fields of one key the last."""
    keys = F.transform(F.regexp_extract_all(text, F.lit(_FIELD), F.lit(1)), lambda k: F.lower(F.trim(k)))
    values = F.transform(F.regexp_extract_all(text, F.lit(_FIELD), F.lit(2)), lambda v: F.trim(v))
    entries = F.zip_with(keys, values, lambda k, v: F.struct(k.alias("key"), v.alias("value")))
    later = lambda all_, i: F.slice(all_, i + 2, F.size(all_))
    # as a variable, so that the patterns are not searched again for each entry
    last = F.transform(F.array(entries), lambda all_: F.filter(all_, lambda e, i: ~F.exists(later(all_, i), lambda o: o["key"] == e["key"])))[0]
    return F.when(F.contains(text, F.lit("::")), F.map_from_entries(last)).otherwise(F.expr("cast(map() as map<string, string>)"))


#: Fixed values, formats of fields: a date, an id, ids that a task depends on, what becomes of a done task, and the weights of urgency.
_DATE, _ID, _IDS, _DONE = r"\d{4}-\d{2}-\d{2}", "[A-Za-z0-9_-]+", "[A-Za-z0-9_, -]+", "delete|keep"
URGENCY = {"highest": 9.0, "high": 6.0, "medium": 3.9, "normal": 1.95, "none": 1.95, "low": 0.0, "lowest": -1.8}
DUE_MOST, DUE_LEAST, DUE_TODAY, DUE_DAY, SCHEDULED, STARTS_LATER = 12.0, 2.4, 8.8, 0.457142857, 5.0, -3.0
#: Dates that a task table has as such, too.
DAYS = ("due", "scheduled", "start")
#: All marks of fields.
_MARKS = "".join([*DATES.values(), *PRIORITIES, "🔁🆔⛔🏁"])


def described(text: Column, global_filter: str = "") -> Column:
    """The text without fields and marks, and without the text that makes a line a task."""
    bare = F.replace(text, F.lit(global_filter), F.lit("")) if global_filter else text
    bare = F.when(F.contains(text, F.lit("::")), F.regexp_replace(bare, _FIELD, "")).otherwise(bare)
    dated = rf"(?:{'|'.join(DATES.values())})\x{{fe0f}}?\s*{_DATE}"
    marked = rf"{dated}|🆔\x{{fe0f}}?\s*{_ID}|⛔\x{{fe0f}}?\s*{_IDS}|🔁\x{{fe0f}}?\s*[^{_MARKS}\[]+|🏁\x{{fe0f}}?\s*(?:{_DONE})|[{_MARKS}]\x{{fe0f}}?"
    return F.trim(F.regexp_replace(F.regexp_replace(bare, marked, ""), r"\s+", " "))


def task_fields(text: Column, fields: Column) -> dict[str, Column]:
    """Fields of the text after the checkbox that are plain texts; marks override ``[key:: value]`` fields of the same name.

    ``fields`` is a column already, so that it is computed once.
    """
    inline = lambda *names: F.coalesce(*(F.try_element_at(fields, F.lit(n)) for n in names))
    out = {name: F.coalesce(_after(text, mark, f"({_DATE})"), inline(name)) for name, mark in DATES.items()}
    named = F.lower(inline("priorityname", "priority"))
    named = F.when(named.isin(list(PRIORITY_NUMBERS)), named)
    priority = F.coalesce(*(F.when(F.contains(text, F.lit(mark)), F.lit(name)) for mark, name in PRIORITIES.items()), named, F.lit("normal"))
    out["priority"] = priority
    out["recurrence"] = F.coalesce(F.trim(_after(text, "🔁", rf"([^{_MARKS}\[]+)")), inline("recurrence", "repeat"))
    out["on_completion"] = F.coalesce(_after(text, "🏁", f"({_DONE})"), inline("oncompletion"), F.lit(""))
    out["id"] = F.coalesce(_after(text, "🆔", f"({_ID})"), inline("id"))
    return out


def task_lists(text: Column, description: Column) -> dict[str, Column]:
    """What a text depends on, its tags, and its description without them."""
    out = {}
    depends = F.split(F.coalesce(_after(text, "⛔", f"({_IDS})"), F.lit("")), ",")
    out["depends_on"] = F.filter(F.transform(depends, lambda d: F.trim(d)), lambda d: d != "")
    out["description_without_tags"] = F.trim(F.regexp_replace(description, _TAG, "$1"))
    names = F.transform(F.regexp_extract_all(description, F.lit(_TAG), F.lit(2)), lambda t: F.regexp_replace(t, "^/+|/+$", ""))
    out["tags"] = F.transform(F.filter(names, lambda t: t != ""), lambda t: F.concat(F.lit("#"), t))
    return out


def file_parts(path: Column) -> dict[str, Column]:
    """The parts of a note's path that queries over tasks name."""
    last = F.element_at(F.split(path, "/"), -1)
    folder, root = F.regexp_extract(path, "^(.*/)[^/]*$", 1), F.regexp_extract(path, "^([^/]*/)", 1)
    bare = lambda c: F.regexp_replace(c, r"(\.md)+$", "")
    return {
        "path": path, "path_without_extension": bare(path), "filename": last, "filename_without_extension": bare(last),
        "folder": F.when(folder == "", "/").otherwise(folder), "root": F.when(root == "", "/").otherwise(root),
    }


_QUOTE, _HEAD, _HEAD_ENDS = (re.compile(p, re.ASCII) for p in (r"^(?:\s*>\s?)+", r"^#{1,6}\s+\S", r"^#{1,6}\s+|\s*#*\s*$"))
_LINES = "line: int, heading: string, section: bigint, parent_line: int, indentation: string, list_marker: string, status_symbol: string, text: string"


def lines_of(body: str, start: int, global_filter: str = "") -> list[tuple]:
    """The task lines of a note in one pass, with the heading above each, the number of headings so far, and the nearest earlier task of the section with a smaller indentation."""
    out: list[tuple] = []
    heading, section, stack = None, 0, []
    for at, line in enumerate(body.split("\n"), start):
        if ">" in line:
            line = _QUOTE.sub("", line)
        if line[:1] == "#" and _HEAD.match(line):
            heading, section, stack = _HEAD_ENDS.sub("", line), section + 1, []
        elif "[" in line and (m := _TASK_LINE.match(line)) and (not global_filter or global_filter in line):
            width = len(m[1])
            while stack and stack[-1][1] >= width:
                stack.pop()
            out.append((at, heading, section, stack[-1][0] if stack else None, m[1], m[2], m[3], m[4]))
            stack.append((at, width))
    return out


def extract_tasks(notes: DataFrame, global_filter: str = "", statuses: dict[str, tuple] | list[str] | None = None, note_links: bool = False) -> DataFrame:
    """A row with all columns for each task line of ``notes``: ``task_lines``, completed."""
    return complete(task_lines(notes, global_filter, note_links), global_filter, statuses)


def _small_methods(spark: SparkSession) -> None:
    """Columns of many patterns make methods that the JVM never compiles, being larger than its limit of 8000 bytes; such stages are to run without whole-stage code."""
    if int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) > 8000:
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")


def task_lines(notes: DataFrame, global_filter: str = "", note_links: bool = False) -> DataFrame:
    """A row for each task line of ``notes`` (path, body; body_start_line and frontmatter_json if they are there).

    One pass over a note's lines numbers them and carries headings and parents down, in time that
    grows with the note; nothing is shuffled. With ``note_links`` the file of a task also has the
    links of its whole note, copied into each of its tasks.
    """
    ship_package(notes.sparkSession)
    _small_methods(notes.sparkSession)
    start = F.col("body_start_line") if "body_start_line" in notes.columns else F.lit(1)
    frontmatter = F.col("frontmatter_json") if "frontmatter_json" in notes.columns else F.lit(None).cast("string")
    in_body, in_properties = line_links(F.col("body")), line_links(F.coalesce(frontmatter, F.lit("")))
    note = [frontmatter.alias("frontmatter")]
    if note_links:
        both = F.array_distinct(F.concat(in_properties, in_body))
        note += [in_properties.alias("outlinks_in_properties"), in_body.alias("outlinks_in_body"), both.alias("outlinks")]
    names = [part.split(":")[0] for part in _LINES.split(", ")]
    kinds = dict(zip(names, (pa.int32(), pa.string(), pa.int64(), pa.int32(), *[pa.string()] * 4), strict=True))

    @F.arrow_udf(f"array<struct<{_LINES}>>")
    def found(bodies: pa.Array, starts: pa.Array) -> pa.Array:
        rows: list[tuple] = []
        ends = [0]
        for b, s in zip(bodies.to_pylist(), starts.to_pylist(), strict=True):
            rows += lines_of(b or "", s or 1, global_filter)
            ends.append(len(rows))
        columns = zip(*rows, strict=True) if rows else [()] * len(names)
        items = pa.StructArray.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds.values(), strict=True)], list(kinds))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items)

    tasks = notes.select("path", F.struct(*note).alias("note"), found(F.col("body"), start.cast("int")).alias("_t")).select("path", "note", F.inline("_t"))
    tasks = tasks.select("*", inline_fields(F.col("text")).alias("_fields"))
    return tasks.select("*", *(c.alias(name) for name, c in task_fields(F.col("text"), F.col("_fields")).items())).drop("_fields")


def complete(tasks: DataFrame, global_filter: str = "", statuses: dict[str, tuple] | list[str] | None = None) -> DataFrame:
    """``tasks`` of ``task_lines`` with what follows from their columns: lists, the description, the parts of the path, the line as written, texts of groups, the status.

    A table need not keep these; a query computes those that it reads, which takes less than
    writing all of them.
    """
    _small_methods(tasks.sparkSession)
    stored = [c for c in tasks.columns if c not in ("path", "note", "line")]
    file = [x.alias(n) for n, x in file_parts(F.col("path")).items()] + [F.col("note")[n].alias(n) for n in tasks.schema["note"].dataType.names]
    tasks = tasks.select("path", F.struct(*file).alias("file"), "line", (F.col("line") - 1).alias("line_number"), *stored)
    tasks = tasks.select("*", inline_fields(F.col("text")).alias("fields"), described(F.col("text"), global_filter).alias("description"))
    tasks = tasks.select("*", *(c.alias(name) for name, c in task_lists(F.col("text"), F.col("description")).items()))
    page = F.col("file.filename_without_extension")
    tasks = tasks.select(
        "*",
        _lookup(F.col("priority"), PRIORITY_NUMBERS, F.lit(3)).alias("priority_number"),
        F.concat("indentation", "list_marker", F.lit(" ["), "status_symbol", F.lit("] "), "text").alias("original_markdown"),
        F.when(F.col("heading").isNull(), page).otherwise(F.concat(page, F.lit(" > "), "heading")).alias("backlink"),
        line_links(F.col("text")).alias("outlinks"),
    )
    tasks = tasks.select("*", *(c.alias(n) for n, c in derived(F.col("recurrence"), F.col("priority_number")).items()))
    return add_status(tasks, known_statuses(statuses))


def derived(recurrence: Column, priority_number: Column) -> dict[str, Column]:
    """What follows from the recurrence and the priority: flags, and texts by which tasks are grouped."""
    again = F.coalesce(F.trim(recurrence) != "", F.lit(False))
    group = F.coalesce(F.try_element_at(F.array(*map(F.lit, PRIORITY_GROUPS)), priority_number + 1), F.lit(PRIORITY_GROUPS[3]))
    return {
        "is_recurring": again, "recurrence_rule": F.coalesce(recurrence, F.lit("")), "recurring_group": F.when(again, "Recurring").otherwise("Not Recurring"),
        "recurrence_group": F.when(again, recurrence).otherwise("None"), "priority_group": group, "priority_name_group": F.concat(F.lit("%%"), priority_number.cast("string"), F.lit("%%"), group),
    }


def add_status(tasks: DataFrame, known: dict[str, tuple] = STATUSES) -> DataFrame:
    symbol = F.col("status_symbol")
    part = lambda k, default: _lookup(symbol, {s: v[k] for s, v in known.items()}, F.lit(default))
    status_type = part(1, "TODO")
    done = status_type.isin("DONE", "CANCELLED", "NON_TASK")
    rank = _lookup(status_type, TYPE_ORDER, F.lit(7))
    return tasks.select(
        "*", part(0, "Unknown").alias("status_name"), status_type.alias("status_type"), part(2, "x").alias("status_next_symbol"), done.alias("is_done"),
        F.when(done, "Done").otherwise("Todo").alias("status_group"), F.concat(F.lit("%%"), rank.cast("string"), F.lit("%%"), status_type).alias("status_type_group"),
        F.least("start", "scheduled", "due").alias("happens"), (F.col("indentation") != "").alias("is_sub_item") if "indentation" in tasks.columns else F.lit(False).alias("is_sub_item"),
    )


def with_parent(tasks: DataFrame, columns: tuple[str, ...] = ("description", "status_type", "status_name", "tags", "due", "priority", "line"), parents: DataFrame | None = None) -> DataFrame:
    """With ``parent``, the given columns of the parent task, which is among ``parents`` if they are given."""
    above = (tasks if parents is None else parents).select("path", F.col("line").alias("parent_line"), F.struct(*columns).alias("parent"))
    return tasks.join(above, ["path", "parent_line"], "left")


def with_days(tasks: DataFrame) -> DataFrame:
    """With the valid dates among due, scheduled and start as dates (due_day, ...), which a table's reader can skip by."""
    return tasks.select("*", *(F.try_to_date(F.col(c)).alias(f"{c}_day") for c in DAYS))


def task_table(index: Index, global_filter: str = "", statuses: list[str] | None = None, parent: bool = True, note_links: bool = True) -> DataFrame:
    """The tasks of an index's notes with their parents and days, from a table that is made once for each segment of the index.

    The table keeps the lines and their plain fields, which one pass over the notes finds; the rest
    is computed from it. Notes are dealt evenly by path, as few files may hold many of them; tasks
    are not shuffled, but for parents.
    """
    name = "lines-" + hashlib.sha256(repr((global_filter, sorted(statuses or ()), parent, note_links)).encode()).hexdigest()[:12]

    def make(notes: DataFrame) -> DataFrame:
        dealt = notes.repartition(int(notes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")
        rows = with_days(task_lines(dealt, global_filter, note_links))
        return with_parent(rows, parents=complete(rows, global_filter, statuses)) if parent else rows

    return complete(index.derived(name, make), global_filter, statuses)


def urgency(today: str) -> Column:
    """Due, priority, scheduled and start, as of ``today``."""
    now = F.lit(today).cast("date")
    days = F.datediff(F.try_to_date(F.col("due")), now)
    due = F.when(days.isNull(), 0.0).when(days <= -7, DUE_MOST).when(days >= 14, DUE_LEAST).otherwise(DUE_TODAY - DUE_DAY * days)
    weight = _lookup(F.col("priority"), URGENCY, F.lit(URGENCY["normal"]))
    scheduled = F.when(F.try_to_date(F.col("scheduled")) <= now, SCHEDULED).otherwise(0.0)
    start = F.when(F.try_to_date(F.col("start")) > now, STARTS_LATER).otherwise(0.0)
    return due + weight + scheduled + start


def random_key(today: str) -> Column:
    """A number from 0 that stays the same for a task throughout a day."""
    return F.xxhash64(F.lit(today), "description", "path", "line").bitwiseAND((1 << 63) - 1)


def dependencies(tasks: DataFrame) -> DataFrame:
    """With is_blocked and is_blocking: an actionable task on an id of another actionable one, and the reverse.

    Ids meet ids alone, so tasks without one are not brought together; what is found comes back by path and line.
    """
    acting = tasks.where(F.col("status_type").isin(*ACTIONABLE))
    ids = acting.where("id IS NOT NULL").select("path", "line", F.col("id").alias("_id"))
    edges = acting.select("path", "line", F.explode("depends_on").alias("_id"))
    flag = lambda rows, others, name: rows.join(others.select("_id").distinct(), "_id", "left_semi").select("path", "line", *(F.lit(n == name).alias(n) for n in ("_b", "_n")))
    found = flag(edges, ids, "_b").unionByName(flag(ids, edges, "_n")).groupBy("path", "line").agg(F.max("_b").alias("_b"), F.max("_n").alias("_n"))
    out = tasks.join(found, ["path", "line"], "left")
    return out.withColumn("is_blocked", F.coalesce("_b", F.lit(False))).withColumn("is_blocking", F.coalesce("_n", F.lit(False))).drop("_b", "_n")


def attach(pages: DataFrame, tasks: DataFrame, columns: tuple[str, ...] = ()) -> DataFrame:
    """``pages`` with the tasks of each in a list ``tasks``, by line; a page bounds its list. With ``columns`` a task has the line and these alone, and nothing else is shuffled."""
    columns = columns or tuple(c for c in tasks.columns if c not in ("path", "line", "file", "fields", "outlinks"))
    rows = tasks.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("line", *columns))).alias("tasks"))
    none = F.array().cast(rows.schema["tasks"].dataType)
    return pages.join(rows, "path", "left").withColumn("tasks", F.coalesce("tasks", none))
