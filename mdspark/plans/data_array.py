"""The fluent interface over pages: lazy arrays of rows, and what a query shows.

A step is an expression of the language, or a Python function from the row to a Column; the row's
attributes are its Columns.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mdspark.operators import tasks as task_operators
from mdspark.plans.expression import Typed, as_date, compile_expression, scope_of, structure, text, truthy, typed

Step = str | Callable[["RowOf"], Column]
SHOWN = "render string, value string, position long"


class RowOf:
    """The Columns of a row as attributes; ``row["a.b"]`` evaluates an expression."""

    def __init__(self, frame: DataFrame):
        self._frame = frame

    def __getattr__(self, name: str) -> Column:
        if name.startswith("_") or name not in self._frame.columns:
            raise AttributeError(name)
        return F.col(f"`{name}`")

    def __getitem__(self, source: str) -> Column:
        return compile_expression(source, self._frame).column


def _made(step: Step, frame: DataFrame) -> Typed:
    if isinstance(step, str):
        return compile_expression(step, frame)
    column = step(RowOf(frame))
    return typed(column, frame.select(column.alias("x")).schema["x"].dataType)


@dataclass
class DataArray:
    """Rows in order: by ``keys``, where they are given, and then by ``tie``."""

    frame: DataFrame
    tie: tuple[str, ...] = ("path",)
    keys: tuple[tuple[str, bool], ...] = ()

    def where(self, step: Step) -> DataArray:
        return DataArray(self.frame.where(truthy(_made(step, self.frame))), self.tie, self.keys)

    filter = where

    def map(self, step: Step, name: str = "value") -> DataArray:
        """One value a row, in a column ``name``; the order stays."""
        kept = self._order_columns()
        return DataArray(self.frame.select(_made(step, self.frame).column.alias(name), *(F.col(c).alias(f"_{k}") for k, c in enumerate(kept))), tuple(f"_{k}" for k in range(len(kept) - len(self.tie), len(kept))), tuple((f"_{k}", down) for k, (_, down) in enumerate(self.keys)))

    def flatMap(self, step: Step, name: str = "value") -> DataArray:
        """The items of a list for each row; a single value stands for itself."""
        x = _made(step, self.frame)
        kept = self._order_columns()
        items = x.column if x.kind == "list" else F.array(x.column)
        rows = self.frame.select(*(F.col(c).alias(f"_{k}") for k, c in enumerate(kept)), F.posexplode(items).alias("_at", name))
        return DataArray(rows, (*(f"_{k}" for k in range(len(self.keys), len(kept))), "_at"), tuple((f"_{k}", down) for k, (_, down) in enumerate(self.keys)))

    def sort(self, step: Step, direction: str = "asc") -> DataArray:
        """By a value, those without one last; rows of equal values stay as they were."""
        x = _made(step, self.frame)
        name = f"_sort{len(self.keys)}"
        column = x.column if x.kind in ("number", "string", "boolean", "date") else F.to_json(x.column) if x.kind != "null" else x.column
        return DataArray(self.frame.withColumn(name, column), self.tie, ((name, direction.lower() == "desc"), *self.keys))

    def groupBy(self, step: Step) -> DataArray:
        """(key, rows), by the key; the rows of a group are one value, so limit what may be large first."""
        x = _made(step, self.frame)
        keyed = F.coalesce(F.to_json(F.struct(x.column.alias("k"))), F.lit("{}"))
        shown = [c for c in self.frame.columns if not c.startswith("_")]
        rows = self.frame.groupBy(keyed.alias("_key")).agg(F.first(x.column).alias("key"), F.sort_array(F.collect_list(F.struct(*self.tie, *(c for c in shown if c not in self.tie)))).alias("rows"))
        return DataArray(rows, ("_key",))

    def distinct(self, step: Step | None = None) -> DataArray:
        """The first row of each value, or of each row as a whole. One row a task of each value is shuffled."""
        shown = [c for c in self.frame.columns if not c.startswith("_")]
        x = _made(step, self.frame) if step is not None else structure("object", **{c: scope_of(self.frame)[c] for c in shown if c not in self.tie})
        keyed = F.coalesce(F.to_json(F.struct(x.column.alias("k"))), F.lit("{}"))
        whole = F.struct(*(F.col(f"`{c}`") for c in self.frame.columns))
        rows = self.frame.groupBy(keyed.alias("_key")).agg(F.min_by(whole, F.struct(*self.tie)).alias("_row"))
        return DataArray(rows.select("_row.*"), self.tie, self.keys)

    def limit(self, n: int) -> DataArray:
        return DataArray(self.ordered().limit(n), self.tie, self.keys)

    def _order_columns(self) -> list[str]:
        return [*(k for k, _ in self.keys), *self.tie]

    def ordered(self) -> DataFrame:
        keys = [F.col(k).desc_nulls_last() if down else F.col(k).asc_nulls_last() for k, down in self.keys]
        return self.frame.orderBy(*keys, *self.tie)

    def array(self) -> DataFrame:
        """The rows in order, without the columns that only order them."""
        out = self.ordered()
        return out.select(*(F.col(f"`{c}`") for c in out.columns if not c.startswith("_")))

    @property
    def length(self) -> int:
        return self.frame.count()


@dataclass
class Pages:
    """What a query can reach: pages (path, file, ...), their tasks, the current page, and named views.

    Nothing outside is reached: ``el`` and ``load`` refuse, and a view is one of ``views``.
    """

    all: DataFrame
    tasks: DataFrame | None = None
    current_path: str = ""
    views: dict[str, Callable[[Pages, Any], DataFrame]] = field(default_factory=dict)
    shown: list[DataFrame] = field(default_factory=list)

    def pages(self, source: str = "") -> DataArray:
        """All pages, those with a #tag, or those whose path begins with a text."""
        wanted, frame = source.strip().strip("\"'"), self.all
        if wanted.startswith("#"):
            tags = compile_expression("file.tags", frame) if "file" in frame.columns else compile_expression("tags", frame)
            frame = frame.where(F.array_contains(tags.column, wanted[1:]) | F.array_contains(tags.column, wanted) if tags.kind == "list" else F.lit(False))
        elif wanted:
            frame = frame.where(F.startswith(F.col("path"), F.lit(wanted)))
        return DataArray(frame)

    def with_tasks(self, *columns: str) -> DataArray:
        """Pages with the list of their tasks, of which ``columns`` alone are kept if any are named."""
        if self.tasks is None:
            raise ValueError("there are no tasks")
        return DataArray(task_operators.attach(self.all, self.tasks, columns))

    def page(self, name: str) -> DataFrame:
        """The page of a path, with or without .md, or of a name; the first by path."""
        bare = F.regexp_replace("path", r"\.md$", "")
        last = F.element_at(F.split(bare, "/"), -1)
        found = self.all.where((F.col("path") == name) | (bare == name.removesuffix(".md")) | (last == name.removesuffix(".md")))
        return found.orderBy((F.col("path") != name).cast("int"), (bare != name.removesuffix(".md")).cast("int"), "path").limit(1)

    def current(self) -> DataFrame:
        return self.page(self.current_path)

    def date(self, value: str) -> Column:
        return as_date(text(value))

    def fileLink(self, path: str, embed: bool = False, display: str | None = None) -> Column:
        bare = path.removesuffix(".md").split("/")[-1]
        return F.struct(F.lit(path).alias("path"), F.lit(display or bare).alias("display"), F.lit(embed).alias("embed"))

    # ---- output: (render, value, position) ----
    def _show(self, render: str, rows: DataFrame, value: Column) -> DataFrame:
        out = rows.select(F.lit(render).alias("render"), value.alias("value"), F.lit(len(self.shown)).cast("long").alias("position"))
        self.shown.append(out)
        return out

    def list(self, rows: DataArray) -> DataFrame:
        frame = rows.array()
        value = F.to_json(F.struct("*")) if len(frame.columns) > 1 else F.to_json(F.struct(F.col(f"`{frame.columns[0]}`").alias("value")))
        return self._show("list", frame, value)

    def table(self, headers: list[str], rows: DataArray, steps: list[Step]) -> DataFrame:
        frame = rows.ordered()
        values = F.struct(*(_made(s, frame).column.alias(h) for h, s in zip(headers, steps, strict=True)))
        return self._show("table", frame, F.to_json(values))

    def taskList(self, rows: DataArray) -> DataFrame:
        frame = rows.array()
        return self._show("taskList", frame, F.to_json(F.struct(*(F.col(c) for c in ("path", "line", "text", "status_symbol") if c in frame.columns))))

    def paragraph(self, value: str) -> DataFrame:
        return self._show("paragraph", self.all.sparkSession.range(1), F.lit(value))

    def view(self, name: str, argument: Any = None) -> DataFrame:
        """A named view; names that leave the vault or are not known are refused."""
        if name.startswith("/") or ".." in name.split("/") or name not in self.views:
            raise ValueError(f"there is no view {name!r}")
        return self.views[name](self, argument)

    def el(self, *_: Any) -> None:
        raise PermissionError("elements cannot be made here")

    def load(self, *_: Any) -> None:
        raise PermissionError("files cannot be read here")

    def output(self) -> DataFrame:
        """All that was shown, one after the other."""
        out = self.all.sparkSession.createDataFrame([], SHOWN)
        for frame in self.shown:
            out = out.unionByName(frame)
        return out
