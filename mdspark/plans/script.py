"""Functions over tasks in a subset of JavaScript, compiled to Columns; nothing is run row by row.

Understood: ``function (task) {...}``, arrow functions, statements with ``return``, bare
expressions; const, let and var; if and else with return; ternaries, ``||``, ``&&``, ``??``, ``!``,
comparisons, arithmetic; members and indexes; the methods below. Anything else is no script
(``ExpressionError``), which callers report. There is no access to files, network or the host.
A Python callable from a row's Columns to a Column does where the subset is too small.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mdspark.plans.expression import (
    STRUCTURED, Compiler, ExpressionError, Typed, coerced, display, equal, flag, java_pattern, listed, null, number, order, scope_of, structure, text, together, truthy, valid_pattern,
)

_TOKEN = re.compile(
    r"""\s*(?:(?P<number>\d+(?:\.\d+)?)|(?P<string>"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|`[^`$]*`)"""
    r"""|(?P<op>===|!==|=>|>=|<=|!=|==|\|\||&&|\?\?|\?\.|[?;=><+\-*/%!.,:()\[\]{}])|(?P<name>[A-Za-z_$][\w$]*))"""
)
_REGEX = re.compile(r"\s*/((?:\\.|\[(?:\\.|[^\]])*\]|[^/\n\\\[])+)/([a-z]*)")
_COMMENT = re.compile(r"//[^\n]*|/\*.*?\*/", re.S)

#: Columns of a task by their names in scripts.
FIELDS = {
    "description": "description", "descriptionWithoutTags": "description_without_tags", "path": "path", "line": "line", "lineNumber": "line_number", "heading": "heading", "text": "text",
    "tags": "tags", "id": "id", "dependsOn": "depends_on", "depends_on": "depends_on", "priority": "priority", "priorityName": "priority", "priorityNumber": "priority_number", "urgency": "urgency",
    "priorityGroup": "priority_group", "priorityNameGroupText": "priority_name_group", "isRecurring": "is_recurring", "recurrence": "recurrence", "recurrenceRule": "recurrence_rule",
    "onCompletion": "on_completion", "originalMarkdown": "original_markdown", "listMarker": "list_marker", "indentation": "indentation", "isSubItem": "is_sub_item", "isDone": "is_done",
    "completed": "is_done", "statusGroup": "status_group", "statusTypeGroupText": "status_type_group", "backlink": "backlink", "outlinks": "outlinks", "random": "random",
}
DATE_FIELDS = {"created": "created", "start": "start", "scheduled": "scheduled", "due": "due", "cancelled": "cancelled", "done": "completion", "happens": "happens"}
STATUS = {"name": "status_name", "type": "status_type", "symbol": "status_symbol", "nextSymbol": "status_next_symbol", "typeGroupText": "status_type_group"}
FILE = {
    "path": "path", "pathWithoutExtension": "path_without_extension", "filename": "filename", "filenameWithoutExtension": "filename_without_extension", "folder": "folder", "root": "root",
    "outlinks": "outlinks", "outlinksInBody": "outlinks_in_body", "outlinksInProperties": "outlinks_in_properties",
}
#: Tokens of date patterns, longest first, as Java's.
DATE_TOKENS = {"YYYY": "yyyy", "MMMM": "MMMM", "MMM": "MMM", "dddd": "EEEE", "ddd": "EEE", "DD": "dd", "MM": "MM", "WW": None, "D": "d", "M": "M"}


def date_text(c: Column, pattern: str) -> Column:
    """A date by the tokens; text in square brackets and all else stands for itself."""
    out = [F.lit("")]
    for piece in re.findall(r"\[[^\]]*\]|" + "|".join(DATE_TOKENS) + "|.", pattern, re.S):
        if piece in DATE_TOKENS:
            java = DATE_TOKENS[piece]
            out.append(F.date_format(c, java) if java else F.lpad(F.weekofyear(c).cast("string"), 2, "0"))
        else:
            out.append(F.lit(piece[1:-1] if len(piece) > 1 else piece))
    return F.concat(*out)


class ScriptCompiler(Compiler):
    """``parent`` gives the columns of the parent task, if the rows carry it."""

    def __init__(self, scope: dict[str, Typed], today: str, query: dict[str, str] | None = None):
        super().__init__({})
        self.columns, self.today = scope, F.lit(today).cast("date")
        query = query or {}
        file = structure("object", **{k: text(query.get(k, "")) for k in ("path", "pathWithoutExtension", "filename", "filenameWithoutExtension", "folder", "root")})
        self.scope = {"task": Typed(F.lit(None), "task"), "query": Typed(F.lit(None), "object", fields={"file": file}), "undefined": null()}
        for k in ("Math", "String", "Number", "Boolean", "Array", "Object"):
            self.scope[k] = Typed(F.lit(None), k)

    # ---- programs ----
    def program(self, source: str) -> Typed:
        self.tokens, self.place = self._tokens(_COMMENT.sub(" ", source)), 0
        out = self._program()
        if self.place < len(self.tokens):
            raise ExpressionError(f"unexpected {self._peek()[1]!r}")
        return out

    def _program(self) -> Typed:
        if self._take("function"):
            if self._peek()[0] == "name":
                self.place += 1
            self._parameters()
            self._need("{")
            return self._block("}")
        if self._arrow_ahead():
            self._parameters()
            self._need("=>")
            out = self._block("}") if self._take("{") else self._or()
            self._take(";")
            return out
        return self._block("")

    def _arrow_ahead(self) -> bool:
        if self._peek()[0] == "name":
            return self._peek(1)[1] == "=>"
        k = 0
        if self._peek()[1] != "(":
            return False
        while self._peek(k)[0] != "end" and self._peek(k)[1] != ")":
            k += 1
        return self._peek(k + 1)[1] == "=>"

    def _parameters(self) -> list[str]:
        """Names of parameters; the first of a program is the task."""
        if not self._take("("):
            self.place += 1
            names = [str(self._peek(-1)[1])]
        else:
            names = []
            while not self._take(")"):
                names.append(str(self._peek()[1]))
                self.place += 1
                self._take(",")
        if names and names[0] != "task" and "value" not in self.scope:
            self.scope = self.scope | {names[0]: self.scope["task"]}
        return names

    def _block(self, end: str) -> Typed:
        """Statements up to ``end``; conditions that return become one nested value."""
        outer, out, tests = self.scope, None, []
        while True:
            if (end and self._take(end)) or (not end and self._peek()[0] == "end"):
                break
            if self._take(";"):
                continue
            if self._take("const", "let", "var"):
                name = str(self._peek()[1])
                self.place += 1
                self._need("=")
                self.scope = self.scope | {name: self._or()}
            elif self._take("if"):
                self._need("(")
                test = self._or()
                self._need(")")
                value = self._branch()
                tests.append((truthy(test), value))
                if self._take("else"):
                    out = self._branch() if out is None else out
            elif self._take("return"):
                value = null() if self._peek()[1] in (";", end) or self._peek()[0] == "end" else self._or()
                out = value if out is None else out
            else:
                value = self._or()
                if end:
                    raise ExpressionError("a statement without effect")
                out = value if out is None else out
        self.scope = outer
        values = [v for _, v in tests] + [out if out is not None else null()]
        if not tests:
            return values[0]
        columns, model = together(values)
        result = columns[-1]
        for (test, _), value in zip(reversed(tests), reversed(columns[:-1]), strict=True):
            result = F.when(test, value).otherwise(result)
        return model.at(result)

    def _branch(self) -> Typed:
        if self._take("{"):
            return self._block("}")
        self._need("return")
        out = self._or()
        self._take(";")
        return out

    # ---- expressions ----
    def _tokens(self, source: str) -> list[tuple[str, Any]]:
        out: list[tuple[str, Any]] = []
        at = 0
        while source[at:].strip():
            slash = not out or out[-1][0] == "op" and out[-1][1] not in (")", "]", "}") or out[-1][1] == "return"
            regex = _REGEX.match(source, at) if slash else None
            m = regex or _TOKEN.match(source, at)
            if not m:
                raise ExpressionError(f"cannot read {source[at:]!r}")
            out.append(("regex", (m[1], m[2])) if regex else (m.lastgroup or "", m[m.lastgroup or 0]))
            at = m.end()
        return out

    def _take(self, *values: str) -> str | None:
        kind, value = self._peek()
        if kind in ("op", "name") and value in values:
            self.place += 1
            return value
        return None

    def _or(self) -> Typed:
        test = self._either()
        if not self._take("?"):
            return test
        yes = self._or()
        self._need(":")
        (a, b), model = together([yes, self._or()])
        return model.at(F.when(truthy(test), a).otherwise(b))

    def _either(self) -> Typed:
        out = self._both()
        while op := self._take("||", "??"):
            right = self._both()
            (a, b), model = together([out, right])
            out = model.at(F.when(truthy(out) if op == "||" else out.column.isNotNull(), a).otherwise(b)) if model.kind != "boolean" else flag(truthy(out) | truthy(right))
        return out

    def _both(self) -> Typed:
        out = self._equality()
        while self._take("&&"):
            right = self._equality()
            (a, b), model = together([out, right])
            out = model.at(F.when(truthy(out), b).otherwise(a)) if model.kind != "boolean" else flag(truthy(out) & truthy(right))
        return out

    def _equality(self) -> Typed:
        out = self._relation()
        while op := self._take("===", "!==", "==", "!="):
            same = equal(self._plain(out), self._plain(self._relation()))
            out = flag(same if op[0] == "=" else ~same)
        return out

    def _relation(self) -> Typed:
        out = self._sum()
        while op := self._take(">=", "<=", ">", "<"):
            out = flag(order(op, self._plain(out), self._plain(self._sum())))
        return out

    def _plain(self, x: Typed) -> Typed:
        """Dates as the text they compare by."""
        return Typed(x.fields["raw"].column, "string") if x.kind in ("date field", "moment") else x

    def add(self, a: Typed, b: Typed) -> Typed:
        a, b = self._plain(a), self._plain(b)
        if a.kind == b.kind == "number":
            return number(a.column + b.column)
        return Typed(F.concat(self._text(a), self._text(b)), "string")

    @staticmethod
    def _text(x: Typed) -> Column:
        """As JavaScript writes a value: whole numbers without a decimal place."""
        if x.kind == "number":
            return F.coalesce(F.when(x.column == F.floor(x.column), x.column.cast("long").cast("string")).otherwise(x.column.cast("string")), F.lit("null"))
        return F.coalesce(display(x), F.lit("")) if x.kind != "null" else F.lit("null")

    def _product(self) -> Typed:
        out = self._unary()
        while op := self._take("*", "/", "%"):
            right = self._unary()
            a, b = coerced(out, "number"), coerced(right, "number")
            out = number({"*": lambda a=a, b=b: a * b, "/": lambda a=a, b=b: F.try_divide(a, b), "%": lambda a=a, b=b: F.try_mod(a, b)}[op]())
        return out

    def _unary(self) -> Typed:
        if self._take("!"):
            return flag(~truthy(self._unary()))
        if self._take("-"):
            return number(-coerced(self._unary(), "number"))
        return self._postfix()

    def _postfix(self) -> Typed:
        out = self._primary()
        while True:
            if self._take(".", "?."):
                name = str(self._peek()[1])
                self.place += 1
                out = self.method(out, name) if self._take("(") else self.field(out, name)
            elif self._take("["):
                at = self._or()
                self._need("]")
                out = self.index(out, at)
            else:
                return out

    def _primary(self) -> Typed:
        kind, value = self._peek()
        if kind == "string":
            self.place += 1
            return text(re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), value[1:-1]))
        if kind == "name" and value in ("null", "undefined"):
            self.place += 1
            return null()
        if self._take("(") :
            out = self._or()
            self._need(")")
            return out
        return super()._primary()

    def name(self, value: str) -> Typed:
        if value not in self.scope:
            raise ExpressionError(f"{value!r} is not known")
        return self.scope[value]

    def function(self, name: str) -> Typed:
        args = self._arguments(")")
        a = args[0] if args else null()
        if name == "moment":
            if not args:
                return self._moment(F.date_format(self.today, "yyyy-MM-dd"))
            return self._moment(self._plain(a).column if self._plain(a).kind == "string" else F.lit(None).cast("string"))
        if name == "string":
            return Typed(self._text(a), "string")
        if name == "number":
            return self._number(a)
        if name == "boolean":
            return flag(truthy(a))
        raise ExpressionError(f"{name!r} is no function here")

    # ---- members ----
    def _moment(self, raw: Column) -> Typed:
        return Typed(raw, "moment", fields={"raw": Typed(raw, "string")})

    def _date_field(self, raw: Column) -> Typed:
        return Typed(F.when(F.trim(raw) != "", raw), "date field", fields={"raw": Typed(F.when(F.trim(raw) != "", raw), "string")})

    def _day(self, x: Typed) -> Column:
        raw = F.trim(x.fields["raw"].column)
        return F.when(raw.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(raw))

    def _column(self, name: str) -> Typed:
        return self.columns.get(name) or null()

    def field(self, x: Typed, name: str) -> Typed:
        if x.kind == "task":
            if name in DATE_FIELDS:
                return self._date_field(coerced(self._column(DATE_FIELDS[name]), "string"))
            if name in ("status", "file"):
                return Typed(F.lit(None), f"task {name}")
            if name in FIELDS:
                return self._column(FIELDS[name])
            given = self.columns.get("fields")
            return given.item.at(F.try_element_at(given.column, F.lit(name.lower()))) if given and given.entries and given.item else null()
        if x.kind == "parent task":
            return x.fields.get(FIELDS.get(name, name)) or null()
        if x.kind == "task status":
            return self._column(STATUS[name]) if name in STATUS else null()
        if x.kind == "task file":
            file = self.columns.get("file")
            return (file.fields.get(FILE.get(name, name)) or null()) if file else null()
        if x.kind == "date field":
            return self._of_date(x, name)
        if x.kind == "Math" and name in ("PI",):
            return number(F.lit(3.141592653589793))
        if x.kind == "regexp" and name == "source":
            return text(x.literal[0])
        return super().field(x, name)

    def _of_date(self, x: Typed, name: str) -> Typed:
        raw, day = x.fields["raw"].column, self._day(x)
        if name == "moment":
            return Typed(raw, "moment", fields=x.fields)
        if name == "category":
            rank = F.when(raw.isNull(), 4).when(day.isNull(), 0).when(day < self.today, 1).when(day == self.today, 2).otherwise(3)
            label = F.element_at(F.array(*map(F.lit, ("Invalid date", "Overdue", "Today", "Future", "Undated"))), rank + 1)
            return structure("object", name=Typed(label, "string"), sortOrder=number(rank.cast("double")), groupText=Typed(F.concat(F.lit("%%"), rank.cast("string"), F.lit("%% "), label), "string"))
        if name == "fromNow":
            days = F.datediff(day, self.today)
            n = F.abs(days)
            size = F.concat(n.cast("string"), F.when(n == 1, " day").otherwise(" days"))
            label = F.when(day.isNull(), "").when(days == 0, "today").when(days < 0, F.concat(size, F.lit(" ago"))).otherwise(F.concat(F.lit("in "), size))
            rank = F.coalesce(F.concat(F.date_format(day, "yyyyMMdd"), F.lit("0000")).cast("long"), F.lit(0))
            group = F.when(day.isNull(), "").otherwise(F.concat(F.lit("%%"), rank.cast("string"), F.lit("%% "), label))
            return structure("object", name=Typed(label, "string"), sortOrder=number(rank.cast("double")), groupText=Typed(group, "string"))
        return null()

    def _date_call(self, x: Typed, name: str, args: list[Typed]) -> Typed:
        day, a = self._day(x), args[0] if args else text("")
        iso = F.date_format(day, "yyyy-MM-dd")
        if name == "format" and a.literal is not None:
            return Typed(F.coalesce(date_text(day, a.literal), coerced(args[1], "string") if len(args) > 1 else F.lit("")), "string")
        if name in ("formatAsDate", "formatAsDateAndTime"):
            return Typed(F.coalesce(iso if name == "formatAsDate" else F.concat(iso, F.lit(" 00:00")), coerced(a, "string")), "string")
        if name == "toISOString":
            zone = F.when(truthy(a), "+00:00").otherwise("Z") if args else F.lit("Z")
            return Typed(F.coalesce(F.concat(iso, F.lit("T00:00:00.000"), zone), F.lit("")), "string")
        if name == "toString":
            return Typed(F.coalesce(F.concat(iso, F.lit(" 00:00")), F.lit("")), "string")
        raise ExpressionError(f"a date has no {name!r}")

    def _moment_call(self, x: Typed, name: str, args: list[Typed]) -> Typed:
        day = self._day(x)
        if name == "isValid":
            return flag(day.isNotNull())
        if name == "format":
            return Typed(F.coalesce(date_text(day, args[0].literal), F.lit("")) if args and args[0].literal is not None else F.lit(""), "string")
        if name in ("isSame", "isSameOrBefore", "isSameOrAfter", "isBefore", "isAfter") and args:
            other = self._plain(args[0])
            that = self._day(Typed(other.column, "moment", fields={"raw": other})) if other.kind == "string" else F.lit(None).cast("date")
            a, b = day, that
            if len(args) > 1 and args[1].literal == "week":
                a, b = (F.year(d) * 100 + F.weekofyear(d) for d in (day, that))
            test = {"isSame": a == b, "isSameOrBefore": a <= b, "isSameOrAfter": a >= b, "isBefore": a < b, "isAfter": a > b}[name]
            return flag(F.coalesce(test, F.lit(False)))
        raise ExpressionError(f"a moment has no {name!r}")

    def _task_call(self, x: Typed, name: str, args: list[Typed]) -> Typed:
        if name in ("isBlocked", "isBlocking"):
            return flag(F.coalesce(self._column({"isBlocked": "is_blocked", "isBlocking": "is_blocking"}[name]).column.cast("boolean"), F.lit(False)))
        if name == "findClosestParentTask":
            parent = self.columns.get("parent")
            return Typed(parent.column, "parent task", fields=parent.fields) if parent and parent.fields else null()
        raise ExpressionError(f"a task has no {name!r}")

    def _file_call(self, name: str, args: list[Typed]) -> Typed:
        key = args[0].literal if args else None
        if name not in ("hasProperty", "property") or key is None:
            raise ExpressionError(f"a file has no {name!r}")
        file = self.columns.get("file")
        stored = file.fields.get("frontmatter") if file else None
        value = F.try_variant_get(F.try_parse_json(stored.column), f"$['{key}']", "string") if stored and stored.kind == "string" else F.lit(None).cast("string")
        return flag(value.isNotNull()) if name == "hasProperty" else Typed(value, "string")

    def method(self, x: Typed, name: str) -> Typed:
        if x.kind == "list" and name in ("map", "filter", "some", "every", "find", "flatMap"):
            return self._over(x, name)
        args = self._arguments(")")
        a = args[0] if args else null()
        special = {"date field": self._date_call, "moment": self._moment_call, "task": self._task_call, "parent task": self._task_call}.get(x.kind)
        if special:
            return special(x, name, args)
        if x.kind == "task file":
            return self._file_call(name, args)
        if x.kind == "Math":
            return self._math(name, args)
        if name == "toString":
            return Typed(self._text(x), "string")
        if x.kind == "regexp" and name == "test":
            return flag(F.coalesce(F.regexp_like(coerced(a, "string"), x.column), F.lit(False)) if valid_pattern(x.literal[0]) else F.lit(False))
        if name in ("includes", "startsWith", "endsWith") and x.kind in ("string", "list"):
            return flag(self.holds({"includes": "contains"}.get(name, name.lower()), x, self._plain(a)))
        if x.kind == "null":
            return null()
        found = {"string": self._string_call, "list": self._list_call, "number": self._number_call}.get(x.kind, lambda *_: None)(x, name, args, a)
        if found is None:
            raise ExpressionError(f"{name!r} is not known for a {x.kind}")
        return found

    def _string_call(self, x: Typed, name: str, args: list[Typed], a: Typed) -> Typed | None:
        c = x.column
        plain = {"toUpperCase": F.upper, "toLowerCase": F.lower, "trim": F.trim, "trimStart": F.ltrim, "trimEnd": F.rtrim}
        if name in plain:
            return Typed(plain[name](c), "string")
        if name in ("slice", "substring"):
            return self._slice(x, args)
        if name == "indexOf":
            return number((F.instr(c, coerced(a, "string")) - 1).cast("double"))
        if name == "concat":
            return Typed(F.concat(c, *(self._text(y) for y in args)), "string")
        if name == "replace":
            if a.kind == "string":  # the first place only
                at, new = F.instr(c, a.column), coerced(args[1], "string") if len(args) > 1 else F.lit("undefined")
                return Typed(F.when(at == 0, c).otherwise(F.concat(F.substring(c, F.lit(1), at - 1), new, F.substring(c, at + F.char_length(a.column), F.char_length(c)))), "string")
            return Typed(self._replaced(c, a, args[1] if len(args) > 1 else text("")), "string")
        if name == "replaceAll":
            return Typed(self._replaced(c, a, args[1] if len(args) > 1 else text("")), "string")
        if name == "match" and a.kind == "regexp" and valid_pattern(a.literal[0]):
            # the list of all matches with the flag g, else of the match and its groups; null without a match
            groups = re.compile(re.sub(r"\(\?<(?![=!])", "(?P<", a.literal[0])).groups
            one = F.array(*(F.regexp_extract(c, java_pattern(a.literal), k) for k in range(groups + 1)))
            many = F.regexp_extract_all(c, F.lit(java_pattern(a.literal)), F.lit(0))
            return listed(F.when(F.regexp_like(c, a.column), many if "g" in a.literal[1] else one), Typed(F.lit(None), "string"))
        if name in ("split", "repeat"):
            return self._string_method(x, name, args, a)
        if name == "padStart":
            return Typed(F.lpad(c, F.greatest(coerced(a, "number").cast("int"), F.char_length(c)), coerced(args[1], "string") if len(args) > 1 else F.lit(" ")), "string")
        return Typed(F.substring(c, coerced(a, "number").cast("int") + 1, F.lit(1)), "string") if name == "charAt" else None

    def _list_call(self, x: Typed, name: str, args: list[Typed], a: Typed) -> Typed | None:
        c = x.column
        if name == "join":
            return Typed(F.array_join(F.transform(c, lambda v: self._text(x.item.at(v))), a.literal if a.literal is not None else ","), "string") if x.item else None
        if name == "slice":
            return self._slice(x, args)
        if name == "concat":
            return listed(F.concat(c, *(y.column if y.kind == "list" else F.array(y.column) for y in args)), x.item)
        if name == "indexOf":
            return number((F.array_position(c, a.column) - 1).cast("double"))
        if name in ("reverse", "sort"):
            return self._list_method(x, name, args, a)
        return self._list_method(x, "flat", args, a) if name == "flat" else None

    def _number_call(self, x: Typed, name: str, args: list[Typed], a: Typed) -> Typed | None:
        return self._number_method(x, "tofixed", args, a) if name == "toFixed" else None

    def _math(self, name: str, args: list[Typed]) -> Typed:
        values = [coerced(x, "number") for x in args]
        if name in ("min", "max") and values:
            return number(values[0] if len(values) == 1 else (F.least if name == "min" else F.greatest)(*values))
        plain = {"floor": F.floor, "ceil": F.ceil, "abs": F.abs, "sqrt": F.sqrt, "round": lambda c: F.floor(c + 0.5)}
        if name not in plain or not values:
            raise ExpressionError(f"Math has no {name!r} here")
        return number(plain[name](values[0]).cast("double"))

    def _over(self, x: Typed, name: str) -> Typed:
        """Methods of lists that take an arrow function."""
        if not self._arrow_ahead():
            raise ExpressionError(f"{name!r} needs an arrow function")
        model, at = x.item or null(), self.place

        def body(value: Column, index: Column) -> Typed:
            self.place, outer = at, self.scope
            self.scope = self.scope | {"value": null()}
            names = self._parameters()
            self.scope = outer | dict(zip(names, (model.at(value), number(index.cast("double"))), strict=False))
            self._need("=>")
            out = self._block("}") if self._take("{") else self._or()
            self.scope = outer
            return out

        made = body(model.column, F.lit(0))
        end = self.place
        if name == "filter" or name == "find":
            column = F.filter(x.column, lambda v, i: truthy(body(v, i)))
            out = listed(column, model) if name == "filter" else model.at(F.try_element_at(column, F.lit(1)))
        elif name in ("some", "every"):
            flags = F.transform(x.column, lambda v, i: truthy(body(v, i)))
            out = flag(F.coalesce((F.exists if name == "some" else F.forall)(flags, lambda f: f), F.lit(name == "every")))
        else:
            out = listed(F.transform(x.column, lambda v, i: body(v, i).column), made)
            if name == "flatMap" and made.kind == "list" and made.item:
                out = listed(F.flatten(out.column), made.item)
        self.place = end
        self._need(")")
        return out


Script = str | Callable[[dict[str, Column]], Column]


def compile_script(source: Script, tasks: DataFrame, today: str, query: dict[str, str] | None = None) -> Typed:
    """The value of a function for each row of ``tasks``. Raises ``ExpressionError`` for what is not understood."""
    if callable(source):
        made = source({c: F.col(f"`{c}`") for c in tasks.columns})
        return scope_of(tasks.select(made.alias("x")))["x"].at(made)
    out = ScriptCompiler(scope_of(tasks), today, query).program(source)
    if out.kind in ("date field", "moment"):
        out = Typed(F.coalesce(F.concat(F.date_format(F.try_to_date(out.fields["raw"].column), "yyyy-MM-dd"), F.lit(" 00:00")), F.lit("")), "string")
    return out if out.kind in ("null", "boolean", "number", "string", "date", "list") or out.kind in STRUCTURED else null()
