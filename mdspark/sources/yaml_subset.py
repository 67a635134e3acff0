"""Properties at the head of a note: block mappings and lists, flow collections, plain, quoted, literal and folded texts, anchors and aliases, tags.

Scalars are those of YAML 1.2: dates, yes and no are texts, as are digits after a leading zero. A
value with a tag of its own is an object of the tag and the value; numbers that JSON lacks are
null; ``<<`` is a name like others. A name that is given twice makes the block unreadable. Names
that are collections (``? ...``) and several documents are not read.
"""

from __future__ import annotations

import copy
import math
import re
from typing import Any


class PropertyError(ValueError):
    pass


#: What stands after a backslash in a text in double quotes.
_ESCAPES = {
    "0": "\0", "a": "\a", "b": "\b", "t": "\t", "\t": "\t", "n": "\n", "v": "\v", "f": "\f", "r": "\r", "e": "\x1b", " ": " ", '"': '"', "/": "/", "\\": "\\",
    "N": "\x85", "_": "\xa0", "L": "\u2028", "P": "\u2029",
}
_QUOTED = re.compile(r"""\s*("(?:\\.|[^"\\])*"|'(?:''|[^'])*'(?!'))""", re.S)


def scalar(text: str) -> Any:
    """null, booleans, numbers, quoted and plain strings, flow lists and objects."""
    return _value(text, None, {})


def _value(text: str, tag: str | None, anchors: dict[str, Any]) -> Any:
    text = text.strip()
    if text[:1] in ("[", "{"):
        value, rest = _flow(text, 0, anchors)
        if text[rest:].strip():
            raise PropertyError(text)
        return _tagged(tag, value)
    return _tagged(tag, text if tag in ("!", "!!str") and text[:1] not in ("'", '"') else _plain(text))


def _tagged(tag: str | None, value: Any) -> Any:
    """The value as its tag has it."""
    if tag is None or tag in ("!", "!!str", "!!seq", "!!map", "!!null") or not re.match(r"!(?!!)|!!(int|float|bool)$", tag):
        return value
    if not tag.startswith("!!"):
        return {tag: value}
    read = _plain(value) if isinstance(value, str) else value
    kind = {"!!int": int, "!!float": float, "!!bool": bool}[tag]
    if kind is float and isinstance(read, int) and not isinstance(read, bool):
        read = float(read)
    if type(read) is not kind:
        raise PropertyError(f"{tag} {value}")
    return read


def _escaped(m: re.Match) -> str:
    code = m[1] or m[2] or m[3]
    if code:
        return chr(int(code, 16))
    if m[4] not in _ESCAPES:
        raise PropertyError(m[0])
    return _ESCAPES[m[4]]


def _folded(text: str, double: bool) -> str:
    """Lines of a quoted text as one: a line feed is a space, as many empty lines are as many line feeds; a backslash before one joins the lines as they are."""
    first, *lines = text.split("\n")
    out, empty = first, 0
    for k, line in enumerate(lines, 1):
        line = line.lstrip(" \t")
        if not line.strip() and k < len(lines):
            empty += 1
            continue
        if double and not empty and (len(out) - len(out.rstrip("\\"))) % 2:
            out = out[:-1] + line
        else:
            out = out.rstrip(" \t") + ("\n" * empty or " ") + line
        empty = 0
    return out


def _plain(text: str) -> Any:
    if len(text) > 1 and text[0] == text[-1] == '"':
        return re.sub(r"\\(?:x([0-9A-Fa-f]{2})|u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", _escaped, _folded(text[1:-1], True), flags=re.S)
    if len(text) > 1 and text[0] == text[-1] == "'":
        return _folded(text[1:-1], False).replace("''", "'")
    if text in ("null", "Null", "NULL", "~", ""):
        return None
    if text in ("true", "True", "TRUE", "false", "False", "FALSE"):
        return text.lower() == "true"
    if m := re.fullmatch(r"([-+]?)0(?:x([0-9A-Fa-f]+)|o([0-7]+)|b([01]+))", text):
        return int(m[1] + (m[2] or m[3] or m[4]), 16 if m[2] else 8 if m[3] else 2)
    if re.fullmatch(r"[-+]?0\d+", text):
        return text
    if re.fullmatch(r"[-+]?\d+", text):
        whole = int(text)
        return whole if -(1 << 63) <= whole < 1 << 64 else float(whole)
    if re.fullmatch(r"[-+]?\.(inf|Inf|INF)|\.(nan|NaN|NAN)", text):
        return None
    if re.fullmatch(r"[-+]?(\d+\.\d*|\.?\d+)([eE][-+]?\d+)?", text):
        fraction = float(text)
        return fraction if math.isfinite(fraction) else text
    return text


_ATOM = re.compile(r"""\s*("(?:\\.|[^"\\])*"|'(?:''|[^'])*'|[^,\[\]{}:]*(?::(?=\S)[^,\[\]{}:]*)*)\s*""")
_PROPERTY = re.compile(r"\s*([&!][^\s,\[\]{}]*)(?:\s+|(?=[,\]}])|$)")


def _flow(text: str, at: int, anchors: dict[str, Any]) -> tuple[Any, int]:
    """A value that begins at ``at``, and where it ends."""
    anchor = tag = None
    while m := _PROPERTY.match(text, at):
        anchor, tag = (m[1][1:], tag) if m[1][0] == "&" else (anchor, m[1])
        at = m.end()
    while at < len(text) and text[at].isspace():
        at += 1
    opening = text[at : at + 1]
    if opening not in ("[", "{"):
        m = _ATOM.match(text, at)
        word, at = m[1].strip(), m.end()
        value = _alias(word[1:], anchors) if word[:1] == "*" else _value(word, tag, anchors)
    else:
        value, at = _collection(text, at, anchors)
        value = _tagged(tag, value)
    if anchor:
        anchors[anchor] = value
    return value, at


def _alias(name: str, anchors: dict[str, Any]) -> Any:
    if name not in anchors:
        raise PropertyError(f"*{name}")
    return copy.deepcopy(anchors[name])


def _collection(text: str, at: int, anchors: dict[str, Any]) -> tuple[Any, int]:
    out: Any = [] if text[at] == "[" else {}
    closing, at = {"[": "]", "{": "}"}[text[at]], at + 1
    while True:
        while at < len(text) and (text[at].isspace() or text[at] == ","):
            at += 1
        if at >= len(text):
            raise PropertyError(text)
        if text[at] == closing:
            return out, at + 1
        before = at
        value, at = _flow(text, at, anchors)
        if closing == "}":
            name = value if isinstance(value, str) else text[before:at].strip()
            value = None
            if text[at : at + 1] == ":":
                value, at = _flow(text, at + 1, anchors)
            if name in out:
                raise PropertyError(f"{name} is given twice")
            out[name] = value
        else:
            out.append(value)
        if at == before:
            raise PropertyError(text)


_KEY = re.compile(r"""("(?:\\.|[^"\\])*"|'(?:''|[^'])*'|[^\s#:\[\]{}"'][^:]*?(?::(?=\S)[^:]*?)*)\s*:(?:\s+(.*))?$""")


def _uncommented(line: str) -> str:
    """Without a comment, which begins after white space and outside of quotes."""
    quote = ""
    for k, c in enumerate(line):
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'" and (k == 0 or line[k - 1] in " \t[{,:-"):
            quote = c
        elif c == "#" and (k == 0 or line[k - 1].isspace()):
            return line[:k].rstrip()
    return line.rstrip()


class _Block:
    def __init__(self, text: str):
        self.lines, self.at = text.split("\n"), 0
        self.anchors: dict[str, Any] = {}

    def peek(self) -> tuple[int, str] | None:
        """Indentation and text of the next line that has some."""
        while self.at < len(self.lines):
            line = _uncommented(self.lines[self.at].expandtabs(4))
            if line.strip():
                return len(line) - len(line.lstrip()), line.strip()
            self.at += 1
        return None

    def value(self, indent: int) -> Any:
        found = self.peek()
        if not found or found[0] < indent:
            return None
        return self.items(found[0]) if found[1].startswith("- ") or found[1] == "-" else self.mapping(found[0])

    def items(self, indent: int) -> list:
        out = []
        while (found := self.peek()) and found[0] == indent and (found[1] == "-" or found[1].startswith("- ")):
            rest = found[1][1:].strip()
            if rest and _KEY.match(rest) and rest[0] not in "\"'[{":
                # a mapping that begins on the dash's line
                inside = indent + len(found[1]) - len(rest)
                self.lines[self.at] = " " * inside + rest
                out.append(self.mapping(inside))
            else:
                self.at += 1
                out.append(self.node(rest, indent))
        return out

    def mapping(self, indent: int) -> dict:
        out: dict = {}
        while (found := self.peek()) and found[0] == indent:
            m = _KEY.match(found[1])
            if not m:
                raise PropertyError(found[1])
            self.at += 1
            name, rest = str(_plain(m[1].strip())) if m[1][0] in "\"'" else m[1].strip(), (m[2] or "").strip()
            if name in out:
                raise PropertyError(f"{name} is given twice")
            out[name] = self.node(rest, indent, True)
        if found and found[0] > indent:
            raise PropertyError(found[1])
        return out

    def node(self, rest: str, indent: int, named: bool = False) -> Any:
        """The value of a name or a dash: what follows on its line, or stands below."""
        anchor = tag = None
        while m := _PROPERTY.match(rest):
            anchor, tag = (m[1][1:], tag) if m[1][0] == "&" else (anchor, m[1])
            rest = rest[m.end() :].strip()
        if rest[:1] == "*":
            return _alias(rest[1:].strip(), self.anchors)
        if rest:
            value = self.after(rest, indent, tag)
        else:
            below = self.peek()
            listed = named and below and below[0] == indent and (below[1] == "-" or below[1].startswith("- "))
            value = self.items(indent) if listed else self.value(indent + 1)
            value = _tagged(tag, "" if value is None and tag == "!!str" else value)
        if anchor:
            self.anchors[anchor] = value
        return value

    def after(self, rest: str, indent: int, tag: str | None = None) -> Any:
        """What follows a name or a dash on its line, and the lines that go on with it."""
        if re.fullmatch(r"[|>](?:[-+]?\d?|\d[-+])", rest):
            return _tagged(tag, self.text(rest, indent))
        if rest[0] in "\"'":
            whole = rest
            while not (m := _QUOTED.match(whole)):
                if self.at >= len(self.lines):
                    raise PropertyError(rest)
                whole += "\n" + self.lines[self.at]
                self.at += 1
            if whole[m.end() :].strip() and not re.match(r"\s+#", whole[m.end() :]):
                raise PropertyError(whole)
            return _value(m[1], tag, self.anchors)
        whole = rest
        if rest[0] in "[{":
            closing = {"[": "]", "{": "}"}[rest[0]]
            while whole.count(rest[0]) > whole.count(closing) and (found := self.peek()):
                whole += " " + found[1]
                self.at += 1
        else:
            while True:
                before = self.at
                found = self.peek()
                if not found or found[0] <= indent or _KEY.match(found[1]):
                    break
                whole += ("\n" * sum(not x.strip() for x in self.lines[before : self.at]) or " ") + found[1]
                self.at += 1
        return _value(whole, tag, self.anchors)

    def text(self, style: str, indent: int) -> str:
        """A literal text (|) or a folded one (>); - drops the last line feed, + keeps all."""
        taken = []
        while self.at < len(self.lines):
            line = self.lines[self.at]
            if line.strip() and len(line) - len(line.lstrip()) <= indent:
                break
            taken.append(line)
            self.at += 1
        kept = [t for t in taken if t.strip()]
        given = re.search(r"\d", style)
        depth = indent + int(given[0]) if given else min((len(t) - len(t.lstrip()) for t in kept), default=0)
        lines = [t[depth:] if t.strip() else "" for t in taken]
        body = "\n".join(lines)
        if style[0] == ">":
            body = re.sub(r"(?<!\n)\n(?!\n| )", " ", body.rstrip("\n")) + body[len(body.rstrip("\n")) :]
            body = re.sub(r"\n\n", "\n", body)
        if "+" in style:
            return body + "\n"
        return body.rstrip("\n") + ("" if "-" in style or not kept else "\n")


def properties(block: str) -> Any:
    """The value of a block: a mapping, or null for one of comments only. ``PropertyError`` for what cannot be read."""
    reader = _Block(block)
    found = reader.peek()
    if not found:
        return None
    value = _value("\n".join(map(_uncommented, reader.lines)), None, reader.anchors) if found[1][0] in "{[" else reader.value(0)
    if found[1][0] not in "{[" and reader.peek():
        raise PropertyError(reader.peek()[1])
    return value
