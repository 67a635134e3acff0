"""Main text of a web page by the distribution of its line blocks."""

from __future__ import annotations

import html
import re
from itertools import groupby
from operator import itemgetter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mdspark.llm.common import small_arrow_batches

#: Lines in a sliding window, text that a window needs at a surge, share of link text at which a line counts as empty.
WINDOW, SURGE, LINKED = 3, 80, 0.5
#: On a page without such a window, the share of its text that a window needs.
SHARE = 0.2
#: What a character of a script without spaces weighs, and the characters that make a paragraph of links text outside of articles.
DENSE, SENTENCE = 3, 25
#: Elements with no main text in them.
DROPPED = frozenset(
    "head script style noscript template svg math iframe object nav header footer aside button select textarea menu dialog audio video canvas map".split()
)
#: Elements whose content is not markup.
RAW = frozenset("script style noscript template textarea title iframe svg".split())
BLOCKS = frozenset(
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre hr figure figcaption address details summary center fieldset legend".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote dd figcaption".split())
#: Classes, ids and roles of what is never the article.
OTHERS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored cookie cookies consent notice notices alert popup modal newsletter subscribe subscription signup login share sharing comment comments reply replies respond disqus related recommended pagination pager copyright legal disclaimer breadcrumb breadcrumbs".split()
)
#: Those of parts of a page's layout, which may stand around the article as well.
LAYOUT = frozenset(
    "banner promo promotion nav navbar navigation menu sidebar side aside rail footer header masthead overlay social widget toolbar complementary contentinfo search form skip".split()
)
FORMS = frozenset(("form", "aria-hidden"))
#: Words that mark an element as a part of its class or id, too, as in comment-list, unless one of NOT stands before them.
COMPOUND = frozenset(
    "advert adverts advertisement advertising sponsor sponsored cookie cookies consent notice popup modal newsletter comment comments disqus related breadcrumb breadcrumbs promo nav navbar menu sidebar".split()
)
NOT = frozenset("has no not with without is show hide hides enable enabled disable disabled".split())
_NAME = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*)")
#: The end of a tag, beyond quoted values.
_TAG_END = re.compile(r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>")
#: Attributes in order, so that no value is read as a name.
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACE = re.compile(r"\s+")
_DENSE = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")


def _word(token: str) -> str | None:
    """The word that marks an element of this class, id or role."""
    if token in OTHERS or token in LAYOUT:
        return token
    parts = re.split("[-_]+", token)
    return None if len(parts) < 2 or parts[0] in NOT else next((w for w in parts if w in COMPOUND), None)


def _mark(tag: str, attributes: str) -> str | None:
    """What marks the element: a word of OTHERS before one of LAYOUT, form, aria-hidden; hidden, if it is not shown at all; else None."""
    found = "form" if tag == "form" else None
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values).lower()
        if name == "hidden" and value != "false":
            return "hidden"
        if name == "aria-hidden" and value != "false":
            found = found or name
        elif name in ("class", "id", "role"):
            words = [w for w in map(_word, value.split()) if w]
            found = next((w for w in words if w in OTHERS), found or next(iter(words), None))
    return found


class _Tags:
    """Comments, declarations and tags of a page in order, in one pass.

    A tag with a quote that nothing closes ends at the next ``>``; from there on quotes are not
    heeded, so that no part of the page is searched twice.
    """

    def __init__(self, page: str):
        self.page, self.broken = page, False

    def next(self, at: int) -> tuple[int, int, str, str, str] | None:
        """(start, end, / of an end tag, name, attributes) of the next one from ``at``; no name for what is no tag."""
        page = self.page
        while (start := page.find("<", at)) >= 0:
            if page.startswith(("<!", "<?"), start):
                comment = page.startswith("<!--", start)
                end = page.find("-->" if comment else ">", start + 2 + 2 * comment)
                return start, len(page) if end < 0 else end + (3 if comment else 1), "", "", ""
            if name := _NAME.match(page, start):
                end = None if self.broken else _TAG_END.match(page, name.end())
                stop = end.end() if end else page.find(">", name.end()) + 1
                if not stop:  # cut off
                    return start, len(page), "", "", ""
                self.broken = self.broken or not end
                return start, stop, name[1], name[2].lower(), page[name.end() : stop - 1]
            at = start + 1
        return None


class Line(NamedTuple):
    text: str
    #: Characters of links in it.
    linked: int
    #: Number of the outermost article or main around it, else 0.
    article: int
    #: Marks around it, outermost first.
    marks: tuple[str, ...]
    #: Whether it is a paragraph or heading.
    paragraph: bool

    def weight(self) -> int:
        links = self.linked > LINKED * len(self.text) and not (self.paragraph and (self.article or len(self.text) >= SENTENCE))
        return 0 if links else len(self.text) + (DENSE - 1) * len(_DENSE.findall(self.text))


def lines(page: str) -> list[Line]:
    """The lines of a page; dropped parts give empty ones.

    A dropped or marked element ends with its own end tag, a marked one also with that of a marked
    one around it; one that is no article's part ends where an article begins. A tag of a dropped
    element that nothing ends drops nothing, and if nesting leaves one open, the first end tag
    ends it.
    """
    out, open_at = _lines(page, None)
    return out if open_at is None else _lines(page, open_at)[0]


def _lines(page: str, flat_from: int | None) -> tuple[list[Line], int | None]:
    """The lines, and where a dropped element began that was open at the end. From ``flat_from`` on dropped elements do not nest."""
    out: list[Line] = []
    text: list[str] = []
    linked, at, article, number, anchor, paragraph = 0, 0, 0, 0, 0, False
    dropped, depth, since = "", 0, 0
    marks: list[list] = []  # mark, tag, open elements of that tag, whether it is in a link
    ends: dict[str, int] = {}
    whole = page.lower()

    def ended(tag: str, at: int) -> bool:
        if tag not in ends:
            ends[tag] = whole.rfind(f"</{tag}")
        return ends[tag] >= at

    def add(joined: str) -> None:
        out.append(Line(joined, min(linked, len(joined)), number if article else 0, tuple(m[0] for m in marks), paragraph))

    def flush() -> None:
        nonlocal linked
        joined = _SPACE.sub(" ", "".join(text)).strip()
        text.clear()
        if joined:
            add(joined)
        linked = 0

    size, tags = len(page), _Tags(page)
    while at < size:
        found = tags.next(at)
        if not dropped and (plain := page[at : found[0] if found else size]):
            plain = html.unescape(plain)
            text.append(plain)
            linked += len(plain) if anchor else 0
        if not found:
            break
        _, at, closing, tag, attributes = found
        if not tag:
            continue
        begins = tag in ("article", "main") and not closing and not article and (not (mark := _mark(tag, attributes)) or (tag == "main" and mark != "hidden"))
        if dropped:
            if begins and dropped not in ("article", "main"):
                dropped = ""
                add("")
            else:
                if tag == dropped and not attributes.endswith("/"):
                    depth = 0 if closing and flat_from is not None and since >= flat_from else depth + (-1 if closing else 1)
                    if not depth:
                        dropped = ""
                        add("")
                if tag in RAW and not closing:
                    at = _raw_end(page, at, tag)
                    if tag == dropped and (depth := depth - 1) == 0:
                        dropped = ""
                        add("")
                continue
        mark = None if closing or tag in VOID or tag in ("html", "body", "main") else _mark(tag, attributes)
        if not closing and tag not in VOID and (tag in DROPPED or tag in RAW or mark == "hidden") and (tag in RAW or mark == "hidden" or ended(tag, at)):
            if tag in RAW:
                if tag not in ("script", "style"):
                    flush()
                at = _raw_end(page, at, tag)
            elif not attributes.endswith("/"):
                flush()
                dropped, depth, since = tag, 1, found[0]
            continue
        if begins and marks:
            flush()
            anchor = marks[0][3]
            marks.clear()
        for k, opened in enumerate(marks):
            if opened[1] == tag and not attributes.endswith("/"):
                opened[2] += -1 if closing else 1
            if not opened[2] or (opened[1] == "p" and tag in BLOCKS):
                flush()
                anchor = opened[3]
                del marks[k:]
                break
        if mark and not attributes.endswith("/"):
            flush()
            marks.append([mark, tag, 1, anchor])
        if tag in ("article", "main"):
            flush()
            number += not closing and not article
            article = max(0, article + (-1 if closing else 1))
        elif tag in BLOCKS or tag in DROPPED:
            flush()
            paragraph = tag in PARAGRAPHS and not closing
        elif tag == "br":
            text.append(" ")
        elif tag == "a":
            anchor = 0 if closing else 1
    flush()
    return out, since if dropped and flat_from is None else None


def _raw_end(page: str, at: int, tag: str) -> int:
    end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
    return end.end() if end else len(page)


def _regions(weights: list[int], surge: float) -> list[bool]:
    """Lines of some weight between a surge and the next dive."""
    sums = [sum(weights[k : k + WINDOW]) for k in range(len(weights))]
    keep, inside = [False] * len(weights), False
    for k, weight in enumerate(weights):
        if not inside and sums[k] >= surge and weight:
            inside = True
        elif inside and not sums[k]:
            inside = False
        keep[k] = inside and weight > 0
    return keep


def _kept(weights: list[int], articles: list[int], surge: float) -> list[bool]:
    """The regions, widened to the articles they touch; what they have outside of these must be a region by itself."""
    keep = _regions(weights, surge)
    touched = {a for a, k in zip(articles, keep, strict=True) if k and a}
    if not any(keep):
        touched = set(articles) - {0}
    if not touched:
        return keep
    alone: list[bool] = []
    for _, run in groupby(zip(articles, weights, strict=True), key=itemgetter(0)):
        alone += _regions([w for _, w in run], surge)
    return [w > 0 and (a in touched if a else k) for w, a, k in zip(weights, articles, alone, strict=True)]


def _chosen(found: list[Line], weights: list[int], allowed: frozenset, depth: int, share: float | None) -> list[bool]:
    """What is kept of the lines in at most ``depth`` marked elements, of ``allowed`` marks; each run of other lines is one empty line."""
    at = [k if len(line.marks) <= depth and allowed.issuperset(line.marks) else -1 for k, line in enumerate(found)]
    at = [k for n, k in enumerate(at) if k >= 0 or not n or at[n - 1] >= 0]
    some = [weights[k] if k >= 0 else 0 for k in at]
    surge = SURGE if share is None else min(SURGE, max(1, share * sum(some)))
    kept = _kept(some, [found[k].article if k >= 0 else found[at[n - 1]].article if n else 0 for n, k in enumerate(at)], surge)
    keep = [False] * len(found)
    for k, yes in zip(at, kept, strict=True):
        if k >= 0:
            keep[k] = yes
    return keep


def main_text(page: str) -> str:
    """Lines between surge and dive points, joined by one line feed.

    The weight of a line is the length of its text, more in scripts without spaces, and nothing if
    most of it is links, unless it is a paragraph. A surge is where the windows' sums come to
    SURGE; the dive is where a whole window is empty again. An article or main element that a kept
    region touches is kept but for its lines of links; lines outside stay if they are a region
    without its text. If a page has no region, its articles, too short for a surge, are kept
    likewise.

    What stands in an element marked by a word of OTHERS, such as comments, is never kept. Other
    marked elements, such as forms and sidebars, are kept only if the lines outside of them have
    neither a region nor an article: forms before the others, the outermost ones, without those
    within them, before the next. On a page without any of that, a surge needs but SHARE of its text.
    """
    found = lines(page)
    weights = [line.weight() for line in found]
    deepest = max((len(line.marks) for line in found), default=0)
    steps = [(FORMS, depth) for depth in range(deepest + 1)] + [(FORMS | LAYOUT, depth) for depth in range(1, deepest + 1)]
    for share in (None, SHARE):
        for allowed, depth in steps:
            keep = _chosen(found, weights, allowed, depth, share)
            if any(keep):
                return "\n".join(line.text for line, k in zip(found, keep, strict=True) if k and line.text)
    return ""


def extract_main_text(df: DataFrame, column: str = "html", to: str = "text") -> DataFrame:
    """``df`` with the main text of each page in column ``to`` (which replaces a column so named).

    Null and empty pages, and pages without such text, give an empty text. Whole pages are read,
    in time that grows with their length; nothing is cut or capped. Each row by itself: no
    shuffle, rows that repeat repeat their text, other columns stay as they are.
    """
    small_arrow_batches(df.sparkSession)

    @F.arrow_udf("string")
    def extract(pages: pa.Array) -> pa.Array:
        return pa.array([main_text(p.as_py() or "") for p in pages], pa.string())

    return df.withColumn(to, extract(column))
