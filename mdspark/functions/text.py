"""Text functions as Columns: search tokens, snippets, note paths, inline tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The ranges whose runs are indexed as bigrams.
CJK_RANGES = ((0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xAC00, 0xD7AF))
CJK = "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in CJK_RANGES)
SNIPPET_CHARS = 180


def search_tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits and ``_``; runs of CJK characters as overlapping bigrams, a single one by itself."""
    word = rf"[{CJK}]+|[\p{{IsAlphabetic}}\p{{N}}_&&[^{CJK}]]+"
    runs = F.regexp_extract_all(F.lower(text), F.lit(word), F.lit(0))

    def split(run: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.char_length(run) - 1), lambda i: F.substring(run, i, F.lit(2)))
        return F.when(run.rlike(f"^[{CJK}]") & (F.char_length(run) > 1), pairs).otherwise(F.array(run))

    # a text without such characters, as most are, is searched for plain words once
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{IsAlphabetic}\p{N}_]+"), F.lit(0))
    return F.when(~text.rlike(f"[{CJK}]"), words).otherwise(F.flatten(F.transform(runs, split)))


def _folded() -> tuple[str, str]:
    """Letters with marks and the letters without them, and the marks themselves, by the canonical decomposition."""
    import unicodedata

    one, other, marks = [], [], []
    for code in [*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000)]:
        bare = "".join(c for c in unicodedata.normalize("NFD", chr(code)) if not unicodedata.combining(c))
        if len(bare) == 1 and bare != chr(code):
            one.append(chr(code))
            other.append(bare)
    marks = [chr(c) for c in range(0x300, 0x370)]
    return "".join(one + marks), "".join(other)


def fold(text: Column) -> Column:
    """Without diacritics; texts in ASCII are left alone."""
    return F.when(text.rlike(r"[^\x00-\x7f]"), F.translate(text, *_folded())).otherwise(text)


def index_terms(text: Column) -> Column:
    """What search tokens are in the index: without diacritics, parted at ``_``.

    Texts without CJK characters and marks of their own are searched once, after a translation of
    their letters, none of which makes or ends a word. The others are taken token by token.
    """
    low, (one, other) = F.lower(text), _folded()
    found = lambda where, word: F.regexp_extract_all(where, F.lit(word), F.lit(0))
    parts = F.flatten(F.transform(search_tokens(text), lambda t: F.split(fold(t), "_+")))
    letters = found(F.translate(low, one[: len(other)], other), r"[\p{IsAlphabetic}\p{N}]+")
    return (
        F.when(~low.rlike(r"[^\x00-\x7f]"), found(low, "[a-z0-9]+"))
        .when(~low.rlike(rf"[{CJK}\x{{300}}-\x{{36f}}]"), letters)
        .otherwise(F.filter(parts, lambda t: t != ""))
    )


def query_phrases(query: str) -> list[list[str]]:
    """The search tokens of a query, each a phrase of the terms it is parted into."""
    one, other = _folded()
    table = str.maketrans({c: (other[k] if k < len(other) else None) for k, c in enumerate(one)})
    phrases = ([p for p in t.translate(table).split("_") if p] for t in query_tokens(query))
    return [p for p in phrases if p]


def query_tokens(query: str) -> list[str]:
    """The same tokens of a query text, on the driver."""
    import regex

    out: list[str] = []
    cjk = "".join(f"{chr(a)}-{chr(b)}" for a, b in CJK_RANGES)
    for run in regex.findall(rf"[{cjk}]+|(?:(?![{cjk}])[\p{{Alphabetic}}\p{{N}}_])+", query.lower()):
        many = regex.match(f"[{cjk}]", run) and len(run) > 1
        out += [run[k : k + 2] for k in range(len(run) - 1)] if many else [run]
    return out


def snippet(body: Column, query: str, chars: int = SNIPPET_CHARS) -> Column:
    """The body, or a window of ``chars`` around the first place of the whole query, with ellipses where it is cut."""
    at = F.greatest(F.instr(F.lower(body), query.lower()) - 1, F.lit(0))
    start = F.greatest(at - chars // 2, F.lit(0))
    end = F.least(start + chars, F.char_length(body))
    window = F.concat(
        F.when(start > 0, "… ").otherwise(""), F.replace(F.substring(body, start + 1, end - start), F.lit("\n"), F.lit(" ")), F.when(end < F.char_length(body), " …").otherwise("")
    )
    return F.when(F.char_length(body) <= chars, F.replace(body, F.lit("\n"), F.lit(" "))).otherwise(window)


def normalize_target(target: Column) -> Column:
    """Without ``.md``, with forward slashes, without a leading ``./`` and outer slashes, lower-cased."""
    bare = F.regexp_replace(F.regexp_replace(target, r"\.md$", ""), r"\\", "/")
    return F.lower(F.regexp_replace(F.regexp_replace(bare, r"^\./", ""), "^/+|/+$", ""))


def collapse_path(path: Column) -> Column:
    """``.`` and ``..`` resolved, lower-cased."""
    def step(done: Column, part: Column) -> Column:
        up = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(part.isin("", "."), done).when(part == "..", up).otherwise(F.concat(done, F.array(part)))

    return F.lower(F.array_join(F.aggregate(F.split(path, "/"), F.expr("cast(array() as array<string>)"), step), "/"))


#: A wiki link, or an inline link or image with its address.
_LINK = r"!?\[\[[^\[\]]+\]\]|!?\[[^\]\[]*\]\(<?[^)>\s]+>?(?:\s+\"[^\"]*\")?\)"


def line_links(text: Column) -> Column:
    """array<struct<raw_target, path, heading, embed>> of the links in a text, in order, first of each.

    Addresses outside and links within the page are left out. ``path`` is where the link leads:
    without ``./`` and outer slashes, with ``.md`` where it has no extension.
    """
    found = F.regexp_extract_all(text, F.lit(_LINK), F.lit(0))

    def one(link: Column) -> Column:
        wiki = F.regexp_extract(link, r"^!?\[\[([^\[\]|]+)", 1)
        inline = F.regexp_extract(link, r"\]\(<?([^)>\s]+)", 1)
        target = F.trim(F.when(wiki != "", wiki).otherwise(unescaped(inline)))
        page = F.trim(F.regexp_extract(target, "^([^#]*)", 1))
        heading = F.regexp_extract(target, "#(.*)$", 1)
        path = F.regexp_replace(F.regexp_replace(F.replace(page, F.lit("\\"), F.lit("/")), r"^(\./)+", ""), "^/+|/+$", "")
        path = F.when(path.rlike(r"[^/.][^/]*\.[^/]*$"), path).otherwise(F.concat(path, F.lit(".md")))
        return F.struct(page.alias("raw_target"), path.alias("path"), F.when(heading != "", heading).alias("heading"), F.startswith(link, F.lit("!")).alias("embed"))

    inside = F.filter(F.transform(found, one), lambda l: (l["raw_target"] != "") & ~l["raw_target"].rlike(r"(?i)^(https?:|mailto:|data:|file:|//)"))
    none = F.expr("cast(array() as array<struct<raw_target: string, path: string, heading: string, embed: boolean>>)")
    return F.when(F.contains(text, F.lit("](")) | F.contains(text, F.lit("[[")), F.array_distinct(inside)).otherwise(F.when(text.isNotNull(), none))


def unescaped(address: Column) -> Column:
    """Percent signs decoded; what is not valid stays as it is."""
    return F.coalesce(F.try_url_decode(F.replace(address, F.lit("+"), F.lit("%2B"))), address)


def inline_tags(body: Column) -> Column:
    """Distinct ``#tag`` names in order, outer slashes trimmed."""
    # fixed value: the characters of a tag, and what may not stand before its sign
    found = F.regexp_extract_all(body, F.lit(r"(?:^|[^A-Za-z0-9_])#([A-Za-z0-9_/-]+)"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, lambda t: F.regexp_replace(t, "^/+|/+$", "")), lambda t: t != ""))
