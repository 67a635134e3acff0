"""Page rows: the properties of a note at the root, a copy of them in ``note``, and its ``file``.

Any table can be pages too: its columns are the properties and one of them is the path.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mdspark.functions.text import inline_tags

LINK = "struct<path: string, display: string, embed: boolean>"
NO_LINKS = f"cast(array() as array<{LINK}>)"
_WIKI = r"^\s*\[\[[\s\S]*\]\]\s*$"


def link_index(links: DataFrame, notes: DataFrame, backlinks: bool = True) -> DataFrame:
    """(path, links, embeds, backlinks): the resolved links of each note by source and by target, in order.

    ``links`` has source_path, ordinal, raw_target, is_embed and target_path. A link shows the
    title of its note, or is what was written where there is none. Backlinks are a list in one
    row, so a note that very many link to makes a large row; leave them out where they are not
    needed.
    """
    titles = notes.select(F.col("path").alias("target_path"), F.col("title").alias("_title"))
    named = links.join(titles, "target_path", "left")
    link = F.struct(F.coalesce("target_path", "raw_target").alias("path"), F.coalesce("_title", "raw_target").alias("display"), F.col("is_embed").alias("embed"))
    out = named.groupBy(F.col("source_path").alias("path")).agg(F.sort_array(F.collect_list(F.struct("ordinal", link.alias("link")))).alias("_l"))
    out = out.select("path", F.transform("_l", lambda x: x["link"]).alias("links"))
    out = out.withColumn("embeds", F.filter("links", lambda x: x["embed"]))
    if not backlinks:
        return out.withColumn("backlinks", F.expr(NO_LINKS))
    sources = notes.select(F.col("path").alias("source_path"), F.col("title").alias("_title"))
    back = links.where("target_path IS NOT NULL").join(sources, "source_path")
    link = F.struct(F.col("source_path").alias("path"), F.col("_title").alias("display"), F.col("is_embed").alias("embed"))
    back = back.groupBy(F.col("target_path").alias("path")).agg(F.sort_array(F.collect_list(F.struct("source_path", "ordinal", link.alias("link")))).alias("_b"))
    back = back.select("path", F.transform("_b", lambda x: x["link"]).alias("backlinks"))
    return out.join(back, "path", "full_outer")


def file_struct(path: Column, title: Column, properties: Column, tags: Column, **more: Column) -> Column:
    """The ``file`` of a page; what ``more`` lacks of size, mtime, ctime, links, embeds and backlinks is null or empty."""
    name = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(\.md)+$", "")
    moment = F.lit(None).cast("timestamp_ntz")
    given = lambda k, default: more.get(k, default).alias(k)
    return F.struct(
        path.alias("path"), name.alias("name"), name.alias("basename"), F.regexp_extract(path, "^(.*)/[^/]*$", 1).alias("folder"), F.lit("md").alias("ext"),
        F.struct(path.alias("path"), title.alias("display"), F.lit(False).alias("embed")).alias("link"),
        given("size", F.lit(None).cast("long")), given("mtime", moment), given("ctime", moment), tags.alias("tags"), properties.alias("properties"), properties.alias("frontmatter"),
        *(F.coalesce(more[k], F.expr(NO_LINKS)).alias(k) if k in more else F.expr(NO_LINKS).alias(k) for k in ("links", "embeds", "backlinks")),
    )


def from_table(frame: DataFrame, path: Column, title: Column | None = None, tags: Column | None = None, **more: Column) -> DataFrame:
    """``frame`` as pages: its columns, ``path``, ``note`` and ``file``. Columns so named give way."""
    own = [c for c in frame.columns if c not in ("path", "note", "file")]
    properties = F.struct(*(F.col(f"`{c}`") for c in own))
    last = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.md$", "")
    no_tags = F.expr("cast(array() as array<string>)")
    file = file_struct(path, title if title is not None else last, properties, tags if tags is not None else no_tags, **more)
    return frame.select(*(F.col(f"`{c}`") for c in own), path.alias("path"), properties.alias("note"), file.alias("file"))


def property_schema(notes: DataFrame, column: str = "frontmatter_json") -> T.StructType:
    """The common schema of all properties, in one pass; what differs from note to note is a variant."""
    ddl = notes.agg(F.schema_of_variant_agg(F.try_parse_json(column))).first()[0]
    if not ddl or not ddl.startswith("OBJECT<"):
        return T.StructType()
    ddl = re.sub(r"\bOBJECT<>", "STRING", ddl)
    ddl = re.sub(r"\bOBJECT<", "STRUCT<", ddl)
    ddl = re.sub(r"\bVOID\b", "STRING", ddl)
    ddl = re.sub(r"\bDECIMAL\(\d+,\s*\d+\)", "DOUBLE", ddl)
    return T._parse_datatype_string(f"x {ddl}")["x"].dataType


def _wiki(c: Column) -> Column:
    """{path, display} of a text in double brackets."""
    inner = F.regexp_extract(c, r"^\s*\[\[([\s\S]*)\]\]\s*$", 1)
    parts = F.split(inner, r"\|", 2)
    return F.when(c.isNotNull(), F.struct(parts[0].alias("path"), F.element_at(parts, -1).alias("display")))


def _wiki_any(c: Column) -> Column:
    """A variant that is a text in double brackets as {path, display}; others as they are."""
    text = F.when(F.schema_of_variant(c) == "STRING", F.try_variant_get(c, "$", "string"))
    return F.when(text.rlike(_WIKI), F.to_variant_object(_wiki(text))).otherwise(c)


def properties_of(notes: DataFrame, column: str = "frontmatter_json") -> DataFrame:
    """``notes`` with a struct ``note`` of the properties.

    A wiki link in a property, or in a list that is one, is {path, display}. Where that is so in
    some notes only, or a property is of several kinds, it is a variant.
    """
    schema = property_schema(notes, column)
    parsed = notes.withColumn("note", F.from_json(F.col(column), schema) if len(schema) else F.lit(None).cast("struct<>"))
    texts = {f.name: isinstance(f.dataType, T.ArrayType) for f in schema if f.dataType == T.StringType() or f.dataType == T.ArrayType(T.StringType())}
    several = {f.name: isinstance(f.dataType, T.ArrayType) for f in schema if f.dataType == T.VariantType() or f.dataType == T.ArrayType(T.VariantType())}
    if not texts and not several:
        return parsed
    leaf = lambda n: F.col("note").getField(n)
    counts = []
    for k, (n, many) in enumerate(texts.items()):
        given = F.coalesce(F.size(leaf(n)), F.lit(0)) if many else F.when(leaf(n).isNotNull(), 1).otherwise(0)
        links = F.coalesce(F.size(F.filter(leaf(n), lambda x: x.rlike(_WIKI))), F.lit(0)) if many else F.when(leaf(n).rlike(_WIKI), 1).otherwise(0)
        counts += [F.sum(given).alias(f"n{k}"), F.sum(links).alias(f"l{k}")]
    found = parsed.agg(*counts, F.lit(0)).first()

    def value(name: str) -> Column:
        if name in several:
            return F.transform(leaf(name), _wiki_any) if several[name] else _wiki_any(leaf(name))
        if name not in texts:
            return leaf(name)
        k = list(texts).index(name)
        if not found[f"l{k}"]:
            return leaf(name)
        if found[f"l{k}"] == found[f"n{k}"]:
            return F.transform(leaf(name), _wiki) if texts[name] else _wiki(leaf(name))
        return F.transform(leaf(name), lambda x: _wiki_any(x.cast("variant"))) if texts[name] else _wiki_any(leaf(name).cast("variant"))

    return parsed.withColumn("note", F.when(F.col("note").isNotNull(), F.struct(*(value(f.name).alias(f.name) for f in schema))))


def from_notes(notes: DataFrame, links: DataFrame | None = None, backlinks: bool = True) -> DataFrame:
    """Pages of notes (path, title, body, frontmatter_json; size, mtime and ctime if they are there).

    Tags are the property ``tags``, if that is a list, and what the body has beside them. A
    property named path, note or file gives way to the page's own. Notes without properties have
    null ones.
    """
    parsed = properties_of(notes)
    names = [f.name for f in parsed.schema["note"].dataType]
    own = F.expr("cast(array() as array<string>)")
    if "tags" in names:
        kind, given = parsed.schema["note"].dataType["tags"].dataType, F.col("note").getField("tags")
        if kind == T.VariantType():
            own = F.coalesce(F.try_variant_get(given, "$", "array<string>"), own)
        elif isinstance(kind, T.ArrayType):
            own = F.coalesce(F.transform(given, lambda t: t.try_cast("string")) if kind.elementType == T.VariantType() else given.cast("array<string>"), own)
    tags = F.array_distinct(F.concat(own, inline_tags(F.col("body"))))
    more = {c: F.col(c) for c in ("size",) if c in notes.columns}
    more |= {c: F.timestamp_seconds(c).cast("timestamp_ntz") if isinstance(notes.schema[c].dataType, T.IntegralType) else F.col(c).cast("timestamp_ntz") for c in ("mtime", "ctime") if c in notes.columns}
    if links is not None:
        parsed = parsed.join(link_index(links, notes, backlinks), "path", "left")
        more |= {c: F.col(c) for c in ("links", "embeds", "backlinks")}
    file = file_struct(F.col("path"), F.col("title"), F.col("note"), tags, **more)
    roots = [F.col("note").getField(n).alias(n) for n in names if n.lower() not in ("path", "note", "file", "title", "body", "frontmatter_json")]
    return parsed.select("path", "title", "body", "frontmatter_json", *roots, "note", file.alias("file"))


def with_this(pages: DataFrame, current: str) -> DataFrame:
    """``pages`` with the page of path ``current`` as ``this`` in every row; no such page, no value."""
    one = pages.where(F.col("path") == current).limit(1).select(F.struct(*(F.col(f"`{c}`") for c in pages.columns)).alias("this"))
    return pages.join(F.broadcast(one), F.lit(True), "left")  # one row


def lookup(notes: DataFrame, name: str) -> DataFrame:
    """The note of a path, with or without .md, or else of a title that exactly one note has; else no row."""
    wanted = name.strip().replace("\\", "/").removeprefix("./").strip("/").lower()
    stem = F.lower(F.regexp_replace("path", r"\.md$", ""))
    by_path = notes.where((F.lower("path") == wanted) | (stem == wanted.removesuffix(".md"))).orderBy("path").limit(1)
    titled = notes.where(F.lower("title") == wanted.removesuffix(".md").split("/")[-1])
    # a title counts only if there is no such path and no second such title
    by_title = titled.limit(2).withColumn("_n", F.lit(1))
    alone = by_title.agg(F.count("*").alias("_n")).where("_n = 1").join(F.broadcast(by_path.select(F.lit(1).alias("_p"))), F.lit(True), "left_anti")
    picked = by_title.drop("_n").join(F.broadcast(alone.select(F.lit(1).alias("_one"))), F.lit(True), "left_semi")
    return by_path.unionByName(picked.select(notes.columns))
