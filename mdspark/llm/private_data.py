"""Personal data by fixed forms and by contexts learned from them; DataFrame functions only.

The base forms give seed entities. The words right before and right after a seed are lexical
patterns. A pattern's confidence is the share of all its occurrences that stand at an
identifier; an identifier's score is the confidence of its best pattern (1 for seeds). Both are
computed in turns over the graph of patterns and instances until no pattern comes or goes, so
that patterns also gain from identifiers other patterns have found. Patterns of high confidence
mark what else stands in them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mdspark.llm.common import Workspace

#: Turns over the graph after which it is an error that patterns still come or go, distinct instances that must support a pattern, and its least confidence.
TURNS, SUPPORT, CONFIDENCE = 100, 3, 0.5
#: Lengths that are summed at once for the places of matches.
CHUNK = 64
KINDS = ("email", "ip", "card", "phone")
FOUND = "context"
#: Java forms of the base patterns. Possessive parts and the look-behinds change no match, they keep long runs linear.
_FORMS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?=(?:[0-9][\x20-]?){12})[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: An identifier: a word of at least six characters with a digit in it; what is cut off at its ends.
_CANDIDATE = r"(?<![^\x20\x09-\x0D])(?=[^\x20\x09-\x0D]*[0-9])[^\x20\x09-\x0D]{6,}+"
_CORE = r"^[^A-Za-z0-9]*([A-Za-z0-9](?:.*[A-Za-z0-9])?)"
_WORD_BREAK = r"[\x20\x09-\x0D]+"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    """Every second digit from the right counts double, less 9 above 9; the sum must end in 0."""
    reversed_ = F.reverse(_digits(m))
    places = F.sequence(F.lit(1), F.length(reversed_))

    def value(i: Column) -> Column:
        d = F.substring(reversed_, i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return F.aggregate(F.transform(places, value), F.lit(0), lambda s, x: s + x) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    n = F.length(_digits(m))
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        bare = F.transform(F.split(m, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
        return F.forall(bare, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    return n.between(12, 19) & _luhn(m) if kind == "card" else n.between(9, 15)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once; an expression that a function of arrays holds is computed for each item."""
    return F.transform(F.array(value), use)[0]


def _running(lengths: Column) -> Column:
    """The sum up to each element, chunk by chunk: the time is that of the chunks, not of the square of all."""
    total = lambda sums, x: F.concat(sums, F.array(F.element_at(sums, F.lit(-1)) + x))

    def shifted(inside: Column) -> Column:
        before = F.aggregate(F.transform(inside, lambda sums: F.element_at(sums, F.lit(-1))), F.array(F.lit(0)), total)
        add = lambda sums, at: F.transform(F.slice(sums, F.lit(2), F.size(sums) - 1), lambda x: x + at)
        return F.flatten(F.zip_with(inside, F.slice(before, F.lit(1), F.size(inside)), add))

    starts = F.sequence(F.lit(1), F.size(lengths), F.lit(CHUNK))
    return _let(F.transform(starts, lambda at: F.aggregate(F.slice(lengths, at, F.lit(CHUNK)), F.array(F.lit(0)), total)), shifted)


def _matches(text: Column, form: str) -> Column:
    """array<struct<start, stop, value, before, after>> of the leftmost non-overlapping matches, in code points.

    What lies between the matches and the matches themselves give the places by running sums.
    ``before`` and ``after`` are the lower-cased words next to the match, beyond white space;
    a word ends where another match of the same form ends. Empty where there is none.
    """
    none = F.expr("cast(array() as array<struct<start: int, stop: int, value: string, before: string, after: string>>)")
    empty = F.array(F.lit(""))

    def one(x: Column, stop: Column) -> Column:
        before = F.lower(F.regexp_extract(F.concat(x["last"], x["g"]), r"([^\x20\x09-\x0D]++)[\x20\x09-\x0D]++$", 1))
        after = F.lower(F.regexp_extract(F.concat(x["rest"], x["next"]), r"^[\x20\x09-\x0D]++([^\x20\x09-\x0D]++)", 1))
        return F.struct((stop - F.char_length(x["m"])).alias("start"), stop.alias("stop"), x["m"].alias("value"), before.alias("before"), after.alias("after"))

    def placed(pairs: Column) -> Column:
        lengths = F.transform(pairs, lambda x: F.char_length(x["g"]) + F.char_length(x["m"]))
        return F.zip_with(pairs, _let(lengths, _running), one)

    def paired(values: Column) -> Column:
        n = F.size(values)
        between = lambda gaps: F.arrays_zip(
            values.alias("m"), F.slice(gaps, F.lit(1), n).alias("g"), F.concat(empty, F.slice(values, F.lit(1), n - 1)).alias("last"),
            F.slice(gaps, F.lit(2), n).alias("rest"), F.concat(F.slice(values, F.lit(2), n), empty).alias("next"),
        )
        return F.when(n == 0, none).otherwise(_let(_let(F.split(text, form, -1), between), placed))

    return _let(F.regexp_extract_all(text, F.lit(form), F.lit(0)), paired)


def _base(text: Column, kind: str, order: int) -> Column:
    kept = F.filter(_matches(text, _FORMS[kind]), lambda s: _valid(kind, s["value"]))
    struct = lambda s: F.struct(s["start"], F.lit(order).alias("o"), s["stop"], F.lit(kind).alias("kind"), s["value"], s["before"], s["after"])
    return F.transform(kept, struct)


def _patterns(s: Column) -> Column:
    """The patterns that an instance stands in: < and the word before it, > and the word after it."""
    both = F.array(F.struct(F.lit("<").alias("side"), s["before"].alias("word")), F.struct(F.lit(">").alias("side"), s["after"].alias("word")))
    return F.transform(F.filter(both, lambda p: p["word"] != ""), lambda p: F.concat(p["side"], p["word"]))


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def _key(key: Column, text: Column) -> Column:
    """128 bits that tell rows apart; rows with the same id and text share them, and their spans."""
    return F.struct(F.xxhash64(key, text).alias("a"), F.xxhash64(F.lit("row"), text, key).alias("b"))


def spans_of(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, k, base, spans) of each row: array<struct<start, o, stop, kind, value>> by start, then kind.

    ``base`` has the matches of the fixed forms, ``spans`` these and what learned patterns add
    (kind ``context``). Null and empty texts have none; ids may be null or repeat, and rows that
    repeat an id and a text get the same spans, each its own row; an empty table gives an empty
    table. Texts of any length are searched whole; to look
    for a text's identifiers outside of its fixed forms each one is held against all of these. ``k`` is
    a 128-bit hash of id and text, for joins. Words, patterns and instances are counted over all
    texts, with partial sums before each shuffle; texts themselves are not shuffled.
    """
    ws = Workspace(docs.sparkSession, "private-data")
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    rows = rows.withColumn("k", _key(F.col("doc_id"), F.col("t")))
    per_kind = rows.select("doc_id", "k", "t", *(_base(F.col("t"), kind, o).alias(kind) for o, kind in enumerate(KINDS)))
    based = per_kind.withColumn("base", F.array_sort(F.concat(*KINDS)))
    bare = lambda s: F.regexp_replace(s["value"], "^[^A-Za-z0-9]+", "")
    others = F.transform(
        _matches(F.col("t"), _CANDIDATE),
        lambda s: F.struct((s["stop"] - F.char_length(bare(s))).alias("start"), F.regexp_extract(s["value"], _CORE, 1).alias("value"), _patterns(s).alias("ps")),
    )
    others = F.transform(others, lambda s: F.struct(s["start"], (s["start"] + F.char_length(s["value"])).alias("stop"), s["value"], s["ps"]))
    taken = F.flatten(F.transform("base", lambda s: F.array(s["start"], s["stop"])))
    found = based.select(
        "doc_id",
        "k",
        F.transform("base", lambda s: F.struct(*(s[c].alias(c) for c in ("start", "o", "stop", "kind", "value")))).alias("base"),
        F.transform("base", lambda s: F.struct(s["value"], _patterns(s).alias("ps"))).alias("seeds"),
        F.when(F.size(taken) == 0, others).otherwise(F.filter(others, lambda s: ~F.exists("base", lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"])))).alias("others"),
    )
    found = found.withColumn("others", F.filter("others", lambda s: F.length(s["value"]) >= 6))
    found = ws.write(found, "found")

    instance = lambda seed: (F.explode("s.ps").alias("p"), F.xxhash64("s.value").alias("v"), F.lit(seed).alias("seed"))
    seeds = found.select(F.explode("seeds").alias("s")).select(*instance(1))
    rest = found.select(F.explode("others").alias("s")).select(*instance(0))
    edges = seeds.unionByName(rest).groupBy("p", "v").agg(F.count("*").alias("n"), F.max("seed").alias("seed"))
    edges = ws.write(edges, "edges")
    words = rows.select(F.explode(F.split("t", _WORD_BREAK)).alias("w")).select(F.lower("w").alias("w"))
    known = edges.groupBy("p").agg(F.count("*").alias("kinds")).where(F.col("kinds") >= SUPPORT)
    known = known.select("p", F.expr("substring(p, 2)").alias("w"))
    # an inner join: the optimizer would push a semi join below the partial sums and shuffle every word
    uses = ws.write(words.groupBy("w").agg(F.count("*").alias("uses")).join(known, "w").select("p", "uses"), "uses")

    score = edges.select("v", F.col("seed").cast("double").alias("score")).groupBy("v").agg(F.max("score").alias("score"))
    good, before = None, None
    for turn in range(TURNS):
        mass = edges.join(score.where("score > 0"), "v").groupBy("p")
        mass = mass.agg(F.sum(F.col("n") * F.col("score")).alias("mass"), F.count("*").alias("kinds")).where(F.col("kinds") >= SUPPORT)
        confidence = F.least(F.col("mass") / (F.col("uses") + 1), F.lit(1.0))
        patterns = ws.write(mass.join(uses, "p").select("p", confidence.alias("confidence")), f"patterns-{turn}")
        good = patterns.where(F.col("confidence") >= CONFIDENCE).select("p")
        state = good.agg(F.count("*"), F.sum(F.xxhash64("p").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
        reached = edges.join(patterns, "p").select("v", F.greatest(F.col("seed").cast("double"), "confidence").alias("score"))
        kept = edges.select("v", F.col("seed").cast("double").alias("score"))
        score = ws.write(reached.unionByName(kept).groupBy("v").agg(F.max("score").alias("score")), f"scores-{turn}")
        ws.drop(f"scores-{turn - 1}", f"patterns-{turn - 1}")
    else:
        raise RuntimeError(f"patterns still come and go after {TURNS} turns")
    added = found.select("k", F.explode("others").alias("s")).select("k", "s.start", "s.stop", "s.value", F.explode("s.ps").alias("p")).join(good, "p", "left_semi")
    one = F.struct("start", F.lit(len(KINDS)).alias("o"), "stop", F.lit(FOUND).alias("kind"), "value")
    added = ws.write(added.groupBy("k").agg(F.collect_set(one).alias("added")), "added")
    ws.drop("edges", "uses")
    out = found.select("doc_id", "k", "base").join(added, "k", "left")
    spans = F.when(F.col("added").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "added")))
    return out.select(F.col("doc_id").alias(key), "k", "base", spans.alias("spans"))


def digest(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return spans.select(key, *(count(k) for k in KINDS), F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with each span of the text replaced by its kind in brackets; overlapping spans become one, of the first's kind.

    Texts without spans, null among them, stay as they are. Columns of any name stay, as do rows
    that repeat; an empty table gives an empty table.
    """
    found = spans_of(docs, key, text).where(F.size("spans") > 0).select("k", "spans").dropDuplicates(["k"])
    none = F.expr("cast(array() as array<struct<start: int, stop: int, kind: string>>)")

    def merge(acc: Column, s: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        one = F.struct(s["start"], s["stop"], s["kind"])
        wider = F.struct(last["start"], F.greatest(last["stop"], s["stop"]).alias("stop"), last["kind"])
        joined = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(wider))
        return F.when((F.size(acc) > 0) & (s["start"] < last["stop"]), joined).otherwise(F.concat(acc, F.array(one)))

    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(text), F.lit("")).alias("t"), _key(F.col(key), F.coalesce(F.col(text), F.lit(""))).alias("k"))
    out = rows.join(found, "k", "left").withColumn("m", F.aggregate("spans", none, merge))
    begins = F.concat(F.array(F.lit(0)), F.transform("m", lambda s: s["stop"]))
    pieces = F.zip_with(
        F.slice(begins, F.lit(1), F.size("m")), "m", lambda at, s: F.concat(F.substring(F.col("t"), at + 1, s["start"] - at), F.lit("["), F.upper(s["kind"]), F.lit("]"))
    )
    tail = F.substring(F.col("t"), F.element_at("m", F.lit(-1))["stop"] + 1, F.char_length("t"))
    changed = F.when(F.size("m") > 0, F.concat(F.array_join(pieces, ""), tail)).otherwise(F.col("row")[text])
    return out.select(*(changed.alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns))
