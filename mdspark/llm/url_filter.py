"""URL filter: a trie over reversed host labels and path characters, longest match first."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mdspark.llm.common import small_arrow_batches

#: (verdict, host, path prefix)
DEFAULT_RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: The list is broadcast; longer lists must be refused, not shipped silently.
MAX_RULE_BYTES = 64 << 20


class RuleTrie:
    """Host labels from the right, then path segments.

    A path prefix that ends within a segment is kept at its last whole segment as a tail,
    tried longest first. A rule on more host labels wins over one on fewer; on the same host
    the longer path wins; for the same host and path, block wins over allow.
    """

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.root: dict = {}
        for verdict, host, path in rules:
            if verdict not in ("allow", "block"):
                raise ValueError(f"unknown verdict {verdict!r}")
            node = self.root
            for label in reversed(host.lower().split(".")):
                node = node.setdefault(label, {})
            *segments, tail = path.split("/")
            node = node.setdefault("/", {})  # no label holds a slash
            for segment in segments:
                node = node.setdefault(("s", segment), {})
            tails = node.setdefault("tails", {})
            if tails.get(tail, ("",))[0] != "block":
                tails[tail] = (verdict, f"{host}{path}")
        self._order(self.root)

    def _order(self, node: dict) -> None:
        for key, value in node.items():
            if key == "tails":
                node[key] = sorted(value.items(), key=lambda x: -len(x[0]))
            else:
                self._order(value)

    @staticmethod
    def _in_path(node: dict, segments: list[str]) -> tuple[str, str] | None:
        found = None
        for segment in segments:
            for tail, rule in node.get("tails", ()):
                if segment.startswith(tail):
                    found = rule
                    break
            node = node.get(("s", segment))
            if node is None:
                break
        return found

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """(verdict, rule) of the longest rule that fits, or None."""
        node, found, segments = self.root, None, path.split("/")
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            if "/" in node:
                found = self._in_path(node["/"], segments) or found
        return found


def filter_urls(
    df: DataFrame, rules: Iterable[tuple[str, str, str]] = DEFAULT_RULES, url: str = "url", default: str = "allow"
) -> DataFrame:
    """``df`` with columns host, path, rule and verdict (which replace columns so named).

    Null urls and urls without ``://`` have an empty host and path and meet no rule. A url
    without a rule gets the verdict ``default``. An empty table gives an empty table; repeated
    rows are judged one by one. The only shuffle-free input is the rule list, which is broadcast
    after its size has been checked.
    """
    rules = list(rules)
    if sum(len(h) + len(p) for _, h, p in rules) > MAX_RULE_BYTES:
        raise ValueError("the rule list is too large to broadcast")
    small_arrow_batches(df.sparkSession)
    trie = df.sparkSession.sparkContext.broadcast(RuleTrie(rules))
    kept = [c for c in df.columns if c not in ("host", "path", "rule", "verdict")]
    given = F.col(f"`{url}`")
    rest = F.when(F.instr(given, "://") > 0, F.expr(f"substring(`{url}`, locate('://', `{url}`) + 3)")).otherwise("")
    # other columns travel as one, so that no name of theirs is in the way
    parts = df.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), rest.alias("rest"))
    host = F.regexp_extract("rest", r"^([^/?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    parts = parts.select("row", lower.alias("host"), F.regexp_extract("rest", r"^[^/?#]*([^?#]*)", 1).alias("path"))

    @F.arrow_udf("struct<rule string, verdict string>")
    def judge(pairs: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        match = trie.value.match
        for hosts, paths in pairs:
            found = [match(h, p) or (default, None) for h, p in zip(hosts.to_pylist(), paths.to_pylist(), strict=True)]
            yield pa.StructArray.from_arrays(
                [pa.array([r for _, r in found], pa.string()), pa.array([v for v, _ in found], pa.string())],
                ["rule", "verdict"],
            )

    judged = parts.withColumn("judged", judge("host", "path"))
    return judged.select(*(F.col("row").getField(c).alias(c) for c in kept), "host", "path", "judged.rule", "judged.verdict")
