"""URL filter: a trie over reversed host labels and path segments.

A rule is an action, a host and a path. It fits its host and all subdomains if the
url's path starts with the rule's path. Of the rules that fit, the deepest host
wins, then the longest path, then block over allow. A rule whose host is empty
fits every host. A url that no rule fits gets the default verdict.

The host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end,
with A-Z lowered; the path goes on up to ``?``, ``#`` or the end. A null url and
one without ``://`` have both empty, and no rule but one without host fits.

Rules are broadcast as one trie while their text keeps to ``TRIE_BYTES``. Beyond
that, each url's host suffixes and path prefixes are joined with the rule table,
which gives the same verdicts by a shuffle. Repeated pages give equal rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRIE_BYTES = 8 << 20
DEFAULT = "allow"
# The production rules.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both parts as columns, by position: no pattern meets the whole url."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    front = F.substring_index(F.substring_index(rest, "?", 1), "#", 1)
    slash = F.instr(front, "/")
    host = F.when(slash > 0, F.substr(front, F.lit(1), slash - 1)).otherwise(front)
    path = F.when(slash > 0, F.substr(front, slash)).otherwise(F.lit(""))
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit("")), F.coalesce(path, F.lit(""))


@dataclass
class Node:
    """A host label or a path segment; ``ends`` are rules that end inside the next segment."""

    below: dict[str, Node] = field(default_factory=dict)
    paths: dict[str, Node] | None = None
    ends: list[tuple[str, int]] = field(default_factory=list)


class Trie:
    def __init__(self, rules: list[tuple[str, str, str]]):
        self.rules = [(h + p, action) for action, h, p in rules]
        self.root = Node()
        for number, (_, host, path) in enumerate(rules):
            node = self.root
            for label in reversed(host.split(".")) if host else ():
                node = node.below.setdefault(label, Node())
            if node.paths is None:
                node.paths = {"": Node()}
            place = node.paths[""]
            *whole, last = path.split("/")
            for segment in whole:
                place = place.below.setdefault(segment, Node())
            place.ends.append((last, number))

    def _longest(self, node: Node, segments: list[str]) -> int | None:
        """The rule with the longest path that starts these segments; block before allow."""
        found, place, i = None, node, 0
        while True:
            fits = [(len(e), self.rules[k][1] == "block", k) for e, k in place.ends if segments[i].startswith(e)]
            if fits:
                found = max(fits)[2]
            if i + 1 >= len(segments) or segments[i] not in place.below:
                return found
            place, i = place.below[segments[i]], i + 1

    def match(self, host: str, path: str) -> int | None:
        segments = path.split("/")
        node, found = self.root, None
        labels = reversed(host.split(".")) if host else ()
        if node.paths is not None:
            found = self._longest(node.paths[""], segments)
        for label in labels:
            node = node.below.get(label)
            if node is None:
                return found
            if node.paths is not None:
                hit = self._longest(node.paths[""], segments)
                found = found if hit is None else hit
        return found


def _by_trie(rows: DataFrame, rules: list[tuple[str, str, str]], default: str) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(Trie(rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = shared.value
        for batch in batches:
            hits = [trie.match(h, p) for h, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            found = [(None, default) if k is None else trie.rules[k] for k in hits]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([r for r, _ in found], pa.string()), pa.array([v for _, v in found], pa.string())],
                ["page_id", "host", "path", "rule", "verdict"],
            )

    return rows.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")


def _by_join(rows: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """The same by equi-joins: on the host suffix, then a filter on the path; urls are judged once each."""
    urls = rows.select("host", "path").distinct()
    labels = F.split("host", r"\.", -1)
    size = F.size(labels)
    suffix = F.transform(F.sequence(F.lit(1), size), lambda k: F.array_join(F.slice(labels, size - k + 1, k), "."))
    keys = urls.select("host", "path", F.explode(F.array_union(suffix, F.array(F.lit("")))).alias("rule_host"))
    fits = keys.join(rules, "rule_host").filter(F.col("path").startswith(F.col("rule_path")))
    depth = F.when(F.col("rule_host") == "", 0).otherwise(F.size(F.split("rule_host", r"\.", -1)))
    rank = F.struct(depth.alias("d"), F.length("rule_path").alias("l"), (F.col("action") == "block").alias("b"))
    best = fits.groupBy("host", "path").agg(F.max_by(F.struct("rule_host", "rule_path", "action"), rank).alias("r"))
    rule = F.concat("r.rule_host", "r.rule_path").alias("rule")
    return rows.join(best, ["host", "path"], "left").select(
        "page_id", "host", "path", rule, F.coalesce("r.action", F.lit(default)).alias("verdict")
    )


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame = RULES, default: str = DEFAULT, limit: int = TRIE_BYTES) -> DataFrame:
    """(page_id, host, path, rule, verdict); ``rules`` as triples or a table (action, host, path)."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        if sum(len(h) + len(p) for _, h, p in rules) <= limit:
            return _by_trie(rows, list(rules), default)
        rules = spark.createDataFrame(rules, "action string, host string, path string")
    size = rules.agg(F.sum(F.length("host") + F.length("path"))).first()[0] or 0
    if size <= limit:
        return _by_trie(rows, [tuple(r) for r in rules.select("action", "host", "path").collect()], default)
    table = rules.select("action", F.col("host").alias("rule_host"), F.col("path").alias("rule_path")).distinct()
    return _by_join(rows, table, default)


def keep_allowed(pages: DataFrame, **options) -> DataFrame:
    """The pages whose verdict is allow, columns unchanged; each distinct url is judged once."""
    urls = pages.select("url").distinct().withColumn("page_id", F.lit(0))
    verdicts = filter_urls(urls, **options).select("host", "path", "verdict").distinct()
    host, path = host_and_path(F.col("row.url"))
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("row"))
    both = rows.withColumns({"host": host, "path": path}).join(verdicts, ["host", "path"])
    return both.filter(F.col("verdict") == "allow").select("row.*")


_RULE_SQL = ", ".join(f"('{a}', '{h}', '{p}', {len(h.split('.'))})" for a, h, p in RULES)
SQL = f"""with u as (select page_id, url, strpos(url, '://') as s from pages),
r as (select page_id, case when s > 0 then regexp_extract(substr(url, s + 3), '^[^?#]*') else '' end as rest from u),
p as (select page_id, coalesce(translate(regexp_extract(rest, '^[^/]*'), '{_UPPER}', '{_LOWER}'), '') as host,
  coalesce(regexp_extract(rest, '(?s)^[^/]*(/.*)?$', 1), '') as path from r),
rules(action, rh, rp, depth) as (values {_RULE_SQL}),
fit as (select page_id, host, path, rh || rp as rule, action, row_number() over (partition by page_id, host, path order by depth desc, length(rp) desc, action desc) as k
  from p join rules on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp))
select p.page_id, p.host, p.path, rule, coalesce(action, '{DEFAULT}') as verdict from p left join (select * from fit where k = 1) f using (page_id, host, path)"""
