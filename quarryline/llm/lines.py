"""Line dedup by site-relative frequency, in DataFrame functions alone.

For each host, the pages that contain a line are divided by the host's pages; lines
above ``RATIO`` and on at least ``MIN_PAGES`` pages are boilerplate and go from all
pages of the host. Pages of equal text on a host count once in both numbers, so a
page's own copies don't turn it into boilerplate.

Lines end at \\n and are compared whole; those of white space alone are neither
counted nor dropped. A page without a host, or without text, stays as it is. A
page all of whose lines go keeps its row with an empty text. Repeated rows are
treated alike. Further columns are kept.

Only hashes of lines are shuffled. Distinct (host, line, page) rows spread over all
three, the counts per (host, line) are pre-aggregated, and hosts' totals join under
a salt, so neither a host with a third of all pages nor a line on each of them meets
in one task. At most
lines-per-page / RATIO lines of a host can be boilerplate; that table joins by size
as measured, and so do the hits with the documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.functions.joins import lookup_join
from quarryline.llm.common import doc_key, stage

RATIO, MIN_PAGES = 0.03, 5
_INK = r"[^ \t\r\f\x0b]"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def boilerplate(docs: DataFrame, host: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, line): hashes of the lines to drop."""
    pages = docs.filter(F.col(host).isNotNull() & F.col("text").isNotNull()).select(F.col(host).alias("host"), "text")
    totals = pages.select("host", F.xxhash64("text").alias("page")).distinct().groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    inked = F.array_distinct(F.filter(_lines(F.col("text")), lambda x: x.rlike(_INK)))
    rows = pages.select("host", F.xxhash64("text").alias("page"), F.explode(inked).alias("line"))
    rows = rows.select("host", "page", F.md5("line").alias("line")).distinct()
    counts = rows.groupBy("host", "line").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") >= min_pages)
    return lookup_join(counts, totals, ["host"], "line", "inner").filter(F.col("c") > F.col("n") * F.lit(float(ratio))).select("host", "line")


def _marked(docs: DataFrame, host: str, ratio: float, min_pages: int) -> DataFrame:
    """(row, drop): each document's row and the hashes of its lines that go, null for none."""
    # Written first, so that its size is known and the join can split a hot line's rows.
    common = stage(boilerplate(docs, host, ratio, min_pages))
    some = docs.filter(F.col(host).isNotNull() & F.col("text").isNotNull())
    rows = some.select(*doc_key(), F.col(host).alias("host"), F.explode(F.array_distinct(_lines(F.col("text")))).alias("line"))
    rows = rows.select("k1", "k2", "host", F.md5("line").alias("line"))
    hits = rows.join(common, ["host", "line"]).groupBy("k1", "k2", "host").agg(F.collect_set("line").alias("drop"))
    whole = docs.select(*doc_key(), F.col(host).alias("host"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return whole.join(hits, ["k1", "k2", "host"], "left").select("row", "drop")


def _kept(text: Column, drop: Column) -> Column:
    return F.array_join(F.filter(_lines(text), lambda x: ~F.array_contains(drop, F.md5(x))), "\n")


def dedup_lines(docs: DataFrame, host: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``docs`` with boilerplate lines dropped from ``text``."""
    marked = _marked(docs, host, ratio, min_pages)
    text = F.when(F.col("drop").isNull(), F.col("row.text")).otherwise(_kept(F.col("row.text"), F.col("drop")))
    return marked.select(*[text.alias(c) if c.lower() == "text" else F.col(f"row.`{c}`") for c in docs.columns])


def line_report(docs: DataFrame, host: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(doc_id, n_lines, n_dropped, text_sha256) for every row; null text counts as empty in the digest."""
    marked = _marked(docs, host, ratio, min_pages).select(F.col("row.doc_id").cast("long").alias("doc_id"), F.col("row.text").alias("text"), "drop")
    text = F.when(F.col("drop").isNull(), F.col("text")).otherwise(_kept(F.col("text"), F.col("drop")))
    lines = F.size(_lines(F.col("text")))
    gone = F.when(F.col("drop").isNull(), F.lit(0)).otherwise(F.size(F.filter(_lines(F.col("text")), lambda x: F.array_contains(F.col("drop"), F.md5(x)))))
    return marked.select(
        "doc_id", F.coalesce(F.when(F.col("text").isNotNull(), lines), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(gone, F.lit(0)).cast("long").alias("n_dropped"), F.sha2(F.coalesce(text, F.lit("")), 256).alias("text_sha256"),
    )


SQL = f"""with d as (select row_number() over () as r, doc_id, text, source as host, string_split(text, chr(10)) as l from documents),
l as (select r, doc_id, text, host, unnest(l) as line, unnest(range(1, len(l) + 1)) as i from d where text is not null),
p as (select distinct host, text from d where host is not null and text is not null),
totals as (select host, count(*) as n from p group by 1),
counts as (select host, line, count(distinct text) as c from l where host is not null and regexp_matches(line, '[^ \\t\\r\\f\\x0b]') group by 1, 2),
common as (select host, line from counts join totals using (host) where c >= {MIN_PAGES} and c > n * {RATIO}::double),
kept as (select r, count(*) as n, string_agg(line, chr(10) order by i) as s from l anti join common using (host, line) group by 1)
select doc_id, coalesce(len(l), 0)::bigint as n_lines, (coalesce(len(l), 0) - coalesce(n, 0))::bigint as n_dropped, sha256(coalesce(s, '')) as text_sha256
from d left join kept using (r)"""
