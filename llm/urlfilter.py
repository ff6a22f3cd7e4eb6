"""URL filters by a temporal list join, in DataFrame operations only.

A block list is a log of dated entries: a pattern is added or removed at a time.
Entries become validity intervals (from the addition up to the next entry of
the pattern in that category), and a capture is judged by the intervals that hold its fetch time, so
the same URL can pass before an entry and fail after it.

Kinds of pattern: ``host`` (this host), ``domain`` (this host and all below
it), ``prefix`` (host and leading path segments, as ``host/a/b``). A capture
has one key for each pattern that could match it; keys meet patterns by
equality on (kind, pattern, month), and the as-of condition is checked inside
the month. The month splits the keys of a host that holds a third of all
captures, and captures of one URL on one day are looked up once.

Defined cases: a null or unparsable URL, or a null time, matches nothing;
repeated captures get a row each; repeated entries count once; entries with a
null field are ignored; of entries for one pattern and category at one time a
removal comes last; empty tables give empty results or captures without matches; other
columns of the captures stay (one named like a result gives way to it).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from llm._batches import table


def host_of(url: Column) -> Column:
    """Host in lower case, without user and port, an IPv6 address in its
    brackets; null if there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#@]*@)?(\[[0-9A-Fa-f:.]+\]|[^/?#:@\[\]]+)", 2))
    return F.when(host != "", host)


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)


def validity(entries: DataFrame) -> DataFrame:
    """(kind, pattern, category, valid_from, valid_to): the intervals of a log
    (kind, pattern, category, action add or remove, effective date). Categories
    of a pattern are listed apart: an entry ends an interval of its own only."""
    log = entries.select("kind", "pattern", "category", "action", "effective").na.drop().distinct()
    order = Window.partitionBy("kind", "pattern", "category").orderBy("effective", "action")
    nxt = F.lead("effective").over(order)
    spans = log.withColumn("valid_to", nxt).where("action = 'add'")
    return spans.select("kind", "pattern", "category", F.col("effective").alias("valid_from"), "valid_to").where(
        "valid_to is null or valid_to > valid_from")


def judge(captures: DataFrame, entries: DataFrame, url_col: str = "url", time_col: str = "fetched") -> DataFrame:
    """``captures`` with ``host``, ``n_active`` (intervals that match and hold
    the fetch date), ``matched`` (the least "kind pattern" of them, or null) and
    ``blocked``."""
    new = ["host", "n_active", "matched", "blocked"]
    keep = [c for c in captures.columns if c.lower() not in new]
    base = captures.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{url_col}`").alias("__url"), F.col(f"`{time_col}`").cast("date").alias("__day"))
    spans = validity(entries)
    sights = base.select("__url", "__day").where("__url is not null and __day is not null").distinct()
    sights = sights.withColumn("host", host_of(F.col("__url"))).where("host is not null")
    # as many leading path segments as the longest pattern has; days up to the last capture
    limits = spans.where("kind = 'prefix'").agg(F.coalesce(F.max(F.size(F.split("pattern", "/")) - 1), F.lit(0)).alias("depth"))
    until = sights.agg(F.max("__day").alias("until"))
    depth, last = limits.first().depth, until.first().until
    labels = F.split("host", r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))
    steps = F.split(F.substring_index(path_of(F.col("__url")), "/", depth + 1), "/")  # the first is empty
    prefixes = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.concat("host", F.concat_ws("/", F.slice(steps, 1, i))))
    keys = F.concat(
        F.array(F.struct(F.lit("host").alias("kind"), F.col("host").alias("pattern"))),
        F.transform(domains, lambda d: F.struct(F.lit("domain").alias("kind"), d.alias("pattern"))),
        F.transform(F.filter(prefixes, lambda p: p.contains("/")), lambda p: F.struct(F.lit("prefix").alias("kind"), p.alias("pattern"))))
    asked = sights.select("__url", "__day", F.inline(keys)).withColumn("month", F.trunc("__day", "month"))
    begin = F.trunc("valid_from", "month")
    end = F.trunc(F.least(F.coalesce("valid_to", F.lit(last)), F.lit(last)), "month")
    by_month = spans.where(begin <= end).withColumn("month", F.explode(F.sequence(begin, end, F.expr("interval 1 month"))))
    active = asked.join(by_month, ["kind", "pattern", "month"]).where(
        (F.col("valid_from") <= F.col("__day")) & (F.col("valid_to").isNull() | (F.col("__day") < F.col("valid_to"))))
    found = active.groupBy("__url", "__day").agg(F.count("*").alias("n_active"), F.min(F.concat_ws(" ", "kind", "pattern")).alias("matched"))
    out = base.join(found, ["__url", "__day"], "left")
    n = F.coalesce("n_active", F.lit(0))
    return out.select(*[F.col(f"`{c}`") for c in keep], host_of(F.col("__url")).alias("host"), n.alias("n_active"), "matched", (n > 0).alias("blocked"))


def _number(text: Column, digits: int, modulus: int) -> Column:
    """A number below ``modulus`` from the MD5 of a text."""
    return F.pmod(F.conv(F.substring(F.md5(text.cast("binary")), digits, 4), 16, 10).cast("long"), F.lit(modulus))


def captures_of(pages: DataFrame) -> DataFrame:
    """Pages have no fetch date: one is worked out from the id, within two years."""
    day = F.date_add(F.lit("2023-01-01").cast("date"), F.pmod(F.col("page_id") * 37, F.lit(730)).cast("int"))
    return pages.select("page_id", "url", day.alias("fetched"))


def entries_of(pages: DataFrame) -> DataFrame:
    """A log worked out from the hosts of the pages: of each sixteen hosts some
    are listed by host, domain or path, removed again, and added once more; a
    second category is added meanwhile and stays."""
    host = host_of(F.col("url"))
    hosts = pages.select(host.alias("host")).where("host is not null").distinct()
    first = F.date_add(F.lit("2023-01-01").cast("date"), _number(F.col("host"), 5, 600).cast("int"))
    kind = _number(F.col("host"), 1, 16)
    listed = hosts.select("host", kind.alias("k"), first.alias("d")).where("k < 6")
    pattern = F.when(F.col("k") < 4, F.col("host")).otherwise(F.concat("host", F.lit("/en")))
    name = F.when(F.col("k") < 2, F.lit("host")).when(F.col("k") < 4, F.lit("domain")).otherwise(F.lit("prefix"))
    category = F.when(F.pmod("k", F.lit(2)) == 0, F.lit("spam")).otherwise(F.lit("malware"))

    def entry(action: str, after: int, of: Column = category) -> Column:
        return F.struct(name.alias("kind"), pattern.alias("pattern"), of.alias("category"), F.lit(action).alias("action"),
                        F.date_add("d", after).alias("effective"))

    return listed.select(F.inline(F.array(entry("add", 0), entry("add", 30, F.lit("phishing")), entry("remove", 60), entry("add", 150))))


def op6_temporal_url_filter(spark, sf_dir: str) -> DataFrame:
    """One row per page: host, fetch date, and the verdict of the list at that date."""
    pages = table(spark, sf_dir, "pages")
    return judge(captures_of(pages), entries_of(pages)).select("page_id", F.col("fetched").cast("string").alias("fetched"), "host", "n_active", "matched", "blocked")


_HOST = "lower(nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#@]*@)?(\\[[0-9A-Fa-f:.]+\\]|[^/?#:@\\[\\]]+)', 2), ''))"
ORACLE = f"""
WITH c AS (SELECT page_id, url, CAST(DATE '2023-01-01' + CAST(((page_id * 37) % 730 + 730) % 730 AS INTEGER) AS DATE) AS fetched, {_HOST} AS host,
             regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1) AS path FROM pages),
h AS (SELECT host, CAST('0x' || substr(md5(host), 1, 4) AS INTEGER) % 16 AS k,
             CAST(DATE '2023-01-01' + CAST('0x' || substr(md5(host), 5, 4) AS INTEGER) % 600 AS DATE) AS d FROM (SELECT DISTINCT host FROM c WHERE host IS NOT NULL)),
spans AS (SELECT CASE WHEN k < 2 THEN 'host' WHEN k < 4 THEN 'domain' ELSE 'prefix' END AS kind,
             CASE WHEN k < 4 THEN host ELSE host || '/en' END AS pattern, CAST(d + a AS DATE) AS valid_from, CAST(d + b AS DATE) AS valid_to
          FROM h, (VALUES (0, 60), (30, NULL), (150, NULL)) AS v(a, b) WHERE k < 6),
m AS (SELECT c.page_id, c.url, c.fetched, s.kind || ' ' || s.pattern AS hit FROM c JOIN spans s
        ON c.fetched >= s.valid_from AND (s.valid_to IS NULL OR c.fetched < s.valid_to) AND (
           (s.kind = 'host' AND c.host = s.pattern) OR
           (s.kind = 'domain' AND (c.host = s.pattern OR ends_with(c.host, '.' || s.pattern))) OR
           (s.kind = 'prefix' AND c.host || '/en' = s.pattern AND (c.path = '/en' OR starts_with(c.path, '/en/'))))),
n AS (SELECT page_id, url, fetched, count(*) AS n, min(hit) AS hit FROM m GROUP BY ALL)
SELECT c.page_id, CAST(c.fetched AS VARCHAR) AS fetched, c.host, coalesce(n.n, 0) AS n_active, n.hit AS matched, coalesce(n.n, 0) > 0 AS blocked
FROM c LEFT JOIN n ON c.page_id IS NOT DISTINCT FROM n.page_id AND c.url = n.url AND c.fetched = n.fetched
"""
