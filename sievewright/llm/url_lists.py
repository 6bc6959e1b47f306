"""URL filters by temporal list join, in DataFrame operations only.

Dated list entries become validity intervals: what an entry said last, at the time of a capture, holds. A capture is
looked up by its host, by each domain that the host is in, and by each path prefix, and joined as of its fetch time.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, written

#: The list of the registered query. Kind, pattern, category, date, action. A domain entry covers the
#: domain and all below it, a host entry one host, a prefix entry a host and what begins with this path segment by segment.
LIST = (
    ("domain", "spam-farm.example.org", "spam", "2024-01-10", "add"),
    ("domain", "spam-farm.example.com", "spam", "2024-01-10", "add"),
    ("domain", "spam-farm.example.com", "spam", "2024-06-15", "remove"),
    ("domain", "spam-farm.example.com", "spam", "2024-09-01", "add"),
    ("domain", "cheap-pills.example.com", "pharmacy", "2024-02-01", "add"),
    ("domain", "adult-x.example.net", "adult", "2024-01-01", "add"),
    ("domain", "adult-x.example.net", "adult", "2024-11-01", "remove"),
    ("domain", "casino-win.example.com", "gambling", "2024-03-05", "add"),
    ("host", "free-bets.example.com", "gambling", "2024-03-05", "add"),
    ("host", "m.ads-track.example.com", "tracking", "2024-04-20", "add"),
    ("domain", "ads-track.example.com", "tracking", "2024-08-01", "add"),
    ("prefix", "www.ththor.example.com/en", "mirror", "2024-05-01", "add"),
    ("prefix", "www.ththor.example.com/en", "mirror", "2024-05-20", "remove"),
)
FIRST_DAY = dt.date(2024, 1, 1)
_SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*://"


def url_host(url: Column) -> Column:
    """The host in lower case, without user, port and a dot at the end; empty if there is none."""
    return F.rtrim(F.lower(F.regexp_extract(url, _SCHEME + r"(?:[^/?#@]*@)?([^/?#:@]+)", 1)), F.lit("."))


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, _SCHEME + r"[^/?#]*([^?#]*)", 1)


def intervals(entries: DataFrame) -> DataFrame:
    """Dated entries (kind, pattern, category, at date, action) -> kind, pattern, category, since, until (not included, or null).

    An entry is on the list from an add to the next action on it; of actions on one day a remove counts last. Days
    without extent and rows with a null in any column drop out; repeated rows change nothing.
    """
    sound = entries.select("kind", F.lower("pattern").alias("pattern"), "category", F.col("at").cast("date").alias("at"), "action").dropna().distinct()
    in_order = Window.partitionBy("kind", "pattern", "category").orderBy("at", "action")
    spans = sound.withColumn("until", F.lead("at").over(in_order)).filter("action = 'add' AND (until IS NULL OR until > at)")
    return spans.select("kind", "pattern", "category", F.col("at").alias("since"), "until")


def lookups(most_labels: int, most_segments: int) -> Column:
    """What a capture is looked up by: (kind, pattern), as long as the longest entries of the list."""
    labels = F.split("host", r"\.")
    domain = F.transform(
        F.sequence(F.lit(1), F.least(F.size(labels), F.lit(max(1, most_labels)))),
        lambda n: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, -n, n), ".").alias("pattern")),
    )
    segments = F.filter(F.split("path", "/"), lambda s: s != "")
    prefix = F.transform(
        F.sequence(F.lit(0), F.least(F.size(segments), F.lit(most_segments))),
        lambda n: F.struct(F.lit("prefix").alias("kind"), F.concat_ws("/", F.col("host"), F.when(n > 0, F.array_join(F.slice(segments, 1, n), "/"))).alias("pattern")),
    )
    host = F.array(F.struct(F.lit("host").alias("kind"), F.col("host").alias("pattern")))
    return F.concat(domain, host, prefix)


def filter_captures(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """captures (page_id, url, fetched date) -> page_id, url, host, fetched, blocked, kind, pattern, category, since: one row a capture.

    blocked tells whether an entry was active on the day of the fetch; of several the longest pattern is named, then
    the least kind and category. The list is broadcast if its intervals are few, else joined by a shuffle on pattern.
    Nulls: a capture without url, host or day matches nothing and isn't blocked. Repeated captures stay apart. An empty
    list blocks nothing, an empty table gives no rows. Other columns are not read.
    """
    listed = written(intervals(entries), "intervals")
    reach = listed.agg(F.max(F.size(F.split("pattern", r"\."))).alias("labels"), F.max(F.size(F.split("pattern", "/")) - 1).alias("segments"), F.count(F.lit(1)).alias("n")).first()
    slim = captures.select("page_id", "url", "fetched", F.coalesce(url_host(F.col("url")), F.lit("")).alias("host"), F.coalesce(url_path(F.col("url")), F.lit("")).alias("path"))
    slim = slim.withColumn("_row", F.monotonically_increasing_id())
    # The last lookup matches nothing and keeps the capture; each has one of its own, so they don't meet in a shuffle.
    keys = slim.withColumn("_k", F.explode(F.concat(lookups(reach["labels"] or 1, reach["segments"] or 0), F.array(F.struct(F.lit("none").alias("kind"), F.col("_row").cast("string").alias("pattern"))))))
    right = listed.select(F.col("kind").alias("_kind"), F.col("pattern").alias("_pattern"), "category", "since", "until")
    right = F.broadcast(right) if reach["n"] <= BROADCAST_ROWS else right
    active = (F.col("fetched") >= F.col("since")) & (F.col("until").isNull() | (F.col("fetched") < F.col("until")))
    found = keys.join(right, (F.col("host") != "") & (F.col("_k.kind") == F.col("_kind")) & (F.col("_k.pattern") == F.col("_pattern")) & active, "left")
    hit = F.struct((-F.length("_pattern")).alias("short"), F.col("_kind").alias("kind"), "category", F.col("_pattern").alias("pattern"), "since")
    found = found.filter("_kind IS NOT NULL OR _k.kind = 'none'").withColumn("hit", F.when(F.col("_kind").isNotNull(), hit))
    best = found.groupBy("_row", "page_id", "url", "host", "fetched").agg(F.min("hit").alias("hit"))
    return best.select("page_id", "url", "host", "fetched", F.col("hit").isNotNull().alias("blocked"), "hit.kind", "hit.pattern", "hit.category", "hit.since")


def op9_temporal_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    # Pages have no time of capture; a day for each page id stands in.
    day = F.date_add(F.lit(FIRST_DAY), F.pmod(F.col("page_id"), F.lit(366)).cast("int"))
    entries = spark.createDataFrame(list(LIST), "kind string, pattern string, category string, at string, action string")
    return filter_captures(pages.select("page_id", "url", day.alias("fetched")), entries)


OP9_SQL = r"""
WITH entries(kind, pattern, category, day, action) AS (
  VALUES ENTRIES
), spans AS (
  SELECT *, lead(day) OVER (PARTITION BY kind, pattern, category ORDER BY day, action) AS until FROM entries
), listed AS (
  SELECT kind, pattern, category, day AS since, until FROM spans WHERE action = 'add' AND (until IS NULL OR until > day)
), captures AS (
  SELECT row_number() OVER () AS capture, page_id, url, DATE '2024-01-01' + CAST(page_id % 366 AS INTEGER) AS fetched,
    rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '.') AS host,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), hits AS (
  SELECT c.*, l.kind, l.pattern, l.category, l.since,
    row_number() OVER (PARTITION BY c.capture ORDER BY length(l.pattern) DESC NULLS LAST, l.kind, l.category) AS n
  FROM captures c LEFT JOIN listed l ON c.fetched >= l.since AND (l.until IS NULL OR c.fetched < l.until) AND CASE l.kind
    WHEN 'domain' THEN c.host = l.pattern OR ends_with(c.host, '.' || l.pattern)
    WHEN 'host' THEN c.host = l.pattern
    ELSE c.host || c.path = l.pattern OR starts_with(c.host || c.path, l.pattern || '/') END
)
SELECT page_id, url, host, fetched, category IS NOT NULL AS blocked, kind, pattern, category, since FROM hits WHERE n = 1
""".replace("ENTRIES", ", ".join(f"('{k}', '{p}', '{c}', DATE '{d}', '{a}')" for k, p, c, d, a in LIST))
