"""URL filters by a temporal list join.

A list is a history: dated additions and removals of entries. Each entry's history becomes validity intervals, and
every capture is held against the entries that were active when it was fetched. Host entries match a host and all
below it, prefix entries a host and path up to a slash. A capture asks for all its hosts and prefixes by equality,
so the join never compares captures with the whole list; the list is broadcast where a count proves it small.

Of an addition and a removal of one entry at one time the removal holds. Repeated events change nothing. Events
without pattern or date, and captures without URL, host or date, match nothing; every capture gets a row, repeated
ones too. An empty table of captures gives no rows, an empty history no match. URLs of any length are asked for whole.
Columns of the captures stay, whatever their names, apart from n_active and lists, which are replaced.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh, materialize, spread_join, table

#: A list of up to so many intervals is sent to every executor.
BROADCAST_ROWS = 200_000


def intervals(events: DataFrame) -> DataFrame:
    """events: list, kind (host or prefix), pattern, action (add or remove), at. Returns list, key, since, until:
    active from since until before until (null: still active)."""
    c = F.col
    history = events.where("pattern is not null and at is not null").groupBy("list", "kind", "pattern", "at").agg(F.max(F.when(c("action") == "remove", 1).otherwise(0)).alias("removed"))
    # the history of one entry is a few events
    following = F.lead("at").over(Window.partitionBy("list", "kind", "pattern").orderBy("at"))
    return history.withColumn("until", following).where("removed = 0").select("list", F.concat(F.when(c("kind") == "host", "h:").otherwise("p:"), F.lower("pattern")).alias("key"), c("at").alias("since"), "until")


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def keys_of(url: Column) -> Column:
    """What entries could match a URL: its host and the domains above, and its path up to each slash."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("h:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    parts = F.split(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^?#]*)", 1), "/")
    prefixes = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.concat(F.lit("p:"), host, F.lit("/"), F.lower(F.array_join(F.slice(parts, F.lit(1), i), "/")), F.when(i > 0, "/").otherwise("")))
    return F.when((host != "") & host.isNotNull(), F.array_distinct(F.concat(domains, prefixes)))


def listed_changes(snapshots: DataFrame) -> DataFrame:
    """The events that dated copies of whole lists tell of. snapshots: list, kind, pattern, at (a row per entry of each
    copy). An entry is added at the first copy that has it after one that has not, and removed at the first copy of its
    list that lacks it again. Copies of a list are known by their entries, so an empty copy is none."""
    c = F.col
    entry = ["list", "kind", "pattern"]
    rows = snapshots.where("pattern is not null and at is not null").select(*entry, "at").distinct()
    # copies of a list are few: each gets the date of the one before it and after it
    order = Window.partitionBy("list").orderBy("at")
    copies = rows.select("list", "at").distinct().withColumns({"before": F.lag("at").over(order), "after": F.lead("at").over(order)})
    held = rows.join(copies, ["list", "at"])
    there = rows.select(*entry, c("at").alias("other"))
    same = lambda side: [held[x].eqNullSafe(there[x]) for x in entry] + [held[side] == there["other"]]
    new = held.join(there, same("before"), "left_anti").select(*entry, F.lit("add").alias("action"), "at")
    gone = held.where("after is not null").join(there, same("after"), "left_anti").select(*entry, F.lit("remove").alias("action"), c("after").alias("at"))
    return new.unionByName(gone)


def filter_captures(captures: DataFrame, events: DataFrame, url: str = "url", at: str = "fetched_on") -> DataFrame:
    """captures with n_active (entries active for it) and lists (their lists, sorted)."""
    c = F.col
    active = intervals(events)
    if active.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        active = F.broadcast(active)
    captures = captures.drop("n_active", "lists")
    names = captures.columns
    of, on = fresh("url"), fresh("at")
    captures = captures.withColumns({of: c(url), on: c(at)})
    fetched = captures.where(c(of).isNotNull() & c(on).isNotNull()).groupBy(of, on).agg(F.count("*").alias("n"))
    asked = fetched.select(of, on, "n", F.explode(keys_of(c(of))).alias("key"))
    hits = asked.join(active, "key").where((c(on) >= c("since")) & (c("until").isNull() | (c(on) < c("until"))))
    # a capture meets at most the entries of its own few keys
    verdicts = materialize(hits.groupBy(of, on).agg(F.first("n").alias("n"), F.count("*").alias("n_active"), F.sort_array(F.collect_set("list")).alias("lists")), "url-verdicts")
    # captures of one URL don't meet in one task, however many they are
    rows = verdicts.agg(F.sum("n")).first()[0] or 0
    joined = spread_join(captures, verdicts, [of, on], rows, how="left")
    return joined.select(*names, F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"), F.coalesce("lists", F.array().cast("array<string>")).alias("lists"))


#: The history that op10 applies: list, kind, pattern, action, day.
HISTORY = [
    ("spam", "host", "spam-farm.example.org", "add", "2024-02-01"),
    ("spam", "host", "spam-farm.example.org", "remove", "2024-05-15"),
    ("spam", "host", "spam-farm.example.org", "add", "2024-08-01"),
    ("pharma", "host", "cheap-pills.example.com", "add", "2024-03-10"),
    ("pharma", "host", "cheap-pills.example.com", "remove", "2024-11-30"),
    ("pharma", "host", "cheap-pills.example.net", "add", "2024-04-20"),
    ("adult", "host", "example.net", "add", "2024-06-01"),
    ("adult", "host", "example.net", "remove", "2024-06-15"),
    ("legal", "prefix", "blog.cheap-pills.example.net/en/", "add", "2024-01-15"),
    ("legal", "prefix", "blog.cheap-pills.example.net/en/", "remove", "2024-04-01"),
    ("legal", "host", "blog.example.org", "add", "2024-01-01"),
]


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages carry no date: the day of fetching is taken to be the day of 2024 that page_id gives."""
    events = spark.createDataFrame([(*x[:4], datetime.date.fromisoformat(x[4])) for x in HISTORY], "list string, kind string, pattern string, action string, at date")
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.date_add(F.lit(datetime.date(2024, 1, 1)), F.pmod("page_id", F.lit(366)).cast("int")).alias("fetched_on"))
    found = filter_captures(pages, events)
    return found.select("page_id", F.date_format("fetched_on", "yyyy-MM-dd").alias("fetched_on"), "n_active", F.array_join("lists", ",").alias("lists"), (F.col("n_active") == 0).alias("kept"))


OP10_SQL = (
    "WITH history(list, kind, pattern, action, day) AS (VALUES "
    + ", ".join(str(x) for x in HISTORY)
    + """),
captures AS (
  SELECT row_number() OVER () AS rid, page_id, DATE '2024-01-01' + CAST(page_id % 366 AS INTEGER) AS d,
         lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host,
         regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1) AS path
  FROM pages),
latest AS (
  SELECT c.rid, h.list, h.kind, h.pattern, arg_max(h.action, h.day || h.action) AS last_action
  FROM captures c JOIN history h ON CAST(h.day AS DATE) <= c.d
   AND CASE WHEN h.kind = 'host' THEN c.host = h.pattern OR ends_with(c.host, '.' || h.pattern)
            ELSE starts_with(c.host || lower(c.path), h.pattern) END
  GROUP BY ALL),
hits AS (
  SELECT rid, count(*) AS n_active, string_agg(DISTINCT list, ',' ORDER BY list) AS lists
  FROM latest WHERE last_action = 'add' GROUP BY rid)
SELECT page_id, strftime(d, '%Y-%m-%d') AS fetched_on, CAST(coalesce(n_active, 0) AS BIGINT) AS n_active,
       coalesce(lists, '') AS lists, n_active IS NULL AS kept
FROM captures c LEFT JOIN hits h ON c.rid = h.rid
"""
)
