"""URL filters (operator 7): dated list entries as validity intervals, joined to captures as of their fetch times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Days that a capture and an interval are matched by.
SLICE_DAYS = 32


def host_of(url: Column) -> Column:
    """Lower-case host of a URL without user, port and a leading ``www.``; empty if there is none."""
    return F.regexp_replace(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1), r"^www\.", "")


def place_of(url: Column, depth: int = 0) -> Column:
    """The host of a URL and up to ``depth`` segments of its path, with case, joined by slashes; empty where there is no host."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    segments = F.slice(F.filter(F.split(path, "/"), lambda x: x != ""), 1, depth) if depth else F.array().cast("array<string>")
    host = host_of(url)
    return F.when(host != "", F.array_join(F.concat(F.array(host), segments), "/")).otherwise("")


def rules_of(place: Column) -> Column:
    """What a list may name to mean a place: its host, every parent domain of two labels or more (of names, not of addresses), and the host
    with each opening of its path."""
    pieces = F.split(place, "/")
    host, labels = pieces[0], F.split(pieces[0], r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    paths = F.transform(F.sequence(F.lit(2), F.greatest(F.size(pieces), F.lit(2))), lambda i: F.array_join(F.slice(pieces, F.lit(1), i), "/"))
    named = F.when(host.rlike(r"^[0-9.]+$|[:\[]"), F.array(host)).otherwise(parents)
    return F.when(F.size(pieces) > 1, F.concat(named, paths)).otherwise(named)


def rule_of_line(line: Column) -> Column:
    """The rule of a line of a list's file: a domain, a domain with a path, a URL, or a line of a hosts file (``0.0.0.0 domain``). Comments from ``#`` on,
    a leading ``www.`` and slashes at the end go; null where nothing is left."""
    bare = F.regexp_replace(F.trim(F.regexp_replace(line, r"#.*$", "")), r"^(?:0\.0\.0\.0|127\.0\.0\.1)\s+", "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), r"[/\s]+$", "")
    host, rest = F.regexp_replace(F.lower(F.regexp_extract(bare, r"^[^/]*", 0)), r"^www\.", ""), F.regexp_extract(bare, r"^[^/]*(/.*)$", 1)
    return F.nullif(F.when(host == "", "").otherwise(F.concat(host, F.regexp_replace(rest, "/+", "/"))), F.lit(""))


def validity(entries: DataFrame) -> DataFrame:
    """list, host, day, action ('add' or 'remove') -> list, host, from_day, to_day (exclusive; null: still valid).

    Each entry holds until the next one of the same list and host. Of entries of one day 'remove' wins. Windows are per (list, host),
    whose entries are a list's history, not captures.
    """
    day = entries.groupBy("list", "host", "day").agg(F.max("action").alias("action"))
    w = Window.partitionBy("list", "host").orderBy("day")
    return day.withColumn("to_day", F.lead("day").over(w)).where("action = 'add'").select("list", "host", F.col("day").alias("from_day"), "to_day")


def snapshot_validity(snapshots: DataFrame, days: DataFrame | None = None) -> DataFrame:
    """Whole lists of some days (list, host, day) -> list, host, from_day, to_day (exclusive; null: still valid).

    An entry holds from the first snapshot that has it to the next one of its list that doesn't. ``days`` (list, day) names snapshots
    that may be empty; without it those with a row count. Windows are over a list's days and over the history of a (list, host). Nulls
    make no entry, and repeated rows count once.
    """
    rows = snapshots.select("list", "host", "day").where("list is not null and host is not null and day is not null").distinct()
    w = Window.partitionBy("list").orderBy("day")
    known = (rows if days is None else days.where("day is not null")).select("list", "day").distinct()
    known = known.withColumn("nth", F.row_number().over(w)).withColumn("next", F.lead("day").over(w))
    own = Window.partitionBy("list", "host").orderBy("nth")
    runs = rows.join(known, ["list", "day"]).withColumn("run", F.col("nth") - F.row_number().over(own))
    return runs.groupBy("list", "host", "run").agg(F.min("day").alias("from_day"), F.max_by("next", "nth").alias("to_day")).drop("run")


def _held(intervals: DataFrame, last: int | None) -> DataFrame:
    """(host, slice, entries): what the lists say of a host in a slice of SLICE_DAYS days, up to the day ``last``."""
    end = F.coalesce("to_day", F.lit((last or 0) + 1))
    some = intervals.where(end > F.col("from_day"))
    slices = some.withColumn("slice", F.explode(F.sequence(F.floor(F.col("from_day") / SLICE_DAYS), F.floor((end - 1) / SLICE_DAYS))))
    return slices.groupBy("host", "slice").agg(F.collect_list(F.struct("list", "from_day", "to_day")).alias("entries"))


def listed_at_fetch(captures: DataFrame, intervals: DataFrame, url: str = "url", day: str = "day") -> DataFrame:
    """captures and active: array of struct(list, rule, from_day, to_day) of the intervals that hold on their day, whose rule (the column host
    of intervals) is the URL's host, a parent domain of it, or its host with an opening of its path.

    Paths are read as deep as the deepest rule. Captures are reduced to distinct (place, slice of days) first; only these have their rules
    looked up, so neither a busy host nor the number of rules of a URL multiplies captures, and each capture stays one row. A null or odd
    URL and a null day match nothing and have an empty array; a column of captures called active is replaced; tables may be empty.
    """
    depth = intervals.agg(F.max(F.size(F.split("host", "/")) - 1)).first()[0] or 0
    rows = captures.select(F.struct("*").alias("row"), F.coalesce(place_of(F.col(url), depth), F.lit("")).alias("place"), F.col(day).alias("day"))
    rows = rows.withColumn("slice", F.floor(F.col("day") / SLICE_DAYS))
    held = _held(intervals, rows.agg(F.max("day")).first()[0])
    sites = rows.where("place <> '' and slice is not null").select("place", "slice").distinct().withColumn("host", F.explode(rules_of(F.col("place"))))
    told = F.transform("entries", lambda e: F.struct(e["list"].alias("list"), F.col("host").alias("rule"), e["from_day"].alias("from_day"), e["to_day"].alias("to_day")))
    on = sites.join(held, ["host", "slice"]).select("place", "slice", told.alias("told")).groupBy("place", "slice").agg(F.flatten(F.collect_list("told")).alias("told"))
    now = F.filter("told", lambda e: (e["from_day"] <= F.col("day")) & (e["to_day"].isNull() | (F.col("day") < e["to_day"])))
    active = F.array_sort(F.coalesce(now, F.array().cast(on.schema["told"].dataType)))
    kept = [F.col("row").getField(c).alias(c) for c in captures.columns if c != "active"]
    return rows.join(on, ["place", "slice"], "left").select(*kept, active.alias("active"))


def active_at_fetch(captures: DataFrame, intervals: DataFrame) -> DataFrame:
    """captures (with host and day) and active: array of struct(list, from_day, to_day) of the intervals that hold on their day.

    Both sides are matched by host and slice of SLICE_DAYS days. What a host's lists say in one slice is one row (a few entries for each
    list), so every capture, whatever else it repeats or lacks, stays one row; where a host has a third of all captures, adaptive
    execution splits them. Entries that were never removed hold up to the last capture. A null host or day matches nothing, captures
    of a slice without entries have an empty array, and empty tables on either side do no harm.
    """
    last = captures.agg(F.max("day").alias("last")).first()["last"]
    held = _held(intervals, last)
    dated = captures.withColumn("slice", F.floor(F.col("day") / SLICE_DAYS)).join(held, ["host", "slice"], "left")
    on = F.filter("entries", lambda e: (e["from_day"] <= F.col("day")) & (e["to_day"].isNull() | (F.col("day") < e["to_day"])))
    active = F.coalesce(on, F.array().cast(held.schema["entries"].dataType))
    return dated.withColumn("active", active).select(*captures.columns, "active")


def _number(text: Column, at: int) -> Column:
    return F.conv(F.substring(F.md5(text), at, 6), 16, 10).cast("long")


#: Snapshots of the list of the query that comes as whole lists, and days between them.
SNAPSHOTS, EVERY = 14, 30


def lists_of_pages(pages: DataFrame) -> DataFrame:
    """Validity intervals of two lists that are derived from the pages' own URLs, as no table has lists: ``block`` names sites (the last three
    labels of hosts) by additions and removals, ``review`` hosts with the first segment of a path, as whole lists of every EVERY days.
    What is listed when goes by digests."""
    host = host_of(F.col("url"))
    labels = F.split(host, r"\.")
    site = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 2, F.lit(1)), 3), ".")
    sites = pages.where(host != "").select(site.alias("host")).distinct().withColumn("n", _number(F.concat(F.lit("block:"), F.col("host")), 1)).where("n % 3 = 0")
    steps = F.array(*[F.struct(F.lit(shift).alias("shift"), F.lit(action).alias("action")) for shift, action in ((0, "add"), (40, "remove"), (90, "add"))])
    block = sites.withColumn("s", F.explode(steps)).select(F.lit("block").alias("list"), "host", (F.col("n") % 300 + F.col("s.shift")).cast("int").alias("day"), F.col("s.action").alias("action"))
    place = place_of(F.col("url"), 1)
    places = pages.where(place.contains("/")).select(place.alias("host")).distinct().withColumn("n", _number(F.concat(F.lit("review:"), F.col("host")), 9))
    nth = F.explode(F.sequence(F.lit(0), F.lit(SNAPSHOTS - 1)))
    review = places.withColumn("nth", nth).where("(n + nth) % 4 < 2").select(F.lit("review").alias("list"), "host", (F.col("nth") * EVERY).alias("day"))
    days = pages.sparkSession.range(SNAPSHOTS).select(F.lit("review").alias("list"), (F.col("id") * EVERY).cast("int").alias("day"))
    return validity(block).unionByName(snapshot_validity(review, days))


def digest(spark, sf_dir: str) -> DataFrame:
    """Query op7: each capture (a page, fetched on a day given by its id) with the lists that named its host, a parent domain or its path then.

    Null URLs have an empty host and are on no list. Captures with no match are kept, with blocked and reviewed false.
    """
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    captures = pages.withColumn("day", F.coalesce(F.col("page_id") % 400, F.lit(0)).cast("int"))
    listed = listed_at_fetch(captures, lists_of_pages(pages))
    on = lambda name: F.exists("active", lambda e: e["list"] == name).cast("int")
    first = F.array_max(F.transform("active", lambda e: e["from_day"])).cast("long")
    return listed.select("page_id", F.coalesce(host_of(F.col("url")), F.lit("")).alias("host"), F.col("day").cast("long").alias("fetch_day"), on("block").alias("blocked"), on("review").alias("reviewed"), first.alias("listed_day"))


SQL = """
with captures as (
  select page_id, coalesce(regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1), '^www[.]', ''), '') as host,
         regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/+([^/?#]+)', 1) as segment, cast(coalesce(page_id % 400, 0) as bigint) as day
  from pages),
parents as (
  select host, array_to_string(l[k:], '.') as rule
  from (select host, l, unnest(range(1, greatest(len(l) - 1, 1) + 1)) as k from (select host, string_split(host, '.') as l from (select distinct host from captures where host <> '')))),
sites as (select distinct array_to_string(l[greatest(len(l) - 2, 1):], '.') as rule from (select string_split(host, '.') as l from captures where host <> '')),
entries as (
  select rule, n % 300 + s.shift as day, s.action
  from (select rule, cast(('0x' || substr(md5('block:' || rule), 1, 6)) as bigint) as n from sites), (values (0, 'add'), (40, 'remove'), (90, 'add')) as s(shift, action) where n % 3 = 0),
valid as (
  select rule, day as from_day, to_day from (select *, lead(day) over (partition by rule order by day) as to_day from entries) where action = 'add'),
blocked as (
  select c.page_id, max(from_day) as listed_day
  from captures c join parents p on p.host = c.host join valid v on v.rule = p.rule and c.day >= v.from_day and (v.to_day is null or c.day < v.to_day) group by c.page_id),
numbered as (
  select page_id, least(day // 30, 13) as s, cast(('0x' || substr(md5('review:' || host || '/' || segment), 9, 6)) as bigint) as n from captures where host <> '' and segment <> ''),
reviewed as (
  select page_id, case when (n + s) % 4 = 1 and s > 0 then s - 1 else s end * 30 as listed_day from numbered where (n + s) % 4 < 2)
select c.page_id, c.host, c.day as fetch_day, cast(b.page_id is not null as integer) as blocked, cast(r.page_id is not null as integer) as reviewed, cast(greatest(b.listed_day, r.listed_day) as bigint) as listed_day
from captures c left join blocked b on b.page_id = c.page_id left join reviewed r on r.page_id = c.page_id
"""
