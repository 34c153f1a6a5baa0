"""Summaries of sets, titles, facets, review items, decisions and scripts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import summaries
from ..sources.catalog import PARSED_SQL, parsed_parts


def set_summaries(spark, sf):
    """What each set of the catalogue of parts says of itself; sizes without decimals."""
    g = parsed_parts(spark, sf).where("base <> ''").groupBy("base").agg(F.count("*").alias("n"), F.sort_array(F.collect_set("part.number")).alias("numbers"), F.sum("file_size").alias("size"))
    lo = F.get("numbers", F.lit(0))
    g = g.withColumn("partial", F.coalesce(~lo.isin(0, 1), F.lit(False)))
    g = g.withColumn("missing", F.when((F.size("numbers") > 0) & ~F.col("partial"), F.array_except(F.sequence(lo, F.element_at("numbers", -1)), "numbers")).otherwise(F.array().cast("array<int>")))
    none, sure = F.lit(None).cast("string"), F.lit(None).cast("double")
    text = summaries.summary_text(none, none, sure, F.col("base"), F.col("numbers"), F.col("missing"), F.col("partial"), F.col("n"), F.col("size"))
    said = summaries.description(none, sure, F.col("numbers"), F.col("missing"), F.col("partial"), F.col("n"), F.col("size"), F.when(F.col("n") == 1, "HELD").otherwise("OK"), sure)
    whole = lambda c: F.regexp_replace(c, r"[.][0-9]+ ([KMGT])B", " $1B")
    return g.select("base", whole(text).alias("summary"), whole(said).alias("description"))


SUMMARY_SQL = f"""with {PARSED_SQL}, g as (select base, count(*) as n, list_sort(coalesce(list(distinct number) filter (number is not null), [])) as numbers, cast(sum(file_size) as bigint) as size from files where base <> '' group by base),
p as (select *, coalesce(numbers[1] not in (0, 1), false) as partial, numbers[1] || '–' || numbers[-1] as span,
 case when size < 1024 then size || ' B' when size < 1048576 then regexp_replace(printf('%.1f KB', size / 1024.0), '[.][0-9]+', '') when size < 1073741824 then regexp_replace(printf('%.1f MB', size / 1048576.0), '[.][0-9]+', '') else regexp_replace(printf('%.1f GB', size / 1073741824.0), '[.][0-9]+', '') end as sz from g),
m as (select *, case when len(numbers) > 0 and not partial then array_to_string(list_filter(range(numbers[1], numbers[-1] + 1), lambda x: not list_contains(numbers, x)), ', ') else '' end as missing from p)
select base, '🌐 COUNTRY: UNKNOWN' || chr(10) || 'Name: ' || base || case when len(numbers) > 0 then chr(10) || 'Parts: ' || span || case when partial then ' (parts 1–' || (numbers[1] - 1) || ' not in source)' when missing <> '' then ' (missing: ' || missing || ')' else '' end else '' end
  || chr(10) || 'Total files: ' || n || chr(10) || 'Total size: ' || sz as summary,
 case when n > 1 then 'Set of several parts, ' || n || ' files, ' || sz || '.' else 'Single file.' end || case when missing <> '' then ' Missing parts: ' || missing || '.' else '' end
  || case when partial then ' Parts ' || span || ' are there, earlier ones are not in the source.' else '' end || case when n = 1 then ' Held back, not for export.' else '' end as description from m"""


def titles(spark, sf):
    """Second words of part names as titles, brands as kinds."""
    parts = spark.read.parquet(f"{sf}/part.parquet")
    return summaries.distinct_titles(parts.select(F.col("p_partkey").alias("group_id"), F.get(F.split("p_name", " "), F.lit(1)).alias("title"), F.col("p_brand").alias("kind")), block=64)


def facets(spark, sf):
    """Records, characters and the languages of each source, as an index shows them."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return docs.groupBy("source").agg(F.count("*").alias("n_records"), F.sum("n_chars").alias("n_chars"), F.to_json(F.array_sort(F.collect_set("lang"))).alias("langs"))


def review_items(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").where("event_type in ('click', 'error')")
    return summaries.review_items(e.select(F.col("user_id").alias("group_id"), F.col("event_id").alias("item_id"), F.when(F.col("event_type") == "click", "grouping").otherwise("name").alias("kind")))


def overlay(spark, sf):
    """Customers as groups under the latest decision of their events; every seventh is held."""
    c = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").alias("group_id"), F.when(F.col("c_custkey") % 7 == 0, "HELD").otherwise("REVIEW").alias("status"))
    e = spark.read.parquet(f"{sf}/events.parquet").where("event_type in ('purchase', 'error')")
    d = e.groupBy(F.col("user_id").alias("group_id")).agg(F.max_by("event_type", "event_id").alias("last"))
    return summaries.overlay(c, d.select("group_id", F.when(F.col("last") == "purchase", "OK").otherwise("IGNORED").alias("status")))


def live_files(spark, sf):
    """Files of each group with its status under the latest decision: orders as files, a row each, so that no group meets in one array."""
    o = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_custkey").alias("group_id"), F.concat(F.lit("order_"), F.col("o_orderkey").cast("string"), F.lit(".zip")).alias("filename"))
    return o.join(overlay(spark, sf), "group_id").select("group_id", "filename", "status")


def scripts(spark, sf):
    """Scripts of whole documents, to which words in other scripts are added, as the tables have none: two of four words by the id."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    word = lambda by: F.element_at(F.array(*map(F.lit, WORDS)), (F.floor(F.col("doc_id") / by) % 4 + 1).cast("int"))
    return docs.select("doc_id", F.explode(summaries.script_countries(F.concat_ws(" ", "text", word(1), word(4)))).alias("h")).select("doc_id", "h.code", "h.confidence")


WORDS = ["база", "डेटा", "נתונים", "data"]
OVERLAY_SQL = """d as (select user_id, max_by(event_type, event_id) as last from events where event_type in ('purchase', 'error') group by user_id),
groups as (select c_custkey as group_id, case when c_custkey % 7 = 0 then 'HELD' when last = 'purchase' then 'OK' when last = 'error' then 'IGNORED' else 'REVIEW' end as status from customer left join d on user_id = c_custkey)"""
QUERIES = {"set_summaries": set_summaries, "distinct_titles": titles, "index_facets": facets, "review_items": review_items, "decision_overlay": overlay, "live_group_files": live_files, "script_evidence": scripts}
SQL = {
    "set_summaries": SUMMARY_SQL,
    "distinct_titles": """with t as (select p_partkey as group_id, string_split(p_name, ' ')[2] as title, p_brand as kind from part),
o as (select *, first_value(kind) over (partition by title order by group_id) as owner from t)
select group_id, title, kind from o where kind = owner union all select group_id, title || ' (' || (1 + row_number() over (partition by title order by group_id)) || ')', kind from o where kind <> owner""",
    "index_facets": "select source, count(*) as n_records, cast(sum(n_chars) as bigint) as n_chars, '[' || string_agg(distinct '\"' || lang || '\"', ',' order by '\"' || lang || '\"') || ']' as langs from documents group by source",
    "review_items": "select user_id as group_id, event_id as item_id, case when event_type = 'click' then 'grouping' else 'name' end as kind from events where event_type in ('click', 'error') qualify row_number() over (partition by user_id order by event_type <> 'click', event_id) = 1",
    "decision_overlay": f"with {OVERLAY_SQL} select * from groups",
    "live_group_files": f"with {OVERLAY_SQL} select group_id, 'order_' || o_orderkey || '.zip' as filename, status from orders join groups on group_id = o_custkey",
    "script_evidence": rf"""with t as (select doc_id, concat_ws(' ', text, {WORDS}[doc_id % 4 + 1], {WORDS}[doc_id // 4 % 4 + 1]) as s from documents)
select doc_id, 'ru' as code, 0.35::double as confidence from t where regexp_matches(s, '[\x{{0400}}-\x{{04FF}}]') union all select doc_id, 'in', 0.35 from t where regexp_matches(s, '[\x{{0900}}-\x{{097F}}]')
union all select doc_id, 'il', 0.40 from t where regexp_matches(s, '[\x{{0590}}-\x{{05FF}}]')""",
}
