"""Decisions, job states, paces, waits and progress over events."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.text import eta
from ..operators import rollups
from ..operators.components import checkpoint_folder
from ..sources.snapshot import merged_stream, read_snapshot
from ..streaming import jobs, states as keyed


def events(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet")


def states(spark, sf):
    return jobs.job_states(events(spark, sf))


STATES_SQL = """states as (select user_id, max_by(event_type, event_id) as last_type, count(*) as attempts, count(*) filter (event_type = 'error') as errors,
 max_by(props, event_id) filter (event_type = 'error') as last_error, max(event_id) as last_event from events group by user_id),
jobs as (select *, case when last_type = 'error' then case when errors >= 5 then 'GIVEN_UP' else 'FAILED' end when last_type = 'purchase' then 'SUCCESS' else 'RUNNING' end as status from states)"""


def counts(spark, sf):
    return states(spark, sf).groupBy("status").agg(F.count("*").alias("n"), F.sum("attempts").alias("attempts"))


def pivot(spark, sf):
    e = events(spark, sf).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return e.groupBy("day").agg(F.count_if(F.col("event_type") == "purchase").alias("done"), F.count_if(F.col("event_type") == "error").alias("failed"), F.count_distinct("user_id").alias("users"), F.count("*").alias("n"))


def waits(spark, sf):
    return jobs.waits(events(spark, sf))


def remaining(spark, sf):
    """What is left to do, with the time it takes at a tenth of a job a second."""
    e = events(spark, sf)
    left = jobs.unfinished(e.select("user_id").distinct(), states(spark, sf))
    return left.agg(F.count("*").alias("n_left")).withColumn("eta", eta(F.col("n_left") * 10))


def decisions(spark, sf):
    """The latest decision on each group; a decision never releases what is held (every seventh group here)."""
    e = events(spark, sf).where("event_type in ('purchase', 'click', 'error')")
    d = e.groupBy(F.col("user_id").alias("group_id")).agg(F.max_by("event_type", "event_id").alias("last"))
    status = F.when(F.col("group_id") % 7 == 0, "HELD").when(F.col("last") == "purchase", "OK").when(F.col("last") == "error", "IGNORED").otherwise("REVIEW")
    return d.select("group_id", status.alias("status"))


def latest_failures(spark, sf):
    return events(spark, sf).where("event_type = 'error'").orderBy(F.desc("ts"), F.desc("event_id")).limit(10).select("event_id", "user_id", "props")


def progress(spark, sf):
    return jobs.progress(states(spark, sf)).withColumn("payload", F.to_json(F.struct("total", "success", "failed", "given_up", "running", "percent")))


def archive_jobs(spark, sf):
    """(jobs, files): orders as the jobs of their customer's region, their items as files."""
    read = lambda t: spark.read.parquet(f"{sf}/{t}.parquet")
    place = read("customer").join(read("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_regionkey").cast("long").alias("archive_id"))
    status = F.when(F.col("o_orderstatus") == "F", "SUCCESS").when(F.col("o_orderstatus") == "O", "RUNNING").otherwise("FAILED")
    jobs_ = read("orders").join(place, F.col("o_custkey") == F.col("c_custkey")).select("archive_id", F.col("o_orderkey").alias("job_id"), status.alias("status"), F.col("o_orderpriority").alias("label"), F.to_date("o_orderdate").alias("day"), "o_custkey")
    return jobs_, read("lineitem").select(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("message_id"), F.floor("l_extendedprice").cast("long").alias("file_size"))


def archive_progress(spark, sf):
    """Jobs, labels, finished jobs, files and bytes of each archive."""
    return rollups.archive_progress(*archive_jobs(spark, sf))


def archive_customers(spark, sf):
    """Distinct customers of each archive, counted, and whether the merged sketches of its days estimate them within 8 %."""
    jobs_, _ = archive_jobs(spark, sf)
    exact = jobs_.groupBy("archive_id").agg(F.count_distinct("o_custkey").alias("n_customers"))
    about = rollups.merged(rollups.day_sketches(jobs_, ["archive_id", "day"], "o_custkey"), "archive_id")
    return exact.join(about, "archive_id").select("archive_id", "n_customers", (F.abs(F.col("estimate") - F.col("n_customers")) <= F.greatest(F.lit(2.0), F.col("n_customers") * 0.08)).alias("close"))


def _stream(spark, sf):
    """(events of the table as a stream, folders for its result and its checkpoint)."""
    folder = f"{checkpoint_folder(spark)}/stream-{uuid.uuid4().hex}"
    return spark.readStream.schema(keyed.EVENTS).parquet(f"{sf}/events.parquet*"), f"{folder}/out", f"{folder}/offsets"


def job_stream(spark, sf):
    """The ledger as a stream leaves it: states and the jobs that stalled, by timer (K6)."""
    events_, target, offsets = _stream(spark, sf)
    keyed.job_stream(events_, target, offsets, late=f"{jobs.LATE_SECONDS} seconds")
    return keyed.read_jobs(spark, target)


def burst_stream(spark, sf):
    """The trailing waits as a stream with evicted state leaves them (K7)."""
    events_, target, offsets = _stream(spark, sf)
    keyed.burst_stream(events_, target, offsets)
    return keyed.read_bursts(spark, target)


def event_snapshot(spark, sf):
    """The latest event of each user and type, as a stream leaves it that merges its batches into a snapshot by key (A3, K1, K2)."""
    events_, target, offsets = _stream(spark, sf)
    merged_stream(events_.select("user_id", "event_type", "event_id", "value"), target, ["user_id", "event_type"], "event_id", offsets)
    return read_snapshot(spark, target, "user_id long, event_type string, event_id long, value double")


def event_payloads(spark, sf):
    """Payloads of events by type, read as variants (B18): how many there are and hold a number, and what these sum up to."""
    number = F.try_variant_get(F.try_parse_json("props"), "$.k", "long")
    e = events(spark, sf).select("event_type", number.alias("k"))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.count("k").alias("n_numbers"), F.sum("k").alias("total"), F.max("k").alias("largest"))


QUERIES = {"event_snapshot": event_snapshot, "event_payloads": event_payloads, "archive_progress": archive_progress, "archive_customers": archive_customers, "job_stream": job_stream, "burst_stream": burst_stream, "progress_snapshot": progress, "job_states": states, "job_counts": counts, "daily_pivot": pivot, "trailing_waits": waits, "remaining_work": remaining, "decisions": decisions, "latest_failures": latest_failures}
STREAM_SQL = f"""with {STATES_SQL}, last as (select user_id, max_by(ts, event_id) as ts from events group by user_id)
select jobs.*, status = 'RUNNING' and epoch_ms(ts) + {jobs.STALLED * 1000} <= (select epoch_ms(max(ts)) from events) - {jobs.LATE_SECONDS * 1000} as stalled from jobs join last using (user_id)"""
ARCHIVE_SQL = """jobs as (select cast(n_regionkey as bigint) as archive_id, o_orderkey as job_id, case o_orderstatus when 'F' then 'SUCCESS' when 'O' then 'RUNNING' else 'FAILED' end as status, o_orderpriority as label, o_custkey
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey)"""
SQL = {
    "archive_progress": f"""with {ARCHIVE_SQL}, files as (select l_orderkey as job_id, l_linenumber as id, cast(floor(l_extendedprice) as bigint) as size from lineitem),
s as (select job_id, count(*) as files, sum(size) as bytes from files group by job_id), f as (select job_id, sum(size) as first_bytes from files where (job_id, id) in (select job_id, min(id) from files group by job_id) group by job_id)
select archive_id, count(*) as n_jobs, count(*) filter (status = 'SUCCESS') as n_done, count(*) filter (status = 'FAILED') as n_failed, count(*) filter (status = 'RUNNING') as n_inflight, count(distinct label) as n_labels, count(distinct job_id) filter (status = 'SUCCESS') as n_finished,
 cast(coalesce(sum(files) filter (status = 'SUCCESS'), 0) as bigint) as files, cast(coalesce(sum(bytes) filter (status = 'SUCCESS'), 0) as bigint) as bytes, cast(coalesce(sum(first_bytes) filter (status = 'SUCCESS'), 0) as bigint) as first_bytes
from jobs left join s using (job_id) left join f using (job_id) group by archive_id""",
    "archive_customers": f"with {ARCHIVE_SQL} select archive_id, count(distinct o_custkey) as n_customers, true as close from jobs group by archive_id",
    "event_snapshot": "select user_id, event_type, max(event_id) as event_id, max_by(value, event_id) as value from events group by user_id, event_type",
    "event_payloads": """with e as (select event_type, try_cast(json_extract_string(props, '$.k') as bigint) as k from events)
 select event_type, count(*) as n, count(k) as n_numbers, cast(sum(k) as bigint) as total, max(k) as largest from e group by event_type""",
    "job_stream": STREAM_SQL,
    "job_states": f"with {STATES_SQL} select * from jobs",
    "job_counts": f"with {STATES_SQL} select status, count(*) as n, cast(sum(attempts) as bigint) as attempts from jobs group by status",
    "progress_snapshot": f"""with {STATES_SQL}, c as (select count(*) as total, count(*) filter (status = 'SUCCESS') as success, count(*) filter (status = 'FAILED') as failed,
 count(*) filter (status = 'GIVEN_UP') as given_up, count(*) filter (status = 'RUNNING') as running from jobs), p as (select *, case when total > 0 then success * 100 // total else 0 end as percent from c)
select *, '{{"total":' || total || ',"success":' || success || ',"failed":' || failed || ',"given_up":' || given_up || ',"running":' || running || ',"percent":' || percent || '}}' as payload from p""",
    "daily_pivot": "select strftime(ts, '%Y-%m-%d') as day, count(*) filter (event_type = 'purchase') as done, count(*) filter (event_type = 'error') as failed, count(distinct user_id) as users, count(*) as n from events group by 1",
    "trailing_waits": """select event_id, user_id, count(*) over h as n_hour, round(sum(value) over h, 2) as wait_hour, count(*) over f as n_five,
 cast(case when value >= 60 then 2 when value >= 20 or count(*) filter (value < 20) over f >= 5 then 1 else 0 end as integer) as level from events
 window h as (partition by user_id order by ts range between interval 1 hour preceding and current row), f as (partition by user_id order by ts range between interval 5 minutes preceding and current row)""",
    "remaining_work": f"with {STATES_SQL}, l as (select count(*) as n_left from jobs where status <> 'SUCCESS'), s as (select n_left, n_left * 10 as sec from l) select n_left, case when sec // 86400 > 0 then (sec // 86400) || 'd' else '' end || case when sec >= 3600 then (sec % 86400 // 3600) || 'h' else '' end || (sec % 3600 // 60) || 'm' as eta from s",
    "decisions": "select user_id as group_id, case when user_id % 7 = 0 then 'HELD' when last = 'purchase' then 'OK' when last = 'error' then 'IGNORED' else 'REVIEW' end as status from (select user_id, max_by(event_type, event_id) as last from events where event_type in ('purchase', 'click', 'error') group by user_id)",
    "latest_failures": "select event_id, user_id, props from events where event_type = 'error' order by ts desc, event_id desc limit 10",
}
SQL["burst_stream"] = SQL["trailing_waits"]
