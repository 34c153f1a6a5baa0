"""Streams: incremental scans, job states, paces and waits. Each has a batch twin over the same columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.summaries import overlay
from ..sources.catalog import shape, upsert_latest

HOUR, FIVE_MINUTES = 3600, 300
#: Seconds after which a job that runs without a word counts as stalled, and how long before the newest event is late.
STALLED, LATE_SECONDS = 7 * 86400, 86400


def scan_stream(spark: SparkSession, folder: str, schema: str, checkpoint: str, target: str) -> None:
    """Files that are new in a folder go to a log of batches once: the checkpoint is the offset (A1, K1, K2). A batch that is run again
    overwrites its own part of the log, and read_catalog keeps the latest row of each key over all batches."""

    def keep(batch: DataFrame, epoch: int) -> None:
        latest = upsert_latest(shape(batch), ["source_id", "message_id"], F.coalesce(F.col("posted"), F.lit(0)))
        latest.write.mode("overwrite").parquet(f"{target}/epoch={epoch}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 100).parquet(folder)
    stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def read_catalog(spark: SparkSession, target: str) -> DataFrame:
    """One row for each key of a log of batches: that of the latest batch (K2, A3)."""
    return upsert_latest(spark.read.parquet(target), ["source_id", "message_id"], F.col("epoch")).drop("epoch")


#: A line of a log that tells of a wait: its time and, as key=value in this order, who waited, for how many seconds, for what.
WAIT_LINE = r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2})\S* .*\bwait who=(\S+) seconds=(\d+) what=(.*)$"


def wait_events(lines: DataFrame, line: str = "value", pattern: str = WAIT_LINE) -> DataFrame:
    """(ts, user, seconds, what) of the lines that tell of a wait; others go (K3). Works on streams and tables alike. The pattern has
    a group for each of the four."""
    part = lambda k: F.regexp_extract(line, pattern, k)
    some = lines.where(F.col(line).rlike(pattern))
    return some.select(F.to_timestamp(F.regexp_replace(part(1), "T", " "), "yyyy-MM-dd HH:mm:ss").alias("ts"), part(2).alias("user"), part(3).cast("long").alias("seconds"), part(4).alias("what"))


def wait_state(events: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """(one row with the seconds waited in the hour before now and the latest wait that isn't over, the six latest waits) (K5)."""
    at = F.to_timestamp(F.lit(now))
    e = events.withColumn("gone", F.unix_timestamp(at) - F.unix_timestamp("ts")).where("gone >= 0")
    open_ = (F.col("seconds") - F.col("gone") > 1).alias("open")
    state = e.agg(F.coalesce(F.sum(F.when(F.col("gone") < HOUR, F.col("seconds"))), F.lit(0)).alias("waited"), F.max_by(F.when(open_, F.struct("user", "what", "seconds", (F.col("seconds") - F.col("gone")).alias("left"))), F.when(open_, F.struct("ts", "user"))).alias("active"))
    return state, e.orderBy(F.desc("ts"), "user", "what").limit(6).select("ts", "user", "seconds", "what")


def pace_stream(events: DataFrame) -> DataFrame:
    """Events of a sliding five minutes by kind; a watermark bounds the state (K4)."""
    return events.withWatermark("ts", "10 minutes").groupBy(F.window("ts", "5 minutes", "1 minute"), "event_type").agg(F.count("*").alias("n"))


def with_status(states: DataFrame) -> DataFrame:
    return states.withColumn("status", F.when(F.col("last_type") == "error", F.when(F.col("errors") >= 5, "GIVEN_UP").otherwise("FAILED")).when(F.col("last_type") == "purchase", "SUCCESS").otherwise("RUNNING"))


def job_states(events: DataFrame) -> DataFrame:
    """The last event, tries and failures of each key: the fold of the ledger (K6)."""
    g = events.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("last_type"), F.count("*").alias("attempts"), F.count_if(F.col("event_type") == "error").alias("errors"), F.max_by(F.when(F.col("event_type") == "error", F.col("props")), F.when(F.col("event_type") == "error", F.col("event_id"))).alias("last_error"), F.max("event_id").alias("last_event"))
    return with_status(g)


def stalled_jobs(events: DataFrame, seconds: int = STALLED, late: int = LATE_SECONDS) -> DataFrame:
    """(user_id, last_event) of the jobs that still run, and whose last event is ``seconds`` older than what can still come, ``late`` seconds
    before the newest event: what the timers of the stream have marked when it rests (K6)."""
    last = events.groupBy("user_id").agg(F.max_by(F.struct("event_type", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), "event_id"), "event_id").alias("e"))
    newest = events.agg(F.max(F.unix_millis(F.col("ts").cast("timestamp"))).alias("newest"))
    overdue = F.col("e.ms") + seconds * 1000 <= F.col("newest") - late * 1000
    return last.crossJoin(newest).where(~F.col("e.event_type").isin("error", "purchase") & overdue).select("user_id", F.col("e.event_id").alias("last_event"))  # one row


def trailing(events: DataFrame, seconds: int) -> Window:
    return Window.partitionBy("user_id").orderBy(F.col("second")).rangeBetween(-seconds, 0)


def waits(events: DataFrame) -> DataFrame:
    """For each event the count and sum of the trailing hour and of five minutes of its key, and a level of escalation (K4, K5, K7)."""
    e = events.withColumn("second", F.unix_micros(F.col("ts").cast("timestamp")))
    hour, five = trailing(e, HOUR * 1_000_000), trailing(e, FIVE_MINUTES * 1_000_000)
    e = e.withColumn("n_hour", F.count("*").over(hour)).withColumn("wait_hour", F.round(F.sum("value").over(hour), 2)).withColumn("n_five", F.count("*").over(five))
    small = F.count_if(F.col("value") < 20).over(five)
    return e.withColumn("level", F.when(F.col("value") >= 60, 2).when((F.col("value") >= 20) | (small >= 5), 1).otherwise(0)).select("event_id", "user_id", "n_hour", "wait_hour", "n_five", "level")


def unfinished(keys: DataFrame, states: DataFrame) -> DataFrame:
    return keys.join(states.where("status = 'SUCCESS'").select("user_id"), "user_id", "left_anti")


def progress(states: DataFrame) -> DataFrame:
    """One row with the counts of jobs by status and the share that is done, in percent (A16). Without jobs all of them are 0."""
    of = lambda status: F.count_if(F.col("status") == status).alias(status.lower())
    counts = states.agg(F.count("*").alias("total"), *map(of, ["SUCCESS", "FAILED", "GIVEN_UP", "RUNNING"]))
    return counts.withColumn("percent", F.when(F.col("total") > 0, F.floor(F.col("success") * 100 / F.col("total"))).otherwise(0).cast("long"))


def progress_stream(events: DataFrame, target: str, checkpoint: str) -> None:
    """Keeps a JSON snapshot of the progress in a folder: the states of all keys so far are folded, and each batch writes them anew."""
    # the same fold as job_states, whose last error has no part in the counts
    g = events.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("last_type"), F.count_if(F.col("event_type") == "error").alias("errors"))

    def write(batch: DataFrame, epoch: int) -> None:
        progress(with_status(batch)).write.mode("overwrite").json(target)

    g.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def decided_stream(groups: DataFrame, decisions: str, target: str, checkpoint: str) -> None:
    """Groups of a stream under the decisions of a folder, which each batch reads anew, so that those made meanwhile take effect (K8)."""

    def decide(batch: DataFrame, epoch: int) -> None:
        made = batch.sparkSession.read.schema("group_id long, status string").parquet(decisions)
        overlay(batch, made).write.mode("overwrite").parquet(f"{target}/epoch={epoch}")

    groups.writeStream.foreachBatch(decide).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
