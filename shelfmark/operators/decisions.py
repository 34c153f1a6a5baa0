"""Decisions of an administrator on groups, and the labels that groups have under them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import stored
from .groups import assign_labels

ACTIONS = ("accept", "rename", "ignore", "hold")


def last_words(log: DataFrame, key: str) -> DataFrame:
    """The decisions of a log (decision_id, action, title) that can still count for whatever a key decides on: the latest one with a known action,
    and the latest renaming. At most two rows a key, however long the log is."""
    known = log.where(F.col("action").isin(*ACTIONS) & F.col(key).isNotNull())
    named = (F.col("action") == "rename") & (F.trim("title") != "")
    row = F.struct("decision_id", "action", "title")
    last = known.groupBy(key).agg(F.max_by(row, "decision_id").alias("a"), F.max_by(row, F.when(named, F.col("decision_id"))).alias("b"))
    both = F.array_distinct(F.array_compact(F.array("a", "b")))
    return last.select(key, F.inline(both))


def latest_decisions(log: DataFrame) -> DataFrame:
    """(group_id, action, title): the latest of each group in an append-only log (decision_id, group_id, action, title); unknown actions count for
    nothing, the title is that of the latest renaming, whatever came after it (J1)."""
    known = log.where(F.col("action").isin(*ACTIONS) & F.col("group_id").isNotNull())
    named = F.when((F.col("action") == "rename") & (F.trim("title") != ""), F.col("title"))
    return known.groupBy("group_id").agg(F.max_by("action", "decision_id").alias("action"), F.max_by(named, F.when(named.isNotNull(), F.col("decision_id"))).alias("title"))


def decided(groups: DataFrame, log: DataFrame) -> DataFrame:
    """groups (with held, status, ignored, name) under the latest decisions: accepted and renamed ones need no review, ignored ones are out, held ones
    stay held whatever is decided, and a decision may hold any group (D15, J1). Decisions on unknown groups do nothing."""
    d = latest_decisions(log).withColumnRenamed("title", "new_title")
    is_ = lambda a: F.coalesce(F.col("action") == a, F.lit(False))
    out = groups.join(d, "group_id", "left").withColumn("held", F.col("held") | is_("hold"))
    out = out.withColumn("status", F.when(F.col("held"), "HELD").when(is_("accept") | is_("rename"), "OK").otherwise(F.col("status")))
    out = out.withColumn("ignored", F.col("ignored") | is_("ignore")).withColumn("name", F.coalesce("new_title", "name"))
    return out.drop("action", "new_title")


def live_labels(groups: DataFrame, log: DataFrame, most_labels: int = 6000, bucket: int = 50) -> DataFrame:
    """Groups with label and kind derived anew under the decisions: a group that was waiting for review gets the label that its own traits
    give it once it is accepted (C11)."""
    return assign_labels(stored(decided(groups, log)), most_labels, bucket)  # read for labels and for their ranks
