from pyspark.sql import functions as F

from shelfmark.operators import decisions, groups
from shelfmark.queries import resolution

COLUMNS = "group_id long, name string, held boolean, ignored boolean, status string, tagged boolean, n_files long, total_size long, country string, domain string"


def test_live_labels(spark):
    g = spark.createDataFrame([
        (1, "one", False, False, "REVIEW", False, 3, 10, None, None), (2, "two", True, False, "HELD", False, 3, 9, None, None), (3, "three", False, False, "OK", False, 3, 8, None, None),
        (4, "four", False, False, "OK", False, 1, 7, "France", None), (5, "five", False, False, "REVIEW", False, 1, 6, None, "udemy"), (6, "six", False, False, "OK", False, 2, 5, None, None)], COLUMNS)
    log = spark.createDataFrame([(1, 1, "ignore", None), (2, 1, "accept", None), (3, 2, "accept", None), (4, 3, "rename", "France"), (5, 4, "hold", None), (6, 5, "rename", " "), (7, 6, "what", None), (8, 77, "accept", None), (9, None, "hold", None), (10, 3, "accept", None)], "decision_id long, group_id long, action string, title string")
    got = {r.group_id: (r.status, r.kind, r.label) for r in decisions.live_labels(g, log).collect()}
    assert got == {1: ("OK", "dataset", "one"), 2: ("HELD", "held", "Quarantine"), 3: ("OK", "dataset", "France"), 4: ("HELD", "held", "Quarantine"), 5: ("OK", "domain", "Udemy"), 6: ("OK", "dataset", "six")}
    before = {r.group_id: r.label for r in decisions.live_labels(g, log.limit(0)).collect()}
    assert before[1] == "Review" and before[4] == "France"


def test_labels_of_two_kinds(spark):
    rows = spark.createDataFrame([(1, "misc", "A"), (2, "dataset", "A"), (3, "country", "A"), (4, "dataset", "A"), (5, "misc", "B"), (6, "ignored", None)], "group_id long, kind string, label string")
    got = {r.group_id: r.label for r in groups.apart_by_kind(rows.withColumn("x", F.lit(1))).collect()}
    assert got == {1: "A (3)", 2: "A", 3: "A (2)", 4: "A", 5: "B", 6: None}


def test_of_a_long_log_two_decisions_a_key_meet_the_groups(spark):
    log = spark.createDataFrame([(k, k % 3, ["rename", "accept", "what", "ignore"][k % 4], [f"t{k}", None, "x", " "][k % 4]) for k in range(200)] + [(900, None, "hold", None)], "decision_id long, user_id long, action string, title string")
    few = decisions.last_words(log, "user_id")
    assert few.groupBy("user_id").count().agg(F.max("count")).first()[0] == 2 and few.count() == 6
    of = lambda t: sorted(map(tuple, decisions.latest_decisions(t.withColumnRenamed("user_id", "group_id")).collect()))
    assert of(few) == of(log)
    sf = "/root/testdata/sf0.001"
    met = resolution.decision_log(spark, sf, spark.range(200).select((F.col("id") * 1000 + 1).alias("group_id")))
    assert met.groupBy("group_id").count().agg(F.max("count")).first()[0] <= 2
