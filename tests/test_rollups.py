import random

from pyspark.sql import functions as F

from shelfmark.operators import rollups


def test_archives(spark):
    rnd = random.Random(1)
    jobs = [(rnd.choice([1, 2, None]), k, rnd.choice(["SUCCESS", "FAILED", "RUNNING", None]), rnd.choice(["a", "b", None])) for k in range(60)]
    files = [(rnd.randint(0, 80), k % 5, rnd.choice([None, 1, 10])) for k in range(300)]
    got = {r.archive_id: tuple(r)[1:] for r in rollups.archive_progress(spark.createDataFrame(jobs, "archive_id long, job_id long, status string, label string"), spark.createDataFrame(files, "job_id long, message_id long, file_size long")).collect()}
    want = {}
    for a in {j[0] for j in jobs}:
        own = [j for j in jobs if j[0] == a]
        done = [j[1] for j in own if j[2] == "SUCCESS"]
        moved = [f for f in files if f[0] in done]
        first = sum(f[2] or 0 for f in moved if f[1] == min(g[1] for g in files if g[0] == f[0]))
        want[a] = (len(own), len(done), sum(j[2] == "FAILED" for j in own), sum(j[2] not in ("SUCCESS", "FAILED") for j in own), len({j[3] for j in own} - {None}), len(done), len(moved), sum(f[2] or 0 for f in moved), first)
    assert got == want


def test_least_rows(spark):
    df = spark.createDataFrame([(None, 2, "x"), (None, 1, "y"), (1, 5, "z"), (1, 5, "w"), (2, None, "n")], "k long, o long, v string")
    assert sorted(r.v for r in rollups.least_rows(df, ["k"], "o").collect()) == ["w", "y", "z"]


def test_sketches_merge(spark):
    rows = spark.range(60_000).select((F.col("id") % 7).alias("day"), (F.col("id") % 3).alias("archive"), (F.col("id") % 20_011).alias("v"))
    made = rollups.merged(rollups.day_sketches(rows, ["archive", "day"], "v"), "archive").collect()
    exact = {r[0]: r[1] for r in rows.groupBy("archive").agg(F.count_distinct("v")).collect()}
    assert len(made) == 3 and all(abs(r.estimate - exact[r.archive]) < 0.05 * exact[r.archive] for r in made)


def test_facets(spark):
    rows = [("a", 1, None), ("a", 2, True), (None, 1, True), ("b", 2, False)]
    df = spark.createDataFrame(rows, "x string, y long, z boolean")
    made = rollups.facets(df, ["x", "y", "z"], F.count("*").alias("n"))
    got = sorted(((r.facet, r.value, r.n) for r in made.collect()), key=repr)
    assert got == sorted([("x", "a", 2), ("x", None, 1), ("x", "b", 1), ("y", "1", 2), ("y", "2", 2), ("z", None, 1), ("z", "true", 2), ("z", "false", 1)], key=repr)
    assert made._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1 and rollups.facets(df.limit(0), ["x"], F.count("*").alias("n")).count() == 0
