import random

from pyspark.sql import functions as F

from shelfmark.operators.ranks import ranked


def test_ranks(spark):
    rnd = random.Random(1)
    rows = [(k, rnd.choice([None, 1, 2, 3, 10**12])) for k in rnd.sample(range(10**9), 3000)]
    df = spark.createDataFrame(rows, "id long, size long").repartition(7)
    got = [(r.nth, r.id) for r in ranked(df, F.desc_nulls_last("size"), "id").collect()]
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert sorted(got) == list(enumerate(i for i, _ in want))
    plan = ranked(df, "id")._jdf.queryExecution().toString()
    assert "Window" not in plan and ranked(df.limit(0), "id").count() == 0


def test_ranks_of_equal_rows(spark):
    got = [r.nth for r in ranked(spark.range(500).select(F.lit(1).alias("x")), "x").collect()]
    assert sorted(got) == list(range(500))
