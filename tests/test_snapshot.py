"""Merges by key against one aggregation over all batches."""

import random

import pytest
from pyspark.sql import functions as F

from shelfmark.sources import snapshot

SCHEMA = "source long, id long, posted long, name string"


def rows_of(df):
    return sorted(map(tuple, df.select("source", "id", "posted", "name").collect()), key=repr)


def latest(rows):
    best = {}
    for r in rows:
        rank = (r[2] is not None, r[2] or 0, r[3] is not None, r[3] or "")
        if r[:2] not in best or rank > best[r[:2]][0]:
            best[r[:2]] = (rank, r)
    return sorted((r for _, r in best.values()), key=repr)


def test_late_and_repeated_batches(spark, tmp_path):
    r = random.Random(4)
    batches = [[(r.choice([1, 2, None]), r.randrange(60), r.choice([None, *range(9)]), r.choice("abc")) for _ in range(120)] for _ in range(4)]
    for order in ([0, 1, 2, 3], [3, 0, 1, 1, 2, 0]):  # the second with repeats, old rows last
        folder = str(tmp_path / f"s{len(order)}")
        for k in order:
            snapshot.merge(spark.createDataFrame(batches[k], SCHEMA), folder, ["source", "id"], "posted", 8)
        assert rows_of(snapshot.read_snapshot(spark, folder)) == latest(sum(batches, []))
        assert snapshot.vacuum(spark, folder) > 0 and rows_of(snapshot.read_snapshot(spark, folder)) == latest(sum(batches, []))


def test_only_touched_buckets_are_written(spark, tmp_path):
    folder = str(tmp_path / "s")
    snapshot.merge(spark.range(400).select(F.lit(1).cast("long").alias("source"), "id", F.lit(1).cast("long").alias("posted"), F.lit("x").alias("name")), folder, ["source", "id"], "posted", 16)
    snapshot.merge(spark.createDataFrame([(1, 7, 2, "y")], SCHEMA), folder, ["source", "id"], "posted", 16)
    assert len(list((tmp_path / "s" / "merge_version=0").glob("merge_bucket=*"))) == 16
    assert len(list((tmp_path / "s" / "merge_version=1").glob("merge_bucket=*"))) == 1
    got = snapshot.read_snapshot(spark, folder)
    assert got.count() == 400 and [x.id for x in got.where("name = 'y'").collect()] == [7]
    (tmp_path / "s" / "merge_version=1" / "_SUCCESS").unlink()  # a merge that was lost half-way
    assert snapshot.read_snapshot(spark, folder).where("name = 'y'").count() == 0
    snapshot.merge(spark.createDataFrame([(1, 7, 2, "y")], SCHEMA), folder, ["source", "id"], "posted", 16)
    assert snapshot.read_snapshot(spark, folder).where("name = 'y'").count() == 1


def test_empty(spark, tmp_path):
    folder = str(tmp_path / "s")
    snapshot.merge(spark.createDataFrame([], SCHEMA), folder, ["source", "id"], "posted")
    assert snapshot.read_snapshot(spark, folder, SCHEMA).count() == 0
    with pytest.raises(ValueError):
        snapshot.read_snapshot(spark, folder)
    with pytest.raises(ValueError):
        snapshot.merge(spark.range(1).withColumn("merge_bucket", F.lit(1)), folder, ["id"], "id")


def test_stream_restarts(spark, tmp_path):
    source, folder, offsets = (str(tmp_path / n) for n in ("in", "out", "offsets"))
    every = []
    for k in range(3):
        batch = [(1, i, (k * 7 + i) % 5, f"{k}") for i in range(k * 10, k * 10 + 30)]
        every += batch
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        snapshot.merged_stream(spark.readStream.schema(SCHEMA).parquet(source), folder, ["source", "id"], "posted", offsets, 4)
    assert rows_of(snapshot.read_snapshot(spark, folder)) == latest(every)
