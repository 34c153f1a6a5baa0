"""Snapshots by key in a folder: a batch rewrites the buckets of keys that it touches, and no others (A3, K1, K2)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import checkpointed
from .catalog import upsert_latest

#: Buckets of a snapshot. A batch that touches a bucket reads and writes all of it, so choose them so that one is some hundred MB.
BUCKETS = 64
_VERSION, _BUCKET = "merge_version", "merge_bucket"


def _glob(spark: SparkSession, pattern: str) -> list:
    """Paths that fit a pattern, in whatever file system it names."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return [s.getPath() for s in found or []]


def _versions(spark: SparkSession, folder: str) -> tuple[int, dict[int, tuple[int, str]]]:
    """(next version, version and path of each live bucket). A version counts once it is whole, which its _SUCCESS file says."""
    number = lambda path, name: int(re.search(rf"{name}=(\d+)", path)[1])
    begun = [number(p.toString(), _VERSION) for p in _glob(spark, f"{folder}/{_VERSION}=*")]
    whole = {number(p.toString(), _VERSION) for p in _glob(spark, f"{folder}/{_VERSION}=*/_SUCCESS")}
    live: dict[int, tuple[int, str]] = {}
    for p in (p.toString() for p in _glob(spark, f"{folder}/{_VERSION}=*/{_BUCKET}=*")):
        version, bucket = number(p, _VERSION), number(p, _BUCKET)
        if version in whole and version >= live.get(bucket, (-1, ""))[0]:
            live[bucket] = (version, p)
    return max(begun, default=-1) + 1, live


def _latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of each key with the greatest order; ties go by the other columns, so the order of batches makes no difference."""
    rest = [c for c in rows.columns if c not in (*keys, order)]
    return upsert_latest(rows, keys, F.struct(order, *rest))


def merge(batch: DataFrame, folder: str, keys: list[str], order: str, buckets: int = BUCKETS) -> None:
    """Takes a batch into the snapshot of a folder: of each key the row with the greatest ``order`` stays, also where an older one comes late.

    Buckets are chosen by a hash of the keys. The batch is reduced to a row for each key; then the buckets that it touches are read, merged in one
    shuffle and written as a new version. Readers see the version once it is whole, so a job that is lost half-way leaves the snapshot
    as it was, and a batch that comes again changes no row. Null keys are keys, a null order is least, columns need an order (no maps),
    an empty batch changes nothing, and the number of buckets stays that of the first merge. One merge at a time.
    """
    spark = batch.sparkSession
    if {_VERSION, _BUCKET} & set(batch.columns):
        raise ValueError(f"{_VERSION} and {_BUCKET} name folders of the snapshot")
    version, live = _versions(spark, folder)
    if live and max(live) >= buckets:
        raise ValueError(f"the snapshot has more than {buckets} buckets")
    place = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    new = checkpointed(_latest(batch, keys, order).withColumn(_BUCKET, place))
    touched = [r[0] for r in new.select(_BUCKET).distinct().collect()]  # no more than buckets
    if not touched:
        return
    paths = [live[b][1] for b in touched if b in live]
    if paths:
        old = spark.read.option("basePath", folder).parquet(*paths).drop(_VERSION)
        new = _latest(new.unionByName(old).repartition(_BUCKET), [_BUCKET, *keys], order)
    else:
        new = new.repartition(_BUCKET)
    new.write.partitionBy(_BUCKET).mode("overwrite").parquet(f"{folder}/{_VERSION}={version}")


def read_snapshot(spark: SparkSession, folder: str, schema: str | None = None) -> DataFrame:
    """The snapshot: a row for each key. Without any merge it is empty, which needs the schema."""
    paths = [p for _, p in _versions(spark, folder)[1].values()]
    if not paths:
        if schema is None:
            raise ValueError(f"nothing was merged into {folder} yet; give the schema of an empty snapshot")
        return spark.createDataFrame([], schema)
    return spark.read.option("basePath", folder).parquet(*paths).drop(_VERSION, _BUCKET)


def vacuum(spark: SparkSession, folder: str) -> int:
    """Removes the buckets that later merges have replaced; how many. Not while somebody reads an older state."""
    live = {p for _, p in _versions(spark, folder)[1].values()}
    gone = [p for p in _glob(spark, f"{folder}/{_VERSION}=*/{_BUCKET}=*") if p.toString() not in live]
    for p in gone:
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    return len(gone)


def merged_stream(stream: DataFrame, folder: str, keys: list[str], order: str, checkpoint: str, buckets: int = BUCKETS) -> None:
    """Merges what is new in a stream into the snapshot and stops when nothing is left. Merges repeat without harm, so each row counts once."""

    def keep(batch: DataFrame, _epoch: int) -> None:
        merge(batch, folder, keys, order, buckets)

    stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
