"""Roll-ups of jobs by archive and of groups by several columns at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a sketch: 4,096 registers, a relative standard error of about 1.6 %.
SKETCH_BITS = 12


def least_rows(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The rows whose ``order`` is the least of their keys, all of them if several are (D14). Null keys are one key."""
    least = rows.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.min(order).alias("__least"))
    same = F.col(order) == F.col("__least")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return rows.join(least, same, "left_semi")


def archive_progress(jobs: DataFrame, files: DataFrame) -> DataFrame:
    """A row for each archive: its jobs by state, distinct labels, and the files and bytes that its finished jobs moved.

    jobs: archive_id, job_id, status (SUCCESS, FAILED or else under way), label; files: job_id, message_id, file_size, several for each job.
    Files are summed for each job before they meet it, so no archive gathers them; first_bytes counts a job's first file alone.
    """
    sums = files.groupBy("job_id").agg(F.count("*").alias("files"), F.sum(F.coalesce("file_size", F.lit(0))).alias("bytes"))
    first = least_rows(files, ["job_id"], "message_id").groupBy("job_id").agg(F.sum(F.coalesce("file_size", F.lit(0))).alias("first_bytes"))
    done = F.col("status") == "SUCCESS"
    joined = jobs.join(sums, "job_id", "left").join(first, "job_id", "left")
    total = lambda c: F.coalesce(F.sum(F.when(done, F.col(c))), F.lit(0)).cast("long").alias(c)
    return joined.groupBy("archive_id").agg(
        F.count("*").alias("n_jobs"), F.count_if(done).alias("n_done"), F.count_if(F.col("status") == "FAILED").alias("n_failed"), F.count_if(~F.coalesce(F.col("status").isin("SUCCESS", "FAILED"), F.lit(False))).alias("n_inflight"),
        F.count_distinct("label").alias("n_labels"), F.count_distinct(F.when(done, F.col("job_id"))).alias("n_finished"), *map(total, ("files", "bytes", "first_bytes")))


def day_sketches(rows: DataFrame, keys: list[str], counted: str) -> DataFrame:
    """keys -> sketch of the distinct values of a column; nulls count for nothing. Sketches of days make those of months, of all archives and so on."""
    return rows.groupBy(*keys).agg(F.hll_sketch_agg(counted, F.lit(SKETCH_BITS)).alias("sketch"))


def merged(sketches: DataFrame, *keys: str) -> DataFrame:
    """keys -> estimate of the distinct values over all sketches of each; the rows behind the sketches aren't read again."""
    return sketches.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"))


def facets(rows: DataFrame, columns: list[str], *measures: Column) -> DataFrame:
    """(facet, value, measures): rows counted by each of several columns in one aggregation (GROUPING SETS) (G11, G12, G19). Rows without a value
    count under a null one."""
    each = rows.groupingSets([[c] for c in columns], *columns).agg(F.grouping_id().alias("__set"), *measures)
    full = (1 << len(columns)) - 1
    # the bit of the one column that isn't rolled up is 0, the first column's is the highest
    facet, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, c in enumerate(columns):
        here = F.col("__set") == full - (1 << (len(columns) - 1 - k))
        facet, value = F.when(here, c).otherwise(facet), F.when(here, F.col(c).cast("string")).otherwise(value)
    return each.withColumn("facet", facet).withColumn("value", value).drop("__set", *columns)
