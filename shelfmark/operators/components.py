"""Connected components of an edge list, as alternating star contractions (Kiveris et al., SoCC 2014)."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that the session names. A local folder is taken in local mode alone (tests)."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="spark-ck-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written to that folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """df as compressed columns in that folder: a fraction of a checkpoint's bytes, readers take the columns they need, and Spark knows the size."""
    folder = f"{checkpoint_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


#: Rows of a partition that ``dealt`` makes: what joins and aggregations sort there stays in memory.
DEALT_ROWS = 250_000


def dealt(df: DataFrame, *keys: str, rows: int | None = None) -> DataFrame:
    """df (of about so many rows; else they are counted) dealt by these columns into partitions of about DEALT_ROWS. Joins and aggregations by them need
    no other deal, and no task sorts more, however well the bytes of its input are compressed. Of few rows Spark merges partitions itself."""
    spark = df.sparkSession
    n = -(-(df.count() if rows is None else rows) // DEALT_ROWS)
    if n <= spark.sparkContext.defaultParallelism:
        return df.repartition(*keys)
    return df.repartition(max(n, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


def _state(edges: DataFrame) -> tuple:
    """Size and a hash of a set of edges; equal for two rounds when nothing changes any more."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to the least node around."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node links itself and its smaller neighbours to the least of them. Edges go from the larger node to the smaller."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    joined = edges.join(least, "u")
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v")


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component): the least node that each node of an edge list reaches, itself included.

    Every step is an aggregation with map-side combine and an equi-join, so a node with very many neighbours is split like any other key.
    Rounds grow with the logarithm of the longest path; each is checkpointed. Loops and repeated edges do no harm, edges with a null
    end are left out, and an empty list gives an empty table.
    """
    nodes = edges.select(F.col(src).alias("node")).unionByName(edges.select(F.col(dst).alias("node"))).where("node is not null").distinct()
    now = edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst)))
    now = checkpointed(now.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).distinct())
    seen = None
    while (state := _state(now)) != seen:
        seen = state
        now = checkpointed(_small_star(_large_star(now)).distinct())
    return nodes.join(now.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
