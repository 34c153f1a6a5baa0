"""Substring search through an index of trigrams: postings of blocks of lines by trigram, then a comparison with the lines of the blocks that have all of a text's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import stored
from .summaries import description

LINES, POSTINGS = "group_id long, text string, block long, bucket int", "gram string, block long, bucket int"
#: Folders of postings and of fragments; a search reads those that it needs.
BUCKETS = 32
#: Lines of a block are 2 to the power of this. Lines near each other have most trigrams in common, so blocks have far fewer postings than lines.
BLOCK_BITS = 12


def trigrams(lines: DataFrame) -> DataFrame:
    """(gram, block), once each: the trigrams of each block's texts. By positions rather than in a lambda, which Spark would interpret."""
    at = lines.where(F.length("text") >= 3).select("text", "block", F.explode(F.sequence(F.lit(1), F.length("text") - 2)).alias("at"))
    return at.select(F.substring("text", F.col("at"), F.lit(3)).alias("gram"), "block").distinct()


def fragments(groups: DataFrame, members: DataFrame, files: DataFrame) -> DataFrame:
    """(group_id, text): what can be searched of each group that may be shown, in lower case: one line of its own (name, category, country,
    description, status, label) and the name of each member, a row each, so that no group gathers its names (B15). Members that have a filename
    are not looked up in the files; every member's group is one of the groups."""
    shown = groups.where("kind <> 'held'")
    # few are held, so the names aren't dealt by group to leave them out
    hidden = stored(groups.where("not coalesce(kind <> 'held', false)").select("group_id"))
    country = F.col("country") if "country" in groups.columns else F.lit(None).cast("string")
    sure = F.col("country_confidence") if "country_confidence" in groups.columns else F.lit(None).cast("double")
    said = description(country, sure, F.col("numbers"), F.col("missing"), F.col("partial_start"), F.col("n_files"), F.col("total_size"), F.col("status"), F.col("confidence"))
    own = shown.select("group_id", F.lower(F.concat_ws(" ", "name", "category", country, said, "status", "label")).alias("text"))
    named = members if "filename" in members.columns else members.join(files.select("message_id", "filename"), "message_id")
    names = named.join(hidden, "group_id", "left_anti").select("group_id", F.lower("filename").alias("text"))
    return own.unionByName(names.where("text is not null"))


def _bucket(c: Column) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(BUCKETS)).cast("int")


def write_index(lines: DataFrame, folder: str) -> None:
    """Writes the fragments (group_id, text) and, by trigram, the blocks of lines that have it; a second run leaves what one leaves. Null texts go.

    A block is a stretch of lines as they come, so no text is shuffled, and those of one task are in one folder. A posting list is a stretch
    of sorted rows in its folder, dealt by trigram and block, so one of very many rows is several files.
    """
    spark = lines.sparkSession
    rows = lines.where("text is not null").select("group_id", "text", F.monotonically_increasing_id().alias("nth"))
    task = F.shiftright("nth", 33)
    rows = rows.select("group_id", "text", F.shiftright("nth", BLOCK_BITS).alias("block"), F.pmod(task, F.lit(BUCKETS)).cast("int").alias("bucket"))
    rows.write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{folder}/lines")
    kept = spark.read.schema(LINES).parquet(f"{folder}/lines")
    postings = trigrams(kept).withColumn("bucket", _bucket(F.col("gram")))
    part = F.pmod("block", F.lit(8))
    postings.repartition("bucket", part).sortWithinPartitions("bucket", "gram").write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{folder}/postings")


def find(spark: SparkSession, folder: str, texts: list[str]) -> DataFrame:
    """(query, group_id): the groups with a line that has the text, letter case aside, for each of a few texts.

    Lines of the blocks that have all trigrams of a text are read and compared, for all texts at once. A text under three letters has none: it is
    compared with all lines. An empty one finds every group.
    """
    lines = spark.read.schema(LINES).parquet(f"{folder}/lines")
    wanted = {t: t.strip().lower() for t in texts}
    grams = {t: sorted({s[i : i + 3] for i in range(len(s) - 2)}) for t, s in wanted.items()}
    every = sorted({g for gs in grams.values() for g in gs})
    table = spark.createDataFrame([(t, wanted[t], g, len(gs)) for t, gs in grams.items() for g in gs], "query string, sought string, gram string, n_grams int")
    short = spark.createDataFrame([(t, wanted[t]) for t, gs in grams.items() if not gs], "query string, sought string")
    found = lines.join(F.broadcast(short), F.col("text").contains(F.col("sought"))).select("query", "group_id")  # a row for each text
    if every:
        of = [b for (b,) in spark.createDataFrame([(g,) for g in every], "gram string").select(_bucket(F.col("gram"))).distinct().collect()]
        postings = spark.read.schema(POSTINGS).parquet(f"{folder}/postings").where(F.col("bucket").isin(sorted(of)) & F.col("gram").isin(every))
        met = postings.join(F.broadcast(table), "gram").groupBy("query", "sought", "n_grams", "block").agg(F.count("*").alias("n")).where("n = n_grams")
        met = met.select("query", "sought", "block", F.pmod(F.shiftright("block", 33 - BLOCK_BITS), F.lit(BUCKETS)).cast("int").alias("bucket"))
        found = found.unionByName(lines.join(met, ["bucket", "block"]).where(F.col("text").contains(F.col("sought"))).select("query", "group_id"))
    return found.distinct()
