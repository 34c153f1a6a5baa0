"""A catalogue of made-up sets, of any size, for tests of scale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SUBJECTS = ["atlas", "survey", "tides", "harbour", "ledger", "meadow", "quartz", "signal"]
KINDS = ["archive", "journal", "records", "tables", "maps"]
#: How each convention names part n of a set; those with a final file end in its extension.
PATTERNS = ["%s.part%02d.rar", "%s.part%d.rar", "%s.%03d", "%s.zip.%03d", "%s.z%02d", "%s.7z.%03d", "%s.r%02d", "%s vol%d.iso"]
FINALS = {4: ".zip", 6: ".rar"}
MOST_PARTS = 14
#: Of a hundred sets or files: sets with a hole, sets that start late, files posted again, files posted again under another name.
HOLES, LATE, AGAIN, RENAMED = 10, 5, 4, 3
FIRST_DAY = 1_700_000_000


def _draw(salt: str, seed: int, choices: int, *keys: str) -> Column:
    return F.pmod(F.xxhash64(*keys, F.lit(salt), F.lit(seed)), F.lit(choices)).cast("int")


def synthetic_catalog(spark: SparkSession, n_sets: int, seed: int = 42) -> DataFrame:
    """Rows of a catalogue: n_sets sets in eight naming conventions of 2 to 14 parts, with holes, late starts and files posted again.

    Every column is a hash of the set's number, the file's number and the seed, so rows don't depend on the partitioning and nothing is
    shuffled. 0 sets give an empty table.
    """
    draw = lambda salt, choices, *keys: _draw(salt, seed, choices, *(keys or ("set",)))
    sets = spark.range(n_sets).withColumnRenamed("id", "set")
    sets = sets.withColumn("style", (F.col("set") % len(PATTERNS)).cast("int")).withColumn("n", 2 + draw("parts", MOST_PARTS - 1))
    sets = sets.withColumn("first", F.when(F.col("style") == 6, 0).otherwise(1))
    sets = sets.withColumn("hole", F.when((F.col("n") >= 4) & (draw("hole", 100) < HOLES), F.col("first") + 1 + draw("which", 100) % (F.col("n") - 2)))
    sets = sets.withColumn("late", F.when((F.col("n") >= 5) & (draw("late", 100) < LATE), 2).otherwise(0))
    last = F.col("first") + F.col("n") - 1
    numbers = F.filter(F.sequence(F.col("first") + F.col("late"), last), lambda k: ~k.eqNullSafe(F.col("hole")))
    numbers = F.when(F.col("style").isin(*FINALS), F.concat(numbers, F.array(F.lit(-1)))).otherwise(numbers)
    subject, kind = (F.get(F.array(*map(F.lit, words)), draw(salt, len(words))) for salt, words in (("subject", SUBJECTS), ("kind", KINDS)))
    sets = sets.withColumn("name", F.concat_ws(" ", F.concat(F.lit("s"), F.col("set").cast("string")), subject, kind))
    files = sets.withColumn("number", F.explode(numbers))
    name = F.coalesce(*[F.when((F.col("style") == k) & (F.col("number") >= 0), F.format_string(p, "name", "number")) for k, p in enumerate(PATTERNS)], *[F.when(F.col("style") == k, F.concat("name", F.lit(end))) for k, end in FINALS.items()])
    place = F.when(F.col("number") < 0, MOST_PARTS + 1).otherwise(F.col("number"))
    files = files.withColumn("filename", name).withColumn("message_id", (F.col("set") * (MOST_PARTS + 2) + place) * 2)
    size = (800_000_000 + draw("size", 1_000_000_000).cast("long") * 4 + draw("jitter", 41, "set", "number")).alias("file_size")
    files = files.withColumn("file_size", size).withColumn("file_id", F.concat(F.lit("fid-"), F.col("message_id").cast("string")))
    fate = draw("fate", 100, "set", "number")
    copies = F.when(fate < AGAIN + RENAMED, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    files = files.withColumn("renamed", fate >= AGAIN).withColumn("copy", F.explode(copies))
    noisy = (F.col("copy") == 1) & F.col("renamed")
    return files.select(
        F.lit(1).cast("long").alias("source_id"),
        (F.col("message_id") + F.col("copy")).alias("message_id"),
        F.when(noisy, F.concat("file_id", F.lit("-b"))).otherwise(F.col("file_id")).alias("file_id"),
        F.when(noisy, F.regexp_replace("filename", r"^([^.]*?)( vol[0-9]+)?(\..*)$", "$1 Copy$2$3")).otherwise(F.col("filename")).alias("filename"),
        "file_size",
        (FIRST_DAY + F.col("set") * 3600 + place * 30 + F.col("copy") * 7).alias("posted"),
        F.lit("application/octet-stream").alias("mime_type"),
        F.lit(None).cast("string").alias("caption"),
        F.lit(None).cast("string").alias("media_group"),
    )
