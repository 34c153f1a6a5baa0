"""Document fingerprints (operator 9): canonical exact digests, built of DataFrame functions alone."""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Classes of the ICU library that Spark brings along.
NORMALIZER, CHARACTER = "com.ibm.icu.text.Normalizer", "com.ibm.icu.lang.UCharacter"
#: Separates the second half of a fingerprint from the first.
SECOND = "shelfmark"
NO_ID = -(1 << 63)


def canonical(text: Column) -> Column:
    """NFKC, case folding (ß as ss, final sigma as sigma), NFKC again, runs of white space as one space, none at either end."""
    nfkc = lambda c: F.java_method(F.lit(NORMALIZER), F.lit("compose"), c, F.lit(True))
    folded = F.java_method(F.lit(CHARACTER), F.lit("foldCase"), nfkc(text), F.lit(True))
    plain = F.when(text.rlike("[^\\x00-\\x7F]"), nfkc(folded)).otherwise(F.lower(text))
    return F.trim(F.regexp_replace(plain, r"[\s\p{Z}]+", " "))


def wide_hash(canon: Column) -> Column:
    """128 bits of xxhash as 32 hex digits."""
    half = lambda *c: F.lpad(F.lower(F.hex(F.xxhash64(*c))), 16, "0")
    return F.concat(half(canon), half(F.lit(SECOND), canon))


def fingerprint(text: Column) -> Column:
    return wide_hash(canonical(text))


def _hashed(rows: DataFrame) -> DataFrame:
    """rows with the fingerprint of text and the digest of its canonical bytes."""
    return rows.withColumn("canon", canonical(F.col("text"))).withColumn("fingerprint", wide_hash(F.col("canon"))).withColumn("digest", F.unhex(F.sha2("canon", 256)))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def copy_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(fingerprint, digest, copy_of) of the texts that two rows or more have: the smallest of their ids.

    Rows are grouped by the fingerprint and, inside it, by the canonical bytes themselves, before as well as after the shuffle: copies
    collapse in the task that reads them, so a group of copies costs one text for each of these tasks, and a collision of hashes
    isn't taken for a copy.
    """
    rows = _hashed(_rows(docs, id_col, text_col)).select("id", "canon", "fingerprint")
    groups = rows.groupBy("fingerprint", "canon").agg(F.min("id").alias("copy_of"), F.count("*").alias("n")).where("n > 1")
    return groups.select("fingerprint", F.unhex(F.sha2("canon", 256)).alias("digest"), "copy_of")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint of each row, and copy_of: the smallest id with the same canonical bytes.

    Null text: as empty. Null ids stay null; copy_of is null only if no copy has an id. Returns id, fingerprint, copy_of for every
    input row (repeated ids are repeated rows, each with its own text's copy). Other columns are ignored; an empty table gives an empty one.
    """
    rows = _hashed(_rows(docs, id_col, text_col)).select("id", "fingerprint", "digest")
    joined = rows.join(copy_groups(docs, id_col, text_col), ["fingerprint", "digest"], "left")
    return joined.select(F.col("id").alias(id_col), "fingerprint", F.coalesce("copy_of", "id").alias("copy_of"))


def neighbours(rows: DataFrame, parts: int) -> tuple[Column, dict[int, tuple[int, int]]]:
    """Stretches of the order (id descending, hash ascending) with about as many rows each: as (stretch of a row, stretch -> id and hash
    that the next stretch begins with).

    The order is circular. An id that holds several stretches by itself is cut further by hash. The driver holds one row's id and hash
    for each stretch, not more.
    """
    cuts = [int(c) for c in rows.stat.approxQuantile("id", [k / parts for k in range(1, parts)], 0.2 / parts)] if parts > 1 else []
    often = {c: n for c, n in Counter(cuts).items() if n > 1}
    cuts = sorted(set(cuts))
    part = F.lit(0)
    if cuts:  # two steps, so that a row meets about 2 * sqrt(ranges) bounds
        below = lambda bounds: F.size(F.filter(bounds, lambda c: c <= F.col("id")))
        step = math.isqrt(len(cuts)) + 1
        coarse = below(F.lit(cuts[step - 1 :: step] or [1 << 62])) * step
        part = coarse + below(F.slice(F.lit(cuts), coarse + 1, step))
    inner = F.lit(0)
    if often:
        times = F.create_map(*[x for c, n in often.items() for x in (F.lit(c).cast("long"), F.lit(n))])[F.col("id")]
        inner = F.coalesce(1 + F.shiftright((F.shiftright("hash", 44) + (1 << 19)) * times, 20), F.lit(0))
    part = (part * (parts + 2) + (parts + 1) - inner).cast("int")
    tops = {r.part: r.top for r in rows.groupBy(part.alias("part")).agg(F.max(F.struct("id", F.bitwise_not("hash").alias("rest"))).alias("top")).collect()}
    order = sorted(tops)
    return part, {p: (tops[order[k - 1]].id, ~tops[order[k - 1]].rest) for k, p in enumerate(order)}


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """Fingerprints of each text, of an edited text (its last third replaced by the start of the next document) and of the next; digest is
    that of the text's canonical bytes.

    The next document is that of the next smaller id (after the smallest: the largest); rows of one id follow each other by a hash of
    their texts. Rows are dealt into stretches of that order once; the first row of the following stretch joins each, so no window spans
    the whole table or all rows of one id. Null text counts as empty. Rows with a null id come after all others. Exact digests
    are alike (1.0) or not (0.0). An empty table gives an empty one.
    """
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = _rows(docs, id_col, text_col).withColumn("id", F.coalesce("id", F.lit(NO_ID))).withColumn("hash", F.xxhash64("text"))
    part, follows = neighbours(rows, parts)
    rows = rows.withColumn("part", part)
    place = F.concat_ws(":", F.col("id").cast("string"), F.col("hash").cast("string"))
    keys = {f"{i}:{h}": p for p, (i, h) in follows.items()} or {"": 0}
    after = F.create_map(*[F.lit(x) for k in keys.items() for x in k])
    first = rows.where(F.col("id").isin([i for i, _ in follows.values()]) & place.isin(list(keys))).groupBy("id", "hash").agg(F.min("text").alias("text"))
    first = first.select("id", "text", "hash", after[place].alias("part"), F.lit(True).alias("ghost"))
    both = _hashed(rows.withColumn("ghost", F.lit(False)).unionByName(first)).drop("canon")
    order = Window.partitionBy("part").orderBy("ghost", F.desc("id"), "hash", "text")
    both = both.withColumn("next_text", F.lead("text").over(order)).withColumn("next_fingerprint", F.lead("fingerprint").over(order)).where("not ghost")
    n = F.char_length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next_text"), F.lit(1), cut))
    out = both.withColumn("n_chars", n.cast("long")).withColumn("edited", edited)
    out = out.withColumn("edited_fingerprint", fingerprint(F.col("edited")))
    like = lambda c: (F.col("fingerprint") == c).cast("double")
    return out.select(F.when(F.col("id") != NO_ID, F.col("id")).alias(id_col), "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", like(F.col("edited_fingerprint")).alias("near_edited"), like(F.col("next_fingerprint")).alias("near_next"), "digest")


def digest(spark, sf_dir: str) -> DataFrame:
    """Query op9: likeness of each document to an edited one and to the next, with the smallest copy of each."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    joined = edited_likeness(docs).join(copy_groups(docs), ["fingerprint", "digest"], "left")
    return joined.withColumn("copy_of", F.coalesce("copy_of", "doc_id")).drop("digest")
