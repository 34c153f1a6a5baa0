"""Part structure of file names, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Extensions that count as containers, and those of archives.
ARCHIVES = ["rar", "zip", "7z", "tar", "gz", "bz2", "xz", "zst", "lz4", "iso", "cab", "arj", "lzh", "ace", "cbz", "uue", "sfx", "tgz", "tbz2"]
CONTAINERS = [*ARCHIVES, "pdf", "epub", "csv", "xlsx", "xls", "doc", "docx", "txt", "md", "sqlite", "db", "sql", "bak", "dat", "bin", "mov", "mp4", "mkv", "avi", "webm", "mp3", "flac", "wav", "apk", "jar", "war", "whl", "jpg", "jpeg", "png", "gif", "webp", "nzb", "torrent"]

# Families of part tokens, with the confidence each gives; what tells them apart is one pattern: the word before the number, or the number.
FAMILIES = [("part", 0.95), ("z", 0.98), ("r", 0.98), ("nn", 0.90), ("nn2", 0.85), ("vol", 0.85)]
FAMILY = r"^((?:part|vol)(?=[-_ ]?[0-9]{1,4}$)|[zr](?=[0-9]{2,3}$)|[0-9]{2,3}(?=$))"
# A part number inside a name, and what stands before it.
INLINE = r"(?i)(?:^|[\s_./-])(part[-_ ]?([0-9]{1,4}))(?=[\s_./-]|$)"
HEAD = r"(?i)^(|.*?[\s_./-])part[-_ ]?[0-9]{1,4}(?=[\s_./-]|$)"
INLINE_CONFIDENCE = 0.80


def _confidence(family: Column) -> Column:
    """CASE over the families."""
    out = None
    for name, confidence in FAMILIES:
        out = F.when(family == name, confidence) if out is None else out.when(family == name, confidence)
    return out


def apart(t: DataFrame, *columns: str) -> DataFrame:
    """t with these columns as the one row of an inline, which Spark neither merges with the next step nor works out twice."""
    kept = [c for c in t.columns if c not in columns]
    return t.select(*kept, F.inline(F.array(F.struct(*columns))))


def with_part(files: DataFrame, name: str = "filename") -> DataFrame:
    """Adds part: struct(base, family, number, container, is_final, label, confidence) of a file name. Null and empty names have an
    empty base. Each step is a column of its own, so that no expression is built into the next ones again and again, and the steps are
    set apart, so that each is a method short enough to be compiled."""
    last = lambda c: F.substring_index(c, ".", -1)
    without = lambda c, end: F.substring(c, F.lit(1), F.length(c) - F.length(end) - 1)
    # names as texts of tokens with one dot between any two: empty tokens don't count
    t = files.withColumn("_plain", F.trim(F.coalesce(F.col(name), F.lit(""))))
    odd = F.col("_plain").contains("..") | F.col("_plain").startswith(".") | F.col("_plain").endswith(".")
    t = t.withColumn("_plain", F.when(odd, F.regexp_replace(F.regexp_replace("_plain", r"\.\.+", "."), r"^\.|\.\z", "")).otherwise(F.col("_plain")))
    t = t.withColumn("_last", last("_plain")).withColumn("_container", F.when(F.lower("_last").isin(CONTAINERS), F.lower("_last")))
    t = t.withColumn("_stem", F.when(F.col("_container").isNotNull(), without("_plain", F.col("_last"))).otherwise(F.col("_plain")))
    t = apart(t, "_container", "_stem")
    rest = "_stem"
    for k in (1, 2):
        t = t.withColumn(f"_end{k}", F.when(F.col(rest) != "", last(rest))).withColumn(f"_before{k}", F.coalesce(without(rest, F.col(f"_end{k}")), F.lit("")))
        # a token that ends in a letter has no part number
        tail, kind = F.substring(f"_end{k}", -1, 1), F.col(f"_kind{k}")
        lettered = ((tail > "9") & (tail <= "Z")) | ((tail >= "a") & (tail <= "z"))
        t = t.withColumn(f"_kind{k}", F.when(lettered, "").otherwise(F.regexp_extract(F.lower(f"_end{k}"), FAMILY, 1)))
        digits = F.length(kind)
        t = t.withColumn(f"_family{k}", F.when(kind.isin("part", "z", "r", "vol"), kind).when(digits == 3, "nn").when(digits == 2, "nn2"))
        dated = F.substring(f"_before{k}", -3, 3).rlike("[0-9]$")  # a number right before: dates, years
        t = t.withColumn(f"_ok{k}", F.when(F.col(f"_family{k}").isin("nn", "nn2"), ~dated).otherwise(F.col(f"_family{k}").isNotNull()))
        t = apart(t, *[f"_{c}{k}" for c in ("end", "before", "family", "ok")])
        rest = f"_before{k}"
    pick = lambda c: F.when(F.col("_ok1"), F.col(f"_{c}1")).when(F.col("_ok2"), F.col(f"_{c}2"))
    t = t.withColumns({"_token": F.lower(pick("end")), "_before": pick("before"), "_family": pick("family")})
    t = t.withColumn("_inner", F.lower(last("_before"))).withColumn("_embedded", F.when(F.col("_inner").isin(CONTAINERS), F.col("_inner")))
    t = t.withColumn("_outer", F.when(F.col("_embedded").isNotNull(), without("_before", last("_before"))).otherwise(F.col("_before")))
    # numbers inside a name are looked for where its end has none, and the rest is cut only around one
    spoken = F.col("_token").isNull() & F.lower("_stem").contains("part")
    t = t.withColumn("_found", F.when(spoken, F.regexp_extract("_stem", INLINE, 1)).otherwise(""))
    t = apart(t, "_token", "_family", "_embedded", "_outer", "_found")
    t = t.withColumn("_digits", F.when(F.col("_found") != "", F.regexp_extract("_stem", INLINE, 2)))
    t = t.withColumn("_head", F.when(F.col("_found") != "", F.regexp_extract("_stem", HEAD, 1)))
    cut = F.concat(F.col("_head"), F.lit(" "), F.substring(F.col("_stem"), F.length("_head") + F.length("_found") + 1, F.length("_stem")))
    t = t.withColumn("_cut", F.when(F.col("_found") != "", F.trim(F.regexp_replace(F.regexp_replace(cut, r"^[ ._\t-]+|[ ._\t-]+$", ""), r"[\s_-]{2,}", " "))))
    t = apart(t, "_digits", "_cut")
    by_tail, by_inline = F.col("_token").isNotNull(), F.col("_found") != ""
    part = F.struct(
        F.when(by_tail, F.col("_outer")).when(by_inline, F.col("_cut")).otherwise(F.col("_stem")).alias("base"),
        F.when(by_tail, F.col("_family")).when(by_inline, F.lit("part")).alias("family"),
        F.when(by_tail, F.regexp_extract("_token", "([0-9]+)$", 1).cast("int")).when(by_inline, F.col("_digits").cast("int")).alias("number"),
        F.when(by_tail, F.coalesce("_container", "_embedded")).otherwise(F.col("_container")).alias("container"),
        (~by_tail & ~by_inline & F.coalesce(F.col("_container").isin(ARCHIVES), F.lit(False))).alias("is_final"),
        F.when(by_tail, F.col("_token")).when(by_inline, F.concat(F.lit("part"), F.col("_digits").cast("int").cast("string"))).alias("label"),
        F.when(by_tail, _confidence(F.col("_family"))).when(by_inline, INLINE_CONFIDENCE).otherwise(0.0).alias("confidence"),
    )
    t = t.withColumn("part", part)
    return t.drop(*[c for c in t.columns if c.startswith("_") and c not in files.columns])
