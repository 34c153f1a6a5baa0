"""Groups from links, exact duplicates, kept members, holds and labels."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import DOTTED, display_name, fold, safe_title, unresolvable
from .components import connected_components, dealt, stored
from .ranks import ranked
from .scoring import AUTO


def exact_duplicates(files: DataFrame) -> DataFrame:
    """(message_id, canonical, kind, confidence): rows whose file id, or else base, slot and size, an earlier row has."""
    # ids and names of one file alone have no second one to be found
    by_id = files.where("file_id is not null").groupBy("file_id").agg(F.min("message_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    f = files.withColumn("slot", F.coalesce("part.label", F.lit("base")) if "part" in files.columns else F.lit("base"))
    keys = ["base", "slot", "file_size"]
    named = dealt(f.where((F.length("base") >= 2) & (F.col("file_size") > 0)).select("message_id", *keys), *keys, rows=files.count())
    # stored, so that few such names are sent to the files and not all files to the names
    by_name = stored(named.groupBy(*keys).agg(F.min("message_id").alias("first_name"), F.count("*").alias("n")).where("n > 1").drop("n"))
    joined = f.join(by_id, "file_id", "left").join(by_name, keys, "left")
    one, two = F.col("first_id") < F.col("message_id"), F.col("first_name") < F.col("message_id")
    out = joined.where(F.coalesce(one, F.lit(False)) | F.coalesce(two, F.lit(False)))
    return out.select("message_id", F.when(one, F.col("first_id")).otherwise(F.col("first_name")).alias("canonical"), F.when(one, "file_id").otherwise("name_slot").alias("kind"), F.when(one, 1.0).otherwise(0.95).alias("confidence"))


def group_members(files: DataFrame, links: DataFrame) -> DataFrame:
    """(message_id, group_id): every file in exactly one group, named by its least id (F1, H2)."""
    comp = connected_components(links, "a", "b").withColumnRenamed("node", "message_id")
    return files.select("message_id").join(comp, "message_id", "left").select("message_id", F.coalesce("component", "message_id").alias("group_id"))


def finalise(files: DataFrame, members: DataFrame, links: DataFrame) -> DataFrame:
    """A row for each group: files, parts, gaps, size, confidence, status, why it needs review, what speaks for it and its weakest link
    (the least pair of those with the least score) (G1 to G6)."""
    g = summed(members.join(files, "message_id"), "group_id")
    counted = links.where("not dup_slot").join(members.withColumnRenamed("message_id", "a"), "a").groupBy("group_id").agg(*counted_links())
    return rated(g.join(counted, "group_id", "left"))


def counted_links() -> list[Column]:
    """What the links of a group say of it: the least score, how many there are, and the least pair of those with it."""
    return [F.min("score").alias("weakest"), F.count("*").alias("n_links"), F.min(F.struct("score", "a", "b")).alias("link")]


def summed(rows: DataFrame, *keys: str, more: tuple[Column, ...] = ()) -> DataFrame:
    """Files, sizes, parts and name of each group, from a row for each file; aggregates ``more`` come along."""
    # without a column display, the name shown is made for the first file of each group alone
    shown = "display" if "display" in rows.columns else F.struct("filename", F.col("part.base").alias("stem"))
    g = rows.groupBy(*keys).agg(
        F.count("*").alias("n_files"), F.sum(F.coalesce("file_size", F.lit(0))).alias("total_size"), F.sort_array(F.collect_set("part.number")).alias("numbers"),
        F.min_by(shown, "message_id").alias("name"), F.min_by("base", "message_id").alias("norm"), F.bool_or(F.trim("base") != "").alias("named"), *more)
    return g if "display" in rows.columns else g.withColumn("name", display_name(F.col("name.filename"), F.col("name.stem")))


def rated(g: DataFrame) -> DataFrame:
    """Summed groups with weakest, n_links and link -> gaps, confidence, status and reasons."""
    n, lo, hi = F.size("numbers"), F.get("numbers", F.lit(0)), F.element_at("numbers", -1)
    g = g.withColumn("partial_start", F.coalesce(~lo.isin(0, 1), F.lit(False)))
    g = g.withColumn("missing", F.when((n > 0) & ~F.col("partial_start"), F.array_except(F.sequence(lo, hi), "numbers")).otherwise(F.array().cast("array<int>")))
    bonus = F.when((F.col("n_files") > 1) & (n >= 3), F.when(F.col("partial_start"), 0.05).when(F.size("missing") <= 2, 0.08).otherwise(0.0)).otherwise(0.0)
    g = g.withColumn("confidence", F.round(F.least(F.lit(0.99), F.coalesce("weakest", F.lit(1.0)) + bonus), 3))
    weak = F.col("n_links").isNotNull() & (F.col("confidence") < AUTO)
    bare = ~F.col("named") | ((F.col("n_files") == 1) & unresolvable(F.col("norm")))
    two = lambda c: F.format_string("%.2f", c)
    said = F.concat_ws("; ", F.when(weak, F.concat(F.lit("confidence "), two("confidence"), F.lit(f" below {AUTO:.2f}"))), F.when(bare, F.lit("no name beyond a part number")))
    why = F.concat_ws("; ", F.when(F.col("partial_start") & (n >= 3), F.lit("parts start mid-range")), F.when(~F.col("partial_start") & (n >= 3), F.concat(F.size("missing").cast("string"), F.lit(" parts missing"))),
        F.when(F.col("n_links").isNotNull(), F.concat(F.lit("weakest link "), two("weakest"), F.lit(" of "), F.col("link.a").cast("string"), F.lit(" and "), F.col("link.b").cast("string"))))
    return g.withColumn("review_reason", F.nullif(said, F.lit(""))).withColumn("reasons", why).withColumn("status", F.when(weak | bare, "REVIEW").otherwise("OK")).drop("link")


def kept_members(members: DataFrame, duplicates: DataFrame) -> DataFrame:
    return members.join(duplicates.select("message_id"), "message_id", "left_anti")


def ordered_members(members: DataFrame, files: DataFrame) -> DataFrame:
    """(group_id, seq, message_id): members by part number (none last) and id."""
    w = Window.partitionBy("group_id").orderBy(F.coalesce("part.number", F.lit(1_000_000_000)), "message_id")
    return members.join(files.select("message_id", "part"), "message_id").select("group_id", F.row_number().over(w).alias("seq"), "message_id")


HOLD_PATTERNS = ["credential", "password", "breach", "leak", "pii", "dox", "ulp"]


def hold_reason(text: Column, patterns: list[str] = HOLD_PATTERNS) -> Column:
    """The first pattern that a folded text matches: words from their start on, phrases anywhere; else null."""
    quoted = lambda p: p if " " in p else rf"(^|[^a-z0-9]){p}"
    return F.coalesce(*[F.when(text.rlike(quoted(p)), p) for p in patterns])


PLAIN = re.compile("[a-z0-9]+")


def has_word(text: Column, words: list[str]) -> Column:
    """Whether a folded text has one of these as a whole word."""
    return text.rlike(f"(?:^|[^a-z0-9])(?:{'|'.join(w for w in words if PLAIN.fullmatch(w))})(?:[^a-z0-9]|$)")


def has_keyword(text: Column, keywords: list[str]) -> Column:
    """Whether a word of the folded text starts with a keyword of at least three letters (C2); the list is empty unless given."""
    keys = [k for k in keywords if len(k) >= 3 and PLAIN.fullmatch(k)]  # words have letters and digits alone
    return F.coalesce(text.rlike(f"(?:^|[^a-z0-9])(?:{'|'.join(keys)})"), F.lit(False)) if keys else F.lit(False)


# Word sets of categories, in the order in which they are tried.
CATEGORIES = [
    ("Courses / Education", ["udemy", "coursera", "edx", "course", "courses", "lecture", "lectures", "training", "bootcamp", "certification", "tutorial", "study", "academy"]),
    ("Books", ["book", "books", "ebook", "epub", "guide", "manual", "handbook", "novel"]),
    ("Software", ["setup", "installer", "portable", "crack", "cracked", "patch", "patches", "apk", "driver", "mod", "repack"]),
    ("Research / Academic", ["research", "academic", "journal", "thesis", "dissertation", "scientific", "paper"]),
    ("Databases / Datasets", ["database", "databases", "db", "dataset", "datasets", "dump", "dumps", "sql", "sqlite", "csv", "excel", "xlsx", "sqlite3", "parquet"]),
]


def category(text: Column, multipart: Column) -> Column:
    out = F.when(~has_word(text, [w for _, known in CATEGORIES for w in known]), F.lit(None).cast("string"))  # most names have none of them
    for label, known in CATEGORIES:
        out = out.when(has_word(text, known), label)
    return F.coalesce(out, F.when(multipart, "Databases / Datasets").otherwise("Miscellaneous"))


def domain(text: Column, services: list[str]) -> Column:
    """struct(name, confidence): a service or a short top level in a dotted token, or a service as a word (C4)."""
    known = F.array(*map(F.lit, sorted(services)))
    dotted = F.regexp_extract_all(text, F.lit(DOTTED))
    labels = lambda d: F.split(d, r"\.")
    usable = F.filter(dotted, lambda d: ~F.exists(labels(d), lambda x: F.length(x) == 1) & (F.array_contains(known, F.get(labels(d), F.lit(0))) | F.length(F.element_at(labels(d), -1)).isin(2, 3)))
    first = F.get(usable, F.lit(0))
    service = F.array_contains(known, F.get(labels(first), F.lit(0)))
    word = F.array_min(F.array_intersect(F.regexp_extract_all(text, F.lit("([a-z0-9]+)")), known))
    name = F.when(first.isNotNull() & service, F.get(labels(first), F.lit(0))).when(first.isNotNull(), first).otherwise(word)
    sure = F.when(first.isNotNull() & service, 0.85).when(first.isNotNull(), 0.70).when(word.isNotNull(), 0.80).otherwise(0.0)
    some = text.contains(".") | (has_word(text, services) if any(map(PLAIN.fullmatch, services)) else F.lit(False))  # else there is nothing to take apart
    return F.struct(F.when(some, name).alias("name"), F.when(some, sure).otherwise(0.0).alias("confidence"))


def weakest_links(members: DataFrame, links: DataFrame, most: int = 3) -> DataFrame:
    """(group_id, a, b, score, evidence) of the weakest link of each group that has one, with the first few pieces of evidence (G4). Second copies of a part
    are no links; ties go to the least pair. An aggregation with map-side combine: no group is gathered."""
    own = links.where("kept and not dup_slot").join(members.select(F.col("message_id").alias("a"), "group_id"), "a")
    least = own.groupBy("group_id").agg(F.min(F.struct("score", "a", "b", "evidence")).alias("w"))
    return least.select("group_id", "w.a", "w.b", "w.score", F.slice("w.evidence", 1, most).alias("evidence"))


def enrich(groups: DataFrame, files: DataFrame, members: DataFrame, patterns: list[str] = HOLD_PATTERNS, keywords: list[str] = (), services: list[str] = ()) -> DataFrame:
    """groups with held (any member's name or caption matches a pattern), hold_reason (of the first such member), tagged (any name has a
    keyword), category (of the first member's name) and domain (of the group's base, unless held) (G7)."""
    f = with_traits(files, patterns, keywords).select("message_id", "filename", "reason", "tag")
    g = members.join(f, "message_id").groupBy("group_id").agg(*traits())
    return traited(groups.join(g, "group_id"), services)


def with_traits(files: DataFrame, patterns: list[str] = HOLD_PATTERNS, keywords: list[str] = ()) -> DataFrame:
    """files with reason (the first pattern that its name or caption matches) and tag (whether its name has a keyword)."""
    folded = fold(F.col("filename"))
    text = F.concat_ws(" ", folded, fold(F.col("caption"))) if "caption" in files.columns else folded
    return files.withColumn("reason", hold_reason(text, patterns)).withColumn("tag", has_keyword(folded, list(keywords)))


def traits() -> tuple[Column, ...]:
    """Aggregates over the files of a group: why it is held, whether it is tagged, and the name of its first file."""
    said = F.when(F.col("reason").isNotNull(), F.concat_ws(": ", "filename", "reason"))
    return F.min_by(said, F.when(F.col("reason").isNotNull(), F.col("message_id"))).alias("hold_reason"), F.bool_or("tag").alias("tagged"), F.min_by("filename", "message_id").alias("first_name")


def traited(groups: DataFrame, services: list[str] = ()) -> DataFrame:
    """groups with these -> held, category and domain."""
    out = groups.withColumn("held", F.col("hold_reason").isNotNull()).withColumn("category", category(fold(F.col("first_name")), F.col("n_files") > 1)).drop("first_name")
    return out.withColumn("domain", F.when(~F.col("held") & (F.col("norm") != ""), domain(F.col("norm"), list(services))["name"]) if services else F.lit(None).cast("string"))


# Kinds in the order in which they keep a title that several have.
KINDS = ["held", "ignored", "review", "tagged", "dataset", "overflow", "country", "domain", "misc"]


def apart_by_kind(labelled: DataFrame) -> DataFrame:
    """Labels made unlike those of other kinds: the first kind in the order of KINDS keeps a title, the next ones get (2), (3)... (H5)."""
    place = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    shared = labelled.where("label is not null").groupBy("label").agg(F.sort_array(F.collect_set(place)).alias("places")).where(F.size("places") > 1)
    out = labelled.join(shared, "label", "left")
    nth = F.array_position("places", place)
    label = F.when(nth > 1, F.concat("label", F.lit(" ("), nth.cast("string"), F.lit(")"))).otherwise(F.col("label"))
    return out.withColumn("label", label).drop("places").select(*labelled.columns)


def assign_labels(groups: DataFrame, most_labels: int = 6000, bucket: int = 50) -> DataFrame:
    """groups (with held, ignored, tagged, country, domain) -> label and kind (C10); the smallest data sets beyond ``most_labels`` share
    buckets (H3, H4). Held groups stay held whatever else is true."""
    kind = F.when(F.col("held"), "held").when(F.col("ignored"), "ignored").when(F.col("status") == "REVIEW", "review").when(F.col("tagged"), "tagged").when(F.col("n_files") > 1, "dataset").when(F.col("country").isNotNull(), "country").when(F.col("domain").isNotNull(), "domain").otherwise("misc")
    g = groups.withColumn("kind", kind)
    top = g.where("kind = 'dataset'").orderBy(F.desc("total_size"), "group_id").limit(most_labels).select("group_id", F.lit(True).alias("own"))
    g = g.join(F.broadcast(top), "group_id", "left")  # most_labels rows
    # those that share buckets are ranked as they are, so that no join deals all groups again
    rest = F.coalesce((F.col("kind") == "dataset") & F.col("own").isNull(), F.lit(False))
    extra = ranked(g.where(rest), "group_id").withColumn("bucket", F.floor(F.col("nth") / bucket) + 1).drop("nth")
    g = g.where(~rest).withColumn("bucket", F.lit(None).cast("long")).unionByName(extra).withColumn("kind", F.when(F.col("bucket").isNotNull(), "overflow").otherwise(F.col("kind")))
    label = F.when(F.col("kind") == "held", "Quarantine").when(F.col("kind") == "review", "Review").when(F.col("kind") == "tagged", "Tagged").when(F.col("kind") == "overflow", F.concat(F.lit("Extra Datasets "), F.col("bucket").cast("string"))).when(F.col("kind") == "dataset", safe_title(F.col("name"))).when(F.col("kind") == "country", F.col("country")).when(F.col("kind") == "domain", F.initcap("domain")).when(F.col("kind") == "misc", "Miscellaneous")
    return apart_by_kind(g.withColumn("label", label).drop("own", "bucket"))
