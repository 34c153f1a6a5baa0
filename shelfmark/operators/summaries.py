"""Texts that describe groups, titles without collisions, review items and the overlay of decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import flag, human_size

# Fixed value: the country confidence from which a summary names the country.
COUNTRY_CONFIDENCE = 0.75


def _listed(numbers: Column) -> Column:
    return F.array_join(F.transform(numbers, lambda x: x.cast("string")), ", ")


def _span(numbers: Column) -> Column:
    return F.concat(F.get(numbers, F.lit(0)).cast("string"), F.lit("–"), F.element_at(numbers, -1).cast("string"))


def summary_text(code: Column, country: Column, confidence: Column, name: Column, numbers: Column, missing: Column, partial_start: Column, n_files: Column, size: Column) -> Column:
    """Lines on country, name, parts, files and size of a group (B13). Numbers are sorted; without any, the line on parts is left out."""
    head = F.when(confidence >= COUNTRY_CONFIDENCE, F.concat(flag(code), F.lit(" "), F.upper(country))).otherwise("\U0001f310 COUNTRY: UNKNOWN")
    before = F.concat(F.lit(" (parts 1–"), (F.get(numbers, F.lit(0)) - 1).cast("string"), F.lit(" not in source)"))
    note = F.when(partial_start, before).when(F.size(missing) > 0, F.concat(F.lit(" (missing: "), _listed(missing), F.lit(")"))).otherwise("")
    parts = F.when(F.size(numbers) > 0, F.concat(F.lit("Parts: "), _span(numbers), note))
    return F.concat_ws("\n", head, F.concat(F.lit("Name: "), name), parts, F.concat(F.lit("Total files: "), n_files.cast("string")), F.concat(F.lit("Total size: "), human_size(size)))


def description(country: Column, confidence: Column, numbers: Column, missing: Column, partial_start: Column, n_files: Column, size: Column, status: Column, sure: Column) -> Column:
    """One paragraph on a group."""
    two = lambda c: F.format_string("%.2f", c)
    return F.concat_ws(
        " ",
        F.when(n_files > 1, F.concat(F.lit("Set of several parts, "), n_files.cast("string"), F.lit(" files, "), human_size(size), F.lit("."))).otherwise("Single file."),
        F.when(confidence >= COUNTRY_CONFIDENCE, F.concat(F.lit("Country: "), country, F.lit(" ("), two(confidence), F.lit(")."))),
        F.when(F.size(missing) > 0, F.concat(F.lit("Missing parts: "), _listed(missing), F.lit("."))),
        F.when(partial_start & (F.size(numbers) > 0), F.concat(F.lit("Parts "), _span(numbers), F.lit(" are there, earlier ones are not in the source."))),
        F.when(status == "REVIEW", F.concat(F.lit("Needs review (confidence "), two(sure), F.lit(")."))).when(status == "HELD", "Held back, not for export."),
    )


def review_marker(name: Column, sure: Column, reason: Column) -> Column:
    """What a reviewer sees on a group."""
    return F.format_string("REVIEW: %s (confidence %.2f)\nReason: %s", name, sure, F.coalesce(reason, F.lit("needs review")))


def distinct_titles(groups: DataFrame, block: int = 1 << 16) -> DataFrame:
    """groups (group_id, title, kind) with title made unlike those of other kinds (H5).

    The kind of the least id keeps a title; each group of another kind gets the next number, from 2, by its id. Numbers are
    counted within blocks of ids and then shifted by the blocks before, so no window spans a title that very many groups have.
    """
    first = groups.groupBy("title").agg(F.min_by("kind", "group_id").alias("owner"))
    g = groups.join(first, "title").withColumn("block", F.when(F.col("kind") != F.col("owner"), F.floor(F.col("group_id") / block)))
    counts = g.where("block is not null").groupBy("title", "block").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("title").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    shifts = counts.select("title", "block", F.coalesce(before, F.lit(0)).alias("before"))
    other = g.where("block is not null").join(shifts, ["title", "block"])
    nth = F.col("before") + F.row_number().over(Window.partitionBy("title", "block").orderBy("group_id")) + 1
    other = other.select("group_id", F.concat("title", F.lit(" ("), nth.cast("string"), F.lit(")")).alias("title"), "kind")
    return g.where("block is null").select("group_id", "title", "kind").unionByName(other)


def review_items(items: DataFrame) -> DataFrame:
    """(group_id, item_id, kind): the item that decides on a group, one of the kind grouping if there is any, else the one of least id."""
    best = items.groupBy("group_id").agg(F.min(F.struct((F.col("kind") != "grouping").alias("later"), "item_id", "kind")).alias("r"))
    return best.select("group_id", "r.item_id", "r.kind")


def overlay(groups: DataFrame, decisions: DataFrame) -> DataFrame:
    """groups with the status that the latest decision gives them; HELD stays (D15). Decisions have one row for each group."""
    d = decisions.select("group_id", F.col("status").alias("decided"))
    status = F.when(F.col("status") == "HELD", "HELD").otherwise(F.coalesce("decided", "status"))
    return groups.join(d, "group_id", "left").withColumn("status", status).drop("decided")


# Scripts that hint at a country, and how much.
SCRIPTS = [("ru", "[\u0400-\u04ff]", 0.35), ("in", "[\u0900-\u097f]", 0.35), ("il", "[\u0590-\u05ff]", 0.40)]


def script_countries(text: Column) -> Column:
    """array<struct(code, confidence)> of all that the scripts of a text hint at (C5e): Cyrillic, Devanagari, Hebrew."""
    hint = lambda code, pattern, sure: F.when(text.rlike(pattern), F.struct(F.lit(code).alias("code"), F.lit(sure).alias("confidence")))
    return F.array_compact(F.array(*[hint(*s) for s in SCRIPTS]))


def script_country(text: Column) -> Column:
    """The strongest of these hints, the first of equal ones; null without any."""
    return F.reduce(script_countries(text), F.lit(None).cast("struct<code:string,confidence:double>"), lambda best, s: F.when(best.isNull() | (s["confidence"] > best["confidence"]), s).otherwise(best))
