"""Groups of files of equal bases, from one deal of the files by base for their pairs and one for their groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import groups, scoring
from .blocking import BIG_BLOCK
from .components import dealt, stored


def big_bases(files: DataFrame) -> DataFrame:
    """(base): the non-empty bases of more than BIG_BLOCK files."""
    return stored(files.where("base <> ''").groupBy("base").count().where(F.col("count") > BIG_BLOCK).select("base"))


def small_pairs(files: DataFrame, why: bool = False, n_rows: int | None = None) -> DataFrame:
    """(base, and what judged gives) of all pairs of each non-empty base; both sides are one deal of the files by base."""
    f = dealt(files.where("base <> ''").select("base", scoring.facts()), "base", rows=n_rows)
    met = f.select("base", F.col("f").alias("fa")).join(f.select("base", F.col("f").alias("fb")), "base").where("fa.message_id < fb.message_id")
    met = met.select("base", F.col("fa.message_id").alias("a"), F.col("fb.message_id").alias("b"), "fa", "fb")
    return scoring.judged(met, F.lit(1.0), why=why, carried=("base",))


def big_pairs(files: DataFrame, why: bool = False) -> DataFrame:
    """The same of big bases through representatives: files with the least id of their base and slot, these with the least id of the base."""
    f = files.select("base", F.col("part.number").alias("slot"), scoring.facts())
    slots = f.groupBy("base", "slot").agg(F.min_by("f", "f.message_id").alias("fa"))
    least = slots.groupBy("base").agg(F.min_by("fa", "fa.message_id").alias("fl"))
    s = slots.select(F.col("base").alias("base_"), F.col("slot").alias("slot_"), "fa")
    own = f.join(s, (F.col("base") == F.col("base_")) & F.col("slot").eqNullSafe(F.col("slot_"))).select("base", "fa", F.col("f").alias("fb"))
    met = own.unionByName(least.join(slots, "base").select("base", F.col("fl").alias("fa"), F.col("fa").alias("fb"))).where("fa.message_id < fb.message_id")
    return scoring.judged(met.select("base", F.col("fa.message_id").alias("a"), F.col("fb.message_id").alias("b"), "fa", "fb"), F.lit(1.0), why=why, carried=("base",))


def base_links(files: DataFrame, why: bool = False) -> DataFrame:
    """Scored pairs of equal bases, as scored_pairs gives them for exact_base_pairs."""
    big = big_bases(files)
    small = small_pairs(files.join(big, "base", "left_anti"), why, files.count())
    return small.unionByName(big_pairs(files.join(big, "base", "left_semi"), why)).drop("base")


def resolve_bases(files: DataFrame, more: tuple = (), carried: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(members, summed groups with weakest, n_links and link) of stored files that are linked by equal bases alone; aggregates ``more`` come along.
    Members have the columns ``carried`` of the files.

    A base whose files all link to its least one is a group, and one without links is none; counts tell which bases are so. Big bases and
    those that are neither go through the connected components of their links, with the same results.
    """
    sizes = files.where("base <> ''").groupBy("base").agg(F.count("*").alias("n"), F.min("message_id").alias("lo")).where("n > 1")
    sizes = stored(sizes)
    big = sizes.where(F.col("n") > BIG_BLOCK).select("base")
    big = stored(big)
    n_rows = files.count()
    pairs = small_pairs(files.join(big, "base", "left_anti"), n_rows=n_rows).where("kept").groupBy("base", "a").agg(
        F.count("*").alias("edges"), F.min(F.when(~F.col("dup_slot"), F.struct("score", "a", "b"))).alias("link"), F.count_if(~F.col("dup_slot")).alias("n_links"))
    # the file with the least id that links at all tells whether it links to all others of its base
    by_base = pairs.groupBy("base").agg(F.min(F.struct("a", "edges")).alias("least"), F.min("link").alias("link"), F.sum("n_links").alias("n_links"))
    by_base = stored(by_base.join(sizes, "base").select("base", "lo", ((F.col("least.a") == F.col("lo")) & (F.col("least.edges") == F.col("n") - 1)).alias("whole"), "link", F.nullif("n_links", F.lit(0).cast("long")).alias("n_links")))
    odd = by_base.where("not whole").select("base")
    rest_bases = stored(big.unionByName(odd))
    rest = stored(files.join(rest_bases, "base", "left_semi"))
    odd_files = rest.join(big, "base", "left_anti")
    n_rest = rest.count()
    links = stored(small_pairs(odd_files, n_rows=n_rest).unionByName(big_pairs(rest.join(big, "base", "left_semi"))).drop("base").where("kept"))
    rest_members = stored(groups.group_members(rest, links))

    whole = by_base.where("whole").select("base", F.col("lo").alias("group_id"), F.col("link.score").alias("weakest"), "n_links", "link")
    # dealt before anything is summed: sums before the deal would sort all that a task reads
    few = dealt(files.join(rest_bases, "base", "left_anti"), "base", rows=n_rows)
    rows = few.join(whole, "base", "left").withColumn("group_id", F.coalesce("group_id", "message_id"))
    first = [F.first(c).alias(c) for c in ("weakest", "n_links", "link")]
    g = groups.summed(rows, "base", "group_id", more=(*first, *more)).drop("base")
    counted = links.where("not dup_slot").join(rest_members.withColumnRenamed("message_id", "a"), "a").groupBy("group_id").agg(*groups.counted_links())
    other = groups.summed(dealt(rest_members.join(rest, "message_id"), "group_id", rows=n_rest), "group_id", more=more).join(counted, "group_id", "left")
    own = rest.join(rest_members, "message_id").select("message_id", "group_id", *carried) if carried else rest_members
    members = rows.select("message_id", "group_id", *carried).unionByName(own)
    return members, g.unionByName(other)
