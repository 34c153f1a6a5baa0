"""Scores of candidate pairs, as Column expressions over two file structs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.parts import ARCHIVES
from ..functions.similarity import partial_ratio, token_set_ratio, weighted_ratio

# The floor of name similarity, the score from which a link is kept, and from which a group needs no review.
LEAST_NAME, REVIEW, AUTO = 0.45, 0.65, 0.90


def compatible(a: Column, b: Column) -> Column:
    """Families that can belong to one set."""
    loose = a["container"].isNull() | b["container"].isNull()
    return a["family"].eqNullSafe(b["family"]) | (a["container"] == b["container"]) | (a["family"].isNotNull() & b["family"].isNotNull() & loose)


# What each kind of evidence adds to a score, and the name weights of score().
def structure_score(a: Column, b: Column) -> Column:
    """What part numbers and containers add."""
    gap = F.abs(a["number"] - b["number"])
    both = F.when(~F.coalesce(compatible(a, b), F.lit(False)), -0.05).when(gap == 0, 0.10).otherwise(F.when(a["family"] == b["family"], 0.30).otherwise(0.28) + F.when(gap == 1, 0.02).when(gap <= 4, 0.01).otherwise(0.0))
    # each side is looked at once: of one part and one other file, what the other is decides; whether the containers are equal has no sides
    numbers = a["number"].isNotNull()
    whole = lambda f: f["is_final"] & f["container"].isin(ARCHIVES)
    common = lambda f: f["container"].isin("zip", "rar", "7z", "tar")
    same, bare = a["container"] == b["container"], F.when(numbers, a["container"].isNull()).otherwise(b["container"].isNull())
    final = F.when(same, 0.30).when(bare, F.when(F.when(numbers, common(b)).otherwise(common(a)), 0.34).otherwise(0.10)).otherwise(0.15)
    one = F.when(F.when(numbers, whole(b)).otherwise(whole(a)), final).otherwise(F.when(same, 0.15).otherwise(0.02))
    numbered = a["number"].isNotNull().cast("int") + b["number"].isNotNull().cast("int")
    return F.when(numbered == 2, both).when(numbered == 1, one).otherwise(0.0)


def context_score(a: Column, b: Column) -> Column:
    """What times, media groups, ids and sizes add."""
    d = F.abs(a["posted"] - b["posted"])
    time = F.when(d <= 60, 0.08).when(d <= 600, 0.05).when(d <= 3600, 0.02).when(d > 7 * 86400, -0.03).otherwise(0.0)
    group = F.when(a["media_group"] == b["media_group"], 0.10).when(F.abs(a["message_id"] - b["message_id"]) <= 100, 0.04).otherwise(0.0)
    numbered = a["number"].isNotNull() | b["number"].isNotNull()
    size = F.when(numbered & (F.greatest(a["file_size"], b["file_size"]) <= F.least(a["file_size"], b["file_size"]) * 1.5), 0.03).otherwise(0.0)
    return time + group + size


def duplicate_slot(a: Column, b: Column) -> Column:
    return F.coalesce((a["number"] == b["number"]) & (a["base"] == b["base"]) & (a["base"] != ""), F.lit(False))


def score(a: Column, b: Column, name: Column, caption: Column | float = 0.0) -> Column:
    """Score in [0, 0.99] of a pair with this name similarity and caption score; pairs under LEAST_NAME score 0."""
    shorter = F.least(F.length(a["base"]), F.length(b["base"]))
    base = name * F.when(shorter >= 2, 0.45).otherwise(0.35) - F.when(name < 0.60, (0.60 - name) * 0.6).otherwise(0.0)
    full = F.least(F.lit(0.99), F.greatest(F.lit(0.0), base + structure_score(a, b) + context_score(a, b) + caption))
    return F.when(name < LEAST_NAME, 0.0).when(duplicate_slot(a, b), F.greatest(F.lit(0.5), base + 0.1)).otherwise(full)


def _label(f: Column) -> Column:
    return F.concat(F.lit("part "), f["number"].cast("string"))


def parts_said(a: Column, b: Column) -> Column:
    """What the part numbers and containers of a pair say, the first piece of its evidence but for the names; null if nothing."""
    gap = F.abs(a["number"] - b["number"])
    two = F.concat(_label(a), F.lit(" and "), _label(b))
    mixed = ~F.coalesce(compatible(a, b), F.lit(False))
    both = F.when(mixed, "kinds of archive that do not go together").when(gap == 0, F.concat(_label(a), F.lit(" of two names"))).when(gap == 1, F.concat(two, F.lit(" in a row"))).otherwise(F.concat(two, F.lit(" of one sequence")))
    part = F.when(a["number"].isNotNull(), a["container"]).otherwise(b["container"])
    other = F.when(a["number"].isNotNull(), b["container"]).otherwise(a["container"])
    final = F.when(a["number"].isNotNull(), b["is_final"]).otherwise(a["is_final"]) & other.isin(ARCHIVES)
    split = part.isNull() & other.isin("zip", "rar", "7z", "tar")
    one = F.when(final & (part == other), "a part and the whole archive").when(final & split, F.concat(F.lit("a part and a whole ."), other)).when(final & part.isNotNull(), F.concat(F.lit("a ."), part, F.lit(" part and a whole ."), other)).when(~final & (part == other), "one container, one number")
    numbered = a["number"].isNotNull().cast("int") + b["number"].isNotNull().cast("int")
    return F.when(numbered == 2, both).when(numbered == 1, one)


def evidence(a: Column, b: Column, parts: Column, name: Column | None = None, caption: Column | None = None) -> Column:
    """What speaks for and against a pair, in the order of the score's terms, as an array of texts (E14), ``parts`` as of parts_said. Without ``name`` the names are equal."""
    numbered = a["number"].isNotNull() | b["number"].isNotNull()
    d = F.abs(a["posted"] - b["posted"])
    sizes = F.greatest(a["file_size"], b["file_size"]) <= F.least(a["file_size"], b["file_size"]) * 1.5
    said = [
        parts, F.when(d <= 60, "posted within a minute").when(d > 7 * 86400, "posted over a week apart"),
        F.when(a["media_group"] == b["media_group"], "posted as one group").when(F.abs(a["message_id"] - b["message_id"]) <= 100, "ids close together"), F.when(numbered & sizes, "sizes alike"),
    ]
    if name is not None:
        said.insert(0, F.when(name < 0.60, F.concat(F.lit("names hardly alike, "), F.format_number(name, 2))))
    if caption is not None:
        said.append(F.when(caption > 0, "captions alike"))
    # no two texts are equal. A filter with a lambda would have Spark interpret every expression in it, row by row
    every = F.array_except(F.array(*said), F.array(F.lit(None).cast("string")))
    return F.when(duplicate_slot(a, b), F.array(F.concat(_label(a), F.lit(" twice")))).otherwise(every)


def caption_score(a: Column, b: Column) -> Column:
    """What alike captions add (E13); nothing where one is missing."""
    c = token_set_ratio(a, b)
    return F.when(a.isNotNull() & b.isNotNull() & (c > 0.5), c * 0.05).otherwise(0.0)


def name_similarity(a: Column, b: Column) -> Column:
    """Greatest of the weighted ratios; equal names are alike without a call of Python's (E5)."""
    return F.greatest(weighted_ratio(a, b), token_set_ratio(a, b) * 0.75, partial_ratio(a, b) * 0.85)


FIELDS = ("message_id", "base", "file_size", "posted", "media_group")


def facts(*more: str) -> Column:
    """f: what a score needs of a file."""
    return F.struct(*FIELDS, *more, "part.number", "part.family", "part.container", "part.is_final").alias("f")


def scored_pairs(pairs: DataFrame, files: DataFrame, fuzzy: bool = False, captions: bool = False, why: bool = False) -> DataFrame:
    """(a, b, score, dup_slot, kept) of candidate pairs, and with ``why`` their evidence. Without ``fuzzy`` all names must be equal; with neither that nor ``captions``
    no Python runs. Scores grow with the likeness of names, so pairs of other names that equal names wouldn't save are left out
    before any likeness is computed, and each pair of names is compared once."""
    side = files.select(facts("caption") if captions else facts())
    x = pairs.select("a", "b").join(side.select(F.col("f.message_id").alias("a"), F.col("f").alias("fa")), "a").join(side.select(F.col("f.message_id").alias("b"), F.col("f").alias("fb")), "b")
    fa, fb = F.col("fa"), F.col("fb")
    if fuzzy:
        same = x.where(fa["base"] == fb["base"]).withColumn("name", F.lit(1.0))
        most = score(fa, fb, F.lit(1.0), 0.05 if captions else 0.0) >= REVIEW
        other = x.where((fa["base"] != fb["base"]) & most).withColumn("base_a", fa["base"]).withColumn("base_b", fb["base"])
        names = other.select("base_a", "base_b").distinct().withColumn("name", name_similarity(F.col("base_a"), F.col("base_b")))
        x = same.unionByName(other.join(names, ["base_a", "base_b"]).drop("base_a", "base_b"))
    else:
        x = x.withColumn("name", F.lit(1.0))
    if captions:
        x = x.withColumn("caption", caption_score(fa["caption"], fb["caption"]))
    return judged(x, F.col("name"), F.col("caption") if captions else 0.0, fuzzy, captions, why)


def judged(x: DataFrame, name: Column, caption: Column | float = 0.0, fuzzy: bool = False, captions: bool = False, why: bool = False, carried: tuple[str, ...] = ()) -> DataFrame:
    """The score columns of pairs x (a, b, fa and fb as of facts), with the columns carried."""
    fa, fb = F.col("fa"), F.col("fb")
    s = F.round(score(fa, fb, name, caption), 6)
    # as a row of its own, so that a filter on the score doesn't make Spark work it out twice, in methods too long to be compiled
    row = F.struct(s.alias("score"), duplicate_slot(fa, fb).alias("dup_slot"))
    out = x.select(*x.columns if why else (*carried, "a", "b"), F.inline(F.array(row)))
    if why:
        # set apart in the same way, in two steps
        out = out.select("*", F.inline(F.array(F.struct(parts_said(fa, fb).alias("__parts")))))
        said = evidence(fa, fb, F.col("__parts"), name if fuzzy else None, caption if captions else None).alias("evidence")
        out = out.select(*carried, "a", "b", "score", "dup_slot", F.inline(F.array(F.struct(said))))
    return out.withColumn("kept", F.col("dup_slot") | (F.col("score") >= REVIEW))
