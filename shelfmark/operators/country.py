"""Country evidence: aliases, top-level domains, cities and scripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import DOTTED
from .patterns import MOST_LETTERS, OTHER_PLACE, WEAK_WORDS, term_hits
from .summaries import script_countries

# A gazetteer is a parameter; this is a small default. code, name, aliases, top levels, cities
GAZETTEER = [
    ("in", "India", "india", "in", "mumbai delhi bangalore chennai"),
    ("gb", "United Kingdom", "united_kingdom great_britain england", "uk", "london manchester leeds"),
    ("us", "United States", "united_states usa america", "us", "new_york chicago houston miami"),
    ("fr", "France", "france french", "fr", "paris lyon marseille"),
    ("de", "Germany", "germany german deutschland", "de", "berlin munich hamburg"),
    ("es", "Spain", "spain spanish", "es", "madrid barcelona"),
    ("kr", "South Korea", "south_korea", "kr", "seoul busan"),
]
# Confidence of a phrase or long alias, a short alias, a top level, a city phrase, a city.
PHRASE, SHORT, TOP, CITY_PHRASE, CITY = 0.95, 0.80, 0.70, 0.60, 0.55


def gazetteer(spark: SparkSession, rows=GAZETTEER) -> DataFrame:
    """(term, kind, code, name, rank, confidence): one row per alias, city and top level."""
    out = []
    for rank, (code, name, aliases, tops, cities) in enumerate(rows):
        for a in aliases.split():
            out.append((a.replace("_", " "), "word", code, name, rank, PHRASE if "_" in a or len(a) >= 4 else SHORT, 1))
        out += [(t, "top", code, name, rank, TOP, 2) for t in tops.split()]
        out += [(c.replace("_", " "), "word", code, name, rank, CITY_PHRASE if "_" in c else CITY, 3) for c in cities.split()]
    return spark.createDataFrame(out, "term string, kind string, code string, name string, rank int, confidence double, level int")


# What a second kind of evidence adds.
BOOST = 0.08


def _hits_by_join(t: DataFrame, terms: DataFrame) -> DataFrame:
    """(id, code, level, confidence) of terms without any bound: words, phrases of up to as many words as the longest term has and top
    levels are exploded and joined to the terms."""
    t = t.withColumn("words", F.filter(F.split(F.regexp_replace("text", "[^a-z0-9]+", " "), " "), lambda w: w != ""))
    longest = terms.where("kind = 'word'").agg(F.max(F.size(F.split("term", " ")))).first()[0] or 1
    entry = lambda term, kind, before: F.struct(term.alias("term"), F.lit(kind).alias("kind"), before.alias("guarded"))
    no = F.lit(False)

    def phrases(n: int):
        guarded = lambda i: F.coalesce(F.get("words", i - 1).isin(OTHER_PLACE), no) if n > 1 else no
        each = F.transform(F.sequence(F.lit(0), F.size("words") - n), lambda i: entry(F.array_join(F.slice("words", i + 1, n), " "), "word", guarded(i)))
        return F.when(F.size("words") >= n, each).otherwise(F.array().cast("array<struct<term:string,kind:string,guarded:boolean>>"))

    tops = F.transform(F.regexp_extract_all("text", F.lit(DOTTED)), lambda d: entry(F.element_at(F.split(d, r"\."), -1), "top", no))
    found = t.select("id", F.explode(F.array_distinct(F.concat(*[phrases(n) for n in range(1, longest + 1)], tops))).alias("e")).select("id", "e.*").where("not guarded")
    usable = terms.where(~F.col("term").isin(WEAK_WORDS) | (F.col("kind") != "word"))
    return found.join(usable, ["term", "kind"]).select("id", "code", "level", "confidence")


def detect_countries(texts: DataFrame, terms: DataFrame, id_col: str = "id", text_col: str = "text", most_letters: int = MOST_LETTERS) -> DataFrame:
    """(id, code, name, confidence) of the best country of each id that has evidence (C5). An id may have several texts.

    One pass of an automaton over each whole text gives its terms; with terms of more letters than ``most_letters`` its words are joined
    to them instead. Each country counts its best level (alias, then top level, then city). A phrase right after south, north or
    central counts only where it also stands elsewhere. The scripts of an id's texts are evidence of their own, each once.
    A close runner-up caps the confidence at 0.60; beside a runner-up that isn't close, two kinds of evidence add BOOST, up to 0.99.
    Null texts have no evidence.
    """
    t = texts.select(F.col(id_col).alias("id"), F.lower(F.col(text_col).cast("string")).alias("text"))
    letters = terms.agg(F.coalesce(F.sum(F.length("term")), F.lit(0))).first()[0]
    if letters <= most_letters:
        known = [r.asDict() for r in terms.select("term", "kind", "code", "level", "confidence").collect()]
        hits = t.select("id", F.explode(term_hits(F.col("text"), known)).alias("h")).select("id", "h.*")
    else:
        hits = _hits_by_join(t, terms)
    scripts = t.select("id", F.explode(script_countries(F.col("text"))).alias("s")).select("id", "s.code", F.lit(None).cast("int").alias("level"), "s.confidence")
    ranked = F.when(F.col("level").isNotNull(), F.struct("level", (-F.col("confidence")).alias("c")))
    best = hits.unionByName(scripts).groupBy("id", "code").agg((-F.min(ranked)["c"]).alias("term"), F.max(F.when(F.col("level").isNull(), F.col("confidence"))).alias("script"))
    reasons = F.col("term").isNotNull().cast("int") + F.col("script").isNotNull().cast("int")
    both = best.select("id", "code", F.greatest("term", "script").alias("confidence"), reasons.alias("reasons"))
    names = terms.groupBy("code").agg(F.first("name").alias("name"), F.min("rank").alias("rank"))
    both = both.join(names, "code", "left")
    w = Window.partitionBy("id").orderBy(F.desc("confidence"), F.asc_nulls_last("rank"), "code")
    top = both.withColumn("place", F.row_number().over(w)).withColumn("second", F.lead("confidence").over(w)).where("place = 1")
    close = (F.col("second") >= 0.50) & (F.col("confidence") - F.col("second") < 0.15)
    sure = F.when(close, F.least("confidence", F.lit(0.60))).when(F.col("second").isNotNull() & (F.col("reasons") >= 2), F.least(F.lit(0.99), F.col("confidence") + BOOST)).otherwise(F.col("confidence"))
    return top.select("id", "code", "name", F.round(sure, 2).alias("confidence"))
