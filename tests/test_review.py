"""Review items of alike names: what is left out before Python runs, against the ratios by definition."""

import random

from pyspark.sql import functions as F

from shelfmark.functions.similarity import weighted
from shelfmark.operators import planning


def names(n=110):
    rnd = random.Random(11)
    out = ["é" * 12, "é" * 11 + "e", "a b", "b a", "x" * 120, "x" * 119 + "y", "ab" * 60, "ab" * 59 + "b", "a", "b", "ab"]
    while len(out) < n:
        base = "".join(rnd.choice("abc") for _ in range(rnd.choice([3, 8, 12, 13, 20, 31, 45]))) if rnd.random() < 0.3 else rnd.choice(out[-20:])
        s = list(base)
        for _ in range(rnd.randint(0, 3)):
            at = rnd.randint(0, len(s))
            s[at : at + rnd.randint(0, 1)] = [rnd.choice(["a", "b", "x", " ", "-", ""])]
        out.append("".join(s).strip() or "z")
    return sorted(set(out))


def test_no_alike_name_is_left_out_before_python(spark):
    made = names()
    pairs = [(a, b) for a in made for b in made if a < b]
    kept = {tuple(r) for r in spark.createDataFrame(pairs, "a string, b string").where(planning.may_be_alike(F.col("a"), F.col("b"))).collect()}
    alike = {(a, b) for a, b in pairs if round(weighted(a, b) / 100, 3) >= planning.ALIKE}
    assert alike <= kept and len(alike) > 100
    assert any(" " not in a + b for a, b in alike) and len(kept) < len(pairs)


def test_review_items_of_one_size(spark):
    made = names(50)
    files = spark.createDataFrame([(k, 7, n) for k, n in enumerate(made)], "message_id long, file_size long, base string")
    groups = spark.createDataFrame([], "group_id long, status string, name string, confidence double, review_reason string, n_files long, country_name string, country_confidence double")
    got = {(r.a, r.b): r.likeness for r in planning.review_items(groups, files).select(F.from_json("payload", "a long, b long, likeness double").alias("p")).select("p.*").collect()}
    want = {(i, j): round(weighted(a, b) / 100, 3) for i, a in enumerate(made) for j, b in enumerate(made) if i < j}
    want = {k: v for k, v in want.items() if v >= planning.ALIKE}
    assert set(got) == set(want) and all(abs(got[k] - v) < 0.0011 for k, v in want.items())


def test_few_names_reach_python(spark):
    """Of two thousand names that share nothing none is left over for the ratios."""
    left = spark.range(2000).select(F.substring(F.md5(F.col("id").cast("string")), 1, 12).alias("a"))
    pairs = left.crossJoin(left.withColumnRenamed("a", "b").limit(200)).where("a < b")
    assert pairs.where(planning.may_be_alike(F.col("a"), F.col("b"))).count() < 20
