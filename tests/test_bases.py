from pyspark.sql import functions as F

from shelfmark.functions.parts import with_part
from shelfmark.operators import bases, blocking, groups, scoring
from shelfmark.sources.catalog import with_names


def catalogue(spark, rows):
    made = [(i, n, s, t, g) for i, n, s, t, g in rows]
    return with_names(with_part(spark.createDataFrame(made, "message_id long, filename string, file_size long, posted long, media_group string")))


ROWS = [
    *[(k, f"whole.part{k:02d}.rar", 10, 1000, "g") for k in range(1, 6)], (6, "whole.part05.rar", 10, 1000, "g"),  # all link to the least, one twice
    (10, "bare.zip", 10, 1, None), (11, "bare (2).zip", 10, 9_000_000, None),  # no link
    (20, "odd.part01.rar", 10, 1, None), (21, "odd.zip", 10, 1, None), (22, "odd.7z", 10, 90_000_000, "h"), (2300, "odd.part02.zip", 10, 90_000_000, "h"), (2301, "odd.part03.7z", 10, 90_000_000, "h"),
    *[(10_000 + 7 * k, f"big.part{k % 5 + 1:02d}.rar", 10, 1000 * k, f"g{k % 3}") for k in range(230)], *[(30_000 + k, "heap.zip", 10, k, "g") for k in range(230)], (50_000, "", 1, 1, None),
]


def test_groups_of_equal_bases_are_those_of_all_steps_one_by_one(spark):
    files = bases.stored(catalogue(spark, ROWS).withColumn("number", F.col("part.number")))
    pairs = scoring.scored_pairs(blocking.exact_base_pairs(files), files, why=True)
    same = lambda x, y: assert_same(x.select(*sorted(x.columns)), y.select(*sorted(x.columns)))
    same(pairs, bases.base_links(files, why=True))
    kept = pairs.where("kept")
    members, g = bases.resolve_bases(files)
    same(groups.group_members(files, kept), members)
    same(groups.finalise(files, groups.group_members(files, kept), kept), groups.rated(g))


def assert_same(x, y):
    left, right = ([str(r) for r in t.collect()] for t in (x, y))
    assert sorted(left) == sorted(right) and left


def test_a_whole_base_meets_once_and_needs_no_components(spark, monkeypatch):
    rows = [(k, f"s{k // 4}.part{k % 4 + 1:02d}.rar", 10, 1000, "g") for k in range(400)]
    seen = []
    step = groups.connected_components
    monkeypatch.setattr(groups, "connected_components", lambda links, *ends: (seen.append(links.count()), step(links, *ends))[1])
    members, g = bases.resolve_bases(bases.stored(catalogue(spark, rows)))
    assert g.count() == 100 and members.count() == 400 and seen == [0]
