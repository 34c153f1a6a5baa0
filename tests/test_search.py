import random

from shelfmark.operators import search


def test_search(spark, tmp_path):
    rnd = random.Random(1)
    lines = [(k % 150, "".join(rnd.choice("ab c.é") for _ in range(rnd.randint(0, 25)))) for k in range(800)] + [(900, None), (901, ""), (902, "x" * 50000 + " the end")]
    df = spark.createDataFrame([(*r, 1) for r in lines], "group_id long, text string, line int")
    texts = ["ab", "", "abc", "a b", "é.é", " AB. ", "the end", "xxx", "none here", "c.a.", "abab"]
    for _ in range(2):  # a second run leaves what one leaves
        search.write_index(df.select("group_id", "text"), str(tmp_path / "i"))
    got = [(r.query, r.group_id) for r in search.find(spark, str(tmp_path / "i"), texts).collect()]
    want = {(q, g) for q in texts for g, t in lines if t is not None and q.strip().lower() in t}
    assert len(got) == len(set(got)) and set(got) == want
    search.write_index(df.limit(0).select("group_id", "text"), str(tmp_path / "none"))
    assert search.find(spark, str(tmp_path / "none"), texts).count() == 0


def test_search_reads_few_folders(spark, tmp_path):
    df = spark.range(3000).selectExpr("id as group_id", "concat('line ', md5(cast(id as string))) as text")
    search.write_index(df, str(tmp_path / "i"))
    wanted = df.where("group_id = 77").first().text[9:20]
    found = search.find(spark, str(tmp_path / "i"), [wanted])
    assert [r.group_id for r in found.collect()] == [77]
    scans = [x for x in found._jdf.queryExecution().executedPlan().toString().splitlines() if "PartitionFilters" in x and "gram" in x]
    assert scans and all("bucket" in x.split("PartitionFilters")[1] for x in scans)


def test_lines_that_are_alike_share_postings(spark, tmp_path):
    """A posting for each trigram of each line made an index of many times the lines, all of it shuffled."""
    df = spark.range(20_000).selectExpr("id as group_id", "concat('order ', id, ' databases / datasets set of several parts, 4 files, ok') as text").coalesce(2)
    search.write_index(df, str(tmp_path / "i"))
    postings = spark.read.parquet(str(tmp_path / "i" / "postings"))
    assert postings.count() < df.count()
    assert sorted(r.group_id for r in search.find(spark, str(tmp_path / "i"), ["ORDER 77 d", "order 19999"]).collect()) == [77, 19999]


def test_no_name_of_a_held_group_can_be_found(spark):
    group = "group_id long, name string, kind string, category string, numbers array<int>, missing array<int>, partial_start boolean, n_files long, total_size long, status string, confidence double, label string"
    groups = spark.createDataFrame([(1, "a", "held", "Books", [], [], False, 1, 5, "HELD", 1.0, "q"), (2, "b", "misc", "Books", [], [], False, 2, 5, "OK", 1.0, "m"), (3, "c", None, "Books", [], [], False, 1, 5, "OK", 1.0, "m")], group)
    members = spark.createDataFrame([(1, 1, "Secret.zip"), (2, 2, "B1.zip"), (4, 2, None), (5, 2, "B2.zip"), (3, 3, "Unsure.zip")], "message_id long, group_id long, filename string")
    got = [(r.group_id, r.text) for r in search.fragments(groups, members, None).collect() if r.text.endswith(".zip")]
    assert sorted(got) == [(2, "b1.zip"), (2, "b2.zip")]
    files = members.drop("group_id")
    assert sorted((r.group_id, r.text) for r in search.fragments(groups, members.drop("filename"), files).collect() if r.text.endswith(".zip")) == sorted(got)
