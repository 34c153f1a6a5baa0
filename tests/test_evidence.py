"""Evidence of pairs and groups, payloads read back, and the files that the index and the report become."""

import json

from pyspark.sql import functions as F

from shelfmark.operators import groups, planning, scoring

PART = "struct<number:int,family:string,container:string,is_final:boolean>"
FILES = f"message_id long, base string, file_size long, posted long, media_group string, caption string, part {PART}"


def side(message_id, base, number=None, container=None, is_final=False, size=100, posted=None, group=None, family=None, caption=None):
    return (message_id, base, size, posted, group, caption, (number, family or ("part" if number else None), container, is_final))


def said(spark, a, b, **options):
    files = spark.createDataFrame([side(1, *a[:1], **a[1]), side(2, *b[:1], **b[1])], FILES)
    return scoring.scored_pairs(spark.createDataFrame([(1, 2)], "a long, b long"), files, why=True, **options).first().evidence


def test_evidence(spark):
    rar = {"container": "rar"}
    assert said(spark, ("set", {"number": 2, "posted": 10, **rar}), ("set", {"number": 3, "posted": 40, "group": "g", **rar})) == ["part 2 and part 3 in a row", "posted within a minute", "ids close together", "sizes alike"]
    assert said(spark, ("set", {"number": 2, **rar}), ("set", {"number": 2, **rar})) == ["part 2 twice"]
    assert said(spark, ("set", {"number": 2, "size": 10}), ("set", {"container": "zip", "is_final": True})) == ["a part and a whole .zip", "ids close together"]
    assert said(spark, ("set", {"number": 2, **rar}), ("set", {"is_final": True, **rar})) == ["a part and the whole archive", "ids close together", "sizes alike"]
    assert said(spark, ("set", {"number": 1, "container": "rar"}), ("set", {"number": 2, "container": "zip", "family": "z"}))[0] == "kinds of archive that do not go together"
    assert said(spark, ("set", {"posted": 1, "group": "g", "size": None}), ("set", {"posted": 10**7, "group": "g"})) == ["posted over a week apart", "posted as one group"]
    assert said(spark, ("", {"size": None}), ("", {"size": None})) == ["ids close together"]
    alike = said(spark, ("one long name", {"number": 1, "group": "g", "posted": 9, "caption": "some words"}), ("one long nome", {"number": 2, "group": "g", "posted": 9, "caption": "some words"}), fuzzy=True, captions=True)
    assert alike[0] == "part 1 and part 2 in a row" and alike[-1] == "captions alike"


def test_weakest_links(spark):
    links = spark.createDataFrame([(1, 2, 0.8, False, True, ["a", "b", "c", "d"]), (1, 3, 0.7, False, True, ["e"]), (2, 3, 0.7, False, True, ["f"]), (1, 4, 0.1, True, True, ["g"]), (8, 9, 0.1, False, False, [])], "a long, b long, score double, dup_slot boolean, kept boolean, evidence array<string>")
    members = spark.createDataFrame([(k, 1) for k in (1, 2, 3, 4)] + [(8, 8), (9, 9)], "message_id long, group_id long")
    assert [tuple(r) for r in groups.weakest_links(members, links).collect()] == [(1, 1, 3, 0.7, ["e"])]
    assert groups.weakest_links(members, links.where("score = 0.8")).first().evidence == ["a", "b", "c"]
    assert groups.weakest_links(members, links.limit(0)).count() == 0


def test_payloads(spark):
    rows = [(1, '{"name":"x","n_files":3}'), (2, '{"name":7,"n_files":"many"}'), (3, "no json"), (4, None), (5, "[]"), (6, "")]
    got = {r.id: r for r in planning.opened(spark.createDataFrame(rows, "id long, payload string"), {"name": "string", "n_files": "long"}).drop("opened").collect()}
    assert (got[1].name, got[1].n_files) == ("x", 3) and got[1]["shape"] == "OBJECT<n_files: BIGINT, name: STRING>"
    assert (got[2].name, got[2].n_files) == ("7", None) and all(got[k].name is None and got[k].n_files is None for k in (3, 4, 5, 6))


def test_index_and_report_files(spark, tmp_path):
    records = spark.createDataFrame([(3, "b"), (2, "A"), (1, "b"), (4, None)], "group_id long, name string")
    planning.write_index(records, str(tmp_path / "index"))
    lines = [json.loads(x) for p in sorted((tmp_path / "index").glob("part-*")) for x in p.read_text().splitlines()]
    assert [x["group_id"] for x in lines] == [4, 2, 1, 3]
    planning.write_report(spark.createDataFrame([('{"a":1}',)], "report string"), str(tmp_path / "report"))
    assert "".join(p.read_text() for p in (tmp_path / "report").glob("part-*")) == '{"a":1}\n'


def test_search_by_archive_and_time(spark):
    files = spark.createDataFrame([(1, 5), (2, 9), (3, None)], "message_id long, posted long")
    members = spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "message_id long, group_id long")
    records = spark.createDataFrame([(g, f"n{g}", "l", "text") for g in (1, 2, 3)], "group_id long, name string, label string, haystack string")
    records = planning.with_updated(records, members, files)
    places = spark.createDataFrame([(1, "l", 4)], "archive_id long, label string, place long")
    listed = planning.with_destinations(records, spark.createDataFrame([(1,), (2,)], "archive_id long"), places)
    assert [r.group_id for r in planning.search(listed, archive=1, sort="updated").collect()] == [2, 1, 3]
    assert planning.search(listed, archive=2).count() == 0 and listed.where(F.col("url").isNotNull()).count() == 3
