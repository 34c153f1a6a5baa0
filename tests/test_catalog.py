import duckdb
import pytest

from pyspark.sql import functions as F

from shelfmark.functions import similarity
from shelfmark.functions.parts import with_part
from shelfmark.functions.text import fold, long_size
from shelfmark.operators import blocking, groups, planning, scoring
from shelfmark.operators.components import connected_components
from shelfmark.operators.country import detect_countries, gazetteer
from shelfmark.queries import oracle_sql, queries, resolution
from shelfmark.sources.catalog import CATALOG, with_names
from shelfmark.sources.synthetic import synthetic_catalog
from shelfmark.streaming import jobs

SF = "/root/testdata/sf0.001"
NAMES = [
    ("Alpha.part01.rar", "Alpha", "part", 1, "rar", False), ("Movie.part-01.rar", "Movie", "part", 1, "rar", False), ("Alpha.zip.007", "Alpha", "nn", 7, "zip", False),
    ("Alpha_2024.z01", "Alpha_2024", "z", 1, None, False), ("Alpha.zip", "Alpha", None, None, "zip", True), ("Alpha.07", "Alpha", "nn2", 7, None, False), ("Alpha.r00", "Alpha", "r", 0, None, False),
    ("Al-Pha-Part-01-SQL.zip", "Al-Pha SQL", "part", 1, "zip", False), ("report 2024.01.02.zip", "report 2024.01.02", None, None, "zip", True), ("file.1985.zip", "file.1985", None, None, "zip", True), ("", "", None, None, None, False), (None, "", None, None, None, False),
]


def test_names(spark):
    rows = with_part(spark.createDataFrame([(n,) for n, *_ in NAMES], "filename string")).collect()
    assert [(r.filename, r.part.base, r.part.family, r.part.number, r.part.container, r.part.is_final) for r in rows] == NAMES


@pytest.mark.parametrize("name", sorted(k for k in oracle_sql()))
def test_oracle(spark, name):
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for t in ("region", "nation", "customer", "part", "orders", "lineitem", "events", "documents", "pages", "conversations"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(oracle_sql()[name])
    columns = sorted(want.columns)
    got = queries()[name](spark, SF)
    assert sorted(got.columns) == columns
    plain = lambda v: round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    key = lambda rows: sorted([tuple(map(plain, r)) for r in rows], key=repr)
    assert key(got.select(*columns).collect()) == key(want.select(*columns).fetchall())


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 6), (6, 9), (7, 8), (3, 10), (4, 4), (None, 3)], "src long, dst long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 10: 1, 5: 5, 6: 5, 9: 5, 7: 7, 8: 7, 4: 4}


def test_big_bases_stay_connected(spark):
    files = spark.range(500).selectExpr("id as message_id", "'x' as base", "cast(id % 7 as int) as number")
    pairs = blocking.exact_base_pairs(files)
    assert pairs.count() < 600
    assert {r.component for r in connected_components(pairs, "a", "b").collect()} == {0}


def test_held_groups_stay_held(spark):
    g = spark.createDataFrame([(1, "a", 3, 10, "OK", True, False, True, None, None), (2, "b", 2, 10, "OK", False, False, False, None, None)], "group_id long, name string, n_files int, total_size long, status string, held boolean, ignored boolean, tagged boolean, country string, domain string")
    assert {r.group_id: r.label for r in groups.assign_labels(g).collect()} == {1: "Quarantine", 2: "b"}


def test_ratios():
    assert similarity.indel("abc", "abc") == 100 and similarity.indel("abcd", "abxd") == 75
    assert similarity.token_set("a b c", "b c") == 100 and similarity.partial("eda", "yandex eda sql") == 100


def test_synthetic_catalog(spark):
    rows = with_part(synthetic_catalog(spark, 400)).collect()
    # " vol1.iso" is no dotted part token, so these files count as whole
    assert len({r.message_id for r in rows}) == len(rows) and {r.part.family for r in rows} == {"part", "nn", "z", "r", None}
    assert all(r.part.is_final for r in rows if r.part.family is None)
    again = len(rows) - len({r.file_id for r in rows})
    copies = [r for r in rows if " Copy" in r.filename]
    assert again > 0 and copies and all(r.part.number is not None or r.part.is_final for r in copies)
    assert {(r.message_id, r.filename) for r in rows} == {(r.message_id, r.filename) for r in synthetic_catalog(spark, 400).repartition(3).collect()}
    assert synthetic_catalog(spark, 0).count() == 0


def test_captions(spark):
    pairs = spark.createDataFrame([("maps of the north", "north maps"), ("maps", "ledger"), (None, "maps")], "a string, b string")
    assert [round(r[0], 6) for r in pairs.select(scoring.caption_score(F.col("a"), F.col("b"))).collect()] == [0.05, 0.0, 0.0]
    part = "struct<number:int,family:string,container:string,is_final:boolean>"
    files = spark.createDataFrame([(k, "atlas", 10, 100, None, c, (k, "part", "rar", False)) for k, c in ((1, "north maps"), (2, "north maps"), (3, None))], f"message_id long, base string, file_size long, posted long, media_group string, caption string, part {part}")
    two = spark.createDataFrame([(1, 2), (2, 3)], "a long, b long")
    plain, more = ({(r.a, r.b): r.score for r in scoring.scored_pairs(two, files, captions=c).collect()} for c in (False, True))
    assert more[1, 2] == pytest.approx(min(0.99, plain[1, 2] + 0.05)) and more[2, 3] == plain[2, 3]


def test_streams(spark, tmp_path):
    place = lambda name: str(tmp_path / name)
    events = spark.createDataFrame([(1, 1, "error"), (2, 1, "purchase"), (3, 2, "error"), (4, 3, "click")], "event_id long, user_id long, event_type string")
    events.write.parquet(place("events"))
    stream = lambda name, schema: spark.readStream.schema(schema).parquet(place(name))
    jobs.progress_stream(stream("events", events.schema), place("progress"), place("c1"))
    spark.createDataFrame([(5, 2, "purchase")], events.schema).write.mode("append").parquet(place("events"))
    jobs.progress_stream(stream("events", events.schema), place("progress"), place("c1"))
    r = spark.read.json(place("progress")).first()
    assert (r.total, r.success, r.failed, r.given_up, r.running, r.percent) == (3, 2, 0, 0, 1, 66)
    g = spark.createDataFrame([(1, "REVIEW"), (2, "HELD")], "group_id long, status string")
    g.write.parquet(place("groups"))
    spark.createDataFrame([(1, "OK"), (2, "OK"), (3, "OK")], g.schema).write.parquet(place("decisions"))
    run = lambda: jobs.decided_stream(stream("groups", g.schema), place("decisions"), place("decided"), place("c2"))
    run()
    spark.createDataFrame([(4, "IGNORED")], g.schema).write.mode("append").parquet(place("decisions"))
    spark.createDataFrame([(4, "REVIEW")], g.schema).write.mode("append").parquet(place("groups"))
    run()
    assert {(r.group_id, r.status) for r in spark.read.parquet(place("decided")).collect()} == {(1, "OK"), (2, "HELD"), (4, "IGNORED")}


def test_shared_openings_are_no_duplicates(spark, tmp_path):
    opening = "the same first words of every letter that this office sends out, "
    rows = [(1, opening + "one", "en", "s", 68), (2, opening + "two", "en", "s", 68), (3, opening + "ONE", "en", "s", 68), (4, opening + "two", "en", "s", 68)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.message_id, r.canonical, r.kind) for r in queries()["doc_duplicates"](spark, str(tmp_path)).collect()}
    assert got == {(3, 1, "name_slot"), (4, 2, "file_id")}
    assert [r.n_files for r in queries()["kept_docs"](spark, str(tmp_path)).collect()] == [2]


def test_groups_link_names_that_differ(spark):
    names = ["Harbour Survey North.part01.rar", "Harbour Surveys North.part02.rar", "Quince ledger.zip", "Harbour Survey of North.part03.rar"]
    raw = spark.createDataFrame([(k + 1, n, 1000 + k, 100, None) for k, n in enumerate(names)], "message_id long, filename string, file_size long, posted long, media_group string")
    members = resolution.resolve(with_names(with_part(raw)))[2]
    assert {(r.message_id, r.group_id) for r in members.collect()} == {(1, 1), (2, 1), (3, 3), (4, 1)}


def test_windows_have_all_neighbours(spark):
    files = spark.range(300).selectExpr("id * id as message_id")
    near = blocking.neighbour_pairs(blocking.in_windows(files, "message_id", rows=20), "scope", "message_id").select("a", "b").distinct()
    ids = [k * k for k in range(300)]
    assert {tuple(r) for r in near.collect()} == {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 : i + 16]}


def test_phrases_of_three_words(spark):
    terms = gazetteer(spark, [("tz", "Tanzania", "tanzania", "tz", "dar_es_salaam"), ("fr", "France", "france", "fr", "paris")])
    texts = spark.createDataFrame([(1, "port of Dar es Salaam"), (2, "dar salaam"), (3, "es")], "id long, text string")
    assert [(r.id, r.code, r.confidence) for r in detect_countries(texts, terms).collect()] == [(1, "tz", 0.60)]


def grouped(spark, rows):
    """{message ids of each group: (status, parts, missing, partial start, reasons)} of (name, size, time) rows."""
    raw = spark.createDataFrame([(k + 1, n, size, at, None) for k, (n, size, at) in enumerate(rows)], "message_id long, filename string, file_size long, posted long, media_group string")
    _, _, members, g = resolution.resolve(with_names(with_part(raw)))
    ids = {}
    for r in members.collect():
        ids.setdefault(r.group_id, []).append(r.message_id)
    return {tuple(sorted(ids[r.group_id])): r for r in g.collect()}


GB, NOW = 1_000_000_000, 1_700_000_000
SETS = [
    ([f"Alpha.part{k}.rar" for k in range(1, 5)], "OK", [1, 2, 3, 4], [], False),
    ([f"Alpha.z{k:02}" for k in range(1, 12)], "OK", list(range(1, 12)), [], False),
    ([f"Alpha.z{k:02}" for k in range(1, 4)] + ["Alpha.zip"], "OK", [1, 2, 3], [], False),
    (["Alpha.001", "Alpha.002", "Alpha.004", "Alpha.005"], "OK", [1, 2, 4, 5], [3], False),
    ([f"Alpha.zip.{k:03}" for k in range(4, 8)], "OK", [4, 5, 6, 7], [], True),
    (["Alpha.zip.001", "Alpha.zip.002", "Alpha.zip.002"], "OK", [1, 2], [], False),
    (["part1.rar", "part2.rar"], "REVIEW", [1, 2], [], False),
    (["YAeda.zip.004", "YAeda.zip.005", "YAeda.zip.006", "YAeda.zip.007", "Yandex-EDA-Part-01-SQL.zip"], "REVIEW", [1, 4, 5, 6, 7], [2, 3], False),
]


@pytest.mark.parametrize("names,status,parts,missing,partial", SETS)
def test_grouping(spark, names, status, parts, missing, partial):
    got = grouped(spark, [(n, GB, NOW) for n in names])
    assert list(got) == [tuple(range(1, len(names) + 1))]
    (r,) = got.values()
    assert (r.status, r.numbers, r.missing, r.partial_start) == (status, parts, missing, partial)
    assert "weakest link" in r.reasons


def test_what_stays_apart(spark):
    assert len(grouped(spark, [("harbour.zip", GB, NOW), ("quince ledger.csv", 5, NOW + 3600)])) == 2
    assert len(grouped(spark, [("data.zip", GB, NOW), ("data.zip", GB // 7, NOW + 10**8)])) == 2


def test_any_member_holds_a_group(spark):
    files = spark.createDataFrame([(1, "Alpha.part1.rar", None), (2, "Alpha.part2.rar", "from a LEAK"), (3, "Beta.part1.rar", None), (4, "Beta password.part2.rar", None), (5, "Gamma.rar", None)], "message_id long, filename string, caption string")
    members = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 3), (5, 5)], "message_id long, group_id long")
    g = spark.createDataFrame([(1, "alpha", 2), (3, "beta", 2), (5, "gamma", 1)], "group_id long, norm string, n_files long")
    got = {r.group_id: (r.held, r.hold_reason) for r in groups.enrich(g, files, members).collect()}
    assert got == {1: (True, "Alpha.part2.rar: leak"), 3: (True, "Beta password.part2.rar: password"), 5: (False, None)}


def test_marks_and_review_states(spark):
    dups = spark.createDataFrame([(2, 1, "file_id", 1.0)], "message_id long, canonical long, kind string, confidence double")
    marks = spark.createDataFrame([(2, 9), (5, 4), (5, 3)], "message_id long, canonical long")
    assert sorted(tuple(r) for r in planning.with_marks(dups, marks).collect()) == [(2, 1, "file_id", 1.0), (5, 3, "marked", 0.9)]
    items = spark.createDataFrame([(k, "grouping" if k % 2 else "country") for k in range(1, 7)], "item_id long, kind string")
    states = spark.createDataFrame([(1, 1, "DONE"), (2, 1, "PENDING"), (3, 3, "DONE")], "decision_id long, item_id long, status string")
    assert [r.item_id for r in planning.review_list(items, states, kind="grouping").collect()] == [1, 5]
    assert [r.item_id for r in planning.review_list(items, states, status="DONE").collect()] == [3]


def test_tables_are_written_anew(spark, tmp_path):
    g, m = spark.range(3).withColumnRenamed("id", "group_id"), spark.range(5).withColumnRenamed("id", "message_id")
    for _ in range(2):
        planning.write_resolution(g, m, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/groups")).count() == 3 and spark.read.parquet(str(tmp_path / "out/members")).count() == 5


def test_scan_keeps_the_latest_row_of_a_key(spark, tmp_path):
    place = lambda n: str(tmp_path / n)
    put = lambda rows: spark.createDataFrame(rows, CATALOG).write.mode("append").parquet(place("in"))
    run = lambda: jobs.scan_stream(spark, place("in"), CATALOG, place("check"), place("log"))
    put([(1, 1, "f", "a.zip", 5, 10, "m", None, None), (1, 2, "f", "", 0, 10, "m", "", "")])
    run()
    put([(1, 1, "f", "b.zip", 6, 11, "m", None, None), (2, 1, "g", "c.zip", 7, 12, "m", None, None)])
    run()
    run()
    got = sorted((r.source_id, r.message_id, r.filename, r.file_size) for r in jobs.read_catalog(spark, place("log")).collect())
    assert got == [(1, 1, "b.zip", 6), (1, 2, "(no name) 2", None), (2, 1, "c.zip", 7)]


def test_waits_of_a_log(spark):
    lines = ["2024-05-01T10:00:00.120 warn net: nothing", "2024-05-01T09:30:00.001 warn job wait who=a1 seconds=30 what=copy", "2024-05-01T09:59:50.001 warn job wait who=a2 seconds=60 what=send", "2024-05-01T08:00:00.001 warn job wait who=a1 seconds=99 what=copy"]
    events = jobs.wait_events(spark.createDataFrame([(x,) for x in lines], "value string"))
    state, recent = jobs.wait_state(events, "2024-05-01 10:00:00")
    r = state.first()
    assert r.waited == 90 and (r.active.user, r.active.left) == ("a2", 50) and [x.user for x in recent.collect()] == ["a2", "a1", "a1"]


def test_evidence_of_countries(spark):
    rows = [("us", "United States", "united_states america", "us", ""), ("ru", "Russia", "russia", "ru", "moscow"), ("fr", "France", "france", "fr", "paris"), ("in", "India", "india", "in", "")]
    texts = [(1, "south america"), (2, "north america, america"), (3, "moscow и paris"), (4, "russia и x.in"), (5, "is at do"), (6, "и")]
    got = {r.id: (r.code, r.confidence) for r in detect_countries(spark.createDataFrame(texts, "id long, text string"), gazetteer(spark, rows)).collect()}
    assert got == {1: ("us", 0.95), 2: ("us", 0.95), 3: ("ru", 0.55), 4: ("ru", 0.99), 6: ("ru", 0.35)}


def test_folding_and_sizes(spark):
    row = spark.createDataFrame([("Straße ΣΑΣ", 2 * 1024**5)], "t string, n long").select(fold(F.col("t")), long_size(F.col("n")), long_size(F.lit(1023 * 1024**2))).first()
    assert tuple(row) == ("strasse σασ", "2.0 PB", "1,023.0 MB")
