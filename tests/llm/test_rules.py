import hashlib
import random
import re

import duckdb
import numpy as np

from pyspark.sql import functions as F

from shelfmark.llm import quality, secrets, url_filters
from shelfmark.llm import queries as llm

SF = "/root/testdata/sf0.01"


def base_spans(text):
    out = []
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def test_secrets_against_brute_force(spark):
    names = ("assign", "access", "hex")
    want = {}
    for i, text in duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall():
        spans = base_spans(text or "")
        said = ",".join(f"{names[k]}:{s}:{e}" for s, k, e in spans)
        want[i] = (*[sum(k == c for _, k, _ in spans) for c in range(3)], hashlib.sha256(said.encode()).hexdigest(), set(filter(None, said.split(","))))
    rows = llm.queries()["op10_secret_scans"](spark, SF).collect()
    assert {r.doc_id: (r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in rows} == {k: v[:4] for k, v in want.items()}
    assert all(want[r.doc_id][4] <= set(filter(None, r.spans.split(","))) for r in rows)


def test_long_and_clashing_secrets(spark):
    key = "aB3dE5gH7jK9mN1pQ3sT5vX7z0q"
    long = "ü " * 50_000 + f"x {key * 30} y password: abcdef12 z"
    schema = "doc_id long, text string, source string, found string, n_assign int, live string, list int, row int"
    docs = spark.createDataFrame([(1, long, "s", "f", 7, "l", 3, 4), (1, long, None, "f", 7, "l", 3, 4), (None, None, "s", None, None, None, None, None), (2, "", "s", "f", 1, "l", 3, 4)], schema)
    got = secrets.find_secrets(docs).collect()
    at = len("ü " * 50_000) + 2
    spans = [[(f.kind, f.start, f.stop) for f in r.found] for r in got if r.doc_id == 1]
    assert spans == [[(3, at, at + len(key) * 30), (0, at + len(key) * 30 + 3, at + len(key) * 30 + 3 + 18)]] * 2
    assert sorted(r.n_assign for r in got) == [0, 0, 1, 1] and {r.list for r in got} == {3, None}
    clean = secrets.redact(docs)
    assert clean.columns == docs.columns
    assert {(r.doc_id, "none" if r.text is None else r.text[-20:], r.n_assign) for r in clean.collect()} == {(1, " <mixed> y <assign> z"[-20:], 7), (None, "none", None), (2, "", 1)}
    none = docs.where("1 = 0")
    assert secrets.find_secrets(none).count() == secrets.redact(none).count() == 0


def test_owners_and_repositories(spark):
    at = lambda k, owner, repo: (k, f"token: shared{'AB'[k % 2]}", owner, repo)
    rows = [at(2 * k, f"o{k}", "r") for k in range(3)] + [at(2 * k + 1, f"o{k % 2}", f"r{k}") for k in range(6)] + [(90 + k, "token: private1", "o1", f"r{k}") for k in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, owner string, repo string")
    kept = {r.text for r in secrets.redact(docs, repo_col="repo", owner_col="owner").collect()}
    assert kept == {"token: sharedA", "token: sharedB", "<assign>"}


def test_quality_of_held_out_labels(spark):
    rows = llm.queries()["op6_quality_classifier"](spark, SF).collect()
    label = dict(duckdb.sql(f"select doc_id, quality from '{SF}/labels.parquet'").fetchall())
    held = [(r.score, label[r.doc_id], r.predicted) for r in rows if r.held_out and label.get(r.doc_id) in (0, 1)]
    good, bad = (np.array([s for s, y, _ in held if y == k]) for k in (1, 0))
    auc = ((good[:, None] > bad[None, :]) + 0.5 * (good[:, None] == bad[None, :])).mean()
    assert auc > 0.85 and np.mean([y == p for _, y, p in held]) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)


def test_quality_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, "good words here", 3.0, "r"), (2, None, 1.0, "r"), (2, "", 2.0, "r"), (None, "bad", None, None), (5, "long word " * 100_000, 1.0, "r")], "doc_id long, text string, score double, row string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (2, 1), (5, 7), (None, 1)], "doc_id long, quality int")
    weights = quality.train(docs, labels)
    got = quality.score(docs, weights)
    assert got.columns == ["doc_id", "text", "row", "score"] and got.count() == 5
    empty = quality.train(docs, labels.where("1 = 0"))
    assert {r.score for r in quality.score(docs, empty).collect()} == {0.5}
    assert quality.score(docs.where("1 = 0"), weights).count() == 0


def test_url_lists_against_brute_force(spark):
    r = random.Random(5)
    entries = [(f"l{r.randrange(2)}", f"h{r.randrange(6)}", r.randrange(200), r.choice(["add", "remove"])) for _ in range(300)] + [("l0", "late", 10, "add")]
    captures = [(k if k % 7 else None, r.choice([*(f"h{j}" for j in range(7)), "late", None]), r.choice([None, *range(0, 900, 7)])) for k in range(400)] + [(1, "late", 20), (1, "late", 500), (1, "late", 5)] * 2
    held = {}
    for name, host, day, action in entries:
        held.setdefault((name, host), {}).setdefault(day, set()).add(action)

    def active(host, day):
        out = set()
        for (name, h), days in held.items():
            before = [d for d in days if day is not None and d <= day]
            if h == host and before and "remove" not in days[max(before)]:
                out.add((name, max(before)))
        return out

    table = spark.createDataFrame(captures, "page_id long, host string, day int")
    intervals = url_filters.validity(spark.createDataFrame(entries, "list string, host string, day int, action string"))
    got = url_filters.active_at_fetch(table, intervals).collect()
    key = lambda rows: sorted(rows, key=repr)
    assert key((r.page_id, r.host, r.day, sorted((e["list"], e.from_day) for e in r.active)) for r in got) == key((p, h, d, sorted(active(h, d))) for p, h, d in captures)
    assert url_filters.active_at_fetch(table.where("1 = 0"), intervals).count() == 0
    assert {len(r.active) for r in url_filters.active_at_fetch(table, intervals.where("1 = 0")).collect()} == {0}


def test_url_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{SF}/pages.parquet'")
    want = con.sql(llm.oracle_sql()["op7_url_filters"])
    got = llm.queries()["op7_url_filters"](spark, SF).select(*want.columns)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want.fetchall(), key=repr)


def test_parent_domains_paths_and_snapshots(spark):
    lines = ["0.0.0.0 Ads.Example.com", "https://www.shop.test/Bad//Path/ # paths keep their case", "# nothing", "", None, "evil.test", "10.1.2.3", "2.3"]
    rules = [r.rule for r in spark.createDataFrame([(x,) for x in lines], "line string").select(url_filters.rule_of_line(F.col("line")).alias("rule")).collect()]
    assert rules == ["ads.example.com", "shop.test/Bad/Path", None, None, None, "evil.test", "10.1.2.3", "2.3"]
    shot = [("l", h, d) for d, hosts in ((0, ["evil.test"]), (10, ["evil.test", "shop.test/Bad/Path"]), (30, ["evil.test", "evil.test", "2.3"]), (40, ["shop.test/Bad/Path"])) for h in hosts] + [("l", None, 0), (None, "x", 0)]
    valid = url_filters.snapshot_validity(spark.createDataFrame(shot, "list string, host string, day int"), spark.createDataFrame([("l", d) for d in (0, 10, 20, 30, 40)], "list string, day int"))
    want = {("evil.test", 0, 20), ("evil.test", 30, 40), ("shop.test/Bad/Path", 10, 20), ("shop.test/Bad/Path", 40, None), ("2.3", 30, 40)}
    assert {(r.host, r.from_day, r.to_day) for r in valid.collect()} == want
    urls = ["http://a.b.evil.test/x", "http://notevil.test/", "https://shop.test/Bad/Path/more?q", "https://shop.test/bad/path", "https://shop.test/Bad", "http://1.2.3/", "http://10.1.2.3/", None, "no url", "http://u@www.EVIL.test:80"]
    captures = [(k, u, d, "s") for k, u in enumerate(urls) for d in (5, 15, 25, 35, 45, None)]
    table = spark.createDataFrame(captures, "id long, url string, day int, slice string")
    got = {(r.id, r.day): [e.rule for e in r.active] for r in url_filters.listed_at_fetch(table, valid).collect()}

    def brute(url, day):
        if url is None or "://" not in url or day is None:
            return []
        at, _, path = url.split("://")[1].partition("/")
        host = at.split("@")[-1].split(":")[0].lower().removeprefix("www.")
        path = "/".join(x for x in path.split("?")[0].split("/") if x)
        address = host.replace(".", "").isdigit()
        fits = lambda r: f"{host}/{path}/".startswith(r + "/") if "/" in r else host == r or (not address and host.endswith("." + r))
        return sorted(r for r, a, b in want if fits(r) and a <= day and (b is None or day < b))

    assert got == {(k, d): brute(u, d) for k, u, d, _ in captures} and any(got.values())
    same = url_filters.listed_at_fetch(table.unionByName(table).withColumn("active", F.lit(1)), valid)
    assert same.columns == ["id", "url", "day", "slice", "active"] and same.count() == 2 * len(captures)
    assert url_filters.listed_at_fetch(table.limit(0), valid).count() == 0
    assert {len(r.active) for r in url_filters.listed_at_fetch(table, valid.limit(0)).collect()} == {0}
