"""Pattern automata and country evidence against plain rules."""

import random
import re

from pyspark.sql import functions as F

from shelfmark.operators.country import BOOST, detect_countries, gazetteer
from shelfmark.operators.groups import hold_reason
from shelfmark.operators.patterns import first_pattern
from shelfmark.operators.summaries import script_countries

ROWS = [
    ("aa", "Aland", "alpha al_pha ab", "aa com", "ana new_ana"), ("bb", "Bland", "beta be_ta_ga", "bb", "bobo"), ("cc", "Cland", "gamma south_gam is", "cc", "cici lo_la"),
    ("ru", "Russia", "russia", "ru", "omsk"), ("il", "Israel", "israel", "il", "haifa"),
]


def texts(seed, n=300):
    rnd = random.Random(seed)
    bits = ["alpha", "al", "pha", "ab", "is", "beta", "be", "ta", "ga", "gamma", "south", "north", "gam", "new", "ana", "bobo", "lo", "la", "x.com", "a.b.bb", "z.cc", "omsk", "база", "נתונים", "डेटा", "é", "ALPHA", "_", "-", "12"]
    return [rnd.choice([" ", "_", " / "]).join(rnd.choice(bits) for _ in range(rnd.randint(0, 7))) for _ in range(n)]


def by_hand(text_list, rows):
    """Best country of all texts of one id, straight from the rules."""
    best, scripts = {}, {}
    for text in text_list:
        s = (text or "").lower()
        words = [w for w in re.split("[^a-z0-9]+", s) if w]
        tops = {d.rsplit(".", 1)[1] for d in re.findall(r"[a-z0-9][a-z0-9-]*(?:\.[a-z0-9-]+)+", s)}

        def stands(term, words=words):
            t = term.split("_")
            at = [i for i in range(len(words)) if words[i : i + len(t)] == t]
            return any(len(t) == 1 or i == 0 or words[i - 1] not in ("south", "north", "central") for i in at) and term not in ("is",)

        for code, _, aliases, top, cities in rows:
            found = [(1, -(0.95 if "_" in a or len(a) >= 4 else 0.80)) for a in aliases.split() if stands(a)] + [(2, -0.70) for t in top.split() if t in tops] + [(3, -(0.60 if "_" in c else 0.55)) for c in cities.split() if stands(c)]
            if found:
                best[code] = min(best.get(code, (9, 0)), min(found))
        for code, pattern, sure in (("ru", "[Ѐ-ӿ]", 0.35), ("in", "[ऀ-ॿ]", 0.35), ("il", "[֐-׿]", 0.40)):
            if re.search(pattern, s):
                scripts[code] = sure
    rank = {r[0]: k for k, r in enumerate(rows)}
    both = sorted(((max(-best.get(c, (0, 0))[1], scripts.get(c, 0)), c) for c in best.keys() | scripts.keys()), key=lambda x: (-x[0], rank.get(x[1], 99), x[1]))
    if not both:
        return None
    sure, code = both[0]
    if len(both) > 1 and both[1][0] >= 0.50 and sure - both[1][0] < 0.15:
        sure = min(sure, 0.60)
    elif len(both) > 1 and code in best and code in scripts:
        sure = min(0.99, sure + BOOST)
    return code, round(sure + 1e-9, 2)


def test_countries(spark):
    rows = [(k % 200, t) for k, t in enumerate(texts(1))] + [(900, None), (901, ""), (902, "נתונים"), (902, "נתונים база"), (902, "x נתונים"), (903, "база נתונים"), (904, "alpha " * 20000 + "beta")]
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "id long, text string, code string, level int")
    terms = gazetteer(spark, ROWS)
    got = {r.id: (r.code, r.confidence) for r in detect_countries(df, terms).collect()}
    want = {i: by_hand([t for j, t in rows if j == i], ROWS) for i in {r[0] for r in rows}}
    assert got == {i: w for i, w in want.items() if w} and got[902] == ("il", 0.40) and got[903] == ("il", 0.40)
    assert got == {r.id: (r.code, r.confidence) for r in detect_countries(df, terms, most_letters=0).collect()}
    assert detect_countries(df.limit(0), terms).count() == 0


def test_scripts_of_one_text(spark):
    df = spark.createDataFrame([("база נתונים डेटा",), ("plain",), (None,)], "s string")
    got = [[tuple(x) for x in r[0]] for r in df.select(script_countries(F.col("s"))).collect()]
    assert got == [[("ru", 0.35), ("in", 0.35), ("il", 0.40)], [], []]


def test_ten_thousand_terms(spark):
    """Answers of a large rule table are those of the join, in one pass without an explode of words."""
    rows = [(f"c{k}", f"Land {k}", f"w{k}x w{k}_y{k}", f"t{k}", f"v{k}") for k in range(2500)]
    rnd = random.Random(2)
    data = [(k, " ".join(rnd.choice([f"w{rnd.randint(0, 2600)}x", f"w{k}", f"y{k}", f"v{rnd.randint(0, 2600)}", f"a.t{rnd.randint(0, 2600)}"]) for _ in range(12))) for k in range(400)]
    df, terms = spark.createDataFrame(data, "id long, text string"), gazetteer(spark, rows)
    one, two = detect_countries(df, terms), detect_countries(df, terms, most_letters=0)
    assert terms.count() == 10000 and one.exceptAll(two).count() == 0 and one.count() == two.count() > 300
    assert "Generate explode(words" not in one._jdf.queryExecution().toString()


def test_first_pattern(spark):
    rnd = random.Random(3)
    patterns = ["leak", "pass word", "dox", "ab", "b", "leak"] + [f"term{k}" for k in range(3000)] + ["two words"]
    lines = [rnd.choice(["", " ", "x", "-"]).join(rnd.choice(["leak", "leaked", "pass", " word", "dox", "ab", "b", "9", "term7", "term2999s", "two words", "é", "z"]) for _ in range(rnd.randint(0, 4))) for _ in range(400)]
    df = spark.createDataFrame([(x,) for x in lines] + [(None,)], "s string")

    def plain(s):
        return next((p for p in patterns if (p in s if " " in p else re.search("(^|[^a-z0-9])" + re.escape(p), s))), None)

    got = df.select("s", first_pattern(F.col("s"), patterns).alias("p")).collect()
    assert [r.p for r in got] == [plain(r.s or "") for r in got]
    few = patterns[:5]
    assert df.where(~hold_reason(F.col("s"), few).eqNullSafe(first_pattern(F.col("s"), few))).count() == 0
    assert df.select(first_pattern(F.col("s"), []).alias("p")).where("p is not null").count() == 0
