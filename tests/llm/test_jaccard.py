import random

import pytest

from shelfmark.llm import jaccard_join


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """Least id over links, by comparing every two documents."""
    sets = {k: shingles(t) for k, t in rows}
    parent = {k: k for k in sets}

    def top(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                parent[max(x, y)] = min(x, y)
    return {(k, len(sets[k]), top(k)) for k in sets}


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    """Groups whose members have any likeness to each other: words changed, dropped, added, ends cut, chains of small edits."""
    r = random.Random(seed)
    rows = []
    for _ in range(5):
        base = [f"w{r.randrange(400)}" for _ in range(r.choice([12, 40, 90]))]
        for _ in range(70):
            text = list(base)
            for _ in range(r.randrange(4)):
                at = r.randrange(len(text))
                kind = r.randrange(4)
                if kind == 0:
                    text[at] = f"W{r.randrange(400)}"
                elif kind == 1:
                    del text[at]
                elif kind == 2:
                    text.insert(at, f"y{r.randrange(10**6)}")
                else:
                    text = text[: max(5, len(text) - r.randrange(12))]
            rows.append((len(rows) * 3 + 1, " ".join(text)))
            if r.random() < 0.1:
                base = text
    r.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(x.doc_id, x.n_shingles, x.component_id) for x in jaccard_join.near_duplicates(docs).collect()}
    assert got == brute(rows)


def test_groups_of_one_prefix(spark):
    """Sets that differ in common shingles alone share prefix and size; some of a group link, some don't."""
    r = random.Random(7)
    common = [[f"c{k}x{j}" for j in range(5)] for k in range(60)]
    rare = [f"r{j}" for j in range(30)]
    rows = []
    for k in range(120):
        some = r.sample(range(60), 6 if k % 3 else 14)
        rows.append((k, " ".join(rare[: 24 + k % 2] + [w for j in sorted(some) for w in common[j]])))
    rows += [(1000 + k, " ".join(w for j in r.sample(range(60), 10) for w in common[j])) for k in range(200)]
    got = {(x.doc_id, x.n_shingles, x.component_id) for x in jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_large_group_and_long_texts(spark):
    """Many near copies with edits of their own, in chains, with repeated, null and empty rows, and a text of a million words."""
    r = random.Random(11)
    base = [f"w{r.randrange(5000)}" for _ in range(80)]
    rows = []
    for k in range(600):
        text = list(base)
        for _ in range(r.randrange(1, 5)):
            text[r.randrange(80)] = f"e{r.randrange(10**9)}"
        rows.append((k + 10, " ".join(text)))
    long = " ".join(f"t{k % 977}x{k}" for k in range(200_000))
    rows += [(5, long), (6, long + " end"), (7, "a b"), (8, "A  B"), (9, ""), (9000, "complementary " + "ab" * 2000)]
    docs = spark.createDataFrame([*rows, (7, "a b"), (None, None)], "doc_id long, text string")
    got = {(x.doc_id, x.n_shingles, x.component_id) for x in jaccard_join.near_duplicates(docs).collect()}
    assert got == brute(rows) | {(None, 0, None)}


def test_lists_in_cells(spark, monkeypatch):
    """Lists of a hundred and more cells give what whole lists give: no member and no leader is lost between two cells."""
    r = random.Random(5)
    shared = [f"s{j}" for j in range(12)]
    rows = []
    for k in range(300):
        text = shared + [f"u{r.randrange(9)}x{j}" for j in range(3 + k % 4)]
        if k % 5 == 0:
            text[r.randrange(12)] = f"e{k}"
        rows.append((k, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(jaccard_join, "CELL_BITS", 1)
    seen = []
    keep = jaccard_join._undecided
    monkeypatch.setattr(jaccard_join, "_undecided", lambda lists: seen.append(lists) or keep(lists))
    got = {(x.doc_id, x.n_shingles, x.component_id) for x in jaccard_join.near_duplicates(docs).collect()}
    assert got == brute(rows)
    cells = seen[0].groupBy("token", "cells").count().where("cells >= 16").collect()
    assert cells and all(x["count"] <= 2 * x.cells for x in cells)
    assert max(x["count"] for x in seen[0].groupBy("token", "cell").count().collect()) < 20


def test_words_that_polynomial_hashes_confuse(spark):
    morse = "".join("ab"[bin(k).count("1") % 2] for k in range(2048))
    other = morse.translate(str.maketrans("ab", "ba"))
    rest = " one two three four"
    docs = spark.createDataFrame([(1, morse + rest), (2, other + rest)], "doc_id long, text string")
    assert {r.component_id for r in jaccard_join.near_duplicates(docs).collect()} == {1, 2}
