import hashlib
import re
import unicodedata

import pytest

from shelfmark.llm import fingerprints


def canonical(text):
    out = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return re.sub(r"\s+", " ", out).strip(" ")


TEXTS = ["Straße", "STRASSE", "ΣΑΣ", "σας", "Ａ  b\n", "a b", "ﬁne day", "FINE day", "", None, "  ", "x" * 200_000, "é€𝄞uvw", "abcdef"]


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_against_brute_force(spark, parts):
    """Canonical bytes, copies and edited texts of rows with repeated and null ids, ties and a very long text."""
    rows = [(k // 2 if k % 5 else None, t) for k, t in enumerate(TEXTS * 2)] + [(7, f"row {k}") for k in range(60)] + [(100 + k, f"other {k % 9}") for k in range(40)]
    docs = spark.createDataFrame([(i, t, "a", 1) for i, t in rows], "doc_id long, text string, fingerprint string, part int").repartition(3)
    least = {}
    for i, t in rows:
        c = canonical(t or "")
        least.setdefault(c, []).append(i)
    want = sorted(((i, min((x for x in least[canonical(t or "")] if x is not None), default=None)) for i, t in rows), key=repr)
    got = fingerprints.fingerprints(docs).collect()
    assert sorted(((r.doc_id, r.copy_of) for r in got), key=repr) == want
    assert len({r.fingerprint for r in got}) == len(least)
    likely = fingerprints.edited_likeness(docs, parts=parts).collect()
    assert len(likely) == len(rows)
    for i, t in rows:  # where ids don't repeat, the next document is known
        if i is not None and i >= 101:
            after = f"other {(i - 101) % 9}"
            cut = len(t) // 3
            edited = t[: len(t) - cut] + after[:cut]
            r = next(r for r in likely if r.doc_id == i)
            assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and r.n_chars == len(t)
            assert r.near_edited == float(canonical(edited) == canonical(t)) and r.near_next == float(canonical(after) == canonical(t))


def test_rows_stay_single(spark, tmp_path):
    rows = [(1, "one"), (2, "two"), (3, "one"), (3, "two"), (4, "three"), (5, "One"), (5, "TWO"), (6, None), (6, ""), (None, "one")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = fingerprints.digest(spark, str(tmp_path)).collect()
    assert sorted(((r.doc_id, r.copy_of) for r in got), key=repr) == sorted([(1, 1), (2, 2), (3, 1), (3, 2), (4, 4), (5, 1), (5, 2), (6, 6), (6, 6), (None, 1)], key=repr)
    assert len({r.fingerprint for r in got}) == 4
