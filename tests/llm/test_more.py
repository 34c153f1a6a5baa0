import random
import zlib

import duckdb

import corpus_pipeline
from shelfmark.llm import packing, substring_dedup, suffix_dedup, token_counts

SF = "/root/testdata/sf0.01"
MORSE = "".join("ab"[bin(k).count("1") % 2] for k in range(2048))
OTHER = MORSE.translate(str.maketrans("ab", "ba"))


def test_suffix_order_of_many_strings():
    """Runs, periods, repeats and random strings."""
    r = random.Random(4)
    for k in range(1500):
        part = [r.randrange(1, 2 + k % 4) for _ in range(r.randrange(1, 30))]
        text = [*(part * r.choice([1, 1, 2, 3])), *[1] * r.randrange(0, 9), 0]
        assert suffix_dedup.suffix_order(text) == sorted(range(len(text)), key=lambda i: text[i:])


def test_words_that_polynomial_hashes_confuse(spark):
    """Complementary Thue-Morse words stay apart: as tokens, as ids and as windows."""
    from tokenizers import Tokenizer

    texts = [(1, MORSE), (2, OTHER), (3, f"{MORSE} {OTHER} x"), (4, " ".join([OTHER] * 60)), (5, " ".join([MORSE] * 60))]
    docs = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    lib = Tokenizer.from_file(token_counts.vocabulary_path())
    assert {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs).collect()} == {i: len(lib.encode(t, add_special_tokens=False).ids) for i, t in texts}
    lib = Tokenizer.from_file(packing.vocabulary_paths()[0])
    pieces = packing.pack(docs, length=1 << 20).collect()
    for i, t in texts:
        ids = [*lib.encode(t, add_special_tokens=False).ids, 0]
        assert [p.ids_crc32 for p in pieces if p.doc_id == i] == [zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))]
    assert {r.doc_id: r.n_removed for r in substring_dedup.remove_repeated_words(docs).collect()} == dict.fromkeys(range(1, 6), 0)


def test_windows_of_a_very_long_text(spark):
    r = random.Random(6)
    words = [f"w{r.randrange(10**6)}" for _ in range(120_000)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[70_000:70_100])), (3, "z " * 30_000), (4, "z " * 60)], "doc_id long, text string")
    assert {x.doc_id: x.n_removed for x in substring_dedup.remove_repeated_words(docs).collect()} == {1: 0, 2: 100, 3: 0, 4: 60}
    assert {x.doc_id: x.n_removed for x in suffix_dedup.remove_repeated_bytes(docs).collect()} == {1: 0, 2: len(" ".join(words[70_000:70_100])), 3: 0, 4: 120}


def test_best_cuts_are_best():
    r = random.Random(8)
    for _ in range(300):
        bounds = [0]
        for _ in range(r.randrange(1, 12)):
            bounds.append(bounds[-1] + r.randrange(1, 6))
        costs = [0.0] + [r.choice([0.0, 1.0, 3.0]) for _ in bounds[1:]]
        length, best = 7, [0.0] + [9e9] * (len(bounds) - 1)
        for j in range(1, len(bounds)):
            best[j] = costs[j] + min(best[i] + length - (bounds[j] - bounds[i]) for i in range(j) if bounds[j] - bounds[i] <= length)
        cuts = packing.best_cuts(bounds, costs, length)
        cost = sum(length - (b - a) + costs[bounds.index(b)] for a, b in zip(cuts[:-1], cuts[1:], strict=True))
        assert abs(cost - best[-1]) < 1e-9 and all(b - a <= length for a, b in zip(cuts[:-1], cuts[1:], strict=True))


def test_pipeline(spark):
    """Every stage keeps the columns of documents and whole rows; the last gives the pieces of exactly what the others kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept, sizes = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, SF).checkpoint()
        assert kept.columns == docs.columns, name
        sizes.append(kept.count())
    assert docs.count() > sizes[0] > sizes[1] >= sizes[2] == sizes[3] > 0
    pieces = corpus_pipeline.run(spark, SF).toPandas()
    assert set(pieces.doc_id) == {r.doc_id for r in kept.select("doc_id").collect()}
    assert (pieces.groupby("doc_id")["length"].sum() == pieces.groupby("doc_id")["doc_tokens"].first()).all()
    assert duckdb.sql("select count(*) from (select sequence_id, sum(length) as n, max(\"offset\" + length) as m from pieces group by 1) where n > 1024 or n <> m").fetchall() == [(0,)]
