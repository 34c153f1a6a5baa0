"""The quality classifier against a plain one, and the pipeline's stages on odd rows."""

import math
import re
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from shelfmark.llm import quality

SF = "/root/testdata/sf0.001"
MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15 | 1


def mix(x):
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & MASK
    return x ^ (x >> 31)


def word_hash(w):
    blocks = [w[k : k + 8] for k in range(0, len(w), 8)]
    return mix((sum(mix((int.from_bytes(b, "little") + (k + 1) * BASE) & MASK) for k, b in enumerate(blocks)) + len(w)) & MASK)


def plain_grams(text):
    words = []
    for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\x09-\x0D\x20]+", text.encode()):
        words.append(0x7654321 if re.fullmatch(rb"[0-9]+", w) else 0x1234567 if re.fullmatch(rb"[A-Z]{3,}", w) else word_hash(w.lower()))
    pairs = [mix((w * 3 + v * 7) & MASK) for w, v in zip(words, words[1:], strict=False)] + [1] * bool(words)
    return [g >> (64 - quality.BITS) for w, p in zip(words, pairs, strict=True) for g in (mix(w), p)]


def plain_weights(examples):
    z, n = {}, {}

    def weight(k):
        s = z.get(k, 0.0)
        return 0.0 if abs(s) <= quality.L1 else -(s - math.copysign(quality.L1, s)) / ((quality.BETA + math.sqrt(n.get(k, 0.0))) / quality.ALPHA + quality.L2)

    for _ in range(quality.EPOCHS):
        for x, label in examples:
            w = {k: weight(k) for k in x}
            error = 1 / (1 + math.exp(-max(-35, min(35, sum(w[k] * v for k, v in x.items()))))) - label
            for k, v in x.items():
                g, old = error * v, n.get(k, 0.0)
                z[k] = z.get(k, 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / quality.ALPHA * w[k]
                n[k] = old + g * g
    return {k: weight(k) for k in z}


def features(text):
    grams = plain_grams(text)
    x = {}
    for g in grams:
        x[g] = x.get(g, 0.0) + quality.SCALE / len(grams)
    return x | {quality.BIAS: 1.0}


def test_query_by_hand(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    labels = spark.read.parquet(f"{SF}/labels.parquet").withColumn("place", F.xxhash64("doc_id")).orderBy("place").collect()
    text, shards = {r.doc_id: r.text or "" for r in docs}, {}
    for r in labels:
        if zlib.crc32(str(r.doc_id).encode()) % 3 != 1:
            shards.setdefault(r.place % quality.SHARDS, []).append((features(text[r.doc_id]), r.quality))
    total = {}
    for examples in shards.values():
        for k, w in plain_weights(examples).items():
            total[k] = total.get(k, 0.0) + w / len(shards)
    rows = {r.doc_id: r for r in quality.digest(spark, SF).collect()}
    assert len(rows) == len(docs)
    for i, t in text.items():
        score = 1 / (1 + math.exp(-sum(total.get(k, 0.0) * v for k, v in features(t).items())))
        r = rows[i]
        assert abs(r.score - score) < 1e-9 and r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and r.predicted == (r.score >= 0.5)


@pytest.fixture(scope="module")
def odd(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    extra = [F.lit("r").alias("__repository"), F.lit(1).alias("id"), F.lit("x").alias("row"), F.lit(0.25).alias("score"), F.lit(7).alias("component_id")]
    rows = docs.select("*", *extra)
    nothing = spark.createDataFrame([(None, None, None, None, None), (None, "", None, "s", 0), (9001, None, "en", None, None), (9002, " \n", "en", "s", 2), (9003, "ü" * 30000, "de", "s", 30000)], docs.schema).select("*", *extra)
    return rows.unionByName(rows.limit(5)).unionByName(nothing)


@pytest.mark.parametrize("k", range(4))
def test_stages_on_odd_rows(spark, odd, k):
    """Columns with names of the stage's own come back as they were, rows without an id or text do no harm, an empty table stays one."""
    name, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, odd, SF).collect()
    assert out and all((r["__repository"], r["id"], r["row"], r["score"], r["component_id"]) == ("r", 1, "x", 0.25, 7) for r in out), name
    assert stage(spark, odd.limit(0), SF).count() == 0 and stage(spark, odd, SF).columns == odd.columns
    if k == 3:
        assert len(out) == odd.count()


def test_packing_of_odd_rows(spark, odd):
    stage = corpus_pipeline.STAGES[4][1]
    pieces = stage(spark, odd, SF).collect()
    assert sum(p["length"] for p in pieces if p["doc_id"] == 9001) == 1 and stage(spark, odd.limit(0), SF).count() == 0
