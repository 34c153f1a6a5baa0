"""Quality classifier (operator 6): hashed word n-grams, logistic regression by follow-the-regularised-leader updates."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import arrays as A
from .exchange import give_back
from .token_counts import steps

BITS = 18
#: Labelled rows that the model is fitted on at most (those with the smallest hash of their id), and parts fitted side by side.
TRAIN_ROWS, SHARDS = 20_000, 8
EPOCHS, ALPHA, BETA, L1, L2, SCALE = 6, 0.5, 1.0, 0.002, 0.002, 20.0

_KIND = np.full(256, 2, np.uint8)  # marks
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
CAPITALS, DIGITS = A.U64(0x1234567), A.U64(0x7654321)


def ngrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the word unigrams and bigrams of each text, and the bounds of each text's. A word is a run of letters and digits
    or of marks, in lower case; words all in capitals and all of digits count as one word each."""
    raw = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))])
    if not len(raw):
        return np.empty(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    kind = _KIND[raw]
    edge = np.ones(len(raw) + 1, dtype=bool)
    edge[1:-1] = kind[1:] != kind[:-1]
    edge[offsets] = True
    at = np.flatnonzero(edge)
    begin, end = at[:-1], at[1:]
    on = kind[begin] > 0
    begin, end = begin[on], end[on]
    words = A.word_hashes(A.lower_ascii(raw), begin, end)
    count = lambda mask: (c := np.concatenate([[0], np.cumsum(mask)]))[end] - c[begin]
    size = end - begin
    words[(size > 2) & (count((raw >= 65) & (raw <= 90)) == size)] = CAPITALS
    words[count((raw >= 48) & (raw <= 57)) == size] = DIGITS
    first = np.searchsorted(begin, offsets)
    pairs = A.mix(words * A.U64(3) + np.append(words[1:], A.U64(0)) * A.U64(7))
    pairs[first[1:][first[1:] > first[:-1]] - 1] = A.U64(1)  # what ends a text has no successor
    both = np.empty(2 * len(words), A.U64)
    both[0::2], both[1::2] = A.mix(words), pairs
    return (both >> A.U64(64 - BITS)).astype(np.int64), 2 * first


@dataclass
class Ftrl:
    """Follow-the-regularised-leader, proximal (McMahan et al., KDD 2013), on sparse rows."""

    size: int

    def __post_init__(self) -> None:
        self.z, self.n = np.zeros(self.size), np.zeros(self.size)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2))

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


BIAS = 1 << BITS


def row_of(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, n = np.unique(grams, return_counts=True)
    return np.append(at, BIAS), np.append(n * (SCALE / max(1, len(grams))), 1.0)


def fit_shard(rows: pd.DataFrame) -> pd.DataFrame:
    """Weights that differ from 0 of a model fitted on one shard."""
    rows = rows.sort_values("place")
    model, examples = Ftrl(BIAS + 1), []
    texts = [t.encode() for t in rows["text"]]
    for a, b in steps(texts):
        grams, bounds = ngrams(texts[a:b])
        examples += [(*row_of(grams[i:j]), int(y)) for i, j, y in zip(bounds[:-1], bounds[1:], rows["label"].iloc[a:b], strict=True)]
    for _ in range(EPOCHS):
        for at, x, label in examples:
            model.learn(at, x, label)
    every = np.arange(BIAS + 1)
    w = model.weights(every)
    return pd.DataFrame({"at": every[w != 0], "w": w[w != 0]})


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> np.ndarray:
    """Weights by averaging models of SHARDS shards. Fits on TRAIN_ROWS labelled rows at most, never on rows whose crc32(id) mod 3 is
    1. The sample's ids and labels are bounded, so they are broadcast; no text is shuffled but those of the sample.

    Labels other than 0 and 1, null ids, and labels without a document teach nothing. Repeated labels of one id teach once each, conflicting
    ones both ways. Without any usable label all weights are 0, so every score is 0.5."""
    usable = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label in (0, 1)")
    usable = usable.where(F.crc32(F.col("id").cast("string")) % 3 != 1).withColumn("place", F.xxhash64("id"))
    sample = usable.orderBy("place", "id", "label").limit(TRAIN_ROWS)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    shards = texts.join(F.broadcast(sample), "id").withColumn("shard", F.pmod("place", F.lit(SHARDS)))
    fitted = shards.groupBy("shard").applyInPandas(fit_shard, "at long, w double")
    n = max(1, min(SHARDS, sample.select(F.pmod("place", F.lit(SHARDS)).alias("s")).distinct().count()))
    weights = np.zeros(BIAS + 1)
    for r in fitted.groupBy("at").agg(F.sum("w").alias("w")).toPandas().itertuples():
        weights[r.at] = r.w / n
    return weights


def _scored(docs: DataFrame, weights: np.ndarray, text_col: str) -> DataFrame:
    """row (struct of all columns of docs) and score."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    place = docs.columns.index(text_col)  # the text travels once, inside its row
    model = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column(0).field(place).cast(pa.binary()).to_pylist()]
            out = [np.empty(0)]
            for a, b in steps(texts):
                grams, bounds = ngrams(texts[a:b])
                total = np.add.reduceat(np.append(model.value[grams], 0.0), bounds[:-1]) if len(grams) else np.zeros(b - a)
                n = np.diff(bounds)
                x = np.where(n > 0, total * SCALE / np.maximum(n, 1), 0.0) + model.value[BIAS]
                out.append(1 / (1 + np.exp(-np.clip(x, -35, 35))))
            yield pa.record_batch([batch.column(0), pa.array(np.concatenate(out))], ["row", "score"])
        give_back()

    return rows.mapInArrow(run, StructType([rows.schema["row"], StructField("score", DoubleType())]))


def score(docs: DataFrame, weights: np.ndarray, text_col: str = "text") -> DataFrame:
    """All columns of docs and score (0 to 1): the sparse dot product of a text's n-gram shares with the weights, as a probability.

    Null and empty texts get the score of the bias alone. A column of docs that is called score gives way to the result. Repeated
    rows are scored each; an empty table gives an empty one. One pass without a shuffle; the weights have a fixed size.
    """
    return _scored(docs, weights, text_col).select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns if c != "score"], "score")


def digest(spark, sf_dir: str) -> DataFrame:
    """Query op6."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored = score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents of a score below 0.5 go. Rows without an id are scored like others, a null or empty text has the score of
    the bias, repeated rows stay or go together; an empty table gives an empty one."""
    weights = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _scored(docs, weights, "text").where("score >= 0.5").select("row.*")
