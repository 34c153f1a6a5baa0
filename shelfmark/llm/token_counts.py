"""Token counts (operator 4): a broadcast table of frequent pre-token lengths, worker caches for the rest, no shuffle at all."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from .unit_cache import UnitCache

#: The frequent tier comes from about so many documents, chosen by a hash of their ids, and has at most so many entries, of which
#: each task of the sample names at most TOLD. It changes the speed alone.
SAMPLE_DOCS, FREQUENT, TOLD = 4000, 65536, 16384
#: Entries a worker caches of the rest before it starts anew.
CACHED = 1_000_000
#: Bytes of text that are looked up at once.
STEP = 1 << 20


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@lru_cache(maxsize=1)
def piece_counter(vocabulary: str) -> Callable[[list[bytes]], list[int]]:
    """Token counts of byte strings by the library, without padding, truncation or added tokens."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    return lambda pieces: [len(e.ids) for e in tokenizer.encode_batch_fast([p.decode() for p in pieces], add_special_tokens=False)]


def steps(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about STEP bytes."""
    first, held = 0, 0
    for k, t in enumerate(texts):
        held += len(t)
        if held >= STEP:
            yield first, k + 1
            first, held = k + 1, 0
    if first < len(texts):
        yield first, len(texts)


def words_of(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All texts as one string and array, their offsets, and bounds of their words."""
    raw = b"".join(texts)
    data = np.frombuffer(raw, np.uint8)
    offsets = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))])
    begin, end, word_offsets = A.word_bounds(data, offsets)
    return raw, data, offsets, begin, end, word_offsets


def frequent_lengths(docs: DataFrame, id_col: str, text_col: str, vocabulary: str) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Compact table of the lengths of frequent short pre-tokens: their keys (high, low) and lengths.

    Tasks tally what the sample leaves them and tell the driver their most frequent pre-tokens; nothing is shuffled.
    """
    share = min(1.0, SAMPLE_DOCS / max(1, docs.count()))
    sample = docs.where(F.pmod(F.xxhash64(F.col(id_col).cast("long")), F.lit(1 << 30)) < int(share * (1 << 30)))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], int] = {}
        for batch in batches:
            texts = [t or b"" for t in batch.column(0).cast(pa.binary()).to_pylist()]
            for a, b in steps(texts):
                _, data, _, begin, end, _ = words_of(texts[a:b])
                short = end - begin <= A.SHORT
                low, high = A.short_keys(data, begin[short], end[short])
                pairs, n = np.unique(np.stack([high, low]), axis=1, return_counts=True) if len(low) else (np.empty((2, 0), A.U64), [])
                for k, c in zip(zip(*pairs.tolist(), strict=True), np.asarray(n).tolist(), strict=True):
                    total[k] = total.get(k, 0) + c
        some = sorted(total, key=lambda k: (-total[k], k))[:TOLD]
        if some:
            yield pa.record_batch([pa.array([np.array([[*k, total[k]] for k in some], A.U64).tobytes()], pa.binary())], ["told"])

    total: dict[tuple[int, int], int] = {}
    for r in sample.select(F.col(text_col).cast("string")).mapInArrow(tally, "told binary").toLocalIterator():
        for high, low, n in np.frombuffer(r.told, A.U64).reshape(-1, 3).tolist():
            total[high, low] = total.get((high, low), 0) + n
    some = sorted(sorted(total, key=lambda k: (-total[k], k))[:FREQUENT])
    words = [(low.to_bytes(8, "little") + (high & (1 << 56) - 1).to_bytes(7, "little"))[: high >> 56] for high, low in some]
    return np.array([k[0] for k in some], A.U64), np.array([k[1] for k in some], A.U64), piece_counter(vocabulary)(words) if words else []


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048, vocabulary: str | None = None) -> DataFrame:
    """The id of each row with n_bytes, n_tokens and over_limit, in one pass without a shuffle.

    Counts are those of the tokenizers library for the whole text, without added special tokens. Pre-tokens never cross white
    space, so a text's count is the sum over its words, special strings inside words included. The lengths of frequent
    words are looked up in the broadcast table, the rest in a worker's cache, and the library counts only what both miss.
    Null text counts as empty (0 tokens), null ids stay null, other columns are ignored, an empty table gives an empty one.
    """
    vocabulary = vocabulary or vocabulary_path()
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, id_col, text_col, vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = None
        for batch in batches:
            cache = cache or UnitCache(piece_counter(vocabulary), CACHED, frequent.value)
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            counts = [np.empty(0, np.int64)]
            for a, b in steps(texts):
                raw, data, _, begin, end, first = words_of(texts[a:b])
                slots, which = cache.lookup(raw, data, begin, end)
                tokens = np.array([cache.values[s] for s in slots.tolist()], np.int64)[which]
                total = np.concatenate([[0], np.cumsum(tokens)])
                counts.append(total[first[1:]] - total[first[:-1]])
            n = np.concatenate(counts)
            yield pa.record_batch([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(n), pa.array(n > limit)], [id_col, "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"{id_col} long, n_bytes long, n_tokens long, over_limit boolean")


def digest(spark, sf_dir: str) -> DataFrame:
    """Query op4."""
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
