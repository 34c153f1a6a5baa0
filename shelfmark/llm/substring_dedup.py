"""Repeated word windows (operator 3): super-k-mer partitioning, with sorting inside the buckets."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import NO_ID
from .windows import HOT_CHUNKS, Units, earlier_windows

WINDOW_WORDS, GRAM_WORDS = 50, 6


def sorted_windows(texts: list[bytes], windows: list[int], ids: list[int], window: int = WINDOW_WORDS) -> tuple[list[int], list[int]]:
    """Sorts all windows of some packed strings; names those that a smaller id has too."""
    rows = []
    for k, (text, n, owner) in enumerate(zip(texts, windows, ids, strict=True)):
        words = text.split(b" ")
        rows += [(b" ".join(words[j : j + window]), owner, k, j) for j in range(n)]
    rows.sort()
    strings, at, last, least = [], [], None, 0
    for text, owner, k, j in rows:
        if text != last:
            last, least = text, owner
        elif owner > least:
            strings.append(k)
            at.append(j)
    return strings, at


def remove_repeated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW_WORDS, hot: int = HOT_CHUNKS) -> DataFrame:
    """Removes each word in a window of ``window`` words that also starts in a document with a smaller id.

    Words are ``[^\\x20\\x09-\\x0D]+``, compared byte for byte. Returns a row per input row: the id, n_words, n_removed and kept
    (the kept words joined by one space). Null or empty text: no words. A null id counts as larger than any other and comes back as
    null. Rows with the same id never remove each other's words. Other columns of the input are ignored. An empty table gives an
    empty one.
    """

    def finish(units: Units, gone: np.ndarray) -> Iterator[tuple]:
        for k, owner in enumerate(units.chunk.ids.tolist()):
            a, b = units.offsets[k], units.offsets[k + 1]
            words, out = units.chunk.text(k).split(), gone[a:b]
            lost = int(out.sum())
            yield None if owner == NO_ID else owner, len(words), lost, b" ".join(compress(words, (~out).tolist()) if lost else words).decode()

    def resolve(texts: list[bytes], windows: list[int], ids: list[int]) -> tuple[list[int], list[int]]:
        return sorted_windows(texts, windows, ids, window)

    arrow = pa.schema([(id_col, pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])
    return earlier_windows(docs, id_col, text_col, "word", window, min(GRAM_WORDS, window), resolve, finish, f"{id_col} long, n_words long, n_removed long, kept string", arrow, hot)


def digest(spark, sf_dir: str) -> DataFrame:
    """Query op3: sizes and a digest of what is kept of each document."""
    kept = remove_repeated_words(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
