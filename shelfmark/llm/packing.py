"""Packing (operator 8): token streams cut into sequences by order-preserving dynamic programming."""

from __future__ import annotations

import base64
import os
import re
import zlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from .exchange import give_back
from .token_counts import steps
from .unit_cache import UnitCache

LENGTH = 1024
#: Cost of a cut, in padding tokens: at the end of a document, of a sentence, anywhere else.
DOC_CUT, SENTENCE_CUT, FREE_CUT = 0.0, 2.0, 16.0
#: Where no sentence ends for so many tokens, free cuts are offered, so far apart.
LONG_GAP, FREE_STEP = 128, 32
#: Tokens that one run of the program covers at most; its last open sequence goes into the next run.
BLOCK = 1 << 21
END_ID, WHOLE = 50256, b"<|endoftext|>"
#: White space beyond ASCII, as UTF-8; texts with it are encoded as a whole.
WIDE_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
#: Distinct words a worker caches before it starts anew; it keeps them from task to task, so the bound is one on what an idle worker holds.
CACHED = 100_000
ENDERS = b".!?\n"


def vocabulary_paths() -> tuple[str, str]:
    """One vocabulary in two formats: for whole texts with special strings, and as ranks for single words."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def pieces_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte ranges that are encoded independently of each other, in order.

    A word takes one space before it along. Of other white space before a word, the last character stands alone; at the end of a
    text it stays together. So the vocabulary's pattern splits texts, whose finer splits lie inside these ranges.
    """
    begin, end, first = A.word_bounds(data, offsets)
    base, top = np.repeat(offsets[:-1], np.diff(first)), np.repeat(offsets[1:], np.diff(first))
    spaced = begin > base
    spaced[spaced] = data[begin[spaced] - 1] == 32
    start = begin - spaced
    before = base.copy()
    same = np.flatnonzero(base[1:] == base[:-1]) + 1 if len(begin) else np.empty(0, np.int64)
    before[same] = end[same - 1]
    alone = (start > before) & ~spaced
    gap_end = start - alone
    gap = gap_end > before
    lasts = first[1:] - 1
    tail_start = np.where(np.diff(first) > 0, end[np.maximum(lasts, 0)] if len(end) else 0, offsets[:-1])
    tail = tail_start < offsets[1:]
    s = np.concatenate([start, before[gap], start[alone] - 1, tail_start[tail]])
    e = np.concatenate([end, gap_end[gap], start[alone], offsets[1:][tail]])
    order = np.argsort(s, kind="stable")
    return s[order], e[order]


class Encoder:
    """Token ids of texts in one worker, with a cache of words."""

    def __init__(self, vocabulary: str, ranks: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.words = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self.ends = np.zeros(END_ID + 1, dtype=bool)
        self.ends[[n for t, n in table.items() if t[-1] in ENDERS]] = True
        self.cache = UnitCache(self._compute, CACHED)

    def _compute(self, words: list[bytes]) -> list[np.ndarray]:
        return [np.array(self.words.encode_ordinary(w.decode()), "<u4") for w in words]

    def _whole(self, text: bytes) -> np.ndarray:
        return np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, "<u4")

    def encode(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        """Ids of each text (unsigned little-endian 32 bit)."""
        odd = [WHOLE in t or (not t.isascii() and WIDE_SPACE.search(t) is not None) for t in texts]
        raw = b"".join(texts)
        data = np.frombuffer(raw, np.uint8)
        offsets = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))])
        start, end = pieces_of(data, offsets)
        slots, which = self.cache.lookup(raw, data, start, end)
        parts = [self.cache.values[s] for s in slots.tolist()]
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        flat = np.concatenate([np.empty(0, "<u4"), *parts])
        n = sizes[which]
        ids = flat[A.spread((np.cumsum(sizes) - sizes)[which], n)]
        bounds = np.concatenate([[0], np.cumsum(n)])[np.searchsorted(start, offsets)]
        for k, whole in enumerate(odd):
            yield self._whole(texts[k]) if whole else ids[bounds[k] : bounds[k + 1]]


@lru_cache(maxsize=1)
def encoder_of(vocabulary: str, ranks: str) -> Encoder:
    """The encoder of this worker, made once for all of its tasks."""
    return Encoder(vocabulary, ranks)


def best_cuts(bounds: list[int], costs: list[float], length: int) -> list[int]:
    """Cuts 0 = c0 < c1 < ... < total among bounds, at most ``length`` apart, of least padding and cut costs.

    bounds ascend from 0 to the total, neighbours at most ``length`` apart. With best[j] the least cost up to bounds[j],
    best[j] = costs[j] + min(best[i] + length - (bounds[j] - bounds[i])) over bounds[i] >= bounds[j] - length. What is
    minimised depends on i alone, so a queue of ascending values gives each minimum in constant time.
    """
    offer = [0.0] * len(bounds)
    back = [0] * len(bounds)
    offer[0] = bounds[0]
    queue = deque([0])
    pop, push = queue.pop, queue.append
    for j in range(1, len(bounds)):
        b = bounds[j]
        low = b - length
        while bounds[queue[0]] < low:
            queue.popleft()
        i = queue[0]
        back[j] = i
        # offer[j] = best[j] + bounds[j]
        o = costs[j] + offer[i] + length
        offer[j] = o
        while queue and offer[queue[-1]] >= o:
            pop()
        push(j)
    cuts, j = [], len(bounds) - 1
    while j > 0:
        cuts.append(bounds[j])
        j = back[j]
    cuts.append(bounds[0])
    return cuts[::-1]


def candidate_cuts(doc_ends: np.ndarray, sentence_ends: np.ndarray, total: int) -> tuple[list[int], list[float]]:
    """Places where a stream may be cut and what that costs; long gaps get free cuts."""
    marks = np.unique(np.concatenate([[0, total], doc_ends, sentence_ends]))
    gaps = np.diff(marks)
    wide = np.flatnonzero(gaps > LONG_GAP)
    free = [np.arange(marks[k] + FREE_STEP, marks[k + 1], FREE_STEP) for k in wide]
    every = np.unique(np.concatenate([marks, *free])) if free else marks
    cost = np.full(len(every), FREE_CUT)
    cost[np.isin(every, sentence_ends)] = SENTENCE_CUT
    cost[np.isin(every, doc_ends)] = DOC_CUT
    return every.tolist(), cost.tolist()


PIECE = pa.schema([("doc", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


class Packer:
    """Takes encoded documents in order and gives pieces; holds one block of the stream."""

    def __init__(self, first_sequence: int, length: int) -> None:
        self.sequence, self.length = first_sequence, length
        self.docs: list[tuple] = []  # (id, ids, sentence ends, tokens, tokens already given)
        self.held = 0

    def add(self, doc: int | None, ids: bytes, ends: np.ndarray) -> None:
        n = len(ids) // 4
        self.docs.append((doc, ids, ends, n, 0))
        self.held += n

    def give(self, last: bool) -> Iterator[tuple]:
        """Pieces of all full sequences of the block; all of them if it is the last."""
        if not self.docs:
            return
        lens = np.array([n - g for _, _, _, n, g in self.docs])
        doc_ends = np.cumsum(lens)
        begin = doc_ends - lens
        sentences = np.concatenate([e[e > g] - g + b for (_, _, e, _, g), b in zip(self.docs, begin.tolist(), strict=True)])
        cuts = best_cuts(*candidate_cuts(doc_ends, sentences, int(doc_ends[-1])), self.length)
        if not last:
            cuts = cuts[:-1]
        edges = np.unique(np.concatenate([cuts, begin, doc_ends]))
        edges = edges[edges <= cuts[-1]]
        where = np.searchsorted(doc_ends, edges[:-1], side="right").tolist()
        sequence = (np.searchsorted(np.array(cuts), edges[:-1], side="right") - 1).tolist()
        edges_, begin_ = edges.tolist(), begin.tolist()
        for a, b, k, s in zip(edges_[:-1], edges_[1:], where, sequence, strict=True):
            doc, ids, _, n, g = self.docs[k]
            at = a - begin_[k] + g
            yield doc, at, b - a, zlib.crc32(memoryview(ids)[4 * at : 4 * (at + b - a)]), n, self.sequence + s, a - cuts[s]
        self.sequence += len(cuts) - 1
        done = cuts[-1]
        rest = [(d, i, e, n, g + max(0, done - b)) for (d, i, e, n, g), b, t in zip(self.docs, begin_, doc_ends.tolist(), strict=True) if t > done]
        self.docs, self.held = rest, sum(n - g for _, _, _, n, g in rest)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """Packs all rows, in the order in which they are read, into sequences of at most ``length`` tokens.

    Each text becomes its ids and then id 0. Every partition packs its own stream in one pass without a shuffle, so only its last
    sequence is left unfilled; sequence ids hold the partition's number in the upper bits. Cuts are chosen among ends of documents
    and sentences (and, where there are none for long, every few tokens) for the least padding plus cut costs. Returns a row per
    piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset. Null and empty texts give a piece with id 0
    alone; null ids stay null. Other columns are ignored. An empty table gives no piece.
    """
    vocabulary = vocabulary or vocabulary_paths()

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), PIECE, strict=True)], schema=PIECE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, packer = None, Packer(TaskContext.get().partitionId() << 40, length)
        for b in batches:
            encoder = encoder or encoder_of(*vocabulary)
            docs_, texts = b.column(0).to_pylist(), [t or b"" for t in b.column(1).cast(pa.binary()).to_pylist()]
            for first, last in steps(texts):
                for doc, ids in zip(docs_[first:last], encoder.encode(texts[first:last]), strict=True):
                    packer.add(doc, np.append(ids, np.zeros(1, "<u4")).tobytes(), np.flatnonzero(encoder.ends[ids]) + 1)
                    if packer.held >= BLOCK:
                        rows = list(packer.give(False))
                        if rows:
                            yield batch(rows)
        rows = list(packer.give(True))
        if rows:
            yield batch(rows)
        give_back()

    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    schema = f"{id_col} long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return rows.mapInArrow(run, schema.replace(id_col, "doc", 1)).withColumnRenamed("doc", id_col)


def digest(spark, sf_dir: str) -> DataFrame:
    """Query op8."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last stage of the pipeline: the pieces of what is left. A null text is empty and is its end token alone; null and repeated ids are rows of
    their own; an empty table gives an empty one."""
    return pack(docs)
