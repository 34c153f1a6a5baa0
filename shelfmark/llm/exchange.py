"""Texts as compressed chunks, and the exchange of packed questions and answers between chunks and hash buckets.

A chunk is one row with about a megabyte of whole texts. Tasks work on chunks with numpy; what chunks must tell each
other travels as one binary row for each (chunk, bucket). The chunk table is dealt by its key once and checkpointed with that
layout, so answers come back to the chunks without moving a text again. A lost executor costs a recomputation from there.
"""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterator
from contextlib import suppress
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import NO_ID, U64

CHUNK_BYTES = 1 << 20
CHUNK_SCHEMA = "chunk long, ids binary, lens binary, body binary"
MESSAGE_SCHEMA = "bucket int, chunk long, kind int, body binary"
MESSAGE = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("kind", pa.int32()), ("body", pa.binary())])


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the session names in spark.checkpoint.dir. A local one is taken in local mode alone; on a cluster that
    names none, executors would lose what they write, so that is an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="spark-ck-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def keyed_checkpoint(df: DataFrame, key: str) -> DataFrame:
    """Deals rows by the key and checkpoints them; later joins on the key don't move them again.

    Adaptive execution hides the layout of what it checkpoints, so it is off for this one job.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    was = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return df.repartition(width(spark), key).checkpoint()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", was)


def chunk_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Rows of whole texts with their ids. A null text counts as empty; a null id as larger than all others."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        squeeze, made = zstandard.ZstdCompressor(level=3), TaskContext.get().partitionId() << 32
        ids: list[int] = []
        texts: list[bytes] = []

        def emit() -> pa.RecordBatch:
            nonlocal made
            lens = np.fromiter(map(len, texts), np.int64, len(texts))
            out = [[made], [np.array(ids, np.int64).tobytes()], [lens.tobytes()], [squeeze.compress(b"".join(texts))]]
            made += 1
            ids.clear(), texts.clear()
            return pa.record_batch([pa.array(out[0], pa.int64()), *(pa.array(x, pa.binary()) for x in out[1:])], ["chunk", "ids", "lens", "body"])

        held = 0
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                ids.append(NO_ID if i is None else i)
                texts.append(t or b"")
                held += len(texts[-1]) + 16
                if held >= chunk_bytes:
                    yield emit()
                    held = 0
        if ids:
            yield emit()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return keyed_checkpoint(rows.mapInArrow(pack, CHUNK_SCHEMA), "chunk")


def give_back() -> None:
    """Returns memory that this worker has freed to the system; workers live on from stage to stage."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


class Chunk:
    """One row of the chunk table; the texts are unpacked when they are asked for."""

    def __init__(self, row: dict) -> None:
        self.key, self.ids, self.body = row["chunk"], np.frombuffer(row["ids"], np.int64), row["body"]
        self.offsets = np.concatenate([[0], np.cumsum(np.frombuffer(row["lens"], np.int64))])

    @classmethod
    def of(cls, key: int, ids: np.ndarray, texts: list[bytes]) -> Chunk:
        out = cls.__new__(cls)
        out.key, out.ids, out.raw = key, ids, b"".join(texts)
        out.offsets = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))])
        return out

    @cached_property
    def raw(self) -> bytes:
        return zstandard.ZstdDecompressor().decompress(self.body, max_output_size=max(1, int(self.offsets[-1])))

    @cached_property
    def data(self) -> np.ndarray:
        return np.frombuffer(self.raw, np.uint8)

    def text(self, k: int) -> bytes:
        return self.raw[self.offsets[k] : self.offsets[k + 1]]


def each_chunk(chunks: DataFrame, work: Callable[[Chunk], Iterator[tuple]], schema: str, arrow: pa.Schema) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                rows = list(work(Chunk(batch.slice(k, 1).to_pylist()[0])))
                if rows:
                    yield pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    return chunks.mapInArrow(run, schema)


def with_answers(chunks: DataFrame, answers: DataFrame, work: Callable[[Chunk, list[dict]], Iterator[tuple]], schema: str, arrow: pa.Schema) -> DataFrame:
    """work for each chunk with the messages addressed to it; the chunks stay where they are."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = [r for x in left.to_pylist() for r in work(Chunk(x), right.to_pylist())]
        give_back()
        return pa.table([pa.array(list(c), t.type) for c, t in zip(zip(*rows, strict=True) if rows else [()] * len(arrow), arrow, strict=True)], schema=arrow)

    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, schema)


def each_bucket(messages: DataFrame, work: Callable[[list[dict]], Iterator[tuple]]) -> DataFrame:
    """work on all messages of one bucket; yields messages back. A bucket is a hash range, its size is the total over ``buckets``."""

    def run(table: pa.Table) -> pa.Table:
        rows = list(work(table.to_pylist()))
        give_back()
        return pa.table([pa.array(list(c), t.type) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 4, MESSAGE, strict=True)], schema=MESSAGE)

    return messages.groupBy("bucket").applyInArrow(run, MESSAGE_SCHEMA)


def split_by_bucket(keys: np.ndarray, buckets: int) -> list[tuple[int, np.ndarray]]:
    """(bucket, positions of its keys in order) for each bucket that has a key."""
    of = (keys % U64(buckets)).astype(np.int64)
    order = np.argsort(of, kind="stable")
    bounds = np.searchsorted(of[order], np.arange(buckets + 1))
    return [(b, order[bounds[b] : bounds[b + 1]]) for b in range(buckets) if bounds[b] < bounds[b + 1]]


def distinct_keys(keys: np.ndarray, owner_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and whether two owners of this chunk have the key."""
    order = np.argsort(keys, kind="stable")
    keys, owners = keys[order], owner_ids[order]
    first = np.ones(len(keys), dtype=bool)
    first[1:] = keys[1:] != keys[:-1]
    at = np.flatnonzero(first)
    if not len(at):
        return keys, np.empty(0, bool)
    return keys[at], np.minimum.reduceat(owners, at) < np.maximum.reduceat(owners, at)


def shared_keys(chunks: DataFrame, keys_of: Callable[[Chunk], tuple[np.ndarray, np.ndarray]], buckets: int, hot: int) -> DataFrame:
    """Finds the keys that two owners have anywhere: messages of kind 0 to each chunk with two bits for each of its distinct keys:
    whether it is shared, and whether more than ``hot`` chunks have it.

    keys_of gives (keys, ids of their owners). A chunk sends each distinct key once, as 6 bytes; keys of one bucket that agree
    in these count as equal, which may only let a key pass that has no partner.
    """

    def ask(chunk: Chunk) -> Iterator[tuple]:
        keys, many = distinct_keys(*keys_of(chunk))
        for bucket, at in split_by_bucket(keys, buckets):
            short = (keys[at] >> U64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
            yield bucket, chunk.key, len(at), short.tobytes() + np.packbits(many[at]).tobytes()

    def answer(rows: list[dict]) -> Iterator[tuple]:
        keys, many = [], []
        for r in rows:
            wide = np.zeros((r["kind"], 8), np.uint8)
            wide[:, :6] = np.frombuffer(r["body"], np.uint8, 6 * r["kind"]).reshape(-1, 6)
            keys.append(wide.view("<u8").ravel())
            many.append(np.unpackbits(np.frombuffer(r["body"], np.uint8, offset=6 * r["kind"]), count=r["kind"]).astype(bool))
        every = np.concatenate(keys)
        order = np.argsort(every, kind="stable")
        new = np.ones(len(order), dtype=bool)
        new[1:] = every[order][1:] != every[order][:-1]
        first = np.flatnonzero(new)
        asked = np.empty(len(order), np.int64)
        asked[order] = np.repeat(np.diff(np.append(first, len(order))), np.diff(np.append(first, len(order))))
        del order, new, every
        at = 0
        for r, m in zip(rows, many, strict=True):
            n = asked[at : at + r["kind"]]
            bits = m | (n > 1)
            at += r["kind"]
            if bits.any():
                yield r["bucket"], r["chunk"], 0, np.packbits(bits).tobytes() + np.packbits(n > hot).tobytes()

    return each_bucket(each_chunk(chunks, ask, MESSAGE_SCHEMA, MESSAGE), answer)


def apply_shared(keys: np.ndarray, owner_ids: np.ndarray, answers: list[dict], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """For each key of a chunk (as keys_of gave them), whether shared_keys found it with two owners, and whether it is hot."""
    distinct, _ = distinct_keys(keys, owner_ids)
    bits = np.zeros((2, len(distinct)), dtype=bool)
    places = dict(split_by_bucket(distinct, buckets))
    for r in answers:
        if r["kind"] == 0:
            at = places[r["bucket"]]
            both = np.frombuffer(r["body"], np.uint8).reshape(2, -1)
            bits[:, at] = np.unpackbits(both, axis=1, count=len(at)).astype(bool)
    return tuple(bits[:, np.searchsorted(distinct, keys)])


def key_levels(chunks: DataFrame, keys_of: Callable[..., tuple[np.ndarray, np.ndarray]], buckets: int, given: DataFrame) -> DataFrame:
    """How common each key is: messages of kind 5 to each chunk with a byte for each of its distinct keys.

    0: one owner; else 1 + log2(owners), rounded down. keys_of(chunk, messages) gives (keys, ids of their owners). A key is known to
    its bucket by 24 bits, so the counters number 2 ** 24 for each bucket and grow with the shuffle partitions; keys that share a
    counter share its level, which is the same for all chunks.
    """

    def ask(chunk: Chunk, messages: list[dict]) -> Iterator[tuple]:
        keys, n = np.unique(keys_of(chunk, messages)[0], return_counts=True)
        for bucket, at in split_by_bucket(keys, buckets):
            short = (keys[at] >> U64(40)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :3]
            many = n[at] > 1
            yield bucket, chunk.key, len(at), short.tobytes() + np.packbits(many).tobytes() + n[at][many].astype("<u4").tobytes()

    def answer(rows: list[dict]) -> Iterator[tuple]:
        counts = np.zeros(1 << 24, np.uint32)
        keys = []
        for r in rows:
            k = r["kind"]
            wide = np.zeros((k, 4), np.uint8)
            wide[:, :3] = np.frombuffer(r["body"], np.uint8, 3 * k).reshape(-1, 3)
            keys.append(wide.view("<u4").ravel())
            many = np.unpackbits(np.frombuffer(r["body"], np.uint8, -(-k // 8), 3 * k), count=k).astype(bool)
            n = np.ones(k, np.uint32)
            n[many] = np.frombuffer(r["body"], "<u4", offset=3 * k + -(-k // 8))
            np.add.at(counts, keys[-1], n)
        for r, key in zip(rows, keys, strict=True):
            n = counts[key]
            yield r["bucket"], r["chunk"], 5, np.where(n > 1, 1 + np.log2(n), 0).astype(np.uint8).tobytes()

    return each_bucket(with_answers(chunks, given, ask, MESSAGE_SCHEMA, MESSAGE), answer)


def apply_levels(keys: np.ndarray, answers: list[dict], buckets: int) -> np.ndarray:
    """The level of each key of a chunk."""
    distinct = np.unique(keys)
    levels = np.zeros(len(distinct), np.uint8)
    places = dict(split_by_bucket(distinct, buckets))
    for r in answers:
        if r["kind"] == 5:
            levels[places[r["bucket"]]] = np.frombuffer(r["body"], np.uint8)
    return levels[np.searchsorted(distinct, keys)]
