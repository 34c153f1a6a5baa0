"""Windows of texts that an earlier document has too, found by super-k-mer partitioning.

A window is ``window`` consecutive units (words or bytes) of one text. Consecutive windows with one minimiser form a
super-k-mer, and equal windows always have equal minimisers, so each super-k-mer travels as one packed string to the bucket
of its minimiser and is compared there with all that could match. Three steps over the chunk table:

1. Each chunk asks the buckets which of its minimisers another document has (6 bytes each). Most text drops out here.
2. Each chunk sends the strings of the rest, every distinct one once, with the smallest id that has it. In the bucket equal
   strings collapse by their bytes. Windows whose hash no other string has are done; the strings of the others go to a
   resolver (sorting, or a suffix array), which compares them byte by byte.
3. Each chunk marks its units: all windows of a string that an earlier document has as a whole, and those the resolver named.

A minimiser that more than ``hot`` chunks have is a poor key: its windows travel one by one, each to the bucket of its own hash,
and are compared in the same way there. Hashes only choose buckets and rule windows out; nothing is capped or dropped. What
one string costs its bucket is one entry for each chunk that has it, so larger chunks (``chunk_bytes``) suit larger tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from operator import itemgetter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from . import arrays as A
from .exchange import CHUNK_BYTES, MESSAGE, MESSAGE_SCHEMA, Chunk, apply_shared, chunk_table, each_bucket, shared_keys, split_by_bucket, width, with_answers

#: (strings, windows in each, id of each) under one minimiser -> (string, window) pairs that a smaller id has too
Resolver = Callable[[list[bytes], list[int], list[int]], tuple[list[int], list[int]]]

HOT_CHUNKS = 2048


@dataclass(frozen=True)
class Plan:
    unit: str  # "word" or "byte"
    window: int
    gram: int
    buckets: int

    def runs(self, data: np.ndarray, begin: np.ndarray | None, end: np.ndarray | None, k: int) -> np.ndarray:
        """Hash of each run of k units."""
        if self.unit == "byte":
            return A.byte_windows(data, k)
        return A.gram_hash(A.prefix_sums(A.word_hashes(data, begin, end)), k)


class Units:
    """The units of a chunk, the strings it sends (entries) and where these occur."""

    def __init__(self, chunk: Chunk, plan: Plan) -> None:
        self.chunk, self.plan = chunk, plan
        self.begin = self.end = None
        self.offsets = chunk.offsets
        if plan.unit == "word":
            self.begin, self.end, self.offsets = A.word_bounds(chunk.data, chunk.offsets)
        self.grams = plan.runs(chunk.data, self.begin, self.end, plan.gram)
        self.kmers = A.super_kmers(self.grams, self.offsets, plan.window, plan.gram)
        self.ids = self.owners(self.kmers["start"])

    def owners(self, at: np.ndarray) -> np.ndarray:
        return self.chunk.ids[A.owner_of(self.offsets, at)] if len(at) else np.empty(0, np.int64)

    def minimisers(self) -> tuple[np.ndarray, np.ndarray]:
        return self.kmers["mini"], self.ids

    def enter(self, answers: list[dict]) -> None:
        """Numbers the distinct strings of shared minimisers; those of hot ones are single windows."""
        shared, hot = apply_shared(self.kmers["mini"], self.ids, answers, self.plan.buckets)
        start, n, key = (self.kmers[k] for k in ("start", "n", "mini"))
        cool = shared & ~hot
        hot &= shared
        if hot.any():
            at = A.spread(start[hot], n[hot])
            own = self.plan.runs(self.chunk.data, self.begin, self.end, self.plan.window)[at]
            self.start, self.n, key = np.concatenate([start[cool], at]), np.concatenate([n[cool], np.ones(len(at), np.int64)]), np.concatenate([key[cool], own])
        else:
            self.start, self.n, key = start[cool], n[cool], key[cool]
        self.ids = self.owners(self.start)
        number: dict[bytes, int] = {}
        self.entry = np.fromiter((number.setdefault(s, len(number)) for s in self._strings()), np.int64, len(self.start))
        self.strings = list(number)
        self.entry_id = np.full(len(number), A.NO_ID)
        np.minimum.at(self.entry_id, self.entry, self.ids)
        keys = np.empty(len(number), A.U64)
        keys[self.entry] = key
        self.places = split_by_bucket(keys, self.plan.buckets)

    def _strings(self) -> Iterator[bytes]:
        """The bytes of each string; words are joined by one space."""
        raw, first, last = self.chunk.raw, self.start, self.start + self.n + self.plan.window - 1
        if self.plan.unit == "word":
            words = [w for k in range(len(self.chunk.ids)) for w in self.chunk.text(k).split()]
            raw = b" ".join(words)
            size = self.end - self.begin
            place = np.cumsum(size + 1) - size - 1
            first, last = place[first], place[last - 1] + size[last - 1]
        return (raw[a:b] for a, b in zip(first.tolist(), last.tolist(), strict=True))


def _transposed(values: np.ndarray) -> bytes:
    """64-bit values byte by byte, which compresses better."""
    return values.view(np.uint8).reshape(-1, 8).T.tobytes()


def _packed(ids: np.ndarray, strings: list[bytes]) -> bytes:
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    return zstandard.ZstdCompressor(level=1).compress(_transposed(ids) + _transposed(sizes) + b"".join(strings))


def _unpacked(body: bytes, n: int) -> tuple[np.ndarray, list[bytes]]:
    raw = zstandard.ZstdDecompressor().decompress(body)
    ids, sizes = (np.frombuffer(raw, np.uint8, 8 * n, 8 * n * k).reshape(8, n).T.copy().view(np.int64).ravel() for k in (0, 1))
    ends = (16 * n + np.cumsum(sizes)).tolist()
    return ids, [raw[b - s : b] for b, s in zip(ends, sizes.tolist(), strict=True)]


def _ask_strings(plan: Plan) -> Callable[[Chunk, list[dict]], Iterator[tuple]]:
    def work(chunk: Chunk, answers: list[dict]) -> Iterator[tuple]:
        if answers:
            units = Units(chunk, plan)
            units.enter(answers)
            for bucket, at in units.places:
                yield bucket, chunk.key, len(at), _packed(units.entry_id[at], list(itemgetter(*at.tolist())(units.strings)) if len(at) > 1 else [units.strings[at[0]]])

    return work


def _open_windows(strings: list[bytes], least: np.ndarray, plan: Plan) -> tuple[np.ndarray, ...]:
    """What hashes can't rule out: strings with windows that a string of another id may have, and the first and the last of these
    windows of each; and for all strings the first unit of each, the bounds of units, and the minimisers of those strings."""
    data = np.frombuffer(b" ".join(strings), np.uint8)
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    first = np.cumsum(sizes + 1) - sizes - 1
    begin = end = None
    units = sizes
    if plan.unit == "word":
        begin, end, at = A.word_bounds(data, np.append(first, len(data)))
        units, first = np.diff(at), at[:-1]
    n = units - plan.window + 1
    owner = np.repeat(np.arange(len(strings)), n)
    at = A.spread(first, n)
    hashes = plan.runs(data, begin, end, plan.window)[at]
    order = np.argsort(hashes, kind="stable")
    hashes = hashes[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = hashes[1:] != hashes[:-1]
    runs = np.flatnonzero(new)
    ids = least[owner[order]]
    differ = np.minimum.reduceat(ids, runs) < np.maximum.reduceat(ids, runs)
    some = np.sort(order[np.repeat(differ, np.diff(np.append(runs, len(order))))])
    held = owner[some]
    lead = np.flatnonzero(np.append(True, held[1:] != held[:-1])) if len(held) else np.empty(0, np.int64)
    who = held[lead]
    window = at[some] - first[held]
    low, high = window[lead], window[np.append(lead[1:], len(held)) - 1] if len(held) else window
    grams = plan.runs(data, begin, end, plan.gram)
    reach = plan.window - plan.gram + 1
    mini = np.minimum.reduceat(grams[A.spread(first[who], np.full(len(who), reach))], np.arange(len(who)) * reach) if len(who) else np.empty(0, A.U64)
    return who, low, high, mini


def _answer_strings(plan: Plan, resolve: Resolver) -> Callable[[list[dict]], Iterator[tuple]]:
    def work(rows: list[dict]) -> Iterator[tuple]:
        number: dict[bytes, int] = {}
        ids, which = [], []
        for r in rows:
            own, strings = _unpacked(r["body"], r["kind"])
            ids.append(own)
            which.append(np.fromiter((number.setdefault(s, len(number)) for s in strings), np.int64, len(strings)))
        strings = list(number)
        del number
        least = np.full(len(strings), A.NO_ID)
        np.minimum.at(least, np.concatenate(which), np.concatenate(ids))
        who, low, high, mini = _open_windows(strings, least, plan)
        order = np.argsort(mini, kind="stable")
        bounds = [*(np.flatnonzero(np.append(True, np.diff(mini[order]) != 0)).tolist() if len(order) else []), len(order)]
        found_string, found_window = [], []
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            at = order[a:b]
            own, skip = who[at].tolist(), low[at].tolist()
            texts = [_cut(strings[k], s, e, plan) for k, s, e in zip(own, skip, high[at].tolist(), strict=True)]
            s, w = resolve(texts, (high[at] - low[at] + 1).tolist(), least[own].tolist())
            found_string += [own[i] for i in s]
            found_window += [skip[i] + j for i, j in zip(s, w, strict=True)]
        named = np.array([found_string, found_window], np.int64).reshape(2, -1)
        named = named[:, np.argsort(named[0], kind="stable")]
        for r, i, k in zip(rows, ids, which, strict=True):
            lo, hi = np.searchsorted(named[0], k), np.searchsorted(named[0], k, side="right")
            mine = np.flatnonzero((hi > lo) & (i == least[k]))
            count = (hi - lo)[mine]
            late = least[k] < i
            if late.any() or len(mine):
                told = np.stack([np.repeat(mine, count), named[1, A.spread(lo[mine], count)]]).astype(np.int32)
                yield r["bucket"], r["chunk"], 4, np.packbits(late).tobytes() + told.tobytes()

    return work


def _cut(text: bytes, first: int, last: int, plan: Plan) -> bytes:
    """Windows first to last of a string."""
    if plan.unit == "byte":
        return text[first : last + plan.window]
    return b" ".join(text.split(b" ")[first : last + plan.window])


def _removed(units: Units, answers: list[dict]) -> np.ndarray:
    """Mask over the units of a chunk."""
    total = int(units.offsets[-1])
    if not answers:
        return np.zeros(total, dtype=bool)
    units.enter(answers)
    late = np.zeros(len(units.strings), dtype=bool)
    places, entries, windows = dict(units.places), [], []
    for r in answers:
        if r["kind"] == 4:
            at = places[r["bucket"]]
            head = -(-len(at) // 8)
            late[at] = np.unpackbits(np.frombuffer(r["body"], np.uint8, head), count=len(at)).astype(bool)
            e, w = np.frombuffer(r["body"], np.int32, offset=head).reshape(2, -1)
            entries.append(at[e])
            windows.append(w.astype(np.int64))
    gone = late[units.entry] | (units.ids > units.entry_id[units.entry])
    at = [A.spread(units.start[gone], units.n[gone])]
    if entries:
        e, w = np.concatenate(entries), np.concatenate(windows)
        order = np.argsort(e, kind="stable")
        e, w = e[order], w[order]
        mine = np.flatnonzero(~gone)
        lo, hi = np.searchsorted(e, units.entry[mine]), np.searchsorted(e, units.entry[mine], side="right")
        at.append(np.repeat(units.start[mine], hi - lo) + w[A.spread(lo, hi - lo)])
    return A.covered(np.concatenate(at), units.plan.window, total)


def earlier_windows(docs: DataFrame, id_col: str, text_col: str, unit: str, window: int, gram: int, resolve: Resolver, finish: Callable[[Units, np.ndarray], Iterator[tuple]], schema: str, arrow: pa.Schema, hot: int = HOT_CHUNKS, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """finish(units, mask) for each chunk; the mask says which units lie in a window that a document with a smaller id has."""
    chunks = chunk_table(docs, id_col, text_col, chunk_bytes)
    plan = Plan(unit, window, gram, 4 * width(docs.sparkSession))
    shared = shared_keys(chunks, lambda chunk: Units(chunk, plan).minimisers(), plan.buckets, hot).checkpoint()
    strings = each_bucket(with_answers(chunks, shared, _ask_strings(plan), MESSAGE_SCHEMA, MESSAGE), _answer_strings(plan, resolve))

    def last(chunk: Chunk, got: list[dict]) -> Iterator[tuple]:
        units = Units(chunk, plan)
        yield from finish(units, _removed(units, got))

    return with_answers(chunks, shared.unionByName(strings), last, schema, arrow)
