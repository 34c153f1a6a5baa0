"""Numpy helpers on whole chunks of text: word bounds, word and window hashes, exact word keys, sliding minima, super-k-mers.

Hashes choose buckets and rule out pairs; what decides on equal strings is compared byte by byte, as said in each operator.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
NO_ID = np.iinfo(np.int64).max

_tables: dict[str, np.ndarray] = {}


def _powers(kind: str, base: int, n: int) -> np.ndarray:
    have = _tables.get(kind)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n).bit_length())
        table = np.full(size, base, dtype=U64)
        table[0] = 1
        have = _tables[kind] = np.cumprod(table, dtype=U64)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values (the finalizer of splitmix64)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


#: Masks of the first k bytes of a little-endian 64-bit value.
FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)


def eight_bytes(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as one value; behind the end come zeros."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", buffer=padded.data, strides=(1,))


def prefix_sums(units: np.ndarray) -> np.ndarray:
    out = np.empty(len(units) + 1, dtype=U64)
    out[0] = 0
    np.cumsum(units * _powers("up", BASE, len(units)), dtype=U64, out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of units[start:end] for arrays of bounds."""
    inverse = _powers("down", INVERSE, len(prefix))
    return mix((prefix[end] - prefix[start]) * inverse[start])


def gram_hash(prefix: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k units, by its start."""
    n = len(prefix) - 1
    if n < k:
        return np.empty(0, dtype=U64)
    return mix((prefix[k:] - prefix[:-k]) * _powers("down", INVERSE, n - k + 1))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    if len(values) < width:
        return values[:0]
    span, out = 1, values
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    if span < width:
        out = np.minimum(out[: -(width - span)], out[width - span :])
    return out


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` of concatenated texts, and the first word of each text.

    offsets: byte bounds of the texts, one more than there are texts; words never cross them.
    """
    inside = (data != 32) & ((data < 9) | (data > 13))
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    starts[cut] = inside[cut]
    ends[cut - 1] = inside[cut - 1]
    begin, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return begin, end, np.searchsorted(begin, offsets)


def word_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range: the sum of its mixed 8-byte blocks, each mixed with its place.

    A sum of values that are mixed one by one has no algebra across places, so strings made to collide under polynomial
    hashes (Thue-Morse words) differ here.
    """
    if not len(begin):
        return np.empty(0, U64)
    n = end - begin
    blocks = np.maximum((n + 7) >> 3, 1)
    total = np.cumsum(blocks)
    nth = np.arange(total[-1]) - np.repeat(total - blocks, blocks)
    value = eight_bytes(data)[np.repeat(begin, blocks) + 8 * nth] & FIRST_BYTES[np.minimum(np.repeat(n, blocks) - 8 * nth, 8)]
    mixed = mix(value + (nth + 1).astype(U64) * U64(BASE))
    return mix(np.add.reduceat(mixed, total - blocks) + n.astype(U64))


#: Longest byte string that two 64-bit values hold with its length.
SHORT = 15


def short_keys(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two values that are the bytes of each range of at most SHORT bytes: equal keys are equal strings. Longer ranges get no use of it."""
    n = np.minimum(end - begin, SHORT)
    value = eight_bytes(data)
    low = value[begin] & FIRST_BYTES[np.minimum(n, 8)]
    rest = np.maximum(n - 8, 0)
    high = value[np.minimum(begin + 8, len(data))] & FIRST_BYTES[rest]
    return low, high | n.astype(U64) << U64(56)


def byte_windows(data: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k bytes, by its start."""
    n = len(data) - k + 1
    if n <= 0:
        return np.empty(0, U64)
    value = eight_bytes(data)
    if k < 8:
        return mix(value[:n] & FIRST_BYTES[k])
    out = np.zeros(n, U64)
    for j, at in enumerate([*range(0, k - 8, 8), k - 8]):
        out += value[at : at + n] * U64((2 * j + 1) * BASE % (1 << 64))
    return mix(out)


def owner_of(offsets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Index of the text that holds each unit."""
    return np.searchsorted(offsets, at, side="right") - 1


def super_kmers(grams: np.ndarray, offsets: np.ndarray, window: int, gram: int, longest: int = 256) -> dict[str, np.ndarray]:
    """Runs of consecutive windows with one minimiser value, from the hashes of all runs of ``gram`` units.

    Returns start (first unit), n (windows; the run covers n + window - 1 units) and mini (minimiser). Equal windows have
    equal minimisers, wherever they stand. Runs are cut after ``longest`` windows.
    """
    empty = {"start": np.empty(0, np.int64), "n": np.empty(0, np.int64), "mini": np.empty(0, U64)}
    least = sliding_min(grams, window - gram + 1)
    if not len(least):
        return empty
    edge = np.zeros(int(offsets[-1]) + 1, dtype=np.int32)
    lo, hi = offsets[:-1], np.maximum(offsets[1:] - window + 1, offsets[:-1])
    np.add.at(edge, lo, 1)
    np.add.at(edge, hi, -1)
    at = np.flatnonzero(np.cumsum(edge)[: len(least)] > 0)
    if not len(at):
        return empty
    least = least[at]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (np.diff(at) != 1) | (least[1:] != least[:-1])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(at)))
    if n.max() > longest:
        parts = -(-n // longest)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        n = np.minimum(np.repeat(n, parts) - nth * longest, longest)
        first = np.repeat(first, parts) + nth * longest
    return {"start": at[first], "n": n, "mini": least[first]}


def covered(starts: np.ndarray, length: int, total: int) -> np.ndarray:
    """Which of ``total`` units lie in a window of ``length`` units at one of the starts."""
    edge = np.zeros(total + 1, dtype=np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + length, total), -1)
    return np.cumsum(edge[:-1]) > 0


def spread(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1 ... start + n - 1 for each pair, one after the other."""
    if not len(start):
        return np.empty(0, np.int64)
    return np.repeat(start - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
