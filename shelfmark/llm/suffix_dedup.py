"""Repeated byte strings (operator 5): suffix arrays by linear grouping over the strings that meet in a bucket."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import NO_ID
from .windows import HOT_CHUNKS, Units, earlier_windows

WINDOW_BYTES, GRAM_BYTES = 50, 24


def suffix_order(symbols: list[int]) -> list[int]:
    """Suffix array by linear grouping (U. Baier, CPM 2016). The symbol 0 is the least and must come last.

    First each suffix is put in the group of its longest Lyndon prefix: groups are taken in descending order, and the suffixes
    that previous-smaller pointers of a group lead to move into higher groups of their own. Then the order inside the groups
    follows in one ascending sweep.
    """
    n = len(symbols)
    used = sorted(set(symbols))
    number = {c: k for k, c in enumerate(used)}
    group = [number[c] for c in symbols]
    members: list[list[int]] = [[] for _ in used]
    for i, g in enumerate(group):
        members[g].append(i)
    below = [k - 1 for k in range(len(used))]
    above = [k + 1 for k in range(len(used))]
    above[-1] = -1
    open_ = -2  # of suffixes without a pointer yet; the place -1 behind the end stays so and ends every walk
    previous = [open_] * (n + 1)
    descending = []
    g = len(used) - 1
    while g >= 0:
        now = members[g]
        if len(now) > 1:
            now = sorted([i for i in now if group[i] == g])
            members[g] = now
        elif now and group[now[0]] != g:
            members[g] = now = []
        descending.append(g)
        times: dict[int, int] = {}
        for i in now:
            p = i - 1
            while (q := previous[p]) != open_:
                p = q
            previous[i] = p
            if p >= 0:
                times[p] = times.get(p, 0) + 1
        if times:
            moved: dict[tuple[int, int], list[int]] = {}
            for p, k in times.items():
                moved.setdefault((group[p], k), []).append(p)
            for old, k in sorted(moved, reverse=True) if len(moved) > 1 else moved:
                new, up = len(members), above[old]
                members.append(moved[old, k])
                below.append(old)
                above.append(up)
                above[old] = new
                if up >= 0:
                    below[up] = new
                for p in members[new]:
                    group[p] = new
        g = below[g]
    head, place = [0] * len(members), 0
    for g in reversed(descending):
        head[g] = place
        place += len(members[g])
    order, unplaced = [0] * n, [True] * n + [False]
    for i in members[descending[-1]]:
        g = group[i]
        order[head[g]] = i
        head[g] += 1
        unplaced[i] = False
    for r in range(n):
        s = order[r] - 1
        while unplaced[s]:
            g = group[s]
            order[head[g]] = s
            head[g] += 1
            unplaced[s] = False
            s = previous[s]
    return order


def suffix_windows(texts: list[bytes], windows: list[int], ids: list[int], window: int = WINDOW_BYTES) -> tuple[list[int], list[int]]:
    """Windows of some strings that a string of a smaller id has too, from the suffix array of all of them."""
    symbols: list[int] = []
    owner: list[int] = []
    starts: list[int] = []
    for k, text in enumerate(texts):
        starts.append(len(symbols))
        symbols += [b + 1 for b in text]
        symbols.append(0)
        owner += [k] * (len(text) + 1)
    strings, at, last, run = [], [], None, []

    def close() -> None:
        least = min(ids[k] for k, _ in run)
        for k, j in run:
            if ids[k] > least:
                strings.append(k)
                at.append(j)

    for i in suffix_order(symbols):
        k = owner[i]
        j = i - starts[k]
        if j < windows[k]:
            text = texts[k][j : j + window]
            if text == last:
                run.append((k, j))
            else:
                if len(run) > 1:
                    close()
                last, run = text, [(k, j)]
    if len(run) > 1:
        close()
    return strings, at


def remove_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW_BYTES, hot: int = HOT_CHUNKS) -> DataFrame:
    """Removes each UTF-8 byte in a string of ``window`` bytes that also starts in a document with a smaller id.

    Returns a row per input row: the id, n_bytes, n_removed, n_spans (maximal removed runs) and kept (the remaining bytes, binary, as
    a cut may fall inside a character). Null text: empty. A null id counts as larger than any other and comes back as null. Rows
    with the same id never remove each other's bytes. Other columns of the input are ignored. An empty table gives an empty one.
    """

    def finish(units: Units, gone: np.ndarray) -> Iterator[tuple]:
        for k, owner in enumerate(units.chunk.ids.tolist()):
            a, b = units.offsets[k], units.offsets[k + 1]
            out = gone[a:b]
            lost = int(out.sum())
            runs = int(out[0]) + int((out[1:] & ~out[:-1]).sum()) if lost else 0
            yield None if owner == NO_ID else owner, int(b - a), lost, runs, units.chunk.data[a:b][~out].tobytes() if lost else units.chunk.text(k)

    def resolve(texts: list[bytes], windows: list[int], ids: list[int]) -> tuple[list[int], list[int]]:
        return suffix_windows(texts, windows, ids, window)

    arrow = pa.schema([(id_col, pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])
    return earlier_windows(docs, id_col, text_col, "byte", window, min(GRAM_BYTES, window), resolve, finish, f"{id_col} long, n_bytes long, n_removed long, n_spans long, kept binary", arrow, hot)


def digest(spark, sf_dir: str) -> DataFrame:
    """Query op5: sizes and a digest of what is kept of each document."""
    kept = remove_repeated_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
