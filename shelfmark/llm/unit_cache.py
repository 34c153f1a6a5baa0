"""Values of words (token counts, token ids) looked up for a whole chunk at once, in one Python worker.

Words of at most 15 bytes are their own keys (two 64-bit values with all their bytes), longer ones are kept as byte strings, so
equal keys are equal words; no hash decides.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from . import arrays as A

LONG = A.U64(1 << 63)


class UnitCache:
    """Slots of byte strings; a slot stands for what ``compute`` gave for the string.

    frequent: the first tier, sorted keys of short strings (high, low) with their values, never dropped. The rest is computed once and
    cached; beyond ``most`` entries the cache starts anew.
    """

    def __init__(self, compute: Callable[[list[bytes]], list], most: int, frequent: tuple[np.ndarray, np.ndarray, list] | None = None) -> None:
        self.compute, self.most = compute, most
        high, low, values = frequent or (np.empty(0, A.U64), np.empty(0, A.U64), [])
        self.tier = dict(zip(zip(high.tolist(), low.tolist(), strict=True), range(len(values)), strict=True))
        self.fixed = list(values)
        self._restart()

    def _restart(self) -> None:
        self.values: list = list(self.fixed)
        self.known: dict[tuple[int, int] | bytes, int] = dict(self.tier)

    def lookup(self, raw: bytes, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct strings of a chunk as slots into ``values``, and for each range which of these it is."""
        if len(self.values) > self.most + len(self.fixed):
            self._restart()
        if not len(start):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        low, high = A.short_keys(data, start, end)
        long = np.flatnonzero(end - start > A.SHORT)
        if len(long):  # a number for each long string of this chunk, in a range of keys of its own
            number: dict[bytes, int] = {}
            low[long] = [number.setdefault(raw[s:e], len(number)) for s, e in zip(start[long].tolist(), end[long].tolist(), strict=True)]
            high[long] = LONG
        order = np.lexsort((low, high))
        low, high = low[order], high[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
        first = order[new]
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(new) - 1
        keys: list = list(zip(high[new].tolist(), low[new].tolist(), strict=True))
        known = self.known
        at = len(keys)
        while at and keys[at - 1][0] == int(LONG):  # the long ones sort last
            at -= 1
            keys[at] = raw[start[first[at]] : end[first[at]]]
        have = [known.get(p, -1) for p in keys]
        missed = [k for k, s in enumerate(have) if s < 0]
        if missed:
            at = first[missed]
            strings = [raw[s:e] for s, e in zip(start[at].tolist(), end[at].tolist(), strict=True)]
            for k, v in zip(missed, self.compute(strings), strict=True):
                known[keys[k]] = have[k] = len(self.values)
                self.values.append(v)
        return np.array(have, np.int64), which
