"""Name similarity: ratios by definition for two names, the same for whole Arrow batches of pairs that blocking has left over (``lanes``), and
native companions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from . import lanes


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bits of whole rows (Hyyro, 2004)."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def indel(a: str, b: str) -> float:
    n = len(a) + len(b)
    return 200.0 * common_length(a, b) / n if n else 100.0


def partial(a: str, b: str) -> float:
    """Best ratio of the shorter text with a stretch of the longer."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    whole = [b[i : i + len(a)] for i in range(len(b) - len(a) + 1)]
    edges = [b[:i] for i in range(1, len(a))] + [b[-i:] for i in range(1, len(a))]
    return max(indel(a, x) for x in (*whole, *edges))


def token_set(a: str, b: str) -> float:
    s, t = set(a.split()), set(b.split())
    if not s or not t:
        return 0.0
    both, only_a, only_b = sorted(s & t), sorted(s - t), sorted(t - s)
    if both and (not only_a or not only_b):
        return 100.0
    base = " ".join(both)
    left, right = " ".join((*both, *only_a)), " ".join((*both, *only_b))
    return max(indel(left, right), indel(base, left) if both else 0.0, indel(base, right) if both else 0.0)


def token_sort(a: str, b: str) -> float:
    return indel(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def weighted(a: str, b: str) -> float:
    """Plain, token and partial ratios, the latter at a discount that grows with the difference in length."""
    if not a or not b:
        return 0.0
    longer = max(len(a), len(b)) / min(len(a), len(b))
    tokens = max(token_sort(a, b), token_set(a, b))
    if longer < 1.5:
        return max(indel(a, b), 0.95 * tokens)
    scale = 0.9 if longer <= 8 else 0.6
    sorted_ = partial(" ".join(sorted(a.split())), " ".join(sorted(b.split())))
    shared = 100.0 if set(a.split()) & set(b.split()) else 0.0
    return max(indel(a, b), scale * partial(a, b), scale * 0.95 * max(sorted_, shared))


def _udf(ratio):
    @F.pandas_udf(DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        codes, distinct = pd.factorize(pd.concat([a, b]).fillna(""), use_na_sentinel=False)
        names = lanes.Names([SPACES.sub(" ", x) for x in distinct])
        return pd.Series(ratio(names, codes[: len(a)], codes[len(a) :]) / 100.0)

    return run


SPACES = re.compile(r"\s+")
indel_ratio, partial_ratio, token_set_ratio, weighted_ratio = map(_udf, (lanes.plain, lanes.partial, lanes.token_sets, lanes.weighted))


def levenshtein_ratio(a: Column, b: Column) -> Column:
    return F.lit(1.0) - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def token_jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)
