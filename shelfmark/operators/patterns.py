"""Many literal patterns and terms at once: one pass over a text with a trie automaton (Aho and Corasick, 1975), in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import DOTTED

#: Letters of all patterns that an automaton takes; each worker holds one, about a hundred bytes a letter.
MOST_LETTERS = 2_000_000

# Words that never count as an alias, and words before a phrase that make it another place.
WEAK_WORDS = ["is", "or", "as", "at", "to", "of", "an", "so", "do", "no", "im", "am", "be"]
OTHER_PLACE = ["south", "north", "central"]

HITS = "array<struct<code:string,level:int,confidence:double>>"


def fits(texts: Iterable[str]) -> bool:
    return sum(map(len, texts)) <= MOST_LETTERS


def _automaton(keys: Iterable[tuple[str, object]]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for key, value in keys:
        out.add_word(key, value)
    out.make_automaton()
    return out


def first_pattern(text: Column, patterns: list[str]) -> Column:
    """The first of these literal patterns, in their order, that a folded text matches: a word from its start on (nothing of a-z and 0-9
    before it), a phrase with a space anywhere; else null. Null texts match nothing; empty patterns are left out."""
    known = list(dict.fromkeys(p for p in patterns if p))
    if not fits(known):
        raise ValueError(f"patterns of over {MOST_LETTERS} letters; match them in several passes")
    if not known:
        return F.lit(None).cast("string")

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        trie = _automaton((p, (k, len(p), " " in p)) for k, p in enumerate(known))
        inside = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")

        def first(s: str | None) -> str | None:
            best = len(known)
            for end, (k, n, phrase) in trie.iter(s or ""):
                if k < best and (phrase or end < n or s[end - n] not in inside):
                    best = k
            return known[best] if best < len(known) else None

        for b in batches:
            yield b.map(first, na_action=None)

    return run(text)


def term_hits(text: Column, terms: list[dict]) -> Column:
    """For each lower-case text the distinct (code, level, confidence) of the terms in it, one pass, whatever their number.

    terms: term, kind (word or top), code, level, confidence. Words and phrases of words count between other words; a phrase right after
    south, north or central only if it also stands elsewhere; a top level at the end of a dotted token. Weak words never count.
    """
    words: dict[str, list[tuple]] = {}
    tops: dict[str, list[tuple]] = {}
    for t in terms:
        if t["kind"] == "top":
            tops.setdefault(t["term"], []).append((t["code"], t["level"], t["confidence"]))
        elif t["term"] not in WEAK_WORDS:
            words.setdefault(t["term"], []).append((t["code"], t["level"], t["confidence"]))

    @F.pandas_udf(HITS)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        trie = _automaton((f" {w} ", (len(w) + 2, " " in w, tuple(v))) for w, v in words.items())
        apart, dotted = re.compile("[^a-z0-9]+"), re.compile(DOTTED)
        before = tuple(f" {w} " for w in OTHER_PLACE)

        def hits(s: str | None) -> list[dict]:
            if not s:
                return []
            out: set[tuple] = set()
            flat = f" {apart.sub(' ', s).strip()} "
            if words:
                for end, (n, phrase, found) in trie.iter(flat):
                    start = end - n + 1
                    if not (phrase and flat.endswith(before, 0, start + 1)):
                        out.update(found)
            if tops and "." in s:
                for d in dotted.findall(s):
                    out.update(tops.get(d.rpartition(".")[2], ()))
            return [{"code": c, "level": level, "confidence": f} for c, level, f in sorted(out)]

        for b in batches:
            yield b.map(hits, na_action=None)

    return run(text)
