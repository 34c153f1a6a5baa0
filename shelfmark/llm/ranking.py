"""Ranked lexical search (operator 12): per-term geometric blocking. Each shard of documents has a posting list for each term of the items; lists
are cut into clusters of alike documents, a cluster keeps the coordinatewise greatest impacts, and is skipped only where these can't reach the
ten best of an item."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .exchange import checkpoint_dir, give_back

TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
TOP = 10
#: Distinct terms of the items that one pass takes along (a few MB in each task); more items take more passes.
SLICE_TERMS = 16_384
#: Impacts of a shard: documents times terms, 64 MB as 32-bit numbers.
SHARD_CELLS, SHARD_DOCS = 1 << 24, 4096
#: Documents of a cluster, on average; shorter posting lists are one cluster without a summary.
CLUSTER = 64
#: Dimensions of the sketches by which documents are told alike; what they miss costs time, never a result.
SKETCH = 32
#: Rankings of one item that one task merges first, before the last merge.
MERGE = 256
NO_ID = np.iinfo(np.int64).max
SHARD_SCHEMA = "body binary"
STATS_SCHEMA = "term int, df long, terms long"
HITS_SCHEMA = "item int, task int, doc_id long, score long"


def terms_of(text: str | None) -> list[bytes]:
    return TERM.findall((text or "").encode().lower())


def slices(items: DataFrame, id_col: str, text_col: str, most: int) -> Iterator[tuple[list[int | None], list[dict[bytes, int]], dict[bytes, int]]]:
    """(ids, terms with their repeats, numbers of the terms) of as many items as have at most ``most`` distinct terms; an item with more is
    one slice. One slice is held at a time."""
    ids, wanted, number = [], [], {}
    for r in items.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).toLocalIterator():
        counts: dict[bytes, int] = {}
        for t in terms_of(r[1]):
            counts[t] = counts.get(t, 0) + 1
        if not counts:
            continue
        if number and len(number.keys() | counts.keys()) > most:
            yield ids, wanted, number
            ids, wanted, number = [], [], {}
        for t in counts:
            number.setdefault(t, len(number))
        ids.append(r[0])
        wanted.append(counts)
    if ids:
        yield ids, wanted, number


def shards_of(docs: DataFrame, number: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """Packed shards: ids, lengths and the (term, count) pairs of the documents that have a term, in the items' terms alone. Documents with
    none of these only count; a null id comes last among equals."""
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(number)  # at most SLICE_TERMS terms, or those of one item
    most = max(1, min(SHARD_DOCS, SHARD_CELLS // max(1, len(number))))

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, squeeze = known.value, zstandard.ZstdCompressor(level=1)
        ids, lens, sizes, terms, counts, more = [], [], [], [], [], [0, 0]

        def emit() -> pa.RecordBatch:
            head = np.array([len(ids), len(terms), *more], np.int64).tobytes()
            body = head + np.array(ids, np.int64).tobytes() + np.array(lens, np.int64).tobytes() + np.array(sizes, np.int64).tobytes() + np.array(terms, np.int32).tobytes() + np.array(counts, np.int32).tobytes()
            for x in (ids, lens, sizes, terms, counts):
                x.clear()
            more[:] = 0, 0
            return pa.record_batch([pa.array([squeeze.compress(body)], pa.binary())], ["body"])

        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                words = TERM.findall(t.lower()) if t else []
                if not words:
                    continue
                have: dict[int, int] = {}
                for w in words:
                    k = lookup.get(w)
                    if k is not None:
                        have[k] = have.get(k, 0) + 1
                if not have:
                    more[0] += 1
                    more[1] += len(words)
                    continue
                ids.append(NO_ID if i is None else i)
                lens.append(len(words))
                sizes.append(len(have))
                terms += have.keys()
                counts += have.values()
                if len(ids) >= most:
                    yield emit()
        if ids or more[0]:
            yield emit()
        give_back()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(pack, SHARD_SCHEMA).checkpoint()


class Shard:
    """Documents of one packed shard: ids, lengths, and rows of (term, count)."""

    def __init__(self, body: bytes) -> None:
        raw = zstandard.ZstdDecompressor().decompress(body)
        n, p, self.more_docs, self.more_terms = np.frombuffer(raw, np.int64, 4).tolist()
        at = 32
        self.ids, self.lens, sizes = (np.frombuffer(raw, np.int64, n, at + 8 * n * k) for k in range(3))
        at += 24 * n
        self.terms = np.frombuffer(raw, np.int32, p, at)
        self.counts = np.frombuffer(raw, np.int32, p, at + 4 * p)
        self.rows = np.repeat(np.arange(n), sizes)


def _bodies(batches: Iterable[pa.RecordBatch]) -> Iterator[Shard]:
    for batch in batches:
        for body in batch.column(0).to_pylist():
            yield Shard(body)


def statistics(shards: DataFrame, n_terms: int) -> tuple[int, int, np.ndarray]:
    """(documents with a term, all their terms, documents of each of the items' terms). A task sends one row for each term it met."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, docs, terms = np.zeros(n_terms, np.int64), 0, 0
        for s in _bodies(batches):
            df += np.bincount(s.terms, minlength=n_terms)
            docs += len(s.ids) + s.more_docs
            terms += int(s.lens.sum()) + s.more_terms
        at = np.flatnonzero(df)
        yield pa.record_batch([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(df[at], docs)), pa.array(np.append(np.zeros(len(at), np.int64), terms))], ["term", "df", "terms"])

    df, n, total = np.zeros(n_terms, np.int64), 0, 0
    for r in shards.mapInArrow(count, STATS_SCHEMA).groupBy("term").agg(F.sum("df").alias("df"), F.sum("terms").alias("terms")).collect():
        if r["term"] < 0:
            n, total = r["df"], r["terms"]
        else:
            df[r["term"]] = r["df"]
    return n, total, df


def impacts(shard: Shard, n_docs: int, n_terms: int) -> np.ndarray:
    """What each (term, count) pair of a shard adds to a score for a weight of one."""
    m = 100 - 75 + (75 * shard.lens * n_docs) // max(1, n_terms)
    tf = shard.counts.astype(np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m[shard.rows])


class Blocks:
    """The posting lists of a shard as clusters of alike documents, each with the greatest impact of its documents in every coordinate.

    needed: for each term the terms that an item has beside it; summaries keep no others, as no bound asks for them.
    """

    def __init__(self, shard: Shard, impact: np.ndarray, needed: list[np.ndarray], weights: np.ndarray, cluster: int = CLUSTER) -> None:
        self.ids = shard.ids
        self.dense = np.zeros((len(shard.ids), len(needed)), np.int32)
        self.dense[shard.rows, shard.terms] = impact
        self.top = self.dense.max(axis=0, initial=0).astype(np.int64)
        signs = np.random.default_rng(0).choice(np.array([-1.0, 1.0], np.float32), (len(needed), SKETCH))
        sketch = (self.dense * weights.astype(np.float32)) @ signs
        sketch /= np.maximum(np.linalg.norm(sketch, axis=1, keepdims=True), 1e-9)
        order = np.argsort(shard.terms, kind="stable")
        bounds = np.searchsorted(shard.terms[order], np.arange(len(needed) + 1))
        self.docs: list[np.ndarray] = []
        self.starts: list[np.ndarray] = []
        self.summary: list[np.ndarray | None] = []
        for t in range(len(needed)):
            docs = shard.rows[order[bounds[t] : bounds[t + 1]]]
            k = -(-len(docs) // cluster)
            if k > 1:
                centres = sketch[docs[np.linspace(0, len(docs) - 1, k).astype(np.int64)]]
                near = (sketch[docs] @ centres.T).argmax(axis=1)
                docs = docs[np.argsort(near, kind="stable")]
                n = np.bincount(near, minlength=k)
                starts = (np.cumsum(n) - n)[n > 0]
                self.summary.append(np.maximum.reduceat(self.dense[np.ix_(docs, needed[t])], starts, axis=0))
            else:
                starts = np.zeros(min(1, len(docs)), np.int64)
                self.summary.append(None)
            self.docs.append(docs)
            self.starts.append(np.append(starts, len(docs)))


class Best:
    """The best hits of one item so far: scores, ids, and what a document must reach to be one of them."""

    def __init__(self) -> None:
        self.scores, self.ids = np.empty(0, np.int64), np.empty(0, np.int64)

    def floor(self) -> int:
        return int(self.scores[-1]) if len(self.scores) == TOP else 1

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        keep = scores >= self.floor()
        scores, ids = np.concatenate([self.scores, scores[keep]]), np.concatenate([self.ids, ids[keep]])
        order = np.lexsort((ids, -scores))[:TOP]
        self.scores, self.ids = scores[order], ids[order]


def search(blocks: Blocks, terms: np.ndarray, weight: np.ndarray, needed: list[np.ndarray], best: Best) -> int:
    """Adds the shard's best documents to an item's; returns how many documents were scored. terms ascend; weight holds repeats.

    Lists are left out while the terms left out can't reach the floor together. A cluster of the others is left out when its bound is
    under the floor: equal scores are decided by ids, so a bound that equals the floor is looked into. Clusters go by falling bound.
    """
    top = weight * blocks.top[terms]
    order = np.argsort(top, kind="stable")
    essential = order[np.cumsum(top[order]) >= best.floor()]
    if not len(essential):
        return 0
    bound, docs = [], []
    for k in essential.tolist():
        t = terms[k]
        starts = blocks.starts[t]
        if blocks.summary[t] is not None:
            at = np.searchsorted(needed[t], terms)
            bound.append(blocks.summary[t][:, at].astype(np.int64) @ weight)
        elif len(starts) > 1:
            bound.append(np.array([top.sum()]))
        else:
            continue
        docs += [blocks.docs[t][a:b] for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
    if not docs:
        return 0
    bounds = np.concatenate(bound)
    seen = np.zeros(len(blocks.ids), bool)
    scored = 0
    order = np.argsort(-bounds, kind="stable")
    for at in range(0, len(order), 8):
        some = order[at : at + 8]
        some = some[bounds[some] >= best.floor()]
        if not len(some):
            break
        fresh = np.unique(np.concatenate([docs[k] for k in some.tolist()]))
        fresh = fresh[~seen[fresh]]
        seen[fresh] = True
        scored += len(fresh)
        best.add(blocks.dense[np.ix_(fresh, terms)].astype(np.int64) @ weight, blocks.ids[fresh])
    return scored


def _slice_hits(docs: DataFrame, wanted: list[dict[bytes, int]], number: dict[bytes, int], id_col: str, text_col: str, cluster: int) -> DataFrame:
    shards = shards_of(docs, number, id_col, text_col)
    n, total, df = statistics(shards, len(number))
    weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(d) + 1))) for d in df], np.int64)
    queries = []
    for counts in wanted:
        pairs = np.array(sorted((number[t], c) for t, c in counts.items()), np.int64)
        queries.append((pairs[:, 0], weights[pairs[:, 0]] * pairs[:, 1]))
    shared = docs.sparkSession.sparkContext.broadcast((queries, weights))  # bounded as the slice is

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, weights = shared.value
        with_term: list[list[int]] = [[] for _ in weights]
        for q, (terms, _) in enumerate(queries):
            for t in terms.tolist():
                with_term[t].append(q)
        needed = [np.unique(np.concatenate([queries[q][0] for q in qs])) for qs in with_term]
        best = [Best() for _ in queries]
        for shard in _bodies(batches):
            if len(shard.ids):
                blocks = Blocks(shard, impacts(shard, n, total), needed, weights, cluster)
                for (terms, weight), b in zip(queries, best, strict=True):
                    search(blocks, terms, weight, needed, b)
        item = np.repeat(np.arange(len(best), dtype=np.int32), [len(b.ids) for b in best])
        task = np.full(len(item), TaskContext.get().partitionId() % MERGE, np.int32)
        give_back()
        yield pa.record_batch([pa.array(item), pa.array(task), pa.array(np.concatenate([b.ids for b in best])), pa.array(np.concatenate([b.scores for b in best]))], ["item", "task", "doc_id", "score"])

    return shards.mapInArrow(find, HITS_SCHEMA)


def _top(hits: DataFrame, *keys: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "doc_id")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= TOP)


RESULT = "item_id long, rank int, doc_id long, score long"


def rank_documents(items: DataFrame, docs: DataFrame, item_col: str = "item_id", item_text: str = "text", id_col: str = "doc_id", text_col: str = "text", slice_terms: int = SLICE_TERMS, cluster: int = CLUSTER) -> DataFrame:
    """RESULT: the ten documents of highest score above 0 for each item, equal scores by ascending doc_id.

    Null and empty texts, and texts without terms, have no hits and are none. A row is a document or an item of its own, so a repeated
    doc_id has several places in a ranking and a repeated item_id several rankings. A null doc_id comes last among equal scores.
    Other columns are not read. Empty tables give an empty result.

    Every document is in a shard of its own task and its whole vector in the items' terms is packed once; nothing is dealt by term, so a word of
    every document is a list in each shard. A task sends ten rows for an item, whatever it holds, merged in two steps.
    """
    spark: SparkSession = docs.sparkSession
    checkpoint_dir(spark)
    out = None
    for ids, wanted, number in slices(items, item_col, item_text, slice_terms):
        hits = _top(_top(_slice_hits(docs, wanted, number, id_col, text_col, cluster), "item", "task").drop("rank"), "item")
        names = spark.createDataFrame(list(enumerate(ids)), "item int, item_id long")
        found = hits.join(F.broadcast(names), "item").select("item_id", "rank", F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "score").checkpoint()
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], RESULT)


def digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op12: the ten best documents of each benchmark item."""
    return rank_documents(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), spark.read.parquet(f"{sf_dir}/documents.parquet"))
