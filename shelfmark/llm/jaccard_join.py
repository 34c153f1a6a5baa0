"""N-gram Jaccard join (operator 2): a grouped prefix join over sets of word shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from . import arrays as A
from .exchange import Chunk, apply_levels, chunk_table, each_chunk, key_levels, width, with_answers

SHINGLE_WORDS = 5
#: Two sets link when PARTS * intersection >= NEED * union.
NEED, PARTS = 80, 100
#: Leaders of a list, one in the first round, grow by this factor from round to round, until all members of a list have led.
MORE_LEADERS = 64
#: Lists are cut into cells of about 2 ** CELL_BITS members at most.
CELL_BITS = 9


def shingle_sets(chunk: Chunk, k: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one text after the other, and the bounds of each text's."""
    data = A.lower_ascii(chunk.data)
    begin, end, first = A.word_bounds(data, chunk.offsets)
    prefix = A.prefix_sums(A.word_hashes(data, begin, end))
    n = np.diff(first)
    many = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    start = A.spread(first[:-1], many)
    owner = np.repeat(np.arange(len(n)), many)
    hashes = A.range_hash(prefix, start, start + np.minimum(k, n[owner]))
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
    hashes, owner = hashes[new], owner[new]
    return hashes, np.searchsorted(owner, np.arange(len(n) + 1))


def _sums(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that stand for each set."""
    out = []
    for x in (A.mix(hashes), A.mix(hashes ^ A.U64(0xA5A5A5A5))):
        total = np.concatenate([np.zeros(1, A.U64), np.cumsum(x, dtype=A.U64)])
        out.append((total[bounds[1:]] - total[bounds[:-1]]).view(np.int64))
    return out[0], out[1]


def needed_overlap(a: Column, b: Column) -> Column:
    """Least intersection of two sets of these sizes that link."""
    return F.ceil(NEED * (a + b) / F.lit(PARTS + NEED))


def prefix_length(n: np.ndarray) -> np.ndarray:
    return n - -(-NEED * n // PARTS) + 1


SIZES = pa.schema([("chunk", pa.int64()), ("place", pa.int32()), ("id", pa.int64()), ("n", pa.int64()), ("sum1", pa.int64()), ("sum2", pa.int64())])


def _measure(chunk: Chunk) -> Iterator[tuple]:
    """Place, id, size and sums of the set of each text."""
    hashes, bounds = shingle_sets(chunk)
    one, two = _sums(hashes, bounds)
    yield from zip([chunk.key] * len(chunk.ids), range(len(chunk.ids)), chunk.ids.tolist(), np.diff(bounds).tolist(), one.tolist(), two.tolist(), strict=True)


class Sets:
    """Sets of the texts of a chunk that stand for all texts with the same set."""

    def __init__(self, chunk: Chunk, answers: list[dict]) -> None:
        hashes, bounds = shingle_sets(chunk)
        n = np.diff(bounds)
        chosen = np.zeros(len(n), dtype=bool)
        chosen[[int(r["body"]) for r in answers if r["kind"] == 9]] = True
        self.texts = np.flatnonzero(chosen)
        self.ids, self.n = chunk.ids[self.texts], n[self.texts]
        self.hashes = hashes[np.repeat(chosen, n)]
        self.bounds = np.concatenate([[0], np.cumsum(self.n)])

    def prefixes(self, levels: np.ndarray) -> None:
        """The first shingles of each set, rare ones first, with their levels."""
        owner = np.repeat(np.arange(len(self.n)), self.n)
        order = np.lexsort((self.hashes, levels, owner))
        self.shareable = np.bincount(owner[levels > 0], minlength=len(self.n))
        size = prefix_length(self.n)
        self.pos = A.spread(np.zeros(len(self.n), np.int64), size)
        self.owner = np.repeat(np.arange(len(self.n)), size)
        at = order[self.bounds[self.owner] + self.pos]
        self.tokens, self.levels = self.hashes[at], levels[at]


NODES = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("shareable", pa.int64()), ("prefix_group", pa.int64()), ("tokens", pa.binary()), ("levels", pa.binary()), ("pos", pa.binary()), ("chunk", pa.int64()), ("place", pa.int32())])


def _candidates(chunks: DataFrame, chosen: DataFrame) -> DataFrame:
    """A row for each distinct set with prefix shingles that others may have: these and their places, and where the text is.

    Shingles of one owner come first in the order. shareable counts the others, so that no set has more than that in common with another.
    """
    buckets = 4 * width(chunks.sparkSession)

    def shingles(chunk: Chunk, answers: list[dict]) -> tuple[np.ndarray, np.ndarray]:
        sets = Sets(chunk, answers)
        return sets.hashes, np.repeat(sets.ids, sets.n)

    def nodes(chunk: Chunk, answers: list[dict]) -> Iterator[tuple]:
        sets = Sets(chunk, answers)
        sets.prefixes(apply_levels(sets.hashes, answers, buckets))
        on = sets.levels > 0
        bounds = np.searchsorted(sets.owner, np.arange(len(sets.n) + 1))
        every = A.prefix_sums(sets.tokens)
        group = A.mix(A.range_hash(every, bounds[:-1], bounds[1:]) + sets.n.astype(A.U64)).view(np.int64)
        for k in np.unique(sets.owner[on]).tolist():
            a, b = bounds[k], bounds[k + 1]
            at = a + np.flatnonzero(on[a:b])
            yield int(sets.ids[k]), int(sets.n[k]), int(sets.shareable[k]), int(group[k]), sets.tokens[at].tobytes(), sets.levels[at].tobytes(), sets.pos[at].astype(np.int32).tobytes(), chunk.key, int(sets.texts[k])

    levels = key_levels(chunks, shingles, buckets, chosen)
    return with_answers(chunks, levels.unionByName(chosen), nodes, "node long, n long, shareable long, prefix_group long, tokens binary, levels binary, pos binary, chunk long, place int", NODES).checkpoint()


#: What a list has of each group, besides its shingle. A group is named by the node that stands for it.
ENTRY = ["node", "n", "shareable", "pos"]
#: What deals a list. Its cells are numbered from 0, and a member's is a hash of its name.
CELL = ["token", "cells", "cell"]


def _companions(nodes: DataFrame) -> DataFrame:
    """(group, node): nodes of one prefix and size as another one, the least of them, which stands for the group."""
    key = ["prefix_group", "n"]
    many = nodes.groupBy(*key).agg(F.min("node").alias("group"), F.count("*").alias("members")).where("members > 1").drop("members")
    return nodes.select("node", *key).join(many, key).where("node <> group").select("group", "node")


def _every_cell(lists: DataFrame) -> DataFrame:
    """Rows of whole lists, once for each cell of their list."""
    return lists.withColumn("cell", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))


def _token_rows(groups: DataFrame) -> DataFrame:
    """A row for each shingle in a group's prefix that another group has in its own.

    The level of a shingle bounds the length of its list (to a factor of two) before any list is made, and is the same wherever the shingle
    is; so every row knows by itself how many cells its list has and which it belongs to, and no step deals a long list by its shingle alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, levels, pos = ([np.frombuffer(x, t) for x in batch.column(c).to_pylist()] for c, t in (("tokens", np.int64), ("levels", np.uint8), ("pos", np.int32)))
            which = np.repeat(np.arange(batch.num_rows), [len(t) for t in tokens])
            plain = batch.select(["node", "n", "shareable"]).take(pa.array(which))
            flat = [np.concatenate([np.empty(0, t), *parts]).astype(t) for t, parts in ((np.int64, tokens), (np.int32, levels), (np.int32, pos))]
            yield pa.record_batch([pa.array(flat[0]), pa.array(flat[1]), *plain.columns, pa.array(flat[2])], ["token", "level", "node", "n", "shareable", "pos"])

    rows = groups.select("node", "n", "shareable", "tokens", "levels", "pos").mapInArrow(run, "token long, level int, node long, n long, shareable long, pos int")
    # no list has 2 ** 31 cells: that were 2 ** 40 sets with one shingle
    cells = F.pow(F.lit(2), F.greatest(F.col("level") - CELL_BITS, F.lit(0))).cast("int")
    rows = rows.withColumn("cells", cells).withColumn("cell", F.pmod(F.xxhash64("node"), "cells").cast("int"))
    listed = _every_cell(rows.groupBy("token", "cells").count().where("count > 1").drop("count"))
    return rows.join(listed, CELL, "left_semi").select(*CELL, *ENTRY)


def _promising(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs of groups whose common prefix shingles, all of them, leave room for a link: these up to the last, and at most the shorter rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for r in batch.to_pylist():
                t, u = np.frombuffer(r["tokens"], np.int64), np.frombuffer(r["tokens2"], np.int64)
                _, i, j = np.intersect1d(t, u, return_indices=True)
                rest = min(r["n"] - np.frombuffer(r["pos"], np.int32)[i].max(), r["n2"] - np.frombuffer(r["pos2"], np.int32)[j].max()) - 1
                ok.append(bool(len(i) + rest >= -(-NEED * (r["n"] + r["n2"]) // (PARTS + NEED))))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    columns = ["n", "tokens", "pos"]
    left = nodes.select(F.col("node").alias("a"), *columns)
    right = nodes.select(F.col("node").alias("b"), *[F.col(c).alias(f"{c}2") for c in columns])
    return pairs.join(left, "a").join(right, "b").mapInArrow(run, "a long, b long")


SET = pa.schema([("node", pa.int64()), ("hashes", pa.binary())])
PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _verify(pairs: DataFrame, nodes: DataFrame, chunks: DataFrame) -> DataFrame:
    """(a, b) of those pairs of nodes whose sets link. The chunks of the b side send each of its sets once to each chunk of the a side
    that asks for it, so the side with few nodes in many pairs should be b."""

    def sets_at(chunk: Chunk, places: set[int]) -> dict[int, np.ndarray]:
        some = sorted(places)
        hashes, bounds = shingle_sets(Chunk.of(chunk.key, chunk.ids[some], [chunk.text(k) for k in some]))
        return {k: hashes[bounds[i] : bounds[i + 1]] for i, k in enumerate(some)}

    def send(chunk: Chunk, rows: list[dict]) -> Iterator[tuple]:
        if rows:
            for k, hashes in sets_at(chunk, {r["place"] for r in rows}).items():
                yield int(chunk.ids[k]), hashes.tobytes()

    def compare(chunk: Chunk, rows: list[dict]) -> Iterator[tuple]:
        mine = sets_at(chunk, {w["place"] for r in rows for w in r["wanted"]}) if rows else {}
        for r in rows:
            other = np.frombuffer(r["hashes"], A.U64)
            for w in r["wanted"]:
                both = np.sort(np.concatenate([mine[w["place"]], other]))
                common = int((both[1:] == both[:-1]).sum())
                if PARTS * common >= NEED * (len(both) - common):
                    yield w["a"], r["b"]

    at = nodes.select("node", "chunk", "place")
    # pairs of one b that one chunk holds: as many as a chunk has texts at most
    asked = pairs.join(at.withColumnRenamed("node", "a"), "a").groupBy("chunk", "b").agg(F.collect_list(F.struct("a", "place")).alias("wanted"))
    needed = at.join(pairs.select(F.col("b").alias("node")).distinct(), "node", "left_semi").select("chunk", "place")
    sets = with_answers(chunks, needed, send, "node long, hashes binary", SET).withColumnRenamed("node", "b")
    return with_answers(chunks, asked.join(sets, "b"), compare, "a long, b long", PAIR)


def _possible() -> Column:
    """Size and position filter for two groups that have a shingle at these places of their order.

    It holds wherever the shingle is the first that both have, as then all they have in common lies in the shorter rest. Every two sets
    that link meet at that shingle too, so those that fail at a later one aren't lost.
    """
    return F.least(_rest(), _rest("2")) >= needed_overlap(F.col("n"), F.col("n2"))


def _rest(of: str = "") -> Column:
    return F.col("n" + of) - F.col("pos" + of)


def _undecided(lists: DataFrame) -> DataFrame:
    """Members of lists that aren't one component, without those that no other member could link to; length is that of their list.

    What is known of a list as a whole is summed up in two steps and told to each of its cells.
    """
    best = lists.groupBy("token", "cells").agg(F.min("n").alias("least"), F.max(_rest()).alias("most"))
    some = lists.join(_every_cell(best), CELL).where(F.least(_rest(), F.col("most")) >= needed_overlap(F.col("n"), F.col("least")))
    open_ = some.groupBy("token", "cells").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("length")).where("lo < hi").select("token", "cells", "length")
    return some.join(_every_cell(open_), CELL).select(*CELL, *ENTRY, "component", "length")


def _partner(names: list[str], of: str = "") -> list[Column]:
    """Columns of the other side of a pair."""
    new = {"node": "b"}
    return [F.col(of + c).alias(new.get(c, f"{c}2")) for c in names]


def _leaders(lists: DataFrame, k: int, times: int) -> DataFrame:
    """(token, cells, leader) of each list: in the first round the member with the fewest shingles of its own, as that links to most others; then
    about ``times`` members by a hash of the round, and all of a list that isn't longer."""
    entry = F.struct(*ENTRY, "component")
    if k == 0:
        own = (F.col("n") - F.col("shareable")) / F.col("n")
        return lists.groupBy("token", "cells").agg(F.min_by(entry, F.struct(own, F.xxhash64("node"))).alias("leader"))
    drawn = F.pmod(F.xxhash64("node", F.lit(k)), F.lit(1 << 30)) * F.col("length").cast("double") < float(times * (1 << 30))
    return lists.where(drawn).select("token", "cells", entry.alias("leader"))


def linked_nodes(nodes: DataFrame, chunks: DataFrame) -> DataFrame:
    """(node, component) of the nodes that have a link.

    Nodes with one prefix and size collapse into a group, named by its least node; members whose set links to that node's stay in the
    group, the others become groups of their own. Groups with a prefix shingle in common form pairs, which the filters on
    size, position and all common prefix shingles must pass; then the pair is expanded: the nodes that stand for the groups are
    verified, and, where these don't link, all other members.

    In each round some groups lead the list of a shingle: those that could link to a leader and aren't yet connected with it form
    pairs, and the leaders leave the list. Lists that are connected as a whole are done, and so are groups that no other of
    the list could link to, so a large cluster of near copies costs a few comparisons for each of its groups. The rounds go on,
    with more leaders each, until no list is left, so no link that could change a component is left out.
    """
    companions = _companions(nodes).checkpoint()
    links = _verify(companions.select(F.col("node").alias("a"), F.col("group").alias("b")), nodes, chunks).checkpoint()
    held = links.select(F.col("a").alias("node"), F.col("b").alias("group"))
    groups = nodes.join(held.select("node"), "node", "left_anti")
    members = held.unionByName(held.select(F.col("group").alias("node"), "group").distinct())
    lists = _token_rows(groups).checkpoint()
    labels, k, times = None, 0, 1
    while True:
        if not links.isEmpty():
            before = links if labels is None else links.unionByName(labels.select(F.col("node").alias("a"), F.col("component").alias("b")))
            labels = connected_components(before, "a", "b").checkpoint()
        now = lists.withColumn("component", F.col("node"))
        if labels is not None:
            now = lists.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
        now = _undecided(now).checkpoint()
        if now.isEmpty():
            return labels if labels is not None else nodes.select("node", F.col("node").alias("component")).where("1 = 0")
        entry = [*ENTRY, "component"]
        leaders = _leaders(now, k, times)
        met = now.join(_every_cell(leaders), CELL).where("node <> leader.node").select("token", *entry, *_partner(entry, "leader.")).where("component <> component2")
        # b is a leader: its set goes to the members' chunks, as the chunk of one that leads a long list couldn't take the sets of all members
        both = met.where(_possible()).groupBy(F.least("node", "b").alias("lo"), F.greatest("node", "b").alias("hi")).agg(F.max("b").alias("b"))
        pairs = _promising(both.select(F.when(F.col("b") == F.col("hi"), F.col("lo")).otherwise(F.col("hi")).alias("a"), "b"), nodes).checkpoint()
        links = _verify(pairs, nodes, chunks).checkpoint()
        rest = pairs.join(links, ["a", "b"], "left_anti")
        side = lambda c: members.select(F.col("group").alias(c), F.col("node").alias(f"of_{c}"))
        wide = rest.join(side("a"), "a", "left").join(side("b"), "b", "left").where("of_a is not null or of_b is not null")
        wide = wide.select(F.coalesce("of_a", "a").alias("a2"), F.coalesce("of_b", "b").alias("b2"), "a", "b").where("a2 <> a or b2 <> b").select(F.col("a2").alias("a"), F.col("b2").alias("b")).checkpoint()
        if not wide.isEmpty():
            links = links.unionByName(_verify(wide, nodes, chunks)).checkpoint()
        lists = now.join(leaders.select("token", F.col("leader.node").alias("node")), ["token", "node"], "left_anti").select(*CELL, *ENTRY)
        k, times = k + 1, times * MORE_LEADERS


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles and component_id of every input row: the least id reachable over links of a Jaccard similarity of 0.8 or more.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case; a set holds the distinct shingles of 5 words, or the whole sequence where
    there are fewer. Null text and texts without words: an empty set, linked with nothing. Rows of one id count as one document. A
    null id counts as larger than any other and comes back as null (as does the component of such rows alone). Other columns
    are ignored. Equal sets collapse before the join (by size and 128 bits of hash sums).
    """
    chunks = chunk_table(docs, id_col, text_col)
    texts = each_chunk(chunks, _measure, "chunk long, place int, id long, n long, sum1 long, sum2 long", SIZES).checkpoint()
    key = ["n", "sum1", "sum2"]
    sets = texts.where("n > 0").groupBy(*key).agg(F.min(F.struct("id", "chunk", "place")).alias("first"))
    sets = sets.select(*key, "first.*").checkpoint()
    chosen = sets.select(F.lit(0).alias("bucket"), "chunk", F.lit(9).alias("kind"), F.col("place").cast("string").cast("binary").alias("body"))
    labels = linked_nodes(_candidates(chunks, chosen), chunks)
    sets = sets.select(*key, F.col("id").alias("node")).join(labels, "node", "left").select(*key, F.coalesce("component", "node").alias("component"))
    # rows of one id are one document, whichever of their sets is linked
    out = texts.join(sets, key, "left").withColumn("component", F.coalesce("component", "id"))
    known = lambda c: F.when(F.col(c) != A.NO_ID, F.col(c))
    return out.select(known("id").alias(id_col), F.col("n").alias("n_shingles"), known("component").alias("component_id"))


def digest(spark, sf_dir: str) -> DataFrame:
    """Query op2."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near duplicates the document with the least id stays. Rows without an id stay, rows that repeat an id stay
    or go together, texts without words are near nothing; an empty table gives an empty one."""
    groups = near_duplicates(docs).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(groups, "doc_id", "left_anti")
