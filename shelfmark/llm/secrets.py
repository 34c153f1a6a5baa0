"""Secret scans (operator 10): candidates by pattern, told apart by how many owners share them in the whole corpus."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from .exchange import checkpoint_dir

#: Fixed values of the contract: kinds in order, with their patterns and least lengths.
KINDS = ("assign", "access", "hex", "mixed")
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{24,}")
LEAST = {"assign": 6, "access": 20}
#: The method's own kind: long runs of mixed characters with much entropy (bits a character).
MIXED = re.compile(rb"[A-Za-z0-9+/_-]{24,}={0,2}")
MIXED_BITS = 3.6
#: A batch goes through the fast matcher first; texts without a hit are done.
ANY = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]|AKIA[A-Z0-9]{16}|[0-9a-f]{24}|[A-Za-z0-9+/_-]{24}"
#: A value that so many distinct owners hold, or two owners in so many repositories, is an example that is widely copied.
WIDE_OWNERS, WIDE_REPOS = 3, 6

_SPAN = StructType([StructField("kind", IntegerType()), StructField("start", IntegerType()), StructField("stop", IntegerType()), StructField("hash", LongType())])
FOUND = StructType([*[StructField(c, IntegerType()) for c in ("n_assign", "n_access", "n_hex")], StructField("found", ArrayType(_SPAN))])


def entropy(value: bytes) -> float:
    n = np.bincount(np.frombuffer(value, np.uint8))
    p = n[n > 0] / len(value)
    return float(-(p * np.log2(p)).sum())


def mixed_enough(value: bytes) -> bool:
    some = (re.search(rb"[A-Z]", value), re.search(rb"[a-z]", value), re.search(rb"[0-9]", value))
    return all(some) and entropy(value) >= MIXED_BITS


def candidates(text: bytes) -> list[tuple[int, int, int, bytes]]:
    """(kind, start, end, value) with byte offsets, by start and kind; the method's own kind only where no base span is."""
    out = []
    for m in ASSIGN.finditer(text):
        if m.end(2) - m.start(2) >= LEAST["assign"]:
            out.append((0, m.start(), m.end(), m[2]))
    out += [(1, m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    out += [(2, m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
    # spans of one kind don't overlap, so the ones before a place end in the order of their starts, kind by kind
    starts = [[s for k, s, _, _ in out if k == kind] for kind in range(3)]
    ends = [[e for k, _, e, _ in out if k == kind] for kind in range(3)]

    def free(a: int, b: int) -> bool:
        before = [(kind, bisect_left(starts[kind], b)) for kind in range(3)]
        return all(n == 0 or ends[kind][n - 1] <= a for kind, n in before)

    out += [(3, m.start(), m.end(), m[0]) for m in MIXED.finditer(text) if mixed_enough(m[0]) and free(m.start(), m.end())]
    return sorted(out, key=lambda x: (x[1], x[0]))


def scan(docs: DataFrame, text_col: str, repo_col: str, owner_col: str, carried: list[str]) -> DataFrame:
    """row (struct of the carried columns), repo, owner and FOUND of each row; offsets in code points, ends exclusive. The
    struct keeps the columns of docs apart from those of the result, whatever their names."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in carried]).alias("row"), F.col(text_col).cast("string").alias("text"), F.col(repo_col).cast("string").alias("repo"), F.col(owner_col).cast("string").alias("owner"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("hash", pa.int64())]))
        for batch in batches:
            column = batch.column(1)
            texts = column.cast(pa.binary())
            hits = pc.fill_null(pc.match_substring_regex(column, ANY), False).to_pylist()
            counts, found = np.zeros((3, len(hits)), np.int32), [[] for _ in hits]
            for k, hit in enumerate(hits):
                if hit:
                    text = texts[k].as_py()
                    spans = candidates(text)
                    places = np.array([(s, e) for _, s, e, _ in spans]).reshape(-1, 2)
                    if len(spans) and not text.isascii():  # code points before each byte
                        places = np.concatenate([[0], np.cumsum(np.frombuffer(text, np.uint8) & 0xC0 != 0x80)])[places]
                    for c, *_ in spans:
                        if c < 3:
                            counts[c, k] += 1
                    found[k] = [{"kind": c, "start": s, "stop": e, "hash": xxhash.xxh64(v).intdigest() - (1 << 63)} for (c, _, _, v), (s, e) in zip(spans, places.tolist(), strict=True)]
            yield pa.record_batch([batch.column(0), batch.column(2), batch.column(3), *map(pa.array, counts), pa.array(found, kind)], ["row", "repo", "owner", *FOUND.names])

    return rows.mapInArrow(run, StructType([rows.schema["row"], StructField("repo", StringType()), StructField("owner", StringType()), *FOUND.fields]))


def ownership(found: DataFrame) -> DataFrame:
    """For each candidate hash of the corpus: the distinct repositories and owners that hold it, and whether it is widely copied.

    Repeats collapse to distinct (hash, repository, owner) before they are counted, on both sides of the shuffle; a value in a third of
    all rows is a few rows here.
    """
    pairs = found.select(F.explode("found.hash").alias("hash"), "repo", "owner").distinct()
    counted = pairs.groupBy("hash").agg(F.count_distinct("repo").alias("n_repos"), F.count_distinct("owner").alias("n_owners"))
    return counted.withColumn("wide", (F.col("n_owners") >= WIDE_OWNERS) | ((F.col("n_owners") >= 2) & (F.col("n_repos") >= WIDE_REPOS)))


def _with_wide(scanned: DataFrame, few: DataFrame) -> DataFrame:
    """scanned with wide, from the spans of few. What is joined depends on a row's hashes alone, so equal lists of hashes travel once."""
    lists = few.select(F.col("found.hash").alias("hashes"))
    spread = lists.distinct().select("hashes", F.posexplode("hashes").alias("at", "hash"))
    common = ownership(few).where("wide").select("hash")
    wide = spread.join(common, "hash").groupBy("hashes").agg(F.sort_array(F.collect_list(F.col("at") + 1)).alias("wide"))
    wide = wide.withColumn("list", F.xxhash64("hashes"))
    # rows without candidates meet nobody: their keys are spread by what they hold, so that they don't gather in one task
    spread_out = F.when(F.size("found") > 0, F.xxhash64("found.hash")).otherwise(F.xxhash64("row"))
    out = scanned.withColumn("hashes", F.col("found.hash")).withColumn("list", spread_out).join(wide, ["list", "hashes"], "left")
    return out.withColumn("wide", F.coalesce("wide", F.array().cast("array<int>"))).drop("list", "hashes")


RESULT = [*FOUND.names, "wide"]


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "source", owner_col: str = "source") -> DataFrame:
    """Every column of docs but the text, FOUND, and wide: the positions in found, from 1, of widely copied examples.

    A row is a document, repeated ids are separate rows. Null and empty texts: no candidates. A null repository or owner counts as none.
    A column of docs that is named like one of the result gives way to it. An empty table gives an empty one. The texts are read
    once; what is found in them, without the texts, is checkpointed and counted from there.
    """
    checkpoint_dir(docs.sparkSession)
    carried = [c for c in docs.columns if c != text_col and c not in RESULT]
    scanned = scan(docs, text_col, repo_col, owner_col, carried).checkpoint()
    return _with_wide(scanned, scanned.where(F.size("found") > 0)).select("row.*", *RESULT)


def _joined(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def live_spans() -> Column:
    """Spans of found that are not widely copied examples."""
    return F.filter(F.col("found"), lambda s, k: ~F.array_contains(F.col("wide"), (k + 1).cast("int")))


def redact(docs: DataFrame, text_col: str = "text", repo_col: str = "source", owner_col: str = "source") -> DataFrame:
    """Replaces each owner-specific secret by ``<kind>``; widely copied examples stay. The columns of docs are kept, whatever their
    names, and n_chars, where there is one, follows the text. Of overlapping spans the first is replaced up to its end, then what
    is left. Null texts stay null."""
    scanned = scan(docs, text_col, repo_col, owner_col, docs.columns)
    out = _with_wide(scanned, scanned.where(F.size("found") > 0)).withColumn("live", live_spans())
    kinds = F.array(*[F.lit(f"<{k}>") for k in KINDS])
    start = F.struct(F.lit("").alias("done"), F.lit(0).alias("at"))
    text = F.col(f"row.`{text_col}`")

    def step(acc: Column, s: Column) -> Column:
        a = F.greatest(acc["at"], s["start"])
        done = F.concat(acc["done"], F.substring(text, acc["at"] + 1, a - acc["at"]), F.when(s["stop"] > a, F.element_at(kinds, s["kind"] + 1)).otherwise(""))
        return F.struct(done.alias("done"), F.greatest(acc["at"], s["stop"]).alias("at"))

    clean = F.aggregate("live", start, step, lambda acc: F.concat(acc["done"], F.substring(text, acc["at"] + 1, F.char_length(text))))
    some = F.size("live") > 0
    columns = {c: F.col(f"row.`{c}`") for c in docs.columns}
    columns[text_col] = F.when(some, clean).otherwise(text)
    if "n_chars" in columns:
        columns["n_chars"] = F.when(some, F.char_length(clean).cast(docs.schema["n_chars"].dataType)).otherwise(columns["n_chars"])
    return out.select(*[v.alias(c) for c, v in columns.items()])


def digest(spark, sf_dir: str) -> DataFrame:
    """Query op10: counts of base secrets, a digest of their spans, all spans, and how many look live. The owner of a document is its
    source; a repository is what a source has in one language."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", F.concat_ws("/", "source", "lang").alias("repository"))
    base = F.filter("found", lambda s: s["kind"] < 3)
    out = find_secrets(docs, repo_col="repository")
    return out.select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("n_assign", "n_access", "n_hex")], F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"), F.size(live_spans()).cast("long").alias("n_live"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: owner-specific secrets are replaced; no document goes. Reads text, source and lang. Rows without an id, text, source or
    language stay, repeated ones too, and all columns come back; an empty table gives an empty one."""
    name = "repository"
    while name in docs.columns:
        name += "_"
    named = docs.withColumn(name, F.concat_ws("/", "source", "lang"))
    return redact(named, repo_col=name).select(*docs.columns)
