"""Catalogues: their schema, shaping of records, and catalogues derived from the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.parts import ARCHIVES, apart, with_part
from ..functions.text import compare_base, display_name, fold, significant_tokens

CATALOG = "source_id long, message_id long, file_id string, filename string, file_size long, posted long, mime_type string, caption string, media_group string"

# One text for both engines: names in six conventions, a third of them posted again.
NAMES = """case l_orderkey % 6
 when 0 then concat('order_', cast(l_orderkey as varchar(20)), '.part', lpad(cast(l_linenumber as varchar(20)), 2, '0'), '.rar')
 when 1 then concat('order_', cast(l_orderkey as varchar(20)), '_x.zip.00', cast(l_linenumber as varchar(20)))
 when 2 then concat('order_', cast(l_orderkey as varchar(20)), '_y.z0', cast(l_linenumber as varchar(20)))
 when 3 then concat('Order-', cast(l_orderkey as varchar(20)), '-Part-0', cast(l_linenumber as varchar(20)), '-SQL.zip')
 when 4 then concat('order_', cast(l_orderkey as varchar(20)), '_set Copy (', cast(l_linenumber as varchar(20)), ').zip')
 else concat('2024.', lpad(cast(l_linenumber as varchar(20)), 2, '0'), '.', cast(10 + l_linenumber as varchar(20)), '.zip') end"""


def shape(raw: DataFrame) -> DataFrame:
    """Records without an id go; names, sizes and extensions get their defaults; zero sizes, dates and empty texts become null."""
    name = F.coalesce(F.nullif("filename", F.lit("")), F.concat(F.lit("(no name) "), F.col("message_id").cast("string")))
    out = raw.where("message_id is not null").withColumn("filename", name)
    out = out.withColumn("extension", F.lower(F.regexp_extract("filename", r"\.([^.]*)$", 1)))
    for c in ("file_size", "posted"):
        out = out.withColumn(c, F.nullif(c, F.lit(0).cast("long")))
    for c in ("caption", "media_group", "file_id"):
        out = out.withColumn(c, F.nullif(c, F.lit("")))
    return out


def upsert_latest(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The latest row of each key, by aggregation (map-side combine) rather than a window."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r"))
    return best.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest]).select(*rows.columns)


def new_rows(rows: DataFrame, seen: int, key: str = "message_id") -> DataFrame:
    return rows.where(F.col(key) > seen)


def with_names(files: DataFrame) -> DataFrame:
    """files with part -> base, tokens, display and is_archive."""
    folded = apart(files.withColumn("__folded", fold(F.col("part.base"))), "__folded")
    out = apart(folded.withColumn("base", compare_base(F.col("__folded"))), "base").drop("__folded").withColumn("tokens", significant_tokens(F.col("base")))
    return out.withColumn("display", display_name(F.col("filename"), F.col("part.base"))).withColumn("is_archive", F.coalesce(F.col("part.container").isin(ARCHIVES), F.lit(False)))


def catalog_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file for each line item; ids follow the order within an order, so no sort spans the table."""
    columns = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
    nth = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*columns))
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", *columns)
    return lines.select((F.col("l_orderkey") * 1000 + nth).alias("message_id"), F.expr(NAMES).alias("filename"), F.floor("l_extendedprice").cast("long").alias("file_size"), F.unix_timestamp(F.col("l_shipdate").cast("timestamp")).alias("posted"), F.concat(F.lit("g"), F.col("l_suppkey").cast("string")).alias("media_group"))


PARTS_SQL = f"""catalog as (
 select l_orderkey * 1000 + row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) as message_id,
  {NAMES} as filename, cast(floor(l_extendedprice) as bigint) as file_size, cast(epoch(cast(l_shipdate as timestamp)) as bigint) as posted,
  concat('g', cast(l_suppkey as varchar)) as media_group from lineitem)"""


def catalog_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file for each document; whole is a digest of all of its text, without case and outer spaces (short texts as they are)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plain = F.trim(F.lower("text"))
    whole = F.when(F.length(plain) >= 2, F.md5(plain)).otherwise(plain).alias("whole")
    return docs.select(F.col("doc_id").alias("message_id"), F.md5("text").alias("file_id"), F.col("n_chars").alias("file_size"), "lang", "source", whole)


DOCS_SQL = "docs as (select doc_id as message_id, md5(text) as file_id, text as whole, n_chars as file_size, lang, source from documents)"


def catalog_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file for each row of part: a set for each name and brand, called by a digest of these, every fifth file spelt a little differently;
    a part number, the size of the part, and its brand as what was posted together."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    own = F.substring(F.md5(F.concat("p_name", "p_brand")), 1, 12)
    spelt = F.when(F.col("p_partkey") % 5 == 0, F.concat(own, F.lit("s"))).otherwise(own)
    name = F.concat(spelt, F.lit(".part0"), (F.col("p_partkey") % 7 + 1).cast("string"), F.lit(".rar"))
    return parts.select(F.col("p_partkey").cast("long").alias("message_id"), name.alias("filename"), F.nullif(F.col("p_size").cast("long"), F.lit(0).cast("long")).alias("file_size"), F.lit(None).cast("long").alias("posted"), F.col("p_brand").alias("media_group"))


def parsed_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_names(with_part(catalog_parts(spark, sf_dir)))


_IN = ", ".join(f"'{c}'" for c in [*ARCHIVES, "pdf", "csv", "txt", "sql"])
# The test names need the families part, nn and z, and the inline form.
PARSED_SQL = f"""{PARTS_SQL},
toks as (select *, list_filter(string_split(filename, '.'), lambda x: x <> '') as every from catalog),
cont as (select *, case when lower(every[-1]) in ({_IN}) then lower(every[-1]) end as c,
  case when lower(every[-1]) in ({_IN}) then every[1:len(every)-1] else every end as toks from toks),
tails as (select *, lower(toks[-1]) as t1, array_to_string(toks[1:len(toks)-1], ' ') as b1 from cont),
fam as (select *, case when regexp_full_match(t1, 'part[-_ ]?[0-9]{{1,4}}') then 'part' when regexp_full_match(t1, 'z[0-9]{{2,3}}') then 'z'
  when regexp_full_match(t1, '[0-9]{{3}}') and not regexp_matches(b1, '[0-9]$') then 'nn'
  when regexp_full_match(t1, '[0-9]{{2}}') and not regexp_matches(b1, '[0-9]$') then 'nn2' end as f, array_to_string(toks, '.') as stem from tails),
parts as (select *, regexp_extract(stem, '(?i)(^|[\\s_./-])part[-_ ]?([0-9]{{1,4}})([\\s_./-]|$)', 2) as inl from fam),
parsed as (select message_id, filename, file_size, posted, media_group,
  case when f is not null then array_to_string(case when lower(toks[-2]) in ({_IN}) then toks[1:len(toks)-2] else toks[1:len(toks)-1] end, '.')
    when inl <> '' then trim(regexp_replace(regexp_replace(stem, '(?i)part[-_ ]?[0-9]{{1,4}}', ' '), '[\\s_-]{{2,}}', ' ', 'g')) else stem end as part_base,
  case when f is not null then f when inl <> '' then 'part' end as family,
  cast(case when f is not null then regexp_extract(t1, '([0-9]+)$', 1) when inl <> '' then inl end as integer) as number,
  case when f is not null and c is null and lower(toks[-2]) in ({_IN}) then lower(toks[-2]) else c end as container,
  (f is null and inl = '' and c is not null) as is_final, case when f is not null then t1 when inl <> '' then 'part' || cast(cast(inl as integer) as varchar) end as label from parts),
peeled as (select *, lower(part_base) as s0 from parsed),
peel1 as (select *, trim(regexp_replace(regexp_replace(regexp_replace(s0, '[\\s_]*\\([0-9]+\\)\\s*$', ' '), '[\\s_]*(?:copy|backup|original|final|old)[\\s_]*[0-9]*\\s*$', ' '), '\\s+', ' ', 'g')) as s1 from peeled),
files as (select * exclude (s0, s1), trim(regexp_replace(s1, '[\\s_./()-]+', ' ', 'g')) as base from peel1)"""
