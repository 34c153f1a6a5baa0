"""Parsing, names, rules, exact duplicates and sizes of derived catalogues."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.similarity import indel_ratio, levenshtein_ratio, partial_ratio, token_set_ratio, weighted_ratio
from ..functions.text import bar, colour, eta, flag, fold, human_size, long_size, safe_title, stable_key
from ..operators import blocking, groups, rollups
from ..operators.country import GAZETTEER, detect_countries, gazetteer
from ..sources.catalog import DOCS_SQL, PARSED_SQL, catalog_docs, parsed_parts, upsert_latest

SERVICES = ["ththe", "yandex", "udemy", "therhe"]


def pages(spark, sf):
    return spark.read.parquet(f"{sf}/pages.parquet").select(F.col("page_id").alias("message_id"), F.regexp_replace("url", "^https?://", "").alias("filename"), F.length("html").cast("long").alias("file_size"))


PAGES_SQL = "pages_ as (select page_id as message_id, regexp_replace(url, '^https?://', '') as filename, cast(length(html) as bigint) as file_size from pages)"


def parsed(spark, sf):
    return parsed_parts(spark, sf).select("message_id", F.col("part.base").alias("part_base"), "part.family", "part.number", "part.container", "part.is_final", "base")


def incomplete_sets(spark, sf):
    """The 25 largest sets, with how many of their parts are missing."""
    f = parsed_parts(spark, sf).where("part.number is not null")
    g = f.groupBy("base").agg(F.count("*").alias("n_files"), F.count_distinct("part.number").alias("n_parts"), F.min("part.number").alias("lo"), F.max("part.number").alias("hi"), F.sum("file_size").alias("total_size"))
    g = g.withColumn("n_missing", F.when(F.col("lo").isin(0, 1), F.col("hi") - F.col("lo") + 1 - F.col("n_parts")).otherwise(0).cast("long"))
    return g.orderBy(F.desc("total_size"), "base").limit(25)


def doc_duplicates(spark, sf):
    """Documents have no names, so what must agree besides the size is the whole text, not its opening."""
    return groups.exact_duplicates(catalog_docs(spark, sf).withColumn("base", F.col("whole")))


def doc_fingerprints(spark, sf):
    d = doc_duplicates(spark, sf)
    return d.select(F.concat_ws(":", "kind", F.col("canonical").cast("string")).alias("fingerprint"), F.col("message_id").alias("duplicate"))


DUP_SQL = f"""{DOCS_SQL}, based as (select *, trim(lower(whole)) as base from docs),
firsts as (select *, min(message_id) over (partition by file_id) as one,
  case when length(base) >= 2 and file_size is not null then min(message_id) over (partition by base, file_size) end as two from based),
dups as (select message_id, case when one < message_id then one else two end as canonical, case when one < message_id then 'file_id' else 'name_slot' end as kind,
  case when one < message_id then 1.0::double else 0.95::double end as confidence from firsts where one < message_id or coalesce(two, message_id) < message_id)"""


def kept_docs(spark, sf):
    docs = catalog_docs(spark, sf)
    kept = groups.kept_members(docs.select("message_id", "source", "file_size"), doc_duplicates(spark, sf))
    return kept.groupBy("source").agg(F.count("*").alias("n_files"), F.sum("file_size").alias("total_size"))


def sizes(spark, sf):
    p = pages(spark, sf)
    return p.select("message_id", human_size(F.col("file_size") * 1000).alias("size"), long_size(F.col("file_size") * 123_457_789).alias("long_size"), colour(F.col("filename")).alias("colour"), safe_title(F.col("filename"), 20).alias("title"), eta(F.col("file_size") * 60).alias("eta"), bar(F.col("file_size") % 21, F.lit(20)).alias("bar"))


# Halves round up in Spark's format, so decimals are computed rather than printed; all figures here are whole bytes.
_TENTHS = lambda b, unit: f"(({b} * 20 + {unit}) // {2 * unit})"
_ONE = lambda b, unit, label: f"{_TENTHS(b, unit)} // 10 || '.' || {_TENTHS(b, unit)} % 10 || ' {label}'"
_COMMAS = lambda b, unit, label: f"format('{{:,}}', cast({_TENTHS(b, unit)} // 10 as bigint)) || '.' || {_TENTHS(b, unit)} % 10 || ' {label}'"
SIZES_SQL = f"""with {PAGES_SQL}, s as (select *, cast(file_size as hugeint) * 1000 as b, cast(file_size as hugeint) * 123457789 as l, file_size * 60 as sec, file_size % 21 as d from pages_)
select message_id, case when b < 1024 then b || ' B' when b < 1048576 then {_ONE("b", 1024, "KB")} when b < 1073741824 then {_ONE("b", 1048576, "MB")} when b < 1099511627776 then {_ONE("b", 1073741824, "GB")} else {_ONE("b", 1099511627776, "TB")} end as size,
 case when l < 1024 then format('{{:,}}', cast(l as bigint)) || ' B' when l < 1048576 then {_COMMAS("l", 1024, "KB")} when l < 1073741824 then {_COMMAS("l", 1048576, "MB")} when l < 1099511627776 then {_COMMAS("l", 1073741824, "GB")} when l < 1125899906842624 then {_COMMAS("l", 1099511627776, "TB")} else {_COMMAS("l", 1125899906842624, "PB")} end as long_size,
 cast(list_sum(list_transform(string_split(filename, ''), lambda c: ord(c))) % 9 as integer) as colour, coalesce(nullif(trim(substr(trim(regexp_replace(filename, '\\s+', ' ', 'g')), 1, 20)), ''), 'Untitled') as title,
 case when sec // 86400 > 0 then (sec // 86400) || 'd' else '' end || case when sec >= 3600 then (sec % 86400 // 3600) || 'h' else '' end || (sec % 3600 // 60) || 'm' as eta,
 repeat('#', cast(d as integer)) || repeat('.', cast(20 - d as integer)) as bar from s"""


def rules(spark, sf):
    p = pages(spark, sf).withColumn("folded", fold(F.col("filename")))
    d = groups.domain(F.col("folded"), SERVICES)
    return p.select("message_id", groups.hold_reason(F.col("folded"), ["tion", "held back", "leak"]).alias("hold"), groups.has_keyword(F.col("folded"), ["fee", "the"]).alias("tagged"), groups.category(F.col("folded"), F.col("message_id") % 2 == 0).alias("category"), d["name"].alias("domain"), d["confidence"].alias("domain_confidence"))


RULES_SQL = f"""with {PAGES_SQL}, f as (select *, lower(filename) as folded, regexp_extract_all(lower(filename), '[a-z0-9]+') as words,
  regexp_extract_all(lower(filename), '[a-z0-9][a-z0-9-]*(?:\\.[a-z0-9-]+)+') as dotted from pages_),
u as (select *, list_filter(dotted, lambda d: not list_bool_or(list_transform(string_split(d, '.'), lambda x: length(x) = 1)) and (string_split(d, '.')[1] in ('ththe', 'yandex', 'udemy', 'therhe') or length(string_split(d, '.')[-1]) in (2, 3))) as ok,
  list_sort(list_filter(words, lambda w: w in ('ththe', 'yandex', 'udemy', 'therhe'))) as known from f)
select message_id, case when regexp_matches(folded, '(^|[^a-z0-9])tion') then 'tion' when contains(folded, 'held back') then 'held back' when regexp_matches(folded, '(^|[^a-z0-9])leak') then 'leak' end as hold,
 len(list_filter(words, lambda w: starts_with(w, 'fee') or starts_with(w, 'the'))) > 0 as tagged,
 case {" ".join("when len(list_filter(words, lambda w: w in (" + ", ".join(f"'{w}'" for w in k) + f"))) > 0 then '{label}'" for label, k in groups.CATEGORIES)} when message_id % 2 = 0 then 'Databases / Datasets' else 'Miscellaneous' end as category,
 case when len(ok) > 0 then case when string_split(ok[1], '.')[1] in ('ththe', 'yandex', 'udemy', 'therhe') then string_split(ok[1], '.')[1] else ok[1] end when len(known) > 0 then known[1] end as domain,
 cast(case when len(ok) > 0 then case when string_split(ok[1], '.')[1] in ('ththe', 'yandex', 'udemy', 'therhe') then 0.85 else 0.70 end when len(known) > 0 then 0.80 else 0.0 end as double) as domain_confidence from u"""


#: The gazetteer, and two places called by words that the invented prose of the tables has, so that every level of evidence occurs.
PLACES = [*GAZETTEER, ("xa", "Exland", "thin_the the_estion", "com 0", "heed thntre"), ("xb", "Wyland", "ble essen thntr", "net", "thheed ntre"), ("xc", "Zedland", "mente_del laosb", "org 12", "estion_the raque")]


def country_docs(spark, sf):
    """The country that each whole document speaks of, for those that speak of one."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return detect_countries(docs, gazetteer(spark, PLACES), "doc_id").withColumnRenamed("id", "doc_id")


def document_facets(spark, sf):
    """Documents and characters by language, source and the country that they surely speak of, in one aggregation."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sure = country_docs(spark, sf).where("confidence >= 0.75").select("doc_id", F.col("code").alias("country"))
    return rollups.facets(docs.join(sure, "doc_id", "left"), ["lang", "source", "country"], F.count("*").alias("n"), F.sum("n_chars").alias("n_chars"))


_ENTRIES = [(a.replace("_", " "), "word", code, rank, (0.95 if "_" in a or len(a) >= 4 else 0.80), 1) for rank, (code, _, aliases, _, _) in enumerate(PLACES) for a in aliases.split()]
_ENTRIES += [(t, "top", code, rank, 0.70, 2) for rank, (code, _, _, tops, _) in enumerate(PLACES) for t in tops.split()]
_ENTRIES += [(c.replace("_", " "), "word", code, rank, (0.60 if "_" in c else 0.55), 3) for rank, (code, _, _, _, cities) in enumerate(PLACES) for c in cities.split()]
COUNTRY_SQL = rf"""with terms(term, kind, code, rank, confidence, level) as (values {", ".join(f"('{t}', '{k}', '{c}', {r}, {f}::double, {n})" for t, k, c, r, f, n in _ENTRIES)}),
names(code, name) as (values {", ".join(f"('{p[0]}', '{p[1]}')" for p in PLACES)}, ('ru', null), ('il', null)),
t as (select doc_id, lower(text) as s, list_filter(string_split(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '') as w from documents),
spots as (select doc_id, w, unnest(range(1, len(w) + 1)) as i from t),
grams as (select doc_id, w[i] as term, false as guarded from spots union all select doc_id, w[i] || ' ' || w[i + 1], coalesce(w[i - 1] in ('south', 'north', 'central') and i > 1, false) from spots where i < len(w)),
tops as (select doc_id, string_split(d, '.')[-1] as term from (select doc_id, unnest(regexp_extract_all(s, '[a-z0-9][a-z0-9-]*(?:\.[a-z0-9-]+)+')) as d from t)),
hits as (select doc_id, code, level, confidence from grams join terms using (term) where kind = 'word' and not guarded union select doc_id, code, level, confidence from tops join terms using (term) where kind = 'top'),
best as (select doc_id, code, arg_min(confidence, level * 10 - confidence) as confidence from hits group by all),
scripts as (select doc_id, 'ru' as code, 0.35 as confidence from t where regexp_matches(s, '[\x{{0400}}-\x{{04FF}}]') union all select doc_id, 'in', 0.35 from t where regexp_matches(s, '[\x{{0900}}-\x{{097F}}]') union all select doc_id, 'il', 0.40 from t where regexp_matches(s, '[\x{{0590}}-\x{{05FF}}]')),
evidence as (select doc_id, code, max(confidence) as confidence, count(*) as reasons from (select * from best union all select * from scripts) group by all),
ranked as (select *, row_number() over v as place, lead(confidence) over v as second from evidence left join (select code, min(rank) as rank from terms group by code) using (code) window v as (partition by doc_id order by confidence desc, rank nulls last, code))
select doc_id, code, name, cast(round(case when second >= 0.50 and confidence - second < 0.15::double then least(confidence, 0.60) when second is not null and reasons >= 2 then least(0.99, confidence + 0.08) else confidence end, 2) as double) as confidence
from ranked left join names using (code) where place = 1"""


FACETS_SQL = f"""with c as ({COUNTRY_SQL}), d as (select lang, source, n_chars, c.code as country from documents left join c on c.doc_id = documents.doc_id and c.confidence >= 0.75)
select case when grouping(lang) = 0 then 'lang' when grouping(source) = 0 then 'source' else 'country' end as facet, coalesce(lang, source, country) as value, count(*) as n, cast(sum(n_chars) as bigint) as n_chars from d group by grouping sets ((lang), (source), (country))"""


def size_candidates(spark, sf):
    """Names of one size that differ in at most a tenth of their letters, in the catalogue of parts."""
    return blocking.same_size_pairs(parsed_parts(spark, sf))


SIZE_SQL = f"""with {PARSED_SQL}, n as (select file_size, base, min(message_id) as id, count(*) as files from files where file_size is not null and base <> '' group by all)
select x.file_size, x.id as a, y.id as b, x.base as name_a, y.base as name_b, x.files as n_a, y.files as n_b, round(1 - levenshtein(x.base, y.base) / cast(greatest(length(x.base), length(y.base)) as double), 6) as likeness
from n x join n y on x.file_size = y.file_size and x.id < y.id where levenshtein(x.base, y.base) * 10 <= greatest(length(x.base), length(y.base))"""


def fuzzy_names(spark, sf):
    """Names of parts against names that share their second word: the four Arrow-batched ratios."""
    names = spark.read.parquet(f"{sf}/part.parquet").select("p_name").distinct().select("p_name", F.element_at(F.split("p_name", " "), -1).alias("word"))
    pairs = names.join(names.select(F.col("p_name").alias("other"), "word"), "word").where("p_name < other")
    a, b = F.col("p_name"), F.col("other")
    return pairs.select("p_name", "other", *[F.round(f(a, b), 6).alias(n) for n, f in (("indel", indel_ratio), ("part", partial_ratio), ("token_set", token_set_ratio), ("weighted", weighted_ratio))])


def latest_by_source(spark, sf):
    docs = catalog_docs(spark, sf)
    return upsert_latest(docs.select("source", "lang", "message_id", "file_size"), ["source", "lang"], F.col("message_id"))


def column_counts(spark, sf):
    docs = catalog_docs(spark, sf)
    return docs.groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("file_id").alias("n_texts"), F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("langs"))


def keys_and_flags(spark, sf):
    nation = spark.read.parquet(f"{sf}/nation.parquet")
    return nation.select("n_name", stable_key(F.col("n_name")).alias("key"), flag(F.substring("n_name", 1, 2)).alias("flag"))


QUERIES = {
    "parsed_parts": parsed, "incomplete_sets": incomplete_sets, "doc_duplicates": doc_duplicates, "doc_fingerprints": doc_fingerprints, "kept_docs": kept_docs,
    "sizes_and_titles": sizes, "rules": rules, "country_evidence": country_docs, "document_facets": document_facets, "same_size_candidates": size_candidates, "fuzzy_names": fuzzy_names,
    "latest_by_source": latest_by_source, "column_counts": column_counts, "keys_and_flags": keys_and_flags,
}
SQL = {
    "parsed_parts": f"with {PARSED_SQL} select message_id, part_base, family, number, container, is_final, base from files",
    "incomplete_sets": f"with {PARSED_SQL} select base, count(*) as n_files, count(distinct number) as n_parts, min(number) as lo, max(number) as hi, cast(sum(file_size) as bigint) as total_size, cast(case when min(number) in (0, 1) then max(number) - min(number) + 1 - count(distinct number) else 0 end as bigint) as n_missing from files where number is not null group by base order by total_size desc, base limit 25",
    "doc_duplicates": f"with {DUP_SQL} select * from dups",
    "doc_fingerprints": f"with {DUP_SQL} select kind || ':' || canonical as fingerprint, message_id as duplicate from dups",
    "kept_docs": f"with {DUP_SQL} select source, count(*) as n_files, cast(sum(file_size) as bigint) as total_size from docs where message_id not in (select message_id from dups) group by source",
    "sizes_and_titles": SIZES_SQL, "rules": RULES_SQL, "country_evidence": COUNTRY_SQL, "document_facets": FACETS_SQL,
    "same_size_candidates": SIZE_SQL,
    "latest_by_source": f"with {DOCS_SQL} select source, lang, max(message_id) as message_id, max_by(file_size, message_id) as file_size from docs group by source, lang",
    "column_counts": f"with {DOCS_SQL} select source, count(*) as n, count(distinct file_id) as n_texts, string_agg(distinct lang, ',' order by lang) as langs from docs group by source",
}
