"""Blocking, scoring, groups, labels, reports and the index over the catalogue of parts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.parts import with_part
from ..operators import bases, blocking, groups, planning, rollups, scoring
from ..operators import decisions
from ..operators import search as texts
from ..operators.components import checkpoint_folder, checkpointed, connected_components, stored
from ..operators.country import detect_countries, gazetteer
from ..sources.catalog import PARSED_SQL, catalog_docs, catalog_names, parsed_parts, with_names


def slots(files):
    """Parsed once and kept in the shared folder, as every step below reads them. Callers select what they need: the rest isn't computed."""
    return checkpointed(files.withColumn("number", F.col("part.number")))


def compared(spark, sf):
    """What pairs of equal bases and their scores need of each file."""
    return stored(parsed_parts(spark, sf).select("message_id", "file_size", "posted", "media_group", "part", "base"))


def base_pairs(spark, sf):
    return blocking.exact_base_pairs(stored(parsed_parts(spark, sf).select("message_id", "base", F.col("part.number").alias("number"))))


PAIRS_SQL = f"""{PARSED_SQL}, sized as (select base, count(*) as n, min(message_id) as lo from files where base <> '' group by base),
reps as (select f.message_id, s.lo, min(f.message_id) over (partition by f.base, f.number) as rep from files f join sized s on s.base = f.base where s.n > 200),
pairs as (select a.message_id as a, b.message_id as b from files a join files b on a.base = b.base and a.message_id < b.message_id join sized s on s.base = a.base where s.n between 2 and 200
 union all select distinct a, b from (select rep as a, message_id as b from reps union all select lo, rep from reps) x where a < b)"""


def links(spark, sf):
    return bases.base_links(compared(spark, sf))


LINKS_SQL = f"""{PAIRS_SQL}, j as (select p.a, p.b, x.base, x.number as n1, y.number as n2, x.family as f1, y.family as f2, x.container as c1, y.container as c2, x.is_final as e1, y.is_final as e2,
  abs(x.posted - y.posted) as d, x.media_group = y.media_group as mg, greatest(x.file_size, y.file_size) <= least(x.file_size, y.file_size) * 1.5 as sz, length(x.base) as len
  from pairs p join files x on x.message_id = p.a join files y on y.message_id = p.b),
k as (select *, case when len >= 2 then 0.45 else 0.35 end as nm, coalesce(n1 = n2, false) as dup,
  case when n1 is not null and n2 is not null then case when not coalesce(f1 is not distinct from f2 or c1 = c2 or c1 is null or c2 is null, false) then -0.05 when n1 = n2 then 0.10
     else case when f1 = f2 then 0.30 else 0.28 end + case when abs(n1 - n2) = 1 then 0.02 when abs(n1 - n2) <= 4 then 0.01 else 0 end end
   when n1 is null and n2 is null then 0
   else case when (case when n1 is not null then e2 else e1 end) and coalesce(case when n1 is not null then c1 else c2 end, '') = (case when n1 is not null then c2 else c1 end) then 0.30
     when (case when n1 is not null then e2 else e1 end) and (case when n1 is not null then c1 else c2 end) is null then 0.34
     when (case when n1 is not null then e2 else e1 end) then 0.15 when c1 = c2 then 0.15 else 0.02 end end as st,
  case when d <= 60 then 0.08 when d <= 600 then 0.05 when d <= 3600 then 0.02 when d > 604800 then -0.03 else 0 end + case when mg then 0.10 when b - a <= 100 then 0.04 else 0 end
   + case when (n1 is not null or n2 is not null) and sz then 0.03 else 0 end as cx from j),
links as (select a, b, round(cast(case when dup then greatest(0.5, nm + 0.1) else least(0.99, greatest(0, nm + st + cx)) end as double), 6) as score, dup as dup_slot from k)"""


def token_candidates(spark, sf):
    """Part names that share a word, and another one, or have close sizes or ids, or one brand. Each word is in an eighth of the names, so these pairs
    grow with the square of the parts; they are put together from classes of equal name, size and brand."""
    parts = spark.read.parquet(f"{sf}/part.parquet")
    files = parts.select(F.col("p_partkey").alias("message_id"), F.split("p_name", " ").alias("tokens"), F.col("p_size").cast("long").alias("file_size"), F.lit(None).cast("long").alias("posted"), F.col("p_brand").alias("media_group"))
    return blocking.class_pairs(files)


TOKENS_SQL = """with t as (select distinct p_partkey as id, unnest(string_split(p_name, ' ')) as token from part),
p as (select a.id as a, b.id as b, count(*) as shared from t a join t b on a.token = b.token and a.id < b.id group by all)
select p.a, p.b, p.shared from p join part x on x.p_partkey = p.a join part y on y.p_partkey = p.b
where shared >= 2 or abs(x.p_size - y.p_size) <= 0.05 * greatest(x.p_size, y.p_size) or abs(p.a - p.b) <= 100 or x.p_brand = y.p_brand"""


def neighbours(spark, sf):
    turns = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn")
    return blocking.neighbour_pairs(turns, "conv_id", "turn")


def copies(spark, sf):
    """Components of the graph that links each document to the first one with the same text."""
    docs = catalog_docs(spark, sf)
    least = docs.groupBy("file_id").agg(F.min("message_id").alias("src"), F.count("*").alias("n")).where("n > 1")
    return connected_components(docs.join(least, "file_id").select("src", F.col("message_id").alias("dst")))


def candidates(files):
    """Pairs of equal bases, of shared tokens and of neighbours in the order of ids, once each (I1). The last two pair other bases alone: files
    of one base share their tokens too, and are linked as exact_base_pairs has them."""
    tokens = blocking.token_pairs(files, apart="base")
    near = blocking.neighbour_pairs(blocking.in_windows(files.select("message_id"), "message_id"), "scope", "message_id")
    return blocking.union_pairs(blocking.exact_base_pairs(files), tokens, blocking.prefiltered(near.select("a", "b").distinct(), files))


def resolve(files):
    """(files, kept links, members, groups) of parsed files of one source by all paths (``bases.resolve_bases``: by equal bases alone)."""
    files = slots(files)
    kept = checkpointed(scoring.scored_pairs(candidates(files), files, fuzzy=True).where("kept"))
    members = checkpointed(groups.group_members(files, kept))
    return files, kept, members, groups.finalise(files, members, kept)


# Rules of the queries: the third part of some orders and nothing else of these sets, names with the word sql, and two words of names.
HOLDS, KEYWORDS, SERVICES = ["order_[0-9]*4[.]part03", "leak"], ["sql"], ["set", "x"]
MOST_LABELS = 100


def resolved(spark, sf, more=(), carried=()):
    """(files, members, groups) of the catalogue of parts by equal bases. Its names differ by numbers alone, so alike names say nothing there."""
    files = parsed_parts(spark, sf).select("message_id", "filename", "file_size", "posted", "media_group", "part", "base")
    files = stored(groups.with_traits(files, HOLDS, KEYWORDS) if more else files)
    members, g = bases.resolve_bases(files, more, carried)
    return files, members, groups.rated(g)


def enriched(spark, sf, carried=()):
    files, members, g = resolved(spark, sf, groups.traits(), carried)
    g = groups.traited(g, SERVICES)
    g = g.withColumn("status", F.when(F.col("held"), "HELD").otherwise(F.col("status"))).withColumn("ignored", F.lit(False)).withColumn("country", F.lit(None).cast("string"))
    g = g.drop("reasons", "hold_reason", "norm", "named", "weakest", "n_links")  # no label or roll-up has them
    return files, members, stored(g)  # read for labels, for their ranks and for each roll-up


def labelled(spark, sf, carried=()):
    """(files, members, groups with label and kind)."""
    files, members, g = enriched(spark, sf, carried)
    return files, members, groups.assign_labels(g, MOST_LABELS)


def duplicates(files):
    return groups.exact_duplicates(files.withColumn("file_id", F.lit(None).cast("string")))


def group_table(spark, sf):
    g = resolved(spark, sf)[2]
    return g.select("group_id", "name", "n_files", "total_size", F.size("numbers").cast("long").alias("n_parts"), F.array_join(F.transform("missing", lambda x: x.cast("string")), ",").alias("missing"), "partial_start", "confidence", "status", "review_reason", "reasons")


def member_table(spark, sf):
    files, members, _ = resolved(spark, sf)
    return groups.ordered_members(members, files)


def label_rollup(spark, sf):
    """Groups and labels of each kind, with the files and bytes that are kept, exact duplicates left out."""
    files, members, g = labelled(spark, sf)
    return planning.label_rollup(g, members, files, duplicates(files), "kind")


def report(spark, sf):
    g = enriched(spark, sf)[2]
    return g.groupBy("status").agg(F.count("*").alias("n_groups"), F.count_if(F.col("n_files") > 1).alias("n_multi"), F.sum("n_files").alias("n_files"), F.count_if(F.size("missing") > 0).alias("n_with_gaps"))


def report_document(spark, sf):
    """The report as one JSON text."""
    files, members, g = labelled(spark, sf)
    return planning.report_document(files, members, g, duplicates(files))


def archive_estimates(spark, sf):
    """What each archive (here: region) would take."""
    files, members, g = labelled(spark, sf)
    archives = spark.read.parquet(f"{sf}/region.parquet").select(F.col("r_regionkey").cast("long").alias("archive_id"))
    return planning.archive_estimates(archives, g, members, duplicates(files))


def review_queue(spark, sf):
    g = enriched(spark, sf)[2].where("status = 'REVIEW'")
    return g.select(F.lit("grouping").alias("kind"), "group_id", F.to_json(F.struct("name", "review_reason", "n_files")).alias("payload"))


def review_payloads(spark, sf):
    """Review items read back from their payloads, those of several files."""
    items = planning.opened(review_queue(spark, sf), {"name": "string", "review_reason": "string", "n_files": "long"})
    return items.where("n_files > 1").select("kind", "group_id", "name", "review_reason", "n_files")


def pair_evidence(spark, sf):
    """What speaks for and against each candidate pair, in order."""
    scored = bases.base_links(compared(spark, sf), why=True)
    return scored.select("a", "b", "score", F.array_join("evidence", "; ").alias("evidence"))


EVIDENCE_SQL = """said as (select a, b, len, case when dup then 'part ' || n1 || ' twice' else concat_ws('; ',
  case when n1 is not null and n2 is not null then case when not coalesce(f1 is not distinct from f2 or c1 = c2 or c1 is null or c2 is null, false) then 'kinds of archive that do not go together'
     when n1 = n2 then 'part ' || n1 || ' of two names' else 'part ' || n1 || ' and part ' || n2 || case when abs(n1 - n2) = 1 then ' in a row' else ' of one sequence' end end
   when n1 is not null or n2 is not null then case when (case when n1 is not null then e2 else e1 end) and c1 = c2 then 'a part and the whole archive'
     when (case when n1 is not null then e2 else e1 end) and (case when n1 is not null then c1 else c2 end) is null then 'a part and a whole .' || (case when n1 is not null then c2 else c1 end)
     when (case when n1 is not null then e2 else e1 end) then 'a .' || (case when n1 is not null then c1 else c2 end) || ' part and a whole .' || (case when n1 is not null then c2 else c1 end)
     when c1 = c2 then 'one container, one number' end end,
  case when d <= 60 then 'posted within a minute' when d > 604800 then 'posted over a week apart' end, case when mg then 'posted as one group' when b - a <= 100 then 'ids close together' end,
  case when (n1 is not null or n2 is not null) and sz then 'sizes alike' end) end as evidence from k)"""


def weakest_links(spark, sf):
    """The weakest link of each group with the first three pieces of its evidence."""
    files = compared(spark, sf)
    links_ = stored(bases.base_links(files, why=True).where("kept"))
    weak = groups.weakest_links(stored(groups.group_members(files, links_)), links_)
    return weak.withColumn("evidence", F.array_join("evidence", "; "))


def top_labels(spark, sf):
    """The 25 labels with the most bytes; ties by kind and label (H7)."""
    g = labelled(spark, sf)[2].where("label is not null")
    sums = g.groupBy("kind", "label").agg(F.count("*").alias("n_groups"), F.sum("total_size").alias("total_size"))
    return sums.orderBy(F.desc("total_size"), "kind", "label").limit(25)


def archive_search(spark, sf):
    """Sets that one archive has, the latest first (C8, D12, H9): archive 2 has every group whose label has 2, 7, 12 ... letters."""
    files, members, g = labelled(spark, sf)
    archives = spark.read.parquet(f"{sf}/region.parquet").select(F.col("r_regionkey").cast("long").alias("archive_id"))
    records = planning.with_updated(planning.index_records(g), members, files).select("group_id", "name", "label", "haystack", "updated", "n_files", "kind", "category", "status", "country", "total_size")
    places = records.select("label").distinct().where("label is not null").select((F.length("label") % 5).cast("long").alias("archive_id"), "label", F.length("label").alias("place"))
    found = planning.search(planning.with_destinations(records, archives, places), "order", archive=2, kind="dataset", multi=True, sort="updated", limit=100)
    return found.select("group_id", "name", "label", "updated", "url")


def index_records(spark, sf):
    """One JSON record for each exportable group; held groups have none."""
    return planning.index_records(labelled(spark, sf)[2]).select("group_id", F.to_json(F.struct("name", "label", "kind", "category", "status", "n_files", "total_size", "haystack")).alias("record"))


def search(spark, sf):
    found = planning.search(planning.index_records(labelled(spark, sf)[2]), "order 12", kind="dataset", multi=True, sort="size", limit=50)
    return found.select("group_id", "name", "label", "n_files", "total_size")


def decision_log(spark, sf, g):
    """Events of a user as decisions on the groups of the order with that number; renamed ones take a title that some share with a domain. Of each user's
    events those alone meet the groups that can still count."""
    action = F.when(F.col("event_type") == "purchase", "accept").when(F.col("event_type") == "click", "rename").when(F.col("event_type") == "error", "ignore").when(F.col("value") > 30, "hold")
    e = spark.read.parquet(f"{sf}/events.parquet").select("user_id", F.col("event_id").alias("decision_id"), action.alias("action"), F.when(F.col("event_id") % 2 == 0, "Set").otherwise(F.concat(F.lit("Title "), F.col("event_id").cast("string"))).alias("title"))
    return g.select("group_id", F.floor(F.col("group_id") / 1000).alias("user_id")).join(decisions.last_words(e, "user_id"), "user_id").drop("user_id")


def live_labels(spark, sf):
    """Groups under the decisions made on them, with the labels that they have then."""
    g = enriched(spark, sf)[2]
    out = decisions.live_labels(g, decision_log(spark, sf, g), MOST_LABELS)
    return out.select("group_id", "name", "status", "kind", "label")


def group_facets(spark, sf):
    """Groups, files and bytes by status, category and kind of label, in one aggregation."""
    g = labelled(spark, sf)[2]
    return rollups.facets(g, ["status", "category", "kind"], F.count("*").alias("n_groups"), F.count_if(F.col("n_files") > 1).alias("n_multi"), F.sum("n_files").alias("n_files"), F.sum("total_size").alias("total_size"))


SEARCHED = ["order 12", "_Y.z07", "copy (4)", "parts: 3, 5", "confidence 0.7", "sql.zip", "no such text", "2024.01"]


def text_search(spark, sf):
    """Groups with a line or a member's name that has one of several texts, through the index of trigrams."""
    files, members, g = labelled(spark, sf, ("filename",))
    folder = f"{checkpoint_folder(spark)}/search-{uuid.uuid4().hex}"
    texts.write_index(texts.fragments(g, members, files), folder)
    return texts.find(spark, folder, SEARCHED)


def top_groups(spark, sf):
    return resolved(spark, sf)[2].select("group_id", "total_size").orderBy(F.desc("total_size"), "group_id").limit(15)


def pilot_groups(spark, sf):
    """The first groups in the order of their first members."""
    return resolved(spark, sf)[2].select("group_id", "n_files").orderBy("group_id").limit(25)


def numeric_ids(spark, sf):
    """Ids of files whose name starts with a digit, once each."""
    return parsed_parts(spark, sf).where(F.col("filename").rlike("^[0-9]")).select("message_id").distinct()


def destinations(spark, sf):
    """Where each record (here: the customers of a nation) is in each archive (region); no address where it isn't."""
    archives = spark.read.parquet(f"{sf}/region.parquet").select(F.col("r_regionkey").cast("long").alias("archive_id"))
    nation = spark.read.parquet(f"{sf}/nation.parquet")
    known = nation.select(F.col("n_regionkey").cast("long").alias("archive_id"), F.col("n_name").alias("label"), F.col("n_nationkey").cast("long").alias("place"))
    customers = spark.read.parquet(f"{sf}/customer.parquet").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    records = customers.groupBy(F.col("n_name").alias("label")).agg(F.count("*").alias("n_records"))
    return planning.with_destinations(records, archives, known)


def linked(spark, sf):
    """Resolution of the catalogue of part names by equal bases, rare tokens and neighbours with alike names, with countries, holds and labels."""
    names = catalog_names(spark, sf).repartition(spark.sparkContext.defaultParallelism)  # a small file with much to parse
    files, kept, members, g = resolve(with_names(with_part(names)))
    g = groups.enrich(g, files, members, ["qu", "leak"], ["zen"], ["yandex", "udemy"])
    text = planning.group_texts(files, members)
    found = detect_countries(text, gazetteer(spark), "group_id").select(F.col("id").alias("group_id"), F.col("name").alias("country_name"), F.col("confidence").alias("country_confidence"))
    g = g.join(found, "group_id", "left").withColumn("status", F.when(F.col("held"), "HELD").otherwise(F.col("status"))).withColumn("ignored", F.lit(False))
    return files, members, g.withColumn("country", F.when(F.col("country_confidence") >= 0.75, F.col("country_name")))


def linked_groups(spark, sf):
    g = groups.assign_labels(linked(spark, sf)[2], MOST_LABELS)
    return g.select("group_id", "name", "n_files", "confidence", "status", "review_reason", "hold_reason", "category", "country_name", "country_confidence", "kind", "label")


def linked_review(spark, sf):
    """Review items of three kinds: groups, alike names of one size, countries that aren't sure."""
    files, _, g = linked(spark, sf)
    return planning.review_items(g, files)


GROUPS_SQL = rf"""{LINKS_SQL}, kept as (select * from links where dup_slot or score >= 0.65), edges as (select a as src, b as dst from kept union all select b, a from kept),
cc(id, comp) using key (id) as (select distinct src, src from edges union (select u.id, min(v.comp) from recurring.cc u join edges e on e.src = u.id join recurring.cc v on e.dst = v.id where v.comp < u.comp group by u.id)),
members as (select f.message_id, coalesce(cc.comp, f.message_id) as group_id from files f left join cc on cc.id = f.message_id),
shown as (select *, substr(trim(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(part_base, '[\s_-]+', ' ', 'g')), '[\s_]*\([0-9]+\)\s*$', ' '), '(?i)[\s_]*(?:copy|backup|original|final|old)[\s_]*[0-9]*\s*$', ' '), '\s+', ' ', 'g')), 1, 120) as display from files),
raw as (select group_id, count(*) as n_files, cast(sum(coalesce(file_size, 0)) as bigint) as total_size, list_sort(coalesce(list(distinct number) filter (number is not null), [])) as numbers,
  arg_min(display, message_id) as name, arg_min(base, message_id) as norm, bool_or(base <> '') as named, arg_min(lower(filename), message_id) as folded,
  bool_or(regexp_matches(lower(filename), '(^|[^a-z0-9])order_[0-9]*4[.]part03') or regexp_matches(lower(filename), '(^|[^a-z0-9])leak')) as held, bool_or(regexp_matches(lower(filename), '(^|[^a-z0-9])sql')) as tagged
  from members join shown using (message_id) group by group_id),
counted as (select group_id, min(score) as weakest, count(*) as n_links, min({{'s': score, 'a': a, 'b': b}}) as link from kept join members on message_id = a where not dup_slot group by group_id),
gaps as (select *, len(numbers) as n, coalesce(numbers[1] not in (0, 1), false) as partial_start from raw left join counted using (group_id)),
sure as (select *, case when n > 0 and not partial_start then list_filter(range(numbers[1], numbers[-1] + 1), lambda x: not list_contains(numbers, x)) else [] end as missing from gaps),
conf as (select *, round(least(0.99, coalesce(weakest, 1.0) + case when n_files > 1 and n >= 3 then case when partial_start then 0.05 when len(missing) <= 2 then 0.08 else 0 end else 0 end), 3) as confidence from sure),
judged as (select *, coalesce(n_links > 0 and confidence < 0.90, false) as weak, not named or (n_files = 1 and (trim(norm) = '' or regexp_matches(trim(norm), '^part[\s_-]*[0-9]*$'))) as bare from conf),
groups as (select *, case when weak or bare then 'REVIEW' else 'OK' end as state, nullif(concat_ws('; ', case when weak then 'confidence ' || printf('%.2f', confidence) || ' below 0.90' end, case when bare then 'no name beyond a part number' end), '') as review_reason,
  concat_ws('; ', case when n >= 3 then case when partial_start then 'parts start mid-range' else len(missing) || ' parts missing' end end, case when n_links > 0 then 'weakest link ' || printf('%.2f', weakest) || ' of ' || link.a || ' and ' || link.b end) as reasons from judged)"""
LABELS_SQL = rf"""{GROUPS_SQL}, kinds as (select *, case when held then 'HELD' else state end as status,
  case when not held and norm <> '' then case when regexp_matches(norm, '(^| )set( |$)') then 'set' when regexp_matches(norm, '(^| )x( |$)') then 'x' end end as domain,
  case {" ".join(f"when regexp_matches(folded, '(^|[^a-z0-9])({'|'.join(words)})([^a-z0-9]|$)') then '{label}'" for label, words in groups.CATEGORIES)} when n_files > 1 then 'Databases / Datasets' else 'Miscellaneous' end as category from groups),
first_kinds as (select *, case when held then 'held' when status = 'REVIEW' then 'review' when tagged then 'tagged' when n_files > 1 then 'dataset' when domain is not null then 'domain' else 'misc' end as k from kinds),
ranked as (select *, case when k = 'dataset' then row_number() over (partition by k order by total_size desc, group_id) end as place from first_kinds),
bucketed as (select *, case when k = 'dataset' and place > 100 then (row_number() over (partition by k, place > 100 order by group_id) - 1) // 50 + 1 end as bucket from ranked),
labelled as (select *, case when bucket is not null then 'overflow' else k end as kind, case k when 'held' then 'Quarantine' when 'review' then 'Review' when 'tagged' then 'Tagged' when 'domain' then upper(domain[1]) || domain[2:] when 'misc' then 'Miscellaneous'
  else case when bucket is not null then 'Extra Datasets ' || bucket else coalesce(nullif(trim(substr(trim(regexp_replace(name, '\s+', ' ', 'g')), 1, 100)), ''), 'Untitled') end end as label from bucketed),
dups as (select message_id from (select message_id, min(message_id) over (partition by base, coalesce(label, 'base'), file_size) as one from files where length(base) >= 2 and file_size > 0) where one < message_id),
kept_files as (select m.group_id, f.file_size from members m join files f using (message_id) where m.message_id not in (select message_id from dups)),
records as (select group_id, name, label, kind, category, status, n_files, total_size, lower(concat_ws(' ', name, category, status, label, 'of ' || n_files || ' files')) as haystack from labelled where kind <> 'held')"""
# The same chain under the latest decisions, and with labels of several kinds kept apart.
_ACT = "case event_type when 'purchase' then 'accept' when 'click' then 'rename' when 'error' then 'ignore' else case when value > 30 then 'hold' end end"
LIVE_SQL = LABELS_SQL.replace("kinds as (select *, case when held then 'HELD' else state end as status", f"""acts as (select user_id, event_id, {_ACT} as action, case when event_id % 2 = 0 then 'Set' else 'Title ' || event_id end as title from events),
latest as (select user_id, max_by(action, event_id) as action, max_by(title, event_id) filter (action = 'rename') as title from acts where action is not null group by user_id),
decided as (select groups.* replace (held or coalesce(action = 'hold', false) as held, coalesce(title, name) as name), coalesce(action in ('accept', 'rename'), false) as released, coalesce(action = 'ignore', false) as ignored, held as was_held from groups left join latest on user_id = group_id // 1000),
kinds as (select *, case when held then 'HELD' when released then 'OK' else state end as status""").replace("case when not held and norm <> ''", "case when not was_held and norm <> ''").replace("'Miscellaneous' end as category from groups)", "'Miscellaneous' end as category from decided)")
LIVE_SQL = LIVE_SQL.replace("select *, case when held then 'held' when status = 'REVIEW'", "select *, case when held then 'held' when ignored then 'ignored' when status = 'REVIEW'").replace("case k when 'held' then 'Quarantine'", "case k when 'ignored' then null when 'held' then 'Quarantine'")
LIVE_SQL = f"""with recursive {LIVE_SQL}, o(kind, p) as (values {", ".join(f"('{k}', {n})" for n, k in enumerate(groups.KINDS))}),
places as (select label, kind, row_number() over (partition by label order by p) as nth from (select distinct label, kind from labelled where label is not null) join o using (kind))
select group_id, name, status, l.kind, case when nth > 1 then l.label || ' (' || nth || ')' else l.label end as label from labelled l left join places p on p.label = l.label and p.kind = l.kind"""
_TENTHS = lambda unit: f"((cast(total_size as hugeint) * 20 + {unit}) // {2 * unit})"
_SIZE = " ".join(f"when total_size < {unit * 1024} then {_TENTHS(unit)} // 10 || '.' || {_TENTHS(unit)} % 10 || ' {label}'" for unit, label in ((1 << 10, "KB"), (1 << 20, "MB"), (1 << 30, "GB")))
SEARCH_SQL = f"""with recursive {LABELS_SQL}, listed as (select *, case when total_size < 1024 then total_size || ' B' {_SIZE} end as bytes from labelled where kind <> 'held'),
lines as (select group_id, lower(concat_ws(' ', name, category, case when n_files > 1 then 'Set of several parts, ' || n_files || ' files, ' || bytes || '.' else 'Single file.' end,
  case when len(missing) > 0 then 'Missing parts: ' || array_to_string(missing, ', ') || '.' end, case when partial_start and n > 0 then 'Parts ' || numbers[1] || '–' || numbers[-1] || ' are there, earlier ones are not in the source.' end,
  case when status = 'REVIEW' then 'Needs review (confidence ' || printf('%.2f', confidence) || ').' end, status, label)) as text from listed
 union all select group_id, lower(filename) from members join files using (message_id) where group_id in (select group_id from listed))
select distinct q as query, group_id from lines join (select unnest({SEARCHED}) as q) on contains(text, lower(q))"""


QUERIES = {
    "exact_base_pairs": base_pairs, "pair_scores": links, "token_candidates": token_candidates, "neighbour_pairs": neighbours, "copy_components": copies, "groups": group_table,
    "group_members": member_table, "label_rollup": label_rollup, "report": report, "report_document": report_document, "archive_estimates": archive_estimates, "review_queue": review_queue,
    "index_records": index_records, "index_search": search, "text_search": text_search, "group_facets": group_facets, "live_labels": live_labels, "top_groups": top_groups, "pilot_groups": pilot_groups, "numeric_ids": numeric_ids, "destinations": destinations,
    "review_payloads": review_payloads, "pair_evidence": pair_evidence, "weakest_links": weakest_links, "top_labels": top_labels, "archive_search": archive_search,
    "linked_groups": linked_groups, "linked_review": linked_review,
}
SQL = {
    "exact_base_pairs": f"with {PAIRS_SQL} select a, b from pairs",
    "pair_scores": f"with {LINKS_SQL} select a, b, score, dup_slot, dup_slot or score >= 0.65 as kept from links",
    "token_candidates": TOKENS_SQL,
    "review_payloads": f"with recursive {LABELS_SQL} select 'grouping' as kind, group_id, name, review_reason, n_files from labelled where status = 'REVIEW' and n_files > 1",
    "pair_evidence": f"with {LINKS_SQL}, {EVIDENCE_SQL} select a, b, score, evidence from links join said using (a, b)",
    "weakest_links": f"""with recursive {GROUPS_SQL}, {EVIDENCE_SQL} select group_id, link.a as a, link.b as b, link.s as score, array_to_string(string_split(evidence, '; ')[1:3], '; ') as evidence
 from groups join said on said.a = link.a and said.b = link.b""",
    "top_labels": f"with recursive {LABELS_SQL} select kind, label, count(*) as n_groups, cast(sum(total_size) as bigint) as total_size from labelled where label is not null group by kind, label order by total_size desc, kind, label limit 25",
    "archive_search": f"""with recursive {LABELS_SQL}, newest as (select group_id, max(posted) as updated from members join files using (message_id) group by group_id)
 select group_id, name, label, updated, 'archive/2/' || length(label) as url from records join newest using (group_id) where kind = 'dataset' and n_files > 1 and contains(haystack, 'order') and length(label) % 5 = 2 order by updated desc nulls last, group_id limit 100""",
    "neighbour_pairs": "select a.conv_id, a.turn as a, b.turn as b from (select *, row_number() over (partition by conv_id order by turn) as r from conversations) a join (select *, row_number() over (partition by conv_id order by turn) as r from conversations) b on a.conv_id = b.conv_id and b.r > a.r and b.r <= a.r + 15",
    "copy_components": "select doc_id as node, least as component from (select doc_id, min(doc_id) over (partition by text) as least, count(*) over (partition by text) as n from documents) where n > 1",
    "groups": f"with recursive {GROUPS_SQL} select group_id, name, n_files, total_size, n as n_parts, array_to_string(missing, ',') as missing, partial_start, cast(confidence as double) as confidence, state as status, review_reason, reasons from groups",
    "group_members": f"with recursive {GROUPS_SQL} select group_id, cast(row_number() over (partition by group_id order by coalesce(number, 1000000000), message_id) as integer) as seq, message_id from members join files using (message_id)",
    "label_rollup": f"with recursive {LABELS_SQL} select kind, count(*) as n_groups, count(distinct label) as n_labels, cast(sum(f) as bigint) as n_files, cast(sum(s) as bigint) as total_size from (select kind, label, (select count(*) from kept_files k where k.group_id = l.group_id) as f, (select coalesce(sum(file_size), 0) from kept_files k where k.group_id = l.group_id) as s from labelled l) group by kind",
    "report": f"with recursive {LABELS_SQL} select status, count(*) as n_groups, count(*) filter (n_files > 1) as n_multi, cast(sum(n_files) as bigint) as n_files, count(*) filter (len(missing) > 0) as n_with_gaps from labelled group by status",
    "report_document": f"""with recursive {LABELS_SQL}, r as (select sum(n_files) as files, count(*) as g, count(*) filter (n_files > 1) as multi, count(*) filter (status = 'OK') as ok, count(*) filter (status = 'REVIEW') as review,
 count(*) filter (status = 'HELD') as held, coalesce(sum(n_files) filter (tagged), 0) as tagged, count(distinct {{'k': kind, 'l': label}}) as labels from labelled)
select '{{"files":' || files || ',"groups":' || g || ',"multipart":' || multi || ',"single":' || (g - multi) || ',"ok":' || ok || ',"review":' || review || ',"held":' || held || ',"tagged_files":' || tagged || ',"duplicates":' || (select count(*) from dups) || ',"labels":' || labels
 || ',"categories":{{' || (select string_agg('"' || category || '":' || n, ',' order by category) from (select category, count(*) as n from labelled group by category)) || '}}}}' as report from r""",
    "archive_estimates": f"with recursive {LABELS_SQL} select cast(r_regionkey as bigint) as archive_id, (select count(distinct {{'k': kind, 'l': label}}) from labelled where kind <> 'held') as labels, (select count(*) from kept_files join labelled using (group_id) where kind <> 'held') as kept_files, (select count(*) from labelled where kind in ('dataset', 'overflow')) as summaries from region",
    "review_queue": f"""with recursive {LABELS_SQL} select 'grouping' as kind, group_id, '{{"name":"' || name || '","review_reason":"' || review_reason || '","n_files":' || n_files || '}}' as payload from labelled where status = 'REVIEW'""",
    "index_records": f"""with recursive {LABELS_SQL} select group_id, '{{"name":"' || name || '","label":"' || label || '","kind":"' || kind || '","category":"' || category || '","status":"' || status || '","n_files":' || n_files || ',"total_size":' || total_size || ',"haystack":"' || haystack || '"}}' as record from records""",
    "index_search": f"with recursive {LABELS_SQL} select group_id, name, label, n_files, total_size from records where contains(haystack, 'order 12') and kind = 'dataset' and n_files > 1 order by total_size desc, group_id limit 50",
    "text_search": SEARCH_SQL, "live_labels": LIVE_SQL,
    "group_facets": f"with recursive {LABELS_SQL} select case when grouping(status) = 0 then 'status' when grouping(category) = 0 then 'category' else 'kind' end as facet, coalesce(status, category, kind) as value, count(*) as n_groups, count(*) filter (n_files > 1) as n_multi, cast(sum(n_files) as bigint) as n_files, cast(sum(total_size) as bigint) as total_size from labelled group by grouping sets ((status), (category), (kind))",
    "top_groups": f"with recursive {GROUPS_SQL} select group_id, total_size from groups order by total_size desc, group_id limit 15",
    "pilot_groups": f"with recursive {GROUPS_SQL} select group_id, n_files from groups order by group_id limit 25",
    "numeric_ids": f"with {PARSED_SQL} select distinct message_id from files where regexp_matches(filename, '^[0-9]')",
    "destinations": "select cast(r_regionkey as bigint) as archive_id, n_name as label, n_records, case when n_regionkey = r_regionkey then 'archive/' || r_regionkey || '/' || n_nationkey end as url from (select n_name, n_regionkey, n_nationkey, count(*) as n_records from customer join nation on c_nationkey = n_nationkey group by all) x cross join region",
}
