"""Roll-ups, the report, the index, destinations, review items and marks over groups with labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import weighted_ratio
from .blocking import all_of_one_size, names_of_sizes
from .components import stored
from .groups import kept_members

# Country confidences that need a look, and the likeness of names that do.
UNSURE, SURE, ALIKE = 0.40, 0.75, 0.90
HEAD_REVIEW, HEAD_NAMES = 500, 10


def label_rollup(groups: DataFrame, members: DataFrame, files: DataFrame, duplicates: DataFrame, by: str = "label") -> DataFrame:
    """Groups, labels, and the files and bytes that are kept, of each label or kind."""
    kept = kept_members(members, duplicates).join(files.select("message_id", "file_size"), "message_id")
    sums = kept.groupBy("group_id").agg(F.count("*").alias("kept_files"), F.sum(F.coalesce("file_size", F.lit(0))).alias("kept_size"))
    g = groups.join(sums, "group_id", "left")
    zero = lambda c: F.sum(F.coalesce(c, F.lit(0)))
    return g.groupBy(by).agg(F.count("*").alias("n_groups"), F.count_distinct("label").alias("n_labels"), zero("kept_files").alias("n_files"), zero("kept_size").alias("total_size"))


def report_document(files: DataFrame, members: DataFrame, groups: DataFrame, duplicates: DataFrame) -> DataFrame:
    """One row with the report as JSON: counts of files, groups by status, duplicates, tagged files, labels, categories."""
    count = lambda c: F.count_if(c)
    g = groups.agg(
        F.sum("n_files").alias("files"), F.count("*").alias("groups"), count(F.col("n_files") > 1).alias("multipart"), count(F.col("n_files") == 1).alias("single"),
        *[count(F.col("status") == s).alias(s.lower()) for s in ("OK", "REVIEW", "HELD")], F.coalesce(F.sum(F.when(F.col("tagged"), F.col("n_files"))), F.lit(0)).alias("tagged_files"), F.count_distinct("kind", "label").alias("labels"))
    kinds = groups.groupBy("category").count().agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "count")))).alias("categories"))
    one = g.crossJoin(duplicates.agg(F.count("*").alias("duplicates"))).crossJoin(kinds)  # single rows
    return one.select(F.to_json(F.struct("files", "groups", "multipart", "single", "ok", "review", "held", "tagged_files", "duplicates", "labels", "categories")).alias("report"))


def archive_estimates(archives: DataFrame, groups: DataFrame, members: DataFrame, duplicates: DataFrame) -> DataFrame:
    """Labels, kept files and summaries that each archive would get; nothing of held groups (D13, G14). archives is a list of a few rows."""
    out = groups.where("kind <> 'held'")
    kept = kept_members(members, duplicates).join(out.select("group_id"), "group_id", "left_semi").agg(F.count("*").alias("kept_files"))
    sums = out.agg(F.count_distinct("kind", "label").alias("labels"), F.count_if(F.col("kind").isin("dataset", "overflow")).alias("summaries"))
    return archives.crossJoin(sums.crossJoin(kept)).select("archive_id", "labels", "kept_files", "summaries")  # one row of sums


def with_destinations(records: DataFrame, archives: DataFrame, destinations: DataFrame) -> DataFrame:
    """records for each of the archives, with the address that (archive, label) has there, or none (D12). Spark broadcasts the archives if they are small."""
    url = F.concat_ws("/", F.lit("archive"), F.col("archive_id").cast("string"), F.col("place").cast("string"))
    joined = records.crossJoin(archives).join(destinations, ["archive_id", "label"], "left")
    return joined.select("archive_id", *records.columns, F.when(F.col("place").isNotNull(), url).alias("url"))


def index_records(groups: DataFrame) -> DataFrame:
    """What the index has of each group that may be shown, with the text to search in (A10, B15); nothing of held ones."""
    text = F.lower(F.concat_ws(" ", "name", "category", "status", "label", F.concat(F.lit("of "), F.col("n_files").cast("string"), F.lit(" files"))))
    return groups.where("kind <> 'held'").withColumn("haystack", text)


def with_updated(records: DataFrame, members: DataFrame, files: DataFrame) -> DataFrame:
    """records with the time of the newest file of each; null where none has one."""
    newest = members.join(files.select("message_id", "posted"), "message_id").groupBy("group_id").agg(F.max("posted").alias("updated"))
    return records.join(newest, "group_id", "left")


def write_index(records: DataFrame, folder: str) -> None:
    """The records as lines of JSON in the order of their names, then of their ids (A10). A range sort: the parts of the folder follow each other."""
    records.orderBy(F.lower("name"), "group_id").write.mode("overwrite").json(folder)


def write_report(report: DataFrame, folder: str) -> None:
    """The report's one row as a text file."""
    report.select("report").coalesce(1).write.mode("overwrite").text(folder)


SORTS = {"name": [F.lower, "name"], "size": [F.desc, "total_size"], "files": [F.desc, "n_files"], "country": [F.asc_nulls_last, "country"], "updated": [F.desc_nulls_last, "updated"]}


def search(records: DataFrame, text: str = "", country: str | None = None, category: str | None = None, status: str | None = None, kind: str | None = None, multi: bool | None = None, sort: str = "name", limit: int | None = None, archive: int | None = None) -> DataFrame:
    """Records that pass all filters given, in one of five orders; ties by group (C8, H9). Only records with_destinations can be asked for those
    that are in an archive, only records with_updated come by their time."""
    out = records
    for c, v in (("country", country), ("category", category), ("status", status), ("kind", kind)):
        if v is not None:
            out = out.where(F.col(c) == v)
    if archive is not None:
        out = out.where((F.col("archive_id") == archive) & F.col("url").isNotNull())
    if multi is not None:
        out = out.where((F.col("n_files") > 1) == multi)
    if text.strip():
        out = out.where(F.col("haystack").contains(text.strip().lower()))
    how, column = SORTS[sort]
    out = out.orderBy(how(F.col(column)), "group_id")
    return out.limit(limit) if limit is not None else out


def group_texts(files: DataFrame, members: DataFrame) -> DataFrame:
    """(group_id, text): names of the members, one text each, so that no group gathers all of its names in one row."""
    return members.join(files.select("message_id", "filename"), "message_id").select("group_id", F.col("filename").alias("text")).distinct()


def may_be_alike(a: Column, b: Column) -> Column:
    """False only for names whose weighted ratio, rounded to thousandths, is below ALIKE; without Python.

    Names of one word each are as alike as their edits allow, which are at least their Levenshtein distance, or one is a stretch of the other (nearly, if
    both are very long). Of names of several words nothing is said.
    """
    n, m = F.length(a), F.length(b)
    most = F.floor((n + m) * 101 / 1000).cast("int")  # edits that leave 0.899 of the letters; the ratio must reach 0.8995
    word = r"^[\p{L}\p{N}!-~]+$"
    return (F.call_function("levenshtein", a, b, most) >= 0) | a.contains(b) | b.contains(a) | (F.least(n, m) > 400) | ~(a.rlike(word) & b.rlike(word))


def review_items(groups: DataFrame, files: DataFrame) -> DataFrame:
    """(kind, group_id, message_id, payload) of groups that need a look, alike names of one size (the first file of each, and how many
    have the name), and countries that aren't sure (J4)."""
    none = F.lit(None).cast("long")
    grouping = groups.where("status = 'REVIEW'").select(F.lit("grouping").alias("kind"), "group_id", none.alias("message_id"), F.to_json(F.struct("name", "confidence", "review_reason", "n_files")).alias("payload"))
    unsure = groups.where(f"status = 'OK' and country_confidence >= {UNSURE} and country_confidence < {SURE}")
    country = unsure.select(F.lit("country").alias("kind"), "group_id", none.alias("message_id"), F.to_json(F.struct("name", "country_name", "country_confidence")).alias("payload"))
    # few are left over, which are read for their names and for their files
    pairs = stored(all_of_one_size(names_of_sizes(files)).where(may_be_alike(F.col("name_a"), F.col("name_b"))))
    names = pairs.select("name_a", "name_b").distinct().withColumn("likeness", F.round(weighted_ratio(F.col("name_a"), F.col("name_b")), 3)).where(F.col("likeness") >= ALIKE)
    alike = pairs.join(names, ["name_a", "name_b"]).select(F.lit("duplicate").alias("kind"), none.alias("group_id"), F.col("a").alias("message_id"), F.to_json(F.struct("a", "b", "n_a", "n_b", "likeness")).alias("payload"))
    return grouping.unionByName(country).unionByName(alike)


def opened(items: DataFrame, fields: dict[str, str], payload: str = "payload") -> DataFrame:
    """items with their JSON payloads as variants (``opened``), a column for each field, {name: type}, and the payload's shape (B18, J4). A payload that isn't JSON,
    and a field that is missing or of another type, are null."""
    out = items.withColumn("opened", F.try_parse_json(payload))
    return out.withColumns({name: F.try_variant_get("opened", f"$.{name}", kind) for name, kind in fields.items()}).withColumn("shape", F.schema_of_variant("opened"))


def review_list(items: DataFrame, statuses: DataFrame, status: str = "PENDING", kind: str | None = None, limit: int = HEAD_REVIEW) -> DataFrame:
    """The head of the items (item_id, kind) with a status, by id; what no status row names is pending."""
    latest = statuses.groupBy("item_id").agg(F.max_by("status", "decision_id").alias("status"))
    out = items.join(latest, "item_id", "left").withColumn("status", F.coalesce("status", F.lit("PENDING"))).where(F.col("status") == status)
    return (out.where(F.col("kind") == kind) if kind is not None else out).orderBy("item_id").limit(limit)


def with_marks(duplicates: DataFrame, marks: DataFrame) -> DataFrame:
    """Duplicates and those that an administrator marked (message_id, canonical), at 0.9; what is known already stays as it is."""
    new = marks.groupBy("message_id").agg(F.min("canonical").alias("canonical")).join(duplicates.select("message_id"), "message_id", "left_anti")
    return duplicates.unionByName(new.select("message_id", "canonical", F.lit("marked").alias("kind"), F.lit(0.9).alias("confidence")))


def write_resolution(groups: DataFrame, members: DataFrame, folder: str) -> None:
    """Writes both tables anew, so that a second run leaves what one run leaves."""
    groups.write.mode("overwrite").parquet(f"{folder}/groups")
    members.write.mode("overwrite").parquet(f"{folder}/members")
