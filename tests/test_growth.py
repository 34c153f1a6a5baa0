from pyspark.sql import functions as F

from shelfmark.functions.parts import with_part
from shelfmark.operators import bases, blocking, components, groups, scoring
from shelfmark.queries import resolution
from shelfmark.sources.catalog import with_names

#: Methods of more bytecodes than this are never compiled by the JVM.
LONGEST = 8000


def catalogue(spark, rows):
    made = [(i, n, s, 1000 + i, g) for i, n, s, g in rows]
    return with_names(with_part(spark.createDataFrame(made, "message_id long, filename string, file_size long, posted long, media_group string")))


def methods(df):
    debug = getattr(df.sparkSession._jvm.org.apache.spark.sql.execution.debug, "package$")
    stages = getattr(debug, "MODULE$").codegenStringSeq(df._jdf.queryExecution().executedPlan())
    return [stages.apply(k)._3().maxMethodCodeSize() for k in range(stages.size())]


def test_scores_under_a_filter_are_worked_out_once_in_methods_that_can_be_compiled(spark):
    files = resolution.slots(catalogue(spark, [(1, "a_set.part01.rar", 5, "g"), (2, "a_set.part02.rar", 5, "g"), (3, "b_set.zip", 7, "h")]))
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = methods(scoring.scored_pairs(blocking.exact_base_pairs(files), files).where("kept"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert found and max(found) < LONGEST


def test_files_of_one_base_meet_through_representatives_alone(spark):
    rows = [(k, f"deadbeefcafe.part{k % 7 + 1:02d}.rar", 10, "g") for k in range(0, 60_000, 200)]
    pairs = resolution.candidates(resolution.slots(catalogue(spark, rows)))
    assert pairs.count() < 3 * len(rows)  # 300 files: 44,850 pairs when each met each


def test_files_of_other_bases_still_meet_by_a_token(spark):
    files = catalogue(spark, [(1, "alpha river.zip", 10, "g"), (5000, "alpha river.rar", 10, "g"), (9000, "alpha stone.zip", 10, "g")])
    every = {tuple(r) for r in blocking.token_pairs(files).select("a", "b").collect()}
    apart = {tuple(r) for r in blocking.token_pairs(files, apart="base").select("a", "b").collect()}
    assert every == {(1, 5000), (1, 9000), (5000, 9000)} and apart == {(1, 9000), (5000, 9000)}


def test_names_are_peeled_and_parsed_as_before(spark):
    names = {"A copy (2) old": "a", "plain  name": "plain name", "old": "", "gold": "g"}
    got = {r["filename"]: r["base"] for r in catalogue(spark, [(k, n, 1, "g") for k, n in enumerate(names)]).collect()}
    assert got == names
    kinds = {"s.part3.rar": "part", "s.z01": "z", "s.r12": "r", "s.zip.001": "nn", "s.01": "nn2", "s.vol-4.rar": "vol", "s.part12345.rar": None, "s.1234": None}
    got = {r["filename"]: r["f"] for r in with_part(spark.createDataFrame([(n,) for n in kinds], "filename string")).select("filename", F.col("part.family").alias("f")).collect()}
    assert got == kinds


def compiled(spark, plan):
    """Sizes of the largest methods of a plan's stages, without the printing of their code."""
    own = []
    if plan.getClass().getSimpleName() == "WholeStageCodegenExec":
        generator = getattr(spark._jvm.org.apache.spark.sql.catalyst.expressions.codegen, "CodeGenerator$")
        own = [getattr(generator, "MODULE$").compile(plan.doCodeGen()._2())._2().maxMethodCodeSize()]
    return own + [n for k in range(plan.children().size()) for n in compiled(spark, plan.children().apply(k))]


def test_names_are_parsed_in_methods_that_can_be_compiled(spark):
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        made = spark.range(1).select(F.col("id").alias("message_id"), F.concat("id", F.lit(".rar")).alias("filename"))
        found = compiled(spark, with_names(with_part(made)).select("message_id", "part", "base")._jdf.queryExecution().executedPlan())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert found and max(found) < LONGEST


def test_odd_names_are_parsed_as_before(spark):
    names = {"": "", "...": "", "rar": "", ".rar": "", "a..b.part01.rar": "a b", "x. .zip.": "x", "2024.01.11.zip": "2024 01 11", "s.z01.rar.": "s", "set.rar.part2": "set", "Order-7-Part-01-SQL.zip": "order 7 sql", "İ.part1.rar": "i̇"}
    got = {r["filename"]: r["base"] for r in catalogue(spark, [(k, n, 1, "g") for k, n in enumerate(names)]).collect()}
    assert got == names


def deals(plan):
    """The plans below each exchange of a plan, without what only carries rows on."""
    own = []
    if plan.getClass().getSimpleName() == "ShuffleExchangeExec":
        below = plan.child()
        while below.getClass().getSimpleName() in ("WholeStageCodegenExec", "InputAdapter", "ProjectExec"):
            below = below.children().apply(0)
        own = [below.getClass().getSimpleName()]
    return own + [n for k in range(plan.children().size()) for n in deals(plan.children().apply(k))]


def test_groups_are_dealt_before_they_are_summed(spark):
    """Sums before a deal sort all that a task reads, and spill when its input is well compressed."""
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        files = bases.stored(catalogue(spark, [(k, f"s{k // 4}.part{k % 4 + 1:02d}.rar", 10, "g") for k in range(40)]))
        found = deals(bases.resolve_bases(files)[1]._jdf.queryExecution().executedPlan())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert found and "ObjectHashAggregateExec" not in found


def test_deals_are_bounded_in_rows(spark, monkeypatch):
    monkeypatch.setattr(components, "DEALT_ROWS", 100)
    many = components.dealt(spark.range(5000), "id")
    assert many.rdd.getNumPartitions() == 50 and many.count() == 5000
    assert components.dealt(spark.range(50), "id").count() == 50


def test_a_name_of_one_file_is_not_looked_up(spark):
    rows = [(k, f"s{k}.part01.rar", 10, "g") for k in range(50)] + [(90, "s7.part01.rar", 10, "g")]
    files = catalogue(spark, rows).withColumn("file_id", F.lit(None).cast("string"))
    dups = groups.exact_duplicates(files)
    assert [tuple(r) for r in dups.select("message_id", "canonical", "kind").collect()] == [(90, 7, "name_slot")]
    joins = dups._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in joins and "SortMergeJoin" not in joins


def test_evidence_is_generated_code_that_can_be_compiled(spark):
    """Evidence in a lambda left the whole step to an interpreter."""
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        files = resolution.slots(catalogue(spark, [(1, "a_set.part01.rar", 5, "g"), (2, "a_set.part02.rar", 5, "g"), (3, "b_set.zip", 7, "h")]))
        scored = scoring.scored_pairs(blocking.exact_base_pairs(files), files, why=True)
        plan = scored._jdf.queryExecution().executedPlan()
        found, steps = compiled(spark, plan), plan.toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert found and max(found) < LONGEST and not any("Generate " in line and "*(" not in line for line in steps.splitlines())
