"""Queries of grades, moves, modes and integrity rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import vocabulary as v
from gridloom.operators import grades as g
from gridloom.operators import discovery, integrity
from gridloom.plans.tables import with_sql
from gridloom.sources.adapters import logical


def capabilities(spark: SparkSession, d: str) -> DataFrame:
    """States of each repository's capabilities: those of the supplier of the same number."""
    c = logical(spark, d, "contributions")
    return logical(spark, d, "grades").select("repo_id").distinct().join(c.groupBy(F.col("profile").alias("k"), "capability").agg(F.min("state").alias("state")), F.col("repo_id") % 25 == F.col("k")).select("repo_id", "capability", "state")


def moves(spark: SparkSession, d: str) -> DataFrame:
    own = logical(spark, d, "grades")
    return g.ranked_moves(own, g.unlock_path(own, capabilities(spark, d)))


def matrix(spark: SparkSession, d: str) -> DataFrame:
    pairs = logical(spark, d, "mode_pairs")
    cells = pairs.where("resolved").select("bundle", "mode", F.explode(F.array(F.lit("color"), F.lit("elevation"))).alias("family"), F.lit("covered").alias("state"))
    families = spark.createDataFrame([(f,) for f in v.FAMILIES[:11]], "family string")
    return g.coverage_matrix(pairs.select("bundle"), pairs.select("mode"), families, cells)


def measures(spark: SparkSession, d: str) -> DataFrame:
    """Per segment of customers, counts that stand for the measures of the checks."""
    c = spark.read.parquet(f"{d}/customer.parquet")
    return c.groupBy((F.col("c_custkey") % 40).alias("repo_id")).agg(F.count(F.when(F.col("c_acctbal") < 0, 1)).alias("skips"), F.count("*").alias("total"), F.countDistinct("c_nationkey").alias("nations"), F.countDistinct("c_mktsegment").alias("segments"), F.count(F.when(F.col("c_acctbal") > 9000, 1)).alias("rich"))


def graded(spark: SparkSession, d: str) -> DataFrame:
    c, none = F.col, F.lit(None).cast("long")
    return measures(spark, d).select(
        "repo_id", g.grade_tier_integrity(c("skips"), c("total") * 2).alias("tier_integrity"), g.grade_leakage(F.when(c("repo_id") % 7 == 0, none).otherwise(c("skips"))).alias("leakage"), g.grade_coverage(c("nations")).alias("coverage"),
        g.grade_modes(c("segments") - 4, c("rich") % 3, F.when(c("repo_id") % 5 == 0, 1).otherwise(0)).alias("mode_completeness"), g.grade_naming(c("segments") - 3).alias("naming"), g.grade_orphans(c("rich"), c("total")).alias("orphans"), g.grade_enforcement(c("rich") % 4).alias("enforcement"),
    )


def steps(spark: SparkSession, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet")
    own = o.select((F.col("o_custkey") % 60).alias("repo_id"), F.substring("o_orderpriority", 1, 1).cast("int").alias("class_ord"), F.col("o_orderkey").alias("id"), F.floor("o_totalprice").alias("reach"), F.when(F.col("o_orderstatus") == "O", F.array("o_orderkey")).otherwise(F.array().cast("array<bigint>")).alias("evidence"))
    return g.next_steps(own).select("repo_id", "class_ord", "id", "reach", "rank")


def rules(spark: SparkSession, d: str) -> DataFrame:
    return integrity.grade_rules(logical(spark, d, "grades").withColumn("note", F.when(F.col("repo_id") % 3 == 0, F.lit("seen"))))


def cover(spark: SparkSession, d: str) -> DataFrame:
    """Declaring files under package roots of several confidences."""
    files = logical(spark, d, "decls").select("path")
    rank = F.element_at(F.array(*[F.lit(c) for c in v.COMPONENT_RANK]), (F.col("p_size") % 5 + 1).cast("int"))
    roots = spark.read.parquet(f"{d}/part.parquet").select(F.concat(F.lit("packages/"), F.lower(F.replace("p_brand", F.lit("#"), F.lit("")))).alias("prefix"), rank.alias("confidence"))
    return discovery.strongest_root(files, roots)


def owners(spark: SparkSession, d: str) -> DataFrame:
    patterns = [("packages/brand1*",), ("packages/*/tokens/color.css",), ("packages/brand23/**",)]
    rules = spark.createDataFrame([(discovery.glob_regex(p),) for (p,) in patterns], "regex string")
    return discovery.ownership(logical(spark, d, "decls").select("path").distinct(), rules)


QUERIES = {
    "root_cover": cover,
    "ownership": owners,
    "namespaces": lambda sp, d: discovery.namespaces(logical(sp, d, "decls").select("repo_id", "name")),
    "grade_counts": lambda sp, d: g.grade_counts(logical(sp, d, "grades")),
    "worst_grade": lambda sp, d: g.worst_grade(logical(sp, d, "grades")),
    "maturity_stage": lambda sp, d: g.maturity_stage(logical(sp, d, "grades")),
    "unlock_path": lambda sp, d: g.unlock_path(logical(sp, d, "grades"), capabilities(sp, d)),
    "ranked_moves": moves,
    "next_steps": steps,
    "coverage_matrix": matrix,
    "mode_gaps": lambda sp, d: g.mode_gaps(logical(sp, d, "concept_modes")),
    "unresolved_pairs": lambda sp, d: g.unresolved_pairs(logical(sp, d, "mode_pairs").select("bundle", "mode"), logical(sp, d, "mode_pairs").where("resolved")),
    "check_grades": graded,
    "adoption_model": lambda sp, d: g.adoption_model(capabilities(sp, d), logical(sp, d, "refs").select((F.col("component") % 50).alias("repo_id"), F.lit(1).alias("references"))),
    "quality_rules": rules,
}

_ALL = "checks(check_id, \"check\") AS (VALUES " + ", ".join(f"({k}, '{c}')" for k, c in enumerate(v.CHECKS)) + "), al AS (SELECT r.repo_id, c.check_id, c.\"check\", coalesce(g.grade, 'not-visible') AS grade FROM (SELECT DISTINCT repo_id FROM grades) r CROSS JOIN checks c LEFT JOIN grades g ON g.repo_id = r.repo_id AND g.check_id = c.check_id)"
_CAPS = "caps AS (SELECT repo_id, capability, min(state) AS state FROM (SELECT DISTINCT repo_id FROM grades) r JOIN contributions k ON repo_id % 25 = profile GROUP BY 1, 2)"
_UNLOCK = "need(\"check\", capability) AS (VALUES " + ", ".join(f"('{c}', {v.CAPABILITIES.index(x)})" for c, xs in g.REQUIRED.items() for x in xs) + "), ul AS (SELECT a.repo_id, n.capability, count(*) AS unlocks, array_to_string(list_sort(list(DISTINCT a.\"check\")), ',') AS checks FROM al a JOIN need n USING (\"check\") JOIN caps c ON c.repo_id = a.repo_id AND c.capability = n.capability WHERE grade = 'not-visible' AND state <> 'verified' GROUP BY 1, 2), unlock AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY unlocks DESC, capability) AS rank FROM ul)"
_MET = lambda c: f"max(CASE WHEN \"check\" = '{c}' AND grade IN ('healthy', 'watch', 'not-needed') THEN 1 ELSE 0 END)"
_STAGE = "w AS (SELECT repo_id, " + ", ".join(f"least(1, {', '.join(map(_MET, needs))}) AS {name}" for name, needs in g.STAGE_NEEDS) + " FROM al GROUP BY 1)"
ORACLE = {
    "root_cover": f"""{with_sql("decls")}, r AS (SELECT concat('packages/', lower(replace(p_brand, '#', ''))) AS prefix, max(p_size % 5) AS k FROM part GROUP BY 1)
      SELECT DISTINCT path, ({v.COMPONENT_RANK})[k + 1] AS confidence FROM decls LEFT JOIN r ON starts_with(path, prefix || '/')""",
    "ownership": f"{with_sql('decls')} SELECT DISTINCT path, CASE WHEN regexp_matches(path, '^packages/(brand1.*|.*/tokens/color[.]css|brand23(/.*)?)$') THEN 'owned' ELSE 'outside' END AS ownership FROM decls",
    "namespaces": f"{with_sql('decls')} SELECT repo_id, split_part(name, '-', 1) AS prefix, count(DISTINCT name) AS dirs FROM decls WHERE contains(name, '-') GROUP BY 1, 2 HAVING count(DISTINCT name) >= 3",
    "grade_counts": f"{with_sql('grades')}, {_ALL} SELECT repo_id, {', '.join(f"count(*) FILTER (grade = '{x}') AS {x.replace('-', '_')}" for x in v.GRADES)} FROM al GROUP BY 1",
    "worst_grade": f"{with_sql('grades')}, {_ALL} SELECT repo_id, arg_min(grade, list_position({v.SEVERITY}, grade)) AS worst FROM al GROUP BY 1",
    "maturity_stage": f"{with_sql('grades')}, {_ALL}, {_STAGE} SELECT repo_id, CASE {' '.join(f"WHEN {n} = 0 THEN '{v.STAGES[k]}'" for k, (n, _) in enumerate(g.STAGE_NEEDS))} ELSE 'held' END AS stage, concat_ws(',', {', '.join(f"CASE WHEN {n} = 1 THEN '{n}' END" for n, _ in g.STAGE_NEEDS)}) AS met FROM w",
    "unlock_path": f"{with_sql('grades', 'contributions')}, {_ALL}, {_CAPS}, {_UNLOCK} SELECT repo_id, capability, unlocks, checks, rank FROM unlock",
    "ranked_moves": f"""{with_sql("grades", "contributions")}, {_ALL}, {_CAPS}, {_UNLOCK}, u AS (SELECT repo_id, 0 AS k, CASE WHEN grade = 'needs-work' THEN 0 ELSE 8 END + check_id AS s, "check" AS what FROM al WHERE grade IN ('needs-work', 'watch') UNION ALL SELECT repo_id, 1, check_id, "check" FROM al WHERE grade = 'not-needed' UNION ALL SELECT repo_id, 2, rank, ({v.CAPABILITIES})[capability + 1] FROM unlock)
      SELECT repo_id, (['fix', 'decide', 'unlock'])[k + 1] AS kind, what, row_number() OVER (PARTITION BY repo_id ORDER BY k, s) AS rank FROM u""",
    "next_steps": "SELECT * FROM (SELECT o_custkey % 60 AS repo_id, CAST(substr(o_orderpriority, 1, 1) AS INT) AS class_ord, o_orderkey AS id, CAST(floor(o_totalprice) AS BIGINT) AS reach, row_number() OVER (PARTITION BY o_custkey % 60 ORDER BY CAST(substr(o_orderpriority, 1, 1) AS INT), floor(o_totalprice) DESC, o_orderkey) AS rank FROM orders WHERE o_orderstatus = 'O') WHERE rank <= 5",
    "coverage_matrix": f"{with_sql('mode_pairs')} SELECT b.bundle, m.mode, family, CASE WHEN p.resolved AND family IN ('color', 'elevation') THEN 'covered' ELSE 'not-visible' END AS state FROM (SELECT DISTINCT bundle FROM mode_pairs) b CROSS JOIN (SELECT DISTINCT mode FROM mode_pairs) m CROSS JOIN (SELECT unnest({v.FAMILIES[:11]}) AS family) f LEFT JOIN mode_pairs p ON p.bundle = b.bundle AND p.mode = m.mode",
    "mode_gaps": f"{with_sql('concept_modes')} SELECT DISTINCT c.token, c.family, m.mode FROM concept_modes c CROSS JOIN (SELECT DISTINCT mode FROM concept_modes) m WHERE family IN ('color', 'elevation') AND NOT EXISTS (SELECT 1 FROM concept_modes x WHERE x.token = c.token AND x.mode = m.mode)",
    "unresolved_pairs": f"{with_sql('mode_pairs')} SELECT bundle, mode FROM mode_pairs WHERE NOT resolved",
    "check_grades": """WITH m AS (SELECT c_custkey % 40 AS repo_id, count(*) FILTER (c_acctbal < 0) AS skips, count(*) AS total, count(DISTINCT c_nationkey) AS nations, count(DISTINCT c_mktsegment) AS segments, count(*) FILTER (c_acctbal > 9000) AS rich FROM customer GROUP BY 1)
      SELECT repo_id, CASE WHEN skips = 0 THEN 'healthy' WHEN skips <= 0.05 * total * 2 THEN 'watch' ELSE 'needs-work' END AS tier_integrity, CASE WHEN repo_id % 7 = 0 THEN 'not-visible' WHEN skips = 0 THEN 'healthy' WHEN skips <= 10 THEN 'watch' ELSE 'needs-work' END AS leakage,
       CASE WHEN nations >= 11 THEN 'healthy' WHEN nations >= 8 THEN 'watch' ELSE 'needs-work' END AS coverage, CASE WHEN segments = 4 THEN 'not-needed' WHEN repo_id % 5 = 0 THEN 'not-visible' WHEN rich % 3 = 0 THEN 'healthy' ELSE 'needs-work' END AS mode_completeness,
       CASE WHEN segments - 3 <= 1 THEN 'healthy' WHEN segments - 3 = 2 THEN 'watch' ELSE 'needs-work' END AS naming, CASE WHEN 100 * rich < 2 * total THEN 'healthy' WHEN 100 * rich <= 10 * total THEN 'watch' ELSE 'needs-work' END AS orphans,
       CASE WHEN rich % 4 >= 2 THEN 'healthy' WHEN rich % 4 = 1 THEN 'watch' ELSE 'not-visible' END AS enforcement FROM m""",
    "adoption_model": f"{with_sql('grades', 'contributions', 'refs')}, {_CAPS} SELECT c.repo_id, CASE WHEN state = 'verified' AND EXISTS (SELECT 1 FROM refs WHERE component % 50 = c.repo_id) THEN 'token-led-hybrid' ELSE 'assess-first' END AS model FROM caps c WHERE capability = 1",
    "quality_rules": f"""{with_sql("grades")}, {_ALL} SELECT repo_id, 'not-visible-needs-note' AS rule, "check" AS detail FROM al WHERE grade = 'not-visible' AND repo_id % 3 <> 0 UNION ALL SELECT repo_id, 'unexplained-not-needed', "check" FROM al WHERE grade = 'not-needed' AND repo_id % 3 <> 0""",
}
