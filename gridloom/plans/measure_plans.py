"""The eight checks measured and graded, for the repositories of the generated tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import evidence, measures, tokens
from gridloom.plans.fleet_plans import GUARDS
from gridloom.plans.tables import with_sql
from gridloom.sources.adapters import logical

BRAND = "lower(replace(p_brand, '#', ''))"


def parts(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/part.parquet").selectExpr(f"{BRAND} as repo_id", "p_partkey as token", "p_size as size", "p_name")


def component_uses(spark: SparkSession, d: str) -> DataFrame:
    """References in the repository of the part that they name, and a raw value now and then."""
    r = logical(spark, d, "refs").select(F.col("token_key").alias("token"), "component", "line")
    return r.join(parts(spark, d).select("repo_id", "token"), "token").select("repo_id", "token", F.concat(F.lit("src/components/c"), F.col("component").cast("string"), F.lit(".css")).alias("path"), "line")


def layered(spark: SparkSession, d: str) -> DataFrame:
    """Parts as tokens: odd keys alias half of theirs, where that is in the same repository."""
    p = parts(spark, d)
    half = F.floor(F.col("token") / 2)
    to = p.select("repo_id", F.col("token").alias("alias_of"))
    own = p.withColumn("alias_of", F.when(F.col("token") % 2 == 1, half)).join(to, ["repo_id", "alias_of"], "left_semi").select("repo_id", "token", "alias_of")
    return p.join(own, ["repo_id", "token"], "left").select("repo_id", "token", F.when(F.col("alias_of").isNotNull(), "semantic").otherwise("primitive").alias("tier"), "alias_of", F.concat(F.col("token").cast("string"), F.lit("px")).alias("value"))


def tier(spark: SparkSession, d: str) -> DataFrame:
    used = component_uses(spark, d)
    raw = used.where("line % 50 = 0").select("repo_id", "path", "line", F.concat(F.col("token").cast("string"), F.lit("px")).alias("literal"))
    return measures.tier_integrity(used.select("repo_id", "path"), used.where("line % 40 = 1"), raw, layered(spark, d))


def leak(spark: SparkSession, d: str) -> DataFrame:
    p = parts(spark, d)
    found = p.where("size < 8").select("repo_id", F.lit("redundant").alias("tier"), F.col("size").cast("string").alias("literal"), (F.col("size") % 3).cast("string").alias("token"), F.lit("a.css").alias("path"), F.col("token").alias("line"))
    return measures.leakage(p, found.where("repo_id <> 'brand4'"), p.where("repo_id <> 'brand5'"))


def cover(spark: SparkSession, d: str) -> DataFrame:
    """Families of theme sheets, defaults of a framework whose version brand9 hides, and gaps where a size is a multiple of seven."""
    t = logical(spark, d, "sheets").select("repo_id", "ord", F.element_at(F.array(*[F.lit(c) for c in measures.CATEGORIES]), (F.col("ord") % 9 + 1).cast("int")).alias("family"))
    repos = t.select("repo_id").distinct()
    default = repos.select("repo_id", F.lit("breakpoint").alias("family"), F.when(F.col("repo_id") != "brand9", "4.1").alias("version"))
    gaps = t.select("repo_id", F.lit("opacity").alias("family"), F.lit("x.css").alias("path"), F.col("ord").alias("line"))
    return measures.coverage(repos, t.where("ord % 11 < 6"), default, gaps)


def naming(spark: SparkSession, d: str) -> DataFrame:
    return measures.naming_coherence(tokens.naming_grammars(logical(spark, d, "sheets").select("repo_id", "path", F.lit("css-custom-property").alias("representation"), F.regexp_replace("name", "^--", "").alias("name"), F.col("ord").alias("line"))))


def source(spark: SparkSession, d: str) -> DataFrame:
    return measures.single_source(logical(spark, d, "sheets").select("repo_id", "path", F.col("ord").alias("line"), "name", "value"))


def unused(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of parts against the references of large orders only."""
    p = parts(spark, d)
    return measures.orphans(p.select("repo_id", "token", F.lit("t.css").alias("path"), F.col("token").alias("line")), component_uses(spark, d).where("line % 100 < 5"))


def modes(spark: SparkSession, d: str) -> DataFrame:
    """Three modes a repository; brand2 declares none, brand3 has a pair without output; parts of size 1 lack the dark one."""
    p = parts(spark, d)
    repos = p.select("repo_id").distinct()
    declared = repos.where("repo_id <> 'brand2'").withColumn("mode", F.explode(F.array(F.lit("light"), F.lit("dark"))))
    pairs = declared.withColumn("bundle", F.lit("main"))
    gaps = p.where("size = 1 and repo_id <> 'brand2'").select("repo_id", "token", F.lit("dark").alias("mode"), F.lit("t.css").alias("path"), F.col("token").alias("line"))
    return measures.mode_completeness(repos, declared, gaps, pairs, pairs.where("repo_id <> 'brand3' or mode = 'dark'"))


def guard(spark: SparkSession, d: str) -> DataFrame:
    c = logical(spark, d, "configs")
    rows = evidence.enforcement(c, evidence.enforcement_rules(c, spark.createDataFrame(GUARDS, "rule string, needle string")))
    return rows.select("repo_id", "grade", F.col("rules").cast("long").alias("measure"), F.get("evidence", F.lit(0)).alias("evidence"))


def everything(spark: SparkSession, d: str) -> DataFrame:
    one = lambda f: f(spark, d)
    return measures.all_grades(tier_integrity=one(tier), leakage=one(leak), coverage=one(cover), mode_completeness=one(modes), naming_coherence=one(naming), single_source=one(source), orphans=one(unused), enforcement=one(guard))


QUERIES = {"measured_grades": everything}

_USES = f"pt AS (SELECT {BRAND} AS repo_id, p_partkey AS token, p_size AS size FROM part), us AS (SELECT p.repo_id, token_key AS token, concat('src/components/c', component, '.css') AS path, line FROM refs JOIN pt p ON p.token = token_key)"
_PARTS = f"""ti AS (SELECT repo_id, count(DISTINCT path) AS n, min(struct_pack(path := path, line := line)) AS m FROM us WHERE (line % 40 = 1 OR line % 50 = 0) AND token IN (SELECT h.token FROM pt h JOIN pt a ON a.token // 2 = h.token AND a.token % 2 = 1 AND a.repo_id = h.repo_id WHERE us.repo_id = h.repo_id AND NOT EXISTS (SELECT 1 FROM pt b WHERE h.token % 2 = 1 AND b.token = h.token // 2 AND b.repo_id = h.repo_id)) GROUP BY 1),
 tg AS (SELECT u.repo_id, coalesce(ti.n, 0) AS n, u.a, ti.m FROM (SELECT repo_id, count(DISTINCT path) AS a FROM us GROUP BY 1) u LEFT JOIN ti USING (repo_id)),
 lk AS (SELECT repo_id, count(DISTINCT size) FILTER (size < 8 AND repo_id <> 'brand4') AS n, min(token) FILTER (size < 8 AND repo_id <> 'brand4') AS l FROM pt GROUP BY 1),
 cv AS (SELECT repo_id, count(DISTINCT ord % 9) FILTER (ord % 11 < 6) + 1 AS n, min(ord) AS l FROM sheets GROUP BY 1),
 nm AS (SELECT repo_id, regexp_replace(name, '^--', '') AS name, ord, path FROM sheets),
 ng AS (SELECT repo_id, CASE WHEN regexp_matches(name, '^[a-z0-9]+(-[a-z0-9]+)+$') THEN 'k' WHEN regexp_matches(name, '^[a-z0-9]+(_[a-z0-9]+)+$') THEN 's' ELSE 'm' END AS gr, min(concat(path, ':', lpad(ord::VARCHAR, 9, '0'))) AS f FROM nm GROUP BY 1, 2), nc AS (SELECT repo_id, count(*) AS n, max(f) AS e FROM ng GROUP BY 1),
 st AS (SELECT repo_id, lower(replace(regexp_replace(name, '^-+', ''), '_', '-')) AS token, count(DISTINCT path) AS si, count(DISTINCT value) AS va, min(struct_pack(path := path, line := ord)) AS m FROM sheets GROUP BY 1, 2), sk AS (SELECT *, CASE WHEN si = 1 THEN 0 WHEN va = 1 THEN 1 ELSE 2 END AS k FROM st),
 ss AS (SELECT repo_id, max(k) AS k, count(*) FILTER (k > 0) AS n, arg_min(concat(m.path, ':', m.line), struct_pack(a := -k, b := m)) FILTER (k > 0) AS e FROM sk GROUP BY 1),
 og AS (SELECT p.repo_id, count(*) AS a, count(*) FILTER (u.token IS NULL) AS n, min(p.token) FILTER (u.token IS NULL) AS l FROM pt p LEFT JOIN (SELECT DISTINCT token FROM us WHERE line % 100 < 5) u ON u.token = p.token GROUP BY 1),
 md AS (SELECT repo_id, count(*) FILTER (size = 1) AS n, min(token) FILTER (size = 1) AS l FROM pt GROUP BY 1)"""
_RULES = "r(rule, needle) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in GUARDS) + "), gh AS (SELECT c.repo_id, r.rule, min(path) || ':2' AS e FROM configs c JOIN r ON contains(lower(c.content), r.needle) WHERE kind <> 3 GROUP BY 1, 2), gn AS (SELECT repo_id, count(DISTINCT rule) AS n, min(e) AS e FROM gh GROUP BY 1)"
ORACLE = {
    "measured_grades": f"""{with_sql("refs", "sheets", "configs")}, {_USES}, {_PARTS}, {_RULES}
      SELECT repo_id, 0 AS check_id, 'tier-integrity' AS "check", CASE WHEN n = 0 THEN 'healthy' WHEN n <= 0.05 * a THEN 'watch' ELSE 'needs-work' END AS grade, n AS measure, CASE WHEN m IS NOT NULL THEN concat(m.path, ':', m.line) END AS evidence FROM tg
      UNION ALL SELECT repo_id, 1, 'leakage', CASE WHEN repo_id = 'brand5' THEN 'not-visible' WHEN n = 0 THEN 'healthy' WHEN n <= 10 THEN 'watch' ELSE 'needs-work' END, CASE WHEN repo_id <> 'brand5' THEN n END, CASE WHEN repo_id <> 'brand5' AND l IS NOT NULL THEN concat('a.css:', l) END FROM lk
      UNION ALL SELECT repo_id, 2, 'coverage', CASE WHEN repo_id = 'brand9' THEN 'not-visible' WHEN n >= 11 THEN 'healthy' WHEN n >= 8 THEN 'watch' ELSE 'needs-work' END, CASE WHEN repo_id <> 'brand9' THEN n END, CASE WHEN repo_id <> 'brand9' THEN concat('x.css:', l) END FROM cv
      UNION ALL SELECT repo_id, 3, 'mode-completeness', CASE WHEN repo_id = 'brand2' THEN 'not-needed' WHEN repo_id = 'brand3' THEN 'not-visible' WHEN n = 0 THEN 'healthy' ELSE 'needs-work' END, CASE WHEN repo_id NOT IN ('brand2', 'brand3') THEN n END, CASE WHEN repo_id <> 'brand2' AND l IS NOT NULL THEN concat('t.css:', l) END FROM md
      UNION ALL SELECT repo_id, 4, 'naming-coherence', CASE WHEN n <= 1 THEN 'healthy' WHEN n = 2 THEN 'watch' ELSE 'needs-work' END, n, e FROM nc
      UNION ALL SELECT repo_id, 5, 'single-source', (['healthy', 'watch', 'needs-work'])[k + 1], n, e FROM ss
      UNION ALL SELECT repo_id, 6, 'orphans', CASE WHEN 100 * n < 2 * a THEN 'healthy' WHEN 100 * n <= 10 * a THEN 'watch' ELSE 'needs-work' END, n, CASE WHEN l IS NOT NULL THEN concat('t.css:', l) END FROM og
      UNION ALL SELECT c.repo_id, 7, 'enforcement', CASE WHEN n >= 2 THEN 'healthy' WHEN n = 1 THEN 'watch' ELSE 'not-visible' END, coalesce(n, 0), e FROM (SELECT DISTINCT repo_id FROM configs) c LEFT JOIN gn USING (repo_id)"""
}
