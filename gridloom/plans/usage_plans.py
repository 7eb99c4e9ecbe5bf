"""Queries of usage, utilities, themes and contrast."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import usage
from gridloom.operators.ranks import ranked
from gridloom.plans.tables import LINKED, refs, with_sql
from gridloom.sources.adapters import logical


def rollup(spark: SparkSession, d: str) -> DataFrame:
    return usage.component_rollup(refs(spark, d))


def rollup_rows(spark: SparkSession, d: str) -> DataFrame:
    families = F.array_join(F.transform("families", lambda x: F.concat_ws("=", x["family"], x["n"].cast("string"))), ",")
    return rollup(spark, d).withColumn("families", families).withColumn("syntaxes", F.array_join("syntaxes", ","))


def top(spark: SparkSession, d: str) -> DataFrame:
    own = rollup(spark, d).withColumn("is_component", F.col("component") % 9 == 0)
    return usage.top_components(own).select("repo_id", "component", "is_component", "references", "distinct_tokens", "rank")


def bands(spark: SparkSession, d: str) -> DataFrame:
    ranked = usage.rank_components(rollup(spark, d)).where("rank <= 20").select("repo_id", "component", "references", "rank")
    return usage.roadmap_bands(ranked)


def themes(spark: SparkSession, d: str) -> DataFrame:
    t = logical(spark, d, "theme")
    return usage.merge_theme(t.where("origin = 'default'"), t.where("origin = 'project'"))


def known(spark: SparkSession, d: str) -> DataFrame:
    """References outside of the files of brand 7, which stand for definitions here."""
    from gridloom.plans.tables import linked

    r = logical(spark, d, "refs").withColumnRenamed("token_key", "token")
    own = usage.known_refs(r, linked(spark, d).where("family <> 'unclassified'"), r.where("path like 'packages/brand7/%'"))
    return own.groupBy("family", "syntax").agg(F.count("*").alias("references"), F.countDistinct("token").alias("tokens"))


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each brand's colors as a theme: every token against the next five of its theme, which it meets by their places in the theme's order."""
    toks = logical(spark, d, "decls").where("value like '#%'").select(F.regexp_extract("path", "/([^/]+)/tokens", 1).alias("repo_id"), F.concat(F.lit("t"), F.col("line").cast("string")).alias("name"), "value", "line")
    placed = ranked(toks, ["line"])
    ahead = placed.select("repo_id", F.col("name").alias("fg"), F.explode(F.sequence(F.col("rank") + 1, F.col("rank") + 5)).alias("rank"), F.when(F.col("line") % 2 == 1, 4.5).otherwise(3.0).alias("minimum"))
    wanted = ahead.join(placed.select("repo_id", "rank", F.col("name").alias("bg")), ["repo_id", "rank"]).select("fg", "bg", "minimum")
    return usage.contrast_pairs(toks.withColumnRenamed("repo_id", "theme"), wanted)


QUERIES = {
    "component_rollup": rollup_rows,
    "component_top20": top,
    "roadmap_bands": bands,
    "band_rollup": lambda sp, d: usage.band_rollup(bands(sp, d)),
    "usage_totals": lambda sp, d: usage.usage_totals(refs(sp, d)),
    "known_refs": known,
    "theme_merge": themes,
    "utility_resolution": lambda sp, d: usage.resolve_utilities(logical(sp, d, "classes"), usage.prefix_table(sp), themes(sp, d)),
    "namespace_coverage": lambda sp, d: usage.namespace_coverage(themes(sp, d), usage.prefix_table(sp)),
    "contrast_pairs": pairs,
}

_ROLL = f"""{LINKED}, r AS (SELECT r.*, k.family FROM refs r JOIN linked k ON k.token = r.token_key), f AS (SELECT component, family, count(*) AS n FROM r GROUP BY 1, 2),
 roll AS (SELECT component, sum(n)::BIGINT AS "references", array_to_string(list(concat(family, '=', n) ORDER BY family), ',') AS families, (SELECT count(DISTINCT token_key) FROM r WHERE r.component = f.component) AS distinct_tokens,
  (SELECT array_to_string(list_sort(list(DISTINCT syntax)), ',') FROM r WHERE r.component = f.component) AS syntaxes FROM f GROUP BY 1)"""
_BANDS = """k AS (SELECT component, "references", row_number() OVER (ORDER BY "references" DESC, distinct_tokens DESC, component) AS rank FROM roll), m AS (SELECT * FROM k WHERE rank <= 20),
 b AS (SELECT *, sum("references") OVER () AS total, coalesce(sum("references") OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM m),
 bands AS (SELECT 'fleet' AS repo_id, component, "references", rank, round(100.0::DOUBLE * "references" / total, 1) AS share, round(100.0::DOUBLE * (before + "references") / total, 1) AS cumulative_share,
  CASE WHEN before * 100 < 50 * total THEN 'assess-first' WHEN before * 100 < 80 * total THEN 'plan-next' ELSE 'focused-follow-up' END AS band FROM b)"""
_PREFIX = "p(prefix, ord, namespace) AS (VALUES " + ", ".join(f"('{p}', {k}, '{n}')" for p, names in usage.UTILITY_PREFIXES for k, n in enumerate(names)) + ")"
_THEME = "dm AS (SELECT namespace, key, min(value) AS v FROM theme WHERE origin = 'default' GROUP BY 1, 2), pm AS (SELECT namespace, key, min(value) AS v FROM theme WHERE origin = 'project' GROUP BY 1, 2), merged AS (SELECT namespace, key, coalesce(pm.v, dm.v) AS value, CASE WHEN pm.v IS NOT NULL THEN 'project' ELSE 'default' END AS origin FROM dm FULL JOIN pm USING (namespace, key))"
ORACLE = {
    "component_rollup": f"{with_sql('decls', 'refs')}, {_ROLL} SELECT 'fleet' AS repo_id, * FROM roll",
    "component_top20": f"{with_sql('decls', 'refs')}, {_ROLL}, k AS (SELECT *, component % 9 = 0 AS is_component, row_number() OVER (ORDER BY component % 9 = 0 DESC, \"references\" DESC, distinct_tokens DESC, component) AS rank FROM roll) SELECT 'fleet' AS repo_id, component, is_component, \"references\", distinct_tokens, rank FROM k WHERE rank <= 20",
    "roadmap_bands": f"{with_sql('decls', 'refs')}, {_ROLL}, {_BANDS} SELECT * FROM bands",
    "band_rollup": f"{with_sql('decls', 'refs')}, {_ROLL}, {_BANDS} SELECT repo_id, band, min(rank) AS start_rank, max(rank) AS end_rank, count(*) AS components, sum(\"references\")::BIGINT AS \"references\" FROM bands GROUP BY 1, 2",
    "usage_totals": f"{with_sql('decls', 'refs')}, {_ROLL} SELECT 'fleet' AS repo_id, count(*) AS components, sum(\"references\")::BIGINT AS \"references\", greatest(count(*) - 20, 0) AS not_shown FROM roll",
    "known_refs": f"{with_sql('decls', 'refs')}, {LINKED} SELECT family, syntax, count(*) AS \"references\", count(DISTINCT token_key) AS tokens FROM refs JOIN linked ON token = token_key WHERE path NOT LIKE 'packages/brand7/%' AND family <> 'unclassified' GROUP BY 1, 2",
    "theme_merge": f"{with_sql('theme')}, {_THEME} SELECT * FROM merged",
    "utility_resolution": f"""{with_sql("classes", "theme")}, {_PREFIX}, {_THEME}, c AS (SELECT DISTINCT class FROM classes), x AS (SELECT class, arg_max(prefix, length(prefix)) AS prefix FROM c JOIN (SELECT DISTINCT prefix FROM p) q ON class = prefix OR class LIKE prefix || '-%' GROUP BY 1),
      y AS (SELECT class, ord, namespace, ltrim(substr(class, length(x.prefix) + 1), '-') AS key FROM x JOIN p USING (prefix)),
      z AS (SELECT y.*, EXISTS (SELECT 1 FROM merged m WHERE m.namespace = y.namespace AND m.key = y.key) AS named, EXISTS (SELECT 1 FROM merged m WHERE m.namespace = y.namespace AND m.key = '') AND regexp_matches(key, '^\\d+(\\.\\d+)?$') AS step FROM y),
      s AS (SELECT class, count(*) FILTER (named) AS n, min(CASE WHEN key = '' THEN namespace ELSE concat(namespace, '-', key) END) FILTER (named) AS c, arg_min(namespace, ord) FILTER (step AND NOT named) AS d FROM z GROUP BY 1)
      SELECT class, CASE WHEN n > 1 THEN 'ambiguous' WHEN n = 1 OR d IS NOT NULL THEN 'resolved' ELSE 'unresolved' END AS state, CASE WHEN n = 1 THEN s.c WHEN n = 0 THEN d END AS concept, coalesce(n = 0 AND d IS NOT NULL, false) AS derived FROM c LEFT JOIN s USING (class)""",
    "namespace_coverage": f"{with_sql('theme')}, {_PREFIX}, {_THEME} SELECT namespace, count(*) AS keys, CASE WHEN namespace IN (SELECT namespace FROM p) THEN 'covered' WHEN namespace IN ('default', 'breakpoint') THEN 'non-utility' ELSE 'uncovered' END AS state FROM merged GROUP BY 1",
    "contrast_pairs": f"""{with_sql("decls")}, t AS (SELECT regexp_extract(path, '/([^/]+)/tokens', 1) AS theme, line AS k, value, row_number() OVER (PARTITION BY regexp_extract(path, '/([^/]+)/tokens', 1) ORDER BY line) AS p FROM decls WHERE value LIKE '#%'),
      rgb AS (SELECT *, [CAST(concat('0x', substr(value, 2, 2)) AS INT) / 255.0::DOUBLE, CAST(concat('0x', substr(value, 4, 2)) AS INT) / 255.0::DOUBLE, CAST(concat('0x', substr(value, 6, 2)) AS INT) / 255.0::DOUBLE] AS c FROM t),
      lin AS (SELECT theme, k, p, 0.2126::DOUBLE * CASE WHEN c[1] <= 0.03928 THEN c[1] / 12.92::DOUBLE ELSE pow((c[1] + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4) END + 0.7152::DOUBLE * CASE WHEN c[2] <= 0.03928 THEN c[2] / 12.92::DOUBLE ELSE pow((c[2] + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4) END
       + 0.0722::DOUBLE * CASE WHEN c[3] <= 0.03928 THEN c[3] / 12.92::DOUBLE ELSE pow((c[3] + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4) END AS l FROM rgb),
      q AS (SELECT a.theme, concat('t', a.k) AS fg, concat('t', b.k) AS bg, (greatest(a.l, b.l) + 0.05::DOUBLE) / (least(a.l, b.l) + 0.05::DOUBLE) AS r, CASE WHEN a.k % 2 = 1 THEN 4.5 ELSE 3.0 END AS m FROM lin a JOIN lin b ON a.theme = b.theme AND b.p BETWEEN a.p + 1 AND a.p + 5)
      SELECT theme, fg, bg, round(r, 4) AS ratio, r >= m AS ok FROM q""",
}
