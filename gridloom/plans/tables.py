"""Inputs of the registered queries, in Spark and, for comparison, as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import scalars as s
from gridloom.functions import vocabulary as v
from gridloom.operators import tokens
from gridloom.sources.adapters import logical, other_sql


def aliased(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declarations with alias_of as the id of the concept that the key column points at."""
    d = logical(spark, sf_dir, "decls")
    target = d.select(F.col("line").alias("alias_of_key"), s.normalize(F.col("name")).alias("alias_of"))
    return d.join(target, "alias_of_key", "left")


def concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.tiers(tokens.resolve_aliases(tokens.collapse_concepts(aliased(spark, sf_dir))))


def linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declarations as concepts of their own key: token, tier, alias_of, family, value."""
    d = logical(spark, sf_dir, "decls")
    tier = F.when(F.col("alias_of_key").isNotNull(), "semantic").otherwise("primitive")
    return d.select(F.col("line").alias("token"), tier.alias("tier"), F.col("alias_of_key").alias("alias_of"), s.family_for(F.col("name"), F.col("value")).alias("family"), "value")


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = logical(spark, sf_dir, "refs")
    return r.join(linked(spark, sf_dir).select(F.col("token").alias("token_key"), "family"), "token_key").withColumnRenamed("token_key", "token")


def norm_sql(c: str) -> str:
    return rf"lower(replace(regexp_replace({c}, '^[-$]+', ''), '_', '-'))"


def family_sql(name: str, value: str) -> str:
    key = rf"lower(regexp_replace(regexp_replace(regexp_replace({name}, '^[-$]+', ''), '([a-z0-9])([A-Z])', '\1-\2', 'g'), '[_.\s]+', '-', 'g'))"
    has = lambda names: "(" + " OR ".join(f"concat('-', {key}, '-') LIKE '%-{n}-%'" for n in names) + ")"
    out = "".join(f" WHEN {has(v.FAMILY_NAMES[f])} THEN '{f}'" for f in v.STRUCTURAL)
    out += rf" WHEN regexp_matches({value}, '(?i)(#[0-9a-f]{{3,8}}\b|(rgb|hsl|oklch|lab|color)\()') OR {has(v.COLOR_NAMES)} THEN 'color' WHEN {has(v.FAMILY_NAMES['icon'])} THEN 'icon'"
    out += f" WHEN {has(v.FAMILY_NAMES['typography'])} OR {key} = 'type' OR {key} LIKE 'type-%' THEN 'typography'"
    out += "".join(f" WHEN {has(v.FAMILY_NAMES[f])} THEN '{f}'" for f in ("spacing", "sizing", "opacity"))
    return f"CASE{out} ELSE 'unclassified' END"


def declared_sql(name: str) -> str:
    has = lambda names: "(" + " OR ".join(f"concat('-', {norm_sql(name)}, '-') LIKE '%-{n}-%'" for n in names) + ")"
    return "CASE" + "".join(f" WHEN {has(names)} THEN '{tier}'" for tier, names in v.TIER_MARKERS) + " END"


def with_sql(*names: str) -> str:
    """WITH and the logical tables, as common table expressions; more may follow after a comma."""
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({other_sql(n)})" for n in names)


LINKED = f"linked AS (SELECT line AS token, CASE WHEN alias_of_key IS NOT NULL THEN 'semantic' ELSE 'primitive' END AS tier, alias_of_key AS alias_of, {family_sql('name', 'value')} AS family, value FROM decls)"
CONCEPTS = f"""
d AS (SELECT a.*, {norm_sql("a.name")} AS id, {family_sql("a.name", "a.value")} AS family, {norm_sql("b.name")} AS alias_of FROM decls a LEFT JOIN decls b ON a.alias_of_key = b.line),
c0 AS (SELECT repo_id, id, count(DISTINCT name) AS names, count(DISTINCT value) AS n_values, count(*) AS definitions, list(name ORDER BY path, ord)[1] AS first_name, list(concat(path, ':', line) ORDER BY path, ord)[1] AS first_site,
 coalesce((list(family ORDER BY path, ord) FILTER (family <> 'unclassified'))[1], 'unclassified') AS family, (list(alias_of ORDER BY path DESC, ord DESC) FILTER (alias_of IS NOT NULL))[1] AS alias_of FROM d GROUP BY 1, 2),
concepts AS (SELECT c.*, CASE WHEN c.alias_of IS NOT NULL THEN EXISTS (SELECT 1 FROM c0 k WHERE k.id = c.alias_of) END AS alias_resolved,
 coalesce({declared_sql("c.first_name")}, CASE WHEN c.alias_of IS NOT NULL THEN 'semantic' ELSE 'primitive' END) AS tier FROM c0 c)"""
