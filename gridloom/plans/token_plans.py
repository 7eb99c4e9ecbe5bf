"""Queries of concepts, leaks and lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import scalars as s
from gridloom.functions import vocabulary as v
from gridloom.operators import graphs, leaks, tokens
from gridloom.plans.tables import CONCEPTS, LINKED, aliased, concepts, family_sql, linked, norm_sql, with_sql
from gridloom.sources.adapters import logical


def concept_collapse(spark: SparkSession, d: str) -> DataFrame:
    c = tokens.collapse_concepts(aliased(spark, d))
    return c.select("repo_id", "id", F.size("names").alias("names"), F.size("values").alias("n_values"), "definitions", F.get("names", F.lit(0)).alias("first_name"), F.get("sites", F.lit(0)).alias("first_site"), "family", "alias_of")


def tier_rows(spark: SparkSession, d: str) -> DataFrame:
    return concepts(spark, d).select("repo_id", "id", "tier", "alias_resolved")


def family_states(spark: SparkSession, d: str) -> DataFrame:
    """Sources under packages of even brands are held out here, so that all three states occur."""
    own = aliased(spark, d).withColumn("_even", F.regexp_extract("path", r"brand(\d+)", 1).cast("int") % 2 == 0)
    hidden = own.where("_even").select("repo_id", s.family_for(F.col("name"), F.col("value")).alias("family")).where("family <> 'color'")
    seen = own.where("not _even and value like '#%'").drop("_even")
    return tokens.family_states(tokens.collapse_concepts(seen), hidden)


def pixel_rows(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Literal lengths from quantities, and the steps of a scale from declared pixel values."""
    lits = spark.read.parquet(f"{d}/lineitem.parquet").select(F.lit("fleet").alias("repo_id"), (F.col("l_quantity") + F.col("l_linenumber") % 4 * 0.5).cast("double").alias("px")).distinct().withColumn("literal", F.concat(F.round(F.col("px") * 10).cast("long").cast("string"), F.lit("tenths")))
    steps = logical(spark, d, "decls").where("value like '%px'").select("repo_id", s.family_for(F.col("name"), F.col("value")).alias("family"), F.regexp_extract("value", r"^(\d+)px$", 1).cast("double").alias("px"))
    return lits, steps


def near_dimension(spark: SparkSession, d: str) -> DataFrame:
    return leaks.near_miss_dimension(*pixel_rows(spark, d))


def near_duration(spark: SparkSession, d: str) -> DataFrame:
    lits, steps = pixel_rows(spark, d)
    return leaks.near_miss_duration(lits.withColumn("px", F.col("px") * 10), steps.withColumn("px", F.col("px") * 20 + 7))


def near_color(spark: SparkSession, d: str) -> DataFrame:
    toks = logical(spark, d, "decls").where("value like '#%'").select("repo_id", s.normalize(F.col("name")).alias("token"), "value")
    return leaks.near_miss_color(logical(spark, d, "literals"), toks)


def proven_values(decls: DataFrame) -> DataFrame:
    """Values that a style variable declares: a literal that equals one is redundant beside it."""
    return decls.where("representation = 'scss-variable' and value like '#%'").groupBy("repo_id", F.col("value").alias("literal")).agg(F.min(s.normalize(F.col("name"))).alias("token"))


def cascade(spark: SparkSession, d: str) -> DataFrame:
    lits, decls = logical(spark, d, "literals"), logical(spark, d, "decls")
    exact = leaks.exact_value_leaks(lits, decls).where("token_candidates is not null").select("repo_id", "literal", F.col("token_candidates").alias("token"))
    return leaks.leak_cascade(lits, proven_values(decls), exact, near_color(spark, d))


def chains(spark: SparkSession, d: str) -> DataFrame:
    return graphs.alias_chains(linked(spark, d).select("token", "tier", "alias_of"))


def chain_rows(spark: SparkSession, d: str) -> DataFrame:
    return chains(spark, d).select("token", "length", F.element_at("hops", -1).alias("last"), "complete", "stops_at", "note")


def traceable(spark: SparkSession, d: str) -> DataFrame:
    own = chains(spark, d).join(linked(spark, d).select("token", "family"), "token")
    return graphs.traceable_families(own.withColumn("family", F.concat_ws("-", "family", (F.col("token") % 40).cast("string"))))


def uses(spark: SparkSession, d: str) -> DataFrame:
    return logical(spark, d, "refs").select(F.col("token_key").alias("token"), "component")


def duplicates(spark: SparkSession, d: str) -> DataFrame:
    l = linked(spark, d)  # noqa: E741
    own = chains(spark, d).select(F.lit("fleet").alias("repo_id"), "token", F.element_at("hops", -1).alias("root")).join(l.select(F.col("token").alias("root"), F.col("value").alias("root_value")), "root")
    return tokens.duplicate_values(own, l.where("alias_of is not null").select(F.lit("fleet").alias("repo_id"), F.col("token").alias("src")))


def preview(spark: SparkSession, d: str) -> DataFrame:
    return leaks.location_preview(logical(spark, d, "literals").select("repo_id", F.col("literal").alias("id"), "path", "line"))


def queue(spark: SparkSession, d: str) -> DataFrame:
    """Leaks with a replacement: proven where a style variable has the value, else left to a reviewer."""
    decls = logical(spark, d, "decls")
    rows = leaks.exact_value_leaks(logical(spark, d, "literals"), decls).drop("confidence", "score").join(proven_values(decls), ["repo_id", "literal"], "left").withColumn("proven", F.col("token").isNotNull())
    tier, confidence = F.when(F.col("proven"), "redundant").otherwise(F.col("tier")), F.when(F.col("proven"), "exact static match").otherwise("manual review")
    own = rows.select("repo_id", "id", tier.alias("tier"), "literal", F.coalesce("token", "token_candidates").alias("token"), "occurrences", "files", "breadth", confidence.alias("confidence"), "proven")
    return leaks.fix_queue(own.withColumn("score", s.score(F.col("occurrences"), F.col("files"), F.col("breadth"), F.col("confidence")))).drop("proven")


def reach(spark: SparkSession, d: str) -> DataFrame:
    return graphs.reachable(logical(spark, d, "edges"), spark.createDataFrame([(0,)], "node long")).select("node", "depth", F.array_join(F.col("via").cast("array<string>"), ">").alias("via"))


def unreached(spark: SparkSession, d: str) -> DataFrame:
    files = logical(spark, d, "edges").select(F.col("dst").alias("file")).distinct()
    seen = graphs.reachable(logical(spark, d, "edges"), spark.createDataFrame([(1,)], "node long"), terminal=files.where("file % 3 = 0").select(F.col("file").alias("node")))
    return graphs.orphan_files(files.withColumn("node", F.col("file")), seen).select("file")


def unused(spark: SparkSession, d: str) -> DataFrame:
    """All declared tokens, with one of each supplier that no reference has a key for."""
    more = spark.read.parquet(f"{d}/supplier.parquet").select((-1 - F.col("s_suppkey")).alias("token"), F.lit("sizing").alias("family"))
    return graphs.orphan_tokens(linked(spark, d).select("token", "family").union(more), uses(spark, d))


QUERIES = {
    "exact_value_leaks": lambda sp, d: leaks.exact_value_leaks(logical(sp, d, "literals"), logical(sp, d, "decls")),
    "literal_groups": lambda sp, d: leaks.literal_groups(logical(sp, d, "literals")).withColumn("properties", F.array_join("properties", ",")),
    "finding_rank": lambda sp, d: leaks.rank_findings(leaks.exact_value_leaks(logical(sp, d, "literals"), logical(sp, d, "decls"))).select("repo_id", "id", "score", "rank"),
    "concept_collapse": concept_collapse,
    "conflicts": lambda sp, d: tokens.conflicts(tokens.collapse_concepts(aliased(sp, d))),
    "tiers": tier_rows,
    "lineage_totals": lambda sp, d: tokens.lineage_totals(concepts(sp, d)),
    "family_states": family_states,
    "family_inventory": lambda sp, d: tokens.family_inventory(concepts(sp, d)),
    "single_source": lambda sp, d: tokens.single_source(logical(sp, d, "decls")),
    "naming_grammars": lambda sp, d: tokens.naming_grammars(logical(sp, d, "decls")),
    "ramps_outliers": lambda sp, d: tokens.ramps(concepts(sp, d)),
    "near_miss_dimension": near_dimension,
    "near_miss_duration": near_duration,
    "near_miss_color": near_color,
    "leak_cascade": cascade,
    "owner_groups": lambda sp, d: leaks.owner_groups(logical(sp, d, "literals")),
    "location_preview": preview,
    "fix_queue": queue,
    "reachability": reach,
    "orphans_files": unreached,
    "orphan_tokens": unused,
    "alias_chains": chain_rows,
    "blast_radius": lambda sp, d: graphs.blast_radius(linked(sp, d), uses(sp, d)),
    "traceable_families": traceable,
    "lineage_summary": lambda sp, d: graphs.lineage_summary(chains(sp, d), uses(sp, d)),
    "entry_ranks": lambda sp, d: graphs.entry_ranks(logical(sp, d, "edges")),
    "duplicate_values": duplicates,
}

_GROUPS = "g AS (SELECT repo_id, lower(literal) AS literal, count(*) AS occurrences, count(DISTINCT path) AS files, count(DISTINCT split_part(path, '/', 2)) AS breadth, array_to_string(list_sort(list(DISTINCT property)), ',') AS properties FROM literals GROUP BY 1, 2)"
_LEAKS = f"""{_GROUPS}, t AS (SELECT value AS literal, array_to_string(list_sort(list(DISTINCT {norm_sql("name")})), ',') AS token_candidates FROM decls WHERE representation = 'css-custom-property' AND {family_sql("name", "value")} = 'color' GROUP BY 1),
 l AS (SELECT g.*, token_candidates, CASE WHEN token_candidates IS NULL THEN 'uncovered-candidate' ELSE 'exact-value-candidate' END AS tier FROM g LEFT JOIN t USING (literal)),
 leaks AS (SELECT repo_id, substr(sha1(concat(tier, '|color|', literal, '|', coalesce(token_candidates, ''))), 1, 12) AS id, tier, literal, token_candidates, occurrences, files, breadth, 'manual review' AS confidence, round((occurrences + 2 * files + 3 * breadth) * 0.4::DOUBLE, 2) AS score FROM l)"""
_PROVEN = f"r AS (SELECT value AS literal, min({norm_sql('name')}) AS token FROM decls WHERE representation = 'scss-variable' AND value LIKE '#%' GROUP BY 1)"


def _lab_sql(name: str, rows: str) -> str:
    """Tables that end with name: the rows (token, hex), with the l, a and b of hex."""
    part = lambda at: f"CAST(concat('0x', substr(hex, {at}, 2)) AS INT) / 255.0::DOUBLE"
    linear = lambda c: f"CASE WHEN {c} <= 0.04045 THEN {c} / 12.92::DOUBLE ELSE pow(({c} + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4::DOUBLE) END"
    f = lambda t: f"CASE WHEN {t} > 216.0::DOUBLE / 24389 THEN cbrt({t}) ELSE (24389.0::DOUBLE / 27 * {t} + 16) / 116 END"
    mix = lambda x, y, z: f"{x}::DOUBLE * r + {y}::DOUBLE * g + {z}::DOUBLE * b"
    return f"""{name}1 AS (SELECT token, hex, {part(2)} AS r, {part(4)} AS g, {part(6)} AS b FROM ({rows}) WHERE regexp_matches(hex, '^#[0-9a-f]{{6}}$')),
 {name}2 AS (SELECT token, hex, {linear("r")} AS r, {linear("g")} AS g, {linear("b")} AS b FROM {name}1),
 {name}3 AS (SELECT token, hex, ({mix("0.4124564", "0.3575761", "0.1804375")}) / 0.95047::DOUBLE AS x, {mix("0.2126729", "0.7151522", "0.0721750")} AS y, ({mix("0.0193339", "0.1191920", "0.9503041")}) / 1.08883::DOUBLE AS z FROM {name}2),
 {name}4 AS (SELECT token, hex, {f("x")} AS x, {f("y")} AS y, {f("z")} AS z FROM {name}3), {name} AS (SELECT token, hex, 116 * y - 16 AS l, 500 * (x - y) AS a, 200 * (y - z) AS b FROM {name}4)"""


#: Every literal against every token, without cells.
_NEAR_COLOR = f"""{_lab_sql("lq", f"SELECT DISTINCT {norm_sql('name')} AS token, value AS hex FROM decls WHERE value LIKE '#%'")}, {_lab_sql("lp", "SELECT DISTINCT NULL AS token, lower(literal) AS hex FROM literals")},
 n1 AS (SELECT lp.hex AS literal, lq.token, lq.hex AS value, lp.l AS l1, lq.l AS l2, lp.a AS a1, lq.a AS a2, lp.b AS b1, lq.b AS b2, pow((sqrt(lp.a * lp.a + lp.b * lp.b) + sqrt(lq.a * lq.a + lq.b * lq.b)) / 2, 7) AS k FROM lp CROSS JOIN lq WHERE lp.hex NOT IN (SELECT hex FROM lq)),
 n2 AS (SELECT * REPLACE (a1 * (1.5::DOUBLE - 0.5::DOUBLE * sqrt(k / (k + pow(25.0::DOUBLE, 7)))) AS a1, a2 * (1.5::DOUBLE - 0.5::DOUBLE * sqrt(k / (k + pow(25.0::DOUBLE, 7)))) AS a2) FROM n1),
 n3 AS (SELECT *, sqrt(a1 * a1 + b1 * b1) AS c1, sqrt(a2 * a2 + b2 * b2) AS c2, CASE WHEN a1 = 0 AND b1 = 0 THEN 0 ELSE (degrees(atan2(b1, a1)) + 360) % 360 END AS h1, CASE WHEN a2 = 0 AND b2 = 0 THEN 0 ELSE (degrees(atan2(b2, a2)) + 360) % 360 END AS h2 FROM n2),
 n4 AS (SELECT *, CASE WHEN c1 * c2 = 0 THEN 0 WHEN abs(h2 - h1) <= 180 THEN h2 - h1 WHEN h2 > h1 THEN h2 - h1 - 360 ELSE h2 - h1 + 360 END AS dh,
  CASE WHEN c1 * c2 = 0 THEN h1 + h2 WHEN abs(h2 - h1) <= 180 THEN (h1 + h2) / 2 WHEN h1 + h2 < 360 THEN (h1 + h2 + 360) / 2 ELSE (h1 + h2 - 360) / 2 END AS mh, (c1 + c2) / 2 AS mc, pow((l1 + l2) / 2 - 50, 2) AS ml FROM n3),
 n5 AS (SELECT *, 1 - 0.17::DOUBLE * cos(radians(mh - 30)) + 0.24::DOUBLE * cos(radians(2 * mh)) + 0.32::DOUBLE * cos(radians(3 * mh + 6)) - 0.20::DOUBLE * cos(radians(4 * mh - 63)) AS t,
  -sin(radians(60 * exp(-pow((mh - 275) / 25, 2)))) * 2 * sqrt(pow(mc, 7) / (pow(mc, 7) + pow(25.0::DOUBLE, 7))) AS rt FROM n4),
 n6 AS (SELECT literal, token, value, rt, (l2 - l1) / (1 + 0.015::DOUBLE * ml / sqrt(20 + ml)) AS x, (c2 - c1) / (1 + 0.045::DOUBLE * mc) AS y, 2 * sqrt(c1 * c2) * sin(radians(dh / 2)) / (1 + 0.015::DOUBLE * mc * t) AS z FROM n5),
 n7 AS (SELECT literal, token, value, sqrt(x * x + y * y + z * z + rt * y * z) AS de FROM n6),
 near AS (SELECT 'fleet' AS repo_id, literal, token, value, round(de, 6) AS delta_e FROM (SELECT *, row_number() OVER (PARTITION BY literal ORDER BY de, token, value) AS place FROM n7) WHERE place = 1 AND de < 3)"""
_CHAINS = f"""{LINKED}, w AS (SELECT token, [token] AS hops, token AS at, tier, alias_of, CAST(NULL AS VARCHAR) AS note, false AS done FROM linked
 UNION ALL SELECT w.token, CASE WHEN k.token IS NOT NULL AND NOT list_contains(w.hops, w.alias_of) THEN list_append(w.hops, k.token) ELSE w.hops END, k.token, CASE WHEN k.token IS NOT NULL AND NOT list_contains(w.hops, w.alias_of) THEN k.tier ELSE w.tier END,
  CASE WHEN list_contains(w.hops, w.alias_of) OR k.token IS NULL THEN w.alias_of ELSE k.alias_of END, CASE WHEN list_contains(w.hops, w.alias_of) THEN 'cycle' WHEN k.token IS NULL THEN 'not found' END, list_contains(w.hops, w.alias_of) OR k.token IS NULL
  FROM w LEFT JOIN linked k ON k.token = w.alias_of WHERE w.alias_of IS NOT NULL AND NOT w.done),
 chains AS (SELECT token, hops, len(hops) AS length, (note IS NULL AND tier = 'primitive') AS complete, alias_of AS stops_at, note FROM w WHERE done OR alias_of IS NULL)"""
_STEPS = f"""lits AS (SELECT DISTINCT CAST(l_quantity + l_linenumber % 4 * 0.5 AS DOUBLE) AS px FROM lineitem), lit AS (SELECT px, concat(CAST(round(px * 10) AS BIGINT), 'tenths') AS literal FROM lits),
 steps AS (SELECT DISTINCT {family_sql("name", "value")} AS family, CAST(regexp_extract(value, '^(\\d+)px$', 1) AS DOUBLE) AS px FROM decls WHERE value LIKE '%px'), st AS (SELECT * FROM steps)"""


def _near(lit: str, step: str, tolerance: int, gap: int) -> str:
    return f"""{with_sql("decls")}, {_STEPS}, a AS ({lit}), b AS ({step}),
    c AS (SELECT *, least(coalesce(px - lag(px) OVER w, 1e18), coalesce(lead(px) OVER w - px, 1e18)) AS gap FROM b WINDOW w AS (PARTITION BY family ORDER BY px)),
    n AS (SELECT literal, abs(a.px - c.px) AS distance, family, c.px AS step, row_number() OVER (PARTITION BY literal ORDER BY abs(a.px - c.px), family, c.px) AS r FROM a JOIN c ON abs(a.px - c.px) <= {tolerance} WHERE gap >= {gap} AND a.px NOT IN (SELECT px FROM b))
    SELECT 'fleet' AS repo_id, literal, distance, family, step FROM n WHERE r = 1"""


_DECL_HIDDEN = f"x AS (SELECT *, CAST(regexp_extract(path, 'brand(\\d+)', 1) AS INT) % 2 = 0 AS even, {family_sql('name', 'value')} AS family FROM decls)"

ORACLE = {
    "exact_value_leaks": f"{with_sql('literals', 'decls')}, {_LEAKS} SELECT * FROM leaks",
    "literal_groups": f"{with_sql('literals')}, {_GROUPS} SELECT * FROM g",
    "finding_rank": f"{with_sql('literals', 'decls')}, {_LEAKS} SELECT repo_id, id, score, row_number() OVER (PARTITION BY repo_id ORDER BY score DESC, id) AS rank FROM leaks",
    "concept_collapse": f"{with_sql('decls')}, {CONCEPTS} SELECT repo_id, id, names, n_values, definitions, first_name, first_site, family, alias_of FROM concepts",
    "conflicts": f"{with_sql('decls')}, {CONCEPTS} SELECT repo_id, id AS token, family, 'two literals' AS kind, n_values AS \"values\", definitions FROM concepts WHERE n_values >= 2",
    "tiers": f"{with_sql('decls')}, {CONCEPTS} SELECT repo_id, id, tier, alias_resolved FROM concepts",
    "lineage_totals": f"{with_sql('decls')}, {CONCEPTS} SELECT repo_id, {', '.join(f"count(*) FILTER (tier = '{t}') AS {t}" for t in v.TIERS)}, count(*) FILTER (alias_resolved) AS resolved_alias_edges, count(*) FILTER (NOT alias_resolved) AS untraced_alias_edges FROM concepts GROUP BY 1",
    "family_states": f"""{with_sql("decls")}, {_DECL_HIDDEN}, h AS (SELECT DISTINCT family FROM x WHERE even AND family <> 'color'), n AS (SELECT family, count(DISTINCT {norm_sql("name")}) AS n FROM x WHERE NOT even AND value LIKE '#%' GROUP BY 1),
      f AS (SELECT unnest({v.FAMILIES}) AS family)
      SELECT 'fleet' AS repo_id, f.family, CASE WHEN n IS NOT NULL THEN 'counted' WHEN h.family IS NOT NULL THEN 'not-visible' ELSE 'none-used' END AS state, CASE WHEN n IS NOT NULL THEN n WHEN h.family IS NULL THEN 0 END AS count FROM f LEFT JOIN n USING (family) LEFT JOIN h ON h.family = f.family""",
    "family_inventory": f"{with_sql('decls')}, {CONCEPTS} SELECT repo_id, family, count(*) AS concepts, sum(definitions)::BIGINT AS sites, {', '.join(f"count(*) FILTER (tier = '{t}') AS {t}" for t in v.TIERS)} FROM concepts GROUP BY 1, 2",
    "single_source": f"{with_sql('decls')} SELECT repo_id, {norm_sql('name')} AS token, count(DISTINCT path) AS sites, count(DISTINCT value) AS \"values\", CASE WHEN count(DISTINCT path) = 1 THEN 'healthy' WHEN count(DISTINCT value) = 1 THEN 'watch' ELSE 'needs-work' END AS grade FROM decls GROUP BY 1, 2",
    "naming_grammars": f"""{with_sql("decls")} SELECT repo_id, representation, CASE WHEN regexp_matches(name, '^[a-z0-9]+$') THEN 'single-word' WHEN regexp_matches(name, '^[a-z0-9]+(-[a-z0-9]+)+$') THEN 'kebab-case' WHEN regexp_matches(name, '^[a-z0-9]+(_[a-z0-9]+)+$') THEN 'snake_case'
      WHEN regexp_matches(name, '^[a-z][a-z0-9]*([A-Z][a-z0-9]*)+$') THEN 'camelCase' WHEN regexp_matches(name, '^[A-Z][a-zA-Z0-9]*$') THEN 'PascalCase' ELSE 'mixed' END AS grammar, count(DISTINCT name) AS names, min(concat(path, ':', lpad(CAST(line AS VARCHAR), 9, '0'))) AS first_site FROM decls GROUP BY 1, 2, 3""",
    "ramps_outliers": f"""{with_sql("decls")}, {CONCEPTS}, k AS (SELECT id, regexp_extract(id, '^(.*)-(\\d+)$', 1) AS stem, regexp_extract(id, '^(.*)-(\\d+)$', 2) AS step FROM concepts WHERE family = 'color'), s AS (SELECT stem, count(DISTINCT step) AS steps FROM k WHERE stem <> '' GROUP BY 1)
      SELECT 'fleet' AS repo_id, id AS token, CASE WHEN steps >= 3 THEN stem END AS ramp, CASE WHEN steps >= 3 THEN steps END AS steps, coalesce(steps, 0) < 3 AS outlier FROM k LEFT JOIN s USING (stem)""",
    "near_miss_dimension": _near("SELECT * FROM lit", "SELECT * FROM st", 2, 4),
    "near_miss_duration": _near("SELECT literal, px * 10 AS px FROM lit", "SELECT family, px * 20 + 7 AS px FROM st", 50, 0),
    "near_miss_color": f"{with_sql('literals', 'decls')}, {_NEAR_COLOR} SELECT * FROM near",
    "leak_cascade": f"""{with_sql("literals", "decls")}, {_LEAKS}, {_PROVEN}, {_NEAR_COLOR}
      SELECT 'fleet' AS repo_id, e.literal, CASE WHEN r.token IS NOT NULL THEN 'redundant' WHEN token_candidates IS NOT NULL THEN 'exact-value candidate' WHEN near.token IS NOT NULL THEN 'near-miss' ELSE 'uncovered' END AS tier, coalesce(r.token, token_candidates, near.token) AS token
      FROM leaks e LEFT JOIN r ON r.literal = e.literal LEFT JOIN near ON near.literal = e.literal""",
    "owner_groups": f"""{with_sql("literals")}, k AS (SELECT path, literal AS value, split_part(path, '/', 2) || '::' || regexp_extract(path, '/(f\\d+)\\.css', 1) AS component, split_part(path, '/', 2) AS owner FROM literals),
      u AS (SELECT path, 'value' AS dimension, value AS key FROM k UNION ALL SELECT path, 'component', component FROM k UNION ALL SELECT path, 'owner', owner FROM k)
      SELECT 'fleet' AS repo_id, dimension, key, count(*) AS occurrences, count(DISTINCT path) AS files, round((count(*) + 2 * count(DISTINCT path) + 3) * 0.4::DOUBLE, 2) AS score FROM u GROUP BY 1, 2, 3""",
    "location_preview": f"{with_sql('literals')}, k AS (SELECT repo_id, literal AS id, path, line, row_number() OVER (PARTITION BY literal, path ORDER BY line) AS r, greatest(count(*) OVER (PARTITION BY literal, path) - 2, 0) AS hidden FROM literals) SELECT repo_id, id, path, line, hidden FROM k WHERE r <= 2",
    "fix_queue": f"""{with_sql("literals", "decls")}, {_LEAKS}, {_PROVEN}, p AS (SELECT repo_id, id, CASE WHEN r.token IS NOT NULL THEN 'redundant' ELSE tier END AS tier, literal, coalesce(r.token, token_candidates) AS token, occurrences, files, breadth, CASE WHEN r.token IS NOT NULL THEN 'exact static match' ELSE 'manual review' END AS confidence FROM leaks LEFT JOIN r USING (literal)),
      q AS (SELECT *, round((occurrences + 2 * files + 3 * breadth) * CASE confidence WHEN 'exact static match' THEN 0.95::DOUBLE ELSE 0.4::DOUBLE END, 2) AS score, tier = 'redundant' AND confidence <> 'manual review' AS safe_to_automate FROM p WHERE token IS NOT NULL)
      SELECT *, CASE WHEN safe_to_automate AND files < 10 THEN 'S' WHEN safe_to_automate OR files <= 1 THEN 'M' ELSE 'L' END AS effort, row_number() OVER (PARTITION BY repo_id ORDER BY score DESC, id) AS rank FROM q""",
    "reachability": f"""{with_sql("edges")}, e AS (SELECT DISTINCT src, dst FROM edges WHERE src <> dst), walk AS (SELECT CAST(0 AS BIGINT) AS node, 0 AS depth, [CAST(0 AS BIGINT)] AS via UNION SELECT e.dst, depth + 1, list_append(via, e.dst) FROM walk JOIN e ON e.src = walk.node WHERE NOT list_contains(via, e.dst) AND depth < 30)
      SELECT node, depth, array_to_string(via, '>') AS via FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY depth, via) AS r FROM walk) WHERE r = 1""",
    "orphans_files": f"""{with_sql("edges")}, e AS (SELECT DISTINCT src, dst FROM edges WHERE src <> dst), walk AS (SELECT CAST(1 AS BIGINT) AS node UNION SELECT e.dst FROM walk JOIN e ON e.src = walk.node WHERE walk.node % 3 <> 0 OR walk.node NOT IN (SELECT dst FROM edges))
      SELECT DISTINCT dst AS file FROM edges WHERE dst NOT IN (SELECT node FROM walk)""",
    "orphan_tokens": f"{with_sql('decls', 'refs')}, {LINKED}, k AS (SELECT token, family FROM linked UNION ALL SELECT -1 - s_suppkey, 'sizing' FROM supplier) SELECT * FROM k WHERE token NOT IN (SELECT token_key FROM refs)",
    "alias_chains": f"{with_sql('decls')}, {_CHAINS} SELECT token, length, hops[-1] AS last, complete, stops_at, note FROM chains",
    "blast_radius": f"""{with_sql("decls", "refs")}, {LINKED}, b AS (SELECT alias_of AS token, token AS dependent FROM linked WHERE alias_of IS NOT NULL AND alias_of <> token UNION SELECT b.token, k.token FROM b JOIN linked k ON k.alias_of = b.dependent WHERE k.token <> b.token),
      n AS (SELECT token, count(DISTINCT dependent) AS dependents FROM b GROUP BY 1), u AS (SELECT b.token, count(DISTINCT r.component) AS component_count FROM b JOIN refs r ON r.token_key = b.dependent GROUP BY 1)
      SELECT token, coalesce(dependents, 0) AS dependents, coalesce(component_count, 0) AS component_count FROM linked LEFT JOIN n USING (token) LEFT JOIN u USING (token)""",
    "traceable_families": f"{with_sql('decls')}, {_CHAINS} SELECT concat(family, '-', token % 40) AS family, count(*) AS tokens FROM chains JOIN linked USING (token) GROUP BY 1 HAVING bool_and(complete)",
    "lineage_summary": f"{with_sql('decls', 'refs')}, {_CHAINS} SELECT count(*) FILTER (complete) AS traced, count(*) FILTER (NOT complete) AS stopped, count(*) FILTER (token IN (SELECT token_key FROM refs)) AS with_consumer, max(length) AS longest FROM chains",
    "entry_ranks": f"{with_sql('edges')}, u AS (SELECT src AS node, 1 AS o, 0 AS i FROM edges UNION ALL SELECT dst, 0, 1 FROM edges) SELECT node, sum(i)::BIGINT AS inbound, sum(o)::BIGINT AS outbound, row_number() OVER (ORDER BY sum(i), sum(o) DESC, node) AS rank FROM u GROUP BY 1",
    "duplicate_values": f"""{with_sql("decls")}, {_CHAINS}, r AS (SELECT c.token, k.value FROM chains c JOIN linked k ON k.token = c.hops[-1] WHERE c.token NOT IN (SELECT token FROM linked WHERE alias_of IS NOT NULL))
      SELECT 'fleet' AS repo_id, value, count(DISTINCT token) AS tokens, min(token) AS first_token, max(token) AS last_token FROM r GROUP BY 1, 2 HAVING count(DISTINCT token) >= 2""",
}
