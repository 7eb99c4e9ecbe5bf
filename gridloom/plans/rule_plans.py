"""Queries of scopes, discovery choices, run evidence and integrity rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import vocabulary as v
from gridloom.operators import discovery, evidence, extract, integrity, leaks, profiles, runs, tokens, usage
from gridloom.operators import grades as g
from gridloom.plans.fleet_plans import product, roots
from gridloom.plans.grade_plans import _ALL
from gridloom.plans.source_plans import _IMPORTS, files, resolved
from gridloom.plans.tables import with_sql
from gridloom.plans.token_plans import ORACLE as TOKENS
from gridloom.plans.token_plans import queue
from gridloom.sources.adapters import logical

PATTERNS = ["src/**", "public/p*1.html", "lib"]
ALIASES = [("@acme/*", "packages/*"), ("@acme/w1*", "vendored/w1*"), ("react", "compat/react.ts")]
REWRITES = [("./m1", "modules/m1"), ("./m12", "other/m12"), ("../", "up/")]
CONTEXTS = [("src", "web"), ("src/vendor", "vendored"), ("packages", "packages")]


def source_roles(spark: SparkSession, d: str) -> DataFrame:
    """Style and script sources: style sheets of even size are canonical, themes aliases, theme objects candidates."""
    role = F.when((F.col("kind") == 1) & (F.col("size") % 2 == 0), "canonical").when((F.col("kind") == 7) & (F.col("size") % 2 == 0), "alias").when(F.col("kind") == 3, "candidate").otherwise("odd")
    return logical(spark, d, "source_files").where("kind in (1, 3, 7)").select("repo_id", "path", "size", role.alias("role"))


def source_problems(spark: SparkSession, d: str) -> DataFrame:
    rows = source_roles(spark, d)
    return integrity.source_rules(rows.withColumn("reachable_from", F.when(F.col("size") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array("path"))))


def discovery_problems(spark: SparkSession, d: str) -> DataFrame:
    """Nations as runs; suppliers as sources, those in debt as roots."""
    s, n = spark.read.parquet(f"{d}/supplier.parquet"), spark.read.parquet(f"{d}/nation.parquet")
    own = n.select(F.col("n_nationkey").alias("repo_id"), F.when(F.col("n_nationkey") % 3 == 0, F.col("n_name")).alias("detected_by"))
    rows = s.select(F.col("s_nationkey").alias("repo_id"), F.col("s_name").alias("path"), "s_acctbal")
    return profiles.discovery_rules(own, rows, rows.where("s_acctbal < 0"))


def mode_problems(spark: SparkSession, d: str) -> DataFrame:
    graded = logical(spark, d, "grades").where("check_id = 3").select("repo_id", "grade")
    key = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("repo_id"), F.col("n_name").alias("bundle"))
    pairs = logical(spark, d, "mode_pairs").join(key, "bundle")
    return profiles.mode_rules(graded, pairs, pairs.where("resolved"))


def root_problems(spark: SparkSession, d: str) -> DataFrame:
    rows = roots(spark, d)
    return profiles.root_evidence_rules(rows.select("repo_id", "path", F.when(F.col("scope") == "product", evidence.root_type(F.col("path"), F.lit(None).cast("string"))).alias("root_type"), F.when(F.col("exists"), F.concat("path", F.lit(":1"))).alias("evidence"), F.nullif("confidence", F.lit("not-visible")).alias("confidence"), "ownership"))


def reason_problems(spark: SparkSession, d: str) -> DataFrame:
    """Misses of which those of dynamic imports carry a reason of another vocabulary."""
    rows = resolved(spark, d)[1]
    return integrity.reason_rules(rows.withColumn("reason", F.when(F.col("reason") == "dynamic runtime import", "dynamic").otherwise(F.col("reason"))))


def queue_problems(spark: SparkSession, d: str) -> DataFrame:
    """The fix queue with planted faults: automation of all that has few files, and an id cut short where it has a zero in front."""
    rows = queue(spark, d).select("repo_id", F.when(F.col("id").startswith("0"), F.substring("id", 1, 11)).otherwise(F.col("id")).alias("id"), "token", "tier", (F.col("rank") % 2 == 0).alias("safe_to_automate"))
    return integrity.queue_rules(rows)


def state_problems(spark: SparkSession, d: str) -> DataFrame:
    """Family states of declared tokens by brand, with two families of the list forgotten and not-visible ones that kept a number."""
    rows = logical(spark, d, "sheets").select("repo_id", "ord")
    fam = F.element_at(F.array(*[F.lit(f) for f in v.FAMILIES[2:]]), (F.col("ord") % len(v.FAMILIES[2:]) + 1).cast("int"))
    states = rows.groupBy("repo_id", fam.alias("family")).agg(F.count("*").alias("n"))
    state = F.when(F.col("n") % 4 == 0, "not-visible").otherwise("counted")
    return integrity.family_rules(states.select("repo_id", "family", state.alias("state"), F.when(F.col("n") % 8 != 4, F.col("n")).alias("count")))


def ranked_problems(spark: SparkSession, d: str) -> DataFrame:
    """A published component view, with references of every fifth component miscounted, against its recomputation."""
    refs = logical(spark, d, "refs").withColumn("repo_id", F.regexp_extract("path", "^packages/([^/]+)/", 1))
    now = usage.top_components(refs.groupBy("repo_id", "component").agg(F.count("*").alias("references"), F.countDistinct("token_key").alias("distinct_tokens")).withColumn("is_component", F.lit(True)), 3).select("repo_id", "component", "references", "rank")
    old = now.withColumn("references", F.col("references") + F.when(F.col("component") % 5 == 0, 1).otherwise(0))
    return integrity.ranking_rules(old, now).groupBy("repo_id", "rule").agg(F.count("*").alias("rows"))


def states_of_capabilities(spark: SparkSession, d: str) -> DataFrame:
    """Three repositories: their roots, what these reach, profiles of two of them, and misses of one."""
    r = roots(spark, d)
    repos = r.select("repo_id").distinct()
    return discovery.capability_states(repos, repos.where("repo_id <> 'r2'").withColumn("part", F.lit("active")), r.where("exists or repo_id = 'r0'"), product(spark, d), repos.where("repo_id = 'r1'").withColumn("reason", F.lit("missing local source")))


def two_runs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Grades, and those of a later run in which each check has the grade of the one before it."""
    now = logical(spark, d, "grades")
    return now, now.withColumn("check_id", ((F.col("check_id") + 1) % 8).cast("int"))


def overlap(spark: SparkSession, d: str) -> DataFrame:
    rows = logical(spark, d, "run_findings").select("run_id", F.substring("id", 1, 1).alias("check"), F.col("id").alias("item"))
    return runs.evidence_overlap(rows.where("run_id = 'baseline'"), rows.where("run_id = 'current'"))


def arbitrary(spark: SparkSession, d: str) -> DataFrame:
    p = logical(spark, d, "source_files")
    name = F.when(F.col("k") % 4 == 0, F.concat(F.lit("md:bg-["), "hex6", F.lit("]"))).when(F.col("k") % 4 == 1, F.concat(F.lit("p-[--"), "word", F.lit("]"))).when(F.col("k") % 4 == 2, F.concat(F.lit("text-[var(--"), "word", F.lit(")]"))).otherwise("p-4")
    return usage.arbitrary_values(p.select(name.alias("class"))).distinct()


def leak_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Leaks of each plugin with the tier of the priority of their orders; uncovered ones have no token."""
    own = logical(spark, d, "literals").withColumn("repo_id", F.regexp_extract("path", "^plugins/([^/]+)/", 1))
    rows = own.groupBy("repo_id", F.element_at(F.array(*[F.lit(t) for t in v.LEAK_TIERS]), (F.substring("property", 1, 1).cast("int") % 4 + 1)).alias("tier"), "literal").agg(F.countDistinct("path").alias("files"))
    return leaks.rank_leaks(rows.withColumn("token", F.when(F.col("tier") != "uncovered", F.substring("literal", 2, 2))))


def leak_states(spark: SparkSession, d: str) -> DataFrame:
    own = logical(spark, d, "literals").withColumn("repo_id", F.regexp_extract("path", "^plugins/([^/]+)/", 1))
    return leaks.leak_state(leaks.literal_groups(own.where("repo_id not in ('p3', 'p7')")), own.select("repo_id"))


def kept_literals(spark: SparkSession, d: str) -> DataFrame:
    """Literals without hairlines and granted exceptions: urgent ones are hairlines, and those of high priority have an exception, granted where the literal ends in 0."""
    own = logical(spark, d, "literals").withColumn("literal", F.when(F.col("property").startswith("1"), "1px").otherwise(F.col("literal")))
    granted = own.where("property like '2%'").select("repo_id", "path", "literal", F.lit("someone").alias("owner"), F.when(F.col("literal").endswith("0"), F.lit("2030-01-01")).alias("review_by")).distinct()
    return discovery.without_exemptions(own, granted).groupBy("path", "property").agg(F.count("*").alias("literals"))


def type_faces(spark: SparkSession, d: str) -> DataFrame:
    rows = logical(spark, d, "faces").select("repo_id", "family", F.element_at(F.array(*[F.lit(x) for x in (60, 80, 90, 100)]), F.when(F.col("ord") % 97 == 0, 4).otherwise((F.col("ord") % 3 + 1).cast("int"))).alias("priority"))
    return tokens.identity_font(rows)


def siblings(spark: SparkSession, d: str) -> DataFrame:
    """Files dealt into token-named directories: style sheets are canonical there, scripts may be admitted."""
    p = logical(spark, d, "source_files").where("kind in (0, 1, 3)")
    place = F.concat_ws("/", F.lit("lib"), F.concat(F.lit("d"), F.floor(F.col("k") / 40).cast("string")), F.element_at(F.array(F.lit("tokens"), F.lit("misc"), F.lit("Theme")), (F.floor(F.col("k") / 8) % 3 + 1).cast("int")), F.element_at(F.split("path", "/"), -1))
    role = F.when((F.col("kind") == 1) & (F.col("size") % 3 == 0), "canonical").otherwise("candidate")
    return tokens.admit_siblings(p.select("repo_id", place.alias("path"), role.alias("role"), F.when(F.col("kind") == 3, "canonical").otherwise("candidate").alias("role_if_admitted"))).select("repo_id", "path", "final_role", "admitted_by")


def tree_edges(spark: SparkSession, d: str) -> DataFrame:
    """Each page includes the tree of scripts of its repository."""
    p = logical(spark, d, "source_files")
    return extract.expand_tree(p.where("kind = 6 and size < 5").select("repo_id", "path", F.lit("packages").alias("dir")), p)


def spec_rewrites(spark: SparkSession, d: str) -> DataFrame:
    specs = extract.imports(files(spark, d)).select("spec").distinct()
    a = discovery.rewrite_aliases(specs, spark.createDataFrame(ALIASES, "pattern string, target string"))
    b = discovery.rewrite_profiles(specs, spark.createDataFrame(REWRITES, "prefix string, target string")).withColumnRenamed("rewritten", "by_profile")
    return a.join(b, "spec", "left")


def chosen(spark: SparkSession, d: str) -> DataFrame:
    p = logical(spark, d, "configs").where("kind = 1 and size <= 4")
    return discovery.applications(p.select("repo_id", F.regexp_extract("path", "^(.*)/", 1).alias("dir")))


QUERIES = {
    "leak_scope": lambda sp, d: leaks.leak_scope(files(sp, d).select("repo_id", "path"), source_roles(sp, d)),
    "orphan_candidates": lambda sp, d: discovery.orphan_candidates(files(sp, d).select("repo_id", "path"), sp.createDataFrame([(discovery.glob_regex(p),) for p in PATTERNS], "regex string")),
    "source_rules": source_problems,
    "discovery_rules": discovery_problems,
    "mode_rules": mode_problems,
    "root_evidence_rules": root_problems,
    "reason_rules": reason_problems,
    "queue_rules": queue_problems,
    "family_rules": state_problems,
    "ranking_rules": ranked_problems,
    "capability_states": states_of_capabilities,
    "confidence_delta": lambda sp, d: runs.confidence_delta(*[g.grade_counts(x) for x in two_runs(sp, d)]),
    "grades_agreed": lambda sp, d: runs.grades_agreed(*two_runs(sp, d)),
    "evidence_overlap": overlap,
    "arbitrary_values": arbitrary,
    "leak_ranks": leak_ranks,
    "leak_states": leak_states,
    "kept_literals": kept_literals,
    "identity_font": type_faces,
    "sibling_sources": siblings,
    "tree_edges": tree_edges,
    "spec_rewrites": spec_rewrites,
    "nearest_context": lambda sp, d: discovery.nearest_context(files(sp, d), sp.createDataFrame(CONTEXTS, "prefix string, context string")),
    "applications": chosen,
    "coverage_counts": lambda sp, d: evidence.state_counts(sp.read.parquet(f"{d}/orders.parquet").select((F.col("o_custkey") % 50).alias("repo_id"), F.element_at(F.array(F.lit("counted"), F.lit("not-needed"), F.lit("other")), F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(3)).alias("state"))),
    "pair_counts": lambda sp, d: evidence.pair_counts(*[x.withColumn("repo_id", F.substring("bundle", -1, 1)) for x in (logical(sp, d, "mode_pairs"), logical(sp, d, "mode_pairs").where("resolved"))]),
}

_S = with_sql("source_files")
_ROLES = "ro AS (SELECT repo_id, path, size, CASE WHEN kind = 1 AND size % 2 = 0 THEN 'canonical' WHEN kind = 7 AND size % 2 = 0 THEN 'alias' WHEN kind = 3 THEN 'candidate' ELSE 'odd' END AS role FROM source_files WHERE kind IN (1, 3, 7))"
_SPLIT = "count(*) FILTER (grade = 'healthy') AS h, count(*) FILTER (grade IN ('watch', 'needs-work')) AS y, count(*) FILTER (grade = 'not-visible') AS n, count(*) FILTER (grade = 'not-needed') AS z"
_LATER = "gl AS (SELECT repo_id, (check_id + 1) % 8 AS check_id, grade FROM grades), bl AS (SELECT r.repo_id, c.check_id, coalesce(gl.grade, 'not-visible') AS grade FROM (SELECT DISTINCT repo_id FROM grades) r CROSS JOIN checks c LEFT JOIN gl ON gl.repo_id = r.repo_id AND gl.check_id = c.check_id)"
_PLUGINS = "li AS (SELECT * REPLACE (split_part(path, '/', 2) AS repo_id) FROM literals)"
ORACLE = {
    "leak_scope": f"{_S}, {_ROLES} SELECT repo_id, path FROM source_files WHERE kind IN (1, 7) AND size % 2 <> 0",
    "orphan_candidates": f"{_S} SELECT repo_id, path FROM source_files WHERE starts_with(path, 'src/') OR regexp_matches(path, '^public/p.*1\\.html$')",
    "source_rules": f"{_S}, {_ROLES} SELECT repo_id, 'unknown-role' AS rule, path AS detail FROM ro WHERE role = 'odd' UNION ALL SELECT repo_id, 'source-without-route', path FROM ro WHERE role IN ('canonical', 'alias') AND size % 3 = 0",
    "discovery_rules": """SELECT n_nationkey AS repo_id, CASE WHEN s = 0 THEN 'no-token-source' WHEN s = 1 AND r = 0 THEN 'one-source-without-roots' ELSE 'neither-detector-nor-roots' END AS rule, s::VARCHAR AS detail
      FROM (SELECT n_nationkey, (SELECT count(DISTINCT s_name) FROM supplier WHERE s_nationkey = n_nationkey) AS s, (SELECT count(DISTINCT s_name) FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal < 0) AS r FROM nation) WHERE s = 0 OR (s = 1 AND r = 0) OR (n_nationkey % 3 <> 0 AND r = 0)""",
    "mode_rules": f"""{with_sql("grades", "mode_pairs")}, gr AS (SELECT repo_id, grade FROM grades WHERE check_id = 3 AND grade IN ('healthy', 'watch', 'needs-work')), mp AS (SELECT n_nationkey AS repo_id, m.* FROM mode_pairs m JOIN nation ON n_name = bundle)
      SELECT repo_id, 'graded-without-audited-pairs' AS rule, grade AS detail FROM gr WHERE repo_id NOT IN (SELECT repo_id FROM mp) UNION ALL SELECT repo_id, 'graded-without-output', bundle || ' / ' || mode FROM mp WHERE NOT resolved AND repo_id IN (SELECT repo_id FROM gr)""",
    "root_evidence_rules": f"""{with_sql("repo_roots")} SELECT repo_id, 'root-without-type' AS rule, path AS detail FROM repo_roots WHERE scope <> 'product' UNION ALL SELECT repo_id, 'root-without-evidence', path FROM repo_roots WHERE NOT present
      UNION ALL SELECT repo_id, unnest(['root-without-confidence', 'unknown-confidence']), path FROM repo_roots WHERE confidence = 'not-visible'""",
    "reason_rules": f"{_S}, {_IMPORTS} SELECT repo_id, 'unknown-reason' AS rule, spec AS detail FROM rt WHERE NOT found AND spec LIKE '<%'",
    "queue_rules": f"""WITH q AS ({TOKENS["fix_queue"]}), c AS (SELECT repo_id, CASE WHEN id LIKE '0%' THEN substr(id, 1, 11) ELSE id END AS id, tier, rank FROM q) SELECT repo_id, 'bad-id' AS rule, id AS detail FROM c WHERE length(id) < 12 UNION ALL SELECT repo_id, 'unsafe-automation', id FROM c WHERE rank % 2 = 0 AND tier <> 'redundant'""",
    "capability_states": f"""{with_sql("repo_roots")}, s AS (SELECT * FROM repo_roots WHERE present AND scope = 'product' AND confidence IN ('import-graph verified', 'framework-registered', 'runtime verified')),
      r AS (SELECT DISTINCT repo_id FROM repo_roots), k AS (SELECT repo_id, EXISTS (SELECT 1 FROM s WHERE s.repo_id = r.repo_id) AS seed, EXISTS (SELECT 1 FROM s WHERE s.repo_id = r.repo_id AND ownership = 'owned') AS own, repo_id = 'r0' AND EXISTS (SELECT 1 FROM repo_roots m WHERE m.repo_id = 'r0' AND NOT present) AS lost FROM r)
      SELECT repo_id, capability, CASE WHEN (capability = 'detection' AND repo_id <> 'r2') OR (capability = 'production_roots' AND seed AND NOT lost) OR (capability = 'import_resolution' AND seed AND repo_id <> 'r1') OR (capability = 'ownership' AND own) THEN 'verified' ELSE 'not-visible' END AS state FROM k CROSS JOIN (SELECT unnest({v.CAPABILITIES}) AS capability)""",
    "family_rules": f"""{with_sql("sheets")}, f AS (SELECT repo_id, ({v.FAMILIES[2:]})[ord % {len(v.FAMILIES[2:])} + 1] AS family, count(*) AS n FROM sheets GROUP BY 1, 2)
      SELECT repo_id, 'missing-family' AS rule, x.family AS detail FROM (SELECT DISTINCT repo_id FROM sheets) y CROSS JOIN (SELECT unnest({v.FAMILIES}) AS family) x WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.repo_id = y.repo_id AND f.family = x.family) UNION ALL SELECT repo_id, 'number-and-state-disagree', family FROM f WHERE n % 8 = 0""",
    "ranking_rules": f"""{with_sql("refs")}, k AS (SELECT split_part(path, '/', 2) AS repo_id, component, row_number() OVER (PARTITION BY split_part(path, '/', 2) ORDER BY count(*) DESC, count(DISTINCT token_key) DESC, component) AS rank FROM refs GROUP BY 1, 2)
      SELECT repo_id, unnest(['not-recomputed', 'not-published']) AS rule, count(*) AS rows FROM k WHERE rank <= 3 AND component % 5 = 0 GROUP BY 1""",
    "confidence_delta": f"""{with_sql("grades")}, {_ALL}, {_LATER}, a AS (SELECT repo_id, {_SPLIT} FROM al GROUP BY 1), b AS (SELECT repo_id, {_SPLIT} FROM bl GROUP BY 1) SELECT repo_id, b.h - a.h AS healthy, b.y - a.y AS your_code, b.n - a.n AS not_visible, b.z - a.z AS not_needed FROM a JOIN b USING (repo_id)""",
    "grades_agreed": f"{with_sql('grades')}, {_ALL}, {_LATER} SELECT al.repo_id, count(*) FILTER (al.grade = bl.grade) AS agreed, count(*) AS checks FROM al JOIN bl ON al.repo_id = bl.repo_id AND al.check_id = bl.check_id GROUP BY 1",
    "evidence_overlap": f"""{with_sql("run_findings")}, e AS (SELECT id, bool_or(run_id = 'baseline') AS a, bool_or(run_id = 'current') AS b FROM run_findings GROUP BY 1) SELECT substr(id, 1, 1) AS "check", count(*) FILTER (a AND b) AS shared, count(*) FILTER (a AND NOT b) AS only_a, count(*) FILTER (b AND NOT a) AS only_b FROM e GROUP BY 1""",
    "arbitrary_values": f"{_S} SELECT DISTINCT 'md:bg-[' || hex6 || ']' AS class, 'literal' AS kind, hex6 AS value FROM source_files WHERE k % 4 = 0 UNION ALL SELECT DISTINCT 'p-[--' || word || ']', 'redundant', '--' || word FROM source_files WHERE k % 4 = 1",
    "leak_ranks": f"""{with_sql("literals")}, {_PLUGINS}, r AS (SELECT repo_id, CAST(substr(property, 1, 1) AS INT) % 4 + 1 AS t, literal, count(DISTINCT path) AS files FROM li GROUP BY 1, 2, 3), q AS (SELECT repo_id, t, ({v.LEAK_TIERS})[t] AS tier, literal, files, CASE WHEN t <> 4 THEN substr(literal, 2, 2) END AS token FROM r)
      SELECT repo_id, tier, literal, files, token, row_number() OVER (PARTITION BY repo_id ORDER BY files DESC, t, token NULLS LAST, literal) AS rank FROM q""",
    "leak_states": f"{with_sql('literals')}, {_PLUGINS}, n AS (SELECT repo_id, CASE WHEN repo_id IN ('p3', 'p7') THEN 0 ELSE count(DISTINCT literal) END AS groups FROM li GROUP BY 1) SELECT repo_id, groups, CASE WHEN groups = 0 THEN 'counted' ELSE 'not-visible' END AS state, CASE WHEN groups = 0 THEN 0 END AS redundant FROM n",
    "kept_literals": f"""{with_sql("literals")}, x AS (SELECT path, property, literal FROM literals WHERE property NOT LIKE '1%'), e AS (SELECT DISTINCT path, literal FROM x WHERE property LIKE '2%' AND literal LIKE '%0') SELECT path, property, count(*) AS literals FROM x WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.path = x.path AND e.literal = x.literal) GROUP BY 1, 2""",
    "identity_font": f"""{with_sql("faces")}, p AS (SELECT repo_id, family, CASE WHEN ord % 97 = 0 THEN 100 ELSE ([60, 80, 90])[ord % 3 + 1] END AS priority FROM faces), t AS (SELECT *, rank() OVER (PARTITION BY repo_id ORDER BY priority DESC) AS r FROM p)
      SELECT repo_id, CASE WHEN count(DISTINCT family) = 1 THEN 'verified' ELSE 'not-visible' END AS state, CASE WHEN count(DISTINCT family) = 1 THEN min(family) END AS family FROM t WHERE r = 1 GROUP BY 1""",
    "sibling_sources": f"""{_S}, p AS (SELECT repo_id, kind, size, concat('lib/d', k // 40, '/', (['tokens', 'misc', 'Theme'])[(k // 8) % 3 + 1]) AS dir, split_part(path, '/', -1) AS name FROM source_files WHERE kind IN (0, 1, 3)), c AS (SELECT DISTINCT repo_id, dir FROM p WHERE kind = 1 AND size % 3 = 0 AND dir NOT LIKE '%/misc')
      SELECT p.repo_id, p.dir || '/' || name AS path, CASE WHEN kind = 1 AND size % 3 = 0 THEN 'canonical' WHEN c.dir IS NOT NULL AND kind = 3 THEN 'canonical' ELSE 'candidate' END AS final_role, CASE WHEN c.dir IS NOT NULL AND kind = 3 THEN 'sibling of a confirmed canonical source' ELSE 'source filename' END AS admitted_by FROM p LEFT JOIN c USING (repo_id, dir)""",
    "tree_edges": f"{_S} SELECT a.repo_id, a.path AS src, b.path AS dst FROM source_files a JOIN source_files b ON a.repo_id = b.repo_id WHERE a.kind = 6 AND a.size < 5 AND b.kind IN (4, 5)",
    "spec_rewrites": f"""{_S}, {_IMPORTS}, s AS (SELECT DISTINCT spec FROM im) SELECT spec, CASE WHEN spec LIKE '@acme/w1%' THEN 'vendored/w1' || substr(spec, 9) WHEN spec LIKE '@acme/%' THEN 'packages/' || substr(spec, 7) WHEN spec = 'react' THEN 'compat/react.ts' ELSE spec END AS rewritten,
      CASE WHEN spec LIKE './m12%' THEN NULL WHEN spec LIKE './m1%' THEN 'modules/m1' || substr(spec, 5) WHEN spec LIKE '../%' THEN 'up/' || substr(spec, 4) END AS by_profile, CASE WHEN spec LIKE './m12%' THEN true WHEN spec LIKE './m1%' OR spec LIKE '../%' THEN false END AS ambiguous FROM s""",
    "nearest_context": f"{_S} SELECT DISTINCT path, CASE WHEN path LIKE 'src/vendor/%' THEN 'src/vendor' ELSE split_part(path, '/', 1) END AS prefix, CASE WHEN path LIKE 'src/vendor/%' THEN 'vendored' WHEN path LIKE 'src/%' THEN 'web' ELSE 'packages' END AS context FROM source_files WHERE path LIKE 'src/%' OR path LIKE 'packages/%'",
    "applications": f"""{with_sql("configs")}, n AS (SELECT repo_id, count(DISTINCT path) AS n, min(replace(path, '/package.json', '')) AS dir FROM configs WHERE kind = 1 AND size <= 4 GROUP BY 1) SELECT repo_id, CASE WHEN n = 1 THEN 'selected' ELSE 'not-visible' END AS state, CASE WHEN n = 1 THEN dir END AS dir FROM n""",
    "coverage_counts": "SELECT o_custkey % 50 AS repo_id, count(*) FILTER (o_orderstatus = 'F') AS counted, count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) AS not_visible, count(*) FILTER (o_orderstatus = 'O') AS not_needed FROM orders GROUP BY 1",
    "pair_counts": f"{with_sql('mode_pairs')} SELECT right(bundle, 1) AS repo_id, count(*) AS audited, count(*) FILTER (resolved) AS resolved FROM mode_pairs GROUP BY 1",
}
