"""Queries of extraction and import resolution, over one source file a part in five repositories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import vocabulary as v
from gridloom.operators import extract
from gridloom.plans.fleet_plans import sheet_files
from gridloom.plans.tables import with_sql
from gridloom.sources.adapters import logical


def files(spark: SparkSession, d: str) -> DataFrame:
    return logical(spark, d, "source_files").select("repo_id", "path", "content")


def styles(spark: SparkSession, d: str) -> DataFrame:
    return files(spark, d).where(extract.file_class(F.col("path")) == "style")


def corpus(spark: SparkSession, d: str) -> DataFrame:
    """Files of each class that are no generated or third-party ones."""
    kept = extract.scan_corpus(files(spark, d))
    return kept.groupBy("repo_id", extract.file_class(F.col("path")).alias("class")).agg(F.count("*").alias("files"))


def resolved(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    own = files(spark, d)
    return extract.resolve_imports(extract.imports(own), own, extract.workspace_packages(own))


QUERIES = {
    "corpus_scan": corpus,
    "import_records": lambda sp, d: extract.imports(files(sp, d)).select("repo_id", "path", "spec", "kind"),
    "import_edges": lambda sp, d: resolved(sp, d)[0],
    "unresolved_imports": lambda sp, d: resolved(sp, d)[1],
    "declared_tokens": lambda sp, d: extract.declarations(files(sp, d)).select("repo_id", "path", "name", "value", "representation", "line"),
    "unreadable_names": lambda sp, d: extract.unreadable_names(files(sp, d)),
    "token_references": lambda sp, d: extract.references(styles(sp, d)),
    "hex_literals": lambda sp, d: extract.hex_literals(styles(sp, d)),
    "theme_declarations": lambda sp, d: extract.theme_declarations(files(sp, d), v.UTILITY_NAMESPACES, sites=True),
    "workspace_packages": lambda sp, d: extract.workspace_packages(files(sp, d)),
    "path_aliases": lambda sp, d: extract.path_aliases(files(sp, d)),
    "framework_versions": lambda sp, d: extract.framework_versions(files(sp, d), "tailwindcss"),
    "root_properties": lambda sp, d: extract.root_properties(sheet_files(sp, d)),
}

_F = with_sql("source_files")
_IMPORTS = f"""im AS (SELECT repo_id, path, k, kind AS fk, unnest(CASE kind WHEN 0 THEN ['./m' || (k - 40), '../lib/missing', 'react', './m' || (k - 80) || '.ts', '<dynamic:name>', '@acme/w' || (k + 4) || '/package.json'] WHEN 1 THEN ['t' || (k - 40), 'theme.css'] WHEN 6 THEN ['./a' || k || '.js', '/css/s.css'] END) AS spec,
 unnest(CASE kind WHEN 0 THEN ['module', 'module', 'module', 'call', 'call', 'call'] WHEN 1 THEN ['style', 'style'] WHEN 6 THEN ['script', 'link'] END) AS kind FROM source_files WHERE kind IN (0, 1, 6)),
 rs AS (SELECT im.*, CASE WHEN fk = 0 AND spec = './m' || (k - 40) THEN 'src/m' || (k - 40) || '.ts' WHEN fk = 0 AND spec LIKE '%.ts' THEN 'src/m' || (k - 80) || '.ts' WHEN spec LIKE '@acme/%' THEN 'packages/w' || (k + 4) || '/package.json' WHEN fk = 1 AND spec <> 'theme.css' THEN 'styles/_t' || (k - 40) || '.scss' END AS dst FROM im),
 rt AS (SELECT rs.*, EXISTS (SELECT 1 FROM source_files s WHERE s.repo_id = rs.repo_id AND s.path = rs.dst) AS found, spec LIKE '@acme/%' AND EXISTS (SELECT 1 FROM source_files s WHERE s.repo_id = rs.repo_id AND s.path = 'packages/w' || (rs.k + 4) || '/package.json') AS package FROM rs)"""
ORACLE = {
    "corpus_scan": f"{_F} SELECT repo_id, CASE WHEN kind IN (1, 7) THEN 'style' WHEN kind IN (0, 3, 6) THEN 'module' ELSE 'source' END AS class, count(*) AS files FROM source_files WHERE NOT (kind = 6 AND size % 5 = 0) AND NOT (kind = 7 AND size % 7 = 0) GROUP BY 1, 2",
    "import_records": f"{_F}, {_IMPORTS} SELECT repo_id, path, spec, kind FROM im",
    "import_edges": f"{_F}, {_IMPORTS} SELECT DISTINCT repo_id, path AS src, dst FROM rt WHERE found",
    "unresolved_imports": f"{_F}, {_IMPORTS} SELECT repo_id, path AS src, spec, CASE WHEN spec LIKE '<%' THEN 'dynamic runtime import' WHEN spec LIKE '.%' OR spec LIKE '/%' OR package THEN 'missing local source' ELSE 'external package' END AS reason FROM rt WHERE NOT found",
    "declared_tokens": f"""{_F}, n AS (SELECT repo_id, path, unnest(CASE kind WHEN 1 THEN [('$accent', hex6, 'scss-variable', 3), ('$spacing.sm', '4px', 'scss-map-entry', 5), ('$spacing.inner.lg', '8px', 'scss-map-entry', 7)] WHEN 2 THEN [('color.' || word, hex6, 'dtcg-json', 1), ('size', '4px', 'style-dictionary-json', 1)]
      WHEN 3 THEN [('theme.color.' || word, hex6, 'js-theme-object', 3), ('--gap', '4px', 'js-theme-object', 5)] WHEN 7 THEN [('--color-' || word, hex6, 'css-custom-property', 2), ('--text-lg', '2rem', 'css-custom-property', 3)] END) AS r FROM source_files WHERE kind IN (1, 2, 3, 7))
      SELECT repo_id, path, r[1] AS name, r[2] AS value, r[3] AS representation, r[4] AS line FROM n""",
    "unreadable_names": f"{_F} SELECT repo_id, path, 'radius' AS name, 'radius' AS family FROM source_files WHERE kind = 3",
    "token_references": f"{_F} SELECT repo_id, path, 10 AS line, token, syntax FROM source_files, (VALUES ('accent', 'scss-variable'), ('space-1', 'css-custom-property')) t(token, syntax) WHERE kind = 1",
    "hex_literals": f"{_F} SELECT repo_id, path, 3 AS line, hex6 AS literal, 'accent' AS property FROM source_files WHERE kind = 1 UNION ALL SELECT repo_id, path, 2, hex6, '--color-' || word FROM source_files WHERE kind = 7 UNION ALL SELECT repo_id, path, 6, '#ABC', 'color' FROM source_files WHERE kind = 7",
    "theme_declarations": f"{_F} SELECT repo_id, path, 'color' AS namespace, word AS key, hex6 AS value FROM source_files WHERE kind = 7 UNION ALL SELECT repo_id, path, 'text', 'lg', '2rem' FROM source_files WHERE kind = 7",
    "workspace_packages": f"{_F} SELECT repo_id, '@acme/w' || k AS name, 'packages/w' || k AS dir FROM source_files WHERE kind = 4",
    "path_aliases": f"{_F} SELECT repo_id, path, '@' || word || '/*' AS pattern, ord, target FROM source_files, (VALUES (0, 'src/*'), (1, 'lib/*')) t(ord, target) WHERE kind = 5",
    "framework_versions": f"{_F} SELECT repo_id, path, '4.' || size || '.0' AS version FROM source_files WHERE kind = 4",
    "root_properties": f"{with_sql('sheets')} SELECT repo_id, path, count(*) FILTER (kind IN (0, 2, 5, 8)) AS root_properties FROM sheets GROUP BY 1, 2",
}
