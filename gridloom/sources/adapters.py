"""Logical tables of the audit, derived by Spark from the star-schema tables, so that each query has rows to work on.

The SQL is plain enough for other engines too; {name} stands for a base table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

ADAPTERS = {
    "decls": """
SELECT 'fleet' AS repo_id, p_partkey AS line, p_partkey AS ord,
 concat('packages/', lower(replace(p_brand,'#','')), '/tokens/', pre, '.css') AS path,
 concat(pre,'-',CASE WHEN p_size % 7 = 0 THEN replace(p_name,' ','_') ELSE replace(p_name,' ','-') END,'-',CAST(p_size % 10 AS STRING)) AS name,
 CASE WHEN p_size % 4 = 0 THEN 'scss-variable' ELSE 'css-custom-property' END AS representation,
 CASE pre WHEN 'color' THEN concat('#', lower(lpad(hex((p_size % 50) * 4113 + 256),6,'0'))) ELSE concat(CAST(p_size*6 AS STRING),'px') END AS value,
 CASE WHEN p_partkey % 3 = 1 THEN CAST(floor(p_partkey/2) AS BIGINT) END AS alias_of_key
FROM (SELECT *, CASE p_type WHEN 'ECONOMY' THEN 'color' WHEN 'STANDARD' THEN 'space' WHEN 'PROMO' THEN 'radius'
      WHEN 'SMALL' THEN 'font' WHEN 'MEDIUM' THEN 'shadow' ELSE 'duration' END AS pre FROM {part}) x""",
    "edges": """
SELECT CAST(floor(p_partkey/2) AS BIGINT) AS src, p_partkey AS dst FROM {part} WHERE p_partkey > 0 AND p_partkey % 7 <> 0
UNION ALL
SELECT p_partkey AS src, CAST(floor(p_partkey/2) AS BIGINT) AS dst FROM {part} WHERE p_partkey > 0 AND p_partkey % 5 = 0""",
    "literals": """
SELECT 'fleet' AS repo_id, concat('#', lower(lpad(hex((o_custkey % 97) * 4113 + 256),6,'0'))) AS literal,
 concat('plugins/p', CAST(o_custkey % 11 AS STRING), '/f', CAST(o_custkey % 40 AS STRING), '.css') AS path,
 o_orderkey AS line, o_orderpriority AS property
FROM {orders}""",
    "refs": """
SELECT 'fleet' AS repo_id, concat('packages/brand', CAST(l_suppkey % 25 + 1 AS STRING), '/components/c', CAST(l_suppkey AS STRING), '.css') AS path,
 l_suppkey AS component, l_orderkey * 8 + l_linenumber AS line, l_partkey AS token_key,
 CASE WHEN l_linenumber % 4 = 0 THEN 'scss-variable' ELSE 'css-custom-property' END AS syntax
FROM {lineitem}""",
    "run_findings": """
SELECT CASE WHEN year(l_shipdate) % 2 = 0 THEN 'baseline' ELSE 'current' END AS run_id,
 substr(sha1(concat('redundant|color|', l_returnflag, '|', CAST(l_suppkey % 60 AS STRING))),1,12) AS id,
 count(*) AS occurrences, count(DISTINCT l_partkey) AS files
FROM {lineitem}
WHERE NOT ((l_suppkey % 60) % 7 = 0 AND year(l_shipdate) % 2 = 1)
  AND NOT ((l_suppkey % 60) % 7 = 1 AND year(l_shipdate) % 2 = 0)
GROUP BY 1, 2""",
    "commits": """
SELECT user_id AS repo_id, event_id AS sha, event_type,
 row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq
FROM {events}""",
    "concept_modes": """
SELECT DISTINCT concat(p_type,'-',p_name) AS token,
 CASE WHEN p_type = 'ECONOMY' THEN 'color' WHEN p_type = 'MEDIUM' THEN 'elevation' ELSE 'spacing' END AS family,
 CASE p_size % 3 WHEN 0 THEN 'light' WHEN 1 THEN 'dark' ELSE 'high-contrast' END AS mode
FROM {part}""",
    "contributions": """
SELECT CAST(s_nationkey AS BIGINT) AS profile, CAST(s_suppkey % 7 AS INT) AS capability,
 CASE WHEN s_acctbal > 0 THEN 'verified' ELSE 'not-visible' END AS state
FROM {supplier}""",
    "grades": """
SELECT repo_id, check_id, CASE n % 5 WHEN 0 THEN 'healthy' WHEN 1 THEN 'watch' WHEN 2 THEN 'needs-work' WHEN 3 THEN 'not-visible' ELSE 'not-needed' END AS grade
FROM (SELECT CAST(o_custkey % 50 AS BIGINT) AS repo_id, CAST(o_orderkey % 8 AS INT) AS check_id, count(*) AS n
 FROM {orders} WHERE o_custkey % 50 <> o_orderkey % 8 GROUP BY 1, 2) x""",
    "classes": """
SELECT concat(CASE pre WHEN 'color' THEN 'bg' WHEN 'space' THEN 'p' WHEN 'radius' THEN 'rounded' WHEN 'font' THEN 'font' WHEN 'shadow' THEN 'shadow' ELSE 'duration' END,
 CASE WHEN p_size % 6 = 0 THEN concat('-', CAST(p_size AS STRING)) ELSE concat('-', replace(p_name,' ','-')) END) AS class
FROM (SELECT *, CASE p_type WHEN 'ECONOMY' THEN 'color' WHEN 'STANDARD' THEN 'space' WHEN 'PROMO' THEN 'radius'
      WHEN 'SMALL' THEN 'font' WHEN 'MEDIUM' THEN 'shadow' ELSE 'duration' END AS pre FROM {part}) x""",
    "theme": """
SELECT DISTINCT CASE p_type WHEN 'ECONOMY' THEN 'color' WHEN 'STANDARD' THEN 'spacing' WHEN 'PROMO' THEN 'radius' WHEN 'SMALL' THEN 'font' WHEN 'MEDIUM' THEN 'shadow' ELSE 'font-weight' END AS namespace,
 CASE WHEN p_size = 11 THEN '' ELSE replace(p_name,' ','-') END AS key, CASE WHEN p_size % 2 = 0 THEN 'default' ELSE 'project' END AS origin, CAST(p_size % 5 AS STRING) AS value
FROM {part} WHERE p_size % 3 <> 0""",
    "roots": """
SELECT concat('apps/a', CAST(p_partkey % 300 AS STRING), '/index.ts') AS path, CAST(p_size % 5 AS INT) AS confidence_rank,
 CASE WHEN p_partkey % 2 = 0 THEN 'owned' ELSE 'shared' END AS ownership, p_brand AS profile
FROM {part}""",
    "mode_pairs": """
SELECT n_name AS bundle, m.mode AS mode, EXISTS (SELECT 1 FROM {supplier} s WHERE s.s_nationkey = n.n_nationkey AND s.s_suppkey % 3 = m.k) AS resolved
FROM {nation} n CROSS JOIN (SELECT 'light' AS mode, 0 AS k UNION ALL SELECT 'dark', 1 UNION ALL SELECT 'high-contrast', 2) m""",
    "runs": """
SELECT CAST(c_custkey AS BIGINT) AS run_id, CAST(c_nationkey AS BIGINT) AS repo_id, c_mktsegment AS framework,
 CASE c_custkey % 3 WHEN 0 THEN 'baseline' WHEN 1 THEN 'release' END AS intent, concat('scope', CAST(c_custkey % 2 AS STRING)) AS scope,
 concat('packages/p', CAST(c_custkey % 4 AS STRING)) AS owned_a, concat('packages/p', CAST(c_custkey % 5 AS STRING)) AS owned_b
FROM {customer}""",
    # Blocks of style sheets of 25 repositories, one a line of its file: kinds 0, 1, 2, 4 and 5 are theme roots.
    "sheets": """
SELECT repo_id, path, ord, kind, name, value, CASE kind WHEN 0 THEN concat(':root ', d) WHEN 1 THEN concat('.dark, .theme-dim ', d) WHEN 2 THEN concat(':root[data-theme="x"] ', d) WHEN 3 THEN concat('.card ', d)
 WHEN 4 THEN concat('@theme inline ', d) WHEN 5 THEN concat('@media (prefers-color-scheme: dark) ', o, ' :root ', d, ' ', c) WHEN 6 THEN concat('@media (min-width: 40em) ', o, ' .panel ', d, ' ', c) WHEN 7 THEN concat('@utility pad ', d)
 ELSE concat('/* :root ', d, ' */ .a::before ', o, ' content: "', c, o, '"; ', c, ' :root ', o, ' .inner ', d, ' ', c) END AS block
FROM (SELECT *, concat(chr(123), ' ', name, ': ', value, '; ', chr(125)) AS d, chr(123) AS o, chr(125) AS c FROM (
 SELECT p_partkey AS ord, lower(replace(p_brand,'#','')) AS repo_id, concat('src/theme/t', CAST(CAST(floor(p_partkey/100) AS BIGINT) AS STRING), '.css') AS path, CAST(p_partkey % 9 AS INT) AS kind,
 CASE WHEN p_size = 13 THEN concat('--radix-', replace(p_name,' ','-')) ELSE concat('--', lower(p_type), '-', replace(p_name,' ','_'), '-', CAST(p_size % 10 AS STRING)) END AS name,
 CASE WHEN p_size % 3 = 0 THEN concat('#', lower(lpad(hex(p_size * 4113 + 256),6,'0'))) ELSE concat(CAST(p_size AS STRING),'px') END AS value FROM {part}) x) y""",
    "faces": """
SELECT p_partkey AS ord, lower(replace(p_brand,'#','')) AS repo_id, concat('src/styles/f', CAST(CAST(floor(p_partkey/100) AS BIGINT) AS STRING), '.css') AS path, p_name AS family, CAST(p_partkey % 8 AS INT) AS kind, CAST(p_partkey AS STRING) AS k,
 CASE p_partkey % 8 WHEN 0 THEN concat('./fonts/a', CAST(p_partkey AS STRING), '.woff2') WHEN 1 THEN concat('/fonts/b', CAST(p_partkey AS STRING), '.ttf?v=2#x') WHEN 2 THEN concat('/plugins/p1/c', CAST(p_partkey AS STRING), '.woff')
 WHEN 3 THEN '../../../../d.woff2' WHEN 4 THEN 'https://cdn.test/x.woff2' WHEN 5 THEN concat('../e', CAST(p_partkey AS STRING), '.otf') WHEN 6 THEN concat('g', CAST(p_partkey AS STRING), '.woff2') ELSE concat('./h', CAST(p_partkey AS STRING), '.woff2') END AS url
FROM {part}""",
    # Where the file of a face of each kind lies, and its first bytes; kinds 3 and 4 have none, kind 5 is no font, kind 7 has a second file.
    "font_files": """
SELECT lower(replace(p_brand,'#','')) AS repo_id, CASE f.kind WHEN 0 THEN concat('src/styles/fonts/a', k, '.woff2') WHEN 1 THEN concat('public/fonts/b', k, '.ttf') WHEN 2 THEN concat('plugins/p1/assets/c', k, '.woff') WHEN 5 THEN concat('src/e', k, '.otf')
 WHEN 6 THEN concat('public/g', k, '.woff2') WHEN 7 THEN concat('src/styles/h', k, '.woff2') ELSE concat('public/h', k, '.woff2') END AS path,
 CASE f.kind WHEN 1 THEN '00010000' WHEN 2 THEN '774F4646' WHEN 5 THEN '25504446' ELSE '774F4632' END AS magic, CASE WHEN f.kind = 8 THEN 'other' ELSE p_name END AS body
FROM (SELECT *, CAST(p_partkey AS STRING) AS k FROM {part}) p JOIN (SELECT 0 AS kind UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 5 UNION ALL SELECT 6 UNION ALL SELECT 7 UNION ALL SELECT 8) f ON f.kind = p_partkey % 8 OR (f.kind = 8 AND p_partkey % 8 = 7)""",
    "brand_decls": """
SELECT lower(replace(p_brand,'#','')) AS repo_id, 'src/brand.css' AS path, CAST(p_partkey AS INT) AS line, p_name, split_part(p_name,' ',1) AS word, CAST(p_size % 4 AS INT) AS kind, CAST(p_size % 5 AS INT) AS heading,
 concat('--', CASE p_size % 4 WHEN 0 THEN 'brand-' WHEN 1 THEN 'color-' WHEN 2 THEN 'github-' ELSE 'acme-' END, split_part(p_name,' ',1), '-', CAST(p_size % 10 AS STRING)) AS name, concat('#', lower(lpad(hex((p_partkey % 300) * 4113 + 256),6,'0'))) AS value,
 CASE p_size % 5 WHEN 0 THEN 'Visual identity' WHEN 1 THEN 'Acme brand colors' WHEN 2 THEN 'The brand' WHEN 3 THEN 'Partner brand' END AS label
FROM {part}""",
    # Three repositories whose files have the same paths.
    "repo_edges": """
SELECT repo_id, concat('src/f', CAST(CAST(floor(k/6) AS BIGINT) AS STRING), '.ts') AS src, concat('src/f', CAST(k AS STRING), '.ts') AS dst FROM (SELECT concat('r', CAST(p_partkey % 3 AS STRING)) AS repo_id, CAST(floor(p_partkey/3) AS BIGINT) AS k, p_size FROM {part}) x WHERE k > 0 AND p_size % 7 <> 0
UNION ALL
SELECT repo_id, concat('src/f', CAST(k AS STRING), '.ts'), concat('src/f', CAST(CAST(floor(k/3) AS BIGINT) AS STRING), '.ts') FROM (SELECT concat('r', CAST(p_partkey % 3 AS STRING)) AS repo_id, CAST(floor(p_partkey/3) AS BIGINT) AS k, p_size FROM {part}) x WHERE k > 0 AND p_size % 5 = 0""",
    "repo_roots": """
SELECT concat('r', CAST(p_partkey % 3 AS STRING)) AS repo_id, concat('src/f', CAST(CAST(floor(p_partkey/3) AS BIGINT) AS STRING), '.ts') AS path, p_size <> 7 AS present, CASE WHEN p_size = 9 THEN 'demo' ELSE 'product' END AS scope,
 CASE p_size % 5 WHEN 0 THEN 'not-visible' WHEN 2 THEN 'import-graph verified' WHEN 3 THEN 'framework-registered' WHEN 4 THEN 'runtime verified' ELSE 'static candidate' END AS confidence, CASE WHEN p_name < 'm' THEN 'owned' ELSE 'shared' END AS ownership
FROM {part} WHERE p_type = 'ECONOMY' AND p_size <= 12""",
    "unit_files": """
SELECT concat('r', CAST(k % 5 AS STRING)) AS repo_id, k, CASE part WHEN 0 THEN concat('src/components/w', CAST(k AS STRING), '/index.tsx') WHEN 1 THEN concat('src/views/v', CAST(k AS STRING), '.tsx')
 WHEN 2 THEN CASE WHEN p_size % 2 = 0 THEN concat('src/views/v', CAST(k AS STRING), '.scss') ELSE concat('src/pages/q', CAST(k AS STRING), '.scss') END ELSE concat('lib/u', CAST(k AS STRING), '.ts') END AS path
FROM (SELECT CAST(floor(p_partkey/4) AS BIGINT) AS k, p_partkey % 4 AS part, p_size FROM {part}) x""",
    "unit_roots": """
SELECT concat('r', CAST(s_suppkey % 5 AS STRING)) AS repo_id, CASE s_suppkey % 4 WHEN 0 THEN 'lib' WHEN 1 THEN 'src/pages' WHEN 2 THEN 'src/views' ELSE 'src/components' END AS prefix,
 CASE s_suppkey % 3 WHEN 0 THEN 'framework-registered' WHEN 1 THEN 'import-graph verified' ELSE 'runtime verified' END AS confidence, CASE WHEN s_nationkey % 8 = 0 THEN 'owned' ELSE 'shared' END AS ownership
FROM {supplier}""",
    "configs": """
SELECT lower(replace(p_brand,'#','')) AS repo_id, concat('apps/a', CAST(p_partkey AS STRING), CASE p_partkey % 4 WHEN 0 THEN '/.stylelintrc.json' WHEN 1 THEN '/package.json' WHEN 2 THEN '/.github/workflows/ci.yml' ELSE '/notes.md' END) AS path, CAST(p_partkey % 4 AS INT) AS kind, CAST(p_size AS INT) AS size,
 concat('name: a', chr(10), ' - ', CASE p_size WHEN 1 THEN 'Declaration-Strict-Value' WHEN 2 THEN 'color-no-hex' WHEN 3 THEN 'npm run lint:tokens' WHEN 4 THEN 'declaration-strict' WHEN 5 THEN 'no-hardcoded-color and color-no-hex' ELSE 'semi' END, chr(10), 'end') AS content
FROM {part}""",
    "page_findings": """
SELECT DISTINCT lower(replace(p_brand,'#','')) AS repo_id, substr(sha1(concat(lower(replace(p_brand,'#','')), '|', CAST(p_partkey % 50 AS STRING))),1,12) AS id FROM {part}""",
    "report_pages": """
SELECT concat('brand', CAST(page_id % 25 + 1 AS STRING)) AS repo_id, page_id, concat(html, ' <i id="', substr(sha1(concat('brand', CAST(page_id % 25 + 1 AS STRING), '|', CAST(page_id % 60 AS STRING))),1,12), '">') AS html FROM {pages}""",
    "profile_rows": """
SELECT concat('n', CAST(s_nationkey AS STRING)) AS repo_id, concat('p', CAST(s_suppkey % 9 AS STRING)) AS profile, CASE WHEN s_suppkey % 5 = 0 THEN 'candidate' ELSE 'active' END AS part,
 CAST(row_number() OVER (PARTITION BY s_nationkey, s_suppkey % 5 = 0 ORDER BY s_suppkey) - CASE WHEN s_nationkey % 6 = 0 THEN 0 ELSE 1 END AS INT) AS ord, CASE WHEN s_suppkey % 11 <> 0 THEN 'adapter' END AS adapter, 'framework' AS kind, 'registered' AS confidence,
 CASE WHEN s_suppkey % 2 = 0 THEN 'user-selected' ELSE 'detected' END AS activation, CAST(s_suppkey % 7 AS INT) AS proofs
FROM {supplier}""",
    # One source file a part, of eight kinds by its key: modules, style sheets, token tables, theme objects, manifests, script configurations, pages, themes.
    "source_files": """
SELECT repo_id, kind, k, size, hex6, word, concat(CASE kind WHEN 0 THEN 'src/m' WHEN 1 THEN 'styles/_t' WHEN 2 THEN 'tokens/t' WHEN 3 THEN 'src/theme' WHEN 4 THEN 'packages/w' WHEN 5 THEN 'packages/w' WHEN 6 THEN CASE WHEN size % 5 = 0 THEN 'dist/p' ELSE 'public/p' END
  ELSE CASE WHEN size % 7 = 0 THEN 'vendor/app' ELSE 'src/vendor/app' END END, ks, CASE kind WHEN 0 THEN '.ts' WHEN 1 THEN '.scss' WHEN 2 THEN '.json' WHEN 3 THEN '.ts' WHEN 4 THEN '/package.json' WHEN 5 THEN '/tsconfig.json' WHEN 6 THEN '.html' ELSE '.css' END) AS path,
 CASE kind
  WHEN 0 THEN concat('import a from "./m', before, '"', nl, 'export ', o, ' b ', c, ' from "../lib/missing"', nl, 'const c = import("./m', early, '.ts")', nl, 'const d = import(name)', nl, 'import "react"', nl, 'const q = require("@acme/w', CAST(k + 4 AS STRING), '/package.json")', nl, '// import z from "./dead"')
  WHEN 1 THEN concat('@use "t', before, '";', nl, '@import url("theme.css");', nl, '$accent: ', hex6, ' !default;', nl, '$spacing: (', nl, '  "sm": 4px,', nl, '  inner: (', nl, '    lg: 8px,', nl, '  ),', nl, ');', nl, '.a ', o, ' color: $accent; padding: var(--space-1); ', c, ' // var(--dead)')
  WHEN 2 THEN concat(o, '"color": ', o, '"', word, '": ', o, '"$value": "', hex6, '"', c, c, ', "size": ', o, '"value": "4px"', c, ', "$meta": ', o, '"x": ', o, '"value": "no"', c, c, c)
  WHEN 3 THEN concat('export const theme = ', o, nl, '  color: ', o, nl, '    ', word, ': "', hex6, '",', nl, '  ', c, ',', nl, '  "--gap": "4px",', nl, '  radius: base.thing,', nl, c)
  WHEN 4 THEN concat(o, '"name": "@acme/w', ks, '", "dependencies": ', o, '"tailwindcss": "^4.', CAST(size AS STRING), '.0"', c, c)
  WHEN 5 THEN concat(o, ' // paths', nl, '"compilerOptions": ', o, '"paths": ', o, '"@', word, '/*": ["src/*", "lib/*",], ', c, c, c)
  WHEN 6 THEN concat('<script src="./a', ks, '.js"></script>', nl, '<link rel="stylesheet" href="/css/s.css">', nl, '<link rel="icon" href="/i.png">', nl, '<div class="bg-', word, ' p-4 md:flex">')
  ELSE concat('@theme ', o, nl, '  --color-', word, ': ', hex6, ';', nl, '  --text-lg: 2rem;', nl, c, nl, '/* color: #123456 */', nl, '.x ', o, ' color: #ABC; ', c) END AS content
FROM (SELECT concat('r', CAST(CAST(floor(p_partkey/8) AS BIGINT) % 5 AS STRING)) AS repo_id, CAST(p_partkey % 8 AS INT) AS kind, p_partkey AS k, CAST(p_partkey AS STRING) AS ks, CAST(p_partkey - 40 AS STRING) AS before, CAST(p_partkey - 80 AS STRING) AS early, CAST(p_size AS INT) AS size,
 concat('#', lower(lpad(hex(p_size * 4113 + 256),6,'0'))) AS hex6, split_part(p_name,' ',2) AS word, chr(10) AS nl, chr(123) AS o, chr(125) AS c FROM {part}) x""",
}


def base_tables(name: str) -> list[str]:
    return sorted(set(re.findall(r"\{(\w+)\}", ADAPTERS[name])))


def logical(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table in Spark. There concat of a null is null, elsewhere a null is left out, as concat_ws leaves it out."""
    return spark.sql(re.sub(r"\bconcat\(", "concat_ws('', ", ADAPTERS[name]), **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in base_tables(name)})


def other_sql(name: str) -> str:
    """The same table for an engine whose string type is VARCHAR and whose base tables are views."""
    return ADAPTERS[name].format(**{t: t for t in base_tables(name)}).replace(" AS STRING)", " AS VARCHAR)").replace("AS STRING", "AS VARCHAR")
