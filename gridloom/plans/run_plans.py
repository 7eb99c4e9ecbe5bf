"""Queries of run comparison, discovery evidence and text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import vocabulary as v
from gridloom.operators import extract, runs, text
from gridloom.plans.tables import with_sql
from gridloom.sources.adapters import logical


def diff(spark: SparkSession, d: str) -> DataFrame:
    f = logical(spark, d, "run_findings")
    return runs.trend_diff(f.where("run_id = 'baseline'"), f.where("run_id = 'current'"))


def regress(spark: SparkSession, d: str) -> DataFrame:
    return runs.regressions(diff(spark, d), diff(spark, d).where("id < '8'"))


def gate(spark: SparkSession, d: str) -> DataFrame:
    """The first run of each repository against its last."""
    r = logical(spark, d, "runs").withColumn("owned_paths", F.array("owned_a", "owned_b"))
    pick = lambda f: r.groupBy("repo_id").agg(f("run_id").alias("run_id")).join(r, ["repo_id", "run_id"])
    return runs.compat_gate(pick(F.min), pick(F.max), ["framework", "intent", "scope"], ["owned_paths"])


def verdict(spark: SparkSession, d: str) -> DataFrame:
    repos = logical(spark, d, "runs").select("repo_id")
    bad = diff(spark, d).where("change = 'grew'").select((F.conv(F.substring("id", 1, 4), 16, 10).cast("long") % 25).alias("repo_id"))
    return runs.ci_verdict(repos, repos.where("repo_id % 6 > 0"), gate(spark, d).where("input = 'scope'"), bad)


def agreement(spark: SparkSession, d: str) -> DataFrame:
    f = logical(spark, d, "run_findings").select("run_id", F.concat(F.lit("s"), F.substring("id", 1, 1)).alias("section"), F.col("id").alias("field"), F.col("files").cast("string").alias("value"))
    return runs.run_agreement(f.where("run_id = 'baseline'"), f.where("run_id = 'current'"))


def fresh(spark: SparkSession, d: str) -> DataFrame:
    c = logical(spark, d, "commits")
    refs = c.where("event_type = 'signup'").groupBy("repo_id").agg(F.max_by("sha", "seq").alias("sha"))
    dirty = c.groupBy("repo_id").agg(F.max_by("event_type", "seq").alias("last")).where("last = 'error'")
    return runs.freshness(c, refs, dirty)


SIGNALS = [(p, k, n, k == 0) for p, needles in enumerate([["licensed under", "version 2.0"], ["heron", "tion the"], ["example.com", "+1 ("], ["the", "und", "que"]]) for k, n in enumerate(needles)]


def signals(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SIGNALS, "profile int, signal int, needle string, required boolean")


def evidence(spark: SparkSession, d: str) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("path"), F.col("text").alias("content"))
    return runs.match_signals(docs, signals(spark))


def reasons(spark: SparkSession, d: str) -> DataFrame:
    """Addresses that the pages link, as import specs that no file answers."""
    from gridloom.functions import scalars as s

    p = spark.read.parquet(f"{d}/pages.parquet")
    specs = p.select(F.explode(F.regexp_extract_all("html", F.lit(r"""(?:href|src)="([^"]+)\""""), 1)).alias("spec"))
    own = specs.select("spec", s.unresolved_reason(F.col("spec"), F.lit(False)).alias("reason"))
    return extract.unresolved_summary(own, v.ACTIONABLE_REASONS)


HOUSE = ["of the", "in the", "de la", "in order to", "robust"]
DOCS = lambda sp, d: sp.read.parquet(f"{d}/documents.parquet")
PAGES = lambda sp, d: sp.read.parquet(f"{d}/pages.parquet")
MARKS = ["northwind-ds", "Lorem", "href=\"#", "class=\"ad"]


def fence_parity(spark: SparkSession, d: str) -> DataFrame:
    """Lines of pipe tables stand for fences, as documents have none."""
    docs = DOCS(spark, d).withColumn("text", F.regexp_replace("text", r"(?m)^(\S+) \| ", "```$1 | "))
    return text.fences(text.lines_of(docs)).groupBy("doc_id").agg(F.count("*").alias("lines"), F.count(F.when(F.col("skip"), 1)).alias("skipped"), F.max(F.when(F.col("unbalanced"), F.col("line_no"))).alias("open_at"))


def page_files(spark: SparkSession, d: str) -> DataFrame:
    return PAGES(spark, d).select(F.lit("web").alias("repo_id"), F.concat("page_id", F.lit(".html")).alias("path"), F.col("html").alias("content"))


QUERIES = {
    "quoted_words": lambda sp, d: extract.class_words(page_files(sp, d)).groupBy("class").agg(F.count("*").alias("uses"), F.countDistinct("path").alias("pages")),
    "page_scripts": lambda sp, d: extract.imports(page_files(sp, d)).where("kind = 'script'").select("path", "spec"),
    "trend_diff": diff,
    "regressions": regress,
    "compat_gate": gate,
    "ci_verdict": verdict,
    "run_agreement": agreement,
    "freshness": fresh,
    "evidence_merge": lambda sp, d: runs.merge_evidence(logical(sp, d, "roots")),
    "capability_merge": lambda sp, d: runs.merge_capabilities(logical(sp, d, "contributions")),
    "signal_match": evidence,
    "profile_score": lambda sp, d: runs.score_profiles(evidence(sp, d), signals(sp)),
    "unresolved_summary": reasons,
    "voice_lint": lambda sp, d: text.voice_lint(DOCS(sp, d), banned=HOUSE),
    "fence_parity": fence_parity,
    "markup_scan": lambda sp, d: text.markup_scan(PAGES(sp, d)),
    "visible_text": lambda sp, d: text.visible_text(PAGES(sp, d)).select("page_id", F.length("text").alias("n_chars"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256")),
    "retired_words": lambda sp, d: text.retired_words(PAGES(sp, d), ["the ", "copyright", "blast radius"]),
    "placeholder_scan": lambda sp, d: text.placeholders(PAGES(sp, d), MARKS),
    "path_leaks": lambda sp, d: text.path_leaks(PAGES(sp, d)),
}

_DIFF = "diff AS (SELECT coalesce(b.id, c.id) AS id, CASE WHEN b.id IS NULL THEN 'new' WHEN c.id IS NULL THEN 'resolved' WHEN c.occurrences > b.occurrences THEN 'grew' WHEN c.occurrences < b.occurrences THEN 'shrank' ELSE 'same' END AS change, b.occurrences AS before, c.occurrences AS after FROM (SELECT * FROM run_findings WHERE run_id = 'baseline') b FULL JOIN (SELECT * FROM run_findings WHERE run_id = 'current') c ON b.id = c.id)"
_GATE = """a AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY run_id) = 1), z AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY run_id DESC) = 1),
 owned AS (SELECT run_id, array_to_string(list_sort(list_distinct([owned_a, owned_b])), ',') AS o FROM runs),
 f AS (SELECT a.repo_id, 'framework' AS input, a.framework AS baseline, z.framework AS current FROM a JOIN z USING (repo_id) UNION ALL SELECT repo_id, 'intent', a.intent, z.intent FROM a JOIN z USING (repo_id) UNION ALL SELECT repo_id, 'scope', a.scope, z.scope FROM a JOIN z USING (repo_id)
  UNION ALL SELECT a.repo_id, 'owned_paths', x.o, y.o FROM a JOIN z USING (repo_id) JOIN owned x ON x.run_id = a.run_id JOIN owned y ON y.run_id = z.run_id), gate AS (SELECT * FROM f WHERE baseline IS DISTINCT FROM current)"""
_LINES = "ln AS (SELECT doc_id, i AS line_no, l[i] AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce({t}, ''), chr(10)) AS l FROM documents)))"
_HAS = lambda needles: "coalesce(" + ", ".join(f"CASE WHEN {test} THEN '{x}' END" for x, test in needles) + ")"
_VALUES = ", ".join(f"({p}, {k}, '{n}', {str(r).lower()})" for p, k, n, r in SIGNALS)
_EVIDENCE = f"signals(profile, signal, needle, required) AS (VALUES {_VALUES}), ev AS (SELECT profile, signal, required, min(doc_id) AS evidence, count(*) AS files FROM documents JOIN signals ON contains(lower(text), needle) GROUP BY 1, 2, 3)"
_SEEN = r"regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->|<[^>]*>', ' ', 'g')"
for _old, _new in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
    _SEEN = f"replace({_SEEN}, '{_old}', '{_new}')"
_PROSE = "replace(regexp_replace(regexp_replace(line, '`+[^`]*`+', ' ', 'g'), '<[^>]*>', ' ', 'g'), 'aria-labelledby', ' ')"
ORACLE = {
    "quoted_words": r"""WITH l AS (SELECT page_id, unnest(string_split(html, chr(10))) AS t FROM pages), q AS (SELECT page_id, unnest(regexp_extract_all(t, '("[^"\n]*"|''[^''\n]*'')', 1)) AS s FROM l), w AS (SELECT page_id, unnest(regexp_split_to_array(trim(substr(s, 2, length(s) - 2)), '\s+')) AS class FROM q)
      SELECT class, count(*) AS uses, count(DISTINCT page_id) AS pages FROM w WHERE class <> '' GROUP BY 1""",
    "page_scripts": r"""SELECT DISTINCT path, spec FROM (SELECT concat(page_id, '.html') AS path, unnest(regexp_extract_all(html, '(?i)<(?:script|style)\b[^>]*?src\s*=\s*[''"]([^''"]+)[''"]', 1)) AS spec FROM pages)""",
    "trend_diff": f"{with_sql('run_findings')}, {_DIFF} SELECT * FROM diff",
    "regressions": f"{with_sql('run_findings')}, {_DIFF} SELECT id, 'grew' AS why FROM diff WHERE change = 'grew' UNION ALL SELECT id, 'returned' FROM diff WHERE change = 'new' AND id < '8'",
    "compat_gate": f"{with_sql('runs')}, {_GATE} SELECT * FROM gate",
    "ci_verdict": f"""{with_sql("runs", "run_findings")}, {_GATE}, {_DIFF}, bad AS (SELECT DISTINCT CAST(concat('0x', substr(id, 1, 4)) AS BIGINT) % 25 AS repo_id FROM diff WHERE change = 'grew')
      SELECT DISTINCT repo_id, CASE WHEN repo_id % 6 = 0 THEN 'pass' WHEN repo_id IN (SELECT repo_id FROM gate WHERE input = 'scope') THEN 'refused' WHEN repo_id IN (SELECT repo_id FROM bad) THEN 'fail' ELSE 'pass' END AS verdict FROM runs""",
    "run_agreement": f"{with_sql('run_findings')}, b AS (SELECT * FROM run_findings WHERE run_id = 'baseline'), c AS (SELECT * FROM run_findings WHERE run_id = 'current') SELECT concat('s', substr(coalesce(b.id, c.id), 1, 1)) AS section, coalesce(b.id, c.id) AS field, CAST(b.files AS VARCHAR) AS a, CAST(c.files AS VARCHAR) AS b, b.files IS NOT DISTINCT FROM c.files AS same FROM b FULL JOIN c ON b.id = c.id",
    "freshness": f"""{with_sql("commits")}, h AS (SELECT repo_id, max(seq) AS head, max(seq) FILTER (event_type = 'signup') AS ref, arg_max(event_type, seq) AS last FROM commits GROUP BY 1)
      SELECT repo_id, CASE WHEN ref IS NULL THEN 'unknown' WHEN head = ref AND last <> 'error' THEN 'fresh' ELSE 'stale' END AS state, head - ref AS behind FROM h""",
    "evidence_merge": f"{with_sql('roots')} SELECT path, ({v.ROOT_RANK})[max(confidence_rank) + 1] AS confidence, array_to_string(list_sort(list(DISTINCT profile)), ',') AS profiles, CASE WHEN bool_or(ownership = 'owned') THEN 'owned' ELSE 'shared' END AS ownership FROM roots GROUP BY 1",
    "capability_merge": f"{with_sql('contributions')} SELECT ({v.CAPABILITIES})[capability + 1] AS capability, CASE WHEN bool_and(state = 'verified') THEN 'verified' ELSE 'not-visible' END AS state, count(DISTINCT state) > 1 AS conflict, count(DISTINCT profile) AS profiles FROM contributions GROUP BY contributions.capability",
    "signal_match": f"WITH {_EVIDENCE} SELECT * FROM ev",
    "profile_score": f"""WITH {_EVIDENCE}, o AS (SELECT s.profile, s.required, e.profile IS NOT NULL AS hit FROM signals s LEFT JOIN ev e ON e.profile = s.profile AND e.signal = s.signal),
      r AS (SELECT profile, count(*) FILTER (hit) AS hits, count(*) AS total, round(count(*) FILTER (hit) / count(*)::DOUBLE, 3) AS score, bool_and(hit OR NOT required) AND count(*) FILTER (hit AND NOT required) >= 1 AS active FROM o GROUP BY 1) SELECT *, row_number() OVER (ORDER BY score DESC, profile) AS rank FROM r""",
    "unresolved_summary": r"""WITH s AS (SELECT unnest(regexp_extract_all(html, '(?:href|src)="([^"]+)"', 1)) AS spec FROM pages), r AS (SELECT spec, CASE WHEN regexp_matches(spec, '^(https?:)?//|^data:') THEN 'remote dependency' WHEN spec LIKE 'sass:%' THEN 'framework built-in' WHEN spec LIKE '<dynamic:%' THEN 'dynamic runtime import' WHEN regexp_matches(spec, '^[./]') THEN 'missing local source' ELSE 'external package' END AS reason FROM s)
      SELECT reason, count(*) AS misses, count(DISTINCT spec) AS specs, reason IN ('missing local source', 'unsupported resolver', 'dynamic runtime import', 'ambiguous profile rewrite') AS actionable FROM r GROUP BY 1""",
    "voice_lint": f"""WITH {_LINES.format(t="text")}, p AS (SELECT doc_id, line_no, {_PROSE} AS prose FROM ln), f AS (SELECT doc_id, line_no, 'us-english' AS rule, {_HAS([(o, f"contains(prose, '{o}')") for o, _ in text.SPELLING])} AS detail FROM p
      UNION ALL SELECT doc_id, line_no, 'banned-phrase', {_HAS([(x, f"regexp_matches(lower(prose), '(^|[^a-z0-9_]){x}($|[^a-z0-9_])')") for x in HOUSE])} FROM p UNION ALL SELECT doc_id, line_no, 'negative-parallelism', CASE WHEN regexp_matches(prose, '(?i)\\b(is|are|was|were)\\s+not\\s+(a|an|the)\\b') THEN 'negative' END FROM p)
      SELECT * FROM f WHERE detail IS NOT NULL""",
    "fence_parity": rf"""WITH {_LINES.format(t=r"regexp_replace(text, '(?m)^(\S+) \| ', '```\1 | ', 'g')")}, k AS (SELECT *, CASE WHEN ltrim(line) LIKE '```%' THEN 1 ELSE 0 END AS f FROM ln), w AS (SELECT *, sum(f) OVER (PARTITION BY doc_id ORDER BY line_no) AS seen, sum(f) OVER (PARTITION BY doc_id) AS total FROM k)
      SELECT doc_id, count(*) AS lines, count(*) FILTER (f = 1 OR (seen % 2 = 1 AND seen < total)) AS skipped, max(line_no) FILTER (f = 1 AND seen = total AND total % 2 = 1) AS open_at FROM w GROUP BY 1""",
    "markup_scan": r"SELECT page_id, CAST(len(regexp_extract_all(html, '(?i)<script\b|<iframe\b|\son(?:error|load|mouseover|click|focus)\s*=|javascript:')) AS BIGINT) AS hits FROM pages WHERE regexp_matches(html, '(?i)<script\b|<iframe\b|\son(?:error|load|mouseover|click|focus)\s*=|javascript:')",
    "visible_text": f"SELECT page_id, length(t) AS n_chars, sha256(t) AS sha256 FROM (SELECT page_id, coalesce({_SEEN}, '') AS t FROM pages)",
    "retired_words": f"SELECT page_id, word FROM (SELECT page_id, lower(coalesce({_SEEN}, '')) AS t FROM pages) CROSS JOIN (SELECT unnest(['the ', 'copyright', 'blast radius']) AS word) WHERE contains(t, word)",
    "placeholder_scan": f"SELECT page_id, mark FROM pages CROSS JOIN (SELECT unnest({MARKS}) AS mark) WHERE contains(html, mark)",
    "path_leaks": r"SELECT page_id FROM pages WHERE regexp_matches(html, '(?:/Users/|/home/|[A-Z]:\\Users\\)[A-Za-z0-9._-]+')",
}
