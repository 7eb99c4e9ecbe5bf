"""What files and pages prove: guardrail rules, findings that pages show, what makes a component, and summaries of places."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import scalars as s
from gridloom.functions import vocabulary as v
from gridloom.operators.discovery import _ancestors
from gridloom.operators.extract import STYLE, extension
from gridloom.operators.grades import grade_enforcement, with_evidence
from gridloom.operators.ranks import ranked, run_keys

#: Files that configure linters and pipelines.
CONFIG_FILE = r"(?i)(?:^|/)(?:\.?(?:stylelint|eslint|biome|prettier|oxlint)[^/]*|package\.json|lefthook\.ya?ml|\.pre-commit-config\.ya?ml|\.gitlab-ci\.ya?ml|\.github/workflows/[^/]+\.ya?ml|\.circleci/config\.yml)$"


def trie_regex(needles: list[str]) -> str:
    """A regex for any of the texts, the longest at a place, that shares their common beginnings, so a place is tried once and not once a text."""
    root: dict = {}
    for needle in needles:
        at = root
        for c in needle:
            at = at.setdefault(c, {})
        at[""] = {}

    def write(node: dict) -> str:
        # The depth is that of the longest run without a branch or end: chains are written as text.
        parts = []
        for c in sorted(k for k in node if k):
            text, child = c, node[c]
            while len(child) == 1 and "" not in child:
                (d, child), text = next(iter(child.items())), text + next(iter(child))
            parts.append(re.sub(r"([^\w\s-])", r"\\\1", text, flags=re.ASCII) + write(child))
        if not parts:
            return ""
        return f"(?:{'|'.join(parts)})" + ("?" if "" in node else "")

    return write(root)


def needle_hits(files: DataFrame, needles: DataFrame, lines: bool = True) -> DataFrame:
    """(keys, path, line, needle): where each text of needles (needle) stands in files (path, content), whatever its case.

    One expression finds the longest text at every place of a line, and what other texts begin with joins it by equality, so
    files are read once and never paired with rules. Without lines, each file gives each text once, with no line.
    """
    keys = run_keys(files)
    spark = files.sparkSession
    known = sorted({r[0].lower() for r in needles.select("needle").distinct().collect() if r[0]})
    if not known:
        return files.select(*keys, "path", F.lit(0).alias("line"), F.lit("").alias("needle")).limit(0)
    within = {(a, a[:n]) for a in known for n in range(1, len(a) + 1)} & {(a, b) for a in known for b in {a[:n] for n in range(1, len(a) + 1)} & set(known)}
    table = spark.createDataFrame(sorted(within), "found string, needle string")
    pattern = f"(?=({trie_regex(known)}))"
    if lines:
        rows = files.select(*keys, "path", F.posexplode(F.split(F.lower("content"), "\n", -1)).alias("k", "text")).select(*keys, "path", (F.col("k") + 1).alias("line"), "text")
    else:
        rows = files.select(*keys, "path", F.lit(None).cast("int").alias("line"), F.lower("content").alias("text"))
    # The empty match of a place without any is no row, as the group is never empty.
    # Rows are numbered before they are exploded: files may repeat, and each gives its texts once.
    found = rows.withColumn("_row", F.monotonically_increasing_id()).select(*keys, "path", "line", "_row", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), 1))).alias("found"))
    return found.join(F.broadcast(table), "found").select(*keys, "path", "line", "_row", "needle").distinct().drop("_row")


def enforcement_rules(files: DataFrame, rules: DataFrame) -> DataFrame:
    """(keys, rule, places, evidence): rules that read tokens and stand in a configuration file, with the first place of each.

    rules: rule, needle. A rule may have several needles.
    """
    keys = run_keys(files)
    hits = needle_hits(files.where(F.col("path").rlike(CONFIG_FILE)), rules)
    own = hits.join(rules.select("rule", F.lower("needle").alias("needle")).distinct(), "needle").select(*keys, "rule", "path", "line").distinct()
    rows = own.groupBy(*keys, "rule").agg(F.count("*").alias("places"), F.min(F.struct("path", "line")).alias("m"))
    return rows.select(*keys, "rule", "places", F.concat_ws(":", "m.path", F.col("m.line").cast("string")).alias("evidence"))


def enforcement(repos: DataFrame, found: DataFrame) -> DataFrame:
    """(keys, rules, evidence, grade): distinct rules of each repository of repos and the grade of the check; none found is not visible."""
    keys = run_keys(repos)
    rows = found.groupBy(*keys).agg(F.countDistinct("rule").alias("n"), F.array_sort(F.collect_set("evidence")).alias("e"))
    own = repos.select(*keys).distinct().join(rows, keys, "left").withColumns({"n": F.coalesce("n", F.lit(0)), "e": F.coalesce("e", F.array().cast("array<string>"))})
    return own.select(*keys, F.col("n").alias("rules"), F.col("e").alias("evidence"), with_evidence(grade_enforcement(F.col("n")), F.col("e")).alias("grade"))


def published_ids(pages: DataFrame, text: str = "html") -> DataFrame:
    """(keys, id): all runs of twelve hex digits of the pages, those within longer runs too."""
    keys = run_keys(pages)
    return pages.select(*keys, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit("(?=([0-9a-f]{12}))"), 1))).alias("id")).distinct()


#: Twelve hex digits that stand alone.
ALONE = r"(?<![0-9a-z])([0-9a-f]{12})(?![0-9a-z])"


def page_gaps(findings: DataFrame, pages: DataFrame, text: str = "html", mark: str = ALONE) -> DataFrame:
    """(keys, id, gap): findings (id) of a repository that its pages don't show, and ids that stand alone on a page and no finding has.

    A finding counts as shown wherever its digits stand. The other way round only runs of exactly twelve digits with a letter
    among them are ids, as longer runs are digests and shorter ones numbers. Where pages mark their ids, mark is a regex
    whose group is a marked id, and digits elsewhere in the text are none.
    """
    keys = run_keys(findings)
    have = findings.where(F.col("id").rlike("^[0-9a-f]{12}$")).select(*keys, "id").distinct()
    missing = have.join(published_ids(pages, text), [*keys, "id"], "left_anti").withColumn("gap", F.lit("absent from the page"))
    marked = F.regexp_extract_all(text, F.lit(mark), 1)
    shown = pages.select(*keys, F.explode(F.array_distinct(marked)).alias("id")).where(F.col("id").rlike("[a-f]")).distinct()
    return missing.unionByName(shown.join(have, [*keys, "id"], "left_anti").withColumn("gap", F.lit("unknown to the data")))


def proven_roots(roots: DataFrame) -> DataFrame:
    """Component roots (prefix, confidence, ownership) that a registration or the graph proves and that are owned."""
    return roots.where(F.col("prefix").isNotNull() & F.col("confidence").isin(*v.COMPONENT_RANK[2:]) & (F.col("ownership") == "owned"))


def component_units(files: DataFrame, roots: DataFrame) -> DataFrame:
    """(keys, key, name, kind, confidence, files, has_source, has_style): the units that files (path) make, with the best evidence that one is a component.

    A unit is a component if its path says so, if a proven root covers a file of it, or if it has source and style; its
    confidence is the strongest of those. Others keep their kind and are path-inferred. roots: prefix, confidence, ownership;
    a path meets them as its own ancestors.
    """
    keys = run_keys(files)
    place = F.array_position(F.array(*[F.lit(r) for r in v.COMPONENT_RANK]), F.col("confidence")) - 1
    strongest = proven_roots(roots).groupBy(*keys, "prefix").agg(F.max(place).alias("_root"))
    paths = files.select(*keys, "path").distinct()
    covered = paths.select(*keys, "path", F.explode(_ancestors()).alias("prefix")).join(strongest, [*keys, "prefix"]).groupBy(*keys, "path").agg(F.max("_root").alias("_root"))
    own = paths.withColumn("c", s.component_identity(F.col("path"))).withColumn("_style", extension(F.col("path")).isin(*STYLE)).join(covered, [*keys, "path"], "left")
    units = own.groupBy(*keys, "c.key").agg(
        F.min("c.name").alias("name"), F.min("c.kind").alias("_kind"), F.count("*").alias("files"), F.bool_or(~F.col("_style")).alias("has_source"), F.bool_or("_style").alias("has_style"),
        F.bool_or(F.col("c.kind") == "component").alias("_named"), F.max("_root").alias("_root"),
    )
    both = F.col("has_source") & F.col("has_style")
    rank = F.greatest(F.lit(0), F.when(both, 1), F.col("_root"))
    kind = F.when(F.col("_named") | F.col("_root").isNotNull() | both, "component").otherwise(F.col("_kind"))
    return units.select(*keys, "key", "name", kind.alias("kind"), F.element_at(F.array(*[F.lit(r) for r in v.COMPONENT_RANK]), rank.cast("int") + 1).alias("confidence"), "files", "has_source", "has_style")


def locations_by_file(locations: DataFrame) -> DataFrame:
    """(keys, id, path, places, first): places `path:line` or `path:line:column` of each id by file; a place that names no line stands by itself with a null path."""
    keys = run_keys(locations)
    site = r"^(.*?):(\d+)(?::\d+)?$"
    hit = F.col("location").rlike(site)
    own = locations.withColumns({"path": F.when(hit, F.regexp_extract("location", site, 1)), "line": F.when(hit, F.regexp_extract("location", site, 2).cast("int")), "alone": F.when(~hit, F.col("location"))})
    return own.groupBy(*keys, "id", "path", "alone").agg(F.count("*").alias("places"), F.min(F.struct("line", "location")).alias("m")).select(*keys, "id", "path", "places", F.col("m.location").alias("first"))


def state_counts(cells: DataFrame, states: tuple[str, ...] = ("counted", "not-visible", "not-needed")) -> DataFrame:
    """Per repository, cells of each state; one of no known state is not visible."""
    keys = run_keys(cells)
    own = F.when(F.col("state").isin(*states), F.col("state")).otherwise("not-visible")
    return cells.withColumn("_s", own).groupBy(*keys).agg(*[F.count(F.when(F.col("_s") == x, 1)).alias(x.replace("-", "_")) for x in states])


def pair_counts(audited: DataFrame, resolved: DataFrame) -> DataFrame:
    """Per repository, audited pairs (bundle, mode) and those with output."""
    keys = run_keys(audited)
    done = resolved.select(*keys, "bundle", "mode").distinct().withColumn("_ok", F.lit(1))
    return audited.select(*keys, "bundle", "mode").distinct().join(done, [*keys, "bundle", "mode"], "left").groupBy(*keys).agg(F.count("*").alias("audited"), F.count("_ok").alias("resolved"))


def top_share(usage: DataFrame, totals: DataFrame, n: int = 5) -> DataFrame:
    """(keys, rows, carried, whole, of, share): what the first n ranked rows carry, of all references where a total was recorded, else of the rows shown.

    usage: component, references, rank; totals: references, null where none was recorded.
    """
    keys = run_keys(usage)
    rows = usage.groupBy(*keys).agg(F.count(F.when(F.col("rank") <= n, 1)).alias("rows"), F.sum(F.when(F.col("rank") <= n, F.col("references")).otherwise(0)).alias("carried"), F.sum("references").alias("_shown"))
    own = rows.join(totals.select(*keys, F.col("references").alias("_all")), keys, "left")
    recorded = F.coalesce(F.col("_all") > 0, F.lit(False))
    whole = F.when(recorded, F.col("_all")).otherwise(F.col("_shown"))
    return own.select(*keys, "rows", "carried", whole.alias("whole"), F.when(recorded, "all").otherwise("shown").alias("of"), s.rounded_percent(F.col("carried"), whole).alias("share"))


def root_type(path: Column, declared: Column) -> Column:
    """What a root is the entry of: as declared if that is a known type, else as its path says."""
    known = ["common", "desktop", "mobile", "admin", "theme", "route", "component", "lazy", "manifest", "template", "demo"]
    out = F.when(declared.isin(*known), declared)
    for kind in ("desktop", "mobile", "admin", "theme"):
        out = out.when(F.contains(F.lower(path), F.lit(kind)), kind)
    return out.otherwise("common")


def taxonomy_drift(prose: DataFrame, families: list[str] = v.FAMILIES) -> DataFrame:
    """(family, drift): families only in the code, only in the prose (ord, family), or in another place although both have the same ones."""
    code = prose.sparkSession.createDataFrame(list(enumerate(families)), "ord int, family string")
    both = code.select("family", F.col("ord").alias("a")).join(prose.select("family", F.col("ord").alias("b")), "family", "full")
    one = F.when(F.col("b").isNull(), "only in code").when(F.col("a").isNull(), "only in prose")
    differs = both.agg(F.bool_and(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("_same"))
    return both.crossJoin(F.broadcast(differs)).withColumn("drift", F.coalesce(one, F.when(F.col("_same") & (F.col("a") != F.col("b")), "order differs"))).where("drift is not null").select("family", "drift")


def move_order(moves: DataFrame) -> DataFrame:
    """moves (kind, sub, what) with their rank: fixes, then decisions, then unlocks, each by sub."""
    return ranked(moves, [F.array_position(F.array(*[F.lit(k) for k in ("fix", "decide", "unlock")]), F.col("kind")), "sub", "what"])
