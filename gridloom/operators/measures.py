"""The measures behind the eight checks: (keys, grade, measure, evidence) of each repository, from the tables that show them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import scalars as s
from gridloom.functions import vocabulary as v
from gridloom.operators import grades as g
from gridloom.operators.ranks import run_keys

#: The categories of the coverage check, as the families that stand for them.
CATEGORIES = ["color", "typography", "spacing", "sizing", "radius", "border", "elevation", "motion", "layer", "opacity", "breakpoint"]


def site(path: str = "path", line: str = "line") -> Column:
    return F.min(F.struct(path, line))


def _text(m: str) -> Column:
    return F.when(F.col(m).isNotNull(), F.concat_ws(":", f"{m}.path", F.col(f"{m}.line").cast("string")))


def _graded(df: DataFrame, grade: Column, measure: Column, evidence: Column) -> DataFrame:
    """With the rule that a problem needs one reachable instance."""
    own = F.when(evidence.isNull() & grade.isin("watch", "needs-work"), "not-visible").otherwise(grade)
    return df.select(*run_keys(df), own.alias("grade"), measure.cast("long").alias("measure"), evidence.alias("evidence"))


def tier_integrity(styles: DataFrame, refs: DataFrame, literals: DataFrame, concepts: DataFrame) -> DataFrame:
    """Component styles (path) that use a primitive, or a raw value, which a semantic token of their repository covers.

    refs: path, line, token; literals: path, line, literal; concepts: token, tier, alias_of, value. A semantic token covers the
    primitive that it aliases, and that one's value. The measure counts styles, not uses.
    """
    keys = run_keys(styles)
    named = concepts.where("tier = 'semantic' and alias_of is not null").select(*keys, F.col("alias_of").alias("token")).distinct()
    covered = concepts.where("tier = 'primitive'").join(named, [*keys, "token"]).select(*keys, "token", s.normalize_literal(F.col("value")).alias("literal"))
    skips = refs.join(covered.select(*keys, "token").distinct(), [*keys, "token"]).select(*keys, "path", "line")
    raw = literals.withColumn("literal", s.normalize_literal(F.col("literal"))).join(covered.where("literal <> ''").select(*keys, "literal").distinct(), [*keys, "literal"]).select(*keys, "path", "line")
    hit = skips.unionByName(raw).join(styles.select(*keys, "path").distinct(), [*keys, "path"], "left_semi").groupBy(*keys).agg(F.countDistinct("path").alias("n"), site().alias("m"))
    own = styles.groupBy(*keys).agg(F.countDistinct("path").alias("all")).join(hit, keys, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return _graded(own, g.grade_tier_integrity(F.col("n"), F.col("all")), F.col("n"), _text("m"))


def leakage(repos: DataFrame, findings: DataFrame, measured: DataFrame) -> DataFrame:
    """Distinct pairs of literal and token of the redundant tier. findings: tier, literal, token, path, line; measured: repositories whose redundancy was measured; the others are not visible."""
    keys = run_keys(repos)
    rows = findings.where("tier = 'redundant'").groupBy(*keys).agg(F.count_distinct(F.struct("literal", "token")).alias("n"), site().alias("m"))
    known = measured.select(*keys).distinct().withColumn("_known", F.lit(True))
    own = repos.select(*keys).distinct().join(rows, keys, "left").join(known, keys, "left").withColumn("n", F.when(F.col("_known"), F.coalesce("n", F.lit(0))))
    return _graded(own, g.grade_leakage(F.col("n")), F.col("n"), F.when(F.col("_known"), _text("m")))


def coverage(repos: DataFrame, declared: DataFrame, frameworks: DataFrame, gaps: DataFrame) -> DataFrame:
    """Categories that a project declares (family) or that its framework's default theme has (family, version).

    A framework without a version hides the check, as nothing says what its theme has. gaps (family, path, line) are hardcoded
    values; the first in a category that is lacking is the evidence.
    """
    keys = run_keys(repos)
    known = lambda df: df.where(F.col("family").isin(*CATEGORIES)).select(*keys, "family")
    have = known(declared).union(known(frameworks.where("version is not null"))).distinct()
    unclear = frameworks.where("version is null").select(*keys).distinct().withColumn("_unclear", F.lit(True))
    lacking = gaps.where(F.col("family").isin(*CATEGORIES)).join(have, [*keys, "family"], "left_anti").groupBy(*keys).agg(site().alias("m"))
    own = repos.select(*keys).distinct().join(have.groupBy(*keys).agg(F.count("*").alias("n")), keys, "left").join(unclear, keys, "left").join(lacking, keys, "left")
    n = F.when(F.col("_unclear").isNull(), F.coalesce("n", F.lit(0)))
    return _graded(own, g.grade_coverage(n), n, F.when(n.isNotNull(), _text("m")))


def mode_completeness(repos: DataFrame, declared: DataFrame, gaps: DataFrame, audited: DataFrame, resolved: DataFrame) -> DataFrame:
    """Gaps of declared modes (mode): tokens that lack one (token, mode, path, line); an audited pair (bundle, mode) without output hides the check, and no mode needs none."""
    keys = run_keys(repos)
    lost = g.unresolved_pairs(audited.select(*keys, "bundle", "mode").distinct(), resolved).groupBy(*keys).agg(F.count("*").alias("u"))
    own = repos.select(*keys).distinct()
    for df, name in ((declared.groupBy(*keys).agg(F.countDistinct("mode").alias("d")), "d"), (gaps.groupBy(*keys).agg(F.count("*").alias("n"), site().alias("m")), "n"), (lost, "u")):
        own = own.join(df, keys, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return _graded(own, g.grade_modes(F.col("d"), F.col("n"), F.col("u")), F.when((F.col("d") > 0) & (F.col("u") == 0), F.col("n")), _text("m"))


def naming_coherence(grammars: DataFrame) -> DataFrame:
    """The most grammars that one representation has, as they are counted in each and never across. grammars: rows of naming_grammars."""
    keys = run_keys(grammars)
    per = grammars.groupBy(*keys, "representation").agg(F.count("*").alias("n"), F.max("first_site").alias("e"))
    own = per.groupBy(*keys).agg(F.max(F.struct("n", "representation", "e")).alias("w"))
    return _graded(own, g.grade_naming(F.col("w.n")), F.col("w.n"), F.col("w.e"))


def single_source(decls: DataFrame) -> DataFrame:
    """The worst token of a run: declared once, at several places alike, or with different values. The measure counts tokens with more than one place."""
    keys = run_keys(decls)
    per = decls.groupBy(*keys, s.normalize(F.col("name")).alias("token")).agg(F.countDistinct("path").alias("sites"), F.countDistinct("value").alias("values"), site().alias("m"))
    level = F.when(F.col("sites") == 1, 0).when(F.col("values") == 1, 1).otherwise(2)
    own = per.withColumn("k", level).groupBy(*keys).agg(F.max("k").alias("k"), F.count(F.when(F.col("k") > 0, 1)).alias("n"), F.min(F.when(F.col("k") > 0, F.struct(-F.col("k"), F.col("m.path").alias("path"), F.col("m.line").alias("line")))).alias("m"))
    return _graded(own, F.element_at(F.array(F.lit("healthy"), F.lit("watch"), F.lit("needs-work")), F.col("k") + 1), F.col("n"), _text("m"))


def orphans(concepts: DataFrame, refs: DataFrame) -> DataFrame:
    """Defined tokens (token, path, line) that nothing of their repository references (token)."""
    keys = run_keys(concepts)
    used = refs.select(*keys, "token").distinct().withColumn("_used", F.lit(True))
    per = concepts.groupBy(*keys, "token").agg(site().alias("m")).join(used, [*keys, "token"], "left")
    own = per.groupBy(*keys).agg(F.count("*").alias("all"), F.count(F.when(F.col("_used").isNull(), 1)).alias("n"), F.min(F.when(F.col("_used").isNull(), F.col("m"))).alias("m"))
    return _graded(own, g.grade_orphans(F.col("n"), F.col("all")), F.col("n"), _text("m"))


def all_grades(**checks: DataFrame) -> DataFrame:
    """(keys, check_id, check, grade, measure, evidence) of the checks given by name, with _ for -."""
    out = None
    for name, df in checks.items():
        label = name.replace("_", "-")
        keys = run_keys(df)
        own = df.select(*keys, F.lit(v.CHECKS.index(label)).alias("check_id"), F.lit(label).alias("check"), "grade", "measure", "evidence")
        out = own if out is None else out.unionByName(own)
    return out
