"""Eight checks of a repository, never one score: grades, stages, what to unlock and what to do next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions import vocabulary as v
from gridloom.operators.ranks import run_keys

REPO = ["repo_id"]


def _ladder(value: Column, healthy: Column, watch: Column) -> Column:
    return F.when(value.isNull(), "not-visible").when(healthy, "healthy").when(watch, "watch").otherwise("needs-work")


def grade_tier_integrity(skips: Column, styles: Column) -> Column:
    """Component styles that skip a semantic sibling: none, up to 5 percent, more."""
    return _ladder(skips, skips == 0, skips <= 0.05 * styles)


def grade_leakage(pairs: Column) -> Column:
    """Distinct redundant pairs of literal and token: none, up to 10, more; null is unmeasured."""
    return _ladder(pairs, pairs == 0, pairs <= 10)


def grade_coverage(categories: Column) -> Column:
    return _ladder(categories, categories >= 11, categories >= 8)


def grade_modes(declared: Column, gaps: Column, unresolved: Column) -> Column:
    """No declared mode needs no grade; a pair without output hides it; any gap is work."""
    return F.when(declared == 0, "not-needed").when((unresolved > 0) | gaps.isNull(), "not-visible").when(gaps == 0, "healthy").otherwise("needs-work")


def grade_naming(grammars: Column) -> Column:
    return _ladder(grammars, grammars <= 1, grammars == 2)


def grade_orphans(orphans: Column, total: Column) -> Column:
    """Share of defined tokens that nothing uses: below 2 percent, up to 10, more."""
    return F.when(orphans.isNull() | (total == 0), "not-visible").when(100 * orphans < 2 * total, "healthy").when(100 * orphans <= 10 * total, "watch").otherwise("needs-work")


def grade_enforcement(rules: Column) -> Column:
    """No rule found is no proof that there is none."""
    return F.when(rules >= 2, "healthy").when(rules == 1, "watch").otherwise("not-visible")


def with_evidence(grade: Column, evidence: Column) -> Column:
    """A problem without one reachable instance is not visible."""
    return F.when((F.size(evidence) == 0) & grade.isin("watch", "needs-work"), "not-visible").otherwise(grade)


def all_checks(grades: DataFrame) -> DataFrame:
    """Every check of every repository; what has no grade is not-visible. grades: repo_id, check_id, grade."""
    dim = grades.sparkSession.createDataFrame([(k, c) for k, c in enumerate(v.CHECKS)], "check_id int, check string")
    out = grades.select(*REPO).distinct().crossJoin(F.broadcast(dim)).join(grades, [*REPO, "check_id"], "left")
    return out.select(*REPO, "check_id", "check", F.when(F.col("grade").isin(*v.GRADES), F.col("grade")).otherwise("not-visible").alias("grade"))


def grade_counts(grades: DataFrame) -> DataFrame:
    """Counts of the five grades, which always add up to eight."""
    return all_checks(grades).groupBy(*REPO).agg(*[F.count(F.when(F.col("grade") == g, 1)).alias(g.replace("-", "_")) for g in v.GRADES])


def worst_grade(grades: DataFrame) -> DataFrame:
    rank = F.array_position(F.array(*[F.lit(g) for g in v.SEVERITY]), F.col("grade"))
    return all_checks(grades).groupBy(*REPO).agg(F.min_by("grade", rank).alias("worst"))


#: Which checks a stage beyond the first needs at healthy or watch, or not needed.
STAGE_NEEDS = [("declared", ["single-source"]), ("adopted", ["leakage", "orphans"]), ("layered", ["tier-integrity", "naming-coherence"]), ("complete", ["coverage", "mode-completeness"]), ("held", ["enforcement"])]


def maturity_stage(grades: DataFrame) -> DataFrame:
    """The stage before the earliest whose needs are unmet, and the later ones that are met already."""
    met = lambda c: F.max(F.when((F.col("check") == c) & F.col("grade").isin("healthy", "watch", "not-needed"), 1).otherwise(0))
    wide = all_checks(grades).groupBy(*REPO).agg(*[F.least(F.lit(1), *[met(c) for c in needs]).alias(name) for name, needs in STAGE_NEEDS])
    stage = F.when(F.lit(False), "")
    for k, (name, _) in enumerate(STAGE_NEEDS):
        stage = stage.when(F.col(name) == 0, v.STAGES[k])
    later = F.array_join(F.filter(F.array(*[F.when(F.col(n) == 1, n) for n, _ in STAGE_NEEDS]), lambda x: x.isNotNull()), ",")
    return wide.select(*REPO, stage.otherwise("held").alias("stage"), later.alias("met"))


#: The capabilities that a check can't do without.
REQUIRED = {
    "tier-integrity": ["token_source_discovery"], "leakage": ["import_resolution", "token_source_discovery"], "coverage": ["detection"], "mode-completeness": ["mode_resolution"],
    "naming-coherence": ["token_source_discovery"], "single-source": ["token_source_discovery"], "orphans": ["production_roots", "import_resolution", "ownership"], "enforcement": ["detection"],
}


def unlock_path(grades: DataFrame, capabilities: DataFrame) -> DataFrame:
    """Capabilities that aren't verified by the checks not visible that they would unlock: most first, then the ladder's order.

    capabilities: repo_id, capability (its place in the ladder), state.
    """
    spark = grades.sparkSession
    need = spark.createDataFrame([(c, v.CAPABILITIES.index(x)) for c, xs in REQUIRED.items() for x in xs], "check string, capability int")
    blocked = all_checks(grades).where("grade = 'not-visible'").join(F.broadcast(need), "check")
    rows = blocked.join(capabilities.where("state <> 'verified'").select(*REPO, "capability"), [*REPO, "capability"]).groupBy(*REPO, "capability").agg(F.count("*").alias("unlocks"), F.array_join(F.array_sort(F.collect_set("check")), ",").alias("checks"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*REPO).orderBy(F.desc("unlocks"), "capability")))


def ranked_moves(grades: DataFrame, unlock: DataFrame) -> DataFrame:
    """Fixes in check order, then decisions, then unlocks in path order; the first is the next move."""
    checks = all_checks(grades)
    fix = checks.where("grade in ('needs-work', 'watch')").select(*REPO, F.lit(0).alias("kind"), (F.when(F.col("grade") == "needs-work", 0).otherwise(8) + F.col("check_id")).alias("sub"), F.col("check").alias("what"))
    decide = checks.where("grade = 'not-needed'").select(*REPO, F.lit(1), F.col("check_id"), "check")
    opened = unlock.select(*REPO, F.lit(2), F.col("rank"), F.element_at(F.array(*[F.lit(c) for c in v.CAPABILITIES]), F.col("capability") + 1))
    rows = fix.union(decide).union(opened)
    kind = F.element_at(F.array(F.lit("fix"), F.lit("decide"), F.lit("unlock")), F.col("kind") + 1)
    return rows.select(*REPO, kind.alias("kind"), "what", F.row_number().over(Window.partitionBy(*REPO).orderBy("kind", "sub")).alias("rank"))


def next_steps(findings: DataFrame, k: int = 5) -> DataFrame:
    """findings (repo_id, class_ord, id, reach, evidence): by class and reach, with evidence, k at most."""
    own = findings.where(F.size("evidence") > 0)
    return own.withColumn("rank", F.row_number().over(Window.partitionBy(*REPO).orderBy("class_ord", F.desc("reach"), "id"))).where(F.col("rank") <= k)


def coverage_matrix(bundles: DataFrame, modes: DataFrame, families: DataFrame, cells: DataFrame) -> DataFrame:
    """Every bundle of a repository in each of its modes for every family; a missing cell is not visible.

    bundles: bundle; modes: mode; cells: bundle, mode, family, state, each with the keys that bundles have. families is the
    fixed list, at most all known ones.
    """
    keys = run_keys(bundles)
    names = sorted({r[0] for r in families.select("family").distinct().limit(len(v.FAMILIES) + 1).collect()})
    if len(names) > len(v.FAMILIES):
        raise ValueError("families is a list of known families")
    per = modes.select(*keys, "mode").distinct().groupBy(*keys).agg(F.collect_set("mode").alias("_modes"))
    own = bundles.select(*keys, "bundle").distinct()
    own = own.join(per, keys) if keys else own.crossJoin(F.broadcast(per))
    out = own.select(*keys, "bundle", F.explode("_modes").alias("mode")).select("*", F.explode(F.array(*[F.lit(n) for n in names]).cast("array<string>")).alias("family"))
    return out.join(cells, [*keys, "bundle", "mode", "family"], "left").select(*keys, "bundle", "mode", "family", F.coalesce("state", F.lit("not-visible")).alias("state"))


def mode_gaps(concept_modes: DataFrame, appearance: tuple[str, ...] = ("color", "elevation")) -> DataFrame:
    """Tokens of families that depend on appearance, in the declared modes that don't define them.

    concept_modes: token, family, mode, and keys. The modes that a repository declares are one row; a token's own are removed
    from them as a set.
    """
    keys = run_keys(concept_modes)
    modes = concept_modes.groupBy(*keys).agg(F.array_sort(F.collect_set("mode")).alias("_all"))
    per = concept_modes.where(F.col("family").isin(*appearance)).groupBy(*keys, "token", "family").agg(F.collect_set("mode").alias("_own"))
    both = per.join(modes, keys) if keys else per.crossJoin(F.broadcast(modes))
    return both.select(*keys, "token", "family", F.explode(F.array_except("_all", "_own")).alias("mode"))


def unresolved_pairs(audited: DataFrame, resolved: DataFrame) -> DataFrame:
    """Audited pairs (bundle, mode) of a repository without output in it."""
    keys = [*run_keys(audited), "bundle", "mode"]
    return audited.join(resolved.select(*keys).distinct(), keys, "left_anti")


def adoption_model(capabilities: DataFrame, usage: DataFrame) -> DataFrame:
    """token-led-hybrid if production roots are verified and usage was counted; else assessment first."""
    roots = capabilities.where("capability = 1").groupBy(*REPO).agg(F.bool_and(F.col("state") == "verified").alias("roots"))
    out = roots.join(usage.groupBy(*REPO).agg(F.sum("references").alias("references")), REPO, "left")
    return out.select(*REPO, F.when(F.col("roots") & (F.col("references") > 0), "token-led-hybrid").otherwise("assess-first").alias("model"))


def check_confidence(grades: DataFrame, capabilities: DataFrame, notes: DataFrame) -> DataFrame:
    """(repo_id, check, state, blocked_by, rationale, decision_owed) for all eight checks.

    A check that isn't visible waits for its required capabilities that aren't verified; one that isn't needed owes a
    rationale. capabilities: repo_id, capability (place in the ladder), state; notes: repo_id, check_id, note.
    """
    spark = grades.sparkSession
    need = spark.createDataFrame([(c, v.CAPABILITIES.index(x)) for c, xs in REQUIRED.items() for x in xs], "check string, capability int")
    verified = capabilities.groupBy(*REPO, "capability").agg(F.bool_and(F.col("state") == "verified").alias("_ok"))
    checks = all_checks(grades)
    waits = checks.where("grade = 'not-visible'").join(F.broadcast(need), "check").join(verified, [*REPO, "capability"], "left").where("not coalesce(_ok, false)")
    name = F.element_at(F.array(*[F.lit(c) for c in v.CAPABILITIES]), F.col("capability") + 1)
    blocked = waits.groupBy(*REPO, "check").agg(F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("capability", name.alias("n")))), lambda x: x["n"]), ",").alias("b"))
    own = checks.join(blocked, [*REPO, "check"], "left").join(notes.groupBy(*REPO, "check_id").agg(F.max("note").alias("note")), [*REPO, "check_id"], "left")
    unneeded = F.col("grade") == "not-needed"
    return own.select(*REPO, "check", F.col("grade").alias("state"), F.coalesce("b", F.lit("")).alias("blocked_by"), F.when(unneeded, F.col("note")).alias("rationale"), (unneeded & F.col("note").isNull()).alias("decision_owed"))


#: What a verified capability lets a report claim.
WIN_CLAIMS = {
    "detection": "Framework detected", "production_roots": "Production roots verified", "import_resolution": "Import graph verified", "token_source_discovery": "Token sources verified", "ownership": "Ownership established",
    "mode_resolution": "Modes resolve", "runtime_verification": "Runtime values read from a build",
}


def wins(capabilities: DataFrame, measurements: DataFrame, confidence: DataFrame) -> DataFrame:
    """(repo_id, ord, claim, evidence): verified capabilities that have a measurement, in the ladder's order, then checks that aren't needed for a reason on record.

    measurements: repo_id, capability, evidence; confidence: rows of check_confidence. Without a measurement nothing is claimed.
    """
    verified = capabilities.groupBy(*REPO, "capability").agg(F.bool_and(F.col("state") == "verified").alias("_ok")).where("_ok")
    proof = measurements.where("evidence is not null and evidence <> ''").groupBy(*REPO, "capability").agg(F.array_join(F.slice(F.array_sort(F.collect_set("evidence")), 1, 4), ", ").alias("evidence"))
    claim = F.element_at(F.array(*[F.lit(WIN_CLAIMS[c]) for c in v.CAPABILITIES]), F.col("capability") + 1)
    seen = verified.join(proof, [*REPO, "capability"]).select(*REPO, F.col("capability").alias("ord"), claim.alias("claim"), "evidence")
    place = F.array_position(F.array(*[F.lit(c) for c in sorted(v.CHECKS)]), F.col("check")).cast("int") + len(v.CAPABILITIES) - 1
    unneeded = confidence.where("state = 'not-needed' and rationale is not null").select(*REPO, place.alias("ord"), F.concat("check", F.lit(": not needed here")).alias("claim"), F.col("rationale").alias("evidence"))
    return seen.unionByName(unneeded)


#: Decisions that only a reader can make, most consequential first.
DECISIONS = ["matching-colors", "root-owners", "held-out-sources", "reasons-owed"]


def report_moves(grades: DataFrame, unlock: DataFrame, findings: DataFrame, roots: DataFrame, held_out: DataFrame, confidence: DataFrame) -> DataFrame:
    """(repo_id, kind, sub, what, count): all that waits for a reader.

    A fix for each check that needs work, in the order of the checks; one decision each for exact-value findings (tier), roots
    of unknown ownership, held-out sources (path) and checks switched off without a reason; an unlock for each step of
    unlock_path, in its order. Only repositories with grades have moves.
    """
    checks = all_checks(grades)
    count = lambda df, what: df.groupBy(*REPO).agg(F.count("*").alias("count")).select(*REPO, F.lit("decide").alias("kind"), F.lit(DECISIONS.index(what)).alias("sub"), F.lit(what).alias("what"), "count")
    fix = checks.where("grade = 'needs-work'").select(*REPO, F.lit("fix").alias("kind"), F.col("check_id").alias("sub"), F.col("check").alias("what"), F.lit(1).cast("long").alias("count"))
    name = F.element_at(F.array(*[F.lit(c) for c in v.CAPABILITIES]), F.col("capability") + 1)
    opened = unlock.select(*REPO, F.lit("unlock").alias("kind"), F.col("rank").alias("sub"), name.alias("what"), F.col("unlocks").alias("count"))
    calls = [
        count(findings.where(F.col("tier").isin("exact-value-candidate", "exact-value candidate")), "matching-colors"), count(roots.where("ownership = 'unknown'"), "root-owners"),
        count(held_out.select(*REPO, "path").distinct(), "held-out-sources"), count(confidence.where("decision_owed"), "reasons-owed"),
    ]
    out = fix.unionByName(opened)
    for call in calls:
        out = out.unionByName(call)
    return out.join(checks.select(*REPO).distinct(), REPO, "left_semi")


def counters(grades: DataFrame, moves: DataFrame) -> DataFrame:
    """(repo_id, fix, decide, unlock): checks that need work, calls to make, and checks that can't be seen; fix and unlock count checks, decide counts calls."""
    per = all_checks(grades).groupBy(*REPO).agg(F.count(F.when(F.col("grade") == "needs-work", 1)).alias("fix"), F.count(F.when(F.col("grade") == "not-visible", 1)).alias("unlock"))
    calls = moves.where("kind = 'decide'").groupBy(*REPO).agg(F.count("*").alias("decide"))
    return per.join(calls, REPO, "left").select(*REPO, "fix", F.coalesce("decide", F.lit(0)).alias("decide"), "unlock")


def success_metrics(sources: DataFrame, resolved: DataFrame, components: DataFrame, redundant: DataFrame, identity: DataFrame) -> DataFrame:
    """(repo_id, metric, baseline): the five measures that an adoption plan starts from, as text; what was not measured is not-visible and no zero.

    sources: path; resolved: bundle, mode; components: component; redundant: redundant (null if unmeasured); identity: typography,
    brand (states). A repository that any of them names has all five.
    """
    repos = None
    for df in (sources, resolved, components, redundant, identity):
        repos = df.select(*REPO) if repos is None else repos.union(df.select(*REPO))
    number = lambda df, *c: df.select(*REPO, *c).distinct().groupBy(*REPO).agg(F.count("*").alias("n"))
    out = repos.distinct().join(number(sources, "path").withColumnRenamed("n", "a"), REPO, "left").join(number(resolved, "bundle", "mode").withColumnRenamed("n", "b"), REPO, "left")
    out = out.join(number(components, "component").withColumnRenamed("n", "c"), REPO, "left").join(redundant.groupBy(*REPO).agg(F.max("redundant").alias("d")), REPO, "left")
    out = out.join(identity.groupBy(*REPO).agg(F.max("typography").alias("t"), F.max("brand").alias("k")), REPO, "left")
    none = F.lit("not-visible")
    text = lambda c: F.col(c).cast("string")
    rows = [
        ("source-consolidation", F.coalesce(text("a"), F.lit("0"))), ("mode-proof", F.coalesce(text("b"), F.lit("0"))), ("component-adoption", F.coalesce(text("c"), none)),
        ("verified-leakage", F.coalesce(text("d"), none)), ("identity-integrity", F.concat_ws(" / ", F.coalesce("t", none), F.coalesce("k", none))),
    ]
    return out.select(*REPO, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), x.alias("baseline")) for m, x in rows])).alias("r")).select(*REPO, "r.*")
