"""Runs against runs: the compatibility gate, the trend, regressions, agreement, freshness, and evidence merges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions import vocabulary as v
from gridloom.operators.discovery import join_rules
from gridloom.operators.evidence import needle_hits
from gridloom.operators.grades import all_checks
from gridloom.operators.ranks import ranked, repo_keys, run_keys


def compat_gate(a: DataFrame, b: DataFrame, exact: list[str], sets: list[str], key: str = "repo_id") -> DataFrame:
    """(key, input, baseline, current) of each input in which two runs differ; arrays of sets compare without order; null equals null."""
    both = a.select(key, *[F.col(c).alias(f"_a{c}") for c in exact + sets]).join(b.select(key, *[F.col(c).alias(f"_b{c}") for c in exact + sets]), key)
    text = lambda side, c: F.array_join(F.array_sort(F.array_distinct(F.col(f"_{side}{c}"))), ",") if c in sets else F.col(f"_{side}{c}").cast("string")
    rows = both.select(key, F.explode(F.array(*[F.struct(F.lit(c).alias("input"), text("a", c).alias("baseline"), text("b", c).alias("current")) for c in exact + sets])).alias("d")).select(key, "d.*")
    return rows.where(~F.col("baseline").eqNullSafe(F.col("current")))


def trend_diff(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """(repo_id where both have it, id, change, before, after): new, resolved, grew, shrank or same, by occurrences."""
    keys = [*repo_keys(baseline, current), "id"]
    both = baseline.select(*keys, F.col("occurrences").alias("before")).join(current.select(*keys, F.col("occurrences").alias("after")), keys, "full")
    change = F.when(F.col("before").isNull(), "new").when(F.col("after").isNull(), "resolved").when(F.col("after") > F.col("before"), "grew").when(F.col("after") < F.col("before"), "shrank").otherwise("same")
    return both.select(*keys, change.alias("change"), "before", "after")


def regressions(diff: DataFrame, resolved_before: DataFrame) -> DataFrame:
    """What grew, and what came back after it was resolved in the same repository."""
    keys = [*repo_keys(diff, resolved_before), "id"]
    back = diff.where("change = 'new'").join(resolved_before.select(*keys).distinct(), keys, "left_semi").select(*keys, F.lit("returned").alias("why"))
    return diff.where("change = 'grew'").select(*keys, F.lit("grew").alias("why")).union(back)


def ci_verdict(repos: DataFrame, baselines: DataFrame, gate: DataFrame, found: DataFrame) -> DataFrame:
    """pass without a baseline, refused where the gate diverges, fail with a regression, else pass. All by repo_id."""
    flag = lambda df, name: df.select("repo_id").distinct().withColumn(name, F.lit(True))
    out = repos.select("repo_id").distinct()
    for df, name in ((baselines, "b"), (gate, "g"), (found, "r")):
        out = out.join(flag(df, name), "repo_id", "left")
    return out.select("repo_id", F.when(F.col("b").isNull(), "pass").when(F.col("g"), "refused").when(F.col("r"), "fail").otherwise("pass").alias("verdict"))


def run_agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """(repo_id where both have it, section, field, a, b, same) of two runs' unpivoted fields; a field that one lacks is different."""
    key = [*repo_keys(a, b), "section", "field"]
    out = a.select(*key, F.col("value").alias("a")).join(b.select(*key, F.col("value").alias("b")), key, "full")
    return out.withColumn("same", F.col("a").eqNullSafe(F.col("b")))


def grades_agreed(a: DataFrame, b: DataFrame) -> DataFrame:
    """(repo_id, agreed, checks): of the eight checks of two runs' grades, those graded alike; a check that a run lacks is not visible in it."""
    both = all_checks(a).withColumnRenamed("grade", "a").join(all_checks(b).select("repo_id", "check_id", F.col("grade").alias("b")), ["repo_id", "check_id"])
    return both.groupBy("repo_id").agg(F.count(F.when(F.col("a") == F.col("b"), 1)).alias("agreed"), F.count("*").alias("checks"))


def evidence_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per check (and repo_id where both have it): evidence that both runs have, and that either alone has, from (check, item)."""
    keys = [*repo_keys(a, b), "check"]
    seen = a.select(*keys, "item", F.lit(1).alias("x"), F.lit(0).alias("y")).union(b.select(*keys, "item", F.lit(0), F.lit(1))).groupBy(*keys, "item").agg(F.max("x").alias("x"), F.max("y").alias("y"))
    return seen.groupBy(*keys).agg(F.sum(F.col("x") * F.col("y")).alias("shared"), F.sum(F.col("x") * (1 - F.col("y"))).alias("only_a"), F.sum((1 - F.col("x")) * F.col("y")).alias("only_b"))


def confidence_delta(a: DataFrame, b: DataFrame) -> DataFrame:
    """Changes of the comparable split: healthy, your_code (watch and needs-work), not_visible, not_needed. Inputs: grade_counts."""
    split = lambda df, p: df.select("repo_id", F.col("healthy").alias(f"{p}0"), (F.col("watch") + F.col("needs_work")).alias(f"{p}1"), F.col("not_visible").alias(f"{p}2"), F.col("not_needed").alias(f"{p}3"))
    out = split(a, "a").join(split(b, "b"), "repo_id")
    return out.select("repo_id", *[(F.col(f"b{k}") - F.col(f"a{k}")).alias(n) for k, n in enumerate(("healthy", "your_code", "not_visible", "not_needed"))])


def freshness(commits: DataFrame, refs: DataFrame, dirty: DataFrame) -> DataFrame:
    """(repo_id, state, behind): unknown without a known ref, fresh if nothing came since and the tree is clean, else stale.

    commits: repo_id, sha, seq; refs: repo_id, sha; dirty: repo_id.
    """
    head = commits.groupBy("repo_id").agg(F.max("seq").alias("head"))
    at = refs.join(commits.select("repo_id", "sha", "seq"), ["repo_id", "sha"]).select("repo_id", "seq")
    out = head.join(at, "repo_id", "left").join(dirty.select("repo_id").distinct().withColumn("_dirty", F.lit(True)), "repo_id", "left")
    behind = F.col("head") - F.col("seq")
    return out.select("repo_id", F.when(behind.isNull(), "unknown").when((behind == 0) & F.col("_dirty").isNull(), "fresh").otherwise("stale").alias("state"), behind.alias("behind"))


def merge_evidence(roots: DataFrame) -> DataFrame:
    """One record a path: the strongest confidence, all profiles, owned if any record is. roots: path, confidence_rank, ownership, profile."""
    keys = [*run_keys(roots), "path"]
    rows = roots.groupBy(*keys).agg(F.max("confidence_rank").alias("r"), F.array_join(F.array_sort(F.collect_set("profile")), ",").alias("profiles"), F.bool_or(F.col("ownership") == "owned").alias("o"))
    return rows.select(*keys, F.element_at(F.array(*[F.lit(c) for c in v.ROOT_RANK]), F.col("r") + 1).alias("confidence"), "profiles", F.when(F.col("o"), "owned").otherwise("shared").alias("ownership"))


def merge_capabilities(contributions: DataFrame) -> DataFrame:
    """The most conservative state of each capability, and whether profiles disagree. contributions: capability, state, profile."""
    keys = run_keys(contributions)
    rows = contributions.groupBy(*keys, "capability").agg(F.bool_and(F.col("state") == "verified").alias("ok"), (F.countDistinct("state") > 1).alias("conflict"), F.countDistinct("profile").alias("profiles"))
    return rows.select(*keys, F.element_at(F.array(*[F.lit(c) for c in v.CAPABILITIES]), F.col("capability") + 1).alias("capability"), F.when(F.col("ok"), "verified").otherwise("not-visible").alias("state"), "conflict", "profiles")


def promote_roots(roots: DataFrame, reached: DataFrame) -> DataFrame:
    """A static candidate that the first walk of its repository reached is import-graph verified."""
    keys = run_keys(roots)
    hit = reached.select(*keys, "path").distinct().withColumn("_hit", F.lit(True))
    promoted = (F.col("confidence") == "static candidate") & F.col("_hit")
    return roots.join(hit, [*keys, "path"], "left").withColumn("confidence", F.when(promoted, "import-graph verified").otherwise(F.col("confidence"))).drop("_hit")


def match_signals(files: DataFrame, signals: DataFrame) -> DataFrame:
    """files (path, content) by signals (profile, signal, needle, required): the first file that holds each needle, whatever its case.

    All needles are sought in one pass over the files; what is found joins the rules by equality.
    """
    keys = run_keys(files)
    hits = needle_hits(files, signals, lines=False).join(F.broadcast(signals.withColumn("needle", F.lower("needle"))), "needle")
    return hits.groupBy(*keys, "profile", "signal", "required").agg(F.min("path").alias("evidence"), F.count("*").alias("files"))


def score_profiles(evidence: DataFrame, signals: DataFrame, minimum: int = 1) -> DataFrame:
    """hits / signals to three places, per repository where evidence has them; active if all required signals hit and enough of the others do.

    Ranked by score, then by priority where signals have one (the highest of a profile's), then by profile. A repository
    without any evidence has no rows.
    """
    keys = run_keys(evidence)
    rules = signals.select("profile", "signal", "required").distinct()
    want = join_rules(evidence.select(*keys).distinct(), rules, F.lit(True)) if keys else rules
    own = want.join(evidence.select(*keys, "profile", "signal", F.lit(1).alias("hit")), [*keys, "profile", "signal"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    rows = own.groupBy(*keys, "profile").agg(F.sum("hit").alias("hits"), F.count("*").alias("total"), F.min(F.when(F.col("required"), F.col("hit"))).alias("must"), F.sum(F.when(~F.col("required"), F.col("hit")).otherwise(0)).alias("more"))
    active = (F.coalesce("must", F.lit(1)) == 1) & (F.col("more") >= minimum)
    scored = rows.select(*keys, "profile", "hits", "total", F.round(F.col("hits") / F.col("total"), 3).alias("score"), active.alias("active"))
    if "priority" not in signals.columns:
        return ranked(scored, [F.desc("score"), "profile"])
    first = signals.groupBy("profile").agg(F.max("priority").alias("priority"))
    return ranked(scored.join(first, "profile", "left"), [F.desc("score"), F.desc("priority"), "profile"])
