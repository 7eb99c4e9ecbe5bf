"""Integrity rules over the tables: rows (repo_id, rule, detail); none is a pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import vocabulary as v
from gridloom.operators.grades import all_checks

REPO = ["repo_id"]


def rule(df: DataFrame, name: str, bad: Column, detail: Column) -> DataFrame:
    return df.where(bad).select(*REPO, F.lit(name).alias("rule"), detail.cast("string").alias("detail"))


def grade_rules(grades: DataFrame) -> DataFrame:
    """not-visible and not-needed need a note. grades: repo_id, check_id, grade, note."""
    notes = grades.groupBy(*REPO).agg(F.max("note").alias("note"))
    own = all_checks(grades.select(*REPO, "check_id", "grade")).join(notes, REPO)
    missing = F.col("note").isNull()
    return rule(own, "not-visible-needs-note", (F.col("grade") == "not-visible") & missing, F.col("check")).union(rule(own, "unexplained-not-needed", (F.col("grade") == "not-needed") & missing, F.col("check")))


def source_rules(sources: DataFrame) -> DataFrame:
    """Known roles only, and canonical and alias sources say what they are reached from. sources: repo_id, path, role, reachable_from."""
    roles = ["canonical", "alias", "consumer-override", "candidate", "consumer"]
    return rule(sources, "unknown-role", ~F.col("role").isin(*roles), F.col("path")).union(rule(sources, "source-without-route", F.col("role").isin("canonical", "alias") & (F.size("reachable_from") < 1), F.col("path")))


def family_rules(states: DataFrame) -> DataFrame:
    """All families are there, and not-visible has no number while the others have one."""
    dim = states.sparkSession.createDataFrame([(f,) for f in v.FAMILIES], "family string")
    missing = states.select(*REPO).distinct().crossJoin(F.broadcast(dim)).join(states, [*REPO, "family"], "left_anti").select(*REPO, F.lit("missing-family").alias("rule"), F.col("family").alias("detail"))
    wrong = (F.col("state") == "not-visible") == F.col("count").isNotNull()
    return missing.union(rule(states, "number-and-state-disagree", wrong, F.col("family")))


def capability_rules(capabilities: DataFrame) -> DataFrame:
    """Seven capabilities in legal states. capabilities: repo_id, capability (place), state."""
    dim = capabilities.sparkSession.createDataFrame([(k,) for k in range(len(v.CAPABILITIES))], "capability int")
    missing = capabilities.select(*REPO).distinct().crossJoin(F.broadcast(dim)).join(capabilities, [*REPO, "capability"], "left_anti").select(*REPO, F.lit("missing-capability").alias("rule"), F.col("capability").cast("string").alias("detail"))
    return missing.union(rule(capabilities, "illegal-state", ~F.col("state").isin("verified", "not-visible"), F.col("capability")))


def reason_rules(unresolved: DataFrame) -> DataFrame:
    return rule(unresolved, "unknown-reason", ~F.col("reason").isin(*v.UNRESOLVED_REASONS), F.col("spec"))


def ranking_rules(published: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Rows of a published table that its recomputation hasn't, and the other way round; both have the same columns."""
    shown = F.to_json(F.struct(*[F.col(c) for c in published.columns]))
    extra = published.exceptAll(recomputed.select(published.columns)).select(*REPO, F.lit("not-recomputed").alias("rule"), shown.alias("detail"))
    return extra.union(recomputed.select(published.columns).exceptAll(published).select(*REPO, F.lit("not-published").alias("rule"), shown.alias("detail")))


def queue_rules(queue: DataFrame) -> DataFrame:
    """A fix has a replacement, ids have 12 hex digits, and only redundant findings are automated."""
    bad = F.array(F.when(F.col("token").isNull(), "no-replacement"), F.when(~F.col("id").rlike("^[0-9a-f]{12}$"), "bad-id"), F.when(F.col("safe_to_automate") & (F.col("tier") != "redundant"), "unsafe-automation"))
    return queue.select(*REPO, F.explode(F.filter(bad, lambda x: x.isNotNull())).alias("rule"), F.col("id").alias("detail"))
