"""Integrity of what discovery recorded: profiles, ladder, roots and counts against each other. Rows (repo_id, rule, detail); none is a pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import vocabulary as v
from gridloom.operators.ranks import run_keys


def broken(df: DataFrame, detail: Column, **rules: Column) -> DataFrame:
    """A row for each rule whose test holds on a row of df; all tests in one pass. Rules are named with _ for -."""
    found = F.array(*[F.when(F.coalesce(test, F.lit(False)), name.replace("_", "-")) for name, test in rules.items()])
    return df.select(*run_keys(df), F.explode(F.filter(found, lambda x: x.isNotNull())).alias("rule"), detail.cast("string").alias("detail"))


def blank(c: str) -> Column:
    return F.coalesce(F.trim(F.col(c)) == "", F.lit(True))


def profile_rules(profiles: DataFrame) -> DataFrame:
    """profiles (profile, part, ord, adapter, kind, confidence, activation, evidence): part is active or candidate.

    An active profile is there once, says what it is, has evidence unless a person chose it, and is no candidate as well;
    active ones are numbered from 0 without gaps.
    """
    keys = run_keys(profiles)
    active = F.col("part") == "active"
    row = broken(
        profiles.where(active), F.col("profile"), profile_without_adapter_kind_or_confidence=blank("adapter") | blank("kind") | blank("confidence"),
        detected_profile_without_evidence=~F.col("activation").eqNullSafe("user-selected") & (F.coalesce(F.size("evidence"), F.lit(0)) < 1),
    )
    per = profiles.groupBy(*keys, "profile").agg(F.count(F.when(active, 1)).alias("a"), F.count(F.when(F.col("part") == "candidate", 1)).alias("c"))
    whole = profiles.where(active).groupBy(*keys).agg(F.count("*").alias("n"), F.countDistinct("ord").alias("d"), F.min("ord").alias("lo"), F.max("ord").alias("hi"))
    order = broken(whole, F.col("n"), profiles_out_of_order=(F.col("d") != F.col("n")) | (F.col("lo") != 0) | (F.col("hi") != F.col("n") - 1))
    return row.unionByName(broken(per, F.col("profile"), duplicated_active_profile=F.col("a") > 1, active_and_candidate=(F.col("a") > 0) & (F.col("c") > 0))).unionByName(order)


def ladder_rules(steps: DataFrame, capabilities: DataFrame) -> DataFrame:
    """steps (ord, capability, state, contributors, next_step, limitation) against the universal order and capabilities (capability, state)."""
    keys = run_keys(steps)
    names = F.array(*[F.lit(c) for c in v.CAPABILITIES])
    n = len(v.CAPABILITIES)
    order = broken(steps, F.col("capability"), ladder_out_of_order=~F.col("capability").eqNullSafe(F.get(names, F.col("ord").cast("int"))))
    per = steps.groupBy(*keys).agg(F.count("*").alias("n"), F.countDistinct("capability").alias("d"))
    size = broken(per, F.col("n"), ladder_steps_missing_or_duplicated=(F.col("n") != n) | (F.col("d") != n))
    own = steps.join(capabilities.select(*keys, "capability", F.col("state").alias("_state")), [*keys, "capability"], "left")
    rows = broken(
        own, F.col("capability"), ladder_state_disagrees=~F.col("state").eqNullSafe(F.col("_state")), step_without_contributor=F.coalesce(F.size("contributors"), F.lit(0)) < 1, step_without_next_step=blank("next_step"),
        incomplete_step_without_limitation=~F.col("state").eqNullSafe("verified") & blank("limitation"),
    )
    return order.unionByName(size).unionByName(rows)


def root_rules(roots: DataFrame, profiles: DataFrame, reached: DataFrame) -> DataFrame:
    """roots (path, part, root_type, ownership, confidence, evidence, profiles, exists, scope) of part product, candidate, missing, component or surface.

    Contributors are active profiles or, for roots of the product, a convention. A candidate is a static one that the graph did
    not reach; a surface is supplemental or a demo and not reached; a missing root does not exist; a component root is owned.
    """
    keys = run_keys(roots)
    part = lambda *names: F.col("part").isin(*names)
    active = profiles.where("part = 'active'").groupBy(*keys).agg(F.collect_set("profile").alias("_active"))
    seen = reached.select(*keys, F.col("node").alias("path"), F.lit(True).alias("_reached")).distinct()
    own = roots.join(active, keys, "left").join(seen, [*keys, "path"], "left")
    none = F.array().cast("array<string>")
    given, allowed = F.coalesce("profiles", none), F.coalesce("_active", none)
    allowed = F.when(part("product", "candidate"), F.array_union(allowed, F.array(F.lit("convention")))).otherwise(allowed)
    invalid = (F.size(F.array_except(given, allowed)) > 0) | ((F.size(given) == 0) & part("product", "surface", "component"))
    hit = F.col("_reached").isNotNull()
    return broken(
        own, F.concat_ws(": ", "part", "path"), invalid_contributors=invalid & ~part("missing"), root_lacks_a_field=part("product", "candidate") & (blank("root_type") | blank("ownership") | blank("confidence") | blank("evidence")),
        unknown_confidence=part("product") & ~F.coalesce(F.col("confidence").isin(*v.ROOT_RANK), F.lit(False)), candidate_is_no_static_candidate=part("candidate") & ~F.col("confidence").eqNullSafe("static candidate"),
        reachable_root_among_candidates=part("candidate") & hit, missing_root_exists=part("missing") & F.coalesce(F.col("exists"), F.lit(True)), component_root_not_owned=part("component") & ~F.col("ownership").eqNullSafe("owned"),
        surface_out_of_scope=part("surface") & ~F.coalesce(F.col("scope").isin("supplemental", "demo"), F.lit(False)), surface_promoted_to_product=part("surface") & hit,
    )


def selection_rules(selection: DataFrame, capabilities: DataFrame, roots: DataFrame) -> DataFrame:
    """selection (state): an ambiguous choice of application publishes no product root and leaves production_roots not visible."""
    keys = run_keys(selection)
    gate = capabilities.where("capability = 'production_roots'").select(*keys, F.col("state").alias("_gate"))
    some = roots.where("part = 'product'").groupBy(*keys).agg(F.count("*").alias("_roots"))
    own = selection.join(gate, keys, "left").join(some, keys, "left")
    unclear = F.col("state") == "not-visible"
    return broken(
        own, F.col("state"), invalid_selection_state=~F.coalesce(F.col("state").isin("root-application", "selected", "auto-selected", "not-visible"), F.lit(False)),
        ambiguous_selection_did_not_block_roots=unclear & ~F.col("_gate").eqNullSafe("not-visible"), ambiguous_selection_with_product_roots=unclear & (F.col("_roots") > 0),
    )


def inventory_rules(states: DataFrame, concepts: DataFrame, runs: DataFrame) -> DataFrame:
    """Counts of families (family, state, count) and of runs (token_count) against the concepts (token, family), whose names are distinct."""
    keys = run_keys(states)
    names = concepts.groupBy(*keys, "token").agg(F.count("*").alias("n"))
    twice = broken(names, F.col("token"), duplicate_concept=F.col("n") > 1)
    per = concepts.groupBy(*keys, "family").agg(F.count("*").alias("_n"))
    family = broken(states.where("state = 'counted'").join(per, [*keys, "family"], "left"), F.col("family"), family_count_disagrees=~F.col("count").eqNullSafe(F.coalesce("_n", F.lit(0))))
    total = broken(runs.join(concepts.groupBy(*keys).agg(F.count("*").alias("_n")), keys, "left"), F.col("token_count"), token_count_disagrees=~F.col("token_count").eqNullSafe(F.coalesce("_n", F.lit(0))))
    return twice.unionByName(family).unionByName(total)


def engine_rules(profiles: DataFrame, steps: DataFrame, capabilities: DataFrame, roots: DataFrame, reached: DataFrame, selection: DataFrame, states: DataFrame, concepts: DataFrame, runs: DataFrame) -> DataFrame:
    """All rules of this module over one set of tables."""
    parts = [profile_rules(profiles), ladder_rules(steps, capabilities), root_rules(roots, profiles, reached), selection_rules(selection, capabilities, roots), inventory_rules(states, concepts, runs)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def discovery_rules(runs: DataFrame, sources: DataFrame, roots: DataFrame) -> DataFrame:
    """Runs (detected_by) whose sources (path) were found by nothing on record: no source, one without roots (path), or neither a detector nor a root."""
    keys = run_keys(runs)
    n = lambda df, name: df.groupBy(*keys).agg(F.countDistinct("path").alias(name))
    own = runs.join(n(sources, "s"), keys, "left").join(n(roots, "r"), keys, "left").withColumns({"s": F.coalesce("s", F.lit(0)), "r": F.coalesce("r", F.lit(0))})
    none, single = F.col("s") == 0, (F.col("s") == 1) & (F.col("r") == 0)
    return broken(own, F.col("s"), no_token_source=none, one_source_without_roots=single, neither_detector_nor_roots=~none & ~single & blank("detected_by") & (F.col("r") == 0))


def mode_rules(grades: DataFrame, audited: DataFrame, resolved: DataFrame) -> DataFrame:
    """Repositories whose mode-completeness was graded (grade) although no pair (bundle, mode) was audited, or pairs lack output."""
    keys = run_keys(grades)
    graded = grades.where(F.col("grade").isin("healthy", "watch", "needs-work")).select(*keys, "grade")
    pairs = audited.select(*keys, "bundle", "mode").distinct()
    empty = broken(graded.join(pairs.select(*keys).distinct(), keys, "left_anti"), F.col("grade"), graded_without_audited_pairs=F.lit(True))
    lost = pairs.join(resolved.select(*keys, "bundle", "mode"), [*keys, "bundle", "mode"], "left_anti").join(graded, keys)
    return empty.unionByName(broken(lost, F.concat_ws(" / ", "bundle", "mode"), graded_without_output=F.lit(True)))


def root_evidence_rules(roots: DataFrame) -> DataFrame:
    """Roots (path, root_type, evidence, confidence, ownership) that lack a field or have an unknown confidence."""
    return broken(
        roots, F.col("path"), root_without_type=blank("root_type"), root_without_evidence=blank("evidence"), root_without_confidence=blank("confidence"), root_without_ownership=blank("ownership"),
        unknown_confidence=~F.coalesce(F.col("confidence").isin(*v.ROOT_RANK), F.lit(False)),
    )
