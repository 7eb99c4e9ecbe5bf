"""Hardcoded literals against tokens: exact, near-miss and uncovered, ranked and grouped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions import scalars as s
from gridloom.functions import vocabulary as v
from gridloom.operators.ranks import ranked, run_keys
from gridloom.sources.staged import staged

REPO = ["repo_id"]


def literal_groups(literals: DataFrame) -> DataFrame:
    """Occurrences, files, and breadth (plugins, all else as core) of each literal, with the properties that it stands in.

    Occurrences are counted as they are spelled before literals are normalised and paths are looked at.
    """
    parts = F.split("path", "/")
    plugin = F.when((F.get(parts, F.lit(0)) == "plugins") & (F.size(parts) > 1), F.get(parts, F.lit(1))).otherwise("core")
    per = literals.groupBy(*REPO, "literal", "path", "property").agg(F.count("*").alias("_n"))
    own = per.withColumn("literal", s.normalize_literal(F.col("literal")))
    return own.groupBy(*REPO, "literal").agg(F.sum("_n").alias("occurrences"), F.countDistinct("path").alias("files"), F.countDistinct(plugin).alias("breadth"), F.array_sort(F.collect_set("property")).alias("properties"))


def exact_value_leaks(literals: DataFrame, decls: DataFrame, representation: str = "css-custom-property") -> DataFrame:
    """Each literal group with the color tokens of the same value, sorted: a candidate for replacement, or uncovered.

    Groups are aggregated before they meet the tokens, so the join has a row a distinct literal.
    """
    tokens = decls.where(F.col("representation") == representation).where(s.family_for(F.col("name"), F.col("value")) == "color")
    tokens = tokens.groupBy(*REPO, s.normalize_literal(F.col("value")).alias("literal")).agg(F.array_join(F.array_sort(F.collect_set(s.normalize(F.col("name")))), ",").alias("token_candidates"))
    rows = literal_groups(literals).join(tokens, [*REPO, "literal"], "left")
    tier = F.when(F.col("token_candidates").isNotNull(), "exact-value-candidate").otherwise("uncovered-candidate")
    confidence = F.lit("manual review")
    return rows.select(
        *REPO, s.finding_id(tier, F.lit("color"), F.col("literal"), F.col("token_candidates")).alias("id"), tier.alias("tier"), "literal", "token_candidates", "occurrences", "files", "breadth", confidence.alias("confidence"),
        s.score(F.col("occurrences"), F.col("files"), F.col("breadth"), confidence).alias("score"),
    )


def rank_findings(findings: DataFrame) -> DataFrame:
    """Findings with their rank: score, then id."""
    return ranked(findings, [F.desc("score"), "id"])


def rank_leaks(leaks: DataFrame) -> DataFrame:
    """Total order of leaks: files, tier, nearest token (none last), literal, and path and line where leaks have them."""
    tier = F.array_position(F.array(*[F.lit(t) for t in v.LEAK_TIERS]), F.col("tier"))
    return ranked(leaks, [F.desc("files"), tier, F.asc_nulls_last("token"), "literal", *[c for c in ("path", "line") if c in leaks.columns]])


def consequence_order(leaks: DataFrame) -> DataFrame:
    """leaks (repo_id, category, literal, files) by what a wrong value costs: color first, dimension last, others after; then files, then literal."""
    rank = F.array_position(F.array(*[F.lit(c) for c in v.CONSEQUENCE]), F.col("category"))
    return ranked(leaks, [F.when(rank > 0, rank).otherwise(len(v.CONSEQUENCE) + 1), F.desc("files"), "literal"])


def near_miss_dimension(literals: DataFrame, steps: DataFrame, tolerance: float = 2, gap: float = 4) -> DataFrame:
    """literals (repo_id, literal, px) within tolerance of a step (repo_id, family, px), where steps lie gap apart or more.

    Exact values are no near misses. Both sides meet in buckets as wide as the tolerance, so the join is an equality.
    """
    w = Window.partitionBy(*REPO, "family").orderBy("px")
    apart = steps.select(*REPO, "family", "px").distinct().withColumn("_d", F.least(F.coalesce(F.col("px") - F.lag("px").over(w), F.lit(1e18)), F.coalesce(F.lead("px").over(w) - F.col("px"), F.lit(1e18)))).where(F.col("_d") >= gap)
    bucket = lambda x: F.floor(x / tolerance)
    spread = apart.withColumn("_b", F.explode(F.array(*[bucket(F.col("px")) + k for k in (-1, 0, 1)]))).select(*REPO, "_b", "family", F.col("px").alias("step"))
    exact = steps.select(*REPO, "px").distinct()
    own = literals.select(*REPO, "literal", "px").distinct().join(exact, [*REPO, "px"], "left_anti").withColumn("_b", bucket(F.col("px")))
    near = own.join(spread, [*REPO, "_b"]).where(F.abs(F.col("px") - F.col("step")) <= tolerance)
    return near.groupBy(*REPO, "literal").agg(F.min(F.struct(F.abs(F.col("px") - F.col("step")).alias("distance"), "family", "step")).alias("m")).select(*REPO, "literal", "m.distance", "m.family", "m.step")


def near_miss_duration(literals: DataFrame, steps: DataFrame, tolerance: float = 50) -> DataFrame:
    """As near_miss_dimension for milliseconds, without the rule on gaps."""
    return near_miss_dimension(literals, steps, tolerance, gap=0)


#: Widths of the cells of near_miss_color in lightness, and in a and b.
CELL_L, CELL_AB = 5.0, 8.0


def chroma_reach(lab: Column, most: float) -> Column:
    """How far from a color, in a and b, any color may lie whose CIEDE2000 to it is below most.

    With the primed chroma c of the color and the reach r, the other's is c + r at most, so that chroma and hue differences
    are divided by 1 + 0.045 (c + r / 2) at most, and r <= k (1 + 0.045 c) / (1 - 0.0225 k) with k = most / sqrt(1 - t / 2),
    where t bounds the rotation term. t is 2 sin(60) at most; a reach so found bounds the mean chroma and the mean hue, which
    bound t again: four rounds. The bound holds for most below 16. Priming stretches a by 1.5 at most, by less if chroma is high, and turns a hue by 11.6 degrees
    at most. The rotation is below 0.0005 where the mean hue is 75 degrees or more from 275.
    """
    a, b = lab["a"], lab["b"]
    raw = F.sqrt(a * a + b * b)
    seven = lambda c: F.pow(c / 25, F.lit(7.0)) / (F.pow(c / 25, F.lit(7.0)) + 1)
    chroma = raw * (F.lit(1.5) - F.lit(0.5) * F.sqrt(seven(raw / 2)))
    turn = F.abs(F.degrees(F.atan2(b, a)) + 85)  # 275 is -85
    off = F.when(turn > 180, F.lit(360) - turn).otherwise(turn)
    reach = lambda k, c: k * (F.lit(1) + F.lit(0.045) * c) / (F.lit(1) - F.lit(0.0225) * k)
    first = most / (1 - 0.8661) ** 0.5
    if first * 0.0225 >= 1:
        raise ValueError("most must be below 16")

    def closer(now: Column, _: Column) -> Column:
        k, c = now["k"], now["c"]
        r = reach(k, c)
        swing = F.when(r < c, F.degrees(F.asin(F.least(r / c, F.lit(1.0)))) / 2).otherwise(F.lit(180.0))
        t = F.when(now["off"] >= F.lit(75 + 11.6) + swing, F.lit(0.0005)).otherwise(F.lit(1.7321) * F.sqrt(seven(c + r / 2)))
        return F.struct((F.lit(most) / F.sqrt(F.lit(1) - t / 2)).alias("k"), c.alias("c"), now["off"].alias("off"))

    start = F.struct(F.lit(first).alias("k"), chroma.alias("c"), off.alias("off"))
    return F.aggregate(F.array(*[F.lit(k) for k in range(4)]), start, closer, lambda x: reach(x["k"], x["c"])) * 1.001 + 0.01


def color_candidates(left: DataFrame, right: DataFrame, most: float) -> DataFrame:
    """Pairs of colors (_lab of left, _q of right) of a repository of which none is lost whose CIEDE2000 is below most.

    Cells have three dimensions. A color of right lies in every cell that its reach touches, one of left in its own, so each
    pair meets once and by equality. Lightness differs by 1.75 * most at most, as its divisor is at most that; what it takes
    of the difference is not left for a and b, so of the pairs that meet those outside of an ellipsoid go.
    """
    keys = run_keys(left)
    cell = lambda x, w: F.floor(x / w).cast("int")
    span = lambda x, r, w: F.explode(F.sequence(cell(x - r, w), cell(x + r, w)))
    spread = right.withColumn("_r", chroma_reach(F.col("_q"), most)).withColumn("_i", span(F.col("_q.l"), F.lit(1.75 * most + 0.01), CELL_L)).withColumn("_j", span(F.col("_q.a"), F.col("_r"), CELL_AB)).withColumn("_k", span(F.col("_q.b"), F.col("_r"), CELL_AB))
    own = left.withColumns({"_i": cell(F.col("_lab.l"), CELL_L), "_j": cell(F.col("_lab.a"), CELL_AB), "_k": cell(F.col("_lab.b"), CELL_AB)})
    part = lambda c, by: F.pow((F.col(f"_lab.{c}") - F.col(f"_q.{c}")) / by, F.lit(2.0))
    met = own.join(spread, [*keys, "_i", "_j", "_k"]).where(part("l", F.lit(1.75 * most)) + part("a", F.col("_r")) + part("b", F.col("_r")) <= 1.001)
    return met.drop("_i", "_j", "_k", "_r")


def near_miss_color(literals: DataFrame, tokens: DataFrame, most: float = 3.0) -> DataFrame:
    """The closest token of each distinct literal below a CIEDE2000 of most; literals that equal a token are none.

    Of tokens of one value the first by name stands for all. Candidates are those of color_candidates. Values and literals are
    put together as they are spelled and written out before anything is worked out of them, so formulas run once a spelling.
    """
    hexed = lambda df, c: df.where(F.col(c).rlike("^#[0-9a-f]{6}$"))
    spelled = staged(tokens.groupBy(*REPO, "value").agg(F.min("token").alias("token")))
    values = hexed(spelled.groupBy(*REPO, s.normalize_literal(F.col("value")).alias("value")).agg(F.min("token").alias("token")), "value")
    written = staged(literals.select(*REPO, "literal").distinct())
    names = hexed(written.select(*REPO, s.normalize_literal(F.col("literal")).alias("literal")).distinct(), "literal").join(values.select(*REPO, F.col("value").alias("literal")), [*REPO, "literal"], "left_anti")
    right, left = s.with_lab(staged(values), "value", "_q"), s.with_lab(staged(names), "literal", "_lab")
    pairs = s.with_delta_e(color_candidates(left, right, most), "_lab", "_q", "de")
    # The bound follows the aggregate: as a filter before it, the whole formula would be repeated in the join's condition.
    best = pairs.groupBy(*REPO, "literal").agg(F.min(F.struct("de", "token", "value")).alias("m")).where(F.col("m.de") < most)
    return best.select(*REPO, "literal", "m.token", "m.value", F.round("m.de", 6).alias("delta_e"))


def leak_cascade(literals: DataFrame, redundant: DataFrame, exact: DataFrame, near: DataFrame) -> DataFrame:
    """Each literal's first tier that holds: redundant, exact value, near miss, uncovered. The others are (repo_id, literal, token)."""
    out = literals.select(*REPO, "literal").distinct()
    for name, table in (("r", redundant), ("e", exact), ("n", near)):
        out = out.join(table.groupBy(*REPO, "literal").agg(F.min("token").alias(name)), [*REPO, "literal"], "left")
    tier = F.when(F.col("r").isNotNull(), v.LEAK_TIERS[0]).when(F.col("e").isNotNull(), v.LEAK_TIERS[1]).when(F.col("n").isNotNull(), v.LEAK_TIERS[2]).otherwise(v.LEAK_TIERS[3])
    return out.select(*REPO, "literal", tier.alias("tier"), F.coalesce("r", "e", "n").alias("token"))


def leak_state(groups: DataFrame, repos: DataFrame) -> DataFrame:
    """Nothing left to compare is counted with 0; groups without a proof of their role are not-visible with null."""
    counts = groups.groupBy(*REPO).agg(F.count("*").alias("groups"))
    out = repos.select(*REPO).distinct().join(counts, REPO, "left").withColumn("groups", F.coalesce("groups", F.lit(0)))
    return out.select(*REPO, "groups", F.when(F.col("groups") == 0, "counted").otherwise("not-visible").alias("state"), F.when(F.col("groups") == 0, F.lit(0)).cast("long").alias("redundant"))


def owner_groups(literals: DataFrame) -> DataFrame:
    """The same occurrences by value, by component and by owner, each with its own counts and score."""
    per = literals.groupBy(*REPO, "path", s.normalize_literal(F.col("literal")).alias("value")).agg(F.count("*").alias("n"))
    # A path's owners are worked out once, not once an occurrence.
    paths = literals.select(*REPO, "path").distinct().withColumn("component", s.component_identity(F.col("path"))["key"]).withColumn("owner", s.owner_for(F.col("path")))
    cells = F.array(*[F.struct(F.lit(k).alias("dimension"), F.col(k).alias("key")) for k in ("value", "component", "owner")])
    rows = per.join(paths, [*REPO, "path"]).select(*REPO, "path", "n", F.explode(cells).alias("g")).select(*REPO, "path", "n", "g.dimension", "g.key")
    out = rows.groupBy(*REPO, "dimension", "key").agg(F.sum("n").alias("occurrences"), F.countDistinct("path").alias("files"))
    return out.withColumn("score", s.score(F.col("occurrences"), F.col("files"), F.lit(1), F.lit("manual review")))


def location_preview(locations: DataFrame, k: int = 2) -> DataFrame:
    """locations (repo_id, id, path, line): the first k lines of each file, and how many are hidden."""
    w = Window.partitionBy(*REPO, "id", "path")
    return locations.withColumn("_r", F.row_number().over(w.orderBy("line"))).withColumn("hidden", F.greatest(F.count("*").over(w) - k, F.lit(0))).where(F.col("_r") <= k).select(*REPO, "id", "path", "line", "hidden")


def fix_queue(findings: DataFrame) -> DataFrame:
    """Findings with a replacement, with effort, whether a tool may apply them, and their place in the order."""
    rows = findings.where("token is not null").withColumn("effort", s.effort(F.col("tier"), F.col("confidence"), F.col("files"), F.col("proven"))).withColumn("safe_to_automate", s.is_automatable(F.col("tier"), F.col("confidence"), F.col("proven")))
    return rank_findings(rows)


def leak_scope(reached: DataFrame, sources: DataFrame) -> DataFrame:
    """Reached style files (path) that define no tokens: where a literal counts as a leak. sources: path, role."""
    keys = run_keys(reached)
    style = reached.where(F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(".css", ".scss", ".sass", ".less"))
    return style.join(sources.where(F.col("role").isin("canonical", "alias")).select(*keys, "path"), [*keys, "path"], "left_anti")
