"""Who uses the tokens: component rollups, the ranked view and its bands, utilities and themes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions import scalars as s
from gridloom.functions import vocabulary as v
from gridloom.operators.ranks import first_ranks, ranked, run_keys

REPO = ["repo_id"]

#: A utility prefix and the namespaces that it draws from.
UTILITY_PREFIXES = [
    ("bg", ["color"]), ("text", ["color", "text"]), ("border", ["color"]), ("ring", ["color"]), ("fill", ["color"]), ("stroke", ["color"]), ("outline", ["color"]), ("accent", ["color"]), ("caret", ["color"]),
    ("decoration", ["color"]), ("divide", ["color"]), ("font", ["font", "font-weight"]), ("leading", ["leading"]), ("tracking", ["tracking"]), ("rounded", ["radius"]), ("shadow", ["shadow"]),
    ("inset-shadow", ["inset-shadow"]), ("drop-shadow", ["drop-shadow"]), ("blur", ["blur"]), ("perspective", ["perspective"]), ("ease", ["ease"]), ("animate", ["animate"]), ("aspect", ["aspect"]),
    ("max-w", ["container", "max-width"]), ("p", ["spacing"]), ("px", ["spacing"]), ("py", ["spacing"]), ("pt", ["spacing"]), ("pr", ["spacing"]), ("pb", ["spacing"]), ("pl", ["spacing"]),
    ("m", ["spacing"]), ("mx", ["spacing"]), ("my", ["spacing"]), ("mt", ["spacing"]), ("mr", ["spacing"]), ("mb", ["spacing"]), ("ml", ["spacing"]), ("gap", ["spacing"]), ("gap-x", ["spacing"]), ("gap-y", ["spacing"]),
    ("space-x", ["spacing"]), ("space-y", ["spacing"]), ("w", ["spacing", "container"]), ("h", ["spacing"]), ("size", ["spacing"]),
]


def known_refs(refs: DataFrame, concepts: DataFrame, definitions: DataFrame) -> DataFrame:
    """References to concepts of their run from files that define none. concepts: token, family; definitions: path; keys as far as concepts have them."""
    keys = run_keys(concepts)
    return refs.join(definitions.select(*keys, "path").distinct(), [*keys, "path"], "left_anti").join(concepts.select(*keys, "token", "family"), [*keys, "token"])


def component_rollup(refs: DataFrame) -> DataFrame:
    """refs (repo_id, component, path, token, family, syntax): references, distinct tokens, families and syntaxes a component.

    Counted in two steps: by component and family first, so that a large component is summed from partial rows.
    """
    parts = refs.groupBy(*REPO, "component", "family").agg(F.count("*").alias("n"), F.collect_set("syntax").alias("syntaxes"), F.countDistinct("token").alias("tokens"))
    return parts.groupBy(*REPO, "component").agg(
        F.sum("n").alias("references"), F.sum("tokens").alias("distinct_tokens"), F.array_sort(F.collect_list(F.struct("family", "n"))).alias("families"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("syntaxes")))).alias("syntaxes"),
    )


def rank_components(usage: DataFrame) -> DataFrame:
    """usage with each component's rank: references, distinct tokens, then its key."""
    return ranked(usage, [F.desc("references"), F.desc("distinct_tokens"), "component"])


def top_components(usage: DataFrame, n: int = 20) -> DataFrame:
    """The first n by rank: components first, surfaces only where components don't fill the list. usage has is_component."""
    order = [F.desc("is_component"), F.desc("references"), F.desc("distinct_tokens"), "component"]
    return first_ranks(usage, order, n)


def roadmap_bands(ranked_rows: DataFrame) -> DataFrame:
    """Each ranked row's share, cumulative share and band, told from the share before the row."""
    own = ranked(ranked_rows, ["rank"], name="_place", running="references")
    band = F.when(F.col("_total") == 0, v.ROADMAP_BANDS[-1][0])
    for name, share in v.ROADMAP_BANDS:
        band = band.when(F.col("_before") * 100 < share * F.col("_total"), name)
    return own.select(
        *ranked_rows.columns, s.rounded_percent(F.col("references"), F.col("_total")).alias("share"), s.rounded_percent(F.col("_before") + F.col("references"), F.col("_total")).alias("cumulative_share"), band.otherwise(v.ROADMAP_BANDS[-1][0]).alias("band"),
    )


def band_rollup(bands: DataFrame) -> DataFrame:
    return bands.groupBy(*REPO, "band").agg(F.min("rank").alias("start_rank"), F.max("rank").alias("end_rank"), F.count("*").alias("components"), F.sum("references").alias("references"))


def usage_totals(refs: DataFrame, n: int = 20) -> DataFrame:
    """Denominators of the ranked view."""
    per = refs.groupBy(*REPO, "component").agg(F.count("*").alias("references"))
    return per.groupBy(*REPO).agg(F.count("*").alias("components"), F.sum("references").alias("references"), F.greatest(F.count("*") - n, F.lit(0)).alias("not_shown"))


def prefix_table(spark) -> DataFrame:
    rows = [(p, k, n) for p, names in UTILITY_PREFIXES for k, n in enumerate(names)]
    return spark.createDataFrame(rows, "prefix string, ord int, namespace string")


def merge_theme(default: DataFrame, project: DataFrame) -> DataFrame:
    """(keys, namespace, key, value, origin): the project's value where it has one. Both tables have the same keys."""
    keys = run_keys(project)
    own = lambda df, name: df.groupBy(*keys, "namespace", "key").agg(F.min("value").alias(name))
    out = own(default, "d").join(own(project, "p"), [*keys, "namespace", "key"], "full")
    return out.select(*keys, "namespace", "key", F.coalesce("p", "d").alias("value"), F.when(F.col("p").isNotNull(), "project").otherwise("default").alias("origin"))


def resolve_utilities(classes: DataFrame, prefixes: DataFrame, theme: DataFrame) -> DataFrame:
    """(keys, class, state, concept, derived): the longest prefix alone decides; a named key of the repository's theme beats a numeric step of the root token.

    classes: class. Each class meets the prefixes as the stems of its own hyphen segments, so that no pair of a class and
    a prefix is made that doesn't match. Two named keys are ambiguous. Derived matches are told apart from named ones.
    """
    repo = run_keys(theme)
    own = classes.select(*repo, "class").distinct().withColumn("base", s.peel(F.col("class")))
    parts = F.split("base", "-")
    stems = own.where(~F.col("base").rlike(r"[\[(]") & (F.col("base") != "")).select(*repo, "class", "base", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "-"))).alias("prefix"))
    known = stems.join(F.broadcast(prefixes.select("prefix").distinct()), "prefix").groupBy(*repo, "class", "base").agg(F.max_by("prefix", F.length("prefix")).alias("prefix"))
    spaces = known.withColumn("key", F.regexp_replace(F.expr("substring(base, length(prefix) + 1)"), "^-+", "")).join(F.broadcast(prefixes), "prefix")
    keys = theme.select(*repo, "namespace", "key").distinct()
    named = keys.withColumn("_named", F.lit(True))
    root = keys.where("key = ''").select(*repo, "namespace", F.lit(True).alias("_root"))
    seen = spaces.join(named, [*repo, "namespace", "key"], "left").join(root, [*repo, "namespace"], "left")
    concept = lambda k: F.when(k == "", F.col("namespace")).otherwise(F.concat_ws("-", "namespace", k))
    step = F.col("_named").isNull() & F.col("_root") & F.col("key").rlike(r"^\d+(\.\d+)?$")
    rows = seen.groupBy(*repo, "class").agg(
        F.count("_named").alias("n"), F.min(F.when(F.col("_named"), concept(F.col("key")))).alias("c"), F.min(F.when(step, F.struct("ord", concept(F.lit("")).alias("c")))).alias("d"),
    )
    out = own.select(*repo, "class").join(rows, [*repo, "class"], "left")
    state = F.when(F.col("n") > 1, "ambiguous").when((F.col("n") == 1) | F.col("d").isNotNull(), "resolved").otherwise("unresolved")
    derived = F.coalesce((F.col("n") == 0) & F.col("d").isNotNull(), F.lit(False))
    return out.select(*repo, "class", state.alias("state"), F.when(F.col("n") == 1, F.col("c")).when(derived, F.col("d.c")).alias("concept"), derived.alias("derived"))


def arbitrary_values(classes: DataFrame) -> DataFrame:
    """(class, kind, value): a literal in brackets leaks; a bare custom property there is dropped by the build, so redundant."""
    base = s.peel(F.col("class"))
    value = F.trim(F.regexp_extract(base, r"^[a-z-]+-\[([^\]]*)\]$", 1))
    hit = base.rlike(r"^[a-z-]+-\[[^\]]*\]$") & ~value.startswith("var(")
    return classes.where(hit).select("class", F.when(value.startswith("--"), "redundant").otherwise("literal").alias("kind"), value.alias("value"))


def namespace_coverage(theme: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Each namespace of a repository's theme: covered by a prefix, making no utilities, or uncovered."""
    keys = run_keys(theme)
    known = prefixes.select("namespace").distinct().withColumn("_c", F.lit(True))
    out = theme.groupBy(*keys, "namespace").agg(F.count("*").alias("keys")).join(known, "namespace", "left")
    return out.select(*keys, "namespace", "keys", F.when(F.col("_c"), "covered").when(F.col("namespace").isin("default", "breakpoint"), "non-utility").otherwise("uncovered").alias("state"))


def contrast_pairs(tokens: DataFrame, pairs: DataFrame) -> DataFrame:
    """tokens (theme, name, value), pairs (fg, bg, minimum): the contrast of each pair in each theme that has both."""
    fg, bg = tokens.select("theme", F.col("name").alias("fg"), F.col("value").alias("_f")), tokens.select("theme", F.col("name").alias("bg"), F.col("value").alias("_b"))
    out = pairs.join(fg, "fg").join(bg, ["theme", "bg"]).withColumn("ratio", s.contrast(F.col("_f"), F.col("_b")))
    return out.select("theme", "fg", "bg", F.round("ratio", 4).alias("ratio"), (F.col("ratio") >= F.col("minimum")).alias("ok"))
