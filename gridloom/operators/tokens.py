"""Declarations to concepts, their conflicts, layers, families, lineage, and the naming and duplication measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions import scalars as s
from gridloom.functions import vocabulary as v
from gridloom.operators.ranks import ranked, run_keys
from gridloom.sources.staged import staged

REPO = ["repo_id"]


def source_role(decls: Column, roots: Column, has_root: Column, css: Column, path: Column, structured: Column, scss: Column, all_alias: Column, forced: Column, admitted: Column) -> Column:
    """A file's role from its counts: forced, empty, local to a component, structured, shaped like a source, or a candidate."""
    name = F.regexp_extract(path, "([^/]*)$", 1)
    named = name.rlike("(?i)(?:token|variable|definition|primitive|semantic|palette|color|typograph|font|spacing|layout|radius|theme)")
    local = path.contains("/components/") | path.contains("/component/")
    shaped = (named & (((decls >= 2) & scss) | (roots > 0))) | ((css >= 5) & has_root)
    return (
        F.when(forced, "canonical").when(decls == 0, "consumer").when(local & (decls < 20), "consumer-override").when(structured, F.when(admitted | named, "canonical").otherwise("candidate"))
        .when(shaped, F.when(all_alias, "alias").otherwise("canonical")).otherwise("candidate")
    )


def admit_siblings(sources: DataFrame) -> DataFrame:
    """sources (repo_id, path, role, role_if_admitted): modules beside a confirmed source in a directory named for tokens.

    One pass: what is admitted here vouches for nothing.
    """
    place = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    own = sources.withColumn("dir", place)
    confirmed = own.where(F.col("role").isin("canonical", "alias")).where(s.family_key(F.regexp_extract("dir", "([^/]*)$", 1)).isin(*v.TOKEN_DIRECTORIES)).select(*REPO, "dir").distinct().withColumn("_ok", F.lit(True))
    is_module = F.col("path").rlike(r"(?i)\.(?:js|jsx|ts|tsx|mjs|cjs)$")
    take = F.col("_ok").isNotNull() & is_module & ~F.col("role").isin("canonical", "alias") & F.col("role_if_admitted").isin("canonical", "alias")
    out = own.join(confirmed, [*REPO, "dir"], "left")
    return out.select(*sources.columns, F.when(take, F.col("role_if_admitted")).otherwise(F.col("role")).alias("final_role"), F.when(take, "sibling of a confirmed canonical source").otherwise("source filename").alias("admitted_by"))


def collapse_concepts(decls: DataFrame) -> DataFrame:
    """One row a concept: names, values, sites and representations in first-seen order, first known family, last alias.

    decls: repo_id, path, ord, line, name, value, representation, and alias_of (a concept id or null). Files come in path
    order and declarations in ord.
    """
    own = decls.withColumn("id", s.normalize(F.col("name"))).withColumn("family", s.family_for(F.col("name"), F.col("value")))
    seen = F.array_sort(F.collect_list(F.struct("path", "ord", "name", "value", "representation", F.concat_ws(":", "path", F.col("line").cast("string")).alias("site"), "family", "alias_of")))
    rows = own.groupBy(*REPO, "id").agg(seen.alias("_d"))
    pick = lambda c: F.transform("_d", lambda x: x[c])
    known = F.filter(pick("family"), lambda x: x != "unclassified")
    aliases = F.filter(pick("alias_of"), lambda x: x.isNotNull())
    return rows.select(
        *REPO, "id", F.array_distinct(pick("name")).alias("names"), F.array_distinct(pick("value")).alias("values"), pick("site").alias("sites"), F.array_distinct(pick("representation")).alias("representations"),
        F.coalesce(F.get(known, F.lit(0)), F.lit("unclassified")).alias("family"), F.when(F.size(aliases) > 0, F.element_at(aliases, -1)).alias("alias_of"), F.size("_d").alias("definitions"),
    )


def resolve_aliases(concepts: DataFrame) -> DataFrame:
    """alias_resolved: whether alias_of names a concept of the run; null without an alias."""
    known = concepts.select(*REPO, F.col("id").alias("alias_of"), F.lit(True).alias("_known")).distinct()
    return concepts.join(known, [*REPO, "alias_of"], "left").withColumn("alias_resolved", F.when(F.col("alias_of").isNotNull(), F.coalesce("_known", F.lit(False)))).drop("_known")


def conflicts(concepts: DataFrame) -> DataFrame:
    """Concepts with two values or more, by the shapes of the values."""
    values = F.filter("values", lambda x: x != "")
    shapes = F.array_sort(F.array_distinct(F.transform(values, s.value_shape)))
    kind = F.when(shapes == F.array(F.lit("alias")), "two aliases").when(shapes == F.array(F.lit("literal")), "two literals").otherwise("literal beside alias")
    return concepts.where(F.size(values) >= 2).select(*REPO, F.col("id").alias("token"), "family", kind.alias("kind"), F.size(values).alias("values"), "definitions")


def tiers(concepts: DataFrame) -> DataFrame:
    """The layer that the evidence supports: the name's own, disagreeing shapes, an alias, a concrete value, or none."""
    shapes = F.size(F.array_distinct(F.transform(F.filter("values", lambda x: x != ""), s.value_shape)))
    concrete = F.exists("values", lambda x: (x != "") & ~x.contains("var(") & ~x.startswith("$"))
    tier = F.coalesce(s.declared_tier(F.col("names")), F.when(shapes > 1, "untraced").when(F.col("alias_of").isNotNull(), "semantic").when(concrete, "primitive").otherwise("untraced"))
    return concepts.withColumn("tier", tier)


def lineage_totals(concepts: DataFrame) -> DataFrame:
    """Concepts by tier, and alias edges that resolve or don't; needs tier and alias_resolved."""
    count = lambda c: F.count(F.when(c, 1))
    return concepts.groupBy(*REPO).agg(*[count(F.col("tier") == t).alias(t) for t in v.TIERS], count(F.col("alias_resolved")).alias("resolved_alias_edges"), count(~F.col("alias_resolved")).alias("untraced_alias_edges"))


def family_states(concepts: DataFrame, hidden: DataFrame, families: list[str] = v.FAMILIES) -> DataFrame:
    """counted with a number, not-visible with null where only held-out or unreadable sources name the family, none-used with 0."""
    spark = concepts.sparkSession
    dim = spark.createDataFrame([(k, f) for k, f in enumerate(families)], "family_ord int, family string")
    repos = concepts.select(*REPO).union(hidden.select(*REPO)).distinct()
    counts = concepts.groupBy(*REPO, "family").agg(F.count("*").alias("n"))
    unseen = hidden.select(*REPO, "family").distinct().withColumn("_hidden", F.lit(True))
    out = repos.crossJoin(F.broadcast(dim)).join(counts, [*REPO, "family"], "left").join(unseen, [*REPO, "family"], "left")
    state = F.when(F.col("n").isNotNull(), "counted").when(F.col("_hidden"), "not-visible").otherwise("none-used")
    return out.select(*REPO, "family", state.alias("state"), F.when(state == "counted", F.col("n")).when(state == "none-used", F.lit(0)).cast("long").alias("count"))


def family_inventory(concepts: DataFrame) -> DataFrame:
    """Per family: concepts, sites, and concepts of each tier."""
    return concepts.groupBy(*REPO, "family").agg(F.count("*").alias("concepts"), F.sum(F.size("sites")).alias("sites"), *[F.count(F.when(F.col("tier") == t, 1)).alias(t) for t in v.TIERS])


def single_source(decls: DataFrame) -> DataFrame:
    """Per concept: definition sites, distinct values, and the grade that they give."""
    rows = decls.groupBy(*REPO, s.normalize(F.col("name")).alias("token")).agg(F.countDistinct("path").alias("sites"), F.countDistinct("value").alias("values"))
    return rows.withColumn("grade", F.when(F.col("sites") == 1, "healthy").when(F.col("values") == 1, "watch").otherwise("needs-work"))


def naming_grammars(decls: DataFrame) -> DataFrame:
    """Per representation, never across: each grammar of separators and case, its names and its first site."""
    leaf = F.regexp_replace(F.regexp_extract("name", r"([^.]*)$", 1), r"^[-$]+", "")
    grammar = (
        F.when(leaf.rlike("^[a-z0-9]+$"), "single-word").when(leaf.rlike("^[a-z0-9]+(?:-[a-z0-9]+)+$"), "kebab-case").when(leaf.rlike("^[a-z0-9]+(?:_[a-z0-9]+)+$"), "snake_case")
        .when(leaf.rlike("^[a-z][a-z0-9]*(?:[A-Z][a-z0-9]*)+$"), "camelCase").when(leaf.rlike("^[A-Z][a-zA-Z0-9]*$"), "PascalCase").otherwise("mixed")
    )
    return decls.groupBy(*REPO, "representation", grammar.alias("grammar")).agg(F.countDistinct("name").alias("names"), F.min(F.concat_ws(":", "path", F.lpad(F.col("line").cast("string"), 9, "0"))).alias("first_site"))


def duplicate_values(chains: DataFrame, edges: DataFrame) -> DataFrame:
    """Values that two names or more resolve to with no lineage edge between the names.

    chains: repo_id, token, root, root_value. A token whose root is another token of the group is linked to it and counts once,
    by its root.
    """
    heads = chains.join(edges.select(*REPO, F.col("src").alias("token")).distinct(), [*REPO, "token"], "left_anti")
    return heads.groupBy(*REPO, F.col("root_value").alias("value")).agg(F.countDistinct("token").alias("tokens"), F.min("token").alias("first_token"), F.max("token").alias("last_token")).where("tokens >= 2")


def ramps(concepts: DataFrame, least: int = 3) -> DataFrame:
    """Color names stem-number: stems of least steps or more are ramps; every color is in one or an outlier."""
    colors = concepts.where("family = 'color'").select(*REPO, "id", F.regexp_extract("id", r"^(.*)-(\d+)$", 1).alias("stem"), F.regexp_extract("id", r"^(.*)-(\d+)$", 2).alias("step"))
    stems = colors.where("stem <> ''").groupBy(*REPO, "stem").agg(F.countDistinct("step").alias("steps"))
    return colors.join(stems, [*REPO, "stem"], "left").select(*REPO, F.col("id").alias("token"), F.when(F.col("steps") >= least, F.col("stem")).alias("ramp"), F.when(F.col("steps") >= least, F.col("steps")).alias("steps"), (F.coalesce("steps", F.lit(0)) < least).alias("outlier"))


def identity_font(candidates: DataFrame) -> DataFrame:
    """candidates (repo_id, family, priority): the strongest, if it is one distinct family; else not-visible."""
    top = candidates.withColumn("_r", F.rank().over(Window.partitionBy(*REPO).orderBy(F.desc("priority")))).where("_r = 1")
    return top.groupBy(*REPO).agg(F.countDistinct("family").alias("n"), F.min("family").alias("f")).select(*REPO, F.when(F.col("n") == 1, "verified").otherwise("not-visible").alias("state"), F.when(F.col("n") == 1, F.col("f")).alias("family"))


#: Selectors that are a theme root by themselves: the document, a theme attribute, or a scheme class.
ROOT_SELECTOR = r"(?::root|html|\[data-theme[^\]]*\]|\.(?:dark|light|theme-[\w-]+))+"
#: A block that is a theme root: such selectors alone, a theme at-rule, or a query of the viewer's scheme.
THEME_ROOT = rf"(?i)^(?:{ROOT_SELECTOR}(?:\s*,\s*{ROOT_SELECTOR})*|@theme\b.*|@media\s*\(\s*prefers-[^)]*\))$"
#: Blocks that don't narrow what stands in them.
OPEN_BLOCK = r"(?i)^@(?:media|layer|supports|theme)\b.*$"
#: Properties that libraries write at run time.
INJECTED = r"^--(?:radix|swiper)-"


def in_theme_root(scopes: Column) -> Column:
    """Whether a declaration in these blocks is the project's: the innermost block is a theme root, and no outer one is a rule of something else."""
    inner = F.get(scopes, F.size(scopes) - 1)
    outer = F.slice(scopes, 1, F.greatest(F.size(scopes) - 1, F.lit(0)))
    return (F.size(scopes) > 0) & inner.rlike(THEME_ROOT) & F.forall(outer, lambda b: b.rlike(THEME_ROOT) | b.rlike(OPEN_BLOCK))


def theme_tokens(decls: DataFrame) -> DataFrame:
    """(keys, token, declarations, files, first_site): the distinct tokens that a project declares at its theme roots.

    decls: path, line, name, representation, scopes. Custom properties count at theme roots only, those that a library injects
    never; style variables count at the top of a file. One name at several roots, or as variable and property, is one token.
    """
    keys = run_keys(decls)
    own = F.when(F.col("representation") == "css-custom-property", in_theme_root(F.col("scopes")) & ~F.col("name").rlike(INJECTED)).otherwise(F.size("scopes") == 0)
    site = F.min(F.struct("path", "line"))
    rows = decls.where(own).groupBy(*keys, s.normalize(F.col("name")).alias("token")).agg(F.count("*").alias("declarations"), F.countDistinct("path").alias("files"), site.alias("_s"))
    return rows.select(*keys, "token", "declarations", "files", F.concat_ws(":", "_s.path", F.col("_s.line").cast("string")).alias("first_site"))


def scoped_properties(decls: DataFrame) -> DataFrame:
    """(keys, token): custom properties that no theme root declares, so they are local state and no tokens."""
    keys = run_keys(decls)
    mine = decls.where("representation = 'css-custom-property'").select(*keys, s.normalize(F.col("name")).alias("token")).distinct()
    return mine.join(theme_tokens(decls).select(*keys, "token"), [*keys, "token"], "left_anti")


#: Names of services whose colors a product shows without owning them.
THIRD_PARTY = ["adobe", "apple", "discord", "facebook", "github", "google", "instagram", "linkedin", "microsoft", "pinterest", "reddit", "slack", "snapchat", "spotify", "tiktok", "twitch", "twitter", "youtube"]
#: Segments of a color's name that belong to no one.
GENERIC_SEGMENTS = [
    "accent", "active", "app", "application", "base", "black", "blue", "brand", "color", "component", "content", "cool", "core", "dark", "danger", "data", "default", "design", "disabled", "error", "focus", "global", "gray", "green",
    "hover", "icon", "info", "inverse", "light", "logo", "muted", "orange", "pink", "primary", "product", "quarternary", "quaternary", "red", "secondary", "semantic", "site", "success", "surface", "system", "tertiary", "text", "theme",
    "ui", "viz", "visualization", "warm", "warning", "white", "yellow",
]
#: Words before "brand" in a heading that name no one.
NAMELESS = ["the", "our", "product", "application", "app", "site"]


def foreign_tokens(names: DataFrame, subjects: DataFrame) -> DataFrame:
    """(keys, token): names of which a segment belongs to someone else than the repository's subjects.

    names: token; subjects: namespace. The subjects' words make the vocabulary of a repository. Segments meet it by equality:
    a number, a generic segment or a word of the vocabulary is own, and any other makes its name foreign; so does a third
    party's name unless it is a subject itself.
    """
    keys = run_keys(names)
    segments = names.select(*keys, "token").distinct().select(*keys, "token", F.explode(F.array_distinct(F.split(s.family_key(F.col("token")), "-"))).alias("word"))
    words = subjects.select(*keys, F.explode(F.split(s.family_key(F.col("namespace")), "-")).alias("word")).distinct()
    own = F.col("word").rlike("^[0-9]+$") | F.col("word").isin(*GENERIC_SEGMENTS)
    unknown = segments.where(~own).join(words, [*keys, "word"], "left_anti")
    services = segments.where(F.col("word").isin(*THIRD_PARTY)).join(subjects.select(*keys, F.col("namespace").alias("word")).distinct(), [*keys, "word"], "left_anti")
    return unknown.select(*keys, "token").union(services.select(*keys, "token")).distinct()


def brand_context(labels: DataFrame, subjects: DataFrame) -> DataFrame:
    """(keys, token, label) of brand headings that vouch for a token: those of a design system or visual identity, or with a subject's word before "brand" that the token's name has too.

    labels: token, label; subjects: namespace.
    """
    keys = run_keys(labels)
    rows = labels.where("label is not null").select(*keys, "token", "label").distinct()
    general = rows.where(F.col("label").rlike(r"(?i)\b(?:design system|visual[ -]identity)\b"))
    before = F.lower(F.element_at(F.split("label", r"(?i)\bbrand\b", 2), 1))
    words = F.array_except(F.array_distinct(F.regexp_extract_all(before, F.lit("[a-z0-9]+"), 0)), F.array(*[F.lit(x) for x in NAMELESS]))
    each = rows.select(*keys, "token", "label", F.explode(words).alias("word"), F.split(s.family_key(F.col("token")), "-").alias("own"))
    vocabulary = subjects.select(*keys, F.explode(F.split(s.family_key(F.col("namespace")), "-")).alias("word")).distinct().withColumn("_subject", F.lit(True))
    named = each.join(vocabulary, [*keys, "word"], "left").groupBy(*keys, "token", "label").agg(F.bool_or(F.array_contains("own", F.col("word"))).alias("a"), F.bool_or(F.col("_subject").isNotNull()).alias("b")).where("a and b")
    return general.unionByName(named.select(*keys, "token", "label")).distinct()


def brand_colors(decls: DataFrame, subjects: DataFrame) -> DataFrame:
    """(keys, token, state, color, confidence, sites, rank): concrete colors that are the brand's by name or by heading.

    decls: path, line, name, value, and label (the brand heading above, or null) where there is one; subjects: namespace.
    Foreign and third-party names are out. A token qualifies by its own name, by its headings, or both, which is its
    confidence; of several values it is a conflict. Tokens named for the brand come first.
    """
    keys = run_keys(decls)
    label = F.col("label") if "label" in decls.columns else F.lit(None).cast("string")
    # What the rest reads several times is worked out once, of each spelling, in as many tasks as a shuffle has.
    spelled = decls.select(*keys, "name", "value", label.alias("label")).groupBy(*keys, "name", "value", "label").agg(F.count("*").alias("_sites"))
    made = spelled.select(*keys, s.normalize(F.col("name")).alias("token"), s.family_for(F.col("name"), F.col("value")).alias("family"), s.concrete_color_value(F.col("value")).alias("color"), "label", "_sites")
    own = staged(made).where("family = 'color'")
    own = own.join(foreign_tokens(own, subjects), [*keys, "token"], "left_anti")
    vouched = brand_context(own, subjects).withColumn("_vouched", F.lit(True))
    named = s.has_signal(s.family_key(F.col("token")), "brand")
    rows = own.where("color is not null").join(vouched, [*keys, "token", "label"], "left").withColumns({"_named": named, "_in": F.col("_vouched").isNotNull()}).where("_named or _in")
    value = s.normalize_literal(F.col("color"))
    out = rows.groupBy(*keys, "token").agg(F.countDistinct(value).alias("n"), F.min("color").alias("color"), F.bool_or("_named").alias("_named"), F.bool_or("_in").alias("_in"), F.sum("_sites").alias("sites"))
    confidence = F.when(F.col("_named") & F.col("_in"), "explicit-brand-name-and-source-section").when(F.col("_named"), "explicit-brand-token-name").otherwise("explicit-brand-source-section")
    found = out.select(*keys, "token", F.when(F.col("n") > 1, "conflict").otherwise("verified").alias("state"), F.when(F.col("n") == 1, F.col("color")).alias("color"), confidence.alias("confidence"), "sites", F.when(F.col("_named"), 0).otherwise(1).alias("_ord"))
    return ranked(found, ["_ord", "token"]).drop("_ord")


def held_out_families(decls: DataFrame, sources: DataFrame) -> DataFrame:
    """(keys, family, sources): families that only held-out sources may have: what candidates and local overrides name. sources: path, role."""
    keys = run_keys(decls)
    held = sources.where(F.col("role").isin("consumer-override", "candidate")).select(*keys, "path").distinct()
    own = decls.join(held, [*keys, "path"]).select(*keys, "path", s.family_for(F.col("name"), F.col("value")).alias("family"))
    return own.groupBy(*keys, "family").agg(F.countDistinct("path").alias("sources"))
