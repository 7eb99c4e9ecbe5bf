"""Which files count: ownership, roots, contexts, rewrites, applications and namespaces of a repository."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions import vocabulary as v
from gridloom.operators.extract import ORPHAN_EXCLUDED, not_excluded
from gridloom.operators.ranks import run_keys

REPO = ["repo_id"]
#: Rows of a rule table that are broadcast at once.
MOST_RULES = 10_000


def join_rules(left: DataFrame, rules: DataFrame, on: F.Column) -> DataFrame:
    """left joined with a table of rules by a test that is no equality.

    A broadcast side has MOST_RULES rows at most, a count that is checked. More rules are dealt into parts by hash, each
    of about half as many, and left is read once a part; the rows are the same.
    """
    count = rules.count()
    parts = 1 if count <= MOST_RULES else -(-2 * count // MOST_RULES)
    out = None
    for k in range(parts):
        some = rules if parts == 1 else rules.where(F.pmod(F.xxhash64(*rules.columns), F.lit(parts)) == k)
        met = left.join(F.broadcast(some), on)
        out = met if out is None else out.unionByName(met)
    return out


def glob_regex(pattern: str) -> str:
    """x/** covers the directory x, taken literally. Else * and ? stand for any characters, slashes too, [...] for one of a set, and a pattern also covers what lies below the path that it spells."""
    quote = lambda x: "".join(c if c.isalnum() or c in "/_-" else "\\" + c for c in x)
    if pattern.endswith("/**"):
        return f"^{quote(pattern[:-3].rstrip('/'))}(?:/.*)?$"
    out, i = "", 0
    while i < len(pattern):
        c, end = pattern[i], pattern.find("]", i + 2)
        if c == "[" and end > 0:
            body, negated = pattern[i + 1 : end], pattern[i + 1] == "!"
            out, i = out + ("[^" if negated else "[") + "".join("\\" + x if x in "\\[&^" else x for x in body[negated:]) + "]", end + 1
            continue
        out, i = out + (".*" if c == "*" else "." if c == "?" else quote(c)), i + 1
    return f"^(?:{out}|{quote(pattern.rstrip('/'))}/.*)$"


def matching(files: DataFrame, patterns: DataFrame) -> DataFrame:
    """files (path) by patterns (regex, ...) that they match; only paths are looked at."""
    return join_rules(files, patterns, F.regexp_like("path", F.col("regex")))


def ownership(files: DataFrame, patterns: DataFrame, default: str = "outside") -> DataFrame:
    """files with ownership owned where a pattern matches."""
    own = matching(files.select("path").distinct(), patterns.select("regex")).select("path").distinct().withColumn("_own", F.lit("owned"))
    # Patterns are the same for all repositories, so a path is owned in each or in none.
    return files.join(own, "path", "left").withColumn("ownership", F.coalesce("_own", F.lit(default))).drop("_own")


def _ancestors(path: str = "path") -> F.Column:
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def strongest_root(files: DataFrame, roots: DataFrame, ranks: list[str] = v.COMPONENT_RANK) -> DataFrame:
    """(keys, path, confidence) of the strongest root (prefix, confidence) of its repository that covers each path; null where none does.

    A path meets the roots as its own ancestors, so the join is an equality on the directory.
    """
    rank = F.array_position(F.array(*[F.lit(r) for r in ranks]), F.col("confidence"))
    keys = run_keys(roots)
    strongest = roots.groupBy(*keys, "prefix").agg(F.max(F.struct(rank.alias("r"), "confidence")).alias("m"))
    paths = files.select(*keys, "path").distinct()
    hit = paths.select(*keys, "path", F.explode(_ancestors()).alias("prefix")).join(strongest, [*keys, "prefix"])
    return paths.join(hit.groupBy(*keys, "path").agg(F.max("m").alias("m")), [*keys, "path"], "left").select(*keys, "path", "m.confidence")


def nearest_context(files: DataFrame, contexts: DataFrame) -> DataFrame:
    """(keys, path, prefix, context) of the most specific prefix (prefix, context) of its repository above each path."""
    keys = run_keys(contexts)
    hit = files.select(*keys, "path").distinct().select(*keys, "path", F.explode(_ancestors()).alias("prefix")).join(contexts, [*keys, "prefix"])
    return hit.groupBy(*keys, "path").agg(F.max_by(F.struct("prefix", "context"), F.length("prefix")).alias("m")).select(*keys, "path", "m.*")


def rewrite_aliases(specs: DataFrame, aliases: DataFrame) -> DataFrame:
    """(spec, rewritten): by the longest alias (pattern, target) that fits; a trailing * carries the rest over."""
    star = F.col("pattern").endswith("*")
    stem = F.regexp_replace("pattern", r"\*$", "")
    fits = (star & F.col("spec").startswith(stem)) | (F.col("spec") == F.col("pattern"))
    rest = F.expr("substring(spec, length(regexp_replace(pattern, '[*]$', '')) + 1)")
    made = F.when(star, F.concat(F.regexp_replace("target", r"\*$", ""), rest)).otherwise(F.col("target"))
    hit = join_rules(specs.select("spec").distinct(), aliases, fits).groupBy("spec").agg(F.max_by(made, F.struct(F.length("pattern"), "pattern")).alias("r"))
    return specs.select("spec").distinct().join(hit, "spec", "left").select("spec", F.coalesce("r", "spec").alias("rewritten"))


def rewrite_profiles(specs: DataFrame, rewrites: DataFrame) -> DataFrame:
    """(spec, rewritten, ambiguous) by prefix rewrites (prefix, target): two destinations or more block the resolution."""
    hit = join_rules(specs.select("spec").distinct(), rewrites, F.col("spec").startswith(F.col("prefix"))).select("spec", F.concat("target", F.expr("substring(spec, length(prefix) + 1)")).alias("d")).distinct()
    rows = hit.groupBy("spec").agg(F.count("*").alias("n"), F.min("d").alias("d"))
    return rows.select("spec", F.when(F.col("n") == 1, F.col("d")).alias("rewritten"), (F.col("n") > 1).alias("ambiguous"))


def seed_roots(roots: DataFrame) -> DataFrame:
    """Roots that exist, are of the product, and are more than a static candidate."""
    return roots.where(F.col("exists") & (F.col("scope") == "product") & F.col("confidence").isin(*v.ROOT_RANK[2:]))


def capability_verdicts(roots: DataFrame, edges: DataFrame, unresolved: DataFrame) -> DataFrame:
    """(repo_id, capability, state): roots by seeds, resolution by edges without actionable misses."""
    count = lambda df, name: df.groupBy(*REPO).agg(F.count("*").alias(name))
    out = roots.select(*REPO).union(edges.select(*REPO)).distinct()
    for df, name in ((seed_roots(roots), "s"), (edges, "e"), (unresolved.where(F.col("reason").isin(*v.ACTIONABLE_REASONS)), "m")):
        out = out.join(count(df, name), REPO, "left")
    state = lambda test: F.when(F.coalesce(test, F.lit(False)), "verified").otherwise("not-visible")
    cells = F.array(F.struct(F.lit("production_roots").alias("capability"), state(F.col("s") > 0).alias("state")), F.struct(F.lit("import_resolution").alias("capability"), state((F.col("e") > 0) & F.col("m").isNull()).alias("state")))
    return out.select(*REPO, F.explode(cells).alias("c")).select(*REPO, "c.*")


def capability_states(repos: DataFrame, profiles: DataFrame, roots: DataFrame, reached: DataFrame, unresolved: DataFrame) -> DataFrame:
    """(keys, capability, state) of all seven capabilities for each repository of repos.

    profiles: profile, part; roots: path, exists, scope, confidence, ownership; reached: node; unresolved: reason. Detection needs
    an active profile; production roots a seed and no registered root that is missing; import resolution a reached file and no
    miss that a person can act on; ownership an owned seed. The other three take later evidence.
    """
    keys = run_keys(repos)
    seeds = seed_roots(roots)
    tests = [
        ("a", profiles.where("part = 'active'")), ("s", seeds), ("m", roots.where(~F.coalesce(F.col("exists"), F.lit(False)))), ("r", reached), ("u", unresolved.where(F.col("reason").isin(*v.ACTIONABLE_REASONS))), ("o", seeds.where("ownership = 'owned'")),
    ]
    out = repos.select(*keys).distinct()
    for name, df in tests:
        out = out.join(df.select(*keys).distinct().withColumn(name, F.lit(True)), keys, "left")
    has = lambda c: F.coalesce(F.col(c), F.lit(False))
    proofs = {"detection": has("a"), "production_roots": has("s") & ~has("m"), "import_resolution": has("r") & ~has("u"), "ownership": has("o")}
    cells = [F.struct(F.lit(c).alias("capability"), F.when(proofs.get(c, F.lit(False)), "verified").otherwise("not-visible").alias("state")) for c in v.CAPABILITIES]
    return out.select(*keys, F.explode(F.array(*cells)).alias("c")).select(*keys, "c.*")


def orphan_candidates(files: DataFrame, patterns: DataFrame | None = None) -> DataFrame:
    """Files (path) that may be orphans: none of a test, fixture or generated path, and inside the owned patterns (regex) where there are any."""
    own = files.where(not_excluded(F.col("path"), ORPHAN_EXCLUDED))
    if patterns is None:
        return own
    return own.join(matching(own.select("path").distinct(), patterns.select("regex")).select("path").distinct(), "path", "left_semi")


def applications(candidates: DataFrame) -> DataFrame:
    """(repo_id, state, dir): one candidate directory is selected; several leave the choice to a person. candidates: repo_id, dir."""
    rows = candidates.groupBy(*REPO).agg(F.countDistinct("dir").alias("n"), F.min("dir").alias("d"))
    return rows.select(*REPO, F.when(F.col("n") == 1, "selected").otherwise("not-visible").alias("state"), F.when(F.col("n") == 1, F.col("d")).alias("dir"))


def namespaces(dirs: DataFrame, least: int = 3) -> DataFrame:
    """(repo_id, prefix, dirs): first hyphen segments that least directories or more share. dirs: repo_id, name."""
    prefix = F.split_part("name", F.lit("-"), F.lit(1))
    return dirs.where(F.col("name").contains("-")).groupBy(*REPO, prefix.alias("prefix")).agg(F.countDistinct("name").alias("dirs")).where(F.col("dirs") >= least)


def without_exemptions(literals: DataFrame, exemptions: DataFrame) -> DataFrame:
    """Literals without hairlines, and without exceptions (repo_id, path, literal) that have an owner and a review date."""
    valid = exemptions.where("owner is not null and review_by is not null").select(*REPO, "path", "literal")
    return literals.where("literal <> '1px'").join(valid, [*REPO, "path", "literal"], "left_anti")
