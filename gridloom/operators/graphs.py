"""Iterated joins: reachability, alias chains, blast radius, orphans. Each round is written to the shared folder."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions import vocabulary as v
from gridloom.operators.ranks import ranked, run_keys
from gridloom.sources.staged import staged

#: After so many rounds the parts of a growing result are written as one table, so that plans stay small at any depth.
FOLD = 16
#: Hops of a round where no chains are kept.
HOPS = 4


def _stays(edges: DataFrame, keys: list[str], terminal: DataFrame | None) -> DataFrame:
    """(keys, src, dst, cost): the distinct edges that may be followed, and for every node that is reached one of cost 0 to itself.

    By that one a node of any hop is among the rows of the last one, so that several hops are a plain chain of joins.
    """
    step = edges.select(*keys, "src", "dst").where("src <> dst").distinct()
    open_step = step if terminal is None else step.join(terminal.select(*keys, F.col("node").alias("src")), [*keys, "src"], "left_anti")
    loops = step.select(*keys, F.col("dst").alias("src"), "dst").distinct()
    return open_step.withColumn("cost", F.lit(1)).unionByName(loops.withColumn("cost", F.lit(0)))


def closure(edges: DataFrame, seeds: DataFrame, terminal: DataFrame | None = None) -> DataFrame:
    """(keys, node): the nodes of reachable, where depths and chains are not asked for. A round goes HOPS hops."""
    keys = run_keys(edges)
    step = staged(_stays(edges, keys, terminal).drop("cost"))
    visited = frontier = staged(seeds.select(*keys, "node").distinct())
    for k in count(1):
        new = frontier
        for _ in range(HOPS):
            new = new.withColumnRenamed("node", "src").join(step, [*keys, "src"]).select(*keys, F.col("dst").alias("node")).distinct().join(visited, [*keys, "node"], "left_anti")
        frontier = staged(new)
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
        visited = staged(visited) if k % HOPS == 0 else visited
    return visited


def reachable(edges: DataFrame, seeds: DataFrame, terminal: DataFrame | None = None) -> DataFrame:
    """(keys, node, depth, via): the least number of hops from a seed of the same repository, and of the chains of that length the smallest.

    edges: src, dst; seeds: node; terminal: node; each with repo_id and run_id where it is kept by them. Nodes of terminal are
    reached and not followed. A round keeps one row a new node before the next begins; loops of the graph end as visited
    nodes are left out. Rounds go on until none is new, at any depth.
    """
    keys = run_keys(edges)
    step = staged(edges.select(*keys, "src", "dst").where("src <> dst").distinct())
    frontier = staged(seeds.select(*keys, "node").distinct().select(*keys, "node", F.lit(0).alias("depth"), F.array("node").alias("via")))
    visited = frontier
    for depth in count(1):
        open_nodes = frontier if terminal is None else frontier.join(terminal.select(*keys, "node"), [*keys, "node"], "left_anti")
        new = open_nodes.withColumnRenamed("node", "src").join(step, [*keys, "src"]).select(*keys, F.col("dst").alias("node"), F.concat("via", F.array("dst")).alias("via"))
        new = new.groupBy(*keys, "node").agg(F.min("via").alias("via")).join(visited.select(*keys, "node"), [*keys, "node"], "left_anti")
        frontier = staged(new.select(*keys, "node", F.lit(depth).alias("depth"), "via"))
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
        visited = staged(visited) if depth % FOLD == 0 else visited
    return visited


def missing_entries(seeds: DataFrame, files: DataFrame) -> DataFrame:
    """Seeds (node) that no file (node) is: reported as `entry point does not exist`, not dropped."""
    keys = run_keys(seeds)
    return seeds.select(*keys, "node").distinct().join(files.select(*keys, "node"), [*keys, "node"], "left_anti").withColumn("reason", F.lit(v.UNRESOLVED_REASONS[0]))


def two_walks(edges: DataFrame, roots: DataFrame, terminal: DataFrame | None = None) -> DataFrame:
    """(keys, node, product_depth, owned_depth): hops from the product's roots, and from its owned roots alone; null where not reached.

    roots: path, exists, scope, confidence, ownership. Both walks are one: a row is a node with a label. Labels product start
    at existing roots of the product that are more than a static candidate. Owned roots among them bear both labels. A static
    candidate counts as a root once the first label reaches it, so where it is owned it begins the second one then. A node
    is visited again if a label comes by a shorter way, as late roots may be nearer. A round goes HOPS hops.
    """
    keys = run_keys(edges)
    step = staged(_stays(edges, keys, terminal))
    own = roots.where(F.col("exists") & (F.col("scope") == "product")).select(*keys, F.col("path").alias("node"), "confidence", "ownership")
    seeds = own.where(F.col("confidence").isin(*v.ROOT_RANK[2:]))
    promotable = own.where((F.col("confidence") == "static candidate") & (F.col("ownership") == "owned")).select(*keys, "node").distinct()
    promotable = staged(promotable)
    zero = F.lit(0).alias("depth")
    first = seeds.select(*keys, "node", F.lit("product").alias("label"), zero).union(seeds.where("ownership = 'owned'").select(*keys, "node", F.lit("owned"), zero)).distinct()
    visited = frontier = staged(first)
    for k in count(1):
        promoted = frontier.where("label = 'product'").join(promotable, [*keys, "node"], "left_semi").select(*keys, "node", F.lit("owned").alias("label"), zero)
        moved = frontier
        for _ in range(HOPS):
            moved = moved.withColumnRenamed("node", "src").join(step, [*keys, "src"]).groupBy(*keys, F.col("dst").alias("node"), "label").agg(F.min(F.col("depth") + F.col("cost")).alias("depth"))
        # One aggregate over what is known and what is new: a row that was known keeps its depth in _old.
        both = visited.withColumn("_old", F.col("depth")).unionByName(moved.union(promoted).withColumn("_old", F.lit(None).cast("int")))
        now = both.groupBy(*keys, "node", "label").agg(F.min("depth").alias("depth"), F.min("_old").alias("_old"))
        frontier = staged(now.where("_old is null or depth < _old").drop("_old"))
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
        visited = staged(visited.groupBy(*keys, "node", "label").agg(F.min("depth").alias("depth"))) if k % FOLD == 0 else visited
    depth = lambda label: F.min(F.when(F.col("label") == label, F.col("depth"))).alias(f"{label}_depth")
    return visited.groupBy(*keys, "node").agg(depth("product"), depth("owned"))


def supplemental_surfaces(surfaces: DataFrame, walked: DataFrame) -> DataFrame:
    """Surface roots (path) that the walk of the product did not reach."""
    keys = run_keys(surfaces)
    return surfaces.join(walked.where("product_depth is not null").select(*keys, F.col("node").alias("path")), [*keys, "path"], "left_anti")


def orphan_files(files: DataFrame, reached: DataFrame) -> DataFrame:
    """Files (node) that were not reached in their repository."""
    keys = run_keys(files)
    return files.join(reached.select(*keys, "node"), [*keys, "node"], "left_anti")


def orphan_tokens(concepts: DataFrame, refs: DataFrame) -> DataFrame:
    """Defined and never referenced in their repository, by token."""
    keys = run_keys(concepts)
    return concepts.join(refs.select(*keys, "token").distinct(), [*keys, "token"], "left_anti")


def orphan_scope(orphans: DataFrame, prefixes: DataFrame) -> DataFrame:
    """orphans (path) inside or outside the owned prefixes (prefix) of their repository; one without prefixes owns all of its own.

    A path meets the prefixes as its own ancestor directories, so the join is an equality.
    """
    keys = run_keys(orphans)
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    held = prefixes.select(*keys, "prefix").distinct()
    owned = orphans.select(*keys, "path", F.explode(above).alias("prefix")).join(held, [*keys, "prefix"]).select(*keys, "path").distinct().withColumn("_in", F.lit(True))
    some = held.groupBy(*keys).agg(F.lit(True).alias("_some")).where("_some")
    known = orphans.join(owned, [*keys, "path"], "left")
    # Without keys, `some` is one row or none.
    known = known.join(some, keys, "left") if keys else known.withColumn("_some", F.lit(None if held.isEmpty() else True).cast("boolean"))
    return known.select(*orphans.columns, F.when(F.col("_some").isNull() | F.col("_in"), "owned").otherwise("outside").alias("scope"))


def alias_chains(concepts: DataFrame) -> DataFrame:
    """(keys, token, hops, length, complete, stops_at, note) for concepts (token, tier, alias_of), each with one alias at most.

    A chain ends at a concept without an alias, before one that is not there, or where it comes to itself again; it is
    complete if it ends at a primitive. Pointers double: a round appends to every open chain the chain of the concept that
    it has come to, so n hops take about log2(n) rounds. Chains into a loop are cut at the first concept that comes again.
    """
    keys = run_keys(concepts)
    # next: the concept that follows the last hop; null once the chain has ended.
    now = staged(concepts.select(*keys, "token", F.array("token").alias("hops"), F.col("alias_of").alias("next"), (F.col("alias_of").isNull() & (F.col("tier") == "primitive")).alias("complete"), F.lit(None).cast(concepts.schema["token"].dataType).alias("stops_at"), F.lit(None).cast("string").alias("note")))
    while not now.where("next is not null").isEmpty():
        far = now.select(*keys, F.col("token").alias("next"), F.col("hops").alias("_hops"), F.col("next").alias("_next"), F.col("complete").alias("_complete"), F.col("stops_at").alias("_stops"), F.col("note").alias("_note"))
        still = now.where("next is not null").join(far, [*keys, "next"], "left")
        both = still.withColumn("_all", F.concat("hops", F.coalesce("_hops", F.array().cast(now.schema["hops"].dataType))))
        # The place, from 0, of the first hop that stands before itself.
        again = F.when(F.size(F.array_distinct("_all")) < F.size("_all"), F.size("hops") + F.array_position(F.transform("_hops", lambda x: F.array_contains("hops", x)), True).cast("int") - 1)
        both = both.withColumn("_cut", again)
        # Repeats between the two parts come first; neither part repeats within itself.
        lost, cut = F.col("_hops").isNull(), F.col("_cut").isNotNull()
        step = both.select(
            *keys, "token", F.when(cut, F.slice("_all", F.lit(1), F.col("_cut"))).otherwise(F.col("_all")).alias("hops"), F.when(lost | cut, None).otherwise(F.col("_next")).alias("next"),
            F.when(lost | cut, False).otherwise(F.col("_complete")).alias("complete"), F.when(lost, F.col("next")).when(cut, F.get("_all", F.col("_cut"))).otherwise(F.col("_stops")).alias("stops_at"),
            F.when(lost, "not found").when(cut, "cycle").otherwise(F.col("_note")).alias("note"),
        )
        now = staged(now.where("next is null").unionByName(step))
    return now.select(*keys, "token", "hops", F.size("hops").alias("length"), F.coalesce("complete", F.lit(False)).alias("complete"), "stops_at", "note")


def blast_radius(concepts: DataFrame, uses: DataFrame) -> DataFrame:
    """(keys, token, dependents, component_count): all tokens that alias it, at any distance, and the components that use any of those.

    concepts: token, alias_of; uses: token, component. A token's own users don't count, nor does the token itself in a loop.
    A token's dependents are those whose chains pass it, so the chains of alias_chains are turned around.
    """
    keys = run_keys(concepts)
    chains = alias_chains(concepts.select(*keys, "token", F.lit("").alias("tier"), "alias_of").distinct())
    reached = staged(chains.select(*keys, F.col("token").alias("dependent"), F.explode("hops").alias("token")).where("token <> dependent").distinct())
    counts = reached.groupBy(*keys, "token").agg(F.count("*").alias("dependents"))
    spent = reached.join(uses.select(*keys, F.col("token").alias("dependent"), "component").distinct(), [*keys, "dependent"]).groupBy(*keys, "token").agg(F.countDistinct("component").alias("component_count"))
    out = concepts.select(*keys, "token").distinct().join(counts, [*keys, "token"], "left").join(spent, [*keys, "token"], "left")
    return out.select(*keys, "token", F.coalesce("dependents", F.lit(0)).alias("dependents"), F.coalesce("component_count", F.lit(0)).alias("component_count"))


def chain_order(chains: DataFrame, uses: DataFrame) -> DataFrame:
    """Chains with the number of their tokens' consumers and a rank: consumers, then token. uses: token, component."""
    keys = run_keys(chains)
    consumers = uses.groupBy(*keys, "token").agg(F.countDistinct("component").alias("consumers"))
    out = chains.join(consumers, [*keys, "token"], "left").withColumn("consumers", F.coalesce("consumers", F.lit(0)))
    return ranked(out, [F.desc("consumers"), "token"])


def radius_order(radius: DataFrame) -> DataFrame:
    """Rows of blast_radius with a rank: components, dependents, then token."""
    return ranked(radius, [F.desc("component_count"), F.desc("dependents"), "token"])


def traceable_families(chains: DataFrame) -> DataFrame:
    """Families of which every token is complete; chains: family, complete."""
    return chains.where("family is not null").groupBy("family").agg(F.count("*").alias("tokens"), F.bool_and("complete").alias("all_complete")).where("all_complete").select("family", "tokens")


def lineage_summary(chains: DataFrame, uses: DataFrame) -> DataFrame:
    own = chains.join(uses.select("token").distinct().withColumn("_used", F.lit(True)), "token", "left")
    number = lambda c: F.count(F.when(c, 1))
    return own.agg(number(F.col("complete")).alias("traced"), number(~F.col("complete")).alias("stopped"), number(F.col("_used")).alias("with_consumer"), F.coalesce(F.max("length"), F.lit(0)).alias("longest"))


def entry_ranks(edges: DataFrame) -> DataFrame:
    """Fallback roots: each file's importers and imports, ranked: few importers first, then many imports, then the name."""
    keys = run_keys(edges)
    both = edges.select(*keys, F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(edges.select(*keys, "dst", F.lit(0), F.lit(1)))
    return ranked(both.groupBy(*keys, "node").agg(F.sum("i").alias("inbound"), F.sum("o").alias("outbound")), ["inbound", F.desc("outbound"), "node"])
