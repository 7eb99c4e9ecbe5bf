"""Merkle manifest of a dataset: aligned blocks hash their subtrees, then swap roots butterfly-wise, so that each gets its own upper proof."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.common import drop_staged, stage, table

#: Children of a node, and levels of the tree below a block's root.
FANOUT, BLOCK_LEVELS = 2, 10
#: Columns that a leaf covers, in this order.
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
STEPS = "array<struct<before:string,after:string>>"


def hashed(text: Column) -> Column:
    """Lowercase hex SHA-256 of UTF-8 bytes."""
    return F.sha2(text.cast("binary"), 256)


def leaf_digest(*values: Column) -> Column:
    """H of the values one after another: null as `-`, else the UTF-8 byte count, a colon and the value."""
    own = [v.cast("string") for v in values]
    return hashed(F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in own]))


def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(steps, leaf, lambda h, s: hashed(F.concat(s["before"], h, s["after"])))


def siblings(steps: Column) -> Column:
    """All siblings of a proof, level by level, left to right."""
    return F.array_join(F.transform(steps, lambda s: F.concat(s["before"], s["after"])), "")


def ranked(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows with pos, its place from 0 in its group's order, and size, the group's rows; written and read again.

    Rows are range-partitioned by group and order, so a large group spreads over many tasks; counts a partition and group,
    as many as both together at most, give each partition's first place. group must not be null.
    """
    placed = stage(rows.orderBy(group, *order).withColumn("_at", F.monotonically_increasing_id()), "ranked")
    counts = placed.groupBy(F.shiftright("_at", 33).alias("_part"), group).agg(F.count("*").alias("_n"), F.min("_at").alias("_least"))
    own = Window.partitionBy(group)
    before = F.coalesce(F.sum("_n").over(own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = stage(counts.select("_part", group, (before - F.col("_least")).alias("_shift"), F.sum("_n").over(own).alias("size")), "firsts")
    return placed.withColumn("_part", F.shiftright("_at", 33)).join(firsts, ["_part", group]).withColumn("pos", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def depth(size: Column, fanout: int) -> Column:
    """Levels above the leaves of a tree of so many leaves."""
    powers = [fanout**k for k in range(63) if fanout**k < 2**63]
    return F.size(F.filter(F.array(*[F.lit(p).cast("long") for p in powers]), lambda p: p < size))


def block_trees(nodes: DataFrame, fanout: int, levels: int) -> DataFrame:
    """(group, block, size, rows, tree): each aligned run of fanout ** levels nodes of a group (group, pos, size, hash, row) as one row.

    rows are its nodes' row in order, tree its levels of hashes, lowest first, up to the block's root.
    """
    width = fanout**levels
    blocks = nodes.groupBy("group", F.floor(F.col("pos") / width).cast("long").alias("block")).agg(F.first("size").alias("size"), F.array_sort(F.collect_list(F.struct("pos", "hash", "row"))).alias("of"))
    up = lambda level: F.transform(F.sequence(F.lit(0), F.floor((F.size(level) - 1) / fanout).cast("int")), lambda i: hashed(F.array_join(F.slice(level, i * fanout + 1, fanout), "")))
    climb = F.least(F.lit(levels), depth(F.col("size"), fanout))
    rungs = F.when(climb > 0, F.sequence(F.lit(1), climb)).otherwise(F.array().cast("array<int>"))
    tree = F.aggregate(rungs, F.array(F.col("of.hash")), lambda acc, _: F.concat(acc, F.array(up(F.element_at(acc, -1)))))
    return blocks.select("group", "block", "size", F.col("of.row").alias("rows"), tree.alias("tree"))


def butterfly(blocks: DataFrame, fanout: int, levels: int) -> DataFrame:
    """(group, block, root, steps): the root of each group's tree and the proof from a block's root up to it, for all blocks (group, block, size, hash).

    In round r, blocks that differ in digit r of their number alone (in base fanout) make an aligned group of fanout; each
    holds the root of its subtree of fanout ** r blocks. They swap these, and every one of them hashes the parent and notes its
    siblings. So after as many rounds as there are levels each block has its whole proof, and nothing is sent down. A tree that
    isn't full is filled up with empty blocks: they carry nothing until a neighbour's root reaches them and then pass it on, so
    no block is asked by more than fanout - 1 others. There are fewer than fanout times as many as real ones.
    """
    rounds = F.greatest(F.lit(0), depth(F.col("size"), fanout) - levels)
    now = blocks.select("group", "block", rounds.alias("rounds"), "hash", F.array().cast(STEPS).alias("steps"))
    most = now.agg(F.max("rounds")).first()[0] or 0
    if most:
        last = now.groupBy("group").agg(F.max("block").alias("last"), F.max("rounds").alias("rounds")).where("rounds > 0")
        filled = last.withColumn("to", F.pow(F.lit(fanout), F.col("rounds")).cast("long") - 1).where("last < to")
        empty = filled.select("group", F.explode(F.sequence(F.col("last") + 1, F.col("to"))).alias("block"), "rounds", F.lit(None).cast("string").alias("hash"), F.array().cast(STEPS).alias("steps"))
        now = now.unionByName(empty)
    for r in range(most):
        stride = fanout**r
        digit = (F.floor(F.col("block") / stride) % fanout).alias("digit")
        partners = Window.partitionBy("group", F.floor(F.col("block") / (stride * fanout)), F.col("block") % stride)
        swapped = now.withColumn("run", F.array_sort(F.collect_list(F.struct(digit, "hash")).over(partners))).withColumn("digit", digit)
        text = lambda keep: F.array_join(F.transform(F.filter("run", lambda x: keep(x["digit"]) & x["hash"].isNotNull()), lambda x: x["hash"]), "")
        before, after, whole = text(lambda d: d < F.col("digit")), text(lambda d: d > F.col("digit")), text(lambda d: d.isNotNull())
        going = F.col("rounds") > r
        step = F.array(F.struct(before.alias("before"), after.alias("after")))
        now = swapped.select(
            "group", "block", "rounds", F.when(going, F.when(F.length(whole) > 0, hashed(whole))).otherwise(F.col("hash")).alias("hash"),
            F.when(going, F.concat("steps", step)).otherwise(F.col("steps")).alias("steps"),
        )
        if r % 8 == 7:  # a plan of many rounds is cut
            then, now = now, stage(now, "butterfly")
            if r > 8:
                drop_staged(then_staged)
            then_staged = now
    return now.select("group", "block", F.col("hash").alias("root"), "steps")


def merkle_trees(nodes: DataFrame, order: list[str], fanout: int = FANOUT, levels: int = BLOCK_LEVELS) -> DataFrame:
    """(group, row, hash, root, steps) for nodes (group, hash, row and the columns of order): each group's tree over its nodes in that order.

    Runs of fanout nodes become one, the last run of a level has fewer; a group of one node is its own root. steps is the
    node's proof: for each level, the siblings before and after it. group is not null.
    """
    placed = ranked(nodes, "group", order)
    trees = stage(block_trees(placed, fanout, levels), "blocks")
    upper = butterfly(trees.select("group", "block", "size", F.element_at("tree", -1)[0].alias("hash")), fanout, levels)
    # The padding blocks drop out here.
    both = trees.join(upper, ["group", "block"])

    def step(level: Column, at: Column) -> Column:
        start = F.floor(at / fanout).cast("int") * fanout
        cut = lambda a, n: F.array_join(F.slice(level, a + 1, n), "")
        return F.struct(cut(start, at - start).alias("before"), cut(at + 1, start + fanout - at - 1).alias("after"))

    # A block's rows are made as one array before they are exploded: else each of them would carry the whole tree.
    below = F.slice("tree", 1, F.size("tree") - 1)
    local = lambda i: F.transform(below, lambda level, k: step(level, F.floor(i / F.pow(F.lit(float(fanout)), k)).cast("int")))
    nodes = F.transform("rows", lambda row, i: F.struct(row.alias("row"), F.element_at(F.element_at("tree", 1), i + 1).alias("hash"), local(i).alias("local")))
    own = both.select("group", "root", "steps", nodes.alias("nodes")).select("group", "root", "steps", F.explode("nodes").alias("node"))
    return own.select("group", F.col("node.row").alias("row"), F.col("node.hash").alias("hash"), "root", F.concat("node.local", "steps").alias("steps"))


def merkle_manifest(docs: DataFrame, group: str = "lang", order: str = "doc_id", columns: tuple[str, ...] = LEAF_COLUMNS, carry: dict[str, Column] | None = None, fanout: int = FANOUT, levels: int = BLOCK_LEVELS) -> DataFrame:
    """(doc_id, leaf, subroot, root, steps and the columns of carry): one row per row of docs, with its proof up to the root of all.

    A leaf is the digest of columns; leaves of equal `group` ascend by `order` (nulls first, ties by digest) and make a tree; the
    trees' roots, by group with null first and else by UTF-8 bytes, make another. Any column may be null; repeated rows are
    leaves of their own; long texts are hashed whole, once; an empty table gives no rows and has no root. docs may have other
    columns of any names; carry computes further columns from a row of docs.
    """
    # Groups in the order of their names: none before all others.
    key = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    carried = F.struct(F.col(order).alias("doc_id"), *[c.alias(name) for name, c in (carry or {}).items()])
    leaves = stage(docs.select(key.alias("group"), leaf_digest(*[F.col(c) for c in columns]).alias("hash"), F.col(order).alias("by"), carried.alias("row")), "leaves")
    trees = stage(merkle_trees(leaves, ["by", "hash"], fanout, levels), "trees")
    drop_staged(leaves)
    # first_value by partial aggregation: one row a group, however many leaves it has.
    tops = trees.groupBy("group").agg(F.first("root").alias("hash")).select(F.lit("").alias("all"), F.col("group").alias("name"), "hash")
    top = merkle_trees(tops.select(F.col("all").alias("group"), "hash", "name", F.struct("name").alias("row")), ["name"], fanout, levels)
    top = stage(top.select(F.col("row.name").alias("group"), F.col("root").alias("whole"), F.col("steps").alias("upper")), "subroots")
    return trees.join(top, "group").select(F.col("row.doc_id").alias("doc_id"), F.col("hash").alias("leaf"), F.col("root").alias("subroot"), F.col("whole").alias("root"), F.concat("steps", "upper").alias("steps"), *[F.col(f"row.`{name}`").alias(name) for name in carry or {}])


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest of documents; each seventh id's hash marks a row whose n_chars is one more when its proof is folded."""
    docs = table(spark, sf_dir, "documents")
    tampered = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & F.col("n_chars").isNotNull()
    other = F.when(tampered, leaf_digest(*[F.col(c) + 1 if c == "n_chars" else F.col(c) for c in LEAF_COLUMNS]))
    out = merkle_manifest(docs, carry={"_tampered": other})
    back = folded(F.coalesce("_tampered", "leaf"), F.col("steps"))
    rows = out.select("doc_id", "leaf", "subroot", "root", hashed(siblings(F.col("steps"))).alias("proof_sha256"), back.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


QUERIES = {"op13_merkle_manifest": op13_merkle_manifest}
ORACLE = {
    "op13_merkle_manifest": """
    WITH RECURSIVE
    d AS (SELECT *, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
        lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda e, _: xor(e >> 1, 3988292384 * (e & 1)))) AS crc FROM documents),
    p AS (SELECT doc_id, lang, n_chars, coalesce(xor(crc, 4294967295) % 7 = 0, false) AS hit,
        coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-') || coalesce(octet_length(encode(lang)) || ':' || lang, '-') AS a,
        coalesce(octet_length(encode(text)) || ':' || text, '-') AS z FROM d),
    l AS (SELECT *, sha256(a || coalesce(octet_length(encode(n_chars::VARCHAR)) || ':' || n_chars, '-') || z) AS leaf,
        sha256(a || coalesce(octet_length(encode((n_chars + 1)::VARCHAR)) || ':' || (n_chars + 1), '-') || z) AS other FROM p),
    r AS (SELECT doc_id, coalesce('=' || lang, '') AS g, leaf, CASE WHEN hit THEN other ELSE leaf END AS own, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM l),
    n AS (SELECT 0 AS lv, g, pos, leaf AS h FROM r
        UNION ALL SELECT lv + 1, g, pos // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM (SELECT *, count(*) OVER (PARTITION BY g) AS c FROM n) WHERE c > 1 GROUP BY lv, g, pos // 2),
    s AS (SELECT g, max(lv) AS top, arg_max(h, lv) AS subroot FROM n GROUP BY g),
    t AS (SELECT 0 AS lv, row_number() OVER (ORDER BY g) - 1 AS pos, subroot AS h FROM s
        UNION ALL SELECT lv + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM (SELECT *, count(*) OVER () AS c FROM t) WHERE c > 1 GROUP BY lv, pos // 2),
    w AS (SELECT max(lv) AS top, arg_max(h, lv) AS root FROM t),
    k AS (SELECT s.g, s.top, s.subroot, row_number() OVER (ORDER BY s.g) - 1 AS gpos FROM s),
    -- Levels of a leaf's proof, those of its own tree first.
    q AS (SELECT r.g, r.pos, x.i, n.h AS sib, n.pos > r.pos >> x.i AS after FROM r JOIN k USING (g), range(k.top) x(i) LEFT JOIN n ON n.g = r.g AND n.lv = x.i AND n.pos = xor(r.pos >> x.i, 1)
        UNION ALL SELECT r.g, r.pos, k.top + y.i, t.h, t.pos > k.gpos >> y.i FROM r JOIN k USING (g), w, range(w.top) y(i) LEFT JOIN t ON t.lv = y.i AND t.pos = xor(k.gpos >> y.i, 1)),
    f AS (SELECT g, pos, list({'sib': coalesce(sib, ''), 'after': coalesce(after, true)} ORDER BY i) AS steps FROM q GROUP BY g, pos),
    o AS (SELECT r.doc_id, r.leaf, k.subroot, w.root, r.own, coalesce(f.steps, []) AS steps FROM r JOIN k USING (g), w LEFT JOIN f ON f.g = r.g AND f.pos = r.pos),
    b AS (SELECT *, list_reduce(list_prepend({'sib': own, 'after': true}, steps), lambda x, y: {'sib': sha256(CASE WHEN y.after THEN x.sib || y.sib ELSE y.sib || x.sib END), 'after': true}).sib AS folded_root FROM o)
    SELECT doc_id, leaf, subroot, root, sha256(list_reduce(list_prepend('', list_transform(steps, lambda x: x.sib)), lambda x, y: x || y)) AS proof_sha256, folded_root, folded_root = root AS verified FROM b"""
}
