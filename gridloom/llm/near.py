"""Links between near copies that share a bucket: proposed in linear numbers, verified on whole texts, joined into components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import by_batch, connected_components, drop_staged, may_contain, stage, without_ids

#: Members of a bucket that one side of a comparison holds at most, about.
BLOCK = 1024

#: matcher(sketches of one comparison) gives a function of a row and an array of other rows: distances, and whether they may be linked.
Matcher = Callable[[list], Callable[[int, np.ndarray], tuple[np.ndarray, np.ndarray]]]


def buckets(rows: DataFrame, copies: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Of rows (keys, id) without copies (id): pairs (x, y) of each bucket's smallest id and its other members, and (key, id) of buckets of three and more.

    Counting goes first, partly in each task. Only rows whose key may be that of a larger bucket are shuffled again; no bucket
    is collected, and a bucket of m members gives m - 1 pairs. Without copies (None) all rows count.
    """
    unique = (lambda of: of) if copies is None else (lambda of: without_ids(of, copies, "id"))
    keys = unique(rows).select(F.explode("keys").alias("key"), "id")
    counted = stage(keys.groupBy("key").agg(F.count("*").alias("m"), F.min("id").alias("a"), F.max("id").alias("b")).where("a <> b"), "buckets")
    large = counted.where("m > 2").select("key", "a")
    # Here copies go last, when only the rows of larger buckets are left.
    held = may_contain(rows.select(F.explode("keys").alias("key"), "id"), "key", large).where("_may").drop("_may")
    members = stage(unique(held).join(large, "key").select("key", "id", "a"), "members")
    star = members.where("id <> a").select(F.col("a").alias("x"), F.col("id").alias("y"))
    pairs = stage(counted.where("m = 2").select(F.col("a").alias("x"), F.col("b").alias("y")).union(star).distinct(), "pairs")
    drop_staged(counted)
    return pairs, members


def near_pairs(pairs: DataFrame, sketches: DataFrame, matcher: Matcher) -> DataFrame:
    """Those pairs (x, y) that sketches (id, sketch) let through."""
    kind = dict(pairs.dtypes)["x"]

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = zip(batch.column("sketch_x").to_pylist(), batch.column("sketch_y").to_pylist(), strict=True)
            ok = [bool(matcher([a, b])(0, np.array([1]))[1][0]) for a, b in rows]
            return pa.RecordBatch.from_arrays([batch.column("x"), batch.column("y")], names=["x", "y"]).filter(pa.array(ok, pa.bool_()))

        return each

    both = pairs.join(sketches.toDF("x", "sketch_x"), "x").join(sketches.toDF("y", "sketch_y"), "y")
    return by_batch(both, make, f"x {kind}, y {kind}")


def open_buckets(members: DataFrame, components: DataFrame) -> DataFrame:
    """(key, id, comp, minor, m, others) of the buckets whose members (key, id) are of several components.

    minor: not of the bucket's largest component; m counts the bucket's rows and others the minor ones.
    """
    named = members.select("key", "id").join(components, "id", "left").select("key", "id", F.coalesce("component", "id").alias("comp"))
    each = named.groupBy("key", "comp").agg(F.count("*").alias("c"))
    of = each.groupBy("key").agg(F.max(F.struct("c", "comp")).alias("most"), F.sum("c").alias("m"), F.count("*").alias("comps")).where("comps > 1")
    of = of.select("key", F.col("most.comp").alias("major"), "m", (F.col("m") - F.col("most.c")).alias("others"))
    return named.join(of, "key").select("key", "id", "comp", (F.col("comp") != F.col("major")).alias("minor"), "m", "others")


def _forest(x: np.ndarray, y: np.ndarray, far: np.ndarray, n: int) -> list[int]:
    """Positions of pairs that span what the pairs connect, nearest first."""
    root = list(range(n))

    def find(a: int) -> int:
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    kept = []
    for k in np.argsort(far, kind="stable").tolist():
        a, b = find(int(x[k])), find(int(y[k]))
        if a != b:
            root[max(a, b)] = min(a, b)
            kept.append(k)
    return kept


def _runs(batches: Iterator[pa.RecordBatch], by: tuple[str, ...]) -> Iterator[pa.Table]:
    """The rows of sorted batches, a table for each value of the columns by."""
    rest: list[pa.Table] = []
    for batch in batches:
        now = pa.Table.from_batches([batch])
        if not len(now):
            continue
        cols = [now[c].to_numpy() for c in by]
        cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        if rest and any(rest[-1][c][-1].as_py() != v[0] for c, v in zip(by, cols, strict=True)):
            yield pa.concat_tables(rest)
            rest = []
        for a, b in zip([0, *cuts], [*cuts, len(now)], strict=True):
            if a and rest:
                yield pa.concat_tables(rest)
                rest = []
            rest.append(now.slice(a, b - a))
    if rest:
        yield pa.concat_tables(rest)


def crossing_pairs(rows: DataFrame, sketches: DataFrame, matcher: Matcher, spanning: bool, block: int = BLOCK, few: int = 0) -> DataFrame:
    """(key, x, y, whole), x < y, of pairs of different components in one bucket that the matcher lets through.

    rows are those of open_buckets. Minor rows meet all rows; both are dealt into blocks by hash, and a comparison sees one
    block of either. So a bucket of one large component and a few others makes about a row a member, and no comparison holds
    more than two blocks. spanning: a comparison of more than few such pairs a row returns a spanning forest of its components, less than
    a row each, and whole is false; others return all of them.
    """
    kind = dict(rows.dtypes)["id"]
    lefts, rights = F.ceil(F.col("others") / block).cast("int"), F.ceil(F.col("m") / block).cast("int")
    own = rows.withColumns({"p": F.pmod(F.xxhash64("id"), lefts).cast("int"), "q": F.pmod(F.hash("id"), rights).cast("int")})
    across = F.transform(F.sequence(F.lit(0), rights - 1), lambda j: F.struct(F.col("p").alias("i"), j.alias("j")))
    down = F.transform(F.sequence(F.lit(0), lefts - 1), lambda i: F.struct(i.alias("i"), F.col("q").alias("j")))
    dealt = own.withColumn("at", F.explode(F.when(F.col("minor"), F.array_union(across, down)).otherwise(down)))
    dealt = dealt.select("key", "at.i", "at.j", "id", "comp", "minor", (F.col("minor") & (F.col("at.i") == F.col("p"))).alias("left"), (F.col("at.j") == F.col("q")).alias("right"))
    dealt = dealt.join(sketches, "id").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "id")

    def compare(part: pa.Table) -> tuple[np.ndarray, np.ndarray, bool]:
        flag = lambda c: part[c].to_numpy(zero_copy_only=False)
        minor, match = flag("minor"), matcher(part["sketch"].to_pylist())
        comp = np.unique(flag("comp"), return_inverse=True)[1]
        cols = np.flatnonzero(flag("right"))
        xs, ys, fars = [], [], []
        for i in np.flatnonzero(flag("left")).tolist():
            # Two minor rows meet twice; rows are in the order of their ids.
            mine = cols[(comp[cols] != comp[i]) & (~minor[cols] | (cols > i))]
            far, ok = match(i, mine)
            hits = mine[ok]
            xs.append(np.full(len(hits), i)), ys.append(hits), fars.append(far[ok])
        if not xs:
            return np.empty(0, np.int64), np.empty(0, np.int64), True
        x, y = np.concatenate(xs), np.concatenate(ys)
        whole = not spanning or len(x) <= few * len(minor)
        if not whole:
            kept = _forest(comp[x], comp[y], np.concatenate(fars), int(comp.max()) + 1)
            x, y = x[kept], y[kept]
        return np.minimum(x, y), np.maximum(x, y), whole

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _runs(batches, ("key", "i", "j")):
            x, y, whole = compare(part)
            key, ids = pa.array(part["key"].to_numpy()), part["id"].combine_chunks()
            for at in range(0, len(x), 50_000):
                a, b = (pa.array(v[at : at + 50_000]) for v in (x, y))
                yield pa.RecordBatch.from_arrays([key.take(a), ids.take(a), ids.take(b), pa.array(np.full(len(a), whole))], names=["key", "x", "y", "whole"])

    return dealt.select("key", "i", "j", "id", "comp", "minor", "left", "right", "sketch").mapInArrow(run, f"key long, x {kind}, y {kind}, whole boolean")


def linked_components(rows: DataFrame, copies: DataFrame | None, matcher: Matcher, texts: Callable[[DataFrame], DataFrame], verify: Callable[[DataFrame, DataFrame], DataFrame], sketches: DataFrame | None = None) -> DataFrame:
    """(id, component) over the links that verify confirms, for rows (keys, id) without those whose id is among copies (id); None stands for no copies.

    texts(ids) gives the texts of ids (id); verify(pairs, texts) returns pairs (x, y), x < y, with a column ok. First each
    bucket's smallest member asks all others: that settles groups of near copies in as many pairs as they have members. In
    buckets whose members are still of several components, all pairs that cross them are compared within tasks. Without
    sketches that comparison, of the column sketch of texts, is the last word, and a spanning forest of the links comes out.
    Else it is of sketches (id, sketch), which may let pairs through that aren't linked: all of them are verified
    where they are no more than the rows, else a spanning forest of them. Where that joins all that it proposes, nothing that
    may be linked is left apart. In the other buckets of a forest every pair that crosses components is verified too, so no
    link is lost.
    """

    def tested(pairs: DataFrame) -> DataFrame:
        asked = pairs if sketches is None else stage(near_pairs(pairs, sketches, matcher), "asked")
        near = stage(texts(asked.select("x").union(asked.select("y")).toDF("id").distinct()), "texts")
        done = stage(verify(asked, near), "checked")
        drop_staged(near)
        return done

    def grown(components: DataFrame | None, links: DataFrame) -> DataFrame:
        new = links.select(F.col("x").alias("u"), F.col("y").alias("v"))
        return connected_components(new if components is None else components.select(F.col("id").alias("u"), F.col("component").alias("v")).union(new))

    def untested(pairs: DataFrame) -> DataFrame:
        return stage(pairs.select("x", "y").distinct().join(done.select("x", "y"), ["x", "y"], "left_anti"), "untested")

    pairs, members = buckets(rows, copies)
    done = tested(pairs)
    drop_staged(pairs)
    components = grown(None, done.where("ok"))
    rest = stage(open_buckets(members, components), "open")
    if rest.isEmpty():
        return components
    if sketches is None:
        whole = stage(texts(rest.select("id").distinct()), "texts")
        links = stage(crossing_pairs(rest, whole.select("id", "sketch"), matcher, True), "links")
        drop_staged(members, rest, whole)
        return grown(components, links)
    proposed = stage(crossing_pairs(rest, sketches, matcher, True, few=1), "proposed")
    more = tested(untested(proposed))
    components = grown(components, more.where("ok"))
    of = lambda end: components.select(F.col("id").alias(end), F.col("component").alias(f"c{end}"))
    named = proposed.where("not whole").join(of("x"), "x", "left").join(of("y"), "y", "left")
    doubtful = stage(named.where(F.coalesce("cx", "x") != F.coalesce("cy", "y")).select("key").distinct(), "doubtful")
    drop_staged(rest, proposed)
    if not doubtful.isEmpty():
        done = done.unionByName(more)
        again = open_buckets(members.join(doubtful, "key", "left_semi"), components)
        components = grown(components, tested(untested(crossing_pairs(again, sketches, matcher, False))).where("ok"))
    drop_staged(members)
    return components
