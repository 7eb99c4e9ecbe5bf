import hashlib
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from gridloom.llm import merkle as m

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree(hashes, fanout):
    """Root, and for each leaf its siblings level by level as (before, after)."""
    levels = [hashes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + fanout]) for i in range(0, len(levels[-1]), fanout)])
    proofs = []
    for i in range(len(hashes)):
        steps = []
        for level in levels[:-1]:
            start = i - i % fanout
            steps.append(("".join(level[start:i]), "".join(level[i + 1 : start + fanout])))
            i //= fanout
        proofs.append(steps)
    return levels[-1][0], proofs


def brute(rows, fanout=2):
    """rows: tuples in the order of COLUMNS."""
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[g] = tree([leaf_of(r) for r in groups[g]], fanout)
    root, upper = tree([trees[g][0] for g in names], fanout) if names else (None, [])
    out = Counter()
    for g, above in zip(names, upper, strict=True):
        for r, own in zip(groups[g], trees[g][1], strict=True):
            steps = own + above
            changed = r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            back = leaf_of((*r[:3], r[3] + 1, r[4])) if changed else leaf_of(r)
            for a, b in steps:
                back = h(a, back, b)
            out[(r[0], leaf_of(r), trees[g][0], root, h(*[a + b for a, b in steps]), back, back == root)] += 1
    return out


def of_manifest(out):
    rows = out.select("doc_id", "leaf", "subroot", "root", m.hashed(m.siblings(F.col("steps"))), m.folded(F.col("leaf"), F.col("steps")))
    return Counter((*r[:5], r[5] == r[3]) for r in map(tuple, rows.collect()))


@pytest.mark.parametrize("fanout,levels", [(2, 1), (2, 2), (3, 1), (2, 12), (5, 2), (2, 0)])
def test_against_brute_force(docs, fanout, levels):
    mixed = docs.withColumn("lang", F.when(F.col("doc_id") % 5 == 0, None).when(F.col("doc_id") < 9, F.lit("é")).otherwise(F.lit("en"))).withColumns({"hash": F.lit(1), "group": F.lit(2), "row": F.lit(3), "root": F.lit("r")})
    rows = [tuple(r[c] for c in COLUMNS) for r in mixed.collect()]
    want = Counter()
    for r, n in brute(rows, fanout).items():
        want[(*r[:5], True)] += n
    assert of_manifest(m.merkle_manifest(mixed, fanout=fanout, levels=levels)) == want


def test_trees_of_every_size(spark):
    """Groups of 1 to 40 leaves side by side, in blocks of two and of one: ragged ends at every level."""
    rows = [(i, None, f"g{n:02d}", None, f"t{i}") for n in range(1, 41) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    want = Counter((*r[:5], True) for r in brute(rows))
    for levels in (0, 1):
        assert of_manifest(m.merkle_manifest(docs, levels=levels)) == want


def test_empty_and_single(spark, no_docs):
    assert m.merkle_manifest(no_docs).collect() == []
    (one,) = m.merkle_manifest(spark.createDataFrame([(3, None, None, None, None)], no_docs.select(COLUMNS[0], "source", "lang", "n_chars", "text").schema)).collect()
    assert one["root"] == one["subroot"] == one["leaf"] == leaf_of((3, None, None, None, None)) and one["steps"] == []


def test_butterfly_swaps_are_bounded(spark):
    """Rounds of 9 blocks: padded to 16, and each swap group has two members."""
    blocks = spark.createDataFrame([("g", k, 9, f"{k:064x}") for k in range(9)], "group string, block long, size long, hash string")
    rows = {r["block"]: r for r in m.butterfly(blocks, 2, 0).collect()}
    assert set(rows) == set(range(16)) and len({r["root"] for r in rows.values()}) == 1
    assert rows[0]["root"] == tree([f"{k:064x}" for k in range(9)], 2)[0] and {len(r["steps"]) for r in rows.values()} == {4}


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_query(spark, sf):
    path = f"/root/testdata/{sf}"
    rows = [tuple(r[c] for c in COLUMNS) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    got = Counter(map(tuple, m.op13_merkle_manifest(spark, path).select(names).collect()))
    assert got == brute(rows) and {r[-1] for r in got} == {True, False}
