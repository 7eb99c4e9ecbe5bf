import math
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gridloom.llm import sharding as s


def check(rows, shards, n):
    sizes = Counter(r["shard"] for r in rows)
    assert len(rows) == n and set(sizes) <= set(range(shards))
    assert max(sizes.values(), default=0) - min((sizes.get(k, 0) for k in range(shards)), default=0) <= 1
    for k in sizes:
        assert sorted(r["slot"] for r in rows if r["shard"] == k) == list(range(sizes[k]))


def test_every_row_once_in_exact_sizes(docs, no_docs):
    held = docs.withColumns({"shard": F.lit("mine"), "_at": F.lit(1), "n": F.lit(2)})
    for shards, block in ((1, 4096), (7, 4), (24, 4096), (200, 1)):
        out = s.shuffle_to_shards(held, shards, 5, block)
        assert out.columns == [*held.columns, "_shard", "slot"]
        rows = out.withColumnRenamed("shard", "own").withColumnRenamed("_shard", "shard").collect()
        check(rows, shards, docs.count())
        assert {r["own"] for r in rows} == {"mine"}
        assert Counter((r["doc_id"], r["text"]) for r in rows) == Counter((r["doc_id"], r["text"]) for r in docs.collect())
    assert s.shuffle_to_shards(no_docs).collect() == []


def test_the_same_seed_gives_the_same_shuffle(spark):
    rows = spark.range(0, 3000, numPartitions=5)
    a, b, c = (sorted(map(tuple, s.shuffle_to_shards(rows, 6, seed, 100).collect())) for seed in (1, 1, 2))
    assert a == b and a != c


def test_draws_follow_the_hypergeometric_law(spark):
    for take, mark, of in ((5, 4, 9), (30, 100, 140), (3, 500, 100_000), (400, 300, 1000)):
        got = Counter(r[0] for r in spark.range(20_000).select(s.drawn(*[F.lit(x).cast("long") for x in (take, mark, of)], F.col("id"))).collect())
        law = {k: math.comb(mark, k) * math.comb(of - mark, take - k) / math.comb(of, take) for k in range(max(0, take + mark - of), min(take, mark) + 1)}
        assert set(got) <= set(law)
        for k, p in law.items():
            assert abs(got[k] - 20_000 * p) < 5.5 * math.sqrt(20_000 * p * (1 - p)) + 1


def test_draws_of_large_numbers(spark):
    take, mark, of = 10**10, 10**11, 24 * 10**11
    (x,) = spark.range(1).select(s.drawn(*[F.lit(v) for v in (take, mark, of)], F.col("id"))).first()
    assert abs(x - take * mark / of) < 6 * math.sqrt(take / 24)


def test_the_matrix_keeps_both_margins(spark):
    counts = spark.createDataFrame([(k, (k * 37) % 11 * 100) for k in range(40)] + [(40, 12_345)], "part long, n long")
    rows = s.communication_matrix(counts, 24, 3).collect()
    assert {r["part"]: sum(r["seats"]) for r in rows} == {r["part"]: r["n"] for r in counts.collect()}
    total = [sum(r["seats"][k] for r in rows) for k in range(24)]
    assert max(total) - min(total) <= 1 and min(min(r["seats"]) for r in rows) >= 0


def test_places_are_uniform(spark):
    """Each twelfth of the rows takes each twelfth of the places about as often, over some seeds, and neighbours part."""
    hits, together = Counter(), 0
    for seed in range(12):
        rows = s.shuffle_to_shards(spark.range(0, 600, numPartitions=4), 3, seed, 70).collect()
        for r in rows:
            hits[(r["id"] // 50, (r["shard"] * 200 + r["slot"]) // 50)] += 1
        at = {r["id"]: (r["shard"], r["slot"]) for r in rows}
        together += sum(at[k][0] == at[k + 1][0] for k in range(599))
    chi = sum((hits[(a, b)] - 50) ** 2 / 50 for a in range(12) for b in range(12))
    assert chi < 121 + 5 * math.sqrt(2 * 121)
    p = 199 / 599
    assert abs(together - 12 * 599 * p) < 6 * math.sqrt(12 * 599 * p * (1 - p))


def test_query_and_written_shards(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = s.op11_shuffle_shards(spark, sf).collect()
    check(rows, 24, len(texts))
    assert {(r["doc_id"], r["size"], r["text_crc32"], r["law"], r["grown_shard"]) for r in rows} == {(i, len(t) + 8, zlib.crc32(t), "rows", None) for i, t in texts.items()}
    docs = spark.range(0, 500, numPartitions=3)
    s.write_shards(docs, str(tmp_path / "out"), 5)
    back = spark.read.parquet(str(tmp_path / "out"))
    check(back.collect(), 5, 500)
    assert sorted(map(tuple, back.select("id", "shard", "slot").collect())) == sorted(map(tuple, s.shuffle_to_shards(docs, 5).collect()))
    with pytest.raises(ValueError):
        s.write_shards(docs.withColumn("Slot", F.lit(1)), str(tmp_path / "no"))
