import random

import pyarrow as pa
from pyspark.sql import functions as F

from gridloom.llm import common as c


def test_components(spark):
    rng = random.Random(8)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(k, k + 1) for k in range(1000, 1060)] + [(2000, k) for k in range(1900, 1990)] + [(5, 5), (None, 3), (7, None)]
    root = {}

    def find(a):
        root.setdefault(a, a)
        while root[a] != a:
            a = root[a]
        return a

    for u, v in pairs:
        if u is not None and v is not None and u != v:
            a, b = find(u), find(v)
            root[max(a, b)] = min(a, b)
    got = {r["id"]: r["component"] for r in c.connected_components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {i: find(i) for i in root}
    assert c.connected_components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_filter_never_loses_a_key(spark):
    rows = spark.range(20_000).withColumn("id", F.when(F.col("id") % 97 == 5, None).otherwise(F.col("id")))
    keys = spark.range(0, 20_000, 7)
    for bits in (1 << 15, 1 << 26):
        seen = c.may_contain(rows, "id", keys, bits=bits)
        assert seen.join(keys, "id").where("not _may").count() == 0 and seen.count() == 20_000
    assert seen.where("_may").count() < 1.01 * keys.count()
    left = c.without_ids(rows, keys, "id")
    assert left.columns == ["id"] and left.where("id % 7 = 0").count() == 0 and left.count() == rows.count() - rows.join(keys, "id").count()


def test_columns_of_any_name(spark):
    rows = spark.range(200).select("id", *[F.lit(k).alias(c) for k, c in enumerate(("_may", "_bucket", "_map", "_place", "_row", "__may", "_MAY2", "a.b"))])
    left = c.without_ids(rows, spark.range(0, 200, 3), "id")
    assert left.columns == rows.columns and sorted(r["id"] for r in left.collect()) == [k for k in range(200) if k % 3]
    assert {r["_may"] for r in left.collect()} == {0}


def test_batches_are_bounded_by_bytes(spark):
    docs = spark.range(0, 3000, numPartitions=1).select(F.lpad(F.col("id").cast("string"), 10_000, "x").alias("text"))
    sizes = c.by_batch(docs, lambda: lambda b: pa.RecordBatch.from_pydict({"n": [b.num_rows], "size": [b.get_total_buffer_size()]}), "n long, size long").collect()
    assert sum(r["n"] for r in sizes) == 3000 and len(sizes) >= 3 and max(r["size"] for r in sizes) < 2 * c.SLICE_BYTES


def test_a_worker_keeps_nothing_of_other_steps(spark):
    import public_tokenizers

    from gridloom.llm import packing, tokens

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = spark.range(0, 40, numPartitions=4).select(F.col("id").alias("doc_id"), F.lit("some words").alias("text"))
    assert packing.cut_pieces(texts, path).count() == 40

    def left(batch):
        import gc
        import os

        return pa.RecordBatch.from_pydict({"pid": [os.getpid()], "n": [sum(type(x).__name__ == "ChunkEncoder" for x in gc.get_objects())]})

    assert {r["n"] for r in c.by_batch(texts, lambda: left, "pid long, n long").collect()} == {0}
    # Tasks of one step share what they ask for.
    first = []
    for _ in range(2):
        c.begun(lambda: first.append(tokens.encoder(path)))
    assert first[0] is first[1]
    c.begun(lambda: None)
    c.begun(lambda: first.append(tokens.encoder(path)))
    assert first[2] is not first[0]
