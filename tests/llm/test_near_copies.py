"""What the joins of near copies shuffle, and which of their comparisons are settled at once."""

import numpy as np
from pyspark.sql import functions as F

from gridloom.llm import common as c
from gridloom.llm import near


def test_only_rows_that_may_go_are_shuffled(spark):
    rows = spark.range(2000).withColumn("keys", F.array("id"))
    left = c.without_ids(rows, spark.range(0, 2000, 500).union(spark.createDataFrame([(7,), (7,)], "id long")), "id")
    assert sorted(r["id"] for r in left.collect()) == [i for i in range(2000) if i % 500 and i != 7]
    # An anti join would be moved to the rows, below the filter.
    assert "LeftAnti" not in left._jdf.queryExecution().optimizedPlan().toString()


def numbers(most):
    """Rows are numbers, that may be linked up to a distance of most."""

    def matcher(rows):
        own = np.array([int(x) for x in rows])
        return lambda i, others: (np.abs(own[others] - own[i]), np.abs(own[others] - own[i]) <= most)

    return matcher


def test_comparisons_of_few_pairs_are_whole(spark):
    apart = spark.createDataFrame([(1, i) for i in range(0, 40, 4)] + [(2, i) for i in range(100, 110)], "key long, id long")
    rows = near.open_buckets(apart, spark.createDataFrame([], "id long, component long"))
    sketches = apart.select("id", F.col("id").cast("string").alias("sketch"))
    found = near.crossing_pairs(rows, sketches, numbers(4), True, few=1).collect()
    # Nine pairs of ten rows are all of the first bucket; the second has thirty, of which a forest comes.
    assert {(r["x"], r["y"]) for r in found if r["key"] == 1} == {(i, i + 4) for i in range(0, 36, 4)} and all(r["whole"] for r in found if r["key"] == 1)
    assert len([r for r in found if r["key"] == 2]) == 9 and not any(r["whole"] for r in found if r["key"] == 2)


def test_whole_comparisons_are_not_done_again(spark, monkeypatch):
    # 10 is first; the pairs (20, 30) and (40, 50) are let through, and only the first is a link.
    rows = spark.createDataFrame([([1], i) for i in (10, 20, 30, 40, 50)], "keys array<long>, id long")
    sketches = spark.createDataFrame([(10, "0"), (20, "100"), (30, "103"), (40, "200"), (50, "203")], "id long, sketch string")
    calls, real = [], near.open_buckets
    monkeypatch.setattr(near, "open_buckets", lambda *a: calls.append(1) or real(*a))
    verify = lambda pairs, texts: pairs.withColumn("ok", F.col("x") == 20)
    found = near.linked_components(rows, spark.createDataFrame([], "id long"), numbers(3), lambda ids: ids, verify, sketches)
    assert {tuple(r) for r in found.collect()} == {(20, 20), (30, 20)}
    assert len(calls) == 1
