"""Places in a total order of each repository, without a task that holds a whole repository."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.sources.staged import staged

#: monotonically_increasing_id has the partition above these bits and the row within it below.
ROW_BITS = 33


def run_keys(df: DataFrame) -> list[str]:
    """The columns that keep repositories and runs apart, as far as df has them."""
    return [c for c in ("repo_id", "run_id") if c in df.columns]


def repo_keys(*dfs: DataFrame) -> list[str]:
    """repo_id where all of the tables have it: for comparisons of two runs, which have ids of their own."""
    return ["repo_id"] if all("repo_id" in df.columns for df in dfs) else []


def ranked(df: DataFrame, order: list[Column | str], name: str = "rank", running: str | None = None) -> DataFrame:
    """df with a column of that name: each row's place from 1 among the rows of its keys (run_keys), in the given total order.

    Rows are range-partitioned by keys and order, so that one large repository spreads over many tasks, and written in that
    order. Counts of each range and key, at most as many as both together, give where a range begins; they are all that a
    window sees. running names a column of numbers: then _before has its sum over the rows before, and _total over all rows.
    """
    keys = run_keys(df)
    placed = staged(df.orderBy(*keys, *order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", ROW_BITS).alias("_part")
    # A null key is a key like others here.
    safe = [F.struct(F.col(k)).alias(f"_{k}") for k in keys]
    amounts = [F.sum(running).alias("_sum")] if running else []
    counts = placed.groupBy(part, *safe).agg(F.count("*").alias("_n"), F.min("_at").alias("_least"), *amounts)
    own = Window.partitionBy(*[f"_{k}" for k in keys])
    before = lambda c: F.coalesce(F.sum(c).over(own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = [before("_sum").alias("_ahead"), F.sum("_sum").over(own).alias("_total")] if running else []
    starts = counts.select("_part", *[f"_{k}" for k in keys], (before("_n") - F.col("_least")).alias("_shift"), *sums)
    out = placed.withColumn("_part", F.shiftright("_at", ROW_BITS)).withColumns({f"_{k}": F.struct(F.col(k)) for k in keys}).join(starts, ["_part", *[f"_{k}" for k in keys]])
    columns = [F.col(c) for c in df.columns] + [(F.col("_at") + F.col("_shift") + 1).cast("int").alias(name)]
    if running:
        # Within a range and key the rows before are summed by a window over that range alone.
        inner = Window.partitionBy("_part", *[f"_{k}" for k in keys]).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
        columns += [(F.col("_ahead") + F.coalesce(F.sum(running).over(inner), F.lit(0))).alias("_before"), F.col("_total")]
    return out.select(*columns)


def first_ranks(df: DataFrame, order: list[Column | str], n: int, name: str = "rank") -> DataFrame:
    """The rows of ranked whose place is n at most; each range gives its first n rows of a key before keys are put together."""
    keys = run_keys(df)
    salted = df.withColumn("_salt", F.spark_partition_id())
    near = salted.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_salt").orderBy(*order))).where(F.col("_r") <= n).drop("_r", "_salt")
    return near.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= n)
