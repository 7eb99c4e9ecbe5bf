"""Run artefacts, rule registries and digests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def write_run(df: DataFrame, path: str) -> None:
    """One artefact by repository and run; a run that is written again replaces its own partition only."""
    df.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("repo_id", "run_id").parquet(path)


def read_run(spark: SparkSession, path: str, repo_id: str | None = None, run_id: str | None = None) -> DataFrame:
    """The artefact, pruned to a repository or run by its partitions."""
    out = spark.read.parquet(path)
    for name, value in (("repo_id", repo_id), ("run_id", run_id)):
        out = out if value is None else out.where(F.col(name) == value)
    return out


def rule_registry(base: DataFrame, *extra: DataFrame) -> DataFrame:
    """Rules by id, later registries over earlier ones, with their place by priority and id. Columns: id, priority, ..."""
    rows = reduce(DataFrame.unionByName, [df.withColumn("_source", F.lit(k)) for k, df in enumerate((base, *extra))])
    last = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("_source")))
    return rows.withColumn("_r", last).where("_r = 1").drop("_r", "_source").orderBy(F.desc("priority"), "id")


def corpus_digest(files: DataFrame) -> DataFrame:
    """(repo_id, files, digest): sha256 of the sorted lines path:sha256 of each repository."""
    own = files.select("repo_id", "path", F.sha2(F.col("content").cast("binary"), 256).alias("h"))
    return own.groupBy("repo_id").agg(F.count("*").alias("files"), F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "path", "h"))), "\n").cast("binary"), 256).alias("digest"))


def forced_sources(sources: DataFrame, forced: DataFrame) -> DataFrame:
    """sources with role canonical where (repo_id, path) is in forced."""
    mark = forced.select("repo_id", "path").distinct().withColumn("_forced", F.lit(True))
    return sources.join(mark, ["repo_id", "path"], "left").withColumn("role", F.when(F.col("_forced"), "canonical").otherwise(F.col("role"))).drop("_forced")
