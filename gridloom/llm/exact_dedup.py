"""Exact dedup by a log-structured merge index of digests, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import may_contain, new_path, row_keyed, stage, table, without_rows

#: Writer options: a Bloom filter on the digests of each row group, so that a lookup of one digest skips most of a run.
RUN_OPTIONS = {"parquet.bloom.filter.enabled#digest": "true", "parquet.bloom.filter.expected.ndv#digest": "100000"}


def normalised(text: str = "text") -> F.Column:
    """Each run of ASCII white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def digest(text: F.Column) -> F.Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def flush_runs(docs: DataFrame, digest=digest) -> DataFrame:
    """Each input split is a memtable: it is flushed as one run of (digest, doc_id), sorted by digest, with filters."""
    path = new_path(docs.sparkSession, "runs")
    rows = docs.select(digest(normalised()).alias("digest"), F.col("doc_id").cast("long").alias("doc_id"))
    rows.sortWithinPartitions("digest", "doc_id").write.options(**RUN_OPTIONS).parquet(path)
    return docs.sparkSession.read.schema(rows.schema).parquet(path)


def compact(*runs: DataFrame) -> DataFrame:
    """One sorted run of (digest, keep_id, group_size) from runs of (digest, doc_id), or from compacted runs and such runs."""
    spark, rows = runs[0].sparkSession, None
    for run in runs:
        own = run if "keep_id" in run.columns else run.select("digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
        rows = own if rows is None else rows.unionByName(own)
    merged = rows.groupBy("digest").agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    path = new_path(spark, "index")
    merged.sortWithinPartitions("digest").write.options(**RUN_OPTIONS).parquet(path)
    return spark.read.schema(merged.schema).parquet(path)


def exact_dedup(docs: DataFrame, digest=digest) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of docs, which needs doc_id and text.

    Memtables flush sorted digest runs; compaction keeps the smallest id of a digest. Rows whose digest occurs more than
    once are hits: the bounded filter lets them through, and they are grouped by their bytes, each task's copies
    counted before the shuffle. Should two texts share a digest, their rows take the groups of their bytes.
    Null text counts as empty. A null doc_id never names a group unless all of its ids are null, and then keep_id is null
    and the rows are kept. Repeated ids within a group are all kept rows, as they are one document. An empty table gives none.
    Texts of any length are hashed whole. Only doc_id and text of docs are read, so other columns may have any names.
    """
    runs = flush_runs(docs, digest)
    index = compact(runs)
    many = index.where("group_size > 1").select("digest")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised().alias("norm")).withColumn("digest", digest(F.col("norm")))
    hits = may_contain(texts, "digest", many).where("_may")
    same = hits.groupBy("digest", "norm").agg(F.count("*").alias("n"))
    shared = stage(same.groupBy("digest").agg(F.count("*").alias("texts")).where("texts > 1").select("digest"), "collisions")
    sha = F.lower(F.hex("digest")).alias("text_sha256")
    out = ["doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept")]
    if shared.isEmpty():
        return runs.join(index, "digest").select(*out, sha)
    bytes_of = texts.join(shared, "digest", "left_semi")
    groups = bytes_of.groupBy("digest", "norm").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    exact = bytes_of.join(groups, ["digest", "norm"]).select(*out, F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"))
    return runs.join(shared, "digest", "left_anti").join(index, "digest").select(*out, sha).unionByName(exact)


def lookup(index: DataFrame, digests: list[str]) -> DataFrame:
    """Rows of a compacted run for a few hex digests; the scan prunes row groups by range and Bloom filter."""
    return index.where(F.col("digest").isin([bytearray.fromhex(x) for x in digests]))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of equal texts one row stays, that with the smallest doc_id; one with a null doc_id only if all have."""
    keyed, row = row_keyed(docs)
    found = exact_dedup(keyed.select(F.col(row).alias("doc_id"), "text"))
    return without_rows(keyed, row, found.where("not kept").select("doc_id"), docs.columns)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


QUERIES = {"op4_exact_dedup": op4_exact_dedup}
ORACLE = {
    "op4_exact_dedup": r"""
    WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
    SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
      doc_id IS NOT DISTINCT FROM min(doc_id) OVER w AS kept, text_sha256
    FROM t WINDOW w AS (PARTITION BY text_sha256)"""
}
