"""The text pipeline: toxic documents go, then exact copies, near copies and benchmark leaks, and the rest is packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm.common import new_path, table
from gridloom.llm.decontaminate import drop_contaminated
from gridloom.llm.exact_dedup import drop_copies
from gridloom.llm.ngram_join import drop_near_copies
from gridloom.llm.packing import pack_stage
from gridloom.llm.toxicity import drop_toxic

#: Each takes (spark, docs, sf_dir); all but the last return the columns of documents.
STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("best_fit_packing", pack_stage),
]

#: SQL can't express the learnt score of the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        out = function(spark, docs, sf_dir)
        path = new_path(spark, f"pipeline-{name}")
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs


QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
