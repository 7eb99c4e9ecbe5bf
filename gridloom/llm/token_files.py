"""Token ids in ORC files: stripes with run-length encoded integers, row indexes, and Bloom filters on document ids."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.common import by_batch, new_path, table
from gridloom.llm.tokens import ENCODE_BYTES, encoder

SCHEMA = "doc_id long, position long, n_tokens long, ids array<int>"
#: Stripes of this many bytes are read in parallel; each 2,000 rows have an entry in the row index and in the Bloom filter.
ORC_OPTIONS = {"orc.stripe.size": str(16 << 20), "orc.row.index.stride": "2000", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.compress": "ZSTD"}


def write_token_files(docs: DataFrame, path: str, vocabulary: str, end_id: int = 0) -> None:
    """Encode every whole text (null: empty), append end_id, and write the ids in ascending doc_id order.

    Texts are range-partitioned before they are encoded, as the partitioner samples what it deals. position is the file's
    place in the order times 2**33 plus the row's place in the file. Null ids come first; ties keep the order of their texts.
    Texts of any length are encoded whole; repeated rows are written each; an empty table gives files without rows. Only doc_id
    and text of docs are read, so other columns may have any names.
    """

    def make():
        coder = encoder(vocabulary)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, ends = coder.encode_column(batch.column("text"), end_id)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.view(np.int32)))
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(ends)), lists], names=["doc_id", "n_tokens", "ids"])

        return each

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    encoded = by_batch(ordered, make, "doc_id long, n_tokens long, ids array<int>", ENCODE_BYTES)
    encoded.select("doc_id", F.monotonically_increasing_id().alias("position"), "n_tokens", "ids").write.options(**ORC_OPTIONS).orc(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, position, n_tokens, ids); filters on doc_id skip stripes and row groups by range and Bloom filter."""
    return spark.read.schema(SCHEMA).orc(path)


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of token files: start counts the ids of all documents before."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = batch.column("ids")
            ends, values = ids.offsets.to_numpy(), memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), "<i4")).cast("B")
            crc = [zlib.crc32(values[4 * a : 4 * b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("position"), pa.array(np.diff(ends), pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "position", "n_tokens", "ids_crc32"])

        return each

    rows = by_batch(read_token_files(spark, path).select("doc_id", "position", "ids"), make, "doc_id long, position long, n_tokens long, ids_crc32 long")
    rows = rows.withColumn("file", F.shiftright("position", 33))
    sizes = read_token_files(spark, path).groupBy(F.shiftright("position", 33).alias("file")).agg(F.sum("n_tokens").alias("size"))
    # One row a file: as many as the writer had partitions, whatever the number of documents.
    before = sizes.select("file", (F.sum("size").over(Window.orderBy("file")) - F.col("size")).alias("before"))
    within = F.sum("n_tokens").over(Window.partitionBy("file").orderBy("position")) - F.col("n_tokens")
    return rows.withColumn("within", within).join(before, "file").select("doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = new_path(spark, "tokens")
    write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_index(spark, path)


QUERIES = {"op2_token_files": op2_token_files}
ORACLE: dict[str, str] = {}
