"""What the text operators share: tables, the shared scratch folder, Arrow helpers, connected components."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Unicode White_Space, as the body of a character class.
WHITE = "\t-\r \x85\xa0  -     　"

#: Of an Arrow batch, what an operator's function sees at once.
SLICE_BYTES = 2 << 20
#: The setting that bounds an Arrow batch by bytes, and Spark's default for it.
BATCH_BYTES, DEFAULT_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"

#: For bytes.translate: everything in ASCII but digits and letters becomes a space, and A-Z become a-z.
WORD_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of our own only where that is unset and there is no cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"{tempfile.gettempdir()}/gridloom-checkpoint"
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def stage(df: DataFrame, what: str = "stage", options: dict[str, str] | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: the lineage ends here, and lost executors cost nothing."""
    path = new_path(df.sparkSession, what)
    df.write.options(**options or {}).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def drop_staged(*frames: DataFrame) -> None:
    """Delete staged tables that no later plan reads."""
    for df in frames:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.staged_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def give_back() -> None:
    """What this process has freed goes back to the system: Arrow's pool, and the C library's heap where it can be trimmed."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


#: What this worker process keeps for its next tasks, and what its present task has asked for.
_held: dict[tuple, object] = {}
_asked: set[tuple] = set()


def _drop_unasked() -> None:
    gone = [key for key in _held if key not in _asked]
    for key in gone:
        del _held[key]
    if gone:
        give_back()


def held(key: tuple, make: Callable[[], object]) -> object:
    """What make gives, made once a worker and kept while its tasks ask for it.

    Workers outlive their tasks and take those of every step, so what each step keeps would add up: it goes when a task
    begins that asks for something else or for nothing.
    """
    _asked.add(key)
    if key not in _held:
        _drop_unasked()
        _held[key] = make()
    return _held[key]


def begun(make: Callable[[], Callable]) -> Callable:
    """A task's function, after which the worker holds only what that asked for."""
    _asked.clear()
    each = make()
    _drop_unasked()
    return each


def joined(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The same rows in the same order, in batches joined up to most bytes."""
    held_back: list[pa.RecordBatch] = []
    for batch in batches:
        if held_back and sum(x.nbytes for x in held_back) + batch.nbytes > most:
            yield pa.concat_batches(held_back)
            held_back = []
        held_back.append(batch)
    if held_back:
        yield pa.concat_batches(held_back)


def by_batch(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """mapInArrow with a function made once a task, by slices of about slice_bytes, so that what it makes at once is bounded.

    What is large and serves many tasks of a step is got by held() within make.

    Batches of long texts are large on both sides of the pipe, so the session's batches are held to SLICE_BYTES, unless it
    has a bound of its own; for a larger slice_bytes they are joined again in the worker. Workers outlive their tasks; each
    gives back what its memory pools kept.
    """
    if df.sparkSession.conf.get(BATCH_BYTES) == DEFAULT_BATCH_BYTES:
        df.sparkSession.conf.set(BATCH_BYTES, str(SLICE_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = begun(make)
        for batch in joined(batches, slice_bytes) if slice_bytes > SLICE_BYTES else batches:
            rows = max(1, batch.num_rows * slice_bytes // max(1, batch.nbytes))
            for at in range(0, batch.num_rows, rows):
                out = each(batch.slice(at, rows))
                if out is not None and out.num_rows:
                    yield out
        del each
        give_back()

    return df.mapInArrow(run, schema)


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def list_array(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """One list a row from numpy arrays, without Python objects for the elements."""
    ends = np.cumsum([0, *map(len, parts)])
    values = np.concatenate(parts) if parts else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of an undirected graph.

    edges: columns u and v of one orderable type; nulls and loops are ignored. Returns (id, component): for every vertex
    that has an edge, the smallest vertex that it reaches. Distributed union-find: each round hangs all larger neighbours of
    a vertex, then all its smaller ones, on the smallest, and each round's edges are written to the shared folder. No
    round collects a vertex's neighbours: they are joined with the smallest one, which partial aggregation finds. Rounds end
    when nothing moves; each hangs a vertex on a smaller one, so there is an end.
    """
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = stage(edges, "components")
    while True:
        # Done when each vertex hangs on one other that hangs on none.
        ends = now.select(F.col("u").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(now.select("v", F.lit(0), F.lit(1)))
        if ends.groupBy("id").agg(F.sum("up").alias("up"), F.sum("down").alias("down")).where("up > 1 or (up > 0 and down > 0)").isEmpty():
            return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select("v", "m").union(least.select("u", "m")).toDF("u", "v").where("u <> v").distinct()
        then, now = now, stage(small, "components")
        drop_staged(then)


INTEGRAL = ("tinyint", "smallint", "int", "bigint")


def key_type(df: DataFrame, keys: DataFrame, key: str) -> str:
    """The type in which both sides' keys are hashed and compared; hashes of an int and of a bigint differ."""
    a, b = dict(df.select(key).dtypes)[key], dict(keys.select(key).dtypes)[key]
    if a in INTEGRAL and b in INTEGRAL:
        return "bigint"
    if a != b:
        raise ValueError(f"{key} is {a} on one side and {b} on the other")
    return a


def key_filter(keys: DataFrame, key: str, bits: int = 1 << 26) -> DataFrame:
    """A bit map of the hashes of keys.key, of at most bits / 8 bytes however many keys there are: rows (_bucket, _map) of 64 longs."""
    at = F.pmod(F.xxhash64(key), F.lit(bits))
    words = keys.where(F.col(key).isNotNull()).select(at.alias("_at")).groupBy(F.shiftright("_at", 6).alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(_at & 63 as int))")).alias("_bits"))
    each = [F.coalesce(F.max(F.when(F.col("_word") % 64 == k, F.col("_bits"))), F.lit(0).cast("long")) for k in range(64)]
    return words.groupBy(F.shiftright("_word", 6).alias("_bucket")).agg(F.array(*each).alias("_map"))


def may_contain(df: DataFrame, key: str, keys: DataFrame, name: str = "_may", bits: int = 1 << 26) -> DataFrame:
    """df with a column of that name: false only where df.key is surely not among keys.key.

    What is broadcast has at most bits / 8 bytes (8 MB), so its bound holds for any number of keys; a full map merely
    prunes nothing. Callers must join the rows that pass for an exact answer. Other columns of df may have any names.
    """
    kind = key_type(df, keys, key)
    place, bucket, words = (free_name(df, x) for x in ("_place", "_bucket", "_map"))
    known = key_filter(keys.select(F.col(key).cast(kind).alias(key)), key, bits).toDF(bucket, words)
    found = df.withColumn(place, F.pmod(F.xxhash64(F.col(key).cast(kind)), F.lit(bits))).withColumn(bucket, F.shiftright(place, 12))
    found = found.join(F.broadcast(known), bucket, "left")
    bit = F.expr(f"shiftright(`{words}`[cast(shiftright(`{place}`, 6) & 63 as int)], cast(`{place}` & 63 as int)) & 1L") != 0
    return found.withColumn(name, F.col(words).isNotNull() & F.coalesce(bit, F.lit(False)) & F.col(key).isNotNull()).drop(place, bucket, words)


def free_name(df: DataFrame, want: str) -> str:
    """want, with so many underscores before it that no column of df has that name, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while want.lower() in taken:
        want = "_" + want
    return want


def without_ids(docs: DataFrame, dropped: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of docs whose key is not in dropped; only rows that may be in it are shuffled. A null key is in nothing."""
    may = free_name(docs, "_may")
    gone = free_name(docs, "_gone")
    flagged = may_contain(docs, key, dropped, may)
    # An outer join: Spark moves an anti join below the join with the bit map, and then shuffles all rows.
    rest = flagged.where(F.col(may)).join(dropped.select(key).distinct().withColumn(gone, F.lit(True)), key, "left").where(F.col(gone).isNull()).drop(gone)
    return flagged.where(~F.col(may)).unionByName(rest).select([F.col(f"`{c}`") for c in docs.columns])


def row_keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a column of longs that no two rows share, for decisions that are made for each row, and its name.

    It is doc_id where that is never null and never repeats. Else rows are numbered in the order of doc_id, nulls last, so
    that a group's smallest number is of its smallest doc_id, and written to the shared folder, as their numbers must not
    change between two reads.
    """
    row = free_name(docs, "_row")
    if docs.groupBy("doc_id").count().where("doc_id is null or count > 1").isEmpty():
        return docs.withColumn(row, F.col("doc_id").cast("long")), row
    # The tie-break lets the ranges cut through many nulls or one id's many rows.
    ordered = docs.withColumn(row, F.monotonically_increasing_id()).orderBy(F.col("doc_id").asc_nulls_last(), row)
    return stage(ordered.withColumn(row, F.monotonically_increasing_id()), "rows"), row


def without_rows(keyed: DataFrame, row: str, dropped: DataFrame, columns: list[str]) -> DataFrame:
    """The rows of row_keyed's docs whose number is not among dropped.doc_id, with the columns that docs had."""
    return without_ids(keyed, dropped.select(F.col("doc_id").alias(row)), row).select([F.col(f"`{c}`") for c in columns])
