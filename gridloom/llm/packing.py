"""Best-fit packing with exact complements, planned on counts of lengths and carried out as joins and windows."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.common import by_batch, stage, table
from gridloom.llm.tokens import ENCODE_BYTES, MAX_CHUNKS, encoder

#: Rows of one length that one task ranks, about.
RANK_ROWS = 500_000


def cut_pieces(docs: DataFrame, vocabulary: str, size: int = 2048, end_id: int = 0, with_ids: bool = False, max_chunks: int = MAX_CHUNKS) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every whole text, null as empty, with end_id at its end."""

    def make():
        coder = encoder(vocabulary, max_chunks)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, ends = coder.encode_column(batch.column("text"), end_id)
            n_pieces = -(-np.diff(ends) // size)
            row = np.repeat(np.arange(batch.num_rows), n_pieces)
            piece = np.arange(len(row)) - (np.cumsum(n_pieces) - n_pieces)[row]
            cuts = np.append(ends[row] + piece * size, ends[-1])
            values = memoryview(ids.astype("<u4", copy=False)).cast("B")
            crc = [zlib.crc32(values[4 * a : 4 * b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
            out = [batch.column("doc_id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(piece * size), pa.array(np.diff(cuts)), pa.array(crc, pa.int64())]
            if with_ids:
                out.append(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids.view(np.int32))))
            return pa.RecordBatch.from_arrays(out, names=names)

        return each

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    names = [x.split()[0] for x in schema.split(", ")]
    return by_batch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, schema, ENCODE_BYTES)


def plan_sequences(counts: dict[int, int], size: int) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """How to fill sequences of size: [(sequences, ((length, copies), ...))], each length used as often as counts says.

    Lengths that fill a sequence alone, then in pairs, then in threes, are taken while both sides last: the complement of a
    sum is looked up by its value. What is left goes by best fit, longest first, many equal sequences at a time. The work
    and the answer depend on the number of different lengths (at most size), not on the number of pieces.
    """
    left = np.zeros(size + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] += n
    out: list[tuple[int, tuple[tuple[int, int], ...]]] = []

    def take(n: int, *lengths: int) -> None:
        if n > 0:
            kinds = {x: lengths.count(x) for x in lengths}
            for x, k in kinds.items():
                left[x] -= n * k
            out.append((int(n), tuple(kinds.items())))

    take(left[size], size)
    for a in range(size - 1, 0, -1):
        b = size - a
        if b <= a and left[a] and left[b]:
            take(left[a] // 2 if a == b else min(left[a], left[b]), a, b)
    for a in range(size - 2, 0, -1):
        if not left[a]:
            continue
        b = np.arange(min(a, size - a - 1), (size - a + 1) // 2 - 1, -1)
        for b in b[(left[b] > 0) & (left[size - a - b] > 0)].tolist():
            c = size - a - b
            need = {x: (a, b, c).count(x) for x in (a, b, c)}
            take(min(left[x] // k for x, k in need.items()), a, b, c)
            if not left[a]:
                break
    gaps: dict[int, list[list]] = {}
    open_gaps = np.zeros(size + 1, dtype=bool)

    def put(gap: int, n: int, kinds: tuple) -> None:
        if gap:
            gaps.setdefault(gap, []).append([n, kinds])
            open_gaps[gap] = True
        else:
            out.append((n, kinds))

    for length in range(size, 0, -1):
        n = int(left[length])
        while n:
            at = np.flatnonzero(open_gaps[length:])
            if at.size:
                gap = int(at[0]) + length
                have, kinds = gaps[gap].pop()
            else:
                gap, have, kinds = size, n, ()
            copies = min(gap // length, n)
            use = min(have, n // copies)
            n -= use * copies
            if have > use and gap < size:
                gaps[gap].append([have - use, kinds])
            elif gap < size and not gaps[gap]:
                open_gaps[gap] = False
            put(gap - copies * length, use, (*kinds, (length, copies)))
    return out + [(n, kinds) for groups in gaps.values() for n, kinds in groups]


def slots(plan: list[tuple[int, tuple[tuple[int, int], ...]]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: where each run of its ranks begins, and its first sequence, copies in a sequence and offset."""
    at: dict[int, int] = {}
    found: dict[int, list[tuple[int, int, int, int]]] = {}
    first = 0
    for n, kinds in plan:
        offset = 0
        for length, copies in kinds:
            found.setdefault(length, []).append((at.get(length, 0), first, copies, offset))
            at[length] = at.get(length, 0) + n * copies
            offset += length * copies
        first += n
    return {k: tuple(np.array(x, dtype=np.int64) for x in zip(*v, strict=True)) for k, v in found.items()}


def pack(pieces: DataFrame, size: int = 2048) -> DataFrame:
    """pieces, which is read twice and should be a written table, with sequence_id and offset.

    It needs doc_id, piece and length (1 to size). Only counts of lengths (at most size) come to the driver. A piece's rank
    among those of its length is its rank within a salt plus what the salts before hold, so no length meets in one task.
    """
    spark = pieces.sparkSession
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    salts = max(8, int(sum(counts.values()) // RANK_ROWS) + 1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    where = spark.sparkContext.broadcast(slots(plan_sequences(counts, size)))
    own = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    before = own.groupBy("length", "_salt").count().select("length", "_salt", (F.sum("count").over(Window.partitionBy("length").orderBy("_salt")) - F.col("count")).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", *[c for c in ("ids_crc32",) if c in pieces.columns]))
    ranked = own.withColumn("_rank", rank.cast("long") - 1).join(before, ["length", "_salt"]).withColumn("_rank", F.col("_rank") + F.col("_before")).select(*pieces.columns, "_rank")

    def make():
        runs = where.value

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            length, rank = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for x in np.unique(length):
                mine = length == x
                begin, first, copies, place = runs[int(x)]
                k = np.searchsorted(begin, rank[mine], "right") - 1
                over = rank[mine] - begin[k]
                sequence[mine], offset[mine] = first[k] + over // copies[k], place[k] + over % copies[k] * x
            return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:-1], "sequence_id", "offset"])

        return each

    schema = ", ".join(f"`{c}` {kind}" for c, kind in pieces.dtypes) + ", sequence_id long, offset long"
    return by_batch(ranked, make, schema)


def pack_documents(docs: DataFrame, vocabulary: str, size: int = 2048, end_id: int = 0, with_ids: bool = False, max_chunks: int = MAX_CHUNKS) -> DataFrame:
    """Every piece of every document with its sequence and its offset there.

    Null texts are empty and give the end id alone; longer documents than size are cut; ties take the order of doc_id and
    piece; repeated rows are pieces of their own; an empty table gives none; other columns of docs play no part. max_chunks
    trades a worker's memory for time and changes no result.
    """
    return pack(stage(cut_pieces(docs, vocabulary, size, end_id, with_ids, max_chunks), "pieces"), size)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: its executors have run the other stages, so its workers keep fewer chunks than those of op8."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), max_chunks=120_000)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op8_best_fit_packing": op8_best_fit_packing}
ORACLE: dict[str, str] = {}
