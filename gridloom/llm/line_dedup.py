"""Fuzzy line dedup: MinHash of character shingles, high-recall banding, exact Jaccard, one line of each component kept."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import by_batch, free_name, may_contain, stage, table
from gridloom.llm.near import linked_components
from gridloom.llm.ngram_join import mix

#: Characters of a shingle, and the similarity of near copies in percent.
SHINGLE, PERCENT = 9, 80
#: A line at the threshold shares a band with its like at 1 - (1 - 0.8**3)**7 = 0.993, at 0.9 at 0.9999.
BANDS, ROWS = 7, 3
#: Bytes of text hashed at once: some arrays of eight bytes a character stay in the processor's cache.
SLICE = 1 << 18
_SIZE = BANDS * ROWS
_BASE = np.uint64(0x9E3779B97F4A7C15)


def normal_line(line: str) -> str:
    """Lower case, trimmed, runs of white space as one space."""
    return " ".join(line.lower().split())


def rolling(data: np.ndarray, width: int) -> np.ndarray:
    """Polynomial hashes of all runs of width values: that of a run comes from those of its two halves."""
    if width < 2 or len(data) < width:
        return data if width == 1 else data[:0]
    half = width // 2
    part = rolling(data, half)
    both = part[: len(part) - half] * np.uint64(pow(int(_BASE), half, 1 << 64)) + part[half:]
    return both if width % 2 == 0 else both[: len(data) - width + 1] * _BASE + data[width - 1 :]


def shingle_hashes(lines: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of the lines, and the number of shingles of each line; a shorter line is one shingle."""
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    counts = np.maximum(sizes - width + 1, 1)
    data = np.frombuffer("".join(x if len(x) >= width else x + "\0" * (width - len(x)) for x in lines).encode("utf-32-le"), np.uint32)
    rolled = rolling(data.astype(np.uint64), width)
    starts = np.concatenate(([0], np.cumsum(np.maximum(sizes, width))[:-1])) if len(lines) else np.empty(0, np.int64)
    ends = np.cumsum(counts)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)
    # One-to-one, so that values differ wherever the rolling hashes do.
    h = rolled[at]
    h *= _BASE
    h ^= h >> np.uint64(32)
    h *= _BASE
    return h, counts


def signatures(lines: list[str], width: int = SHINGLE) -> np.ndarray:
    """MinHash signatures by one permutation: the least hash of each bin, empty bins filled from the next full one."""
    h, counts = shingle_hashes(lines, width)
    owner = np.repeat(np.arange(len(lines)), counts)
    bins = ((h >> np.uint64(32)) * np.uint64(_SIZE) >> np.uint64(32)).astype(np.int64)
    none = np.iinfo(np.uint64).max
    flat = np.full(len(lines) * _SIZE, none, np.uint64)
    np.minimum.at(flat, owner * _SIZE + bins, h & np.uint64(0xFFFFFFFF))
    out = flat.reshape(len(lines), _SIZE)
    place = np.arange(2 * _SIZE)
    full = np.where(np.tile(out != none, 2), place, 2 * _SIZE)
    nearest = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1][:, :_SIZE]
    return np.take_along_axis(out, nearest % _SIZE, axis=1) + np.uint64(0x100000001) * (nearest - place[:_SIZE]).astype(np.uint64)


def line_rows(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, line_no, line_id, keys) of every line with words; line_id is a 128-bit digest of the normal line."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            doc_ids, numbers, lines = [], [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for k, line in enumerate(text.split("\n") if text else ()):
                    if line := normal_line(line):
                        doc_ids.append(doc_id), numbers.append(k), lines.append(line)
            if not lines:
                return None
            sig = signatures(lines, width)
            keys = np.zeros((len(lines), BANDS), np.uint64)
            for r in range(ROWS):
                keys = mix(keys + sig[:, r::ROWS] * _BASE + np.arange(1, BANDS + 1, dtype=np.uint64))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(doc_ids, pa.int64()), pa.array(numbers, pa.int32()), pa.array([xxhash.xxh3_128_digest(x) for x in lines], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(lines) + 1) * BANDS, pa.int32()), pa.array(keys.reshape(-1).view(np.int64))),
                ],
                names=["doc_id", "line_no", "line_id", "keys"],
            )

        return each

    return by_batch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, "doc_id long, line_no int, line_id binary, keys array<long>", SLICE)


class LineSets:
    """Shingle sets of lines, for exact Jaccard similarities of one with many others."""

    def __init__(self, lines: list[str], width: int, percent: int):
        h, counts = shingle_hashes(lines, width)
        owner = np.repeat(np.arange(len(lines), dtype=np.int64), counts)
        number, known = pd.factorize(h)
        # Owners ascend, so the pairs of each line stay together.
        pairs = pd.unique(owner * max(1, len(known)) + number)
        self.shingles, self.seen = pairs % max(1, len(known)), np.zeros(len(known), bool)
        self.size = np.bincount(pairs // max(1, len(known)), minlength=len(lines))
        self.start, self.percent = np.cumsum([0, *self.size]), percent

    def __call__(self, i: int, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """100 less the similarity in percent, and whether it is reached."""
        others, every = np.asarray(others, np.int64), len(others)
        fit = np.flatnonzero(100 * np.minimum(self.size[i], self.size[others]) >= self.percent * np.maximum(self.size[i], self.size[others]))
        far, ok = np.full(every, 100), np.zeros(every, bool)
        if len(fit):
            mine, size = self.shingles[self.start[i] : self.start[i + 1]], self.size[others[fit]]
            self.seen[mine] = True
            ends = np.cumsum(size)
            at = np.arange(ends[-1]) + np.repeat(self.start[others[fit]] - (ends - size), size)
            both = np.add.reduceat(self.seen[self.shingles[at]], ends - size, dtype=np.int64)
            self.seen[mine] = False
            union = len(mine) + size - both
            far[fit], ok[fit] = 100 - 100 * both // union, 100 * both >= self.percent * union
        return far, ok


def verifier(width: int, percent: int):
    """Pairs (x, y) of first rows with ok: whether the sets of their lines' shingles, from (id, sketch), reach the similarity."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            a, b = (batch.column(c).to_pylist() for c in ("line_x", "line_y"))
            lines = list(dict.fromkeys([*a, *b]))
            h, counts = shingle_hashes(lines, width)
            sets = dict(zip(lines, map(np.unique, np.split(h, np.cumsum(counts)[:-1])), strict=True))
            ok = np.empty(len(a), bool)
            for k, (x, y) in enumerate(zip(a, b, strict=True)):
                p, q = sets[x], sets[y]
                fit = 100 * min(len(p), len(q)) >= percent * max(len(p), len(q))
                if fit:
                    both = np.sort(np.concatenate([p, q]))
                    same = int((both[1:] == both[:-1]).sum())
                ok[k] = fit and 100 * same >= percent * (len(p) + len(q) - same)
            return pa.RecordBatch.from_arrays([batch.column("x"), batch.column("y"), pa.array(ok)], names=["x", "y", "ok"])

        return each

    def verify(pairs: DataFrame, near: DataFrame) -> DataFrame:
        near = near.select("id", "sketch")
        whole = pairs.join(near.toDF("x", "line_x"), "x").join(near.toDF("y", "line_y"), "y").select("x", "y", "line_x", "line_y").sortWithinPartitions("x")
        return by_batch(whole, make, "x long, y long, ok boolean", 1 << 20)

    return verify


def line_texts(docs: DataFrame, own: DataFrame):
    """The normal lines (id, n, sketch) of first rows (id), cut from their documents; n is the length."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, lines = [], []
            for text, wanted in zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist(), strict=True):
                own = text.split("\n")
                for w in wanted:
                    if w["line_no"] < len(own) and xxhash.xxh3_128_digest(line := normal_line(own[w["line_no"]])) == w["line_id"]:
                        ids.append(w["id"]), lines.append(line)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(map(len, lines), pa.int64()), pa.array(lines, pa.string())], names=["id", "n", "sketch"])

        return each

    def of(ids: DataFrame) -> DataFrame:
        places = stage(own.select(F.col("row_id").alias("id"), "doc_id", "line_no", "line_id").join(ids, "id"), "places")
        # A document's own lines at most, so that its text is carried once.
        wanted = places.groupBy("doc_id").agg(F.collect_set(F.struct("id", "line_no", "line_id")).alias("wanted"))
        near = may_contain(texts, "doc_id", places).where("_may").join(wanted, "doc_id").select("text", "wanted").where("text is not null")
        # Of rows that repeat a doc_id only those count that hold the line.
        return by_batch(near, make, "id long, n long, sketch string").dropDuplicates(["id"])

    return of


def line_components(docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, line_no, keep_doc, keep_line, kept) for every line with words of every row of docs.

    Lines are numbered from 0 and split at line feeds. Lines that are equal once normalised are one vertex; others link
    when the Jaccard similarity of their sets of character shingles, whole lines being compared, is percent / 100 or more. Of each
    component the first line by (doc_id, line_no) is kept. Blank lines and null or empty texts have no rows; lines of a null
    doc_id have rows and come first in the order, but their only copies aren't compared with near ones; repeated rows of one
    doc_id keep the same line number twice; very long lines are compared whole; an empty table gives none; other columns
    of docs play no part.
    """
    rows = stage(line_rows(docs, width).withColumn("row_id", F.monotonically_increasing_id()), "lines")
    # The first row of a line is one whose document can be found by its id, if there is one.
    lost = F.when(F.col("doc_id").isNull(), F.lit(1 << 62)).otherwise(F.lit(0))
    first = rows.groupBy("line_id").agg(F.min(F.col("row_id") + lost).alias("first"), F.count("*").alias("copies")).withColumn("first", F.col("first").bitwiseAND(F.lit((1 << 62) - 1)))
    # Most lines have one row, which is its own first; only rows whose line may have more are shuffled to be joined.
    many = stage(first.where("copies > 1"), "many")
    flagged, columns = may_contain(rows, "line_id", many), ["row_id", "doc_id", "line_no", "line_id", "keys"]
    once = flagged.where("not _may").select(*columns, F.col("row_id").alias("first"), F.lit(1).cast("long").alias("copies"))
    more = stage(flagged.where("_may").join(many, "line_id", "left").select(*columns, F.coalesce("first", "row_id").alias("first"), F.coalesce("copies", F.lit(1)).cast("long").alias("copies")), "more")
    every = once.unionByName(more)
    own = stage(every.drop("keys"), "own")
    keys = every.where("doc_id is not null and row_id = first").select("keys", F.col("row_id").alias("id"))
    texts = line_texts(docs, own.where("row_id = first"))
    components = linked_components(keys, None, lambda lines: LineSets(lines, width, percent), texts, verifier(width, percent))
    # A line of its own, without copies or links, needs no shuffle: it keeps itself.
    linked = components.toDF("first", "component")
    flagged = may_contain(own.select("first", "doc_id", "line_no", "copies"), "first", linked)
    alone = flagged.where("copies = 1 and not _may").select("doc_id", "line_no", F.col("doc_id").alias("keep_doc"), F.col("line_no").alias("keep_line"))
    named = flagged.where("copies > 1 or _may").join(linked, "first", "left").select("doc_id", "line_no", F.coalesce("component", "first").alias("component"))
    keep = named.groupBy("component").agg(F.min(F.struct("doc_id", "line_no")).alias("keep"))
    out = named.join(keep, "component").select("doc_id", "line_no", F.col("keep.doc_id").alias("keep_doc"), F.col("keep.line_no").alias("keep_line")).unionByName(alone)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_doc")) & (F.col("line_no") == F.col("keep_line")))


def without_lines(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """docs with the lines that are not kept cut out of their texts; rows with a null doc_id stay whole."""
    name = free_name(docs, "_gone")
    gone = lines.where("not kept").groupBy("doc_id").agg(F.collect_set("line_no").alias(name))
    cut = F.array_join(F.filter(F.transform(F.split("text", "\n", -1), lambda line, k: F.when(~F.array_contains(name, k), line)), lambda x: x.isNotNull()), "\n")
    return docs.join(gone, "doc_id", "left").withColumn("text", F.when(F.col(name).isNull(), F.col("text")).otherwise(cut)).select([F.col(f"`{c}`") for c in docs.columns])


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_components(table(spark, sf_dir, "documents"))


QUERIES = {"op1_line_dedup": op1_line_dedup}
ORACLE: dict[str, str] = {}
