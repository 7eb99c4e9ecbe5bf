"""Jaccard join of word n-grams by parity sketches: XOR into bits, pigeonhole on pieces of them, verify whole sets."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import by_batch, drop_staged, list_array, may_contain, row_keyed, stage, table, texts_of, without_rows
from gridloom.llm.near import linked_components

#: Bits of the narrowest sketch.
LEAST_BITS = 1024
#: Sizes of a band differ by this factor at most.
BAND = 1.5
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)


class WordHashes(dict):
    """64-bit hashes of words, kept for a task's next texts; anew beyond a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value



def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingles(text: bytes, width: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word n-grams; of its whole sequence if that is shorter; none without words."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    own = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width_now = min(width, len(words))
    total = np.full(len(words) - width_now + 1, np.uint64(width_now), np.uint64)
    for k in range(width_now):
        total += own[k : len(words) - width_now + 1 + k] * _ODD[k]
    return np.unique(mix(total))


@lru_cache(8)
def bands(percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least size, pieces, and pieces that make keys, of each size band, up to sizes of 2**40.

    Linked sets differ in at most (a + b) * (100 - percent) / (100 + percent) members, and so in as many pieces. Pieces with no
    member say nothing, so there are as many more pieces as are likely to be empty. The pieces that two sets share are
    then more than these spare ones; the first that they share, in one order for all sets, is no set's last spare one. So
    each set leaves its last spare pieces out, and linked sets still share a key.
    """
    lows = [1]
    while lows[-1] < 1 << 40:
        lows.append(max(lows[-1] + 1, math.ceil(lows[-1] * BAND)))
    pieces, needed = [], []
    for low, high in zip(lows, lows[1:], strict=False):
        most = high - 1
        differ = (most + most * 100 // percent) * (100 - percent) // (100 + percent)
        spare = 0
        for _ in range(12 if differ else 0):
            expect = (differ + 1 + spare) * math.exp(-low / (differ + 1 + spare))
            spare = int(expect + 3 * math.sqrt(expect))
        pieces.append(differ + 1 + spare)
        needed.append(differ + 1)
    return np.array(lows), np.array(pieces), np.array(needed)


def piece_keys(h: np.ndarray, percent: int) -> np.ndarray:
    """64-bit keys of pieces of the parity sketch of a set, in its own size band and in the one below if a partner may be there.

    A piece is a parity vector with a bit for each 64-bit value, of which the key has the XOR of its members. The order of
    pieces is: those with members by their key, then empty ones by place.
    """
    lows, pieces, needed = bands(percent)
    band = int(np.searchsorted(lows, len(h), "right")) - 1
    out = []
    for b in (band, band - 1):
        if b < 0 or b < band and len(h) * percent > 100 * (int(lows[band]) - 1):
            continue
        count, keep = int(pieces[b]), int(needed[b])
        place = ((h >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32)
        starts = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        at, salt = place[starts], np.uint64(b * int(_ODD[1]) % (1 << 64))
        keys = mix(np.bitwise_xor.reduceat(h, starts) + mix(at * _ODD[0] + salt))
        if len(keys) > keep:
            keys = np.partition(keys, keep - 1)[:keep]
        elif len(keys) < keep:
            empty = np.setdiff1d(np.arange(count, dtype=np.uint64), at)[: keep - len(keys)]
            keys = np.concatenate([keys, mix(mix(empty * _ODD[0] + salt))])
        out.append(keys)
    return np.concatenate(out).view(np.int64)


def sketch(h: np.ndarray) -> bytes:
    """The size of the set, and a parity sketch of two bits or more a member: sets that differ widely have about half of the bits different, which is more than linked sets may have."""
    bits = 1 << max(LEAST_BITS.bit_length() - 1, min(20, math.ceil(math.log2(2 * len(h) + 1))))
    return np.int64(len(h)).tobytes() + np.packbits(np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1).tobytes()


def fold(sketch: np.ndarray, words: int) -> np.ndarray:
    """A sketch of fewer words: halves are XORed, which keeps the bound."""
    while sketch.shape[-1] > words:
        half = sketch.shape[-1] // 2
        sketch = sketch[..., :half] ^ sketch[..., half:]
    return sketch


class Sketches:
    """Hamming distances of sketches, lower bounds of symmetric differences, against what linked sets may differ in.

    All are folded to the narrowest, as members of a bucket are of like sizes.
    """

    def __init__(self, sketches: list[bytes], percent: int):
        self.n, self.percent = np.array([int.from_bytes(s[:8], "little") for s in sketches]), percent
        words = min(len(s) // 8 - 1 for s in sketches)
        self.bits = np.stack([fold(np.frombuffer(s, np.uint64, offset=8), words) for s in sketches])

    def __call__(self, i: int, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, m = self.n[i], self.n[others]
        fit = 100 * np.minimum(n, m) >= self.percent * np.maximum(n, m)
        far, own = np.full(len(others), 1 << 30, np.int64), np.flatnonzero(fit)
        far[own] = np.bitwise_count(self.bits[others[own]] ^ self.bits[i]).sum(axis=1, dtype=np.int64)
        return far, far <= (n + m) * (100 - self.percent) // (100 + self.percent)


def signatures(docs: DataFrame, width: int, percent: int) -> DataFrame:
    def make():
        hashes = WordHashes()

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            sizes, sets, sketches, keys = [], [], [], []
            for text in texts_of(batch.column("text")):
                h = shingles(text, width, hashes)
                sizes.append(len(h))
                sets.append(xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None)
                sketches.append(sketch(h))
                keys.append(piece_keys(h, percent) if len(h) else np.empty(0, np.int64))
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(sets, pa.binary()), pa.array(sketches, pa.binary()), list_array(keys, pa.int64())], names=["doc_id", "n_shingles", "set_id", "sketch", "keys"])

        return each

    return by_batch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, "doc_id long, n_shingles long, set_id binary, sketch binary, keys array<long>")


def verifier(width: int, percent: int):
    """Pairs (x, y) of ids with ok: whether their whole sets, from texts (id, text), reach the similarity."""

    def make():
        kept: dict[int, np.ndarray] = {}
        hashes = WordHashes()

        def of(i: int, text: bytes) -> np.ndarray:
            if i not in kept:
                if len(kept) > 64:
                    kept.clear()
                kept[i] = shingles(text, width, hashes)
            return kept[i]

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            ok = []
            for x, y, a, b in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), texts_of(batch.column("text_x")), texts_of(batch.column("text_y")), strict=True):
                p, q = of(x, a), of(y, b)
                both = len(np.intersect1d(p, q, assume_unique=True))
                ok.append(100 * both >= percent * (len(p) + len(q) - both))
            return pa.RecordBatch.from_arrays([batch.column("x"), batch.column("y"), pa.array(ok, pa.bool_())], names=["x", "y", "ok"])

        return each

    def verify(pairs: DataFrame, near: DataFrame) -> DataFrame:
        whole = pairs.join(near.toDF("x", "text_x"), "x").join(near.toDF("y", "text_y"), "y").select("x", "y", "text_x", "text_y").sortWithinPartitions("x")
        return by_batch(whole, make, "x long, y long, ok boolean")

    return verify


def ngram_components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs: its links' component, named by its smallest doc_id.

    Words are runs of other bytes than ASCII white space, with A-Z in lower case; a set holds a text's distinct n-grams of
    width words, as 64-bit hashes. Two rows link at a Jaccard similarity of percent / 100 or more. Equal sets are one vertex.
    Texts without words and null texts are empty sets that link with nothing: component_id is their doc_id. Rows that repeat
    a doc_id are compared each by its own text. A null doc_id names a component only where all of its ids are null. Very long
    texts are compared whole. An empty table gives none; other columns of docs play no part.
    """
    keyed, row = row_keyed(docs.select("doc_id", "text"))
    found = row_components(keyed.select(F.col(row).alias("doc_id"), "text"), width, percent)
    if not hasattr(keyed, "staged_path"):
        return found
    # Row numbers follow the order of doc_id, so the smallest row of a component has its smallest doc_id.
    own, first = keyed.select(F.col(row).alias("r"), F.col("doc_id").cast("long").alias("doc_id")), keyed.select(F.col(row).alias("c"), F.col("doc_id").cast("long").alias("component_id"))
    out = found.select(F.col("doc_id").alias("r"), "n_shingles", F.col("component_id").alias("c"))
    return out.join(own, "r").join(first, "c").select("doc_id", "n_shingles", "component_id")


def row_components(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """As ngram_components, of docs whose doc_id is a long without nulls or repeats."""
    rows = stage(signatures(docs, width, percent), "signatures")
    first = rows.where("n_shingles > 0").groupBy("set_id").agg(F.min("doc_id").alias("first"))
    own = stage(rows.select("doc_id", "n_shingles", "set_id").join(first, "set_id", "left").select("doc_id", "n_shingles", "first"), "own")
    full, copies = rows.where("n_shingles > 0"), own.where("doc_id <> first").select(F.col("doc_id").alias("id"))
    keys, sketches = full.select("keys", F.col("doc_id").alias("id")), full.select(F.col("doc_id").alias("id"), "sketch")
    own_texts = docs.select(F.col("doc_id").alias("id"), "text")

    def texts(ids: DataFrame) -> DataFrame:
        # ids are distinct. A semi join would be moved below the join with the bit map, and shuffle all texts.
        return may_contain(own_texts, "id", ids).where("_may").join(ids, "id").select("id", "text")

    components = linked_components(keys, copies, lambda sketches: Sketches(sketches, percent), texts, verifier(width, percent), sketches)
    drop_staged(rows)
    out = own.join(components.toDF("first", "component"), "first", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "first", "doc_id").alias("component_id"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component of five-word shingles at 0.8 one row stays, as in exact dedup."""
    keyed, row = row_keyed(docs)
    found = stage(row_components(keyed.select(F.col(row).alias("doc_id"), "text"), 5, 80).where("doc_id <> component_id").select("doc_id"), "near")
    return without_rows(keyed, row, found, docs.columns)


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents"), width=3, percent=90)


QUERIES = {"op6_ngram_jaccard_join": op6_ngram_jaccard_join}
ORACLE: dict[str, str] = {}
