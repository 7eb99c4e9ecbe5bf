"""Toxicity by non-negative positive-unlabelled learning: a numpy scorer from confirmed toxic texts and unlabelled ones."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import WORD_TABLE, by_batch, list_array, row_keyed, stage, table, texts_of, without_rows

#: The classifier is fitted on at most so many confirmed toxic and so many unlabelled documents, drawn by a hash of doc_id; it scores all.
POSITIVES, UNLABELLED = 6_000, 18_000
#: Features that the scorer keeps, and the hash space that they come from.
FEATURES, BUCKETS = 8_192, 1 << 26
#: Standard errors between a feature's shares that it takes.
CLEAR = 5.0
#: Scores beyond this, either way, cost no more.
CAP = 6.0
#: Leading letters of a word that are features of their own, as endings vary.
STEMS = (4, 5, 6)


def word_features(word: bytes) -> list[int]:
    """Hashed features of a word in lower case: the word, and its stems of a few lengths."""
    out = [zlib.crc32(word) % BUCKETS]
    if len(word) > STEMS[0]:
        letters = word.decode()
        out += [zlib.crc32(b"^" + letters[:k].encode()) % BUCKETS for k in STEMS if len(letters) > k]
    return out


def words_of(text: bytes) -> set[bytes]:
    """Distinct words of a text in lower case; other letters than A-Z keep their case only if lower() finds none."""
    return set(text.decode().lower().encode().translate(WORD_TABLE).split())


def fold(doc_id: str = "doc_id") -> F.Column:
    """crc32 of the id as text, modulo 5; rows of remainder 0 are held out."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5


def _extract(texts: DataFrame, known: np.ndarray | None) -> DataFrame:
    """(positive, features): all hashed features of each text, or places in known of those that are there."""
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast(known)

    def make():
        place = None if shared.value is None else {int(f): k for k, f in enumerate(shared.value)}

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for text in texts_of(batch.column("text")):
                found = {f for w in words_of(text) for f in word_features(w)}
                rows.append(np.array(sorted(found) if place is None else sorted(place[f] for f in found if f in place), dtype=np.int32))
            return pa.RecordBatch.from_arrays([batch.column("positive"), list_array(rows, pa.int32())], names=["positive", "features"])

        return each

    return by_batch(texts, make, "positive boolean, features array<int>")


def fit_nnpu(positive: list[np.ndarray], unlabelled: list[np.ndarray], size: int, prior: float, steps: int = 400, rate: float = 0.05, l2: float = 2e-5, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear scorer of binary features, by the non-negative risk estimator of PU learning.

    The risk is prior * R(positive, +) + max(0, R(unlabelled, -) - prior * R(positive, -)) with the logistic loss of scores cut
    off at CAP: with an unbounded loss a few sure positives would outweigh all else in the second part, and the bias
    would rise to make up for it. Where that part is negative, the step climbs out of it, so that unlabelled positives
    are not fitted as negatives.
    """
    rows = [*positive, *unlabelled]
    ends = np.cumsum([0, *map(len, rows)])
    index, owner = (np.concatenate(rows).astype(np.int64) if rows else np.empty(0, np.int64)), np.repeat(np.arange(len(rows)), np.diff(ends))
    is_p = np.arange(len(rows)) < len(positive)
    n_p, n_u = max(1, len(positive)), max(1, len(unlabelled))
    w, b = np.zeros(size), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, steps + 1):
        z = np.bincount(owner, w[index], minlength=len(rows)) + b
        cut, live = np.clip(z, -CAP, CAP), np.abs(z) < CAP
        sig = 1 / (1 + np.exp(-cut))
        minus = np.logaddexp(0, cut)
        rest = minus[~is_p].sum() / n_u - prior * minus[is_p].sum() / n_p
        slope = np.where(is_p, -prior * sig / n_p, sig / n_u) * (1 if rest >= 0 else -1)
        slope = np.where(live, slope + np.where(is_p, prior * (sig - 1) / n_p, 0), 0)
        grad = np.append(np.bincount(index, slope[owner], minlength=size) + l2 * w, slope.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        w, b = w - move[:-1], b - move[-1]
    return w, float(b)


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED, keep: int = FEATURES) -> tuple[np.ndarray, np.ndarray, float]:
    """(features, weights, bias), learnt from labelled rows outside the held-out fold.

    The class prior is the share of label 1 there. Positives are rows labelled 1; unlabelled are texts of the same fold
    without regard to labels. Features are those whose share among positives exceeds that among unlabelled texts most clearly.
    """
    spark = docs.sparkSession
    seen = labels.where("toxic is not null and doc_id is not null").where(fold() != 0)
    total, ones = seen.agg(F.count("*"), F.sum(F.col("toxic").cast("long"))).first()
    prior = min(0.9, max(1e-4, (ones or 0) / total)) if total else 0.05
    draw = F.xxhash64("doc_id")
    p = seen.where("toxic = 1").select("doc_id").distinct().orderBy(draw, "doc_id").limit(positives).withColumn("positive", F.lit(True))
    u = docs.where("doc_id is not null").where(fold() != 0).select("doc_id").orderBy(draw, "doc_id").limit(unlabelled).distinct().withColumn("positive", F.lit(False))
    # At most positives + unlabelled ids, so their broadcast has a fixed bound.
    drawn = stage(p.unionByName(u).coalesce(1), "drawn")
    texts = stage(docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select("positive", "text"), "sample")
    shares = _extract(texts, None).select("positive", F.explode("features").alias("f")).groupBy("f").agg(F.count(F.when(F.col("positive"), 1)).alias("p"), F.count(F.when(~F.col("positive"), 1)).alias("u"))
    sizes = {r[0]: r[1] for r in texts.groupBy("positive").count().collect()}
    n_p, n_u = max(1, sizes.get(True, 0)), max(1, sizes.get(False, 0))
    a, c = (F.col("p") + 0.1) / (n_p + 1), (F.col("u") + 0.5) / (n_u + 1)
    # By how many standard errors the shares differ; a feature of one or two documents of a small sample says nothing.
    clear = (a - c) / F.sqrt(c * (1 - c) * (1.0 / n_p + 1.0 / n_u))
    best = shares.where((F.col("p") >= 2) & (a > 1.5 * c) & (clear >= CLEAR)).orderBy(clear.desc(), "f").limit(keep).select("f")
    known = np.array([r[0] for r in best.collect()], dtype=np.int64)
    rows = _extract(texts, known).collect()
    by = {k: [np.array(r["features"], dtype=np.int64) for r in rows if r["positive"] is k] for k in (True, False)}
    w, b = fit_nnpu(by[True], by[False], len(known), prior)
    return known, w, b


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float]) -> DataFrame:
    """(doc_id, score) of every whole text; null and empty texts get the score of no features."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        known, w, b = shared.value
        weight = dict(zip(known.tolist(), w.tolist(), strict=True))
        cache: dict[bytes, tuple[int, ...]] = {}

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            if len(cache) > 200_000:
                cache.clear()
            for text in texts_of(batch.column("text")):
                found: set[int] = set()
                words = words_of(text)
                for word in words.difference(cache):
                    cache[word] = tuple(f for f in word_features(word) if f in weight)
                for hit in filter(None, map(cache.__getitem__, words)):
                    found.update(hit)
                out.append(1 / (1 + np.exp(-np.clip(b + sum(weight[f] for f in sorted(found)), -30, 30))))
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.float64())], names=["doc_id", "score"])

        return each

    return by_batch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs.

    Labels are learnt only where crc32(doc_id) mod 5 is not 0; scores come from the text alone. Without labels or without
    positives the score is the prior's. Null text scores as empty; a null doc_id is not held out; repeated rows score alike;
    an empty table gives none. Texts of any length are read whole, in batches bounded by bytes. Ties in the drawing of the sample
    and among features go by hash and id, and by feature. Only doc_id and text of docs are read, so other columns may have any names.
    """
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: rows predicted toxic go, whatever their doc_id."""
    keyed, row = row_keyed(docs)
    found = score(keyed.select(F.col(row).alias("doc_id"), "text"), train(docs, table(spark, sf_dir, "labels")))
    return without_rows(keyed, row, stage(found.where("score >= 0.5").select("doc_id"), "toxic"), docs.columns)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op3_toxicity": op3_toxicity}
ORACLE: dict[str, str] = {}
