"""Quality by weak labels: EM finds how far overlapping heuristics can be trusted, and their posterior trains a hashed scorer."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import by_batch, stage, table, texts_of

#: The scorer is fitted on at most so many documents of either posterior label, drawn by a hash of doc_id.
SAMPLE = 6_000
#: Hash space of the scorer's features.
BUCKETS = 1 << 12
#: Words that a text's shares are shrunk by.
SHRINK = 30
#: A labeller says low (0), high (1) or nothing (2).
LOW, HIGH, NONE = 0, 1, 2

_LETTERS = np.array([chr(c).isalpha() or c >= 128 for c in range(256)])
_UPPER = np.array([65 <= c <= 90 for c in range(256)])
_MARKS = np.array([chr(c) in "#*$%&!|@^~=<>\\{}[]_+" for c in range(256)])
#: For bytes.translate: a letter's or digit's kind; marks stand for themselves. Runs of one kind count once, over a word's whole length.
_KINDS = bytes(65 if _UPPER[c] else 97 if _LETTERS[c] else 48 if 48 <= c <= 57 else c for c in range(256))
_RUNS = re.compile(rb"([Aa0])\1+")
#: Words of a stretch in which variety is judged, as a long text repeats its vocabulary anyway.
STRETCH = 500

#: Fixed order of the labellers, for the columns and the vote patterns.
LABELLERS = ("marks", "capitals", "repeats", "mark_runs", "bars", "variety", "word_length", "lines")


def votes(text: bytes) -> tuple[int, ...]:
    """Each labeller's vote on a whole text; all are silent on a text without words."""
    words = text.split()
    if not words:
        return (NONE,) * len(LABELLERS)
    count = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    n, letters = len(words), int(count[_LETTERS].sum())
    marks, upper = int(count[_MARKS].sum()) / len(text), int(count[_UPPER].sum()) / max(1, letters)
    repeats = sum(map(bytes.__eq__, words, words[1:])) / max(1, n - 1)
    runs = sum(text.count(x) for x in (b"!!", b"%%", b"##", b"**", b"$$", b"&&")) / n
    bars = (int(count[124]) + int(count[9])) / n
    variety = np.mean([len(set(words[k : k + STRETCH])) / len(words[k : k + STRETCH]) for k in range(0, n, STRETCH) if k == 0 or n - k >= STRETCH])
    length = letters / n
    lines = [x for x in text.split(b"\n") if x.strip()]
    copied = 1 - len(set(lines)) / len(lines)
    cut = lambda x, low, high: LOW if x > low else HIGH if x < high else NONE
    return (
        cut(marks, 0.03, 0.01),
        cut(upper, 0.4, 0.15) if letters >= 20 else NONE,
        cut(repeats, 0.2, 0.05) if n >= 6 else NONE,
        cut(runs, 0.2, 0.02) if n >= 4 else NONE,
        LOW if bars > 0.2 and n >= 6 else NONE,
        (LOW if variety < 0.2 else HIGH if variety > 0.35 else NONE) if n >= 20 else NONE,
        HIGH if 2 <= length <= 14 else LOW,
        cut(copied, 0.5, 0.05) if len(lines) >= 4 else NONE,
    )


def vote_code(of: tuple[int, ...]) -> int:
    return sum(v * 3**k for k, v in enumerate(of))


def weak_labels(counts: dict[int, int], rounds: int = 100) -> tuple[dict[int, float], np.ndarray]:
    """Posterior of label 1 for each vote pattern, and each labeller's chances of its three votes given label 0 and 1.

    Expectation-maximisation over patterns and how often they occur, of which there are at most 3**8 whatever the number of
    documents. The prior and the chances keep a little mass on everything.
    """
    if not counts:
        return {}, np.full((len(LABELLERS), 2, 3), 1 / 3)
    codes, n = np.array(list(counts)), np.array(list(counts.values()), dtype=float)
    table = np.stack([codes // 3**k % 3 for k in range(len(LABELLERS))], axis=1)
    # It begins from a rule of thumb: any labeller that says low is more often right than not.
    p = np.where((table == LOW).any(1), 0.15, 0.9)
    chances = np.zeros((len(LABELLERS), 2, 3))
    for _ in range(rounds):
        prior = (p @ n + 1) / (n.sum() + 2)
        for j in range(len(LABELLERS)):
            for v in range(3):
                mine = n * (table[:, j] == v)
                chances[j, 1, v], chances[j, 0, v] = (mine @ p + 0.5) / (n @ p + 1.5), (mine @ (1 - p) + 0.5) / (n @ (1 - p) + 1.5)
        logs = np.log(chances)
        one = np.log(prior) + sum(logs[j, 1, table[:, j]] for j in range(len(LABELLERS)))
        zero = np.log(1 - prior) + sum(logs[j, 0, table[:, j]] for j in range(len(LABELLERS)))
        now = 1 / (1 + np.exp(np.clip(zero - one, -50, 50)))
        if np.abs(now - p).max() < 1e-9:
            break
        p = now
    return dict(zip(codes.tolist(), p.tolist(), strict=True)), chances


class Shapes(dict):
    """Hashed shape of a word: runs of capitals, letters, digits, and the marks themselves."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        shape = _RUNS.sub(rb"\1", word.translate(_KINDS))
        self[word] = value = zlib.crc32(shape) % BUCKETS
        return value


_shapes = Shapes()


def features(text: bytes) -> np.ndarray:
    """Shares of hashed word shapes and of pairs of them over a whole text, and of words that repeat the one before.

    SHRINK words more are counted than there are, so that a few words say little against the bias.
    """
    words = text.split()
    out = np.zeros(BUCKETS + 1)
    if words:
        shape = np.fromiter(map(_shapes.__getitem__, words), np.int64, len(words))
        out[:BUCKETS] = np.bincount(shape, minlength=BUCKETS) + np.bincount((shape[:-1] * 31 + shape[1:] * 17 + 7) % BUCKETS, minlength=BUCKETS)
        out[BUCKETS] = 2 * sum(map(bytes.__eq__, words, words[1:]))
        out /= len(words) + SHRINK
    return out


def fit_scorer(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 300, rate: float = 0.1, l2: float = 1e-4) -> np.ndarray:
    """Weights and, last, the bias of a logistic scorer of soft labels y, by Adam on all rows; weight: how many documents each stands for."""
    weight = weight / max(1e-9, weight.sum())
    x = np.hstack([x, np.ones((len(x), 1))])
    w, m, v = np.zeros(x.shape[1]), np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for step in range(1, steps + 1):
        grad = x.T @ (weight * (1 / (1 + np.exp(-np.clip(x @ w, -30, 30))) - y)) + l2 * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return w


def quality(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, votes, posterior, score, predicted) for every row of docs; no labels are used.

    votes has a digit a labeller: 0 low, 1 high, 2 nothing. posterior is the weak-label model's chance of high quality for that pattern, score the
    hashed scorer's for the text (0 to 1), predicted 1 if score >= 0.5. Null, empty and blank texts have no words: every labeller is
    silent, and the scorer falls back on its bias. A null doc_id is scored too; repeated rows score alike; an empty table gives none.
    Texts of any length are read whole. Ties in the drawing of the sample go by hash and id. Only doc_id and text of docs are
    read, so other columns may have any names.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def make_votes():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([vote_code(votes(t)) for t in texts_of(batch.column("text"))], pa.int32())], names=["doc_id", "code"])

        return each

    voted = stage(by_batch(rows, make_votes, "doc_id long, code int"), "votes")
    counts = {r[0]: r[1] for r in voted.groupBy("code").count().collect()}
    posterior, _ = weak_labels(counts)
    sizes = [sum(n for c, n in counts.items() if (posterior[c] >= 0.5) is side) for side in (False, True)]
    known = spark.createDataFrame(sorted(posterior.items()), "code int, posterior double")
    judged = voted.join(F.broadcast(known), "code").where("doc_id is not null")
    draw = [F.xxhash64("doc_id"), F.col("doc_id")]
    drawn = judged.where("posterior < 0.5").orderBy(*draw).limit(sample).unionByName(judged.where("posterior >= 0.5").orderBy(*draw).limit(sample))
    # At most 2 * sample ids: a fixed bound for their broadcast.
    drawn = stage(drawn.select("doc_id", "posterior").coalesce(1), "drawn")

    def make_features():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [features(t) for t in texts_of(batch.column("text"))]
            at = [np.flatnonzero(f) for f in found]
            return pa.RecordBatch.from_arrays([batch.column("posterior"), pa.array(at, pa.list_(pa.int32())), pa.array([f[k] for f, k in zip(found, at, strict=True)], pa.list_(pa.float64()))], names=["posterior", "at", "share"])

        return each

    fitted = by_batch(rows.join(F.broadcast(drawn), "doc_id").select("posterior", "text"), make_features, "posterior double, at array<int>, share array<double>").collect()
    used = np.unique(np.concatenate([np.array(r["at"], dtype=np.int64) for r in fitted] or [np.empty(0, np.int64)]))
    place = {int(k): i for i, k in enumerate(used)}
    x = np.zeros((len(fitted), len(used)), dtype=np.float32)
    for i, r in enumerate(fitted):
        x[i, [place[k] for k in r["at"]]] = r["share"]
    y = np.array([r["posterior"] for r in fitted])
    high = int((y >= 0.5).sum())
    w = fit_scorer(x, y, np.where(y >= 0.5, sizes[1] / max(1, high), sizes[0] / max(1, len(y) - high)))
    full = np.zeros(BUCKETS + 1)
    full[used] = w[:-1]
    shared = spark.sparkContext.broadcast((full, float(w[-1]), posterior))

    def make_scores():
        weights, bias, chance = shared.value

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = texts_of(batch.column("text"))
            all_votes = [votes(t) for t in texts]
            score = 1 / (1 + np.exp(-np.clip(np.array([features(t) @ weights for t in texts]) + bias, -30, 30)))
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(["".join(map(str, v)) for v in all_votes]), pa.array([chance[vote_code(v)] for v in all_votes], pa.float64()), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "votes", "posterior", "score", "predicted"])

        return each

    return by_batch(rows, make_scores, "doc_id long, votes string, posterior double, score double, predicted int")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))


QUERIES = {"op10_quality_classifier": op10_quality_classifier}
ORACLE: dict[str, str] = {}
