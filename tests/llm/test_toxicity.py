import random
import zlib

import numpy as np

from gridloom.llm import toxicity as t
from tests.llm.conftest import SCHEMA


def corpus(rng, n):
    words = ["".join(rng.choice("abcdefghijk") for _ in range(rng.randint(2, 8))) for _ in range(2000)]
    bad = ["vilest", "grobiankopf"]
    out = []
    for i in range(n):
        toxic = rng.random() < 0.15
        text = [rng.choice(words) for _ in range(rng.randint(5, 80))]
        for _ in range(rng.randint(1, 4) if toxic else 0):
            text.insert(rng.randrange(len(text)), rng.choice(bad) + rng.choice(["", "en", "es", "."]))
        out.append((i, " ".join(text), int(toxic)))
    return out


def test_held_out_accuracy(spark):
    rows = corpus(random.Random(3), 1500)
    docs = spark.createDataFrame([(i, x, "en", "s", 0, 0, "", "", 0) for i, x, _ in rows], SCHEMA)
    labels = spark.createDataFrame([(i, y, 1) for i, _, y in rows if i % 3], "doc_id long, toxic int, text long")
    got = {r["doc_id"]: r for r in t.toxicity(docs, labels).collect()}
    assert len(got) == len(rows)
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    held = [(got[i]["predicted"], y) for i, _, y in rows if got[i]["held_out"]]
    assert np.mean([a == b for a, b in held]) > 0.95
    assert sum(a for a, b in held if b) > 0.9 * sum(b for _, b in held)


def test_edges_of_the_input(spark, docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (9, None)], "doc_id long, toxic int")
    assert t.toxicity(no_docs, labels).collect() == []
    for some in (labels, labels.limit(0)):
        got = t.toxicity(docs, some).collect()
        assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)


def test_risk_stays_non_negative_for_unlabelled_positives():
    rng = np.random.default_rng(1)
    sample = lambda n, p: [np.flatnonzero(rng.random(40) < np.where(np.arange(40) < 5, p, 0.2)) for _ in range(n)]
    positive, unlabelled = sample(200, 0.7), sample(180, 0.7) + sample(720, 0.02)
    w, b = t.fit_nnpu(positive, unlabelled, 40, 0.2)
    z = [b + w[x].sum() for x in unlabelled]
    assert np.mean(np.array(z[:180]) > 0) > 0.9 and np.mean(np.array(z[180:]) > 0) < 0.05
