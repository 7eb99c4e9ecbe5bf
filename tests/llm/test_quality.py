import numpy as np

from gridloom.llm import quality as q


def test_em_recovers_accuracies_of_overlapping_labellers():
    rng = np.random.default_rng(0)
    n, truth = 20_000, None
    truth = rng.random(n) < 0.8
    right = np.array([0.95, 0.9, 0.85, 0.8, 0.75, 0.9, 0.7, 0.9])
    counts, own = {}, []
    for t in truth:
        v = tuple(q.NONE if rng.random() < 0.4 else int(t) if rng.random() < a else int(not t) for a in right)
        own.append(q.vote_code(v))
        counts[own[-1]] = counts.get(own[-1], 0) + 1
    posterior, chances = q.weak_labels(counts)
    assert np.mean([(posterior[c] >= 0.5) == t for c, t in zip(own, truth, strict=True)]) > 0.93
    learnt = chances[:, 1, q.HIGH] / (chances[:, 1, q.HIGH] + chances[:, 1, q.LOW])
    assert np.abs(learnt - right).max() < 0.04
    assert q.weak_labels({})[0] == {}


def test_votes():
    assert q.votes(b"") == q.votes(b" \n") == (q.NONE,) * 8
    assert q.votes(b"Of Of Of Of Of Of Of Of was. was. was. was.")[2] == q.LOW
    assert q.votes(b"TION!! TH!! NDTHNT!! ERESED!! ON!! THE!!")[:2] == (q.LOW, q.LOW)
    assert q.votes(b"ab | cd. | ef | gh, | ij | kl")[4] == q.LOW
    plain = q.votes(b"The heron was by the water and it stood there for a long while. Then it left.")
    assert q.LOW not in plain


def test_accuracy_on_labels_that_it_never_reads(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in q.op10_quality_classifier(spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert np.mean([got[r["doc_id"]]["predicted"] == r["quality"] for r in labels]) > 0.97


def test_edges_of_the_input(docs, no_docs):
    assert q.quality(no_docs).collect() == []
    got = q.quality(docs).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and len(r["votes"]) == 8 for r in got)
    assert {r["votes"] for r in got if r["doc_id"] in (1, 2, 3)} == {"2" * 8}
