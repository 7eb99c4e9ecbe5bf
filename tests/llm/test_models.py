"""The learnt parts against enumeration, finite differences and other solvers, and what files hold beside their rows."""

import itertools
import random

import numpy as np
import public_tokenizers
import pytest

from gridloom.llm import line_dedup, pii, quality, token_files, toxicity

N = len(pii.LABELS)


def sequences(length):
    """All label sequences that the field allows."""
    for y in itertools.product(range(N), repeat=length):
        if pii.LABELS[y[0]][0] != "I" and all(pii.ALLOWED[a][b] for a, b in zip(y, y[1:], strict=False)):
            yield y


def score_of(row, y, w, trans):
    return sum(w[f, k] for fs, k in zip(row, y, strict=True) for f in fs) + sum(trans[a, b] for a, b in zip(y, y[1:], strict=False))


def test_viterbi_finds_the_best_of_all_sequences():
    rng = np.random.default_rng(5)
    rows = [pii.token_features(pii.TOKENS.findall(t)) for t in ("a @ b", "call +1 2", "x", "3 . 4 . 5"[:5], "in a 9 b")]
    for _ in range(4):
        w, trans = rng.normal(size=(pii.BUCKETS + 1, N)), rng.normal(size=(N, N))
        for row, got in zip(rows, pii.viterbi(rows, (w, trans)), strict=True):
            best = max(score_of(row, y, w, trans) for y in sequences(len(row)))
            assert abs(score_of(row, got, w, trans) - best) < 1e-9 and tuple(got) in set(sequences(len(row)))


def test_the_first_step_of_the_field_follows_the_gradient_of_its_likelihood():
    """Adam's first step is the rate times the gradient's sign; the gradient is counted over all label sequences."""
    lines = ["x <email a @ b>", "<phone +1 2> y", "in <ip 3> z"]
    w, trans = pii.train_crf(lines, steps=1, rate=0.1, l2=0.0)
    g_trans, g_bias = np.zeros((N, N)), np.zeros(N)
    for line in lines:
        tokens, gold = pii.parse_labelled(line)
        every = list(sequences(len(tokens)))
        for y, share in [(gold, -1.0), *((y, 1 / len(every)) for y in every)]:
            for a, b in zip(y, y[1:], strict=False):
                g_trans[a, b] += share
            for k in y:
                g_bias[k] += share
    for value, grad in ((trans, g_trans / 3), (w[pii.BUCKETS], g_bias / 3)):
        sure = np.abs(grad) > 1e-6
        assert sure.any() and np.allclose(value[sure], -0.1 * np.sign(grad[sure]), atol=1e-3)


def risk(w, b, positive, unlabelled, prior):
    z = lambda rows: np.clip([b + w[r].sum() for r in rows], -toxicity.CAP, toxicity.CAP)
    plus, minus, other = (np.mean(np.logaddexp(0, x)) for x in (-z(positive), z(positive), z(unlabelled)))
    return prior * plus + max(0.0, other - prior * minus)


def test_the_first_step_of_the_risk_follows_its_gradient():
    rng = np.random.default_rng(2)
    positive, unlabelled = [np.flatnonzero(rng.random(12) < 0.5) for _ in range(9)], [np.flatnonzero(rng.random(12) < 0.3) for _ in range(14)]
    prior, rate = 0.2, 0.05
    w, b = toxicity.fit_nnpu(positive, unlabelled, 12, prior, steps=1, rate=rate, l2=0.0)
    at, h = np.append(np.zeros(12), np.log(prior / (1 - prior))), 1e-5
    for k in range(13):
        up, down = at.copy(), at.copy()
        up[k] += h
        down[k] -= h
        grad = (risk(up[:-1], up[-1], positive, unlabelled, prior) - risk(down[:-1], down[-1], positive, unlabelled, prior)) / (2 * h)
        moved = np.append(w, b)[k] - at[k]
        assert abs(grad) < 1e-7 or abs(moved + rate * np.sign(grad)) < 1e-3


def test_more_steps_lower_the_risk():
    rng = np.random.default_rng(3)
    sample = lambda n, p: [np.flatnonzero(rng.random(20) < np.where(np.arange(20) < 4, p, 0.2)) for _ in range(n)]
    positive, unlabelled = sample(60, 0.7), sample(30, 0.7) + sample(170, 0.03)
    risks = [risk(*toxicity.fit_nnpu(positive, unlabelled, 20, 0.15, steps=s, l2=0.0), positive, unlabelled, 0.15) for s in (1, 20, 150)]
    assert risks[0] > risks[1] > risks[2] >= 0


def test_the_scorer_reaches_newtons_solution():
    rng = np.random.default_rng(4)
    x, y, weight = rng.normal(size=(80, 5)), rng.random(80), rng.random(80)
    l2, got = 1e-2, quality.fit_scorer(x, y, weight, steps=4000, rate=0.02, l2=1e-2)
    a, p, w = np.hstack([x, np.ones((80, 1))]), weight / weight.sum(), np.zeros(6)
    for _ in range(50):
        s = 1 / (1 + np.exp(-a @ w))
        w = w - np.linalg.solve((a.T * (p * s * (1 - s))) @ a + l2 * np.eye(6), a.T @ (p * (s - y)) + l2 * w)
    assert np.abs(got - w).max() < 1e-2


def jaccard(a, b, width=line_dedup.SHINGLE):
    x, y = ({t[i : i + width] for i in range(max(1, len(t) - width + 1))} for t in (a, b))
    return len(x & y) / len(x | y)


@pytest.mark.parametrize("low,high", [(30, 80), (80, 200), (200, 900)])
def test_bands_find_similar_lines_of_every_length(low, high):
    """Pairs of a similarity of 0.8 to 0.9: at least 0.99 of them share a band."""
    rng = random.Random(low)
    pairs = []
    while len(pairs) < 1200:
        a = "".join(rng.choice("abcdefghij klmnop") for _ in range(rng.randint(low, high)))
        b = list(a)
        for _ in range(max(1, len(a) // 120)):
            place = rng.choice([rng.randrange(len(b)), rng.randrange(4), len(b) - 1 - rng.randrange(4)])
            b[place] = rng.choice("xyz") if rng.random() < 0.7 else ""
        b = "".join(b)
        if 0.8 <= jaccard(a, b) <= 0.9:
            pairs.append((a, b))
    one, two = (line_dedup.signatures([p[k] for p in pairs]).reshape(len(pairs), line_dedup.BANDS, line_dedup.ROWS) for k in (0, 1))
    assert (one == two).all(axis=2).any(axis=1).mean() >= 0.99


def test_orc_files_hold_stripes_indexes_and_filters_that_skip_rows(spark, tmp_path):
    docs = spark.range(0, 30_000, numPartitions=4).selectExpr("id * 3 as doc_id", "concat('word ', id, ' and more') as text")
    path = str(tmp_path / "ids")
    token_files.write_token_files(docs, path, public_tokenizers.path("byte_bpe_50k.json"))
    orc, hadoop = spark._jvm.org.apache.orc, spark._jvm.org.apache.hadoop.fs.Path
    kinds, rows = set(), 0
    for file in sorted((tmp_path / "ids").glob("*.orc")):
        reader = orc.OrcFile.createReader(hadoop(str(file)), orc.OrcFile.readerOptions(spark._jsc.hadoopConfiguration()))
        rows += reader.getNumberOfRows()
        records = reader.rows()
        for stripe in reader.getStripes():
            footer = records.readStripeFooter(stripe)
            kinds |= {(s.getColumn(), s.getKind().toString()) for s in footer.getStreamsList()}
            encodings = {footer.getColumns(k).getKind().toString() for k in range(1, footer.getColumnsCount())}
            assert encodings == {"DIRECT_V2"}  # run-length encoded integers
        records.close()
        reader.close()
    assert rows == 30_000 and (1, "BLOOM_FILTER_UTF8") in kinds and {(k, "ROW_INDEX") for k in range(1, 5)} <= kinds
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for wanted, most in ((3 * 17_000, 2_000), (3 * 17_000 + 1, 2_000)):
            one = token_files.read_token_files(spark, path).where(f"doc_id = {wanted}")
            assert len(one.collect()) == (wanted % 3 == 0)
            leaf = one._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
            assert leaf.metrics().apply("numOutputRows").value() <= most
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
