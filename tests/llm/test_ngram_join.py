import random

import numpy as np
import pytest

from gridloom.llm import ngram_join as j
from tests.llm.conftest import SCHEMA, rows_of


def brute(rows, width, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    root = {i: i for i in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted((i, len(sets[i]), find(i)) for i in ids)


def near_copies(rng, groups, copies, length, start):
    words = [f"w{k}" for k in range(4000)]
    out = []
    for _ in range(groups):
        base = [rng.choice(words) for _ in range(rng.randint(2, length))]
        for _ in range(rng.randint(1, copies)):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 6])):
                text[rng.randrange(len(text))] = rng.choice(words)
            out.append((start + len(out), " ".join(text)))
    return out


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80)])
def test_components_against_brute_force(spark, width, percent):
    rng = random.Random(width)
    rows = near_copies(rng, 40, 6, 300, 1000) + near_copies(rng, 2, 150, 160, 5000) + near_copies(rng, 60, 4, 24, 9000) + [(1, None), (2, ""), (3, " \n"), (4, "One"), (5, "one"), (6, "one two")]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(i, t, None, None, None, 0, "", "", 0) for i, t in rows], SCHEMA)
    got = sorted(map(tuple, j.ngram_components(docs, width, percent).collect()))
    assert got == brute(rows, width, percent)


def test_edges_of_the_input(spark, docs, no_docs):
    assert j.ngram_components(no_docs).collect() == []
    got = j.ngram_components(docs, 3, 90).collect()
    assert len(got) == len(rows_of(docs))
    assert {r["component_id"] for r in got if r["doc_id"] in (4, 5, 6)} == {4}
    assert {(r["doc_id"], r["component_id"]) for r in got if r["n_shingles"] == 0} == {(1, 1), (2, 2), (3, 3)}
    kept = j.drop_near_copies(spark, docs, "")
    assert kept.columns == docs.columns


def test_linked_sets_share_a_key():
    rng = np.random.default_rng(2)
    for percent in (80, 90):
        for size in (1, 3, 9, 10, 18, 19, 20, 60, 148, 500, 3000):
            for _ in range(12):
                a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
                most = 2 * len(a) * (100 - percent) // (100 + percent)
                gone = rng.integers(0, most // 2 + 1)
                kept = rng.permutation(a)[gone:]
                more = rng.integers(0, most - gone + 1) if most else 0
                b = np.unique(np.concatenate([kept, rng.integers(0, 2**63, more).astype(np.uint64)]))
                both = len(np.intersect1d(a, b))
                if 100 * both >= percent * (len(a) + len(b) - both):
                    assert np.intersect1d(j.piece_keys(a, percent), j.piece_keys(b, percent)).size
                    for many in (1, 4):
                        far, ok = j.Sketches([j.sketch(a), j.sketch(b)] * many, percent)(0, np.array([1]))
                        assert ok[0] and far[0] <= len(a) + len(b) - 2 * both
