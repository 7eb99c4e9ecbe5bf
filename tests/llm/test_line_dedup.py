import random

import numpy as np

from gridloom.llm import line_dedup as d
from tests.llm.conftest import SCHEMA, rows_of


def brute(rows):
    lines, first = [], {}
    for i, t in rows:
        for k, x in enumerate((t or "").split("\n")):
            if n := d.normal_line(x):
                lines.append((i, k, n))
                first.setdefault(n, len(first))
    texts = sorted(first, key=first.get)
    sets = [{x[k : k + 9] for k in range(max(1, len(x) - 8))} for x in texts]
    root = list(range(len(texts)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    links = 0
    for a in range(len(texts)):
        for b in range(a):
            if 10 * min(len(sets[a]), len(sets[b])) >= 8 * max(len(sets[a]), len(sets[b])):
                both = len(sets[a] & sets[b])
                if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    links += 1
                    root[max(find(a), find(b))] = min(find(a), find(b))
    keep = {}
    for i, k, n in lines:
        c = find(first[n])
        keep[c] = min(keep.get(c, (i, k)), (i, k), key=lambda p: (p[0] is not None, p[0] or 0, p[1]))
    return {(i, k): keep[find(first[n])] for i, k, n in lines}, links


def test_against_brute_force(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(600)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 40))) for _ in range(150)]

    def near(x):
        w = x.split()
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            w[rng.randrange(len(w))] = rng.choice(words)
        return rng.choice([str.upper, str, lambda s: "  " + s.replace(" ", "\t")])(" ".join(w))

    rows = [(i, "\n".join(near(rng.choice(base)) for _ in range(rng.randint(0, 6))) + rng.choice(["", "\n", "\n\n"])) for i in range(130)] + [(900, None), (901, ""), (902, "\n \n")]
    rows.append((903, "\n".join(near(base[0]) for _ in range(120))))
    docs = spark.createDataFrame([(i, t, None, None, 0, 0, "", "", 0) for i, t in rows], SCHEMA)
    want, links = brute(rows)
    got = d.line_components(docs).collect()
    assert len(got) == len(want) and links > 100
    same = sum(want[r["doc_id"], r["line_no"]] == (r["keep_doc"], r["keep_line"]) for r in got)
    assert same >= 0.97 * len(want)  # MinHash may miss a link at the threshold
    wrong = [r for r in got if want[r["doc_id"], r["line_no"]] > (r["keep_doc"], r["keep_line"])]
    assert not wrong
    cut = {r["doc_id"]: r["text"] for r in d.without_lines(docs, d.line_components(docs)).collect()}
    assert cut[900] is None and cut[902] == "\n \n" and len(cut) == len(rows)
    assert sum(bool(x.strip()) for t in cut.values() for x in (t or "").split("\n")) == sum(r["kept"] for r in got)


def test_edges_of_the_input(docs, no_docs):
    assert d.line_components(no_docs).collect() == []
    got = d.line_components(docs).collect()
    rows = [(i, k) for i, t in rows_of(docs) for k, x in enumerate((t or "").split("\n")) if x.split()]
    assert sorted(((r["doc_id"], r["line_no"]) for r in got), key=str) == sorted(rows, key=str)


def test_signature_agreement_estimates_similarity():
    rng = random.Random(1)
    a = "".join(rng.choice("abcdefghij ") for _ in range(400))
    b = a[:200] + a[240:]
    sig = d.signatures([a, b, "short", "short"])
    assert 0.6 < np.mean(sig[0] == sig[1]) < 1 and (sig[2] == sig[3]).all()


def test_exact_similarities():
    rng = random.Random(3)
    lines = ["".join(rng.choice("abc ") for _ in range(rng.randint(1, 60))) for _ in range(40)] + ["épée longue " * 5, "épée longue " * 4 + "épée"]
    sets, of = d.LineSets(lines, 9, 80), lambda x: {x[k : k + 9] for k in range(max(1, len(x) - 8))}
    for i in range(len(lines)):
        ok = sets(i, np.arange(len(lines)))[1]
        for j, x in enumerate(lines):
            both = len(of(lines[i]) & of(x))
            assert ok[j] == (100 * both >= 80 * (len(of(lines[i])) + len(of(x)) - both))


def test_a_large_bucket_makes_linear_rows(spark):
    from pyspark.sql import functions as F

    from gridloom.llm import near

    rows = spark.range(20_000).select("id", F.array(F.lit(7).cast("long")).alias("keys"))
    pairs, members = near.buckets(rows, spark.range(0).toDF("id"))
    assert (pairs.count(), members.count()) == (19_999, 20_000)
    # All but 30 are one component already: they meet all others, and a forest comes out.
    comps = spark.range(1, 20_000).where("id % 700 <> 5").select("id", F.lit(0).cast("long").alias("component"))
    left = near.open_buckets(members, comps)
    texts = spark.range(20_000).select("id", F.lit("one and the same line of text").alias("sketch"))
    links = near.crossing_pairs(left, texts, lambda lines: d.LineSets(lines, 9, 80), True)
    assert left.where("minor").count() < 35 and links.count() < 35 * 20


def test_only_lines_that_repeat_are_joined(spark, monkeypatch):
    rng = random.Random(6)
    line = lambda: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(12))
    same, staged, real = line(), {}, d.stage
    monkeypatch.setattr(d, "stage", lambda df, what: staged.setdefault(what, real(df, what)))
    rows = [(i, line() + ("\n" + same.upper() if i % 20 == 3 else "")) for i in range(300)] + [(None, same), (None, line())]
    got = d.line_components(spark.createDataFrame([(i, t, None, None, 0, 0, "", "", 0) for i, t in rows], SCHEMA)).collect()
    assert len(got) == 317 and {(r["keep_doc"], r["keep_line"]) for r in got if r["line_no"] == 1} == {(None, 0)}
    assert sum(r["kept"] for r in got) == 302
    assert staged["more"].count() == 16 and staged["own"].count() == 317
