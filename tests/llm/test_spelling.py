import random
import re
import zlib
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridloom.llm import spelling as s
from tests.llm.conftest import rows_of


def words_brute(rows, least=5):
    out = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 6 and n >= least}


def edits(w):
    """All strings one edit from w, over the letters that can occur, as patterns with one hole."""
    return {w[:i] + "\0" + w[i:] for i in range(len(w) + 1)}, {w[:i] + "\0" + w[i + 1 :] for i in range(len(w))}


def groups_brute(words):
    holes = {}
    for w in words:
        added, replaced = edits(w)
        for h in added:
            holes.setdefault(h, set()).add((w, 0))
        for h in replaced:
            holes.setdefault(h, set()).add((w, 1))
    near = {w: set() for w in words}
    for found in holes.values():
        whole = {w for w, k in found if k}
        for w, _ in found:
            near[w] |= whole - {w}
        for w in whole:
            near[w] |= {x for x, _ in found} - {w}
    out = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        out[w] = best if best is not None and words[best] >= 5 * n else None
    rows = set()
    for w, n in words.items():
        root = w
        while out[root] is not None:
            root = out[root]
        rows.add((w, out[w], root, n, len(near[w]), words[out[w]] if out[w] else None))
    return rows


def test_words_of_texts(docs, no_docs):
    rows = rows_of(docs) + [(k, " ".join(["naïveté", "ÉCOLEs", "naïvete", "Ünderåge", "wörter×÷", "plain", "Letters"] * 3) + "x" * 30) for k in range(900)]
    spark = docs.sparkSession
    held = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"word": F.lit(1), "n": F.lit("x")})
    assert {r["word"]: r["n"] for r in s.corpus_words(held).collect()} == words_brute(rows)
    assert s.corpus_words(no_docs).collect() == [] and s.variant_groups(s.corpus_words(no_docs)).collect() == []


def test_groups_against_brute_force(spark):
    rng = random.Random(3)
    roots = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(6, 9))) for _ in range(120)] + ["aaaaaa", "aaaaaaa", "abababab", "babababa", "abababa"]
    words = {}
    for w in roots:
        words[w] = rng.randint(5, 5000)
        for _ in range(6):
            k, c = rng.randrange(len(w)), rng.choice("abcdeéß")
            v = rng.choice([w[:k] + w[k + 1 :], w[:k] + c + w[k:], w[:k] + c + w[k + 1 :]])
            if len(v) >= 6:
                words[v] = rng.choice([5, 7, 25, 125, 625])
                w = v
    got = s.variant_groups(spark.createDataFrame(list(words.items()), "word string, n long"))
    assert {tuple(r) for r in got.select("word", "form", "root", "n", "n_near", "form_n").collect()} == groups_brute(words)


@settings(max_examples=400, deadline=None)
@given(st.text("abc", min_size=6, max_size=9), st.integers(0, 8), st.sampled_from("abc"), st.integers(0, 2), st.permutations([a + b for a in "abc" for b in "abc"]))
def test_pivots_never_miss_an_edit(word, at, letter, kind, order):
    """For any order of the grams, two words one edit apart share a key of one's pivot and the other's prefix."""
    at %= len(word)
    other = (word[:at] + word[at + 1 :], word[:at] + letter + word[at:], word[:at] + letter + word[at + 1 :])[kind]
    if other == word or len(other) < 6:
        return
    ranks = {g: k for k, g in enumerate(order)}

    def keys(w):
        last, places, pivots = s.gram_prefix(w, ranks)
        assert len(pivots) == 2 and pivots[1] - pivots[0] >= 2 and set(pivots) <= set(places)
        return last, *({k for i in at for k in (w[: i + 2] + ">", "<" + w[i:])} for at in (places, pivots))

    (last_a, pre_a, piv_a), (last_b, pre_b, piv_b) = keys(word), keys(other)
    assert (last_b >= last_a and piv_a & pre_b) or (last_a >= last_b and piv_b & pre_a)


def test_disjoint_pair_is_the_cheapest():
    rng = random.Random(4)
    for _ in range(300):
        places = sorted(rng.sample(range(12), rng.randint(3, 8)))
        ranks = [rng.randrange(100) for _ in places]
        all_pairs = [(ranks[a] + ranks[b]) for a in range(len(places)) for b in range(a) if places[a] - places[b] >= 2]
        chosen = s.disjoint_pair(places, ranks)
        assert sum(ranks[places.index(p)] for p in chosen) == min(all_pairs)


def test_roots_of_long_chains(spark):
    forms = spark.createDataFrame([(f"w{k:03d}", f"w{k + 1:03d}") for k in range(40)] + [("x", "w039")], "word string, form string")
    assert {tuple(r) for r in s.forms_to_roots(forms).collect()} == {(f"w{k:03d}", "w040") for k in range(40)} | {("x", "w040")}


def test_query_on_the_smallest_tables(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {tuple(r) for r in s.op12_spelling_variants(spark, sf).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    assert got == groups_brute(words_brute(rows)) and any(r[1] for r in got)
