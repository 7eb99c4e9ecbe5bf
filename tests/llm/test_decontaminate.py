import hashlib
import re

from gridloom.llm import decontaminate as d
from tests.llm.conftest import rows_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def brute(rows, items):
    wins = []
    for item, text in items:
        w = WORD.findall(lower(text))
        if w and item is not None:
            wins += [(str(item), w[k : k + 10]) for k in range(max(1, len(w) - 9))]
    out = []
    for i, t in rows:
        words, hit, who = WORD.findall(lower(t)), set(), set()
        for item, w in wins:
            for k in range(len(words) - len(w) + 1):
                if words[k : k + len(w)] == w:
                    hit.update(range(k, k + len(w)))
                    who.add(item)
        out.append((i, len(words), len(hit), len(who), hashlib.sha256(",".join(sorted(who)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def test_against_brute_force(spark, docs, no_docs):
    rows = rows_of(docs)
    short = [r for r in rows if len(r[1] or "") < 2000]
    some = [t for _, t in short if t and len(t.split()) > 30]
    items = [(10, " ".join(some[0].split()[3:17]).upper()), (9, " ".join(some[0].split()[8:20])), (9, "two words"), (11, some[1]), (12, some[1]), (13, None), (14, "!!"), (None, some[2]), (15, "word"), (16, "beta beta beta")]
    table = spark.createDataFrame(items, "item_id long, text string")
    few = docs.where("text is null or length(text) < 2000")
    for size in (d.ITEM_BYTES, 40):
        got = d.decontaminate(few, table, item_bytes=size).collect()
        assert sorted([tuple(r)[:6] for r in got], key=str) == brute(short, items)
    spans = next(r for r in got if r["n_hit"] > 10)
    text = next(t for i, t in short if i == spans["doc_id"])
    assert sum(len(WORD.findall(lower(text[s["start"] : s["end"]]))) for s in spans["spans"]) == spans["n_hit"]
    assert d.decontaminate(no_docs, table).collect() == []
    assert d.decontaminate(docs, table.limit(0)).where("contaminated").count() == 0
    long = d.decontaminate(docs, spark.createDataFrame([(1, " ".join(next(t for i, t in rows if i == 9).split()[20_000:20_012]))], "item_id long, text string"))
    assert [r["doc_id"] for r in long.where("contaminated").collect()] == [9]
