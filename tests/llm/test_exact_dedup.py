import hashlib
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from gridloom.llm import exact_dedup as d
from tests.llm.conftest import rows_of


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    out = Counter()
    for norm, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        out.update((i, keep, len(ids), i == keep, hashlib.sha256(norm.encode()).hexdigest()) for i in ids)
    return out


def test_against_brute_force(docs, no_docs):
    assert Counter(map(tuple, d.exact_dedup(docs).collect())) == brute(rows_of(docs))
    assert d.exact_dedup(no_docs).collect() == []


def test_bytes_settle_texts_that_share_a_digest(docs):
    weak = lambda text: F.unhex(F.substring(F.sha2(text.cast("binary"), 256), 1, 2))
    assert Counter(tuple(r)[:4] for r in d.exact_dedup(docs, weak).collect()) == Counter(r[:4] for r in brute(rows_of(docs)).elements())


def test_compaction_of_runs_and_lookup(docs):
    whole = d.compact(d.flush_runs(docs))
    old, new = docs.where("doc_id < 20"), docs.where("doc_id >= 20 or doc_id is null")
    assert sorted(map(tuple, d.compact(d.compact(d.flush_runs(old)), d.flush_runs(new)).collect())) == sorted(map(tuple, whole.collect()))
    key = hashlib.sha256(b"same text here").hexdigest()
    assert [(r["keep_id"], r["group_size"]) for r in d.lookup(whole, [key]).collect()] == [(4, 4)]


def test_stage_keeps_the_first_of_each_text(spark, docs):
    kept = d.drop_copies(spark, docs.where("doc_id is not null"), "")
    assert kept.columns == docs.columns
    assert sorted({r["doc_id"] for r in kept.collect()} & set(range(1, 8))) == [1, 3, 4, 6, 7]
