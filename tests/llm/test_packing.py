import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from gridloom.llm import packing as p
from tests.llm.conftest import rows_of

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(rows, size):
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    return len(by)


def test_pieces_and_places(docs, no_docs):
    coder = Tokenizer.from_file(PATH)
    coder.encode_special_tokens = True
    want = []
    for i, text in rows_of(docs):
        ids = [*coder.encode(text or "", add_special_tokens=False).ids, 0]
        want += [(i, k, 64 * k, len(part := ids[64 * k : 64 * k + 64]), zlib.crc32(np.array(part, "<u4").tobytes())) for k in range(-(-len(ids) // 64))]
    rows = p.pack_documents(docs, PATH, size=64).collect()
    assert sorted([tuple(r)[:5] for r in rows], key=str) == sorted(want, key=str)
    total = sum(r["length"] for r in rows)
    assert check(rows, 64) <= -(-total // 64) * 1.03 + 1
    assert p.pack_documents(no_docs, PATH).collect() == []
    ids = p.pack_documents(docs.limit(5), PATH, with_ids=True).collect()
    assert all(len(r["ids"]) == r["length"] for r in ids)


def test_plan_uses_every_length_and_exact_complements():
    rng = np.random.default_rng(3)
    for size in (8, 64, 2048):
        for _ in range(20):
            counts = {int(x): int(n) for x, n in zip(rng.integers(1, size + 1, 60), rng.integers(0, 90, 60), strict=True)}
            plan = p.plan_sequences(counts, size)
            used = defaultdict(int)
            for n, kinds in plan:
                assert n > 0 and sum(x * k for x, k in kinds) <= size
                for x, k in kinds:
                    used[x] += n * k
            assert dict(used) == {x: n for x, n in counts.items() if n}
            assert len(plan) < 8 * size
    assert sorted(p.plan_sequences({3: 2, 5: 1, 2: 2, 4: 2, 8: 1}, 8), key=str) == sorted([(1, ((8, 1),)), (1, ((5, 1), (3, 1))), (1, ((4, 2),)), (1, ((3, 1), (2, 2)))], key=str)


def test_pieces_do_not_depend_on_the_chunks_kept(docs):
    few, many = (sorted(map(tuple, p.cut_pieces(docs, PATH, 64, max_chunks=n).collect()), key=str) for n in (3, 400_000))
    assert few == many


def test_pieces_at_multiples_of_the_size(spark):
    words = [0, 1, 6, 7, 8, 14, 15, 16, 23, 24]
    docs = spark.createDataFrame([(k, " ".join(["one"] * n) if n else None) for k, n in enumerate(words)], "doc_id long, text string").coalesce(1)
    rows = sorted(map(tuple, p.cut_pieces(docs, PATH, 8, with_ids=True).collect()))
    one = Tokenizer.from_file(PATH).encode("one", add_special_tokens=False).ids
    want = []
    for k, n in enumerate(words):
        ids = [*one * n, 0]
        want += [(k, i, 8 * i, len(part := ids[8 * i : 8 * i + 8]), zlib.crc32(np.array(part, "<u4").tobytes()), part) for i in range(-(-len(ids) // 8))]
    assert rows == want


def test_words_of_any_case_and_signs_ask_the_library_once():
    from gridloom.llm.tokens import ChunkEncoder

    class Counted:
        def __init__(self, inner):
            self.inner, self.asked = inner, 0

        def encode_batch_fast(self, texts, **options):
            self.asked += len(texts)
            return self.inner.encode_batch_fast(texts, **options)

        def tokenize(self, text):
            self.asked += 1
            return self.inner.tokenize(text)

    words, signs = [chr(97 + k) * 3 + "é" for k in range(20)], ".,;:!?"
    coder = ChunkEncoder(PATH)
    coder.tokenizer, coder.model = Counted(coder.tokenizer), Counted(getattr(coder, "model", None))
    coder.encode([f"{form}{s}" for w in words for form in (w, w.upper(), w.title()) for s in signs])
    assert coder.tokenizer.asked + coder.model.asked <= len(words) + len(signs) + 1
