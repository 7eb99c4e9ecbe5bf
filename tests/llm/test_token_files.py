import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from gridloom.llm import token_files as t
from gridloom.llm.tokens import ChunkEncoder
from tests.llm.conftest import rows_of

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_round_trip(spark, docs, tmp_path):
    path = f"{tmp_path}/ids"
    t.write_token_files(docs, path, PATH)
    coder = Tokenizer.from_file(PATH)
    coder.encode_special_tokens = True
    at, want = 0, []
    for i, text in sorted(rows_of(docs), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = np.array([*coder.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    got = sorted(map(tuple, t.token_index(spark, path).collect()), key=lambda r: r[1])
    assert got == want
    back = t.read_token_files(spark, path).orderBy("position").collect()
    assert [(r["doc_id"], zlib.crc32(np.array(r["ids"], "<u4").tobytes())) for r in back] == [(w[0], w[3]) for w in want]
    assert t.read_token_files(spark, path).where("doc_id = 105").count() == 1


def test_empty_table(spark, no_docs, tmp_path):
    t.write_token_files(no_docs, f"{tmp_path}/none", PATH)
    assert t.token_index(spark, f"{tmp_path}/none").collect() == []


def test_chunks_never_change_ids():
    rng = __import__("random").Random(1)
    marks = [" ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", " ", "　", "​", "a", "B's", "'", "İ", "Σ", "é", "é", "1", "！", "😀", "<|endoftext|>", "\x00"]
    texts = ["".join(rng.choice(marks) for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        coder = Tokenizer.from_file(public_tokenizers.path(name))
        coder.encode_special_tokens = True
        want = [np.array(e.ids, "<u4").tobytes() for e in coder.encode_batch(texts, add_special_tokens=False)]
        assert ChunkEncoder(public_tokenizers.path(name), max_cached=500).encode(texts) == want


def test_plain_chunks_are_split_as_the_library_splits_them():
    chars = [chr(c) for c in (*range(0x250), *range(0x2B0, 0x380), *range(0x1E00, 0x1F00), *range(0x2000, 0x2070), 0x212A, 0x212B, 0xFB01, 0xFEFF, 0xFFFD, 0x1F600)]
    rng = __import__("random").Random(2)
    texts = [form.replace("_", c) for c in chars for form in ("_", "a_b", "É_ß", "one _", "_ 2", "3_,\nNext", "don't_", "a\n_")]
    plain = [" ", " ", "\n", "  ", " \n", "\n ", "The", "élan", "ÀÉ", "ß", "12", "3", ".", ",", "!!", "(", "'s", "'", "×", "ª", "ÿ", "\x01", "\x7f", "H̱", "K", "<|endoftext|>"]
    texts += ["".join(rng.choice(plain) for _ in range(rng.randint(0, 12))) for _ in range(4000)]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        path = public_tokenizers.path(name)
        coder = Tokenizer.from_file(path)
        coder.encode_special_tokens = True
        want = [np.array(e.ids, "<u4").tobytes() for e in coder.encode_batch(texts, add_special_tokens=False)]
        for kept in (3, 400_000):
            one = ChunkEncoder(path, max_cached=kept)
            assert one.encode(texts[:900]) + one.encode(texts[900:]) == want


def test_words_with_signs_ask_the_library_for_each_word_once():
    class Counted:
        def __init__(self, inner):
            self.inner, self.asked = inner, 0

        def encode_batch_fast(self, texts, **options):
            self.asked += len(texts)
            return self.inner.encode_batch_fast(texts, **options)

        def tokenize(self, text):
            self.asked += 1
            return self.inner.tokenize(text)

    words, signs = [chr(97 + k) * 3 + "ing" for k in range(20)], [chr(c) * n for c in b".,;:!?" for n in (1, 2, 3)]
    texts = [f" {w}{s}" for w in words for s in signs]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        coder = ChunkEncoder(public_tokenizers.path(name))
        coder.tokenizer = Counted(coder.tokenizer)
        coder.model = Counted(getattr(coder, "model", None))
        coder.encode(texts)
        # Two more for what lies before the first space and before the first piece.
        assert coder.tokenizer.asked + coder.model.asked <= len(words) + len(signs) + 2
