"""Token ids of whole texts by the tokenizers library, each distinct chunk of a batch looked up once."""

from __future__ import annotations

import os
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from gridloom.llm.common import WHITE, held

#: Chunks that the library never merges across: runs of other characters with at most one space before them, and the rest of white space, as byte-level BPE splits it.
BYTE_CHUNKS = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
#: A space beside other white space: a cut before each space would not leave whole chunks.
ODD_SPACES = f"[{WHITE}] | [{WHITE}]"
#: No byte of UTF-8, and no character of a plain chunk.
MARK, SIGN = b"\xff", "\x01"

#: Plain chunks have only ASCII without the apostrophe and control characters, and letters of Latin-1. PIECES are what the library's own pattern makes of them.
LETTERS, MARKS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff", r"!-&(-/:-@\[-`{-~"
PLAIN = f"[{LETTERS}0-9{MARKS}]"
BYTE_PLAIN, BYTE_PIECES = rf"\A ?{PLAIN}+(?:\n{PLAIN}+)*\z", rf"( ?[{LETTERS}]+| ?[0-9]+| ?[{MARKS}]+|\n)"
WORD_PLAIN, WORD_PIECES = rf"\A{PLAIN}*\z", rf"([{LETTERS}]+|[0-9]|[{MARKS}]+)"

#: Pieces that an encoder keeps, and four times the chunks.
MAX_CHUNKS = 400_000
#: Of texts that are encoded at once: the more, the fewer distinct chunks for each byte.
ENCODE_BYTES = 4 << 20


def byte_alphabet() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies: printable ones for themselves, the others from U+0100 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {b: chr(b if b in own else next(others)) for b in range(256)}


BYTE_ALPHABET = byte_alphabet()


def gather(ids: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of runs of ids that lie one after another, those numbered at, and their sizes."""
    taken = sizes[at]
    ends = np.cumsum(taken)
    first = (np.cumsum(sizes) - sizes)[at] - (ends - taken)
    return ids[np.repeat(first, taken) + np.arange(taken.sum())], taken


def run_sums(sizes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The sum of the sizes in each run between two offsets."""
    return np.diff(np.concatenate([[0], np.cumsum(sizes)])[offsets])


class Recent:
    """Runs of ids by key, those last asked for: beyond limit, half as many stay."""

    def __init__(self, limit: int):
        self.limit, self.turn = limit, 0
        self.keys, self.ids = pa.array([], pa.large_binary()), np.empty(0, np.uint32)
        self.sizes, self.used = np.empty(0, np.int64), np.empty(0, np.int64)

    def get(self, keys: pa.Array, make: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct keys, one after another, and the size of each; make gives those of the keys that are not kept."""
        if len(self.keys) > self.limit:
            stay = np.sort(np.argsort(-self.used, kind="stable")[: self.limit // 2])
            self.ids, self.sizes = gather(self.ids, self.sizes, stay)
            self.keys, self.used = self.keys.take(pa.array(stay)), self.used[stay]
        self.turn += 1
        at = pc.index_in(keys, value_set=self.keys).fill_null(-1).to_numpy().astype(np.int64)
        new = np.flatnonzero(at < 0)
        if len(new):
            lost = keys.take(pa.array(new))
            ids, sizes = make(lost)
            at[new] = len(self.keys) + np.arange(len(new))
            self.keys, self.ids = pa.concat_arrays([self.keys, lost]), np.concatenate([self.ids, ids])
            self.sizes, self.used = np.concatenate([self.sizes, sizes]), np.concatenate([self.used, np.zeros(len(new), np.int64)])
        self.used[at] = self.turn
        return gather(self.ids, self.sizes, at)


class ChunkEncoder:
    """Token ids as the library gives them for whole texts; null is empty.

    The library splits a text at white space before it merges, so a text's ids are those of its chunks one after another.
    Strings of special tokens in a text count as ordinary text. A plain chunk is split further, into what the library's
    pattern makes of it, and each piece goes to the library's model; any other chunk goes through the library as it is. The
    ids of recent chunks and pieces are kept; how many changes the speed and never the result.
    """

    def __init__(self, path: str, max_cached: int = MAX_CHUNKS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        # Vocabularies whose tokens end with words fold case and drop white space.
        self.by_word = self.tokenizer.normalizer is not None
        # More chunks than these cost as much to look up as they save.
        self.chunks, self.pieces = Recent(max_cached // 4), Recent(max_cached)

    def cut(self, texts: pa.Array) -> pa.Array:
        """The chunks of each text, in UTF-8. What lies between two spaces may hold more than one chunk: no merge crosses its ends either."""
        texts = texts.cast(pa.large_string()).fill_null("")
        cut = texts.cast(pa.large_binary())
        if self.by_word:
            return pc.split_pattern(pc.replace_substring(cut, b"\n", b" "), b" ")
        cut = pc.replace_substring(cut, b" ", MARK + b" ")
        odd = pc.match_substring_regex(texts, ODD_SPACES)
        if pc.any(odd).as_py():
            other = [MARK.join(x.encode() for x in BYTE_CHUNKS.findall(text)) for text in texts.filter(odd).to_pylist()]
            cut = pc.replace_with_mask(cut, odd, pa.array(other, pa.large_binary()))
        return pc.split_pattern(cut, MARK)

    def piece_ids(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """By the library's model, which takes the characters that stand for bytes."""
        text = MARK.join(pieces.to_numpy(zero_copy_only=False)).decode("latin-1").translate(BYTE_ALPHABET)
        tokenize, ids, sizes = self.model.tokenize, [], []
        for piece in text.split(BYTE_ALPHABET[MARK[0]]):
            found = tokenize(piece)
            sizes.append(len(found))
            ids += [token.id for token in found]
        return np.array(ids, np.uint32), np.array(sizes, np.int64)

    def plain_ids(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        signed = pc.replace_substring_regex(pc.utf8_lower(chunks) if self.by_word else chunks, WORD_PIECES if self.by_word else BYTE_PIECES, SIGN + r"\1")
        # Each piece follows a sign, so each chunk begins with an empty one.
        pieces = pc.split_pattern(signed.cast(pa.large_binary()), SIGN.encode())
        coded = pieces.flatten().dictionary_encode()
        ids, sizes = gather(*self.pieces.get(coded.dictionary, self.piece_ids), coded.indices.to_numpy())
        return ids, run_sums(sizes, pieces.offsets.to_numpy())

    def other_ids(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        ids, sizes, texts = [], [], chunks.to_pylist()
        for i in range(0, len(texts), 8192):
            for x in self.tokenizer.encode_batch_fast(texts[i : i + 8192], add_special_tokens=False):
                found = x.ids
                sizes.append(len(found))
                ids += found
        return np.array(ids, np.uint32), np.array(sizes, np.int64)

    def chunk_ids(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = chunks.cast(pa.large_string())
        plain = pc.match_substring_regex(texts, WORD_PLAIN if self.by_word else BYTE_PLAIN)
        (a, n), (b, m) = self.plain_ids(texts.filter(plain)), self.other_ids(texts.filter(pc.invert(plain)))
        # Both kinds go back to their places.
        at = np.argsort(np.argsort(~plain.to_numpy(zero_copy_only=False), kind="stable"), kind="stable")
        return gather(np.concatenate([a, b]), np.concatenate([n, m]), at)

    def encode_column(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with end_id after it, and where each text's begin and the last one's end."""
        chunks = self.cut(texts)
        coded = chunks.flatten().dictionary_encode()
        ids, sizes = gather(*self.chunks.get(coded.dictionary, self.chunk_ids), coded.indices.to_numpy())
        ends = np.cumsum([0, *run_sums(sizes, chunks.offsets.to_numpy())])
        return (ids, ends) if end_id is None else (np.insert(ids, ends[1:], end_id), ends + np.arange(len(ends)))

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit bytes."""
        ids, ends = self.encode_column(pa.array(texts, pa.large_string()))
        return [ids[a:b].astype("<u4").tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]


def encoder(path: str, max_chunks: int = MAX_CHUNKS) -> ChunkEncoder:
    """One for each worker process and vocabulary, while its tasks encode. Spark runs as many workers as there are cores, so the library gets one thread each."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return held(("encoder", path, max_chunks), lambda: ChunkEncoder(path, max_chunks))
