"""Spelling variants: words one edit apart, found by pivotal bigrams, hang on the far more frequent form."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import by_batch, drop_staged, stage, table, texts_of

#: Least code points of a word and least occurrences.
MIN_LENGTH, MIN_COUNT = 6, 5
#: A form must be so many times as frequent.
FORM_FACTOR = 5
#: Of runs, 1 in so many loses a code point (contract of the query).
DROP_ONE_IN = 199

#: In UTF-8: U+00C0 to U+00FF are C3 80 to C3 BF, and C3 begins no other character.
ASCII_RUN, RUN = re.compile(b"[a-z]{%d,}" % MIN_LENGTH), re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf]){%d,}" % MIN_LENGTH)
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def cut_one(run: bytes, at: int) -> bytes:
    """run without its code point number at."""
    text = run.decode()
    return (text[:at] + text[at + 1 :]).encode()


def words_of(doc_id: int | None, text: bytes) -> Counter:
    """Occurrences of the words of one text that are long enough; some runs lose a code point, by their id and letters."""
    text, head = text.translate(LOWER), zlib.crc32(b"%d:" % doc_id if doc_id is not None else b":")
    out: Counter = Counter()
    for run, n in Counter((ASCII_RUN if text.isascii() else RUN).findall(text)).items():
        h = zlib.crc32(run, head)
        if h % DROP_ONE_IN == 0:
            length = len(run.decode())
            if length == MIN_LENGTH:
                continue
            run = cut_one(run, h % length)
        out[run] += n
    return out


def corpus_words(docs: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) over whole texts: runs of letters of at least MIN_LENGTH code points, with A-Z lower-cased, that occur min_count times.

    A batch's counts are summed in the task before they are shuffled. Null and empty texts have no words; a null doc_id hashes
    as an empty one; repeated rows count again; an empty table gives none.
    """

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            sums: Counter = Counter()
            for i, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch.column("text")), strict=True):
                for word, n in words_of(i, text).items():
                    sums[word] += n
            words = pa.array(list(sums), pa.binary()).cast(pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array(list(sums.values()), pa.int64())], names=["word", "n"])

        return each

    parts = by_batch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, "word string, n long", slice_bytes=32 << 20)
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def gram_ranks(words: DataFrame) -> list[str]:
    """All bigrams of the words (word), rarest first, ties by the bigram. Letters are 26 and 64, so there are 8,100 at most."""
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring("word", i, F.lit(2))))
    counted = words.where(F.length("word") > 1).select(F.explode(grams).alias("gram")).groupBy("gram").agg(F.count("*").alias("c"))
    return [r["gram"] for r in counted.orderBy("c", "gram").collect()]


def disjoint_pair(places: list[int], ranks: list[int], grams: int = 2, width: int = 2) -> list[int]:
    """Of grams at ascending places, as many disjoint ones as asked with the least sum of ranks: their places.

    Dynamic programming: best[k] holds, for each prefix of the places, the cheapest choice of k disjoint grams within it.
    """
    none = (float("inf"), ())
    best = [(0.0, ())] * (len(places) + 1)
    for _ in range(grams):
        now, ends = [none], 0
        for i, (place, rank) in enumerate(zip(places, ranks, strict=True)):
            while ends < i and places[ends] + width <= place:
                ends += 1
            cost, chosen = best[ends]
            now.append(min(now[-1], (cost + rank, (*chosen, place))))
        best = now
    return list(best[-1][1])


def gram_prefix(word: str, ranks: dict[str, int]) -> tuple[int, list[int], list[int]]:
    """(rank of the last gram, places of the prefix's grams, places of the two pivots).

    One edit destroys at most two bigrams, so the three rarest make the prefix, with all occurrences of the third's gram: of
    two words within one edit, the one whose last gram is not the rarer has one of the other's pivots in its prefix.
    """
    own = sorted((ranks[word[i : i + 2]], i) for i in range(len(word) - 1))
    last = own[2][0]
    places = sorted(i for rank, i in own if rank <= last)
    return last, places, disjoint_pair(places, [ranks[word[i : i + 2]] for i in places])


def gram_index(words: DataFrame, grams: list[str]) -> DataFrame:
    """(key, size, pivot, last, letters, word, n): where a word (word, n) is found, and by which pivots it asks.

    An unharmed gram of two words one edit apart stands as far from the start in both, with all before it equal, or as far from
    the end, with all after it equal. So a gram's key is the word up to its end, or from its start on: it holds the gram, its
    position limit, and the equal side. A pivot asks at the lengths one below and above as well. letters marks which of 64
    groups of letters occur. Words have at least four code points.
    """

    def make():
        ranks = {g: k for k, g in enumerate(grams)}

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows: list[list] = [[] for _ in range(7)]
            for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True):
                last, places, pivots = gram_prefix(word, ranks)
                letters = 0
                for c in word:
                    letters |= 1 << (ord(c) % 63)
                for i in places:
                    for key in (f"{word[: i + 2]}>", f"<{word[i:]}"):
                        for size, pivot in ((len(word), False), *((len(word) + d, True) for d in (-1, 0, 1) if i in pivots)):
                            for column, value in zip(rows, (key, size, pivot, last, letters, word, n), strict=True):
                                column.append(value)
            kinds = (pa.string(), pa.int32(), pa.bool_(), pa.int32(), pa.int64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names=["key", "size", "pivot", "last", "letters", "word", "n"])

        return each

    return by_batch(words.select("word", "n"), make, "key string, size int, pivot boolean, last int, letters long, word string, n long", slice_bytes=1 << 20)


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n) for all ordered pairs of different words (word, n) that are one edit apart.

    Pivots meet the prefixes of words of no rarer last gram; letters that only one word has are two groups at most; the
    edit distance of those that are left is computed in full. The join is on equal keys, whose large partitions Spark splits.
    """
    index = stage(gram_index(words, gram_ranks(words)), "grams")
    a = index.where("pivot").select("key", "size", *[F.col(c).alias(f"{c}_a") for c in ("last", "letters", "word", "n")])
    b = index.where("not pivot").select("key", "size", *[F.col(c).alias(f"{c}_b") for c in ("last", "letters", "word", "n")])
    met = a.join(b, ["key", "size"]).where((F.col("last_b") >= F.col("last_a")) & (F.bit_count(F.col("letters_a").bitwiseXOR(F.col("letters_b"))) <= 2) & (F.col("word_a") != F.col("word_b")))
    met = met.where(F.levenshtein("word_a", "word_b", 1) == 1)
    first = F.col("word_a") < F.col("word_b")
    pairs = met.select(*[F.when(first, F.col(f"{c}_{x}")).otherwise(F.col(f"{c}_{y}")).alias(f"{c}_{x}") for x, y in (("a", "b"), ("b", "a")) for c in ("word", "n")]).distinct()
    pairs = stage(pairs, "near-words")
    drop_staged(index)
    return pairs.select(F.col("word_a").alias("word"), F.col("n_a").alias("n"), F.col("word_b").alias("near"), F.col("n_b").alias("near_n")).union(pairs.select("word_b", "n_b", "word_a", "n_a"))


def forms_to_roots(forms: DataFrame) -> DataFrame:
    """(word, root) for rows (word, form) that make a forest: pointers double each round until all end at a word without a form."""
    now = stage(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        up = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        ahead = stage(now.select("word", "root").join(up, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        drop_staged(now)
        if ahead.where("moved").isEmpty():
            return ahead.select("word", "root")
        now = ahead


def variant_groups(words: DataFrame, factor: int = FORM_FACTOR) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for words (word, n): distinct, at least four code points, n their occurrences.

    A word's form is its near word of largest n, of ties the first in code-point order, where that n is at least factor times
    its own. n grows along forms, so they end: root is the last one, the word itself if it has no form.
    """
    near = near_words(words)
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("near"))).alias("best"))
    held = words.select("word", "n").join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.col("best.near").alias("near"), (-F.col("best.minus")).alias("near_n"))
    proper = F.col("near_n") >= factor * F.col("n")
    held = stage(held.select("word", F.when(proper, F.col("near")).alias("form"), "n", "n_near", F.when(proper, F.col("near_n")).alias("form_n")), "forms")
    roots = forms_to_roots(held.where("form is not null").select("word", "form"))
    return held.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variant_groups(stage(corpus_words(table(spark, sf_dir, "documents")), "words"))


QUERIES = {"op12_spelling_variants": op12_spelling_variants}
#: SQL has no crc32 here; tests compare with brute force over all pairs.
ORACLE: dict[str, str] = {}
