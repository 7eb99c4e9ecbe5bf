"""Benchmark decontamination: one Aho-Corasick automaton over the word windows of the items, each text scanned once."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import WORD_TABLE, by_batch, held, row_keyed, stage, table, texts_of, without_rows

WINDOW = 10
#: Bytes of item texts that one automaton takes, as many as fit in a worker; only beyond that there are more automata, and an exact scan of the texts for each.
ITEM_BYTES = 32 << 20
WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<struct<start:int,end:int>>"
FOUND = "hits array<int>, items array<string>"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_TABLE).split()


class Windows:
    """The automaton of the items' windows over numbers of words; a word that no item has is 0."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        import ahocorasick

        self.number: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            ids = [self.number.setdefault(w, len(self.number) + 1) for w in words_of(text)]
            for k in range(max(1, len(ids) - window + 1)) if ids else ():
                owners.setdefault(tuple(ids[k : k + window]), set()).add(item)
        self.shortest = min(map(len, owners), default=0)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, who in owners.items():
            self.automaton.add_word(key, (len(key), sorted(who)))
        if owners:
            self.automaton.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[list[int], set[str]]:
        """Word ranges that windows cover, as a flat list of begins and ends in order and apart, and the items they are of."""
        get, hits, items = self.number.get, [], set()
        if not self.shortest or len(words) < self.shortest:
            return hits, items
        found = [(end + 1 - n, end + 1, who) for end, (n, who) in self.automaton.iter(tuple([get(w, 0) for w in words]))]
        for begin, end, who in sorted(found):
            items.update(who)
            if hits and begin <= hits[-1]:
                hits[-1] = max(hits[-1], end)
            else:
                hits += [begin, end]
        return hits, items


def _windows(shared: object, window: int) -> Windows:
    return held(("windows", shared, window), lambda: Windows(shared.value, window))


def _merged(ranges: list[int]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for begin, end in sorted(zip(ranges[::2], ranges[1::2], strict=True)):
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((begin, end))
    return out


def _report(doc_id: int | None, text: bytes, words: int, hits: list[int], items: set[str]) -> tuple:
    ranges, spans = _merged(hits), []
    if ranges:
        places = [m.span() for m in WORDS.finditer(re.sub("[A-Z]", lambda m: m[0].lower(), text.decode()))]
        spans = [{"start": places[a][0], "end": places[b - 1][1]} for a, b in ranges]
    listed = ",".join(sorted(items))
    return doc_id, words, sum(b - a for a, b in ranges), len(items), hashlib.sha256(listed.encode()).hexdigest(), bool(ranges), spans


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans) for every row of docs.

    spans are the hit words' places in the original text, in code points. Items are dealt into parts of about item_bytes;
    one part is the usual case, and the texts are scanned once. Null texts have no words; null items and items without
    words have no windows; items of the same text all count; repeated rows are reported each; an empty table gives none. Texts of
    any length are scanned whole. Only doc_id and text of docs are read, so other columns may have any names.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.encode("text", "utf-8").alias("text")).where("item is not null and text is not null")
    parts = int((items.agg(F.sum(F.length("text"))).first()[0] or 0) // item_bytes) + 1
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def scan(of: DataFrame, part: int, last: bool) -> DataFrame:
        own = items.where(F.pmod(F.xxhash64("item"), F.lit(parts)) == part).collect()
        shared = spark.sparkContext.broadcast([(r[0], bytes(r[1])) for r in own])

        def make():
            windows = _windows(shared, window)

            def each(batch: pa.RecordBatch) -> pa.RecordBatch:
                doc_ids, texts = batch.column("doc_id").to_pylist(), texts_of(batch.column("text"))
                before = list(zip(batch.column("hits").to_pylist(), batch.column("items").to_pylist(), strict=True)) if part else [((), ())] * len(texts)
                out = []
                for doc_id, text, (hits, known) in zip(doc_ids, texts, before, strict=True):
                    now, new = windows.scan(words := words_of(text))
                    out.append(_report(doc_id, text, len(words), [*hits, *now], new.union(known)) if last else ([*hits, *now], [*known, *new]))
                cols = list(zip(*out, strict=True))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))] if last else [pa.list_(pa.int32()), pa.list_(pa.string())]
                kept = [] if last else [batch.column("doc_id"), batch.column("text")]
                names = [x.split()[0] for x in (RESULT.replace("struct<start:int,end:int>", "struct") if last else f"doc_id long, text string, {FOUND}").split(", ")]
                return pa.RecordBatch.from_arrays([*kept, *(pa.array(x, kind) for x, kind in zip(cols, kinds, strict=True))], names=names)

            return each

        return by_batch(of, make, RESULT if last else f"doc_id long, text string, {FOUND}")

    for part in range(parts - 1):
        rows = stage(scan(rows, part, False), "scanned")
    return scan(rows, parts - 1, True)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: rows with any benchmark window go, whatever their doc_id."""
    keyed, row = row_keyed(docs)
    found = decontaminate(keyed.select(F.col(row).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return without_rows(keyed, row, stage(found.where("contaminated").select("doc_id"), "contaminated"), docs.columns)


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op9_benchmark_decontamination": op9_benchmark_decontamination}
ORACLE: dict[str, str] = {}
