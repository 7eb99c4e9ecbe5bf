import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridloom.llm import toxicity
from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_ngram_join import brute as near

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tmp_path):
    """Each stage on its own input: what stays is what a plain reading of the rules keeps."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, got = docs.columns, {}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "ngram_jaccard_join", "benchmark_decontamination", "best_fit_packing"]
    for name, function in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        function(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        if name == "best_fit_packing":
            assert {r["doc_id"] for r in out.collect()} == set(before)
            break
        assert out.columns == columns
        got[name] = {r["doc_id"]: r["text"] for r in out.collect()}
        if name == "toxicity":
            labels = spark.read.parquet(f"{SF}/labels.parquet")
            want = {r["doc_id"] for r in toxicity.toxicity(docs, labels).where("predicted = 0").collect()}
        elif name == "exact_dedup":
            first = {}
            for i in sorted(before):
                first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", before[i] or ""), i)
            want = set(first.values())
        elif name == "ngram_jaccard_join":
            want = {i for i, _, c in near(list(before.items()), 5, 80) if i == c}
        else:
            items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            want = {r[0] for r in leaks(list(before.items()), items) if not r[5]}
        assert set(got[name]) == want and all(before[i] == t for i, t in got[name].items())
        docs = out


def test_run_gives_the_rows_of_its_last_stage(spark):
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "piece", "length", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0


def test_filters_decide_for_each_row_whatever_its_id(spark, tmp_path, monkeypatch):
    item = " ".join(f"item{k}" for k in range(12))
    near = " ".join(f"word{k}" for k in range(200))
    spark.createDataFrame([("i", item)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    monkeypatch.setattr(toxicity, "train", lambda docs, labels: "model")
    monkeypatch.setattr(toxicity, "score", lambda docs, model: docs.select("doc_id", F.col("text").contains("toxic").cast("double").alias("score")))
    stages = dict(corpus_pipeline.STAGES)

    def kept(name, rows, kind="long"):
        docs = spark.createDataFrame(rows, f"doc_id {kind}, text string").repartition(2)
        out = stages[name](spark, docs, str(tmp_path))
        assert out.dtypes == docs.dtypes
        return sorted(map(tuple, out.collect()), key=str)

    for name, bad in (("toxicity", "a toxic text"), ("benchmark_decontamination", f"so {item} then")):
        assert kept(name, [(None, bad), (None, "clean"), (5, bad), (5, "clean too"), (6, "fine")]) == sorted([(None, "clean"), (5, "clean too"), (6, "fine")], key=str)
        assert kept(name, [(5, bad), (6, "fine")], "int") == [(6, "fine")]
    for name, a, b in (("exact_dedup", near, near.replace(" ", "  ")), ("ngram_jaccard_join", near, near + " end")):
        assert kept(name, [(None, a), (5, b), (5, "clean"), (7, a)]) == sorted([(5, b), (5, "clean")], key=str)
        assert kept(name, [(5, a), (5, a), (6, "fine")]) == [(5, a), (6, "fine")]
        assert kept(name, [(None, a), (None, a)]) == [(None, a)]
        assert kept(name, [(5, a), (6, b)], "int") == [(5, a)]


def test_keys_of_two_kinds_are_not_compared(spark):
    from gridloom.llm.common import without_ids

    with pytest.raises(ValueError, match="doc_id is"):
        without_ids(spark.createDataFrame([("5",)], "doc_id string"), spark.createDataFrame([(5,)], "doc_id long"))
