"""Each stage acts on its own input, and clean documents stay."""

import random

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        assert before * 0.5 < docs.count() <= before
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() > 0
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "toxicity", "minhash_near_dedup", "suffix_array_dedup", "packing"]


def test_cut_keeps_one_row_a_row(spark):
    passage = "shared words " * 40
    rows = [(1, "a " + passage, "en", "s", 1), (1, "a " + passage, "en", "s", 1), (1, "other", "en", "s", 1), (None, passage, None, None, None), (2, None, "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.cut_repeats(spark, docs, "").collect()
    assert len(got) == 5 and sorted(r.doc_id for r in got if r.doc_id is not None) == [1, 1, 1, 2]
    assert "other" in {r.text for r in got}


def test_language_by_code_length(spark):
    rng = random.Random(3)
    bags = {"aa": "abcde", "bb": "vwxyz"}
    text = lambda lang, n=20: " ".join("".join(rng.choice(bags[lang]) for _ in range(5)) for _ in range(n))
    rows = [(i, text(k := list(bags)[i % 2]), None if i % 10 < 2 else k) for i in range(400)]
    odd = ["".join(rng.choice("0123456789ghijkmnopqrstu") for _ in range(300)), "\u042d\u0442\u043e \u0440\u0443\u0441\u0441\u043a\u0438\u0439 \u0442\u0435\u043a\u0441\u0442 " * 5, "123 456", None]
    rows += [(1000 + i, t, "aa") for i, t in enumerate(odd)]
    docs = spark.createDataFrame([(i, t, k, "s", 1) for i, t, k in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.lang for r in corpus_pipeline.identify_language(spark, docs, "").collect()}
    assert got == {i: list(bags)[i % 2] for i in range(400)}
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    kept = {r.doc_id: r.lang for r in corpus_pipeline.identify_language(spark, unlabelled, "").collect()}
    assert set(kept) == {*range(400), 1000, 1001} and set(kept.values()) == {None}
