"""Each registered query over its whole smallest table: its columns, and a row a document or what its contract says."""

import pytest
from pyspark.sql import functions as F

from assayer.llm import queries

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op2_packing": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    "op3_vector_search": ["query_id", "rank", "vec_id", "score"],
    "op4_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op5_suffix_array": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op6_hyper_minhash": ["doc_id", "n_shingles", "component_id", "kept"],
    "op7_substring_index": ["doc_id", "n_words", "n_removed", "kept_sha256"],
    "op8_token_counts": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
    "op9_fingerprints": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    "op11_positional_index": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    "op12_whitening": ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
    "op13_hard_negatives": ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"],
    "op10_byte_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
}


@pytest.mark.parametrize("name", list(COLUMNS))
def test_query(spark, name):
    got = queries.QUERIES[name](spark, SF)
    assert got.columns[: len(COLUMNS[name])] == COLUMNS[name]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = got.toPandas()
    if name == "op3_vector_search":
        assert rows["rank"].min() == 1 and rows["rank"].max() == 20
    elif name == "op13_hard_negatives":
        assert rows["rank"].min() == 1 and rows["rank"].max() == 10 and (30 * rows["positive_score"] <= 100 * rows["negative_score"]).all()
    elif name == "op12_whitening":
        assert rows.groupby("vec_id").size().eq(8).all() and rows["identity_error"].max() < 1e-4
    elif name == "op2_packing":
        assert rows.groupby("doc_id")["length"].sum().to_dict() == rows.groupby("doc_id")["doc_tokens"].first().to_dict() and rows["doc_id"].nunique() == docs.count()
    else:
        assert sorted(rows["doc_id"]) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    if name == "op4_language_id":
        labelled = docs.where("lang IS NOT NULL").select("doc_id", "lang").toPandas().merge(rows[rows["held_out"]], on="doc_id")
        assert (labelled["lang"] == labelled["lang_pred"]).mean() > 0.95
    if name == "op1_toxicity":
        assert rows["score"].between(0, 1).all() and ((rows["score"] >= 0.5) == (rows["predicted"] == 1)).all()


def test_pipeline_runs_as_its_stages(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
    packed = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
    assert packed.agg(F.max("length")).first()[0] <= 1024
