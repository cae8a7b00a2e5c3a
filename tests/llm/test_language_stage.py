"""The pipeline's first stage where no language can be learned."""

import corpus_pipeline

from .test_contracts import DOCS


def test_without_languages_only_texts_without_a_letter_go(spark):
    texts = ["some words", "Größe", None, "", "12 34 ...", "é"]
    docs = spark.createDataFrame([(k, t, None, "own", len(t or "")) for k, t in enumerate(texts)], DOCS)
    got = {r["doc_id"]: r["lang"] for r in corpus_pipeline.language_id(spark, docs, "").collect()}
    assert got == {0: "und", 1: "und", 5: "und"}
