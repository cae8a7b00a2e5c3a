"""The text program over whole texts, long ones too."""

from bytegrain.plans import catalog


def test_long_texts_are_decoded_by_the_program(spark, tmp_path):
    texts = ["a" * 400, "a" * 401, "é€😀x" * 500, "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in catalog.QUERIES["utf8_decode_program"](spark, str(tmp_path)).select("doc_id", "n_chars", "n_bytes").collect()}
    assert got == {(k, None if t is None else len(t), None if t is None else len(t.encode())) for k, t in enumerate(texts)}
