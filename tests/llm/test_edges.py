"""Null and repeated ids, columns with clashing names, texts longer than a slice: fingerprints, languages, repeats and tokens."""

import hashlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from bytegrain.llm import bpe, langid, queries, recompress, simhash
from bytegrain.llm.text import SLICE_BYTES

LONG = " ".join(f"word{k % 40_000} and{k % 7}" for k in range(200_000))
ROWS = [(None, "a b c d e"), (1, LONG), (1, "a b c d e"), (2, ""), (3, None), (4, LONG + " tail"), (5, "a b c d e"), (5, "a b c d e")]
CLASH = ("fp", "component_id", "bucket", "blob", "kind", "ids", "lang_pred", "score", "_kept", "node", "root", "key", "sig", "h", "n_words", "decoded")


@pytest.fixture(scope="module")
def docs(spark):
    assert len(LONG) > SLICE_BYTES
    frame = spark.createDataFrame(ROWS, "doc_id bigint, text string").withColumn("lang", F.when(F.col("doc_id") > 3, "fr").otherwise("en"))
    return frame.withColumns({c: F.lit("x") for c in CLASH}).repartition(2)


def test_fingerprints(docs):
    got = simhash.near_duplicates(docs, 3, 3, simhash.choices(3, 2)).collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append((r["fp"], r["component_id"]))
    assert len(got) == len(ROWS) and by[5][0] == by[5][1]
    assert by[2] == by[3] == [(0, 2)]
    assert {c for _, c in by[None]} == {c for f, c in by[5]} == {1} and (by[None][0][0], 1) in by[1]


def test_near_duplicates_keep_rows_of_a_kept_id(docs):
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns
    # 5 and the row without an id equal a row of 1; 4 is near the other row of 1; 2 and 3 have no words
    assert sorted((r["doc_id"] or 0, len(r["text"] or "")) for r in kept.collect()) == [(0, 9), (1, 9), (1, len(LONG)), (2, 0)]


def test_languages(docs):
    model = langid.fit(docs, F.lit(True))
    got = langid.predict(docs, model).collect()
    assert len(got) == len(ROWS) and {r["lang_pred"] for r in got if not r["text"]} == {"und"} and {r["lang_pred"] for r in got if r["text"]} <= {"en", "fr"}
    assert langid.fit(docs.limit(0), F.lit(True)).families == []


def test_repeats(docs):
    got = recompress.remove_repeats(docs, 5).collect()
    of = {}
    for r in got:
        of.setdefault(r["doc_id"], []).append(r)
    assert len(got) == len(ROWS)
    assert [r["n_removed"] for r in of[1]] == [0, 0] and of[None][0]["n_removed"] == 0  # rows of one id, and of none, lose nothing to each other
    assert [r["n_removed"] for r in of[5]] == [5, 5] and of[2][0]["n_words"] == of[3][0]["n_words"] == 0
    assert of[4][0]["n_words"] == 400_001 and of[4][0]["n_removed"] == 400_000 and of[4][0]["text"] == "tail"


def test_tokens(docs):
    path = public_tokenizers.path(queries.TOKENS)
    got = bpe.decode(bpe.encode(docs, path, public_tokenizers.PATTERN), path, public_tokenizers.PATTERN).collect()
    want = sorted(hashlib.sha256((t or "").encode()).hexdigest() for _, t in ROWS)
    assert sorted(hashlib.sha256(bytes(r["decoded"])).hexdigest() for r in got) == want
    assert sorted(len(r["ids"]) for r in got)[:2] == [0, 0]
