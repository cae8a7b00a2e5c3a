"""The corpus pipeline: each stage reads what the one before wrote, as Parquet in the shared folder.

Every stage takes the columns of documents and ignores others, whatever their names; an empty table gives an empty one. Rows that repeat
(also a null or doubled doc_id) are documents of their own, but for the near-dedup, where rows of one doc_id stay or go together.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytegrain.llm import bpe, decontam, langid, line_dedup, simhash
from bytegrain.llm.exchange import MADE, forget, stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents in no language: null and empty texts and those without a letter. `lang` becomes the predicted language, `und` where
    nothing was learned. A null lang is not learned from."""
    model = langid.fit(docs, ~langid.held_out())
    found = langid.predict(docs.select(*COLUMNS), model, lettered=True)
    return found.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops every line whose key is found in 10 documents or more; a text of nothing else becomes empty and stays. Null texts stay null."""
    docs = docs.select(*COLUMNS)
    found = line_dedup.drop_lines(docs, line_dedup.LineIndex.build(docs, min_docs=10))
    return found.withColumn("n_chars", F.char_length("text").cast("bigint")).select(*COLUMNS)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates, that with the smallest doc_id: five-word shingles, a similarity of 0.8 or more. Null and
    empty texts are equal to each other; rows without a doc_id stay."""
    return simhash.deduplicated(docs.select(*COLUMNS), shingle=5)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold ten consecutive words of a benchmark item, or all of a shorter one; items without words match nothing, null
    and empty texts stay."""
    return decontam.decontaminated(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids of every text and `round_trip`: whether they decode to its bytes. Null and empty texts have no ids."""
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    return bpe.encoded(docs.select(*COLUMNS), path, pattern)


STAGES = [("language ID", language_id), ("line dedup", dedup_lines), ("SimHash near-dedup", dedup_near), ("benchmark decontamination", decontaminate), ("byte-level BPE", encode)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents. What a stage has written besides its result is deleted once the result stands, and so is the result before."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), len(MADE)
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
        forget(spark, before, (MADE[-1],))
    return docs
