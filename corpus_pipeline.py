"""A training-data pipeline over the documents table: five stages, each calling one operator.

Language ID drops what it rejects, toxicity drops what scores one half or more, SimHash keeps one document of each
group, mixing leaves documents out or repeats them to meet the sources' targets, and BPE turns the mix into ids. Models
are learned from the whole tables of ``sf_dir``, so a stage decides alike whatever stood before it; the stages
themselves work on all rows of their predecessor.

Texts that are null, empty or without letters are rejected by language ID. Equal texts, repeated rows too, become one document: the one with
the smallest id, a null id counting as the largest. Null sources are a source of their own. An empty table stays empty in
every stage; columns beside doc_id, text and source are carried along up to the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, langid, mixing, simhash, toxicity
from tidemark.llm.common import staged, table

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs, langid.fit(table(spark, sf_dir, "documents")))


def toxic_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_representatives(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids): a document that the mix repeats stays repeated."""
    return bpe.encode(docs, VOCABULARY)


STAGES = [
    ("language_id", language_id),
    ("toxicity", toxic_language),
    ("simhash_near_dedup", near_duplicates),
    ("source_mix", source_mix),
    ("bpe", token_ids),
]

#: Learned models have no SQL form: the tests check each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
