"""From raw documents to packed training sequences.

Five stages, each over all that the one before kept, stored in between in the shared folder: documents
whose language is known; one document of each group of near duplicates; texts without the passages that
other documents brought before; texts without secrets; pieces of documents in packed sequences.

Defined results, as the operators state them: rows with null or empty texts go in the first stage, as no
language is known; rows without a doc_id are kept and take no part in what compares documents; of rows with
equal doc_id and text one is left; an empty table gives no pieces; texts of any length are handled whole;
other columns, whatever their names, are passed through to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from facetflow.llm import langid, minhash, packing, secrets, substring
from facetflow.operators.tables import discard, scope, stored


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the character models know; rejected ones go."""
    return langid.keep_known(docs, langid.fit(docs))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near duplicates."""
    return minhash.keep_one(docs, spark)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words that repeated windows cover; those of which nothing is left go."""
    return substring.clean(docs, substring.find(docs, spark))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark."""
    return secrets.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences along the space-filling curve."""
    return packing.pack_documents(docs, spark)


STAGES = [
    ("language", known_language),
    ("near_duplicates", without_near_duplicates),
    ("substrings", without_repeats),
    ("secrets", without_secrets),
    ("packing", packed),
]

#: Character models and tokenizers are beyond SQL; tests hold the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        if k + 1 == len(STAGES):
            return stage(spark, docs, sf_dir)
        before = docs
        with scope(spark) as keep:  # what a stage stores for itself goes with it
            docs = keep(stored(stage(spark, docs, sf_dir), f"stage-{name}"))
        discard(before)
    return docs
