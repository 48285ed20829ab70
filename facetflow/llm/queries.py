"""The registered queries of this subpackage: each applies its operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from facetflow.llm import counting, divergence, langid, lexical, media, minhash, packing, pieces, prefixes, secrets, substring, toxicity, vectors
from facetflow.llm.common import id_hash_mod, table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), spark)


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.read_features(media.store_texts(table(spark, sf_dir, "documents")))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", (id_hash_mod("doc_id", 4) == 2).alias("held_out"), "score", "predicted")


def op5_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return substring.digest(docs, substring.find(docs, spark))


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.range_join(table(spark, sf_dir, "embeddings"), spark)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counting.count_tokens(table(spark, sf_dir, "documents"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), spark)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.predict(docs, langid.fit(docs))
    return found.select("doc_id", (id_hash_mod("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = lexical.build_index(table(spark, sf_dir, "documents"), spark)
    return lexical.search(index, table(spark, sf_dir, "benchmark"), spark)


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"), spark)


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.digest(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_packing, op2_media, op3_sentencepiece, op4_toxicity, op5_substring, op6_embeddings, op7_token_counts, op8_minhash, op9_secrets, op10_language, op11_lexical, op12_divergence, op13_byte_bpe)}


def oracle_sql() -> dict[str, str]:
    return {"op5_substring": substring.SQL, "op6_embeddings": vectors.SQL, "op11_lexical": lexical.SQL, "op12_divergence": divergence.SQL}
