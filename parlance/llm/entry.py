"""Queries of this package for __spark_entry__."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm import decontamination, infill, jaccard, language, licenses, lines, packing, periodic, secrets, sharding, tokencounts, topk, toxicity
from parlance.llm.common import with_ids
from parlance.llm.oracles import ORACLES  # noqa: F401
from parlance.session import table

def vocabulary(name: str) -> str:
    """File of a tokenizer's vocabulary; the operators take it as a parameter, and it is no part of this repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    out = toxicity.score(docs, model, ["doc_id"])
    return out.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted", F.size("offending").cast("long").alias("n_offending"), F.to_json("offending").alias("offending"))


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantised(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, topk.every_fiftieth(vectors), 5)


def op4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.deduplicate(with_ids(table(spark, sf_dir, "documents"), "doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.array_join("removed", ",").alias("removed"), F.octet_length("text").cast("long").alias("bytes"), F.crc32("text").alias("text_crc32"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "start", "n_words", F.round("similarity", 6).alias("similarity"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(sharding.shard(table(spark, sf_dir, "documents")))


def op7_tokencounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencounts.count_edited(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json")))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op11_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = language.identify(docs, language.fit(docs))
    return out.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score", F.to_json("spans").alias("spans"))


def op12_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.digest(infill.transform(table(spark, sf_dir, "documents")))


def op13_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digest(periodic.find(table(spark, sf_dir, "documents"), change=periodic.planted))


QUERIES = {
    "op1_licenses": op1_licenses,
    "op2_toxicity": op2_toxicity,
    "op3_topk": op3_topk,
    "op4_lines": op4_lines,
    "op5_decontamination": op5_decontamination,
    "op6_sharding": op6_sharding,
    "op7_tokencounts": op7_tokencounts,
    "op8_packing": op8_packing,
    "op9_secrets": op9_secrets,
    "op10_jaccard": op10_jaccard,
    "op11_language": op11_language,
    "op12_infill": op12_infill,
    "op13_periodic": op13_periodic,
}
