"""One query per operator over its whole table: ``(spark, sf_dir) -> DataFrame``, and SQL where SQL can say it."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm import (
    archives,
    blob_ledger,
    bpe,
    centroids,
    collocations,
    compression_language,
    phrase_index,
    pseudo_likelihood,
    quantised,
    sharding,
    superminhash,
    toxicity,
    url_templates,
)
from shelfmark.llm.common import table
from shelfmark.llm.sql import ORACLES


def op1_content_chunk_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


def op2_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op3_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superminhash.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=2)


def op4_phrase_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_index.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_likelihood.score_documents(table(spark, sf_dir, "documents"))


def op6_int8_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantised.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archives.round_trip(table(spark, sf_dir, "pages"))


def op8_blob_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = blob_ledger.document_secrets(table(spark, sf_dir, "documents"))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(spans, 256).alias("base_sha256"),
        spans.alias("spans"),
    )


def op9_compression_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression_language.languages(table(spark, sf_dir, "documents"))


def op10_boosted_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_path_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = url_templates.judged(table(spark, sf_dir, "pages"))
    return found.select("page_id", "host", "path", "rule", "verdict", "template")


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_vectors(table(spark, sf_dir, "embeddings"))


def op13_rollup_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_content_chunk_bpe,
        op2_label_propagation,
        op3_superminhash,
        op4_phrase_index,
        op5_pseudo_likelihood,
        op6_int8_tiles,
        op7_arc_to_warc,
        op8_blob_ledger,
        op9_compression_language,
        op10_boosted_toxicity,
        op11_path_templates,
        op12_centroids,
        op13_rollup_collocations,
    )
}

__all__ = ["ORACLES", "QUERIES"]
