"""A training-data pipeline: five stages over ``documents``, each reading what the one before kept.

Toxic documents go, one of each group of near copies stays, documents that hold
benchmark passages go, secrets are blanked out, and the last stage encodes the texts.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm import blob_ledger, bpe, phrase_index, superminhash, toxicity
from shelfmark.llm.common import saved, table
from shelfmark.sources import storage

#: Words of a shingle of the near-duplicate stage, and the similarity in percent from which documents are linked.
SHINGLE_WORDS = 5
PERCENT = 80
#: Column of the numbers of a stage's rows.
ROW = "__row"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below the rejection threshold; rows stay where they are."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    score = "__score"
    return toxicity.with_score(docs, model, score).where(F.col(score) < toxicity.REJECT).drop(score)


def _numbered(docs: DataFrame) -> DataFrame:
    """The rows with a number of their own, so that a decision is on a row, whatever its doc_id.

    The number is the row's place in its part of the written table, the same each time that is read.
    """
    return docs.withColumn(ROW, F.monotonically_increasing_id())


def _as_documents(rows: DataFrame) -> DataFrame:
    return rows.select(F.col(ROW).alias("doc_id"), "text")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that with the smallest doc_id, one without doc_id only where all have none.

    Of equal rows one stays, also of those without doc_id; rows that share a doc_id but not the text are
    different documents. Empty and null texts are copies of nothing.
    """
    rows = _numbered(docs)
    parts = superminhash.near_duplicates(_as_documents(rows), SHINGLE_WORDS, PERCENT)
    n = rows.count()
    parts = saved(parts.select(F.col("doc_id").alias(ROW), "component_id"), "groups", n)
    large = parts.groupBy("component_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("component_id")
    grouped = parts.join(large, "component_id", "left_semi").join(rows.select(ROW, "doc_id"), ROW)
    first = grouped.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", ROW)).alias("first"))
    gone = grouped.select(ROW).join(first.select(F.col("first")[ROW].alias(ROW)), ROW, "left_anti")
    return rows.join(saved(gone, "gone", n), ROW, "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a passage of any benchmark item, with or without a doc_id."""
    rows = _numbered(docs)
    found = phrase_index.contamination(_as_documents(rows), table(spark, sf_dir, "benchmark"))
    gone = found.where("contaminated").select(F.col("doc_id").alias(ROW))
    return rows.join(saved(gone, "gone", rows.count()), ROW, "left_anti").select(*docs.columns)


def blank_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with [kind] in place of every secret; n_chars follows the text."""
    ledger = blob_ledger.saved(blob_ledger.scan(docs), "ledger")
    found = blob_ledger.with_findings(docs, blob_ledger.findings(ledger), into="__spans")
    clean = found.withColumn("text", blob_ledger.redacted(F.col("text"), F.col("__spans"))).drop("__spans")
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of the texts that are left."""
    return bpe.digests(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", blank_secrets),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet to the shared folder and read again."""
    folder = f"{storage.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    path = storage._path(spark, folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        target = f"{folder}/{number}-{name}"
        made = stage(spark, docs, sf_dir)
        made.write.parquet(target)
        docs = spark.read.schema(made.schema).parquet(target)
    return docs


#: Compression, hashing and learning are beyond SQL; the tests hold the rows against brute force.
ORACLE_SQL = None
