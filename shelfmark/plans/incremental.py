"""Index again only what changed."""

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import ids
from shelfmark.plans.indexing import chunk_documents, embed_chunks
from shelfmark.sources import storage
from shelfmark.sources.corpus import FILE as STORED_FILE
from shelfmark.sources.corpus import CorpusStore, with_defaults

FILE = ("codebase_name", "file_path")


def fingerprints(documents: DataFrame) -> DataFrame:
    """``codebase_name, file_path, fingerprint`` of decoded files; store it beside the corpus.

    Null content counts as empty. A path that occurs more than once has one fingerprint,
    which follows from all its texts.
    """
    content = F.coalesce("content", F.lit(""))
    hashed = documents.select(*FILE, F.sha2(content, 256).alias("_hash"), F.xxhash64(content).alias("_number"))
    texts = hashed.groupBy(*FILE).agg(
        F.count(F.lit(1)).alias("_texts"),
        F.min("_hash").alias("_low"),
        F.max("_hash").alias("_high"),
        F.sum(F.col("_number").cast("decimal(20,0)")).alias("_sum"),
    )
    several = F.sha2(F.concat_ws(":", "_texts", "_low", "_high", F.col("_sum").cast("string")), 256)
    return texts.select(*FILE, F.when(F.col("_texts") == 1, F.col("_low")).otherwise(several).alias("fingerprint"))


def file_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """``codebase_name, file_path, status`` from two tables of :func:`fingerprints`.

    ``status`` is ``added``, ``changed``, ``deleted`` or ``same``. Only fingerprints are shuffled.
    """
    before = old.select(*FILE, F.col("fingerprint").alias("_before"))
    after = new.select(*FILE, F.col("fingerprint").alias("_after"))
    status = (
        F.when(F.col("_before").isNull(), "added")
        .when(F.col("_after").isNull(), "deleted")
        .when(F.col("_before") == F.col("_after"), "same")
        .otherwise("changed")
    )
    return before.join(after, list(FILE), "full").select(*FILE, status.alias("status"))


def refreshed_chunks(
    stored: DataFrame,
    documents: DataFrame,
    changes: DataFrame,
    embedder,
    max_file_size: int | None = None,
    use_prefix: bool = False,
) -> DataFrame:
    """The chunk table as it is after ``changes``: rows to replace the stored ones by.

    Rows of files that stayed the same are taken as stored; added and changed files are
    chunked and embedded anew, and no other text reaches the embedder.
    """
    kept = stored.join(changes.where(F.col("status") == "same").select(*FILE), list(FILE), "left_semi")
    wanted = changes.where(F.col("status").isin("added", "changed")).select(*FILE)
    fresh = documents.join(wanted, list(FILE), "left_semi")
    chunks = chunk_documents(fresh, max_file_size, embedder.context_tokens)
    made = with_defaults(embed_chunks(chunks, embedder, use_prefix))
    return kept.select(*made.columns).unionByName(made)


def refresh_corpora(
    store: CorpusStore,
    documents: DataFrame,
    embedder,
    name: str | None = None,
    delete_missing: bool = True,
    max_file_size: int | None = None,
    use_prefix: bool = False,
    on_invalid: str | None = None,
    stream: tuple[str, int] | None = None,
) -> dict[str, int]:
    """Bring a corpus (or each corpus that occurs in ``documents``) up to date; how many files were added, changed, deleted, same.

    Only texts of added and changed files are chunked and embedded, and only their rows are
    written; all corpora change by one step. Files that the store has and ``documents`` has not
    are deleted, unless ``delete_missing`` is off. Files that were stored without a
    refresh have no fingerprint yet and count as changed once. Documents without a path are
    left out. A corpus of which all files are gone stays, empty.
    """
    spark = documents.sparkSession
    corpus = F.lit(name) if name is not None else F.col("codebase_name")
    documents = documents.withColumn("codebase_name", corpus).withColumn("table_name", ids.table_name(corpus))
    documents = documents.where(F.col("file_path").isNotNull())
    # Names that sanitise to one table are one corpus, as everywhere in the store.
    after = fingerprints(documents.select(F.col("table_name").alias("codebase_name"), "file_path", "content"))
    known = store.fingerprints(name)
    stored = store.read(name) if name is None or store.exists(name) else None
    if stored is not None:
        bare = stored.select(*STORED_FILE).distinct().join(known, list(STORED_FILE), "left_anti")
        known = known.unionByName(bare.withColumn("fingerprint", F.lit("")))
    if name is None:
        known = known.join(documents.select("table_name").distinct(), "table_name", "left_semi")
    before = known.select(F.col("table_name").alias("codebase_name"), "file_path", "fingerprint")
    changes = file_changes(before, after).join(after, list(FILE), "left")
    changes = changes.select(F.col("codebase_name").alias("table_name"), "file_path", "status", "fingerprint")
    if not delete_missing:
        changes = changes.where("status != 'deleted'")
    folder = f"{storage.shared_folder(spark)}/changes-{uuid.uuid4().hex}"
    changes.write.parquet(folder)
    try:
        changes = spark.read.schema(changes.schema).parquet(folder)
        wanted = changes.where(F.col("status").isin("added", "changed")).select(*STORED_FILE)
        fresh = documents.join(wanted, list(STORED_FILE), "left_semi").drop("table_name")
        chunks = chunk_documents(fresh, max_file_size, embedder.context_tokens)
        store.apply(embed_chunks(chunks, embedder, use_prefix, on_invalid), changes, embedder.dim, stream)
        counted = {row["status"]: row["count"] for row in changes.groupBy("status").count().collect()}
    finally:
        storage.delete(spark, folder)
    return {status: counted.get(status, 0) for status in ("added", "changed", "deleted", "same")}
