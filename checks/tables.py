"""Inputs of the checked queries: the given tables, and tables Spark derives from them."""

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark import HashingEmbedder
from shelfmark.sources import storage
from shelfmark.plans.indexing import chunk_documents, embed_chunks
from shelfmark.sources.corpus import with_defaults
from shelfmark.sources.files import documents_as_files, spread_scan

DIM = 64
CHUNK_TOKENS = 512

# Folders and names (around the document's number) that make a document table look
# like a source tree.
FOLDERS = [
    "", "src/", "a/b/", ".git/", "web/node_modules/p/", "docs/é/", "env/", "lib/build/x/",
    "pkg.egg-info/",
]
NAMES = [
    ("m", ".py"), ("M", ".PY"), ("r", ".tar.gz"), ("Makefile", ""), ("n", ".log"), ("p", ".html"),
    ("c", ".R"), ("y", ".yaml"), (".env.", ""), ("t", ".txt"), ("keep", ".log"), ("u", ".unk"),
    ("d", ".sqlite3"), ("v", ".vue"), ("name", "."), (".hidden", ""), ("z", ".txt.gz"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list[str], index: Column) -> Column:
    listed = ", ".join(f"'{value}'" for value in values)
    return F.element_at(F.expr(f"array({listed})"), (index + 1).cast("int"))


def document_path() -> Column:
    """A file path for each document number."""
    number = F.col("doc_id")
    kind = number % len(NAMES)
    folder = F.floor(number / len(NAMES)) % len(FOLDERS)
    return F.concat(
        _pick(FOLDERS, folder),
        _pick([before for before, _ in NAMES], kind),
        number.cast("string"),
        _pick([after for _, after in NAMES], kind),
    )


def document_bytes() -> Column:
    """Bytes of a document: plain, or in one of the ways files go wrong."""
    text = F.encode("text", "UTF-8")
    variant = F.col("doc_id") % 7
    return (
        F.when(variant == 0, F.concat(F.lit(bytearray(b"\0")), text))
        .when(variant == 1, F.concat(text, F.lit(bytearray(b"\xe9\r\n\r"))))
        .when(variant == 2, F.lit(bytearray(b"")))
        .when(variant == 3, F.encode(F.replace("text", F.lit("\n"), F.lit("\r\n")), "UTF-8"))
        .when(variant == 4, F.concat(F.lit(bytearray(b"a" * 1023 + b"\xc3\xa9")), text))
        .otherwise(text)
    )


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as decoded files, one corpus per source."""
    documents = spread_scan(table(spark, sf_dir, "documents"))
    return documents_as_files(documents, document_path(), "text", "source")


def raw_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as raw files: ``doc_id, source, file_path, length, content``."""
    documents = spread_scan(table(spark, sf_dir, "documents"))
    return documents.select(
        "doc_id",
        "source",
        document_path().alias("file_path"),
        document_bytes().alias("content"),
    ).withColumn("length", F.octet_length("content").cast("bigint"))


def file_tree(spark: SparkSession, sf_dir: str) -> str:
    """Write every raw file below a new folder, one task per share of them; the folder."""
    root = storage.qualified(spark, f"{storage.shared_folder(spark)}/tree-{uuid.uuid4().hex}")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file_system, top = fs.FileSystem.from_uri(root)
        for batch in batches:
            for row in batch.to_pylist():
                path = f"{top}/{row['file_path']}"
                file_system.create_dir(path.rpartition("/")[0])
                with file_system.open_output_stream(path, compression=None) as stream:
                    stream.write(row["content"])
            yield batch.select(["doc_id"])

    written = raw_files(spark, sf_dir).mapInArrow(write, "doc_id bigint")
    written.write.format("noop").mode("overwrite").save()
    return root


def page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``page_id, path``: the path of each URL, without host, query and fragment."""
    return table(spark, sf_dir, "pages").select(
        "page_id", F.regexp_extract("url", "^[a-z]+://[^/]*/([^?#]*)", 1).alias("path")
    )


def corpus_chunks(spark: SparkSession, sf_dir: str, dim: int = DIM) -> DataFrame:
    """All documents chunked and embedded, as stored rows."""
    chunks = chunk_documents(document_files(spark, sf_dir), max_tokens=CHUNK_TOKENS)
    return with_defaults(embed_chunks(chunks, HashingEmbedder(dim)))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark text as a question, and a blank one beside each."""
    items = table(spark, sf_dir, "benchmark")
    asked = items.select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))
    blank = items.select(
        (-F.col("item_id") - 1).alias("query_id"), F.lit(" \t\n ").alias("query_text")
    )
    return asked.unionAll(blank)


def broken_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored vectors, some with a NaN, an infinity, a wrong length or nothing at all."""
    v = F.col("embedding")
    tail = F.slice(v, F.lit(2), F.size(v) - 1)
    variant = F.col("vec_id") % 7

    def starting_with(value: float) -> Column:
        return F.concat(F.array(F.lit(value).cast("float")), tail)

    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        "label",
        F.when(variant == 0, starting_with(float("nan")))
        .when(variant == 1, starting_with(float("-inf")))
        .when(variant == 2, tail)
        .when(variant == 3, F.lit(None))
        .otherwise(v)
        .alias("vector"),
    )
