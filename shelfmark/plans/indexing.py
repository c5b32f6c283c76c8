"""Index a tree of files or a table of texts: one plan, one write."""

import time
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions.paths import extension, language, modified_iso
from shelfmark.functions.vectors import is_valid_vector
from shelfmark.functions.text import DOCUMENT_PREFIX, decoded
from shelfmark.operators.chunking import chunk_count, chunk_text
from shelfmark.operators.embedding import embed, handle_invalid
from shelfmark.operators.filters import is_binary, within_size
from shelfmark.sources import storage
from shelfmark.sources.corpus import CorpusStore
from shelfmark.sources.files import dealing_tasks, read_contents, walk_files


def chunk_files(
    files: DataFrame,
    max_file_size: int | None = None,
    max_tokens: int | None = None,
    assume_latin1: bool = True,
    drop_empty: bool = False,
) -> DataFrame:
    """Chunk rows of raw files, with the metadata of the file on each.

    Empty, over-sized, binary and unreadable files give no rows.
    """
    readable = (
        files.where(within_size(F.col("length"), max_file_size))
        .where(F.col("content").isNotNull())
        .where(~is_binary(F.col("file_path"), F.col("content"), assume_latin1))
    )
    ext = extension(F.col("file_path"))
    texts = readable.select(
        "file_path",
        "absolute_path",
        ext.alias("extension"),
        F.col("length").alias("size_bytes"),
        modified_iso(F.col("modificationTime")).alias("modified_at"),
        language(ext).alias("language"),
        decoded(F.col("content")).alias("content"),
    )
    return chunk_text(texts, "content", max_tokens, drop_empty)


def chunk_documents(
    documents: DataFrame,
    max_file_size: int | None = None,
    max_tokens: int | None = None,
    drop_empty: bool = False,
) -> DataFrame:
    """Chunk rows of texts that are decoded already (see ``documents_as_files``)."""
    ext = extension(F.col("file_path"))
    texts = documents.where(within_size(F.col("size_bytes"), max_file_size)).withColumns(
        {"extension": ext, "language": language(ext)}
    )
    return chunk_text(texts, "content", max_tokens, drop_empty)


def embed_chunks(
    chunks: DataFrame, embedder, use_prefix: bool = False, on_invalid: str | None = None
) -> DataFrame:
    """Chunks with vectors; ``on_invalid`` (``drop`` or ``zero``) says what becomes of bad ones."""
    done = embed(chunks, embedder, "content", DOCUMENT_PREFIX if use_prefix else None)
    return handle_invalid(done, embedder.dim, on_invalid=on_invalid) if on_invalid else done


def _store(
    store: CorpusStore,
    chunks: DataFrame,
    name: str | None,
    embedder,
    replace: bool,
    on_invalid: str | None,
) -> dict[str, int]:
    """Write, and count what was written while it is written.

    The counters sit in the last stage, whose tasks count once however often they
    are tried, and see the chunks before ``on_invalid`` drops any: a file is counted
    by its first chunk, as failed if the model failed on that.
    """
    seen = Observation()
    first = F.col("chunk_index") == 0
    stored = F.lit(True)
    if on_invalid == "drop":
        stored = is_valid_vector(F.col("vector"), embedder.dim)
    counted = chunks.observe(
        seen,
        F.count_if(stored).alias("chunks_created"),
        F.count_if(first & F.col("embed_ok")).alias("files_processed"),
        F.count_if(first & ~F.col("embed_ok")).alias("files_failed"),
        F.count_if(~F.col("embed_ok")).alias("chunks_failed"),
    )
    if on_invalid:
        counted = handle_invalid(counted, embedder.dim, on_invalid=on_invalid)
    write = store.replace if replace else store.append
    write(counted, name, embedder.dim)
    return {key: int(value or 0) for key, value in seen.get.items()}


def _summary(found: int, written: dict[str, int], started: float) -> dict:
    ended = time.time()
    return {
        "total_files_found": found,
        "files_processed": written["files_processed"],
        "files_skipped": found - written["files_processed"] - written["files_failed"],
        "files_failed": written["files_failed"],
        "chunks_created": written["chunks_created"],
        "chunks_failed": written["chunks_failed"],
        "start_time": started,
        "end_time": ended,
        "files_per_second": written["files_processed"] / max(ended - started, 1e-9),
    }


def index_files(
    spark: SparkSession,
    root: str,
    name: str,
    store: CorpusStore,
    embedder,
    extra_patterns=(),
    max_file_size: int | None = None,
    assume_latin1: bool = True,
    use_prefix: bool = False,
    replace: bool = False,
    on_invalid: str | None = None,
) -> dict:
    """Scan, filter, decode, chunk, embed and store the files below ``root``.

    The chunk budget is the embedder's context. Returns the counters of the run. A
    write that fails raises its error; an append then added nothing. A text the model fails on is stored with a zero vector and counted in
    ``chunks_failed``.
    """
    started = time.time()
    # The listing is written down once: the counters, the number of reading tasks
    # and the read itself then see the same files, whatever happens to the tree.
    listing = f"{storage.shared_folder(spark)}/listing-{uuid.uuid4().hex}"
    storage.delete_at_exit(spark, listing)
    walk_files(spark, root, extra_patterns).write.parquet(listing)
    files = spark.read.parquet(listing)
    wanted = within_size(F.col("length"), max_file_size)
    found, to_read = files.agg(F.count(F.lit(1)), F.count_if(wanted)).head()
    contents = read_contents(files.where(wanted), root, dealing_tasks(spark, to_read))
    chunks = chunk_files(contents, max_file_size, embedder.context_tokens, assume_latin1)
    store.create(name, embedder.dim)
    embedded = embed_chunks(chunks, embedder, use_prefix)
    written = _store(store, embedded, name, embedder, replace, on_invalid)
    storage.delete(spark, listing)
    return _summary(found, written, started)


def index_documents(
    documents: DataFrame,
    store: CorpusStore,
    embedder,
    name: str | None = None,
    max_file_size: int | None = None,
    use_prefix: bool = False,
    replace: bool = False,
    rebalance: bool | None = None,
    on_invalid: str | None = None,
) -> dict:
    """Chunk, embed and store a table of texts, into one corpus or into one per ``codebase_name``.

    With many corpora the chunks are rebalanced by corpus before they are
    embedded, while a row is still small: adaptive execution then joins small
    corpora into one task and splits a corpus that dominates, which keeps files
    few and tasks even. Without adaptive execution a dominating corpus would meet
    in one task, so rows then stay where they are.
    """
    adaptive = documents.sparkSession.conf.get("spark.sql.adaptive.enabled") == "true"
    started = time.time()
    found = documents.select("file_path").count()
    chunks = chunk_documents(documents, max_file_size, embedder.context_tokens)
    if adaptive and (rebalance if rebalance is not None else name is None):
        chunks = chunks.hint("rebalance", "codebase_name")
    if name is not None:
        store.create(name, embedder.dim)
    embedded = embed_chunks(chunks, embedder, use_prefix)
    written = _store(store, embedded, name, embedder, replace, on_invalid)
    return _summary(found, written, started)


def file_statuses(
    files: DataFrame,
    status: Column,
    max_tokens: int | None = None,
    text: Column | str = "content",
) -> DataFrame:
    """``file_path, status, chunks``: what indexing does with each file, and into how many chunks."""
    body = F.col(text) if isinstance(text, str) else text
    count = F.when(F.col("status") == "ok", chunk_count(body, max_tokens)).otherwise(0)
    return files.withColumn("status", status).select("file_path", "status", count.alias("chunks"))
