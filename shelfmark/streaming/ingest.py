"""Index documents as they arrive."""

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from shelfmark.plans.incremental import refresh_corpora
from shelfmark.plans.indexing import chunk_documents, embed_chunks
from shelfmark.sources.corpus import CorpusStore


def index_stream(
    documents: DataFrame,
    store_root: str,
    checkpoint: str,
    embedder,
    max_file_size: int | None = None,
    use_prefix: bool = False,
    on_invalid: str | None = None,
    upsert: bool = False,
) -> DataStreamWriter:
    """A writer that chunks, embeds and stores a stream in the shape of ``documents_as_files``.

    Every step is per row, so there is no state to keep and no watermark to set. Each
    batch is one version of the store, which keeps the number of the stream's last batch (a
    stream is known by its ``checkpoint``): a batch that is run again after a failure changes
    nothing. Names, vector lengths and ``on_invalid`` are handled as in ``index_documents``.

    By default documents are appended, repeated ones again. With ``upsert`` a document takes
    the place of the one stored under its corpus and path, unless it is the same; within one
    batch, all texts of a path count together.
    """

    def store_batch(batch: DataFrame, number: int) -> None:
        store = CorpusStore(batch.sparkSession, store_root)
        told = (checkpoint, number)
        if upsert:
            refresh_corpora(
                store, batch, embedder, None, False, max_file_size, use_prefix, on_invalid, told
            )
            return
        chunks = chunk_documents(batch, max_file_size, embedder.context_tokens)
        store.append(embed_chunks(chunks, embedder, use_prefix, on_invalid), None, embedder.dim, told)

    return documents.writeStream.option("checkpointLocation", checkpoint).foreachBatch(store_batch)
