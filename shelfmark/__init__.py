"""Corpus indexing and vector retrieval as Spark DataFrame transforms."""

import sys

from pyspark import cloudpickle

from shelfmark.operators.chunking import chunk_text
from shelfmark.operators.embedding import HashingEmbedder, ModelEmbedder, embed
from shelfmark.operators.render import render
from shelfmark.operators.search import nearest, nearest_batch
from shelfmark.plans.incremental import refresh_corpora
from shelfmark.plans.indexing import index_documents, index_files
from shelfmark.plans.querying import context_texts, query_chunks, query_corpus, query_database
from shelfmark.sources.corpus import CorpusStore
from shelfmark.sources.files import documents_as_files, read_contents, scan_files, walk_files

# Functions sent to tasks carry their code along, so executors need not have this
# package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = [
    "CorpusStore",
    "HashingEmbedder",
    "ModelEmbedder",
    "chunk_text",
    "context_texts",
    "documents_as_files",
    "embed",
    "index_documents",
    "index_files",
    "nearest",
    "nearest_batch",
    "query_chunks",
    "query_corpus",
    "query_database",
    "read_contents",
    "refresh_corpora",
    "render",
    "scan_files",
    "walk_files",
]
