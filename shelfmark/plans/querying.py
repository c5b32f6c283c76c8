"""Ask a corpus: questions in, hits or context texts out, one plan per batch of questions."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.text import QUERY_PREFIX
from shelfmark.operators.embedding import embed, where_computed
from shelfmark.operators.filters import similar_enough, with_extension, with_text
from shelfmark.operators.render import render
from shelfmark.operators.search import nearest_batch
from shelfmark.sources.corpus import CorpusStore


def embed_queries(
    queries: DataFrame, embedder, use_prefix: bool = False, on_failed: str = "raise"
) -> DataFrame:
    """``query_id, query_vector`` of the queries that have text.

    A query the model fails on fails the job; with ``on_failed="skip"`` it has no
    vector, so it finds nothing.
    """
    if on_failed not in ("raise", "skip"):
        raise ValueError(f"on_failed must be raise or skip, got {on_failed!r}")
    asked = with_text(queries.select("query_id", "query_text"))
    prefix = QUERY_PREFIX if use_prefix else None
    done = embed(asked, embedder, "query_text", prefix, "query_vector")
    failed = F.lit(None).cast("array<float>")
    if on_failed == "raise":
        said = F.concat(
            F.lit("the model failed on query "),
            F.col("query_id").cast("string"),
            F.lit(": "),
            F.coalesce("embed_error", F.lit("")),
        )
        failed = F.raise_error(said).cast("array<float>")
    vector = F.when(F.col("embed_ok"), F.col("query_vector")).otherwise(failed)
    return done.select("query_id", vector.alias("query_vector"))


def query_chunks(
    chunks: DataFrame,
    queries: DataFrame,
    embedder,
    limit: int | None = None,
    min_similarity: float | None = None,
    extension_filter: str | None = None,
    where: Column | str | None = None,
    filter_mode: str = "pre",
    metric: str = "l2",
    use_prefix: bool = False,
    skip_zero_vectors: bool = False,
    on_failed_query: str = "raise",
    **options,
) -> DataFrame:
    """Hits of each query (``query_id, query_text``) in a chunk table, threshold applied.

    Blank chunks and chunks the model failed on have a zero vector and can be
    found like any other, unless ``skip_zero_vectors`` is set.
    """
    if skip_zero_vectors:
        chunks = where_computed(chunks, F.exists("vector", lambda v: v != 0))
    if filter_mode == "pre":
        chunks = with_extension(chunks, extension_filter)
    hits = nearest_batch(
        chunks,
        embed_queries(queries, embedder, use_prefix, on_failed_query),
        limit,
        where=where,
        filter_mode=filter_mode,
        metric=metric,
        **options,
    )
    if filter_mode == "post":
        hits = with_extension(hits, extension_filter)
    return similar_enough(hits, min_similarity)


def query_corpus(
    store: CorpusStore, name: str, queries: DataFrame, embedder, **options
) -> DataFrame:
    """:func:`query_chunks` on a stored corpus; an unknown one is an error."""
    return query_chunks(store.read(name), queries, embedder, **options)


def context_texts(
    hits: DataFrame,
    queries: DataFrame,
    style: str = "human",
    max_content_length: int | None = None,
) -> DataFrame:
    """One text per query, also for queries that found nothing."""
    return render(hits, queries, style, max_content_length)


def query_database(
    store: CorpusStore,
    name: str,
    query_text: str,
    embedder,
    limit: int | None = None,
    style: str = "human",
    **options,
) -> str:
    """Answer one question with one text."""
    queries = store.spark.range(1).select(
        F.lit(0).alias("query_id"), F.lit(query_text).cast("string").alias("query_text")
    )
    hits = query_corpus(store, name, queries, embedder, limit=limit, **options)
    return context_texts(hits, queries, style).head()["text"]
