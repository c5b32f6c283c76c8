"""One callable per operator: ``(spark, sf_dir) -> DataFrame`` over whole tables."""

import uuid

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.tables import (
    CHUNK_TOKENS,
    DIM,
    broken_vectors,
    corpus_chunks,
    document_files,
    document_path,
    file_tree,
    page_paths,
    questions,
    raw_files,
    table,
)
from shelfmark import (
    CorpusStore,
    HashingEmbedder,
    chunk_text,
    context_texts,
    index_documents,
    index_files,
    nearest,
    nearest_batch,
    query_chunks,
    read_contents,
    scan_files,
    walk_files,
)
from shelfmark.functions import display, globs, html, ids, paths, text
from shelfmark.operators import embedding, filters, hybrid, stats
from shelfmark.operators.keyword_index import KeywordIndex
from shelfmark.plans import incremental, indexing
from shelfmark.sources import storage
from shelfmark.sources.corpus import with_defaults
from shelfmark.sources.files import documents_as_files, spread_scan
from shelfmark.streaming.ingest import index_stream


IGNORE_RULES = ["*.log", "!keep*.log", "/src", "a/*", "!a/b/", "docs/**", "?[0-4]*.py", "*.un[!x]"]
EXTRA_RULES = "*.vue, web/*"
PREVIEW = 200
MIN_SIMILARITY = 0.55

QUERIES = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def _digest(vector: str = "vector") -> Column:
    """One number that changes with every entry of a vector and its place."""
    weighed = F.transform(vector, lambda v, i: v.cast("double") * (i + 1))
    return F.round(F.aggregate(weighed, F.lit(0.0), lambda total, v: total + v), 4).alias("digest")


def _r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


# -- vector search -------------------------------------------------------------


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def _first_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return _embeddings(spark, sf_dir).orderBy("vec_id").select("embedding").head()[0]


def _near_first(spark, sf_dir, **options) -> DataFrame:
    return nearest(
        _embeddings(spark, sf_dir),
        _first_vector(spark, sf_dir),
        vector_col="embedding",
        ties=["vec_id"],
        **options,
    )


def _scored(df: DataFrame, *names: str) -> DataFrame:
    return df.select(
        *names, _r6("distance").alias("distance"), _r6("similarity").alias("similarity")
    )


@query
def knn_single(spark, sf_dir):
    return _scored(_near_first(spark, sf_dir, k=5), "vec_id", "label")


@query
def knn_filtered(spark, sf_dir):
    return _scored(_near_first(spark, sf_dir, k=5, where=F.col("label") == 1), "vec_id", "label")


@query
def knn_post_filter(spark, sf_dir):
    hits = _near_first(spark, sf_dir, k=40, where="label = 1", filter_mode="post")
    return _scored(hits, "vec_id", "label")


@query
def knn_threshold(spark, sf_dir):
    hits = _near_first(spark, sf_dir, k=5, where="label = 1")
    return _scored(filters.similar_enough(hits, 0.38), "vec_id", "label")


@query
def threshold_nan(spark, sf_dir):
    """Rows whose vector has no distance, or none but infinity, pass no threshold."""
    hits = nearest(
        broken_vectors(spark, sf_dir),
        _first_vector(spark, sf_dir),
        k=broken_vectors(spark, sf_dir).count(),
        ties=["vec_id"],
    )
    return _scored(filters.similar_enough(hits, 0.38), "vec_id", "label")


@query
def knn_dot_scaled(spark, sf_dir):
    """Vectors that are not of unit length: the largest products are the most similar."""
    scale = (F.col("vec_id") % 5).cast("float")
    scaled = _embeddings(spark, sf_dir).select(
        "vec_id", "label", F.transform("embedding", lambda x: x * scale).alias("vector")
    )
    question = [3 * x for x in _first_vector(spark, sf_dir)]
    hits = nearest(scaled, question, k=40, metric="dot", ties=["vec_id"])
    return _scored(filters.similar_enough(hits, 0.5), "vec_id", "label")


def _all_vectors_as_queries(spark, sf_dir) -> DataFrame:
    return _embeddings(spark, sf_dir).select(
        F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector")
    )


def _batch(spark, sf_dir, **options) -> DataFrame:
    return nearest_batch(
        _embeddings(spark, sf_dir),
        _all_vectors_as_queries(spark, sf_dir),
        5,
        vector_col="embedding",
        ties=["vec_id"],
        **options,
    )


@query
def knn_metrics(spark, sf_dir):
    parts = [
        _scored(_batch(spark, sf_dir, metric=m), "query_id", "rank", "vec_id").withColumn(
            "metric", F.lit(m)
        )
        for m in ("l2", "cosine", "dot")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def knn_batch(spark, sf_dir):
    return _scored(_batch(spark, sf_dir), "query_id", "rank", "vec_id", "label")


@query
def knn_batch_blocks(spark, sf_dir):
    """More queries than one block holds, none kept: each batch of the table reads all blocks."""
    hits = _batch(spark, sf_dir, query_block_rows=150, kept_query_bytes=0)
    return _scored(hits, "query_id", "rank", "vec_id", "label")


@query
def knn_batch_many(spark, sf_dir):
    """More questions than a task keeps, asked in passes, over tiles of several Arrow batches."""
    options = {"query_block_rows": 64, "kept_query_bytes": 64 * 1024, "tile_bytes": 256 * 1024}
    hits = _batch(spark, sf_dir, pass_queries=300, **options)
    return _scored(hits, "query_id", "rank", "vec_id", "label")


@query
def knn_batch_filtered(spark, sf_dir):
    return _scored(_batch(spark, sf_dir, where="label < 3"), "query_id", "rank", "vec_id", "label")


# -- chunking ------------------------------------------------------------------


def _chunks(spark, sf_dir, name: str, key: list[str], text_col: str, tokens) -> DataFrame:
    rows = spread_scan(table(spark, sf_dir, name)).select(*key, text_col)
    return chunk_text(rows, text_col, tokens)


@query
def chunk_documents(spark, sf_dir):
    return _chunks(spark, sf_dir, "documents", ["doc_id"], "text", CHUNK_TOKENS)


@query
def chunk_documents_small(spark, sf_dir):
    """A small budget, where most lines must be cut."""
    return _chunks(spark, sf_dir, "documents", ["doc_id"], "text", 64)


@query
def chunk_pages(spark, sf_dir):
    return _chunks(spark, sf_dir, "pages", ["page_id"], "html", CHUNK_TOKENS)


@query
def chunk_conversations(spark, sf_dir):
    return _chunks(spark, sf_dir, "conversations", ["conv_id", "turn"], "text", CHUNK_TOKENS)


@query
def chunk_unsplit(spark, sf_dir):
    return _chunks(spark, sf_dir, "documents", ["doc_id"], "text", None)


@query
def chunk_totals(spark, sf_dir):
    chunks = chunk_documents(spark, sf_dir)
    return chunks.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("chunks"),
        F.max("total_chunks").alias("total_chunks"),
        F.max("chunk_index").alias("last_index"),
        F.max("end_line").alias("last_line"),
    )


# -- embedding -----------------------------------------------------------------


def _entries(df: DataFrame, *keys: str) -> DataFrame:
    # the outer form keeps Spark from computing the vector a second time in a filter
    return (
        df.select(*keys, F.posexplode_outer("vector").alias("bucket", "weight"))
        .where(F.col("weight") != 0)
        .withColumn("weight", _r6(F.col("weight").cast("double")))
    )


@query
def embed_hash(spark, sf_dir):
    chunks = chunk_documents(spark, sf_dir).select("doc_id", "chunk_index", "content")
    return _entries(embedding.embed(chunks, HashingEmbedder(DIM)), "doc_id", "chunk_index")


@query
def embed_whole_text(spark, sf_dir):
    """Texts longer than the model's context, with the document prefix."""
    documents = spread_scan(table(spark, sf_dir, "documents")).select("doc_id", "text")
    done = embedding.embed(documents, HashingEmbedder(DIM), "text", text.DOCUMENT_PREFIX)
    return _entries(done, "doc_id")


@query
def embed_with_metadata(spark, sf_dir):
    """Other columns stay; missing text counts as empty."""
    turns = spread_scan(table(spark, sf_dir, "conversations")).select(
        "conv_id",
        "turn",
        "role",
        F.when(F.col("turn") % 3 != 1, F.col("text")).alias("content"),
    )
    done = embedding.embed(turns, HashingEmbedder(DIM))
    entry = F.aggregate("vector", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    return done.select(
        "conv_id",
        "turn",
        "role",
        "embed_ok",
        F.size("vector").alias("dim"),
        F.round(entry, 4).alias("squared_norm"),
        F.size(F.filter("vector", lambda v: v != 0)).alias("nonzero"),
    )


@query
def embed_placeholder(spark, sf_dir):
    missing = _embeddings(spark, sf_dir).select(
        "vec_id", F.when(F.col("vec_id") % 7 != 0, F.col("embedding")).alias("vector")
    )
    done = embedding.fill_missing_vectors(missing, DIM)
    return done.select(
        "vec_id",
        "embed_ok",
        F.size("vector").alias("dim"),
        _r6(F.element_at("vector", 1).cast("double")).alias("first_entry"),
    )


@query
def vector_checks(spark, sf_dir):
    return embedding.vector_checks(broken_vectors(spark, sf_dir), DIM).select(
        "vec_id",
        "vector_length",
        "inf_count",
        "nan_count",
        "wrong_length",
        "vector_ok",
        _r6(F.col("vector_min").cast("double")).alias("vector_min"),
        _r6(F.col("vector_max").cast("double")).alias("vector_max"),
    )


@query
def vector_quality(spark, sf_dir):
    summary = embedding.vector_quality(broken_vectors(spark, sf_dir), DIM, by=["label"])
    ends = {name: _r6(F.col(name).cast("double")) for name in ("smallest", "largest")}
    return summary.withColumns(ends)


@query
def vector_repair(spark, sf_dir):
    """What dropping and zeroing bad vectors leave."""
    broken = broken_vectors(spark, sf_dir)
    parts = []
    for mode in ("drop", "zero"):
        done = embedding.handle_invalid(broken, DIM, on_invalid=mode)
        parts.append(
            done.groupBy("label").agg(
                F.lit(mode).alias("mode"),
                F.count(F.lit(1)).alias("vectors"),
                F.count_if(F.forall("vector", lambda v: v == 0)).alias("zero_vectors"),
            )
        )
    return parts[0].unionByName(parts[1])


# -- scalar functions ----------------------------------------------------------


@query
def path_parts(spark, sf_dir):
    pages = page_paths(spark, sf_dir).select(F.col("page_id").alias("row"), "path")
    files = document_files(spark, sf_dir).select(
        F.lit(-1).cast("bigint").alias("row"), F.col("file_path").alias("path")
    )
    path = F.col("path")
    return pages.unionByName(files).select(
        "row",
        "path",
        paths.extension(path).alias("extension"),
        paths.extension_or_placeholder(path).alias("extension_label"),
        paths.relative_path(path, "web/node_modules").alias("below_modules"),
        paths.without_local_scheme(F.concat(F.lit("file:///srv/"), path)).alias("absolute"),
    )


@query
def language(spark, sf_dir):
    ext = paths.extension(F.col("file_path"))
    files = document_files(spark, sf_dir)
    return files.select("file_path", paths.language(ext).alias("language"))


@query
def modified_iso(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("row"), "ts")
    orders = table(spark, sf_dir, "orders").select(
        (-F.col("o_orderkey")).alias("row"), F.col("o_orderdate").alias("ts")
    )
    return events.unionAll(orders).select("row", paths.modified_iso(F.col("ts")).alias("iso"))


@query
def row_id(spark, sf_dir):
    files = document_files(spark, sf_dir)
    id_ = ids.row_id(F.col("codebase_name"), F.col("file_path"))
    return files.select(
        "codebase_name",
        "file_path",
        id_.alias("id"),
        ids.chunk_id(id_, F.lit(3)).alias("chunk_id"),
    )


@query
def sanitize_name(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(
        F.concat_ws(" - ", "p_name", "p_brand", F.concat("p_type", F.lit("!"))).alias("name")
    )
    texts = table(spark, sf_dir, "documents").select(F.col("text").alias("name"))
    return parts.unionAll(texts).select(
        ids.sanitized(F.col("name")).alias("sanitized"),
        ids.table_name(F.col("name")).alias("table_name"),
    )


@query
def list_corpora(spark, sf_dir):
    names = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("My_Rag_rag "), F.col("source")).alias("name")
    )
    tables = names.select(ids.table_name(F.col("name")).alias("table_name")).distinct()
    return tables.select("table_name", ids.corpus_of_table(F.col("table_name")).alias("corpus"))


@query
def truncate_context(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.round(text.estimated_tokens(t), 4).alias("tokens"),
        text.truncated_to_context(t, 512).alias("cut_512"),
        F.length(text.truncated_to_context(t, 1024)).alias("length_1024"),
        F.lit(text.chunk_budget(512)).alias("budget"),
    )


@query
def prefix_text(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(
        "item_id",
        text.with_prefix(F.col("text"), text.QUERY_PREFIX).alias("as_query"),
        text.with_prefix(F.col("text"), text.DOCUMENT_PREFIX).alias("as_document"),
        text.with_prefix(F.col("text"), None).alias("as_is"),
    )


@query
def strip_text(spark, sf_dir):
    pad = "\t　   \x1f"
    padded = F.concat(F.lit(pad), F.col("text"), F.lit(pad[::-1]))
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        text.strip(padded).alias("stripped"),
        text.is_blank(F.lit(pad)).alias("pad_is_blank"),
        text.is_blank(F.col("text")).alias("text_is_blank"),
    )


@query
def label_hits(spark, sf_dir):
    """Labels of chunks, with zeros and nulls in the line and chunk numbers."""
    chunks = chunk_documents(spark, sf_dir).withColumn("file_path", document_path())
    odd = F.col("doc_id") % 5

    def blurred(name: str) -> Column:
        return F.when(odd == 0, F.lit(0)).when(odd == 1, F.lit(None)).otherwise(F.col(name))

    return chunks.select(
        "doc_id",
        "chunk_index",
        display.location_label(
            *(F.col(c) for c in ("file_path", "start_line", "end_line")),
            F.col("chunk_index"),
            F.col("total_chunks"),
        ).alias("label"),
        display.location_label(
            F.col("file_path"), *map(blurred, ["start_line", "end_line", "chunk_index", "total_chunks"])
        ).alias("blurred_label"),
    )


@query
def preview(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        display.preview(t, PREVIEW).alias("cut"),
        (display.preview(t, 0) == t).alias("zero_keeps"),
        (display.preview(t, None) == t).alias("none_keeps"),
    )


@query
def score_format(spark, sf_dir):
    score = F.col("l_discount") + F.col("l_tax") / 16
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        display.score_text(score).alias("score"),
        display.percent_text(score).alias("percent"),
    )


# -- filters -------------------------------------------------------------------


@query
def exclude_default(spark, sf_dir):
    files = document_files(spark, sf_dir).select("file_path")
    pages = page_paths(spark, sf_dir).select(F.col("path").alias("file_path"))
    path = F.col("file_path")
    both = files.unionByName(pages)
    return both.where(~globs.matches_any(path, globs.DEFAULT_EXCLUDES))


@query
def exclude_rules(spark, sf_dir):
    rules = globs.clean_patterns(["# comment", "", *(f" {rule} " for rule in IGNORE_RULES)])
    return document_files(spark, sf_dir).select(
        "file_path", globs.matches_any(F.col("file_path"), rules).alias("excluded")
    )


@query
def exclude_additional(spark, sf_dir):
    rules = globs.split_patterns(EXTRA_RULES)
    return document_files(spark, sf_dir).select(
        "file_path", globs.matches_any(F.col("file_path"), rules).alias("excluded")
    )


@query
def exclude_reason(spark, sf_dir):
    reason = globs.exclusion_reason(
        F.col("file_path"), IGNORE_RULES, globs.split_patterns(EXTRA_RULES)
    )
    return document_files(spark, sf_dir).select("file_path", reason.alias("reason"))


@query
def size_filter(spark, sf_dir):
    files = raw_files(spark, sf_dir)
    size = F.col("length")
    return files.select(
        "doc_id",
        filters.within_size(size, 3000).alias("kept"),
        filters.size_status(size, 3000).alias("size_status"),
        filters.within_size(size).alias("kept_by_default"),
    )


@query
def binary_sniff(spark, sf_dir):
    return raw_files(spark, sf_dir).select(
        "doc_id",
        filters.is_binary(F.col("file_path"), F.col("content")).alias("is_binary"),
        text.head_is_binary(F.col("content")).alias("head_is_binary"),
        paths.has_text_mime(F.col("file_path")).alias("text_by_name"),
    )


@query
def decode_text(spark, sf_dir):
    return raw_files(spark, sf_dir).select("doc_id", text.decoded(F.col("content")).alias("text"))


@query
def decode_marked(spark, sf_dir):
    """Every text as UTF-8 bytes behind a mark; odd documents hold a second one, which is text."""
    mark = F.lit(bytearray(b"\xef\xbb\xbf"))
    plain = F.encode("text", "UTF-8")
    marked = F.when(F.col("doc_id") % 2 == 0, F.concat(mark, plain)).otherwise(F.concat(mark, mark, plain))
    documents = table(spark, sf_dir, "documents")
    return documents.select("doc_id", text.decoded(marked).alias("text"))


@query
def decode_wide(spark, sf_dir):
    """Every text as UTF-16 or UTF-32 behind its mark; a byte too many at the end makes one binary."""
    documents = table(spark, sf_dir, "documents")
    kind = F.col("doc_id") % 4
    content = (
        F.when(kind == 0, F.concat(F.lit(bytearray(b"\xff\xfe")), F.encode("text", "UTF-16LE")))
        .when(kind == 1, F.concat(F.lit(bytearray(b"\xfe\xff")), F.encode("text", "UTF-16BE")))
        .when(kind == 2, F.concat(F.lit(bytearray(b"\0\0\xfe\xff")), F.encode("text", "UTF-32")))
        .otherwise(F.concat(F.lit(bytearray(b"\xff\xfe")), F.encode("text", "UTF-16LE"), F.lit(bytearray(b"\0"))))
    )
    made = documents.select("doc_id", text.head_is_binary(content).alias("is_binary"), text.decoded(content).alias("text"))
    return made.withColumn("text", F.when(~F.col("is_binary"), F.col("text")))


@query
def extension_filter(spark, sf_dir):
    files = document_files(spark, sf_dir).withColumn(
        "extension", paths.extension(F.col("file_path"))
    )
    kept = filters.matching(filters.with_extension(files, ".py"), "size_bytes > 500")
    return kept.select("file_path", "extension", "size_bytes")


@query
def blank_queries(spark, sf_dir):
    return filters.with_text(questions(spark, sf_dir))


# -- trees of files ------------------------------------------------------------


@query
def scan_tree(spark, sf_dir):
    """Every file of the tree, with a digest of the bytes read."""
    root = file_tree(spark, sf_dir)
    files = read_contents(scan_files(spark, root), root, path="path")
    return files.select(
        F.regexp_extract("path", "/tree-[0-9a-f]+/(.*)$", 1).alias("file_path"),
        "length",
        F.md5("content").alias("digest"),
    )


@query
def walk_tree(spark, sf_dir):
    root = file_tree(spark, sf_dir)
    files = walk_files(spark, root, globs.split_patterns(EXTRA_RULES))
    return files.select(
        "file_path",
        "length",
        F.expr("endswith(absolute_path, concat('/', file_path))").alias("below_root"),
    )


@query
def walk_ignored(spark, sf_dir):
    """A tree with an ignore file whose rules also take files back in."""
    root = file_tree(spark, sf_dir)
    file_system, top = fs.FileSystem.from_uri(root)
    with file_system.open_output_stream(f"{top}/.gitignore") as stream:
        stream.write(("# rules\n\n" + "\n".join(IGNORE_RULES) + "\n").encode())
    return walk_files(spark, root).select("file_path", "length")


@query
def index_tree(spark, sf_dir):
    """What indexing a tree of files stores."""
    root = file_tree(spark, sf_dir)
    folder = f"{storage.shared_folder(spark)}/indexed-{uuid.uuid4().hex}"
    store = CorpusStore(spark, folder)
    index_files(
        spark, root, "The Tree", store, HashingEmbedder(DIM), globs.split_patterns(EXTRA_RULES)
    )
    return store.read("The Tree").select(
        "id", "codebase_name", "table_name", "file_path", "content", "extension", "size_bytes",
        "language", "start_line", "end_line", "chunk_index", "total_chunks",
        F.size("vector").alias("dim"),
    )


# -- statistics ----------------------------------------------------------------


@query
def ext_counts(spark, sf_dir):
    return stats.files_by_extension(document_files(spark, sf_dir))


def _chunk_table(spark, sf_dir) -> DataFrame:
    """Documents as chunk rows without vectors."""
    return indexing.chunk_documents(document_files(spark, sf_dir), max_tokens=CHUNK_TOKENS)


def _stats_rows(df: DataFrame) -> DataFrame:
    shown = F.array_join(
        F.transform(
            F.map_entries("extension_distribution"),
            lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")),
        ),
        ",",
    )
    return df.withColumn("extension_distribution", shown)


@query
def corpus_stats_store(spark, sf_dir):
    """A corpus under two spellings of its name is one; one without rows is listed, too."""
    store = CorpusStore(spark, f"{storage.shared_folder(spark)}/spelled-{uuid.uuid4().hex}")
    store.create("Nothing Here", DIM)
    spelled = F.when(F.col("size_bytes") % 2 == 0, F.lit("My App")).otherwise(F.lit("my_app"))
    files = document_files(spark, sf_dir).withColumn("codebase_name", spelled)
    index_documents(files, store, HashingEmbedder(DIM, CHUNK_TOKENS))
    return _stats_rows(store.stats())


@query
def degenerate_vectors(spark, sf_dir):
    """Per label: zero, near-constant and repeated vectors, of a table where a few are made so."""
    kind = F.col("vec_id") % 10
    changed = (
        F.when(kind == 0, F.transform("embedding", lambda x: F.lit(0.0).cast("float")))
        .when(kind == 1, F.transform("embedding", lambda x: F.lit(0.25).cast("float")))
        .when(kind == 2, F.transform("embedding", lambda x, i: i.cast("float")))
        .otherwise(F.col("embedding"))
    )
    vectors = _embeddings(spark, sf_dir).select("label", changed.alias("vector"))
    return embedding.degenerate_vectors(vectors, by=["label"])


@query
def corpus_stats(spark, sf_dir):
    return _stats_rows(stats.corpus_stats(_chunk_table(spark, sf_dir)))


@query
def extension_counts(spark, sf_dir):
    return stats.extension_counts(_chunk_table(spark, sf_dir))


@query
def distinct_files(spark, sf_dir):
    return stats.distinct_files(_chunk_table(spark, sf_dir))


@query
def row_count(spark, sf_dir):
    return stats.row_count(_chunk_table(spark, sf_dir))


@query
def run_stats(spark, sf_dir):
    files = raw_files(spark, sf_dir)
    status = filters.file_status(
        F.col("file_path"),
        F.col("length"),
        F.col("content"),
        max_file_size=3000,
        extra_patterns=["*.vue"],
    )
    body = text.decoded(F.col("content"))
    return stats.run_stats(indexing.file_statuses(files, status, CHUNK_TOKENS, body))


class _Refusing(HashingEmbedder):
    """Fails on texts whose length is a multiple of five."""

    def embedded(self, text):
        failed = F.coalesce(F.length(text) % 5 == 0, F.lit(False))
        zero = F.array_repeat(F.lit(0.0).cast("float"), self.dim)
        return F.struct(
            F.when(failed, zero).otherwise(self.vector(text)).alias("vector"),
            (~failed).alias("ok"),
            F.when(failed, F.lit("refused")).alias("error"),
        )


@query
def run_stats_failures(spark, sf_dir):
    """Counters of an index run whose model fails on some texts, and what is stored nevertheless."""
    store = CorpusStore(spark, f"{storage.shared_folder(spark)}/refused-{uuid.uuid4().hex}")
    done = index_documents(document_files(spark, sf_dir), store, _Refusing(DIM, CHUNK_TOKENS))
    counters = [c for c in done if not c.endswith("_time") and c != "files_per_second"]
    zero = F.forall("vector", lambda v: v == 0) & F.col("content").rlike(r"\S")
    return store.read().agg(
        *(F.lit(done[c]).cast("bigint").alias(c) for c in counters),
        F.count(F.lit(1)).alias("stored"),
        F.count_if(zero).alias("without_vector"),
    )


# -- store ---------------------------------------------------------------------


@query
def defaults_append(spark, sf_dir):
    given = _embeddings(spark, sf_dir).select(
        F.concat(F.lit("v/"), F.col("vec_id").cast("string"), F.lit(".bin")).alias("file_path"),
        F.when(F.col("vec_id") % 2 == 0, F.lit("body")).alias("content"),
        F.when(F.col("vec_id") % 3 == 0, F.lit("given")).alias("id"),
        F.when(F.col("vec_id") % 5 == 0, F.col("label")).alias("start_line"),
        F.col("embedding").alias("vector"),
    )
    rows = with_defaults(given, "Vec Store")
    return rows.select(
        *(c for c in rows.columns if c not in ("modified_at", "vector")),
        F.size("vector").alias("dim"),
        F.col("modified_at").isNotNull().alias("has_time"),
    )


@query
def corpus_roundtrip(spark, sf_dir):
    """Index every source into its corpus, replace one, drop one, and count the rest."""
    folder = f"{storage.shared_folder(spark)}/roundtrip-{uuid.uuid4().hex}"
    store, embedder = CorpusStore(spark, folder), HashingEmbedder(DIM)
    files = document_files(spark, sf_dir)
    index_documents(files, store, embedder)
    index_documents(files.where("codebase_name = 'src1'"), store, embedder, "src1", replace=True)
    store.drop("src2")
    return _stats_rows(store.stats())


@query
def corpus_catalog(spark, sf_dir):
    """Names, existence and sizes after indexing every source, creating one corpus, dropping one."""
    folder = f"{storage.shared_folder(spark)}/catalog-{uuid.uuid4().hex}"
    store, embedder = CorpusStore(spark, folder), HashingEmbedder(DIM)
    index_documents(document_files(spark, sf_dir), store, embedder)
    store.create("An Empty One", DIM)
    store.drop("src3")
    listed = spark.createDataFrame(
        [(name, store.exists(name)) for name in store.names()], "corpus string, found boolean"
    )
    sizes = store.read().groupBy(ids.corpus_of_table(F.col("table_name")).alias("corpus")).agg(
        F.count(F.lit(1)).alias("chunks"), F.max(F.size("vector")).alias("dim")
    )
    return listed.join(sizes, "corpus", "left").fillna(0, ["chunks"])


@query
def guarded_open(spark, sf_dir):
    """Reading, searching and counting corpora under names that exist, in another spelling, and not."""
    store = CorpusStore(spark, f"{storage.shared_folder(spark)}/guarded-{uuid.uuid4().hex}")
    index_documents(document_files(spark, sf_dir), store, HashingEmbedder(DIM, CHUNK_TOKENS))
    asked = []
    for plain in store.names():
        for name in (plain, plain.upper(), f"{plain} missing"):
            try:
                refused = store.read(name) is None
            except ValueError as error:
                refused = str(error) == f"corpus {name!r} does not exist"
            found = store.exists(name)
            asked.append((name, plain, found, refused, not found and store.stats(name) is None))
    answers = spark.createDataFrame(asked, "name string, corpus string, found boolean, refused boolean, no_stats boolean")
    rows = store.read().groupBy(ids.corpus_of_table(F.col("table_name")).alias("corpus")).agg(F.count(F.lit(1)).alias("chunks"))
    first = store.search(store.names()[0] + " missing", [0.0] * DIM)  # no rows, whatever the question
    hits = first.agg(F.count(F.lit(1)).alias("hits_of_missing"))
    counted = answers.join(rows, "corpus", "left").join(F.broadcast(hits))
    return counted.withColumn("chunks", F.when(F.col("found"), F.col("chunks")).otherwise(0)).drop("corpus")


@query
def index_documents_rows(spark, sf_dir):
    """The rows indexing stores, with a digest of the vector."""
    rows = corpus_chunks(spark, sf_dir)
    return rows.select(
        *(c for c in rows.columns if c not in ("modified_at", "vector")), _digest()
    )


# -- questions to texts --------------------------------------------------------


def _rag_hits(spark, sf_dir, **options) -> DataFrame:
    return query_chunks(
        corpus_chunks(spark, sf_dir),
        questions(spark, sf_dir),
        HashingEmbedder(DIM),
        **options,
    )


def _hit_rows(hits: DataFrame) -> DataFrame:
    return _scored(
        hits, "query_id", "rank", "id", "file_path", "extension", "start_line", "end_line",
        "chunk_index", "total_chunks",
    )


@query
def rag_query(spark, sf_dir):
    return _hit_rows(_rag_hits(spark, sf_dir))


@query
def rag_query_stored(spark, sf_dir):
    """The same over stored corpora: texts and paths are read for the hits only."""
    store = CorpusStore(spark, f"{storage.shared_folder(spark)}/asked-{uuid.uuid4().hex}")
    index_documents(document_files(spark, sf_dir), store, HashingEmbedder(DIM, CHUNK_TOKENS))
    return _hit_rows(query_chunks(store.read(), questions(spark, sf_dir), HashingEmbedder(DIM)))


@query
def rag_query_failed(spark, sf_dir):
    """Questions the model fails on find nothing; the others what they always find."""
    chunks = corpus_chunks(spark, sf_dir)
    hits = query_chunks(chunks, questions(spark, sf_dir), _Refusing(DIM), on_failed_query="skip")
    return _hit_rows(hits)


@query
def hybrid_search(spark, sf_dir):
    """Fused ranks of the 20 best chunks by vector and by keyword."""
    by_vector = _rag_hits(spark, sf_dir, limit=20)
    by_keyword = hybrid.keyword_ranks(corpus_chunks(spark, sf_dir), questions(spark, sf_dir), 20)
    return hybrid.fused(by_vector, by_keyword, 5).withColumn("score", F.round("score", 9))


@query
def keyword_search(spark, sf_dir):
    """BM25 over whole documents."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return hybrid.keyword_ranks(documents, questions(spark, sf_dir), 10, "text", ["doc_id"])


@query
def keyword_indexed(spark, sf_dir):
    """The same hits from a stored index, opened again after it was built."""
    documents = table(spark, sf_dir, "documents")
    location = f"{storage.shared_folder(spark)}/keyword-index-{uuid.uuid4().hex}"
    KeywordIndex.build(documents, location, "text", ["doc_id"])
    return KeywordIndex(spark, location).search(questions(spark, sf_dir), 10)


@query
def page_index(spark, sf_dir):
    """Pages as text, one corpus per host, chunked and embedded."""
    pages = table(spark, sf_dir, "pages")
    shown = pages.withColumn("text", html.page_text(F.col("html"))).withColumn("host", html.host(F.col("url")))
    files = documents_as_files(shown, F.col("page_id").cast("string"), "text", "host")
    done = indexing.embed_chunks(indexing.chunk_documents(files, max_tokens=CHUNK_TOKENS), HashingEmbedder(DIM))
    return done.select(
        "codebase_name",
        "file_path",
        "chunk_index",
        "content",
        _digest(),
    )


def _then_and_now(spark, sf_dir, number: Column) -> tuple[DataFrame, DataFrame]:
    """Before, files numbered 0 modulo 10 were not there and those numbered 1 had another text; now those numbered 2 are gone."""
    documents = table(spark, sf_dir, "documents")
    kind = number % 10
    text_then = F.when(kind == 1, F.concat(F.lit("draft "), F.col("text"))).otherwise(F.col("text"))
    then = documents_as_files(
        documents.where(kind != 0).withColumn("text", text_then), document_path(), "text", "source"
    )
    return then, documents_as_files(documents.where(kind != 2), document_path(), "text", "source")


def _chunks_per_file(rows: DataFrame, *keys) -> DataFrame:
    return rows.groupBy("codebase_name", "file_path", *keys).agg(
        F.count(F.lit(1)).alias("chunks"), F.sum(F.length("content").cast("bigint")).alias("characters")
    )


@query
def incremental_apply(spark, sf_dir):
    """A store refreshed from what there was then to what there is now: per file its rows, and whether the refresh wrote them."""
    then, now = _then_and_now(spark, sf_dir, F.floor(F.col("doc_id") / 7))
    store = CorpusStore(spark, f"{storage.shared_folder(spark)}/refreshed-{uuid.uuid4().hex}")
    embedder = HashingEmbedder(DIM, CHUNK_TOKENS)
    incremental.refresh_corpora(store, then, embedder)
    incremental.refresh_corpora(store, now, embedder)
    new = F.contains(F.col("_metadata.file_path"), F.lit("/segment=000000000002-")).alias("rewritten")
    return _chunks_per_file(store.read().select("codebase_name", "file_path", "content", new), "rewritten")


@query
def index_stream_rows(spark, sf_dir):
    """What a stream of documents stores, each under its path; the stream is started again and finds nothing new."""
    folder = f"{storage.shared_folder(spark)}/streamed-{uuid.uuid4().hex}"
    given = table(spark, sf_dir, "documents").schema
    for _ in range(2):
        arriving = spark.readStream.schema(given).parquet(f"{sf_dir}/documents.parque[t]")  # a pattern may also name one file
        files = documents_as_files(arriving, document_path(), "text", "source")
        writer = index_stream(files, f"{folder}/store", f"{folder}/log", HashingEmbedder(DIM, CHUNK_TOKENS), upsert=True)
        writer.trigger(availableNow=True).start().awaitTermination()
    rows = CorpusStore(spark, f"{folder}/store").read()
    return rows.select(*(c for c in rows.columns if c not in ("modified_at", "vector", "table_name")), _digest())


@query
def incremental_delta(spark, sf_dir):
    """Per file: what happened to it, and its chunks and characters in the refreshed table."""
    then, now = _then_and_now(spark, sf_dir, F.col("doc_id"))
    embedder = HashingEmbedder(DIM)
    stored = with_defaults(indexing.embed_chunks(indexing.chunk_documents(then, max_tokens=CHUNK_TOKENS), embedder))
    changes = incremental.file_changes(incremental.fingerprints(then), incremental.fingerprints(now))
    rows = incremental.refreshed_chunks(stored, now, changes, embedder)
    joined = changes.join(_chunks_per_file(rows), ["codebase_name", "file_path"], "left")
    return joined.fillna(0, ["chunks", "characters"])


@query
def rag_query_filtered(spark, sf_dir):
    return _hit_rows(
        _rag_hits(spark, sf_dir, extension_filter=".py", limit=3, min_similarity=MIN_SIMILARITY)
    )


@query
def rag_query_prefixed(spark, sf_dir):
    return _hit_rows(_rag_hits(spark, sf_dir, use_prefix=True, metric="cosine", limit=4))


@query
def render_human(spark, sf_dir):
    hits = _rag_hits(spark, sf_dir, min_similarity=MIN_SIMILARITY)
    return context_texts(hits, questions(spark, sf_dir), "human", PREVIEW)


@query
def render_machine(spark, sf_dir):
    return context_texts(_rag_hits(spark, sf_dir), questions(spark, sf_dir), "machine")
