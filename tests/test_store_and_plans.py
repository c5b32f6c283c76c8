"""The store, the two pipelines on a tree of files, rendering, and the stream."""

import os
import shutil
from collections import Counter

import pytest
from pyspark.sql import functions as F

import shelfmark as sm
from shelfmark.functions.globs import pruning_regex
from shelfmark.operators import stats
from shelfmark.schema import chunk_schema, hit_schema
from shelfmark.sources.corpus import with_defaults
from shelfmark.sources.files import ignore_patterns
from shelfmark.streaming.ingest import index_stream
from tests.conftest import SF_DIR

EMBEDDER = sm.HashingEmbedder(16)
FILES = {
    "main.py": b"def main():\n    return 'hello world'\n" * 40,
    "__init__.py": b"VERSION = 1\n",
    ".eslintrc": b"{}",
    "src/_private/a b+c%20.md": "# Über\r\nzwei\rdrei".encode(),
    "src/latin.txt2": b"\xe9t\xe9\n",
    "src/deep/er/still/x.JS": b"let x = 1\n",
    "exactly.txt": b"a" * 1_000_000,
    "toobig.txt": b"a" * 1_000_001,
    "empty.txt": b"",
    "image.dat": b"\x00\x01",
    "named.txt": b"\x00 text by name",
    "late.bin": b"a" * 1024 + b"\0",
    "skip.me": b"x",
    "src/skip.me": b"x",
    "build/out.py": b"x",
    "node_modules/m/i.js": b"x",
    ".git/config": b"x",
    "a.log": b"x",
    "extra/one.py": b"x",
    ".gitignore": b"# comment\n\n *.me \n",
}
NOT_FOUND = {
    "skip.me", "src/skip.me", "build/out.py", "node_modules/m/i.js", ".git/config", "a.log",
    "extra/one.py", ".gitignore",
}
SKIPPED = {"toobig.txt", "empty.txt", "image.dat"}


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for name, data in FILES.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    os.utime(root / "main.py", (1_700_000_000, 1_700_000_000))
    return str(root)


@pytest.fixture
def store(spark, tmp_path):
    return sm.CorpusStore(spark, str(tmp_path / "store"))


def test_walk(spark, tree):
    assert {r.path[len(tree) + 1 :] for r in sm.scan_files(spark, tree).collect()} == set(FILES)
    for levels in (1, 4):
        assert sm.scan_files(spark, tree, entries=levels).count() == len(FILES)
    walked = {r.file_path: r for r in sm.walk_files(spark, tree, ["extra/*"]).collect()}
    assert set(walked) == set(FILES) - NOT_FOUND
    assert all(r.length == len(FILES[name]) for name, r in walked.items())
    assert walked["main.py"].absolute_path == f"{tree}/main.py"
    assert ignore_patterns(tree) == ["*.me"]
    assert sm.scan_files(spark, f"file://{tree}").count() == len(FILES)


def test_read_contents(spark, tree):
    files = sm.walk_files(spark, tree)
    got = {r.file_path: bytes(r.content) for r in sm.read_contents(files, tree, 3).collect()}
    assert got == {name: FILES[name] for name in got} and "__init__.py" in got
    gone = files.withColumn("absolute_path", F.lit(f"{tree}/nothing"))
    assert {r.content for r in sm.read_contents(gone, tree).collect()} == {None}


def test_index_a_tree(spark, tree, store):
    result = sm.index_files(spark, tree, "My Tree", store, EMBEDDER, ["extra/*"])
    found = set(FILES) - NOT_FOUND
    assert result["total_files_found"] == len(found)
    assert result["files_processed"] == len(found - SKIPPED)
    assert result["files_skipped"] == len(SKIPPED)
    assert result["files_failed"] == result["chunks_failed"] == 0
    rows = store.read("my tree").collect()
    assert len(rows) == result["chunks_created"]
    by_file = {}
    for r in rows:
        by_file.setdefault(r.file_path, []).append(r)
    assert set(by_file) == found - SKIPPED
    main = sorted(by_file["main.py"], key=lambda r: r.chunk_index)
    assert len(main) > 1 and {r.total_chunks for r in main} == {len(main)}
    assert main[0].modified_at == "2023-11-14T22:13:20"
    assert main[0].size_bytes == len(FILES["main.py"]) and main[0].language == "python"
    assert len({r.id for r in main}) == 1 and main[0].codebase_name == "My Tree"
    (md,) = by_file["src/_private/a b+c%20.md"]
    assert md.content == "# Über\nzwei\ndrei" and (md.start_line, md.end_line) == (1, 3)
    assert by_file["src/latin.txt2"][0].content == "été\n"
    assert by_file["src/deep/er/still/x.JS"][0].extension == ".JS"
    assert by_file["src/deep/er/still/x.JS"][0].language == "javascript"
    assert all(len(r.vector) == 16 for r in rows)

    again = sm.index_files(spark, tree, "My Tree", store, EMBEDDER, ["extra/*"])
    assert store.count("my tree") == 2 * again["chunks_created"]  # appends
    small = sm.index_files(
        spark, tree, "My Tree", store, EMBEDDER, ["extra/*"], max_file_size=999_999, replace=True
    )
    assert small["files_skipped"] == len(SKIPPED) + 1
    assert store.count("my tree") == small["chunks_created"] < result["chunks_created"]


def test_index_an_empty_tree(spark, tmp_path, store):
    (tmp_path / "nothing").mkdir()
    result = sm.index_files(spark, str(tmp_path / "nothing"), "none", store, EMBEDDER)
    assert result["total_files_found"] == result["files_processed"] == result["chunks_created"] == 0
    assert store.exists("none") and store.count("none") == 0


def test_failures_of_the_model_are_counted(spark, tree, store):
    def load():
        def model(texts):
            if any("hello" in t for t in texts):
                raise RuntimeError("no")
            return [[1.0, 2.0] for _ in texts]

        return model

    result = sm.index_files(spark, tree, "m", store, sm.ModelEmbedder(load, 2, pause_seconds=0), max_file_size=9999)
    zero = store.read("m").where(F.forall("vector", lambda v: v == 0)).count()
    assert result["chunks_failed"] == zero > 0
    assert result["chunks_created"] == store.count("m") > zero


def test_bad_vectors_can_be_dropped_or_zeroed(spark, tree, store):
    def load():
        return lambda texts: [[float("nan"), 1.0] if "hello" in t else [1.0, 2.0] for t in texts]

    model = sm.ModelEmbedder(load, 2)
    every = sm.index_files(spark, tree, "n", store, model, max_file_size=9999)["chunks_created"]
    bad = store.read("n").where(F.exists("vector", F.isnan)).count()
    assert bad > 0
    sm.index_files(spark, tree, "d", store, model, max_file_size=9999, on_invalid="drop")
    assert store.count("d") == every - bad
    sm.index_files(spark, tree, "z", store, model, max_file_size=9999, on_invalid="zero")
    assert store.count("z") == every
    assert store.read("z").where(F.exists("vector", F.isnan)).count() == 0
    asked = spark.createDataFrame([(1, "q")], "query_id int, query_text string")
    options = {"limit": every, "min_similarity": 0.0}
    assert sm.query_corpus(store, "z", asked, model, **options).count() == every
    kept = sm.query_corpus(store, "z", asked, model, skip_zero_vectors=True, **options)
    assert kept.count() == every - bad


def chunks(spark, rows):
    return spark.createDataFrame(rows, "file_path string, content string, vector array<float>")


def test_create_list_drop(spark, store):
    assert store.names() == [] and store.stats() is None and not store.exists("a")
    assert store.create("My Repo!", 4) == "my_repo_rag"
    assert store.create("my repo", 8) == "my_repo_rag"
    assert store.dimension("MY REPO") == 4
    store.create("x_rag_y", 4)
    assert store.names() == ["my_repo", "x_rag_y"]
    assert store.exists("my-repo") is False and store.exists("My Repo")
    assert store.count("my repo") == 0 and store.stats("nobody") is None
    assert store.drop("my repo") is True and store.drop("my repo") is False
    assert store.names() == ["x_rag_y"]
    assert store.drop_all() == 1 and store.names() == []
    with pytest.raises(ValueError):
        store.create("!!", 4)
    with pytest.raises(ValueError):
        store.create("a", 0)


def test_append_fills_defaults(spark, store):
    store.append(chunks(spark, [("a.py", None, [1.0, 0.0])]), "R", dim=2)
    row = store.read("R").head()
    assert row.content == "" and row.extension == "" and row.language == "" and row.size_bytes == 0
    assert (row.start_line, row.end_line, row.chunk_index, row.total_chunks) == (1, 1, 0, 1)
    assert row.absolute_path == "" and row.modified_at and len(row.id) == 16
    assert store.read("R").drop("table_name").schema.names == chunk_schema().names
    store.append(chunks(spark, []), "R")
    assert store.count("R") == 1 and store.dimension("R") == 2
    given = chunks(spark, [("a.py", "x", [1.0, 0.0])]).withColumn("id", F.lit("mine"))
    assert with_defaults(given, "R").head().id == "mine"
    with pytest.raises(ValueError):
        with_defaults(given.drop("vector"), "R")


def test_wrong_length_adds_nothing(spark, store):
    store.create("R", 2)
    with pytest.raises(Exception, match="length 2"):
        store.append(chunks(spark, [("a", "x", [1.0, 0.0]), ("b", "x", [1.0])]), "R")
    assert store.count("R") == 0


def test_replace_leaves_other_corpora(spark, store):
    for name in ("a", "b"):
        store.append(chunks(spark, [(f"{name}{i}", "x", [1.0, 0.0]) for i in range(3)]), name, 2)
    store.replace(chunks(spark, [("new", "x", [0.0, 1.0])]), "a")
    assert [r.file_path for r in store.read("a").collect()] == ["new"]
    assert store.count("b") == 3 and store.dimension("a") == 2
    store.replace(chunks(spark, []), "a")
    assert store.count("a") == 0 and store.exists("a") and store.dimension("a") == 2
    assert store.count("b") == 3


def test_unknown_corpus(spark, store):
    with pytest.raises(ValueError):
        store.read("nobody")
    nothing = store.search("nobody", [1.0])
    assert nothing.count() == 0 and nothing.schema.names == hit_schema().names
    with pytest.raises(ValueError):
        sm.query_database(store, "nobody", "q", EMBEDDER)


def test_search_in_store(spark, store):
    rows = [(f"f{i}.py", f"text {i}", [float(i), 0.0]) for i in range(10)]
    store.append(chunks(spark, rows).withColumn("extension", F.lit(".py")), "r", 2)
    hits = store.search("r", [3.2, 0.0]).collect()
    assert [h.file_path for h in hits] == ["f3.py", "f4.py", "f2.py", "f5.py", "f1.py"]
    assert hits[0].similarity == pytest.approx(1 / (1 + 0.04), abs=1e-6)
    assert store.search("r", [3.2, 0.0], where="extension = '.md'").count() == 0
    asked = spark.createDataFrame([(7, [9.0, 0.0])], "query_id int, query_vector array<float>")
    batch = store.search_batch("r", asked, k=2).orderBy("rank").collect()
    assert [(h.query_id, h["rank"], h.file_path) for h in batch] == [(7, 1, "f9.py"), (7, 2, "f8.py")]


def test_only_one_partition_is_read(spark, store):
    for name in ("a", "b"):
        store.append(chunks(spark, [("x", "x", [1.0, 0.0])]), name, 2)
    assert all("table_name=a_rag" in f for f in store.read("a").inputFiles())
    plan = stats.corpus_stats(store.read("a"))._jdf.queryExecution().executedPlan().toString()
    assert "vector" not in plan and "content" not in plan


def test_corpus_stats_with_more_extensions_than_the_map_holds(spark):
    rows = [("a", f"f{e}_{i}.x{e:02}", f".x{e:02}") for e in range(40) for i in range(1 + e % 3)]
    rows += [("b", "only.py", ".py")] * 2 + [(None, "no name.py", ".py")]
    chunks = spark.createDataFrame(rows, "codebase_name string, file_path string, extension string")
    found = {r["codebase_name"]: r for r in stats.corpus_stats(chunks, 5).collect()}
    largest = sorted(Counter(e for c, _, e in rows if c == "a").items(), key=lambda x: (-x[1], x[0]))
    others = sum(n for _, n in largest[5:])
    assert found["a"]["extension_distribution"] == dict(largest[:5]) | {stats.OTHER_EXTENSIONS: others}
    assert found["a"]["total_chunks"] == found["a"]["total_files"] == sum(n for _, n in largest)
    assert found["b"]["extension_distribution"] == {".py": 2} and found["b"]["total_files"] == 1
    assert len(found) == 3
    whole = {r["codebase_name"]: r["extension_distribution"] for r in stats.corpus_stats(chunks).collect()}
    assert whole["a"] == dict(largest)
    plan = stats.corpus_stats(chunks, 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") == 1  # what gives the chunks runs once
    with pytest.raises(ValueError):
        stats.corpus_stats(chunks, 0)
    assert stats.corpus_stats(chunks.where("false")).count() == 0


def test_corpus_stats_of_very_many_extensions(spark, store):
    rows = [(f"f{e}_{i}.x{e}", "", [0.0]) for e in range(1300) for i in range(1 + (e == 7))]
    store.append(
        chunks(spark, rows).withColumn("extension", F.regexp_extract("file_path", r"\..*", 0)), "a", 1
    )
    row = store.stats("a").head()
    assert row.extension_distribution == {f".x{e}": 1 + (e == 7) for e in range(1300)}
    assert row.total_files == row.total_chunks == 1301


def test_corpus_stats(spark, store):
    rows = [("a.py", "1", [0.0]), ("a.py", "2", [0.0]), ("b.md", "3", [0.0])]
    store.append(
        chunks(spark, rows).withColumn("extension", F.regexp_extract("file_path", r"\..*", 0)), "A", 1
    )
    row = store.stats("a").head()
    assert (row.codebase_name, row.table_name, row.total_files, row.total_chunks) == ("A", "a_rag", 2, 3)
    assert row.extension_distribution == {".py": 2, ".md": 1}


QUESTIONS = [(1, "hello world"), (2, "   "), (3, None)]


def test_query_to_text(spark, tree, store):
    sm.index_files(spark, tree, "t", store, EMBEDDER, max_file_size=9999)
    asked = spark.createDataFrame(QUESTIONS, "query_id int, query_text string")
    hits = sm.query_corpus(store, "t", asked, EMBEDDER, limit=2, extension_filter=".py")
    rows = hits.orderBy("rank").collect()
    assert {r.query_id for r in rows} == {1} and len(rows) == 2
    assert all(r.extension == ".py" for r in rows)

    def label(r):
        more = f", chunk {r.chunk_index + 1}/{r.total_chunks}" if r.total_chunks > 1 else ""
        return f"{r.file_path} (lines {r.start_line}-{r.end_line}{more})"

    human = ["Found 2 relevant files:\n"]
    for i, r in enumerate(rows, 1):
        human += [f"{i}. {label(r)}", f"   Similarity: {r.similarity:.3f} | Size: {r.size_bytes} bytes"]
    human.append("\n" + "=" * 60 + "\n")
    for i, r in enumerate(rows, 1):
        body = r.content if len(r.content) <= 50 else r.content[:50] + "\n... (truncated)"
        human += [f"## {i}. {label(r)}\n", body, "\n" + "-" * 60 + "\n"]
    texts = {r.query_id: r.text for r in sm.context_texts(hits, asked, "human", 50).collect()}
    assert texts[1] == "\n".join(human)
    assert texts[2] == texts[3] == "No results found."

    machine = ["Found 2 relevant files:\n"]
    for i, r in enumerate(rows, 1):
        machine += [
            f"\n## {i}. {label(r)}",
            f"**Relevance:** {r.similarity:.2%} | **Type:** {r.extension}",
            "\n```", r.content, "```\n",
        ]
    texts = {r.query_id: r.text for r in sm.context_texts(hits, asked, "machine").collect()}
    assert texts[1] == "\n".join(machine)
    one = sm.query_database(
        store, "t", "hello world", EMBEDDER, 2, "machine", extension_filter=".py"
    )
    assert one == "\n".join(machine)
    assert sm.query_database(store, "t", " ", EMBEDDER) == "No results found."
    with pytest.raises(ValueError):
        sm.render(hits, style="other")


def test_numbers_in_texts_have_no_gaps(spark):
    hits = spark.createDataFrame(
        [(1, r, f"f{r}", "c", ".py", 1, 1, 1, 0, 1, 0.5) for r in (2, 5)],
        "query_id int, rank int, file_path string, content string, extension string, size_bytes int,"
        " start_line int, end_line int, chunk_index int, total_chunks int, similarity double",
    )
    text = sm.render(hits).head().text
    assert "\n1. f2 " in text and "\n2. f5 " in text


def documents(df):
    path = F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))
    return sm.documents_as_files(df, path, "text", "source")


def test_index_many_corpora_at_once(spark, store):
    table = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    hot = table.withColumn("source", F.when(F.col("doc_id") % 3 == 0, F.lit("hot")).otherwise(F.col("source")))
    result = sm.index_documents(documents(hot), store, EMBEDDER)
    assert result["files_processed"] == table.count()
    assert set(store.names()) == {r.source for r in hot.select("source").distinct().collect()}
    assert store.read().count() == result["chunks_created"]
    totals = store.stats().agg(F.sum("total_files"), F.sum("total_chunks")).head()
    assert tuple(totals) == (result["files_processed"], result["chunks_created"])


def test_stream_counts_each_document_once(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "store")
    source.mkdir()
    shutil.copyfile(f"{SF_DIR}/documents.parquet", source / "1.parquet")
    table = spark.read.parquet(str(source / "1.parquet"))
    direct = sm.CorpusStore(spark, str(tmp_path / "direct"))
    sm.index_documents(documents(table), direct, EMBEDDER)

    def run():
        stream = documents(spark.readStream.schema(table.schema).parquet(str(source)))
        writer = index_stream(stream, target, str(tmp_path / "ck"), EMBEDDER)
        writer.trigger(availableNow=True).start().awaitTermination()

    run()
    streamed = sm.CorpusStore(spark, target)
    columns = ["id", "codebase_name", "content", "chunk_index", "vector", "table_name"]
    key = lambda r: (r.id, r.chunk_index)
    assert sorted(streamed.read().select(columns).collect(), key=key) == sorted(
        direct.read().select(columns).collect(), key=key
    )
    before = streamed.read().count()
    run()
    assert streamed.read().count() == before
    shutil.copyfile(f"{SF_DIR}/documents.parquet", source / "2.parquet")
    run()
    assert streamed.read().count() == 2 * before
    one = streamed.names()[0]
    assert streamed.count(one) == 2 * direct.count(one)


def test_same_results_under_any_number_of_shuffle_partitions(spark):
    from checks.queries import QUERIES

    found = []
    for n in ("1", "4", "16"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        rows = [sorted(map(tuple, QUERIES[q](spark, SF_DIR).collect()))
                for q in ("rag_query", "corpus_stats", "knn_batch_blocks")]
        found.append(rows)
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert found[0] == found[1] == found[2]


def _texts(spark, n=10):
    return spark.range(n).selectExpr(
        "'c' AS codebase_name", "concat(id, '.txt') AS file_path", "concat(id, '.txt') AS absolute_path",
        "10L AS size_bytes", "cast(null AS string) AS modified_at", "concat('text ', id) AS content",
    )


class CountedModel:
    """Appends a line per text to a file; fails on texts that hold 7, gives a NaN for those that hold 3."""

    def __init__(self, log):
        self.log = str(log)

    def __call__(self):
        log = self.log

        def model(texts):
            if len(texts) > 1:
                raise ValueError("one at a time")
            with open(log, "a") as out:
                out.write("x")
            if "7" in texts[0]:
                raise ValueError("seven")
            return [[float("nan") if "3" in texts[0] else 1.0, 2.0]]

        return model


def _model(log):
    return sm.ModelEmbedder(CountedModel(log), dim=2, batch_size=1, attempts=1)


@pytest.mark.parametrize("on_invalid", [None, "drop", "zero"])
def test_a_model_sees_each_text_once_and_counters_add_up(spark, store, tmp_path, on_invalid):
    # a batch of one that fails is tried once more alone
    log = tmp_path / "calls"
    result = sm.index_documents(_texts(spark), store, _model(log), name="c", on_invalid=on_invalid)
    assert len(log.read_text()) == 11
    dropped = 1 if on_invalid == "drop" else 0
    assert result["chunks_created"] == 10 - dropped == store.count("c")
    assert (result["files_processed"], result["files_failed"], result["files_skipped"]) == (9, 1, 0)


def test_failed_questions(spark, store, tmp_path):
    sm.index_documents(_texts(spark), store, _model(tmp_path / "log"), name="c", on_invalid="zero")
    asked = spark.createDataFrame([(1, "good"), (2, "bad 7")], "query_id long, query_text string")
    log = tmp_path / "asked"
    hits = sm.query_chunks(
        store.read("c"), asked, _model(log), on_failed_query="skip", skip_zero_vectors=True, min_similarity=0.0
    )
    assert {r["query_id"] for r in hits.collect()} == {1}
    with pytest.raises(Exception, match="failed on query 2"):
        sm.query_chunks(store.read("c"), asked, _model(log)).collect()


def test_statistics_of_empty_and_twice_spelled_corpora(spark, store, tmp_path):
    store.create("Empty", 2)
    texts = _texts(spark).withColumn("codebase_name", F.when(F.col("file_path") < "5", "My App").otherwise("my_app"))
    sm.index_documents(texts, store, _model(tmp_path / "log"))
    rows = {r["table_name"]: r for r in store.stats().collect()}
    assert rows["empty_rag"]["total_files"] == 0 and rows["empty_rag"]["extension_distribution"] == {}
    assert rows["my_app_rag"]["total_files"] == 10 and len(rows) == 2
    assert store.stats("Empty").head()["total_chunks"] == 0 and store.stats("none") is None


def test_unusable_names_and_wrong_lengths_are_refused(spark, store, tmp_path):
    for name in ("!!", None):
        with pytest.raises(Exception, match="no character usable"):
            sm.index_documents(
                _texts(spark).withColumn("codebase_name", F.lit(name).cast("string")), store, _model(tmp_path / "log")
            )
    sm.index_documents(_texts(spark), store, _model(tmp_path / "log"), name="c", on_invalid="zero")
    with pytest.raises(ValueError, match="3 entries"):
        store.search("c", [1.0, 2.0, 3.0])
    asked = spark.createDataFrame([(1, [1.0, 2.0, 3.0])], "query_id long, query_vector array<float>")
    with pytest.raises(Exception, match="has not the 2 entries"):
        store.search_batch("c", asked).collect()


def test_links_to_folders_are_not_followed(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "f.py").write_text("x")
    (tmp_path / "a" / "loop").symlink_to(tmp_path)
    assert [r["path"] for r in sm.scan_files(spark, str(tmp_path)).collect()] == [f"{tmp_path}/a/f.py"]


def test_thresholds_and_similarity_of_products(spark):
    from shelfmark.functions.vectors import similarity
    from shelfmark.operators.filters import similar_enough

    rows = spark.createDataFrame([(float("nan"),), (-2.0,), (-1.0,), (0.0,), (3.0,)], "d double")
    graded = rows.select("d", similarity(F.col("d")).alias("similarity"))
    assert [r["d"] for r in similar_enough(graded, 0.5).orderBy("d").collect()] == [-2.0, -1.0, 0.0]
    assert [r["similarity"] for r in graded.where("d = d and not isnan(d)").orderBy("d").collect()] == [3.0, 2.0, 1.0, 0.25]


def test_only_changed_files_are_embedded_again(spark, store, tmp_path):
    from shelfmark.plans.incremental import file_changes, fingerprints, refreshed_chunks

    old = _texts(spark)
    sm.index_documents(old, store, _model(tmp_path / "first"), name="c")
    said = F.when(F.col("file_path") == "3.txt", F.lit("new text")).otherwise(F.col("content"))
    new = old.where("file_path <> '4.txt'").withColumn("content", said)
    new = new.unionByName(_texts(spark, 11).where("file_path = '10.txt'"))
    changes = file_changes(fingerprints(old), fingerprints(new))
    status = {r["file_path"]: r["status"] for r in changes.collect() if r["status"] != "same"}
    assert status == {"3.txt": "changed", "4.txt": "deleted", "10.txt": "added"}
    rows = refreshed_chunks(store.read("c"), new, changes, _model(tmp_path / "second"))
    store.replace(rows, "c")
    stored = {r["file_path"]: r["content"] for r in store.read("c").collect()}
    assert stored == {r["file_path"]: r["content"] for r in new.collect()}
    assert len((tmp_path / "second").read_text()) == 2  # one call for each of the two files


def test_repeated_paths_and_null_texts_have_fingerprints(spark):
    from shelfmark.plans.incremental import file_changes, fingerprints

    shape = "codebase_name string, file_path string, content string"
    old = spark.createDataFrame([("c", "a", "x"), ("c", "a", "y"), ("c", "b", None)], shape)
    new = spark.createDataFrame([("c", "a", "y"), ("c", "a", "x"), ("c", "b", "")], shape)
    assert {r["status"] for r in file_changes(fingerprints(old), fingerprints(new)).collect()} == {"same"}
    more = spark.createDataFrame([("c", "a", "y"), ("c", "a", "z"), ("c", "b", "")], shape)
    assert {r["status"] for r in file_changes(fingerprints(old), fingerprints(more)).collect()} == {"same", "changed"}
    empty = spark.createDataFrame([], shape)
    assert {r["status"] for r in file_changes(fingerprints(empty), fingerprints(new)).collect()} == {"added"}


def test_a_walk_goes_on_where_a_task_stopped_and_leaves_out_pruned_folders(spark, tmp_path):
    trunk = tmp_path
    for depth in range(6):
        trunk = trunk / f"d{depth}"
        trunk.mkdir()
        (trunk / "a.py").write_text("x")
    for name in ("node_modules", "kept", "gen"):
        (tmp_path / name / "sub").mkdir(parents=True)
        (tmp_path / name / "sub" / "b.js").write_text("x")
    every = {str(p) for p in tmp_path.rglob("*") if p.is_file()}
    for entries in (1, 3, None):
        found = [r.path for r in sm.scan_files(spark, str(tmp_path), entries=entries).collect()]
        assert sorted(found) == sorted(every)
    pruned = pruning_regex(["node_modules", "d3"], ["gen/"], ["kept", "!kept/sub/b.js"])
    found = {r.path[len(str(tmp_path)) + 1 :] for r in sm.scan_files(spark, str(tmp_path), entries=2, pruned=pruned).collect()}
    assert found == {"d0/a.py", "d0/d1/a.py", "d0/d1/d2/a.py", "kept/sub/b.js"}
    walked = {r.file_path for r in sm.walk_files(spark, str(tmp_path), ["d1", "!a.py"]).collect()}
    assert walked == {f[len(str(tmp_path)) + 1 :] for f in every if "node_modules" not in f}


def _versions(spark, texts):
    rows = [(path, text, corpus) for path, text, corpus in texts]
    frame = spark.createDataFrame(rows, "path string, body string, corpus string")
    return sm.documents_as_files(frame, F.col("path"), "body", "corpus")


def _held(store):
    return sorted((r["table_name"], r["file_path"], r["content"]) for r in store.read().collect())


def test_a_failed_replacement_changes_no_corpus(spark, store, monkeypatch):
    first = chunks(spark, [("a", "old", [1.0, 0.0]), ("b", "old", [1.0, 0.0])])
    both = first.withColumn("codebase_name", F.when(F.col("file_path") == "a", "one").otherwise("two"))
    store.append(both, dim=2)
    before = _held(store)
    failing = both.withColumn("content", F.when(F.col("file_path") == "b", F.raise_error(F.lit("lost"))).otherwise(F.lit("new")))
    with pytest.raises(Exception, match="lost"):
        store.replace(failing)
    assert _held(store) == before

    def killed(*_):
        raise KeyboardInterrupt  # after all rows are written, before the version is

    with monkeypatch.context() as patch:
        patch.setattr("shelfmark.sources.storage.write_new_text", killed)
        with pytest.raises(KeyboardInterrupt):
            store.replace(both.withColumn("content", F.lit("new")))
    assert _held(store) == before
    store.replace(both.withColumn("content", F.lit("new")))
    assert {content for _, _, content in _held(store)} == {"new"}
    assert store.vacuum() > 0 and {content for _, _, content in _held(store)} == {"new"}


def test_two_writers_keep_each_others_rows(spark, store, monkeypatch):
    from shelfmark.sources import storage

    plain, raced = storage.write_new_text, []

    def slower(session, location, text):
        if not raced:  # another writer takes the number first
            raced.append(location)
            monkeypatch.setattr("shelfmark.sources.storage.write_new_text", plain)
            store.append(chunks(spark, [("fast", "x", [1.0, 0.0])]), "c", 2)
        return plain(session, location, text)

    monkeypatch.setattr("shelfmark.sources.storage.write_new_text", slower)
    store.append(chunks(spark, [("slow", "x", [1.0, 0.0])]), "c", 2)
    assert raced and {path for _, path, _ in _held(store)} == {"fast", "slow"}


def test_a_refresh_writes_changed_files_only(spark, store):
    then = [("a.py", "one", "x"), ("b.py", "two", "x"), ("gone.py", "three", "x"), ("c.py", "four", "y"), (None, "no path", "x")]
    now = [("a.py", "one", "x"), ("b.py", "two changed", "x"), ("new.py", "five", "X"), ("c.py", "four", "y"), ("z.py", "zz", "z")]
    assert sm.refresh_corpora(store, _versions(spark, then), EMBEDDER) == {"added": 4, "changed": 0, "deleted": 0, "same": 0}
    assert sm.refresh_corpora(store, _versions(spark, now), EMBEDDER) == {"added": 2, "changed": 1, "deleted": 1, "same": 2}
    want = sorted((f"{c.lower()}_rag", p, t) for p, t, c in now)
    assert _held(store) == want
    files = store.read().select("file_path", F.col("_metadata.file_path").alias("f")).collect()
    assert {r["file_path"] for r in files if "segment=000000000002-" in r["f"]} == {"b.py", "new.py", "z.py"}
    assert sm.refresh_corpora(store, _versions(spark, now), EMBEDDER)["same"] == 5
    store.vacuum()
    assert _held(store) == want and store.count("x") == 3
    # back again: a file that went and came counts once, and only the named corpus is looked at
    assert sm.refresh_corpora(store, _versions(spark, then[:3]), EMBEDDER, "x") == {"added": 1, "changed": 1, "deleted": 1, "same": 1}
    assert [r[1:] for r in _held(store) if r[0] == "x_rag"] == [("a.py", "one"), ("b.py", "two"), ("gone.py", "three")]
    assert sm.refresh_corpora(store, _versions(spark, then[:1]).limit(0), EMBEDDER, "x")["deleted"] == 3
    assert store.exists("x") and store.count("x") == 0 and store.count("y") == 1


def test_a_refresh_of_rows_without_fingerprints(spark, store):
    documents = _versions(spark, [("a.py", "one", "x"), ("b.py", "two", "x")])
    sm.index_documents(documents, store, EMBEDDER)
    assert sm.refresh_corpora(store, documents.where("file_path = 'a.py'"), EMBEDDER) == {"added": 0, "changed": 1, "deleted": 1, "same": 0}
    assert _held(store) == [("x_rag", "a.py", "one")]
    store.replace(chunks(spark, [("r", "x", [1.0] * 16)]), "x")
    assert [r[1] for r in _held(store)] == ["r"] and store.fingerprints("x").count() == 0


def test_a_batch_of_a_stream_counts_once(spark, store):
    documents = _versions(spark, [("a.py", "one", "x")])
    for number, texts in ((0, "one"), (0, "ignored"), (1, "two")):
        batch = documents.withColumn("content", F.lit(texts))
        sm.refresh_corpora(store, batch, EMBEDDER, delete_missing=False, stream=("log", number))
    assert _held(store) == [("x_rag", "a.py", "two")]
    rows = chunks(spark, [("r", "x", [1.0] * 16)])
    for number in (2, 2, 1, 3):
        store.append(rows, "x", stream=("log", number))
    assert store.count("x") == 3
