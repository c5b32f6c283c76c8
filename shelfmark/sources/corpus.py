"""The chunk store: one Parquet dataset, one partition directory per write and corpus.

``<root>/segment=<number>/table_name=<sanitized name>_rag/part-*.parquet`` holds the 14
chunk columns. One job can fill many corpora, one scan can serve statistics over all
of them, and a plan over a single corpus touches its directories only.

Nothing written is ever changed. What the store holds is said by its latest version,
``<root>/_versions/<number>``: the segments of each corpus. It is written last and at
once, so a write is seen whole, for all its corpora, or not at all. A refresh
writes the rows of added and changed files as a new segment, and in ``_gone`` the
files whose rows in older segments no longer count; ``_files`` has fingerprints of
files. ``vacuum`` deletes what no version needs any more.
"""

import copy
import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.functions import ids
from shelfmark.operators import search as knn
from shelfmark.operators.stats import table_stats
from shelfmark.schema import EMBEDDING_DIM, chunk_schema, hit_schema, positive
from shelfmark.sources import storage

PARTITION = "table_name"
SEGMENT = "segment"
FILE = ("table_name", "file_path")


def with_defaults(chunks: DataFrame, codebase_name: Column | str | None = None) -> DataFrame:
    """The 14 stored columns, defaults in place of what is missing or null.

    ``file_path`` and ``vector`` must be there. ``modified_at`` becomes the time
    of the query when it is absent.
    """
    for needed in ("file_path", "vector"):
        if needed not in chunks.columns:
            raise ValueError(f"chunks need a {needed} column")

    def given(name: str) -> Column:
        return F.col(name) if name in chunks.columns else F.lit(None)

    if codebase_name is None:
        corpus = F.col("codebase_name")
    else:
        corpus = F.lit(codebase_name) if isinstance(codebase_name, str) else codebase_name
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    defaults = {
        "absolute_path": F.lit(""),
        "content": F.lit(""),
        "extension": F.lit(""),
        "size_bytes": F.lit(0),
        "modified_at": now,
        "language": F.lit(""),
        "start_line": F.lit(1),
        "end_line": F.lit(1),
        "chunk_index": F.lit(0),
        "total_chunks": F.lit(1),
    }
    given_id = F.nullif(given("id").cast("string"), F.lit(""))
    values = {
        "id": F.coalesce(given_id, ids.row_id(corpus, F.col("file_path"))),
        "codebase_name": corpus,
        "file_path": F.col("file_path"),
        "vector": F.col("vector"),
    }
    values.update({name: F.coalesce(given(name), value) for name, value in defaults.items()})
    return chunks.select(
        *(values[f.name].cast(f.dataType).alias(f.name) for f in chunk_schema().fields)
    )


def _applied(version: dict, stream: tuple[str, int] | None) -> bool:
    """Whether a version has this batch of a stream already."""
    return stream is not None and version["streams"].get(stream[0], -1) >= stream[1]


class CorpusStore:
    """Create, fill, replace, drop, list and open corpora below one root folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = storage.qualified(spark, root).rstrip("/")

    # -- names ---------------------------------------------------------------

    def table_name(self, name: str) -> str:
        """Sanitized name and suffix; a name with nothing left is refused."""
        # a one-row relation the optimizer evaluates by itself, without a job
        given = self.spark.sql("SELECT * FROM VALUES (:name) AS t(name)", args={"name": name})
        table = given.select(ids.table_name(F.col("name"))).head()[0]
        if table == ids.TABLE_SUFFIX:
            raise ValueError(f"{name!r} has no character usable in a table name")
        return table

    def tables(self) -> list[str]:
        """Table names, from the store's latest version alone."""
        return sorted(self._version()[1]["tables"])

    def names(self) -> list[str]:
        """Corpus names: table names without their suffix."""
        return [table[: -len(ids.TABLE_SUFFIX)] for table in self.tables()]

    def exists(self, name: str) -> bool:
        return self.table_name(name) in self._version()[1]["tables"]

    # -- versions ------------------------------------------------------------

    def _version(self) -> tuple[int, dict]:
        """Number and content of the latest version; 0 for a store without one."""
        folder = f"{self.root}/_versions"
        numbers = [n for n in storage.child_names(self.spark, folder) if n.isdigit()]
        if not numbers:
            return 0, {"tables": {}, "streams": {}}
        return int(numbers[-1]), json.loads(storage.read_text(self.spark, f"{folder}/{numbers[-1]}"))

    def _commit(self, change: Callable[[dict], None]) -> None:
        """Make ``change`` to the latest version; if another writer was faster, to what that one left."""
        while True:
            number, content = self._version()
            content = copy.deepcopy(content)
            change(content)
            if storage.write_new_text(self.spark, f"{self.root}/_versions/{number + 1:012d}", json.dumps(content)):
                return

    def _new_segment(self) -> str:
        """A name that sorts after those of all segments of the store."""
        used = [s["id"] for t in self._version()[1]["tables"].values() for s in t["segments"]]
        return f"{max((int(s.split('-')[0]) for s in used), default=0) + 1:012d}-{uuid.uuid4().hex}"

    def _segment_folder(self, segment: str, table: str | None = None) -> str:
        return f"{self.root}/{SEGMENT}={segment}" + (f"/{PARTITION}={table}" if table else "")

    def vacuum(self) -> int:
        """Delete segments, corpora in them and versions that the latest version does not need; how many folders and files.

        Reads that began before the latest version may still need them.
        """
        number, content = self._version()
        needed = {(s["id"], table) for table, t in content["tables"].items() for s in t["segments"]}
        ids_needed = {segment for segment, _ in needed}
        deleted = 0
        for child in storage.child_names(self.spark, self.root):
            segment = child.removeprefix(f"{SEGMENT}=")
            if segment == child:
                continue
            if segment not in ids_needed:
                for folder in (f"{self.root}/{child}", f"{self.root}/_files/{segment}", f"{self.root}/_gone/{segment}"):
                    deleted += storage.delete(self.spark, folder)
                continue
            for part in storage.child_names(self.spark, f"{self.root}/{child}"):
                table = part.removeprefix(f"{PARTITION}=")
                if table != part and (segment, table) not in needed:
                    deleted += storage.delete(self.spark, f"{self.root}/{child}/{part}")
        for old in storage.child_names(self.spark, f"{self.root}/_versions"):
            if old.isdigit() and int(old) < number:
                deleted += storage.delete(self.spark, f"{self.root}/_versions/{old}")
        return deleted

    # -- definition ----------------------------------------------------------

    def create(self, name: str, dim: int | None = None) -> str:
        """Make an empty corpus for vectors of length ``dim``; one that exists stays as it is."""
        table = self.table_name(name)
        made = {"dim": positive("dim", dim, EMBEDDING_DIM), "segments": []}
        if not self.exists(name):
            self._commit(lambda version: version["tables"].setdefault(table, made))
        return table

    def dimension(self, name: str) -> int | None:
        """Vector length the corpus was made for; None when nobody ever said."""
        return self._version()[1]["tables"][self.table_name(name)]["dim"]

    def drop(self, name: str) -> bool:
        """Remove a corpus; false when there is none."""
        return self._drop([self.table_name(name)]) > 0

    def drop_all(self) -> int:
        """Remove every corpus; how many there were."""
        return self._drop(self.tables())

    def _drop(self, tables: list[str]) -> int:
        gone: dict[str, dict] = {}

        def remove(version: dict) -> None:
            gone.clear()
            gone.update({t: version["tables"].pop(t) for t in tables if t in version["tables"]})

        if set(tables) & set(self.tables()):
            self._commit(remove)
        for table, content in gone.items():
            for segment in content["segments"]:
                storage.delete(self.spark, self._segment_folder(segment["id"], table))
        return len(gone)

    # -- rows ----------------------------------------------------------------

    def read(self, name: str | None = None) -> DataFrame:
        """Chunks of one corpus, or of all; the schema is known, so no file is opened for it."""
        if name is not None and not self.exists(name):
            raise ValueError(f"corpus {name!r} does not exist")
        tables = self.tables() if name is None else [self.table_name(name)]
        return self._rows(self._version()[1], tables).drop(SEGMENT)

    def _rows(self, version: dict, tables: Sequence[str]) -> DataFrame:
        """The rows that count, with the segment each lies in."""
        schema = chunk_schema().add(PARTITION, T.StringType()).add(SEGMENT, T.StringType())
        wanted = {t: version["tables"][t]["segments"] for t in tables}
        folders = [self._segment_folder(s["id"], t) for t, segments in wanted.items() for s in segments if s["rows"]]
        if not folders:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).option("basePath", self.root).parquet(*folders)
        return self._current(rows, version, tables)

    def _current(self, rows: DataFrame, version: dict, tables: Sequence[str]) -> DataFrame:
        """Rows (table_name, file_path, segment, ...) without those that a later segment says are gone."""
        later = {s["id"] for t in tables for s in version["tables"][t]["segments"] if s.get("gone")}
        if not later:
            return rows
        gone = self.spark.read.schema("_table string, _file string, _segment string").parquet(
            *(f"{self.root}/_gone/{segment}" for segment in sorted(later))
        )
        replaced = (
            (F.col(PARTITION) == F.col("_table"))
            & (F.col("file_path") == F.col("_file"))
            & (F.col(SEGMENT) < F.col("_segment"))
        )
        return rows.join(gone, replaced, "left_anti")

    def fingerprints(self, name: str | None = None) -> DataFrame:
        """``table_name, file_path, fingerprint`` of the files that refreshes stored; others have none."""
        version = self._version()[1]
        tables = [t for t in ([self.table_name(name)] if name is not None else self.tables()) if t in version["tables"]]
        schema = "table_name string, file_path string, fingerprint string, segment string"
        known = {s["id"] for t in tables for s in version["tables"][t]["segments"] if s.get("files")}
        if not known:
            return self.spark.createDataFrame([], schema).drop(SEGMENT)
        rows = self.spark.read.schema(schema).parquet(*(f"{self.root}/_files/{segment}" for segment in sorted(known)))
        # A segment may hold files of corpora that were dropped or replaced since.
        pairs = [(t, s["id"]) for t in tables for s in version["tables"][t]["segments"] if s.get("files")]
        live = self.spark.createDataFrame(pairs, "table_name string, segment string")
        return self._current(rows.join(live, ["table_name", SEGMENT], "left_semi"), version, tables).drop(SEGMENT)

    def _ready(self, chunks: DataFrame, codebase_name, dim: int | None) -> DataFrame:
        rows = with_defaults(chunks, codebase_name)
        if dim is not None:
            bad = F.concat(
                F.lit(f"a vector has not the length {dim} of its corpus: "), F.col("file_path")
            )
            checked = F.when(F.size("vector") == dim, F.col("vector")).otherwise(F.raise_error(bad))
            kept = [c for c in rows.columns if c != "vector"]
            rows = rows.select(*kept, checked.alias("vector", metadata={"dimension": int(dim)}))
        table = ids.table_name(F.col("codebase_name"))
        named = table.isNotNull() & (table != ids.TABLE_SUFFIX)
        unusable = F.concat(
            F.lit("a corpus name has no character usable in a table name: "),
            F.coalesce("codebase_name", F.lit("null")),
        )
        return rows.withColumn(PARTITION, F.when(named, table).otherwise(F.raise_error(unusable).cast("string")))

    def append(
        self,
        chunks: DataFrame,
        name: str | None = None,
        dim: int | None = None,
        stream: tuple[str, int] | None = None,
    ) -> None:
        """Add chunks; nothing stored changes, and repeated rows are added again.

        Without ``name`` each row goes to the corpus its ``codebase_name`` says.
        A vector of another length than ``dim`` (or than the named corpus was
        created for) fails the job, and a failed job adds nothing. ``stream`` names a stream
        and the number of its batch: a batch that was added already is left out.
        """
        self._add(chunks, name, dim, replace=False, stream=stream)

    def replace(
        self, chunks: DataFrame, name: str | None = None, dim: int | None = None
    ) -> None:
        """Swap the content of the corpora that occur in ``chunks``; others stay.

        A named corpus is emptied even if ``chunks`` has no row. All corpora are swapped
        by one step: a failure at any moment leaves all as they were.
        """
        self._add(chunks, name, dim, replace=True)

    def _add(
        self, chunks: DataFrame, name: str | None, dim: int | None, replace: bool, stream: tuple[str, int] | None = None
    ) -> None:
        if _applied(self._version()[1], stream):
            return
        if dim is None and name is not None and self.exists(name):
            dim = self.dimension(name)
        segment, filled = self._written(chunks, name, dim)
        named = [] if name is None else [self.table_name(name)]

        def change(version: dict) -> None:
            if _applied(version, stream):
                return
            if stream is not None:
                version["streams"][stream[0]] = stream[1]
            for table in sorted({*filled, *named}):
                content = version["tables"].setdefault(table, {"dim": dim, "segments": []})
                content["dim"] = dim or content["dim"]
                new = [{"id": segment, "rows": True}] if table in filled else []
                content["segments"] = new if replace else content["segments"] + new

        self._commit(change)

    def _written(self, chunks: DataFrame, name: str | None, dim: int | None) -> tuple[str, list[str]]:
        """A new segment that no version names yet, and the tables it has rows of."""
        segment = self._new_segment()
        folder = self._segment_folder(segment)
        try:
            self._ready(chunks, name, dim).write.partitionBy(PARTITION).parquet(folder)
        except Exception:
            storage.delete(self.spark, folder)
            raise
        prefix = f"{PARTITION}="
        return segment, [c[len(prefix) :] for c in storage.child_names(self.spark, folder) if c.startswith(prefix)]

    def apply(
        self,
        chunks: DataFrame,
        changes: DataFrame,
        dim: int | None = None,
        stream: tuple[str, int] | None = None,
    ) -> None:
        """Make rows of added and changed files count instead of the stored ones, in all corpora by one step.

        ``changes`` has ``table_name, file_path, status, fingerprint`` (see ``plans.incremental``); ``chunks``
        are the rows of its added and changed files. A corpus that another writer changed in the
        meantime makes this fail, with nothing done. ``stream`` names a stream and
        the number of its batch: a batch that was applied already is left out.
        """
        before = self._version()[1]
        if _applied(before, stream):
            return
        segment, filled = self._written(chunks, None, dim)
        fresh = changes.where(F.col("status").isin("added", "changed"))
        files = fresh.select(*FILE, "fingerprint", F.lit(segment).alias(SEGMENT))
        files.write.parquet(f"{self.root}/_files/{segment}")
        gone = changes.where(F.col("status").isin("changed", "deleted"))
        gone.select(F.col("table_name").alias("_table"), F.col("file_path").alias("_file"), F.lit(segment).alias("_segment")).write.parquet(
            f"{self.root}/_gone/{segment}"
        )
        touched = changes.where("status != 'same'").groupBy("table_name").agg(
            F.bool_or(F.col("status").isin("changed", "deleted")).alias("gone"), F.bool_or(F.col("status").isin("added", "changed")).alias("files")
        )
        touched = {row["table_name"]: row for row in touched.collect()}  # a row for each corpus

        def change(version: dict) -> None:
            if _applied(version, stream):
                return
            if stream is not None:
                version["streams"][stream[0]] = stream[1]
            for table, row in touched.items():
                if version["tables"].get(table) != before["tables"].get(table):
                    raise RuntimeError(f"{table} was changed by another writer during a refresh")
                content = version["tables"].setdefault(table, {"dim": dim, "segments": []})
                content["dim"] = dim or content["dim"]
                content["segments"].append({"id": segment, "rows": table in filled, "gone": row["gone"], "files": row["files"]})

        self._commit(change)

    # -- queries -------------------------------------------------------------

    def search(
        self,
        name: str,
        query_vector: Sequence[float],
        limit: int | None = None,
        where: Column | str | None = None,
        filter_mode: str = "pre",
        metric: str = "l2",
    ) -> DataFrame:
        """Nearest chunks of a corpus; no rows when the corpus does not exist."""
        if not self.exists(name):
            return self.spark.createDataFrame([], hit_schema())
        found = knn.nearest(
            self.read(name), query_vector, limit, where, filter_mode, metric, dim=self.dimension(name)
        )
        return found.select(*(f.name for f in hit_schema().fields))

    def search_batch(self, name: str, queries: DataFrame, **options) -> DataFrame:
        """Nearest chunks for each query vector; an unknown corpus is an error."""
        found = knn.nearest_batch(self.read(name), queries, dim=self.dimension(name), **options)
        return found.select("query_id", "rank", *(f.name for f in hit_schema().fields))

    def stats(self, name: str | None = None) -> DataFrame | None:
        """Statistics of one corpus (None when it does not exist), or of all in one scan.

        One row per table, empty ones included; names that share a table are one corpus.
        """
        tables = self.tables() if name is None else [self.table_name(name)] * self.exists(name)
        if not tables:
            return None
        rows = self.read(name).withColumn("table_name", F.col(PARTITION))
        known = self.spark.createDataFrame(
            [(t, t[: -len(ids.TABLE_SUFFIX)]) for t in tables], "table_name string, plain_name string"
        )
        return (
            known.join(table_stats(rows), "table_name", "left")
            .select(
                F.coalesce("codebase_name", "plain_name").alias("codebase_name"),
                "table_name",
                F.coalesce("total_files", F.lit(0).cast("bigint")).alias("total_files"),
                F.coalesce("total_chunks", F.lit(0).cast("bigint")).alias("total_chunks"),
                F.coalesce(
                    "extension_distribution", F.create_map().cast("map<string,bigint>")
                ).alias("extension_distribution"),
            )
        )

    def count(self, name: str) -> int:
        return self.read(name).count()

