"""Read trees of files, and tables of texts that stand for files.

Spark's own file sources skip names that begin with ``_`` or ``.``, which in a
source tree are files like any other (``__init__.py``). So the tree is listed by
tasks, round by round, and the files that survive the path and size rules are
then read by tasks. Neither names nor bytes pass through the driver.
"""

import os
import re
import uuid
from collections import deque
from collections.abc import Iterator
from pathlib import PurePosixPath

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.functions.globs import DEFAULT_EXCLUDES, clean_patterns, exclusion_reason, pruning_regex
from shelfmark.functions.paths import relative_path
from shelfmark.schema import positive
from shelfmark.sources import storage

IGNORE_FILE = ".gitignore"

# Bytes of content in one Arrow batch.
BATCH_BYTES = 16 * 1024 * 1024
# Tasks per core that folders, or files to be read, are dealt out to.
TASKS_PER_CORE = 4

_LISTING = "path string, modificationTime timestamp, length bigint, is_dir boolean"
_LISTING_ARROW = pa.schema(
    [
        ("path", pa.string()),
        ("modificationTime", pa.timestamp("us", tz="UTC")),
        ("length", pa.int64()),
        ("is_dir", pa.bool_()),
    ]
)
_ROWS_PER_BATCH = 10_000
# Names a task lists before it gives back the folders it has not opened.
WALK_ENTRIES = 10_000


def open_location(root: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a root: an absolute local path or a URI."""
    location = root.replace("s3a://", "s3://", 1)
    file_system, path = fs.FileSystem.from_uri(location)
    return file_system, path.rstrip("/") or "/"


def root_path(root: str) -> str:
    """The root as it begins the paths of a listing."""
    return open_location(root)[1]


def _children(file_system: fs.FileSystem, folder: str) -> list[fs.FileInfo]:
    """What a folder holds, but for links to folders: a walk does not follow them."""
    try:
        found = file_system.get_file_info(fs.FileSelector(folder))
    except (PermissionError, FileNotFoundError):  # as a walk of the tree would
        return []
    if not isinstance(file_system, fs.LocalFileSystem):
        return found
    return [i for i in found if i.type != fs.FileType.Directory or not os.path.islink(i.path)]


def _walker(root: str, entries: int, pruned: str | None):
    """Replace each folder by the files below it, and by the folders the task did not get to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file_system, top = open_location(root)
        excluded = re.compile(pruned).search if pruned else lambda folder: None
        listed = 0

        def rows(batch: pa.RecordBatch):
            nonlocal listed
            folders = deque(batch.column("path").to_pylist())
            while folders:
                folder = folders.popleft()
                if listed >= entries:
                    yield {"path": folder, "is_dir": True}
                    continue
                for info in _children(file_system, folder):
                    listed += 1
                    if info.type == fs.FileType.File:
                        yield {
                            "path": info.path,
                            "modificationTime": info.mtime,
                            "length": info.size,
                            "is_dir": False,
                        }
                    elif info.type == fs.FileType.Directory:
                        if not excluded(info.path.removeprefix(top).lstrip("/") + "/"):
                            folders.append(info.path)

        for batch in batches:
            part: list[dict] = []
            for row in rows(batch):
                part.append(row)
                if len(part) == _ROWS_PER_BATCH:
                    yield pa.RecordBatch.from_pylist(part, _LISTING_ARROW)
                    part = []
            if part:
                yield pa.RecordBatch.from_pylist(part, _LISTING_ARROW)

    return run


def scan_files(
    spark: SparkSession,
    root: str,
    tasks: int | None = None,
    entries: int | None = None,
    pruned: str | None = None,
) -> DataFrame:
    """Every regular file below ``root``: ``path, modificationTime, length``.

    The tree is walked in rounds when this is called. A task opens folders until it has
    listed ``entries`` names and gives back those it has not opened, which the next round
    deals out to all tasks; so a long trunk or one huge subtree is shared out like any
    other, and a small tree takes one round. The listing lies in the shared folder until
    the session ends. Without ``tasks`` there are ``TASKS_PER_CORE`` for each core, or one for
    each folder of a round if those are fewer. Folders whose path below the root, with a slash at its end,
    matches ``pruned`` are never opened.
    """
    entries = positive("entries", entries, WALK_ENTRIES)
    walk = f"{storage.shared_folder(spark)}/walk-{uuid.uuid4().hex}"
    rounds: list[str] = []
    folders = spark.range(1, numPartitions=1).select(F.lit(root_path(root)).alias("path"))
    waiting = 1
    while waiting:
        dealt = folders.repartition(tasks or dealing_tasks(spark, waiting)) if rounds else folders
        rounds.append(f"{walk}/{len(rounds)}")
        dealt.mapInArrow(_walker(root, entries, pruned), _LISTING).write.parquet(rounds[-1])
        storage.delete_at_exit(spark, rounds[-1])
        folders = spark.read.schema(_LISTING).parquet(rounds[-1]).where("is_dir").select("path")
        waiting = folders.count()
    return spark.read.schema(_LISTING).parquet(*rounds).where("not is_dir").drop("is_dir")


def ignore_patterns(root: str) -> list[str]:
    """Rules of the ignore file at the root, if there is one."""
    file_system, path = open_location(root)
    info = file_system.get_file_info(str(PurePosixPath(path) / IGNORE_FILE))
    if info.type != fs.FileType.File:
        return []
    with file_system.open_input_stream(info.path) as stream:
        text = stream.read().decode("utf-8", errors="replace")
    return clean_patterns(text.splitlines())


def walk_files(
    spark: SparkSession,
    root: str,
    extra_patterns=(),
    use_ignore_file: bool = True,
    tasks: int | None = None,
) -> DataFrame:
    """The files indexing looks at: ``file_path`` (below the root), ``absolute_path``,
    ``modificationTime, length``. No file is opened to decide, nor is a folder all of whose files are excluded."""
    rules = ignore_patterns(root) if use_ignore_file else []
    extra = list(extra_patterns)
    pruned = pruning_regex(DEFAULT_EXCLUDES, rules, extra)
    listed = scan_files(spark, root, tasks, pruned=pruned).select(
        relative_path(F.col("path"), root_path(root)).alias("file_path"),
        F.col("path").alias("absolute_path"),
        "modificationTime",
        "length",
    )
    return listed.where(exclusion_reason(F.col("file_path"), rules, extra).isNull())


def dealing_tasks(spark: SparkSession, rows: int) -> int:
    """How many tasks that many folders or files are dealt out to; a task streams what it reads, however much."""
    return max(min(rows, spark.sparkContext.defaultParallelism * TASKS_PER_CORE), 1)


def read_contents(
    files: DataFrame, root: str, tasks: int | None = None, path: str = "absolute_path"
) -> DataFrame:
    """Add ``content``: the bytes of each listed file, null where it cannot be read.

    A listing row is tiny and its file is not, so rows are dealt out anew to
    ``tasks`` tasks before anything is read.
    """
    spread = files.repartition(tasks) if tasks else files
    schema = T.StructType([*spread.schema.fields, T.StructField("content", T.BinaryType())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file_system, _ = open_location(root)
        for batch in batches:
            begin, size, contents = 0, 0, []
            for position, name in enumerate(batch.column(path).to_pylist()):
                try:
                    with file_system.open_input_stream(name, compression=None) as stream:
                        data = stream.read()
                except (PermissionError, FileNotFoundError):
                    data = None
                contents.append(data)
                size += len(data or b"")
                if size >= BATCH_BYTES or position == batch.num_rows - 1:
                    part = batch.slice(begin, position + 1 - begin)
                    yield pa.RecordBatch.from_arrays(
                        [*part.columns, pa.array(contents, pa.binary())],
                        names=[*batch.schema.names, "content"],
                    )
                    begin, size, contents = position + 1, 0, []

    return spread.mapInArrow(read, schema)


def spread_scan(df: DataFrame) -> DataFrame:
    """Deal a scan's rows out to all cores when it has fewer splits than cores.

    A scan has a split for every ``spark.sql.files.maxPartitionBytes``, so a large table is
    never shuffled here.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def documents_as_files(
    df: DataFrame,
    file_path: Column | str,
    text: Column | str,
    codebase_name: Column | str,
    modified_at: Column | None = None,
) -> DataFrame:
    """``codebase_name, file_path, absolute_path, size_bytes, modified_at, content`` from any table."""

    def column(c: Column | str) -> Column:
        return F.col(c) if isinstance(c, str) else c

    return df.select(
        column(codebase_name).alias("codebase_name"),
        column(file_path).alias("file_path"),
        column(file_path).alias("absolute_path"),
        F.octet_length(column(text)).cast("bigint").alias("size_bytes"),
        (F.lit(None) if modified_at is None else modified_at).cast("string").alias("modified_at"),
        column(text).alias("content"),
    )
