"""What the operators share: their input columns, tables kept in the shared folder, the training fold."""

import math
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.sources import storage

#: A table is broadcast only when it was counted and has at most so many rows of a few numbers or one short text.
BROADCAST_ROWS = 50_000
#: Rows for which a saved table gets a part of its own, where the number of its rows is bounded.
PACKED = 10_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def saved(frame: DataFrame, name: str, rows: int | None = None, together: int | None = None) -> DataFrame:
    """The frame, written as Parquet to the folder all executors share and read again.

    This cuts the lineage: a lost executor costs the tasks that it ran, not the steps
    before. The folder goes when the session's JVM ends. Where it is known that the frame has
    at most ``rows`` narrow rows, no more tasks make it, and no more files, than hold PACKED
    of them each, or than there are cores. Rows of several MB are written, and read again, ``together`` at most: else a
    task holds as many of them as a row group has, and these grow with its share of the input.
    """
    spark = frame.sparkSession
    if rows is not None:
        frame = frame.coalesce(max(spark.sparkContext.defaultParallelism, math.ceil(rows / PACKED)))
    folder = f"{storage.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    path = storage._path(spark, folder)
    writer = frame.write if together is None else frame.write.option("parquet.block.row.count.limit", together)
    writer.parquet(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(frame.schema).parquet(folder)


@contextmanager
def batches_of(spark: SparkSession, size: str) -> Iterator[None]:
    """What runs meanwhile hands rows to Python in Arrow batches of about that size (or of one row)."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def small(frame: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The (saved) frame with a broadcast hint if it has at most that many rows; joins shuffle it otherwise."""
    return F.broadcast(frame) if frame.count() <= rows else frame


def joinable(frame: DataFrame, rows: int) -> DataFrame:
    """The frame, of at most so many rows, for a join; if they may be too many to broadcast, it is not, however small its files are.

    Spark goes by the bytes of files or shuffles, which are a fraction of what the driver holds while it makes a broadcast.
    """
    return frame if rows <= BROADCAST_ROWS else frame.hint("merge")


def texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Two columns, doc_id and text, whatever else the table has; a null text becomes an empty one."""
    return docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")
    )


def fold(doc_id: Column) -> Column:
    """crc32 of the number as text, modulo 3; 1 marks the held-out third (a null number is in fold 0)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3, F.lit(0))
