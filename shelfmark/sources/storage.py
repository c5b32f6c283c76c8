"""Paths on whatever file system the cluster uses, through Spark's own Hadoop client."""

import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _path(spark: SparkSession, location: str):
    return spark._jvm.org.apache.hadoop.fs.Path(location)


def _file_system(spark: SparkSession, location: str):
    return _path(spark, location).getFileSystem(spark._jsc.hadoopConfiguration())


def qualified(spark: SparkSession, location: str) -> str:
    """The location with its scheme, as file listings show it."""
    return _file_system(spark, location).makeQualified(_path(spark, location)).toString()


def exists(spark: SparkSession, location: str) -> bool:
    return _file_system(spark, location).exists(_path(spark, location))


def delete(spark: SparkSession, location: str) -> bool:
    """Remove a file or a whole directory; false when there is none."""
    return _file_system(spark, location).delete(_path(spark, location), True)


def delete_at_exit(spark: SparkSession, location: str) -> None:
    """Remove a folder when the driver ends."""
    _file_system(spark, location).deleteOnExit(_path(spark, location))


def child_names(spark: SparkSession, location: str) -> list[str]:
    """Names directly below a directory; none when it is absent."""
    if not exists(spark, location):
        return []
    found = _file_system(spark, location).listStatus(_path(spark, location))
    return sorted(status.getPath().getName() for status in found)


def read_text(spark: SparkSession, location: str) -> str:
    stream = _file_system(spark, location).open(_path(spark, location))
    try:
        return bytes(stream.readAllBytes()).decode("utf-8")
    finally:
        stream.close()


def write_new_text(spark: SparkSession, location: str, text: str) -> bool:
    """Make a file with this text at once; false, and nothing done, if there is one already.

    The text is written beside it and renamed, which file systems such as HDFS do as one step.
    """
    beside = f"{location.rpartition('/')[0]}/.{uuid.uuid4().hex}"
    stream = _file_system(spark, location).create(_path(spark, beside))
    stream.write(bytearray(text.encode("utf-8")))
    stream.close()
    files = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        _path(spark, qualified(spark, location)).toUri(), spark._jsc.hadoopConfiguration()
    )
    plain = getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark._sc._gateway.new_array(plain, 1)
    options[0] = plain.NONE
    try:
        files.rename(_path(spark, beside), _path(spark, location), options)
    except Py4JJavaError as error:
        delete(spark, beside)
        if "FileAlreadyExists" in str(error.java_exception):
            return False
        raise
    return True


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the session names it.

    Only a local session, where nothing is named, gets a temporary one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="shelfmark-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder
