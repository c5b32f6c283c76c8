"""Identifiers and table names."""

from pyspark.sql import Column
from pyspark.sql import functions as F

TABLE_SUFFIX = "_rag"


def row_id(codebase_name: Column, file_path: Column) -> Column:
    """First 16 hex digits of SHA-256 over ``name:path``; all chunks of a file share it."""
    return F.substring(F.sha2(F.concat(codebase_name, F.lit(":"), file_path), 256), 1, 16)


def chunk_id(id_: Column, chunk_index: Column) -> Column:
    """An identifier of one chunk, which the row id is not."""
    return F.concat_ws("-", id_, chunk_index.cast("string"))


def sanitized(name: Column) -> Column:
    """Lower case, anything but word characters and ``-`` to one ``_``, no ``_`` at the ends."""
    words = F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}_\-]", "_")
    return F.btrim(F.regexp_replace(words, "_+", "_"), F.lit("_"))


def table_name(name: Column) -> Column:
    return F.concat(sanitized(name), F.lit(TABLE_SUFFIX))


def corpus_of_table(table: Column) -> Column:
    """Table name without its suffix; only the suffix goes, not every occurrence."""
    return F.regexp_replace(table, f"{TABLE_SUFFIX}$", "")
