"""Predicates on files, hits and query texts."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.globs import exclusion_reason
from shelfmark.functions.paths import has_text_mime
from shelfmark.functions.text import head_is_binary, is_blank
from shelfmark.schema import MAX_FILE_SIZE_BYTES, MIN_SIMILARITY, positive


def size_status(size: Column, max_file_size: int | None = None) -> Column:
    """``empty``, ``too_large`` (strictly above the limit) or null."""
    limit = positive("max_file_size", max_file_size, MAX_FILE_SIZE_BYTES)
    return F.when(size == 0, F.lit("empty")).when(size > limit, F.lit("too_large"))


def within_size(size: Column, max_file_size: int | None = None) -> Column:
    limit = positive("max_file_size", max_file_size, MAX_FILE_SIZE_BYTES)
    return (size > 0) & (size <= limit)


def is_binary(path: Column, content: Column, assume_latin1: bool = True) -> Column:
    """Binary by content, unless the name says text."""
    return F.when(has_text_mime(path), F.lit(False)).otherwise(
        head_is_binary(content, assume_latin1)
    )


def file_status(
    path: Column,
    size: Column,
    content: Column,
    max_file_size: int | None = None,
    ignore_patterns=(),
    extra_patterns=(),
    assume_latin1: bool = True,
) -> Column:
    """What indexing does with a file: ``excluded``, ``empty``, ``too_large``, ``binary`` or ``ok``."""
    reason = exclusion_reason(path, ignore_patterns, extra_patterns)
    return F.coalesce(
        F.when(reason.isNotNull(), F.lit("excluded")),
        size_status(size, max_file_size),
        F.when(is_binary(path, content, assume_latin1), F.lit("binary")),
        F.lit("ok"),
    )


def with_extension(df: DataFrame, ext: str | None) -> DataFrame:
    """Exact, case-sensitive extension; None or empty keeps every row."""
    return df.where(F.col("extension") == F.lit(ext)) if ext else df


def matching(df: DataFrame, where: Column | str | None) -> DataFrame:
    """Any predicate over the columns of ``df``."""
    return df if where is None else df.where(where)


def similar_enough(df: DataFrame, min_similarity: float | None = None) -> DataFrame:
    """Inclusive threshold; zero is a threshold like any other, and no number passes none."""
    limit = MIN_SIMILARITY if min_similarity is None else min_similarity
    value = F.col("similarity")
    return df.where(~F.isnan(value) & (value >= F.lit(float(limit))))


def with_text(df: DataFrame, text_col: str = "query_text") -> DataFrame:
    """Rows whose text is not blank."""
    return df.where(~is_blank(F.col(text_col)))
