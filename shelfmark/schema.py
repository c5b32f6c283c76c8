"""Row layout of the chunk table, and the defaults that go with it."""

from pyspark.sql import types as T

# Defaults a caller can override by argument everywhere.
EMBEDDING_DIM = 1024
CONTEXT_TOKENS = 512
MAX_FILE_SIZE_BYTES = 1_000_000
SEARCH_LIMIT = 5
MIN_SIMILARITY = 0.001

# Characters allowed per estimated token, and the two shares of a
# token budget that may be used.
CHARS_PER_TOKEN = 1.5
BUDGET_SHARE = 0.7
TRUNCATE_ABOVE_SHARE = 0.8


def chunk_schema(dim: int | None = None) -> T.StructType:
    """The 14 columns of a stored chunk.

    Spark has no fixed-length array, so the vector length travels as metadata of
    the column; the Parquet footer keeps it.
    """
    metadata = {} if dim is None else {"dimension": int(dim)}
    return T.StructType(
        [
            T.StructField("id", T.StringType()),
            T.StructField("codebase_name", T.StringType()),
            T.StructField("file_path", T.StringType()),
            T.StructField("absolute_path", T.StringType()),
            T.StructField("content", T.StringType()),
            T.StructField("extension", T.StringType()),
            T.StructField("size_bytes", T.LongType()),
            T.StructField("modified_at", T.StringType()),
            T.StructField("language", T.StringType()),
            T.StructField("start_line", T.IntegerType()),
            T.StructField("end_line", T.IntegerType()),
            T.StructField("chunk_index", T.IntegerType()),
            T.StructField("total_chunks", T.IntegerType()),
            T.StructField("vector", T.ArrayType(T.FloatType()), metadata=metadata),
        ]
    )


def hit_schema() -> T.StructType:
    """What a search returns: the stored columns but corpus and vector, and two scores."""
    kept = [f for f in chunk_schema().fields if f.name not in ("codebase_name", "vector")]
    return T.StructType(
        kept
        + [
            T.StructField("distance", T.DoubleType()),
            T.StructField("similarity", T.DoubleType()),
        ]
    )


def positive(name: str, value, default):
    """``None`` means the default; zero or less is refused."""
    if value is None:
        return default
    if value <= 0:
        raise ValueError(f"{name} must be positive, got {value}")
    return value
