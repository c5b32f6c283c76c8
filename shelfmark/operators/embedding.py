"""Attach a vector to each text.

Two embedders share one contract: given a text column they give a struct
``(vector, ok, error)``. Blank text is the zero vector, text too long for the
model's context is cut first, and a text the model fails on becomes the zero
vector with ``ok = false`` instead of failing the job.
"""

import time
from collections.abc import Callable, Iterator, Sequence
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.functions import vectors
from shelfmark.functions.text import is_blank, truncated_to_context, with_prefix
from shelfmark.schema import CONTEXT_TOKENS, EMBEDDING_DIM, positive

_VECTOR = T.ArrayType(T.FloatType())

# Entries of the dense matrix a task holds at a time.
_ENTRIES_AT_ONCE = 4_000_000


def _list_array(matrix: np.ndarray) -> pa.Array:
    rows, dim = matrix.shape
    offsets = np.arange(0, rows * dim + 1, dim, dtype=np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(matrix.ravel(), pa.float32()))


class HashingEmbedder:
    """Signed feature hashing of words, L2-normalised; needs no model.

    Spark reduces a text to its words; an Arrow function hashes each distinct word
    of a batch once and adds the words up into dense rows.
    """

    def __init__(self, dim: int | None = None, context_tokens: int | None = None):
        self.dim = positive("dim", dim, EMBEDDING_DIM)
        self.context_tokens = positive("context_tokens", context_tokens, CONTEXT_TOKENS)

    def _words(self, text: Column) -> Column:
        """Lower-case words with one space between; empty for null text.

        One string per row crosses to Python far faster than an array of words.
        """
        return F.coalesce(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]+", " "), F.lit(""))

    def vector(self, text: Column) -> Column:
        dim = self.dim
        rows_at_once = max(1, _ENTRIES_AT_ONCE // dim)

        def add_up(texts: pa.Array) -> np.ndarray:
            words = pc.split_pattern(texts, " ")
            coded = words.flatten().dictionary_encode()
            distinct = coded.dictionary.to_pylist()
            # of eight hex digits, seven choose the bucket and the last the sign;
            # what stands before the first and after the last space is no word
            hashed = np.array(
                [int(md5(w.encode()).hexdigest()[:8], 16) for w in distinct], dtype=np.int64
            )
            bucket = (hashed >> 4) % dim
            sign = np.array([w != "" for w in distinct]) * (1.0 - 2.0 * (hashed % 2))
            word = coded.indices.to_numpy()
            per_row = pc.list_value_length(words).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(words), dtype=np.int64), per_row)
            sums = np.bincount(
                row * dim + bucket[word], weights=sign[word], minlength=len(words) * dim
            ).reshape(len(words), dim)
            norms = np.sqrt(np.einsum("ij,ij->i", sums, sums))
            norms[norms == 0] = 1.0
            unit = np.empty(sums.shape, dtype=np.float32)
            return np.divide(sums, norms[:, None], out=unit, casting="unsafe")

        @F.arrow_udf(_VECTOR)
        def dense(texts: pa.Array) -> pa.Array:
            parts = [
                add_up(texts.slice(begin, rows_at_once))
                for begin in range(0, len(texts), rows_at_once)
            ]
            return _list_array(np.concatenate(parts or [np.empty((0, dim), np.float32)]))

        return dense(self._words(text))

    def embedded(self, text: Column) -> Column:
        return F.struct(
            self.vector(text).alias("vector"),
            F.lit(True).alias("ok"),
            F.lit(None).cast("string").alias("error"),
        )


class ModelEmbedder:
    """Run a user's model. ``load()`` is called once per task and returns a function
    from a list of texts to a list of vectors (None for a text it could not do).

    When a call fails its texts are tried one by one, each ``attempts`` times with
    growing pauses, so that an error costs the texts that cause it and no others.
    """

    def __init__(
        self,
        load: Callable[[], Callable[[list[str]], Sequence]],
        dim: int | None = None,
        context_tokens: int | None = None,
        batch_size: int = 64,
        attempts: int = 3,
        pause_seconds: float = 1.0,
    ):
        self.load = load
        self.attempts = positive("attempts", attempts, 3)
        self.pause_seconds = pause_seconds
        self.dim = positive("dim", dim, EMBEDDING_DIM)
        self.context_tokens = positive("context_tokens", context_tokens, CONTEXT_TOKENS)
        self.batch_size = positive("batch_size", batch_size, 64)

    def embedded(self, text: Column) -> Column:
        load, dim, size = self.load, self.dim, self.batch_size
        attempts, pause = self.attempts, self.pause_seconds
        result = T.StructType(
            [
                T.StructField("vector", _VECTOR),
                T.StructField("ok", T.BooleanType()),
                T.StructField("error", T.StringType()),
            ]
        )

        def call(model, texts: list[str]) -> list:
            found = list(model(texts))
            if len(found) != len(texts):
                raise ValueError(f"model gave {len(found)} vectors for {len(texts)} texts")
            return found

        def one(model, text: str) -> tuple:
            for attempt in range(attempts):
                try:
                    (vector,) = call(model, [text])
                    return vector, None if vector is not None else "model gave no vector"
                except Exception as failure:  # whatever a model raises is its answer
                    error = f"{type(failure).__name__}: {failure}"
                if attempt < attempts - 1:
                    time.sleep(pause * 2**attempt)
            return None, error

        def many(model, texts: list[str]) -> list[tuple]:
            try:
                found = call(model, texts)
                return [(v, None if v is not None else "model gave no vector") for v in found]
            except Exception:
                return [one(model, text) for text in texts]

        @F.arrow_udf(result)
        def run_model(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            model = load()
            zero = np.zeros(dim, dtype=np.float32)
            for batch in batches:
                texts = batch.to_pylist()
                wanted = [i for i, t in enumerate(texts) if t is not None]
                pairs: list[tuple] = [(zero, None)] * len(texts)
                for begin in range(0, len(wanted), size):
                    part = wanted[begin : begin + size]
                    for i, pair in zip(part, many(model, [texts[i] for i in part])):
                        pairs[i] = pair
                errors = [error for _, error in pairs]
                rows = [zero if v is None else np.asarray(v, dtype=np.float32) for v, _ in pairs]
                yield pa.StructArray.from_arrays(
                    [
                        pa.array(rows, pa.list_(pa.float32())),
                        pa.array([e is None for e in errors], pa.bool_()),
                        pa.array(errors, pa.string()),
                    ],
                    names=["vector", "ok", "error"],
                )

        return run_model(text)


def embed(
    df: DataFrame,
    embedder,
    text_col: str = "content",
    prefix: str | None = None,
    vector_col: str = "vector",
) -> DataFrame:
    """Add ``vector_col``, ``embed_ok`` and ``embed_error``; keep every other column.

    Missing text counts as empty.
    """
    text = with_prefix(F.coalesce(F.col(text_col), F.lit("")), prefix)
    usable = F.when(~is_blank(text), truncated_to_context(text, embedder.context_tokens))
    kept = [c for c in df.columns if c not in (vector_col, "embed_ok", "embed_error", "_embedded")]
    return df.select(*kept, embedder.embedded(usable).alias("_embedded")).select(
        *kept,
        F.col("_embedded")["vector"].alias(vector_col),
        F.col("_embedded")["ok"].alias("embed_ok"),
        F.col("_embedded")["error"].alias("embed_error"),
    )


def where_computed(df: DataFrame, predicate: Column) -> DataFrame:
    """``df.where(predicate)`` for columns that a model made.

    A plain filter would be pushed below the model with a second copy of its call; one
    on what a generator gives stays where it is.
    """
    return df.withColumn("_wanted", F.explode(F.array(predicate))).where("_wanted").drop("_wanted")


def fill_missing_vectors(df: DataFrame, dim: int, vector_col: str = "vector") -> DataFrame:
    """Zero vector where none could be made, and ``embed_ok`` telling so."""
    vector = F.col(vector_col)
    return df.withColumn("embed_ok", vector.isNotNull()).withColumn(
        vector_col, F.coalesce(vector, vectors.zero_vector(dim))
    )


def vector_checks(df: DataFrame, dim: int, vector_col: str = "vector") -> DataFrame:
    """Per row: length, smallest and largest entry, counts of bad entries, and a verdict."""
    v = F.col(vector_col)
    return df.withColumns(
        {
            "vector_length": vectors.length(v),
            "vector_min": F.array_min(v),
            "vector_max": F.array_max(v),
            "inf_count": vectors.inf_count(v),
            "nan_count": vectors.nan_count(v),
            "wrong_length": F.coalesce(vectors.length(v) != dim, F.lit(True)),
            "vector_ok": vectors.is_valid_vector(v, dim),
        }
    )


def vector_quality(df: DataFrame, dim: int, vector_col: str = "vector", by=()) -> DataFrame:
    """One row (per group) summing up :func:`vector_checks`."""
    checks = vector_checks(df, dim, vector_col)
    return checks.groupBy(*by).agg(
        F.count(F.lit(1)).alias("vectors"),
        F.count_if(F.col("vector_ok")).alias("valid"),
        F.count_if(F.col("wrong_length")).alias("wrong_length"),
        F.count_if(F.col("inf_count") > 0).alias("with_inf"),
        F.count_if(F.col("nan_count") > 0).alias("with_nan"),
        F.min("vector_min").alias("smallest"),
        F.max("vector_max").alias("largest"),
    )


def degenerate_vectors(
    df: DataFrame, vector_col: str = "vector", by=(), spread: float = 1e-6
) -> DataFrame:
    """Per group: vectors, and how many are zero, near-constant or a repetition of another.

    Near-constant: largest and smallest entry differ by at most ``spread``, zero vectors
    aside. Repetitions are counted on two hashes, each distinct vector once, before groups
    meet, so one vector that is most of a corpus stays one row. Null counts as neither.
    Vectors themselves are not shuffled.
    """
    v = F.col(vector_col)
    hashes = {"_hash": F.xxhash64(v), "_other_hash": F.xxhash64(F.lit(1), v)}
    ends = {"_low": F.array_min(v), "_high": F.array_max(v)}
    named = df.select(*by, v.isNotNull().alias("_given"), *(c.alias(n) for n, c in (hashes | ends).items()))
    distinct = named.groupBy(*by, *hashes).agg(
        F.count_if("_given").alias("_n"), *(F.max(n).alias(n) for n in ends)
    )
    low, high = F.col("_low"), F.col("_high")
    zero = (low == 0) & (high == 0)
    constant = ~zero & (high - low <= spread)

    def rows(test: Column) -> Column:
        return F.coalesce(F.sum(F.when(test, F.col("_n"))), F.lit(0))

    return distinct.groupBy(*by).agg(
        F.sum("_n").alias("vectors"),
        rows(zero).alias("zero"),
        rows(constant).alias("near_constant"),
        F.sum(F.greatest(F.col("_n") - 1, F.lit(0))).alias("repeated"),
    )


def handle_invalid(
    df: DataFrame, dim: int, vector_col: str = "vector", on_invalid: str = "flag"
) -> DataFrame:
    """``flag`` adds ``vector_ok``, ``drop`` removes bad rows, ``zero`` replaces their vector."""
    ok = vectors.is_valid_vector(F.col(vector_col), dim)
    if on_invalid == "flag":
        return df.withColumn("vector_ok", ok)
    if on_invalid == "drop":
        return where_computed(df, ok)
    if on_invalid == "zero":
        return df.withColumn(
            vector_col, F.when(ok, F.col(vector_col)).otherwise(vectors.zero_vector(dim))
        )
    raise ValueError(f"on_invalid must be flag, drop or zero, got {on_invalid!r}")
