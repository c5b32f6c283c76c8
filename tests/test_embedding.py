"""Embedders and vector checks."""

import hashlib
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.operators import embedding
from shelfmark.operators.embedding import HashingEmbedder, ModelEmbedder, embed


def hashed(body, dim):
    sums = [0] * dim
    for word in re.findall(r"\w+", body.lower()):
        digest = hashlib.md5(word.encode()).hexdigest()
        sums[int(digest[:7], 16) % dim] += 1 - 2 * (int(digest[7], 16) % 2)
    norm = math.sqrt(sum(s * s for s in sums)) or 1.0
    return np.array([s / norm for s in sums], dtype=np.float32).tolist()


def test_hashing_embedder(spark):
    bodies = ["Hello hello world", "", "  \n", None, "été 中文 x_1", "x" * 2000 + " y", "!!"]
    df = spark.createDataFrame(list(enumerate(bodies)), "i int, content string")
    got = embed(df, HashingEmbedder(32)).orderBy("i").collect()
    for row, body in zip(got, bodies):
        seen = (body or "")[:537] if len(body or "") > 614 else body or ""
        assert row.vector == hashed(seen, 32)
        assert row.embed_ok and row.embed_error is None
        assert row.content == body


def test_hashing_embedder_over_many_batches(spark):
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.range(100).select("id", F.concat(F.lit("word "), F.col("id")).alias("content"))
        for row in embed(df, HashingEmbedder(16)).collect():
            assert row.vector == hashed(f"word {row.id}", 16)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_prefix_is_embedded(spark):
    df = spark.createDataFrame([("body",)], "content string")
    row = embed(df, HashingEmbedder(16), prefix="search_document: ").head()
    assert row.vector == hashed("search_document: body", 16)


def load_lengths():
    def model(texts):
        if any("boom" in t for t in texts):
            raise RuntimeError("cannot do boom")
        return [None if t == "none" else [float(len(t)), 1.0] for t in texts]

    return model


def test_model_embedder_isolates_failures(spark):
    bodies = ["ab", "boom", "", "none", "x" * 700, "abc"]
    df = spark.createDataFrame(list(enumerate(bodies)), "i int, content string").coalesce(1)
    got = embed(df, ModelEmbedder(load_lengths, 2, pause_seconds=0)).orderBy("i").collect()
    assert [r.vector for r in got] == [[2, 1], [0, 0], [0, 0], [0, 0], [537, 1], [3, 1]]
    assert [r.embed_ok for r in got] == [True, False, True, False, True, True]
    assert got[1].embed_error == "RuntimeError: cannot do boom"


def test_model_is_tried_again(spark):
    def load():
        calls = {"n": 0}

        def model(texts):
            calls["n"] += 1
            if calls["n"] < 4:  # the whole batch once, then the first text twice
                raise RuntimeError("later")
            return [[1.0] for _ in texts]

        return model

    df = spark.createDataFrame([("a",), ("b",)], "content string").coalesce(1)
    patient = embed(df, ModelEmbedder(load, 1, pause_seconds=0)).collect()
    assert [r.embed_ok for r in patient] == [True, True]
    hasty = embed(df, ModelEmbedder(load, 1, attempts=1, pause_seconds=0)).collect()
    assert [r.embed_ok for r in hasty] == [False, False]


def test_model_is_loaded_once_per_task(spark):
    def load():
        import os
        import uuid

        token = float(int(uuid.uuid4()) % 1_000_000)
        assert os.getpid()
        return lambda texts: [[token] for _ in texts]

    df = spark.range(300).select(F.col("id").cast("string").alias("content")).coalesce(2)
    tokens = embed(df, ModelEmbedder(load, 1, batch_size=10)).select("vector").distinct().count()
    assert tokens <= 2


VECTORS = [
    (0, [1.0, 2.0]), (1, [float("nan"), 1.0]), (2, [float("inf"), float("-inf")]), (3, [1.0]),
    (4, None), (5, [0.0, 0.0]), (6, [None, 1.0]),
]


@pytest.fixture
def odd_vectors(spark):
    schema = T.StructType(
        [T.StructField("i", T.IntegerType()), T.StructField("vector", T.ArrayType(T.FloatType()))]
    )
    return spark.createDataFrame(VECTORS, schema)


def test_vector_checks(odd_vectors):
    got = {r.i: r for r in embedding.vector_checks(odd_vectors, 2).collect()}
    assert [got[i].vector_ok for i in range(7)] == [True, False, False, False, False, True, False]
    assert [got[i].vector_length for i in range(7)] == [2, 2, 2, 1, None, 2, 2]
    assert (got[1].nan_count, got[2].inf_count, got[3].wrong_length) == (1, 2, True)
    total = embedding.vector_quality(odd_vectors, 2).head()
    assert (total.vectors, total.valid, total.with_nan, total.with_inf, total.wrong_length) == (7, 2, 1, 1, 2)


def test_handling_of_bad_vectors(odd_vectors):
    assert embedding.handle_invalid(odd_vectors, 2, on_invalid="drop").count() == 2
    zeroed = {r.i: r.vector for r in embedding.handle_invalid(odd_vectors, 2, on_invalid="zero").collect()}
    assert zeroed[0] == [1, 2] and all(zeroed[i] == [0, 0] for i in (1, 2, 3, 4, 6))
    flags = {r.i: r.vector_ok for r in embedding.handle_invalid(odd_vectors, 2).collect()}
    assert flags[0] and not flags[4]
    with pytest.raises(ValueError):
        embedding.handle_invalid(odd_vectors, 2, on_invalid="ignore")


def test_placeholder(odd_vectors):
    got = {r.i: r for r in embedding.fill_missing_vectors(odd_vectors, 2).collect()}
    assert got[4].vector == [0, 0] and not got[4].embed_ok and got[0].embed_ok
