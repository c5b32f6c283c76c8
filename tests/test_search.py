"""Nearest neighbours against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.functions import vectors
from shelfmark.operators.filters import similar_enough, with_text
from shelfmark.operators.search import nearest, nearest_batch
from tests.conftest import SF_DIR

ROW = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("chunk_index", T.IntegerType()),
        T.StructField("label", T.IntegerType()),
        T.StructField("vector", T.ArrayType(T.FloatType())),
    ]
)
QUERY = T.StructType(
    [
        T.StructField("query_id", T.LongType()),
        T.StructField("query_vector", T.ArrayType(T.FloatType())),
    ]
)


def exact(x, q, metric):
    x, q = np.asarray(x, dtype=np.float64), np.asarray(q, dtype=np.float64)
    if metric == "l2":
        return float(np.float32(((x - q) ** 2).sum()))
    inner = float((x * q).sum())
    if metric == "cosine":
        sizes = math.sqrt((x * x).sum()) * math.sqrt((q * q).sum())
        inner = inner / sizes if sizes else 0.0
    return 1.0 - float(np.float32(inner))


def brute(rows, queries, k, metric="l2"):
    out = []
    for qid, q in queries:
        usable = [r for r in rows if r[3] is not None and len(r[3]) == len(q)]
        scored = [(exact(r[3], q, metric), r[0], r[1]) for r in usable]
        scored.sort(key=lambda s: (math.isnan(s[0]), s[0], s[1], s[2]))
        out += [(qid, i + 1, s[1], s[2]) for i, s in enumerate(scored[:k])]
    return out


def keys(df):
    return [
        (r.query_id, r["rank"], r.id, r.chunk_index) for r in df.orderBy("query_id", "rank").collect()
    ]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 6)).astype(np.float32)
    rows = [(f"id{i % 20:02d}", i, i % 4, base[i].tolist()) for i in range(60)]
    rows += [("copy", i, 1, base[0].tolist()) for i in range(200)]  # a third and more are ties
    rows += [("zero", i, 2, [0.0] * 6) for i in range(40)]
    queries = [(i, base[i].tolist()) for i in range(12)] + [(100, [0.0] * 6)]
    queries += [(i, rng.normal(size=6).astype(np.float32).tolist()) for i in range(200, 215)]
    return rows, queries


@pytest.mark.parametrize("metric", vectors.METRICS)
@pytest.mark.parametrize("k", [1, 5, 90])
def test_batch_equals_brute_force(spark, data, metric, k):
    rows, queries = data
    table = spark.createDataFrame(rows, ROW).repartition(5)
    asked = spark.createDataFrame(queries, QUERY)
    want = brute(rows, queries, k, metric)
    for options in ({}, {"query_block_rows": 9}, {"query_block_rows": 9, "kept_query_bytes": 0}):
        assert keys(nearest_batch(table, asked, k, metric=metric, **options)) == want


def test_small_arrow_batches_give_the_same(spark, data):
    rows, queries = data
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        table = spark.createDataFrame(rows, ROW).repartition(3)
        asked = spark.createDataFrame(queries, QUERY)
        assert keys(nearest_batch(table, asked, 5)) == brute(rows, queries, 5)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_one_query_in_a_batch_equals_the_single_search(spark, data):
    rows, queries = data
    table = spark.createDataFrame(rows, ROW)
    single = nearest(table, queries[3][1], 7).select("id", "chunk_index", "distance").collect()
    batch = nearest_batch(table, spark.createDataFrame([queries[3]], QUERY), 7).orderBy("rank")
    assert single == batch.select("id", "chunk_index", "distance").collect()


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        ("a", 0, 0, [1.0, 0.0]), ("b", 0, 0, [nan, 0.0]), ("c", 0, 0, [inf, 0.0]),
        ("d", 0, 0, [1.0]), ("e", 0, 0, None), ("f", 0, 0, [2.0, 0.0]), ("g", 0, 0, [1.0, 0.0]),
        ("h", 0, 0, [None, 1.0]), ("i", 0, 0, [1.0, 2.0, 3.0]),
    ]
    table = spark.createDataFrame(rows, ROW).coalesce(1)
    queries = [(1, [1.0, 0.0]), (2, [inf, 0.0]), (3, [1.0, 2.0, 3.0]), (4, None), (5, [9.0] * 4)]
    asked = spark.createDataFrame(queries, QUERY)
    for rows_at_once in (2, 4096):
        got = nearest_batch(table, asked, 9, query_block_rows=rows_at_once, kept_query_bytes=0)
        found = {}
        for r in got.orderBy("query_id", "rank").collect():
            found.setdefault(r.query_id, []).append(r.id)
        # a number, then infinity, then NaN; other lengths and nulls are not there
        assert found[1] == ["a", "g", "f", "c", "b"]
        assert set(found[2]) == {"a", "b", "c", "f", "g"}
        assert found[3] == ["i"]
        assert set(found) == {1, 2, 3}
    assert [r.id for r in nearest(table, [1.0, 0.0], 9).collect()] == ["a", "g", "f", "c", "b"]


def test_filters(spark, data):
    rows, queries = data
    table = spark.createDataFrame(rows, ROW)
    vector = queries[0][1]
    pre = nearest(table, vector, 5, where=F.col("label") == 3).collect()
    only = [r for r in rows if r[2] == 3]
    assert [(r.id, r.chunk_index) for r in pre] == [w[2:] for w in brute(only, [(0, vector)], 5)]
    every = nearest(table, vector, 300).collect()
    post = nearest(table, vector, 300, where="label = 3", filter_mode="post").collect()
    assert [r.id for r in post] == [r.id for r in every if r.label == 3]
    few = nearest(table, vector, 50, where="label = 3", filter_mode="post").collect()
    ids = {(r.id, r.chunk_index) for r in nearest(table, vector, 50, where="label = 3").collect()}
    assert {(r.id, r.chunk_index) for r in few} <= ids
    assert nearest(table, vector, 5, where="label = 77").collect() == []
    asked = spark.createDataFrame(queries, QUERY)
    assert nearest_batch(table, asked, 5, where="label = 77").count() == 0
    batch_post = nearest_batch(table, asked, 50, where="label = 3", filter_mode="post")
    assert keys(batch_post.where("query_id = 0"))[:1] == keys(
        nearest_batch(table, asked, 50).where("query_id = 0 and label = 3")
    )[:1]


def test_k_beyond_the_table_and_no_queries(spark, data):
    rows, queries = data
    table = spark.createDataFrame(rows, ROW)
    assert nearest(table, queries[0][1], 1000).count() == len(rows)
    nobody = spark.createDataFrame([], QUERY)
    assert nearest_batch(table, nobody, 3).count() == 0
    empty = spark.createDataFrame([], ROW)
    asked = spark.createDataFrame(queries, QUERY)
    assert nearest_batch(empty, asked, 3).count() == 0


def test_bad_arguments(spark, data):
    table = spark.createDataFrame(data[0], ROW)
    for options in ({"k": 0}, {"metric": "l3"}, {"filter_mode": "maybe"}):
        with pytest.raises(ValueError):
            nearest(table, [0.0] * 6, **options)


def test_the_table_is_not_shuffled(spark, data):
    rows, queries = data
    table, asked = spark.createDataFrame(rows, ROW), spark.createDataFrame(queries, QUERY)
    found = nearest_batch(table, asked, 3, query_block_rows=10)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" not in plan and "Join" not in plan
    physical = found._jdf.queryExecution().executedPlan().toString()
    assert physical.index("ArrowEvalPython") > physical.rindex("Exchange")  # only hits are shuffled
    assert keys(found) == brute(rows, queries, 3)


def test_threshold(spark, data):
    table = spark.createDataFrame(data[0], ROW)
    hits = nearest(table, data[1][2][1], 60)
    levels = sorted({r.similarity for r in hits.collect()})
    counts = [similar_enough(hits, level).count() for level in levels]
    assert counts == sorted(counts, reverse=True)
    assert similar_enough(hits, levels[-1]).count() >= 1  # inclusive
    assert similar_enough(hits, 0.0).count() == 60
    assert similar_enough(hits, 1.1).count() == 0


def test_array_expressions_agree(spark):
    embeddings = spark.read.parquet(f"{SF_DIR}/embeddings.parquet")
    first = embeddings.orderBy("vec_id").head().embedding
    query = F.array(*[F.lit(v) for v in first]).cast("array<float>")
    for metric in vectors.METRICS:
        scored = embeddings.withColumn("d", vectors.distance(F.col("embedding"), query, metric))
        want = [r.vec_id for r in scored.orderBy("d", "vec_id").limit(10).collect()]
        got = nearest(embeddings, first, 10, metric=metric, vector_col="embedding", ties=["vec_id"])
        assert [r.vec_id for r in got.collect()] == want


def test_plans(spark):
    """The predicate reaches the scan, vectors alone go to Python, once, and rows do not shuffle."""
    table = spark.read.parquet(f"{SF_DIR}/embeddings.parquet")
    vector = table.head().embedding
    plan = nearest(
        table, vector, 5, where="label = 1", vector_col="embedding", ties=["vec_id"]
    )._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(label,1)" in plan and "TakeOrderedAndProject" in plan
    assert plan.count("ArrowEvalPython") == 1
    queries = table.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    plan = nearest_batch(
        table, queries, 5, where="label = 1", vector_col="embedding", ties=["vec_id"]
    )._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(label,1)" in plan and plan.count("ArrowEvalPython") == 1
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert plan.count("WindowGroupLimit") == 4


def test_blank_queries_are_dropped(spark):
    rows = [(1, "q"), (2, " \t"), (3, None), (4, "　")]
    df = spark.createDataFrame(rows, "query_id int, query_text string")
    assert [r.query_id for r in with_text(df).collect()] == [1]
