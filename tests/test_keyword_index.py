"""The stored keyword index: the same hits as a ranking of all rows, from few postings."""

import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.operators import keyword_index
from shelfmark.operators.hybrid import keyword_ranks
from shelfmark.operators.keyword_index import KeywordIndex
from shelfmark.sources import storage


def built(table, tmp_path, keys=("id",)):
    return KeywordIndex.build(table, str(tmp_path / uuid.uuid4().hex), "text", keys)


def same(index, table, queries, k, keys=("id",)):
    columns = ["query_id", "rank", *keys, "keyword_score"]
    got = sorted(map(tuple, index.search(queries, k).select(*columns).collect()))
    want = sorted(map(tuple, keyword_ranks(table, queries, k, "text", keys).select(*columns).collect()))
    assert [r[:-1] for r in got] == [r[:-1] for r in want]
    assert np.allclose([r[-1] for r in got], [r[-1] for r in want], atol=1.5e-6)
    return got


def some_texts(spark, n, seed=1):
    rng = np.random.default_rng(seed)
    words = np.array([f"w{i}" for i in range(60)])
    share = 1 / np.arange(1, 61)
    rows = [(i, i % 3, " ".join(rng.choice(words, rng.integers(0, 30), p=share / share.sum()))) for i in range(n)]
    rows += [(n + i, 0, "w40 copy w1") for i in range(200)] + [(n + 200, 0, None), (n + 201, 0, "")]
    return spark.createDataFrame(rows, "id long, part int, text string")


@pytest.mark.parametrize(("block", "postings"), [(128, 100_000), (4, 50)])
def test_same_hits_as_the_ranking_of_all_rows(spark, tmp_path, monkeypatch, block, postings):
    monkeypatch.setattr(keyword_index, "BLOCK", block)
    monkeypatch.setattr(keyword_index, "LIST", postings)
    table = some_texts(spark, 800)
    asked = ["w1", "w1 w2 w3", "W59, w1!", "copy w1", "w40 w41 w42 w43 w2 w1 w1", "unknown", "", None, "w5 unknown w1"]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, query_text string")
    index = built(table, tmp_path)
    for k in (7, 300):
        same(index, table, queries, k)
    # keys of two columns, and an index that is only opened
    index = KeywordIndex(spark, built(table, tmp_path, ("part", "id")).location)
    assert index.keys == ["part", "id"]
    same(index, table, queries, 9, ("part", "id"))


def test_a_word_of_all_rows_is_read_from_the_top(spark, tmp_path):
    """200 questions with a word that all, or 18,000 rows hold make no row per question and text."""
    table = spark.range(20_000).select(
        "id", F.concat(F.when(F.col("id") % 10 < 9, "the of ").otherwise("of "), F.expr("repeat('x ', int(id % 977))"), F.concat(F.lit("rare"), F.col("id") % 5_000)).alias("text")
    )
    index = built(table, tmp_path)
    asked = spark.range(200).select(F.col("id").alias("query_id"), F.concat(F.lit("of rare"), F.col("id")).alias("query_text"))
    only = asked.select("query_id", F.lit("the").alias("query_text"))
    for queries, most in ((asked, 200 * 4), (only, 200 * 2 * keyword_index.BLOCK)):
        assert index._looked_up(index._bounds(queries, 3)).count() <= most
    same(index, table, asked.where("query_id < 20"), 3)
    same(index, table, only.where("query_id < 2"), 3)


def test_copies_are_indexed_once(spark, tmp_path):
    table = spark.range(5_000).select("id", F.when(F.col("id") % 2 == 0, "same words here").otherwise(F.concat(F.lit("words "), "id")).alias("text"))
    index = built(table, tmp_path)
    queries = spark.createDataFrame([(1, "same words")], "query_id long, query_text string")
    assert index._looked_up(index._bounds(queries, 50)).where("_sum > 1").count() <= 1
    assert [r[2] for r in same(index, table, queries, 50)] == list(range(0, 100, 2))


def test_repeated_keys_are_rows_of_their_own(spark, tmp_path):
    table = spark.createDataFrame([(3, "a b"), (3, "a b"), (3, "a c c"), (None, "a b")], "id long, text string")
    found = built(table, tmp_path).search(spark.createDataFrame([(1, "a c")], "query_id long, query_text string"), 9)
    assert [r["id"] for r in found.orderBy("rank").collect()] == [3, None, 3, 3]


def test_empty_tables_and_unfinished_indexes(spark, tmp_path):
    table = some_texts(spark, 5)
    queries = spark.createDataFrame([(1, "w1")], "query_id long, query_text string")
    assert built(table.limit(0), tmp_path).search(queries, 3).count() == 0
    index = built(table, tmp_path)
    assert index.search(queries.limit(0), 3).count() == 0
    with pytest.raises(ValueError, match="exists"):
        KeywordIndex.build(table, index.location, "text", ["id"])
    storage.delete(spark, f"{index.location}/totals")
    with pytest.raises(ValueError, match="no complete"):
        KeywordIndex(spark, index.location)
    with pytest.raises(ValueError):
        built(table, tmp_path).search(queries, 0)
