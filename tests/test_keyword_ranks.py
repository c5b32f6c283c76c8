"""Keyword ranking: no row per pair of a question and a row is made, and rows are scored where they lie."""

import math
import re
from collections import Counter

import pytest

from shelfmark.operators import hybrid


def expected(rows, queries, k):
    """BM25 row by row; rows with the same keys and number of words are one, with the same keys one hit."""
    words = [re.findall(r"\w+", (text or "").lower()) for _, text in rows]
    mean = sum(map(len, words)) / len(words)
    bags = {}
    for (key, _), found in zip(rows, words, strict=True):
        bags.setdefault((key, len(found)), Counter()).update(found)
    spread = Counter(w for bag in bags.values() for w in bag)
    hits = []
    for query_id in sorted({q for q, _ in queries}):
        asked = [w for q, text in queries if q == query_id for w in set(re.findall(r"\w+", (text or "").lower()))]
        scores = Counter()
        for (key, size), bag in bags.items():
            for w in asked:
                if bag[w]:
                    rare = math.log1p((len(rows) - spread[w] + 0.5) / (spread[w] + 0.5))
                    scores[key] += rare * bag[w] * 2.2 / (bag[w] + 1.2 * (0.25 + 0.75 * size / mean))
        best = sorted(scores, key=lambda key: (-round(scores[key], 6), key is not None, key or 0))[:k]
        hits += [(query_id, key, round(scores[key], 6), rank) for rank, key in enumerate(best, 1)]
    return hits


def ranked(spark, rows, queries, k, parts=3):
    table = spark.createDataFrame(rows, "id long, content string").repartition(parts)
    asked = spark.createDataFrame(queries, "query_id long, query_text string")
    return hybrid.keyword_ranks(table, asked, k, keys=["id"])


def check(spark, rows, queries, k):
    found = [tuple(r) for r in ranked(spark, rows, queries, k).orderBy("query_id", "rank").collect()]
    want = expected(rows, queries, k)
    assert [(q, key, rank) for q, key, _, rank in found] == [(q, key, rank) for q, key, _, rank in want]
    assert [r[2] for r in found] == pytest.approx([r[2] for r in want], abs=1.5e-6)


ROWS = [(i, " ".join(f"w{j}" for j in range(1, 30) if (i * 7 + j * j) % (j + 1) == 0) + " The" * (i % 3)) for i in range(400)]
ROWS += [(1000 + i, "copy of w1 the") for i in range(100)] + [(2000, None), (2001, ""), (2002, "...")]
QUERIES = [(1, "w1 the"), (2, "W5, w6!"), (3, "unknown"), (4, ""), (5, None), (6, "copy copy w28 w29"), (7, "the"), (7, "the w3")]


def test_hits_with_copies_nulls_and_a_question_asked_twice(spark):
    for k in (1, 7, 600):
        check(spark, ROWS, QUERIES, k)


def test_rows_with_the_same_keys_are_one_hit(spark):
    check(spark, [*ROWS, *ROWS[:50], (3, "w1 w1 w28"), (None, "w1 the"), (None, "w29"), (None, "w1 the")], QUERIES, 9)


def test_many_passes_and_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(hybrid, "PASS_ENTRIES", 20, raising=False)
    monkeypatch.setattr(hybrid, "PAIRS", 50, raising=False)
    check(spark, ROWS, QUERIES, 5)


def test_a_task_hands_on_its_best_only(spark, monkeypatch):
    """All 500 rows have a word of all 40 questions: 20,000 pairs, of which three tasks hand on 5 a question each."""
    made, top = [], hybrid.top_per_query
    monkeypatch.setattr(hybrid, "top_per_query", lambda candidates, *rest: made.append(candidates.count()) or top(candidates, *rest))
    rows = [(i, f"the w{i % 50} " + "x " * (i % 11)) for i in range(500)]
    queries = [(q, f"the w{q}") for q in range(40)]
    found = ranked(spark, rows, queries, 5)
    assert made[0] <= 3 * 5 * 40
    assert found.count() == 200


def test_empty_tables_and_questions(spark):
    table = spark.createDataFrame(ROWS, "id long, content string")
    asked = spark.createDataFrame(QUERIES, "query_id long, query_text string")
    assert hybrid.keyword_ranks(table.limit(0), asked, 3, keys=["id"]).count() == 0
    assert hybrid.keyword_ranks(table, asked.limit(0), 3, keys=["id"]).count() == 0
    assert hybrid.keyword_ranks(table, asked.where("query_id = 3"), 3, keys=["id"]).count() == 0


def test_an_index_counts_words_in_the_row(spark, tmp_path, monkeypatch):
    """What is written as bags is grouped once, by text; no row per text and word is grouped."""
    from pyspark.sql.classic.dataframe import DataFrame

    from shelfmark.operators.keyword_index import KeywordIndex

    grouped, group = [], DataFrame.groupBy
    monkeypatch.setattr(DataFrame, "groupBy", lambda frame, *by: grouped.append(by) or group(frame, *by))
    table = spark.createDataFrame([(1, "a b A"), (2, "a b A"), (3, None), (4, "ß x y z y")], "id long, text string")
    index = KeywordIndex.build(table, str(tmp_path / "index"), "text", ["id"])
    assert [by for by in grouped if "_hash" in by] == [("_hash",)]
    bags = {tuple(r["_first"]): (r["_copies"], r["_length"], sorted(map(tuple, r["_bag"]))) for r in index._table("bags").collect()}
    assert bags == {
        (1,): (2, 3, [("a", 2), ("b", 1)]),
        (3,): (1, 0, []),
        (4,): (1, 5, [("x", 1), ("y", 2), ("z", 1), ("ß", 1)]),
    }
