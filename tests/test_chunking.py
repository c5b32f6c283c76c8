"""The chunker against a plain restatement of its rules, and its invariants."""

import random
import re

import pytest
from pyspark.sql import functions as F

from shelfmark.functions.text import chunk_budget
from shelfmark.operators.chunking import chunk_count, chunk_text
from tests.conftest import SF_DIR


def expected_chunks(body, budget):
    """(content, first line, last line) of each chunk."""
    if len(body) <= budget:
        return [(body, 1, body.count("\n") + 1)]
    groups = []  # [text, first, last, may grow]
    for number, line in enumerate(body.split("\n"), 1):
        line += "\n"
        if len(line) > budget:
            while line:
                cut = len(line)
                if cut > budget:
                    space = line.rfind(" ", 0, budget)
                    cut = space + 1 if space > budget / 2 else budget
                groups.append([line[:cut], number, number, False])
                line = line[cut:]
        elif groups and groups[-1][3] and len(groups[-1][0]) + len(line) <= budget:
            groups[-1][0] += line
            groups[-1][2] = number
        else:
            groups.append([line, number, number, True])
    return [(content.strip(), first, last) for content, first, last, _ in groups]


def spark_chunks(spark, bodies, tokens=512):
    df = spark.createDataFrame(list(enumerate(bodies)), "i int, content string")
    found = {}
    for r in chunk_text(df, "content", tokens).orderBy("i", "chunk_index").collect():
        found.setdefault(r.i, []).append(r)
    return [found.get(i, []) for i in range(len(bodies))]


M = chunk_budget(512)
EDGES = [
    "",
    "x" * M,
    "x" * (M + 1),
    "\n".join(["y" * (M - 2)] * 3),
    "\n".join(["y" * (M - 1)] * 3),
    "\n".join(["y" * M] * 3),
    "\n".join(["y" * (M + 1)] * 3),
    "z" * M + "\n" + "short",
    *("w" * k + " " + "v" * 900 for k in (M // 2 - 1, M // 2, M // 2 + 1, M - 2, M - 1, M)),
    ("word " * 400) + "\n" + ("word " * 400),
    "first\n" + "long " * 300,
    "long " * 300 + "\nlast",
    "\n" * 400,
    " " * 1500,
    "line of text\n" * 100,
    "é😀 " * 700,
    ("　" + "q" * 500 + "\xa0\n") * 4,
    "a\n" + "b" * 2000 + "\n\n\nc\n" + "d " * 900 + "\n",
    "no newline at end " * 3 + "\n" * 3 + "x" * 600,
]


@pytest.mark.parametrize("tokens", [512, 64, 7, 4, 3, 2, 1])
def test_edges(spark, tokens):
    budget = chunk_budget(tokens)
    for body, got in zip(EDGES, spark_chunks(spark, EDGES, tokens)):
        want = expected_chunks(body, budget)
        assert [(r.content, r.start_line, r.end_line) for r in got] == want
        assert [r.chunk_index for r in got] == list(range(len(want)))
        assert {r.total_chunks for r in got} == {len(want)}


@pytest.mark.parametrize("tokens", [512, 7, None])
def test_counting_agrees_with_chunking(spark, tokens):
    df = spark.createDataFrame([*enumerate(EDGES), (-1, None)], "i int, content string")
    counts = {r.i: r.n for r in df.select("i", chunk_count(F.col("content"), tokens).alias("n")).collect()}
    made = {r.i: r.total_chunks for r in chunk_text(df, max_tokens=tokens).collect()}
    assert counts == {**made, -1: None}


def test_random_texts(spark):
    rng = random.Random(3)
    bodies = [
        "".join(rng.choice("ab cdé\n\n \t😀　") for _ in range(rng.randrange(0, 900)))
        for _ in range(150)
    ]
    for body, got in zip(bodies, spark_chunks(spark, bodies, 40)):
        assert [(r.content, r.start_line, r.end_line) for r in got] == expected_chunks(body, 42)


@pytest.mark.parametrize("tokens", [2000, 32768])
def test_large_budgets_and_characters_of_two_sizes(spark, tokens):
    bodies = [
        "a😀" * 40000, "a😀 " * 30000, ("a😀" * 30 + "\n") * 1500, "x" * 200000, "word " * 30000,
        "\n" * 40000, "é😀\n" * 40000 + "tail",
    ]
    budget = chunk_budget(tokens)
    for body, got in zip(bodies, spark_chunks(spark, bodies, tokens)):
        assert [(r.content, r.start_line, r.end_line) for r in got] == expected_chunks(body, budget)


def test_documents_and_invariants(spark):
    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text")
    bodies = {r.doc_id: r.text for r in documents.collect()}
    found = {}
    for r in chunk_text(documents, "text").orderBy("doc_id", "chunk_index").collect():
        found.setdefault(r.doc_id, []).append(r)
    assert found.keys() == bodies.keys()
    for key, rows in found.items():
        body = bodies[key]
        assert [(r.content, r.start_line, r.end_line) for r in rows] == expected_chunks(body, M)
        assert all(len(r.content) <= M for r in rows)
        squeezed = re.sub(r"\s+", "", body)
        assert re.sub(r"\s+", "", "".join(r.content for r in rows)) == squeezed
        starts = [r.start_line for r in rows]
        assert starts == sorted(starts) and starts[0] == 1
        assert rows[-1].end_line == body.count("\n") + 1


def test_unsplit_null_and_empty(spark):
    rows = [(1, "a\n" * 1000), (2, None), (3, "")]
    df = spark.createDataFrame(rows, "i int, content string")
    got = {r.i: r for r in chunk_text(df, max_tokens=None).collect()}
    assert got[1].end_line == 1001 and got[1].content == "a\n" * 1000
    assert (got[1].chunk_index, got[1].total_chunks, got[1].start_line) == (0, 1, 1)
    assert 2 not in got
    assert (got[3].content, got[3].end_line) == ("", 1)


def test_drop_empty_keeps_numbers(spark):
    df = spark.createDataFrame([("z" * M + "\nshort",)], "content string")
    every = chunk_text(df).orderBy("chunk_index").collect()
    kept = chunk_text(df, drop_empty=True).orderBy("chunk_index").collect()
    assert [r.content for r in every] == ["z" * M, "", "short"]
    assert [(r.chunk_index, r.total_chunks) for r in kept] == [(0, 3), (2, 3)]


def test_budget_must_be_positive(spark):
    df = spark.createDataFrame([("x",)], "content string")
    with pytest.raises(ValueError):
        chunk_text(df, max_tokens=0)


def test_no_shuffle_and_no_array_copied_through_the_explode(spark):
    df = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    plan = chunk_text(df.select("doc_id", "text"), "text")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
    generate = next(line for line in plan.splitlines() if "Generate" in line)
    assert re.search(r"\), \[doc_id#\d+L?\], true", generate), generate


def test_other_columns_stay(spark):
    df = spark.createDataFrame([(1, "k", "x")], "i int, tag string, body string")
    got = chunk_text(df.withColumn("n", F.lit(2)), "body").collect()[0]
    assert (got.i, got.tag, got.n, got.content) == (1, "k", 2, "x")
