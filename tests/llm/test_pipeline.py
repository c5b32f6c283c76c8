"""The pipeline's stages against brute force, one after the other, and without the tables' comforts."""

import re

import corpus_pipeline
from pyspark.sql import functions as F

from shelfmark.llm import bpe
from tests.llm.test_operators import brute_near, brute_spans, smallest_reachable  # noqa: F401

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "decontamination", "secrets", "bpe"]
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF).checkpoint()
        assert after.columns == docs.columns
        was, now = {r["doc_id"]: r for r in before.collect()}, {r["doc_id"]: r for r in after.collect()}
        assert set(now) <= set(was)
        if name == "near_duplicates":
            _, component = brute_near([(i, r["text"]) for i, r in was.items()], 5)
            assert set(now) == {i for i in was if component[i] == i}
        if name == "decontamination":
            items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
            plain = lambda t: " " + " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(lower))) + " "
            grams = set()
            for w in (plain(t).split() for t in items):
                grams |= {" " + " ".join(w[i : i + 10]) + " " for i in range(max(1, len(w) - 9))}
            assert set(now) == {i for i, r in was.items() if not any(g in plain(r["text"]) for g in grams)}
        if name == "secrets":
            assert set(now) == set(was)
            assert all((now[i]["text"] == was[i]["text"]) == (not brute_spans(was[i]["text"])) for i in was)
        before = after
    last = corpus_pipeline.encode(spark, before, SF).collect()
    coder = bpe.ChunkEncoder(bpe.default_path())
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    assert {r["doc_id"]: r["n_tokens"] for r in last} == {i: len(coder.encode(t)) for i, t in texts.items()}


def test_odd_rows(spark):
    odd = [(1, None, "x"), (2, "", "x"), (None, "text of no number", "x"), (None, None, "x"), (3, "same words here", "x"), (3, "same words here", "x")]
    docs = spark.createDataFrame(odd, "doc_id long, text string, __other string")
    for rows in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            repeated = name == "near_duplicates" and not rows.isEmpty()
            assert stage(spark, rows, SF).count() == rows.count() - repeated


def test_decisions_are_on_rows(spark):
    """Rows without doc_id, and texts that share one, go or stay by their own text."""
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").head()["text"]
    plain = " ".join(f"word{i}" for i in range(40))
    other = " ".join(f"other{i}" for i in range(40))
    rows = [(1, plain), (1, f"before {item} after"), (None, f"again {item}"), (None, other), (None, other), (2, plain + " more"), (3, "alone in here"), (0, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).checkpoint()
    left = [tuple(r) for r in corpus_pipeline.drop_contaminated(spark, docs, SF).collect()]
    assert sorted(left, key=str) == sorted((r for r in rows if item not in (r[1] or "")), key=str)
    clean = docs.where(~F.contains(F.coalesce("text", F.lit("")), F.lit(item)))  # the two are copies of each other
    left = [tuple(r) for r in corpus_pipeline.drop_near_duplicates(spark, clean.checkpoint(), SF).collect()]
    assert sorted(left, key=str) == sorted({r for r in rows if r != (2, plain + " more") and item not in (r[1] or "")}, key=str)
    named = spark.createDataFrame([(None, other), (9, other), (7, other)], "doc_id long, text string").checkpoint()
    assert [r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, named, SF).collect()] == [7]
