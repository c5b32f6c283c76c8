"""Texts that used to take quadratic time, and bytes behind byte-order marks."""

import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark import chunk_text
from shelfmark.functions import html, text
from shelfmark.operators import embedding


def seconds(action) -> float:
    began = time.monotonic()
    action()
    return time.monotonic() - began


def plain_page_text(page: str) -> str:
    for name in ("script", "style"):
        page = re.sub(rf"(?is)<{name}\b[^>]*>.*?(?:</{name}\s*>|\Z)", " ", page)
    page = re.sub(r"(?s)<!--.*?(?:-->|\Z)", " ", page)
    page = re.sub("<[^>]*>", " ", page)
    for entity, character in html._ENTITIES.items():
        page = page.replace(entity, character)
    return re.sub("[ \t]+", " ", page).replace("\n ", "\n").replace(" \n", "\n")


def test_page_text_of_broken_pages(spark):
    rng = np.random.default_rng(4)
    parts = ["<script", "<script>", "</script>", "</script ", "<style a>", "</style>", "<!--", "-->", "<", ">", "x", "é ", "\n", "&lt;", "\x01", "<p>", "😀"]
    pages = ["", "<", ">", "a<b", "<script", "<script>x", "x\x01", "<style>\x01"]
    pages += ["".join(rng.choice(parts, rng.integers(1, 14))) for _ in range(3_000)]
    frame = spark.createDataFrame([(i, p) for i, p in enumerate([*pages, None])], "i int, page string")
    got = [r[0] for r in frame.orderBy("i").select(html.page_text(F.col("page"))).collect()]
    assert got == [*map(plain_page_text, pages), None]


@pytest.mark.parametrize("part", ["<", "<script ", "<script>", "<style", "<!--", "</script ", "&lt;", "< >"])
def test_page_text_takes_linear_time(spark, part):
    page = spark.range(1).select(html.page_text(F.expr(f"repeat('{part}', {1_000_000 // len(part)})")).alias("t"))
    assert seconds(page.select(F.length("t")).collect) < 5


def test_emoji_are_cut_in_linear_time(spark):
    def cut(words: int) -> float:
        frame = spark.range(1).select(F.expr(f"repeat('😀a😀 ', {words})").alias("content"))
        return seconds(chunk_text(frame, "content", 2_000).agg(F.sum(F.length("content"))).collect)

    cut(1_000)
    once = cut(300_000)
    assert cut(600_000) < 2.6 * once + 1


@pytest.mark.parametrize("tokens", [3, 60, 2_000])
def test_emoji_are_cut_like_letters(spark, tokens):
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(["😀", "a", " ", "\n", "bb ", "𝒳"], 9_000, p=[0.3, 0.3, 0.1, 0.01, 0.19, 0.1])) for _ in range(6)]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, content string")
    letters = frame.withColumn("content", F.regexp_replace("content", r"[\x{10000}-\x{10FFFF}]", "x"))
    shown = [sorted(map(tuple, chunk_text(f, "content", tokens).collect()), key=lambda r: (r[0], r[4])) for f in (frame, letters)]
    assert [tuple(re.sub("[\U00010000-\U0010ffff]", "x", v) if isinstance(v, str) else v for v in r) for r in shown[0]] == shown[1]
    again = "".join(r[1] for r in shown[0] if r[0] == 0)
    assert re.sub(r"\s", "", again) == re.sub(r"\s", "", texts[0])


def test_marks_of_wide_encodings(spark):
    body = "one\r\ntwo é 中 😀\U0010ffff ﻿"
    wanted = body.replace("\r\n", "\n")
    marks = {"utf-16-le": b"\xff\xfe", "utf-16-be": b"\xfe\xff", "utf-32-le": b"\xff\xfe\0\0", "utf-32-be": b"\0\0\xfe\xff"}
    good = [mark + body.encode(name) for name, mark in marks.items()]
    broken = [mark + body.encode(name) + b"\0" for name, mark in marks.items()]
    broken += [b"\xff\xfe\x00\xd8a\0", b"\xfe\xff\xdc\x00\0a", b"\xff\xfea\0\0\0", b"\0\0\xfe\xff\0\x11\0\0", b"\0\0\xfe\xff\0\0\xd8\0"]
    empty = list(marks.values())
    rows = [(i, b and bytearray(b)) for i, b in enumerate([*good, *empty, *broken, None])]
    frame = spark.createDataFrame(rows, "i int, b binary")
    got = [tuple(r) for r in frame.orderBy("i").select(text.decoded(F.col("b")), text.head_is_binary(F.col("b")), text.head_is_binary(F.col("b"), False)).collect()]
    assert got[:4] == [(wanted, False, False)] * 4
    assert got[4:8] == [("", False, False)] * 4
    assert [r[1:] for r in got[8:-1]] == [(True, True)] * len(broken)
    assert got[8][0] == text_as_latin1(broken[0]) and got[-1] == (None, True, True)
    long = spark.createDataFrame([(bytearray(b"\xff\xfe" + ("ab😀" * 700_000).encode("utf-16-le")),)], "b binary")
    assert long.select(F.length(text.decoded(F.col("b")))).first()[0] == 2_100_000


def text_as_latin1(content: bytes) -> str:
    return re.sub("\r\n?", "\n", content.decode("latin-1"))


def test_vectors_are_not_shuffled(spark):
    rows = [(1, [0.0, 0.0]), (1, [0.0, 0.0]), (1, [0.5, 0.5]), (2, [1.0, 2.0]), (2, None), (2, []), (2, [1.0, 2.0])]
    found = embedding.degenerate_vectors(spark.createDataFrame(rows, "label int, vector array<float>"), by=["label"])
    assert sorted(map(tuple, found.collect())) == [(1, 3, 2, 1, 1), (2, 3, 0, 0, 1)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert all("vector" not in line for line in plan.splitlines() if "Exchange" in line)
