"""Scalar functions against hand-made tables of expected values."""

import datetime as dt
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from shelfmark.functions import display, ids, paths, text
from shelfmark.schema import positive


def apply(spark, values, function, kind="string"):
    """Values of ``function`` over one column, in order."""
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(function(F.col("v"))).collect()]


@pytest.mark.parametrize(
    "path, expected, lang",
    [
        ("a.py", ".py", "python"),
        ("a.PY", ".PY", "python"),
        ("a.R", ".R", "r"),
        ("a.tar.gz", ".gz", "unknown"),
        (".gitignore", "", "unknown"),
        ("x/.env.local", ".local", "unknown"),
        ("Makefile", "", "unknown"),
        ("name.", "", "unknown"),
        ("dir.d/file", "", "unknown"),
        ("d/é.md", ".md", "markdown"),
    ],
)
def test_extension_and_language(spark, path, expected, lang):
    assert apply(spark, [path], paths.extension) == [expected]
    assert apply(spark, [expected], paths.language) == [lang]
    assert apply(spark, [path], paths.extension_or_placeholder) == [expected or "no_extension"]


def test_relative_and_absolute_path(spark):
    given = ["/r/a/b.py", "/r/a", "/ra/b", "/other/x"]
    assert apply(spark, given, lambda c: paths.relative_path(c, "/r/")) == [
        "a/b.py", "a", "/ra/b", "/other/x",
    ]
    given = ["file:/a/b", "file:///a/b", "hdfs://n/a", "/a"]
    assert apply(spark, given, paths.without_local_scheme) == ["/a/b", "/a/b", "hdfs://n/a", "/a"]


def test_modified_time_is_iso_text(spark):
    times = [dt.datetime(2024, 1, 2, 3, 4, 5, tzinfo=dt.timezone.utc),
             dt.datetime(2024, 1, 2, 3, 4, 5, 60, tzinfo=dt.timezone.utc)]
    expected = [t.replace(tzinfo=None).isoformat() for t in times]
    assert apply(spark, times, paths.modified_iso, "timestamp") == expected


def test_text_by_name(spark):
    given = ["a.py", "a.PY", "a.txt.gz", "d/x.c", ".txt", "a.json", "x.tar", "Makefile", "a.md"]
    assert apply(spark, given, paths.has_text_mime) == [
        True, True, True, True, False, False, False, False, True,
    ]


def test_row_id(spark):
    row = spark.range(1).select(ids.row_id(F.lit("My Repo"), F.lit("src/é.py"))).head()[0]
    assert row == hashlib.sha256("My Repo:src/é.py".encode()).hexdigest()[:16]


@pytest.mark.parametrize(
    "name, expected",
    [("My Plug--in  é!! v2_", "my_plug--in_é_v2"), ("!!", ""), ("a__b", "a_b"), ("A-B", "a-b")],
)
def test_sanitize(spark, name, expected):
    assert apply(spark, [name], ids.sanitized) == [expected]
    assert apply(spark, [name], ids.table_name) == [expected + "_rag"]


def test_only_the_suffix_goes(spark):
    assert apply(spark, ["x_rag_y_rag", "a_rag"], ids.corpus_of_table) == ["x_rag_y", "a"]


def test_strip_matches_python(spark):
    given = [" a ", "　é \x1c", "\t\n", "", "a b", "\x85\xa0x ", "​kept​"]
    assert apply(spark, given, text.strip) == [g.strip() for g in given]
    assert apply(spark, [*given, None], text.is_blank) == [not g.strip() for g in given] + [True]


def test_context_truncation(spark):
    given = ["x" * n for n in (614, 615, 10)]
    assert [len(t) for t in apply(spark, given, text.truncated_to_context)] == [614, 537, 10]
    assert text.chunk_budget(512) == 537
    assert apply(spark, ["é😀"], text.estimated_tokens) == [2 / 1.5]


def test_prefix(spark):
    assert apply(spark, ["q"], lambda c: text.with_prefix(c, text.QUERY_PREFIX)) == ["search_query: q"]
    assert apply(spark, ["q"], lambda c: text.with_prefix(c, None)) == ["q"]


def test_decoding(spark):
    given = [b"a\r\nb\rc\n", "é😀".encode(), b"\xe9t\xe9", b"", "中".encode()[:2]]
    expected = ["a\nb\nc\n", "é😀", "été", "", "ä¸"]
    assert apply(spark, [bytearray(b) for b in given], text.decoded, "binary") == expected


def test_binary_sniffing(spark):
    whole = "é".encode()
    given = [
        b"", b"plain", b"\0", b"a" * 1023 + b"\0", b"a" * 1024 + b"\0", b"a" * 1023 + whole,
        b"\xe9 latin", b"a" * 1022 + "中".encode() + b"b", b"\xc3",
    ]
    loose = apply(spark, [bytearray(b) for b in given], text.head_is_binary, "binary")
    assert loose == [False, False, True, True, False, False, False, False, False]
    strict = apply(
        spark, [bytearray(b) for b in given], lambda c: text.head_is_binary(c, False), "binary"
    )
    assert strict == [False, False, True, True, False, False, True, False, True]


def test_labels(spark):
    rows = [("a.py", 3, 9, 1, 4), ("a.py", 3, 9, 0, 1), ("a.py", 0, None, None, None)]
    df = spark.createDataFrame(rows, "p string, s int, e int, i int, n int").coalesce(1)
    got = [r[0] for r in df.select(display.location_label(*map(F.col, "psein"))).collect()]
    assert got == ["a.py (lines 3-9, chunk 2/4)", "a.py (lines 3-9)", "a.py (lines 1-1)"]


def test_preview(spark):
    assert apply(spark, ["abcdef", "abc"], lambda c: display.preview(c, 3)) == [
        "abc\n... (truncated)", "abc",
    ]
    assert apply(spark, ["abc"], lambda c: display.preview(c, 0)) == ["abc"]
    assert apply(spark, ["abc"], lambda c: display.preview(c, None)) == ["abc"]


def test_scores_are_formatted_as_in_python(spark):
    rng = random.Random(7)
    values = [0.0625, 0.0005, 0.00005, 0.1235, 1.0, 0.9995, 0.3125, 0.99995, 0.5, 0.0]
    values += [rng.random() for _ in range(3000)] + [round(rng.random(), 4) for _ in range(3000)]
    assert apply(spark, values, display.score_text, "double") == [f"{v:.3f}" for v in values]
    assert apply(spark, values, display.percent_text, "double") == [f"{v:.2%}" for v in values]


def test_zero_is_refused():
    assert positive("k", None, 5) == 5
    with pytest.raises(ValueError):
        positive("k", 0, 5)
