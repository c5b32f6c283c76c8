"""URL templates, integer clusters and collocations against brute force and against their SQL on odd rows."""

import collections
import hashlib
import math
import random
import re

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shelfmark.llm import centroids, collocations, queries, sql, url_templates


def by_sql(statement, **tables):
    connection = duckdb.connect()
    for name, table in tables.items():
        connection.register(name, table)
    found = connection.execute(statement)
    names = [d[0] for d in found.description]
    return sorted((dict(zip(names, row, strict=True)) for row in found.fetchall()), key=str)


def by_spark(frame, names):
    return sorted(({n: row[n] for n in names} for row in frame.collect()), key=str)


def in_order(rows):
    return sorted((tuple(sorted(r.items())) for r in rows), key=str)


# -- 11 ---------------------------------------------------------------------------


def urls():
    rng = random.Random(4)
    out = [None, "", "no scheme", "http://", "http://org", "http://org/", "x://A.ORG/es/1", "http://xorg/", "http://a.example.org/es",
           "http://example.org/es/", "http://EXAMPLE.org/en/12?x=/", "http://b.example.org/en/2#://", "http://shop.com/de/9", "http://com/fr/",
           "http://a.com?/fr/", "http://a.com#/fr/", "://", "a://b://c/d", "http://u@h.net:80/a//b///", "http://t.net/" + "/".join(map(str, range(40))),
           "http://t.net/" + "x" * 100_000, "http://t.net/" + "a/" * 20_000, "http://ü.net/É/e.PHP", "http://h.net/\nq"]
    for i in range(400):
        out.append(f"http://big.com/{rng.choice(['en', 'es', 'fr', 'de'])}/{rng.randint(1, 999)}{rng.choice(['', '/', '.html'])}")
        out.append(f"http://big.com/user/{rng.choice('abcdefghij')}{rng.choice('abcdefghij')}{rng.choice('xyz')}/posts/{i}")
    out += [f"http://bad.com/de/{i}/x" for i in range(40)] + [f"http://bad.com/en/{i}/x" for i in range(40)]
    out += ["http://bad.com/de/1/x"] * 30
    return list(enumerate(out)) + [(None, "http://n.org/x"), (3, "http://n.net/x"), (3, "http://n.net/x")]


def test_url_templates(spark):
    rows = urls()
    pages = spark.createDataFrame([(i, u, "h", 1) for i, u in rows], "page_id long, url string, host string, n int").repartition(4)
    found = url_templates.judged(pages)
    names = ["page_id", "host", "path", "rule", "verdict", "template"]
    table = pa.table({"page_id": pa.array([r[0] for r in rows], pa.int64()), "url": [r[1] for r in rows]})
    got = by_spark(found, names)
    assert in_order(got) == in_order(by_sql(sql.PATH_TEMPLATES, pages=table))
    by_url = {}
    for row in got:
        by_url.setdefault(row["page_id"], row)
    assert {(by_url[i]["rule"], by_url[i]["verdict"]) for i in (5, 6)} == {("org/", "allow")}
    assert (by_url[4]["rule"], by_url[4]["host"], by_url[4]["path"]) == (None, "org", "")
    assert by_url[8]["rule"] == "org/" and by_url[9]["rule"] == "example.org/es/" and by_url[10]["rule"] == "example.org/en/1"
    assert by_url[12]["verdict"] == "block" and by_url[13]["verdict"] == "allow" and by_url[14]["path"] == ""
    users = {r["template"] for r in got if r["host"] == "big.com" and "/user/" in r["path"]}
    assert users == {"/user/*/posts/0"}
    assert {r["verdict"] for r in got if r["host"] == "bad.com" and r["rule"] is None} == {"block"}
    assert {r["verdict"] for r in got if r["host"].endswith(".net")} == {"allow"}


def test_url_templates_of_nothing(spark):
    empty = spark.createDataFrame([], "page_id long, url string")
    assert url_templates.judged(empty).count() == 0
    nulls = spark.createDataFrame([(None, None), (1, None)], "page_id long, url string")
    assert {(r["host"], r["path"], r["verdict"]) for r in url_templates.judged(nulls).collect()} == {("", "", "allow")}


def test_url_query_uses_no_python_worker(spark):
    pages = spark.createDataFrame([(1, "http://a.com/de/1")], "page_id long, url string")
    plan = url_templates.judged(pages)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# -- 12 ---------------------------------------------------------------------------


def lloyd(rows, clusters, rounds, seed=2):
    points = []
    for vec_id, v in rows:
        if v is not None and len(v) == 4 and all(x is not None and math.isfinite(x) for x in v):
            points.append((vec_id, [math.floor(256 * x) for x in v]))
    named = [(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), x) for i, x in points if i is not None]
    means = [x for _, x in sorted(named)] + sorted(x for i, x in points if i is None)
    means = means[:clusters]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, m, strict=True)), c) for c, m in enumerate(means))
    for _ in range(rounds):
        groups = collections.defaultdict(list)
        for _, x in points:
            groups[near(x)[1]].append(x)
        means = [[sum(col) // len(groups[c]) for col in zip(*groups[c], strict=True)] if groups[c] else m for c, m in enumerate(means)]
    ends = [(i, *near(x)) for i, x in points]
    sums = collections.Counter()
    for _, d, c in ends:
        sums[c] += d
    return sorted(
        ((i, c, d, sums[c], sum(sums.values()), hashlib.sha256(",".join(map(str, means[c])).encode()).hexdigest()) for i, d, c in ends), key=str
    )


@pytest.fixture(scope="module")
def vectors():
    rng = random.Random(9)
    rows = [(i, [rng.gauss(i % 3, 0.4) for _ in range(4)]) for i in range(150)]
    rows += [(200 + i, [0.5, -0.25, 0.0, 1.0]) for i in range(40)]  # equal rows: ties and empty clusters
    rows += [(300, None), (301, []), (302, [1.0] * 5), (303, [1.0, None, 1.0, 1.0]), (304, [float("nan")] * 4), (305, [float("inf"), 0.0, 0.0, 0.0])]
    return rows + [(7, [9.0, 9.0, 9.0, 9.0]), (7, [9.0, 9.0, 9.0, 9.0]), (None, [0.0, 0.1, -0.1, -3.0]), (306, [0.0] * 4), (307, [-0.001] * 4)]


VECTORS = "vec_id long, embedding array<float>, cluster int, x array<int>, distance double"


@pytest.mark.parametrize("clusters", [1, 7, 12, 1000])
def test_centroids(spark, vectors, clusters):
    frame = spark.createDataFrame([(i, v, 1, [1], 0.5) for i, v in vectors], VECTORS).repartition(5)
    held = [(r[0], None if r[1] is None else list(r[1])) for r in frame.select("vec_id", "embedding").collect()]  # as floats
    found = centroids.cluster_vectors(frame, clusters, rounds=3, components=4)
    assert sorted(map(tuple, found.collect()), key=str) == lloyd(held, clusters, 3)


def test_centroids_of_nothing(spark):
    none = spark.createDataFrame([(1, None, 1, [1], 0.5)], VECTORS)
    for frame in (none, none.limit(0)):
        assert centroids.cluster_vectors(frame).collect() == []


def test_centroids_refuse_what_64_bits_cannot_hold(spark):
    large = spark.createDataFrame([(1, [1e30] * 64, 1, [1], 0.5)], VECTORS)
    with pytest.raises(Exception, match="above"):
        centroids.cluster_vectors(large).collect()


# -- 13 ---------------------------------------------------------------------------

PHRASED = "doc_id long, text string, lang string, phrase string, f int"


def brute_collocations(rows, order, least, top, percent=50):
    counts, totals = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            for k in range(1, order + 1):
                for i in range(len(words) - k + 1):
                    counts[lang, tuple(words[i : i + k])] += 1
    candidates = {key: a for key, a in counts.items() if len(key[1]) > 1 and a >= least}
    around = collections.Counter()
    for (lang, words), a in candidates.items():
        for k in range(2, len(words)):
            for i in range(len(words) - k + 1):
                around[lang, words[i : i + k]] = max(a, around[lang, words[i : i + k]])
    listed = collections.defaultdict(list)
    for (lang, words), a in candidates.items():
        if 100 * around[lang, words] >= percent * a and around[lang, words]:
            continue
        score, _, l, r = min((10**6 * a * a // (counts[lang, words[:k]] * counts[lang, words[k:]]), k, counts[lang, words[:k]], counts[lang, words[k:]]) for k in range(1, len(words)))
        listed[lang].append((-score, -a, " ".join(words).encode(), l, r))
    return sorted(
        (lang, rank, p.decode(), -a, l, r, totals[lang], -s)
        for lang, found in listed.items()
        for rank, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1)
    )


@pytest.fixture(scope="module")
def phrased():
    rng = random.Random(11)
    vocabulary = ["the", "The", "of", "new", "York", "york", "city", "é", "É", "İ", "漢字", "😀", "a\xa0b", "x-1", "-", "|"]
    rows = []
    for i in range(600):
        words = rng.choices(vocabulary, k=rng.randint(0, 14))
        if rng.random() < 0.3:
            words += ["New", "york", "City", "hall"]
        rows.append(("".join(w + rng.choice([" ", "  ", "\t", ". ", ",", "\n", " \r\n", "\x0b", "!?"]) if rng.random() < 0.4 else w + " " for w in words), rng.choice(["en", "de", None])))
    rows += [(None, "en"), ("", None), (" \t\n", "fr"), ("ha " * 5000, "zz"), ("one two", "en"), ("w" * 100_000, "en"), (None, None), ("a b c", "")]
    return rows + [("same old story again", "en")] * 15


@pytest.mark.parametrize(("order", "least", "top"), [(3, 10, 2000), (3, 3, 5), (2, 4, 2000), (4, 5, 2000)])
def test_collocations(spark, phrased, order, least, top):
    docs = spark.createDataFrame([(i, t, lang, "p", 3) for i, (t, lang) in enumerate(phrased)], PHRASED).repartition(6)
    found = collocations.collocations(docs, order, least, top)
    assert sorted(map(tuple, found.collect())) == brute_collocations(phrased, order, least, top)


def test_collocations_of_nothing(spark):
    empty = spark.createDataFrame([], PHRASED)
    assert collocations.collocations(empty).count() == 0
    rare = spark.createDataFrame([(1, "only once here", "en", "p", 1)], PHRASED)
    assert collocations.collocations(rare).count() == 0


def test_collocation_products_pass_64_bits(spark):
    """Counts beyond what a test can hold: the score's arithmetic alone."""
    row = spark.range(1).select(F.lit(3_000_000_000).alias("a"), F.lit(4_000_000_000).alias("l"), F.lit(5_000_000_000).alias("r"))
    score = F.expr("(cast(1000000 as decimal(7,0)) * cast(a as decimal(15,0)) * cast(a as decimal(15,0))) div (cast(l as decimal(15,0)) * cast(r as decimal(15,0)))")
    assert row.select(score.alias("s")).head()["s"] == 450_000


# -- the queries over whole tables against their SQL -------------------------------


@pytest.mark.parametrize("name", ["op11_path_templates", "op12_centroids", "op13_rollup_collocations"])
def test_queries_equal_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    connection = duckdb.connect()
    for table in ("pages", "embeddings", "documents"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    found = connection.execute(sql.ORACLES[name])
    names = [d[0] for d in found.description]
    rows = [dict(zip(names, r, strict=True)) for r in found.fetchall()]
    frame = queries.QUERIES[name](spark, folder)
    assert sorted(frame.columns) == sorted(names)
    assert in_order(by_spark(frame, names)) == in_order(rows)
