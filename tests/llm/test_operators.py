"""Every operator against brute force on small tables with nulls, ties, repeats, long texts and clashing columns."""

import base64
import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyarrow import parquet
from pyspark.sql import functions as F

from shelfmark.llm import archives, blob_ledger, bpe, common, compression_language, graph, phrase_index, pseudo_likelihood, quantised, sharding, superminhash, toxicity
from shelfmark.llm import words as hashed

DOCS = "doc_id long, text string, lang string, source string, n_chars long, bucket int, key string, score double, shard int, rep long, n long"
WORDS = [a + b for a in "ba ko ri mu te la zo ne vi pu".split() for b in "n r s t l m".split()]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    base = sentence(rng, 120).split()
    out = []
    for i in range(60):
        near = list(base)
        for at in rng.sample(range(len(near)), rng.randint(0, 9)):
            near[at] = rng.choice(WORDS) + str(rng.randint(0, 99))
        out.append((i, " ".join(near)))
    out += [(100 + i, sentence(rng, rng.randint(1, 60))) for i in range(30)]
    out += [(200, None), (201, ""), (202, "  \n\t"), (203, "one"), (204, "One"), (205, "a b"), (206, "a b"), (206, "a b"), (None, "a b"), (None, None)]
    out += [(207, "Ünïcode ÉÉ 漢字 😀 token = \"abcdef123\" AKIA" + "Z" * 16 + " " + "0af" * 9 + "g password:ab secret: token: abcdefgh")]
    out += [(208, "<|endoftext|> it's  a   <|endoftext|>\n\n end <|endo")]
    out += [(209, sentence(rng, 30_000)), (210, "x" * 200_000), (211, "zz " + " ".join(base[10:40]) + " qq")]
    return [(i, t, "en" if t and i and i % 2 else None, "s", len(t or ""), 1, "k", 0.5, 3, 9, 8) for i, t in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def ids_of(rows):
    return sorted((r[0] if r[0] is not None else -1) for r in rows)


def got_ids(frame, column="doc_id"):
    return sorted(-1 if pd.isna(v) else int(v) for v in frame[column])


# -- 1 ----------------------------------------------------------------------------


def reference_tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_path())


def test_bpe_digests(docs, rows, empty):
    tokenizer = reference_tokenizer()

    def digest(value):
        return hashlib.sha256(value.encode("utf-8")).hexdigest()

    expected = []
    for row in rows:
        ids = tokenizer.encode(row[1] or "", add_special_tokens=False).ids
        expected.append((row[0], len(ids), digest(",".join(map(str, ids))), digest(tokenizer.decode(ids, skip_special_tokens=False))))
    found = [tuple(r) for r in bpe.digests(docs).collect()]
    assert sorted(found, key=str) == sorted(expected, key=str)
    assert bpe.digests(empty).count() == 0


def test_bpe_chunks_join_exactly_whatever_the_cuts(monkeypatch):
    for name, value in (("MIN_CHUNK", 3), ("CUT_BITS", 2), ("MAX_CHUNK", 9)):
        monkeypatch.setattr(bpe, name, value)
    tokenizer, coder, rng = reference_tokenizer(), bpe.ChunkEncoder(bpe.default_path()), random.Random(1)
    parts = ["a", "b", " ", "  ", "\n", "'", "'ll", "'re", "1", "²", "é", "漢", "!", ".", "<|endoftext|>", "<|endo", "　", "😀", "\t", "\x85"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 60)))
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert coder.encode(text) == ids, repr(text)
        assert coder.decode(ids) == tokenizer.decode(ids, skip_special_tokens=False)


def test_bpe_round_trip_and_reuse(docs, rows):
    back = bpe.decode(bpe.encode(docs)).collect()
    assert sorted(map(str, (r["text"] for r in back))) == sorted(r[1] or "" for r in rows)
    coder = bpe.ChunkEncoder(bpe.default_path())
    text = sentence(random.Random(5), 4000)
    coder.encode(text)
    once = coder.encoded
    coder.encode("other words first " + text)
    assert coder.encoded < once + 6


# -- 2 ----------------------------------------------------------------------------


def test_shards(spark, docs, rows, empty):
    rng = random.Random(7)
    many = rows + [(1000 + i, sentence(rng, rng.randint(1, 200)), None, "s", 0, 1, "k", 0.5, 3, 9, 8) for i in range(3000)]
    many += [(5000 + i, "copy of one text", None, "s", 0, 1, "k", 0.5, 3, 9, 8) for i in range(1500)]
    many += [(9000 + 20 * g + i, f"group {g} " + sentence(random.Random(g), 30), None, "s", 0, 1, "k", 0.5, 3, 9, 8) for g in range(40) for i in range(20)]
    found = sharding.shard_documents(spark.createDataFrame(many, DOCS)).toPandas()
    assert got_ids(found) == ids_of(many)
    assert set(found.law) == {"bytes"} and found.grown_shard.isna().all()
    size = {i: len((t or "").encode()) + 1 for i, t, *_ in many if i is not None}
    crc = {i: zlib.crc32((t or "").encode()) for i, t, *_ in many if i is not None}
    for r in found[found.doc_id.notna()].itertuples():
        assert r.size == size[r.doc_id] and r.text_crc32 == crc[r.doc_id]
    loads = found[found["size"] < 100_000].groupby("shard")["size"].sum()
    for _, own in found.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))
    total = found["size"].sum() / 8
    heavy = found.groupby("shard")["size"].sum()
    assert len(loads) == 8 and (heavy - total).abs().max() <= max(0.02 * total, 200_001)
    groups = found[(found.doc_id >= 9000)].copy()
    groups["g"] = (groups.doc_id - 9000) // 20
    assert (groups.groupby("g").shard.nunique() == 1).mean() > 0.9
    assert sharding.shard_documents(empty).count() == 0


def test_shards_are_even_without_huge_rows(spark):
    rng = random.Random(8)
    many = [(i, sentence(rng, rng.randint(1, 60))) for i in range(6000)] + [(7000 + i, "same") for i in range(3000)]
    found = sharding.shard_documents(spark.createDataFrame(many, "doc_id long, text string")).toPandas()
    loads = found.groupby("shard")["size"].sum()
    assert loads.max() - loads.min() <= 0.01 * loads.mean()


def test_shards_gather_a_group_of_a_third(spark):
    rng = random.Random(9)
    many = [(i, sentence(rng, 30)) for i in range(4000)]
    many += [(10_000 + i, sentence(random.Random(-1), 30)) for i in range(2800)]
    many += [(20_000 + i, sentence(random.Random(1000 + i // 4), 30)) for i in range(1600)]
    found = sharding.shard_documents(spark.createDataFrame(many, "doc_id long, text string"))
    loads = found.groupBy("shard").agg(F.sum("size").alias("w")).toPandas().w
    assert len(loads) == 8 and loads.max() - loads.min() <= 0.02 * loads.mean()
    cut = sharding.cut_share(found.select(F.col("text_crc32").alias("group"), "shard")).collect()[0]["cut"]
    assert cut < 0.68  # two whole shards and part of a third cut 0.66 of the pairs, eight even parts 0.875
    small = found.where("doc_id >= 20000").groupBy(F.expr("(doc_id - 20000) div 4")).agg(F.countDistinct("shard").alias("n"))
    assert small.where("n = 1").count() > 0.9 * 400


def test_shards_skip_cells_that_do_not_fit():
    assert sharding._grants([(0, 1, 0, 50), (0, 1, 1, 5), (0, 1, 2, 4)], [60, 60], 70) == {(0, 1): [1, 2]}


# -- 3 ----------------------------------------------------------------------------


def smallest_reachable(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def brute_near(rows, k):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, text, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(lower))
        n = min(k, len(w))
        sets[i] = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if n else set()
    named = [i for i in sets if i is not None and sets[i]]
    links = []
    for a, b in itertools.combinations(named, 2):
        common = len(sets[a] & sets[b])
        if 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
            links.append((a, b))
    return sets, smallest_reachable([i for i in sets if i is not None], links)


def test_components_of_few_links_are_few_files(spark, monkeypatch):
    files = {}
    monkeypatch.setattr(graph, "saved", lambda frame, name, *rows: files.setdefault(name, []).append(common.saved(frame, name, *rows)) or files[name][-1])
    put = {"spark.sql.shuffle.partitions": "97", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in put}
    try:
        for k, v in put.items():
            spark.conf.set(k, v)
        links = spark.createDataFrame([(i, i + 1) for i in range(3000)], "a long, b long")
        assert {r["component"] for r in graph.components(links).collect()} == {0}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    for name in ("picks", "roots"):
        assert all(len(frame.inputFiles()) <= spark.sparkContext.defaultParallelism for frame in files[name])
    monkeypatch.setattr(common, "PACKED", 100)  # more rows, more parts
    assert len(common.saved(spark.range(0, 3000, 1, 64), "many", 3000).inputFiles()) == 30


@pytest.mark.parametrize(("k", "hot"), [(2, 32), (5, 32), (2, 4)])
def test_near_duplicates(docs, rows, empty, monkeypatch, k, hot):
    monkeypatch.setattr(superminhash, "HOT", hot)
    monkeypatch.setattr(superminhash, "BLOCK", 16)
    sets, component = brute_near(rows, k)
    found = superminhash.near_duplicates(docs, k).toPandas()
    assert got_ids(found) == ids_of(rows)
    for r in found[found.doc_id.notna()].itertuples():
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), component[r.doc_id], r.doc_id == component[r.doc_id])
    nameless = found[found.doc_id.isna()]
    assert nameless.kept.all() and nameless.component_id.isna().all()
    if hot == 4:
        assert superminhash.near_duplicates(empty, k).count() == 0


def test_signatures_estimate_similarity_and_stop_early():
    rng = np.random.default_rng(0)
    common, a, b = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (800, 100, 100))
    one, two = superminhash.superminhash([np.concatenate([common, a]), np.concatenate([common, b])], 256)
    assert abs((one == two).mean() - 0.8) < 0.08
    assert (one >> 32).max() < 20
    assert (superminhash.superminhash([np.zeros(0, np.uint64)])[0] == np.iinfo(np.int64).max).all()


def test_components_of_a_long_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5, 5), (None, 3), (7, 6)]
    found = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(301)} | {1000 + i: 1000 for i in range(200)}


def test_word_hashes_do_not_depend_on_pieces(monkeypatch):
    import pyarrow as pa

    text = sentence(random.Random(1), 500) + "\x0b\x0cÄ É　x"
    whole = [h for _, _, h in hashed.word_hashes(pa.array([None, text, "", text]))]
    monkeypatch.setattr(hashed, "PIECE", 64)
    pieces = [x for _, _, h in hashed.word_hashes(pa.array([None, text, "", text])) for x in h]
    for x, y in zip(whole[0], pieces, strict=True):
        assert (x == y).all() and len(x) == len(y)
    assert len(whole[0][1]) == len(re.findall(r"[^\x20\x09-\x0D]+", text))


# -- 4 ----------------------------------------------------------------------------


def test_contamination(spark, docs, rows, empty):
    base = rows[211 - 211][1].split()
    items = [
        (1, " ".join(base[5:45])), (2, "One"), (3, "a,B"), (4, None), (5, "..."), (6, sentence(random.Random(99), 12)),
        (10, "zz " + " ".join(base[10:19])), (1, " ".join(base[5:45])), (None, "ünïcode éé"), (7, "it s a"),
    ]
    bench = spark.createDataFrame(items, "item_id long, text string")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(lower))
    windows = []
    for i, text in items:
        w = split(text)
        windows += [(i, w[j : j + 10]) for j in range(max(1, len(w) - 9)) if w]
    expected = []
    for i, text, *_ in rows:
        w, hit, found = split(text), set(), set()
        for item, g in windows:
            for j in range(len(w) - len(g) + 1):
                if w[j] == g[0] and w[j : j + len(g)] == g:
                    hit |= set(range(j, j + len(g)))
                    found.add(item)
        names = sorted(str(x) for x in found if x is not None)
        expected.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    got = [tuple(r) for r in phrase_index.contamination(docs, bench).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert phrase_index.contamination(empty, bench).count() == 0
    assert phrase_index.contamination(docs, bench.limit(0)).where("contaminated").count() == 0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "red x x green x blue"), (2, "red x x x x x x green blue"), (3, "blue"), (4, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "green blue red"), (2, "BLUE")], "item_id long, text string")
    rows = phrase_index._documents(docs, "doc_id", "text")
    found = {(r["doc_id"], r["item_id"]) for r in phrase_index.proximity_hits(rows, items, 6).collect()}
    assert found == {(1, "1"), (1, "2"), (2, "2"), (3, "2")}


# -- 5 ----------------------------------------------------------------------------


def test_pseudo_likelihood_learns_order(spark, docs, rows, empty):
    rng = random.Random(2)
    follow = {w: rng.choice(WORDS) for w in WORDS}

    def chain(n):
        out = [rng.choice(WORDS)]
        while len(out) < n:
            out.append(follow[out[-1]] if rng.random() < 0.8 else rng.choice(WORDS))
        return out

    text = [(i, " ".join(chain(400))) for i in range(150)]
    vocabulary, network = pseudo_likelihood.train(spark.createDataFrame(text, "doc_id long, text string").repartition(4))
    fresh = chain(400)
    mixed = fresh[:]
    rng.shuffle(mixed)
    score = pseudo_likelihood.scored(spark.createDataFrame([(1, " ".join(fresh)), (2, " ".join(mixed))], "doc_id long, text string"), vocabulary, network)
    ordered, shuffled = (r["perplexity"] for r in score.orderBy("doc_id").collect())
    assert ordered < 0.8 * shuffled
    found = pseudo_likelihood.score_documents(docs).toPandas()
    assert got_ids(found) == ids_of(rows)
    assert (found[found.n_tokens == 0].log_likelihood == 0).all() and found[found.n_tokens == 0].perplexity.isna().all()
    assert pseudo_likelihood.score_documents(empty).count() == 0


def test_components_broadcast_no_large_table(spark, monkeypatch):
    """Links and components are shuffled for a join if they are more rows than may be broadcast, whatever their bytes."""
    plans, keep = [], graph.saved
    monkeypatch.setattr(common, "BROADCAST_ROWS", 50)
    monkeypatch.setattr(graph, "saved", lambda frame, *a: plans.append(frame) or keep(frame, *a))
    links = spark.range(100).selectExpr("id as a", "id + 1 as b")
    found = graph.components(links, rows=100)
    large = [f._jdf.queryExecution().executedPlan().toString() for f in [found, *plans[:4]]]
    assert any("SortMergeJoin" in p for p in large) and not any("Broadcast" in p for p in large)
    assert {(r["node"], r["component"]) for r in found.collect()} == {(i, 0) for i in range(101)}


def test_pseudo_likelihood_holds_few_blocks_at_once(spark):
    """A partition's blocks are read one by one and go to Python in batches of about one, whatever their number."""
    words = "a few of the words " * (pseudo_likelihood.BLOCK // 5 + 1)
    docs = spark.createDataFrame([(i, words) for i in range(3)], "doc_id long, text string").coalesce(1)
    blocks = pseudo_likelihood.tokenised(docs, pseudo_likelihood.Vocabulary([], None))
    files = [parquet.ParquetFile(f.removeprefix("file://")).metadata for f in blocks.inputFiles()]
    assert [m.row_group(g).num_rows for m in files for g in range(m.num_row_groups)] == [1, 1, 1]

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    with common.batches_of(spark, pseudo_likelihood.BATCH_SIZE):
        found = [r["n"] for r in blocks.mapInArrow(sizes, "n long").collect()]
    assert len(found) > 1 and sum(found) == 3 and spark.conf.get(key) == before


def test_pseudo_likelihood_is_a_sum_over_both_sides():
    network = pseudo_likelihood.Network.new(np.zeros(pseudo_likelihood.EDGE))
    tokens = np.arange(10)
    around = pseudo_likelihood.neighbours(tokens)
    assert around[0].tolist() == [pseudo_likelihood.EDGE] * 3 + [1, 2, 3] and around[5].tolist() == [2, 3, 4, 6, 7, 8]
    every = [np.exp(network.log_probabilities(around[:1], np.array([t]))[0]) for t in range(pseudo_likelihood.EDGE)]
    assert abs(sum(every) - 1) < 1e-5


def test_pseudo_likelihood_predicts_words_not_buckets(spark, monkeypatch):
    monkeypatch.setattr(pseudo_likelihood, "BLOCK", 500)
    rng = random.Random(5)
    common = [f"c{i}" for i in range(2000)]
    text = [(i, " ".join(rng.choice(common) for _ in range(200))) for i in range(200)] + [(900, " ".join(f"r{i}" for i in range(200)))]
    frame = spark.createDataFrame(text, "doc_id long, text string").repartition(3)
    vocabulary, network = pseudo_likelihood.train(frame)
    fresh = [(1, text[0][1]), (2, text[-1][1]), (3, " ".join(f"unseen{i}" for i in range(200))), (None, "r1"), (None, "r1"), (4, None)]
    found = pseudo_likelihood.scored(spark.createDataFrame(fresh, "doc_id long, text string"), vocabulary, network).toPandas()
    by = found.dropna(subset="doc_id").set_index("doc_id")
    assert len(found) == 6 and by.n_tokens[4] == 0 and by.log_likelihood[4] == 0
    assert by.perplexity[2] > 5 * by.perplexity[1] and by.perplexity[3] > 5 * by.perplexity[1]
    # Every word's share by brute force: with the class's probability fixed, shares of a class and its uncounted word are 1.
    counts = {r["word"] & (2**64 - 1): r["n"] for r in vocabulary.counts.collect()}
    words = np.array(sorted(counts), np.uint64)
    tokens = vocabulary.tokens(words)
    for t in range(pseudo_likelihood.FREQUENT, pseudo_likelihood.EDGE):
        assert sum(counts[int(w)] for w in words[tokens == t]) + 1 == vocabulary.seen[t]
    hashes = next(hashed.word_hashes(pa.array([text[-1][1]]), True))[2][0]
    tokens = vocabulary.tokens(hashes)
    want = network.log_probabilities(pseudo_likelihood.neighbours(tokens), tokens).sum()
    want += sum(np.log(counts[int(w)] / vocabulary.seen[t]) for w, t in zip(hashes, tokens) if t >= pseudo_likelihood.FREQUENT)
    assert abs(by.log_likelihood[2] - want) < 1e-3


def test_pseudo_likelihood_trains_on_every_token(docs, rows):
    network = pseudo_likelihood.Network.new(np.zeros(pseudo_likelihood.EDGE))
    vocabulary = pseudo_likelihood.Vocabulary([], None)
    texts = pa.array([t for _, t, *_ in rows[:90]])
    batch = pa.RecordBatch.from_arrays([texts], ["text"])
    rounds = pseudo_likelihood.ROUNDS
    seen = [next(pseudo_likelihood._trainer(network, vocabulary, turn, rounds, 0.3)(iter([batch]))).column("n")[0].as_py() for turn in range(rounds)]
    assert sum(seen) == sum(len(t.split()) for t in texts.to_pylist()) and min(seen) > 0


def test_pseudo_likelihood_hashes_texts_twice(spark, docs, monkeypatch):
    read = []
    monkeypatch.setattr(pseudo_likelihood, "texts", lambda d: read.append(d) or common.texts(d))
    assert pseudo_likelihood.score_documents(docs).count() == docs.count()
    assert len(read) == 2  # for the counts, and for the tokens that all rounds and the scores read


def test_pseudo_likelihood_texts_side_by_side_are_apart():
    sizes, tokens = np.array([0, 4, 1, 0, 9, 0]), np.arange(14) % pseudo_likelihood.EDGE
    padded, places = pseudo_likelihood.edged(sizes, tokens)
    ends = np.cumsum(sizes)
    want = np.concatenate([pseudo_likelihood.neighbours(tokens[e - n : e]) for e, n in zip(ends, sizes) if n])
    assert (padded[places[:, None] + pseudo_likelihood._OFFSETS] == want).all() and (padded[places] == tokens).all()


def test_pseudo_likelihood_of_logits_far_apart():
    network = pseudo_likelihood.Network.new(np.linspace(0, -1000, pseudo_likelihood.EDGE))
    network.out[:, -1] += 1000 * np.sign(network.hidden(np.zeros((1, 6), int))[0])
    around = np.array([[0] * 6, [pseudo_likelihood.EDGE] * 6, [5] * 6])
    logits = network.hidden(around).astype(float) @ network.out + network.prior
    want = logits - np.logaddexp.reduce(logits, axis=1)[:, None]
    for t in (0, 1, pseudo_likelihood.EDGE - 1):
        assert np.allclose(network.log_probabilities(around, np.full(3, t)), want[:, t], rtol=1e-4, atol=1e-3)


def test_pseudo_likelihood_words_of_one_class_are_told_apart_by_their_sides(spark):
    # Two topics; each word "x..y" has the class of all others, so only its sides say whose it is.
    rng = random.Random(9)
    often = [[f"{t}{i}{end}" for i in range(4) for end in ends] for t, ends in (("a", ("on", "ed")), ("b", ("ui", "as")))]
    rare = [[f"x{t}{i}yy" for i in range(150)] for t in "ab"]
    extra = [f"f{i}" for i in range(pseudo_likelihood.FREQUENT)]

    def line(topic, words):
        return " ".join(rng.choice(words if at % 3 == 1 else often[topic]) for at in range(60))

    text = [(i, line(i % 2, rare[i % 2])) for i in range(400)] + [(i, " ".join(extra * 60)) for i in range(400, 405)]
    state = rng.getstate()
    own = line(0, rare[0])
    rng.setstate(state)
    other = line(0, rare[1])  # the same classes in the same order
    found = pseudo_likelihood.score_documents(spark.createDataFrame([*text, (900, own), (901, other)], "doc_id long, text string").repartition(2)).toPandas()
    by = found.set_index("doc_id").log_likelihood
    assert by[900] > by[901] + 20


def test_pseudo_likelihood_shares_of_a_class_are_one_for_every_kind_of_sides(spark, rows, docs, monkeypatch):
    monkeypatch.setattr(pseudo_likelihood, "COMMON", 9)
    vocabulary, network = pseudo_likelihood.train(docs)
    blocks = pseudo_likelihood.tokenised(docs, vocabulary)
    sides = pseudo_likelihood.learn_sides(blocks, vocabulary, network)
    every = sides.counts.toPandas()
    assert (every.word.nunique(), every[sides.names].to_numpy().sum()) == (len(every), sum(vocabulary.seen[pseudo_likelihood.FREQUENT :] - 1))
    words = every.word.to_numpy().view(np.uint64)
    shares = np.exp(sides.logs(words, every[sides.names].to_numpy(), vocabulary))
    of = vocabulary.tokens(words)
    uncounted = sides.share / sides.total
    for t in np.unique(of):
        assert np.allclose(shares[of == t].sum(0) + uncounted[t], 1)
    # A text's likelihood by brute force.
    text = max((t or "" for _, t, *_ in rows), key=len)
    hashes = next(hashed.word_hashes(pa.array([text]), True))[2][0]
    tokens = vocabulary.tokens(hashes)
    around = pseudo_likelihood.neighbours(tokens)
    at = {w: i for i, w in enumerate(words.tolist())}
    want = network.log_probabilities(around, tokens).sum()
    want += sum(np.log(shares[at[w], k]) for w, k, t in zip(hashes.tolist(), sides.kinds(around).tolist(), tokens) if t >= pseudo_likelihood.FREQUENT)
    one = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert abs(pseudo_likelihood.scored(one, vocabulary, network, sides).first()["log_likelihood"] - want) < 1e-3 * len(tokens)


def test_pseudo_likelihood_classes_are_endings():
    keys = next(hashed.word_hashes(pa.array(["a Running É x ring, sing"]), True))[2][0]
    assert (keys & hashed.ENDING).tolist() == [ord("a"), int.from_bytes(b"ng"), int.from_bytes("É".encode()), ord("x"), int.from_bytes(b"g,"), int.from_bytes(b"ng")]
    assert len(set(keys.tolist())) == 6
    vocabulary = pseudo_likelihood.Vocabulary([int(keys.view(np.int64)[1])], None, [int.from_bytes(b"ng")])
    assert vocabulary.tokens(keys).tolist() == [pseudo_likelihood.REST, 0, *[pseudo_likelihood.REST] * 3, pseudo_likelihood.FREQUENT]


def test_pseudo_likelihood_beats_word_counts_whatever_the_partitions(spark):
    rng = random.Random(8)
    tongues = [[f"{rng.choice('bdfgklm')}{rng.choice('aeiou')}{i}{end}" for i in range(400) for end in ends] for ends in (("on", "ed"), ("eux", "ai"), ("ung", "ig"))]
    text = [(i, " ".join(rng.choice(tongues[i % 3]) for _ in range(200))) for i in range(600)]
    frame = spark.createDataFrame(text, "doc_id long, text string")
    counts = Counter(w for _, t in text for w in t.split())
    tokens = sum(counts.values())
    unigram = -sum(n * math.log(n / tokens) for n in counts.values()) / tokens
    for parts in (1, 8, 24):
        vocabulary, network = pseudo_likelihood.train(frame.repartition(parts))
        found = pseudo_likelihood.scored(frame, vocabulary, network).agg(F.sum("log_likelihood") / F.sum("n_tokens")).first()[0]
        assert -found < unigram - 0.3


def test_pseudo_likelihood_steps_down_the_gradient():
    network = pseudo_likelihood.Network.new(np.zeros(pseudo_likelihood.EDGE))
    rng = np.random.default_rng(6)
    tokens = rng.integers(0, 9, 40)
    around, moved, by = pseudo_likelihood.neighbours(tokens), network.copy(), 1e-2
    moved.step(around, tokens, 1.0)
    for at in [(0, int(tokens[0]), 3), (4, int(tokens[7]), 5)]:
        losses = []
        for sign in (1, -1):
            probe = network.copy()
            probe.tables[at] += sign * by
            losses.append(-probe.log_probabilities(around, tokens).mean())
        assert abs((losses[0] - losses[1]) / (2 * by) - float(network.tables[at] - moved.tables[at])) < 1e-4


# -- 6 ----------------------------------------------------------------------------


def test_embeddings(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(40, 16))
    near = np.concatenate([base, base[:20] + rng.normal(size=(20, 16)) * 0.25, base[:20] * 3.0, base[:8] + rng.normal(size=(8, 16)) * 0.45])
    vectors = [(i, v.tolist()) for i, v in enumerate(near)]
    vectors += [(500, None), (501, [0.0] * 16), (502, [float("nan")] * 16), (503, [float("inf")] + [1.0] * 15), (504, [None] + [1.0] * 15), (505, []), (506, [1.0, 0.0]), (507, [2.0, 0.1]), (None, base[0].tolist())]
    vectors += [(600 + i, base[0].tolist()) for i in range(30)] + [(508, [1e-300] * 16), (509, [1e300] * 16)]
    frame = spark.createDataFrame([(i, v, 1, "x") for i, v in vectors], "vec_id long, embedding array<double>, rep int, tile string")
    good = {i: np.array(v) for i, v in vectors if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)}
    good = {i: v / np.abs(v).max() for i, v in good.items()}
    links = [(a, b) for a, b in itertools.combinations(good, 2) if len(good[a]) == len(good[b]) and good[a] @ good[b] / np.sqrt((good[a] @ good[a]) * (good[b] @ good[b])) >= 0.9]
    nodes = [i for i, _ in vectors if i is not None]
    component, degree = smallest_reachable(nodes, links), dict.fromkeys(nodes, 0)
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    for tile_rows in (4096, 8):
        found = quantised.near_duplicates(frame, tile_rows=tile_rows, pivots=4).toPandas()
        assert len(found) == len(vectors)
        for r in found[found.vec_id.notna()].itertuples():
            assert (r.n_links, r.component_id, r.kept) == (degree[r.vec_id], component[r.vec_id], r.vec_id == component[r.vec_id]), r
    assert quantised.near_duplicates(frame.limit(0)).count() == 0


def test_quantised_bound_loses_no_pair():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 8))
    x /= np.linalg.norm(x, axis=1)[:, None]
    i, j = quantised.possible(x, x, 0.9)
    exact = set(zip(*np.nonzero(x @ x.T >= 0.9), strict=True))
    assert exact <= set(zip(i, j, strict=True)) and len(i) < 1.2 * len(exact) + 20


# -- 7 ----------------------------------------------------------------------------


def test_archives(spark, tmp_path):
    pages = [(1, "http://a/x y\n", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "http://b", None), (4, "http://c", ""), (5, "u", "\r\n\r\nWARC/1.1\r\n\r\n"), (6, "u", "x" * 3_000_000), (5, "u", "\r\n\r\nWARC/1.1\r\n\r\n"), (None, "n", "<p>é</p>"), (7, "u", "HTTP/1.1 200 OK\r\n\r\nbody")]
    frame = spark.createDataFrame([(*p, "c", b"c") for p in pages], "page_id long, url string, html string, name string, content binary")
    raw = [(i, (h or "").encode()) for i, _, h in pages]
    expected = []
    for i, data in raw:
        largest = max(j for j, d in raw if d == data and j is not None)
        sha = base64.b32encode(hashlib.sha1(data).digest()).decode()
        expected.append((i, len(data), sha, "response" if i == largest else "revisit", None if i == largest else largest))
    got = [tuple(r) for r in archives.round_trip(frame).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)
    got = archives.round_trip(frame, str(tmp_path / "w"), least_bytes=5).where("payload_bytes < 5").collect()
    assert {r["record_type"] for r in got} == {"response"} and len(got) == 2
    assert archives.round_trip(frame.limit(0)).count() == 0


def test_archives_are_parsed_twice_and_read_once(spark, tmp_path, monkeypatch):
    parsed, read, convert, unpack = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0), archives._convert, archives._read

    def counted(total, step):
        def run(batches):
            for batch in step(batches):
                total.add(len(batch))
                yield batch

        return run

    monkeypatch.setattr(archives, "_convert", counted(parsed, convert))
    monkeypatch.setattr(archives, "_read", counted(read, unpack))
    frame = spark.createDataFrame([(i, "u", f"text {i % 7}") for i in range(30)], "page_id long, url string, html string")
    assert archives.round_trip(frame, str(tmp_path / "w")).count() == 30
    assert (parsed.value, read.value) == (60, 30)


@pytest.mark.parametrize("version", [1, 2])
def test_arc_headers(version):
    data = archives.arc_header(version, "a.arc")
    data += archives.arc_record(version, "a.arc", len(data), "http://x/", b"HTTP/1.0 404 No\r\nA: b\r\n\r\n\nbody\n", "-")
    data += archives.arc_record(version, "a.arc", len(data), "http://y/", b"", "-")
    first, second = archives.parse_arc("a.arc", data)
    assert first["URL"] == "http://x/" and first["content"].endswith(b"\nbody\n") and second["content"] == b""
    assert ("Result-code" in first) == (version == 2)
    with pytest.raises(ValueError, match="declares"):
        list(archives.parse_arc("a.arc", data[: data.index(b"body")]))
    with pytest.raises(ValueError, match="version"):
        list(archives.parse_arc("a.arc", data.replace(f"{version} 0 shelfmark".encode(), b"9 0 shelfmark")))


# -- 8 ----------------------------------------------------------------------------

BASE = (
    ("assign", re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
)


def brute_spans(text):
    spans = [(m.start(), rank, kind, m.end()) for rank, (kind, p, group, least) in enumerate(BASE) for m in p.finditer(text or "") if len(m[group]) >= least]
    return sorted(spans)


def test_secrets(docs, rows, empty):
    found = [(r["doc_id"], [tuple(s) for s in r["spans"]]) for r in blob_ledger.document_secrets(docs).select("doc_id", "spans").collect()]
    expected = [(r[0], brute_spans(r[1])) for r in rows]
    assert sorted(found, key=str) == sorted(expected, key=str)
    assert len(brute_spans(rows[-5][1])) == 3
    assert blob_ledger.document_secrets(empty).count() == 0


def test_ledger_scans_only_what_it_has_not_seen(spark, tmp_path):
    folder = str(tmp_path / "ledger")
    first = spark.createDataFrame([(1, "token=abcdef"), (2, "token=abcdef"), (3, "clean")], "doc_id long, text string")
    blob_ledger.document_secrets(first, folder).count()
    assert blob_ledger.read_ledger(spark, folder).count() == 2 * 3
    more = first.union(spark.createDataFrame([(4, "x AKIA" + "A" * 16)], first.schema))
    found = {r["doc_id"]: len(r["spans"]) for r in blob_ledger.document_secrets(more, folder).collect()}
    assert found == {1: 1, 2: 1, 3: 0, 4: 1}
    assert blob_ledger.read_ledger(spark, folder).count() == 3 * 3
    newer = (*blob_ledger.RULES[:2], blob_ledger.Rule("hex", "[0-9a-f]{6,}", version=2))
    found = {r["doc_id"]: len(r["spans"]) for r in blob_ledger.document_secrets(more, folder, newer).collect()}
    assert found[1] == 2 and blob_ledger.read_ledger(spark, folder).count() == 3 * 3 + 3


def test_redaction(spark):
    frame = spark.createDataFrame([("é token=abcdef1 z",), ("none",), (None,), ("token=" + "0123456789abcdef" * 2,)], "text string")
    found = blob_ledger.findings(blob_ledger.scan(frame))
    clean = blob_ledger.with_findings(frame, found).select(blob_ledger.redacted(F.col("text"), F.col("spans")).alias("t"))
    assert sorted(str(r["t"]) for r in clean.collect()) == ["None", "[assign]", "none", "é [assign] z"]


# -- 9 ----------------------------------------------------------------------------


def test_languages(spark, docs, rows, empty):
    found = compression_language.languages(docs).toPandas()
    assert got_ids(found) == ids_of(rows)
    by = found[found.doc_id.notna()].set_index("doc_id")
    assert (by.loc[[200, 201, 202]].lang_pred == "und").all() and found.score.between(0, 1).all()
    for r in found[found.doc_id.notna()].itertuples():
        assert r.held_out == (zlib.crc32(str(int(r.doc_id)).encode()) % 3 == 1)
    assert compression_language.languages(empty).count() == 0


def test_languages_held_out(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = compression_language.languages(table).where("held_out").join(table.select("doc_id", "lang"), "doc_id").toPandas()
    assert (found.lang == found.lang_pred).mean() > 0.95


def test_languages_beside_one_of_one_short_text(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    rare = next(i for i in range(10**9, 10**9 + 100) if zlib.crc32(str(i).encode()) % 3 != 1)
    more = table.union(spark.createDataFrame([(rare, "qxj wvk zzq jxw kqv", "xx")], "doc_id long, text string, lang string"))
    plain, dictionaries = compression_language.train(table), compression_language.train(more)
    assert set(dictionaries) == {*plain, "xx"} and all(dictionaries[lang] == data for lang, data in plain.items())
    found = compression_language.predicted(table, dictionaries).join(table, "doc_id").toPandas()
    before = compression_language.predicted(table, plain).toPandas().set_index("doc_id").lang_pred
    assert (found.lang_pred == found.doc_id.map(before)).mean() > 0.99
    assert compression_language.Classifier(dictionaries).predict("qxj wvk zzq jxw kqv")[0] == "xx"


# -- 10 ---------------------------------------------------------------------------


def test_toxicity(spark, docs, rows, empty):
    labels = spark.createDataFrame([(100, 1), (101, 0), (102, None), (None, 1), (100, 0), (103, 7)], "doc_id long, toxic int")
    found = toxicity.toxicity(docs, labels).toPandas()
    assert got_ids(found) == ids_of(rows) and found.score.between(0, 1).all()
    assert (found.predicted == (found.score >= 0.7)).all()
    assert toxicity.toxicity(empty, labels).count() == 0
    assert toxicity.toxicity(docs, labels.limit(0)).count() == len(rows)


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    table, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    found = toxicity.toxicity(table, labels).where("held_out").join(labels, "doc_id").toPandas()
    caught, clean = found[found.toxic == 1].predicted.mean(), 1 - found[found.toxic == 0].predicted.mean()
    assert caught > 0.85 and clean > 0.99


def test_trees_and_isotonic():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] < 0)).astype(float)
    trees = toxicity.Trees().fit(x[:1000], y[:1000])
    assert ((trees.margin(x[1000:]) > 0) == y[1000:]).mean() > 0.95
    at, rate = toxicity.isotonic(np.array([0.0, 1, 2, 3, 3, 4]), np.array([0.0, 1, 0, 1, 0, 1]))
    assert (np.diff(rate) >= 0).all() and (np.diff(at) >= 0).all() and rate[0] < 0.5 < rate[-1]


def test_obfuscated_words_and_second_person():
    lexicon = toxicity.Lexicon({"idiot": 3.0, "loser*": 2.0})
    value = dict(zip(toxicity.FEATURES, toxicity.features("You 1d10t! losers, LOSERVILLE", lexicon), strict=True))
    assert value["heaviest"] == 3.0 and value["near_you"] > 0 and value["obfuscated"] > 0 and value["capitals"] > 0.3
    assert toxicity.features("", lexicon) == [0.0] * len(toxicity.FEATURES)


# -- long runs, repeats ---------------------------------------------------------------


@pytest.mark.parametrize("character", [" ", "\n", "\t", "^", "a", "\u3000"])
def test_bpe_of_long_runs(character):
    tokenizer, coder = reference_tokenizer(), bpe.ChunkEncoder(bpe.default_path())
    run = character * 2_000_000
    for text in (f"x{run}y", run, f"a b {run} c{run[:150_000]}"):
        assert coder.encode(text) == tokenizer.encode(text, add_special_tokens=False).ids


def test_repeated_labelled_rows_are_one_of_the_sample(spark):
    rng = random.Random(2)
    rows = [(i, sentence(rng, 20)) for i in range(60)]
    docs = spark.createDataFrame(rows + [rows[0]] * 5000, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    sample = [tuple(r)[:2] for r in toxicity._sample(docs, labels, 20, "toxic").collect()]
    assert len(sample) == len(set(sample)) and all(sum(y == k for _, y in sample) <= 20 for k in (0, 1))


def test_phrases_of_one_repeated_word(spark):
    import time

    item = spark.createDataFrame([("i", "zz " * 2000), ("j", "ab cd " * 300)], "item_id string, text string")
    docs = spark.createDataFrame([(1, "x " + "zz " * 20_000), (2, "zz " * 9), (3, "q " + "ab cd " * 1000 + "ab")], "doc_id long, text string")
    phrase_index.contamination(docs.limit(1), item.limit(0)).collect()
    began = time.time()
    found = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"]) for r in phrase_index.contamination(docs, item).collect()}
    assert found == {1: (20_001, 20_000, 1), 2: (9, 0, 0), 3: (2002, 2001, 1)}
    assert time.time() - began < 60


def test_redaction_takes_time_in_proportion(spark):
    import time

    def seconds(n):
        text = " ".join(f"é{i} password=abcdef{i}" for i in range(n))
        row = spark.createDataFrame([(1, text)], "doc_id long, text string").checkpoint()
        found = blob_ledger.findings(blob_ledger.saved(blob_ledger.scan(row), "ledger"))
        began = time.time()
        clean = blob_ledger.with_findings(row, found).select(blob_ledger.redacted(F.col("text"), F.col("spans"))).head()[0]
        assert clean == " ".join(f"é{i} [assign]" for i in range(n))
        return time.time() - began

    seconds(100)
    assert seconds(8000) < 10
