"""Near-duplicate documents by SuperMinHash signatures, banding, verification and components."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import joinable, saved, texts
from shelfmark.llm.graph import components, spanning_links
from shelfmark.llm.words import mix, shingles, word_hashes

LANES = 128
BAND_LANES = 4
#: Buckets with more members than HOT are compared in blocks of about BLOCK members.
HOT = 32
BLOCK = 512
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BLOCK = 1 << 17


def superminhash(sets: list[np.ndarray], lanes: int = LANES) -> np.ndarray:
    """A row of signature values for each set of 64-bit hashes.

    Every element walks through a random permutation of the lanes, one lane a step,
    and offers step + a random fraction there; a lane keeps its smallest offer. An offer
    of step j is at least j, so a set is done when all its lanes hold less than the next
    step: after a few steps for large sets. All elements of all sets take a step
    together. Values are (step << 32) + fraction; lanes of an empty set keep the maximum.
    """
    best = np.full(len(sets) * lanes, np.iinfo(np.int64).max, np.int64)
    sizes = np.array([len(s) for s in sets], np.int64)
    elements = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owners = np.repeat(np.arange(len(sets)), sizes)
    for start in range(0, len(elements), _BLOCK):
        element, owner = elements[start : start + _BLOCK], owners[start : start + _BLOCK]
        order = np.empty((len(element), lanes), np.uint8 if lanes <= 256 else np.uint16)
        order[:] = np.arange(lanes)
        row = np.arange(len(element))
        for step in range(lanes):
            random = mix(element[row] + np.uint64((step + 1) * int(_STEP) & 0xFFFFFFFFFFFFFFFF))
            other = step + ((random & np.uint64(0xFFFFFFFF)) * np.uint64(lanes - step) >> np.uint64(32)).astype(np.int64)
            lane = order[row, other]
            order[row, other] = order[row, step]
            offer = (step << 32) + (random >> np.uint64(32)).astype(np.int64)
            np.minimum.at(best, owner[row] * lanes + lane, offer)
            open_sets = best.reshape(-1, lanes).max(1) >= (step + 1) << 32
            row = row[open_sets[owner[row]]]
            if not len(row):
                break
    return best.reshape(-1, lanes)


def band_hashes(signatures: np.ndarray, band_lanes: int = BAND_LANES) -> np.ndarray:
    """One 64-bit hash for each band of lanes; the band's number is part of it."""
    bands = signatures.shape[1] // band_lanes
    value = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(signatures), bands)).copy()
    for i in range(band_lanes):
        value = mix(value * np.uint64(0x100000001B3) + signatures[:, i : bands * band_lanes : band_lanes].astype(np.uint64))
    return value.view(np.int64)


def _signer(k: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for start, end, hashes in word_hashes(batch.column(1)):
                sets = [shingles(h, k) for h in hashes]
                bands = band_hashes(superminhash(sets))
                keys = [[int(mix(s ^ np.uint64(c)).sum(dtype=np.uint64).view(np.int64)) for s in sets] for c in (1, 2)]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids[start:end],
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(keys[0], pa.int64()),
                        pa.array(keys[1], pa.int64()),
                        pa.ListArray.from_arrays(
                            np.arange(0, bands.size + 1, bands.shape[1], dtype=np.int32), pa.array(bands.ravel())
                        ),
                    ],
                    ["doc_id", "n_shingles", "key1", "key2", "bands"],
                )

    return sign


def _set_maker(k: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for start, end, hashes in word_hashes(batch.column(1)):
                sets = [shingles(h, k).view(np.int64) for h in hashes]
                ends = np.cumsum([0] + [len(s) for s in sets]).astype(np.int32)
                values = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(sets)))
                yield pa.RecordBatch.from_arrays([ids[start:end], values], ["doc_id", "shingles"])

    return make


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, size_a, size_b) whose full sets overlap enough."""
    joined = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("set_b")), "b").join(
        sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("set_a")), "a"
    )
    common = F.size(F.array_intersect("set_a", "set_b")).cast("long")
    enough = 100 * common >= percent * (F.col("size_a") + F.col("size_b") - common)
    return joined.where(enough).select("a", "b")


def _overlaps(rows: list[np.ndarray], columns: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sets, as products of 0/1 matrices, some shingles at a time."""
    tokens = np.concatenate(rows + columns)
    owner = np.repeat(np.arange(len(rows) + len(columns)), [len(s) for s in rows + columns])
    _, token, n = np.unique(tokens, return_inverse=True, return_counts=True)
    shared = n[token] > 1
    number = np.cumsum(n > 1) - 1
    token, owner = number[token[shared]], owner[shared]
    out = np.zeros((len(rows), len(columns)), np.float32)
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    for start in range(0, int(token[-1]) + 1 if len(token) else 0, 4096):
        low, high = np.searchsorted(token, [start, start + 4096])
        part = np.zeros((len(rows) + len(columns), 4096), np.float32)
        part[owner[low:high], token[low:high] - start] = 1
        out += part[: len(rows)] @ part[len(rows) :].T
    return out


def _block_links(percent: int):
    def run(table: pa.Table) -> pa.Table:
        first, second = table["i"][0].as_py(), table["j"][0].as_py()
        block, ids = table["block"].to_numpy(), table["rep"].to_numpy()
        lists = table["shingles"].combine_chunks()
        sets = np.split(lists.flatten().to_numpy(), np.cumsum(pc.list_value_length(lists).to_numpy())[:-1])
        left = np.flatnonzero(block == first)
        right = left if first == second else np.flatnonzero(block == second)
        sizes = np.array([len(s) for s in sets], np.int64)
        common = _overlaps([sets[k] for k in left], [sets[k] for k in right]).astype(np.int64)
        u, v = np.nonzero(100 * common >= percent * (sizes[left][:, None] + sizes[right] - common))
        nodes, roots = spanning_links(len(ids), left[u], right[v])
        return pa.table({"a": pa.array(ids[roots]), "b": pa.array(ids[nodes])})

    return run


def _within_crowds(members: DataFrame, sets: DataFrame, percent: int, rows: int) -> DataFrame:
    """Links (a, b) that connect all members of large buckets which any chain of links connects; members: (first, rep) by bucket, at most ``rows``."""
    edges = members.where(F.col("first") != F.col("rep")).select(F.col("first").alias("a"), F.col("rep").alias("b"))
    crowd = saved(components(edges, rows=rows).select(F.col("node").alias("rep"), F.col("component").alias("crowd")), "crowds", 2 * rows)
    blocks = crowd.groupBy("crowd").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    placed = crowd.join(blocks, "crowd").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    dealt = placed.select("crowd", "rep", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        "crowd", "rep", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")
    )
    return (
        dealt.join(sets.withColumnRenamed("doc_id", "rep"), "rep")
        .groupBy("crowd", "i", "j")
        .applyInArrow(_block_links(percent), "a long, b long")
    )


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    A document's set is its distinct runs of ``shingle_words`` words (A-Z lowered,
    split at ASCII white space). Two documents are linked when 100 * |intersection| >=
    percent * |union|; component_id is the smallest doc_id reachable, kept marks it.

    1. One pass signs each text; documents of equal sets form a class, represented by
       its smallest doc_id. 32 bands of 4 lanes miss a pair of similarity 0.8 with a
       probability of about 5e-8.
    2. Within each band bucket all members are compared with the smallest one only, on
       full sets. The links found melt most of a group of near copies into one component.
    3. Where a bucket still holds several components and at most HOT members, its pairs
       between different ones that differ little in size are compared. Larger such buckets
       make up crowds; a crowd is cut into blocks, and each pair of blocks is one task
       that multiplies member-by-shingle matrices and returns links that connect what is
       connected, not pairs. So each pair that shares a bucket is either compared or known
       to be connected; a crowd's work grows with its square, its rows with its blocks.

    Empty or null texts have no shingles and are linked with nothing, nor is a row
    without doc_id (component_id null, kept). Rows that repeat a doc_id with the same text give
    equal result rows; with different texts, the number stands for all of them in links.
    """
    documents = texts(docs)
    signed = saved(
        documents.mapInArrow(
            _signer(shingle_words), "doc_id long, n_shingles long, key1 long, key2 long, bands array<long>"
        ),
        "signatures",
    )
    n = signed.count()
    classes = saved(
        signed.where("n_shingles > 0 and doc_id is not null")
        .groupBy("key1", "key2", "n_shingles")
        .agg(F.min(F.struct("doc_id", "bands")).alias("first"))
        .select("key1", "key2", F.col("n_shingles").alias("size"), F.col("first.doc_id").alias("rep"), F.col("first.bands").alias("bands")),
        "classes",
        n,
    )
    member = classes.select("rep", "size", F.explode("bands").alias("bucket"))
    centre = (
        member.groupBy("bucket")
        .agg(F.min(F.struct("rep", "size")).alias("centre"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("bucket", F.col("centre.rep").alias("a"), F.col("centre.size").alias("size_a"))
    )
    shared = saved(member.join(centre, "bucket"), "buckets", n * (LANES // BAND_LANES))
    n_shared = shared.count()
    alike = lambda x, y: 100 * F.least(x, y) >= percent * F.greatest(x, y)
    star = saved(
        shared.where(F.col("a") != F.col("rep"))
        .where(alike("size_a", "size"))
        .select("a", F.col("rep").alias("b"), "size_a", F.col("size").alias("size_b"))
        .distinct(),
        "pairs",
        n_shared,
    )
    candidates = shared.select(F.col("rep").alias("doc_id")).distinct()
    sets = saved(
        documents.join(candidates, "doc_id", "left_semi").mapInArrow(
            _set_maker(shingle_words), "doc_id long, shingles array<long>"
        ),
        "sets",
    )
    n_star = star.count()
    first = saved(_verified(joinable(star, n_star), sets, percent), "links", n_star)
    n_first = first.count()
    melted = joinable(saved(components(first, rows=n_first), "components", n), 2 * n_first)
    placed = (
        shared.select("bucket", "rep", "size")
        .join(melted.withColumnRenamed("node", "rep"), "rep", "left")
        .select("bucket", "rep", "size", F.coalesce("component", "rep").alias("part"))
    )
    mixed = (
        placed.groupBy("bucket")
        .agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count(F.lit(1)).alias("n"), F.min("rep").alias("first"))
        .where("low < high")
        .select("bucket", "n", "first")
    )
    open_members = saved(placed.join(mixed, "bucket"), "open", n_shared)
    cold = open_members.where(F.col("n") <= HOT)
    x, y = cold.alias("x"), cold.alias("y")
    rest = (
        x.join(y, "bucket")
        .where(F.col("x.part") < F.col("y.part"))
        .where(alike(F.col("x.size"), F.col("y.size")))
        .select(
            F.least("x.rep", "y.rep").alias("a"),
            F.greatest("x.rep", "y.rep").alias("b"),
            F.when(F.col("x.rep") < F.col("y.rep"), F.col("x.size")).otherwise(F.col("y.size")).alias("size_a"),
            F.when(F.col("x.rep") < F.col("y.rep"), F.col("y.size")).otherwise(F.col("x.size")).alias("size_b"),
        )
        .distinct()
        .join(joinable(star.select("a", "b"), n_star), ["a", "b"], "left_anti")
    )
    hot = open_members.where(F.col("n") > HOT).select("first", "rep")
    second = saved(_verified(saved(rest, "pairs"), sets, percent).union(_within_crowds(hot, sets, percent, n_shared)), "links")
    found = second.count()
    parts = joinable(components(first.union(second), rows=n_first + found), 2 * (n_first + found)) if found else melted
    grouped = classes.join(parts.withColumnRenamed("node", "rep"), "rep", "left").select(
        "key1", "key2", F.col("size").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id")
    )
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return (
        signed.drop("bands")
        .join(joinable(saved(grouped, "classes", n), n), ["key1", "key2", "n_shingles"], "left")
        .select(
            "doc_id",
            "n_shingles",
            component.alias("component_id"),
            F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"),
        )
    )
