"""Near-duplicate embeddings: int8 tile products with error bounds, exact only where the bound leaves doubt."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import saved
from shelfmark.llm.graph import components, spanning_links

TILE_ROWS = 4096
#: Vectors whose directions name the neighbourhoods that tiles are cut from.
PIVOTS = 16


def quantise(units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(codes, scale, size, error) of unit vectors: int8 codes, their step, the norm of step * codes and of what is lost."""
    scale = np.abs(units).max(1) / 127
    codes = np.rint(units / scale[:, None]).astype(np.int8)
    near = codes * scale[:, None]
    return codes, scale, np.linalg.norm(near, axis=1), np.linalg.norm(units - near, axis=1)


def possible(a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of unit vectors whose cosine may reach the threshold.

    With x = x' + e and y = y' + f (primes: quantised), x.y - x'.y' = x'.f + e.y, at most
    |x'||f| + |e|. Code products are whole numbers below 2**24 for up to 1,040 dimensions,
    exact in float32; beyond, float64 is used. 1e-9 covers the rounding of the rest.
    """
    (ca, sa, na, ea), (cb, sb, _, eb) = quantise(a), quantise(b)
    kind = np.float32 if a.shape[1] <= 1040 else np.float64
    product = (ca.astype(kind) @ cb.astype(kind).T).astype(np.float64)
    upper = product * sa[:, None] * sb + na[:, None] * eb + ea[:, None]
    return np.nonzero(upper >= threshold - 1e-9)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", a, b) / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b)))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)


def _compare(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        """A pair of tiles: per class the number of linked vectors, and links that connect what is connected."""
        first, second = table["first"][0].as_py(), table["second"][0].as_py()
        tile = table["tile"].to_numpy()
        ids, copies = table["rep"].to_numpy(), table["copies"].to_numpy()
        vectors = _matrix(table["v"])
        left = np.flatnonzero(tile == first)
        right = left if first == second else np.flatnonzero(tile == second)
        units = vectors / np.linalg.norm(vectors, axis=1)[:, None]
        us, vs = [], []
        for at in range(0, len(left), 256):
            rows = left[at : at + 256]
            i, j = possible(units[rows], units[right], threshold)
            i, j = rows[i], right[j]
            if first == second:
                i, j = i[i < j], j[i < j]
            for part in range(0, len(i), 1 << 16):
                x, y = i[part : part + (1 << 16)], j[part : part + (1 << 16)]
                real = cosines(vectors[x], vectors[y]) >= threshold
                us.append(x[real])
                vs.append(y[real])
        u, v = np.concatenate(us or [np.zeros(0, int)]), np.concatenate(vs or [np.zeros(0, int)])
        links = np.bincount(u, copies[v], len(ids)) + np.bincount(v, copies[u], len(ids))
        hit = np.flatnonzero(links)
        nodes, roots = spanning_links(len(ids), u, v)
        none = lambda n: pa.nulls(n, pa.int64())
        return pa.table(
            {
                "rep": pa.concat_arrays([pa.array(ids[hit]), none(len(nodes))]),
                "links": pa.concat_arrays([pa.array(links[hit].astype(np.int64)), none(len(nodes))]),
                "a": pa.concat_arrays([none(len(hit)), pa.array(ids[nodes])]),
                "b": pa.concat_arrays([none(len(hit)), pa.array(ids[roots])]),
            }
        )

    return run


def _pivoted(pivots: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = pivots / np.linalg.norm(pivots, axis=1)[:, None]
        for batch in batches:
            if not len(batch):
                continue
            v = _matrix(batch.column(2))
            similar = (v / np.linalg.norm(v, axis=1)[:, None]) @ units.T
            best = similar.argmax(1)
            angle = np.arccos(np.clip(similar[np.arange(len(v)), best], -1, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best, pa.int64()), pa.array(angle)], ["rep", "copies", "v", "pivot", "angle"])

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, vec_id: str = "vec_id", embedding: str = "embedding", tile_rows: int = TILE_ROWS, pivots: int = PIVOTS) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Two vectors are linked if their cosine in double precision is at least the threshold.
    Equal vectors form a class first; the tiles hold classes, so copies never multiply.
    Classes go to the nearest of ``pivots`` directions and from there into tiles of bounded
    size, ordered by the angle to the pivot. Two tiles are compared unless the angles prove
    that no pair of theirs can be linked (triangle inequality on the sphere). A pair of tiles is
    one small task: int8 products with the error bound of each vector, exact cosines for
    the pairs the bound leaves open; it returns counts and a spanning forest of its links, never pairs.

    Vectors that are null, empty, zero or hold null or non-finite components are linked
    with nothing (n_links 0, own component); vectors of different lengths are never
    linked. Rows without vec_id are linked with nothing and kept. Repeated rows count as copies.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & finite & F.exists("v", lambda x: x != 0)
    # A scale does not change the cosine; with it no square over- or underflows.
    scaled = F.transform("v", lambda x: x / F.array_max(F.transform("v", F.abs)) + F.lit(0.0))
    keyed = saved(
        rows.select("vec_id", F.when(F.coalesce(usable, F.lit(False)), scaled).alias("v")).select(
            "vec_id", "v", F.when(F.col("v").isNotNull(), F.sha2(F.concat_ws(",", F.col("v").cast("array<string>")), 256)).alias("key")
        ),
        "vectors",
    )
    classes = saved(
        keyed.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("v").alias("v")),
        "classes",
    )
    lengths = [row["n"] for row in classes.select(F.size("v").alias("n")).distinct().collect()]
    out = []
    for length in lengths:
        own = classes.where(F.size("v") == length).select("rep", "copies", "v")
        sample = own.orderBy(F.xxhash64("rep")).limit(pivots).toArrow()
        placed = saved(own.mapInArrow(_pivoted(_matrix(sample["v"])), "rep long, copies long, v array<double>, pivot long, angle double"), "placed")
        counts = placed.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("angle", [i / 16 for i in range(1, 16)], 1000).alias("cuts")).collect()
        # Each pivot's classes are cut by angle into 16 rings, each ring by hash into tiles of about tile_rows.
        spec = spark.createDataFrame(
            [(r["pivot"], list(r["cuts"]) if r["n"] > tile_rows else [], max(1, -(-r["n"] // (tile_rows * (16 if r["n"] > tile_rows else 1))))) for r in counts],
            "pivot long, cuts array<double>, parts long",
        )
        ring = F.size(F.filter("cuts", lambda c: c < F.col("angle")))
        tiled = saved(
            placed.join(F.broadcast(spec), "pivot").select(
                "rep", "copies", "v", "pivot", "angle", F.concat_ws("-", "pivot", ring, F.pmod(F.xxhash64("rep"), F.col("parts"))).alias("tile")
            ),
            "tiles",
        )
        summary = tiled.groupBy("tile").agg(F.first("pivot").alias("pivot"), F.min("angle").alias("low"), F.max("angle").alias("high"))
        out.append(_tile_pairs(tiled, saved(summary, "summary"), _matrix(sample["v"]), threshold))
    results = None
    for compared in out:
        results = compared if results is None else results.union(compared)
    if results is None:
        return keyed.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    results = saved(results, "compared")
    degree = results.where("rep is not null").groupBy("rep").agg(F.sum("links").alias("links"))
    parts = components(results.where("a is not null").select("a", "b"))
    grouped = (
        classes.select("key", "rep", "copies")
        .join(degree, "rep", "left")
        .join(parts.withColumnRenamed("node", "rep"), "rep", "left")
        .select("key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    )
    return keyed.select("vec_id", "key").join(saved(grouped, "classes"), "key", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "vec_id").alias("component_id"),
        F.coalesce(F.coalesce("component", "vec_id") == F.col("vec_id"), F.lit(True)).alias("kept"),
    )


def _tile_pairs(tiled: DataFrame, summary: DataFrame, pivots: np.ndarray, threshold: float) -> DataFrame:
    """Compare the pairs of tiles whose rings may hold a link.

    For x at angle a to pivot p and y at angle b to pivot q, with p and q at angle c: the
    angle of x and y is at least a - b - c, b - a - c and c - a - b.
    """
    spark = tiled.sparkSession
    units = pivots / np.linalg.norm(pivots, axis=1)[:, None]
    between = np.arccos(np.clip(units @ units.T, -1, 1))
    # At most PIVOTS squared numbers.
    apart = spark.createDataFrame(
        [(i, j, float(between[i, j])) for i in range(len(units)) for j in range(len(units))], "pivot long, other long, apart double"
    )
    limit = float(np.arccos(threshold)) + 1e-6
    x = summary.select(F.col("tile").alias("first"), "pivot", F.col("low").alias("low1"), F.col("high").alias("high1"))
    y = summary.select(F.col("tile").alias("second"), F.col("pivot").alias("other"), F.col("low").alias("low2"), F.col("high").alias("high2"))
    least = F.greatest(
        F.col("low1") - F.col("high2") - F.col("apart"),
        F.col("low2") - F.col("high1") - F.col("apart"),
        F.col("apart") - F.col("high1") - F.col("high2"),
    )
    pairs = saved(
        x.join(F.broadcast(apart), "pivot").join(y, "other").where("first <= second").where(least <= limit).select("first", "second"), "tile-pairs"
    )
    ends = pairs.select("first", "second", F.explode(F.array_distinct(F.array("first", "second"))).alias("tile"))
    return (
        tiled.select("tile", "rep", "copies", "v")
        .join(ends, "tile")
        .groupBy("first", "second")
        .applyInArrow(_compare(threshold), "rep long, links long, a long, b long")
    )
