"""Exact nearest-neighbour search over a chunk table.

Every stored vector is compared; nothing is approximated. Vectors are compared
in Arrow batches by matrix products, which only *select* rows: each selected
row's distance is then computed again entry by entry. A batch hands back no
more than ``k`` rows per query, so the comparison of every pair never exists as
rows.

* One query: a distance column, then ``orderBy().limit()``.
* A batch of queries: their vectors are written once as Parquet to the shared
  folder, and each task reads them block by block while it holds a tile of its
  share of the table. The table is never shuffled, whatever the number of
  queries, and no vector passes through the driver.
* What a hit shows besides is read last: columns of varying length (texts, paths)
  of a table that is a Parquet scan stay out of the ranking. Rows are ranked with
  their place (file and position in it), and the few that are left are joined with
  the other columns by it. Rows of a table that is computed carry their columns
  along, as computing them again would cost more.
"""

import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import dataset
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from shelfmark.functions.vectors import METRICS, similarity
from shelfmark.operators.filters import matching
from shelfmark.schema import SEARCH_LIMIT, positive
from shelfmark.sources import storage
from shelfmark.sources.files import open_location

# Queries a task reads at a time, and bytes of them it keeps for its next tile.
QUERY_BLOCK_ROWS = 4096
KEPT_QUERY_BYTES = 64 * 1024 * 1024
# Bytes of vectors and rows of the table that pass over the queries together.
TILE_BYTES = 128 * 1024 * 1024
TILE_ROWS = 131_072
# Queries whose hits a task collects for a tile; more of them are asked in several passes over the table.
PASS_QUERIES = 1_000_000
# Hits that are sent to the tasks that read the other columns; more of them are joined by a shuffle.
SENT_HITS = 100_000
# Files that are named to the scan of the other columns; where hits lie in more, all are read.
NAMED_FILES = 1_000

_QUERIES_PER_FILE = 100_000
_ROWS_PER_PRODUCT = 4096
_QUERIES_PER_PRODUCT = 512
# Rows whose products with a part of the queries stay in a core's cache; a multiple of eight.
_ROWS_IN_CACHE = 512
# Selected pairs whose distances are computed together, and more only by those of one product.
_PAIRS_HELD = 1 << 18
_FEW = 4
_PLACE = ("_file", "_position")
_MERGE_SALTS = 16


def _check(metric: str, filter_mode: str) -> None:
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}, expected one of {METRICS}")
    if filter_mode not in ("pre", "post"):
        raise ValueError(f"filter_mode must be pre or post, got {filter_mode!r}")


def _matrix(vectors: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the right length as a matrix, and their positions."""
    lengths = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False)
    usable = np.flatnonzero(lengths == dim)
    if len(usable) < len(vectors):
        vectors = vectors.take(pa.array(usable))
    flat = vectors.flatten()
    if flat.null_count:  # a null entry has no distance
        gaps = flat.is_null().to_numpy(zero_copy_only=False).reshape(-1, dim).any(axis=1)
        usable = usable[~gaps]
        flat = vectors.filter(pa.array(~gaps)).flatten()
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return values, usable


def _pair_distance(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Distance of corresponding rows, at the precision of the stored vectors."""
    with np.errstate(all="ignore"):
        if metric == "l2":
            return ((a - b) ** 2).sum(axis=1).astype(np.float32).astype(np.float64)
        inner = (a * b).sum(axis=1)
        if metric == "cosine":
            sizes = np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1))
            inner = np.where(sizes == 0, 0.0, inner / np.where(sizes == 0, 1.0, sizes))
        return 1.0 - inner.astype(np.float32).astype(np.float64)


def _augmented(
    x: np.ndarray, q: np.ndarray, metric: str
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``b, a`` whose product ``a @ b.T`` (queries by rows) holds what no distance of a pair is below, and per query by
    how much the distance of any row may be above it; then which rows and which queries that judges.

    What is added to the inner product is columns of both sides, less all that rounding may do to a pair. Single
    precision serves where squares stay far from its ends.
    """
    with np.errstate(over="ignore"):
        x_size, q_size = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", q, q)
    # A sum of finite squares is finite if all entries are.
    x_finite, q_finite = np.isfinite(x_size), np.isfinite(q_size)
    if not (x_finite.all() and q_finite.all()):
        x, q = np.where(x_finite[:, None], x, 0.0), np.where(q_finite[:, None], q, 0.0)
        x_size, q_size = np.where(x_finite, x_size, 0.0), np.where(q_finite, q_size, 0.0)
    largest = x_size.max(initial=0.0), q_size.max(initial=0.0)
    kind = np.float32 if metric == "cosine" or all(1e-12 < size < 1e24 for size in largest) else np.float64
    slack = 2 * (x.shape[1] + 8) * float(np.finfo(kind).eps) + 2e-7
    b, a = np.empty((len(x), x.shape[1] + 2), kind), np.empty((len(q), q.shape[1] + 2), kind)
    if metric == "l2":
        b[:, :-2], b[:, -2], b[:, -1] = x, x_size * (1 - slack), 1.0
        a[:, :-2], a[:, -2], a[:, -1] = -2.0 * q, 1.0, q_size * (1 - slack)
        above = 2 * slack * (largest[0] + q_size)
    elif metric == "cosine":
        x_norm, q_norm = (np.sqrt(np.where(size == 0, 1.0, size))[:, None] for size in (x_size, q_size))
        b[:, :-2], b[:, -2], b[:, -1] = x / x_norm, 1.0 - slack, 0.0
        a[:, :-2], a[:, -2], a[:, -1] = -q / q_norm, 1.0, 0.0
        above = np.full(len(q), 2 * slack)
    else:
        b[:, :-2], b[:, -2], b[:, -1] = x, np.sqrt(x_size), 1.0 - slack
        a[:, :-2], a[:, -2], a[:, -1] = -q, -slack * np.sqrt(q_size), 1.0
        above = 2 * slack * (np.sqrt(largest[0] * q_size) + 1)
    return b, a, above, x_finite, q_finite


def _widened(limit: np.ndarray, kind: type) -> np.ndarray:
    """Limits with slack for the rounding of reported distances and of very small numbers, as a column."""
    ends = (1 - 1e-6) * float(np.finfo(np.float32).max)  # beyond, distances are reported as infinite, and equal
    limit = np.where(limit > ends, np.inf, np.maximum(limit, -ends))
    limit = limit + 1e-6 * np.where(np.isfinite(limit), np.abs(limit), 0.0) + 1e-35
    return limit.astype(kind)[:, None]


def _below(b: np.ndarray, a: np.ndarray, limit: np.ndarray, most: int) -> np.ndarray | None:
    """Places (query times rows, plus row) where ``a @ b.T`` is not above the query's limit; None if they are more than ``most``."""
    n, found, count = len(b), [], 0
    limit = _widened(limit, a.dtype.type)
    room = np.empty((len(a), _ROWS_IN_CACHE), a.dtype)
    kept = np.zeros((len(a), _ROWS_IN_CACHE), bool)
    for begin in range(0, n, _ROWS_IN_CACHE):
        part = b[begin : begin + _ROWS_IN_CACHE]
        if len(part) < _ROWS_IN_CACHE:
            room, kept[:, len(part) :] = np.empty((len(a), len(part)), a.dtype), False
        np.less_equal(np.matmul(a, part.T, out=room), limit, out=kept[:, : len(part)])
        # Few are kept: they are looked for eight at a time.
        eights = np.flatnonzero(kept.view(np.uint64))
        if len(eights):
            which, place = np.nonzero(kept.reshape(-1, 8)[eights])
            at = eights[which] * 8 + place
            count += len(at)
            if count > most:
                return None
            col, row = np.divmod(at, _ROWS_IN_CACHE)
            found.append(col * n + row + begin)
    return np.concatenate(found) if found else np.empty(0, np.int64)


def _first(col: np.ndarray, distance: np.ndarray, ties: Sequence[pa.Array], k: int) -> np.ndarray:
    """Of hits (query, distance and what orders equal distances), the best ``k`` of each query, in order."""
    columns = {"col": pa.array(col), "distance": pa.array(distance)}
    for i, tie in enumerate(ties):
        if tie.null_count:  # nulls come first, as they do in Spark
            columns[f"valid{i}"] = tie.is_valid()
        columns[f"tie{i}"] = tie
    # NaN sorts after every number, as it does in Spark.
    order = pc.sort_indices(pa.table(columns), sort_keys=[(name, "ascending") for name in columns]).to_numpy()
    col = col[order]
    return order[np.arange(len(col)) - np.searchsorted(col, col) < k]


def _best_pairs(
    x: np.ndarray,
    q: np.ndarray,
    ties: Sequence[pa.Array],
    k: int,
    metric: str,
    bound: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per query the ``k`` nearest rows of one block: row, query, distance.

    ``ties`` are the columns that order equal distances. ``bound`` holds, per
    query, a distance already reached by ``k`` rows elsewhere; rows beyond it are
    left out, and it is lowered to what this block reaches.
    """
    found, held, rows, cols = [], 0, [], []
    b, a, above, judged, q_judged = _augmented(x, q, metric)
    unjudged = np.flatnonzero(~judged)
    known = b if judged.all() else b[judged]

    def finish() -> None:
        nonlocal held
        row, col = np.concatenate(rows), np.concatenate(cols)
        distance = np.concatenate(
            [_pair_distance(x[row[i : i + 65536]], q[col[i : i + 65536]], metric) for i in range(0, len(row), 65536)]
            or [np.empty(0)]
        )
        best = _first(col, distance, [t.take(pa.array(row)) for t in ties], k)
        found.append((row[best], col[best], distance[best]))
        rows.clear(), cols.clear()
        held = 0

    for begin in range(0, len(q), _QUERIES_PER_PRODUCT):
        part = slice(begin, min(begin + _QUERIES_PER_PRODUCT, len(q)))
        n, some = part.stop - begin, _FEW * k * (part.stop - begin)
        limit = np.full(n, np.inf) if bound is None else bound[part].copy()
        limit[~q_judged[part]] = np.inf
        at = None if len(known) >= k and np.isinf(limit).any() else _below(known, a[part], limit, some)
        if at is None:
            # Where few are nearer than what was reached elsewhere, the block's own order need not be known.
            if len(known) >= k:
                reached = np.partition(a[part] @ known.T, k - 1, axis=1)[:, k - 1] + above[part]
                limit = np.minimum(limit, reached)
                limit[~q_judged[part]] = np.inf
            at = _below(known, a[part], limit, n * len(known))
        col, row = np.divmod(at, max(len(known), 1))
        if len(unjudged):  # rows that the product cannot judge are kept
            row = np.concatenate([np.flatnonzero(judged)[row], np.tile(unjudged, n)])
            col = np.concatenate([col, np.repeat(np.arange(n), len(unjudged))])
        rows.append(row)
        cols.append(col + begin)
        held += len(row)
        if held >= _PAIRS_HELD:
            finish()
    finish()
    row, col, distance = (np.concatenate(parts) for parts in zip(*found, strict=True))
    if bound is not None and len(col):
        _lowered(bound, np.full((len(q), k), np.inf), col, distance)
    return row, col, distance


def _lowered(bound: np.ndarray, reached: np.ndarray, col: np.ndarray, distance: np.ndarray) -> None:
    """Put hits (at most ``k`` a query, query by query in order) to the ``k`` distances that each query has reached, and lower the bound to the last."""
    mine, place = np.unique(col, return_inverse=True)
    new = np.full((len(mine), reached.shape[1]), np.inf)
    new[place, np.arange(len(col)) - np.searchsorted(col, col)] = np.where(np.isnan(distance), np.inf, distance)
    reached[mine] = np.sort(np.hstack([reached[mine], new]), axis=1)[:, : reached.shape[1]]
    bound[mine] = np.minimum(bound[mine], reached[mine, -1])


def top_per_query(candidates: DataFrame, k: int, order: list[Column]) -> DataFrame:
    """Best ``k`` rows per query. Ranking runs within a salt first, so that one query's
    candidates from very many tasks do not meet in a single one."""
    salted = candidates.withColumn("_salt", F.spark_partition_id() % _MERGE_SALTS)
    within = Window.partitionBy("query_id", "_salt").orderBy(*order)
    overall = Window.partitionBy("query_id").orderBy(*order)
    return (
        salted.withColumn("rank", F.row_number().over(within))
        .where(F.col("rank") <= k)
        .withColumn("rank", F.row_number().over(overall))
        .where(F.col("rank") <= k)
        .drop("_salt")
    )


def nearest(
    table: DataFrame,
    query_vector: Sequence[float],
    k: int | None = None,
    where: Column | str | None = None,
    filter_mode: str = "pre",
    metric: str = "l2",
    vector_col: str = "vector",
    ties: Sequence[str] = ("id", "chunk_index"),
    dim: int | None = None,
) -> DataFrame:
    """The ``k`` rows nearest to one vector, nearest first, with ``distance`` and ``similarity``.

    ``pre`` ranks the rows that satisfy ``where``; ``post`` applies it to the
    ``k`` best of all rows, which may leave fewer. Rows whose vector is null or of
    another length have no distance and are left out. ``dim``, where it is known, is
    the length the question must have.
    """
    _check(metric, filter_mode)
    k = positive("k", k, SEARCH_LIMIT)
    query = np.asarray(query_vector, dtype=np.float64)
    if dim is not None and len(query) != dim:
        raise ValueError(f"the query vector has {len(query)} entries, those of the table {dim}")

    @F.arrow_udf(T.DoubleType())
    def distance_to_query(vectors: pa.Array) -> pa.Array:
        x, usable = _matrix(vectors, len(query))
        found = np.full(len(vectors), np.nan)
        found[usable] = _pair_distance(x, query[None, :], metric)
        missing = np.ones(len(vectors), dtype=bool)
        missing[usable] = False
        return pa.array(found, mask=missing)

    place, late = _late_columns(table, vector_col, ties)
    rows = matching(table.withColumns(place), where) if filter_mode == "pre" else table.withColumns(place)
    kept = [c for c in rows.columns if c != vector_col and c not in late]
    ranked = (
        rows.select(*kept, distance_to_query(vector_col).alias("distance"))
        .orderBy(F.col("distance").asc_nulls_last(), *ties)
        .limit(k)
        # above the limit, where it cannot make Spark compute the distance twice
        .where(F.col("distance").isNotNull())
        .withColumn("similarity", similarity(F.col("distance")))
    )
    if late:
        ranked = _with_late_columns(ranked, table, place, late, vector_col, k)
        ranked = ranked.orderBy(F.col("distance"), *ties)
    return matching(ranked, where) if filter_mode == "post" else ranked


def _is_scan(table: DataFrame) -> bool:
    """Whether a table's rows are rows of files: what is between may only choose columns and leave rows out."""
    node = table._jdf.queryExecution().analyzed()
    while node.nodeName() in ("Project", "Filter", "SubqueryAlias", "Join"):
        if node.nodeName() == "Join" and node.joinType().toString() not in ("LeftAnti", "LeftSemi"):
            return False
        node = node.children().apply(0)
    return node.nodeName() in ("LogicalRelation", "Relation")


def _late_columns(table: DataFrame, vector_col: str, ties: Sequence[str]) -> tuple[dict[str, Column], list[str]]:
    """Where a row lies, and the columns to read after the ranking; both empty unless the table is a Parquet scan."""
    varying = (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType, T.VariantType)
    late = [f.name for f in table.schema.fields if f.name not in (vector_col, *ties) and isinstance(f.dataType, varying)]
    place = {"_file": F.col("_metadata.file_path"), "_position": F.col("_metadata.row_index")}
    if not late or "_metadata" in table.columns or set(_PLACE) & set(table.columns) or not _is_scan(table):
        return {}, []
    try:
        table.select(*place.values()).schema  # of other formats than Parquet, rows have no number  # noqa: B018
    except AnalysisException:
        return {}, []
    return place, late


def _with_late_columns(
    hits: DataFrame, table: DataFrame, place: dict[str, Column], late: list[str], vector_col: str, most: int
) -> DataFrame:
    """The hits (at most ``most``) with the columns left out so far, in the table's order, the hits' own last."""
    others = table.select(*late, *(c.alias(name) for name, c in place.items()))
    joined = others.join(F.broadcast(hits) if most <= SENT_HITS else hits, list(_PLACE))
    own = [c for c in table.columns if c != vector_col]
    return joined.select(*own, *(c for c in hits.columns if c not in (*own, *_PLACE)))


def _saved(queries: DataFrame, query_vector_col: str) -> str:
    """Write the query vectors once to the shared folder, where every task can read them."""
    spark = queries.sparkSession
    folder = storage.qualified(spark, f"{storage.shared_folder(spark)}/queries-{uuid.uuid4().hex}")
    asked = queries.select("query_id", F.col(query_vector_col).cast("array<double>").alias("vector"))
    asked.write.option("maxRecordsPerFile", _QUERIES_PER_FILE).parquet(folder)
    storage.delete_at_exit(spark, folder)
    return folder


def _passes(spark, folder: str, most: int) -> tuple[list[list[str]], int]:
    """The saved files in groups of at most so many queries (or of one file), and the number of all queries."""
    counts = spark.read.parquet(folder).groupBy(F.col("_metadata.file_path").alias("file")).count()
    groups, held, total = [[]], 0, 0
    for row in counts.orderBy("file").collect():  # one row per 100,000 queries
        if groups[-1] and held + row["count"] > most:
            groups.append([])
            held = 0
        groups[-1].append(row["file"])
        held += row["count"]
        total += row["count"]
    return groups, total


def _read_blocks(files: list[str], rows: int) -> Iterator[pa.Table]:
    """The saved queries in blocks of so many rows, in the same order each time."""
    for file in files:
        file_system, path = open_location(file)
        saved = dataset.dataset(path, filesystem=file_system, format="parquet")
        for batch in saved.to_batches(batch_size=rows, batch_readahead=1, fragment_readahead=1):
            if batch.num_rows:
                yield pa.Table.from_batches([batch])


def _tiles(batches: Iterator[tuple[pa.Array, ...]], most_bytes: int, most_rows: int) -> Iterator[list[tuple[pa.Array, ...]]]:
    """Batches of the table in groups that fit the limits, or of one batch."""
    tile, size, rows = [], 0, 0
    for batch in batches:
        if tile and (size + batch[0].nbytes > most_bytes or rows + len(batch[0]) > most_rows):
            yield tile
            tile, size, rows = [], 0, 0
        tile.append(batch)
        size += batch[0].nbytes
        rows += len(batch[0])
    if tile:
        yield tile


class _Questions:
    """The queries of a pass, read from their files once, or once per tile for those beyond ``kept_bytes``.

    The distances that rows of the table have reached are kept with the queries in
    memory only, so what a task holds does not grow with the number of queries.
    """

    def __init__(self, read: Callable[[], Iterator[pa.Table]], kept_bytes: int):
        self.read, self.kept_bytes = read, kept_bytes
        self.kept: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        self.complete, self.seen = False, False
        self.reads = 0

    def blocks(self) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
        """Ids, vectors and the distance reached so far, block by block."""
        yield from self.kept
        if self.complete:
            return
        self.reads += 1
        skip, size, number, full = len(self.kept), sum(b[0].nbytes + b[1].nbytes for b in self.kept), 0, self.seen
        for table in self.read():
            for ids, q in _query_blocks(table):
                number += 1
                if number <= skip:
                    continue
                block = (ids, q, np.full(len(q), np.inf))
                size += ids.nbytes + q.nbytes
                full = full or size > self.kept_bytes
                if not full:
                    self.kept.append(block)
                yield block
        self.complete, self.seen = not full, True


def _tile_hits(
    vectors: pa.Array, keys: Sequence[pa.Array], questions: _Questions, k: int, metric: str
) -> tuple[np.ndarray, pa.Array | None, np.ndarray]:
    """Rows of a tile, the query each was found by, and the distance."""
    found = []
    for ids, q, bound in questions.blocks():
        parts, reached = [], np.full((len(q), k), np.inf)
        for begin in range(0, len(vectors), _ROWS_PER_PRODUCT):
            x, usable = _matrix(vectors.slice(begin, _ROWS_PER_PRODUCT), q.shape[1])
            if len(usable):
                near = [key.take(pa.array(usable + begin)) for key in keys]
                row, col, distance = _best_pairs(x, q, near, k, metric, bound)
                _lowered(bound, reached, col, distance)
                parts.append((usable[row] + begin, col, distance))
        if parts:
            row, col, distance = (np.concatenate(p) for p in zip(*parts, strict=True))
            left = np.flatnonzero(~(distance > bound[col]))  # a later part of the tile came nearer
            row, col, distance = row[left], col[left], distance[left]
            best = _first(col, distance, [key.take(pa.array(row)) for key in keys], k)
            found.append((row[best], ids.take(pa.array(col[best])), distance[best]))
    if not found:
        return np.empty(0, np.int64), None, np.empty(0)
    return np.concatenate([f[0] for f in found]), pa.concat_arrays([f[1] for f in found]), np.concatenate([f[2] for f in found])


def _query_blocks(queries: pa.Table) -> list[tuple[pa.Array, np.ndarray]]:
    """Ids and matrix per vector length; queries without a vector find nothing."""
    vectors = queries["vector"].combine_chunks()
    ids = queries["query_id"].combine_chunks()
    if isinstance(vectors, pa.ChunkedArray):
        vectors, ids = pa.concat_arrays(vectors.chunks), pa.concat_arrays(ids.chunks)
    lengths = pc.list_value_length(vectors)
    blocks = []
    for dim in sorted(set(lengths.drop_null().to_pylist()) - {0}):
        q, usable = _matrix(vectors, dim)
        if len(usable):
            blocks.append((ids.take(pa.array(usable)), q))
    return blocks


def _candidates(
    rows: DataFrame,
    files: list[str],
    id_type: T.DataType,
    k: int,
    metric: str,
    ties: Sequence[str],
    block_rows: int,
    kept_bytes: int,
    tile_bytes: int,
) -> DataFrame:
    """Candidates by one pass over the table, in place: only vectors and tie columns go to Python.

    Tiles of the table meet the saved queries block by block.
    """
    hits_type = T.ArrayType(
        T.StructType([T.StructField("query_id", id_type), T.StructField("distance", T.DoubleType())])
    )

    @F.arrow_udf(hits_type)
    def hits_of_row(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        questions = _Questions(lambda: _read_blocks(files, block_rows), kept_bytes)
        for tile in _tiles(batches, tile_bytes, TILE_ROWS):
            vectors, *keys = (pa.concat_arrays(parts) for parts in zip(*tile, strict=True))
            row, ids, distance = _tile_hits(vectors, keys, questions, k, metric)
            if ids is None:
                made = pa.nulls(len(vectors), hits_arrow)
            else:
                order = np.argsort(row, kind="stable")
                pairs = pa.StructArray.from_arrays(
                    [ids.take(pa.array(order)), pa.array(distance[order])], ["query_id", "distance"]
                )
                counts = np.bincount(row, minlength=len(vectors))
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                made = pa.ListArray.from_arrays(offsets, pairs)
            begin = 0
            for batch in tile:
                yield made.slice(begin, len(batch[0]))
                begin += len(batch[0])

    hits_arrow = to_arrow_type(hits_type)
    # The outer explode keeps the optimizer from copying the function into a
    # filter below it.
    return (
        rows.withColumn("_hits", hits_of_row(F.col("_vector"), *(F.col(t) for t in ties)))
        .drop("_vector")
        .withColumn("_hit", F.explode_outer("_hits"))
        .drop("_hits")
        .where(F.col("_hit").isNotNull())
        .withColumns({"query_id": F.col("_hit.query_id"), "distance": F.col("_hit.distance")})
        .drop("_hit")
    )


def nearest_batch(
    table: DataFrame,
    queries: DataFrame,
    k: int | None = None,
    where: Column | str | None = None,
    filter_mode: str = "pre",
    metric: str = "l2",
    vector_col: str = "vector",
    query_vector_col: str = "query_vector",
    ties: Sequence[str] = ("id", "chunk_index"),
    query_block_rows: int = QUERY_BLOCK_ROWS,
    kept_query_bytes: int = KEPT_QUERY_BYTES,
    tile_bytes: int = TILE_BYTES,
    pass_queries: int = PASS_QUERIES,
    dim: int | None = None,
) -> DataFrame:
    """The ``k`` nearest rows for each row of ``queries`` (``query_id`` and a vector).

    Gives the columns of ``table`` but the vector, and ``query_id``, ``distance``,
    ``similarity`` and ``rank`` (from 1). ``query_id`` must be unique. The query
    vectors are computed and written to the shared folder when this is called, and
    removed when the session ends. A task holds a tile of the table, a block of queries
    (and ``kept_query_bytes`` of them for the next tile), and about ``k`` hits for each of at most
    ``pass_queries`` queries; more queries are asked in several passes.
    """
    _check(metric, filter_mode)
    k = positive("k", k, SEARCH_LIMIT)
    if dim is not None:  # a question of another length fails the job instead of finding nothing
        vector = F.col(query_vector_col)
        wrong = F.raise_error(F.lit(f"a query vector has not the {dim} entries of the table's"))
        fits = vector.isNull() | (F.size(vector) == dim)
        queries = queries.withColumn(
            query_vector_col, F.when(fits, vector).otherwise(wrong.cast(queries.schema[query_vector_col].dataType))
        )
    place, late = _late_columns(table, vector_col, ties)
    rows = matching(table.withColumns(place), where) if filter_mode == "pre" else table.withColumns(place)
    kept = [c for c in rows.columns if c != vector_col and c not in late]
    rows = rows.select(*kept, F.col(vector_col).alias("_vector"))
    passes, asked = _passes(table.sparkSession, _saved(queries, query_vector_col), pass_queries)
    id_type = queries.schema["query_id"].dataType
    candidates = None
    for files in passes:
        found = _candidates(rows, files, id_type, k, metric, ties, query_block_rows, kept_query_bytes, tile_bytes)
        candidates = found if candidates is None else candidates.unionAll(found)
    order = [F.col("distance"), *(F.col(t) for t in ties)]
    ranked = top_per_query(candidates, k, order).withColumn(
        "similarity", similarity(F.col("distance"))
    )
    if late:
        if k * asked > SENT_HITS:
            ranked, table = _written_hits(ranked, table)
        ranked = _with_late_columns(ranked, table, place, late, vector_col, k * asked)
    return matching(ranked, where) if filter_mode == "post" else ranked


def _written_hits(hits: DataFrame, table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Many hits, written down; and the table without files that hold none, if those that do are few enough to be named.

    Without this, a join by shuffle would begin to move the table's texts before it is known which are asked for.
    """
    spark = hits.sparkSession
    folder = f"{storage.shared_folder(spark)}/hits-{uuid.uuid4().hex}"
    hits.write.parquet(folder)
    storage.delete_at_exit(spark, folder)
    written = spark.read.schema(hits.schema).parquet(folder)
    files = [row["_file"] for row in written.select("_file").distinct().limit(NAMED_FILES + 1).collect()]
    return written, table.where(F.col("_metadata.file_path").isin(files)) if len(files) <= NAMED_FILES else table
