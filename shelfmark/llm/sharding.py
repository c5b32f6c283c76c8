"""Shards of near equal size with few cut links: balanced label propagation."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import saved, small

SHARDS = 8
ROUNDS = 4
#: Share of the mean by which a shard may exceed it while labels move; the last step evens it out.
SLACK = 0.02
#: Cells per pair of shards in which the driver counts bytes that want to move.
CELLS = 2048
#: A linked group of over 1/LARGE of the mean shard's bytes is placed by the driver, in ranges of PLACES hashes.
LARGE = 64
PLACES = 1 << 30
#: Rows of a shard that get their slots in one task, on average.
SLOT_ROWS = 50_000


def _grants(wanted: list[tuple[int, int, int, int]], load: list[int], room: int) -> dict[tuple[int, int], list[int]]:
    """For each move from i to j, the cells that may go: swaps first, then what the target still takes; a cell that does not fit is skipped."""
    cells: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for i, j, cell, size in wanted:
        cells.setdefault((i, j), []).append((cell, size))
    total = {k: sum(s for _, s in v) for k, v in cells.items()}
    quota = {(i, j): min(w, total.get((j, i), 0)) for (i, j), w in total.items()}
    load = list(load)
    for k in sorted(total, key=lambda k: (load[k[1]] - load[k[0]], k)):
        more = min(total[k] - quota[k], max(0, room - load[k[1]]))
        quota[k] += more
        load[k[1]] += more
        load[k[0]] -= more
    granted = {}
    for k, listed in cells.items():
        used = 0
        for cell, size in sorted(listed):
            if used + size <= quota[k]:
                used += size
                granted.setdefault(k, []).append(cell)
    return granted


def _bits(cells: list[int]) -> list[int]:
    """The set of cells as signed 64-bit words."""
    bits = sum(1 << cell for cell in set(cells))
    return [int.from_bytes((bits >> at & 0xFFFFFFFFFFFFFFFF).to_bytes(8, "little"), "little", signed=True) for at in range(0, CELLS, 64)]


def _bounds(parts: list[int]) -> list[int]:
    """Where each shard's range of [0, PLACES) ends, the ranges in proportion to the parts."""
    total, ends, run = max(1, sum(parts)), [], 0
    for part in parts[:-1]:
        run += part
        ends.append(PLACES * run // total)
    return ends


def _fill(groups: list[tuple[int, int]], size: int, shards: int) -> tuple[dict[int, list[int]], list[int]]:
    """Bytes of each large group by shard, and the bytes each shard has left.

    The largest group comes first, into the emptiest shard; one that fits nowhere fills whole shards before it begins the next.
    """
    left = [size // shards + (i < size % shards) for i in range(shards)]
    parts = {}
    for group, rest in sorted(groups, key=lambda g: (-g[1], g[0])):
        parts[group] = [0] * shards
        while rest > 0:
            j = max(range(shards), key=left.__getitem__)
            taken = min(rest, left[j])
            parts[group][j] += taken
            left[j] -= taken
            rest -= taken
    return parts, left


def start(rows: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Rows (group, size, tie, ...) with a first shard: linked groups of over 1/LARGE of a shard gathered, all others by their hash.

    A large group lies in one shard, or fills whole shards and part of another; the others
    are dealt in proportion to the bytes that this leaves. The driver sees at most shards times LARGE groups.
    """
    sizes = saved(rows.groupBy("group").agg(F.sum("size").alias("w"), F.count(F.lit(1)).alias("n")), "sizes")
    total = int(sizes.agg(F.sum("w").alias("w")).collect()[0]["w"] or 0)
    large = sizes.where((F.col("n") > 1) & (F.col("w") * (shards * LARGE) > total)).select("group", "w").collect()
    parts, left = _fill([(r["group"], r["w"]) for r in large], total, shards)
    table = [(group, _bounds(by)) for group, by in parts.items()]
    rows = rows.join(F.broadcast(rows.sparkSession.createDataFrame(table, "group long, bounds array<int>")), "group", "left")
    bounds = F.coalesce("bounds", F.array(*(F.lit(b) for b in _bounds(left if sum(left) else [1] * shards))))
    place = F.pmod(F.xxhash64("tie", F.lit(1)), F.lit(PLACES))
    return rows.withColumn("large", F.col("bounds").isNotNull()).withColumn("shard", F.size(F.filter(bounds, lambda b: b <= place))).drop("bounds")


def _loads(rows: DataFrame, shards: int) -> list[int]:
    found = {r["shard"]: r["w"] for r in rows.groupBy("shard").agg(F.sum("size").alias("w")).collect()}
    return [int(found.get(i, 0) or 0) for i in range(shards)]


def propagate(rows: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, slack: float = SLACK) -> DataFrame:
    """Rows (group, size, tie, large, shard, ...) with new shards: every round, members move to where most of their group is.

    All members of a group are linked, so a member's neighbours by shard are the group's
    bytes by shard, aggregated before the join. The driver sees bytes per (from, to, cell), at
    most shards squared times CELLS numbers, and grants moves under the capacity: swaps, then
    whatever the target has room for. Rows without neighbours count as room: level() moves them on
    at no cost. Large groups stay where start() gathered them. Cells follow the group's hash, dealt anew
    each round, so groups move whole, and parts of one only where it is larger than the room.
    """
    whole = sum(_loads(rows, shards))
    for turn in range(rounds):
        weight = rows.groupBy("group", "shard").agg(F.sum("size").alias("w"), F.count(F.lit(1)).alias("n"), F.max("large").alias("large"))
        heaviest = F.max_by("shard", F.struct("w", F.xxhash64("group", "shard")))
        best = saved(
            weight.groupBy("group")
            .agg(heaviest.alias("wish"), F.count(F.lit(1)).alias("places"), F.sum("n").alias("members"), F.max("large").alias("gathered"))
            .where("members > 1")
            .select("group", F.when((F.col("places") > 1) & ~F.col("gathered"), F.col("wish")).alias("wish"), F.lit(True).alias("linked")),
            "wishes",
        )
        cell = F.pmod(F.xxhash64("group", F.lit(7 + turn)), F.lit(CELLS // 16)) * 16 + F.pmod(F.xxhash64("tie", F.lit(turn)), F.lit(16))
        asked = saved(rows.join(best, "group", "left").withColumn("cell", cell.cast("int")), "asked")
        wanted = [
            (r["shard"], r["wish"], r["cell"], r["w"])
            for r in asked.where("wish != shard").groupBy("shard", "wish", "cell").agg(F.sum("size").alias("w")).collect()
        ]
        if not wanted:
            break
        granted = _grants(wanted, _loads(asked.where("linked"), shards), int(whole / shards * (1 + slack)) + 1)
        if not granted:
            break
        table = rows.sparkSession.createDataFrame([(i, j, _bits(cells)) for (i, j), cells in granted.items()], "shard int, wish int, cells array<long>")
        goes = F.getbit(F.get("cells", F.expr("cell div 64").cast("int")), F.pmod("cell", F.lit(64)).cast("int")) == 1
        rows = (
            asked.join(F.broadcast(table), ["shard", "wish"], "left")
            .withColumn("shard", F.when(goes, F.col("wish")).otherwise(F.col("shard")))
            .drop("wish", "cell", "linked", "cells")
        )
    return rows


def _moves(sizes: list[tuple[int, int, int]], load: list[int], tolerance: float) -> list[tuple[int, int, int]]:
    """(shard, cell, to): cells that go from shards above the mean to the one furthest below, none beyond the mean.

    Cells of linked rows (from CELLS on) move only while a shard is above the mean by more than the tolerance.
    """
    mean = sum(load) / len(load)
    load, moves = list(load), []
    for shard, cell, size in sorted(sizes):
        sink = min(range(len(load)), key=load.__getitem__)
        over = load[shard] - mean
        if size <= min(over, mean - load[sink]) and (cell < CELLS or over > tolerance * mean):
            moves.append((shard, cell, sink))
            load[shard] -= size
            load[sink] += size
    return moves


def level(rows: DataFrame, shards: int = SHARDS, passes: int = 4, tolerance: float = 0.002) -> DataFrame:
    """Even the shards out by moving cells of rows, those without neighbours first; each pass deals the cells anew.

    The driver sees at most 2 * CELLS numbers a shard and broadcasts as many moves.
    """
    # Written first, so that the join's two sides are plain exchanges, which adaptive execution may split.
    linked = saved(rows.groupBy("group").agg(F.count(F.lit(1)).alias("members")).where("members > 1"), "linked")
    rows = saved(rows.join(linked, "group", "left").withColumn("members", F.coalesce("members", F.lit(1))), "levelled")
    for turn in range(passes):
        cell = F.when(F.col("members") > 1, CELLS).otherwise(0) + F.pmod(F.xxhash64("tie", F.lit(100 + turn)), F.lit(CELLS))
        rows = rows.withColumn("cell", cell.cast("int"))
        sizes = [(r["shard"], r["cell"], r["w"]) for r in rows.groupBy("shard", "cell").agg(F.sum("size").alias("w")).collect()]
        load = [sum(w for i, _, w in sizes if i == shard) for shard in range(shards)]
        moves = _moves(sizes, load, tolerance)
        if not moves:
            break
        table = F.broadcast(rows.sparkSession.createDataFrame(moves, "shard int, cell int, to int"))
        rows = saved(
            rows.join(table, ["shard", "cell"], "left").withColumn("shard", F.coalesce("to", "shard")).drop("to", "cell"), "levelled"
        )
    return rows


def slots(rows: DataFrame, slot_rows: int = SLOT_ROWS) -> DataFrame:
    """Gapless positions from 0 in each shard: ranks in parts of bounded size, after the rows of the parts before."""
    parts = max(1, -(-rows.count() // slot_rows))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("tie"), F.lit(parts)).cast("int"))
    sizes = rows.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = saved(sizes.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")), "offsets")
    rank = F.row_number().over(Window.partitionBy("shard", "part").orderBy("tie", "doc_id"))
    return (
        rows.withColumn("rank", rank)
        .join(small(offsets), ["shard", "part"])
        .withColumn("slot", (F.col("offset") + F.col("rank") - 1).cast("long"))
        .drop("part", "rank", "offset")
    )


def cut_share(rows: DataFrame) -> Column:
    """Of a frame (group, shard): the share of linked pairs in different shards, as a frame of one row."""
    by = rows.groupBy("group", "shard").agg(F.count(F.lit(1)).cast("double").alias("n"))
    pairs = by.groupBy("group").agg((F.pow(F.sum("n"), 2) - F.sum("n")).alias("all"), F.sum(F.col("n") * (F.col("n") - 1)).alias("inside"))
    return pairs.agg((1 - F.sum("inside") / F.sum("all")).alias("cut"))


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row of docs; the law is ``bytes``.

    Size is the text's UTF-8 bytes (null: none) plus 1. Documents of equal texts are linked;
    a null text counts as empty, crc32 0. Large groups start gathered, other labels at a hash of the row, so shards start even.
    Repeated rows and rows without doc_id are placed like any other. grown_shard is null.
    """
    text = F.col("text").cast("string")
    crc = F.crc32(F.coalesce(text, F.lit("")))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        crc.cast("long").alias("text_crc32"),
        F.xxhash64(F.coalesce(text, F.lit("")), F.octet_length(F.coalesce(text, F.lit("")))).alias("group"),
    ).withColumn("tie", F.xxhash64("doc_id", "group"))
    placed = level(propagate(saved(start(saved(rows, "documents"), shards), "started"), shards), shards)
    return slots(placed).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
