"""How a search reads: what travels with the ranking, and how often questions are read."""

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from shelfmark.operators.search import _Questions, _passes, _saved, _tile_hits, _tiles, nearest, nearest_batch


def stored(spark, tmp_path, n=300):
    rng = np.random.default_rng(2)
    rows = [(f"i{i % 50}", i, i % 3, f"text {i}", [f"tag{i}"], rng.normal(size=5).astype("float32").tolist()) for i in range(n)]
    rows += [("copy", 7, 1, f"copy {i}", [], [0.0] * 5) for i in range(60)]  # equal keys, other texts
    frame = spark.createDataFrame(rows, "id string, chunk_index int, label int, content string, tags array<string>, vector array<float>")
    folder = str(tmp_path / uuid.uuid4().hex)
    frame.repartition(4).write.parquet(folder)
    return spark.read.parquet(folder)


def asked(spark, n=40):
    rng = np.random.default_rng(3)
    return spark.createDataFrame([(i, rng.normal(size=5).tolist()) for i in range(n)], "query_id long, query_vector array<double>")


def rows_of(frame):
    return sorted((tuple(map(str, r)) for r in frame.collect()))


def test_texts_are_read_for_hits_only(spark, tmp_path):
    table = stored(spark, tmp_path)
    found = nearest_batch(table, asked(spark), 4)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    merge = plan[plan.index("Window") :] if "Window" in plan else plan[plan.index("Rank") :]
    scans = [line for line in plan.splitlines() if "Relation" in line]
    assert len(scans) == 2 and "content" not in merge.split("Relation")[0]
    assert "content#" not in "".join(line for line in plan.splitlines() if "Window" in line or "_hits" in line)
    carried = nearest_batch(table.limit(10_000), asked(spark), 4)  # no scan: columns are carried along
    assert found.columns == carried.columns
    # Of equal keys and distances, any row may be shown, so the copies are left out.
    plain = lambda df: rows_of(df.where("id != 'copy'"))
    assert plain(found) == plain(carried) and found.count() == carried.count() == 160


def test_rows_below_a_generator_keep_their_columns(spark, tmp_path):
    """Rows made of one file row share its place, so they must not be told apart by it."""
    table = stored(spark, tmp_path).withColumn("part", F.explode(F.array(F.lit("a"), F.lit("b"), F.lit("c"))))
    assert nearest_batch(table, asked(spark, 5), 6).count() == 30
    assert nearest(table, [0.1] * 5, 6).count() == 6


def test_one_question_and_its_filters(spark, tmp_path):
    table = stored(spark, tmp_path).where("id != 'copy'")
    for options in ({}, {"where": "content like '%1%'"}, {"where": "label = 1", "filter_mode": "post"}):
        late = nearest(table, [0.2] * 5, 9, **options)
        carried = nearest(table.limit(10_000), [0.2] * 5, 9, **options)
        assert [tuple(r) for r in late.collect()] == [tuple(r) for r in carried.collect()]
        assert late.columns == carried.columns


def test_many_hits_are_written_and_only_their_files_are_named(spark, tmp_path, monkeypatch):
    from shelfmark.operators import search

    table = stored(spark, tmp_path).where("id != 'copy'")
    want = rows_of(nearest_batch(table, asked(spark), 3))
    monkeypatch.setattr(search, "SENT_HITS", 10)
    assert rows_of(nearest_batch(table, asked(spark), 3)) == want
    monkeypatch.setattr(search, "NAMED_FILES", 1)
    assert rows_of(nearest_batch(table, asked(spark), 3)) == want


def test_questions_beyond_what_is_kept_are_read_once_per_tile():
    rng = np.random.default_rng(4)
    blocks = [pa.table({"query_id": pa.array(range(i, i + 10)), "vector": rng.normal(size=(10, 4)).tolist()}) for i in range(0, 100, 10)]
    batches = [(pa.array(rng.normal(size=(50, 4)).tolist()), pa.array(range(b * 50, b * 50 + 50))) for b in range(12)]

    def run(kept_bytes, tile_bytes):
        questions, hits, tiles = _Questions(lambda: iter(blocks), kept_bytes), [], 0
        for tile in _tiles(iter(batches), tile_bytes, 10**6):
            vectors, keys = (pa.concat_arrays(part) for part in zip(*tile, strict=True))
            row, ids, distance = _tile_hits(vectors, [keys], questions, 3, "l2")
            hits += zip(ids.to_pylist(), distance.tolist(), keys.take(pa.array(row)).to_pylist(), strict=True)
            tiles += 1
        best = {q: sorted(h for h in hits if h[0] == q)[:3] for q in range(100)}
        return best, questions.reads, tiles, sum(len(b[2]) for b in questions.kept)

    all_kept, reads, tiles, bounds = run(10**6, 1)
    assert (reads, tiles, bounds) == (1, 12, 100)
    for kept in (0, 900):
        best, reads, tiles, bounds = run(kept, 1)
        assert best == all_kept and (reads, tiles) == (12, 12) and bounds < 30
        best, reads, tiles, bounds = run(kept, 4 * batches[0][0].nbytes)
        assert best == all_kept and (reads, tiles) == (3, 3)


def test_passes_hold_each_question_once(spark, monkeypatch):
    from shelfmark.operators import search

    monkeypatch.setattr(search, "_QUERIES_PER_FILE", 7)
    folder = _saved(asked(spark, 40).coalesce(1), "query_vector")
    passes, total = _passes(spark, folder, 15)
    assert total == 40 and len(passes) == 3 and len({f for p in passes for f in p}) == 6
