"""Blocks of the vector search: what is put in order, and what it finds."""

import numpy as np
import pyarrow as pa
import pytest

from shelfmark.functions.vectors import METRICS
from shelfmark.operators import search


@pytest.mark.parametrize("metric", METRICS)
def test_what_was_reached_elsewhere_spares_the_order_of_a_block(metric, monkeypatch):
    """A block is put in order only while its rows may be among the nearest; the hits are those of all rows."""
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(size=(4000, 8)).astype(np.float32).astype(float), np.zeros((3, 8)), np.full((1, 8), np.nan)])
    q, ids, bound, hits, ordered = np.vstack([x[:200], x[-2:-1]]), pa.array(range(len(x))), np.full(201, np.inf), [], []
    partition = np.partition
    monkeypatch.setattr(search.np, "partition", lambda *a, **named: ordered.append(1) or partition(*a, **named))
    for begin in range(0, len(x), 500):
        row, col, distance = search._best_pairs(x[begin : begin + 500], q, [ids.slice(begin, 500)], 5, metric, bound)
        hits += zip(col.tolist(), distance.tolist(), (row + begin).tolist(), strict=True)
    found = [sorted(h for h in hits if h[0] == c and h[1] == h[1])[:5] for c in range(200)]
    for c in range(200):
        every = search._pair_distance(x[:-1], q[c : c + 1], metric)
        best = np.lexsort((np.arange(len(every)), every))[:5]
        assert [(h[2], h[1]) for h in found[c]] == [(i, every[i]) for i in best.tolist()]
    assert len(ordered) < 8


def _nearest(x: np.ndarray, q: np.ndarray, ids: np.ndarray, k: int, metric: str) -> list[tuple[int, int, str]]:
    found = []
    for c in range(len(q)):
        d = search._pair_distance(x, q[c : c + 1], metric)
        best = np.lexsort((ids, np.nan_to_num(d, nan=0.0, posinf=np.inf, neginf=-np.inf), np.isnan(d)))[:k]
        found += [(c, int(ids[i]), str(d[i])) for i in best]
    return sorted(found)


@pytest.mark.parametrize("metric", METRICS)
def test_a_tile_hands_on_the_best_of_each_question_only(metric, monkeypatch):
    monkeypatch.setattr(search, "_ROWS_PER_PRODUCT", 500)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(4000, 8)).astype(np.float32)
    x[rng.integers(0, 4000, 800)] = x[7]  # equal distances
    x[11] = np.nan
    ids, kind = rng.permutation(4000), pa.list_(pa.float64())
    asked = pa.table({"query_id": np.arange(10), "vector": pa.array(list(x[:10].astype(float)), kind)})
    questions = search._Questions(lambda: iter([asked]), 1 << 20)
    row, query, distance = search._tile_hits(pa.array(list(x)), [pa.array(ids)], questions, 5, metric)
    hits = sorted((c, int(ids[r]), str(d)) for r, c, d in zip(row, query.to_pylist(), distance, strict=True))
    assert hits == _nearest(x.astype(float), x[:10].astype(float), ids, 5, metric)


@pytest.mark.parametrize("metric", METRICS)
@pytest.mark.parametrize("size", [1e-30, 1e-12, 1.0, 1e9, 1e19, 1e30])
def test_blocks_of_very_small_and_large_vectors(metric, size):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(900, 16)) * np.exp(4 * rng.normal(size=(900, 1))) * size
    q, ids = x[:40], np.arange(900)
    with np.errstate(all="ignore"):
        row, col, distance = search._best_pairs(x, q, [pa.array(ids)], 3, metric)
        hits = sorted((int(c), int(r), str(d)) for r, c, d in zip(row, col, distance, strict=True))
        assert hits == _nearest(x, q, ids, 3, metric)


def test_equal_distances_put_rows_without_a_key_first():
    x = np.ones((6, 4))
    row, _, _ = search._best_pairs(x, x[:1], [pa.array([5, 3, None, 4, None, 1])], 3, "l2")
    assert row[:2].tolist() == [2, 4] and row[2] == 5
