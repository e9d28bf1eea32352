"""The relation kernel by level strips against all pairs, and on polygons of many corners."""

from __future__ import annotations

import time
import tracemalloc

import numpy as np
import pytest

from geosieve.functions import relate


def ring(n, x, y, radius, seed=0):
    turn = np.linspace(0, 2 * np.pi, n + 1)[:-1]
    wave = radius * (1 + 0.2 * np.sin(7 * turn + seed) + 1e-3 * np.random.default_rng(seed).random(n))
    points = np.stack([x + wave * np.cos(turn), y + wave * np.sin(turn)], 1)
    return np.hstack([points, np.roll(points, -1, 0)])


def path(n, seed):
    points = np.cumsum(np.random.default_rng(seed).integers(-3, 4, (n + 1, 2)), 0).astype(float)
    return np.hstack([points[:-1], points[1:]])


def squares(n, seed):
    """Squares on whole coordinates, so that corners and sides meet."""
    out = []
    for x, y in np.random.default_rng(seed).permutation(400)[:n, None] // np.array([20, 1]) % 20 * 2:
        c = np.array([(x, y), (x + 1, y), (x + 1, y + 1), (x, y + 1)], float)
        out.append(np.hstack([c, np.roll(c, -1, 0)]))
    return np.vstack(out)


SHAPES = [(2, ring(40, 0, 0, 10)), (2, ring(60, 3, 2, 10, 1)), (2, ring(30, 0, 0, 2)), (2, squares(30, 1)), (2, squares(60, 2)),
          (1, path(80, 3)), (1, path(50, 4)), (1, squares(20, 1)), (0, np.hstack([path(40, 3)[:, :2]] * 2)),
          (0, np.array([[1.0, 1.0, 1.0, 1.0]])), (1, np.array([[0.0, 0.0, 40.0, 0.0]])), (2, ring(50, 100, 100, 3))]


@pytest.mark.parametrize("block", [7, 1 << 20])
def test_strips_change_nothing(monkeypatch, block):
    want = [relate._relate(*a, *b) for a in SHAPES for b in SHAPES]
    monkeypatch.setattr(relate, "ALL_PAIRS", 0)
    monkeypatch.setattr(relate, "BLOCK_PAIRS", block)
    assert [relate._relate(*a, *b) for a in SHAPES for b in SHAPES] == want
    assert len(set(want)) > 10


def test_level_pairs_are_whole_and_single(monkeypatch):
    monkeypatch.setattr(relate, "ALL_PAIRS", 0)
    r = np.random.default_rng(5)
    for n, m in ((50, 70), (1, 300), (200, 3)):
        sides = [(low, low + r.choice([0, 0.1, 5], len(low))) for low in (r.integers(0, 20, k).astype(float) for k in (n, m))]
        pairs = [p for i, j in relate._level_pairs(*sides, 1e-9) for p in zip(i.tolist(), j.tolist())]
        assert len(pairs) == len(set(pairs))
        (a0, a1), (b0, b1) = sides
        assert set(pairs) >= {(i, j) for i in range(n) for j in range(m) if a0[i] <= b1[j] and b0[j] <= a1[i]}


def test_polygons_of_many_corners():
    tracemalloc.start()
    start = time.time()
    matrix = relate._relate(2, ring(20_000, 0, 0, 10), 2, ring(20_000, 3, 2, 10, 1))
    assert time.time() - start < 30 and tracemalloc.get_traced_memory()[1] < 1 << 30
    tracemalloc.stop()
    assert matrix == relate._relate(2, ring(200, 0, 0, 10), 2, ring(200, 3, 2, 10, 1))
