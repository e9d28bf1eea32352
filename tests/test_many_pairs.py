"""Many pairs of shapes at once: the kernel for batches, distances of rectangles, rows that share a key."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from geosieve.functions import relate
from geosieve.layer import BoxColumns
from geosieve.operators import geometry_jobs as gj
from geosieve.plans import layers as ly
from geosieve.plans import spatial as plans

RINGS = {**ly.CORNERS, "triangle": [[(0, 0), (17.3, 4.1), (5, 12.7), (0, 0)]], "flat": [[(0, 0), (5, 0), (5, 0), (0, 0)]]}


def random_edges(rng) -> np.ndarray:
    rings = RINGS[rng.choice(list(RINGS))]
    edges = np.array([[*p, *q] for ring in rings for p, q in zip(ring, ring[1:])], float)
    return edges * rng.integers(1, 5) / 2 + np.tile(rng.integers(0, 24, 2), 2)


def lists(edges):
    return pa.array([None if e is None else e.ravel() for e in edges], pa.list_(pa.float64()))


@pytest.mark.parametrize("block", [1, 200, 1 << 16])
def test_batch_kernel_gives_the_matrices_of_the_single_one(monkeypatch, block):
    monkeypatch.setattr(relate, "MANY_BLOCK", block)
    rng = np.random.default_rng(3)
    a, b = ([random_edges(rng) for _ in range(600)] for _ in "ab")
    kinds = np.array(["POLYGON", "MULTIPOLYGON", "LINESTRING"])[rng.integers(0, 3, (2, 600))].tolist()
    want = [relate._relate(relate._dimension(i), x, relate._dimension(j), y) for i, x, j, y in zip(kinds[0], a, kinds[1], b)]
    a[5], b[6] = None, np.empty((0, 4))
    want[5] = want[6] = None
    got = relate._relation_udf.func(pa.array(kinds[0]), lists(a), pa.array(kinds[1]), lists(b))
    assert got.to_pylist() == want
    part = relate._relation_udf.func(*[x.slice(3, 40) for x in (pa.array(kinds[0]), lists(a), pa.array(kinds[1]), lists(b))])
    assert part.to_pylist() == want[3:43]


def test_small_polygons_are_not_related_one_by_one(monkeypatch):
    monkeypatch.setattr(relate, "_relate", None)
    rng = np.random.default_rng(4)
    a, kind = [random_edges(rng) for _ in range(50)], pa.array(["POLYGON"] * 50)
    assert all(m[0] == "2" for m, e in zip(relate._relation_udf.func(kind, lists(a), kind, lists(a)).to_pylist(), a)
               if np.ptp(e[:, 1]) > 0)


def test_distances_of_rectangles_are_those_of_other_shapes(spark):
    rows = [(float(i % 7), float(i % 5), float(i % 7 + i % 3), float(i % 5 + i % 4), float(i % 11), float(i % 6),
             float(i % 11 + i % 4), float(i % 6 + i % 2)) for i in range(150)]
    box = lambda s: BoxColumns(*[f"{s}{n}" for n in range(4)]).shape()
    df = spark.createDataFrame(rows, ", ".join(f"{s}{n} double" for s in "ab" for n in range(4)))
    df = df.select(box("a").alias("a"), box("b").alias("b"))
    # the same ring from another corner is not taken for an upright rectangle
    turned = F.expr("named_struct('type', a.type, 'parts', array(array(concat(slice(a.parts[0][0], 2, 4), array(a.parts[0][0][1])))))")
    got = gj.distances(df.withColumn("c", turned), "a", "b")
    got = gj.distances(got, "c", "b", "other").select("distance", "other").collect()
    assert any(r.distance > 0 for r in got) and all(r.distance == pytest.approx(r.other, abs=1e-9) for r in got)


def test_pairs_of_parts_carry_their_shapes(spark, tmp_path):
    rows = [(i, 40 + i % 7) for i in range(1, 13)] + [(3, 43), (None, 5), (7, None)]
    spark.createDataFrame(rows, "p_partkey long, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    for query in (plans.g9, plans.g15_shapes):
        df = query(spark, str(tmp_path))
        assert df._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
        # as when shapes were joined by key, a key that comes twice repeats its pairs with the shapes of all its rows
        n = {(r.t_key, r.s_key): r.n for r in df.groupBy("t_key", "s_key").agg(F.count("*").alias("n")).collect()}
        assert n[1, 1] == 1 and n[3, 3] == 16 and (7, 7) in n and not any(None in k for k in n)
