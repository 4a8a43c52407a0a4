"""Neighbours in any dimension and density against all pairs."""

from __future__ import annotations

import numpy as np
import pytest

from spatialfactor.operators import graph


def table(spark, at, samples, coords):
    columns = ", ".join(f"{c} double" for c in coords)
    return spark.createDataFrame([(int(i * 7 % 4999), s, *map(float, p)) for i, (s, p) in enumerate(zip(samples, at, strict=True))], f"obs_id bigint, sample_id string, {columns}")


def all_pairs(at, samples, k):
    ids = np.asarray([i * 7 % 4999 for i in range(len(at))])
    want = set()
    for i in range(len(at)):
        d = np.zeros(len(at))
        for c in range(at.shape[1]):
            d += (at[:, c] - at[i, c]) ** 2
        d = np.sqrt(d)
        near = sorted((d[j], ids[j]) for j in range(len(at)) if samples[j] == samples[i] and j != i)
        want |= {(ids[i], j) for _, j in near[:k]}
    return want


@pytest.mark.parametrize("d", [1, 2, 3, 5])
def test_neighbours_in_any_dimension(spark, d):
    rng = np.random.default_rng(d)
    coords = tuple(f"c{i}" for i in range(d))
    # a dense spot, a grid with ties, copies of a point, and one far away
    at = np.vstack((rng.normal(size=(150, d)) * 1e-4, rng.integers(0, 5, (120, d)), np.ones((8, d)) * 2.5, np.full((1, d), 1e4), rng.random((60, d)) * 30))
    samples = ["b" if i % 11 == 0 else "a" for i in range(len(at))]
    samples[-1] = samples[-2] = "two"
    for tile_points in (30, 10_000):
        got = {(r.i, r.j) for r in graph.nearest(table(spark, at, samples, coords), 4, coords, tile_points).collect()}
        assert got == all_pairs(at, samples, 4)


def test_radius_graphs_in_three_dimensions_and_odd_rows(spark):
    rng = np.random.default_rng(0)
    at, coords = rng.random((90, 3)), ("x", "y", "z")
    samples = ["ab"[i % 2] for i in range(90)]
    obs = table(spark, at, samples, coords)
    got = {(r.i, r.j) for r in graph.radius_graph(obs, 0.3, coords).collect()}
    ids = [i * 7 % 4999 for i in range(90)]
    assert got == {(ids[i], ids[j]) for i in range(90) for j in range(90) if i != j and samples[i] == samples[j] and np.sqrt(((at[i] - at[j]) ** 2).sum()) <= 0.3}
    assert np.isclose(graph.auto_radius(obs, coords), 1.5 * np.sqrt(np.prod(at.max(axis=0) - at.min(axis=0)) / 90))
    odd = spark.createDataFrame([(9000, None, 0.5, 0.5, 0.5), (9001, "a", None, 0.5, 0.5), (9002, "a", float("nan"), 0.5, 0.5), (None, "a", 0.5, 0.5, 0.5)], obs.schema)
    assert {(r.i, r.j) for r in graph.nearest(obs.union(odd), 3, coords, 20).collect()} == all_pairs(at, samples, 3)
    assert graph.nearest(obs.limit(0), 3, coords).collect() == []
    with pytest.raises(ValueError):
        graph.build_graph(obs, "delaunay", coords=coords)
