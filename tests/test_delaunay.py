"""Delaunay graphs against the definition: an edge has a circle that no other point is in."""

from __future__ import annotations

import numpy as np
import pytest

from spatialfactor.operators import delaunay

from .test_operators import points


def defined(p: np.ndarray) -> set[tuple[int, int]]:
    """Edges by the interval of centres on their bisectors; on one circle, those at the first point, and the rim."""
    out = set()
    for i in range(len(p)):
        for j in range(i + 1, len(p)):
            k = np.asarray([x for x in range(len(p)) if x not in (i, j)], dtype=int)
            d, u = p[j] - p[i], p[k] - (p[i] + p[j]) / 2
            a, b = (u**2).sum(axis=1) - (d**2).sum() / 4, 2 * (u @ np.asarray([-d[1], d[0]]))
            low, high = (a[b < 0] / b[b < 0]).max(initial=-np.inf), (a[b > 0] / b[b > 0]).min(initial=np.inf)
            if (a[b == 0] < 0).any():
                continue
            if np.isfinite(low) and np.isfinite(high) and abs(high - low) <= 1e-9 * (1 + abs(high) + abs(low)):
                t = (low + high) / 2
                if i < k[np.abs(t * b - a) <= 1e-9 * (d @ d) * (1 + abs(t)) ** 2].min():
                    out.add((i, j))
            elif low < high:
                out.add((i, j))
    return out


def shape(kind: str, n: int, rng) -> np.ndarray:
    if kind == "even":
        p = rng.random((n, 2))
    elif kind == "grid":
        p = rng.integers(0, 7, (n, 2)).astype(float)
    elif kind == "columns":
        p = np.stack((rng.integers(0, 8, n), rng.integers(0, 100, n) / 20), axis=1).astype(float)
    elif kind == "circle":
        p = np.stack((np.cos(np.arange(n) * 2 * np.pi / n), np.sin(np.arange(n) * 2 * np.pi / n)), axis=1)
    elif kind == "uneven":
        p = np.vstack((rng.random((n // 2, 2)) * 1e-3, rng.random((n - n // 2, 2)) * 10, [[100.0, 100.0]]))
    else:
        p = np.stack((np.arange(n) * 1.0, np.arange(n) * 2.0), axis=1)
    p = np.unique(p, axis=0)
    return p[rng.permutation(len(p))]


@pytest.mark.parametrize("kind", ["even", "grid", "columns", "circle", "uneven", "line"])
def test_triangulation_by_definition(kind):
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 4, 9, 40):
        p = shape(kind, n, rng)
        assert delaunay.triangulate(p) == (defined(p) if len(p) > 1 else set())


def test_tiles_give_the_graph_of_the_whole_sample(spark):
    rng = np.random.default_rng(2)
    samples = {kind: shape(kind, 400, rng) for kind in ("even", "grid", "columns", "uneven", "line")}
    samples["hole"] = samples["even"][np.hypot(*(samples["even"] - 0.5).T) > 0.35]
    samples["one"], samples["two"] = np.asarray([[1.0, 1.0]]), np.asarray([[1.0, 1.0], [2.0, 1.0]])
    rows, want, at = [], set(), 0
    for kind, p in samples.items():
        rows += [(at + i, kind, *xy) for i, xy in enumerate(p)]
        want |= {(at + i, at + j) for i, j in delaunay.triangulate(p)}
        at += len(p)
    # a second point at a place, and points without one
    obs = points(spark, [*rows, (at, "even", *samples["even"][0])]).unionByName(spark.createDataFrame([(at + 1, "o", "even", None, 1.0)], "obs_id bigint, obs_name string, sample_id string, x double, y double"))
    got = {(r.i, r.j): r for r in delaunay.delaunay_graph(obs, tile_points=60).collect()}
    assert set(got) == want | {(j, i) for i, j in want}
    where = {i: np.asarray([x, y]) for i, _, x, y in rows}
    assert all(r.a == 1.0 and np.isclose(r.dist, np.linalg.norm(where[i] - where[j])) for (i, j), r in got.items())
    assert delaunay.delaunay_graph(obs.limit(0)).collect() == []


def test_time_grows_little_faster_than_the_points():
    import time

    rng = np.random.default_rng(3)
    took = []
    for n in (2_000, 16_000):
        p = rng.random((n, 2))
        began = time.process_time()
        assert len(delaunay.triangulate(p)) > 2.9 * n
        took.append(time.process_time() - began)
    assert took[1] < 20 * took[0]
