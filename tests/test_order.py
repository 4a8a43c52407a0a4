"""Running sums, ranks and quantiles against NumPy, with ties, nulls and groups of every size."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from spatialfactor.operators import order


def rows_of(spark, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(str(g), float(v)) for g, n in enumerate((1, 2, 300, 700)) for v in np.where(rng.random(n) < 0.4, 0.0, rng.normal(size=n) * 10.0 ** rng.integers(-9, 9, n))]
    rows += [(None, float(v)) for v in rng.integers(0, 5, 90)]
    return rows, spark.createDataFrame(rows, "g string, v double")


def test_positions_and_running_sums(spark):
    rows, df = rows_of(spark)
    got = order.positions(df, ["g"], [F.col("v")]).collect()
    for g in {r[0] for r in rows}:
        own = sorted((r.position, r.v) for r in got if r.g == g)
        assert [p for p, _ in own] == list(range(1, len(own) + 1)) and [v for _, v in own] == sorted(v for h, v in rows if h == g)
    whole = sorted((r.position, r.v) for r in order.positions(df, [], [F.col("v").desc()]).collect())
    assert [v for _, v in whole] == sorted((v for _, v in rows), reverse=True) and whole[-1][0] == len(rows)
    sums = order.prefix_sums(df.where("g = '2'").withColumn("n", F.lit(2)), [], [F.col("v")], F.col("n"), "before").collect()
    assert sorted(r.before for r in sums) == list(range(0, 600, 2))
    assert order.positions(df.limit(0), ["g"], [F.col("v")]).collect() == []


@pytest.mark.parametrize("heavy", [4096, 3])
def test_average_ranks(spark, monkeypatch, heavy):
    monkeypatch.setattr(order, "HEAVY", heavy)
    rows, df = rows_of(spark)
    got = Counter(map(tuple, order.average_rank(df, "v", ["g"], "rank").collect()))
    want = Counter()
    for g, v in rows:
        own = [u for h, u in rows if h == g]
        want[g, v, sum(u < v for u in own) + (sum(u == v for u in own) + 1) / 2] += 1
    assert got == want


@pytest.mark.parametrize(("small", "settled"), [(100_000, 10_000), (50, 10), (0, 1)])
def test_quantiles(spark, monkeypatch, small, settled):
    monkeypatch.setattr(order, "SMALL", small)
    monkeypatch.setattr(order, "SETTLED", settled)
    monkeypatch.setattr(order, "BUCKETS", 16)
    rows, df = rows_of(spark)
    more = spark.createDataFrame([("5", None), ("6", -1.7e308), ("6", 1.7e308), ("6", 5e-324), ("6", 0.0), ("2", None)], "g string, v double")
    asked = [0.0, 0.1, 0.5, 0.75, 0.95, 1.0]
    got = {(r.g, r.probability): r["quantile"] for r in order.quantiles(df.union(more), ["g"], F.col("v"), asked).collect()}
    rows += [("6", v) for v in (-1.7e308, 1.7e308, 5e-324, 0.0)]
    groups = {r[0] for r in rows}
    assert len(got) == len(groups) * len(asked)
    for g in groups:
        own = np.asarray([v for h, v in rows if h == g])
        for p in asked:
            at = np.sort(own)
            i = p * (len(own) - 1)
            want = at[int(np.floor(i))] + (i - np.floor(i)) * (at[int(np.ceil(i))] - at[int(np.floor(i))])
            assert np.isclose(got[g, p], want, rtol=1e-12, atol=0), (g, p)
    assert order.quantiles(df.limit(0), ["g"], F.col("v"), [0.5]).collect() == []
