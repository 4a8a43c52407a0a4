"""Block matrices against NumPy."""

from __future__ import annotations

import numpy as np
import pytest

from spatialfactor.operators import matrix


def test_round_trip_and_products(spark):
    rng = np.random.default_rng(5)
    rows = {(int(r), int(c)): float(v) for r, c, v in zip(rng.integers(-40, 90, 400), rng.integers(-9, 50, 400), rng.normal(size=400), strict=True)}
    dense = {(int(i), k): float(rng.normal()) for i in range(-9, 45) for k in (0, 2, 5) if i % 7 or k == 2}
    entries = spark.createDataFrame([(*rc, v) for rc, v in rows.items()], "r bigint, c bigint, v double")
    factor = spark.createDataFrame([(*ik, v) for ik, v in dense.items()], "c bigint, k int, q double")
    for size in (1, 8, 1024):
        blocks, other = matrix.to_blocks(entries, "r", "c", "v", size), matrix.dense_blocks(factor, "c", "q", size)
        back = matrix.from_blocks(blocks)
        assert back.columns == ["r", "c", "v"] and {(x.r, x.c): x.v for x in back.collect()} == rows and back.count() == len(rows)
        product = matrix.multiply(blocks, other)
        got = {(x.r, x.k): x.v for x in product.collect()}
        want = {}
        for (r, c), v in rows.items():
            if any((c, k) in dense for k in (0, 2, 5)):
                for k in (0, 2, 5):
                    want[r, k] = want.get((r, k), 0.0) + v * dense.get((c, k), 0.0)
        assert set(got) == set(want) and all(np.isclose(got[x], want[x], atol=1e-12) for x in want)
        # neither matrix is shuffled: the one exchange is that of the sums
        assert matrix.multiply(blocks, other)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
        blocks.drop()
        other.drop()
        assert not spark.catalog.tableExists(blocks.name)


def test_repeated_null_and_missing_entries(spark):
    entries = spark.createDataFrame([(1, 1, 2.0), (1, 1, 3.0), (1, 2, None), (2, 2, 0.0)], "obs_id bigint, var_id bigint, x double")
    assert sorted(map(tuple, matrix.from_blocks(matrix.to_blocks(entries)).collect())) == [(1, 1, 5.0), (1, 2, 0.0), (2, 2, 0.0)]
    assert matrix.from_blocks(matrix.to_blocks(entries.limit(0))).collect() == []
    w = spark.createDataFrame([(1, 0, 1.0)], "var_id bigint, k int, q double")
    with pytest.raises(ValueError):
        matrix.multiply(matrix.to_blocks(entries), matrix.dense_blocks(w, "var_id", "q", 8))
    for bad in (lambda: matrix.to_blocks(entries, size=0), lambda: matrix.to_blocks(entries.union(spark.createDataFrame([(None, 1, 1.0)], entries.schema)))):
        with pytest.raises(ValueError):
            bad()


def test_a_thin_matrix_has_blocks_by_its_entries(spark):
    """Columns that each have entries in far rows made a block, with a start for each of its rows, of almost every entry."""
    rng = np.random.default_rng(3)
    cells = {(int(r), int(c)) for c in range(2_048) for r in rng.integers(-(10**12), 10**12, 3)}
    entries = spark.createDataFrame([(r, c, 1.0) for r, c in cells], "r bigint, c bigint, v double")
    for bound, most in ((32_768, 2), (1_000, 8)):
        blocks = matrix.to_blocks(entries, "r", "c", "v", block_entries=bound)
        held = [(len(b["rows"]), len(b["indptr"]), len(b["vals"])) for b in blocks.table.collect()]
        assert len(held) <= most and sum(n for _, _, n in held) == len(cells)
        assert all(starts == rows + 1 and n <= 1.2 * bound for rows, starts, n in held)
        assert {(x.r, x.c) for x in matrix.from_blocks(blocks).collect()} == cells
