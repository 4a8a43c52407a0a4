"""What holds a job's size in bounds: no join sends round what Spark only takes to be small."""

from __future__ import annotations

from spatialfactor.operators import graph


def executed(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_points_of_a_radius_graph_are_merged_whatever_size_spark_expects(spark):
    obs = spark.range(40).selectExpr("id AS obs_id", "'s' AS sample_id", "cast(id % 8 AS double) AS x", "cast(id div 8 AS double) AS y")
    got = graph.radius_graph(obs, 1.0)
    assert "SortMergeJoin" in executed(got) and "Broadcast" not in executed(got)
    # a grid of 8 by 5: each point with those beside and above it
    assert {(r["i"], r["j"]) for r in got.collect()} == {(a, b) for a in range(40) for b in range(40) if abs(a % 8 - b % 8) + abs(a // 8 - b // 8) == 1}


def test_activities_send_no_observations_round_and_are_those_of_the_sql(spark):
    import __spark_entry__ as driver
    from spatialfactor.plans.fixtures import VIEWS, view

    folder = "/root/testdata/sf0.001"
    tables = {t: spark.read.parquet(f"{folder}/{t}.parquet") for t in ("part", "orders", "lineitem")}
    sql = VIEWS["fx_w"][1]
    for t in tables:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
    w = view(spark, folder, "fx_w")
    assert sorted(map(tuple, w.collect())) == sorted(map(tuple, spark.sql(sql, **tables).collect()))
    for plan in (executed(w), executed(driver.queries()["recon_error_per_gene"](spark, folder))):
        # the side that is sent round is that of the components
        assert "BuildRight, Cross" in plan and "BuildLeft" not in plan


def test_procrustes_takes_tens_of_thousands_of_features_in_seconds(spark, tmp_path):
    import time

    import numpy as np

    import __spark_entry__ as driver

    n = 60_000
    lines = spark.range(4 * n).selectExpr("id AS l_orderkey", f"id * 7 % 50 AS l_partkey", f"id % {n} AS l_suppkey", "cast(1 + id * id % 11 AS double) AS l_quantity")
    orders = spark.range(4 * n).selectExpr("id AS o_orderkey", "concat(cast(1 + (id * 13 + id div 7) % 3 AS string), '-X') AS o_orderpriority")
    for name, df in (("lineitem", lines), ("orders", orders), ("part", spark.range(50).selectExpr("id AS p_partkey"))):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    began = time.time()
    got = driver.queries()["procrustes"](spark, str(tmp_path)).toArrow()
    took = time.time() - began
    q = np.zeros((n, 2))
    q[got["var_id"].to_numpy(), got["k"].to_numpy() - 1] = got["q"].to_numpy()
    # entries are rounded to six places
    assert len(got) == 2 * n and np.abs(q.T @ q - np.eye(2)).max() < 1e-3
    assert took < 30


def test_local_fits_of_many_genes_take_seconds_and_are_those_of_each_gene():
    import time

    import numpy as np

    from spatialfactor.operators import preprocess

    rng = np.random.default_rng(1)
    for x in (rng.normal(size=2_503), rng.exponential(size=2_503), np.round(rng.normal(size=2_503), 1), np.repeat(rng.normal(size=835), 3)):
        y = np.sin(x) + rng.normal(scale=0.1, size=len(x))
        for span in (0.3, 0.05, 1.0):
            got, k = preprocess.local_quadratic(x, y, span), int(np.ceil(span * len(x)))
            for i in (*range(0, len(x), 50), x.argmin(), x.argmax()):
                near = np.sort(np.abs(x - x[i]))[:k]
                chosen = np.argsort(np.abs(x - x[i]), kind="stable")[:k]
                weight = np.sqrt(np.maximum((1 - (near / near[-1]) ** 3) ** 3, 1e-9))
                want = np.linalg.lstsq(np.vander(x[chosen] - x[i], 3) * weight[:, None], y[chosen] * weight, rcond=None)[0][2]
                assert abs(got[i] - want) < 1e-7
    x = rng.normal(size=50_000)
    began = time.time()
    preprocess.local_quadratic(x, x**2, 0.3)
    assert time.time() - began < 15


def test_a_figure_of_both_matrices_shuffles_no_cells(spark):
    from spatialfactor.operators import plotdata

    w = spark.createDataFrame([(1, 0, 2.0), (1, 1, 1.0), (2, 0, 0.5), (3, 1, 3.0)], "obs_id bigint, k int, w double")
    q = spark.createDataFrame([(7, 0, 1.0), (7, 1, -1.0), (8, 1, 2.0), (9, 0, 5.0)], "var_id bigint, k int, q double")
    expr = spark.createDataFrame([(1, 7, 4.0), (2, 8, 6.0), (2, 9, 1.0)], "obs_id bigint, var_id bigint, x double")
    genes = spark.createDataFrame([(7,), (8,)], "var_id bigint")
    got = plotdata.spatial_reconstruction(expr, w, q, genes)
    # 3 has no entries, 9 is not among the genes
    assert sorted(map(tuple, got.collect())) == [
        (1, 7, 4.0, 1.0, -3.0, 4.0), (1, 8, 0.0, 2.0, 0.0, 6.0), (2, 7, 0.0, 0.5, -3.0, 4.0), (2, 8, 6.0, 0.0, 0.0, 6.0), (3, 7, 0.0, -3.0, -3.0, 4.0), (3, 8, 0.0, 6.0, 0.0, 6.0)
    ]
    assert "Exchange" not in executed(got) and "Join" not in executed(got)
    assert plotdata.spatial_reconstruction(expr, w, q, genes.limit(0)).collect() == []


def test_neighbours_in_medium_samples_are_found_whole_and_are_those_of_tiles(spark):
    obs = spark.range(1_500).selectExpr("id AS obs_id", "'s' AS sample_id", "cast(id * 37 % 211 AS double) AS x", "cast(id * 53 % 97 AS double) AS y")
    got = graph.nearest(obs, 4)
    plan = executed(got)
    assert "FlatMapGroupsInPandas" in plan and "CoGroups" not in plan and "REPARTITION_BY_NUM" in plan
    assert {(r["i"], r["j"]) for r in got.collect()} == {(r["i"], r["j"]) for r in graph.nearest(obs, 4, tile_points=300).collect()}
