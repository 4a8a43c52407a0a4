"""Small hand-made inputs for the operators, and the rules that a reader would guess wrong."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from spatialfactor.config import FitConfig
from spatialfactor.functions.linalg import RiemannianAdam, polar, procrustes, signed_qr
from spatialfactor.functions.special import student_two_sided
from spatialfactor.operators import analysis, characterize, delaunay, downstream, fit, graph, posthoc, preprocess, samples, smooth, updates


def points(spark, rows):
    return spark.createDataFrame([(i, f"o{i}", s, float(x), float(y)) for i, s, x, y in rows], "obs_id bigint, obs_name string, sample_id string, x double, y double")


def long(spark, matrix, names):
    return spark.createDataFrame([(i, k, float(v)) for i, row in enumerate(np.asarray(matrix)) for k, v in enumerate(row)], names)


def dense(df, rows, cols, shape):
    out = np.zeros(shape)
    for r in df.collect():
        out[r[rows], r[cols]] = r[2]
    return out


def test_one_way_neighbour_has_half_its_distance(spark):
    obs = points(spark, [(0, "s", 0, 0), (1, "s", 1, 0), (2, "s", 3, 0)])
    found = {(r.i, r.j): r.dist for r in graph.knn_graph(obs, 1).collect()}
    assert found == {(0, 1): 1.0, (1, 0): 1.0, (1, 2): 1.0, (2, 1): 1.0}


def test_knn_matches_brute_force_with_ties_copies_and_gaps(spark):
    rng = np.random.default_rng(5)
    at = np.vstack((rng.integers(0, 12, (150, 2)), rng.normal(500, 1, (7, 2)), [[3, 3]] * 6))
    rows = [(i, "ab"[i % 2], x, y) for i, (x, y) in enumerate(at)]
    got = {(r.i, r.j) for r in graph.nearest(points(spark, rows), 4).collect()}
    want = set()
    for i, s, x, y in rows:
        near = sorted((np.sqrt((x - u) ** 2 + (y - v) ** 2), j) for j, t, u, v in rows if t == s and j != i)
        want |= {(i, j) for _, j in near[:4]}
    assert got == want


def test_samples_stay_apart_and_small_ones_are_left_out(spark):
    obs = points(spark, [(0, "z", 0, 0), (1, "a", 100, 0), (2, "z", 1, 0), (3, "a", 101, 0), (4, "z", 2, 0), (5, "a", 102, 0), (6, "t", 0, 0)])
    lap = graph.per_sample_laplacian(obs, 1).collect()
    of = {r.obs_id: r.sample_id for r in obs.collect()}
    assert all(of[r.i] == of[r.j] for r in lap) and 6 not in {r.i for r in lap}
    with pytest.raises(ValueError):
        graph.knn_graph(obs, 1).collect()


def test_isolated_points_and_smoothing(spark):
    obs = points(spark, [(0, "s", 0, 0), (1, "s", 1, 0), (2, "s", 50, 50)])
    edges = graph.radius_graph(obs, 2.0)
    lap = graph.laplacian(edges, obs)
    assert {(r.i, r.v) for r in lap.where("i = j").collect()} == {(0, 1.0), (1, 1.0), (2, 1.0)}
    expr = long(spark, [[1, 0], [3, 2], [4, 4]], "obs_id bigint, var_id bigint, x double")
    got = dense(smooth.smooth_expression(expr, lap, 0.5), "obs_id", "var_id", (3, 2))
    assert np.allclose(got, [[2, 1], [2, 1], [2, 2]])
    with pytest.raises(ValueError):
        smooth.smooth_expression(expr, lap, 1.5)
    with pytest.raises(ValueError):
        graph.build_graph(obs, "hexagons")


def test_w_update_lowers_the_error_and_stays_nonnegative(spark):
    rng = np.random.default_rng(1)
    x, w, q = rng.random((12, 6)), rng.random((12, 3)) + 0.1, rng.normal(size=(6, 3))
    df = long(spark, x, "obs_id bigint, var_id bigint, x double")
    got = dense(updates.update_w(df, long(spark, w, "obs_id bigint, k int, w double"), long(spark, q, "var_id bigint, k int, q double")), "obs_id", "k", w.shape)
    assert np.allclose(got, fit.step_w(w, x @ q, q.T @ q, None, 0.0, np.zeros(3)))
    assert (got >= 0).all() and np.linalg.norm(x - got @ q.T) <= np.linalg.norm(x - w @ q.T)


def test_gradient_matches_finite_differences(spark):
    rng = np.random.default_rng(2)
    x, w, q = rng.random((9, 5)), rng.random((9, 3)), rng.normal(size=(5, 3))
    g = dense(updates.q_gradient(long(spark, x, "obs_id bigint, var_id bigint, x double"), long(spark, w, "obs_id bigint, k int, w double"), long(spark, q, "var_id bigint, k int, q double"), 1.0), "var_id", "k", q.shape)

    def loss(m):
        return np.linalg.norm(x - w @ m.T) ** 2 + np.sqrt(2 * 45) * (np.minimum(m[:, 1:], 0) ** 2).sum()

    for i in range(5):
        for k in range(3):
            e = np.zeros_like(q)
            e[i, k] = 1e-6
            assert abs((loss(q + e) - loss(q - e)) / 2e-6 - g[i, k]) < 1e-4


def test_dominance_ties_go_to_the_higher_component(spark):
    gsp = long(spark, [[0.5, 0.5, 0.0], [0.0, 0.0, 0.0], [0.7, 0.1, 0.2]], "var_id bigint, k int, gsp double")
    assert {r.var_id: r.dominant for r in downstream.dominance(gsp).collect()} == {0: 1, 1: 2, 2: 0}


def test_concordance_is_positive_for_negative_loadings(spark):
    rng = np.random.default_rng(3)
    w = long(spark, rng.random((40, 2)), "obs_id bigint, k int, w double")
    q = long(spark, [[-1.0, 0.1], [1.0, 0.2]], "var_id bigint, k int, q double")
    rows = {(r.var_id, r.k): r for r in characterize.characterized(w, q).collect()}
    assert rows[0, 0].c_recon > 0.9 and rows[0, 0].exclusivity > 0
    one = characterize.characterized(w.where("k = 0"), q.where("k = 0")).collect()
    assert all(abs(r.exclusivity - r.r_var) < 1e-12 for r in one)
    with pytest.raises(ValueError):
        characterize.precompute_stats(w, q.where("k = 0"))


def test_posthoc_recovers_planted_coefficients(spark):
    rng = np.random.default_rng(7)
    w, b = rng.random((30, 3)), rng.normal(size=(8, 3))
    x = rng.normal(size=8) + w @ b.T
    r = posthoc.posthoc_regression(long(spark, x, "obs_id bigint, var_id bigint, x double"), long(spark, w, "obs_id bigint, k int, w double"), spark.createDataFrame([(i,) for i in range(8)], "var_id bigint"))
    assert np.allclose(dense(r.coefficients.select("var_id", "k", "coef"), "var_id", "k", b.shape), b, atol=1e-8)
    assert all(f.r2 > 1 - 1e-9 for f in r.features.collect())
    assert abs(float(student_two_sided(np.asarray(2.0), 10)) - 0.07338803) < 1e-7


def test_component_labels():
    assert posthoc.component_label(3) == "GEP03" and posthoc.component_label(3, {3: "Tumour"}) == "Tumour"
    assert [posthoc.component_of(x, 12, {3: "Tumour"}) for x in (5, "GEP05", "gep5", "Tumour", "GEP11", "GEP03")] == [5, 5, 5, 3, 11, 3]
    for bad in (12, -1, "GEP12", "other", ""):
        with pytest.raises(ValueError):
            posthoc.component_of(bad, 12)


def test_spearman_against_ranks_of_numpy(spark):
    rng = np.random.default_rng(14)
    w = np.where(rng.random((40, 2)) < 0.4, 0, rng.random((40, 2)))
    age = [None if i % 9 == 0 else float(rng.integers(0, 6)) for i in range(40)]
    obs = spark.createDataFrame([(i, "x", a) for i, a in enumerate(age)], "obs_id bigint, name string, age double")
    rank = lambda v: np.asarray([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])
    got = {r.k: r.correlation for r in analysis.correlate(long(spark, w, "obs_id bigint, k int, w double"), obs, ["age", "name"], "spearman").collect()}
    known = np.asarray([i for i in range(40) if age[i] is not None])
    for k in range(2):
        assert np.isclose(got[k], np.corrcoef(rank(w[known, k]), rank(np.asarray([age[i] for i in known])))[0, 1])


def test_moments_of_pairs_with_gaps_and_large_means(spark):
    rng = np.random.default_rng(15)
    w = rng.random((60, 3)) + [0, 1e6, 5]
    w[:, 2] = 5
    df = long(spark, w, "obs_id bigint, k int, w double")
    for rows in (df, df.where("(obs_id + k) % 5 <> 0").repartition(5)):
        held = {(r.obs_id, r.k) for r in rows.collect()}
        got = {(r.k1, r.k2): r.s for r in characterize.covariance(rows).collect()}
        products = {(r.k1, r.k2): r.v for r in updates.gram(rows, "obs_id", "w").collect()}
        for a in range(3):
            for b in range(3):
                both = [i for i in range(60) if (i, a) in held and (i, b) in held]
                assert np.isclose(got[a, b], np.cov(w[both, a], w[both, b])[0, 1], rtol=1e-6, atol=1e-9)
                assert np.isclose(products[a, b], w[both, a] @ w[both, b])
    r = {(x.k1, x.k2): x.r for x in analysis.component_correlation(df).collect()}
    assert np.isclose(r[0, 1], np.corrcoef(w[:, 0], w[:, 1])[0, 1], atol=1e-6) and r[2, 2] is None and np.isclose(r[0, 0], 1)


def test_alignment_needs_samples(spark):
    obs = points(spark, [(0, "a", 0, 0), (1, None, 1, 1)])
    for bad in (obs, obs.drop("sample_id")):
        with pytest.raises(ValueError):
            samples.align_grid(bad)


def test_merging(spark):
    expr = spark.createDataFrame([("o", "A", 1.0), ("o", "B", 2.0)], "obs_name string, var_name string, x double")
    obs = spark.createDataFrame([("o", 0.0)], "obs_name string, x double")
    merged, all_obs = samples.merge_samples([(expr, obs), (expr.where("var_name = 'A'"), obs)])
    assert {r.var_name for r in merged.collect()} == {"A"} and sorted(r.sample_id for r in all_obs.collect()) == ["0", "1"]
    for kwargs, parts in (({"join": "left"}, [(expr, obs)] * 2), ({}, [(expr.where("var_name = 'A'"), obs), (expr.where("var_name = 'B'"), obs)]), ({}, [(expr, obs)])):
        with pytest.raises(ValueError):
            samples.merge_samples(parts, **kwargs)


def test_preprocessing_drops_abnormal_genes_and_small_counts(spark):
    expr = spark.createDataFrame([(o, v, float(o + v + 1)) for o in range(6) for v in range(4)] + [(0, 4, float("nan")), (1, 5, -1.0), (2, 6, float("inf"))], "obs_id bigint, var_id bigint, x double")
    assert {r.var_id for r in preprocess.abnormal_genes(expr).collect()} == {4, 5, 6}
    out, obs = preprocess.standard_preprocess(expr, spark.createDataFrame([(i,) for i in range(6)], "obs_id bigint"), min_genes=1)
    assert {r.var_id for r in out.collect()} == {0, 1, 2, 3} and obs.count() == 6


def test_analysis_rules(spark):
    q = long(spark, [[1, 0], [0, 2], [2, 1]], "var_id bigint, k int, q double")
    w = long(spark, np.arange(1, 9).reshape(4, 2), "obs_id bigint, k int, w double")
    w2, q2 = analysis.normalize_q_scale_w(w, q)
    a, b = (dense(analysis.reconstruct(x, y), "obs_id", "var_id", (4, 3)) for x, y in ((w, q), (w2, q2)))
    assert np.allclose(a, b)
    for bad in (lambda: analysis.top_genes(q, "Signal_9"), lambda: analysis.top_genes(q, "x"), lambda: analysis.rank_genes(q, 1, "x"), lambda: analysis.normalize_components(w, q, "x")):
        with pytest.raises(ValueError):
            bad()


def test_linear_algebra():
    rng = np.random.default_rng(0)
    q = procrustes(rng.normal(size=(3, 10)))
    assert np.allclose(q.T @ q, np.eye(3))
    q = RiemannianAdam(1e-2).step(q, rng.normal(size=q.shape))
    assert np.allclose(q.T @ q, np.eye(3), atol=1e-6)
    for m in (q + 1e-3 * rng.normal(size=q.shape), rng.normal(size=(10, 3)) * [1e-6, 1, 1e6], np.ones((4, 2))):
        u, s, vt = np.linalg.svd(m, full_matrices=False)
        assert np.allclose(polar(m).T @ polar(m), np.eye(m.shape[1]), atol=1e-9) and (s[-1] < 1e-9 or np.allclose(polar(m), u @ vt, atol=1e-8))
    assert np.allclose(signed_qr(q), q) and np.allclose(signed_qr(-q), -q)
    assert delaunay.triangulate(np.asarray([[0, 0], [1, 0], [0, 1], [3, 3.0]])) >= {(0, 1), (0, 2), (1, 2), (1, 3), (2, 3)}
    assert delaunay.triangulate(np.asarray([[0, 0], [2, 0], [1, 0.0]])) == {(0, 2), (1, 2)}


def test_configuration():
    assert FitConfig().n_components == 25 and FitConfig().use_tv and FitConfig().tv_epsilon == 1e-2
    for bad in ({"n_components": 1}, {"lambda_neg": -1.0}, {"tv_epsilon": 0.0}, {"tv_stage": "x"}):
        with pytest.raises(ValueError):
            FitConfig(**bad)


def test_fit_recovers_planted_factors(spark, tmp_path):
    from spatialfactor.sources.tables import export_results, load_result, save_result

    rng = np.random.default_rng(4)
    rows = [(i, "ab"[i % 2], *rng.random(2) * 10) for i in range(80)]
    obs = points(spark, rows)
    centre = np.asarray([[2, 2], [8, 8], [2, 8]])
    xy = np.asarray([r[2:] for r in rows])
    w = np.exp(-((xy[:, None] - centre) ** 2).sum(axis=2) / 8)
    q = np.zeros((12, 3))
    for k in range(3):
        q[4 * k : 4 * k + 4, k] = 0.5
    x = w @ q.T * 4 + 0.2
    expr = long(spark, x, "obs_id bigint, var_id bigint, x double")
    config = FitConfig(n_components=4, stage1_epochs=15, stage2_epochs=1, adam_steps=3, init_iterations=5, lambda_l1_q=0.0, lambda_l1_w=0.0, alpha=0.01, use_tv=False, l1_strategy="none")
    result = fit.fit(expr, obs, graph.per_sample_laplacian(obs, 4), config)
    got_w, got_q = dense(result.w, "obs_id", "k", (80, 4)), dense(result.q, "var_id", "k", (12, 4))
    assert (got_w >= 0).all() and np.allclose(got_q[:, 1:].T @ got_q[:, 1:], np.eye(3), atol=1e-6)
    assert np.linalg.norm(x - got_w @ got_q.T) / np.linalg.norm(x) < 0.3
    save_result(result, str(tmp_path / "r"))
    assert load_result(spark, str(tmp_path / "r")).config == config
    var = spark.createDataFrame([(i, f"g{i}") for i in range(12)], "var_id bigint, var_name string")
    assert set(export_results(result, obs, var, str(tmp_path / "e"), normalized=True)) == {"loadings", "signatures", "genes", "scaling", "coordinates", "top_genes", "metadata", "parameters"}
    error = np.linalg.norm(x - got_w @ got_q.T) / np.linalg.norm(x)
    assert result.metadata["relative_error"] < 0.35 and result.metadata["max_cosine"] < 1e-6 and error > 0
    # a warm start takes the given factors; wrong shapes and edges between samples are told
    short = FitConfig(n_components=4, stage1_epochs=0, stage2_epochs=2, adam_steps=1, tv_update_freq=1, l1_scale="median_abs")
    again = fit.Factorizer(short).fit(expr, obs, graph.per_sample_laplacian(obs, 4), w=result.w, q=result.q)
    assert np.abs(dense(again.w, "obs_id", "k", (80, 4)) - got_w).max() < np.abs(got_w).max()
    other = fit.fit(expr, obs, graph.per_sample_laplacian(obs, 4), FitConfig(**short.to_dict() | {"tv_update_freq": 5}), w=result.w, q=result.q)
    assert not np.allclose(dense(other.w, "obs_id", "k", (80, 4)), dense(again.w, "obs_id", "k", (80, 4)), rtol=1e-12, atol=0)
    lap = graph.per_sample_laplacian(obs, 4)
    with pytest.raises(ValueError):
        fit.fit(expr, obs, lap, short, w=result.w.where("k < 3"))
    with pytest.raises(ValueError):
        fit.fit(expr, obs, lap, short, auto_init=False)
    with pytest.raises(ValueError):
        fit.fit(expr, obs, lap.union(spark.createDataFrame([(0, 1, -0.1)], "i bigint, j bigint, v double")), short, w=result.w)
    with pytest.raises(ValueError):
        fit.FitResult.of_tables(result.w, result.q.where("k > 0"), config)
    assert fit.FitResult.of_tables(result.w, result.q, config).component_names[0] == "Background"
    with pytest.raises(FileNotFoundError):
        load_result(spark, str(tmp_path / "none"))
    with pytest.raises(TypeError):
        fit.fit(expr, obs, expr, config, alpha=1.0)


def test_registered_fits_run_with_the_defaults(spark, monkeypatch):
    from types import SimpleNamespace

    from spatialfactor.plans import model_queries, queries

    seen = []
    monkeypatch.setattr(queries, "rounded", lambda df: df)
    monkeypatch.setattr(model_queries, "laplacian_of", lambda v, k: None)
    monkeypatch.setattr(fit, "fit", lambda expr, obs, lap, config: seen.append(config) or SimpleNamespace(w=None, q=None, start=None))
    for features in (30, 10):
        v = SimpleNamespace(expr=spark.range(features).withColumnRenamed("id", "var_id"), obs=None, spark=spark, sf_dir=str(features))
        monkeypatch.setattr(queries, "Views", lambda spark, sf_dir, v=v: v)
        for name in ("fit_w", "fit_q", "symnmf_init"):
            queries.QUERIES[name](None, "")
    assert seen == [FitConfig(), FitConfig(n_components=10)]  # the queries of a fit share it


def test_whole_table_queries_against_brute_force(spark, monkeypatch):
    from types import SimpleNamespace

    import __spark_entry__
    from spatialfactor.plans import queries

    rng = np.random.default_rng(3)
    n, p = 61, 23
    w, q, x = rng.random((n, 2)), rng.normal(size=(p, 2)), np.where(rng.random((n, p)) < 0.6, rng.integers(1, 9, (n, p)), 0).astype(float)
    x[7] = 0
    x[::2, 4] = 0
    long = lambda m, names: spark.createDataFrame([(i, j, float(m[i, j])) for i in range(m.shape[0]) for j in range(m.shape[1]) if names[-1] != "x double" or m[i, j]], ", ".join(names))
    v = SimpleNamespace(
        w=long(w, ["obs_id bigint", "k int", "w double"]),
        q=long(q, ["var_id bigint", "k int", "q double"]),
        expr=long(x, ["obs_id bigint", "var_id bigint", "x double"]),
        obs=spark.createDataFrame([(i, f"o{i}", f"s{i % 2}", float(i), 0.0) for i in range(n)], "obs_id bigint, obs_name string, sample_id string, x double, y double"),
        var=spark.createDataFrame([(j, f"G{j}") for j in range(p)], "var_id bigint, var_name string"),
        signatures=spark.createDataFrame([("s", f"g{j}", 1.0, 1.0, 1.0) for j in range(p)], "signature string, gene string, avg_logfc double, pct_1 double, pct_2 double"),
    )
    monkeypatch.setattr(queries, "Views", lambda spark, sf_dir: v)
    run = lambda name: __spark_entry__.queries()[{"reconstruct": "reconstruct_slice"}.get(name, name)](spark, "").collect()
    r = w @ q.T
    got = {(t.obs_id, t.var_id): t.x for t in run("reconstruct")}
    assert len(got) == n * p and all(abs(got[i, j] - r[i, j]) < 1e-5 for i in range(n) for j in range(p))
    errors = np.linalg.norm(x - r, axis=1) / (np.linalg.norm(x, axis=1) + 1e-10)
    got = {t.obs_id: t.error for t in run("recon_error_per_obs")}
    assert len(got) == n and np.allclose([got[i] for i in range(n)], errors, rtol=1e-4)
    sliced = {(t.obs_id, t.var_id): t.x for t in analysis.reconstruct(v.w, v.q, v.obs.where("obs_id % 5 = 0"), v.var.where("var_id < 4")).collect()}
    assert set(sliced) == {(i, j) for i in range(0, n, 5) for j in range(4)} and all(abs(x - r[i, j]) < 1e-9 for (i, j), x in sliced.items())
    assert {(t.obs_id, t.var_id): t.original for t in run("plot_spatial_reconstruction")} == {(i, j): x[i, j] for i in range(n) for j in range(p)}
    assert [(t.n_genes, t.n_matched) for t in run("signature_overlap")] == [(p, p)]
    assert all(abs(t.q - q[t.var_id, t.k]) < 1e-5 for t in run("expand_genes")) and len(run("expand_genes")) == 2 * p
    assert {t.var_id for t in run("hvg_validation")} == set(range(p))
    cells = {(f"s{i % 2}", i, j) for i, j in zip(*np.nonzero(x), strict=True)}
    assert len(run("merge_outer")) == len(cells) and len(run("merge_inner")) == sum(j != 4 for _, _, j in cells)


def test_symmetric_start_lowers_the_objective_and_knows_its_options(spark):
    rng = np.random.default_rng(6)
    obs = points(spark, [(i, "ab"[i % 2], *rng.random(2) * 5) for i in range(60)])
    x = rng.random((60, 3)) @ rng.random((3, 14))
    expr = long(spark, x, "obs_id bigint, var_id bigint, x double")
    lap = graph.per_sample_laplacian(obs, 4)
    blocks = fit.Blocks(expr, obs, lap, list(range(14)))
    entries = {(r.i, r.j): r.v for r in lap.collect()}
    s = np.zeros((60, 60))
    for (i, j), v in entries.items():
        if i != j:
            s[i, j] = max(-v, 0)
    s = 0.5 * np.eye(60) + 0.5 * s / np.maximum(s.sum(axis=1, keepdims=True), 1e-300)
    y = s @ x
    v = fit.leading(blocks, 3, 1)
    want = np.linalg.svd(y)[2][:3].T
    assert np.allclose(np.abs(v.T @ want), np.eye(3), atol=1e-5)
    for rule in ("hals", "mult"):
        state, q, wtw, ytw = fit.initialize(blocks, FitConfig(n_components=3, init_iterations=20), rule=rule)
        w = dense(blocks.long_w(state), "obs_id", "k", (60, 3))
        assert np.allclose(wtw, w.T @ w) and np.allclose(ytw, y.T @ w) and np.allclose(q.T @ q, np.eye(3), atol=1e-8)
        assert np.linalg.norm(y @ y.T - w @ w.T) < 0.5 * np.linalg.norm(y @ y.T) and (w >= 0).all()
    assert np.allclose(fit.initial_q(wtw, ytw, "lstsq"), ytw @ np.linalg.inv(wtw))
    for bad in (lambda: fit.updater("x"), lambda: fit.initial_q(wtw, ytw, "x"), lambda: fit.oriented(np.zeros((3, 3)), 3, 3), lambda: fit.oriented(np.zeros((2, 9)), 5, 3)):
        with pytest.raises(ValueError):
            bad()
    assert fit.oriented(np.zeros((3, 5)), 5, 3).shape == (5, 3)


def test_sums_of_blocks_in_one_level_and_in_two(spark, monkeypatch):
    obs = points(spark, [(i, "abcde"[i % 5], float(i), 0.0) for i in range(20)])
    expr = long(spark, np.arange(60.0).reshape(20, 3), "obs_id bigint, var_id bigint, x double")
    blocks = fit.Blocks(expr, obs, graph.per_sample_laplacian(obs, 2), [0, 1, 2])
    assert blocks.buckets > 1
    work = lambda b, f: ({"w": np.ones((b.n, 2)), "u": np.full((b.n, 1), 3.0)}, {"wx": b.transposed(np.ones((b.n, 2))), "n": np.asarray([[b.n]])})
    want = np.tile(np.arange(60.0).reshape(20, 3).sum(axis=0), (2, 1))
    for grouped in (64, 1):
        monkeypatch.setattr(fit, "GROUPED", grouped)
        state, sums = blocks.run(work, None)
        assert np.allclose(sums["wx"], want) and sums["n"] == 20
    kept, sums = blocks.run(lambda b, f: (f, {"w": f["w"].sum(axis=0), "u": f["u"].sum(axis=0)}), state)
    assert sums["w"].tolist() == [[20.0, 20.0]] and sums["u"].tolist() == [[60.0]]
    assert sorted(tuple(r) for r in blocks.long_w(kept, "u").collect()) == [(i, 0, 3.0) for i in range(20)]


def test_total_variation_terms_two_ways(spark):
    """Terms by joins and by the blocks' arrays are the same."""
    from types import SimpleNamespace

    rng = np.random.default_rng(7)
    obs = points(spark, [(i, "a", *rng.random(2)) for i in range(20)])
    lap = graph.per_sample_laplacian(obs, 3)
    w = rng.random((20, 2))
    edges, stats = graph.tv_structures(lap)
    got = {(r.obs_id, r.k): (r.lw, r.d) for r in updates.tv_terms(updates.tv_weights(edges, long(spark, w, "obs_id bigint, k int, w double"), 1e-2)).collect()}
    rows = lap.collect()
    row = SimpleNamespace(ids=list(range(20)), rim=[], owners=[], xi=[], xc=[], xv=[], li=[r.i for r in rows], lj=[r.j for r in rows], lv=[r.v for r in rows])
    block = fit.Block(row, 1, max(-r.v for r in rows if r.i < r.j))
    lw, d = block.tv_terms(w, w, 1e-2)
    packed = {(r.obs_id, r.k): (r.lw, r.d) for r in updates.tv_row_terms(edges, long(spark, w, "obs_id bigint, k int, w double"), 1e-2).collect()}
    assert set(packed) == set(got) and all(np.allclose(packed[x], got[x]) for x in got)
    assert stats["n_edges"] == edges.count() and len(got) == 40
    assert all(np.allclose(got[i, k], (lw[i, k], d[i, k])) for i in range(20) for k in range(2))


def test_end_to_end_run(spark):
    from spatialfactor.operators.pipeline import run_pipeline

    rng = np.random.default_rng(8)
    obs = points(spark, [(i, "ab"[i % 2], *rng.random(2) * 5) for i in range(40)])
    expr = long(spark, rng.integers(1, 9, (40, 12)), "obs_id bigint, var_id bigint, x double")
    result = run_pipeline(expr, obs, min_genes=1, n_components=3, stage1_epochs=2, stage2_epochs=1, adam_steps=1, init_iterations=2, neighbours=4)
    q = dense(result.q, "var_id", "k", (12, 3))
    assert np.allclose(np.linalg.norm(q, axis=0), 1) and result.metadata["normalized"] and result.w.count() == 120
    with pytest.raises(TypeError):
        run_pipeline(expr, obs, colour="red")


def test_alignment_is_kept_and_told_from_others(spark, tmp_path):
    obs = points(spark, [(i, "ab"[i % 2], float(i), 1.0) for i in range(4)]).withColumn("obs_name", F.col("obs_id").cast("string"))
    first = samples.cached_alignment(obs, str(tmp_path / "grid"))
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, samples.cached_alignment(obs, str(tmp_path / "grid")).collect()))
    with pytest.raises(ValueError, match="does not match"):
        samples.cached_alignment(obs.withColumn("obs_name", F.concat("obs_name", F.lit("x"))), str(tmp_path / "grid"))


def test_variable_genes_without_samples_and_against_a_plain_version(spark):
    rng = np.random.default_rng(9)
    x = rng.poisson(3, (50, 16)).astype(float)
    x[:, 3] = rng.poisson(0.5, 50) * 20
    expr = long(spark, x, "obs_id bigint, var_id bigint, x double").where("x <> 0")
    obs = spark.createDataFrame([(i,) for i in range(50)], "obs_id bigint")
    got = {r.var_id: r["rank"] for r in preprocess.highly_variable(expr, obs, 4).collect()}
    mean, var = x.mean(axis=0), x.var(axis=0, ddof=1)
    sd = np.sqrt(10 ** preprocess.local_quadratic(np.log10(mean), np.log10(var), 0.3))
    clipped = np.minimum(x, mean + sd * np.sqrt(50))
    clipped[x == 0] = 0
    score = (50 * mean**2 + (clipped**2).sum(axis=0) - 2 * clipped.sum(axis=0) * mean) / (49 * sd**2)
    ordered = score[sorted(range(16), key=got.get)]
    assert sorted(got.values()) == list(range(1, 17)) and (np.diff(ordered) <= 1e-9).all()


def test_regression_statistics_and_checks(spark):
    rng = np.random.default_rng(10)
    w, n, r = rng.random((40, 2)), 40, 2
    x = 2 + w @ np.asarray([[1.0, 0.0, -2.0], [0.5, 3.0, 0.0]]) + rng.normal(size=(40, 3))
    expr, wl = long(spark, x, "obs_id bigint, var_id bigint, x double"), long(spark, w, "obs_id bigint, k int, w double")
    var = spark.createDataFrame([(i, f"g{i}") for i in range(3)], "var_id bigint, var_name string")
    found = posthoc.posthoc_regression(expr, wl, var)
    a = np.hstack((np.ones((n, 1)), w))
    b = np.linalg.lstsq(a, x, rcond=None)[0]
    rest = x - a @ b
    sigma = (rest**2).sum(axis=0) / (n - r - 1)
    error = np.sqrt(np.diag(np.linalg.inv(a.T @ a))[:, None] * sigma)
    for t in found.coefficients.collect():
        assert np.isclose(t.coef, b[t.k + 1, t.var_id]) and np.isclose(t.stderr, error[t.k + 1, t.var_id]) and np.isclose(t.t, t.coef / t.stderr) and 0 <= t.pvalue <= 1
    for t in found.features.collect():
        assert np.isclose(t.r2, 1 - (rest[:, t.var_id] ** 2).sum() / ((x[:, t.var_id] - x[:, t.var_id].mean()) ** 2).sum())
    with pytest.warns(UserWarning, match="rank"):
        posthoc.posthoc_regression(expr, long(spark, np.repeat(w[:, :1], 2, axis=1), "obs_id bigint, k int, w double"), var)
    for bad in ((expr, wl.where("obs_id > 0 OR k > 0"), var), (expr.union(expr.limit(1).selectExpr("obs_id", "var_id", "double('nan')")), wl, var), (expr, wl, var.union(var))):
        with pytest.raises(ValueError):
            posthoc.posthoc_regression(*bad)


def test_triangles_have_empty_circles():
    points_ = np.random.default_rng(11).random((40, 2))
    edges = delaunay.triangulate(points_)
    near = {i: {b if a == i else a for a, b in edges if i in (a, b)} for i in range(40)}
    triangles = {tuple(sorted((a, b, c))) for a, b in edges for c in near[a] & near[b]}
    empty = set()
    for a, b, c in triangles:
        (ax, ay), (bx, by), (cx, cy) = points_[a], points_[b], points_[c]
        d = 2 * (ax * (by - cy) + bx * (cy - ay) + cx * (ay - by))
        ux = ((ax**2 + ay**2) * (by - cy) + (bx**2 + by**2) * (cy - ay) + (cx**2 + cy**2) * (ay - by)) / d
        uy = ((ax**2 + ay**2) * (cx - bx) + (bx**2 + by**2) * (ax - cx) + (cx**2 + cy**2) * (bx - ax)) / d
        radius = np.hypot(ax - ux, ay - uy)
        if (np.hypot(points_[:, 0] - ux, points_[:, 1] - uy) > radius - 1e-9).all():
            empty |= {(a, b), (a, c), (b, c)}
    assert {tuple(sorted(e)) for e in edges} == empty


def test_sampled_error_and_normalising_modes(spark):
    rng = np.random.default_rng(12)
    w, q = rng.random((30, 2)), rng.normal(size=(8, 2))
    x = w @ q.T + rng.normal(size=(30, 8)) * 0.1
    wl, ql = long(spark, w, "obs_id bigint, k int, w double"), long(spark, q, "var_id bigint, k int, q double")
    expr = long(spark, x, "obs_id bigint, var_id bigint, x double")
    error = analysis.relative_error_sampled(expr, wl, ql, 30).first()[0]
    assert np.isclose(error, np.linalg.norm(x - w @ q.T) / np.linalg.norm(x))
    assert 0 < analysis.relative_error_sampled(expr, wl, ql, 10).first()[0] < 1
    for mode in ("W", "Q", "both"):
        a, b = analysis.normalize_components(wl, ql, mode)
        got = dense(a, "obs_id", "k", (30, 2)) @ dense(b, "var_id", "k", (8, 2)).T
        assert np.allclose(got, w @ q.T)
