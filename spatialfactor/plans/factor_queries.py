"""Queries over fitted factors: analysis, scores, characterisation, regression, figures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analysis, characterize, downstream, plotdata, posthoc
from .queries import r6, register

ORDERS = {"abs": "abs(q)", "positive": "q", "negative": "-q"}


def top_sql(criterion: str, n: int, where: str = "") -> str:
    return f"SELECT k, var_id, {r6('q')} AS score, {r6('abs(q)')} AS abs_score, rank FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY {ORDERS[criterion]} DESC, var_id DESC) AS rank FROM fx_q {where}) t WHERE rank <= {n}"


for name, criterion in (("abs", "abs"), ("pos", "positive"), ("neg", "negative")):

    @register(f"top_genes_{name}", f"SELECT var_id, score, abs_score, rank FROM ({top_sql(criterion, 50, 'WHERE k = 1')}) u")
    def _(v, criterion=criterion):
        return analysis.top_genes(v.q, "Signal_1", 50, criterion)


@register("rank_genes_components", top_sql("abs", 100))
def _(v):
    return analysis.rank_genes(v.q, 100)


@register("background", f"SELECT var_id, k, {r6('q')} AS q FROM fx_q WHERE k = 0")
def _(v):
    return analysis.background(v.q)


@register("signals", f"SELECT var_id, k, {r6('q')} AS q FROM fx_q WHERE k > 0")
def _(v):
    return analysis.signals(v.q)


FULL = "full_x AS (SELECT o.obs_id, g.var_id, coalesce(e.x, 0e0) AS x, r.r FROM (SELECT w.obs_id, q.var_id, sum(w * q) AS r FROM fx_w w JOIN fx_q q ON w.k = q.k GROUP BY w.obs_id, q.var_id) r JOIN fx_obs o ON r.obs_id = o.obs_id JOIN fx_var g ON r.var_id = g.var_id LEFT JOIN fx_expr e ON e.obs_id = r.obs_id AND e.var_id = r.var_id)"
ERROR = "sqrt(sum((x - r) * (x - r))) / (sqrt(sum(x * x)) + 1e-10)"


@register("recon_error_total", f"WITH {FULL} SELECT {r6(ERROR)} AS error FROM full_x")
def _(v):
    return analysis.reconstruction_error(v.expr, v.w, v.q)


@register("recon_error_per_gene", f"WITH {FULL} SELECT var_id, {r6(ERROR)} AS error FROM full_x GROUP BY var_id")
def _(v):
    return analysis.reconstruction_error(v.expr, v.w, v.q, "gene")


@register("recon_error_per_obs", f"WITH {FULL} SELECT obs_id, {r6(ERROR)} AS error FROM full_x GROUP BY obs_id")
def _(v):
    return analysis.reconstruction_error(v.expr, v.w, v.q, "obs")


@register("corr_pearson", f"SELECT k, key, {r6('corr(w, value)')} AS correlation FROM fx_w w JOIN (SELECT obs_id, 'x' AS key, x AS value FROM fx_obs UNION ALL SELECT obs_id, 'p_retailprice', p_retailprice FROM fx_obs) o ON w.obs_id = o.obs_id GROUP BY k, key")
def _(v):
    return analysis.correlate(v.w, v.obs, ["x", "p_retailprice", "obs_name"])


RANK = "rank() OVER (PARTITION BY k ORDER BY {0}) + (count(*) OVER (PARTITION BY k, {0}) - 1) / 2e0"


@register("corr_spearman", f"SELECT k, 'x' AS key, {r6('corr(a, b)')} AS correlation FROM (SELECT k, {RANK.format('w')} AS a, {RANK.format('x')} AS b FROM fx_w w JOIN fx_obs o ON w.obs_id = o.obs_id) t GROUP BY k")
def _(v):
    return analysis.correlate(v.w, v.obs, ["x"], "spearman")


@register("component_orthogonality", f"WITH n AS (SELECT k, sqrt(sum(q * q)) AS n FROM fx_q GROUP BY k), g AS (SELECT a.k AS k1, b.k AS k2, sum(a.q / x.n * b.q / y.n) AS g FROM fx_q a JOIN fx_q b ON a.var_id = b.var_id JOIN n x ON a.k = x.k JOIN n y ON b.k = y.k WHERE a.k > 0 AND b.k > 0 GROUP BY a.k, b.k) SELECT {r6('sqrt(sum((g - CASE WHEN k1 = k2 THEN 1e0 ELSE 0e0 END) * (g - CASE WHEN k1 = k2 THEN 1e0 ELSE 0e0 END)))')} AS orthogonality FROM g")
def _(v):
    return analysis.orthogonality(v.q, "var_id", "q")


@register("component_sparsity", f"SELECT k, CAST(count_if(abs(w) < 0.05e0) AS BIGINT) AS n_below, {r6('avg(CASE WHEN abs(w) < 0.05e0 THEN 1e0 ELSE 0e0 END)')} AS sparsity FROM fx_w GROUP BY k")
def _(v):
    return analysis.sparsity(v.w, "w", 0.05)


@register("component_correlation", f"SELECT a.k AS k1, b.k AS k2, {r6('corr(a.w, b.w)')} AS r FROM fx_w a JOIN fx_w b ON a.obs_id = b.obs_id GROUP BY a.k, b.k")
def _(v):
    return analysis.component_correlation(v.w)


QN = "n AS (SELECT k, sqrt(sum(q * q)) AS n FROM fx_q GROUP BY k)"


@register("normalize_q_scale_w", f"WITH {QN} SELECT 'w' AS factor, obs_id AS id, w.k, {r6('w * n')} AS value FROM fx_w w JOIN n ON w.k = n.k UNION ALL SELECT 'q', var_id, q.k, {r6('q / n')} FROM fx_q q JOIN n ON q.k = n.k")
def _(v):
    w, q = analysis.normalize_q_scale_w(v.w, v.q)
    return w.select(F.lit("w").alias("factor"), F.col("obs_id").alias("id"), "k", F.col("w").alias("value")).unionByName(q.select(F.lit("q").alias("factor"), F.col("var_id").alias("id"), "k", F.col("q").alias("value")))


@register("normalize_components_both", f"WITH {QN}, m AS (SELECT k, sqrt(sum(w * w)) AS m FROM fx_w GROUP BY k) SELECT obs_id, w.k, {r6('w / sqrt(m / n)')} AS w FROM fx_w w JOIN n ON w.k = n.k JOIN m ON w.k = m.k")
def _(v):
    return analysis.normalize_components(v.w, v.q, "both")[0]


@register("reconstruct_slice", f"SELECT obs_id, var_id, {r6('sum(w * q)')} AS x FROM fx_w w JOIN fx_q q ON w.k = q.k GROUP BY obs_id, var_id")
def _(v):
    return analysis.reconstruct(v.w, v.q, v.obs, v.var)


@register("qscore", f"SELECT var_id, k, {r6('q / sqrt(sum(q * q) OVER (PARTITION BY k))')} AS qscore FROM fx_q")
def _(v):
    return downstream.qscore(v.q)


GSP = """peak AS (SELECT k, greatest(max(w), 1e-10) AS peak FROM fx_wc GROUP BY k), sc AS (SELECT var_id, q.k, q.q, greatest(q.q * peak, 0e0) AS s FROM fx_qc q JOIN peak ON q.k = peak.k),
gsp AS (SELECT var_id, k, q, coalesce(s / nullif(sum(s) OVER (PARTITION BY var_id), 0e0), 0e0) AS gsp FROM sc)"""
DOM = f"""{GSP}, ranked AS (SELECT *, row_number() OVER (PARTITION BY var_id ORDER BY round(gsp, 9) DESC, k DESC) AS r FROM gsp),
dom AS (SELECT a.var_id, a.k AS dominant, a.gsp / (b.gsp + 1e-8) AS ratio FROM ranked a JOIN ranked b ON a.var_id = b.var_id AND a.r = 1 AND b.r = 2)"""


def dominance_of(v):
    return downstream.dominance(downstream.gene_specificity(v.wc, v.qc))


@register("gene_specificity", f"WITH {GSP} SELECT var_id, k, {r6('gsp')} AS gsp FROM gsp")
def _(v):
    return downstream.gene_specificity(v.wc, v.qc)


@register("dominance", f"WITH {DOM} SELECT var_id, dominant, {r6('least(ratio, 1e6)')} AS ratio FROM dom")
def _(v):
    return dominance_of(v).withColumn("ratio", F.least("ratio", F.lit(1e6)))


LEVELS = f"{DOM}, m AS (SELECT k, avg(CASE WHEN q > 0 THEN q END) AS m FROM fx_qc GROUP BY k), lev AS (SELECT q.var_id, q.k, q.q, coalesce(q.q > 0 AND q.q > m, FALSE) AS above, dominant, ratio FROM fx_qc q JOIN m ON q.k = m.k JOIN dom ON q.var_id = dom.var_id)"


@register("enrichment_genelist", f"WITH {LEVELS} SELECT k, var_id, {r6('q')} AS q, rank FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY q DESC, var_id) AS rank FROM lev WHERE above AND dominant = k AND ratio >= 1.2e0) t WHERE rank <= 50")
def _(v):
    return downstream.enrichment_genes(v.qc, dominance_of(v), 50, 1.2)


@register("enrichment_quality", f"""WITH {LEVELS}, c AS (SELECT k AS gep_idx, count_if(q > 0) AS a, round(coalesce(avg(CASE WHEN q > 0 THEN q END), 0e0), 6) + 0e0 AS b, round(max(q), 6) + 0e0 AS d, count_if(above) AS e, count_if(above AND dominant = k) AS f, count_if(above AND dominant = k AND ratio >= 1.2e0) AS g FROM lev GROUP BY k)
SELECT gep_idx, CAST(a AS BIGINT) AS n_positive, b AS q_mean_positive, d AS q_max, CAST(e AS BIGINT) AS n_above_mean, CAST(f AS BIGINT) AS n_dominant, CAST(g AS BIGINT) AS n_pass_l4, CAST(least(g, 50) AS BIGINT) AS n_selected, least(g, 50) < 10 AS is_low_quality FROM c""")
def _(v):
    return downstream.enrichment_quality(v.qc, dominance_of(v), 50, 1.2)


CLASSES = """p AS (SELECT k, quantile_cont(w, 0.99) AS p99 FROM fx_wc GROUP BY k), nv AS (SELECT o.sample_id, w.k, w.w, CASE WHEN p99 > 0 THEN w.w / p99 ELSE w.w END AS v FROM fx_wc w JOIN p ON w.k = p.k JOIN fx_obs o ON w.obs_id = o.obs_id),
st AS (SELECT k, sample_id, quantile_cont(v, 0.95) AS p95, avg(w) AS m, stddev_pop(w) AS s, count(*) AS n FROM nv GROUP BY k, sample_id),
zz AS (SELECT nv.k, nv.sample_id, (w - m) / (s + 1e-10) AS z FROM nv JOIN st ON nv.k = st.k AND nv.sample_id = st.sample_id),
mo AS (SELECT k, sample_id, avg(z * z) AS m2, avg(z * z * z) AS m3, avg(z * z * z * z) AS m4 FROM zz GROUP BY k, sample_id),
bi AS (SELECT st.*, p95 > 0.3e0 AS active, p95 > 0.3e0 AND n >= 50 AS big, coalesce(m4 / nullif(m2 * m2, 0e0) > 0 AND (power(m3 / nullif(power(m2, 1.5e0), 0e0), 2) + 1) / nullif(m4 / nullif(m2 * m2, 0e0), 0e0) > 0.55e0, FALSE) AS bim FROM st JOIN mo ON st.k = mo.k AND st.sample_id = mo.sample_id),
cl AS (SELECT k, CAST(count(*) AS BIGINT) AS n_samples, CAST(count_if(active) AS BIGINT) AS n_active, avg(CASE WHEN active THEN 1e0 ELSE 0e0 END) AS frac_active,
CASE WHEN count_if(active) >= 2 THEN stddev_pop(CASE WHEN active THEN m END) / (avg(CASE WHEN active THEN m END) + 1e-10) ELSE 0e0 END AS between_cv,
coalesce(avg(CASE WHEN big THEN s / (m + 1e-10) END), 0e0) AS within_cv, coalesce(avg(CASE WHEN big THEN CASE WHEN bim THEN 1e0 ELSE 0e0 END END), 0e0) AS bimodal_frac FROM bi GROUP BY k)"""
CLASS_COLUMNS = f"k, n_samples, n_active, {r6('frac_active')} AS frac_active, {r6('between_cv')} AS between_cv, {r6('within_cv')} AS within_cv, {r6('bimodal_frac')} AS bimodal_frac"


@register("classify_geps", f"WITH {CLASSES} SELECT {CLASS_COLUMNS} FROM cl")
def _(v):
    return downstream.classify_components(v.wc, v.obs)


@register("component_categories", f"""WITH {CLASSES}, cut AS (SELECT quantile_cont(frac_active, 0.75) AS hi, quantile_cont(frac_active, 0.25) AS lo, quantile_cont(between_cv, 0.6) AS cv FROM cl)
SELECT {CLASS_COLUMNS}, CASE WHEN frac_active < lo THEN 'Rare' WHEN frac_active >= hi AND between_cv < cv THEN 'Global' ELSE 'Subgroup' END AS reach,
CASE WHEN bimodal_frac <= 0.1e0 AND within_cv < 0.3e0 THEN 'Uniform' WHEN bimodal_frac > 0.2e0 OR bimodal_frac > 0.1e0 AND within_cv > 0.5e0 THEN 'Structured' ELSE 'Diffuse' END AS form FROM cl, cut""")
def _(v):
    return downstream.component_categories(downstream.classify_components(v.wc, v.obs))


STATS = """wcm AS MATERIALIZED (SELECT * FROM fx_wc), qcm AS MATERIALIZED (SELECT * FROM fx_qc),
sig AS MATERIALIZED (SELECT a.k AS k1, b.k AS k2, covar_samp(a.w, b.w) AS s FROM wcm a JOIN wcm b ON a.obs_id = b.obs_id GROUP BY a.k, b.k),
mm AS MATERIALIZED (SELECT var_id, k2 AS k, sum(q * s) AS m FROM qcm JOIN sig ON k = k1 GROUP BY var_id, k2),
st0 AS (SELECT q.var_id, q.k, q.q, m, s, s > 1e-10 AS active, sum(m * q.q) OVER (PARTITION BY q.var_id) AS v FROM qcm q JOIN mm ON q.var_id = mm.var_id AND q.k = mm.k JOIN sig ON q.k = k1 AND q.k = k2),
st1 AS (SELECT *, CASE WHEN active THEN q * q * s / (v + 1e-10) ELSE 0e0 END AS r_var, CASE WHEN active THEN greatest(least(sign(q) * m / (sqrt(greatest(v, 0e0)) * sqrt(greatest(s, 0e0)) + 1e-10), 1e0), -1e0) ELSE 0e0 END AS c_recon FROM st0),
st2 AS (SELECT *, row_number() OVER (PARTITION BY var_id ORDER BY r_var DESC, k) AS nth FROM st1),
st AS MATERIALIZED (SELECT *, r_var - CASE WHEN nth = 1 THEN max(CASE WHEN nth = 2 THEN r_var END) OVER gene ELSE max(CASE WHEN nth = 1 THEN r_var END) OVER gene END AS exclusivity, max(CASE WHEN nth = 1 THEN k END) OVER gene AS top_k FROM st2 WINDOW gene AS (PARTITION BY var_id))"""


@register("precompute_stats", f"WITH {STATS} SELECT var_id, k, {r6('q')} AS q, {r6('m')} AS m, {r6('s')} AS s, active, {r6('v')} AS v FROM st")
def _(v):
    return characterize.precompute_stats(v.wc, v.qc)


for name in ("r_var", "c_recon", "exclusivity"):

    @register(name, f"WITH {STATS} SELECT var_id, k, {r6(name)} AS {name} FROM st")
    def _(v, name=name):
        return characterize.characterized(v.wc, v.qc).select("var_id", "k", name)


@register("gep_gene_ranking", f"""WITH {STATS}, cut AS (SELECT k, quantile_cont(r_var, 0.8) AS cut FROM st GROUP BY k),
f AS (SELECT st.*, c_recon >= 0.4e0 AS fits, c_recon >= 0.4e0 AND r_var >= cut AND top_k = st.k AS anchor FROM st JOIN cut ON st.k = cut.k),
roles AS (SELECT *, 'anchor' AS role FROM f WHERE anchor UNION ALL SELECT *, 'representative' FROM f WHERE fits UNION ALL SELECT *, 'exclusive' FROM f WHERE anchor AND exclusivity >= 0)
SELECT k, role, rank, var_id, {r6('c_recon')} AS c_recon, {r6('r_var')} AS r_var, {r6('exclusivity')} AS exclusivity FROM (SELECT *, row_number() OVER (PARTITION BY k, role ORDER BY round(c_recon, 9) DESC, var_id) AS rank FROM roles) t WHERE rank <= 50""")
def _(v):
    return characterize.rank_genes_per_component(characterize.characterized(v.wc, v.qc))


@register("gep_quality", f"""WITH {STATS}, g AS (SELECT k, CASE WHEN sum(r_var * r_var) > 1e-10 THEN sum(r_var) * sum(r_var) / sum(r_var * r_var) ELSE 0e0 END AS e, CAST(count_if(c_recon >= 0.4e0) AS BIGINT) AS n, max(r_var) AS t FROM st GROUP BY k)
SELECT k, round(e, 2) AS n_eff, n AS n_high_concordance, round(t, 4) AS top1, t > 0.5e0 AS single_gene_driven, e < 5 OR n < 5 AS low_gene_support, NOT t > 0.5e0 AND NOT (e < 5 OR n < 5) AS interpretable FROM g""")
def _(v):
    return characterize.component_quality(characterize.characterized(v.wc, v.qc))


@register("annotate_signatures", f"""WITH {STATS}, g AS (SELECT signature, s_suppkey AS var_id, avg_logfc FROM fx_signatures JOIN supplier ON gene = s_name WHERE avg_logfc >= 1 AND pct_1 - pct_2 >= 20),
sc AS (SELECT k, signature, sum(avg_logfc * c_recon) / sum(avg_logfc) AS score FROM g JOIN st ON g.var_id = st.var_id WHERE q > 0 GROUP BY k, signature HAVING count(*) >= 3),
rk AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY round(score, 9) DESC, signature) AS nth FROM sc),
b AS (SELECT c.k, x.signature AS best, x.score, y.score AS second, x.score - coalesce(y.score, 0e0) AS margin FROM (SELECT DISTINCT k FROM st) c LEFT JOIN rk x ON c.k = x.k AND x.nth = 1 LEFT JOIN rk y ON c.k = y.k AND y.nth = 2)
SELECT k, best, {r6('score')} AS score, {r6('second')} AS second, {r6('margin')} AS margin, CASE WHEN score >= 0.1e0 AND margin >= 0.01e0 THEN best ELSE 'unassigned' END AS label FROM b""")
def _(v):
    return characterize.annotate_components(characterize.characterized(v.wc, v.qc), v.var, v.signatures, 3, 0.1, 0.01)


@register("posthoc_simple_ols", f"""WITH d AS (SELECT g.var_id, w.w, coalesce(x, 0e0) AS x FROM (SELECT DISTINCT var_id FROM fx_expr) g CROSS JOIN fx_w w LEFT JOIN fx_expr e ON e.var_id = g.var_id AND e.obs_id = w.obs_id WHERE w.k = 0)
SELECT var_id, {r6('regr_intercept(x, w)')} AS intercept, {r6('regr_slope(x, w)')} AS coef, {r6('regr_r2(x, w)')} AS r2 FROM d GROUP BY var_id""")
def _(v):
    return posthoc.simple_regression(v.expr, v.w, 0)


@register("rank_genes_for_gep", f"""WITH d AS (SELECT *, CASE WHEN q > 0 THEN 'positive' ELSE 'negative' END AS direction FROM fx_q WHERE q <> 0)
SELECT k, direction, rank, var_id, {r6('q')} AS coef FROM (SELECT *, row_number() OVER (PARTITION BY k, direction ORDER BY round(abs(q), 9) DESC, var_id) AS rank FROM d) t WHERE rank <= 30""")
def _(v):
    return posthoc.rank_by_coefficient(v.q.withColumnRenamed("q", "coef"), 30, 30)


SCORES = "m AS (SELECT signature, k, CASE WHEN count(*) >= 3 THEN avg(q) END AS score FROM (SELECT DISTINCT signature, upper(gene) AS gene FROM fx_signatures) s JOIN fx_var v ON s.gene = upper(v.var_name) JOIN fx_q q ON v.var_id = q.var_id GROUP BY signature, k)"


@register("score_signatures", f"WITH {SCORES}, z AS (SELECT *, stddev_pop(score) OVER (PARTITION BY signature) AS sd, avg(score) OVER (PARTITION BY signature) AS mean FROM m) SELECT signature, k, {r6('CASE WHEN sd > 0 THEN (score - mean) / sd WHEN score IS NOT NULL THEN 0e0 END')} AS score FROM z")
def _(v):
    return posthoc.score_signatures(v.q.withColumnRenamed("q", "coef"), v.var, v.signatures)


@register("signature_overlap", "WITH s AS (SELECT DISTINCT signature, upper(gene) AS gene FROM fx_signatures), h AS (SELECT s.*, v.g FROM s LEFT JOIN (SELECT DISTINCT upper(var_name) AS g FROM fx_var) v ON s.gene = v.g) SELECT signature, count(*) AS n_genes, count(g) AS n_matched, coalesce(string_agg(g, ',' ORDER BY g), '') AS genes FROM h GROUP BY signature")
def _(v):
    return posthoc.signature_overlap(v.var, v.signatures)


@register("zscore_columns", f"SELECT obs_id, k, {r6('(w - avg(w) OVER (PARTITION BY k)) / CASE WHEN stddev_pop(w) OVER (PARTITION BY k) > 0 THEN stddev_pop(w) OVER (PARTITION BY k) ELSE 1e0 END')} AS w FROM fx_w")
def _(v):
    return posthoc.zscore_columns(v.w, "w")


@register("plot_spatial_loadings", f"SELECT w.obs_id, {r6('x')} AS x, {r6('y')} AS y, k, {r6('w')} AS w FROM fx_w w JOIN fx_obs o ON w.obs_id = o.obs_id WHERE k IN (1, 2)")
def _(v):
    return plotdata.spatial_loadings(v.w, v.obs, [1, 2])


@register("plot_signature_heatmap", f"WITH t AS ({top_sql('abs', 10)}), o AS (SELECT var_id, min(k * 100 + rank) AS f FROM t GROUP BY var_id) SELECT q.var_id, f // 100 * 10 + f % 100 AS nth, k, {r6('q')} AS q FROM fx_q q JOIN o ON q.var_id = o.var_id")
def _(v):
    return plotdata.signature_heatmap(v.q, 10)


@register("plot_spatial_reconstruction", f"""WITH r AS (SELECT w.obs_id, q.var_id, sum(w * q) AS r FROM fx_w w JOIN fx_q q ON w.k = q.k GROUP BY w.obs_id, q.var_id),
t AS (SELECT r.obs_id, r.var_id, coalesce(x, 0e0) AS original, r AS reconstructed FROM r LEFT JOIN fx_expr e ON r.obs_id = e.obs_id AND r.var_id = e.var_id)
SELECT obs_id, var_id, original, {r6('reconstructed')} AS reconstructed, {r6('least(min(original) OVER (PARTITION BY var_id), min(reconstructed) OVER (PARTITION BY var_id))')} AS low, {r6('greatest(max(original) OVER (PARTITION BY var_id), max(reconstructed) OVER (PARTITION BY var_id))')} AS high FROM t""")
def _(v):
    return plotdata.spatial_reconstruction(v.expr, v.w, v.q, v.var)


@register("export_top_genes", f"SELECT k, v.var_name AS gene, rank, score FROM ({top_sql('positive', 50)}) t JOIN fx_var v ON t.var_id = v.var_id")
def _(v):
    return analysis.rank_genes(v.q, 50, "positive").join(v.var, "var_id").select("k", F.col("var_name").alias("gene"), "rank", "score")
