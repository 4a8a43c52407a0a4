"""One query per operator over the canonical views, and SQL that gives the same rows from the same tables.

Doubles are rounded to six places on both sides; counts and ranks are bigint.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, matrix, preprocess, samples, smooth, updates
from .fixtures import view, with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
K, R = 6, 4.0


class Views:
    """The canonical views of one call."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return view(self.spark, self.sf_dir, f"fx_{name}")


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places without negative zero, ints to bigint."""
    out = []
    for f in df.schema:
        kind, c = f.dataType.typeName(), F.col(f"`{f.name}`")
        out.append((F.round(c, 6) + F.lit(0.0)).alias(f.name) if kind == "double" else c.cast("bigint").alias(f.name) if kind in ("integer", "long", "short") else c)
    return df.select(*out)


def register(name: str, sql: str | None = None):
    def keep(make: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: rounded(make(Views(spark, sf_dir)))
        if sql:
            ORACLE_SQL[name] = with_views(sql)
        return make

    return keep


def r6(expression: str) -> str:
    return f"(round({expression}, 6) + 0e0)"


PAIRS = "SELECT a.obs_id AS i, b.obs_id AS j, a.sample_id, sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) AS dist FROM fx_obs a JOIN fx_obs b ON a.sample_id = b.sample_id AND a.obs_id <> b.obs_id"


def knn(k: int, skip: bool = False) -> str:
    few = f"WHERE n >= {k + 1}" if skip else ""
    return f"""pairs AS (SELECT p.* FROM ({PAIRS}) p JOIN (SELECT sample_id, count(*) AS n FROM fx_obs GROUP BY sample_id) s ON p.sample_id = s.sample_id {few}),
directed AS (SELECT i, j, dist FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY dist, j) AS rank FROM pairs) t WHERE rank <= {k}),
edges AS (SELECT i, j, 1e0 AS a, sum(dist) / 2 AS dist FROM (SELECT i, j, dist FROM directed UNION ALL SELECT j, i, dist FROM directed) t GROUP BY i, j)"""


def lap(k: int = K, skip: bool = True) -> str:
    nodes = f"(SELECT obs_id FROM fx_obs o JOIN (SELECT sample_id, count(*) AS n FROM fx_obs GROUP BY sample_id) s ON o.sample_id = s.sample_id WHERE n >= {k + 1})"
    return f"""{knn(k, skip)}, degree AS (SELECT i, sum(a) AS d FROM edges GROUP BY i),
lap AS (SELECT e.i, e.j, -e.a / sqrt(x.d * y.d) AS v FROM edges e JOIN degree x ON e.i = x.i JOIN degree y ON e.j = y.i UNION ALL SELECT obs_id, obs_id, 1e0 FROM {nodes} n)"""


def graph_of(v: Views, k: int = K) -> DataFrame:
    return graph.knn_graph(v.obs, k, skip_small=True)


def laplacian_of(v: Views, k: int = K) -> DataFrame:
    return graph.per_sample_laplacian(v.obs, k)


# graphs


@register("graph_knn", f"WITH {knn(K, True)} SELECT i, j, a FROM edges")
def _(v):
    return graph_of(v).select("i", "j", "a")


@register("graph_knn_distance", f"WITH {knn(K, True)} SELECT i, j, {r6('dist')} AS dist FROM edges")
def _(v):
    return graph_of(v).select("i", "j", "dist")


@register("graph_knn_directed", f"WITH {knn(K)} SELECT i, j, 1e0 AS a, {r6('dist')} AS dist FROM directed")
def _(v):
    return graph.graph_from_coords(v.obs, k=K)


@register("graph_radius", f"SELECT i, j, 1e0 AS a, {r6('dist')} AS dist FROM ({PAIRS}) p WHERE dist <= {R}")
def _(v):
    return graph.radius_graph(v.obs, R)


@register("graph_radius_auto", f"WITH r AS (SELECT 1.5e0 * sqrt((max(x) - min(x)) * (max(y) - min(y)) / count(*)) AS radius FROM fx_obs) SELECT i, j, 1e0 AS a, {r6('dist')} AS dist FROM ({PAIRS}) p, r WHERE dist <= radius")
def _(v):
    return graph.build_graph(v.obs, "radius")


@register("graph_set_diag", f"WITH {knn(K, True)} SELECT i, j, a, {r6('dist')} AS dist FROM edges UNION ALL SELECT obs_id, obs_id, 1e0, 0e0 FROM fx_obs")
def _(v):
    return graph.set_diag(graph_of(v), v.obs)


@register("graph_average_degree", f"WITH {knn(K, True)} SELECT {r6('avg(coalesce(d, 0e0))')} AS average_degree FROM fx_obs LEFT JOIN (SELECT i, sum(a) AS d FROM edges GROUP BY i) t ON obs_id = i")
def _(v):
    return graph.average_degree(graph_of(v), v.obs)


@register("laplacian_normalized", f"WITH {knn(K, True)}, degree AS (SELECT i, sum(a) AS d FROM edges GROUP BY i) SELECT e.i, e.j, {r6('-e.a / sqrt(x.d * y.d)')} AS v FROM edges e JOIN degree x ON e.i = x.i JOIN degree y ON e.j = y.i UNION ALL SELECT obs_id, obs_id, 1e0 FROM fx_obs")
def _(v):
    return graph.laplacian(graph_of(v), v.obs)


@register("laplacian_unnormalized", f"WITH {knn(K, True)} SELECT i, j, -a AS v FROM edges UNION ALL SELECT obs_id, obs_id, coalesce(d, 0e0) FROM fx_obs LEFT JOIN (SELECT i, sum(a) AS d FROM edges GROUP BY i) t ON obs_id = i")
def _(v):
    return graph.laplacian(graph_of(v), v.obs, normalized=False)


@register("per_sample_graph", f"WITH {lap(8)} SELECT i, j, {r6('v')} AS v FROM lap")
def _(v):
    return graph.per_sample_laplacian(v.obs, 8)


@register("edge_list_from_laplacian", f"WITH {lap()}, u AS (SELECT i, j, greatest(-v, 0e0) AS weight FROM lap WHERE i < j) SELECT i, j, {r6('weight / (SELECT max(weight) FROM u)')} AS weight FROM u WHERE weight > 0")
def _(v):
    return graph.edges_from_laplacian(laplacian_of(v))


@register("edge_list_inverse_distance", f"WITH {knn(K, True)}, u AS (SELECT i, j, 1e0 / (dist + 1e-6) AS weight FROM edges WHERE i < j) SELECT i, j, {r6('weight / (SELECT max(weight) FROM u)')} AS weight FROM u")
def _(v):
    return graph.edge_list(graph_of(v))


@register("smooth_expression", f"""WITH {lap()}, adj AS (SELECT i, j, greatest(-v, 0e0) AS a FROM lap WHERE i <> j), tot AS (SELECT i, sum(a) AS t FROM adj GROUP BY i)
SELECT obs_id, var_id, {r6('sum(x)')} AS x FROM (SELECT obs_id, var_id, 0.5e0 * x AS x FROM fx_expr
UNION ALL SELECT adj.i, e.var_id, 0.5e0 * adj.a / t * e.x FROM adj JOIN tot ON adj.i = tot.i JOIN fx_expr e ON adj.j = e.obs_id) u GROUP BY obs_id, var_id""")
def _(v):
    return smooth.smooth_expression(v.expr, laplacian_of(v), 0.5)


# updates of W and Q

LEDGES = f"{lap()}, u AS (SELECT i, j, greatest(-v, 0e0) AS weight FROM lap WHERE i < j), ledges AS (SELECT i, j, weight / (SELECT max(weight) FROM u) AS weight FROM u WHERE weight > 0)"
TV = f"{LEDGES}, tv AS (SELECT e.i, e.j, a.k, a.w - b.w AS diff, weight, weight / sqrt((a.w - b.w) * (a.w - b.w) + 1e-6) AS wt FROM ledges e JOIN fx_wc a ON e.i = a.obs_id JOIN fx_wc b ON e.j = b.obs_id AND a.k = b.k)"
TERMS = f"{TV}, terms AS (SELECT obs_id, k, sum(t) AS lw, sum(wt) AS d FROM (SELECT i AS obs_id, k, wt * diff AS t, wt FROM tv UNION ALL SELECT j, k, -wt * diff, wt FROM tv) s GROUP BY obs_id, k)"


def tv_edges(v: Views) -> DataFrame:
    return graph.edges_from_laplacian(laplacian_of(v))


def tv_of(v: Views) -> DataFrame:
    return updates.tv_weights(tv_edges(v), v.wc, 1e-6)


@register("tv_weights", f"WITH {TV} SELECT i, j, k, {r6('diff')} AS diff, {r6('wt')} AS wt FROM tv")
def _(v):
    return tv_of(v).select("i", "j", "k", "diff", "wt")


@register("tv_terms", f"WITH {TERMS} SELECT obs_id, k, {r6('lw')} AS lw, {r6('d')} AS d FROM terms")
def _(v):
    return updates.tv_row_terms(tv_edges(v), v.wc, 1e-6)


@register("tv_weight_stats", f"WITH {TV} SELECT {r6('min(wt)')} AS min_wt, {r6('max(wt)')} AS max_wt, {r6('avg(wt)')} AS mean_wt, {r6('max(wt / weight)')} AS max_ratio, {r6('avg(CASE WHEN wt / weight > 100 THEN 1e0 ELSE 0e0 END)')} AS clipped FROM tv")
def _(v):
    return updates.tv_weight_stats(tv_of(v), 100.0)


def w_step(spatial: str | None, alpha: float, l1: str | None, w: str = "fx_w") -> str:
    more_num, more_den, joins = "", "", ""
    if spatial:
        more_num, more_den = f" + {alpha}e0 * (coalesce(d, 0e0) * f.w - coalesce(lw, 0e0))", f" + {alpha}e0 * coalesce(d, 0e0) * f.w"
        joins += f" LEFT JOIN {spatial} s ON f.obs_id = s.obs_id AND f.k = s.k"
    if l1:
        more_den += " + l.lam"
        joins += f" JOIN {l1} l ON f.k = l.k"
    return f"""gram AS (SELECT a.k AS k1, b.k AS k2, sum(a.q * b.q) AS g FROM fx_q a JOIN fx_q b ON a.var_id = b.var_id GROUP BY a.k, b.k),
wg AS (SELECT obs_id, k2 AS k, sum(w * greatest(g, 0e0)) AS wgp, sum(w * greatest(-g, 0e0)) AS wgn FROM {w} JOIN gram ON k = k1 GROUP BY obs_id, k2),
xq AS (SELECT obs_id, k, sum(x * q) AS p FROM fx_expr e JOIN fx_q q ON e.var_id = q.var_id GROUP BY obs_id, k),
step AS (SELECT f.obs_id, f.k, f.w * sqrt(least(greatest((greatest(coalesce(p, 0e0), 0e0) + wgn{more_num}) / (greatest(-coalesce(p, 0e0), 0e0) + wgp + 1e-10{more_den}), 0e0), 1e6)) AS w
FROM {w} f JOIN wg ON f.obs_id = wg.obs_id AND f.k = wg.k LEFT JOIN xq ON f.obs_id = xq.obs_id AND f.k = xq.k{joins})"""


STEP = f"SELECT obs_id, k, {r6('w')} AS w FROM step"
L1 = "norms AS (SELECT k, sqrt(sum(w * w)) AS s FROM fx_w GROUP BY k), l1 AS (SELECT k, 0.3e0 * s / ((SELECT avg(s) FROM norms) + 1e-10) AS lam FROM norms)"
LTERMS = "lterms AS (SELECT p.obs_id, p.k, lw, v AS d FROM (SELECT l.i AS obs_id, w.k, sum(v * w) AS lw FROM lap l JOIN fx_w w ON l.j = w.obs_id GROUP BY l.i, w.k) p JOIN lap ON lap.i = p.obs_id AND lap.j = p.obs_id)"


@register("w_update_plain", f"WITH {w_step(None, 0, None)} {STEP}")
def _(v):
    return updates.update_w(v.expr, v.w, v.q)


@register("w_update_laplacian", f"WITH {lap()}, {LTERMS}, {L1}, {w_step('lterms', 0.3, 'l1')} {STEP}")
def _(v):
    return updates.update_w(v.expr, v.w, v.q, updates.laplacian_terms(laplacian_of(v), v.w), 0.3, updates.l1_weights(v.w, "w", 0.3))


@register("w_update_tv", f"WITH {TERMS}, {w_step('terms', 0.3, None, 'fx_wc')} {STEP}")
def _(v):
    return updates.update_w(v.expr, v.wc, v.q, updates.tv_row_terms(tv_edges(v), v.wc, 1e-6), 0.3)


@register("l1_weights_fixed", "SELECT DISTINCT k, 0.5e0 AS lambda FROM fx_w")
def _(v):
    return updates.l1_weights(v.w, "w", 0.5, "fixed")


for scale, sql in (("l2_norm", "sqrt(sum(w * w))"), ("mean_abs", "avg(abs(w))"), ("median_abs", "quantile_cont(abs(w), 0.5)")):

    @register(f"l1_weights_adaptive_{scale}", f"WITH s AS (SELECT k, {sql} AS s FROM fx_wc GROUP BY k) SELECT k, {r6('0.5e0 * s / ((SELECT avg(s) FROM s) + 1e-10)')} AS lambda FROM s")
    def _(v, scale=scale):
        return updates.l1_weights(v.wc, "w", 0.5, "adaptive", scale)


@register("scale_variation", f"WITH n AS (SELECT k, sqrt(sum(w * w)) AS a, avg(abs(w)) AS b, sum(abs(w)) AS c FROM fx_wc GROUP BY k) SELECT {r6('max(a) / greatest(min(a), 1e-10)')} AS l2_ratio, {r6('max(b) / greatest(min(b), 1e-10)')} AS mean_abs_ratio, {r6('max(c) / greatest(min(c), 1e-10)')} AS l1_ratio FROM n")
def _(v):
    return updates.scale_variation(v.wc, "w")


WTW = "SELECT a.k AS k1, b.k AS k2, sum(a.w * b.w) AS v FROM fx_w a JOIN fx_w b ON a.obs_id = b.obs_id GROUP BY a.k, b.k"
WTX = "SELECT k, var_id, sum(w * x) AS v FROM fx_expr e JOIN fx_w w ON e.obs_id = w.obs_id GROUP BY k, var_id"


@register("wtw", f"SELECT k1, k2, {r6('v')} AS v FROM ({WTW}) t")
def _(v):
    return updates.gram(v.w, "obs_id", "w")


@register("wtx", f"SELECT k, var_id, {r6('v')} AS v FROM ({WTX}) t")
def _(v):
    return updates.wtx(v.expr, v.w)


@register("q0_closed_form", f"""WITH g AS ({WTW}), x AS ({WTX}), c AS (SELECT var_id, sum(q * v) AS c FROM fx_q JOIN g ON k = k1 AND k2 = 0 WHERE k > 0 GROUP BY var_id)
SELECT b.var_id, {r6('(coalesce(x.v, 0e0) - coalesce(c.c, 0e0)) / ((SELECT v FROM g WHERE k1 = 0 AND k2 = 0) + 1e-10)')} AS q
FROM (SELECT var_id FROM fx_q WHERE k = 0) b LEFT JOIN x ON b.var_id = x.var_id AND x.k = 0 LEFT JOIN c ON b.var_id = c.var_id""")
def _(v):
    return updates.background_update(v.expr, v.w, v.q)


@register("q_gradient", f"""WITH g AS ({WTW}), x AS ({WTX}), qg AS (SELECT var_id, k2 AS k, sum(q * v) AS p FROM fx_q JOIN g ON k = k1 GROUP BY var_id, k2),
n AS (SELECT count(DISTINCT obs_id) AS n FROM fx_w), p AS (SELECT count(DISTINCT var_id) AS p FROM fx_q)
SELECT f.var_id, f.k, {r6('2 * (qg.p - coalesce(x.v, 0e0)) + CASE WHEN f.k > 0 THEN -2 * sqrt(2e0 * n.n * p.p) * greatest(-f.q, 0e0) ELSE 0e0 END')} AS g
FROM fx_q f JOIN qg ON f.var_id = qg.var_id AND f.k = qg.k LEFT JOIN x ON f.var_id = x.var_id AND f.k = x.k, n, p""")
def _(v):
    return updates.q_gradient(v.expr, v.w, v.q)


# preprocessing and samples


@register("qc_cells", 'SELECT o.obs_id, CAST(count_if(e.x > 0) AS BIGINT) AS "N_genes" FROM fx_obs o JOIN fx_expr e ON o.obs_id = e.obs_id GROUP BY o.obs_id HAVING count_if(e.x > 0) >= 24')
def _(v):
    return preprocess.filter_cells(v.expr, v.obs, 24).select("obs_id", "N_genes")


GENES = "SELECT var_id, CAST(count_if(x > 0) AS BIGINT) AS n_cells, sum(x) / (SELECT CAST(count(*) AS DOUBLE) FROM fx_obs) AS mean FROM fx_expr GROUP BY var_id"


@register("qc_genes", f"SELECT var_id, n_cells, {r6('mean')} AS mean FROM ({GENES}) t WHERE n_cells >= greatest(3, CAST(floor((SELECT count(*) FROM fx_obs) * 0.03e0) AS BIGINT)) AND mean >= 0.5e0")
def _(v):
    return preprocess.filter_genes(v.expr, v.obs.count(), 0.03, 0.5)


@register("abnormal_genes", "SELECT DISTINCT var_id FROM fx_expr WHERE x - 50 < 0 AND var_id % 7 = 0 AND x < 2")
def _(v):
    odd = F.when((F.col("var_id") % 7 == 0) & (F.col("x") < 2), F.lit(-1.0)).otherwise(F.col("x"))
    return preprocess.abnormal_genes(v.expr.withColumn("x", odd))


@register("normalize_total", f"SELECT obs_id, var_id, {r6('x * 1e4 / sum(x) OVER (PARTITION BY obs_id)')} AS x FROM fx_expr")
def _(v):
    return preprocess.normalize_total(v.expr)


@register("log1p", f"SELECT obs_id, var_id, {r6('ln(1 + x)')} AS x FROM fx_expr")
def _(v):
    return preprocess.log1p(v.expr)


@register("matrix_stats", f"WITH s AS (SELECT (SELECT count(*) FROM fx_obs) * (SELECT count(*) FROM fx_var) AS cells, count_if(x <> 0) AS n, min(x) AS lo, max(x) AS hi FROM fx_expr) SELECT {r6('100 * (1 - n / CAST(cells AS DOUBLE))')} AS sparsity, CASE WHEN n < cells THEN least(lo, 0e0) ELSE lo END AS min_x, CASE WHEN n < cells THEN greatest(hi, 0e0) ELSE hi END AS max_x FROM s")
def _(v):
    return preprocess.matrix_stats(v.expr, v.obs.count(), v.var.count())


@register("hvg_validation", f"SELECT var_id FROM ({GENES}) t WHERE mean >= 0 AND n_cells >= greatest(5, CAST(floor((SELECT count(*) FROM fx_obs) * 0.01e0) AS BIGINT))")
def _(v):
    return preprocess.validate_hvg(v.expr, v.obs.count(), v.var.select("var_id"))


@register("expand_genes", f"SELECT v.var_id, c.k, {r6('coalesce(q, 0e0)')} AS q FROM fx_var v CROSS JOIN (SELECT DISTINCT k FROM fx_q) c LEFT JOIN fx_q q ON v.var_id = q.var_id AND c.k = q.k")
def _(v):
    return preprocess.expand_genes(v.q, v.var)


NAMED = "SELECT o.obs_name, g.var_name, l.x, o.sample_id AS own FROM fx_expr l JOIN fx_obs o ON l.obs_id = o.obs_id JOIN fx_var g ON l.var_id = g.var_id"
#: All observations and genes in two parts: the samples up to the middle one by name, and the rest.
HALVES = "cut AS (SELECT sample_id AS middle FROM (SELECT sample_id, row_number() OVER (ORDER BY sample_id) AS nth, count(*) OVER () AS n FROM (SELECT DISTINCT sample_id FROM fx_obs) d) s WHERE nth = n // 2 + 1)"
PARTS = f"named AS ({NAMED}), {HALVES}, a AS (SELECT '0' AS sample_id, obs_name, var_name, x FROM named, cut WHERE own < middle), b AS (SELECT '1' AS sample_id, obs_name, var_name, x FROM named, cut WHERE own >= middle)"


def merged(v: Views, join: str) -> DataFrame:
    named = v.expr.join(v.obs.select("obs_id", "obs_name", "sample_id"), "obs_id").join(v.var, "var_id")
    ids = sorted(r["sample_id"] for r in v.obs.select("sample_id").distinct().collect())
    second = F.col("sample_id") >= F.lit(ids[len(ids) // 2])
    parts = [(named.where(own).select("obs_name", "var_name", "x"), v.obs.where(own).drop("sample_id")) for own in (~second, second)]
    return samples.merge_samples(parts, join)[0]


@register("merge_inner", f"WITH {PARTS}, g AS (SELECT var_name FROM a INTERSECT SELECT var_name FROM b) SELECT sample_id, obs_name, var_name, x FROM (SELECT * FROM a UNION ALL SELECT * FROM b) t WHERE var_name IN (SELECT var_name FROM g)")
def _(v):
    return merged(v, "inner")


@register("merge_outer", f"WITH {PARTS} SELECT * FROM a UNION ALL SELECT * FROM b")
def _(v):
    return merged(v, "outer")


@register("align_grid", f"""WITH box AS (SELECT sample_id, min(obs_id) AS first, min(x) AS x0, min(y) AS y0, max(x) - min(x) AS w, max(y) - min(y) AS h FROM fx_obs GROUP BY sample_id),
s AS (SELECT *, CASE WHEN w > 0 THEN 100 / w ELSE 1e0 END AS scale, row_number() OVER (ORDER BY first) - 1 AS nth FROM box),
o AS (SELECT *, nth // 5 AS r, coalesce(sum(w * scale + 20) OVER (PARTITION BY nth // 5 ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) AS ox FROM s),
t AS (SELECT r, coalesce(sum(max(h * scale) + 20) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) AS oy FROM o GROUP BY r)
SELECT p.obs_id, p.sample_id, {r6('(p.x - x0) * scale + ox')} AS ax, {r6('(p.y - y0) * scale + oy')} AS ay FROM fx_obs p JOIN o ON p.sample_id = o.sample_id JOIN t ON o.r = t.r""")
def _(v):
    return samples.align_grid(v.obs)


# matrices in blocks


@register("blocks_round_trip", "SELECT obs_id, var_id, x FROM fx_expr")
def _(v):
    return matrix.from_blocks(matrix.to_blocks(v.expr))


@register("blocks_xq", f"SELECT obs_id, k, {r6('sum(x * q)')} AS v FROM fx_expr e JOIN fx_q q ON e.var_id = q.var_id GROUP BY obs_id, k")
def _(v):
    return matrix.multiply(matrix.to_blocks(v.expr), matrix.dense_blocks(v.q, "var_id", "q"))


@register("blocks_lw", f"WITH {lap()} SELECT l.i AS i, w.k AS k, {r6('sum(v * w)')} AS lw FROM lap l JOIN fx_w w ON l.j = w.obs_id GROUP BY l.i, w.k")
def _(v):
    return matrix.multiply(matrix.to_blocks(laplacian_of(v), "i", "j", "v"), matrix.dense_blocks(v.w), "lw")
