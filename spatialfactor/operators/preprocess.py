"""Quality control, normalisation and gene selection of a measurement matrix (obs_id, var_id, x); absent entries are 0."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shipping import ship_package


def filter_cells(expr: DataFrame, obs: DataFrame, min_genes: int = 200) -> DataFrame:
    """Observations with at least ``min_genes`` positive entries, with N_genes; an existing N_genes column is used."""
    if "N_genes" not in obs.columns:
        counts = expr.groupBy("obs_id").agg(F.count_if(F.col("x") > 0).alias("N_genes"))
        obs = obs.join(counts, "obs_id", "left").withColumn("N_genes", F.coalesce("N_genes", F.lit(0)))
    return obs.where(F.col("N_genes") >= min_genes) if min_genes > 0 else obs


def gene_stats(expr: DataFrame, n_obs: int) -> DataFrame:
    """(var_id, n_cells, mean): positive entries and the mean over all observations."""
    return expr.groupBy("var_id").agg(F.count_if(F.col("x") > 0).alias("n_cells"), (F.sum("x") / F.lit(float(n_obs))).alias("mean"))


def filter_genes(expr: DataFrame, n_obs: int, min_cells_pct: float = 0.01, min_mean: float = 0.0) -> DataFrame:
    """Genes positive in at least max(3, int(n * pct)) observations and with the mean wanted, if one is."""
    least = max(3, int(n_obs * min_cells_pct))
    kept = gene_stats(expr, n_obs).where(F.col("n_cells") >= least)
    return kept.where(F.col("mean") >= min_mean) if min_mean > 0 else kept


def abnormal_genes(expr: DataFrame) -> DataFrame:
    """Genes with a NaN, infinite or negative entry."""
    odd = F.isnan("x") | (F.abs("x") == float("inf")) | (F.col("x") < 0)
    return expr.groupBy("var_id").agg(F.bool_or(odd).alias("odd")).where("odd").select("var_id")


def normalize_total(expr: DataFrame, target: float = 1e4) -> DataFrame:
    """Entries scaled so that each observation sums to the target; one that sums to 0 stays."""
    total = F.sum("x").over(Window.partitionBy("obs_id"))
    return expr.withColumn("x", F.coalesce(F.try_divide(F.col("x") * F.lit(target), total), F.col("x")))


def log1p(expr: DataFrame) -> DataFrame:
    return expr.withColumn("x", F.log1p("x"))


def clean(expr: DataFrame) -> DataFrame:
    """NaN and infinite entries become 0, that is, go."""
    return expr.where(~F.isnan("x") & (F.abs("x") != float("inf")) & (F.col("x") != 0))


def matrix_stats(expr: DataFrame, n_obs: int, n_var: int) -> DataFrame:
    """Share of zeros in percent, least and greatest entry."""
    cells = float(n_obs * n_var)
    one = expr.agg(F.count_if(F.col("x") != 0).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    gap = F.col("n") < F.lit(cells)
    return one.select(
        (F.lit(100.0) * (F.lit(1.0) - F.col("n") / F.lit(cells))).alias("sparsity"),
        F.when(gap, F.least("lo", F.lit(0.0))).otherwise(F.col("lo")).alias("min_x"),
        F.when(gap, F.greatest("hi", F.lit(0.0))).otherwise(F.col("hi")).alias("max_x"),
    )


def highly_variable(expr: DataFrame, obs: DataFrame, n_top: int = 2000, span: float = 0.3) -> DataFrame:
    """(var_id, rank, highly_variable) by the variance of standardised, clipped entries, batch by batch.

    Per sample (all rows are one where there is no sample_id): a local quadratic fit of log10 variance on log10 mean over
    the genes, in one task for a sample (three numbers a gene), gives the expected deviation; entries standardised by it are clipped at sqrt(n) and their variance ranks the
    genes. Genes are ordered by the number of samples in which they rank among the top, then by the median rank.
    """
    if "sample_id" not in obs.columns:
        obs = obs.withColumn("sample_id", F.lit("all"))
    sizes = obs.groupBy("sample_id").agg(F.count("*").alias("n"))
    at = expr.join(obs.select("obs_id", "sample_id"), "obs_id")
    moments = at.groupBy("sample_id", "var_id").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("ss")).join(F.broadcast(sizes), "sample_id")
    moments = moments.select("sample_id", "var_id", "n", (F.col("s") / F.col("n")).alias("mean"), F.greatest((F.col("ss") - F.col("s") * F.col("s") / F.col("n")) / F.greatest(F.col("n") - 1, F.lit(1)), F.lit(0.0)).alias("var"))
    ship_package(expr.sparkSession)

    def deviations(frame):
        import numpy as np

        frame = frame.sort_values("var_id")
        ok = ((frame["var"] > 0) & (frame["mean"] > 0)).to_numpy()
        expected = np.zeros(len(frame))
        if ok.sum() > 3:
            expected[ok] = 10 ** local_quadratic(np.log10(frame["mean"].to_numpy()[ok]), np.log10(frame["var"].to_numpy()[ok]), span)
        frame = frame.assign(sd=np.sqrt(expected), top=np.sqrt(frame["n"].astype(float)))
        return frame.loc[expected > 0, ["sample_id", "var_id", "mean", "sd", "top", "n"]]

    # a group is a sample's genes, one row each
    table = moments.withColumn("sample_id", F.col("sample_id").cast("string")).groupBy("sample_id").applyInPandas(deviations, "sample_id string, var_id bigint, mean double, sd double, top double, n bigint")
    at = at.withColumn("sample_id", F.col("sample_id").cast("string"))
    clipped = F.least("x", F.col("mean") + F.col("sd") * F.col("top"))
    sums = at.join(table, ["sample_id", "var_id"]).groupBy("sample_id", "var_id", "mean", "sd", "n").agg(F.sum(clipped).alias("s"), F.sum(clipped * clipped).alias("ss"))
    score = (F.col("n") * F.col("mean") ** 2 + F.col("ss") - 2 * F.col("s") * F.col("mean")) / (F.greatest(F.col("n") - 1, F.lit(1)) * F.col("sd") ** 2)
    ranked = sums.withColumn("score", score).withColumn("rank", F.row_number().over(Window.partitionBy("sample_id").orderBy(F.col("score").desc(), "var_id")))
    per_gene = ranked.groupBy("var_id").agg(F.count_if(F.col("rank") <= n_top).alias("samples"), F.expr("percentile(rank, 0.5)").alias("median_rank"))
    order = Window.orderBy(F.col("samples").desc(), "median_rank", "var_id")
    return per_gene.withColumn("rank", F.row_number().over(order)).select("var_id", "rank", (F.col("rank") <= n_top).alias("highly_variable"))


#: Up to so many points each fit goes over its points; of more, over sums of leaves and of what a tree makes of them.
DIRECT_POINTS, LEAF = 2_000, 32


def local_quadratic(x, y, span: float):
    """Tricube-weighted quadratic fit around each point, over the nearest ``span`` of the points."""
    import numpy as np

    k = min(max(4, int(np.ceil(span * len(x)))), len(x))
    if len(x) > DIRECT_POINTS:
        return _quadratic_by_sums(np.asarray(x, dtype=float), np.asarray(y, dtype=float), k)
    return np.asarray([_quadratic_at(x, y, c, k) for c in x])


def _quadratic_at(x, y, c: float, k: int) -> float:
    import numpy as np

    d = np.abs(x - c)
    near = np.argpartition(d, k - 1)[:k]
    h = d[near].max() or 1.0
    sw = np.sqrt(np.maximum((1 - (d[near] / h) ** 3) ** 3, 1e-9))
    a = np.vander(x[near] - c, 3)
    return np.linalg.lstsq(a * sw[:, None], y[near] * sw, rcond=None)[0][2]


def _quadratic_by_sums(x, y, k: int, chunk: int = 1 << 13):
    """``local_quadratic`` of n points in n log n steps.

    The k nearest of a point are neighbours in the order of x, and left and right of it the tricube weight is a polynomial in
    the distance; so sums of powers of the distance, to the 13th, give the fit. Leaves of 32 points and the nodes of a binary
    tree over them hold such sums about their own middle, in units of their own radius, and are carried to the point in units
    of its window. All of these are at most 1, so nothing cancels. Leaves at the window's ends and around the point are gone
    over one by one. Where the sums leave the fit undetermined, as with few different x, it is made from the points.
    """
    from math import comb

    import numpy as np

    n, order = len(x), np.argsort(x, kind="stable")
    xs, ys = x[order], y[order]
    padded = -(-n // LEAF) * LEAF
    px, py, real = (np.concatenate((v, np.full(padded - n, fill))) for v, fill in ((xs, xs[-1]), (ys, 0.0), (np.ones(n), 0.0)))
    powers = np.arange(14)
    carry = np.asarray([[comb(m, j) if j <= m else 0 for j in range(14)] for m in range(14)], dtype=float)

    def carried(sums, scale, shift):
        """Sums of powers about another middle: scale and shift are the old radius and the way between, in the new unit."""
        scaled, ways = sums * (scale[:, None] ** powers)[:, None, :], shift[:, None] ** powers
        out = np.zeros_like(sums)
        for m in range(14):
            out[:, :, m] = np.einsum("nsj,nj->ns", scaled[:, :, : m + 1], ways[:, m::-1] * carry[m, : m + 1])
        return out

    leaf_x = px.reshape(-1, LEAF)
    low, high = leaf_x[:, 0], leaf_x[:, -1]
    middle, radius = [(low + high) / 2], [np.maximum((high - low) / 2, 1e-300)]
    each = ((leaf_x - middle[0][:, None]) / radius[0][:, None])[:, :, None] ** powers
    weights = np.stack((real.reshape(-1, LEAF), (real * py).reshape(-1, LEAF)), axis=1)
    levels = [np.einsum("nsp,npm->nsm", weights, each)]
    del each
    while len(levels[-1]) > 1:
        below, mid, rad = levels[-1], middle[-1], radius[-1]
        if len(below) % 2:
            below, mid, rad = np.concatenate((below, np.zeros((1, 2, 14)))), np.append(mid, mid[-1]), np.append(rad, rad[-1])
        left, right = mid[0::2] - rad[0::2], mid[1::2] + rad[1::2]
        center, size = (left + right) / 2, np.maximum((right - left) / 2, 1e-300)
        levels.append(sum(carried(below[i::2], rad[i::2] / size, (mid[i::2] - center) / size) for i in (0, 1)))
        middle.append(center)
        radius.append(size)

    out = np.empty(n)
    for first in range(0, n, chunk):
        at = np.arange(first, min(n, first + chunk))
        c = xs[at]
        # the window starts where its next point is no nearer than its first
        lo, top = np.maximum(at - k + 1, 0), np.minimum(at, n - k)
        while (lo < top).any():
            half = (lo + top) // 2
            on = (lo < top) & (c - xs[half] > xs[np.minimum(half + k, n - 1)] - c)
            lo, top = np.where(on, half + 1, lo), np.where(on | (lo >= top), top, half)
        hi = lo + k
        h = np.maximum(c - xs[lo], xs[hi - 1] - c)
        h[h == 0] = 1.0
        sums = np.zeros((2, len(at), 2, 14))
        moments, products = np.zeros((len(at), 5)), np.zeros((len(at), 3))
        ends = np.stack((lo // LEAF, at // LEAF, (hi - 1) // LEAF))
        for e in range(3):
            fresh = np.flatnonzero(np.all(ends[e] != ends[:e], axis=0)) if e else np.arange(len(at))
            place = ends[e][fresh][:, None] * LEAF + np.arange(LEAF)
            u = (px[place] - c[fresh, None]) / h[fresh, None]
            w = np.maximum((1 - np.abs(u) ** 3) ** 3, 1e-9) * ((place >= lo[fresh, None]) & (place < hi[fresh, None]))
            for m in range(5):
                moments[fresh, m] += (w * u**m).sum(axis=1)
                if m < 3:
                    products[fresh, m] += (w * u**m * py[place]).sum(axis=1)
        for side in (0, 1):
            a, b = ends[side] + 1, ends[side + 1].copy()
            for level, (nodes, mid, rad) in enumerate(zip(levels, middle, radius, strict=True)):
                for odd, node in ((a, 0), (b, -1)):
                    take = np.flatnonzero((a < b) & (odd % 2 == 1))
                    if len(take):
                        chosen = odd[take] + node
                        sums[side, take] += carried(nodes[chosen], rad[chosen] / h[take], (mid[chosen] - c[take]) / h[take])
                        odd[take] += 1 if node == 0 else -1
                a, b = a // 2, b // 2
                if not (a < b).any():
                    break
        for side, sign in ((0, 1.0), (1, -1.0)):
            tricube = lambda t, m, s=sign: t[:, m] + 3 * s * t[:, m + 3] + 3 * t[:, m + 6] + s * t[:, m + 9]
            for m in range(5):
                moments[:, m] += tricube(sums[side, :, 0], m)
                if m < 3:
                    products[:, m] += tricube(sums[side, :, 1], m)
        a0, a1, a2, a3, a4 = moments.T / moments[:, 0]
        b0, b1, b2 = products.T / moments[:, 0]
        found = a0 * (a2 * a4 - a3 * a3) - a1 * (a1 * a4 - a2 * a3) + a2 * (a1 * a3 - a2 * a2)
        with np.errstate(divide="ignore", invalid="ignore"):
            fit = (b0 * (a2 * a4 - a3 * a3) - a1 * (b1 * a4 - b2 * a3) + a2 * (b1 * a3 - b2 * a2)) / found
        open_ = {v: _quadratic_at(xs, ys, v, k) for v in np.unique(c[~(found > 1e-9 * a2 * a4)])}
        out[order[at]] = [open_.get(v, f) for v, f in zip(c, fit, strict=True)] if open_ else fit
    return out


def validate_hvg(expr: DataFrame, n_obs: int, chosen: DataFrame) -> DataFrame:
    """Chosen genes (var_id) with a mean of 0 or more that max(5, int(n * 0.01)) observations or more express."""
    stats = gene_stats(expr, n_obs).where((F.col("mean") >= 0) & (F.col("n_cells") >= max(5, int(n_obs * 0.01))))
    return chosen.join(stats.select("var_id"), "var_id", "left_semi")


def mask_genes(expr: DataFrame, chosen: DataFrame) -> DataFrame:
    return expr.join(chosen.select("var_id"), "var_id", "left_semi")


def expand_genes(q: DataFrame, var: DataFrame) -> DataFrame:
    """Q over all genes: 0 for those that were masked."""
    every = var.select("var_id").crossJoin(F.broadcast(q.select("k").distinct()))
    return every.join(q, ["var_id", "k"], "left").select("var_id", "k", F.coalesce("q", F.lit(0.0)).alias("q"))


def standard_preprocess(expr: DataFrame, obs: DataFrame, min_genes: int = 200, min_cells_pct: float = 0.01, min_mean: float = 0.0, target: float | None = 1e4, log: bool = True, n_top: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Cell QC, gene QC, abnormal genes, normalise, log1p, gene selection, cleaning, in this order: (expr, obs)."""
    obs = filter_cells(expr, obs, min_genes)
    expr = expr.join(obs.select("obs_id"), "obs_id", "left_semi")
    n = obs.count()
    expr = expr.join(filter_genes(expr, n, min_cells_pct, min_mean).select("var_id"), "var_id", "left_semi")
    expr = expr.join(abnormal_genes(expr), "var_id", "left_anti")
    expr = normalize_total(expr, target) if target else expr
    expr = log1p(expr) if log else expr
    if n_top:
        chosen = highly_variable(expr, obs, n_top).where("highly_variable")
        expr = mask_genes(expr, validate_hvg(expr, n, chosen))
    return clean(expr), obs
