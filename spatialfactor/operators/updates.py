"""Single steps of the factorisation X ~ W Q^T in long form: w (obs_id, k, w), q (var_id, k, q), expr (obs_id, var_id, x)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shipping import ship_package
from .order import quantiles


def pair_moments(factor: DataFrame, key: str, value: str) -> DataFrame:
    """(k1, k2, n, m1, m2, c, p) of each task for the pairs of components that rows have: the rows with both, the means of
    either over them, the sum of products of deviations from those and that of the products.

    A row of the factor goes to Python as one, and a task gives a row for each pair, whatever its rows; so nothing of the
    size of pairs times rows is made. Deviations are taken from values of the task, so they don't cancel.
    """
    ship_package(factor.sparkSession)
    rows = factor.groupBy(key).agg(F.collect_list(F.struct("k", F.col(value).cast("double").alias("v"))).alias("r")).select(F.col("r.k").alias("ks"), F.col("r.v").alias("vs"))

    def sums(batches):
        ks = np.empty(0, dtype=np.int64)
        shift = np.empty(0)
        n, s, p = (np.zeros((0, 0)) for _ in range(3))
        for batch in batches:
            size = np.diff(batch.column("ks").offsets.to_numpy())
            k, v = batch.column("ks").flatten().to_numpy(), batch.column("vs").flatten().to_numpy(zero_copy_only=False)
            new = np.setdiff1d(k, ks)
            if len(new):
                ks = np.concatenate((ks, new))
                shift = np.concatenate((shift, [v[k == one].mean() for one in new]))
                n, s, p = (np.pad(m, (0, len(new))) for m in (n, s, p))
            order = np.argsort(ks)
            column, row = order[np.searchsorted(ks[order], k)], np.repeat(np.arange(len(size)), size)
            held, known = np.zeros((len(size), len(ks))), np.zeros((len(size), len(ks)))
            np.add.at(held, (row, column), v - shift[column])
            known[row, column] = 1.0
            n, s, p = n + known.T @ known, s + held.T @ known, p + held.T @ held
        a, b = np.nonzero(n)
        m, s1, s2, c = n[a, b], s[a, b], s[b, a], p[a, b]
        m1, m2 = shift[a] + s1 / m, shift[b] + s2 / m
        c = c - s1 * s2 / m
        yield pa.RecordBatch.from_pydict({"k1": pa.array(ks[a], pa.int32()), "k2": pa.array(ks[b], pa.int32()), "n": m, "m1": m1, "m2": m2, "c": c, "p": c + m * m1 * m2})

    return rows.mapInArrow(sums, "k1 int, k2 int, n double, m1 double, m2 double, c double, p double")


def merged_moments(factor: DataFrame, key: str, value: str) -> DataFrame:
    """(k1, k2, n, c) over all rows: those with both components, and the sum of products of their deviations from the means."""
    whole = Window.partitionBy("k1", "k2")
    mean = lambda m: F.sum(F.col("n") * F.col(m)).over(whole) / F.sum("n").over(whole)
    # a row a task: differences of means first, products after
    between = F.col("n") * (F.col("m1") - mean("m1")) * (F.col("m2") - mean("m2"))
    return pair_moments(factor, key, value).withColumn("between", between).groupBy("k1", "k2").agg(F.sum("n").alias("n"), F.sum(F.col("c") + F.col("between")).alias("c"))


def gram(factor: DataFrame, key: str, value: str, out: str = "v") -> DataFrame:
    """(k1, k2, out): inner products of a factor's columns over its rows."""
    return pair_moments(factor, key, value).groupBy("k1", "k2").agg(F.sum("p").alias(out))


def wtx(expr: DataFrame, w: DataFrame) -> DataFrame:
    """(k, var_id, v): W^T X, from the entries that X has.

    An entry meets its observation's row of W as one, and a feature's sums over all components travel as one row.
    """
    ks = sorted(r["k"] for r in w.select("k").distinct().collect())
    if not ks:
        return expr.join(w, "obs_id").select("k", "var_id", F.lit(0.0).alias("v"))
    kind = w.schema["k"].dataType
    # what a row of W has no entry for stays null, so that no sum is made of it
    wide = w.groupBy("obs_id").agg(*[F.sum(F.when(F.col("k") == k, F.col("w"))).alias(f"w{i}") for i, k in enumerate(ks)])
    sums = expr.join(wide.hint("merge"), "obs_id").groupBy("var_id").agg(*[F.sum(F.col(f"w{i}") * F.col("x")).alias(f"v{i}") for i in range(len(ks))])
    each = F.explode(F.array(*[F.struct(F.lit(k).cast(kind).alias("k"), F.col(f"v{i}").alias("v")) for i, k in enumerate(ks)]))
    return sums.select("var_id", each.alias("e")).select("e.k", "var_id", "e.v").where("v IS NOT NULL")


def xq(expr: DataFrame, q: DataFrame) -> DataFrame:
    """(obs_id, k, v): X Q."""
    return expr.join(q, "var_id").groupBy("obs_id", "k").agg(F.sum(F.col("x") * F.col("q")).alias("v"))


def tv_weights(edges: DataFrame, w: DataFrame, eps: float = 1e-6) -> DataFrame:
    """(i, j, k, diff, weight, wt) of edges (i, j, weight): weight / sqrt((W_i - W_j)^2 + eps)."""
    left, right = w.select(F.col("obs_id").alias("i"), "k", F.col("w").alias("wi")), w.select(F.col("obs_id").alias("j"), "k", F.col("w").alias("wj"))
    diff = F.col("wi") - F.col("wj")
    return edges.join(left, "i").join(right, ["j", "k"]).select("i", "j", "k", diff.alias("diff"), "weight", (F.col("weight") / F.sqrt(diff * diff + F.lit(eps))).alias("wt"))


def tv_terms(weighted: DataFrame) -> DataFrame:
    """(obs_id, k, lw, d): E^T (wt * diff) and |E|^T wt."""
    ends = weighted.select("k", F.explode(F.array(F.struct(F.col("i").alias("obs_id"), (F.col("wt") * F.col("diff")).alias("t"), "wt"), F.struct(F.col("j").alias("obs_id"), (-F.col("wt") * F.col("diff")).alias("t"), "wt"))).alias("e"))
    return ends.groupBy("e.obs_id", "k").agg(F.sum("e.t").alias("lw"), F.sum("e.wt").alias("d"))


def tv_row_terms(edges: DataFrame, w: DataFrame, eps: float = 1e-6) -> DataFrame:
    """``tv_terms`` of ``tv_weights``, with an observation's row of W as one: edges go to either end with both rows, and what
    meets there is summed in place."""
    packed = lambda k, out: w.groupBy(F.col("obs_id").alias(k)).agg(F.map_from_entries(F.collect_list(F.struct("k", "w"))).alias(out))
    both = edges.select("i", "j", "weight").unionByName(edges.select(F.col("j").alias("i"), F.col("i").alias("j"), "weight"))
    met = both.join(packed("j", "other"), "j").select("i", "weight", "other").repartition("i").join(packed("i", "own"), "i")
    terms = met.select("i", "weight", "other", F.explode("own").alias("k", "w")).withColumn("diff", F.col("w") - F.try_element_at("other", F.col("k"))).where("diff IS NOT NULL")
    wt = F.col("weight") / F.sqrt(F.col("diff") * F.col("diff") + F.lit(eps))
    return terms.groupBy(F.col("i").alias("obs_id"), "k").agg(F.sum(wt * F.col("diff")).alias("lw"), F.sum(wt).alias("d"))


def tv_weight_stats(weighted: DataFrame, clip: float = 1000.0) -> DataFrame:
    """Extremes and mean of the weights, their largest ratio to the edge weights, and the share above ``clip`` times."""
    ratio = F.col("wt") / F.col("weight")
    return weighted.agg(F.min("wt").alias("min_wt"), F.max("wt").alias("max_wt"), F.avg("wt").alias("mean_wt"), F.max(ratio).alias("max_ratio"), F.avg(F.when(ratio > clip, 1.0).otherwise(0.0)).alias("clipped"))


def laplacian_terms(lap: DataFrame, w: DataFrame) -> DataFrame:
    """(obs_id, k, lw, d): L W and the diagonal of L."""
    # an observation's row of W travels as one array; entries that meet at i stay there
    packed = w.groupBy(F.col("obs_id").alias("j")).agg(F.collect_list(F.struct("k", "w")).alias("row"))
    met = lap.join(packed, "j").select("i", "j", "v", "row").repartition("i").select("i", "j", "v", F.explode("row").alias("e"))
    own = F.max(F.when(F.col("i") == F.col("j"), F.col("v")))
    return met.groupBy(F.col("i").alias("obs_id"), F.col("e.k").alias("k")).agg(F.sum(F.col("v") * F.col("e.w")).alias("lw"), own.alias("d"))


def update_w(expr: DataFrame, w: DataFrame, q: DataFrame, spatial: DataFrame | None = None, alpha: float = 0.0, l1: DataFrame | None = None) -> DataFrame:
    """One multiplicative step of W with Q fixed.

    ``spatial`` holds (obs_id, k, lw, d), ``l1`` (k, lambda). w * sqrt(clip(num / den, 0, 1e6)) with the positive and
    negative parts of X Q and Q^T Q; an observation without spatial terms has none, a step that is not finite leaves w.
    """
    g = gram(q, "var_id", "q")
    signs = g.select("k1", "k2", F.greatest("v", F.lit(0.0)).alias("gp"), F.greatest(-F.col("v"), F.lit(0.0)).alias("gn"))
    wg = w.join(F.broadcast(signs), w["k"] == signs["k1"]).groupBy("obs_id", F.col("k2").alias("k")).agg(F.sum(F.col("w") * F.col("gp")).alias("wgp"), F.sum(F.col("w") * F.col("gn")).alias("wgn"))
    rows = w.join(wg, ["obs_id", "k"]).join(xq(expr, q), ["obs_id", "k"], "left").withColumn("v", F.coalesce("v", F.lit(0.0)))
    num = F.greatest("v", F.lit(0.0)) + F.col("wgn")
    den = F.greatest(-F.col("v"), F.lit(0.0)) + F.col("wgp") + F.lit(1e-10)
    if spatial is not None:
        rows = rows.join(spatial, ["obs_id", "k"], "left").withColumn("lw", F.coalesce("lw", F.lit(0.0))).withColumn("d", F.coalesce("d", F.lit(0.0)))
        num = num + F.lit(float(alpha)) * (F.col("d") * F.col("w") - F.col("lw"))
        den = den + F.lit(float(alpha)) * F.col("d") * F.col("w")
    if l1 is not None:
        rows = rows.join(F.broadcast(l1), "k")
        den = den + F.col("lambda")
    ratio = F.least(F.greatest(num / den, F.lit(0.0)), F.lit(1e6))
    new = F.col("w") * F.sqrt(ratio)
    return rows.select("obs_id", "k", F.when(F.isnan(new) | new.isNull() | (F.abs(new) == float("inf")), F.col("w")).otherwise(new).alias("w"))


def l1_weights(factor: DataFrame, value: str, base: float, strategy: str = "adaptive", scale: str = "l2_norm") -> DataFrame:
    """(k, lambda): the base for all columns, or base * scale / (mean scale + 1e-10)."""
    if strategy == "fixed":
        return factor.select("k").distinct().select("k", F.lit(float(base)).alias("lambda"))
    if strategy != "adaptive":
        raise ValueError(f"unknown strategy: {strategy}")
    v = F.col(value)
    by = {"l2_norm": F.sqrt(F.sum(v * v)), "mean_abs": F.avg(F.abs(v))}
    if scale == "median_abs":
        scales = quantiles(factor, ["k"], F.abs(v), [0.5]).select("k", F.col("quantile").alias("s"))
    elif scale in by:
        scales = factor.groupBy("k").agg(by[scale].alias("s"))
    else:
        raise ValueError(f"unknown scale: {scale}")
    return scales.join(F.broadcast(scales.agg(F.avg("s").alias("mean")))).select("k", (F.lit(float(base)) * F.col("s") / (F.col("mean") + F.lit(1e-10))).alias("lambda"))


def scale_variation(factor: DataFrame, value: str) -> DataFrame:
    """Largest over smallest column norm: L2, mean absolute value, L1."""
    v = F.col(value)
    norms = factor.groupBy("k").agg(F.sqrt(F.sum(v * v)).alias("l2"), F.avg(F.abs(v)).alias("mean_abs"), F.sum(F.abs(v)).alias("l1"))
    return norms.agg(*[(F.max(c) / F.greatest(F.min(c), F.lit(1e-10))).alias(f"{c}_ratio") for c in ("l2", "mean_abs", "l1")])


def background_update(expr: DataFrame, w: DataFrame, q: DataFrame) -> DataFrame:
    """(var_id, q): the background column (X^T w0 - Q_s W_s^T w0) / (|w0|^2 + 1e-10), other columns fixed."""
    g = gram(w, "obs_id", "w").where("k2 = 0")
    x0 = wtx(expr, w.where("k = 0")).select("var_id", "v")
    cross = q.where("k > 0").join(F.broadcast(g), q["k"] == F.col("k1")).groupBy("var_id").agg(F.sum(F.col("q") * F.col("v")).alias("c"))
    norm = g.where("k1 = 0").select(F.col("v").alias("norm"))
    base = q.where("k = 0").select("var_id").join(x0, "var_id", "left").join(cross, "var_id", "left").join(F.broadcast(norm))
    return base.select("var_id", ((F.coalesce("v", F.lit(0.0)) - F.coalesce("c", F.lit(0.0))) / (F.col("norm") + F.lit(1e-10))).alias("q"))


def q_gradient(expr: DataFrame, w: DataFrame, q: DataFrame, lambda_neg: float = 1.0, l1: DataFrame | None = None, delta: float = 0.1) -> DataFrame:
    """(var_id, k, g): 2 (Q W^T W - X^T W), and for signals the negativity and Huber terms.

    Scales: sqrt(2 n p) for negativity and 2 sqrt(n) for the l1 weights (k, lambda).
    """
    n, p = w.select("obs_id").distinct().count(), q.select("var_id").distinct().count()
    g = gram(w, "obs_id", "w")
    qg = q.join(F.broadcast(g), q["k"] == g["k1"]).groupBy("var_id", F.col("k2").alias("k")).agg(F.sum(F.col("q") * F.col("v")).alias("qg"))
    rows = q.join(qg, ["var_id", "k"]).join(wtx(expr, w), ["var_id", "k"], "left")
    rows = rows.join(F.broadcast(l1), "k", "left") if l1 is not None else rows.withColumn("lambda", F.lit(0.0))
    fit = F.lit(2.0) * (F.col("qg") - F.coalesce("v", F.lit(0.0)))
    negative = F.lit(-2.0 * lambda_neg * (2.0 * n * p) ** 0.5) * F.greatest(-F.col("q"), F.lit(0.0))
    sparse = F.coalesce("lambda", F.lit(0.0)) * F.lit(2.0 * n**0.5) * F.greatest(F.least("q", F.lit(delta)), F.lit(-delta))
    return rows.select("var_id", "k", (fit + F.when(F.col("k") > 0, negative + sparse).otherwise(F.lit(0.0))).alias("g"))
