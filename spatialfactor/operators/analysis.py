"""Queries on fitted factors: rankings, errors, correlations, quality and scaling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import written
from .order import average_rank
from .updates import gram, merged_moments, wtx, xq

#: Features whose rows of Q are sent to all tasks.
SENT_FEATURES = 200_000
SCORES = {"abs": lambda q: F.abs(q), "positive": lambda q: q, "negative": lambda q: -q}


def rank_genes(q: DataFrame, n: int = 100, criterion: str = "abs") -> DataFrame:
    """(k, var_id, score, abs_score, rank): the top genes of each component, ties to the larger id."""
    if criterion not in SCORES:
        raise ValueError(f"unknown criterion: {criterion}")
    score = SCORES[criterion](F.col("q"))
    order = Window.partitionBy("k").orderBy(score.desc(), F.col("var_id").desc())
    return q.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select("k", "var_id", F.col("q").alias("score"), F.abs("q").alias("abs_score"), "rank")


def top_genes(q: DataFrame, component: int | str, n: int = 50, criterion: str = "abs") -> DataFrame:
    """The top genes of one component, by number or by name (Background, Signal_1, ...)."""
    if isinstance(component, str):
        names = {"Background": 0}
        if component not in names and not (component.startswith("Signal_") and component[7:].isdigit() and int(component[7:]) > 0):
            raise ValueError(f"unknown component: {component}")
        component = names.get(component, int(component[7:] or 0) if component.startswith("Signal_") else 0)
    one = q.where(F.col("k") == component)
    if one.isEmpty():
        raise ValueError(f"component {component} is out of range")
    return rank_genes(one, n, criterion).drop("k")


def background(factor: DataFrame) -> DataFrame:
    return factor.where("k = 0")


def signals(factor: DataFrame) -> DataFrame:
    return factor.where("k > 0")


def reconstruction_error(expr: DataFrame, w: DataFrame, q: DataFrame, by: str | None = None) -> DataFrame:
    """Relative Frobenius error over all, by "gene" or by "obs", without forming W Q^T.

    |X|^2 - 2 <X, W Q^T> + <W Q^T, W Q^T>: the cross term is that of a factor with its product with X, which has a row of
    components a feature or observation, the last is a quadratic form in a Gram matrix.
    """
    if by is None:
        xx = expr.agg(F.sum(F.col("x") * F.col("x")).alias("xx"))
        xr = wtx(expr, w).join(q, ["var_id", "k"]).agg(F.sum(F.col("v") * F.col("q")).alias("xr"))
        rr = gram(w, "obs_id", "w").join(gram(q, "var_id", "q", "u"), ["k1", "k2"]).agg(F.sum(F.col("v") * F.col("u")).alias("rr"))
        return xx.join(F.broadcast(xr)).join(F.broadcast(rr)).select((F.sqrt(F.greatest(F.col("xx") - 2 * F.col("xr") + F.col("rr"), F.lit(0.0))) / (F.sqrt("xx") + F.lit(1e-10))).alias("error"))
    if by not in ("gene", "obs"):
        raise ValueError(f"by must be gene, obs or nothing, not {by}")
    key, factor, value, g = ("var_id", q, "q", gram(w, "obs_id", "w")) if by == "gene" else ("obs_id", w, "w", gram(q, "var_id", "q"))
    xx = expr.groupBy(key).agg(F.sum(F.col("x") * F.col("x")).alias("xx"))
    product = wtx(expr, w) if by == "gene" else xq(expr, q)
    xr = product.withColumnRenamed("v", "p").join(factor, [key, "k"]).groupBy(key).agg(F.sum(F.col("p") * F.col(value)).alias("xr"))
    half = factor.join(F.broadcast(g), factor["k"] == g["k1"]).groupBy(key, F.col("k2").alias("k")).agg(F.sum(F.col(value) * F.col("v")).alias("h"))
    rr = half.join(factor, [key, "k"]).groupBy(key).agg(F.sum(F.col("h") * F.col(value)).alias("rr"))
    rows = rr.join(xx, key, "left").join(xr, key, "left").na.fill(0.0, ["xx", "xr"])
    return rows.select(key, (F.sqrt(F.greatest(F.col("xx") - 2 * F.col("xr") + F.col("rr"), F.lit(0.0))) / (F.sqrt("xx") + F.lit(1e-10))).alias("error"))


def relative_error_sampled(expr: DataFrame, w: DataFrame, q: DataFrame, sample: int, seed: int = 0) -> DataFrame:
    """The total error over about ``sample`` observations, chosen by a hash of the id and the seed."""
    n = w.select("obs_id").distinct().count()
    chosen = w.where(F.pmod(F.xxhash64("obs_id", F.lit(seed)), F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, sample / max(n, 1)))))
    return reconstruction_error(expr.join(chosen.select("obs_id").distinct(), "obs_id", "left_semi"), chosen, q)


def correlate(w: DataFrame, obs: DataFrame, keys: list[str], method: str = "pearson") -> DataFrame:
    """(k, key, correlation) of components with numeric columns of the observations; constant ones are left out."""
    numeric = [f.name for f in obs.schema if f.dataType.typeName() in ("double", "float", "integer", "long", "short", "byte", "decimal")]
    keys = [k for k in keys if k in numeric]
    if not keys:
        raise ValueError("no numeric column to correlate with")
    if method not in ("pearson", "spearman"):
        raise ValueError(f"unknown method: {method}")
    long = obs.select("obs_id", F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("double").alias("value")) for k in keys])).alias("c")).select("obs_id", "c.key", "c.value")
    rows = w.join(long.where("value IS NOT NULL"), "obs_id")
    a, b = "w", "value"
    if method == "spearman":
        rows = written(rows.select("k", "key", "w", "value"), "correlated")
        rows = written(average_rank(rows, "w", ["k", "key"], "rw"), "correlated")
        rows = average_rank(rows, "value", ["k", "key"], "rv")
        a, b = "rw", "rv"
    return rows.groupBy("k", "key").agg(F.stddev_pop(a).alias("sa"), F.stddev_pop(b).alias("sb"), F.corr(a, b).alias("correlation")).where("sa >= 1e-10 AND sb >= 1e-10").select("k", "key", "correlation")


def orthogonality(factor: DataFrame, key: str, value: str) -> DataFrame:
    """Frobenius distance of the Gram matrix of the L2-normalised signals from the identity."""
    g = gram(factor.where("k > 0"), key, value)
    d = g.where("k1 = k2").select(F.col("k1").alias("k"), F.when(F.col("v") > 0, F.sqrt("v")).otherwise(F.lit(1.0)).alias("n"))
    both = g.join(F.broadcast(d.select(F.col("k").alias("k1"), F.col("n").alias("n1"))), "k1").join(F.broadcast(d.select(F.col("k").alias("k2"), F.col("n").alias("n2"))), "k2")
    off = F.col("v") / (F.col("n1") * F.col("n2")) - F.when(F.col("k1") == F.col("k2"), 1.0).otherwise(0.0)
    return both.agg(F.sqrt(F.sum(off * off)).alias("orthogonality"))


def sparsity(factor: DataFrame, value: str, threshold: float = 1e-3) -> DataFrame:
    """(k, n_below, sparsity): entries below the threshold in absolute value, and their share."""
    below = F.abs(value) < threshold
    return factor.groupBy("k").agg(F.count_if(below).alias("n_below"), F.avg(F.when(below, 1.0).otherwise(0.0)).alias("sparsity"))


def component_correlation(w: DataFrame) -> DataFrame:
    """(k1, k2, r): Pearson correlations of the components' columns."""
    c = merged_moments(w, "obs_id", "w")
    # of complete rows; a component without variance has no correlations
    own = F.when(F.col("k1") == F.col("k2"), F.col("c"))
    met = c.withColumn("c1", F.max(own).over(Window.partitionBy("k1"))).withColumn("c2", F.max(own).over(Window.partitionBy("k2")))
    root = F.sqrt("c1") * F.sqrt("c2")
    return met.select("k1", "k2", F.when(root > 0, F.greatest(F.least(F.col("c") / root, F.lit(1.0)), F.lit(-1.0))).alias("r"))


def column_norms(factor: DataFrame, value: str, out: str) -> DataFrame:
    """(k, out): L2 norms, 1 for a column of zeros."""
    n = F.sqrt(F.sum(F.col(value) * F.col(value)))
    return factor.groupBy("k").agg(F.when(n > 0, n).otherwise(F.lit(1.0)).alias(out))


def normalize_q_scale_w(w: DataFrame, q: DataFrame) -> tuple[DataFrame, DataFrame]:
    """W and Q with unit columns in Q and the norms moved to W; their product is unchanged."""
    norms = F.broadcast(column_norms(q, "q", "n"))
    return w.join(norms, "k").select("obs_id", "k", (F.col("w") * F.col("n")).alias("w")), q.join(norms, "k").select("var_id", "k", (F.col("q") / F.col("n")).alias("q"))


def normalize_components(w: DataFrame, q: DataFrame, mode: str = "both") -> tuple[DataFrame, DataFrame]:
    """Scale columns so that Q, or W, has unit norm, or both have sqrt(|w| |q|)."""
    if mode == "Q":
        return normalize_q_scale_w(w, q)
    if mode not in ("W", "both"):
        raise ValueError(f"mode must be Q, W or both, not {mode}")
    norms = F.broadcast(column_norms(w, "w", "wn").join(column_norms(q, "q", "qn"), "k"))
    up = F.col("wn") if mode == "W" else F.sqrt(F.col("wn") / F.col("qn"))
    return w.join(norms, "k").select("obs_id", "k", (F.col("w") / up).alias("w")), q.join(norms, "k").select("var_id", "k", (F.col("q") * up).alias("q"))


def reconstruct(w: DataFrame, q: DataFrame, rows: DataFrame | None = None, genes: DataFrame | None = None) -> DataFrame:
    """(obs_id, var_id, x): a slice of W Q^T, absent entries of the factors being 0.

    A row of either factor travels as one row with a column a component, so nothing is shuffled but the factors; the rows
    of Q, features by components, go to all tasks where they are at most ``SENT_FEATURES``.
    """
    w = w if rows is None else w.join(rows.select("obs_id").distinct(), "obs_id", "left_semi")
    q = q if genes is None else q.join(genes.select("var_id").distinct(), "var_id", "left_semi")
    ks = sorted(r["k"] for r in q.select("k").distinct().collect())
    wide = lambda f, key, value: f.groupBy(key).agg(*[F.coalesce(F.max(F.when(F.col("k") == k, F.col(value))), F.lit(0.0)).alias(f"{value}{k}") for k in ks])
    if not ks:
        return w.join(q, "k").select("obs_id", "var_id", F.lit(0.0).alias("x"))
    features = written(wide(q, "var_id", "q"), "wide-q")
    features = F.broadcast(features) if features.count() <= SENT_FEATURES else features
    total = F.lit(0.0)
    for k in ks:
        total = total + F.col(f"w{k}") * F.col(f"q{k}")
    return wide(w, "obs_id", "w").crossJoin(features).select("obs_id", "var_id", total.alias("x"))
