"""Characterisation of components through the covariance of their activities, without forming W Q^T."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .updates import merged_moments

TINY = 1e-10


def covariance(w: DataFrame) -> DataFrame:
    """(k1, k2, s): sample covariances of the columns of W."""
    return merged_moments(w, "obs_id", "w").select("k1", "k2", F.when(F.col("n") > 1, F.col("c") / (F.col("n") - 1)).alias("s"))


def precompute_stats(w: DataFrame, q: DataFrame) -> DataFrame:
    """(var_id, k, q, m, s, active, v): M = Q Sigma, the component's variance and whether it varies, the gene's modelled
    variance."""
    sigma = covariance(w)
    kw, kq = w.select("k").distinct(), q.select("k").distinct()
    if not kw.exceptAll(kq).isEmpty() or not kq.exceptAll(kw).isEmpty():
        raise ValueError("W and Q have different components")
    m = q.join(F.broadcast(sigma), q["k"] == sigma["k1"]).groupBy("var_id", F.col("k2").alias("k")).agg(F.sum(F.col("q") * F.col("s")).alias("m"))
    own = sigma.where("k1 = k2").select(F.col("k1").alias("k"), "s")
    rows = q.join(m, ["var_id", "k"]).join(F.broadcast(own), "k")
    return rows.select("var_id", "k", "q", "m", "s", (F.col("s") > TINY).alias("active"), F.sum(F.col("m") * F.col("q")).over(Window.partitionBy("var_id")).alias("v"))


def characterized(w: DataFrame, q: DataFrame) -> DataFrame:
    """The statistics with r_var (share of variance), c_recon (sign of q times the correlation of model and activity) and
    exclusivity (r_var less the largest of other components; with one component, r_var)."""
    rows = precompute_stats(w, q)
    r = F.when(F.col("active"), F.col("q") * F.col("q") * F.col("s") / (F.col("v") + F.lit(TINY))).otherwise(F.lit(0.0))
    root = F.sqrt(F.greatest("v", F.lit(0.0))) * F.sqrt(F.greatest("s", F.lit(0.0))) + F.lit(TINY)
    c = F.when(F.col("active"), F.greatest(F.least(F.signum("q") * F.col("m") / root, F.lit(1.0)), F.lit(-1.0))).otherwise(F.lit(0.0))
    rows = rows.withColumn("r_var", r).withColumn("c_recon", c)
    gene = Window.partitionBy("var_id").orderBy(F.col("r_var").desc(), "k")
    rows = rows.withColumn("nth", F.row_number().over(gene))
    whole = Window.partitionBy("var_id")
    first, second = F.max(F.when(F.col("nth") == 1, F.col("r_var"))).over(whole), F.max(F.when(F.col("nth") == 2, F.col("r_var"))).over(whole)
    rows = rows.withColumn("exclusivity", F.when(second.isNull(), F.col("r_var")).when(F.col("nth") == 1, F.col("r_var") - second).otherwise(F.col("r_var") - first))
    return rows.withColumn("top_k", F.max(F.when(F.col("nth") == 1, F.col("k"))).over(whole)).drop("nth")


def rank_genes_per_component(stats: DataFrame, n: int = 50, concordance: float = 0.4, quantile: float = 0.8, min_exclusivity: float = 0.0) -> DataFrame:
    """(k, role, rank, var_id, c_recon, r_var, exclusivity): anchor, representative and exclusive genes by concordance.

    Anchors are concordant, in the component's top by variance share, and have it as their largest; ties of the largest
    go to the lowest component.
    """
    cut = F.expr(f"percentile(r_var, {quantile})").over(Window.partitionBy("k"))
    rows = stats.withColumn("cut", cut).withColumn("fits", (F.col("c_recon") > 0) & (F.col("c_recon") >= concordance))
    rows = rows.withColumn("anchor", F.col("fits") & (F.col("r_var") >= F.col("cut")) & (F.col("top_k") == F.col("k")))
    roles = F.array(F.when(F.col("anchor"), F.lit("anchor")), F.when(F.col("fits"), F.lit("representative")), F.when(F.col("anchor") & (F.col("exclusivity") >= min_exclusivity), F.lit("exclusive")))
    rows = rows.select("k", "var_id", "c_recon", "r_var", "exclusivity", F.explode(F.array_compact(roles)).alias("role"))
    order = Window.partitionBy("k", "role").orderBy(F.round("c_recon", 9).desc(), "var_id")
    rows = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    return rows.select("k", "role", "rank", "var_id", *[F.round(c, 6).alias(c) for c in ("c_recon", "r_var", "exclusivity")])


def component_quality(stats: DataFrame, concordance: float = 0.4, min_effective: float = 5, min_concordant: int = 5, classes: DataFrame | None = None) -> DataFrame:
    """(k, n_eff, n_high_concordance, top1, single_gene_driven, low_gene_support, interpretable): how many genes carry a
    component; with activity classes joined where given."""
    ss, total = F.sum(F.col("r_var") * F.col("r_var")), F.sum("r_var")
    effective = F.when(ss > TINY, total * total / ss).otherwise(F.lit(0.0))
    out = stats.groupBy("k").agg(effective.alias("e"), F.count_if(F.col("c_recon") >= concordance).alias("n_high_concordance"), F.max("r_var").alias("t"))
    single, low = F.col("t") > 0.5, (F.col("e") < min_effective) | (F.col("n_high_concordance") < min_concordant)
    out = out.select("k", F.round("e", 2).alias("n_eff"), "n_high_concordance", F.round("t", 4).alias("top1"), single.alias("single_gene_driven"), low.alias("low_gene_support"), (~single & ~low).alias("interpretable"))
    return out if classes is None else out.join(classes, "k", "left")


def annotate_components(stats: DataFrame, var: DataFrame, signatures: DataFrame, min_genes: int = 5, min_score: float = 0.4, min_margin: float = 0.1, min_logfc: float = 1.0, min_pct_gap: float = 20.0) -> DataFrame:
    """(k, best, score, second, margin, label): the signature with the largest weighted mean concordance.

    Signature genes need the fold change, and the gap of percentages where those are given; of a component only genes
    with a positive loading count. A signature with fewer than ``min_genes`` of them has no score.
    """
    genes = signatures.where(F.col("avg_logfc") >= min_logfc)
    if {"pct_1", "pct_2"} <= set(signatures.columns):
        genes = genes.where(F.col("pct_1") - F.col("pct_2") >= min_pct_gap)
    rows = genes.join(var.select("var_id", F.col("var_name").alias("gene")), "gene").join(stats.where("q > 0"), "var_id")
    scores = rows.groupBy("k", "signature").agg(F.count("*").alias("n"), F.try_divide(F.sum(F.col("avg_logfc") * F.col("c_recon")), F.sum("avg_logfc")).alias("score"))
    valid = scores.where((F.col("n") >= min_genes) & F.col("score").isNotNull())
    valid = valid.withColumn("nth", F.row_number().over(Window.partitionBy("k").orderBy(F.round("score", 9).desc(), "signature"))).where("nth <= 2")
    at = lambda i, c: F.max(F.when(F.col("nth") == i, F.col(c)))
    best = valid.groupBy("k").agg(at(1, "signature").alias("best"), at(1, "score").alias("score"), at(2, "score").alias("second"))
    out = stats.select("k").distinct().join(best, "k", "left").withColumn("margin", F.col("score") - F.coalesce("second", F.lit(0.0)))
    sure = (F.col("score") >= min_score) & (F.col("margin") >= min_margin)
    return out.select("k", "best", "score", "second", "margin", F.when(F.coalesce(sure, F.lit(False)), F.col("best")).otherwise(F.lit("unassigned")).alias("label"))
