"""Scores of genes and components: specificity, dominance, enriched genes, activity classes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import written
from .order import quantiles


def qscore(q: DataFrame) -> DataFrame:
    """Columns of Q over their L2 norm (1 for a column of zeros)."""
    norm = F.sqrt(F.sum(F.col("q") * F.col("q")).over(Window.partitionBy("k")))
    return q.select("var_id", "k", (F.col("q") / F.when(norm > 0, norm).otherwise(F.lit(1.0))).alias("qscore"))


def gene_specificity(w: DataFrame, q: DataFrame) -> DataFrame:
    """(var_id, k, gsp): positive loadings times the component's largest activity, as shares of the gene's sum."""
    peak = w.groupBy("k").agg(F.greatest(F.max("w"), F.lit(1e-10)).alias("peak"))
    scaled = q.join(F.broadcast(peak), "k").withColumn("s", F.greatest(F.col("q") * F.col("peak"), F.lit(0.0)))
    total = F.sum("s").over(Window.partitionBy("var_id"))
    return scaled.select("var_id", "k", F.coalesce(F.try_divide("s", total), F.lit(0.0)).alias("gsp"))


def dominance(gsp: DataFrame) -> DataFrame:
    """(var_id, dominant, ratio): the top component, ties to the higher one, and top / (second + 1e-8)."""
    ranked = gsp.withColumn("r", F.row_number().over(Window.partitionBy("var_id").orderBy(F.round("gsp", 9).desc(), F.col("k").desc()))).where("r <= 2")
    top = F.max(F.when(F.col("r") == 1, F.col("gsp")))
    second = F.coalesce(F.max(F.when(F.col("r") == 2, F.col("gsp"))), F.lit(0.0))
    return ranked.groupBy("var_id").agg(F.max(F.when(F.col("r") == 1, F.col("k"))).alias("dominant"), (top / (second + F.lit(1e-8))).alias("ratio"))


def _levels(q: DataFrame, dom: DataFrame, min_ratio: float | None) -> DataFrame:
    mean = F.avg(F.when(F.col("q") > 0, F.col("q"))).over(Window.partitionBy("k"))
    rows = q.join(dom, "var_id").withColumn("mean_pos", mean)
    above = (F.col("q") > 0) & (F.col("q") > F.col("mean_pos"))
    rows = rows.withColumn("above", F.coalesce(above, F.lit(False))).withColumn("dom", F.col("above") & (F.col("dominant") == F.col("k")))
    return rows.withColumn("pass", F.col("dom") & (F.lit(True) if min_ratio is None else F.col("ratio") >= min_ratio))


def enrichment_genes(q: DataFrame, dom: DataFrame, n: int = 50, min_ratio: float | None = 2.0) -> DataFrame:
    """(k, var_id, q, rank): genes above the mean positive loading that the component dominates."""
    order = Window.partitionBy("k").orderBy(F.col("q").desc(), "var_id")
    return _levels(q, dom, min_ratio).where("pass").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select("k", "var_id", "q", "rank")


def enrichment_quality(q: DataFrame, dom: DataFrame, n: int = 50, min_ratio: float | None = 2.0, min_genes: int = 10) -> DataFrame:
    """Counts of the selection's levels by component; one with fewer than ``min_genes`` selected is of low quality."""
    rows = _levels(q, dom, min_ratio).groupBy(F.col("k").alias("gep_idx"))
    positive = F.when(F.col("q") > 0, F.col("q"))
    out = rows.agg(
        F.count(positive).alias("n_positive"),
        F.round(F.coalesce(F.avg(positive), F.lit(0.0)), 6).alias("q_mean_positive"),
        F.round(F.max("q"), 6).alias("q_max"),
        F.count_if("above").alias("n_above_mean"),
        F.count_if("dom").alias("n_dominant"),
        F.count_if("pass").alias("n_pass_l4"),
    )
    selected = F.least(F.col("n_pass_l4"), F.lit(n))
    return out.withColumn("n_selected", selected).withColumn("is_low_quality", selected < min_genes)


def classify_components(w: DataFrame, obs: DataFrame, threshold: float = 0.3, min_spots: int = 50) -> DataFrame:
    """Activity of components over samples: share active, variation between and within, bimodality, and classes."""
    # read several times below
    w = written(w.select("obs_id", "k", "w"), "classified-w")
    p99 = quantiles(w, ["k"], F.col("w"), [0.99]).select("k", F.col("quantile").alias("p99"))
    rows = w.join(F.broadcast(p99), "k").join(obs.select("obs_id", "sample_id"), "obs_id").withColumn("v", F.when(F.col("p99") > 0, F.col("w") / F.col("p99")).otherwise(F.col("w")))
    p95 = quantiles(rows, ["k", "sample_id"], F.col("v"), [0.95]).select("k", "sample_id", F.col("quantile").alias("p95"))
    per = rows.groupBy("k", "sample_id").agg(F.avg("w").alias("m"), F.stddev_pop("w").alias("s"), F.count("*").alias("n")).join(p95, ["k", "sample_id"])
    z = (F.col("w") - F.col("m")) / (F.col("s") + F.lit(1e-10))
    moments = rows.join(per.select("k", "sample_id", "m", "s"), ["k", "sample_id"]).groupBy("k", "sample_id").agg(F.avg(F.pow(z, 2)).alias("m2"), F.avg(F.pow(z, 3)).alias("m3"), F.avg(F.pow(z, 4)).alias("m4"))
    per = per.join(moments, ["k", "sample_id"]).withColumn("active", F.col("p95") > threshold).withColumn("large", F.col("active") & (F.col("n") >= min_spots))
    skew, kurt = F.try_divide(F.col("m3"), F.pow("m2", F.lit(1.5))), F.try_divide(F.col("m4"), F.col("m2") * F.col("m2"))
    per = per.withColumn("bimodal", F.coalesce((kurt > 0) & (F.try_divide(skew * skew + F.lit(1.0), kurt) > 0.55), F.lit(False)))
    mean = F.when(F.col("active"), F.col("m"))
    cv = F.when(F.col("large"), F.col("s") / (F.col("m") + F.lit(1e-10)))
    out = per.groupBy("k").agg(
        F.count("*").alias("n_samples"),
        F.count_if("active").alias("n_active"),
        F.avg(F.when(F.col("active"), 1.0).otherwise(0.0)).alias("frac_active"),
        F.when(F.count(mean) >= 2, F.stddev_pop(mean) / (F.avg(mean) + F.lit(1e-10))).otherwise(F.lit(0.0)).alias("between_cv"),
        F.coalesce(F.avg(cv), F.lit(0.0)).alias("within_cv"),
        F.coalesce(F.avg(F.when(F.col("large"), F.when(F.col("bimodal"), 1.0).otherwise(0.0))), F.lit(0.0)).alias("bimodal_frac"),
    )
    return out


def component_categories(classified: DataFrame) -> DataFrame:
    """Reach: Rare below the lower quartile of active shares, Global from the upper one on if the variation between samples
    is below its 60 % quantile, Subgroup otherwise. Form: Uniform if samples hardly vary within and are not bimodal,
    Structured if they are, or are in part and vary much, Diffuse otherwise."""
    cuts = classified.agg(F.expr("percentile(frac_active, 0.75)").alias("hi"), F.expr("percentile(frac_active, 0.25)").alias("lo"), F.expr("percentile(between_cv, 0.6)").alias("cv"))
    rows = classified.join(F.broadcast(cuts))
    reach = F.when(F.col("frac_active") < F.col("lo"), "Rare").when((F.col("frac_active") >= F.col("hi")) & (F.col("between_cv") < F.col("cv")), "Global").otherwise("Subgroup")
    modes, within = F.col("bimodal_frac"), F.col("within_cv")
    form = F.when((modes <= 0.1) & (within < 0.3), "Uniform").when((modes > 0.2) | ((modes > 0.1) & (within > 0.5)), "Structured").otherwise("Diffuse")
    return rows.select(*classified.columns, reach.alias("reach"), form.alias("form"))
