"""Regression of every feature on the fitted activities, and what follows from its coefficients.

Sufficient statistics are W^T W and the sums of W, which the driver inverts, and for each feature its column of W^T X and
its sums of X and X^2, from which tasks solve a batch of features at once. Coefficients stay where they are computed.
"""

from __future__ import annotations

import re
import warnings
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shipping import ship_package
from ..functions.special import student_two_sided
from ..sources.store import written
from .updates import gram, wtx


@dataclass
class Regression:
    """Coefficients (var_id, k, coef, stderr, t, pvalue) and per feature (var_id, intercept, r2)."""

    coefficients: DataFrame
    features: DataFrame
    params: dict = field(default_factory=dict)


def zscore_columns(factor: DataFrame, value: str) -> DataFrame:
    """Columns less their mean over their population deviation (1 for a constant column)."""
    # a row a component
    stats = factor.groupBy("k").agg(F.avg(value).alias("column_mean"), F.stddev_pop(value).alias("column_sd"))
    scaled = (F.col(value) - F.col("column_mean")) / F.when(F.col("column_sd") > 0, F.col("column_sd")).otherwise(F.lit(1.0))
    return factor.join(F.broadcast(stats), "k").withColumn(value, scaled).select(factor.columns)


def simple_regression(expr: DataFrame, w: DataFrame, component: int = 0) -> DataFrame:
    """(var_id, intercept, coef, r2): least squares of each feature on one component, absent entries 0."""
    one = w.where(F.col("k") == component)
    s = one.agg(F.count("*").cast("double").alias("n"), F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("w")).alias("sww"))
    x = expr.join(one, "obs_id").groupBy("var_id").agg(F.sum("x").alias("sx"), F.sum(F.col("x") * F.col("x")).alias("sxx"), F.sum(F.col("x") * F.col("w")).alias("swx"))
    rows = x.join(F.broadcast(s))
    sww, swx, sxx = F.col("sww") - F.col("sw") * F.col("sw") / F.col("n"), F.col("swx") - F.col("sw") * F.col("sx") / F.col("n"), F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n")
    coef = F.try_divide(swx, sww)
    return rows.select("var_id", ((F.col("sx") - coef * F.col("sw")) / F.col("n")).alias("intercept"), coef.alias("coef"), F.try_divide(coef * swx, sxx).alias("r2"))


def checked(expr: DataFrame, w: DataFrame, var: DataFrame) -> None:
    """ValueError unless all entries are finite, W is complete, and features have one row and, if named, one name each."""
    odd = lambda c: F.bool_or(F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    if expr.agg(odd("x")).first()[0] or w.agg(odd("w")).first()[0]:
        raise ValueError("entries must be finite")
    r = w.agg(F.count("*").alias("rows"), F.count_distinct("obs_id").alias("n"), F.count_distinct("k").alias("r"), F.count_distinct("obs_id", "k").alias("cells")).first()
    if r["rows"] != r["cells"] or r["cells"] != r["n"] * r["r"]:
        raise ValueError("every observation needs one activity of each component")
    names = ["var_id", *(["var_name"] if "var_name" in var.columns else [])]
    r = var.agg(F.count("*").alias("rows"), *[F.count_distinct(c).alias(c) for c in names]).first()
    if any(r[c] != r["rows"] for c in names):
        raise ValueError("features and their names must be unique")


def posthoc_regression(expr: DataFrame, w: DataFrame, var: DataFrame, add_intercept: bool = True, standardize_w: bool = False, standardize_x: bool = False, ridge: float = 0.0) -> Regression:
    """Least squares or ridge of every feature on all components; the intercept is not penalised.

    The pseudo-inverse gives the solution of least norm where activities are collinear. R2 is against the centred sum of
    squares also without intercept; features without variance have none. Without degrees of freedom there are no errors.
    """
    if not 0 <= ridge < float("inf"):
        raise ValueError("ridge must be a number that is not negative")
    checked(expr, w, var)
    if standardize_w:
        w = zscore_columns(w, "w")
    ks = sorted(r["k"] for r in w.select("k").distinct().collect())
    at = {k: i for i, k in enumerate(ks)}
    n = w.select("obs_id").distinct().count()
    a = np.zeros((len(ks), len(ks)))
    for r in gram(w, "obs_id", "w").collect():
        a[at[r["k1"]], at[r["k2"]]] = r["v"]
    if (rank := int(np.linalg.matrix_rank(a))) < len(ks):
        warnings.warn(f"activities have rank {rank} of {len(ks)}: the solution of least norm is given", stacklevel=2)
    sums = {r["k"]: r["s"] for r in w.groupBy("k").agg(F.sum("w").alias("s")).collect()}
    sw = np.asarray([sums[k] for k in ks])
    whole = np.block([[np.asarray([[float(n)]]), sw[None, :]], [sw[:, None], a]]) if add_intercept else a
    penalty = ridge * np.eye(len(whole))
    if add_intercept:
        penalty[0, 0] = 0.0
    inverse = np.linalg.pinv(whole + penalty, hermitian=True)
    spread = np.sqrt(np.maximum(np.diag(inverse @ whole @ inverse), 0.0))
    df = int(n - np.linalg.matrix_rank(whole, hermitian=True))

    def solve(frames):
        """All features of a batch at once, from their sums."""
        for f in frames:
            b = np.zeros((len(ks), len(f)))
            for j, (own, values) in enumerate(zip(f["ks"], f["vs"], strict=True)):
                if own is not None:
                    b[[at[k] for k in own], j] = values
            sx, sxx = f["sx"].to_numpy(float), f["sxx"].to_numpy(float)
            if standardize_x:
                mean, sd = sx / n, np.sqrt(np.maximum(sxx / n - (sx / n) ** 2, 0.0))
                sd[sd == 0] = 1.0
                b, sxx, sx = (b - np.outer(sw, mean)) / sd, (sxx - n * mean**2) / sd**2, np.zeros(len(f))
            if add_intercept:
                b = np.vstack((sx[None, :], b))
            beta = inverse @ b
            sse = np.maximum(sxx - 2 * (beta * b).sum(axis=0) + (beta * (whole @ beta)).sum(axis=0), 0.0)
            tss = sxx - sx**2 / n
            r2 = np.where(tss > 1e-12, 1.0 - sse / np.where(tss > 1e-12, tss, 1.0), np.nan)
            se = np.outer(spread, np.sqrt(sse / df if df > 0 else np.full(len(f), np.nan)))
            with np.errstate(divide="ignore", invalid="ignore"):
                t = beta / se
            p = student_two_sided(t, df) if df > 0 else np.full(t.shape, np.nan)
            first = int(add_intercept)
            out = {"var_id": f["var_id"], "intercept": beta[0] if add_intercept else 0.0, "r2": r2}
            yield pd.DataFrame(out | {name: list(m[first:].T) for name, m in (("coef", beta), ("stderr", se), ("t", t), ("pvalue", p))})

    ship_package(expr.sparkSession)
    packed = wtx(expr, w).groupBy("var_id").agg(F.collect_list(F.struct("k", "v")).alias("b")).select("var_id", F.col("b.k").alias("ks"), F.col("b.v").alias("vs"))
    sums_x = expr.groupBy("var_id").agg(F.sum("x").alias("sx"), F.sum(F.col("x") * F.col("x")).alias("sxx"))
    rows = var.select(F.col("var_id").cast("bigint").alias("var_id")).join(packed, "var_id", "left").join(sums_x, "var_id", "left").na.fill(0.0, ["sx", "sxx"])
    types = "var_id bigint, intercept double, r2 double, coef array<double>, stderr array<double>, t array<double>, pvalue array<double>"
    solved = written(rows.select("var_id", "ks", "vs", "sx", "sxx").mapInPandas(solve, types), "regression")
    each = F.posexplode(F.arrays_zip("coef", "stderr", "t", "pvalue")).alias("at", "c")
    names = F.array(*[F.lit(k).cast("int") for k in ks])
    coefficients = solved.select("var_id", each).select("var_id", names[F.col("at")].alias("k"), "c.coef", "c.stderr", "c.t", "c.pvalue")
    return Regression(coefficients, solved.select("var_id", "intercept", "r2"), {"n": n, "df": df, "ridge": ridge, "add_intercept": add_intercept})


DEFAULT_LABEL = "GEP{:02d}"


def component_label(k: int, labels: dict[int, str] | None = None) -> str:
    """A component's label: the given one, else GEP and its number."""
    return (labels or {}).get(k) or DEFAULT_LABEL.format(k)


def component_of(name: int | str, n_components: int, labels: dict[int, str] | None = None) -> int:
    """A component by number, by its label or by its default label, upper or lower case; ValueError for others."""
    if not isinstance(name, str):
        if 0 <= name < n_components:
            return int(name)
        raise ValueError(f"component {name} is out of range")
    for k in range(n_components):
        if name == component_label(k, labels):
            return k
    if (found := re.fullmatch(r"(?i)GEP0*(\d+)", name)) and int(found[1]) < n_components:
        return int(found[1])
    raise ValueError(f"no component is called {name}")


def rank_by_coefficient(coefficients: DataFrame, n_top: int = 50, n_bottom: int = 50, sort_by: str = "coef", min_abs: float = 0.0) -> DataFrame:
    """(k, direction, rank, var_id, coef): the most positive and the most negative genes, each direction ranked."""
    keys = {"coef": F.abs("coef"), "abs_coef": F.abs("coef"), "t": F.abs("t"), "abs_t": F.abs("t")} if "t" in coefficients.columns else {"coef": F.abs("coef"), "abs_coef": F.abs("coef")}
    if sort_by not in keys:
        raise ValueError(f"unknown order: {sort_by}")
    key = keys[sort_by]
    rows = coefficients.where(~F.isnan("coef") & (F.abs("coef") < float("inf")) & (F.abs("coef") >= min_abs) & (F.col("coef") != 0))
    rows = rows.withColumn("direction", F.when(F.col("coef") > 0, "positive").otherwise("negative"))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("k", "direction").orderBy(F.round(key, 9).desc(), "var_id")))
    return rows.where(F.col("rank") <= F.when(F.col("direction") == "positive", F.lit(n_top)).otherwise(F.lit(n_bottom))).select("k", "direction", "rank", "var_id", "coef")


def _matched(coefficients: DataFrame, var: DataFrame, signatures: DataFrame, ignore_case: bool) -> DataFrame:
    fold = (lambda c: F.upper(c)) if ignore_case else (lambda c: c)
    genes = signatures.select("signature", fold(F.col("gene")).alias("gene")).dropDuplicates()
    return genes.join(var.select("var_id", fold(F.col("var_name")).alias("gene")), "gene").join(coefficients, "var_id")


def score_signatures(coefficients: DataFrame, var: DataFrame, signatures: DataFrame, min_genes: int = 3, zscore: bool = True, ignore_case: bool = True) -> DataFrame:
    """(signature, k, score): mean coefficient over the signature's genes, standardised over components if asked."""
    rows = _matched(coefficients, var, signatures, ignore_case).groupBy("signature", "k").agg(F.avg("coef").alias("score"), F.count("*").alias("n"))
    rows = rows.withColumn("score", F.when(F.col("n") >= min_genes, F.col("score"))).drop("n")
    if zscore:
        over = Window.partitionBy("signature")
        sd = F.stddev_pop("score").over(over)
        rows = rows.withColumn("score", F.when(sd > 0, (F.col("score") - F.avg("score").over(over)) / sd).when(F.col("score").isNotNull(), F.lit(0.0)))
    return rows


def signature_overlap(var: DataFrame, signatures: DataFrame, ignore_case: bool = True) -> DataFrame:
    """(signature, n_genes, n_matched, genes): how much of a signature is measured, the matched genes by name."""
    fold = (lambda c: F.upper(c)) if ignore_case else (lambda c: c)
    genes = signatures.select("signature", fold(F.col("gene")).alias("gene")).dropDuplicates()
    hits = genes.join(var.select(fold(F.col("var_name")).alias("gene")).distinct().withColumn("hit", F.lit(1)), "gene", "left")
    return hits.groupBy("signature").agg(F.count("*").alias("n_genes"), F.count("hit").alias("n_matched"), F.concat_ws(",", F.sort_array(F.collect_list(F.when(F.col("hit") == 1, F.col("gene"))))).alias("genes"))
