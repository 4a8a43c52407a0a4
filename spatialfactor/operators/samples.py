"""Assembling samples: merging data sets, laying samples out on a grid for display."""

from __future__ import annotations

import hashlib
import json
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge_samples(parts: list[tuple[DataFrame, DataFrame]], join: str = "inner", batch_key: str = "sample_id", cohorts: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """One (expr, obs) of several, expr as (obs_name, var_name, x) and obs with obs_name.

    Inner keeps the genes that all have, outer all of them (what is absent is 0). The batch key is the position as text.
    Genes are told by name; an order of columns does not exist in this form.
    """
    if len(parts) < 2:
        raise ValueError("merging takes two data sets or more")
    if join not in ("inner", "outer"):
        raise ValueError(f"join must be inner or outer, not {join}")
    genes = reduce(lambda a, b: a.intersect(b), [e.select("var_name").distinct() for e, _ in parts]) if join == "inner" else None
    if genes is not None and genes.isEmpty():
        raise ValueError("the data sets have no gene in common")
    exprs, all_obs = [], []
    for i, (expr, obs) in enumerate(parts):
        obs = obs.withColumn(batch_key, F.lit(str(i)))
        all_obs.append(obs.withColumn("cohort", F.lit(cohorts[i])) if cohorts else obs)
        kept = expr.join(genes, "var_name", "left_semi") if genes is not None else expr
        exprs.append(kept.select(F.lit(str(i)).alias(batch_key), "obs_name", "var_name", "x"))
    return reduce(DataFrame.unionByName, exprs), reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), all_obs)


def align_grid(obs: DataFrame, per_row: int = 5, normalize: bool = True, width: float = 100.0, gap: float = 20.0) -> DataFrame:
    """(obs_id, sample_id, ax, ay): samples shifted to 0, scaled to one width and laid out in rows.

    Samples stand in the order of their smallest obs_id. A row is as high as its highest sample. Observations without a
    sample, or a table without the column, are a ValueError.
    """
    if "sample_id" not in obs.columns:
        raise ValueError("the observations have no sample_id")
    if not obs.where("sample_id IS NULL").isEmpty():
        raise ValueError("every observation needs a sample_id")
    box = obs.groupBy("sample_id").agg(F.min("obs_id").alias("first"), F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") - F.min("x")).alias("w"), (F.max("y") - F.min("y")).alias("h"))
    scale = F.when((F.col("w") > 0) & F.lit(normalize), F.lit(width) / F.col("w")).otherwise(F.lit(1.0))
    box = box.withColumn("scale", scale).withColumn("sw", F.col("w") * F.col("scale")).withColumn("sh", F.col("h") * F.col("scale"))
    box = box.withColumn("nth", F.row_number().over(Window.orderBy("first")) - 1).withColumn("row", F.floor(F.col("nth") / per_row))
    before = Window.partitionBy("row").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    box = box.withColumn("ox", F.coalesce(F.sum(F.col("sw") + F.lit(gap)).over(before), F.lit(0.0)))
    rows = box.groupBy("row").agg(F.max("sh").alias("high"))
    above = Window.orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select("row", F.coalesce(F.sum(F.col("high") + F.lit(gap)).over(above), F.lit(0.0)).alias("oy"))
    placed = obs.join((box.join(rows, "row").select("sample_id", "x0", "y0", "scale", "ox", "oy")), "sample_id")
    return placed.select("obs_id", "sample_id", ((F.col("x") - F.col("x0")) * F.col("scale") + F.col("ox")).alias("ax"), ((F.col("y") - F.col("y0")) * F.col("scale") + F.col("oy")).alias("ay"))


def alignment_signature(obs: DataFrame, per_row: int = 5, normalize: bool = True, width: float = 100.0, gap: float = 20.0) -> str:
    """Digest of observations, samples, coordinates and settings, the same for any order of rows."""
    one = F.xxhash64("obs_id", "obs_name", "sample_id", "x", "y")
    r = obs.agg(F.count("*").alias("n"), F.sum(one.cast("decimal(38,0)")).alias("s"), F.bit_xor(one).alias("b")).first()
    return hashlib.sha256(f"{r['n']}:{r['s']}:{r['b']}:{per_row}:{normalize}:{width}:{gap}".encode()).hexdigest()


def cached_alignment(obs: DataFrame, path: str, **settings) -> DataFrame:
    """``align_grid`` kept as a table: read back where the folder holds one of the same observations and settings.

    The table's signature stands beside it; one of other observations, samples, coordinates or settings is a ValueError.
    """
    spark, signature = obs.sparkSession, alignment_signature(obs, **settings)
    try:
        held = json.loads(spark.read.text(f"{path}/signature").first()["value"])["signature"]
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    else:
        if held != signature:
            raise ValueError(f"the alignment at {path} does not match these observations and settings")
        return spark.read.parquet(f"{path}/coordinates")
    align_grid(obs, **settings).write.mode("overwrite").parquet(f"{path}/coordinates")
    spark.createDataFrame([(json.dumps({"signature": signature}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/signature")
    return spark.read.parquet(f"{path}/coordinates")
