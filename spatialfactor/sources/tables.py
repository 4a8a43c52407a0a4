"""Reading and writing data sets and results: parquet tables with a JSON sidecar, CSV for export."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import FitConfig
from ..operators.analysis import normalize_q_scale_w, rank_genes
from ..operators.fit import FitResult


def read_dataset(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(expr, obs, var) of a folder of three tables; FileNotFoundError if one is missing, other errors as they are."""
    try:
        return tuple(spark.read.parquet(f"{path}/{t}") for t in ("expr", "obs", "var"))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        raise FileNotFoundError(path) from error


def write_dataset(path: str, expr: DataFrame, obs: DataFrame, var: DataFrame) -> None:
    for name, df in (("expr", expr), ("obs", obs), ("var", var)):
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def save_result(result: FitResult, path: str, reconstruction: DataFrame | None = None, var: DataFrame | None = None, obs: DataFrame | None = None) -> None:
    """W, Q and, if given, a reconstruction and the names of features and observations as parquet; configuration,
    metadata and what stands in the factors' rows and columns as one row of JSON text."""
    spark = result.w.sparkSession
    result.w.write.mode("overwrite").parquet(f"{path}/w")
    result.q.write.mode("overwrite").parquet(f"{path}/q")
    if reconstruction is not None:
        reconstruction.write.mode("overwrite").parquet(f"{path}/reconstruction")
    if var is not None:
        var.select("var_id", "var_name").write.mode("overwrite").parquet(f"{path}/var_names")
    if obs is not None:
        obs.select("obs_id", "obs_name").write.mode("overwrite").parquet(f"{path}/obs_names")
    orientation = {"w": ["observations", "components"], "q": ["features", "components"]}
    about = json.dumps({"config": result.config.to_dict(), "metadata": result.metadata, "orientation": orientation})
    spark.createDataFrame([(about,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")


def load_result(spark: SparkSession, path: str) -> FitResult:
    try:
        about = json.loads("".join(r["value"] for r in spark.read.text(f"{path}/metadata").collect()))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        raise FileNotFoundError(path) from error
    return FitResult(spark.read.parquet(f"{path}/w"), spark.read.parquet(f"{path}/q"), FitConfig(**about["config"]), about["metadata"])


#: Columns of the observations that an export takes along where they are there.
METADATA_COLUMNS = ("sample_id", "cohort", "patient", "tumor", "region", "Mouse_ID", "Slice_ID", "Sample_type", "Tier1", "Tier3", "patient_id", "ukf_id")


def export_results(result: FitResult, obs: DataFrame, var: DataFrame, path: str, prefix: str = "factors", top: int = 50, columns: list[str] | None = None, normalized: bool = False) -> dict[str, str]:
    """CSV folders for loadings, signatures, gene names, coordinates, scaling factors, top genes, metadata and parameters;
    their paths by name. ``normalized``: signatures of length 1, loadings scaled to match."""
    spark = obs.sparkSession
    scaling = result.q.groupBy("k").agg(F.sqrt(F.sum(F.col("q") * F.col("q"))).alias("norm"))
    w, q = normalize_q_scale_w(result.w, result.q) if normalized else (result.w, result.q)
    wanted = columns or [c for c in METADATA_COLUMNS if c in obs.columns]
    settings = spark.createDataFrame([(k, str(v)) for k, v in result.config.to_dict().items()], "parameter string, value string")
    parts = {
        "loadings": w.groupBy("obs_id").pivot("k").agg(F.first("w")),
        "signatures": q.join(var.select("var_id", "var_name"), "var_id").groupBy("var_id", "var_name").pivot("k").agg(F.first("q")),
        "genes": var.select("var_id", "var_name"),
        "scaling": scaling,
        "coordinates": obs.select("obs_id", "x", "y"),
        "top_genes": rank_genes(q, top, "positive").join(var.select("var_id", F.col("var_name").alias("gene")), "var_id").select("k", "gene", "rank", "score"),
        "metadata": obs.select("obs_id", *wanted),
        "parameters": settings,
    }
    out = {}
    for name, df in parts.items():
        out[name] = f"{path}/{prefix}_{name}"
        df.write.mode("overwrite").csv(out[name], header=True)
    return out
