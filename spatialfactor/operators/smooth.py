"""Graph smoothing of a measurement matrix (obs_id, var_id, x)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def smooth_with_graph(expr: DataFrame, weights: DataFrame, center: float = 0.5) -> DataFrame:
    """c * X + (1 - c) * rownorm(A) X for edges (i, j, a). Rows without edges become c * X."""
    if not 0.0 <= center <= 1.0:
        raise ValueError("the centre's weight must lie in 0 to 1")
    # an observation's entries travel together, so an edge is one row in both shuffles
    packed = expr.groupBy("obs_id").agg(F.collect_list(F.struct("var_id", "x")).alias("entries"))
    total = F.sum("a").over(Window.partitionBy("i"))
    share = F.when(total == 0, F.col("a")).otherwise(F.col("a") / F.when(total == 0, F.lit(1.0)).otherwise(total))
    edges = weights.select("i", F.col("j").alias("obs_id"), (F.lit(1.0 - center) * share).alias("share"))
    around = edges.join(packed, "obs_id").select("i", "share", "entries")
    own = packed.select(F.col("obs_id").alias("i"), F.lit(center).alias("share"), "entries")
    entries = around.unionByName(own).repartition("i").select("i", "share", F.explode("entries").alias("e"))
    return entries.groupBy(F.col("i").alias("obs_id"), F.col("e.var_id").alias("var_id")).agg(F.sum(F.col("share") * F.col("e.x")).alias("x"))


def adjacency_of(lap: DataFrame) -> DataFrame:
    """Edges (i, j, a) of a Laplacian: diag(L) - L, cut at 0."""
    return lap.where("i <> j").select("i", "j", F.greatest(-F.col("v"), F.lit(0.0)).alias("a")).where("a > 0")


def smooth_expression(expr: DataFrame, lap: DataFrame, center: float = 0.5) -> DataFrame:
    """Smoothing over the graph that a Laplacian holds."""
    return smooth_with_graph(expr, adjacency_of(lap), center)
