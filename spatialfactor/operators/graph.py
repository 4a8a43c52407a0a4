"""Spatial neighbour graphs, Laplacians and edge lists.

Observations are (obs_id, sample_id, x, y), or have other coordinates, of which neighbour and radius graphs take any number;
edges (i, j, a, dist) hold both directions; a Laplacian is (i, j, v) with its
diagonal. Neighbours are sought within a sample only, so a graph of many samples is block diagonal.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shipping import ship_package
from ..sources.store import written
from .tiles import CUT_BY, MARK, boxes_of, cut_into_tiles, near_tiles

#: Points of a tile, of which each is compared with all others; a tile of fewer than four times as many as the neighbours
#: asked for would tell little about them.
TILE_POINTS = 1_000
#: Points of a sample up to which it stays whole: comparing all pairs takes a task less time than the jobs that cut tiles.
WHOLE_POINTS = 8_000
#: Pairs whose distances a task has in memory at once.
PAIRS = 1 << 21


def _distance(coords: tuple[str, ...]) -> Column:
    total = F.lit(0.0)
    for c in coords:
        d = F.col(f"b.{c}") - F.col(f"a.{c}")
        total = total + d * d
    return F.sqrt(total)


def closest(at: np.ndarray, ids: np.ndarray, among: np.ndarray, among_ids: np.ndarray, k: int, bound: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place among the others, distance) of the ``k`` nearest of each row, itself left out, none beyond its bound;
    ties go to the smaller id. ``among`` is in the order of its ids."""
    rows, places, distances = [], [], []
    for low in range(0, len(at), max(1, PAIRS // max(len(among), 1))):
        high = min(len(at), low + max(1, PAIRS // max(len(among), 1)))
        d = np.zeros((high - low, len(among)))
        for c in range(at.shape[1]):
            d += (among[None, :, c] - at[low:high, None, c]) ** 2
        d = np.sqrt(d)
        d[ids[low:high, None] == among_ids[None, :]] = np.inf
        if d.shape[1] > k:
            limit = np.partition(d, k - 1, axis=1)[:, k - 1]
        else:
            limit = np.full(len(d), np.finfo(float).max)
        if bound is not None:
            limit = np.minimum(limit, bound[low:high])
        row, place = np.nonzero((d <= limit[:, None]) & np.isfinite(d))
        far = d[row, place]
        order = np.lexsort((place, far, row))
        row, place, far = row[order], place[order], far[order]
        nth = np.arange(len(row)) - np.searchsorted(row, row)
        rows.append(row[nth < k] + low)
        places.append(place[nth < k])
        distances.append(far[nth < k])
    cat = lambda parts, kind: np.concatenate(parts) if parts else np.empty(0, dtype=kind)
    return cat(rows, int), cat(places, int), cat(distances, float)


def nearest(obs: DataFrame, k: int, coords: tuple[str, ...] = ("x", "y"), tile_points: int | None = None) -> DataFrame:
    """Directed edges (i, j, dist) from each observation to its ``k`` nearest of the sample, ties to the smaller id.

    Any number of coordinates and any density. Where a sample has more than ``WHOLE_POINTS`` points, or more than the
    ``tile_points`` given, samples are cut into tiles of about equally many points, and a point's
    neighbours in its own tile bound how far away its nearest can be. Where that reaches beyond the tile's box, the bound is
    brought down by boxes that hold enough points and lie near as a whole, and the point asks the tiles whose boxes it
    still reaches; the k nearest of all answers are exact. Observations without sample or coordinates have no neighbours.
    """
    ship_package(obs.sparkSession)
    known = F.col("sample_id").isNotNull() & F.col("obs_id").isNotNull()
    for c in coords:
        known = known & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    points = obs.where(known).select(F.col("obs_id").cast("bigint").alias("obs_id"), F.col("sample_id").cast("string").alias("sample"), *[F.col(c).cast("double").alias(c) for c in coords])
    whole_points = max(tile_points or WHOLE_POINTS, 4 * k)
    tile_points = max(tile_points or TILE_POINTS, 4 * k)
    names = list(coords)

    def own(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("obs_id")
        at, ids = frame[names].to_numpy(float), frame["obs_id"].to_numpy()
        row, place, far = closest(at, ids, at, ids, k)
        return pd.DataFrame({"block": np.full(len(row), frame["block"].iat[0], dtype=object), "i": ids[row], "j": ids[place], "dist": far})

    found = "block string, i bigint, j bigint, dist double"
    if points.groupBy("sample").agg(F.count("*").alias("n")).where(F.col("n") > whole_points).isEmpty():
        # samples are few and small in bytes, but not in work: they are not put together into a task or two
        dealt = points.withColumn("block", F.col("sample")).repartition(int(obs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "block")
        return dealt.groupBy("block").applyInPandas(own, found).select("i", "j", "dist")
    points = written(points, "neighbour-points")
    points = written(points.join(cut_into_tiles(points, tile_points, coords).select("obs_id", "block"), "obs_id"), "neighbour-tiles")
    local = written(points.groupBy("block").applyInPandas(own, found), "neighbours")
    reach = local.groupBy("block", F.col("i").alias("obs_id")).agg(F.max("dist").alias("r"), F.count("*").alias("held"))
    boxes = boxes_of(points, coords)
    inner = F.least(*[F.least(F.col(c) - F.col(f"{c}0"), F.col(f"{c}1") - F.col(c)) for c in coords], F.lit(float("inf")))
    open_ = points.join(reach, ["block", "obs_id"], "left").join(boxes.drop("sample", "slab", "n"), "block")
    # a tile of a cut sample has more than k points, so r is the distance of the k-th
    open_ = open_.where(F.instr("block", MARK) > 0).where(F.col("r").isNull() | (F.col("r") >= inner))
    open_ = written(open_.select("block", "obs_id", *coords, "r"), "open-points")
    furthest = boxes.where(F.instr("block", MARK) > 0).join(open_.groupBy("block").agg(F.max("r").alias("furthest")), "block", "left").withColumn("furthest", F.coalesce("furthest", F.lit(0.0)))
    furthest = written(furthest, "neighbour-boxes")
    corners = [f"{c}{n}" for c in coords for n in (0, 1)]
    pairs = near_tiles(furthest, "furthest", coords).join(furthest.select("block", "n", *corners), "block")
    pairs = pairs.groupBy(F.col("to").alias("block")).agg(F.collect_list(F.struct("n", *corners, F.col("block").alias("target"))).alias("tiles"))

    def to_box(b: Column, most: bool) -> Column:
        total = F.lit(0.0)
        for c in coords:
            below, above = F.col(c) - b[f"{c}0"], b[f"{c}1"] - F.col(c)
            d = F.greatest(F.abs(below), F.abs(above)) if most else F.greatest(-below, -above, F.lit(0.0))
            total = total + d * d
        return F.sqrt(total)

    # roundings must not leave a tile out
    slack = 1 + 1e-12
    asking = open_.join(pairs, "block")
    bound = F.least(F.col("r"), F.array_min(F.transform("tiles", lambda b: F.when(b["n"] >= k, to_box(b, True) * slack))))
    asking = asking.withColumn("bound", bound)
    asked = asking.select("obs_id", *coords, "bound", F.explode(F.filter("tiles", lambda b: to_box(b, False) <= F.col("bound") * slack)).alias("b")).select("obs_id", *coords, "bound", F.col("b.target").alias("target"))

    def others(questions: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(questions) or not len(held):
            return pd.DataFrame({"i": [], "j": [], "dist": []})
        held = held.sort_values("obs_id")
        ids, other = questions["obs_id"].to_numpy(), held["obs_id"].to_numpy()
        row, place, far = closest(questions[names].to_numpy(float), ids, held[names].to_numpy(float), other, k, questions["bound"].to_numpy(float))
        return pd.DataFrame({"i": ids[row], "j": other[place], "dist": far})

    answers = asked.groupBy("target").cogroup(points.groupBy("block")).applyInPandas(others, "i bigint, j bigint, dist double")
    both = answers.select("i", "j", "dist").unionByName(local.select("i", "j", "dist"))
    order = Window.partitionBy("i").orderBy("dist", "j")
    return both.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k).select("i", "j", "dist")


def symmetric(edges: DataFrame) -> DataFrame:
    """Union of both directions, weight 1; the distance is half the sum over directions, so that of a neighbour that is
    one only in one direction is halved."""
    back = edges.select(F.col("j").alias("i"), F.col("i").alias("j"), "dist")
    return edges.select("i", "j", "dist").unionByName(back).groupBy("i", "j").agg((F.sum("dist") / 2).alias("dist")).select("i", "j", F.lit(1.0).alias("a"), "dist")


def tv_structures(lap: DataFrame) -> tuple[DataFrame, dict]:
    """What total variation needs of a Laplacian: its edges (i, j, weight) and their number, mean weight and degree."""
    edges = edges_from_laplacian(lap)
    r = edges.agg(F.count("*").alias("n_edges"), F.avg("weight").alias("mean_weight")).first()
    nodes = edges.selectExpr("explode(array(i, j)) AS i").distinct().count()
    return edges, {"n_edges": r["n_edges"], "mean_weight": r["mean_weight"], "n_nodes": nodes, "mean_degree": 2.0 * r["n_edges"] / nodes if nodes else 0.0}


def knn_graph(obs: DataFrame, k: int = 6, skip_small: bool = False, coords: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """Symmetric k-nearest-neighbour graph. Samples of ``k`` points or fewer raise, or are left out."""
    small = obs.groupBy("sample_id").agg(F.count("*").alias("n")).where(F.col("n") < k + 1)
    if skip_small:
        obs = obs.join(small.select("sample_id"), "sample_id", "left_anti")
    elif not small.isEmpty():
        raise ValueError(f"a sample has fewer than {k + 1} observations")
    return symmetric(nearest(obs, k, coords))


def auto_radius(obs: DataFrame, coords: tuple[str, ...] = ("x", "y")) -> float:
    """1.5 * sqrt(area / n), area the product of the coordinate ranges."""
    area = F.lit(1.0)
    for c in coords:
        area = area * (F.max(c) - F.min(c))
    r = obs.agg(F.count("*").alias("n"), area.alias("area")).first()
    return 1.5 * (r["area"] / r["n"]) ** 0.5


def radius_graph(obs: DataFrame, radius: float | None = None, coords: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """All pairs of a sample within the radius, both directions, by grid cells as wide as the radius along the first coordinates.

    Cells are merged, never sent round: the size that Spark expects of the points is that of their compressed file.
    """
    radius = auto_radius(obs, coords) if radius is None else radius
    grid = obs.select("obs_id", "sample_id", *coords)
    cells = [f"cell_{c}" for c in coords[:CUT_BY]]
    for c, cell in zip(coords, cells, strict=False):
        grid = grid.withColumn(cell, F.floor(F.col(c) / F.lit(float(radius))))
    around = grid
    for cell in cells:
        around = around.withColumn("step", F.explode(F.array(*[F.lit(s) for s in (-1, 0, 1)]))).withColumn(cell, F.col(cell) + F.col("step")).drop("step")
    met = (F.col("a.sample_id") == F.col("b.sample_id")) & (F.col("a.obs_id") != F.col("b.obs_id"))
    for cell in cells:
        met = met & (F.col(f"a.{cell}") == F.col(f"b.{cell}"))
    pairs = around.alias("a").join(grid.hint("merge").alias("b"), met)
    return pairs.select(F.col("a.obs_id").alias("i"), F.col("b.obs_id").alias("j"), F.lit(1.0).alias("a"), _distance(coords).alias("dist")).where(F.col("dist") <= radius)


def set_diag(edges: DataFrame, obs: DataFrame) -> DataFrame:
    """The graph with self loops of weight 1."""
    return edges.select("i", "j", "a", "dist").unionByName(obs.select(F.col("obs_id").alias("i"), F.col("obs_id").alias("j"), F.lit(1.0).alias("a"), F.lit(0.0).alias("dist")))


def build_graph(obs: DataFrame, method: str = "knn", k: int = 6, radius: float | None = None, diagonal: bool = False, coords: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """Graph by method: knn, radius or delaunay, the last in the plane only."""
    if method == "knn":
        edges = knn_graph(obs, k, coords=coords)
    elif method == "radius":
        edges = radius_graph(obs, radius, coords)
    elif method == "delaunay":
        if tuple(coords) != ("x", "y"):
            raise ValueError("Delaunay graphs are of the coordinates x and y")
        from .delaunay import delaunay_graph

        edges = delaunay_graph(obs)
    else:
        raise ValueError(f"unknown graph method: {method}")
    return set_diag(edges, obs) if diagonal else edges


def graph_from_coords(obs: DataFrame, radius: float | None = None, k: int | None = None, coords: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """Low-level form: a radius graph, or a directed k-nearest-neighbour graph; the radius wins if both are given."""
    if radius is not None:
        return radius_graph(obs, radius, coords)
    if k is None:
        raise ValueError("give a radius or a number of neighbours")
    return nearest(obs, k, coords).select("i", "j", F.lit(1.0).alias("a"), "dist")


def degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy("i").agg(F.sum("a").alias("degree"))


def average_degree(edges: DataFrame, obs: DataFrame) -> DataFrame:
    """Mean row sum over all observations."""
    all_of = obs.select(F.col("obs_id").alias("i")).join(degrees(edges), "i", "left")
    return all_of.agg(F.avg(F.coalesce("degree", F.lit(0.0))).alias("average_degree"))


def laplacian(edges: DataFrame, obs: DataFrame, normalized: bool = True, symmetric: bool = False) -> DataFrame:
    """(i, j, v): I - D^-1/2 A D^-1/2, with 1 on the diagonal also where the degree is 0; or D - A.

    ``edges`` are read once where they are known to be symmetric, since the degree of an edge's end is then a sum over the
    edges that it ends; else degrees are joined.
    """
    nodes = obs.select(F.col("obs_id").alias("i"), F.col("obs_id").alias("j"))
    if not normalized:
        ends = F.array(F.struct("j", (-F.col("a")).alias("v")), F.struct(F.col("i").alias("j"), F.col("a").alias("v")))
        parts = edges.where("i <> j").select("i", F.explode(ends).alias("e")).select("i", "e.j", "e.v")
        parts = parts.unionByName(nodes.withColumn("v", F.lit(0.0)))
    else:
        if symmetric:
            sums = edges.withColumn("di", F.sum("a").over(Window.partitionBy("i"))).withColumn("dj", F.sum("a").over(Window.partitionBy("j")))
        else:
            degree = degrees(edges)
            sums = edges.join(degree.withColumnRenamed("degree", "di"), "i").join(degree.select(F.col("i").alias("j"), F.col("degree").alias("dj")), "j", "left")
        parts = sums.select("i", "j", F.coalesce(F.try_divide(-F.col("a"), F.sqrt(F.col("di") * F.col("dj"))), F.lit(0.0)).alias("v"))
        # a loop's share of its degree is a / sqrt(d * d)
        parts = parts.unionByName(nodes.withColumn("v", F.lit(1.0)))
    return parts.groupBy("i", "j").agg(F.sum("v").alias("v"))


def per_sample_laplacian(obs: DataFrame, k: int = 8, coords: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """Normalised Laplacian of each sample's graph under the observations' own ids; small samples have no entries."""
    if k < 1:
        raise ValueError("the number of neighbours must be at least 1")
    if not obs.where("sample_id IS NULL").isEmpty():
        raise ValueError("sample ids must not be null")
    small = obs.groupBy("sample_id").agg(F.count("*").alias("n")).where(F.col("n") < k + 1).select("sample_id")
    large = obs.join(small, "sample_id", "left_anti")
    return laplacian(symmetric(nearest(large, k, coords)), large, symmetric=True)


def edges_from_laplacian(lap: DataFrame) -> DataFrame:
    """Upper-triangle edges (i, j, weight): -v cut at 0, over the largest; all ones if there is no weight."""
    upper = lap.where("i < j").select("i", "j", F.greatest(-F.col("v"), F.lit(0.0)).alias("weight")).where("weight > 0")
    top = upper.agg(F.max("weight").alias("top"))
    return upper.join(F.broadcast(top)).select("i", "j", F.coalesce(F.try_divide("weight", "top"), F.lit(1.0)).alias("weight"))


def edge_list(edges: DataFrame, weighted: bool = True) -> DataFrame:
    """Upper-triangle edges with weight 1 / (dist + 1e-6) over the largest, or 1. Distances go by (i, j)."""
    upper = edges.where("i < j")
    if not weighted:
        return upper.select("i", "j", F.lit(1.0).alias("weight"))
    raw = upper.select("i", "j", (F.lit(1.0) / (F.col("dist") + F.lit(1e-6))).alias("weight"))
    return raw.join(F.broadcast(raw.agg(F.max("weight").alias("top")))).select("i", "j", (F.col("weight") / F.col("top")).alias("weight"))
