"""Samples cut into tiles: boxes of about equally many rows, whatever the density and the number of coordinates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import written
from .order import positions

#: Samples, or tiles, whose sizes are sent to all tasks.
SENT_SAMPLES = 1_000_000
#: Coordinates by which tiles are cut; further ones stay whole.
CUT_BY = 3
#: Between the parts of a tile's name.
MARK = "\u0001"


def sent(df: DataFrame) -> DataFrame:
    """``df`` to all tasks, if it has at most ``SENT_SAMPLES`` rows."""
    return F.broadcast(df) if df.count() <= SENT_SAMPLES else df


def cut_into_tiles(rows: DataFrame, tile_rows: int, coords: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """(obs_id, sample, block): a sample of more than ``tile_rows`` rows is cut along its coordinates in turn, each time into
    parts of about equally many rows, down to ``tile_rows``; others are a block each. ``rows``: obs_id, sample, coordinates.

    Places in the order are counted over ranges of it, so no task sorts a sample.
    """
    n = rows.groupBy("sample").agg(F.count("*").alias("m"))
    large = written(n.where(F.col("m") > tile_rows), "large-samples")
    if large.isEmpty():
        return rows.select("obs_id", "sample", F.col("sample").alias("block"))
    # one sample may hold most rows: where samples are few, their sizes go to the rows
    large = sent(large)
    whole = rows.join(large, "sample", "left_anti").select("obs_id", "sample", F.col("sample").alias("block"))
    part = rows.join(large.select("sample"), "sample", "left_semi").withColumn("block", F.col("sample"))
    cuts = coords[:CUT_BY]
    for level, c in enumerate(cuts):
        sizes = sent(written(part.groupBy("block").agg(F.count("*").alias("m")), "tile-sizes"))
        placed = positions(part.join(sizes, "block"), ["block"], [F.col(c), *[F.col(o) for o in coords if o != c], F.col("obs_id")], "at")
        pieces = F.ceil(F.round(F.pow(F.col("m") / F.lit(tile_rows), F.lit(1.0 / (len(cuts) - level))), 9))
        number = F.floor((F.col("at") - 1) * pieces / F.col("m"))
        part = written(placed.select("obs_id", "sample", *coords, F.concat_ws(MARK, "block", number.cast("string")).alias("block")), "tiles")
    return whole.unionByName(part.select("obs_id", "sample", "block"))


def boxes_of(points: DataFrame, coords: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """(sample, block, slab, n, lowest and highest value of each coordinate) of points with their tiles; a slab is a part
    by the first coordinate."""
    corners = [f(c).alias(f"{c}{n}") for c in coords for f, n in ((F.min, 0), (F.max, 1))]
    return points.groupBy("sample", "block").agg(*corners, F.count("*").alias("n")).withColumn("slab", F.substring_index("block", MARK, 2))


def near_tiles(boxes: DataFrame, reach: str, coords: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """(to, block): other tiles of the sample whose boxes, in each coordinate, come as near as a tile's ``reach``.

    Tiles meet through the slabs that they reach, so far fewer pairs than all are compared.
    """
    first, others = coords[0], coords[1:CUT_BY]
    slabs = boxes.groupBy("sample", "slab").agg(F.min(f"{first}0").alias("s0"), F.max(f"{first}1").alias("s1"))
    asks = boxes.join(slabs.withColumnRenamed("slab", "met"), "sample").where((F.col("s0") <= F.col(f"{first}1") + F.col(reach)) & (F.col("s1") >= F.col(f"{first}0") - F.col(reach)))
    asks = asks.select(F.col("met").alias("slab"), F.col("block").alias("to"), F.col(reach).alias("reach"), *[F.col(f"{c}{n}").alias(f"to_{c}{n}") for c in coords for n in (0, 1)])
    pairs = asks.join(boxes.select("slab", "block", *[f"{c}{n}" for c in coords[:CUT_BY] for n in (0, 1)]), "slab").where("to <> block")
    for c in (first, *others):
        pairs = pairs.where((F.col(f"{c}0") <= F.col(f"to_{c}1") + F.col("reach")) & (F.col(f"{c}1") >= F.col(f"to_{c}0") - F.col("reach")))
    return pairs.select("to", "block")
