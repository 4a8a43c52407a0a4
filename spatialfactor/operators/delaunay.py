"""Delaunay graphs of samples of any size: local triangulations of tiles, whose circles other tiles then check.

A tile triangulates its points and those of a margin around it. A triangle at one of its own points is right if no point
of the sample lies inside its circumcircle, an outer edge if none lies beyond it. Circles within the tile's own box are
empty by construction; the others, few and near the border, are sent to the tiles whose boxes they reach, and those answer
with the point that lies deepest inside. Tiles that got answers add the points and triangulate again, until no question
finds a point: every triangle then has an empty circle, which is what makes it Delaunay, whatever the margin was.

Where more than three points lie on an empty circle, the triangulation is not unique: here the smallest id among them is
joined with all others, so the graph does not hang on tiles or the order of rows.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shipping import ship_package
from ..sources.store import written
from .tiles import MARK, boxes_of, cut_into_tiles, near_tiles, sent

#: Points of a tile; the margin around it, in mean distances of its points.
TILE_POINTS, MARGIN = 4_000, 4.0
#: Circumcentres of neighbouring triangles that are this near, relative to their shared edge, are one.
SAME_CENTRE = 1e-9
#: Error bounds of the two determinants in units of their terms' sizes.
ORIENT_ERROR, CIRCLE_ERROR = 3.4e-16, 1.2e-15


class Triangulation:
    """Delaunay triangulation of distinct points in the plane, by insertion with exact decisions.

    ``third`` maps an edge, as ``u * size + v``, to the vertex on its left; the ghost vertex ``n`` closes the outside.
    Points come in rounds of growing size, in each by neighbouring strips, so the walk to a point's triangle is short and
    the work is about proportional to n log n.
    """

    def __init__(self, points: np.ndarray):
        self.n, self.size = len(points), len(points) + 1
        self.x, self.y = points[:, 0].tolist(), points[:, 1].tolist()
        self.third: dict[int, int] = {}
        order = self._order(points)
        self.collinear = not self._start(order)
        if not self.collinear:
            for p in order:
                if p not in self.first:
                    self._insert(p)

    def _order(self, points: np.ndarray) -> list[int]:
        low, high = points.min(axis=0), points.max(axis=0)
        at = (points - low) / np.where(high > low, high - low, 1.0)
        round_of = np.floor(np.log2(1.0 + np.random.default_rng(0).permutation(self.n))).astype(int)
        strips = np.sqrt(2.0 ** round_of / 2.0)
        strip = np.floor(at[:, 0] * strips).astype(int)
        return np.lexsort((np.where(strip % 2 == 0, at[:, 1], -at[:, 1]), strip, round_of)).tolist()

    def _start(self, order: list[int]) -> bool:
        if self.n < 3:
            return False
        a, b = order[0], order[1]
        for c in order[2:]:
            side = self.orient(a, b, c)
            if side:
                if side < 0:
                    a, b = b, a
                self.first, g = {a, b, c}, self.n
                for t in ((a, b, c), (b, a, g), (c, b, g), (a, c, g)):
                    self._add(*t)
                self.last = a, b, c
                return True
        return False

    def _add(self, u: int, v: int, w: int) -> None:
        s, third = self.size, self.third
        third[u * s + v], third[v * s + w], third[w * s + u] = w, u, v

    def orient(self, a: int, b: int, c: int) -> float:
        """Above 0 where a, b, c turn left."""
        x, y = self.x, self.y
        left, right = (x[b] - x[a]) * (y[c] - y[a]), (y[b] - y[a]) * (x[c] - x[a])
        det = left - right
        if abs(det) > ORIENT_ERROR * (abs(left) + abs(right)):
            return det
        ax, ay, bx, by, cx, cy = map(Fraction, (x[a], y[a], x[b], y[b], x[c], y[c]))
        exact = (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)
        return (exact > 0) - (exact < 0)

    def inside(self, a: int, b: int, c: int, p: int) -> bool:
        """Whether p lies strictly inside the circle through a, b, c, which turn left."""
        x, y = self.x, self.y
        px, py = x[p], y[p]
        ax, ay, bx, by, cx, cy = x[a] - px, y[a] - py, x[b] - px, y[b] - py, x[c] - px, y[c] - py
        bc, cb, ca, ac, ab, ba = bx * cy, cx * by, cx * ay, ax * cy, ax * by, bx * ay
        sa, sb, sc = ax * ax + ay * ay, bx * bx + by * by, cx * cx + cy * cy
        det = sa * (bc - cb) + sb * (ca - ac) + sc * (ab - ba)
        if abs(det) > CIRCLE_ERROR * (sa * (abs(bc) + abs(cb)) + sb * (abs(ca) + abs(ac)) + sc * (abs(ab) + abs(ba))):
            return det > 0
        px, py = Fraction(px), Fraction(py)
        ax, ay, bx, by, cx, cy = Fraction(x[a]) - px, Fraction(y[a]) - py, Fraction(x[b]) - px, Fraction(y[b]) - py, Fraction(x[c]) - px, Fraction(y[c]) - py
        return (ax * ax + ay * ay) * (bx * cy - cx * by) + (bx * bx + by * by) * (cx * ay - ax * cy) + (cx * cx + cy * cy) * (ax * by - bx * ay) > 0

    def conflicts(self, u: int, v: int, w: int, p: int) -> bool:
        """Whether p breaks the triangle; a ghost's circle is what lies beyond its edge, and the edge itself."""
        g = self.n
        if g not in (u, v, w):
            return self.inside(u, v, w, p)
        if u == g:
            u, v = v, w
        elif v == g:
            u, v = w, u
        side = self.orient(u, v, p)
        if side:
            return side > 0
        x, y = self.x, self.y
        return (x[u] - x[p]) * (x[v] - x[p]) + (y[u] - y[p]) * (y[v] - y[p]) < 0

    def _locate(self, p: int) -> tuple[int, int, int]:
        u, v, w = self.last
        s, g, third = self.size, self.n, self.third
        while True:
            for a, b in ((u, v), (v, w), (w, u)):
                if self.orient(a, b, p) < 0:
                    u, v, w = b, a, third[b * s + a]
                    break
            else:
                return u, v, w
            if w == g:
                return u, v, w

    def _insert(self, p: int) -> None:
        s, third = self.size, self.third
        u, v, w = self._locate(p)
        pending, rim, gone = [(u, v, w)], [], {u * s + v, v * s + w, w * s + u}
        while pending:
            u, v, w = pending.pop()
            for a, b in ((u, v), (v, w), (w, u)):
                back = b * s + a
                if back in gone:
                    continue
                c = third[back]
                if self.conflicts(b, a, c, p):
                    gone |= {back, a * s + c, c * s + b}
                    pending.append((b, a, c))
                else:
                    rim.append((a, b))
        # an edge met before its other side turned out to be in conflict is no border
        rim = [(a, b) for a, b in rim if b * s + a not in gone]
        for key in gone:
            del third[key]
        g = self.n
        for a, b in rim:
            self._add(a, b, p)
            if a != g and b != g:
                self.last = a, b, p

    def triangles(self) -> tuple[np.ndarray, np.ndarray]:
        """(triangles, outer edges): vertices in left turn, each once; an outer edge has the points on its right."""
        s, g = self.size, self.n
        keys, w = np.fromiter(self.third.keys(), dtype=np.int64), np.fromiter(self.third.values(), dtype=np.int64)
        u, v = keys // s, keys % s
        once = (u < v) & (u < w)
        real = np.stack((u, v, w), axis=1)[once & (v < g) & (w < g)]
        return real, np.stack((u, v), axis=1)[w == g]


def bisector_place(p: np.ndarray, i: np.ndarray, j: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Where on the bisector of i and j, in lengths of the edge from its middle, the circle through i, j, k has its centre."""
    d, u = p[j] - p[i], p[k] - (p[i] + p[j]) / 2
    normal = np.stack((-d[:, 1], d[:, 0]), axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        return ((u**2).sum(axis=1) - (d**2).sum(axis=1) / 4) / (2 * (u * normal).sum(axis=1))


def canonical_edges(p: np.ndarray, triangles: np.ndarray) -> np.ndarray:
    """Edges (i < j) of the triangles; of the points of one circle, the first is joined with all others."""
    sides = np.concatenate([triangles[:, [0, 1, 2]], triangles[:, [1, 2, 0]], triangles[:, [2, 0, 1]]])
    owner = np.tile(np.arange(len(triangles)), 3)
    low, high = sides[:, :2].min(axis=1), sides[:, :2].max(axis=1)
    order = np.lexsort((high, low))
    low, high, far, owner = low[order], high[order], sides[order, 2], owner[order]
    first = np.flatnonzero(np.append(True, (low[1:] != low[:-1]) | (high[1:] != high[:-1])))
    edges = np.stack((low[first], high[first]), axis=1)
    inner = first[np.append(np.diff(first), len(low) - first[-1]) == 2]
    a, b = (bisector_place(p, low[inner], high[inner], far[inner + k]) for k in (0, 1))
    same = inner[np.abs(a - b) <= SAME_CENTRE * (1 + np.abs(a) + np.abs(b))]
    if not len(same):
        return edges
    group = np.arange(len(triangles))

    def root(t: int) -> int:
        while group[t] != t:
            group[t] = group[group[t]]
            t = group[t]
        return t

    for x, y in zip(owner[same].tolist(), owner[same + 1].tolist(), strict=True):
        group[root(x)] = root(y)
    polygons: dict[int, set[int]] = {}
    for t in set(owner[same].tolist()) | set(owner[same + 1].tolist()):
        polygons.setdefault(root(t), set()).update(triangles[t].tolist())
    kept = set(map(tuple, edges.tolist())) - set(zip(low[same].tolist(), high[same].tolist(), strict=True))
    for corners in polygons.values():
        kept |= {(min(corners), c) for c in corners if c != min(corners)}
    return np.asarray(sorted(kept))


def line_edges(p: np.ndarray) -> np.ndarray:
    """Points on a line form a path."""
    order = np.lexsort((p[:, 1], p[:, 0]))
    return np.sort(np.stack((order[:-1], order[1:]), axis=1), axis=1)


def triangulate(points: np.ndarray) -> set[tuple[int, int]]:
    """Edges (i < j) of the Delaunay graph of distinct points in the plane; collinear points form a path."""
    points = np.asarray(points, dtype=float)
    if len(points) < 2:
        return set()
    t = Triangulation(points)
    return set(map(tuple, (line_edges(points) if t.collinear else canonical_edges(points, t.triangles()[0])).tolist()))


def circumcircles(p: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a, b, c = p[t[:, 0]], p[t[:, 1]] - p[t[:, 0]], p[t[:, 2]] - p[t[:, 0]]
    d = 2 * (b[:, 0] * c[:, 1] - b[:, 1] * c[:, 0])
    sb, sc = (b**2).sum(axis=1), (c**2).sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        centre = np.stack(((c[:, 1] * sb - b[:, 1] * sc) / d, (b[:, 0] * sc - c[:, 0] * sb) / d), axis=1)
    return a + centre, np.sqrt((centre**2).sum(axis=1))


#: A row is an edge (i, j, dist) or a question of a tile: a circle through a, b, c, or what lies left of a to b where c is missing.
FOUND = "block string, i bigint, j bigint, dist double, ax double, ay double, bx double, by double, cx double, cy double, r double"
COLUMNS = [c.split()[0] for c in FOUND.split(", ")]


def tile_work(frame: pd.DataFrame) -> pd.DataFrame:
    """Edges at a tile's own points, and the questions that must find no point for them to be right."""
    frame = frame.sort_values("obs_id").drop_duplicates("obs_id").reset_index(drop=True)
    p, ids, own, block = frame[["x", "y"]].to_numpy(float), frame["obs_id"].to_numpy(), frame["own"].to_numpy(bool), frame["block"].iat[0]
    low, high = p[own].min(axis=0), p[own].max(axis=0)
    t = Triangulation(p) if len(p) > 2 else None
    parts = []
    if t is None or t.collinear:
        edges = line_edges(p)
        # what lies on either side of the line, or further on it, is not known
        outer = np.concatenate((edges, edges[:, ::-1]))
        outer = outer if len(outer) else np.zeros((1, 2), dtype=int)
    else:
        real, outer = t.triangles()
        edges = canonical_edges(p, real)
        real = real[own[real].any(axis=1)]
        centre, r = circumcircles(p, real)
        open_ = ~((centre - r[:, None] > low).all(axis=1) & (centre + r[:, None] < high).all(axis=1))
        corner = p[real[open_]]
        parts.append(pd.DataFrame({"ax": corner[:, 0, 0], "ay": corner[:, 0, 1], "bx": corner[:, 1, 0], "by": corner[:, 1, 1], "cx": corner[:, 2, 0], "cy": corner[:, 2, 1], "r": r[open_]}))
    outer = p[outer[own[outer].any(axis=1)]]
    parts.append(pd.DataFrame({"ax": outer[:, 0, 0], "ay": outer[:, 0, 1], "bx": outer[:, 1, 0], "by": outer[:, 1, 1]}))
    edges = edges[own[edges].any(axis=1)]
    parts.append(pd.DataFrame({"i": ids[edges[:, 0]], "j": ids[edges[:, 1]], "dist": np.hypot(*(p[edges[:, 0]] - p[edges[:, 1]]).T)}))
    out = pd.concat(parts).reindex(columns=COLUMNS)
    out["block"] = block
    return out.astype({"i": "Int64", "j": "Int64"})


def answers(questions: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
    """Of a tile's points for each question the one deepest inside, or, where none is, those on the circle, or next on the line."""
    p, ids = points[["x", "y"]].to_numpy(float), points["obs_id"].to_numpy()
    found = []
    for q in questions.itertuples(index=False):
        a, b, c = (np.asarray(v) for v in ((q.ax, q.ay), (q.bx, q.by), (q.cx, q.cy)))
        if np.isnan(q.cx):
            d = b - a
            length = float((d**2).sum())
            depth = d[0] * (p[:, 1] - a[1]) - d[1] * (p[:, 0] - a[0])
            # a tile of one point asks for all others
            depth, slack = (depth, 1e-12 * length) if length else (1.0 / (1e-300 + ((p - a) ** 2).sum(axis=1)), 0.0)
            if not length:
                depth[(p == a).all(axis=1)] = 0.0
        else:
            # the power of a point to the circle, from differences to the point, as exact as they are
            u, v, w = a - p, b - p, c - p
            su, sv, sw = (u**2).sum(axis=1), (v**2).sum(axis=1), (w**2).sum(axis=1)
            cross = lambda s, t: s[:, 0] * t[:, 1] - s[:, 1] * t[:, 0]
            area = (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
            depth, slack = (su * cross(v, w) + sv * cross(w, u) + sw * cross(u, v)) / area, 1e-9 * q.r**2
        best = int(depth.argmax())
        at = [best] if depth[best] > slack else np.flatnonzero(depth >= -slack)
        if np.isnan(q.cx) and len(at) > 1:
            # on the line itself: one between the two, and the next before and after them
            along = (p[at] - a) @ d / length
            of = lambda these, to: [at[these[np.abs(along[these] - to).argmin()]]] if len(these) else []  # noqa: B023, E731
            at = of(np.flatnonzero((along > 0) & (along < 1)), 0.5) + of(np.flatnonzero(along < 0), 0.0) + of(np.flatnonzero(along > 1), 1.0)
        found += [(q.block, ids[k], p[k, 0], p[k, 1]) for k in at]
    return pd.DataFrame(found, columns=["block", "obs_id", "x", "y"]).drop_duplicates()


def tiled(obs: DataFrame, tile_points: int) -> tuple[DataFrame, DataFrame]:
    """(points with their tiles, boxes of the tiles); of points at one place the smallest id."""
    s = F.coalesce(F.col("sample_id").cast("string"), F.lit(""))
    points = obs.where("x IS NOT NULL AND y IS NOT NULL AND obs_id IS NOT NULL").groupBy(s.alias("sample"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).agg(F.min("obs_id").alias("obs_id"))
    points = written(points, "delaunay-points")
    blocks = cut_into_tiles(points, tile_points)
    points = written(points.join(blocks.select("obs_id", "sample", "block"), ["obs_id", "sample"]).select("block", "sample", "obs_id", "x", "y"), "delaunay-tiles")
    margin = F.lit(MARGIN) * F.sqrt(F.greatest((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")), F.lit(0.0)) / F.col("n"))
    return points, written(boxes_of(points).withColumn("margin", margin), "delaunay-boxes")


def margins(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """(block, obs_id, x, y): points of other tiles near a tile's box, by the smaller of the two tiles' margins."""
    own = boxes.select("block", F.col("margin").alias("m"))
    to = boxes.select(F.col("block").alias("to"), "x0", "x1", "y0", "y1", "margin")
    pairs = near_tiles(boxes, "margin").join(own, "block").join(to, "to").select("block", "to", "x0", "x1", "y0", "y1", F.least("margin", "m").alias("m"))
    near = points.join(pairs, "block").where(F.col("x").between(F.col("x0") - F.col("m"), F.col("x1") + F.col("m")) & F.col("y").between(F.col("y0") - F.col("m"), F.col("y1") + F.col("m")))
    return near.select(F.col("to").alias("block"), "obs_id", "x", "y")


def delaunay_graph(obs: DataFrame, tile_points: int = TILE_POINTS) -> DataFrame:
    """(i, j, a, dist) of each sample's Delaunay graph, both directions.

    Coincident points share their first id's edges; points on a line form a path; points without coordinates have none.
    Samples of more than ``tile_points`` points are cut into tiles, each of which is a task's work with its margin and the
    points that were found to matter. Questions go only to tiles of the sample whose boxes they reach.
    """
    ship_package(obs.sparkSession)
    points, boxes = tiled(obs, tile_points)
    several = boxes.where(F.instr("block", MARK) > 0)
    sets = points.select("block", "obs_id", "x", "y", F.lit(True).alias("own"))
    done = []
    if not several.isEmpty():
        sets = written(sets.unionByName(margins(points, several).withColumn("own", F.lit(False))), "delaunay-sets")
    while True:
        out = written(sets.groupBy("block").applyInPandas(tile_work, FOUND), "delaunay-round")
        if several.isEmpty():
            done.append(out.where("i IS NOT NULL"))
            break
        asked = out.where("i IS NULL").join(several.select("block", "sample"), "block")
        targets = sent(several.select("sample", F.col("block").alias("target"), "x0", "x1", "y0", "y1"))
        # the circle's centre again, and the corner of a box that lies furthest to the left of a line
        bx, by, cx, cy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"), F.col("cx") - F.col("ax"), F.col("cy") - F.col("ay")
        d, sb, sc = 2 * (bx * cy - by * cx), bx * bx + by * by, cx * cx + cy * cy
        mx, my = F.col("ax") + (cy * sb - by * sc) / d, F.col("ay") + (bx * sc - cx * sb) / d
        gap = lambda m, lo, hi: F.greatest(F.col(lo) - m, m - F.col(hi), F.lit(0.0))
        circle = F.hypot(gap(mx, "x0", "x1"), gap(my, "y0", "y1")) <= F.col("r") * (1 + 1e-9)
        left = bx * (F.when(bx > 0, F.col("y1")).otherwise(F.col("y0")) - F.col("ay")) - by * (F.when(by > 0, F.col("x0")).otherwise(F.col("x1")) - F.col("ax"))
        reaches = F.when(F.col("cx").isNull() | F.isnan("cx"), left >= -1e-9 * sb).otherwise(F.coalesce(circle, F.lit(True)) | F.isnan("r"))
        questions = written(asked.join(targets, "sample").where(F.col("target") != F.col("block")).where(reaches).select("target", "block", "ax", "ay", "bx", "by", "cx", "cy", "r"), "delaunay-questions")
        got = questions.groupBy("target").cogroup(points.groupBy("block")).applyInPandas(lambda q, p: answers(q, p) if len(q) and len(p) else pd.DataFrame(columns=["block", "obs_id", "x", "y"]), "block string, obs_id bigint, x double, y double")
        new = written(got.distinct().join(sets.select("block", "obs_id"), ["block", "obs_id"], "left_anti").select("block", "obs_id", "x", "y"), "delaunay-answers")
        again = new.select("block").distinct()
        done.append(out.where("i IS NOT NULL").join(again, "block", "left_anti"))
        if new.isEmpty():
            break
        sets = written(sets.join(again, "block", "left_semi").unionByName(new.withColumn("own", F.lit(False))), "delaunay-sets")
    edges = done[0]
    for more in done[1:]:
        edges = edges.unionByName(more)
    both = F.explode(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))).alias("e")
    return edges.groupBy("i", "j").agg(F.min("dist").alias("dist")).select(both, "dist").select("e.i", "e.j", F.lit(1.0).alias("a"), "dist")
