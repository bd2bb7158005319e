"""Areas and detections: rings to cells, set operations on cells, and outlines of regions.

Areas meet detections as sets of grid cells, so that clipping, subtracting and dissolving are joins and distincts. A
cell is (y, x) of a grid with origin x0, y0 and pixel size px, and belongs to an area if its centre lies inside.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenewatch.operators.outlines import polygonize

__all__ = ["polygonize"]


def inside_rings(px: np.ndarray, py: np.ndarray, rings: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Whether points lie in the even-odd interior of closed rings."""
    out = np.zeros(len(px), bool)
    for xs, ys in rings:
        for x1, y1, x2, y2 in zip(xs, ys, np.roll(xs, -1), np.roll(ys, -1)):
            if y1 != y2:
                out ^= ((y1 > py) != (y2 > py)) & (px < (x2 - x1) * (py - y1) / (y2 - y1) + x1)
    return out


def rings_in_cells(rings: DataFrame, x0: float, y0: float, px: float, by: str = "aoi_id", strip: int = 64) -> DataFrame:
    """(by, y, x): cells whose centres lie in a polygon of rings (by, poly, ring, points); rows count up with y.

    A polygon is split into strips of rows, each filled by one task, so that a large one does not land in one.
    """
    kind = rings.schema[by].dataType.simpleString()
    ys = F.transform("points", lambda p: p["y"])
    polys = rings.groupBy(by, "poly").agg(F.collect_list("points").alias("rings"), F.min(F.array_min(ys)).alias("lo"), F.max(F.array_max(ys)).alias("hi"))
    first, last = F.floor((F.col("lo") - y0) / px / strip), F.floor((F.col("hi") - y0) / px / strip)
    strips = polys.select(by, "rings", F.explode(F.sequence(first, last)).alias("s")).repartition(by, "s")

    def of(batches):
        for pdf in batches:
            for key, polygon, s in zip(pdf[by], pdf["rings"], pdf["s"]):
                shape = [(np.array([p["x"] for p in r], float), np.array([p["y"] for p in r], float)) for r in polygon]
                xs = np.concatenate([r[0] for r in shape])
                cols = np.arange(int(np.floor((xs.min() - x0) / px)), int(np.floor((xs.max() - x0) / px)) + 1)
                for row in range(int(s) * strip, (int(s) + 1) * strip):
                    hit = cols[inside_rings(x0 + (cols + 0.5) * px, np.full(len(cols), y0 + (row + 0.5) * px), shape)]
                    if len(hit):
                        yield pd.DataFrame({by: [key] * len(hit), "y": np.int64(row), "x": hit.astype(np.int64)})

    return strips.mapInPandas(of, f"`{by}` {kind}, y long, x long").distinct()


def aoi_cells(search: DataFrame, on: list[DataFrame] = (), off: list[DataFrame] = ()) -> DataFrame:
    """(y, x): the search area, within each area to look in and outside each area to leave out; all as cells."""
    out = search.select("y", "x").distinct()
    for area in on:
        out = out.join(area.select("y", "x").distinct(), ["y", "x"], "left_semi")
    for area in off:
        out = out.join(area.select("y", "x").distinct(), ["y", "x"], "left_anti")
    return out


def rectangle_meets_rings(min_x: float, min_y: float, max_x: float, max_y: float, rings: list[tuple[np.ndarray, np.ndarray]]) -> bool:
    """Whether a rectangle and a polygon of closed rings share a point: a corner inside, a vertex inside, or edges that cross."""
    cx, cy = np.array([min_x, max_x, max_x, min_x]), np.array([min_y, min_y, max_y, max_y])
    if inside_rings(cx, cy, rings).any():
        return True
    for xs, ys in rings:
        if ((xs >= min_x) & (xs <= max_x) & (ys >= min_y) & (ys <= max_y)).any():
            return True
        dx, dy = np.roll(xs, -1) - xs, np.roll(ys, -1) - ys
        low, high = np.zeros(len(xs)), np.ones(len(xs))
        alive = np.ones(len(xs), bool)
        for p, q in ((-dx, xs - min_x), (dx, max_x - xs), (-dy, ys - min_y), (dy, max_y - ys)):
            with np.errstate(divide="ignore", invalid="ignore"):
                t = q / p
            alive &= ~((p == 0) & (q < 0))
            low = np.where(p < 0, np.maximum(low, t), low)
            high = np.where(p > 0, np.minimum(high, t), high)
        if (alive & (low <= high)).any():
            return True
    return False


def scenes_in_aoi(near: DataFrame, rings: DataFrame, by: str = "aoi_id") -> DataFrame:
    """Rows of near (by and an envelope, already near by boxes) whose envelope meets a polygon of the area."""
    polys = rings.groupBy(by, "poly").agg(F.collect_list("points").alias("_rings"))
    schema = near.schema

    def of(batches):
        for pdf in batches:
            shapes = [[(np.array([p["x"] for p in r], float), np.array([p["y"] for p in r], float)) for r in rings] for rings in pdf["_rings"]]
            ok = [rectangle_meets_rings(*box, shape) for *box, shape in zip(pdf["min_x"], pdf["min_y"], pdf["max_x"], pdf["max_y"], shapes)]
            yield pdf.loc[ok, schema.names]

    return near.join(polys.drop("poly"), by).mapInPandas(of, schema).distinct()


def clip_to_aoi(cells: DataFrame, aoi: DataFrame) -> DataFrame:
    """Detection cells (with their columns) inside the area."""
    return cells.join(aoi.select("y", "x").distinct(), ["y", "x"], "left_semi")


def subtract_overlapping(new: DataFrame, base: DataFrame, min_cells: int = 0, by: str = "component") -> DataFrame:
    """New detection cells without those of base; features left with fewer than min_cells are dropped."""
    left = new.join(base.select("tile_id", "y", "x").distinct(), ["tile_id", "y", "x"], "left_anti")
    if min_cells <= 0:
        return left
    return left.join(left.groupBy("tile_id", by).agg(F.count("*").alias("_n")).where(F.col("_n") >= min_cells).select("tile_id", by), ["tile_id", by], "left_semi")


def dissolve(cells: DataFrame) -> DataFrame:
    """(dn, y, x): the union of all features of a class, classes below 1 as 1; shuffled by cell, never by class alone."""
    return cells.select(F.when(F.col("dn") <= 0, 1).otherwise(F.col("dn")).alias("dn"), "y", "x").dropDuplicates(["dn", "y", "x"])


def union_tiles(parts: list[DataFrame]) -> DataFrame:
    """The features of all parts as one set; columns that a part lacks are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def filter_features(features: DataFrame, min_area: float = 0.0) -> DataFrame:
    """Features of a class above 0 and, where min_area is positive, at least that large."""
    out = features.where("dn > 0")
    return out.where(F.col("area") >= min_area) if min_area > 0 else out


def feature_count(features: DataFrame, by: str = "job_id") -> DataFrame:
    """(by, n, error): features of each result; none is an error."""
    n = F.count("dn")
    return features.groupBy(by).agg(n.alias("n"), F.when(n == 0, "no polygons").alias("error"))


def simplify_ring(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas and Peucker's simplification of a closed ring; it keeps at least a triangle, else the ring as it is."""
    keep = np.zeros(len(points), bool)
    far = int(((points - points[0]) ** 2).sum(axis=1).argmax())
    keep[[0, far, -1]] = True
    stack = [(0, far), (far, len(points) - 1)]
    while stack:
        a, b = stack.pop()
        if b <= a + 1:
            continue
        p, q, mid = points[a], points[b], points[a + 1 : b]
        length = np.hypot(*(q - p))
        away = np.abs((q[0] - p[0]) * (mid[:, 1] - p[1]) - (q[1] - p[1]) * (mid[:, 0] - p[0])) / length if length else np.hypot(*(mid - p).T)
        if away.max() > tolerance:
            k = a + 1 + int(away.argmax())
            keep[k] = True
            stack += [(a, k), (k, b)]
    return points[keep] if keep.sum() >= 4 else points


def simplify(features: DataFrame, tolerance: float) -> DataFrame:
    """Features with simpler rings; unchanged for a tolerance of 0."""
    if tolerance <= 0:
        return features

    def of(batches):
        for pdf in batches:
            yield pdf.assign(rings=[[simplify_ring(np.array([list(p) for p in r], float), tolerance).tolist() for r in rings] for rings in pdf["rings"]])

    return features.mapInPandas(of, features.schema)


def to_multipolygon(rings: Column) -> Column:
    """Coordinates of one polygon as those of a MultiPolygon."""
    return F.array(rings)
