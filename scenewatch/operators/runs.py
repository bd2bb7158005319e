"""Whole runs: from the catalog and pixels to the features of one period, of two, or of a series of slices of a period.

Pixels have scene_id beside tile_id, y, x, date and bands, all on one grid a tile. What a run scores (a scene, a pair, a series) has a
key, which stands in the place of tile_id throughout; none is collected, and all of them are scored as one table.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenewatch.functions.names import scene_key
from scenewatch.operators import components, planning, raster, scoring, selection, vector

PAIR_MODES = ("concat", "newer_only", "union")


@dataclass(frozen=True)
class Finding:
    """How features are made of a model's output; all of it is a model's spec.

    Regions under min_px cells go, then features under min_area; what is left is clipped to the area, so that slivers at its edge are
    those of large features and stay. With merge, features of all keys that share cells become one: places has (tile_id, dy, dx), where each
    tile lies on a grid of all tiles.
    """

    tile: int = 256
    bound: int = 32
    limit: float = 0.5
    min_px: int = 1
    connectivity: int = 4
    min_area: float = 0.0
    tolerance: float = 0.0
    gt: tuple[float, ...] | None = None
    merge: bool = False
    places: DataFrame | None = None


def allowed_scenes(scenes: DataFrame, rings: DataFrame | None) -> DataFrame:
    """Scenes whose envelope meets some polygon of rings (aoi_id, poly, ring, points); all of them without rings."""
    if rings is None:
        return scenes
    xs, ys = coordinates("x"), coordinates("y")
    boxes = rings.groupBy("aoi_id").agg(F.min(F.array_min(xs)).alias("min_x"), F.min(F.array_min(ys)).alias("min_y"), F.max(F.array_max(xs)).alias("max_x"), F.max(F.array_max(ys)).alias("max_y"))
    near = planning.scenes_in_boxes(scenes, boxes)
    return vector.scenes_in_aoi(near, rings).select(*scenes.columns).distinct()


def coordinates(name: str) -> Column:
    return F.transform("points", lambda p: p[name])


def selected(scenes: DataFrame, start: str, end: str, cloud: float, rings: DataFrame | None = None) -> DataFrame:
    """The scenes of a period that a run may use: by days and cloud, each once, within the area."""
    return allowed_scenes(selection.dedupe_scenes(selection.filter_scenes(scenes, start, end, cloud)), rings)


def of_keys(pixels: DataFrame, keys: DataFrame) -> DataFrame:
    """Pixels of the scenes in keys (key, tile_id, scene_id), with the key as tile_id."""
    return pixels.join(keys.select("key", "tile_id", "scene_id"), ["tile_id", "scene_id"]).drop("tile_id").withColumnRenamed("key", "tile_id")


def features(cubes: DataFrame, channels: list[str], scorer: scoring.Scorer | Callable[[np.ndarray], np.ndarray], tiles: DataFrame, how: Finding, area: DataFrame | None = None) -> DataFrame:
    """(tile_id, component, dn, area, rings) of what a scorer finds on cubes; tiles has (key, tile_id) for area's cells (tile_id, y, x)."""
    windows = scoring.make_windows(raster.reject_empty_scenes(cubes), how.tile, how.bound)
    cells = scoring.stitch_binary(scoring.score_windows(windows, scorer, channels, how.tile), how.tile, how.bound, how.limit)
    labelled = components.label_components(components.filter_small(cells, how.min_px, how.connectivity), 4)
    if how.min_area > 0:
        pixel = abs(how.gt[1] * how.gt[5]) if how.gt else 1.0
        large = components.component_sizes(labelled, pixel).where(F.col("area") >= how.min_area)
        labelled = labelled.join(large.select("tile_id", "component"), ["tile_id", "component"], "left_semi")
    if area is not None:
        own = area.select("tile_id", "y", "x").distinct().join(tiles.select("tile_id", "key").distinct(), "tile_id").select(F.col("key").alias("tile_id"), "y", "x")
        labelled = labelled.join(own, ["tile_id", "y", "x"], "left_semi")
    if how.merge:
        labelled = merged(labelled, tiles, how.places)
    found = vector.filter_features(vector.polygonize(labelled, list(how.gt) if how.gt else None))
    return vector.simplify(found, how.tolerance)


def merged(labelled: DataFrame, tiles: DataFrame, places: DataFrame | None) -> DataFrame:
    """Regions of all keys as those of one grid, tile_id `all`: cells that several have count once, and what touches is one."""
    at = labelled
    if places is not None:
        own = places.join(tiles.select("tile_id", "key").distinct(), "tile_id").select(F.col("key").alias("tile_id"), "dy", "dx")
        at = at.join(own, "tile_id").withColumns({"y": F.col("y") + F.col("dy"), "x": F.col("x") + F.col("dx")})
    cells = vector.dissolve(at.select(F.col("v").alias("dn"), "y", "x"))
    return components.label_components(cells.select(F.lit("all").alias("tile_id"), "y", "x", F.col("dn").alias("v")), 4)


def counted(found: DataFrame) -> DataFrame:
    """(n, error): how many features a run has; none is the error `no polygons`."""
    n = F.count("dn")
    return found.agg(n.alias("n"), F.when(n == 0, "no polygons").alias("error"))


def single_period(
    scenes: DataFrame, pixels: DataFrame, start: str, end: str, cloud: float, channels: list[str], scorer: scoring.Scorer | Callable[[np.ndarray], np.ndarray], tile: int = 256, bound: int = 32, limit: float = 0.5,
    level: str = "L1C", cloud_mask: str = "full", area: DataFrame | None = None, min_px: int = 1, min_area: float = 0.0, gt: list[float] | None = None, rings: DataFrame | None = None, best: bool = True, how: Finding | None = None,
) -> DataFrame:
    """(tile_id, component, dn, area, rings): what a scorer finds on the scenes of a period, the best one of each tile or all.

    area is a set of cells (tile_id, y, x) to look in, rings are polygons that a scene must meet. With `best` features carry their tile,
    else their scene. how, if given, holds tile, bound and the other ways of finding in one.
    """
    how = how or Finding(tile=tile, bound=bound, limit=limit, min_px=min_px, min_area=min_area, gt=tuple(gt) if gt else None)
    chosen = selected(scenes, start, end, cloud, rings)
    chosen = selection.best_scene_per_tile(chosen) if best else chosen
    keys = chosen.select((F.col("tile_id") if best else scene_key()).alias("key"), "tile_id", "scene_id")
    cubes = raster.build_cube(of_keys(pixels, keys), channels, level, cloud_mask)
    return features(cubes, raster.channel_names(channels), scorer, keys, how, area)


def paired_periods(
    scenes: DataFrame, pixels: DataFrame, new: tuple[str, str], base: tuple[str, str], cloud: float, channels: list[str], scorer: scoring.Scorer | Callable[[np.ndarray], np.ndarray], how: Finding = Finding(),
    pair_mode: str = "concat", level: str = "L1C", cloud_mask: str = "full", area: DataFrame | None = None, rings: DataFrame | None = None,
) -> DataFrame:
    """Features of each pair of a new scene and its base, the latest one of the base period before it; tile_id is `new||base`.

    Pixels invalid in either scene are invalid. concat scores both scenes' channels side by side, older first; newer_only the new
    scene; union both, each alone, and has the features of both.
    """
    if pair_mode not in PAIR_MODES:
        raise ValueError(f"pair_mode is one of {PAIR_MODES}, not {pair_mode}")
    newer, older = selected(scenes, *new, cloud, rings), selected(scenes, *base, cloud, rings)
    pairs = planning.pair_dedup(planning.pair_scenes(newer, older)).withColumn("key", F.concat_ws("||", "new_key", "base_key"))

    def cube(found: DataFrame, end: str) -> tuple[DataFrame, DataFrame]:
        own = found.select(scene_key().alias(end), "scene_id")
        keys = pairs.select("key", "tile_id", end).join(own, end)
        return raster.build_cube(of_keys(pixels, keys), channels, level, cloud_mask), keys

    (a, keys), (b, _) = cube(older, "base_key"), cube(newer, "new_key")
    names = raster.channel_names(channels)
    both = raster.concat_inputs(a, b, names)
    if pair_mode == "concat":
        return features(both, [f"{c}_{k}" for k in (1, 2) for c in names], scorer, keys, how, area)
    one = [features(both.select(*raster.KEY, *[F.col(f"{c}_{k}").alias(c) for c in names], "valid"), names, scorer, keys, how, area) for k in ((2,) if pair_mode == "newer_only" else (1, 2))]
    return one[0] if len(one) == 1 else scoring.union_detections(*one)


def series(
    scenes: DataFrame, pixels: DataFrame, start: str, end: str, cloud: float, n: int, scorer: scoring.Scorer | Callable[[np.ndarray], np.ndarray], how: Finding = Finding(), level: str = "L1C", area: DataFrame | None = None, rings: DataFrame | None = None,
) -> DataFrame:
    """Features of each tile's series of NDVI, one scene for each of n slices of the period."""
    chosen = selected(scenes, start, end, cloud, rings)
    picked = planning.interval_pick(chosen, n, F.lit(start).cast("date"), F.lit(end).cast("date")).select("tile_id", "scene_id", "i")
    rows = pixels.join(picked, ["tile_id", "scene_id"])
    r = raster.reflectances({b: F.col(b) for b in ("b04", "b08")}, F.col("date") if level == "L1C" else None, level)
    cubes = raster.build_ndvi_series(rows.select("tile_id", "i", "y", "x", r["b04"].alias("red"), r["b08"].alias("nir")), n)
    return features(cubes, [f"ndvi_{i}" for i in range(n)], scorer, picked.select(F.col("tile_id").alias("key"), "tile_id"), how, area)
