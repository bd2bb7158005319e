"""Queries on the block layout: the rows of the same work on pixels, with the same SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from scenewatch.jobs import fixtures as x
from scenewatch.jobs import grid_queries as g
from scenewatch.jobs import scene_queries as sc
from scenewatch.operators import areas, blocks, scoring

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return keep


def grid_blocks(spark, d):
    """Digital numbers of eight tiles as blocks of 8 x 8 pixels, as the grid is seven pixels wide."""
    return blocks.to_blocks(x.grid_pixels(spark, d), list(x.BANDS), 8, ("date",))


@query(g.ORACLES["build_cube"])
def block_cube(spark, d):
    return blocks.cells(blocks.cube(grid_blocks(spark, d), ["NDVI"], "L1C", "simple"), "ndvi", "valid")


@query(g.ORACLES["cloud_masks"])
def block_cloud_masks(spark, d):
    return blocks.cells(blocks.cloud_masks(grid_blocks(spark, d)), "b04", "b08", "simple", "full")


@query(g.ORACLES["ndvi_series"])
def block_ndvi_series(spark, d):
    made = blocks.to_blocks(x.grid_pixels(spark, d), ["b04", "b08"], 8)
    picked = made.select((F.col("tile_id") % 2).alias("tile_id"), "by", "bx", "y0", "x0", "h", "w", "there", F.floor(F.col("tile_id") / 2).alias("i"), F.col("b04").alias("red"), F.col("b08").alias("nir"))
    return blocks.cells(blocks.ndvi_series(picked, 4), *[f"ndvi_{i}" for i in range(4)], "valid")


def patch_blocks(spark, d):
    made = blocks.to_blocks(x.patches(spark, d).select(F.col("vec_id").alias("tile_id"), "y", "x", "v", "dn"), ["v", "dn"], 4)
    return made.withColumn("valid", F.transform("dn", lambda n: n > 0))


@query(g.ORACLES["score_binary"])
def block_scores(spark, d):
    """Windows of 4 with a bound of 1 over blocks of 4, so that each of them reaches beyond its block."""
    found = blocks.score_blocks(patch_blocks(spark, d), g.contrast, ["v"], 4, bound=1, block=4)
    return scoring.stitch_binary(blocks.window_cells(found), 4, 1, 0.25)


def brightest(windows: np.ndarray) -> np.ndarray:
    """The greatest value of each window's valid pixels, so that context counts."""
    return np.broadcast_to(windows[:, :1].max(axis=(2, 3), keepdims=True), windows[:, :1].shape)


@query(
    f"WITH {x.PATCHES}, k AS (SELECT unnest(range(0, 8, 2)) AS o), w AS (SELECT vec_id AS tile_id, y, x, CAST(a.o // 2 AS INT) AS wy, CAST(b.o // 2 AS INT) AS wx, CASE WHEN dn > 0 THEN v END AS v FROM patches JOIN k a ON y >= a.o AND y < a.o + 4 JOIN k b ON x >= b.o AND x < b.o + 4) SELECT tile_id, wy, wx, count(v) AS n, max(v) AS score FROM w GROUP BY ALL HAVING count(v) > 0"
)
def block_windows(spark, d):
    found = blocks.window_cells(blocks.score_blocks(patch_blocks(spark, d), brightest, ["v"], 4, bound=1, means=[-1.0], block=4))
    return found.groupBy("tile_id", "wy", "wx").agg(F.count("*").alias("n"), F.max("score").alias("score"))


@query(
    f"""WITH {x.PATCHES}, t AS (SELECT vec_id, y, x, v FROM patches), c AS (SELECT vec_id, y // 2 AS y, x // 2 AS x, CASE WHEN min(dn) = 0 THEN 0 ELSE max(CAST(dn AS FLOAT)) END AS v FROM patches GROUP BY ALL),
    a AS (SELECT unnest(range(8)) AS p, greatest(0, CAST(floor((p + 0.5) / 2 - 0.5) AS INT)) AS lo, least(3, CAST(floor((p + 0.5) / 2 - 0.5) AS INT) + 1) AS hi, (p + 0.5) / 2 - 0.5 - floor((p + 0.5) / 2 - 0.5) AS f),
    q AS (SELECT t.vec_id, t.y, t.x, t.v, ay.f AS fy, ax.f AS fx, c00.v AS c00, c01.v AS c01, c10.v AS c10, c11.v AS c11 FROM t JOIN a ay ON ay.p = t.y JOIN a ax ON ax.p = t.x
      JOIN c c00 ON c00.vec_id = t.vec_id AND c00.y = ay.lo AND c00.x = ax.lo JOIN c c01 ON c01.vec_id = t.vec_id AND c01.y = ay.lo AND c01.x = ax.hi
      JOIN c c10 ON c10.vec_id = t.vec_id AND c10.y = ay.hi AND c10.x = ax.lo JOIN c c11 ON c11.vec_id = t.vec_id AND c11.y = ay.hi AND c11.x = ax.hi)
    SELECT vec_id AS tile_id, CAST(y AS INT) AS y, CAST(x AS INT) AS x, v AS b04, CAST(CASE WHEN c00 = 0 OR c01 = 0 OR c10 = 0 OR c11 = 0 THEN 0 ELSE (c00 * (1 - fx) + c01 * fx) * (1 - fy) + (c10 * (1 - fx) + c11 * fx) * fy END AS FLOAT) AS b11 FROM q"""
)
def on_reference_grid(spark, d):
    """A band of 8 x 8 pixels and one of 4 x 4 over the same ground meet on the finer grid."""
    at = x.patches(spark, d).select(F.col("vec_id").alias("tile_id"), "y", "x", "v", "dn")
    half = at.groupBy("tile_id", F.floor(F.col("y") / 2).alias("y"), F.floor(F.col("x") / 2).alias("x")).agg(F.when(F.min("dn") == 0, 0).otherwise(F.max("dn")).cast("float").alias("v"))
    both = [blocks.to_blocks(rows.select("tile_id", "y", "x", "v"), ["v"], 3).withColumn("band", F.lit(b)) for b, rows in (("B04", at), ("B11", half))]
    # blocks of 3 over grids of 8 and 4: the last ones are cut to the grid
    size = F.when(F.col("band") == "B04", 8).otherwise(4)
    whole = both[0].unionByName(both[1]).withColumns({"h": F.least(F.lit(3), size - F.col("y0")), "w": F.least(F.lit(3), size - F.col("x0"))})
    inside = F.filter(F.arrays_zip("v", F.sequence(F.lit(0), F.lit(8)).alias("i")), lambda s: (s["i"] % 3 < F.col("w")) & (F.floor(s["i"] / 3) < F.col("h")))
    cut = whole.withColumn("data", F.transform(inside, lambda s: s["v"])).select("tile_id", "band", "by", "bx", "h", "w", "data")
    tiles = at.select("tile_id").distinct()
    grids = tiles.select("tile_id", F.explode(F.array(*[F.struct(F.lit(k).alias("nth"), F.lit(b).alias("band"), F.lit(n).alias("w"), F.lit(n).alias("h"), F.array(*[F.lit(v) for v in (0.0, p, 0.0, 0.0, 0.0, -p)]).alias("gt")) for k, (b, n, p) in enumerate((("B04", 8, 10.0), ("B11", 4, 20.0)))])).alias("g")).select("tile_id", "g.*")
    return blocks.cells(blocks.on_reference_blocks(cut, grids, ["b04", "b11"], native=True, block=3), "b04", "b11")


@query(sc.ORACLES["pathology_diff"])
def block_pathology_diff(spark, d):
    grid = x.grid_pixels(spark, d)
    even, odd = grid.where("tile_id % 2 = 0"), grid.where("tile_id % 2 = 1").withColumn("tile_id", F.col("tile_id") - 1)
    years = [blocks.to_blocks(year, list(x.BANDS), 8, ("date",)) for year in (even, odd)]
    found = blocks.cells(blocks.pathology_diff(*years, buckets=8), "sick", "newly_sick")
    return found.groupBy("tile_id").agg(F.count("*").alias("n"), F.count_if("sick").alias("sick"), F.count_if("newly_sick").alias("newly_sick"))


@query(g.ORACLES["clip_to_aoi"])
def clip_by_cover(spark, d):
    """Detections inside a ring with a hole, met by squares of 64 x 64 cells."""
    rings = spark.createDataFrame([("a", 0, k, [{"x": a, "y": b} for a, b in r]) for k, r in enumerate((g.SQUARE, g.HOLE))], "aoi_id string, poly int, ring int, points array<struct<x:double,y:double>>")
    rows = x.patches(spark, d).where("dn > 0").select(F.col("vec_id").alias("tile_id"), "dn", F.col("y").cast("long"), (F.col("x") + 8 * (F.col("vec_id") % 50)).alias("x"))
    return areas.clip(rows, areas.cover(rings, 0.0, 0.0, 1.0)).select("tile_id", "dn", "y", "x")
