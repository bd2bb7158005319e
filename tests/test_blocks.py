"""Rasters as blocks against the same on pixels, and against loops."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scenewatch.operators import blocks, raster, scoring
from tests.compare import rows_of

BANDS = ["b02", "b03", "b04", "b08", "b10", "b11", "b12"]


@pytest.fixture(scope="module")
def pixels(spark):
    """Two tiles with holes, zeros and clouds."""
    rng = np.random.default_rng(1)
    y, x = np.divmod(np.arange(23 * 31), 31)
    parts = []
    for t in "ab":
        frame = pd.DataFrame({"tile_id": t, "y": y, "x": x, **{b: rng.choice([0, 20, 300, 900, 2500, 12000], len(y)).astype(np.float32) for b in BANDS}, "scl": rng.choice([3.6, 4.0, 8.0], len(y)).astype(np.float32)})
        parts.append(frame[rng.random(len(y)) < 0.9])
    return spark.createDataFrame(pd.concat(parts)).withColumn("date", F.when(F.col("tile_id") == "a", F.lit("2022-01-20")).otherwise("2023-01-01").cast("date")).repartition(3)


@pytest.mark.parametrize(("channels", "level", "cloud", "scl"), [(["NDVI"], "L1C", "simple", None), (["B04", " b08", "NDVI_0"], "L1C", "full", None), (["B04", "B03", "B02", "B08"], "L1C", "full", None), (["B11", "NDVI"], "L2A", "full", "scl")])
def test_cubes_of_blocks_are_those_of_pixels(pixels, channels, level, cloud, scl):
    made = blocks.to_blocks(pixels, [*BANDS, "scl"], 8, ("date",))
    got = blocks.cube(made, channels, level, cloud, scl)
    assert rows_of(blocks.cells(got, *raster.channel_names(channels), "valid")) == rows_of(raster.build_cube(pixels, channels, level, cloud, scl))
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString().split("MapInPandas")[0]


def test_series_of_blocks_are_those_of_pixels(pixels):
    rows = pixels.withColumn("i", F.when(F.col("tile_id") == "a", 0).otherwise(1)).withColumn("tile_id", F.lit("t"))
    rows = rows.unionByName(rows.where("i = 0").withColumns({"tile_id": F.lit("lone")}))
    flat = rows.select("tile_id", "i", "y", "x", F.col("b04").alias("red"), F.col("b08").alias("nir"))
    want = raster.build_ndvi_series(flat, 2)
    made = [blocks.to_blocks(flat.where(F.col("i") == i).drop("i"), ["red", "nir"], 8).withColumn("i", F.lit(i)) for i in (0, 1)]
    got = blocks.ndvi_series(made[0].unionByName(made[1]), 2)
    assert rows_of(blocks.cells(got, "ndvi_0", "ndvi_1", "valid")) == rows_of(want)


@pytest.mark.parametrize(("tile", "bound", "overlap", "block"), [(4, 1, 0, 8), (5, 0, 2, 8), (6, 1, 0, 8), (11, 2, 0, 4), (3, 0, 0, 64), (8, 0, 0, 8)])
def test_windows_of_blocks_are_those_of_pixels(pixels, tile, bound, overlap, block):
    """A model that looks at whole windows, so that context counts."""
    model = lambda w: np.stack([w.sum(axis=(1, 2, 3))[:, None, None] + w[:, 0], w[:, 1] * 2], axis=1)
    cube = raster.build_cube(pixels, ["B04", "B08"], "L1C", "full").where("valid or y > 3")
    want = scoring.score_windows(scoring.make_windows(cube, tile, bound, overlap), model, ["b04", "b08"], tile, [0.25, 0.5])
    made = blocks.to_blocks(cube.withColumn("valid", F.col("valid").cast("float")), ["b04", "b08", "valid"], block)
    made = made.withColumn("valid", F.transform("valid", lambda v: v > 0))
    got = blocks.window_cells(blocks.score_blocks(made, model, ["b04", "b08"], tile, bound, overlap, [0.25, 0.5], batch=3, block=block))
    a, b = (df.select("tile_id", "wy", "wx", "y", "x", "k", F.round("score", 3).alias("score")) for df in (got, want))
    assert rows_of(a) == rows_of(b) and not a.isEmpty()


def test_only_strips_are_shuffled(spark, pixels):
    made = blocks.to_blocks(pixels, ["b04"], 8).withColumn("valid", F.col("there"))
    plan = blocks.score_blocks(made, lambda w: w, ["b04"], 4, 1, block=8)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan
    kept = blocks.strips(made, ["b04"], 4, 2, 8)
    sent = kept.agg(F.sum(F.size("b04"))).first()[0]
    assert sent < 0.7 * made.agg(F.sum(F.size("b04"))).first()[0]


def resampled(a, m):
    """Bilinear by loops."""
    n = a.shape
    out = np.zeros(m, np.float32)
    for y in range(m[0]):
        for x in range(m[1]):
            if n == m:
                out[y, x] = a[y, x]
                continue
            sy, sx = (y + 0.5) * (n[0] / m[0]) - 0.5, (x + 0.5) * (n[1] / m[1]) - 0.5
            y0, x0 = int(np.floor(sy)), int(np.floor(sx))
            fy, fx = np.float32(sy - y0), np.float32(sx - x0)
            four = a[np.ix_((max(y0, 0), min(y0 + 1, n[0] - 1)), (max(x0, 0), min(x0 + 1, n[1] - 1)))]
            if (four == 0).any():
                continue
            one = np.float32(1)
            top, low = four[0, 0] * (one - fx) + four[0, 1] * fx, four[1, 0] * (one - fx) + four[1, 1] * fx
            out[y, x] = top * (one - fy) + low * fy
    return out


def band_blocks(spark, arrays, block):
    rows = []
    for (tile, band), a in arrays.items():
        for by in range(-(-a.shape[0] // block)):
            for bx in range(-(-a.shape[1] // block)):
                part = a[by * block : (by + 1) * block, bx * block : (bx + 1) * block]
                rows.append((tile, band, by, bx, *part.shape, part.ravel().tolist()))
    return spark.createDataFrame(rows, "tile_id int, band string, by int, bx int, h int, w int, data array<float>").repartition(3)


@pytest.mark.parametrize(("block", "level", "native"), [(8, "L1C", True), (5, "L2A", False), (64, "L1C", True)])
def test_bands_of_other_sizes_are_bilinear_on_the_reference_grid(spark, block, level, native):
    """Bands of 10, 20 and 60 m, and an odd size; zeros spread as no data."""
    rng = np.random.default_rng(block)
    sizes = {"B02": (36, 30), "B11": (18, 15), "B01": (6, 5), "B05": (13, 17)}
    arrays = {(t, b): np.where(rng.random(s) < 0.03, 0, rng.uniform(1, 5000, s)).astype(np.float32) for t in (1, 2) for b, s in sizes.items()}
    del arrays[2, "B01"]
    grids = spark.createDataFrame([(t, k, b, sizes[b][1], sizes[b][0], [float(t), 10.0, 0.0, 0.0, 0.0, -10.0]) for t in (1, 2) for k, b in enumerate(sizes) if (t, b) in arrays], "tile_id int, nth int, band string, w int, h int, gt array<double>")
    got = blocks.on_reference_blocks(band_blocks(spark, arrays, block), grids, ["b02", "b11", "b01", "b05"], level, block, native=native)
    pixels = {(r.tile_id, r.y, r.x): r for r in blocks.cells(got, "b02", "b11", "b01", "b05").collect()}
    assert len(pixels) == 2 * 36 * 30
    for (t, b), a in arrays.items():
        want = resampled(a, (36, 30))
        assert (np.array([[pixels[t, y, x][b.lower()] for x in range(30)] for y in range(36)], np.float32) == want).all(), b
    assert all(r.b01 == 0 for k, r in pixels.items() if k[0] == 2)


def test_stacked(spark):
    a, b = (np.arange(12, dtype=np.float32).reshape(3, 4) + k for k in (0, 100))
    wide = blocks.stacked(band_blocks(spark, {(1, "B04"): a, (1, "B08"): b, (2, "B04"): a}, 2), ["b04", "b08"], block=2)
    got = {(r.tile_id, r.y, r.x): (r.b04, r.b08) for r in blocks.cells(wide, "b04", "b08").collect()}
    assert got == {(t, y, x): (a[y, x], b[y, x] if t == 1 else 0) for t in (1, 2) for y in range(3) for x in range(4)}


def test_years_of_blocks_differ_without_a_shuffle(spark):
    """Base blocks that are missing count as sick before; the join of both years has no exchange below it."""
    rng = np.random.default_rng(4)
    y, x = np.divmod(np.arange(20 * 20), 20)
    frame = pd.DataFrame({"tile_id": 1, "y": y, "x": x, "v": rng.uniform(0.5, 1.5, 400).astype(np.float32)})
    base = frame[(frame.y < 12) & (rng.random(400) < 0.8)].assign(v=rng.uniform(0.5, 1.5, 400).astype(np.float32)[: len(frame)][(frame.y < 12).to_numpy().nonzero()[0][0]])
    made = [blocks.to_blocks(spark.createDataFrame(f), ["v"], 4).withColumn("vog1", F.transform("v", lambda v: F.when(v > 0.6, v))).drop("v") for f in (frame, base)]
    tables = [blocks.bucketed(m, 4) for m in made]
    limits = spark.createDataFrame([(1, 0.9, 0.8)], "tile_id long, threshold float, base_threshold float")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got = blocks.mask_diff(*tables, limits)
        plan = got._jdf.queryExecution().executedPlan().toString()
        rows = {(r.y, r.x): (r.sick, r.newly_sick) for r in blocks.cells(got, "sick", "newly_sick").collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "Exchange hashpartitioning" not in plan
    was = {(r.y, r.x): np.float32(0.6) < np.float32(r.v) < np.float32(0.8) for r in base.itertuples()}
    assert rows == {(r.y, r.x): ((s := bool(np.float32(0.6) < r.v < np.float32(0.9))), s and not was.get((r.y, r.x), True)) for r in frame.itertuples()}


def test_pixels_that_are_not_there_cost_nothing(pixels):
    """Arrays reach Spark as Arrow lists, and band maths skips holes: what no pixel is has no reflectance, is 0 and not valid."""
    made = blocks.to_blocks(pixels, BANDS, 8, ("date",))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("MapInPandas")
    for found, name in ((blocks.cube(made, ["B04"], "L1C", "none"), "b04"), (blocks.cloud_masks(made), "b04")):
        seen = found.select(F.explode(F.arrays_zip("there", name, *[c for c in ("valid", "simple", "full") if c in found.columns])).alias("p")).select("p.*")
        holes = seen.where("not there").drop("there").distinct().collect()
        assert len(holes) == 1 and not any(holes[0])
    maths = blocks.cube(made, ["B04"], "L1C", "none")._jdf.queryExecution().optimizedPlan().toString()
    assert ".there THEN" in maths


def test_windows_of_many_blocks_go_to_the_model_together(spark):
    """Blocks with few windows fill a call of the model, whichever blocks they come from."""
    rows = [(t, y, x, float(t + y * 4 + x)) for t in range(6) for y in range(4) for x in range(4)]
    made = blocks.to_blocks(spark.createDataFrame(rows, "tile_id int, y int, x int, v float"), ["v"], 2).withColumn("valid", F.col("there"))

    def calls(windows):
        return np.full_like(windows[:, :1], len(windows))

    found = blocks.score_blocks(made, calls, ["v"], 2, batch=4, block=2)
    assert [r.scores[0][0] for r in found.collect()] == [4] * 24
