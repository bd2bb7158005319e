"""Raster tables: grids that meet, valid pixels, cubes of channels, and resampling, one row a pixel."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenewatch.functions import bands
from scenewatch.functions.geo import nearest_index, pixel_to_world
from scenewatch.operators.selection import reference_band

KEY = ("tile_id", "y", "x")
INVALID_SHARE = 99.9


def nodata_percent(pixels: DataFrame, by: str = "tile_id") -> DataFrame:
    """(by, n, nodata_pct) from rows with valid."""
    n = F.count("*")
    return pixels.groupBy(by).agg(n.alias("n"), (100.0 * (n - F.count_if("valid")) / n).alias("nodata_pct"))


def reject_empty_scenes(pixels: DataFrame, by: str = "tile_id", limit: float = INVALID_SHARE) -> DataFrame:
    """Pixels of scenes of which less than `limit` percent are invalid."""
    return pixels.join(nodata_percent(pixels, by).where(F.col("nodata_pct") < limit).select(by), by, "left_semi")


def channel_names(channels: list[str]) -> list[str]:
    return [c.strip().lower() for c in channels]


def is_ndvi(name: str) -> bool:
    return name.startswith("ndvi") or name == "ndvog"


def reflectances(raw: dict[str, Column], day: Column | None, level: str) -> dict[str, Column]:
    """Bands by name as reflectances of the level."""
    return {b: bands.toa(v, day) if level == "L1C" else bands.boa(v) for b, v in raw.items()}


def validity(r: dict[str, Column], channels: list[str], level: str, cloud: str, scl: Column | None = None) -> Column:
    """Whether a pixel of reflectances r is valid for these channels: some positive one, no cloud, a clear scene class."""
    mode = bands.cloud_mask_mode(channels, cloud)
    cloudy = None
    if mode != "none" and level == "L1C" and {"b10", "b11", "b12"} <= r.keys():
        more = [r.get(b) for b in ("b02", "b03", "b04")] if mode == "full" else []
        cloudy = bands.cloud_mask(r["b10"], r["b11"], r["b12"], *more)
    used = [c for n in channel_names(channels) for c in ([r["b04"], r["b08"]] if is_ndvi(n) else [r[n]])]
    valid = bands.valid_pixel(used, cloudy)
    return valid if scl is None else valid & bands.scl_valid(scl)


def channel(name: str, r: dict[str, Column], valid: Column) -> Column:
    return F.when(valid, bands.ndvi_unit(r["b04"], r["b08"])).otherwise(bands.f32(0)) if is_ndvi(name) else r[name]


def build_cube(pixels: DataFrame, channels: list[str], level: str = "L1C", cloud: str = "full", scl: str | None = None) -> DataFrame:
    """(tile_id, y, x, one column a channel, valid) from digital numbers on one grid.

    Bands become reflectances by level; a channel NDVI is made from b04 and b08. A pixel is valid if some channel is
    positive (for NDVI, red or infrared), it is not cloudy and its scene class, if given, is clear.
    """
    have = [c for c in pixels.columns if c.startswith("b") and c[1:3].isdigit()]
    r = reflectances({b: F.col(b) for b in have}, F.col("date") if level == "L1C" else None, level)
    valid = validity(r, channels, level, cloud, F.col(scl) if scl else None)
    cube = pixels.select(*KEY, *[r[b].alias(f"_{b}") for b in have], valid.alias("valid"))
    made = {b: F.col(f"_{b}") for b in have}
    return cube.select(*KEY, *[channel(n, made, F.col("valid")).alias(n) for n in channel_names(channels)], "valid")


def on_reference_grid(values: DataFrame, grids: DataFrame, level: str = "L1C", **choice) -> DataFrame:
    """(tile_id, y, x, gt, a column a band) of each scene on the grid of its reference band, bands resampled to the nearest.

    values: (tile_id, band, y, x, v), tile_id standing for a scene; grids: (tile_id, nth, band, w, h, gt) without
    rotation. choice goes to selection.reference_band(). Where a band has no pixel its value is 0. Band names become
    lower-case columns; there is a handful of them.
    """
    chosen = reference_band(grids.withColumnRenamed("tile_id", "scene_id"), level, **choice).select(F.col("scene_id").alias("tile_id"), "band", F.col("gt").alias("ref_gt"))
    names = sorted(r.band for r in grids.select("band").distinct().collect())
    ref = values.join(chosen, ["tile_id", "band"]).select(*KEY, "ref_gt")
    wanted = ref.join(grids.select("tile_id", "band", "gt"), "tile_id")
    wx, wy = pixel_to_world(F.col("ref_gt"), F.col("x") + 0.5, F.col("y") + 0.5)
    at = wanted.select(*KEY, "ref_gt", "band", nearest_index(wy, F.col("gt")[3], F.col("gt")[5]).alias("_y"), nearest_index(wx, F.col("gt")[0], F.col("gt")[1]).alias("_x"))
    of = values.select("tile_id", "band", F.col("y").cast("int").alias("_y"), F.col("x").cast("int").alias("_x"), "v")
    found = at.join(of, ["tile_id", "band", "_y", "_x"], "left")
    columns = [F.coalesce(F.max(F.when(F.col("band") == n, F.col("v"))), F.lit(0).cast(values.schema["v"].dataType)).alias(n.lower()) for n in names]
    return found.groupBy(*KEY).agg(F.first("ref_gt").alias("gt"), *columns)


def combine_valid(cubes: list[DataFrame]) -> DataFrame:
    """Pixels that all cubes have, valid where all are."""
    parts = [c.select(*KEY, F.col("valid").alias(f"_v{i}")) for i, c in enumerate(cubes)]
    both = reduce(lambda a, b: a.join(b, list(KEY)), parts)
    return both.select(*KEY, reduce(lambda a, b: a & b, [F.col(f"_v{i}") for i in range(len(cubes))]).alias("valid"))


def align_pairs(a: DataFrame, b: DataFrame, grid_a: DataFrame, grid_b: DataFrame, channels: list[str]) -> DataFrame:
    """(tile_id, y, x, a_.., b_.., valid) on the rectangle that two grids share, counted from its corner.

    grids: (tile_id, gt, h, w). Pixel sizes that differ by over 1e-6 and grids that do not meet are errors. A pixel
    invalid in either is invalid and zero in both.
    """
    g = grid_a.alias("a").join(grid_b.alias("b"), "tile_id")
    px, py = F.col("a.gt")[1], F.col("a.gt")[5]
    dx, dy = F.round((F.col("b.gt")[0] - F.col("a.gt")[0]) / px), F.round((F.col("b.gt")[3] - F.col("a.gt")[3]) / py)
    x0, y0 = F.greatest(F.lit(0), dx), F.greatest(F.lit(0), dy)
    x1, y1 = F.least(F.col("a.w"), dx + F.col("b.w")), F.least(F.col("a.h"), dy + F.col("b.h"))
    differ = (F.abs(px - F.col("b.gt")[1]) > 1e-6) | (F.abs(py - F.col("b.gt")[5]) > 1e-6)
    wrong = F.when(differ, F.lit("pixel sizes differ")).when((x1 <= x0) | (y1 <= y0), F.lit("grids do not meet"))
    frame = g.select("tile_id", *[F.when(wrong.isNotNull(), F.raise_error(wrong).cast("int")).otherwise(c.cast("int")).alias(n) for n, c in (("x0", x0), ("y0", y0), ("x1", x1), ("y1", y1), ("dx", dx), ("dy", dy))])
    one = a.join(frame, "tile_id").where("x >= x0 and x < x1 and y >= y0 and y < y1").select("tile_id", (F.col("y") - F.col("y0")).alias("y"), (F.col("x") - F.col("x0")).alias("x"), *[F.col(c).alias(f"a_{c}") for c in channels], F.col("valid").alias("_va"))
    two = b.join(frame, "tile_id").select("tile_id", (F.col("y") + F.col("dy") - F.col("y0")).alias("y"), (F.col("x") + F.col("dx") - F.col("x0")).alias("x"), *[F.col(c).alias(f"b_{c}") for c in channels], F.col("valid").alias("_vb"))
    both = one.join(two, list(KEY)).withColumn("valid", F.col("_va") & F.col("_vb"))
    values = [F.when(F.col("valid"), F.col(f"{k}_{c}")).otherwise(bands.f32(0)).alias(f"{k}_{c}") for k in "ab" for c in channels]
    return both.select(*KEY, *values, "valid")


def concat_inputs(older: DataFrame, newer: DataFrame, channels: list[str], pair_mode: str = "concat") -> DataFrame:
    """Channels of both periods side by side, older first; newer_only keeps the new one."""
    if pair_mode == "newer_only":
        return newer.select(*KEY, *channels, "valid")
    a = older.select(*KEY, *[F.col(c).alias(f"{c}_1") for c in channels], F.col("valid").alias("_v1"))
    b = newer.select(*KEY, *[F.col(c).alias(f"{c}_2") for c in channels], F.col("valid").alias("_v2"))
    return a.join(b, list(KEY)).select(*KEY, *[f"{c}_1" for c in channels], *[f"{c}_2" for c in channels], (F.col("_v1") & F.col("_v2")).alias("valid"))


def crop(cells: DataFrame, x0: int, y0: int, w: int, h: int) -> DataFrame:
    """Cells of a window counted from its corner; gt, if there, is moved along. Parts outside the grid do not exist."""
    out = cells.where((F.col("x") >= x0) & (F.col("y") >= y0) & (F.col("x") < x0 + w) & (F.col("y") < y0 + h))
    x0, y0 = max(0, x0), max(0, y0)
    if "gt" in cells.columns:
        g = F.col("gt")
        out = out.withColumn("gt", F.array(g[0] + x0 * g[1] + y0 * g[2], g[1], g[2], g[3] + x0 * g[4] + y0 * g[5], g[4], g[5]))
    return out.withColumns({"x": F.col("x") - x0, "y": F.col("y") - y0})


def resample_nearest_geo(src: DataFrame, ref: DataFrame, src_gt: list[float], ref_gt: list[float], value: str = "v") -> DataFrame:
    """ref cells (tile_id, y, x) with the value of the nearest src cell by world position; 0 where src has none."""
    wx, wy = ref_gt[0] + (F.col("x") + 0.5) * ref_gt[1], ref_gt[3] + (F.col("y") + 0.5) * ref_gt[5]
    at = ref.select(*KEY, nearest_index(wy, F.lit(src_gt[3]), F.lit(src_gt[5])).alias("_y"), nearest_index(wx, F.lit(src_gt[0]), F.lit(src_gt[1])).alias("_x"))
    of = src.select("tile_id", F.col("y").cast("int").alias("_y"), F.col("x").cast("int").alias("_x"), F.col(value))
    return at.join(of, ["tile_id", "_y", "_x"], "left").select(*KEY, F.coalesce(value, F.lit(0).cast(src.schema[value].dataType)).alias(value))


def corners(at: Column, src: int, ref: int) -> tuple[Column, Column, Column]:
    """(low, high, weight of high) of the source positions around a target position along one axis."""
    s = (at + 0.5) * (src / ref) - 0.5
    low = F.floor(s)
    return F.greatest(low, F.lit(0)).cast("int"), F.least(low + 1, F.lit(src - 1)).cast("int"), (s - low).cast("float")


def resample_bilinear(src: DataFrame, src_size: tuple[int, int], ref_size: tuple[int, int], value: str = "v") -> DataFrame:
    """(tile_id, y, x, value) on the target grid: pixel centres, weights in single precision; a zero neighbour gives 0.

    src has every cell of each tile; sizes are (h, w). Each source cell is sent to the target cells that it touches.
    """
    if src_size == ref_size:
        return src.select(*KEY, value)
    (h, w), (rh, rw) = src_size, ref_size

    def touched(n: int, m: int, name: str) -> DataFrame:
        axis = src.sparkSession.range(m).select(F.col("id").cast("int").alias(name))
        low, high, weight = corners(F.col(name), n, m)
        return axis.select(name, F.explode(F.array(F.struct(F.lit(0).alias("k"), low.alias("s")), F.struct(F.lit(1).alias("k"), high.alias("s")))).alias("c"), weight.alias("f" + name)).select(name, F.col("c.k").alias("k" + name), F.col("c.s").alias("s" + name), "f" + name)

    ys, xs = touched(h, rh, "ty"), touched(w, rw, "tx")
    spread = src.join(ys, src["y"] == ys["sty"]).join(xs, src["x"] == xs["stx"])
    corner = {(j, i): F.max(F.when((F.col("kty") == j) & (F.col("ktx") == i), F.col(value))) for j in (0, 1) for i in (0, 1)}
    four = spread.groupBy("tile_id", "ty", "tx").agg(F.first("fty").alias("fy"), F.first("ftx").alias("fx"), *[c.alias(f"v{j}{i}") for (j, i), c in corner.items()])
    one, fx, fy = bands.f32(1), F.col("fx"), F.col("fy")
    top = ((F.col("v00") * (one - fx)).cast("float") + (F.col("v01") * fx).cast("float")).cast("float")
    low = ((F.col("v10") * (one - fx)).cast("float") + (F.col("v11") * fx).cast("float")).cast("float")
    mixed = ((top * (one - fy)).cast("float") + (low * fy).cast("float")).cast("float")
    empty = reduce(lambda a, b: a | b, [F.col(f"v{j}{i}") == 0 for j in (0, 1) for i in (0, 1)])
    return four.select("tile_id", F.col("ty").alias("y"), F.col("tx").alias("x"), F.when(empty, bands.f32(0)).otherwise(mixed).alias(value))


def build_ndvi_series(picked: DataFrame, n: int) -> DataFrame:
    """(tile_id, y, x, ndvi_0.., valid) from rows (tile_id, i, y, x, red, nir) of the scene picked for each interval.

    A pixel without a positive band in any interval is invalid throughout, and 0.
    """
    v = bands.ndvi_clipped(F.col("red"), F.col("nir"))
    wide = picked.withColumn("v", v).groupBy(*KEY).agg((F.count("v") == n).alias("valid"), *[F.max(F.when(F.col("i") == i, F.col("v"))).alias(f"_{i}") for i in range(n)])
    return wide.select(*KEY, *[F.when(F.col("valid"), F.col(f"_{i}")).otherwise(bands.f32(0)).alias(f"ndvi_{i}") for i in range(n)], "valid")


def pixels_of(blocks: DataFrame, size: int = 512) -> DataFrame:
    """(scene_id, tile_id, band, y, x, v) of band blocks, by their place in the grid of blocks."""
    return blocks.select("scene_id", "tile_id", "band", "by", "bx", "w", F.posexplode("data").alias("i", "v")).select(
        "scene_id", "tile_id", "band", (F.col("by") * size + F.floor(F.col("i") / F.col("w"))).cast("int").alias("y"), (F.col("bx") * size + F.col("i") % F.col("w")).cast("int").alias("x"), "v"
    )


def block_math(blocks: DataFrame, by: list[str], f, *names: str) -> DataFrame:
    """Blocks of several bands, one column of values each, combined value by value: f takes the bands' columns.

    For equal grids this joins and shuffles blocks, not pixels.
    """
    wide = blocks.groupBy(*by).agg(*[F.max_by("data", F.when(F.col("band") == n, F.lit(1))).alias(n) for n in names])
    return wide.withColumn("data", F.transform(F.arrays_zip(*[F.col(n) for n in names]), lambda s: f(*[s[n] for n in names]))).drop(*names)
