"""One mosaic from many tiles: a common scale for colours, reprojection to a target grid, and the overlay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenewatch.functions.bands import linear_scale
from scenewatch.functions.geo import lonlat_to_mercator, mercator_to_lonlat, utm_to_wgs84, wgs84_to_utm
from scenewatch.operators.graph import cut

#: Limits of 16-bit values, and the scale without any.
LEAST, MOST, FALLBACK = 1.0, 65535.0, (1.0, 10000.0)


def band_stats(values: DataFrame, stride: int = 10) -> DataFrame:
    """(tile_id, band, n, low, high, mean, std) of every stride-th row and column of each band: 1 % of it by default.

    values has tile_id, y, x, band, v. A flat band gets a high of low + 1.
    """
    some = values.where((F.col("y") % stride == 0) & (F.col("x") % stride == 0)) if stride > 1 else values
    v = F.col("v").cast("double")
    stats = some.groupBy("tile_id", "band").agg(F.count(v).alias("n"), F.min(v).alias("low"), F.max(v).alias("high"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"))
    return stats.withColumn("high", F.when(F.col("high") <= F.col("low"), F.col("low") + 1).otherwise(F.col("high")))


def global_scale(stats: DataFrame) -> DataFrame:
    """(band, src_min, src_max): the medians over tiles of mean -+ 2 deviations, in the limits of 16-bit values."""
    std = F.greatest("std", F.lit(1.0))
    low, high = F.greatest(F.lit(LEAST), F.col("mean") - 2.0 * std), F.least(F.lit(MOST), F.col("mean") + 2.0 * std)
    one = stats.select("band", "low", "high", low.alias("a"), high.alias("b"))
    flat = F.col("b") <= F.col("a")
    a = F.when(flat, F.greatest(F.lit(LEAST), F.col("low"))).otherwise(F.col("a"))
    both = one.withColumns({"a2": a, "b2": F.when(flat, F.greatest(a + 1.0, F.col("high"))).otherwise(F.col("b"))})
    out = both.groupBy("band").agg(F.median("a2").alias("m"), F.median("b2").alias("n"))
    empty = F.col("n") <= F.col("m")
    return out.select("band", F.when(empty, FALLBACK[0]).otherwise(F.col("m")).alias("src_min"), F.when(empty, FALLBACK[1]).otherwise(F.col("n")).alias("src_max"))


def normalize_tiles(values: DataFrame, scale: DataFrame) -> DataFrame:
    """values with v as a byte by the band's scale; there is one scale a band, and a handful of bands."""
    return values.join(F.broadcast(scale), "band").withColumn("v", linear_scale(F.col("v").cast("double"), F.col("src_min"), F.col("src_max"))).drop("src_min", "src_max")


def overlay_last_wins(values: DataFrame, by: list[str | Column], order: str = "tile_order", v: str = "v") -> DataFrame:
    """(by, v): in each target cell the non-empty value of the last tile in the list."""
    return values.where(F.col(v) != 0).groupBy(*by).agg(F.max_by(v, order).alias(v))


def overlay_bands(pixels: DataFrame, by: list[str], bands: list[str], order: str = "tile_order") -> DataFrame:
    """(band, by, v): overlay_last_wins() from one column a band: a cell is one row of the aggregate, not one a band.

    Where pixels are dealt by `by` already, nothing is shuffled.
    """
    found = pixels.groupBy(*by).agg(*[F.max_by(b, F.when(F.col(b) != 0, F.col(order))).alias(b) for b in bands])
    return found.unpivot(by, bands, "band", "v").where("v is not null").select("band", *by, "v")


def rgb_blocks(cells: DataFrame, block: int = 512) -> DataFrame:
    """(band, by, bx, y0, x0, h, w, data): cells (band, ty, tx, v) gathered into blocks; cells without a value are 0."""
    at = cells.select("band", F.floor(F.col("ty") / block).alias("by"), F.floor(F.col("tx") / block).alias("bx"), F.pmod("ty", F.lit(block)).cast("int").alias("y"), F.pmod("tx", F.lit(block)).cast("int").alias("x"), "v")
    place = F.col("y") * block + F.col("x")
    grouped = at.groupBy("band", "by", "bx").agg(F.array_sort(F.collect_list(F.struct(place.alias("p"), F.col("v").alias("v")))).alias("c"))
    # runs of zeros between the places that have a value
    gaps = F.zip_with(F.concat(F.array(F.lit(-1)), F.transform("c", lambda s: s["p"])), F.concat("c", F.array(F.struct(F.lit(block * block).alias("p"), F.lit(0).alias("v")))), lambda a, s: F.concat(F.array_repeat(F.lit(0), s["p"] - a - 1), F.array(s["v"].cast("int"))))
    data = F.slice(F.flatten(gaps), 1, block * block)
    return grouped.select("band", "by", "bx", (F.col("by") * block).alias("y0"), (F.col("bx") * block).alias("x0"), F.lit(block).alias("h"), F.lit(block).alias("w"), data.alias("data"))


def build_mosaic(values: DataFrame, grids: DataFrame, order: DataFrame, pixel: float = 20.0, block: int = 512, stride: int = 10) -> DataFrame:
    """Blocks (see rgb_blocks) of one mosaic from UTM pixels: common scale, bytes, warp, overlay of the tiles in `order`.

    values: (tile_id, band, y, x, v); grids as for warp(); order: (tile_id, tile_order), later tiles lie above. The scale
    comes from every stride-th row and column of the source, so tiles look alike.
    """
    scale = cut(global_scale(band_stats(values, stride)))
    # bytes are warped, not scaled afterwards: rounding and cells without data come out as in a mosaic of finished tiles
    shown = warp(normalize_tiles(values, scale).withColumn("v", F.col("v").cast("double")), grids, pixel).join(order, "tile_id")
    shown = shown.withColumn("v", F.floor(F.col("v") + 0.5).cast("int"))
    return rgb_blocks(overlay_last_wins(shown, ["band", "ty", "tx"], "tile_order"), block)


def warp(values: DataFrame, grids: DataFrame, pixel: float = 20.0) -> DataFrame:
    """(tile_id, band, ty, tx, v) in Web Mercator cells of `pixel` metres, aligned to its origin, from UTM pixels.

    values: (tile_id, band, y, x, v); grids: (tile_id, zone, gt, h, w) without rotation. Every target cell over a tile is
    mapped back to its source position; the value is bilinear there, by single-pixel centres, and 0 where a neighbour
    is missing or empty. Target cells are made from the tile's outline, a row of them in each task.
    """
    g = F.col("gt")
    corner = [(g[0] + i * F.col("w") * g[1], g[3] + j * F.col("h") * g[5]) for i in (0, 1) for j in (0, 1)]
    world = [lonlat_to_mercator(*utm_to_wgs84(e, n, F.col("zone"))) for e, n in corner]
    low = [F.floor(F.least(*[p[k] for p in world]) / pixel) for k in (0, 1)]
    high = [F.ceil(F.greatest(*[p[k] for p in world]) / pixel) for k in (0, 1)]
    rows = grids.select("tile_id", "zone", "gt", "h", "w", F.explode(F.sequence(low[1], high[1])).alias("ty"), low[0].alias("a"), high[0].alias("z")).repartition("tile_id", "ty")
    cells = rows.select("tile_id", "zone", "gt", "h", "w", "ty", F.explode(F.sequence("a", "z")).alias("tx"))
    lon, lat = mercator_to_lonlat((F.col("tx") + 0.5) * pixel, (F.col("ty") + 0.5) * pixel)
    east, north = wgs84_to_utm(lon, lat, F.col("zone"))
    sx, sy = (east - g[0]) / g[1] - 0.5, (north - g[3]) / g[5] - 0.5
    inside = (F.col("sx") >= 0) & (F.col("sy") >= 0) & (F.col("sx") <= F.col("w") - 1) & (F.col("sy") <= F.col("h") - 1)
    at = cells.select("tile_id", "ty", "tx", "h", "w", sx.alias("sx"), sy.alias("sy")).where(inside)
    at = at.withColumns({"x": F.floor("sx"), "y": F.floor("sy")}).withColumns({"fx": F.col("sx") - F.col("x"), "fy": F.col("sy") - F.col("y")})
    four = F.array(*[F.struct((F.col("y") + j).alias("y"), (F.col("x") + i).alias("x"), ((F.col("fy") if j else 1 - F.col("fy")) * (F.col("fx") if i else 1 - F.col("fx"))).alias("k")) for j in (0, 1) for i in (0, 1)])
    need = at.select("tile_id", "ty", "tx", F.explode(four).alias("c")).where("c.k > 0").select("tile_id", "ty", "tx", F.col("c.y").alias("y"), F.col("c.x").alias("x"), F.col("c.k").alias("k"))
    asked = need.groupBy("tile_id", "ty", "tx").agg(F.count("*").alias("asked"))
    found = need.join(values.select("tile_id", "band", F.col("y").cast("long"), F.col("x").cast("long"), "v"), ["tile_id", "y", "x"])
    mixed = found.groupBy("tile_id", "band", "ty", "tx").agg(F.sum(F.col("k") * F.col("v")).alias("v"), F.min("v").alias("least"), F.count("*").alias("got")).join(asked, ["tile_id", "ty", "tx"])
    return mixed.select("tile_id", "band", "ty", "tx", F.when((F.col("least") == 0) | (F.col("got") < F.col("asked")), 0.0).otherwise(F.col("v")).alias("v"))
