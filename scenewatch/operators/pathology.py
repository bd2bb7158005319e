"""Sick forest by the histogram of a red-edge index, per tile, and the difference between two years.

Pixels have tile_id, y, x and vog1 (null: no data or cloud). A tile is reduced to 100 bins by aggregates that combine
before they shuffle; the threshold is then found by windows over those bins, and nothing sorts pixels.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenewatch.functions import bands
from scenewatch.operators.graph import cut

BINS = 100
#: Tiles, of a few numbers each, that are sent to every task: some 10 MB.
SENT = 200_000
#: Fixed values of the recipe.
PROMINENCE, PROMINENCE_REACH, PEAK_REACH, LEAST_DENSITY, WIDTH_SHARE = 10.0, 4, 15, 0.1, 0.75
FOREST = (0.3, 1.5)
NO_VALUES = 0.5
LEAST_VALID = 100


def vog1_pixels(pixels: DataFrame) -> DataFrame:
    """pixels of digital numbers (tile_id, y, x, date, b05, b06, b10, b11, b12) with their vog1."""
    r = {b: bands.toa(F.col(b), F.col("date")) for b in ("b05", "b06", "b10", "b11", "b12")}
    cloudy = bands.cloud_mask(r["b10"], r["b11"], r["b12"])
    return pixels.withColumn("vog1", bands.vog1(r["b05"], r["b06"], cloudy))


def ranges(pixels: DataFrame) -> DataFrame:
    """(tile_id, n_pixels, n, low, high): how many values a tile has, and their range; all tiles are kept. Computed once."""
    v = F.col("vog1").cast("double")
    return cut(pixels.groupBy("tile_id").agg(F.count("*").alias("n_pixels"), F.count(v).alias("n"), F.min(v).alias("low"), F.max(v).alias("high")))


def histogram(pixels: DataFrame, tiles: DataFrame, bins: int = BINS) -> DataFrame:
    """(tile_id, b, left_edge, count, density): every bin of every tile whose values differ, empty ones too."""
    tiles = tiles.where("high > low").withColumn("w", (F.col("high") - F.col("low")) / F.lit(float(bins)))
    v = F.col("vog1").cast("double")
    # no value is bin -1: a filter for values would be moved below the index and compute it again; least() skips nulls
    b = F.when(v.isNotNull(), F.least(F.floor((v - F.col("low")) / F.col("w")), F.lit(bins - 1))).otherwise(-1).cast("int")
    counts = of_tiles(pixels, tiles.select("tile_id", "low", "w")).groupBy("tile_id", b.alias("b")).agg(F.count("*").alias("count"))
    every = tiles.select("tile_id", "low", "w", "n", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("b"))
    full = every.join(counts, ["tile_id", "b"], "left")
    count = F.coalesce("count", F.lit(0))
    return full.select("tile_id", "b", (F.col("low") + F.col("b") * F.col("w")).alias("left_edge"), count.alias("count"), (count / (F.col("n") * F.col("w"))).alias("density"))


def find_peaks(density: Column, order: Window) -> Column:
    """Strict local maxima, ends excluded."""
    return F.coalesce((density > F.lag(density).over(order)) & (density > F.lead(density).over(order)), F.lit(False))


def peak_prominence(density: Column, order: Window) -> Column:
    """A value minus the least of its neighbours within the reach on both sides."""
    return density - F.min(density).over(order.rowsBetween(-PROMINENCE_REACH, PROMINENCE_REACH))


def argrelmax(value: Column, order: Window, bins: int = BINS) -> Column:
    """Greater than each of the neighbours within the reach; only where all of them exist."""
    before, after = F.max(value).over(order.rowsBetween(-PEAK_REACH, -1)), F.max(value).over(order.rowsBetween(1, PEAK_REACH))
    return F.col("b").between(PEAK_REACH, bins - PEAK_REACH - 1) & (value > before) & (value > after)


def of_tiles(pixels: DataFrame, tiles: DataFrame) -> DataFrame:
    """pixels joined with a row a tile; the tiles are sent to every task while there are no more than SENT of them."""
    return pixels.join(F.broadcast(tiles) if tiles.count() <= SENT else tiles, "tile_id")


def tile_statistics(pixels: DataFrame) -> DataFrame:
    """(tile_id, n_pixels, n_valid, threshold, n_below): thresholds(), and how many values lie below each.

    Three passes over pixels, each reduced to a few rows a tile in its tasks before they shuffle, and kept: the range
    of values, their bins, and the guard together with the counts.
    """
    tiles = ranges(pixels)
    order = Window.partitionBy("tile_id").orderBy("b")
    d = F.col("density")
    bins = histogram(pixels, tiles)
    flat = bins.withColumn("modified", F.when(find_peaks(d, order) & (peak_prominence(d, order) > PROMINENCE), F.greatest(F.lit(0.0), d - peak_prominence(d, order))).otherwise(d))
    flat = flat.withColumn("candidate", argrelmax(F.col("modified"), order))
    best = F.max_by("left_edge", F.when(F.col("candidate"), F.struct("modified", (-F.col("b")).alias("k"))))
    found = flat.groupBy("tile_id").agg(
        best.alias("peak"), F.max_by("left_edge", F.struct("density", (-F.col("b")).alias("k"))).alias("mode"),
        F.min(F.when(d > LEAST_DENSITY, F.col("left_edge"))).alias("edge"), F.min("left_edge").alias("first"),
    )
    mode, edge = F.coalesce("peak", "mode"), F.coalesce("edge", "first")
    found = cut(found.select("tile_id", (mode - F.lit(WIDTH_SHARE) * (mode - edge)).alias("raw")))
    v = F.col("vog1").cast("double")
    forest = v.between(F.lit(FOREST[0]), F.lit(FOREST[1]))
    sick = F.count_if(F.col("vog1") < F.col("raw").cast("float"))
    below = cut(of_tiles(pixels, found).groupBy("tile_id").agg(F.count_if(forest).alias("n_forest"), F.count_if(forest & (v < F.col("raw"))).alias("n_under"), sick.alias("n_below")))
    # above the 75th percentile exactly if more values lie below than have a lower rank
    anomalous = (F.col("n_forest") > 0) & (F.col("n_under") >= F.floor(F.col("n_forest") * 75 / 100) + 1)
    one = tiles.join(found, "tile_id", "left").join(below, "tile_id", "left")
    value = F.when(F.col("n") == 0, F.lit(NO_VALUES)).when(F.col("high") == F.col("low"), F.col("low")).when(anomalous, F.lit(-1.0)).otherwise(F.col("raw"))
    # a tile of one value has none below it
    return one.select("tile_id", "n_pixels", F.col("n").alias("n_valid"), value.cast("float").alias("threshold"), F.coalesce("n_below", F.lit(0)).alias("n_below"))


def thresholds(pixels: DataFrame) -> DataFrame:
    """(tile_id, n_pixels, n_valid, threshold): threshold is single precision, -1 where the peak found cannot be forest."""
    return tile_statistics(pixels).drop("n_below")


def sick_pixels(pixels: DataFrame, found: DataFrame, least_valid: int = LEAST_VALID) -> DataFrame:
    """pixels of tiles with a usable threshold and enough values, with sick: below the threshold; null stays healthy."""
    usable = found.where((F.col("threshold") >= 0) & (F.col("n_valid") >= least_valid)).select("tile_id", "threshold")
    return of_tiles(pixels, cut(usable)).withColumn("sick", F.coalesce(F.col("vog1") < F.col("threshold"), F.lit(False)))


def pathology(pixels: DataFrame) -> DataFrame:
    """(tile_id, n_pixels, n_valid, threshold, n_sick) of every tile; n_sick is null where the tile is skipped."""
    usable = (F.col("threshold") >= 0) & (F.col("n_valid") >= LEAST_VALID)
    return tile_statistics(vog1_pixels(pixels)).select("tile_id", "n_pixels", "n_valid", "threshold", F.when(usable, F.col("n_below")).alias("n_sick"))


def mask_diff(new: DataFrame, base: DataFrame, outside: str = "sick") -> DataFrame:
    """new pixels with newly_sick: sick now and not sick in the base year.

    new and base have tile_id, y, x, sick; base also vog1. A base pixel under clouds was not sick. A pixel that the
    base grid lacks counts as sick before (`sick`), or as unknown and so not sick (`unknown`).
    """
    if outside not in ("sick", "unknown"):
        raise ValueError(f"outside is sick or unknown, not {outside}")
    before = base.select("tile_id", "y", "x", F.col("sick").alias("was"), F.lit(True).alias("there"))
    was = F.coalesce("was", F.when(F.col("there").isNull(), F.lit(outside == "sick")), F.lit(False))
    return new.join(before, ["tile_id", "y", "x"], "left").withColumn("newly_sick", F.col("sick") & ~was).drop("was", "there")


def pathology_diff(new: DataFrame, base: DataFrame) -> DataFrame:
    """Pixels of tiles in both years with newly_sick; each year has its own threshold.

    A tile whose new threshold is unusable fails and is left out; one whose base threshold is takes the new one for both.
    """
    a, b = vog1_pixels(new), vog1_pixels(base)
    now, then = thresholds(a).where("threshold >= 0").select("tile_id", "threshold"), thresholds(b).select("tile_id", F.col("threshold").alias("own"))
    both = now.join(then, "tile_id").select("tile_id", "threshold", F.when(F.col("own") >= 0, F.col("own")).otherwise(F.col("threshold")).alias("base_threshold"))
    both = cut(both)
    sick = of_tiles(a, both.select("tile_id", "threshold")).withColumn("sick", F.coalesce(F.col("vog1") < F.col("threshold"), F.lit(False)))
    was = of_tiles(b, both.select("tile_id", "base_threshold")).withColumn("sick", F.coalesce(F.col("vog1") < F.col("base_threshold"), F.lit(False)))
    return mask_diff(sick, was)


def histogram_threshold(left: np.ndarray, density: np.ndarray) -> float:
    """The threshold of one tile's bins before the test against the forest's values: the recipe in NumPy."""
    n = len(density)
    inner = np.zeros(n, bool)
    inner[1:-1] = (density[1:-1] > density[:-2]) & (density[1:-1] > density[2:])
    lows = np.array([density[max(0, i - PROMINENCE_REACH) : i + PROMINENCE_REACH + 1].min() for i in range(n)])
    modified = np.where(inner & (density - lows > PROMINENCE), np.maximum(0, density - (density - lows)), density)
    tops = [i for i in range(PEAK_REACH, n - PEAK_REACH) if modified[i] > max(modified[i - PEAK_REACH : i].max(), modified[i + 1 : i + PEAK_REACH + 1].max())]
    mode = left[max(tops, key=lambda i: (modified[i], -i))] if tops else left[int(density.argmax())]
    above = np.flatnonzero(density > LEAST_DENSITY)
    edge = left[above[0]] if len(above) else left[0]
    return float(mode - WIDTH_SHARE * (mode - edge))


def threshold_udaf(bins: DataFrame) -> DataFrame:
    """(tile_id, raw) from histogram(): the same as the windows of thresholds(), a hundred rows a group in pandas."""

    def of(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("b")
        return pd.DataFrame({"tile_id": [key[0]], "raw": [histogram_threshold(pdf["left_edge"].to_numpy(), pdf["density"].to_numpy())]})

    return bins.groupBy("tile_id").applyInPandas(of, f"tile_id {bins.schema['tile_id'].dataType.simpleString()}, raw double")
