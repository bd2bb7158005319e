"""Choosing scenes: filters by period, cloud and completeness, and the best scene of a group.

A scene row has tile_id, captured_at (timestamp), date, scene_id, safe_name, img_data_path, cloud, nodata_pct and the
envelope min_x, min_y, max_x, max_y. Every choice has a total order, so that reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenewatch.functions.names import blank, normalize_tile_id, scene_key, tile_id_from_path
from scenewatch.operators.graph import cut


def scene_defaults(scenes: DataFrame) -> DataFrame:
    """Fills captured_at from date and scene_id from the product name where they are missing."""
    return scenes.withColumns({"captured_at": F.coalesce("captured_at", F.col("date").cast("timestamp")), "scene_id": F.coalesce(blank(F.col("scene_id")), F.col("safe_name"))})


def filter_scenes(scenes: DataFrame, start, end, cloud: float) -> DataFrame:
    """Scenes of the days start to end with at most this cloud, limits included; a scene without a day fails the run."""
    day = F.coalesce("date", F.raise_error(F.concat(F.lit("scene without a date: "), F.coalesce("safe_name", F.lit("?")))).cast("date"))
    return scenes.where(day.between(F.lit(start), F.lit(end)) & (F.col("cloud") <= cloud))


def mosaic_candidates(scenes: DataFrame, start, end, tiles: list[str] | None = None) -> DataFrame:
    """Complete scenes captured from start to the end of the day `end`, of the given tiles; no nodata figure means 0."""
    last = F.lit(end).cast("timestamp") + F.expr("interval 86399 seconds")
    out = scenes.where(F.col("captured_at").between(F.lit(start).cast("timestamp"), last) & (F.coalesce("nodata_pct", F.lit(0.0)) == 0))
    return out if tiles is None else out.where(normalize_tile_id(F.col("tile_id")).isin(*[t.upper().removeprefix("T") for t in tiles]))


def first_of(rows: DataFrame, by: list[str | Column], order: list[Column]) -> DataFrame:
    """The first row of each group. Spark keeps one row a group in each task before it shuffles them."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_n = 1").drop("_n")


def dedupe_scenes(scenes: DataFrame) -> DataFrame:
    """One row a scene key: the least cloud, then the greatest product name, then the greatest path."""
    keyed = scenes.withColumn("scene_key", scene_key())
    return first_of(keyed, ["scene_key"], [F.col("cloud"), F.desc("safe_name"), F.desc("img_data_path")])


def dedupe_catalog(scenes: DataFrame) -> DataFrame:
    """One row a scene id (else tile and time): the greatest product name, then path."""
    key = F.coalesce(blank(F.col("scene_id")), F.concat_ws("|", "tile_id", F.col("captured_at").cast("string")))
    return first_of(scenes.withColumn("_key", key), ["_key"], [F.desc("safe_name"), F.desc("img_data_path")]).drop("_key")


def best_scene_per_tile(scenes: DataFrame, tie: str = "latest") -> DataFrame:
    """The least cloudy scene of each tile; among equals the latest or the earliest, then the least scene key."""
    if tie not in ("latest", "earliest"):
        raise ValueError(f"tie is latest or earliest, not {tie}")
    tile = F.coalesce(blank(F.col("tile_id")), tile_id_from_path(F.col("img_data_path")))
    at = F.desc("captured_at") if tie == "latest" else F.asc("captured_at")
    return first_of(scenes.withColumn("tile_id", tile).where("tile_id <> ''"), ["tile_id"], [F.col("cloud"), at, scene_key(), F.col("img_data_path")])


def latest_per_tile(scenes: DataFrame) -> DataFrame:
    return first_of(scenes, ["tile_id"], [F.desc("captured_at"), scene_key(), F.col("img_data_path")])


def mosaic_selection(candidates: DataFrame) -> DataFrame:
    """The scene of each tile for a mosaic, with cloud_limit.

    The limit is the least whole number from 1 to 100 that admits a scene, which is max(1, ceil(least cloud)); the
    latest scene within it is taken, then the greatest product name. Tiles with nothing within 100 are left out.
    """
    limit = F.greatest(F.lit(1), F.ceil(F.min("cloud"))).cast("int")
    limits = candidates.groupBy("tile_id").agg(limit.alias("cloud_limit")).where("cloud_limit <= 100")
    fit = candidates.join(limits, "tile_id").where("cloud <= cloud_limit").select(*candidates.columns, "cloud_limit")
    return first_of(fit, ["tile_id"], [F.desc("captured_at"), F.desc("safe_name"), F.desc("img_data_path")])


def sort_scenes(scenes: DataFrame) -> DataFrame:
    """Scenes by time, tile and key, then product name."""
    return scenes.orderBy("captured_at", "tile_id", scene_key(), "safe_name")


def numbered(ordered: DataFrame, name: str = "nth") -> DataFrame:
    """The rows of a sorted table with their places from 1: that in a range plus the rows of the ranges before.

    The driver holds one count a range, of which there are as many as shuffle partitions.
    """
    rows = cut(ordered.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    counts = {r.p: r.n for r in rows.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    before = [sum(n for q, n in counts.items() if q < p) for p in range(max(counts, default=0) + 1)]
    first = F.element_at(F.array(*[F.lit(n).cast("long") for n in before]), (part + 1).cast("int"))
    return rows.withColumn(name, first + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_at")


def sort_catalog(scenes: DataFrame) -> DataFrame:
    return scenes.orderBy("captured_at", "tile_id", "safe_name")


def available_years(scenes: DataFrame) -> DataFrame:
    return scenes.select(F.year("date").alias("year")).distinct()


def index_filters(products: DataFrame, level: str, least_b02: int = 70_000_000) -> DataFrame:
    """Products whose parts are all there; at L1C the blue band's file must also have its usual size."""
    parts = F.col("name").isNotNull() & F.col("img_data_path").isNotNull() & F.col("metadata_path").isNotNull() & F.col("raster_path").isNotNull()
    return products.where(parts & (F.col("b02_size") >= least_b02) if level == "L1C" else parts)


def index_counters(products: DataFrame, kept: DataFrame) -> DataFrame:
    """Products found, skipped and left after deduplication in each year."""
    final = dedupe_catalog(kept).groupBy("year").agg(F.count("*").alias("final"))
    seen = products.groupBy("year").agg(F.count("*").alias("found")).join(kept.groupBy("year").agg(F.count("*").alias("indexed")), "year", "left").join(final, "year", "left")
    return seen.select("year", "found", F.coalesce("indexed", F.lit(0)).alias("indexed"), (F.col("found") - F.coalesce("indexed", F.lit(0))).alias("skipped"), F.coalesce("final", F.lit(0)).alias("final"))


def best_file(files: DataFrame, patterns: list[str], group: str = "tile_id", path: str = "path") -> DataFrame:
    """(group, path): the least path whose file name matches the first pattern that any file of the group matches."""
    name = F.element_at(F.split(F.col(path), "/"), -1)
    rank = F.coalesce(*[F.when(name.rlike(f"(?i){p}"), F.lit(k)) for k, p in enumerate(patterns)])
    return first_of(files.withColumn("_r", rank).where("_r is not null"), [group], [F.col("_r"), F.col(path)]).select(group, path)


def reference_band(bands: DataFrame, level: str, low_resolution: bool = False, native: bool = False, most: int = 5490 * 5490) -> DataFrame:
    """The band whose grid each scene uses, from (scene_id, nth, band, w, h).

    L1C: the most pixels, first on ties. L2A: the last band of the first one's size. A grid of over `most` pixels falls
    back to B05 (B01 at the lowest resolution), if there, unless native resolution is kept.
    """
    by = Window.partitionBy("scene_id")
    if level == "L1C":
        chosen = first_of(bands, ["scene_id"], [F.desc(F.col("w") * F.col("h")), F.col("nth")])
    else:
        first = F.first(F.struct("w", "h")).over(by.orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        chosen = first_of(bands.withColumn("_f", first).where(F.col("_f") == F.struct("w", "h")).drop("_f"), ["scene_id"], [F.desc("nth")])
    if native:
        return chosen
    other = bands.where(F.col("band") == ("B01" if low_resolution else "B05")).select("scene_id", F.struct(*bands.columns).alias("_o"))
    pick = chosen.join(first_of(other, ["scene_id"], [F.col("_o.nth")]), "scene_id", "left").withColumn("_big", (F.col("w") * F.col("h") > most) & F.col("_o").isNotNull())
    return pick.select("scene_id", *[F.when(F.col("_big"), F.col(f"_o.{c}")).otherwise(F.col(c)).alias(c) for c in bands.columns if c != "scene_id"])


def resolve_band_file(files: DataFrame, resolution: str = "R10m", group: str = "scene_id", path: str = "path") -> DataFrame:
    """(group, band, path): for each scene and band the file of the wanted resolution, else of the next, then the least path.

    files has the band beside the path; a file says its resolution at its end, before the extension, or not at all.
    """
    order = {"R20m": ("20m", "10m", "60m"), "R60m": ("60m", "20m", "10m")}.get(resolution, ("10m", "20m", "60m"))
    stem = F.regexp_replace(F.col(path), r"\.[^./]*$", "")
    rank = F.coalesce(*[F.when(stem.endswith(f"_{r}"), F.lit(k)) for k, r in enumerate(order)], F.lit(len(order)))
    return first_of(files.withColumn("_r", rank), [group, "band"], [F.col("_r"), F.col(path)]).select(group, "band", path)


def first_image(files: DataFrame, group: str = "scene_id", path: str = "path") -> DataFrame:
    """(group, path): the least image file that is not true colour or an atmosphere layer; it gives a scene's envelope."""
    return files.where(~F.col(path).rlike(r"(?i)_(TCI|AOT|WVP)(_\d+m)?\.[^./]*$")).groupBy(group).agg(F.min(path).alias(path))


def envelope(corners: DataFrame, by: str = "scene_id") -> DataFrame:
    """(by, min_x, min_y, max_x, max_y) of corner points x, y."""
    return corners.groupBy(by).agg(F.min("x").alias("min_x"), F.min("y").alias("min_y"), F.max("x").alias("max_x"), F.max("y").alias("max_y"))


def pair_label(tile: Column, new: Column, old: Column) -> Column:
    """`tile [old -> new]` with the days of both scenes."""
    return F.concat(tile, F.lit(" ["), old.cast("string"), F.lit(" -> "), new.cast("string"), F.lit("]"))
