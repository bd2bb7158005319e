"""Reading and writing what the system keeps in files: catalogs, registries, areas, listings, rasters and features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scenewatch.functions.geo import as_multipolygon
from scenewatch.functions.names import blank
from scenewatch.functions.times import captured_at

#: Catalog versions and modes that can be read, and the version that is written.
LEAST_VERSION, VERSION, MODES = 7, 9, ("sentinel", "sentinel2a")
TILE_FIELDS = "date STRING, captured_at STRING, scene_id STRING, safe_name STRING, img_data_path STRING, cloud DOUBLE, nodata_pixel_percentage DOUBLE, envelope ARRAY<DOUBLE>, tile_id STRING"
CATALOG = f"version INT, preprocess STRING, generated STRING, year INT, tiles ARRAY<STRUCT<{TILE_FIELDS}>>"
CATALOG_FILE = "cash.json"
POLYGON = "name STRING, public INT, publick INT"
JOB = "id STRING, model STRING, poligon STRING, cloud INT, start STRING, end STRING, start2 STRING, end2 STRING, time STRING"
SPEC = (
    "description STRING, onnx_file STRING, channels ARRAY<STRING>, tile INT, bound INT, threshold DOUBLE, preprocess STRING, resolution STRING, season STRING, inputs INT, simplify DOUBLE, min_area DOUBLE, "
    "preserve_native_resolution BOOLEAN, merge BOOLEAN, num_classes INT, channel_means ARRAY<DOUBLE>, overlap INT, detection_classes ARRAY<INT>, pair_mode STRING, best_scene_per_tile BOOLEAN, cloud_mask_mode STRING, "
    "`poligons-on` ARRAY<STRING>, `poligons-off` ARRAY<STRING>, mask_filter STRUCT<enabled: BOOLEAN, min_area: INT, connectivity: INT>"
)
SPEC_MODES = ("sentinel", "sentinel2a", "identity", "pathology", "pathology_diff")
PAIR_MODES = ("concat", "newer_only", "union")
BLOCK = "scene_id STRING, tile_id STRING, band STRING, level STRING, by INT, bx INT, h INT, w INT, gt ARRAY<DOUBLE>, epsg INT, data ARRAY<FLOAT>"


def read_catalog(spark: SparkSession, root: str, years: list[int] | None = None, mode: str | None = None) -> DataFrame:
    """Scenes of the yearly catalogs under root; years are whole folders, so others are never opened.

    A version below 7, an unknown mode (or another than `mode`) and a catalog without scenes are errors; a blank mode is
    `sentinel`.
    """
    paths = [f"{root}/{y}/{CATALOG_FILE}" for y in years] if years else f"{root}/20[0-9][0-9]/{CATALOG_FILE}"
    docs = spark.read.schema(CATALOG).option("multiLine", True).json(paths).withColumn("preprocess", F.coalesce(F.nullif(F.lower(F.trim("preprocess")), F.lit("")), F.lit("sentinel")))
    wrong = (
        F.when(F.coalesce("version", F.lit(0)) < LEAST_VERSION, F.concat(F.lit("catalog version "), F.coalesce(F.col("version").cast("string"), F.lit("?"))))
        .when(~F.col("preprocess").isin(*([mode] if mode else MODES)), F.concat(F.lit("catalog mode "), "preprocess"))
        .when(F.coalesce(F.size("tiles"), F.lit(0)) <= 0, "catalog without scenes")
    )
    checked = docs.withColumn("tiles", F.when(wrong.isNotNull(), F.raise_error(wrong).cast(docs.schema["tiles"].dataType)).otherwise(F.col("tiles")))
    rows = checked.select("year", "preprocess", F.inline("tiles"))
    at = captured_at(F.coalesce(blank(F.col("captured_at")), F.col("date")))
    box = {n: F.get("envelope", F.lit(i)) for i, n in enumerate(("min_x", "min_y", "max_x", "max_y"))}
    return rows.withColumns({"captured_at": at, "date": F.coalesce(F.try_to_date("date", "yyyy-MM-dd"), at.cast("date")), "scene_id": F.coalesce(blank(F.col("scene_id")), F.col("safe_name")), **box}).withColumnRenamed("nodata_pixel_percentage", "nodata_pct").drop("envelope")


def write_catalog(scenes: DataFrame, root: str, mode: str = "sentinel") -> None:
    """Replaces the catalogs of the years in scenes under root, as Parquet partitions by year; other years stay."""
    rows = scenes.withColumns({"year": F.year("date"), "version": F.lit(VERSION), "preprocess": F.lit(mode)})
    rows.repartition("year").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year").parquet(root)


def year_dirs(names: DataFrame, which: str, name: str = "name") -> DataFrame:
    """The year folders that `all` or one year stands for, in order; any other word is an error."""
    if which != "all" and not (len(which) == 4 and which.isdigit() and which.startswith("20")):
        raise ValueError(f"all or a year from 2000 to 2099, not {which}")
    found = names.where(F.col(name).rlike("^20..$"))
    return (found if which == "all" else found.where(F.col(name) == which)).orderBy(name)


def xml_number(xml: Column, tag: str) -> Column:
    """The last element of this name anywhere, as a number; null if there is none or it is no number."""
    found = F.xpath(xml, F.lit(f"//*[local-name()='{tag}']/text()"))
    return F.try_element_at(F.transform(found, lambda t: F.trim(t).try_cast("double")), F.lit(-1))


def product_metadata(xml: DataFrame, level: str, text: str = "xml") -> DataFrame:
    """Adds cloud and nodata_pct. L1C: cloud from either of two elements; L2A needs cloud and nodata, else both are null."""
    cloud = F.coalesce(xml_number(F.col(text), "Cloud_Coverage_Assessment"), xml_number(F.col(text), "CLOUDY_PIXEL_PERCENTAGE"))
    if level == "L1C":
        return xml.withColumns({"cloud": cloud, "nodata_pct": F.lit(None).cast("double")})
    nodata = xml_number(F.col(text), "NODATA_PIXEL_PERCENTAGE")
    both = cloud.isNotNull() & nodata.isNotNull()
    return xml.withColumns({"cloud": F.when(both, cloud), "nodata_pct": F.when(both, nodata)})


def read_product_metadata(spark: SparkSession, glob: str, level: str) -> DataFrame:
    """(path, xml, cloud, nodata_pct) of metadata files."""
    files = spark.read.format("binaryFile").load(glob).select("path", F.decode("content", "UTF-8").alias("xml"))
    return product_metadata(files, level)


def band_paths(xml: DataFrame, bands: list[str], resolutions: list[str], text: str = "xml", key: str = "path") -> DataFrame:
    """(key, band, file): for each band the listed image file of the first resolution that has one, then the least."""
    files = xml.select(key, F.explode(F.xpath(F.col(text), F.lit("//*[local-name()='IMAGE_FILE']/text()"))).alias("file"))
    spread = files.select("*", F.explode(F.array(*map(F.lit, bands))).alias("band"))
    rank = F.coalesce(*[F.when(F.col("file").endswith(F.concat(F.lit("_"), F.col("band"), F.lit(f"_{r}"))), F.lit(k)) for k, r in enumerate(resolutions)])
    found = spread.withColumn("_r", rank).where("_r is not null")
    return found.withColumn("_n", F.row_number().over(Window.partitionBy(key, "band").orderBy("_r", "file"))).where("_n = 1").select(key, "band", "file")


def relaxed_json(text: Column) -> Column:
    """JSON without its comments and trailing commas; strings are left alone."""
    string = r'("(?:\\.|[^"\\])*")'
    plain = F.regexp_replace(text, string + r"|/\*[\s\S]*?\*/|//[^\n]*|(?m:^\s*#[^\n]*)", "$1")
    return F.regexp_replace(plain, string + r"|,(\s*[}\]])", "$1$2")


def read_json_map(spark: SparkSession, path: str, fields: str, relaxed: bool = False) -> DataFrame:
    """(id, fields...) of a registry kept as {id: record}, or as a list of records with an id; a blank file has none."""
    kind = T.StructType.fromDDL(fields)
    text = spark.read.text(path, wholetext=True).select((relaxed_json(F.col("value")) if relaxed else F.col("value")).alias("t")).where("trim(t) <> ''")
    as_map = F.map_entries(F.from_json("t", T.MapType(T.StringType(), kind)))
    listed = T.StructType([*kind.fields] if "id" in kind.names else [T.StructField("id", T.StringType()), *kind.fields])
    as_list = F.transform(F.from_json("t", T.ArrayType(listed)), lambda r: F.struct(r["id"].alias("key"), F.struct(*[r[f].alias(f) for f in kind.names]).alias("value")))
    rows = text.select(F.explode(F.when(F.ltrim("t").startswith("["), as_list).otherwise(as_map)).alias("e"))
    own = F.coalesce(blank(F.col("e.value.id")), F.col("e.key")) if "id" in kind.names else F.col("e.key")
    return rows.select(own.alias("id"), *[F.col(f"e.value.{f}").alias(f) for f in kind.names if f != "id"])


def write_json_map(rows: DataFrame, path: str, most: int = 100_000) -> None:
    """Writes rows with an id as one {id: record} document. Registries are small; more than `most` rows are an error."""
    if (n := rows.limit(most + 1).count()) > most:
        raise ValueError(f"more than {n - 1} records do not belong in one document; write Parquet")
    record = F.struct(*[c for c in rows.columns if c != "id"])
    rows.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("id", record)))).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_polygons(spark: SparkSession, path: str) -> DataFrame:
    """(polygon_id, name, public); an older spelling of the last field is accepted."""
    return read_json_map(spark, path, POLYGON).select(F.col("id").alias("polygon_id"), "name", F.coalesce("public", "publick", F.lit(0)).alias("public"))


def load_specs(spark: SparkSession, path: str) -> DataFrame:
    """Model specs by key with defaults filled; models of an unknown mode are dropped, a bad pair mode is an error."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json(relaxed_json(F.col("value")), f"models MAP<STRING, STRUCT<{SPEC}>>").alias("c"))
    rows = raw.select(F.explode("c.models")).select(F.col("key").alias("model"), "value.*")
    mode = F.coalesce(blank(F.lower("preprocess")), F.lit("sentinel"))
    pair, two = F.coalesce("pair_mode", F.lit("")), F.coalesce("inputs", F.lit(1)) > 1
    wrong = (pair != "") & (~two | ~pair.isin(*PAIR_MODES))

    def positive(name: str, default) -> Column:
        return F.when(F.col(name) > 0, F.col(name)).otherwise(F.lit(default))

    eight = F.coalesce(F.col("mask_filter.connectivity") == 8, F.lit(False))
    filled = {
        "onnx_file": F.coalesce(blank(F.col("onnx_file")), F.concat("model", F.lit(".onnx"))), "preprocess": mode, "resolution": F.coalesce(blank(F.col("resolution")), F.lit("R10m")), "inputs": positive("inputs", 1), "tile": positive("tile", 256),
        "bound": F.greatest(F.coalesce("bound", F.lit(0)), F.lit(0)), "threshold": F.when(F.coalesce("threshold", F.lit(0.0)) == 0, 0.5).otherwise(F.col("threshold")), "num_classes": positive("num_classes", 1), "overlap": F.coalesce("overlap", F.lit(0)),
        "merge": F.coalesce("merge", F.lit(False)),
        "mask_filter": F.struct(F.coalesce("mask_filter.enabled", F.lit(False)).alias("enabled"), F.coalesce("mask_filter.min_area", F.lit(0)).alias("min_area"), F.when(eight, 8).otherwise(4).alias("connectivity")),
        "pair_mode": F.when(wrong, F.raise_error(F.concat(F.lit("pair mode "), pair, F.lit(" of model "), F.col("model"))).cast("string")).when(pair == "", "concat").otherwise(pair),
    }
    return rows.withColumns(filled).where(F.col("preprocess").isin(*SPEC_MODES))


def read_geojson(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, feature, poly, ring, is_hole, points) of areas; points are structs x, y. Without any polygon: an error."""
    raw = spark.read.schema("type STRING, features ARRAY<STRUCT<geometry: STRUCT<type: STRING, coordinates: STRING>>>").option("multiLine", True).json(paths).select(F.input_file_name().alias("path"), F.posexplode_outer("features").alias("feature", "f"))
    multi = F.from_json(as_multipolygon(F.col("f.geometry.type"), F.col("f.geometry.coordinates")), "array<array<array<array<double>>>>")
    multi = F.when(multi.isNull(), F.raise_error(F.concat(F.lit("no polygon in "), F.col("path"))).cast("array<array<array<array<double>>>>")).otherwise(multi)
    polys = raw.select("path", "feature", F.posexplode(multi).alias("poly", "rings"))
    rings = polys.select("path", "feature", "poly", F.posexplode("rings").alias("ring", "r"))
    return rings.select("path", "feature", "poly", "ring", (F.col("ring") > 0).alias("is_hole"), F.transform("r", lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))).alias("points"))


def listed(objects: DataFrame) -> DataFrame:
    """objects (path, size) with the product name and tile_id that their paths say, null where they say none."""
    where = F.regexp_extract("path", r"tiles/(\d+)/([A-Z])/([A-Z]{2})/([^/]+\.SAFE)", 4)
    tile = F.regexp_replace(F.regexp_extract("path", r"tiles/(\d+/[A-Z]/[A-Z]{2})/", 1), "/", "")
    return objects.withColumns({"name": F.nullif(where, F.lit("")), "tile_id": F.nullif(tile, F.lit(""))})


def read_listing(spark: SparkSession, manifest: str) -> DataFrame:
    """(path, size, name, tile_id) of a listing's objects: from a Parquet manifest of path and size."""
    return listed(spark.read.schema("path STRING, size BIGINT").parquet(manifest))


def read_folder(spark: SparkSession, folder: str, pattern: str | None = None) -> DataFrame:
    """(path, size, name, tile_id) of the files under a folder of a bucket or disk, of all depths; none of them is opened.

    Empty files are left out: to new_files() they count as missing.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    files = (reader.option("pathGlobFilter", pattern) if pattern else reader).load(folder)
    return listed(files.select("path", F.col("length").alias("size")))


def read_band_blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BLOCK).parquet(path)


def write_mask_blocks(blocks: DataFrame, path: str) -> None:
    """Mask blocks by tile; zeros are kept as values, so that holes survive."""
    blocks.write.mode("overwrite").partitionBy("tile_id").parquet(path)


def write_features(features: DataFrame, path: str) -> None:
    """Features (dn, coordinates as MultiPolygon arrays in degrees) as lines of GeoJSON; empty ones are left out."""
    kept = features.where(F.size("coordinates") > 0)
    geometry = F.struct(F.lit("MultiPolygon").alias("type"), F.col("coordinates"))
    kept.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.col("dn").alias("DN")).alias("properties"), geometry.alias("geometry"))).alias("value")).write.mode("overwrite").text(path)


def write_mosaic(blocks: DataFrame, path: str) -> None:
    blocks.write.mode("overwrite").partitionBy("band", "by").parquet(path)
