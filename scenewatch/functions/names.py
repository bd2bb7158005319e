"""What product names, tile ids and paths say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The form of product folders at each level.
PRODUCTS = {"L1C": r"^S2[AB]_MSIL1C_(\d{8})T\d{6}_.+\.SAFE$", "L2A": r"^S2[AB]_MSIL2A_(\d{8})T\d{6}_.+\.SAFE$"}
PREFIXES = {"L1C": "tiles", "L2A": "L2/tiles"}
TILE = r"T\d{2}[A-Z]{3}"


def blank(c: Column) -> Column:
    """The trimmed text, null if nothing is left."""
    return F.nullif(F.trim(c), F.lit(""))


def tile_id_from_path(path: Column) -> Column:
    return F.regexp_extract(path, TILE, 0)


def normalize_tile_id(tile: Column) -> Column:
    return F.regexp_replace(F.upper(F.trim(tile)), "^T", "")


def parse_product_name(products: DataFrame, name: str = "name") -> DataFrame:
    """Adds date, captured_at (text), tile_id and scene_id; all null where the name has not the form of a product."""
    parts = F.split(F.regexp_replace(F.element_at(F.split(F.col(name), "/"), -1), r"\.SAFE$", ""), "_")
    out = products.withColumn("_p", parts)
    at = F.when(F.size("_p") >= 6, F.try_to_timestamp(F.col("_p")[2], F.lit("yyyyMMdd'T'HHmmss")))
    tile = F.filter("_p", lambda x: (F.length(x) == 6) & x.startswith("T"))
    tile = F.when(at.isNotNull(), F.coalesce(F.get(tile, F.lit(0)), F.col("_p")[5]))
    stamp = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return out.withColumns({"date": at.cast("date"), "captured_at": stamp, "tile_id": tile, "scene_id": F.when(at.isNotNull(), F.concat_ws("|", tile, stamp))}).drop("_p")


def product_date(name: Column, level: str) -> Column:
    """The day in the name of a product of this level, else null."""
    return F.to_date(F.try_to_timestamp(F.nullif(F.regexp_extract(name, PRODUCTS[level], 1), F.lit("")), F.lit("yyyyMMdd")))


def match_products(listing: DataFrame, level: str, start, end, name: str = "name") -> DataFrame:
    """The products of a level from start to end, both included, with their day as product_date."""
    day = product_date(F.col(name), level)
    return listing.withColumn("product_date", day).where(F.col("product_date").between(F.lit(start), F.lit(end)))


def tile_prefix(tile: Column, level: str) -> Column:
    """Where the bucket keeps a tile; null unless the id has five characters."""
    where = F.concat(F.lit(PREFIXES[level] + "/"), F.left(tile, F.lit(2)), F.lit("/"), F.substring(tile, 3, 1), F.lit("/"), F.substring(tile, 4, 2), F.lit("/"))
    return F.when(F.length(tile) == 5, where)


def scene_key() -> Column:
    """What tells scenes apart: scene id, else product, else tile and time, else tile, date and path."""
    c = {n: F.coalesce(F.trim(F.col(n).cast("string")), F.lit("")) for n in ("tile_id", "date", "img_data_path")}
    at = blank(F.col("captured_at").cast("string"))
    return F.coalesce(
        blank(F.col("scene_id")), blank(F.col("safe_name")), F.when(at.isNotNull(), F.concat(c["tile_id"], F.lit("|"), at)), F.concat(c["tile_id"], F.lit("|"), c["date"], F.lit("|"), c["img_data_path"])
    )


def scene_label() -> Column:
    """Tile (else from the path, else the path's last part) and date."""
    tile = F.coalesce(blank(F.col("tile_id")), blank(tile_id_from_path(F.col("img_data_path"))), F.element_at(F.split(F.regexp_replace("img_data_path", "/+$", ""), "/"), -1))
    return F.concat_ws(" ", tile, F.col("date").cast("string"))


def valid_identifier(text: Column) -> Column:
    return F.coalesce(text.rlike("^[A-Za-z0-9]+$"), F.lit(False))
