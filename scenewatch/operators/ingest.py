"""What to fetch: products and files that a listing has and the local store lacks, with the counts of a run."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def new_products(listing: DataFrame, existing: DataFrame, key: str = "name") -> DataFrame:
    """Products of a listing whose folder is not there yet."""
    return listing.join(existing.select(key).distinct(), key, "left_anti")


def new_files(objects: DataFrame, local: DataFrame) -> DataFrame:
    """Objects (path, size) to copy: the local file is missing or empty. Names that end in / are folders."""
    return objects.where(~F.col("path").endswith("/")).join(local.where("size > 0").select("path"), "path", "left_anti")


def product_counters(listing: DataFrame, existing: DataFrame, key: str = "name", by: str = "level") -> DataFrame:
    """Per level: products matched, those already there and those to fetch."""
    there = existing.select(key, F.lit(True).alias("_there")).distinct()
    rows = listing.join(there, key, "left")
    return rows.groupBy(by).agg(F.count("*").alias("matched"), F.count("_there").alias("skipped"), F.count_if(F.col("_there").isNull()).alias("to_download"))


def transfer_counters(files: DataFrame, by: str = "level") -> DataFrame:
    """Files and bytes to copy at each level."""
    return files.groupBy(by).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def union_levels(*parts: DataFrame) -> DataFrame:
    """The rows of all levels together; columns that one lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
