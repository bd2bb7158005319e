"""Inputs derived from the given tables: scenes from events, requests from suppliers, pixels from line items.

Each has a DataFrame form and the SQL that gives the same rows in DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenewatch.functions.bands import f32


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tile_of(user: str) -> str:
    return f"concat('T40V', chr(CAST(65 + floor(({user} % 42) / 6) AS INT)), chr(CAST(65 + {user} % 6 AS INT)))"


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scene for each event: 42 tiles, one scene id a tile and day, so that there is something to dedupe."""
    tile = F.expr(tile_of("user_id"))
    u = F.col("user_id")
    return read(spark, sf_dir, "events").select(
        "event_id", tile.alias("tile_id"), F.col("ts").alias("captured_at"), F.to_date("ts").alias("date"), F.concat_ws("|", tile, F.to_date("ts").cast("string")).alias("scene_id"),
        F.concat(F.lit("S2A_"), F.lpad(F.col("event_id").cast("string"), 8, "0"), F.lit(".SAFE")).alias("safe_name"), F.concat(F.lit("/img/"), F.col("event_type"), F.lit("/"), F.col("event_id").cast("string")).alias("img_data_path"),
        F.least("value", F.lit(100.0)).alias("cloud"), F.when(F.col("event_id") % 7 == 0, 1.5).otherwise(0.0).alias("nodata_pct"),
        (52 + (u % 6) * F.lit(1.2)).alias("min_x"), (56 + F.floor((u % 42) / 6) * F.lit(0.8)).alias("min_y"), (F.lit(53.5) + (u % 6) * F.lit(1.2)).alias("max_x"), (57 + F.floor((u % 42) / 6) * F.lit(0.8)).alias("max_y"),
    )


SCENES = f"""scenes AS (SELECT event_id, {tile_of('user_id')} AS tile_id, ts AS captured_at, CAST(ts AS DATE) AS date,
  {tile_of('user_id')} || '|' || CAST(CAST(ts AS DATE) AS VARCHAR) AS scene_id, 'S2A_' || lpad(CAST(event_id AS VARCHAR), 8, '0') || '.SAFE' AS safe_name,
  '/img/' || event_type || '/' || CAST(event_id AS VARCHAR) AS img_data_path, least(value, CAST(100 AS DOUBLE)) AS cloud,
  CASE WHEN event_id % 7 = 0 THEN CAST(1.5 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS nodata_pct,
  52 + (user_id % 6) * CAST(1.2 AS DOUBLE) AS min_x, 56 + floor((user_id % 42) / 6) * CAST(0.8 AS DOUBLE) AS min_y,
  CAST(53.5 AS DOUBLE) + (user_id % 6) * CAST(1.2 AS DOUBLE) AS max_x, 57 + floor((user_id % 42) / 6) * CAST(0.8 AS DOUBLE) AS max_y FROM events)"""


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request for each supplier: two periods, a cloud limit, a model (a brand of parts) and an area (a nation)."""
    k, day = F.col("s_suppkey"), lambda base, c: F.date_add(F.lit(base).cast("date"), c.cast("int"))
    return read(spark, sf_dir, "supplier").select(
        k.alias("job_id"), day("2024-01-11", k % 10).alias("start"), day("2024-01-11", k % 10 + 3 + k % 5).alias("end"), day("2024-01-01", k % 5).alias("start2"), day("2024-01-01", k % 5 + 4).alias("end2"),
        (k * 7 % 101).cast("int").alias("cloud"), F.concat(F.lit("Brand#"), (k % 27).cast("string")).alias("model"), F.col("s_nationkey").alias("polygon_id"),
        F.when(k % 9 == 0, "soon").otherwise(F.date_format(F.lit("2024-02-01").cast("timestamp") + F.make_interval(hours=(k * 37 % 700).cast("int")), "yyyy-MM-dd HH:mm")).alias("time"),
    )


JOBS = """jobs AS (SELECT s_suppkey AS job_id, DATE '2024-01-11' + CAST(s_suppkey % 10 AS INT) AS "start", DATE '2024-01-11' + CAST(s_suppkey % 10 + 3 + s_suppkey % 5 AS INT) AS "end",
  DATE '2024-01-01' + CAST(s_suppkey % 5 AS INT) AS start2, DATE '2024-01-01' + CAST(s_suppkey % 5 + 4 AS INT) AS end2, CAST(s_suppkey * 7 % 101 AS INT) AS cloud,
  'Brand#' || CAST(s_suppkey % 27 AS VARCHAR) AS model, s_nationkey AS polygon_id,
  CASE WHEN s_suppkey % 9 = 0 THEN 'soon' ELSE strftime(TIMESTAMP '2024-02-01' + to_hours(CAST(s_suppkey * 37 % 700 AS INT)), '%Y-%m-%d %H:%M') END AS "time" FROM supplier)"""


def polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas: nations as boxes, a third hidden and a third restricted."""
    n = F.col("n_nationkey")
    box = [(52 + (n % 5) * F.lit(1.5)).alias("min_x"), (56 + F.floor(n / 5) * F.lit(1.1)).alias("min_y"), (53 + (n % 5) * F.lit(1.5)).alias("max_x"), (57 + F.floor(n / 5) * F.lit(1.1)).alias("max_y")]
    return read(spark, sf_dir, "nation").select(n.alias("polygon_id"), F.col("n_name").alias("name"), (n % 3).alias("public"), *box)


POLYGONS = """polygons AS (SELECT n_nationkey AS polygon_id, n_name AS name, n_nationkey % 3 AS public, 52 + (n_nationkey % 5) * CAST(1.5 AS DOUBLE) AS min_x,
  56 + floor(n_nationkey / 5) * CAST(1.1 AS DOUBLE) AS min_y, 53 + (n_nationkey % 5) * CAST(1.5 AS DOUBLE) AS max_x, 57 + floor(n_nationkey / 5) * CAST(1.1 AS DOUBLE) AS max_y FROM nation)"""


def specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models: the brands of parts; the numbers say which take two inputs and which go by season."""
    n = F.expr("CAST(substring(p_brand, 7) AS INT)")
    return read(spark, sf_dir, "part").select("p_brand").distinct().select(
        F.col("p_brand").alias("model"), F.concat(F.lit("Model "), F.col("p_brand")).alias("description"), (1 + n % 2).alias("inputs"), F.when(n % 3 == 0, "summer").when(n % 3 == 1, "").alias("season")
    )


SPECS = """specs AS (SELECT DISTINCT p_brand AS model, 'Model ' || p_brand AS description, 1 + CAST(substr(p_brand, 7) AS INT) % 2 AS inputs,
  CASE CAST(substr(p_brand, 7) AS INT) % 3 WHEN 0 THEN 'summer' WHEN 1 THEN '' END AS season FROM part)"""


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digital numbers of eight tiles, one pixel for each line item, before and after the day of the offset."""
    s, k, n, p = F.col("l_suppkey"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")
    off = F.when(s % 2 == 0, 0).otherwise(1000)
    n6 = 3000 + p % 500
    u = F.when((s % 8).isin(1, 5) & (p % 8 == 0), 120).otherwise((k * 7 + n * 13) % 100 + p % 100 + (s * 31 + k) % 100)
    m = F.when((s % 8 == 7) & (k % 10 != 0), 3).otherwise(1)
    band = {
        "b02": 200 + p % 900, "b03": 300 + p % 800, "b04": 250 + k % 900, "b05": F.floor(n6 * m * (2100 + u * 5) / 3000), "b06": n6, "b10": F.col("l_quantity").cast("int") % 30,
        "b11": 250 + p % 3000, "b12": 150 + k % 3000,
    }
    b08 = F.when(k % 50 == 0, 0).otherwise(off + 2000 + k % 1500)
    return read(spark, sf_dir, "lineitem").select(
        (s % 8).alias("tile_id"), k.alias("y"), n.alias("x"), F.when(s % 2 == 0, F.lit("2022-01-25")).otherwise("2022-01-26").cast("date").alias("date"), *[(off + v).cast("float").alias(c) for c, v in band.items()], b08.cast("float").alias("b08")
    )


PIXELS = """pixels AS (WITH b AS (SELECT l_suppkey % 8 AS tile_id, l_orderkey, l_linenumber, l_partkey, CAST(l_quantity AS INT) AS q,
    CASE WHEN l_suppkey % 2 = 0 THEN DATE '2022-01-25' ELSE DATE '2022-01-26' END AS date, CASE WHEN l_suppkey % 2 = 0 THEN 0 ELSE 1000 END AS off, 3000 + l_partkey % 500 AS n6,
    CASE WHEN l_suppkey % 8 IN (1, 5) AND l_partkey % 8 = 0 THEN 120 ELSE (l_orderkey * 7 + l_linenumber * 13) % 100 + l_partkey % 100 + (l_suppkey * 31 + l_orderkey) % 100 END AS u,
    CASE WHEN l_suppkey % 8 = 7 AND l_orderkey % 10 <> 0 THEN 3 ELSE 1 END AS m FROM lineitem)
  SELECT tile_id, l_orderkey AS y, l_linenumber AS x, date, CAST(off + 200 + l_partkey % 900 AS FLOAT) AS b02, CAST(off + 300 + l_partkey % 800 AS FLOAT) AS b03, CAST(off + 250 + l_orderkey % 900 AS FLOAT) AS b04,
    CAST(off + floor(n6 * m * (2100 + u * 5) / 3000) AS FLOAT) AS b05, CAST(off + n6 AS FLOAT) AS b06, CAST(off + q % 30 AS FLOAT) AS b10, CAST(off + 250 + l_partkey % 3000 AS FLOAT) AS b11,
    CAST(off + 150 + l_orderkey % 3000 AS FLOAT) AS b12, CAST(CASE WHEN l_orderkey % 50 = 0 THEN 0 ELSE off + 2000 + l_orderkey % 1500 END AS FLOAT) AS b08 FROM b)"""


BANDS = ("b02", "b03", "b04", "b05", "b06", "b08", "b10", "b11", "b12")


def grid_pixels(spark: SparkSession, sf_dir: str, by: tuple[str, ...] = ()) -> DataFrame:
    """pixels with one row a position: the least of each band.

    With some of the position in `by` pixels are dealt by it first, to all shuffle partitions: a position is seldom there twice, so that
    tasks that reduce before the shuffle would only hold their pixels.
    """
    rows = pixels(spark, sf_dir)
    dealt = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *by) if by else rows
    return dealt.groupBy("tile_id", "y", "x").agg(F.min("date").alias("date"), *[F.min(b).alias(b) for b in BANDS])


GRID = PIXELS + ", grid AS (SELECT tile_id, y, x, min(date) AS date, " + ", ".join(f"min({b}) AS {b}" for b in BANDS) + " FROM pixels GROUP BY tile_id, y, x)"


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An 8 x 8 image for each embedding, with a class 0, 1 or 2 for each pixel."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("i", "v"))
    return e.select("vec_id", F.floor(F.col("i") / 8).cast("int").alias("y"), (F.col("i") % 8).alias("x"), "v", F.when(F.col("v") > f32(0.05), 1 + F.col("label") % 2).otherwise(0).alias("dn"))


PATCHES = """patches AS (SELECT vec_id, CAST(floor(i / 8) AS INT) AS y, CAST(i % 8 AS INT) AS x, v, CASE WHEN v > CAST(0.05 AS FLOAT) THEN 1 + label % 2 ELSE 0 END AS dn
  FROM (SELECT vec_id, label, unnest(range(64)) AS i, unnest(embedding) AS v FROM embeddings))"""
