"""Further queries: the index of products, intervals, labels, levels and resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from scenewatch.functions import times
from scenewatch.jobs import fixtures as x
from scenewatch.operators import job_queue as q
from scenewatch.operators import planning as plan
from scenewatch.operators import raster, scoring
from scenewatch.operators import selection as s

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return keep


FOUND = f"""{x.SCENES}, f AS (SELECT *, 2020 + CAST(event_id % 4 AS INT) AS year, event_id % 11 <> 0 AND (event_id * 7919 % 150) >= 70 AS ok FROM scenes)"""


@query(
    f"""WITH {FOUND}, d AS (SELECT year, count(*) AS final FROM (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY safe_name DESC, img_data_path DESC) AS rn FROM f WHERE ok) WHERE rn = 1 GROUP BY year)
    SELECT year, count(*) AS found, count(CASE WHEN ok THEN 1 END) AS indexed, count(CASE WHEN NOT ok THEN 1 END) AS skipped, coalesce(max(final), 0) AS final FROM f LEFT JOIN d USING (year) GROUP BY year"""
)
def index_counters(spark, d):
    k = F.col("event_id")
    rows = x.scenes(spark, d).withColumns({"year": (2020 + k % 4).cast("int"), "name": F.col("safe_name"), "metadata_path": F.when(k % 11 != 0, "m"), "raster_path": F.lit("r"), "b02_size": k * 7919 % 150})
    return s.index_counters(rows, s.index_filters(rows, "L1C", least_b02=70))


@query(f"WITH {x.SCENES} SELECT tile_id AS scene_id, min(min_x) AS min_x, min(min_y) AS min_y, max(min_x) AS max_x, max(min_y) AS max_y FROM scenes GROUP BY tile_id")
def envelope(spark, d):
    return s.envelope(x.scenes(spark, d).select(F.col("tile_id").alias("scene_id"), F.col("min_x").alias("x"), F.col("min_y").alias("y")))


@query(
    f"""WITH {x.JOBS}, j AS (SELECT job_id, epoch_us(CAST("start" AS TIMESTAMP)) AS a, epoch_us(CAST("end" AS TIMESTAMP)) + 86400000000 AS z FROM jobs)
    SELECT job_id, CAST(i AS INT) AS i, a + i * ((z - a) // 7) AS from_us, CASE WHEN i = 6 THEN z ELSE a + (i + 1) * ((z - a) // 7) END AS to_us FROM j, range(7) t(i)"""
)
def build_intervals(spark, d):
    return x.jobs(spark, d).select("job_id", F.inline(times.build_intervals(F.col("start"), F.col("end"), 7)))


@query(f"WITH {x.JOBS}, {x.SPECS} SELECT model, CASE WHEN season IS NULL THEN 'L2A' ELSE 'L1C' END AS level, season = '' AS series FROM (SELECT model, season FROM specs) WHERE true")
def catalog_level(spark, d):
    rows = x.specs(spark, d)
    mode = F.when(F.col("season").isNull(), " Sentinel2A ").when(F.col("season") == "", "identity").otherwise("sentinel")
    channels = F.array(F.lit("NDVI_0"), F.when(F.col("season") == "", " ndvi1").otherwise("B04"))
    series = plan.is_time_series(mode, channels)
    return rows.select("model", plan.catalog_level(mode).alias("level"), F.when(F.col("season").isNotNull(), series).alias("series"))


@query(f"WITH {x.SPECS}, {x.POLYGONS} SELECT 'model' AS kind, description AS label FROM specs UNION ALL SELECT 'area', name FROM polygons")
def sorted_options(spark, d):
    models, areas = q.sorted_options(x.specs(spark, d), x.polygons(spark, d))
    return models.select(F.lit("model").alias("kind"), F.col("description").alias("label")).unionByName(areas.select(F.lit("area").alias("kind"), F.col("name").alias("label")))


@query(
    f"""WITH {x.PATCHES}, p AS (SELECT vec_id, y // 2 AS y, x // 2 AS x, y % 2 AS j, x % 2 AS i, CASE WHEN dn = 0 THEN CAST(0 AS FLOAT) ELSE v END AS v FROM patches),
    c AS (SELECT vec_id, y, x, max(v) FILTER (WHERE j = 0 AND i = 0) AS a, max(v) FILTER (WHERE j = 0 AND i = 1) AS b, max(v) FILTER (WHERE j = 1 AND i = 0) AS c, max(v) FILTER (WHERE j = 1 AND i = 1) AS d FROM p GROUP BY ALL)
    SELECT vec_id AS tile_id, CAST(y AS INT) AS y, CAST(x AS INT) AS x, CASE WHEN a = 0 OR b = 0 OR c = 0 OR d = 0 THEN CAST(0 AS FLOAT)
      ELSE CAST((a * CAST(0.5 AS FLOAT) + b * CAST(0.5 AS FLOAT)) * CAST(0.5 AS FLOAT) + (c * CAST(0.5 AS FLOAT) + d * CAST(0.5 AS FLOAT)) * CAST(0.5 AS FLOAT) AS FLOAT) END AS v FROM c"""
)
def resample_bilinear(spark, d):
    rows = x.patches(spark, d).select(F.col("vec_id").alias("tile_id"), "y", "x", F.when(F.col("dn") == 0, F.lit(0).cast("float")).otherwise(F.col("v")).alias("v"))
    return raster.resample_bilinear(rows, (8, 8), (4, 4))


@query(f"WITH {x.PATCHES} SELECT vec_id, y, x, dn FROM patches WHERE dn = 1 UNION ALL SELECT vec_id, y, x, dn FROM patches WHERE dn = 2")
def union_detections(spark, d):
    rows = x.patches(spark, d).select("vec_id", "y", "x", "dn")
    return scoring.union_detections(rows.where("dn = 1"), rows.where("dn = 2"))


@query("SELECT c_custkey AS scene_id, 'B04' AS band, min(c_mktsegment) AS path FROM customer GROUP BY c_custkey")
def resolve_band_file(spark, d):
    rows = x.read(spark, d, "customer").select(F.col("c_custkey").alias("scene_id"), F.lit("B04").alias("band"), F.explode(F.array(F.concat("c_mktsegment", F.lit("_B04_20m.jp2")), F.concat("c_mktsegment", F.lit("_B04_10m.jp2")))).alias("path"))
    return s.resolve_band_file(rows, "R10m").withColumn("path", F.regexp_replace("path", "_B04_10m.jp2$", ""))


@query("SELECT c_nationkey AS scene_id, min(c_name) || '_B05.jp2' AS path FROM customer GROUP BY c_nationkey")
def first_image(spark, d):
    rows = x.read(spark, d, "customer").select(F.col("c_nationkey").alias("scene_id"), F.explode(F.array(F.concat("c_name", F.lit("_B05.jp2")), F.lit("A_TCI_10m.jp2"), F.lit("A_AOT.jp2"))).alias("path"))
    return s.first_image(rows)
