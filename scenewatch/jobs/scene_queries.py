"""Queries over scenes and requests, and forest pathology."""

from __future__ import annotations

from pyspark.sql import functions as F

from scenewatch.functions import names, times
from scenewatch.jobs import fixtures as x
from scenewatch.operators import pathology as p
from scenewatch.operators import planning as plan
from scenewatch.operators import selection as s

QUERIES, ORACLES = {}, {}
COLUMNS = ["event_id", "tile_id", "captured_at", "date", "scene_id", "safe_name", "img_data_path", "cloud", "nodata_pct"]
COLS = ", ".join(COLUMNS)


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def best(table: str, by: str, order: str, where: str = "true", cols: str = COLS) -> str:
    return f"SELECT {cols} FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {order}) AS rn FROM {table} WHERE {where}) WHERE rn = 1"


@query(f"WITH {x.SCENES} SELECT {COLS} FROM scenes WHERE date BETWEEN DATE '2024-01-08' AND DATE '2024-01-20' AND cloud <= 40")
def filter_scenes(spark, d):
    return s.filter_scenes(x.scenes(spark, d), "2024-01-08", "2024-01-20", 40.0).select(*COLUMNS)


@query(f"WITH {x.SCENES} {best('scenes', 'scene_id', 'cloud, safe_name DESC, img_data_path DESC', cols=COLS + ', scene_id AS scene_key')}")
def dedupe_scenes(spark, d):
    return s.dedupe_scenes(x.scenes(spark, d)).select(*COLUMNS, "scene_key")


@query(f"WITH {x.SCENES} {best('scenes', 'scene_id', 'safe_name DESC, img_data_path DESC')}")
def dedupe_catalog(spark, d):
    return s.dedupe_catalog(x.scenes(spark, d)).select(*COLUMNS)


@query(f"WITH {x.SCENES}, one AS ({best('scenes', 'scene_id', 'cloud, safe_name DESC, img_data_path DESC')}) {best('one', 'tile_id', 'cloud, captured_at DESC, scene_id, img_data_path')}")
def best_scene_latest(spark, d):
    return s.best_scene_per_tile(s.dedupe_scenes(x.scenes(spark, d)), "latest").select(*COLUMNS)


@query(f"WITH {x.SCENES} {best('scenes', 'tile_id', 'cloud, captured_at, scene_id, img_data_path')}")
def best_scene_earliest(spark, d):
    return s.best_scene_per_tile(x.scenes(spark, d), "earliest").select(*COLUMNS)


@query(f"WITH {x.SCENES} {best('scenes', 'tile_id', 'captured_at DESC, scene_id, img_data_path')}")
def latest_per_tile(spark, d):
    return s.latest_per_tile(x.scenes(spark, d)).select(*COLUMNS)


@query(
    f"""WITH {x.SCENES}, c AS (SELECT * FROM scenes WHERE captured_at BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25 23:59:59' AND nodata_pct = 0),
    l AS (SELECT tile_id, greatest(1, CAST(ceil(min(cloud)) AS INT)) AS cloud_limit FROM c GROUP BY tile_id),
    f AS (SELECT c.*, l.cloud_limit FROM c JOIN l USING (tile_id) WHERE l.cloud_limit <= 100 AND c.cloud <= l.cloud_limit)
    {best('f', 'tile_id', 'captured_at DESC, safe_name DESC, img_data_path DESC', cols=COLS + ', cloud_limit')}"""
)
def mosaic_selection(spark, d):
    found = s.mosaic_candidates(x.scenes(spark, d), "2024-01-05", "2024-01-25")
    return s.mosaic_selection(found).select(*COLUMNS, "cloud_limit")


@query(f"WITH {x.SCENES} SELECT DISTINCT CAST(year(date) AS INT) AS year FROM scenes")
def available_years(spark, d):
    return s.available_years(x.scenes(spark, d))


@query(f"WITH {x.SCENES} SELECT event_id, row_number() OVER (ORDER BY captured_at, tile_id, scene_id, event_id) AS nth FROM scenes")
def sort_scenes(spark, d):
    return s.numbered(s.sort_scenes(x.scenes(spark, d))).select("event_id", "nth")


PRODUCT = "'S2' || substr('ABC', CAST(event_id % 3 + 1 AS INT), 1) || '_MSIL1C_' || {ts} || '_N0511_R121_' || tile_id || '_20240201T000000.SAFE'"


def products(spark, d):
    name = F.concat(F.lit("S2"), F.substring(F.lit("ABC"), F.col("event_id") % 3 + 1, F.lit(1)), F.lit("_MSIL1C_"), F.date_format("captured_at", "yyyyMMdd'T'HHmmss"), F.lit("_N0511_R121_"), F.col("tile_id"), F.lit("_20240201T000000.SAFE"))
    return x.scenes(spark, d).select("event_id", "tile_id", "captured_at", name.alias("name"), F.col("cloud").alias("size"))


PRODUCTS = f"{x.SCENES}, products AS (SELECT event_id, tile_id, captured_at, {PRODUCT.format(ts=chr(39).join(['strftime(captured_at, ', '%Y%m%dT%H%M%S', ')']))} AS name FROM scenes)"


@query(f"WITH {PRODUCTS} SELECT event_id, CAST(captured_at AS DATE) AS date, strftime(captured_at, '%Y-%m-%dT%H:%M:%SZ') AS captured_at, tile_id, tile_id || '|' || strftime(captured_at, '%Y-%m-%dT%H:%M:%SZ') AS scene_id FROM products")
def parse_product_name(spark, d):
    return names.parse_product_name(products(spark, d).select("event_id", "name")).drop("name")


@query(
    f"""WITH {PRODUCTS} SELECT event_id, name, CAST(captured_at AS DATE) AS product_date, 'tiles/' || substr(tile_id, 2, 2) || '/' || substr(tile_id, 4, 1) || '/' || substr(tile_id, 5, 2) || '/' AS prefix
    FROM products WHERE regexp_matches(name, '^S2[AB]_MSIL1C_') AND CAST(captured_at AS DATE) BETWEEN DATE '2024-01-10' AND DATE '2024-01-12'"""
)
def match_products(spark, d):
    found = names.match_products(products(spark, d), "L1C", "2024-01-10", "2024-01-12")
    tile = names.normalize_tile_id(names.tile_id_from_path(F.col("name")))
    return found.select("event_id", "name", "product_date", names.tile_prefix(tile, "L1C").alias("prefix"))


@query(f"WITH {x.SCENES} SELECT event_id, tile_id || ' ' || CAST(date AS VARCHAR) AS label FROM scenes")
def scene_labels(spark, d):
    return x.scenes(spark, d).select("event_id", names.scene_label().alias("label"))


@query(
    f"""WITH {x.SCENES}, r AS (SELECT DISTINCT tile_id FROM scenes UNION ALL SELECT 'T40VZZ'), c AS (SELECT * FROM scenes WHERE nodata_pct = 0 AND cloud <= 5)
    SELECT tile_id, count(c.event_id) AS n FROM r LEFT JOIN c USING (tile_id) GROUP BY tile_id"""
)
def required_tiles(spark, d):
    rows = x.scenes(spark, d)
    required = rows.select("tile_id").distinct().unionByName(spark.createDataFrame([("T40VZZ",)], "tile_id string"))
    there, missing = plan.require_tiles(required, rows.where("nodata_pct = 0 and cloud <= 5"))
    return there.groupBy("tile_id").agg(F.count("*").alias("n")).unionByName(missing.select("tile_id", F.lit(0).cast("long").alias("n")))


@query(f"""WITH {x.SCENES}, {x.JOBS} SELECT j.job_id, s.event_id FROM jobs j JOIN scenes s ON s.date BETWEEN j."start" AND j."end" AND s.cloud <= j.cloud""")
def plan_jobs(spark, d):
    jobs = x.jobs(spark, d).select("job_id", "start", "end", "cloud")
    return plan.plan_jobs(jobs, x.scenes(spark, d)).select("job_id", "event_id")


TOUCH = "a.min_x <= s.max_x AND a.max_x >= s.min_x AND a.min_y <= s.max_y AND a.max_y >= s.min_y"


@query(f"WITH {x.SCENES}, {x.POLYGONS} SELECT a.polygon_id, count(*) AS n, sum(s.event_id) AS total FROM polygons a JOIN scenes s ON {TOUCH} GROUP BY a.polygon_id")
def scenes_in_areas(spark, d):
    found = plan.scenes_in_boxes(x.scenes(spark, d), x.polygons(spark, d))
    return found.groupBy("polygon_id").agg(F.count("*").alias("n"), F.sum("event_id").cast("decimal(38,0)").alias("total"))


PAIRS = f"""{x.SCENES}, n AS ({best('scenes', 'scene_id', 'cloud, safe_name DESC, img_data_path DESC', "date >= DATE '2024-01-12'")}), b AS ({best('scenes', 'scene_id', 'cloud, safe_name DESC, img_data_path DESC', "date <= DATE '2024-01-20'")}),
    pairs AS (SELECT tile_id, new_key, new_at, base_key, base_at FROM (SELECT n.tile_id, n.scene_id AS new_key, n.captured_at AS new_at, b.scene_id AS base_key, b.captured_at AS base_at,
      row_number() OVER (PARTITION BY n.scene_id ORDER BY CASE WHEN b.captured_at < n.captured_at THEN 0 ELSE 1 END, b.captured_at DESC, b.scene_id) AS rn FROM n LEFT JOIN b USING (tile_id)) WHERE rn = 1)"""


def two_periods(spark, d):
    rows = x.scenes(spark, d)
    return s.dedupe_scenes(rows.where("date >= '2024-01-12'")), s.dedupe_scenes(rows.where("date <= '2024-01-20'"))


@query(f"WITH {PAIRS} SELECT * FROM pairs")
def pair_scenes(spark, d):
    return plan.pair_scenes(*two_periods(spark, d))


@query(f"WITH {PAIRS} SELECT DISTINCT tile_id, new_key, base_key FROM pairs WHERE base_key IS NOT NULL")
def pair_dedup(spark, d):
    return plan.pair_dedup(plan.pair_scenes(*two_periods(spark, d))).select("tile_id", "new_key", "base_key")


@query(f"WITH {x.SCENES} SELECT tile_id FROM scenes WHERE date <= DATE '2024-01-02' AND cloud < 9 INTERSECT SELECT tile_id FROM scenes WHERE date > DATE '2024-01-28' AND cloud < 9")
def common_tiles(spark, d):
    rows = x.scenes(spark, d).where("cloud < 9")
    return plan.common_tiles(rows.where("date <= '2024-01-02'"), rows.where("date > '2024-01-28'"))


@query(
    f"""WITH {x.SCENES}, e AS (SELECT *, epoch_us(captured_at) AS us FROM scenes), p AS (SELECT epoch_us(TIMESTAMP '2024-01-03') AS a, (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(TIMESTAMP '2024-01-03')) AS len),
    i AS (SELECT CAST(i AS INT) AS i, a + i * (len // 7) AS a, CASE WHEN i = 6 THEN a + len ELSE a + (i + 1) * (len // 7) END AS z FROM p, range(7) t(i)),
    r AS (SELECT e.*, i.i, row_number() OVER (PARTITION BY tile_id, i.i ORDER BY CASE WHEN us >= a AND us < z THEN 0 ELSE 1 END, CASE WHEN us >= a AND us < z THEN cloud END,
      CASE WHEN us >= a AND us < z THEN -us END, CASE WHEN us >= a AND us < z THEN NULL ELSE abs(us - (a + z) // 2) END, cloud, us, scene_id, img_data_path) AS rn FROM e, i)
    SELECT tile_id, i, event_id, cloud FROM r WHERE rn = 1"""
)
def interval_pick(spark, d):
    found = plan.interval_pick(x.scenes(spark, d), 7, F.lit("2024-01-03").cast("date"), F.lit("2024-01-31").cast("date"))
    return found.select("tile_id", "i", "event_id", "cloud")


@query(
    f"""WITH {x.JOBS}, y AS (SELECT job_id, 2000 + CAST(job_id % 30 AS INT) AS yr, ['spring', 'summer', 'autumn', 'winter'][CAST(job_id % 4 AS INT) + 1] AS season FROM jobs)
    SELECT job_id, CAST(CAST(yr AS VARCHAR) || CASE season WHEN 'spring' THEN '-03-01' WHEN 'summer' THEN '-06-01' WHEN 'autumn' THEN '-09-01' ELSE '-12-01' END AS DATE) AS first_day,
      CAST(CASE season WHEN 'spring' THEN CAST(yr AS VARCHAR) || '-05-31' WHEN 'summer' THEN CAST(yr AS VARCHAR) || '-08-31' WHEN 'autumn' THEN CAST(yr AS VARCHAR) || '-11-30' ELSE CAST(yr + 1 AS VARCHAR) || '-02-28' END AS DATE) AS last_day FROM y"""
)
def season_dates(spark, d):
    jobs = x.jobs(spark, d)
    season = F.element_at(F.array(*map(F.lit, times.SEASONS)), (F.col("job_id") % 4).cast("int") + 1)
    a, z = times.season_dates(season, (2000 + F.col("job_id") % 30).cast("int"))
    return jobs.select("job_id", a.alias("first_day"), z.alias("last_day"))


@query(
    f"""WITH {x.SCENES}, {x.JOBS}, {x.POLYGONS}, j AS (SELECT jobs.*, p.min_x, p.min_y, p.max_x, p.max_y FROM jobs JOIN polygons p USING (polygon_id)),
    sc AS ({best('scenes', 'scene_id', 'cloud, safe_name DESC, img_data_path DESC', cols='*')}),
    seen AS (SELECT a.job_id, sc.*, a.min_x AS ax, a.min_y AS ay, a.max_x AS bx, a.max_y AS by_ FROM j a JOIN sc ON sc.date BETWEEN a."start" AND a."end" AND sc.cloud <= a.cloud),
    t AS (SELECT *, ax <= max_x AND bx >= min_x AND ay <= max_y AND by_ >= min_y AS inside, tile_id IN (SELECT tile_id FROM scenes WHERE date <= DATE '2024-01-03') AS has_base FROM seen)
    SELECT job_id, count(t.scene_id) AS seen, count(CASE WHEN NOT inside THEN 1 END) AS skipped_outside, count(CASE WHEN inside AND NOT has_base THEN 1 END) AS misses, count(CASE WHEN inside AND has_base THEN 1 END) AS processed
    FROM jobs LEFT JOIN t USING (job_id) GROUP BY job_id"""
)
def run_counters(spark, d):
    rows = x.scenes(spark, d)
    boxes = x.polygons(spark, d).select("polygon_id", *[F.col(c).alias(f"a_{c}") for c in plan.BOX])
    jobs = x.jobs(spark, d)
    seen = plan.plan_jobs(jobs.join(boxes, "polygon_id"), s.dedupe_scenes(rows))
    inside = seen.where("a_min_x <= max_x and a_max_x >= min_x and a_min_y <= max_y and a_max_y >= min_y")
    base = rows.where("date <= '2024-01-03'").select("tile_id", F.lit("b").alias("base_key")).distinct()
    return plan.run_counters(jobs, seen, inside, inside.select("job_id", "tile_id").join(base, "tile_id", "left"))


@query(
    f"""WITH {x.JOBS}, {x.SPECS}, {x.POLYGONS} SELECT job_id, CASE WHEN s.model IS NULL THEN 'unknown model' WHEN p.polygon_id IS NULL THEN 'no such area'
      WHEN j.cloud NOT BETWEEN 0 AND 95 THEN 'cloud out of range' WHEN coalesce(season, '') <> '' AND job_id % 5 = 0 THEN 'no year' WHEN coalesce(season, '') <> '' AND inputs = 2 AND job_id % 7 = 0 THEN 'no base year'
      WHEN coalesce(season, '') <> '' AND inputs = 2 AND job_id % 5 = job_id % 7 THEN 'years are the same' WHEN coalesce(season, '') = '' AND inputs = 2 AND job_id % 11 = 0 THEN 'no base dates' END AS error
    FROM jobs j LEFT JOIN specs s USING (model) LEFT JOIN (SELECT * FROM polygons WHERE public IN (1, 2)) p USING (polygon_id)"""
)
def validate_jobs(spark, d):
    k = F.col("job_id")
    jobs = x.jobs(spark, d).withColumns({"year": (k % 5).cast("int"), "year2": (k % 7).cast("int"), "start2": F.when(k % 11 != 0, F.col("start2")), "cloud": F.when(F.col("cloud") > 95, F.col("cloud") + 100).otherwise(F.col("cloud"))})
    return plan.validate_jobs(jobs, x.specs(spark, d), x.polygons(spark, d)).select("job_id", "error")


@query(f"WITH {x.POLYGONS} SELECT polygon_id, name FROM polygons WHERE public = 2")
def visible_polygons(spark, d):
    return plan.visible_polygons(x.polygons(spark, d), False).select("polygon_id", "name")


def toa(b: str) -> str:
    return f"CASE WHEN {b} = 0 THEN CAST(0 AS FLOAT) ELSE least(CAST(1 AS FLOAT), CAST(greatest(CASE WHEN date > DATE '2022-01-25' THEN {b} - CAST(1000 AS FLOAT) ELSE {b} END, CAST(0 AS FLOAT)) / CAST(10000 AS FLOAT) AS FLOAT)) END"


def vog_sql(source: str) -> str:
    t = ", ".join(f"{toa(b)} AS {b}" for b in ("b05", "b06", "b10", "b11", "b12"))
    cloud = "b11 < CAST(0.03 AS FLOAT) OR b12 < CAST(0.02 AS FLOAT) OR b10 > CAST(0.0025 AS FLOAT)"
    return f"(SELECT tile_id, y, x, CASE WHEN NOT ({cloud}) AND b05 > 0 AND b06 > 0 THEN b05 / b06 END AS v FROM (SELECT tile_id, y, x, {t} FROM {source}))"


def threshold_sql(v: str, to: str) -> str:
    """CTEs from (tile_id, v) to a table of tile_id, n_pixels, n_valid, threshold."""
    return f"""{to}r AS (SELECT tile_id, count(*) AS n_pixels, count(v) AS n, min(CAST(v AS DOUBLE)) AS low, max(CAST(v AS DOUBLE)) AS high FROM {v} GROUP BY tile_id),
    {to}w AS (SELECT *, (high - low) / CAST(100 AS DOUBLE) AS w FROM {to}r WHERE high > low),
    {to}c AS (SELECT tile_id, least(CAST(floor((CAST(v AS DOUBLE) - low) / w) AS INT), 99) AS b, count(*) AS c FROM {v} JOIN {to}w USING (tile_id) WHERE v IS NOT NULL GROUP BY ALL),
    {to}h AS (SELECT tile_id, CAST(t.b AS INT) AS b, low + t.b * w AS e, coalesce(c, 0) AS c, coalesce(c, 0) / (n * w) AS d FROM {to}w CROSS JOIN range(100) t(b) LEFT JOIN {to}c x USING (tile_id, b)),
    {to}p AS (SELECT *, d > lag(d) OVER o AND d > lead(d) OVER o AS peak, d - min(d) OVER (PARTITION BY tile_id ORDER BY b ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS prom FROM {to}h WINDOW o AS (PARTITION BY tile_id ORDER BY b)),
    {to}m AS (SELECT *, CASE WHEN peak AND prom > 10 THEN greatest(CAST(0 AS DOUBLE), d - prom) ELSE d END AS m FROM {to}p),
    {to}a AS (SELECT *, b BETWEEN 15 AND 84 AND m > max(m) OVER (PARTITION BY tile_id ORDER BY b ROWS BETWEEN 15 PRECEDING AND 1 PRECEDING) AND m > max(m) OVER (PARTITION BY tile_id ORDER BY b ROWS BETWEEN 1 FOLLOWING AND 15 FOLLOWING) AS top FROM {to}m),
    {to}t AS (SELECT tile_id, first(e ORDER BY m DESC, b) FILTER (WHERE top) AS pk, first(e ORDER BY d DESC, b) AS md, min(e) FILTER (WHERE d > 0.1) AS ed, min(e) AS f FROM {to}a GROUP BY tile_id),
    {to}u AS (SELECT tile_id, coalesce(pk, md) - CAST(0.75 AS DOUBLE) * (coalesce(pk, md) - coalesce(ed, f)) AS raw FROM {to}t),
    {to}q AS (SELECT tile_id, quantile AS p75 FROM (SELECT tile_id, list_sort(list(CAST(v AS DOUBLE)))[count(*) * 75 // 100 + 1] AS quantile FROM {v} WHERE v BETWEEN CAST(0.3 AS DOUBLE) AND CAST(1.5 AS DOUBLE) GROUP BY tile_id)),
    {to} AS (SELECT tile_id, n_pixels, n AS n_valid, CAST(CASE WHEN n = 0 THEN 0.5 WHEN high = low THEN low WHEN p75 IS NOT NULL AND raw > p75 THEN -1 ELSE raw END AS FLOAT) AS threshold
      FROM {to}r LEFT JOIN {to}u USING (tile_id) LEFT JOIN {to}q USING (tile_id))"""


PATHOLOGY = f"{x.PIXELS}, v AS {vog_sql('pixels')}, {threshold_sql('v', 'th')}"


@query(
    f"""WITH {PATHOLOGY} SELECT th.tile_id, n_pixels, n_valid, threshold, CASE WHEN threshold >= 0 AND n_valid >= 100 THEN n_sick END AS n_sick
    FROM th JOIN (SELECT tile_id, count(CASE WHEN v < threshold THEN 1 END) AS n_sick FROM v JOIN th USING (tile_id) GROUP BY tile_id) USING (tile_id)"""
)
def pathology_tiles(spark, d):
    return p.pathology(x.pixels(spark, d))


@query(f"WITH {PATHOLOGY} SELECT tile_id, b, e AS left_edge, CAST(c AS BIGINT) AS count, d AS density FROM thh")
def vog1_histogram(spark, d):
    index = p.vog1_pixels(x.pixels(spark, d))
    return p.histogram(index, p.ranges(index))


@query(f"WITH {PATHOLOGY} SELECT tile_id, raw FROM thu")
def threshold_udaf(spark, d):
    index = p.vog1_pixels(x.pixels(spark, d))
    return p.threshold_udaf(p.histogram(index, p.ranges(index)))


@query(
    f"""WITH {x.GRID}, v1 AS {vog_sql('grid')}, va AS (SELECT * FROM v1 WHERE tile_id % 2 = 0), vb AS (SELECT tile_id - 1 AS tile_id, y, x, v FROM v1 WHERE tile_id % 2 = 1),
    {threshold_sql('va', 'ta')}, {threshold_sql('vb', 'tb')},
    k AS (SELECT ta.tile_id, ta.threshold AS t, CASE WHEN tb.threshold >= 0 THEN tb.threshold ELSE ta.threshold END AS bt FROM ta JOIN tb USING (tile_id) WHERE ta.threshold >= 0)
    SELECT tile_id, count(*) AS n, count(CASE WHEN va.v < t THEN 1 END) AS sick, count(CASE WHEN va.v < t AND vb.tile_id IS NOT NULL AND NOT coalesce(vb.v < bt, false) THEN 1 END) AS newly_sick
    FROM va JOIN k USING (tile_id) LEFT JOIN vb USING (tile_id, y, x) GROUP BY tile_id"""
)
def pathology_diff(spark, d):
    grid = x.grid_pixels(spark, d)
    even, odd = grid.where("tile_id % 2 = 0"), grid.where("tile_id % 2 = 1").withColumn("tile_id", F.col("tile_id") - 1)
    found = p.pathology_diff(even, odd)
    return found.groupBy("tile_id").agg(F.count("*").alias("n"), F.count_if("sick").alias("sick"), F.count_if("newly_sick").alias("newly_sick"))
