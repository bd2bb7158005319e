"""Queries over pixels, patches, areas and the queue."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from scenewatch.functions import bands, geo
from scenewatch.jobs import fixtures as x
from scenewatch.jobs.scene_queries import PRODUCTS, products, toa
from scenewatch.operators import components as c
from scenewatch.operators import ingest, mosaic, raster, scoring, vector
from scenewatch.operators import job_queue as q
from scenewatch.operators import selection as s
from scenewatch.streaming import catalog as stream

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


# --- what to fetch, and the queue ---

LISTING = f"{PRODUCTS}, listing AS (SELECT p.name, CASE WHEN e.value > 30 THEN 'L2A' ELSE 'L1C' END AS level, CAST(e.value * 100 AS BIGINT) AS size, e.event_type AS kind FROM products p JOIN events e USING (event_id))"


def listing(spark, d):
    rows = products(spark, d).join(x.read(spark, d, "events").select("event_id", "event_type", "value"), "event_id")
    return rows.select("name", F.when(F.col("value") > 30, "L2A").otherwise("L1C").alias("level"), F.round(F.col("value") * 100).cast("long").alias("size"), F.col("event_type").alias("kind"))


@query(f"WITH {LISTING} SELECT name, level FROM listing WHERE name NOT IN (SELECT name FROM listing WHERE kind = 'click')")
def new_products(spark, d):
    rows = listing(spark, d)
    return ingest.new_products(rows, rows.where("kind = 'click'")).select("name", "level")


@query(f"WITH {LISTING} SELECT level, count(*) AS matched, count(CASE WHEN t THEN 1 END) AS skipped, count(CASE WHEN NOT t THEN 1 END) AS to_download FROM (SELECT *, name IN (SELECT name FROM listing WHERE kind = 'click') AS t FROM listing) GROUP BY level")
def product_counters(spark, d):
    rows = listing(spark, d)
    return ingest.product_counters(rows, rows.where("kind = 'click'"))


@query(f"WITH {LISTING}, o AS (SELECT name || '/B02.jp2' AS path, size, level, kind FROM listing UNION ALL SELECT name || '/', 0, level, kind FROM listing) SELECT level, count(*) AS files, sum(size) AS bytes FROM o WHERE path NOT LIKE '%/' AND path NOT IN (SELECT path FROM o WHERE kind = 'view' AND size > 500) GROUP BY level")
def new_files(spark, d):
    rows = listing(spark, d)
    objects = ingest.union_levels(rows.withColumn("path", F.concat("name", F.lit("/B02.jp2"))), rows.withColumns({"path": F.concat("name", F.lit("/")), "size": F.lit(0).cast("long")}))
    local = objects.where("kind = 'view'").withColumn("size", F.when(F.col("size") > 500, F.col("size")).otherwise(0))
    found = ingest.transfer_counters(ingest.new_files(objects, local))
    return found.withColumn("bytes", F.col("bytes").cast("decimal(38,0)"))


TIMED = "strptime(\"time\", '%Y-%m-%d %H:%M')"


@query(f"WITH {x.JOBS}, {x.SPECS}, {x.POLYGONS} SELECT job_id, coalesce(description, j.model, '—') AS model, coalesce(name, CAST(j.polygon_id AS VARCHAR), '—') AS area, CAST(cloud AS VARCHAR) || '%' AS cloud, strftime(\"start\", '%d.%m.%Y') AS \"start\", CASE WHEN \"time\" = 'soon' THEN 'soon' ELSE strftime(try_{TIMED}, '%d.%m.%Y %H:%M') END AS \"time\" FROM jobs j LEFT JOIN specs USING (model) LEFT JOIN polygons USING (polygon_id)")
def enrich_jobs(spark, d):
    return q.enrich_jobs(x.jobs(spark, d), x.specs(spark, d), x.polygons(spark, d)).select("job_id", "model", "area", "cloud", "start", "time")


@query(f"WITH {x.JOBS} SELECT job_id FROM jobs ORDER BY coalesce(try_{TIMED}, TIMESTAMP '1970-01-01'), job_id LIMIT 1")
def oldest_job(spark, d):
    return q.oldest_job(x.jobs(spark, d)).select("job_id")


@query(f"WITH {x.JOBS} SELECT job_id, coalesce(try_{TIMED} < TIMESTAMP '2024-02-10', false) AS removed FROM jobs")
def prune_results(spark, d):
    kept, gone = q.prune_results(x.jobs(spark, d), F.lit("2024-03-11").cast("timestamp"), 30)
    return kept.select("job_id", F.lit(False).alias("removed")).unionByName(gone.select("job_id", F.lit(True).alias("removed")))


@query(f"WITH {x.JOBS} SELECT job_id, CASE WHEN cloud >= 50 THEN 'queued' ELSE 'done' END AS state FROM jobs WHERE cloud >= 50 OR polygon_id < 12")
def settle_queue(spark, d):
    jobs = x.jobs(spark, d)
    left, done = q.settle_queue(jobs, jobs.where("cloud < 50"), jobs.where("polygon_id < 12"), F.lit("2024-03-01 00:00"))
    return left.select("job_id", F.lit("queued").alias("state")).unionByName(done.select("job_id", F.lit("done").alias("state")))


@query("SELECT p_brand AS tile_id, coalesce(min(p_name) FILTER (WHERE p_name LIKE '%ring'), min(p_name) FILTER (WHERE p_name LIKE 'red%')) AS path FROM part WHERE p_name LIKE '%ring' OR p_name LIKE 'red%' GROUP BY p_brand")
def best_file(spark, d):
    return s.best_file(x.read(spark, d, "part"), ["ring$", "^red"], "p_brand", "p_name").toDF("tile_id", "path")


@query("SELECT scene_id, band FROM (SELECT o_custkey AS scene_id, o_orderkey AS band, row_number() OVER (PARTITION BY o_custkey ORDER BY (1 + o_orderkey % 5) * (1 + o_orderkey % 3) DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1")
def reference_band(spark, d):
    k = F.col("o_orderkey")
    rows = x.read(spark, d, "orders").select(F.col("o_custkey").alias("scene_id"), k.alias("nth"), k.alias("band"), (1 + k % 5).alias("w"), (1 + k % 3).alias("h"))
    return s.reference_band(rows, "L1C", native=True).select("scene_id", "band")


@query(f"WITH {x.SCENES} SELECT tile_id, to_timestamp(floor(epoch(captured_at) / 432000) * 432000)::TIMESTAMP AS \"from\", count(*) AS n FROM scenes GROUP BY ALL")
def scene_counts_by_window(spark, d):
    found = stream.scene_counts_by_window(x.scenes(spark, d), "5 days")
    return found.select("tile_id", F.col("from").cast("timestamp_ntz").alias("from"), "n")


# --- pixels ---

REFLECT = ", ".join(f"{toa(b)} AS {b}" for b in x.BANDS)


def bool_cloud(full: bool) -> str:
    simple = "b11 < CAST(0.03 AS FLOAT) OR b12 < CAST(0.02 AS FLOAT) OR b10 > CAST(0.0025 AS FLOAT)"
    more = " OR (CASE WHEN b03 + b11 = 0 THEN CAST(0 AS FLOAT) ELSE (b03 - b11) / (b03 + b11) END) > CAST(0.1 AS FLOAT) OR CAST((b02 + b03 + b04) / CAST(3 AS FLOAT) AS FLOAT) > CAST(0.25 AS FLOAT) OR CAST(b02 - CAST(0.5 AS FLOAT) * b04 - CAST(0.08 AS FLOAT) AS FLOAT) > CAST(0.01 AS FLOAT)"
    return simple + (more if full else "")


@query(f"WITH {x.GRID}, r AS (SELECT tile_id, y, x, {REFLECT} FROM grid) SELECT tile_id, y, x, b04, b08, {bool_cloud(False)} AS simple, {bool_cloud(True)} AS full FROM r")
def cloud_masks(spark, d):
    r = {b: bands.toa(F.col(b), F.col("date")) for b in x.BANDS}
    t = x.grid_pixels(spark, d).select("tile_id", "y", "x", *[v.alias(b) for b, v in r.items()])
    col = {b: F.col(b) for b in x.BANDS}
    simple = bands.cloud_mask(col["b10"], col["b11"], col["b12"])
    return t.select("tile_id", "y", "x", "b04", "b08", simple.alias("simple"), bands.cloud_mask(col["b10"], col["b11"], col["b12"], col["b02"], col["b03"], col["b04"]).alias("full"))


CUBE = f"""{x.GRID}, r AS (SELECT tile_id, y, x, {REFLECT} FROM grid),
  cube AS (SELECT tile_id, y, x, b04, b08, (b04 > 0 OR b08 > 0) AND NOT ({bool_cloud(False)}) AS valid,
    CASE WHEN (b04 > 0 OR b08 > 0) AND NOT ({bool_cloud(False)}) AND b04 <> 0 AND b08 <> 0 AND b08 + b04 <> 0 THEN CAST(((b08 - b04) / (b08 + b04) + CAST(1 AS FLOAT)) * CAST(0.5 AS FLOAT) AS FLOAT) ELSE CAST(0 AS FLOAT) END AS ndvi FROM r)"""


def cube(spark, d):
    return raster.build_cube(x.grid_pixels(spark, d), ["NDVI"], "L1C", "simple")


@query(f"WITH {CUBE} SELECT tile_id, y, x, ndvi, valid FROM cube")
def build_cube(spark, d):
    return cube(spark, d)


@query(f"WITH {CUBE} SELECT tile_id, count(*) AS n, CAST(100 AS DOUBLE) * (count(*) - count(CASE WHEN valid THEN 1 END)) / count(*) AS nodata_pct FROM cube GROUP BY tile_id")
def nodata_percent(spark, d):
    return raster.nodata_percent(cube(spark, d))


@query(f"WITH {CUBE}, g AS (SELECT tile_id FROM cube GROUP BY tile_id HAVING CAST(100 AS DOUBLE) * count(CASE WHEN NOT valid THEN 1 END) / count(*) < 40) SELECT tile_id, count(*) AS n FROM cube WHERE tile_id IN (SELECT tile_id FROM g) GROUP BY tile_id")
def reject_empty_scenes(spark, d):
    return raster.reject_empty_scenes(cube(spark, d), limit=40.0).groupBy("tile_id").agg(F.count("*").alias("n"))


ALIGN = f"{CUBE}, a AS (SELECT * FROM cube WHERE tile_id % 2 = 0), b AS (SELECT tile_id - 1 AS tile_id, y, x, ndvi, valid FROM cube WHERE tile_id % 2 = 1)"


@query(f"WITH {ALIGN} SELECT a.tile_id, a.y - 3 AS y, a.x - 1 AS x, CASE WHEN a.valid AND b.valid THEN a.ndvi ELSE CAST(0 AS FLOAT) END AS a_ndvi, CASE WHEN a.valid AND b.valid THEN b.ndvi ELSE CAST(0 AS FLOAT) END AS b_ndvi, a.valid AND b.valid AS valid FROM a JOIN b ON a.tile_id = b.tile_id AND a.y = b.y + 3 AND a.x = b.x + 1")
def align_pairs(spark, d):
    """The odd tiles' grid lies three rows below and one column right of the even ones'."""
    rows = cube(spark, d)
    a, b = rows.where("tile_id % 2 = 0"), rows.where("tile_id % 2 = 1").withColumn("tile_id", F.col("tile_id") - 1)
    h, w = rows.agg(F.max("y") + 1, F.max("x") + 1).first()
    tiles = a.select("tile_id").distinct()

    def grid(x0: float, y0: float):
        return tiles.select("tile_id", F.array(*[F.lit(v) for v in (x0, 10.0, 0.0, y0, 0.0, -10.0)]).alias("gt"), F.lit(h).cast("int").alias("h"), F.lit(w).cast("int").alias("w"))

    return raster.align_pairs(a, b, grid(0.0, 0.0), grid(10.0, -30.0), ["ndvi"])


@query(f"WITH {ALIGN} SELECT tile_id, y, x, a.ndvi AS ndvi_1, b.ndvi AS ndvi_2, a.valid AND b.valid AS valid FROM a JOIN b USING (tile_id, y, x)")
def concat_inputs(spark, d):
    rows = cube(spark, d)
    return raster.concat_inputs(rows.where("tile_id % 2 = 0"), rows.where("tile_id % 2 = 1").withColumn("tile_id", F.col("tile_id") - 1), ["ndvi"])


@query(f"WITH {x.GRID} SELECT r.tile_id, r.y, r.x, coalesce(s.b04, CAST(0 AS FLOAT)) AS v FROM grid r LEFT JOIN grid s ON r.tile_id = s.tile_id AND s.y = floor(r.y / 2) + 1 AND s.x = floor(r.x / 2)")
def resample_nearest_geo(spark, d):
    grid = x.grid_pixels(spark, d)
    src, ref = [0.0, 20.0, 0.0, 20.0, 0.0, -20.0], [0.0, 10.0, 0.0, 0.0, 0.0, -10.0]
    return raster.resample_nearest_geo(grid.select("tile_id", "y", "x", F.col("b04").alias("v")), grid, src, ref)


@query(f"WITH {x.GRID} SELECT tile_id, y - 100 AS y, x - 2 AS x, b04 FROM grid WHERE y >= 100 AND y < 600 AND x >= 2 AND x < 6")
def crop(spark, d):
    return raster.crop(x.grid_pixels(spark, d).select("tile_id", "y", "x", "b04"), 2, 100, 4, 500)


@query(f"""WITH {x.GRID}, v AS (SELECT tile_id % 2 AS tile_id, tile_id // 2 AS i, y, x, CASE WHEN b04 > 0 OR b08 > 0 THEN greatest(CAST(0 AS FLOAT), coalesce((b08 - b04) / nullif(b08 + b04, 0), 0)) END AS n FROM grid)
  SELECT tile_id, y, x, count(n) = 4 AS valid, {', '.join(f'CAST(CASE WHEN count(n) = 4 THEN max(n) FILTER (WHERE i = {i}) ELSE 0 END AS FLOAT) AS ndvi_{i}' for i in range(4))} FROM v GROUP BY tile_id, y, x""")
def ndvi_series(spark, d):
    rows = x.grid_pixels(spark, d).select((F.col("tile_id") % 2).alias("tile_id"), F.floor(F.col("tile_id") / 2).alias("i"), "y", "x", F.col("b04").alias("red"), F.col("b08").alias("nir"))
    return raster.build_ndvi_series(rows, 4)


# --- mosaic ---

VALUES = f"{x.GRID}, vals AS (SELECT tile_id, y, x, band, v FROM grid UNPIVOT (v FOR band IN (b02, b03, b04)))"


def values(spark, d):
    grid = x.grid_pixels(spark, d)
    return grid.unpivot(["tile_id", "y", "x"], ["b02", "b03", "b04"], "band", "v")


STATS = f"{VALUES}, st AS (SELECT tile_id, band, count(v) AS n, min(CAST(v AS DOUBLE)) AS low, CASE WHEN max(v) <= min(v) THEN min(CAST(v AS DOUBLE)) + 1 ELSE max(CAST(v AS DOUBLE)) END AS high, avg(CAST(v AS DOUBLE)) AS mean, stddev_pop(CAST(v AS DOUBLE)) AS std FROM vals GROUP BY tile_id, band)"
SCALE = f"""{STATS}, ab AS (SELECT band, low, high, greatest(1.0, mean - 2 * greatest(std, 1.0)) AS a, least(65535.0, mean + 2 * greatest(std, 1.0)) AS b FROM st),
  ab2 AS (SELECT band, CASE WHEN b <= a THEN greatest(1.0, low) ELSE a END AS a, CASE WHEN b <= a THEN greatest(greatest(1.0, low) + 1, high) ELSE b END AS b FROM ab),
  sc AS (SELECT band, CASE WHEN n <= m THEN 1.0 ELSE m END AS src_min, CASE WHEN n <= m THEN 10000.0 ELSE n END AS src_max FROM (SELECT band, median(a) AS m, median(b) AS n FROM ab2 GROUP BY band))"""


@query(f"WITH {STATS} SELECT tile_id, band, n, low, high, round(mean, 6) AS mean, round(std, 6) AS std FROM st")
def band_stats(spark, d):
    found = mosaic.band_stats(values(spark, d), stride=1)
    return found.withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


@query(f"WITH {SCALE} SELECT band, round(CAST(src_min AS DOUBLE), 6) AS src_min, round(CAST(src_max AS DOUBLE), 6) AS src_max FROM sc")
def global_scale(spark, d):
    found = mosaic.global_scale(mosaic.band_stats(values(spark, d), stride=1))
    return found.select("band", F.round("src_min", 6).alias("src_min"), F.round("src_max", 6).alias("src_max"))


@query(f"WITH {VALUES} SELECT band, y, x, v FROM (SELECT *, row_number() OVER (PARTITION BY band, y, x ORDER BY tile_id DESC) AS rn FROM vals WHERE v <> 0) WHERE rn = 1")
def overlay(spark, d):
    return mosaic.overlay_bands(x.grid_pixels(spark, d, ("y", "x")), ["y", "x"], ["b02", "b03", "b04"], "tile_id")


@query(f"WITH {VALUES} SELECT tile_id, band, y, x, CAST(CASE WHEN v = 0 THEN 0 ELSE least(255, greatest(1, floor((CAST(v AS DOUBLE) - 200) / (1500.0 - 200) * 254.0 + 1.5))) END AS INT) AS v FROM vals")
def normalize_tiles(spark, d):
    scale = spark.createDataFrame([(b, 200.0, 1500.0) for b in ("b02", "b03", "b04")], "band string, src_min double, src_max double")
    return mosaic.normalize_tiles(values(spark, d), scale)


# --- windows and scores ---


def patch_pixels(spark, d):
    return x.patches(spark, d).select(F.col("vec_id").alias("tile_id"), "y", "x", "v", (F.col("dn") > 0).alias("valid"))


def contrast(windows: np.ndarray) -> np.ndarray:
    """Two scores that need no context, so that stitching can be told from scoring."""
    return np.concatenate([windows[:, :1] * 2, 1 - windows[:, :1]], axis=1)


@query(f"WITH {x.PATCHES} SELECT vec_id AS tile_id, y, x, CASE WHEN v * CAST(2 AS FLOAT) > CAST(0.25 AS FLOAT) THEN 1 ELSE 0 END AS v FROM patches WHERE dn > 0")
def score_binary(spark, d):
    windows = scoring.make_windows(patch_pixels(spark, d), 4, bound=1)
    return scoring.stitch_binary(scoring.score_windows(windows, contrast, ["v"], 4), 4, 1, 0.25)


@query(f"WITH {x.PATCHES}, k AS (SELECT unnest(range(0, 8, 2)) AS o), w AS (SELECT vec_id AS tile_id, y, x, CAST(a.o // 2 AS INT) AS wy, CAST(b.o // 2 AS INT) AS wx FROM patches JOIN k a ON y >= a.o AND y < a.o + 4 JOIN k b ON x >= b.o AND x < b.o + 4) SELECT tile_id, wy, wx, count(*) AS n, sum(y * 8 + x) AS cells FROM w GROUP BY ALL")
def make_windows(spark, d):
    rows = scoring.make_windows(patch_pixels(spark, d), 4, bound=1)
    return rows.groupBy("tile_id", "wy", "wx").agg(F.count("*").alias("n"), F.sum(F.col("y") * 8 + F.col("x")).cast("decimal(38,0)").alias("cells"))


SCORES = f"""{x.PATCHES}, k AS (SELECT unnest(range(3)) AS k), w AS (SELECT unnest(range(2)) AS w),
  sc AS (SELECT vec_id AS tile_id, y, x, CAST(k AS INT) AS k, ((vec_id * 31 + y * 7 + x * 13 + k * 17 + w * 5) % 101) / CAST(101 AS DOUBLE) AS score FROM patches, k, w)"""


def scores(spark, d):
    rows = x.patches(spark, d).select(F.col("vec_id").alias("tile_id"), "y", "x", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k")).select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("w"))
    return rows.withColumn("score", ((F.col("tile_id") * 31 + F.col("y") * 7 + F.col("x") * 13 + F.col("k") * 17 + F.col("w") * 5) % 101) / F.lit(101.0))


@query(f"WITH {SCORES}, m AS (SELECT tile_id, y, x, k, avg(score) AS s FROM sc GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY tile_id, y, x ORDER BY round(s, 12) DESC, k) AS rn FROM m) SELECT tile_id, y, x, CASE WHEN k > 0 THEN k ELSE 0 END AS v, k > 0 AS is_detection FROM b WHERE rn = 1")
def score_multiclass(spark, d):
    return scoring.stitch_multiclass(scores(spark, d))


@query(f"WITH {SCORES} SELECT tile_id, min(score) AS low, max(score) AS high, round(avg(score), 9) AS mean FROM sc GROUP BY tile_id")
def patch_stats(spark, d):
    return scoring.patch_stats(scores(spark, d)).withColumn("mean", F.round("mean", 9))


# --- regions and areas ---


def patch_cells(spark, d):
    return x.patches(spark, d).select(F.col("vec_id").alias("tile_id"), "y", "x", F.col("dn").alias("v"))


CELLS = f"{x.PATCHES}, cells AS (SELECT vec_id AS tile_id, y, x, dn AS v FROM patches WHERE dn <> 0)"


def regions(conn: int) -> str:
    """A recursive walk from every cell to all cells of its region."""
    near = "abs(a.y - b.y) + abs(a.x - b.x) = 1" if conn == 4 else "greatest(abs(a.y - b.y), abs(a.x - b.x)) = 1"
    return f"""e AS (SELECT a.tile_id, a.y * 8 + a.x AS p, b.y * 8 + b.x AS q FROM cells a JOIN cells b ON a.tile_id = b.tile_id AND a.v = b.v AND {near}),
      walk AS (SELECT tile_id, y * 8 + x AS p, y * 8 + x AS q FROM cells UNION SELECT w.tile_id, w.p, e.q FROM walk w JOIN e ON e.tile_id = w.tile_id AND e.p = w.q),
      lab AS (SELECT tile_id, p, min(q) AS r FROM walk GROUP BY tile_id, p),
      labelled AS (SELECT c.*, (r // 8) * 2147483648 + r % 8 AS component FROM cells c JOIN lab l ON c.tile_id = l.tile_id AND l.p = c.y * 8 + c.x)"""


@query(f"WITH RECURSIVE {CELLS}, {regions(4)} SELECT tile_id, CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x, v, component FROM labelled")
def label_components(spark, d):
    return c.label_components(patch_cells(spark, d), 4, block=4)


@query(f"WITH RECURSIVE {CELLS}, {regions(8)} SELECT tile_id, component, min(v) AS v, count(*) AS n, CAST(count(*) AS DOUBLE) * 100 AS area FROM labelled GROUP BY tile_id, component")
def component_sizes(spark, d):
    found = c.component_sizes(c.label_components(patch_cells(spark, d), 8, block=3), 100.0)
    return found.select("tile_id", "component", "v", "n", "area")


@query(f"WITH RECURSIVE {CELLS}, {regions(4)} SELECT tile_id, CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x, v FROM labelled WHERE (tile_id, component) IN (SELECT (tile_id, component) FROM labelled GROUP BY tile_id, component HAVING count(*) >= 3)")
def filter_small(spark, d):
    return c.filter_small(patch_cells(spark, d), 3, 4, block=5)


@query(f"WITH {CELLS} SELECT DISTINCT tile_id, CAST(y + dy AS BIGINT) AS y, CAST(x + dx AS BIGINT) AS x FROM cells, (SELECT unnest([-1, 0, 1]) AS dy) a, (SELECT unnest([-1, 0, 1]) AS dx) b WHERE y + dy BETWEEN 0 AND 7 AND x + dx BETWEEN 0 AND 7")
def dilate(spark, d):
    cells = patch_cells(spark, d)
    bounds = cells.select("tile_id").distinct().select("tile_id", F.lit(8).alias("h"), F.lit(8).alias("w"))
    return c.dilate(cells, 1, bounds).select("tile_id", F.col("y").cast("long"), F.col("x").cast("long"))


@query(f"WITH RECURSIVE {CELLS}, {regions(8)}, old AS (SELECT tile_id + 1 AS tile_id, y, x FROM cells), sh AS (SELECT tile_id, component, avg(CASE WHEN o.y IS NULL THEN 0.0 ELSE 1.0 END) AS s FROM labelled LEFT JOIN old o USING (tile_id, y, x) GROUP BY tile_id, component) SELECT tile_id, CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x, v FROM labelled JOIN sh USING (tile_id, component) WHERE s < 0.4")
def drop_old_components(spark, d):
    cells = patch_cells(spark, d)
    return c.drop_old_components(cells, cells.withColumn("tile_id", F.col("tile_id") + 1), 0.4, block=4)


@query(f"WITH RECURSIVE {CELLS}, {regions(4)} SELECT tile_id, component, min(v) AS dn, CAST(count(*) AS DOUBLE) * 100 AS area FROM labelled GROUP BY tile_id, component HAVING count(*) >= 4")
def polygonize(spark, d):
    found = vector.polygonize(c.label_components(patch_cells(spark, d), 4), [0.0, 10.0, 0.0, 0.0, 0.0, -10.0])
    return vector.filter_features(found, 400.0).select("tile_id", "component", "dn", "area")


@query(
    f"""WITH RECURSIVE {CELLS}, {regions(4)}, corner AS (SELECT tile_id, component, y + j AS vy, x + i AS vx, 1 - j AS j, 1 - i AS i FROM labelled, (SELECT unnest([0, 1]) AS j), (SELECT unnest([0, 1]) AS i)),
    v AS (SELECT tile_id, component, vy, vx, CASE count(*) WHEN 1 THEN 1 WHEN 3 THEN 1 WHEN 2 THEN CASE WHEN count(DISTINCT j) = 2 AND count(DISTINCT i) = 2 THEN 2 ELSE 0 END ELSE 0 END AS n FROM corner GROUP BY ALL)
    SELECT tile_id, component, sum(n)::BIGINT AS corners, (min(vx) FILTER (WHERE n > 0) * 10)::DOUBLE AS left_x FROM v GROUP BY tile_id, component"""
)
def polygon_corners(spark, d):
    """Corners of all rings of a region, and where its outer ring begins, with regions spread over blocks of 3 cells."""
    found = vector.polygonize(c.label_components(patch_cells(spark, d), 4, block=3), [0.0, 10.0, 0.0, 0.0, 0.0, -10.0], block=3)
    corners = F.aggregate("rings", F.lit(0).cast("long"), lambda n, ring: n + F.size(ring) - 1)
    return found.select("tile_id", "component", corners.alias("corners"), F.element_at(F.element_at("rings", 1), 1)[0].alias("left_x"))


@query(f"WITH {x.PATCHES} SELECT DISTINCT dn, CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) + 8 * (vec_id % 50) AS x FROM patches WHERE dn > 0")
def dissolve(spark, d):
    rows = x.patches(spark, d).where("dn > 0").select("dn", F.col("y").cast("long"), (F.col("x") + 8 * (F.col("vec_id") % 50)).alias("x"))
    return vector.dissolve(rows)


SQUARE = [(3.0, 1.0), (300.2, 1.0), (300.2, 6.0), (3.0, 6.0), (3.0, 1.0)]
HOLE = [(50.0, 2.0), (90.0, 2.0), (90.0, 5.0), (50.0, 5.0), (50.0, 2.0)]


@query(f"WITH {x.PATCHES}, m AS (SELECT vec_id AS tile_id, dn, y, CAST(x AS BIGINT) + 8 * (vec_id % 50) AS x FROM patches WHERE dn > 0) SELECT tile_id, dn, CAST(y AS BIGINT) AS y, x FROM m WHERE y BETWEEN 1 AND 5 AND x BETWEEN 3 AND 299 AND NOT (y BETWEEN 2 AND 4 AND x BETWEEN 50 AND 89)")
def clip_to_aoi(spark, d):
    rings = spark.createDataFrame([("a", 0, k, [{"x": a, "y": b} for a, b in r]) for k, r in enumerate((SQUARE, HOLE))], "aoi_id string, poly int, ring int, points array<struct<x:double,y:double>>")
    area = vector.aoi_cells(vector.rings_in_cells(rings, 0.0, 0.0, 1.0))
    rows = x.patches(spark, d).where("dn > 0").select(F.col("vec_id").alias("tile_id"), "dn", F.col("y").cast("long"), (F.col("x") + 8 * (F.col("vec_id") % 50)).alias("x"))
    return vector.clip_to_aoi(rows, area).select("tile_id", "dn", "y", "x")


@query(f"WITH RECURSIVE {CELLS}, {regions(4)}, l AS (SELECT * FROM labelled a WHERE NOT EXISTS (SELECT 1 FROM cells b WHERE b.tile_id + 1 = a.tile_id AND a.y = b.y AND a.x = b.x)) SELECT tile_id, CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x, v, component FROM l WHERE (tile_id, component) IN (SELECT (tile_id, component) FROM l GROUP BY tile_id, component HAVING count(*) >= 2)")
def subtract_overlapping(spark, d):
    cells = patch_cells(spark, d)
    base = cells.where("v <> 0").select(F.col("tile_id") + 1, F.col("y").cast("long"), F.col("x").cast("long")).toDF("tile_id", "y", "x")
    return vector.subtract_overlapping(c.label_components(cells, 4), base, 2).select("tile_id", "y", "x", "v", "component")


@query(f"WITH {x.JOBS}, {x.PATCHES}, f AS (SELECT DISTINCT vec_id * 3 AS job_id, dn FROM patches WHERE dn > 0) SELECT job_id, count(dn) AS n, CASE WHEN count(dn) = 0 THEN 'no polygons' END AS error FROM jobs LEFT JOIN f USING (job_id) GROUP BY job_id")
def feature_count(spark, d):
    features = x.patches(spark, d).where("dn > 0").select((F.col("vec_id") * 3).alias("job_id"), "dn").distinct()
    return vector.feature_count(x.jobs(spark, d).select("job_id").join(features, "job_id", "left"))


@query(f"WITH {x.SCENES} SELECT event_id, round(min_x * 20037508.342789244 / 180.0, 3) AS mx, round(ln(tan((90.0 + min_y) * pi() / 360.0)) * 20037508.342789244 / pi(), 3) AS my FROM scenes")
def lonlat_to_mercator(spark, d):
    mx, my = geo.lonlat_to_mercator(F.col("min_x"), F.col("min_y"))
    return x.scenes(spark, d).select("event_id", F.round(mx, 3).alias("mx"), F.round(my, 3).alias("my"))
