import math
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from scenewatch.functions import bands, geo, names, times


def one(spark, **columns):
    row = spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()
    return row[0] if len(columns) == 1 else row


def day(text):
    return F.lit(text).cast("date")


@pytest.mark.parametrize(
    ("raw", "when", "value"),
    [(0, "2022-01-26", 0), (999, "2022-01-26", 0), (1000, "2022-01-26", 0), (1000, "2022-01-25", 0.1), (11000, "2022-01-26", 1), (11000, "2022-01-25", 1), (6000, "2022-01-26", 0.5), (6000, None, 0.6)],
)
def test_toa(spark, raw, when, value):
    assert one(spark, v=bands.toa(F.lit(raw).cast("float"), day(when))) == pytest.approx(value, abs=1e-7)


def test_ndvi_forms(spark):
    f = bands.f32
    assert one(spark, v=bands.ndvi_unit(f(0.1), f(0.3))) == pytest.approx(0.75)
    assert one(spark, v=bands.ndvi_unit(f(0), f(0.3))) == 0
    assert one(spark, v=bands.ndvi_clipped(f(0.3), f(0.1))) == 0
    assert one(spark, v=bands.ndvi_clipped(f(0), f(0))) is None


def test_scl_rounds_before_it_judges(spark):
    assert [one(spark, v=bands.scl_valid(F.lit(x))) for x in (4.0, 7.6, 2.6, 2.4, 11.0)] == [True, False, False, True, False]


def test_model_input(spark):
    assert one(spark, v=bands.model_input(bands.f32(5000))) == pytest.approx(0.5)
    assert one(spark, v=bands.model_input(bands.f32(-1))) == 0
    assert one(spark, v=bands.model_input(bands.f32(1.5))) == 1
    assert one(spark, v=bands.model_input(bands.f32(7), identity=True)) == 7


def test_mask_mode():
    assert bands.cloud_mask_mode(["B04", "b03", "B02 ", "B08"]) == "none"
    assert bands.cloud_mask_mode(["B12", "B8A", "B03"]) == "full"


def test_linear_scale_keeps_zero_for_no_data(spark):
    got = [one(spark, v=bands.linear_scale(F.lit(float(v)), F.lit(100.0), F.lit(200.0))) for v in (0, 50, 100, 150, 200, 900)]
    assert got == [0, 1, 1, 128, 255, 255]


def test_seasons(spark):
    a, z = times.season_dates(F.lit("winter"), F.lit(2023))
    assert one(spark, a=a, z=z) == (date(2023, 12, 1), date(2024, 2, 28))
    a, z = times.season_dates(F.lit("monsoon"), F.lit(2023))
    assert one(spark, a=a, z=z) == (None, None)


def test_intervals(spark):
    got = one(spark, v=times.build_intervals(day("2024-01-01"), day("2024-01-10"), 3))
    start = 1704067200 * 10**6
    step = 10 * times.DAY // 3
    assert [(r.from_us, r.to_us) for r in got] == [(start, start + step), (start + step, start + 2 * step), (start + 2 * step, start + 10 * times.DAY)]
    with pytest.raises(ValueError):
        times.build_intervals(day("2024-01-01"), day("2024-01-10"), 0)


def test_date_window():
    assert times.date_window(None, None, date(2024, 3, 1)) == (date(2024, 2, 15), date(2024, 3, 1))
    assert times.date_window(None, "2024-03-01") == (date(2024, 2, 15), date(2024, 3, 1))
    for bad in ((None, None), ("2024-01-01", None), ("2024-02-01", "2024-01-01")):
        with pytest.raises(ValueError):
            times.date_window(*bad)
    assert times.years_between(date(2022, 12, 1), date(2024, 1, 1)) == [2022, 2023, 2024]


@pytest.mark.parametrize(
    ("text", "value"),
    [("2024-05-01T10:20:30Z", datetime(2024, 5, 1, 10, 20, 30)), ("2024-05-01T10:20:30.25Z", datetime(2024, 5, 1, 10, 20, 30, 250000)), ("20240501T102030", datetime(2024, 5, 1, 10, 20, 30)), ("2024-05-01 nonsense", datetime(2024, 5, 1)), ("", None), ("soon", None)],
)
def test_captured_at(spark, text, value):
    got = one(spark, v=times.captured_at(F.lit(text)).cast("timestamp_ntz"))
    assert got == value


def test_format_date(spark):
    texts = ["2024-05-01", "2024-05-01 10:20", "2024-05-01 10:20:30", "later", "", None]
    assert [one(spark, v=times.format_date(F.lit(t).cast("string"))) for t in texts] == ["01.05.2024", "01.05.2024 10:20", "01.05.2024 10:20:30", "later", "—", "—"]


def test_product_names(spark):
    rows = spark.createDataFrame([("S2A_MSIL1C_20250601T081531_N0511_R121_T40VEP_20250601T102233.SAFE",), ("S2A_x",), ("a_b_notadate_d_e_f",), (None,)], "name string")
    got = names.parse_product_name(rows).collect()
    assert got[0][1:] == (date(2025, 6, 1), "2025-06-01T08:15:31Z", "T40VEP", "T40VEP|2025-06-01T08:15:31Z")
    assert all(r[1:] == (None,) * 4 for r in got[1:])
    assert one(spark, v=names.tile_prefix(F.lit("40VDP"), "L2A")) == "L2/tiles/40/V/DP/"
    assert one(spark, v=names.tile_prefix(F.lit("40VD"), "L1C")) is None
    assert one(spark, v=names.normalize_tile_id(F.lit(" t40vdp "))) == "40VDP"
    assert [one(spark, v=names.valid_identifier(F.lit(t).cast("string"))) for t in ("aB1", "a b", "", None)] == [True, False, False, False]


@pytest.mark.parametrize(("lon", "lat", "zone"), [(56.25, 58.0, 40), (57.0, 0.0, 40), (54.1, 61.3, 40), (-70.5, -33.4, -19), (5.9, 79.0, 31)])
def test_utm_round_trip(spark, lon, lat, zone):
    e, n = geo.wgs84_to_utm(F.lit(lon), F.lit(lat), F.lit(zone))
    back = geo.utm_to_wgs84(F.col("e"), F.col("n"), F.lit(zone))
    row = spark.range(1).select(e.alias("e"), n.alias("n")).select("*", back[0].alias("lon"), back[1].alias("lat")).first()
    assert (row.lon, row.lat) == (pytest.approx(lon, abs=1e-8), pytest.approx(lat, abs=1e-8))


def test_utm_known_points(spark):
    e, n = geo.wgs84_to_utm(F.lit(57.0), F.lit(0.0), F.lit(40))
    assert one(spark, e=e, n=n) == (pytest.approx(500000, abs=1e-3), pytest.approx(0, abs=1e-3))
    e, n = geo.wgs84_to_utm(F.lit(57.0), F.lit(45.0), F.lit(40))
    assert one(spark, e=e, n=n)[1] == pytest.approx(4982950.4, abs=0.5)


def test_mercator(spark):
    x, y = geo.lonlat_to_mercator(F.lit(180.0), F.lit(89.9))
    row = one(spark, x=x, y=y)
    assert row.x == pytest.approx(geo.HALF_EQUATOR) and row.y == pytest.approx(math.log(math.tan(179.5 * math.pi / 360)) * 6378137, rel=1e-9)


def test_nearest_index_rounds_away_from_zero(spark):
    got = [one(spark, v=geo.nearest_index(F.lit(w), F.lit(0.0), F.lit(10.0))) for w in (0.0, 5.0, 10.0, 9.9, -5.0)]
    assert got == [-1, 0, 1, 0, -1]


@pytest.mark.parametrize(("tile", "bound", "size"), [(8, 1, 30), (8, 2, 9), (5, 0, 23), (10, 3, 10), (6, 1, 5)])
def test_window_owner_is_the_last_that_writes(spark, tile, bound, size):
    step, owner = tile - 2 * bound, [None] * size
    for k, y0 in enumerate(range(0, size, step)):
        low = 0 if y0 == 0 else bound
        high = size - y0 if y0 + tile >= size else tile - bound
        for y in range(y0 + low, min(y0 + max(high, low), size)):
            owner[y] = k
    got = [r[0] for r in spark.range(size).select(geo.window_owner(F.col("id"), tile, bound)).collect()]
    assert got == owner


def test_sieve_pixels(spark):
    assert [one(spark, v=geo.sieve_pixels(F.lit(a), F.lit(p))) for a, p in ((0.0, 10.0), (100.0, 10.0), (5000.0, 10.0), (5001.0, 20.0))] == [8, 8, 50, 13]


def test_boa_and_places(spark):
    from scenewatch.functions import bands, geo

    rows = spark.createDataFrame([(0.0,), (5000.0,), (20000.0,)], "v float")
    assert [r[0] for r in rows.select(bands.boa(F.col("v"))).collect()] == [0.0, 0.5, 1.0]
    gt = F.array(*[F.lit(v) for v in (100.0, 10.0, 0.0, 50.0, 0.0, -10.0)])
    x, y = geo.pixel_to_world(gt, F.lit(3.5), F.lit(2.5))
    col, row = geo.world_to_pixel(gt, x, y)
    ring = geo.rect_ring(F.lit(0.0), F.lit(1.0), F.lit(2.0), F.lit(3.0))
    got = spark.range(1).select(x, y, col, row, F.transform(ring, lambda p: F.array(p["x"], p["y"]))).first()
    assert tuple(got) == (135.0, 25.0, 3, 2, [[0.0, 1.0], [2.0, 1.0], [2.0, 3.0], [0.0, 3.0], [0.0, 1.0]])


def test_collections_keep_their_polygons(spark):
    from scenewatch.functions import geo

    ring = "[[0,0],[1,0],[1,1],[0,0]]"
    rows = spark.createDataFrame([([("Point", "[1,2]"), ("Polygon", f"[{ring}]"), ("MultiPolygon", f"[[{ring}],[{ring},{ring}]]")],), ([],)], "g array<struct<type:string,coordinates:string>>")
    assert [[len(p) for p in r[0]] for r in rows.select(geo.collection_parts(F.col("g"))).collect()] == [[1, 1, 2], []]
