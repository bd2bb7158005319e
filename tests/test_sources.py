import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from scenewatch.sources import files

SCENE = {"date": "2025-06-01", "captured_at": "2025-06-01T08:15:31Z", "scene_id": "", "safe_name": "a.SAFE", "img_data_path": "/x", "cloud": 3.5, "envelope": [1, 2, 3, 4], "tile_id": "T40VEP"}


def catalog(tmp_path, year, **changes):
    doc = {"version": 9, "preprocess": "sentinel", "generated": "", "year": year, "tiles": [SCENE]} | changes
    (tmp_path / str(year)).mkdir(parents=True, exist_ok=True)
    (tmp_path / str(year) / files.CATALOG_FILE).write_text(json.dumps(doc))


def test_read_catalog(spark, tmp_path):
    catalog(tmp_path, 2024)
    catalog(tmp_path, 2025)
    rows = files.read_catalog(spark, str(tmp_path), [2025]).collect()
    assert [(r.year, r.scene_id, r.cloud, r.nodata_pct, r.min_x, r.max_y, str(r.date)) for r in rows] == [(2025, "a.SAFE", 3.5, None, 1, 4, "2025-06-01")]
    assert files.read_catalog(spark, str(tmp_path)).count() == 2


@pytest.mark.parametrize("changes", [{"version": 6}, {"preprocess": "other"}, {"tiles": []}])
def test_bad_catalogs_fail(spark, tmp_path, changes):
    catalog(tmp_path, 2025, **changes)
    with pytest.raises(PySparkException):
        files.read_catalog(spark, str(tmp_path)).collect()


def test_write_catalog_replaces_only_its_years(spark, tmp_path):
    rows = spark.sql("SELECT 't' AS tile_id, DATE '2024-01-01' AS date, 1.0D AS cloud UNION ALL SELECT 'u', DATE '2025-01-01', 2.0D")
    files.write_catalog(rows, str(tmp_path / "c"))
    files.write_catalog(rows.where("tile_id = 'u'").withColumn("cloud", F.lit(7.0)), str(tmp_path / "c"))
    assert sorted((r.year, r.cloud) for r in spark.read.parquet(str(tmp_path / "c")).collect()) == [(2024, 1.0), (2025, 7.0)]


def test_metadata(spark, tmp_path):
    wrap = '<n1:Level-1C_User_Product xmlns:n1="urn:x"><Q>{}</Q></n1:Level-1C_User_Product>'
    texts = {
        "a": "<Cloud_Coverage_Assessment>12.5</Cloud_Coverage_Assessment>", "b": "<CLOUDY_PIXEL_PERCENTAGE>4</CLOUDY_PIXEL_PERCENTAGE>", "c": "",
        "d": "<Cloud_Coverage_Assessment>1</Cloud_Coverage_Assessment><Cloud_Coverage_Assessment>2</Cloud_Coverage_Assessment><NODATA_PIXEL_PERCENTAGE>0.5</NODATA_PIXEL_PERCENTAGE>",
    }
    for name, text in texts.items():
        (tmp_path / f"{name}.xml").write_text(wrap.format(text))
    read = lambda level: {r.path[-5]: (r.cloud, r.nodata_pct) for r in files.read_product_metadata(spark, str(tmp_path / "*.xml"), level).collect()}
    assert read("L1C") == {"a": (12.5, None), "b": (4.0, None), "c": (None, None), "d": (2.0, None)}
    assert read("L2A") == {"a": (None, None), "b": (None, None), "c": (None, None), "d": (2.0, 0.5)}


def test_band_paths(spark):
    xml = "<a>" + "".join(f"<IMAGE_FILE>{f}</IMAGE_FILE>" for f in ("R20m/x_B04_20m", "R10m/x_B04_10m", "R20m/x_B05_20m", "R60m/x_B05_60m")) + "</a>"
    rows = spark.createDataFrame([("p", xml)], "path string, xml string")
    got = {(r.band, r.file) for r in files.band_paths(rows, ["B04", "B05", "B99"], ["10m", "20m", "60m"]).collect()}
    assert got == {("B04", "R10m/x_B04_10m"), ("B05", "R20m/x_B05_20m")}


def test_json_maps(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"1": {"name": "one", "public": 2}, "2": {"name": "two", "publick": 1}}')
    (tmp_path / "l.json").write_text('[{"id": "9", "model": "m", "time": "t"}, {"model": "n"}]')
    (tmp_path / "e.json").write_text("  \n")
    (tmp_path / "r.json").write_text('{ // note\n "1": {"name": "a // b, }", "public": 1,}, /* x */ }')
    assert sorted(map(tuple, files.read_polygons(spark, str(tmp_path / "m.json")).collect())) == [("1", "one", 2), ("2", "two", 1)]
    assert [(r.id, r.model) for r in files.read_json_map(spark, str(tmp_path / "l.json"), files.JOB).collect()] == [("9", "m"), (None, "n")]
    assert files.read_json_map(spark, str(tmp_path / "e.json"), files.JOB).count() == 0
    assert [(r.id, r["name"], r.public) for r in files.read_json_map(spark, str(tmp_path / "r.json"), files.POLYGON, relaxed=True).collect()] == [("1", "a // b, }", 1)]
    rows = spark.createDataFrame([("a", 1), ("b", None)], "id string, n int")
    files.write_json_map(rows, str(tmp_path / "out"))
    assert sorted(map(tuple, files.read_json_map(spark, str(tmp_path / "out"), "n INT").collect())) == [("a", 1), ("b", None)]
    with pytest.raises(ValueError):
        files.write_json_map(rows, str(tmp_path / "out2"), most=1)


def test_specs(spark, tmp_path):
    models = {"m": {"channels": ["B04"]}, "bad": {"preprocess": "zebra"}, "two": {"inputs": 2, "pair_mode": "union", "threshold": 0.3, "mask_filter": {"enabled": True, "min_area": 4, "connectivity": 8}}}
    (tmp_path / "c.json").write_text(json.dumps({"models": models}))
    rows = {r.model: r for r in files.load_specs(spark, str(tmp_path / "c.json")).collect()}
    assert set(rows) == {"m", "two"}
    assert (rows["m"].tile, rows["m"].threshold, rows["m"].pair_mode, rows["m"].onnx_file, rows["m"].mask_filter.connectivity) == (256, 0.5, "concat", "m.onnx", 4)
    assert (rows["two"].pair_mode, rows["two"].threshold, rows["two"].mask_filter.connectivity) == ("union", 0.3, 8)
    for wrong in ({"pair_mode": "concat"}, {"inputs": 2, "pair_mode": "sum"}):
        (tmp_path / "w.json").write_text(json.dumps({"models": {"w": wrong}}))
        with pytest.raises(PySparkException):
            files.load_specs(spark, str(tmp_path / "w.json")).collect()


def test_geojson(spark, tmp_path):
    square, hole = [[0, 0], [9, 0], [9, 9], [0, 9], [0, 0]], [[2, 2], [4, 2], [4, 4], [2, 2]]
    features = [{"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [square, hole]}}, {"type": "Feature", "geometry": {"type": "MultiPolygon", "coordinates": [[square], [square]]}}]
    (tmp_path / "a.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    rows = files.read_geojson(spark, str(tmp_path / "a.geojson"))
    assert sorted((r.feature, r.poly, r.ring, r.is_hole, len(r.points)) for r in rows.collect()) == [(0, 0, 0, False, 5), (0, 0, 1, True, 4), (1, 0, 0, False, 5), (1, 1, 0, False, 5)]
    (tmp_path / "b.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": []}))
    with pytest.raises(PySparkException):
        files.read_geojson(spark, str(tmp_path / "b.geojson")).collect()


def test_features_and_listing(spark, tmp_path):
    rows = spark.createDataFrame([(1, [[[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 0.0]]]]), (2, [])], "dn int, coordinates array<array<array<array<double>>>>")
    files.write_features(rows, str(tmp_path / "f"))
    got = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "f")).collect()]
    assert [(g["properties"]["DN"], g["geometry"]["type"]) for g in got] == [(1, "MultiPolygon")]
    spark.createDataFrame([("tiles/40/V/DP/S2A_x.SAFE/B02.jp2", 5), ("other", 1)], "path string, size bigint").write.parquet(str(tmp_path / "l"))
    assert sorted((r.name or "", r.tile_id or "") for r in files.read_listing(spark, str(tmp_path / "l")).collect()) == [("", ""), ("S2A_x.SAFE", "40VDP")]


def test_years(spark):
    names = spark.createDataFrame([("2024",), ("2019",), ("1999",), ("x",)], "name string")
    assert [r.name for r in files.year_dirs(names, "all").collect()] == ["2019", "2024"]
    assert [r.name for r in files.year_dirs(names, "2024").collect()] == ["2024"]
    with pytest.raises(ValueError):
        files.year_dirs(names, "24")


def test_blank_catalog_mode_is_sentinel(spark, tmp_path):
    tile = {"tile_id": "40VDP", "date": "2025-01-02", "safe_name": "x", "cloud": 1.0}
    for k, mode in enumerate(["", "  ", None, "Sentinel"]):
        folder = tmp_path / str(k) / "2025"
        folder.mkdir(parents=True)
        (folder / files.CATALOG_FILE).write_text(json.dumps({"version": 7, "preprocess": mode, "year": 2025, "tiles": [tile]}))
        assert [r.preprocess for r in files.read_catalog(spark, str(tmp_path / str(k))).collect()] == ["sentinel"]


def test_blocks_are_written_and_read(spark, tmp_path):
    row = ("s", "t", "B04", "L1C", 0, 1, 1, 2, [0.0, 10.0, 0.0, 0.0, 0.0, -10.0], 32640, [0.0, 2.0])
    blocks = spark.createDataFrame([row], files.BLOCK)
    blocks.write.parquet(str(tmp_path / "in"))
    assert [tuple(r) for r in files.read_band_blocks(spark, str(tmp_path / "in")).collect()] == [row]
    files.write_mask_blocks(blocks, str(tmp_path / "mask"))
    assert (tmp_path / "mask" / "tile_id=t").is_dir()
    assert [r.data for r in spark.read.parquet(str(tmp_path / "mask")).collect()] == [[0.0, 2.0]]
    mosaic = spark.createDataFrame([("b02", 3, 4, [1, 0])], "band string, by int, bx int, data array<int>")
    files.write_mosaic(mosaic, str(tmp_path / "m"))
    assert (tmp_path / "m" / "band=b02" / "by=3").is_dir()
    assert [(r.band, r.by, r.bx, r.data) for r in spark.read.parquet(str(tmp_path / "m")).collect()] == [("b02", 3, 4, [1, 0])]


def test_folder_listing(spark, tmp_path):
    product = "S2A_MSIL1C_20250601T081531_N0511_R121_T40VEP_20250601T102233.SAFE"
    for name, size in ((f"tiles/40/V/EP/{product}/GRANULE/a.jp2", 3), (f"tiles/40/V/EP/{product}/b.xml", 1), (f"tiles/40/V/EP/{product}/empty.xml", 0), ("other/c.jp2", 5)):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * size)
    rows = {(r.path.split("/")[-1], r.size, r.name, r.tile_id) for r in files.read_folder(spark, str(tmp_path)).collect()}
    assert rows == {("a.jp2", 3, product, "40VEP"), ("b.xml", 1, product, "40VEP"), ("c.jp2", 5, None, None)}
    assert files.read_folder(spark, str(tmp_path), "*.jp2").count() == 2
