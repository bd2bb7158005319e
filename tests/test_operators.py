import json
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from scenewatch.functions.geo import wgs84_to_utm
from scenewatch.operators import components as c
from scenewatch.operators import areas, mosaic, outlines, pathology, planning, raster, scoring, selection, vector
from scenewatch.operators.graph import connected
from scenewatch.streaming import catalog as stream


def scenes(spark, rows):
    """Rows of (tile, time, cloud, name)."""
    df = spark.createDataFrame([(t, datetime.fromisoformat(at), float(cl), n) for t, at, cl, n in rows], "tile_id string, captured_at timestamp, cloud double, safe_name string")
    return df.withColumns({"date": F.to_date("captured_at"), "scene_id": F.col("safe_name"), "img_data_path": F.concat(F.lit("/"), "safe_name"), "nodata_pct": F.lit(0.0)})


def test_ties_go_to_the_latest_or_the_earliest(spark):
    rows = scenes(spark, [("a", "2024-01-01", 5, "x"), ("a", "2024-01-02", 5, "y"), ("a", "2024-01-03", 9, "z")])
    assert [r.safe_name for r in selection.best_scene_per_tile(rows, "latest").collect()] == ["y"]
    assert [r.safe_name for r in selection.best_scene_per_tile(rows, "earliest").collect()] == ["x"]
    with pytest.raises(ValueError):
        selection.best_scene_per_tile(rows, "any")


@pytest.mark.parametrize(("clouds", "want"), [([0, 0.5], 1), ([1], 1), ([1.01], 2), ([100], 100), ([100.5], None), ([40, 39.5, 41], 40)])
def test_adaptive_limit_equals_the_loop(spark, clouds, want):
    rows = scenes(spark, [("a", f"2024-01-{i + 1:02d}", cl, f"s{i}") for i, cl in enumerate(clouds)])
    got = selection.mosaic_selection(rows).collect()
    limit = next((n for n in range(1, 101) if any(cl <= n for cl in clouds)), None)
    assert limit == want
    if limit is None:
        assert got == []
    else:
        last = max(i for i, cl in enumerate(clouds) if cl <= limit)
        assert [(r.cloud_limit, r.safe_name) for r in got] == [(limit, f"s{last}")]


def test_scene_without_a_date_fails(spark):
    rows = scenes(spark, [("a", "2024-01-01", 5, "x")]).withColumn("date", F.lit(None).cast("date"))
    with pytest.raises(PySparkException):
        selection.filter_scenes(rows, "2024-01-01", "2024-01-02", 50).collect()


def test_pairs_need_a_strictly_earlier_base(spark):
    new = scenes(spark, [("a", "2024-02-01T10:00", 1, "n1"), ("b", "2024-01-01T10:00", 1, "n2"), ("c", "2024-01-01", 1, "n3")])
    base = scenes(spark, [("a", "2024-02-01T10:00", 1, "same"), ("a", "2024-01-05", 1, "old2"), ("a", "2024-01-05", 1, "old1"), ("b", "2024-03-01", 1, "late"), ("b", "2024-02-01", 1, "mid")])
    assert {r.new_key: r.base_key for r in planning.pair_scenes(new, base).collect()} == {"n1": "old1", "n2": "late", "n3": None}


def test_boxes_that_touch_count_once(spark):
    box = "min_x double, min_y double, max_x double, max_y double"
    areas = spark.createDataFrame([(1, 0.0, 0.0, 2.5, 2.5), (2, 10.0, 10.0, 11.0, 11.0)], f"aoi int, {box}")
    rows = spark.createDataFrame([("in", 0.5, 0.5, 1.5, 1.5), ("touch", 2.5, 2.5, 4.0, 4.0), ("out", 2.6, 0.0, 3.0, 1.0)], f"name string, {box}")
    assert sorted((r.aoi, r["name"]) for r in planning.scenes_in_boxes(rows, areas).collect()) == [(1, "in"), (1, "touch")]


def scalar_threshold(values):
    """The recipe with plain loops over the values."""
    values = sorted(values)
    low, high = values[0], values[-1]
    if low == high:
        return low
    w = (high - low) / 100
    count = [0] * 100
    for v in values:
        count[min(int((v - low) / w), 99)] += 1
    d = [k / (len(values) * w) for k in count]
    m = list(d)
    for i in range(1, 99):
        prom = d[i] - min(d[max(0, i - 4) : i + 5])
        if d[i] > d[i - 1] and d[i] > d[i + 1] and prom > 10:
            m[i] = max(0.0, d[i] - prom)
    tops = [i for i in range(15, 85) if all(m[i] > m[j] for j in range(i - 15, i + 16) if j != i)]
    mode = low + (max(tops, key=lambda i: (m[i], -i)) if tops else d.index(max(d))) * w
    edge = low + next((i for i, v in enumerate(d) if v > 0.1), 0) * w
    out = mode - 0.75 * (mode - edge)
    forest = [v for v in values if 0.3 <= v <= 1.5]
    return -1.0 if forest and out > forest[len(forest) * 75 // 100] else out


def test_thresholds_equal_loops(spark):
    rng = np.random.default_rng(3)
    tiles = {"two": np.concatenate([rng.normal(0.9, 0.05, 700), rng.normal(1.6, 0.3, 300)]), "spike": np.concatenate([rng.normal(1, 0.1, 500), np.full(400, 1.05)]), "high": np.concatenate([rng.uniform(0.4, 0.6, 200), rng.normal(4, 0.2, 900)]), "few": rng.uniform(0.5, 1, 7), "flat": np.full(5, 0.7), "none": np.array([np.nan] * 3), "far": rng.uniform(2, 3, 150)}
    data = [(t, i, 0, None if np.isnan(v) else float(np.float32(v))) for t, vs in tiles.items() for i, v in enumerate(vs)]
    px = spark.createDataFrame(data, "tile_id string, y int, x int, vog1 float")
    got = {r.tile_id: r.threshold for r in pathology.thresholds(px).collect()}
    for t, vs in tiles.items():
        want = 0.5 if np.isnan(vs).all() else scalar_threshold([float(np.float32(v)) for v in vs])
        assert got[t] == pytest.approx(np.float32(want), abs=1e-6), t


@pytest.mark.parametrize("first_bins", [False, True])
def test_clouds_do_not_move_a_threshold(spark, first_bins):
    """Pixels without a value are in no bin; here they are most of a tile. With first_bins its peak is none of argrelmax."""
    rng = np.random.default_rng(5)
    parts = [rng.normal(0.55, 0.03, 3000), rng.uniform(0.5, 2.5, 300)] if first_bins else [rng.normal(0.9, 0.05, 3000), rng.uniform(0.4, 1.6, 300)]
    values = [float(np.float32(v)) for v in np.concatenate(parts)]
    rows = [("clear", i, 0, v) for i, v in enumerate(values)] + [("cloudy", i, 0, v) for i, v in enumerate(values)] + [("cloudy", i, 1, None) for i in range(30000)]
    px = spark.createDataFrame(rows, "tile_id string, y int, x int, vog1 float")
    got = {r.tile_id: r for r in pathology.tile_statistics(px).collect()}
    assert got["clear"].threshold == got["cloudy"].threshold == pytest.approx(np.float32(scalar_threshold(values)), abs=1e-6)
    assert (got["cloudy"].threshold < 0) == first_bins and got["cloudy"].n_below == got["clear"].n_below > 0
    bins = pathology.histogram(px, pathology.ranges(px))
    assert {r.tile_id: r.n for r in bins.groupBy("tile_id").agg(F.sum("count").alias("n")).collect()} == {"clear": len(values), "cloudy": len(values)}
    usable = spark.createDataFrame([("cloudy", 0.6, 3300), ("clear", 0.6, 99)], "tile_id string, threshold float, n_valid long")
    sick = pathology.sick_pixels(px, usable)
    assert sick.count() == 33300 and sick.where("sick").count() == sum(v < np.float32(0.6) for v in map(np.float32, values))


def test_outside_the_base_grid(spark):
    new = spark.createDataFrame([("a", 0, 0, True), ("a", 0, 1, True), ("a", 0, 2, True)], "tile_id string, y int, x int, sick boolean")
    base = spark.createDataFrame([("a", 0, 0, False), ("a", 0, 1, True)], "tile_id string, y int, x int, sick boolean")
    got = lambda **k: {r.x: r.newly_sick for r in pathology.mask_diff(new, base, **k).collect()}
    assert got() == {0: True, 1: False, 2: False}
    assert got(outside="unknown") == {0: True, 1: False, 2: True}


def grid(spark, a, tile="t"):
    return spark.createDataFrame([(tile, y, x, float(a[y, x])) for y in range(a.shape[0]) for x in range(a.shape[1])], "tile_id string, y int, x int, v float")


@pytest.mark.parametrize(("src", "ref"), [((4, 5), (8, 10)), ((6, 4), (3, 2)), ((3, 3), (5, 7)), ((2, 2), (2, 2))])
def test_bilinear_equals_loops(spark, src, ref):
    rng = np.random.default_rng(sum(src))
    a = rng.uniform(1, 9, src).astype(np.float32)
    a[0, 1] = 0
    want = np.zeros(ref, np.float32)
    for y in range(ref[0]):
        for x in range(ref[1]):
            if src == ref:
                want[y, x] = a[y, x]
                continue
            sy, sx = (y + 0.5) * src[0] / ref[0] - 0.5, (x + 0.5) * src[1] / ref[1] - 0.5
            y0, x0 = int(np.floor(sy)), int(np.floor(sx))
            fy, fx = np.float32(sy - y0), np.float32(sx - x0)
            ys, xs = (max(y0, 0), min(y0 + 1, src[0] - 1)), (max(x0, 0), min(x0 + 1, src[1] - 1))
            four = a[np.ix_(ys, xs)]
            if (four == 0).any():
                continue
            want[y, x] = (four[0, 0] * (1 - fx) + four[0, 1] * fx) * (1 - fy) + (four[1, 0] * (1 - fx) + four[1, 1] * fx) * fy
    got = np.zeros(ref, np.float32)
    for r in raster.resample_bilinear(grid(spark, a), src, ref).collect():
        got[r.y, r.x] = r.v
    assert np.allclose(got, want, atol=1e-5)


def test_align_needs_one_pixel_size(spark):
    rows = grid(spark, np.ones((2, 2), np.float32)).withColumn("valid", F.lit(True))
    frame = lambda px, x0: spark.createDataFrame([("t", [x0, px, 0.0, 0.0, 0.0, -px], 2, 2)], "tile_id string, gt array<double>, h int, w int")
    for other in (frame(20.0, 0.0), frame(10.0, 500.0)):
        with pytest.raises(PySparkException):
            raster.align_pairs(rows, rows, frame(10.0, 0.0), other, ["v"]).collect()


def test_block_math(spark):
    rows = spark.createDataFrame([("s", 0, 0, "b05", [1.0, 2.0]), ("s", 0, 0, "b06", [2.0, 8.0])], "scene_id string, by int, bx int, band string, data array<double>")
    assert [r.data for r in raster.block_math(rows, ["scene_id", "by", "bx"], lambda a, b: a / b, "b05", "b06").collect()] == [[0.5, 0.25]]


@pytest.mark.parametrize(("tile", "bound", "size"), [(6, 1, (11, 9)), (5, 0, (5, 7)), (8, 2, (3, 20))])
def test_binary_windows_equal_loops(spark, tile, bound, size):
    rng = np.random.default_rng(tile)
    a = rng.uniform(0, 1, size).astype(np.float32)
    ok = rng.uniform(0, 1, size) > 0.2

    def model(w):
        """Depends on the place in the window and on its mean: context and ownership matter."""
        place = np.arange(tile, dtype=np.float32)
        return w + w.mean(axis=(2, 3), keepdims=True) + 0.01 * place[None, None, :, None] - 0.02 * place[None, None, None, :]

    want, step = np.zeros(size, int), tile - 2 * bound
    for y0 in range(0, size[0], step):
        for x0 in range(0, size[1], step):
            w = np.full((1, 1, tile, tile), 0.5, np.float32)
            h, k = min(tile, size[0] - y0), min(tile, size[1] - x0)
            w[0, 0, :h, :k] = np.where(ok[y0 : y0 + h, x0 : x0 + k], a[y0 : y0 + h, x0 : x0 + k], 0.5)
            p = model(w)[0, 0]
            ya, xa = (0 if y0 == 0 else bound), (0 if x0 == 0 else bound)
            yb, xb = (size[0] - y0 if y0 + tile >= size[0] else tile - bound), (size[1] - x0 if x0 + tile >= size[1] else tile - bound)
            for y in range(ya, yb):
                for x in range(xa, xb):
                    want[y0 + y, x0 + x] = int(ok[y0 + y, x0 + x] and p[y, x] > np.float32(1.0))
    rows = spark.createDataFrame([("t", y, x, float(a[y, x]), bool(ok[y, x])) for y in range(size[0]) for x in range(size[1])], "tile_id string, y int, x int, v float, valid boolean")
    scored = scoring.score_windows(scoring.make_windows(rows, tile, bound), model, ["v"], tile, [0.5])
    got = np.zeros(size, int)
    for r in scoring.stitch_binary(scored, tile, bound, 1.0).collect():
        got[r.y, r.x] = r.v
    assert (got == want).all()


def test_detections_of_class_zero(spark):
    rows = spark.createDataFrame([(0,), (1,), (2,)], "k int")
    pick = lambda **o: [r[0] for r in rows.select(scoring.detection_classes(F.col("k"), **o)).collect()]
    assert pick() == [False, True, True]
    assert pick(classes=[0, 2]) == [False, False, True]
    assert pick(classes=[0, 2], strict_dn=False) == [True, False, True]


def flood(a, conn):
    label, out = {}, np.zeros(a.shape, int)
    for y in range(a.shape[0]):
        for x in range(a.shape[1]):
            if a[y, x] and not out[y, x]:
                name = y * c.ROW + x + 1
                stack, out[y, x] = [(y, x)], name
                while stack:
                    i, j = stack.pop()
                    for di in (-1, 0, 1):
                        for dj in (-1, 0, 1):
                            u, v = i + di, j + dj
                            if (conn == 8 or abs(di) + abs(dj) == 1) and 0 <= u < a.shape[0] and 0 <= v < a.shape[1] and not out[u, v] and a[u, v] == a[i, j]:
                                out[u, v] = name
                                stack.append((u, v))
    return out


@pytest.mark.parametrize(("conn", "block"), [(4, 4), (8, 4), (8, 7), (4, 100)])
def test_components_do_not_depend_on_blocks(spark, conn, block):
    a = np.random.default_rng(5).integers(0, 3, (17, 15))
    a[:, 7] = 1
    want = flood(a, conn)
    got = np.zeros(a.shape, int)
    for r in c.label_components(grid(spark, a), conn, block).collect():
        got[r.y, r.x] = r.component + 1
    assert (got == want).all()


def test_sieve(spark):
    a = np.zeros((6, 6), int)
    a[1, 1], a[3:6, 3:6], a[4, 4] = 1, 2, 5
    got = np.zeros(a.shape, int)
    for r in c.sieve(grid(spark, a), 4, block=3).collect():
        got[r.y, r.x] = r.v
    want = np.zeros((6, 6), int)
    want[3:6, 3:6] = 2
    assert (got == want).all()


@pytest.mark.parametrize("seed", range(3))
def test_no_small_region_remains(spark, seed):
    """Chains of small regions, stripes and noise: whatever touches another region is large in the end."""
    rng = np.random.default_rng(seed)
    a = np.kron(rng.integers(0, 4, (3, 4)), np.ones((4, 3), int))
    noise = rng.random(a.shape) < 0.4
    a = np.where(noise, rng.integers(0, 9, a.shape), a)
    got = np.zeros(a.shape, int)
    for r in c.sieve(grid(spark, a), 6, block=5).collect():
        got[r.y, r.x] = r.v
    label = flood(got + 1, 8)
    sizes = np.unique(label, return_counts=True)[1]
    assert len(sizes) == 1 or sizes.min() >= 6
    stripes = np.arange(6)[None, :]  # a chain of single cells: all merge, though none is large
    assert len({r.v for r in c.sieve(grid(spark, stripes), 6, block=4).collect()}) == 1
    far = np.array([[1, 1, 1, 1, 2, 3, 4, 4, 4, 4, 4]])  # both ends are large: each small one goes to the largest it touches
    assert [r.v for r in sorted(c.sieve(grid(spark, far), 4, block=4).collect(), key=lambda r: r.x)] == [1, 1, 1, 1, 1, 4, 4, 4, 4, 4, 4]


def test_connected_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (5, 5)], "a long, b long")
    assert {r.node: r.root for r in connected(links).collect()} == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}


def trace(cells: set[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """Closed rings (x, y) around cells, outer ones with positive area, holes with negative; corners only.

    Edges run with their cell on one side; where two cells touch only at a corner the ring turns so as to keep them
    apart, as 4-connected regions do.
    """
    after: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for y, x in cells:
        for gone, a, b in (((y - 1, x), (x, y), (x + 1, y)), ((y, x + 1), (x + 1, y), (x + 1, y + 1)), ((y + 1, x), (x + 1, y + 1), (x, y + 1)), ((y, x - 1), (x, y + 1), (x, y))):
            if gone not in cells:
                after.setdefault(a, []).append(b)
    rings = []
    for start in sorted(after):
        while after.get(start):
            ring, at, to = [start], start, after[start].pop()
            while to != start:
                ring.append(to)
                ways = after[to]
                dx, dy = to[0] - at[0], to[1] - at[1]
                # the turn towards the cell's own side first
                way = next((w for w in ways if (w[0] - to[0], w[1] - to[1]) == (-dy, dx)), ways[0])
                ways.remove(way)
                at, to = to, way
            n = len(ring)
            rings.append([p for i, p in enumerate(ring) if (ring[i - 1][0] == p[0]) != (p[0] == ring[(i + 1) % n][0])])
    return rings


def ring_area(ring: list[tuple[float, float]]) -> float:
    xs, ys = np.array([p[0] for p in ring], float), np.array([p[1] for p in ring], float)
    return float((xs * np.roll(ys, -1) - np.roll(xs, -1) * ys).sum() / 2)


@pytest.mark.parametrize(("block", "share"), [(4, 0.6), (5, 0.5), (7, 0.85), (64, 0.6)])
def test_outlines_equal_a_walk(spark, block, share):
    """Rings by ranked chains are those of a walk around all cells of a region, whatever the blocks."""
    rng = np.random.default_rng(block)
    a = (rng.random((33, 29)) < share).astype(int)
    a[10:30, 3] = a[10:30, 25] = a[10, 3:26] = a[29, 3:26] = 1  # a ring through many blocks
    labels = flood(a, 4)
    rows = [("t", int(y), int(x), 3, int(labels[y, x])) for y, x in zip(*np.nonzero(a))]
    table = spark.createDataFrame(rows, "tile_id string, y int, x int, v int, component long").repartition(3)
    gt = [100.0, 10.0, 0.0, 50.0, 0.0, -5.0]
    got = {r.component: r for r in vector.polygonize(table, gt, block).collect()}
    assert set(got) == set(labels[a > 0].tolist())
    for k, r in got.items():
        cells = set(zip(*(w.tolist() for w in np.nonzero(labels == k))))
        want = sorted(trace(cells), key=lambda ring: (-ring_area(ring), ring))
        assert [[(int((x - 100) / 10), int((y - 50) / -5)) for x, y in ring] for ring in r.rings] == [[*ring, ring[0]] for ring in want]
        assert (r.dn, r.area, r.tile_id) == (3, len(cells) * 50.0, "t")
    assert vector.polygonize(table.where("false")).isEmpty()


@pytest.mark.parametrize("block", [5, 64])
def test_neighbours_share_their_thinned_border(spark, block):
    """Every edge inside is run through once each way, islands and crossings included; fewer points than before."""
    rng = np.random.default_rng(9)
    y, x = np.mgrid[:40, :44]
    a = (np.hypot(y - 12 + rng.integers(-1, 2, y.shape), x - 14) < 10).astype(int) + 2 * (x + rng.integers(0, 3, y.shape) > 27) + 4 * (y > 30)
    a[20:26, 30:36] = 9
    labels = flood(a + 1, 4)
    cells = spark.createDataFrame(pd.DataFrame({"tile_id": "t", "y": y.ravel(), "x": x.ravel(), "v": a.ravel() + 1, "component": labels.ravel()}))
    plain, thin = (vector.polygonize(cells, None, block, k).collect() for k in (0.0, 1.5))
    sides = lambda rows: [(tuple(p), tuple(q)) for r in rows for ring in r.rings for p, q in zip(ring, ring[1:])]
    found = sides(thin)
    inner = [(p, q) for p, q in found if not any(p[k] == q[k] in (0, (44, 40)[k]) for k in (0, 1))]
    assert len(set(found)) == len(found) and all((q, p) in set(found) for p, q in inner)
    assert len(found) < 0.8 * len(sides(plain)) and {r.component: r.area for r in thin} == {r.component: r.area for r in plain}
    assert all(ring[0] == ring[-1] and len(ring) >= 4 for r in thin for ring in r.rings)


def test_a_ring_of_many_chains_settles_in_log_rounds(spark):
    """A serpentine through 300 blocks: each block passes on chains, never the region."""
    y, x = np.divmod(np.arange(60 * 60), 60)
    on = (y % 2 == 0) | (x == np.where(y % 4 == 1, 59, 0))
    table = spark.createDataFrame(pd.DataFrame({"tile_id": 1, "y": y[on], "x": x[on], "v": 1, "component": 0}))
    parts = outlines.chains(table, 3)
    assert parts.agg(F.max(F.size("xs"))).first()[0] <= 12
    (row,) = vector.polygonize(table, block=3).collect()
    assert row.area == on.sum() and [[tuple(map(int, p)) for p in ring[:-1]] for ring in row.rings] == trace(set(zip(y[on].tolist(), x[on].tolist())))


def test_polygonize_hole_and_diagonal(spark):
    a = np.ones((5, 5), int)
    a[2, 2] = 0
    a[0, 3], a[1, 4], a[0, 4] = 0, 0, 1
    rows = {r.component: r for r in vector.polygonize(c.label_components(grid(spark, a), 4)).collect()}
    assert len(rows) == 2
    big = rows[0]
    areas = [ring_area([tuple(p) for p in ring[:-1]]) for ring in big.rings]
    assert areas[0] > 0 and areas[1:] == [-1] and sum(areas) == big.area == (a == 1).sum() - 1


def test_random_polygons_have_the_area_of_their_cells(spark):
    a = np.random.default_rng(8).integers(0, 2, (14, 14))
    for r in vector.polygonize(c.label_components(grid(spark, a), 4, 5), [100.0, 10.0, 0.0, 50.0, 0.0, -10.0]).collect():
        rings = [ring_area([tuple(p) for p in ring[:-1]]) for ring in r.rings]
        assert abs(sum(rings)) == pytest.approx(r.area)
        assert all(ring[0] == ring[-1] for ring in r.rings)


def ring(*points):
    return [{"x": float(x), "y": float(y)} for x, y in points]


def test_cells_of_areas(spark):
    outer, hole = ring((0, 0), (10, 0), (10, 100), (0, 100), (0, 0)), ring((2, 2), (6, 2), (6, 50), (2, 50), (2, 2))
    rows = spark.createDataFrame([("a", 0, 0, outer), ("a", 0, 1, hole), ("b", 0, 0, ring((20, 0), (30, 0), (20, 10), (20, 0)))], "aoi_id string, poly int, ring int, points array<struct<x:double,y:double>>")
    got = vector.rings_in_cells(rows, 0.0, 0.0, 1.0).groupBy("aoi_id").count().collect()
    assert {r.aoi_id: r["count"] for r in got} == {"a": 1000 - 4 * 48, "b": 45}
    a, b = (vector.rings_in_cells(rows.where(f"aoi_id = '{k}'"), 0.0, 0.0, 1.0) for k in "ab")
    assert vector.aoi_cells(a, [a], [a.where("y >= 50")]).count() == 500 - 4 * 48
    assert vector.aoi_cells(a, [b]).count() == 0
    near = spark.createDataFrame([("a", "hole", 3.0, 3.0, 5.0, 40.0), ("a", "edge", 5.0, 40.0, 7.0, 41.0), ("a", "over", -5.0, -5.0, 500.0, 500.0)], "aoi_id string, name string, min_x double, min_y double, max_x double, max_y double")
    assert sorted(r["name"] for r in vector.scenes_in_aoi(near, rows).collect()) == ["edge", "over"]


def test_simplify_keeps_corners():
    line = np.array([(0, 0), (5, 0.01), (10, 0), (10, 10), (0, 10), (0, 0)], float)
    assert len(vector.simplify_ring(line, 0.5)) == 5
    assert len(vector.simplify_ring(line, 0.001)) == 6
    assert len(vector.simplify_ring(np.array([(0, 0), (1, 0), (1, 1), (0, 0)], float), 50)) == 4


def test_warp_finds_the_source_pixel(spark):
    """A smooth surface in a UTM tile is read at the right places of the Mercator grid."""
    e, n = (spark.range(1).select(*wgs84_to_utm(F.lit(56.2), F.lit(58.0), F.lit(40))).first()[i] for i in (0, 1))
    h = w = 20
    gt = [round(e, -2), 10.0, 0.0, round(n, -2), 0.0, -10.0]
    surface = lambda x, y: 1000 + 3 * x + 7 * y
    rows = spark.createDataFrame([("t", "b", y, x, float(surface(x, y))) for y in range(h) for x in range(w)], "tile_id string, band string, y int, x int, v double")
    grids = spark.createDataFrame([("t", 40, gt, h, w)], "tile_id string, zone int, gt array<double>, h int, w int")
    got = mosaic.warp(rows, grids, 20.0).collect()
    from scenewatch.functions.geo import mercator_to_lonlat

    cells = spark.createDataFrame([(r.tx, r.ty, r.v) for r in got], "tx long, ty long, v double")
    lon, lat = mercator_to_lonlat((F.col("tx") + 0.5) * 20.0, (F.col("ty") + 0.5) * 20.0)
    ee, nn = wgs84_to_utm(lon, lat, F.lit(40))
    for r in cells.select("v", ((ee - gt[0]) / 10 - 0.5).alias("x"), ((nn - gt[3]) / -10 - 0.5).alias("y")).collect():
        assert r.v == pytest.approx(surface(r.x, r.y), abs=1e-6)
    assert len(got) > 20


def test_rgb_blocks(spark):
    rows = spark.createDataFrame([("r", 0, 1, 5), ("r", 1, 0, 7), ("r", 2, 3, 9)], "band string, ty long, tx long, v int")
    got = {(r.by, r.bx): r.data for r in mosaic.rgb_blocks(rows, 2).collect()}
    assert got == {(0, 0): [0, 5, 7, 0], (1, 1): [0, 9, 0, 0]}


def drop(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps({"tile_id": t, "captured_at": at, "date": at[:10], "scene_id": s, "safe_name": s, "img_data_path": "/" + s, "cloud": cl}) for t, at, s, cl in rows))


def test_streams(spark, tmp_path):
    src, table = tmp_path / "in", str(tmp_path / "best")
    run = lambda: stream.stream_best_scene(stream.stream_catalog(spark, str(src)), table, str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    drop(src, "1.json", [("a", "2024-03-01T00:00:00Z", "s1", 50.0), ("a", "2024-03-02T00:00:00Z", "s2", 40.0), ("b", "2024-03-02T00:00:00Z", "s3", 10.0), ("a", "2024-03-01T00:00:00Z", "s1", 1.0)])
    run()
    first = {r.tile_id: r.cloud for r in stream.best_scenes(spark, table).collect()}
    assert first["b"] == 10.0 and first["a"] in (1.0, 40.0)
    drop(src, "2.json", [("b", "2024-04-20T00:00:00Z", "s9", 5.0)])
    run()
    drop(src, "3.json", [("a", "2024-01-01T00:00:00Z", "late", 0.0), ("a", "2024-04-20T00:00:00Z", "s10", 0.5)])
    run()
    assert {r.tile_id: (r.scene_id, r.cloud) for r in stream.best_scenes(spark, table).collect()} == {"a": ("s10", 0.5), "b": ("s9", 5.0)}
    with pytest.raises(ValueError):
        stream.best_scenes(spark, str(tmp_path / "nothing"))


def test_stream_jobs(spark, tmp_path):
    rows = scenes(spark, [("a", "2024-03-02", 5, "x")])
    queue = tmp_path / "q"
    queue.mkdir()
    (queue / "1.json").write_text('{"job_id": 1, "start": "2024-03-01", "end": "2024-03-03", "cloud": 10, "time": "t"}\n{"job_id": 2, "start": "2023-03-01", "end": "2023-03-03", "cloud": 10, "time": "t"}')
    jobs = spark.readStream.schema("job_id INT, start DATE, end DATE, cloud INT, time STRING").json(str(queue))
    stream.stream_jobs(jobs, rows, str(tmp_path / "p"), str(tmp_path / "r"), str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert [r.job_id for r in spark.read.parquet(str(tmp_path / "r")).collect()] == [1]
    assert [(r.job_id, r.scene_id) for r in spark.read.parquet(str(tmp_path / "p")).collect()] == [(1, "x")]


def test_interval_pick_equals_all_pairs(spark):
    """Every slice against every scene, by loops."""
    rng, at0 = np.random.default_rng(3), datetime(2024, 1, 1)
    rows = [(f"t{rng.integers(3)}", at0 + timedelta(minutes=int(m)), float(rng.integers(3)), f"s{k}") for k, m in enumerate(rng.choice([0, 700, 1440, 5000, 9000, 14399, 14400, 20000, 31000], 25))]
    df = spark.createDataFrame(rows, "tile_id string, captured_at timestamp, cloud double, safe_name string").withColumns({"scene_id": F.col("safe_name"), "img_data_path": F.col("safe_name"), "date": F.to_date("captured_at")})
    n, start, end = 6, datetime(2024, 1, 2), datetime(2024, 1, 11)
    got = {(r.tile_id, r.i): r.safe_name for r in planning.interval_pick(df, n, F.lit("2024-01-02").cast("date"), F.lit("2024-01-11").cast("date")).collect()}
    step = (end + timedelta(days=1) - start) / n
    want = {}
    for t in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == t]
        for i in range(n):
            a, z = start + i * step, start + (i + 1) * step
            inside = sorted((r[2], -(r[1] - at0).total_seconds(), r[3]) for r in own if a <= r[1] < z)
            near = sorted((abs((r[1] - (a + (z - a) / 2)).total_seconds()), r[2], r[1], r[3]) for r in own)
            want[t, i] = inside[0][-1] if inside else near[0][-1]
    assert got == want


def test_pairs_equal_all_pairs(spark):
    rng, at0 = np.random.default_rng(4), datetime(2024, 1, 1)
    rows = [(f"t{rng.integers(4)}", at0 + timedelta(days=int(d)), f"s{k:03d}") for k, d in enumerate(rng.integers(0, 60, 80))]
    df = spark.createDataFrame(rows, "tile_id string, captured_at timestamp, safe_name string").withColumns({"scene_id": F.col("safe_name"), "img_data_path": F.col("safe_name"), "date": F.to_date("captured_at")})
    new, base = rows[:40], rows[40:70]
    got = {r.new_key: r.base_key for r in planning.pair_scenes(df.where("safe_name < 's040'"), df.where("safe_name >= 's040' and safe_name < 's070'")).collect()}
    for t, at, name in new:
        own = [(b[1], b[2]) for b in base if b[0] == t]
        pool = [b for b in own if b[0] < at] or own
        last = max((b[0] for b in pool), default=None)
        assert got[name] == min((b[1] for b in pool if b[0] == last), default=None)


def test_busy_days_are_parted(spark):
    rows = scenes(spark, [("a", f"2024-01-{1 + k % 20:02d}", k % 90, f"s{k}") for k in range(60)])
    jobs = spark.createDataFrame([(1, "2024-01-03", "2024-01-12", 40), (2, "2024-01-01", "2024-01-20", 100)], "job_id int, start string, end string, cloud int").select("job_id", F.to_date("start").alias("start"), F.to_date("end").alias("end"), "cloud")
    few, many = (sorted((r.job_id, r.safe_name) for r in planning.plan_jobs(jobs, rows, most=m).collect()) for m in (3, 1000))
    assert few == many and len([x for x in few if x[0] == 2]) == 60


@pytest.mark.parametrize(("sent", "most"), [(100, 100), (0, 3), (0, 1000)])
def test_plans_equal_all_pairs(spark, sent, most):
    """Periods of one day to three years, some the wrong way round or open; the join makes no pair outside a period."""
    rng = np.random.default_rng(11)
    day = lambda n: (datetime(2023, 1, 1) + timedelta(days=int(n))).strftime("%Y-%m-%d")
    rows = scenes(spark, [("a", day(n), int(c), f"s{k}") for k, (n, c) in enumerate(zip(rng.integers(0, 1200, 300), rng.integers(0, 100, 300)))])
    raw = [(k, day(a), day(a + n), int(c)) for k, (a, n, c) in enumerate(zip(rng.integers(0, 800, 40), [0, 1, 6, 7, 8, 9, 15, 16, 63, 64, 65, 511, 513, 1100, -3] * 3, rng.integers(0, 101, 40)))] + [(99, None, "2024-01-01", 100)]
    jobs = spark.createDataFrame(raw, "job_id int, start string, end string, cloud int").select("job_id", F.to_date("start").alias("start"), F.to_date("end").alias("end"), "cloud")
    got = sorted((r.job_id, r.safe_name) for r in planning.plan_jobs(jobs, rows, most=most, sent=sent).collect())
    every = rows.select(F.col("date").cast("string"), "cloud", "safe_name").collect()
    assert got == sorted((j, s.safe_name) for j, a, z, c in raw for s in every if a and a <= s.date <= z and s.cloud <= c)
    nodes = jobs.where("start <= end").select("job_id", F.datediff("end", "start").alias("n"), F.explode(planning.day_nodes(F.col("start"), F.col("end"), 4)).alias("d"))
    covered = nodes.groupBy("job_id", "n").agg(F.sum(F.pow(F.lit(8), F.col("d.level"))).alias("days"), F.count("*").alias("k")).collect()
    assert all(r.days == r.n + 1 and r.k <= 14 * 4 for r in covered) and len(covered) == 36 + 2


def test_jobs_alike_are_joined_as_bundles(spark):
    """What the join itself gives grows with distinct requests, not with jobs; jobs are told apart after it, repeated rows too."""
    rows = scenes(spark, [("a", f"2024-01-{1 + k % 20:02d}", k % 90, f"s{k}") for k in range(60)])
    raw = [(k % 500, f"2024-01-{3 + k % 2:02d}", "2024-01-12", 40, {"k": k}) for k in range(600)]
    jobs = spark.createDataFrame(raw, "job_id int, start string, end string, cloud int, note map<string,int>").withColumns({"start": F.to_date("start"), "end": F.to_date("end")})
    every = rows.select(F.dayofmonth("date").alias("day"), "cloud", "safe_name").collect()
    want = sorted((j, s.safe_name) for j, a, _, c, _ in raw for s in every if int(a[-2:]) <= s.day <= 12 and s.cloud <= c)
    for options in ({}, {"alike": 7}, {"sent": 0}, {"even": 10}):
        found = planning.plan_jobs(jobs, rows, **options)
        assert sorted((r.job_id, r.safe_name) for r in found.collect()) == want
        assert found.columns == ["job_id", "start", "end", "cloud_limit", "note", *rows.columns]
    assert "Generate explode" in planning.plan_jobs(jobs, rows)._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]


def test_pairs_of_jobs_and_scenes_come_in_runs(spark, tmp_path):
    """Jobs of one request come again with each scene of a chunk, so a written pair takes a fraction of a byte; with all jobs of one scene
    after another it took four, and 60 times the tables did not fit the disk. A chunk's scenes are in one task, all others too."""
    rows = scenes(spark, [("a", f"2024-01-{1 + k % 20:02d}", k * 7 % 101, f"s{k:04d}") for k in range(600)])
    raw = spark.range(40_000).selectExpr("id as job_id", "id % 10 as a", "cast(id * 7 % 101 as int) as cloud")
    jobs = raw.select("job_id", F.date_add(F.lit("2024-01-03").cast("date"), F.col("a").cast("int")).alias("start"), F.lit("2024-01-14").cast("date").alias("end"), "cloud")
    planning.plan_jobs(jobs, rows).select("job_id", F.col("safe_name").substr(2, 4).cast("long").alias("event_id")).write.parquet(f"{tmp_path}/pairs")
    found = spark.read.parquet(f"{tmp_path}/pairs")
    per = {(a, c): n for a, c, n in raw.groupBy("a", "cloud").count().collect()}
    want = sum(n for k in range(600) for (a, c), n in per.items() if 3 + a <= 1 + k % 20 <= 14 and k * 7 % 101 <= c)
    assert found.count() == found.distinct().count() == want > 2_000_000
    size = sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet"))
    assert (size - 4 * 8 * 40_000) / want < 0.5  # without each file's list of jobs


def test_many_small_windows_are_scored_in_one_call_of_a_task(spark):
    """A group is no call of its own: rows of many windows come together, a null key is a scene too, invalid pixels are the mean."""
    rng = np.random.default_rng(5)
    raw = [(t, y, x, float(rng.integers(1, 9)), bool(rng.random() < 0.7)) for t in (None, 1, 2, 3) for y in range(7) for x in range(5)]
    pixels = spark.createDataFrame(raw, "tile_id long, y int, x int, v float, valid boolean")
    found = scoring.score_windows(scoring.make_windows(pixels, 4, bound=1), lambda w: w + w.sum(axis=(2, 3), keepdims=True), ["v"], 4, [0.5], batch=3)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan and "MapInPandas" in plan
    want = []
    for t in (None, 1, 2, 3):
        own = {(y, x): v for k, y, x, v, ok in raw if k == t and ok}
        for wy, wx in {(y // 2 - a, x // 2 - b) for y in range(7) for x in range(5) for a in (0, 1) for b in (0, 1)}:
            if min(wy, wx) >= 0:
                cells = [(wy * 2 + y, wx * 2 + x) for y in range(4) for x in range(4)]
                total = sum(own.get(c, 0.5) for c in cells)
                want += [(t, wy, wx, *c, 0, own[c] + total) for c in cells if c in own]
    key = lambda r: tuple(-1 if v is None else v for v in r)
    assert sorted((tuple(r) for r in found.collect()), key=key) == sorted(want, key=key)


def test_overlay_of_bands_is_that_of_values(spark, sf_dir):
    """The same cells from a column a band, and one shuffle in the query's plan."""
    from scenewatch.jobs import grid_queries

    rng = np.random.default_rng(8)
    raw = [(t, y, x, int(rng.integers(0, 3)), int(rng.integers(0, 2))) for t in range(4) for y in range(5) for x in range(5) if rng.random() < 0.7]
    pixels = spark.createDataFrame(raw, "tile_order int, y int, x int, b02 int, b03 int")
    got = mosaic.overlay_bands(pixels, ["y", "x"], ["b02", "b03"])
    want = mosaic.overlay_last_wins(pixels.unpivot(["tile_order", "y", "x"], ["b02", "b03"], "band", "v"), ["band", "y", "x"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert grid_queries.overlay(spark, sf_dir)._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_numbered_and_catalog_order(spark):
    rows = scenes(spark, [("b", "2024-01-02", 1, "x"), ("a", "2024-01-02", 1, "z"), ("a", "2024-01-02", 1, "y"), ("c", "2024-01-01", 1, "w")])
    want = ["w", "y", "z", "x"]
    assert [r.safe_name for r in selection.sort_catalog(rows).collect()] == want
    assert [r.safe_name for r in sorted(selection.numbered(selection.sort_scenes(rows)).collect(), key=lambda r: r.nth)] == want


def test_defaults_of_scenes(spark):
    rows = spark.createDataFrame([(None, "2024-01-02", " ", "x"), ("2024-01-03 04:00:00", "2024-01-02", "id", "y")], "at string, day string, scene_id string, safe_name string")
    got = selection.scene_defaults(rows.select(F.to_timestamp("at").alias("captured_at"), F.to_date("day").alias("date"), "scene_id", "safe_name")).collect()
    assert [(r.captured_at, r.scene_id) for r in got] == [(datetime(2024, 1, 2), "x"), (datetime(2024, 1, 3, 4), "id")]


def test_newest_first(spark):
    from scenewatch.operators.job_queue import newest_first

    rows = spark.createDataFrame([("a", "2024-01-02 10:00"), ("b", "soon"), ("c", "2024-02-01 09:00")], "id string, time string")
    assert [r.id for r in newest_first(rows).collect()] == ["c", "a", "b"]


def test_reference_band_of_l2a_and_large_grids(spark):
    rows = spark.createDataFrame([(1, 0, "B02", 4, 4), (1, 1, "B05", 2, 2), (1, 2, "B03", 4, 4), (2, 0, "B02", 9, 9), (2, 1, "B01", 1, 1)], "scene_id int, nth int, band string, w int, h int")
    pick = lambda **k: {r.scene_id: r.band for r in selection.reference_band(rows, **k).collect()}
    assert pick(level="L2A", native=True) == {1: "B03", 2: "B02"}
    assert pick(level="L1C", most=10) == {1: "B05", 2: "B02"}
    assert pick(level="L1C", low_resolution=True, most=10) == {1: "B02", 2: "B01"}


def test_band_files_by_resolution(spark):
    files = ["a_B04_60m.jp2", "a_B04_20m.jp2", "b_B04_60m.jp2", "c_B04.jp2", "d_B04_10m.jp2"]
    rows = spark.createDataFrame([(1, "B04", f) for f in files[:3]] + [(2, "B04", f) for f in files[2:4]] + [(3, "B04", f) for f in files], "scene_id int, band string, path string")
    pick = lambda r: {x.scene_id: x.path for x in selection.resolve_band_file(rows, r).collect()}
    assert pick("R10m") == {1: "a_B04_20m.jp2", 2: "b_B04_60m.jp2", 3: "d_B04_10m.jp2"}
    assert pick("R60m") == {1: "a_B04_60m.jp2", 2: "b_B04_60m.jp2", 3: "a_B04_60m.jp2"}


def test_valid_in_all_cubes_and_newer_only(spark):
    a = spark.createDataFrame([(1, 0, 0, 1.0, True), (1, 0, 1, 2.0, True)], "tile_id int, y int, x int, v double, valid boolean")
    b = spark.createDataFrame([(1, 0, 0, 5.0, False), (1, 9, 9, 5.0, True)], "tile_id int, y int, x int, v double, valid boolean")
    assert [tuple(r) for r in raster.combine_valid([a, b]).collect()] == [(1, 0, 0, False)]
    assert sorted(tuple(r) for r in raster.concat_inputs(a, b, ["v"], "newer_only").collect()) == [(1, 0, 0, 5.0, False), (1, 9, 9, 5.0, True)]


def test_simplify_and_union_of_features(spark):
    ring = [[0.0, 0.0], [1.0, 0.01], [2.0, 0.0], [2.0, 2.0], [0.0, 2.0], [0.0, 0.0]]
    one = spark.createDataFrame([(1, [ring])], "dn int, rings array<array<array<double>>>")
    assert vector.simplify(one, 0.1).first().rings == [[p for p in ring if p != [1.0, 0.01]]]
    assert vector.simplify(one, 0.0).first().rings == [ring]
    both = vector.union_tiles([one, spark.createDataFrame([(2,)], "dn int")])
    assert sorted((r.dn, r.rings is None) for r in both.collect()) == [(1, False), (2, True)]


def test_bands_meet_on_the_reference_grid(spark):
    """A fine band 4 x 4 and a coarse one 2 x 2 of twice the pixel size."""
    fine = [(1, "B04", y, x, float(10 * y + x + 1)) for y in range(4) for x in range(4)]
    coarse = [(1, "B11", y, x, float(100 + 2 * y + x)) for y in range(2) for x in range(2)]
    values = spark.createDataFrame(fine + coarse, "tile_id int, band string, y int, x int, v float")
    grids = spark.createDataFrame([(1, 0, "B04", 4, 4, [0.0, 10.0, 0.0, 0.0, 0.0, -10.0]), (1, 1, "B11", 2, 2, [0.0, 20.0, 0.0, 0.0, 0.0, -20.0])], "tile_id int, nth int, band string, w int, h int, gt array<double>")
    got = {(r.y, r.x): (r.b04, r.b11) for r in raster.on_reference_grid(values, grids, native=True).collect()}
    at = lambda p: int((p + 0.5) / 2 - 0.5 + 0.5)
    assert got == {(y, x): (10.0 * y + x + 1, 100.0 + 2 * at(y) + at(x)) for y in range(4) for x in range(4)}


def test_mosaic_from_tiles(spark):
    """Two tiles over one place: the later one lies above; every block is full."""
    px = [(t, "b02", y, x, 1000.0 + 500 * t + y) for t in (1, 2) for y in range(30) for x in range(30)]
    values = spark.createDataFrame(px, "tile_id int, band string, y int, x int, v double")
    east, north = 500000.0, 6300000.0
    grids = spark.createDataFrame([(t, 40, [east, 20.0, 0.0, north, 0.0, -20.0], 30, 30) for t in (1, 2)], "tile_id int, zone int, gt array<double>, h int, w int")
    order = spark.createDataFrame([(1, 0), (2, 1)], "tile_id int, tile_order int")
    blocks = mosaic.build_mosaic(values, grids, order, pixel=40.0, block=16, stride=1).collect()
    assert blocks and all(len(r.data) == 256 for r in blocks)
    scale = mosaic.global_scale(mosaic.band_stats(values, 1)).first()
    seen = [v for r in blocks for v in r.data if v]
    low, high = (min(255, max(1, int((v - scale.src_min) / (scale.src_max - scale.src_min) * 254 + 1.5))) for v in (2000.0, 2029.0))
    assert seen and min(seen) >= low and max(seen) <= high


def test_single_period(spark):
    """From a catalog of two scenes a tile to polygons: the clearer scene is scored, a bright square is found."""
    from scenewatch.operators.runs import single_period

    catalog = scenes(spark, [(t, f"2024-01-{d:02d}", cl, f"{t}{d}") for t in "ab" for d, cl in ((1, 50), (2, 5))] + [("a", "2024-03-01", 0, "late")])
    bands = {"b02": 0, "b03": 0, "b08": 3000, "b10": 0, "b11": 2000, "b12": 2000}
    rows = [(t, f"{t}{d}", y, x, 9000.0 if d == 2 and 3 <= y < 6 and 4 <= x < 8 else 100.0) for t in "ab" for d in (1, 2) for y in range(12) for x in range(12)]
    pixels = spark.createDataFrame(rows, "tile_id string, scene_id string, y int, x int, b04 float").withColumns({"date": F.lit("2021-01-01").cast("date"), **{b: F.lit(float(v)).cast("float") for b, v in bands.items()}})
    found = single_period(catalog, pixels, "2024-01-01", "2024-01-31", 60.0, ["B04"], lambda w: w, tile=8, bound=2, cloud_mask="simple").collect()
    assert sorted((r.tile_id, r.area) for r in found) == [("a", 12.0), ("b", 12.0)]
    area = spark.createDataFrame([("a", y, x) for y in range(12) for x in range(6)], "tile_id string, y int, x int")
    inside = single_period(catalog, pixels, "2024-01-01", "2024-01-31", 60.0, ["B04"], lambda w: w, tile=8, bound=2, cloud_mask="simple", area=area).collect()
    assert [(r.tile_id, r.area) for r in inside] == [("a", 6.0)]


def test_slivers_of_large_features_stay(spark):
    """Least area is asked of whole features, before they are clipped; the area then cuts them."""
    from scenewatch.operators.runs import counted, single_period

    catalog = scenes(spark, [("a", "2024-01-02", 5, "a2")])
    rows = [("a", "a2", y, x, 9000.0 if 3 <= y < 6 and 4 <= x < 8 or (y, x) == (10, 10) else 100.0) for y in range(12) for x in range(12)]
    fixed = {"b02": 0, "b03": 0, "b08": 3000, "b10": 0, "b11": 2000, "b12": 2000}
    pixels = spark.createDataFrame(rows, "tile_id string, scene_id string, y int, x int, b04 float").withColumns({"date": F.lit("2021-01-01").cast("date"), **{b: F.lit(float(v)).cast("float") for b, v in fixed.items()}})
    area = spark.createDataFrame([("a", y, x) for y in range(12) for x in (4, 10)], "tile_id string, y int, x int")
    args = (catalog, pixels, "2024-01-01", "2024-01-31", 60.0, ["B04"], lambda w: w)
    found = single_period(*args, tile=8, bound=2, cloud_mask="simple", area=area, min_area=12.0)
    assert [(r.tile_id, r.area) for r in found.collect()] == [("a", 3.0)] and tuple(counted(found).first()) == (1, None)
    none = single_period(*args, tile=8, bound=2, cloud_mask="simple", area=area, min_area=13.0)
    assert tuple(counted(none).first()) == (0, "no polygons")


def run_tables(spark):
    """Two tiles, a scene a week; a bright square that moves right by one with each scene."""
    days = ["2024-01-02", "2024-01-09", "2024-01-16"]
    catalog = scenes(spark, [(t, d, 5, f"{t}{k}") for t in "ab" for k, d in enumerate(days)]).withColumns({"min_x": F.when(F.col("tile_id") == "a", 0.0).otherwise(10.0), "min_y": F.lit(0.0)}).withColumns({"max_x": F.col("min_x") + 5, "max_y": F.lit(5.0)})
    rows = [(t, f"{t}{k}", y, x, 9000.0 if 3 <= y < 6 and 4 + k <= x < 8 + k else 100.0) for t in "ab" for k in range(3) for y in range(12) for x in range(12)]
    fixed = {"b02": 0, "b03": 0, "b08": 3000, "b10": 0, "b11": 2000, "b12": 2000}
    return catalog, spark.createDataFrame(rows, "tile_id string, scene_id string, y int, x int, b04 float").withColumns({"date": F.lit("2021-01-01").cast("date"), **{b: F.lit(float(v)).cast("float") for b, v in fixed.items()}})


@pytest.mark.parametrize("mode", ["concat", "newer_only", "union"])
def test_paired_run(spark, mode):
    """The model finds what is bright in the new scene and was not in the older one, or what is bright."""
    from scenewatch.operators.runs import Finding, paired_periods

    catalog, pixels = run_tables(spark)
    model = (lambda w: w[:, 1:2] - w[:, :1]) if mode == "concat" else (lambda w: w[:, :1])
    ring = spark.createDataFrame([("area", 0, 0, [(11.0, 1.0), (12.0, 1.0), (12.0, 2.0), (11.0, 1.0)])], "aoi_id string, poly int, ring int, points array<struct<x:double,y:double>>")
    run = lambda **k: paired_periods(catalog, pixels, ("2024-01-08", "2024-01-31"), ("2024-01-01", "2024-01-07"), 60.0, ["B04"], model, Finding(tile=8, bound=2), mode, cloud_mask="simple", **k)
    got = sorted((r.tile_id, r.area) for r in run().collect())
    pairs = [(f"{t}{k}||{t}0", k) for t in "ab" for k in (1, 2)]
    assert got == sorted({"concat": [(p, 3.0 * k) for p, k in pairs], "newer_only": [(p, 12.0) for p, _ in pairs], "union": [(p, 12.0) for p, _ in pairs * 2]}[mode])
    assert {r.tile_id[0] for r in run(rings=ring).collect()} == {"b"}


def test_series_run_and_merge(spark):
    """Slices of three weeks give three NDVI channels; with merge what overlaps on the common grid is one feature."""
    from scenewatch.operators.runs import Finding, series

    catalog, pixels = run_tables(spark)
    model = lambda w: (w[:, :1] < 0.2).astype(np.float32) * (w[:, 2:3] > 0.2)
    one = series(catalog, pixels, "2024-01-01", "2024-01-21", 60.0, 3, model, Finding(tile=8, bound=2)).collect()
    assert sorted((r.tile_id, r.area) for r in one) == [("a", 6.0), ("b", 6.0)]  # low NDVI in the first slice, not in the last
    places = spark.createDataFrame([("a", 0, 0), ("b", 1, 0)], "tile_id string, dy int, dx int")
    both = series(catalog, pixels, "2024-01-01", "2024-01-21", 60.0, 3, model, Finding(tile=8, bound=2, merge=True, places=places)).collect()
    assert [(r.tile_id, r.area) for r in both] == [("all", 8.0)]  # 3 x 2 cells twice, a row apart


def test_mosaic_scales_before_it_warps(spark):
    """A cell's byte is the mean of its neighbours' bytes, and none where a neighbour has no data."""
    px = [(1, "b02", y, x, 0.0 if (y, x) == (5, 5) else 1000.0 + 97 * ((7 * y + 3 * x) % 11)) for y in range(30) for x in range(30)]
    values = spark.createDataFrame(px, "tile_id int, band string, y int, x int, v double")
    grids = spark.createDataFrame([(1, 40, [500000.0, 20.0, 0.0, 6300000.0, 0.0, -20.0], 30, 30)], "tile_id int, zone int, gt array<double>, h int, w int")
    order = spark.createDataFrame([(1, 0)], "tile_id int, tile_order int")
    blocks_ = mosaic.build_mosaic(values, grids, order, pixel=40.0, block=16, stride=1).collect()
    got = {(r.y0 + i // 16, r.x0 + i % 16): v for r in blocks_ for i, v in enumerate(r.data) if v}
    scale = mosaic.global_scale(mosaic.band_stats(values, 1)).first()
    as_byte = lambda v: 0 if v == 0 else min(255, max(1, int((v - scale.src_min) / (scale.src_max - scale.src_min) * 254 + 1.5)))
    data = spark.createDataFrame([(*p[:4], float(as_byte(p[4]))) for p in px], "tile_id int, band string, y int, x int, v double")
    want = {(r.ty, r.tx): int(r.v + 0.5) for r in mosaic.warp(data, grids, 40.0).collect() if int(r.v + 0.5)}
    assert got == want and len(want) > 100


def onnx_identity() -> bytes:
    """A model file of one Identity node, in the wire format of its protocol buffers."""
    def field(number: int, value: bytes | int) -> bytes:
        if isinstance(value, int):
            return bytes([number << 3]) + bytes([value])
        return bytes([number << 3 | 2]) + bytes([len(value)]) + value

    shape = b"".join(field(1, field(2, b"nchw"[k : k + 1])) for k in range(4))
    value = lambda name: field(1, name) + field(2, field(1, field(1, 1) + field(2, shape)))
    node = field(1, b"input") + field(2, b"output") + field(4, b"Identity")
    graph = field(1, node) + field(2, b"g") + field(11, value(b"input")) + field(12, value(b"output"))
    return field(1, 8) + field(7, graph) + field(8, field(2, 13))


def test_onnx_scorer(spark, tmp_path):
    """A model file gives what the same function gives, opened by the tasks themselves."""
    (tmp_path / "m.onnx").write_bytes(onnx_identity())
    rows = spark.createDataFrame([("t", y, x, float(y * 7 + x), (y + x) % 3 > 0) for y in range(9) for x in range(9)], "tile_id string, y int, x int, v float, valid boolean")
    windows = scoring.make_windows(rows, 4, 1)
    score = lambda model: sorted(map(tuple, scoring.score_windows(windows, model, ["v"], 4, [0.5]).collect()))
    assert score(scoring.OnnxScorer(str(tmp_path / "m.onnx"))) == score(lambda w: w) != []


def test_covers_hold_the_cells_of_areas(spark):
    """Stars with holes, two of them overlapping, some left of the origin: the same cells as strips of rows give, few of them tested."""
    rng = np.random.default_rng(12)

    def star(cx, cy, r):
        turn = np.linspace(0, 2 * np.pi, 30)[:-1]
        far = r * rng.uniform(0.6, 1, 29)
        return ring(*zip(cx + far * np.cos(turn), cy + far * np.sin(turn)))

    rows = [("a", 0, 0, star(500, 420, 380)), ("a", 0, 1, star(520, 400, 90)), ("a", 1, 0, star(800, 500, 200)), ("b", 0, 0, star(-200, 90, 150)), ("c", 0, 0, ring((3, 3), (4, 3), (4, 4), (3, 3)))]
    rings = spark.createDataFrame(rows, "aoi_id string, poly int, ring int, points array<struct<x:double,y:double>>")
    area = areas.cover(rings, -10.0, 5.0, 2.0).cache()
    want = {(r.aoi_id, r.y, r.x) for r in vector.rings_in_cells(rings, -10.0, 5.0, 2.0).collect()}
    got = set()
    for r in area.collect():
        bits = np.ones(4096, bool) if r.bits is None else np.unpackbits(np.array(r.bits, np.int64).view(np.uint8), bitorder="little").astype(bool)
        got |= {(r.aoi_id, r.qy * 64 + int(i) // 64, r.qx * 64 + int(i) % 64) for i in np.flatnonzero(bits)}
    assert got == want and area.where("bits is null").count() > 3
    cells = spark.range(-150, 500).select(F.col("id").alias("x"), F.explode(F.sequence(F.lit(-20), F.lit(420), F.lit(7))).alias("y"), F.lit("k").alias("kind"))
    inside = {(r.y, r.x) for r in areas.clip(cells, area).collect()}
    assert inside == {(y, x) for _, y, x in want if (y + 20) % 7 == 0 and -20 <= y <= 420 and -150 <= x < 500}
