"""Rasters as blocks: one row a square of pixels, one array a band. What is shuffled is blocks or strips of them, never pixels.

A block has tile_id (a scene), by, bx (its place, `block` pixels a side), y0, x0, h, w, and arrays of h * w values in reading order. An
array `there`, where a grid has holes, says which pixels exist. Arithmetic on pixels is transform() over zipped arrays with the column
functions of bands, so it stays in the JVM beside its block; what needs a neighbourhood (windows of a model, grids of another pixel
size) gets strips of the blocks around it and is NumPy in tasks.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from scenewatch.functions import bands
from scenewatch.operators import raster
from scenewatch.operators.components import whole_groups
from scenewatch.operators.graph import cut, shared_dir
from scenewatch.operators.pathology import of_tiles, thresholds
from scenewatch.operators.scoring import Scorer, step_of
from scenewatch.operators.selection import reference_band

PLACE = ("tile_id", "by", "bx")
FRAME = (*PLACE, "y0", "x0", "h", "w")
SIDE = 256


def to_blocks(pixels: DataFrame, names: list[str], block: int = SIDE, once: tuple[str, ...] = ()) -> DataFrame:
    """(FRAME, once.., there, names..) from rows (tile_id, y, x): the one time that pixels are shuffled, where a source has no blocks.

    names are numeric; nulls are 0, no data. Columns in `once` are the same for all pixels of a block.
    """
    kinds = {f.name: f.dataType.simpleString() for f in pixels.schema}
    rows = pixels.select("tile_id", F.floor(F.col("y") / block).cast("int").alias("by"), F.floor(F.col("x") / block).cast("int").alias("bx"), F.col("y").cast("long"), F.col("x").cast("long"), *once, *[F.coalesce(n, F.lit(0).cast(kinds[n])).alias(n) for n in names])

    fields = [*(f"`{n}` {kinds[n]}" for n in ("tile_id",)), "by int, bx int", *(f"`{n}` {kinds[n]}" for n in once), "y0 int, x0 int, h int, w int"]
    arrays = to_arrow_schema(T.StructType.fromDDL(", ".join(["there boolean", *(f"`{n}` {kinds[n]}" for n in names)])))
    numbers = {f.name: np.dtype(f.type.to_pandas_dtype()) for f in arrays}

    def packed(batches):
        """The arrays of a block as bytes: pandas would hand lists to Spark number by number."""
        for pdf, group in whole_groups(batches, list(PLACE)):
            first = np.flatnonzero(np.diff(group, prepend=-1))
            at = group * block * block + (pdf["y"].to_numpy() % block) * block + pdf["x"].to_numpy() % block
            out = pdf.iloc[first][[*PLACE, *once]].reset_index(drop=True)
            out = out.assign(y0=out["by"] * block, x0=out["bx"] * block, h=np.int32(block), w=np.int32(block))
            parts = []
            for name, kind in numbers.items():
                full = np.zeros(len(first) * block * block, kind)
                full[at] = True if name == "there" else pdf[name].to_numpy()
                parts.append(full.reshape(len(first), -1).view(np.uint8))
            yield out.assign(_data=[row.tobytes() for row in np.concatenate(parts, axis=1)])

    def unpacked(batches):
        for batch in batches:
            *frame_, data = batch.columns
            n, size, begin, lists = len(data), block * block, 0, []
            ends = np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + n + 1]
            raw = np.frombuffer(data.buffers()[2], np.uint8)[ends[0] : ends[-1]].reshape(n, -1) if n else np.zeros((0, 0), np.uint8)
            for kind in numbers.values():
                values = np.ascontiguousarray(raw[:, begin : begin + size * kind.itemsize]).view(kind).ravel()
                lists.append(pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * size), pa.array(values)))
                begin += size * kind.itemsize
            yield pa.RecordBatch.from_arrays([*frame_, *lists], names=[*batch.schema.names[:-1], *numbers])

    made = rows.repartition(*PLACE).sortWithinPartitions(*PLACE).mapInPandas(packed, ", ".join([*fields, "_data binary"]))
    return made.mapInArrow(unpacked, ", ".join([*fields, "there array<boolean>", *(f"`{n}` array<{kinds[n]}>" for n in names)]))


def stacked(blocks: DataFrame, names: list[str], once: tuple[str, ...] = (), block: int = SIDE) -> DataFrame:
    """(FRAME, once.., one array a band) from a row a band (band, data), all bands on one grid. A band that is missing is 0, no data."""
    first = [F.first(n).alias(n) for n in ("h", "w", *once)]
    wide = blocks.groupBy(*PLACE).agg(*first, *[F.first(F.when(F.upper("band") == n.upper(), F.col("data")), True).alias(n) for n in names])
    return wide.select(*PLACE, (F.col("by") * block).alias("y0"), (F.col("bx") * block).alias("x0"), "h", "w", *once, *[F.coalesce(n, F.array_repeat(bands.f32(0), (F.col("h") * F.col("w")).cast("int"))).alias(n) for n in names])


def each(names: list[str], f: Callable[[dict[str, Column]], Column], there: bool = False) -> Column:
    """The array of f over the pixels of arrays of these names; with `there` null, and no work, where no pixel is."""
    if there:
        return F.transform(F.arrays_zip("there", *[F.col(n) for n in names]), lambda s: F.when(s["there"], f({n: s[n] for n in names})))
    return F.transform(F.arrays_zip(*[F.col(n) for n in names]), lambda s: f({n: s[n] for n in names}))


def cells(blocks: DataFrame, *names: str) -> DataFrame:
    """(tile_id, y, x, names..): a row a pixel, of those that are there."""
    some = ["there"] if "there" in blocks.columns else []
    rows = blocks.select("tile_id", "y0", "x0", "w", F.posexplode(F.arrays_zip(*[F.col(n) for n in (*some, *names)])).alias("_i", "_p"))
    at = rows.where("_p.there") if some else rows
    return at.select("tile_id", (F.col("y0") + F.floor(F.col("_i") / F.col("w"))).cast("int").alias("y"), (F.col("x0") + F.col("_i") % F.col("w")).cast("int").alias("x"), *[F.col(f"_p.{n}").alias(n) for n in names])


def bands_of(blocks: DataFrame) -> list[str]:
    return [c for c in blocks.columns if c.startswith("b") and c[1:3].isdigit()]


def frame(blocks: DataFrame) -> list[str]:
    return [*FRAME, *(["there"] if "there" in blocks.columns else [])]


def cube(blocks: DataFrame, channels: list[str], level: str = "L1C", cloud: str = "full", scl: str | None = None) -> DataFrame:
    """(FRAME, one array a channel, valid): raster.build_cube() on blocks, without any shuffle."""
    have = bands_of(blocks)
    names = raster.channel_names(channels)

    def seen(p: dict[str, Column]) -> Column:
        r = raster.reflectances({b: p[b] for b in have}, F.col("date") if level == "L1C" else None, level)
        return F.struct(*[v.alias(b) for b, v in r.items()], raster.validity(r, channels, level, cloud, p[scl] if scl else None).alias("valid"))

    def made(name: str) -> Column:
        return F.transform("_p", lambda s: F.when(s.isNull(), bands.f32(0)).otherwise(raster.channel(name, {b: s[b] for b in have}, s["valid"])))

    lit = blocks.withColumn("_p", each([*have, *([scl] if scl else [])], seen, "there" in blocks.columns))
    return lit.select(*frame(blocks), *[made(n).alias(n) for n in names], F.transform("_p", lambda s: F.when(s.isNull(), False).otherwise(s["valid"])).alias("valid"))


def cloud_masks(blocks: DataFrame) -> DataFrame:
    """(FRAME, b04, b08, simple, full) of digital numbers: reflectances, and both cloud tests; 0 and false where no pixel is."""
    have = bands_of(blocks)
    tests = {"simple": ("b10", "b11", "b12"), "full": ("b10", "b11", "b12", "b02", "b03", "b04")}
    used = [b for b in have if b in {"b04", "b08", *tests["full"]}]
    lit = blocks.withColumn("_p", each(used, lambda p: F.struct(*[bands.toa(p[b], F.col("date")).alias(b) for b in used]), "there" in blocks.columns))

    def told(f: Callable[[Column], Column], nothing: Column) -> Column:
        return F.transform("_p", lambda s: F.when(s.isNull(), nothing).otherwise(f(s)))

    masks = [told(lambda s, t=t: bands.cloud_mask(*[s[b] for b in t]), F.lit(False)).alias(n) for n, t in tests.items()]
    return lit.select(*frame(blocks), *[told(lambda s, b=b: s[b], bands.f32(0)).alias(b) for b in ("b04", "b08")], *masks)


def ndvi_series(picked: DataFrame, n: int) -> DataFrame:
    """(FRAME, ndvi_0.., valid) from blocks (i, red, nir) of the scene picked for each interval: raster.build_ndvi_series() on blocks."""
    names, there = [f"ndvi_{i}" for i in range(n)], "there" in picked.columns
    one = picked.select(*frame(picked), "i", each(["red", "nir"], lambda p: bands.ndvi_clipped(p["red"], p["nir"])).alias("v"))
    of = lambda c, i: F.first(F.when(F.col("i") == i, F.col(c)), True)
    extent = [F.first(c).alias(c) for c in ("y0", "x0", "h", "w")]
    wide = one.groupBy(*PLACE).agg(*extent, *[of("v", i).alias(f"_{i}") for i in range(n)], *([of("there", i).alias(f"_t{i}") for i in range(n)] if there else []))
    size, nothing = (F.col("h") * F.col("w")).cast("int"), F.lit(None).cast("float")
    full = wide.withColumns({f"_{i}": F.coalesce(f"_{i}", F.array_repeat(nothing, size)) for i in range(n)})
    ok = lambda p: reduce(lambda a, b: a & b, [p[f"_{i}"].isNotNull() for i in range(n)])
    raw = [f"_{i}" for i in range(n)]
    out = {m: each(raw, lambda p, i=i: F.when(ok(p), p[f"_{i}"]).otherwise(bands.f32(0))) for i, m in enumerate(names)} | {"valid": each(raw, ok)}
    if there:
        full = full.withColumns({f"_t{i}": F.coalesce(f"_t{i}", F.array_repeat(F.lit(False), size)) for i in range(n)})
        out["there"] = each([f"_t{i}" for i in range(n)], lambda p: reduce(lambda a, b: a | b, p.values()))
    return full.select(*FRAME, *[v.alias(m) for m, v in out.items()])


# --- windows of a model, with strips of the blocks around ---


def origins(place: int, block: int, step: int) -> range:
    """Where the windows begin that begin in a block of this place along one axis."""
    return range(-(-place * block // step) * step, (place + 1) * block, step)


def strips(blocks: DataFrame, channels: list[str], tile: int, step: int, block: int) -> DataFrame:
    """(FRAME, valid, channels..): of each block the parts that windows beginning in other blocks reach, with those blocks' places."""
    kind = blocks.schema["tile_id"].dataType.simpleString()
    back = -(-(tile - 1) // block)

    def part(place: int, first: int, size: int) -> list[tuple[int, int, int]]:
        """(other place, from, to) along one axis, for each place whose windows reach rows first .. first + size."""
        out = []
        for k in range(max(0, place - back), place + 1):
            if begin := origins(k, block, step):
                low, high = max(first, begin[0]), min(first + size, begin[-1] + tile)
                out += [(k, low, high)] if low < high else []
        return out

    def of(batches):
        for batch in batches:
            rows = []
            for tile_id, own_y, own_x, y0, x0, h, w, *data in rows_in(pa.Table.from_batches([batch])):
                planes = [p.reshape(h, w) for p in data]
                for by, y1, y2 in part(own_y, y0, h):
                    for bx, x1, x2 in part(own_x, x0, w):
                        if (by, bx) != (own_y, own_x):
                            rows.append((tile_id, by, bx, y1, x1, y2 - y1, x2 - x1, *[p[y1 - y0 : y2 - y0, x1 - x0 : x2 - x0].ravel() for p in planes]))
            if rows:
                first, lists = zip(*((r[: len(FRAME)], r[len(FRAME) :]) for r in rows))
                yield pa.RecordBatch.from_arrays([*(pa.array(c, f.type) for c, f in zip(zip(*first), schema)), *map(list_array, zip(*lists))], schema=schema)

    fields = f"tile_id {kind}, by int, bx int, y0 int, x0 int, h int, w int, valid array<boolean>, " + ", ".join(f"`{c}` array<float>" for c in channels)
    schema = to_arrow_schema(T.StructType.fromDDL(fields))
    return blocks.select(*FRAME, "valid", *channels).mapInArrow(of, fields)


def score_blocks(blocks: DataFrame, scorer: Scorer | Callable[[np.ndarray], np.ndarray], channels: list[str], tile: int, bound: int = 0, overlap: int = 0, means: list[float] | None = None, batch: int = 4, block: int = SIDE) -> DataFrame:
    """(tile_id, wy, wx, y0, x0, h, w, valid, scores): each window with a valid pixel, and one array of scores for each output k.

    scoring.make_windows() and score_windows() on blocks: a window is made where it begins, from its block and strips of others, so that
    strips are all that is shuffled if blocks are parted by PLACE already. Blocks smaller than SIDE come in squares of about SIDE, as a
    group costs the same however little it holds; their windows go to the model and to Spark together, a few million values at most.
    Padding and invalid pixels are the channel means, or 0.
    """
    step = step_of(tile, bound, overlap)
    fill = np.array(means if means else [0.0] * len(channels), np.float32)
    predict = scorer.predict if hasattr(scorer, "predict") else scorer
    field = blocks.schema["tile_id"]

    at_once = batch * max(1, (1 << 21) // (batch * len(channels) * tile * tile))

    def of(own: pa.Table, near: pa.Table) -> pa.Table:
        places: dict[tuple, list[list]] = {}
        for t in (own, near):
            for row in rows_in(t):
                places.setdefault(tuple(row[1:3]), []).append(row)
        held, out = [], []
        for (by, bx), parts in places.items():
            ys, xs = origins(by, block, step), origins(bx, block, step)
            held += windows(parts, parts[0][0], ys, xs) if ys and xs else []
            while len(held) >= at_once:
                out.append(scored(held[:at_once]))
                held = held[at_once:]
        return pa.Table.from_batches([*out, *([scored(held)] if held else [])], schema)

    def scored(held: list[tuple]) -> pa.RecordBatch:
        tile_id, y, x, valid, planes = zip(*held)
        input_, n, size = np.stack(planes), len(held), tile * tile
        out = np.concatenate([np.asarray(predict(input_[k : k + batch]), np.float32) for k in range(0, n, batch)])
        y, x = np.array(y, np.int32), np.array(x, np.int32)
        full = np.full(n, tile, np.int32)
        ends = lambda m, size: pa.array(np.arange(m + 1, dtype=np.int32) * size)
        each_k = pa.ListArray.from_arrays(ends(n * out.shape[1], size), pa.array(out.ravel()))
        lists = [pa.ListArray.from_arrays(ends(n, size), pa.array(np.stack(valid).ravel())), pa.ListArray.from_arrays(ends(n, out.shape[1]), each_k)]
        return pa.RecordBatch.from_arrays([pa.array(tile_id, schema[0].type), *map(pa.array, (y // step, x // step, y, x, full, full)), *lists], schema=schema)

    def windows(parts: list[list], tile_id: object, ys: range, xs: range) -> list[tuple]:
        shape = (ys[-1] + tile - ys[0], xs[-1] + tile - xs[0])
        valid, planes = np.zeros(shape, bool), np.broadcast_to(fill[:, None, None], (len(channels), *shape)).copy()
        for _, _, _, y0, x0, h, w, good, *data in parts:
            top, left = max(y0, ys[0]), max(x0, xs[0])
            low, right = min(y0 + h, ys[0] + shape[0]), min(x0 + w, xs[0] + shape[1])
            if top >= low or left >= right:
                continue
            to, at = (slice(top - ys[0], low - ys[0]), slice(left - xs[0], right - xs[0])), (slice(top - y0, low - y0), slice(left - x0, right - x0))
            valid[to] = ok = good.reshape(h, w)[at].astype(bool)
            for c, values in enumerate(data):
                planes[c][to][ok] = values.reshape(h, w)[at][ok]
        at = [(y, x, (slice(y - ys[0], y - ys[0] + tile), slice(x - xs[0], x - xs[0] + tile))) for y in ys for x in xs]
        return [(tile_id, y, x, valid[s], planes[:, s[0], s[1]]) for y, x, s in at if valid[s].any()]

    whole = blocks.select(*FRAME, "valid", *channels)
    sent = strips(blocks, channels, tile, step, block)
    # its own names for the places: both sides come from one table
    sent = sent.select(*[F.col(c).alias(f"_{c}" if c in PLACE else c) for c in sent.columns])
    fields = f"tile_id {field.dataType.simpleString()}, wy int, wx int, y0 int, x0 int, h int, w int, valid array<boolean>, scores array<array<float>>"
    schema = to_arrow_schema(T.StructType.fromDDL(fields))
    many = max(1, SIDE // block)

    def square(prefix: str) -> list[Column]:
        return [F.col(f"{prefix}{c}") if c == "tile_id" or many == 1 else F.floor(F.col(f"{prefix}{c}") / many) for c in PLACE]

    return whole.groupBy(*square("")).cogroup(sent.groupBy(*square("_"))).applyInArrow(of, fields)


def rows_in(table: pa.Table) -> list[list]:
    """The rows of a table, lists of numbers as arrays."""
    columns = []
    for c in (c.combine_chunks() for c in table.columns):
        if pa.types.is_list(c.type):
            values, ends = c.values.to_numpy(zero_copy_only=False), c.offsets.to_numpy().tolist()
            columns.append([values[a:b] for a, b in zip(ends, ends[1:])])
        else:
            columns.append(c.to_pylist())
    return [list(r) for r in zip(*columns)]


def list_array(rows: tuple[np.ndarray, ...]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)], dtype=np.int32)), pa.array(np.concatenate(rows)))


def window_cells(windows: DataFrame) -> DataFrame:
    """(tile_id, wy, wx, y, x, k, score): the valid pixels of scored windows, as scoring.score_windows() has them."""
    at = windows.select("tile_id", "wy", "wx", "y0", "x0", "w", "valid", F.posexplode("scores").alias("k", "s"))
    rows = at.select("tile_id", "wy", "wx", "y0", "x0", "w", "k", F.posexplode(F.arrays_zip("valid", "s")).alias("i", "p")).where("p.valid")
    return rows.select("tile_id", "wy", "wx", (F.col("y0") + F.floor(F.col("i") / F.col("w"))).cast("int").alias("y"), (F.col("x0") + F.col("i") % F.col("w")).alias("x"), "k", F.col("p.s").alias("score"))


# --- bands of other pixel sizes on the reference grid ---


def touched(first: int, size: int, n: int, m: int) -> tuple[int, int]:
    """The range of target cells along one axis whose value uses a source cell of first .. first + size, of n cells and m targets."""
    if n == m:
        return first, first + size
    low = 0 if first == 0 else max(0, int(np.floor((first - 0.5) * m / n - 0.5)))
    high = m if first + size >= n else min(m, int(np.ceil((first + size + 0.5) * m / n - 0.5)) + 1)
    return low, high


def needed(low: int, high: int, n: int, m: int) -> tuple[int, int]:
    """The range of source cells along one axis that target cells low .. high use."""
    if n == m:
        return low, high
    at = lambda t: int(np.floor((t + 0.5) * (n / m) - 0.5))
    return max(0, at(low)), min(n, at(high - 1) + 2)


def bilinear(source: np.ndarray, y: np.ndarray, x: np.ndarray, n: tuple[int, int], m: tuple[int, int], y0: int, x0: int) -> np.ndarray:
    """Values at target rows y and columns x from a part of the source that begins at y0, x0; sizes n of the source, m of the target.

    Pixel centres, weights in single precision, neighbours clamped at the edges; a zero neighbour gives 0.
    """
    if n == m:
        return source[np.ix_(y - y0, x - x0)]
    one = np.float32(1)

    def corners(t: np.ndarray, n: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        s = (t + 0.5) * (n / m) - 0.5
        low = np.floor(s).astype(np.int64)
        return np.maximum(low, 0), np.minimum(low + 1, n - 1), (s - low).astype(np.float32)

    (ya, yb, fy), (xa, xb, fx) = corners(y, n[0], m[0]), corners(x, n[1], m[1])
    four = [source[np.ix_(a - y0, b - x0)] for a in (ya, yb) for b in (xa, xb)]
    fy, fx = fy[:, None], fx[None, :]
    top, low = four[0] * (one - fx) + four[1] * fx, four[2] * (one - fx) + four[3] * fx
    return np.where(reduce(np.logical_or, [v == 0 for v in four]), np.float32(0), top * (one - fy) + low * fy)


def on_reference_blocks(blocks: DataFrame, grids: DataFrame, names: list[str], level: str = "L1C", block: int = SIDE, **choice) -> DataFrame:
    """(FRAME, gt, one array a band) of each scene on the grid of its reference band; other bands bilinear, by the ratio of sizes.

    blocks: (tile_id, band, by, bx, h, w, data), blocks of one size on each band's own grid; grids: (tile_id, nth, band, w, h, gt), a row a
    band. choice goes to selection.reference_band(). Each block sends every target block the part of it that is used there,
    so what is shuffled is the sources and their edges. Where a band has no pixel its value is 0.
    """
    of_scene = grids.withColumnRenamed("tile_id", "scene_id")
    chosen = reference_band(of_scene, level, **choice).select(F.col("scene_id").alias("tile_id"), F.col("w").alias("m_w"), F.col("h").alias("m_h"), "gt")
    sized = blocks.join(grids.select("tile_id", "band", F.col("w").alias("n_w"), F.col("h").alias("n_h")), ["tile_id", "band"]).join(chosen, "tile_id")
    kind = blocks.schema["tile_id"].dataType.simpleString()

    def parts(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                data, y0, x0 = np.asarray(r.data, np.float32).reshape(r.h, r.w), r.by * block, r.bx * block
                (ly, hy), (lx, hx) = touched(y0, r.h, r.n_h, r.m_h), touched(x0, r.w, r.n_w, r.m_w)
                for by in range(ly // block, -(-hy // block)):
                    for bx in range(lx // block, -(-hx // block)):
                        a, b = needed(by * block, min((by + 1) * block, r.m_h), r.n_h, r.m_h)
                        c, d = needed(bx * block, min((bx + 1) * block, r.m_w), r.n_w, r.m_w)
                        a, b, c, d = max(a, y0), min(b, y0 + r.h), max(c, x0), min(d, x0 + r.w)
                        if a < b and c < d:
                            rows.append((r.tile_id, by, bx, r.band, a, c, b - a, d - c, r.n_h, r.n_w, r.m_h, r.m_w, r.gt, np.ascontiguousarray(data[a - y0 : b - y0, c - x0 : d - x0]).ravel()))
            if rows:
                yield pd.DataFrame(rows, columns=["tile_id", "by", "bx", "band", "y0", "x0", "h", "w", "n_h", "n_w", "m_h", "m_w", "gt", "data"])

    sent = sized.select("tile_id", "by", "bx", "band", "h", "w", "n_h", "n_w", "m_h", "m_w", "gt", "data").mapInPandas(
        parts, f"tile_id {kind}, by int, bx int, band string, y0 int, x0 int, h int, w int, n_h int, n_w int, m_h int, m_w int, gt array<double>, data array<float>"
    )

    def put(batches):
        for pdf, group in whole_groups(batches, list(PLACE)):
            bounds = np.append(np.flatnonzero(np.diff(group, prepend=-1)), len(pdf))
            columns = [pdf[c].to_numpy() for c in pdf.columns]
            yield pd.DataFrame([made([[c[i] for c in columns] for i in range(a, b)]) for a, b in zip(bounds[:-1], bounds[1:])])

    def made(parts: list[list]) -> dict:
        tile_id, by, bx, *_, m_h, m_w, gt, _ = parts[0]
        y, x = np.arange(by * block, min((by + 1) * block, m_h)), np.arange(bx * block, min((bx + 1) * block, m_w))
        row = {"tile_id": tile_id, "by": by, "bx": bx, "y0": by * block, "x0": bx * block, "h": len(y), "w": len(x), "gt": gt} | {n: np.zeros(len(y) * len(x), np.float32) for n in names}
        for name in names:
            own = [p[3:] for p in parts if p[3].lower() == name.lower()]
            if own:
                n, m = tuple(own[0][5:7]), (m_h, m_w)
                (a, b), (c, d) = needed(int(y[0]), int(y[-1]) + 1, n[0], m[0]), needed(int(x[0]), int(x[-1]) + 1, n[1], m[1])
                source = np.zeros((b - a, d - c), np.float32)
                for _, y0, x0, h, w, *_, data in own:
                    source[y0 - a : y0 - a + h, x0 - c : x0 - c + w] = data.reshape(h, w)
                row[name] = bilinear(source, y, x, n, m, a, c).ravel()
        return row

    fields = f"tile_id {kind}, by int, bx int, y0 int, x0 int, h int, w int, gt array<double>, " + ", ".join(f"`{n}` array<float>" for n in names)
    return sent.repartition(*PLACE).sortWithinPartitions(*PLACE).mapInPandas(put, fields)


# --- the forest index as tables of blocks, and the difference between two years ---


def index_blocks(blocks: DataFrame) -> DataFrame:
    """(FRAME, vog1) of digital numbers: pathology.vog1_pixels() on blocks; null under clouds and where there is no data."""
    names = ["b05", "b06", "b10", "b11", "b12"]

    def index(p: dict[str, Column]) -> Column:
        r = raster.reflectances(p, F.col("date"), "L1C")
        return bands.vog1(r["b05"], r["b06"], bands.cloud_mask(r["b10"], r["b11"], r["b12"]))

    return blocks.select(*frame(blocks), each(names, index, "there" in blocks.columns).alias("vog1"))


def bucketed(blocks: DataFrame, buckets: int = 64) -> DataFrame:
    """blocks as a table in the shared folder, dealt to buckets by PLACE and sorted there: joins of such tables by PLACE shuffle nothing."""
    spark = blocks.sparkSession
    name = f"blocks_{uuid.uuid4().hex}"
    blocks.repartition(buckets, *PLACE).write.bucketBy(buckets, *PLACE).sortBy(*PLACE).option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    return spark.table(name)


def mask_diff(new: DataFrame, base: DataFrame, limits: DataFrame) -> DataFrame:
    """(FRAME, sick, newly_sick) of the new year's blocks: pathology.mask_diff() where both years have blocks of one grid.

    new and base have vog1, as bucketed() tables of index_blocks(); limits has tile_id, threshold, base_threshold. A pixel that the
    base lacks counts as sick before; one under clouds there was not sick.
    """
    there = "there" in new.columns
    size = F.size("vog1")
    before = base.select(*PLACE, F.col("vog1").alias("was"), *([F.col("there").alias("was_there")] if there else []))
    both = of_tiles(new.join(before, list(PLACE), "left"), limits)
    both = both.withColumn("has", F.coalesce("was_there" if there else F.lit(None).cast("array<boolean>"), F.array_repeat(F.col("was").isNotNull(), size))).withColumn("was", F.coalesce("was", F.array_repeat(F.lit(None).cast("float"), size)))

    def masks(p: dict[str, Column]) -> Column:
        sick = F.coalesce(p["vog1"] < F.col("threshold"), F.lit(False))
        was = ~p["has"] | F.coalesce(p["was"] < F.col("base_threshold"), F.lit(False))
        return F.struct(sick.alias("sick"), (sick & ~was).alias("newly_sick"))

    told = both.withColumn("_m", each(["vog1", "was", "has"], masks, there))
    return told.select(*frame(new), *[each_member("_m", n) for n in ("sick", "newly_sick")])


def each_member(array: str, name: str) -> Column:
    return F.transform(array, lambda s: F.coalesce(s[name], F.lit(False))).alias(name)


def pathology_diff(new: DataFrame, base: DataFrame, buckets: int = 64) -> DataFrame:
    """(FRAME, sick, newly_sick): pathology.pathology_diff() on blocks of digital numbers of two years, on one grid a tile.

    The index of each year is computed once and written as a bucketed table; thresholds read its one column, and the difference joins
    blocks where they lie.
    """
    years = [bucketed(index_blocks(blocks), buckets) for blocks in (new, base)]
    now, then = (thresholds(cells(t, "vog1")).select("tile_id", "threshold") for t in years)
    both = now.where("threshold >= 0").join(then.withColumnRenamed("threshold", "own"), "tile_id")
    limits = cut(both.select("tile_id", "threshold", F.when(F.col("own") >= 0, F.col("own")).otherwise(F.col("threshold")).alias("base_threshold")))
    return mask_diff(*years, limits)
