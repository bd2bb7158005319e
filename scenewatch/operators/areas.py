"""Areas as covers: squares of cells that lie inside whole, and border squares with a bit for each cell.

A polygon is split as a quadtree: a node that no edge crosses is inside or outside by one test and is not split further, so exact tests
of cells happen in border squares only. What meets an area joins it on squares, one row each; whole squares admit all of their cells.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenewatch.operators.vector import inside_rings

#: Cells along the side of a square, and levels of the quadtree above it.
SIDE, LEVELS = 64, 6
Ring = tuple[np.ndarray, np.ndarray]


def crossed(rings: list[Ring], x1: float, y1: float, x2: float, y2: float) -> bool:
    """Whether some edge of closed rings has a point in a rectangle, its border included."""
    for xs, ys in rings:
        dx, dy = np.roll(xs, -1) - xs, np.roll(ys, -1) - ys
        near = (np.minimum(xs, xs + dx) <= x2) & (np.maximum(xs, xs + dx) >= x1) & (np.minimum(ys, ys + dy) <= y2) & (np.maximum(ys, ys + dy) >= y1)
        if not near.any():
            continue
        ax, ay, dx, dy = xs[near], ys[near], dx[near], dy[near]
        # all four corners on one side of an edge's line: it passes by
        sides = [np.sign(dx * (cy - ay) - dy * (cx - ax)) for cx in (x1, x2) for cy in (y1, y2)]
        if (np.abs(reduce(np.add, sides)) < 4).any():
            return True
    return False


def squares(rings: list[Ring], y: int, x: int, n: int, x0: float, y0: float, px: float) -> list[tuple[int, int, list[int] | None]]:
    """(qy, qx, bits) of the squares with some cell inside in a node of n cells a side; bits is None where all are inside."""
    centre = lambda k, o: o + (k + 0.5) * px
    if not crossed(rings, centre(x, x0), centre(y, y0), centre(x + n - 1, x0), centre(y + n - 1, y0)):
        if not inside_rings(np.array([centre(x, x0)]), np.array([centre(y, y0)]), rings)[0]:
            return []
        return [(qy, qx, None) for qy in range(y // SIDE, (y + n) // SIDE) for qx in range(x // SIDE, (x + n) // SIDE)]
    if n > SIDE:
        half = n // 2
        return [s for dy in (0, half) for dx in (0, half) for s in squares(rings, y + dy, x + dx, half, x0, y0, px)]
    cy, cx = np.divmod(np.arange(SIDE * SIDE), SIDE)
    inside = inside_rings(centre(x + cx, x0), centre(y + cy, y0), rings)
    if not inside.any():
        return []
    return [(y // SIDE, x // SIDE, None if inside.all() else np.packbits(inside, bitorder="little").view(np.int64).tolist())]


def cover(rings: DataFrame, x0: float, y0: float, px: float, by: str = "aoi_id") -> DataFrame:
    """(by, qy, qx, bits): the squares of each area with some cell whose centre lies in one of its polygons (by, poly, ring, points).

    bits is null where all cells of a square do. A polygon is dealt by nodes of SIDE * 2**LEVELS cells, each split in one task.
    """
    kind, node = rings.schema[by].dataType.simpleString(), SIDE << LEVELS
    ends = [F.transform("points", lambda p: p["x"]), F.transform("points", lambda p: p["y"])]
    box = [f(g(e)).alias(f"{n}{k}") for k, e in enumerate(ends) for n, f, g in (("low", F.min, F.array_min), ("high", F.max, F.array_max))]
    polys = rings.groupBy(by, "poly").agg(F.collect_list("points").alias("rings"), *box)
    at = lambda k, o: F.sequence(F.floor((F.col(f"low{k}") - o) / px / node), F.floor((F.col(f"high{k}") - o) / px / node))
    nodes = polys.withColumn("ny", F.explode(at(1, y0))).withColumn("nx", F.explode(at(0, x0))).select(by, "rings", "ny", "nx").repartition(by, "ny", "nx")

    def of(batches):
        for pdf in batches:
            rows = []
            for key, polygon, ny, nx in zip(pdf[by], pdf["rings"], pdf["ny"], pdf["nx"]):
                shape = [(np.array([p["x"] for p in r], float), np.array([p["y"] for p in r], float)) for r in polygon]
                rows += [(key, *s) for s in squares(shape, int(ny) * node, int(nx) * node, node, x0, y0, px)]
            if rows:
                yield pd.DataFrame(rows, columns=[by, "qy", "qx", "bits"])

    return united(nodes.mapInPandas(of, f"`{by}` {kind}, qy long, qx long, bits array<long>"), by)


def united(parts: DataFrame, *by: str) -> DataFrame:
    """(by, qy, qx, bits): squares of several covers as one; without by, those of all areas together."""
    either = F.aggregate("all", F.array_repeat(F.lit(0).cast("long"), SIDE), lambda a, b: F.zip_with(a, b, lambda p, q: p.bitwiseOR(q)))
    found = parts.groupBy(*by, "qy", "qx").agg(F.bool_or(F.col("bits").isNull()).alias("whole"), F.collect_list("bits").alias("all"))
    return found.select(*by, "qy", "qx", F.when(~F.col("whole"), either).alias("bits"))


def square_of(at: Column) -> Column:
    return F.floor(at / SIDE)


def clip(cells: DataFrame, area: DataFrame) -> DataFrame:
    """Cells (y, x and others) inside a cover, as vector.clip_to_aoi() with the area's cells; areas of several rows a square are united first."""
    one = united(area)
    place = F.pmod("y", F.lit(SIDE)) * SIDE + F.pmod("x", F.lit(SIDE))
    word, bit = F.get("bits", F.floor(place / 64).cast("int")), F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))
    met = cells.withColumns({"qy": square_of(F.col("y")), "qx": square_of(F.col("x"))}).join(one, ["qy", "qx"])
    return met.where(F.col("bits").isNull() | (word.bitwiseAND(bit) != 0)).select(*cells.columns)
