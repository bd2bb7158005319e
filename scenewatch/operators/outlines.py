"""Outlines of regions as rings of corners: edges of cells, linked and ranked, first inside blocks and then across them.

Each side of a cell that does not meet its own region is an edge, run with the cell on its right. Which edge follows it is seen from the
cells around its head, so a block that also gets its neighbours' border cells knows the successor of all of its edges, wherever that lies.
Inside a block edges are ranked by pointer doubling in NumPy and contracted: a ring that never leaves the block is done, and the
others are left as chains with their corners. Chains are ranked by pointer doubling too, a join a round, in as many rounds as the
logarithm of a ring's number of chains. So no task holds a region; only the corners of a ring come together.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenewatch.operators.components import whole_groups
from scenewatch.operators.graph import cut

#: For each way along a cell (east above it, south at its right, west below it, north at its left), as (y, x): the cell across the
#: edge, the one ahead on its own side, the one ahead across, and the head of the edge.
WAYS = (((-1, 0), (0, 1), (-1, 1), (0, 1)), ((0, 1), (1, 0), (1, 1), (1, 1)), ((1, 0), (0, -1), (1, -1), (1, 0)), ((0, -1), (-1, 0), (-1, -1), (0, 0)))
#: An edge's number is y * ACROSS + x * 4 + way.
ACROSS = 1 << 32


def ranked(after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(end, steps to it) of each of n nodes that lead to after[i], or nowhere if that is -1; a ring ends before its least node."""
    n = len(after)
    own = np.arange(n)
    to, least = np.where(after < 0, own, after), own.copy()
    for _ in range(n.bit_length() + 1):
        least = np.minimum(least, least[to])
        to = to[to]
    ring = after[to] >= 0  # nodes that never reach an end
    last = (after < 0) | ring & (after == least)
    to, steps = np.where(last, own, after), np.where(last, 0, 1)
    for _ in range(n.bit_length() + 1):
        steps = steps + steps[to]
        to = to[to]
    return to, steps


def block_chains(y: np.ndarray, x: np.ndarray, component: np.ndarray, own: np.ndarray, group: np.ndarray, width: int, low_y: np.ndarray, low_x: np.ndarray, junctions: bool = False) -> dict[str, np.ndarray | list]:
    """Chains of the edges of some blocks' own cells, with the row of a cell of each one's region.

    low_y and low_x are the corner of each cell's block; cells of neighbours lie one step outside of it, and width leaves room for two.
    id is the number of the first edge, next that of the edge after the last, or -1 for a closed ring; double_area is twice the
    signed area below the chain. xs and ys are its corners; with `junctions` also the points where three regions meet (the outside
    counts as one), or two cross, which are 1 in marks.
    """
    place = (group * width + y - low_y + 2) * width + x - low_x + 2
    order = np.argsort(place, kind="stable")
    p, region = place[order], component[order]

    def cell(q: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(p, q), len(p) - 1)
        return np.where(p[at] == q, at, -1)

    mine = np.flatnonzero(own[order])
    keys, follow, corner, meets, cells, ways = [], [], [], [], [], []
    for way, (across, ahead, beyond, _) in enumerate(WAYS):
        step = lambda c: c[0] * width + c[1]
        other = cell(p[mine] + step(across))
        i = mine[(other < 0) | (region[other] != region[mine])]
        r, b = cell(p[i] + step(ahead)), cell(p[i] + step(beyond))
        straight = (r >= 0) & (region[r] == region[i])
        left = straight & (b >= 0) & (region[b] == region[i])
        to = np.where(left, b, np.where(straight, r, i))
        turn = np.where(left, (way - 1) % 4, np.where(straight, way, (way + 1) % 4))
        keys.append(i * 4 + way)
        follow.append(to * 4 + turn)
        corner.append(turn != way)
        label = lambda c: np.where(c < 0, -1, region[c])
        around = np.sort([region[i], label(cell(p[i] + step(across))), label(r), label(b)], axis=0)
        crossing = (label(b) == region[i]) & (label(r) == label(cell(p[i] + step(across)))) & (label(r) != region[i])
        meets.append(((np.diff(around, axis=0) != 0).sum(axis=0) >= 2) | crossing)
        cells.append(i)
        ways.append(np.full(len(i), way))
    sort = np.argsort(np.concatenate(keys))
    key, follow, corner, meet, at, way = (np.concatenate(c)[sort] for c in (keys, follow, corner, meets, cells, ways))
    shown = corner | meet if junctions else corner
    inside = own[order][follow // 4]
    after = np.where(inside, np.searchsorted(key, follow), -1)
    end, steps = ranked(after)
    line = np.lexsort((-steps, end))
    first = np.flatnonzero(np.diff(end[line], prepend=-1))
    last = end[line[first]]
    cy, cx = y[order][at], x[order][at]
    head = np.array([w[3] for w in WAYS])
    hy, hx = cy + head[way, 0], cx + head[way, 1]
    # twice the area below each edge, by its ends
    double = np.choose(way, (-cy, cx + 1, cy + 1, -cx))
    to = order[follow // 4]
    goes = np.where(after >= 0, -1, y[to] * ACROSS + x[to] * 4 + follow % 4)
    bounds = np.searchsorted(np.flatnonzero(shown[line]), np.append(first, len(line)))
    kept = line[shown[line]]
    ranges = list(zip(bounds[:-1], bounds[1:]))
    return {
        "row": order[at[line[first]]], "id": (cy * ACROSS + cx * 4 + way)[line[first]], "next": goes[last], "double_area": np.add.reduceat(double[line], first) if len(first) else first,
        "xs": [hx[kept[a:b]] for a, b in ranges], "ys": [hy[kept[a:b]] for a, b in ranges], "marks": [meet[kept[a:b]].astype(np.int64) for a, b in ranges],
    }


def chains(labelled: DataFrame, block: int = 256, junctions: bool = False) -> DataFrame:
    """(tile_id, component, v, id, next, double_area, xs, ys, marks) of regions (tile_id, y, x, v, component); next is -1 for closed rings.

    A block gets its own cells and the border cells of the eight around it.
    """
    kind = labelled.schema["tile_id"].dataType.simpleString()
    rows = labelled.select("tile_id", F.col("y").cast("long"), F.col("x").cast("long"), F.col("v").cast("int"), F.col("component").cast("long"))
    at = lambda dy, dx: F.struct(F.floor((F.col("y") + dy) / block).alias("by"), F.floor((F.col("x") + dx) / block).alias("bx"))
    inner = (F.col("y") % block).between(1, block - 2) & (F.col("x") % block).between(1, block - 2)
    to = F.when(inner, F.array(at(0, 0))).otherwise(F.array_distinct(F.array(*[at(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)])))
    keys = ["tile_id", "by", "bx"]
    sent = rows.withColumn("b", F.explode(to)).select("tile_id", "b.by", "b.bx", "y", "x", "v", "component").where("by >= 0 and bx >= 0")

    def of(batches):
        for pdf, group in whole_groups(batches, keys):
            y, x, component = (pdf[c].to_numpy(np.int64) for c in ("y", "x", "component"))
            by, bx = pdf["by"].to_numpy(np.int64), pdf["bx"].to_numpy(np.int64)
            own = (y // block == by) & (x // block == bx)
            found = block_chains(y, x, component, own, group, block + 4, by * block, bx * block, junctions)
            row = found.pop("row")
            if len(row):
                yield pd.DataFrame({"tile_id": pdf["tile_id"].to_numpy()[row], "component": component[row], "v": pdf["v"].to_numpy()[row], **found})

    return sent.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(of, f"tile_id {kind}, component long, v int, id long, next long, double_area long, xs array<long>, ys array<long>, marks array<long>")


def rings_of(parts: DataFrame) -> DataFrame:
    """(tile_id, id, ring, steps) of chains that lead from id to next in closed rings: the least id of the ring, and the steps to it.

    In round k each chain knows the least of the 2**k chains from it on, how far that is, and the chain after them.
    """
    state = cut(parts.select("tile_id", "id", F.col("next").alias("to"), F.col("id").alias("ring"), F.lit(0).cast("long").alias("steps")))
    span = 1
    while True:
        far = state.select("tile_id", F.col("id").alias("to"), F.col("to").alias("then"), F.col("ring").alias("far_ring"), F.col("steps").alias("far_steps"))
        less = F.col("far_ring") < F.col("ring")
        ring, steps = F.when(less, F.col("far_ring")).otherwise(F.col("ring")), F.when(less, F.col("far_steps") + span).otherwise(F.col("steps"))
        state = cut(state.join(far, ["tile_id", "to"]).select("tile_id", "id", F.col("then").alias("to"), ring.alias("ring"), steps.alias("steps"), less.alias("less")))
        if state.where("less").isEmpty():
            return state.select("tile_id", "id", "ring", "steps")
        span *= 2


def thinned(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas and Peucker's simplification of an arc or a closed ring. It keeps its ends and the point farthest from them, of a
    ring a triangle at least, and does not depend on the way that it is run through.
    """
    if len(points) <= 2:
        return points
    turned = tuple(points[0]) > tuple(points[-1]) or (points[0] == points[-1]).all() and tuple(points[1]) > tuple(points[-2])
    line = points[::-1] if turned else points

    def away(a: int, b: int) -> np.ndarray:
        p, q, mid = line[a], line[b], line[a + 1 : b]
        length = np.hypot(*(q - p))
        return np.abs((q[0] - p[0]) * (mid[:, 1] - p[1]) - (q[1] - p[1]) * (mid[:, 0] - p[0])) / length if length else np.hypot(*(mid - p).T)

    far = 1 + int(away(0, len(line) - 1).argmax())
    keep = np.zeros(len(line), bool)
    keep[[0, far, -1]] = True
    stack = [(0, far), (far, len(line) - 1)]
    while stack:
        a, b = stack.pop()
        if b > a + 1:
            off = away(a, b)
            if off.max() > tolerance:
                k = a + 1 + int(off.argmax())
                keep[k] = True
                stack += [(a, k), (k, b)]
    if (line[0] == line[-1]).all() and keep.sum() < 4:
        sides = [(a + 1 + int(off.argmax()), off.max()) for a, b in ((0, far), (far, len(line) - 1)) if b > a + 1 for off in [away(a, b)]]
        keep[max(sides, key=lambda side: side[1])[0]] = True
    kept = line[keep]
    return kept[::-1] if turned else kept


def thin_ring(points: np.ndarray, marks: np.ndarray, tolerance: float) -> np.ndarray:
    """A closed ring whose arcs between junctions are thinned each alone, as the neighbours beyond them thin theirs."""
    at = np.flatnonzero(marks[:-1])
    if not len(at):
        return thinned(points, tolerance)
    ring = np.concatenate([points[at[0] : -1], points[: at[0] + 1]])
    cuts = np.append(at - at[0], len(ring) - 1)
    arcs = [thinned(ring[a : b + 1], tolerance) for a, b in zip(cuts[:-1], cuts[1:])]
    return np.concatenate([arcs[0][:1], *[arc[1:] for arc in arcs]])


def polygonize(labelled: DataFrame, gt: list[float] | None = None, block: int = 256, tolerance: float = 0.0) -> DataFrame:
    """(tile_id, component, dn, area, rings) of 4-connected regions (tile_id, y, x, v, component); y and x are not negative.

    rings: the outer ring first, then holes, by area; closed, corners only, from the least (x, y) on, in world units by the affine
    transform gt (no rotation); area is that of the cells. Where two cells of a region touch only at a corner, rings keep them apart.
    With a tolerance, in world units of square pixels, rings are thinned arc by arc between the points where regions meet, so that
    neighbours still share their border exactly.
    """
    parts = cut(chains(labelled, block, tolerance > 0))
    open_ = parts.where("next >= 0")
    whole = parts.where("next < 0").select("*", F.col("id").alias("ring"), F.lit(0).cast("long").alias("steps"))
    if not open_.isEmpty():
        whole = whole.unionByName(open_.join(rings_of(open_), ["tile_id", "id"]))
    # from the chain with the least number on, the others by how far it still is
    place = F.struct((F.col("steps") > 0).alias("later"), (-F.col("steps")).alias("left"), F.arrays_zip("xs", "ys", "marks").alias("points"))
    found = whole.groupBy("tile_id", "component", "v", "ring").agg(F.sum("double_area").alias("double_area"), F.array_sort(F.collect_list(place)).alias("parts"))
    points = found.select("tile_id", "component", "v", "double_area", F.flatten(F.transform("parts", lambda s: s["points"])).alias("p"))
    start = F.array_position("p", F.array_min("p")).cast("int")
    turned = points.withColumn("p", F.concat(F.slice("p", start, F.size("p")), F.slice("p", 1, start)))  # closed: the first point is also the last
    if tolerance > 0:
        step = tolerance / abs(gt[1]) if gt else tolerance

        def of(batches):
            for pdf in batches:
                rings = [np.array([(p["xs"], p["ys"], p["marks"]) for p in ring]) for ring in pdf["p"]]
                yield pdf.assign(p=[[{"xs": int(x), "ys": int(y), "marks": 0} for x, y in thin_ring(r[:, :2], r[:, 2], step)] for r in rings])

        turned = turned.mapInPandas(of, turned.schema)
    g = [F.lit(float(k)) for k in gt or (0, 1, 0, 0, 0, 1)]
    world = lambda ring: F.transform(ring, lambda p: F.array(g[0] + p["xs"] * g[1], g[3] + p["ys"] * g[5]))
    rings = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("double_area")).alias("order"), "p"))), lambda s: world(s["p"]))
    area = F.sum("double_area") / 2 * F.abs(g[1] * g[5])
    return turned.groupBy("tile_id", "component").agg(F.first("v").alias("dn"), area.alias("area"), rings.alias("rings"))
