"""Connected regions of mask cells: labels that hold across blocks, sizes, and what follows from them.

A cell has tile_id, y, x (not negative) and v; 0 is background and never labelled. Blocks are labelled each in one
task; then only cells on block borders are joined, and the labels that meet are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenewatch.operators.graph import connected, cut

ROW = 1 << 31
AHEAD = {4: ((0, 1), (1, 0)), 8: ((0, 1), (1, 0), (1, 1), (1, -1))}
#: Blocks along one side of a square of blocks whose labels are merged in one task.
SQUARE = 16


def least_linked(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the least node of its component under links (a, b): hooking and pointer jumping."""
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        if not (x != y).any():
            return root
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root != root[root]).any():
            root = root[root]


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Runs of whole groups from batches sorted by keys, with the number of each row's group: many small groups at once. Nulls are equal."""
    held = None
    for pdf in batches:
        pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
        if not len(pdf):
            continue
        new = np.concatenate([[True], np.logical_or.reduce([(v[1:] != v[:-1]) & ~(pd.isna(v[1:]) & pd.isna(v[:-1])) for v in (pdf[k].to_numpy() for k in keys)])])
        last = int(np.flatnonzero(new)[-1])
        if last:
            yield pdf.iloc[:last], np.cumsum(new[:last]) - 1
        held = pdf.iloc[last:].reset_index(drop=True)
    if held is not None and len(held):
        yield held, np.zeros(len(held), np.int64)


def block_labels(y: np.ndarray, x: np.ndarray, v: np.ndarray, group: np.ndarray, block: int, conn: int) -> np.ndarray:
    """The label of each cell of some blocks: y * 2**31 + x of the first cell, in reading order, of its region there.

    Runs of equal cells in a row are merged with the runs that they touch in the next row, in NumPy throughout.
    """
    width = block + 2  # an empty column on both sides, and two empty rows below, part rows and blocks
    place = (group * width + y % block) * width + x % block + 1
    order = np.argsort(place, kind="stable")
    p, w = place[order], v[order]
    run = np.cumsum(np.concatenate([[True], (p[1:] != p[:-1] + 1) | (w[1:] != w[:-1])])) - 1
    ends_a, ends_b = [], []
    for dy, dx in AHEAD[conn][1:]:
        at = np.minimum(np.searchsorted(p, p + dy * width + dx), len(p) - 1)
        met = np.flatnonzero((p[at] == p + dy * width + dx) & (w[at] == w))
        ends_a.append(run[met])
        ends_b.append(run[at[met]])
    root = least_linked(int(run[-1]) + 1, np.concatenate(ends_a), np.concatenate(ends_b))
    first = order[np.searchsorted(run, np.arange(int(run[-1]) + 1))]
    label = np.empty(len(y), np.int64)
    label[order] = (y[first] * ROW + x[first])[root[run]]
    return label


def merged(a: np.ndarray, b: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of a member, label, root): each label of links (a, b) with the least label of its component in its group."""
    label, own = np.concatenate([a, b]), np.concatenate([group, group])
    order = np.lexsort((label, own))
    new = np.concatenate([[True], (label[order][1:] != label[order][:-1]) | (own[order][1:] != own[order][:-1])])
    node = np.empty(len(label), np.int64)
    node[order] = np.cumsum(new) - 1
    nodes = order[new]
    root = least_linked(len(nodes), node[: len(a)], node[len(a) :])
    return nodes % len(a), label[nodes], label[nodes][root]


def label_components(cells: DataFrame, conn: int = 4, block: int = 256) -> DataFrame:
    """(tile_id, y, x, v, component): cells with v <> 0; component is the least label of its region of equal v.

    Blocks are labelled each in one task. Labels that meet across blocks are merged first inside squares of SQUARE x
    SQUARE blocks, each in one task that sees border cells only, then across squares by connected().
    """
    if conn not in AHEAD:
        raise ValueError(f"cells touch at 4 or 8 neighbours, not {conn}")
    kind = cells.schema["tile_id"].dataType.simpleString()
    keyed = cells.where("v <> 0").select("tile_id", F.col("y").cast("long"), F.col("x").cast("long"), F.col("v").cast("int"), F.floor(F.col("y") / block).alias("by"), F.floor(F.col("x") / block).alias("bx"))

    def labelled(batches):
        for pdf, group in whole_groups(batches, ["tile_id", "by", "bx"]):
            y, x, v = (pdf[c].to_numpy(np.int64) for c in ("y", "x", "v"))
            yield pdf[["tile_id", "y", "x", "v"]].assign(label=block_labels(y, x, v, group, block, conn))

    def joined(batches):
        for pdf, group in whole_groups(batches, ["tile_id", "sy", "sx"]):
            row, label, root = merged(pdf["from"].to_numpy(np.int64), pdf["label"].to_numpy(np.int64), group)
            yield pd.DataFrame({"tile_id": pdf["tile_id"].to_numpy()[row], "label": label, "root": root})

    keys = ["tile_id", "by", "bx"]
    local = cut(keyed.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(labelled, f"tile_id {kind}, y long, x long, v int, label long"))
    side = block * SQUARE
    square = F.struct(F.floor(F.col("y") / side).alias("y"), F.floor(F.col("x") / side).alias("x"))
    edge = local.where(f"y % {block} in (0, {block - 1}) or x % {block} in (0, {block - 1})").withColumn("to_square", square)
    steps = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in AHEAD[conn]])
    sent = edge.select("tile_id", "y", "x", "v", "label", F.col("to_square").alias("square"), F.explode(steps).alias("s"))
    sent = sent.select("tile_id", (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"), "v", F.col("label").alias("from"), "square")
    met = cut(sent.join(edge, ["tile_id", "y", "x", "v"]).where("`from` <> label").select("tile_id", "from", "label", "square", "to_square").distinct())
    keys = ["tile_id", "sy", "sx"]
    near = met.where("square = to_square").select("tile_id", "from", "label", F.col("square.y").alias("sy"), F.col("square.x").alias("sx"))
    inner = cut(near.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(joined, f"tile_id {kind}, label long, root long"))
    across = met.where("square <> to_square").select("tile_id", "from", "label")
    for end in ("from", "label"):
        own = inner.select("tile_id", F.col("label").alias(end), F.col("root").alias("_root"))
        across = across.join(own, ["tile_id", end], "left").withColumn(end, F.coalesce("_root", end)).drop("_root")
    outer = connected(across.select(F.struct("tile_id", F.col("from").alias("l")).alias("a"), F.struct("tile_id", F.col("label").alias("l")).alias("b")))
    roots = outer.select(F.col("node.tile_id").alias("tile_id"), F.col("node.l").alias("first"), F.col("root.l").alias("last"))
    found = local.join(inner, ["tile_id", "label"], "left").withColumn("first", F.coalesce("root", "label")).join(roots, ["tile_id", "first"], "left")
    return found.select("tile_id", "y", "x", "v", F.coalesce("last", "first").alias("component"))


def component_sizes(labelled: DataFrame, pixel_area: float = 1.0) -> DataFrame:
    """(tile_id, component, v, n, area, bounds) of each region."""
    return labelled.groupBy("tile_id", "component").agg(
        F.min("v").alias("v"), F.count("*").alias("n"), (F.count("*") * F.lit(float(pixel_area))).alias("area"), F.min("y").alias("min_y"), F.min("x").alias("min_x"), F.max("y").alias("max_y"), F.max("x").alias("max_x")
    )


def filter_small(cells: DataFrame, min_px: int, conn: int = 4, enabled: bool = True, block: int = 256) -> DataFrame:
    """cells (tile_id, y, x, v) without regions under min_px cells; as they are if disabled or min_px is at most 1."""
    if not enabled or min_px <= 1:
        return cells.where("v <> 0").select("tile_id", "y", "x", "v")
    labelled = label_components(cells, conn, block)
    kept = component_sizes(labelled).where(F.col("n") >= min_px).select("tile_id", "component")
    return labelled.join(kept, ["tile_id", "component"], "left_semi").select("tile_id", "y", "x", "v")


def dilate(cells: DataFrame, radius: int, bounds: DataFrame | None = None) -> DataFrame:
    """(tile_id, y, x): the cells and all within `radius` steps of 8 neighbours; bounds (tile_id, h, w) clip them."""
    reach = F.sequence(F.lit(-radius), F.lit(radius))
    rows = cells.where("v <> 0").select("tile_id", "y", "x", F.explode(reach).alias("dy")).select("tile_id", (F.col("y") + F.col("dy")).alias("y"), "x").distinct()
    grown = rows.select("tile_id", "y", "x", F.explode(reach).alias("dx")).select("tile_id", "y", (F.col("x") + F.col("dx")).alias("x")).distinct()
    return grown if bounds is None else grown.join(bounds, "tile_id").where("y >= 0 and x >= 0 and y < h and x < w").select("tile_id", "y", "x")


def drop_old_components(new: DataFrame, old: DataFrame, ratio: float, block: int = 256) -> DataFrame:
    """Cells of new without the 8-connected regions of which at least `ratio` of the cells were set in old."""
    labelled = label_components(new, 8, block)
    was = old.where("v <> 0").select("tile_id", F.col("y").cast("long"), F.col("x").cast("long"), F.lit(1.0).alias("was")).distinct()
    share = labelled.join(was, ["tile_id", "y", "x"], "left").groupBy("tile_id", "component").agg(F.avg(F.coalesce("was", F.lit(0.0))).alias("share"))
    return labelled.join(share.where(F.col("share") < ratio), ["tile_id", "component"], "left_semi").select("tile_id", "y", "x", "v")


def neighbours(labelled: DataFrame, of: DataFrame) -> DataFrame:
    """(tile_id, a, b): the regions b that touch each region a of `of` (tile_id, component) at 8 neighbours, each pair once."""
    steps = F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for dy, dx in AHEAD[8] for a, b in ((dy, dx), (-dy, -dx))])
    own = labelled.join(of, ["tile_id", "component"], "left_semi")
    sent = own.select("tile_id", F.col("component").alias("a"), "y", "x", F.explode(steps).alias("s")).select("tile_id", "a", (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"))
    return sent.join(labelled.select("tile_id", "y", "x", F.col("component").alias("b")), ["tile_id", "y", "x"]).where("a <> b").select("tile_id", "a", "b").distinct()


def contracted(regions: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(regions, roots) after linked regions (tile_id, a, b) became one, with the value of its largest member; roots: (tile_id, id, root)."""
    ends = [F.struct("tile_id", F.col(c).alias("l")).alias(c) for c in ("a", "b")]
    roots = cut(connected(links.select(*ends)).select(F.col("node.tile_id").alias("tile_id"), F.col("node.l").alias("id"), F.col("root.l").alias("root")))
    moved = regions.join(roots, ["tile_id", "id"], "left").withColumn("to", F.coalesce("root", "id"))
    grown = moved.groupBy("tile_id", F.col("to").alias("id")).agg(F.max_by("v", F.struct("n", -F.col("id"))).alias("v"), F.sum("n").alias("n"))
    return cut(grown), roots


def sieve(cells: DataFrame, px: int, block: int = 256) -> DataFrame:
    """All cells, background included, with no region under px cells (8 neighbours) left that touches another one.

    cells has every cell of the grid. Regions are merged in rounds on the graph of regions, as Boruvka's steps: each small one is tied to its
    largest neighbour, the lesser component on ties, and what is tied becomes one region with the value of its largest member. Neighbours that
    have come to one value count as one region before the next step. Pixels take part at the start and the end only; rounds
    grow with the logarithm of the longest chain of small regions.
    """
    labelled = cut(label_components(cells.withColumn("v", F.col("v") + 1), 8, block))
    regions = cut(component_sizes(labelled).select("tile_id", F.col("component").alias("id"), "v", "n"))
    # a group that stays small has small members only, so their links are all that is ever needed
    links = cut(neighbours(labelled, regions.where(F.col("n") < px).select("tile_id", F.col("id").alias("component"))))
    place = regions.select("tile_id", F.col("id").alias("component"), "id")
    while True:
        side = lambda k: regions.select("tile_id", F.col("id").alias(k), F.col("v").alias(f"{k}_v"), F.col("n").alias(f"{k}_n"))
        known = cut(links.join(side("a"), ["tile_id", "a"]).join(side("b"), ["tile_id", "b"]))
        equal = known.where("a_v = b_v").select("tile_id", "a", "b")
        small = known.where(F.col("a_n") < px)
        best = small.groupBy("tile_id", "a").agg(F.max_by("b", F.struct("b_n", -F.col("b"))).alias("b"))
        tied = equal if not equal.isEmpty() else best
        if tied.isEmpty():
            break
        regions, roots = contracted(regions, tied)
        for end in ("a", "b"):
            own = roots.select("tile_id", F.col("id").alias(end), F.col("root").alias("_root"))
            links = links.join(own, ["tile_id", end], "left").withColumn(end, F.coalesce("_root", end)).drop("_root")
        links = cut(links.where("a <> b").select("tile_id", "a", "b").distinct())
        place = cut(place.join(roots, ["tile_id", "id"], "left").select("tile_id", "component", F.coalesce("root", "id").alias("id")))
    final = place.join(regions.select("tile_id", "id", F.col("v").alias("taken")), ["tile_id", "id"]).select("tile_id", "component", "taken")
    return labelled.join(final, ["tile_id", "component"]).select("tile_id", "y", "x", (F.col("taken") - 1).alias("v"))
