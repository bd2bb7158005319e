"""Batch scoring of image windows by a pluggable model, and stitching of what it says.

Pixels have keys (a scene), y, x, one float column a channel and valid. A window is one task's patch; with a bound its
edge is context only, with an overlap every window counts and means are taken.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenewatch.functions.geo import window_owner
from scenewatch.operators.components import whole_groups


class Scorer(Protocol):
    """A model: float32 windows (N, C, H, W) to float32 scores (N, K, H, W)."""

    def predict(self, windows: np.ndarray) -> np.ndarray: ...


class OnnxScorer:
    """A model file, opened once a task; its input is called `input`, its output `output`."""

    def __init__(self, path: str) -> None:
        self.path, self.session = path, None

    def __getstate__(self) -> dict:
        return {"path": self.path, "session": None}

    def predict(self, windows: np.ndarray) -> np.ndarray:
        if self.session is None:
            import onnxruntime

            self.session = onnxruntime.InferenceSession(self.path, providers=["CPUExecutionProvider"])
        return self.session.run(["output"], {"input": windows})[0]


def step_of(tile: int, bound: int = 0, overlap: int = 0) -> int:
    step = tile - overlap if overlap else tile - 2 * bound
    if step <= 0:
        raise ValueError(f"windows of {tile} with bound {bound} and overlap {overlap} do not advance")
    return step


def windows_of(at: Column, tile: int, step: int) -> Column:
    """The numbers of the windows along one axis that hold a pixel: those that begin at most tile - 1 before it."""
    first = F.greatest(F.lit(0), F.ceil((at - tile + 1) / step)).cast("int")
    return F.sequence(first, F.floor(at / step).cast("int"))


def make_windows(pixels: DataFrame, tile: int, bound: int = 0, overlap: int = 0) -> DataFrame:
    """pixels once for each window that holds them, with wy, wx and the position py, px in it.

    A window's number is its place in steps; a window that only a tail of the grid reaches is padded when it is scored.
    """
    step = step_of(tile, bound, overlap)
    rows = pixels.withColumn("wy", F.explode(windows_of(F.col("y"), tile, step))).withColumn("wx", F.explode(windows_of(F.col("x"), tile, step)))
    return rows.withColumns({"py": (F.col("y") - F.col("wy") * step).cast("int"), "px": (F.col("x") - F.col("wx") * step).cast("int")})


def score_windows(windows: DataFrame, scorer: Scorer | Callable[[np.ndarray], np.ndarray], channels: list[str], tile: int, means: list[float] | None = None, keys: tuple[str, ...] = ("tile_id",), batch: int = 4) -> DataFrame:
    """(keys, wy, wx, y, x, k, score) of the valid pixels of every window and each of the model's outputs k.

    The model gets `batch` windows a call. A task fills many windows at once, a few million values at most; windows without a
    valid pixel are left out before the shuffle. Padding and invalid pixels are the channel means, or 0.
    """
    fill = np.array(means if means else [0.0] * len(channels), np.float32)
    predict = scorer.predict if hasattr(scorer, "predict") else scorer
    fields = ", ".join(f"`{k}` {windows.schema[k].dataType.simpleString()}" for k in keys)
    window = [*keys, "wy", "wx"]
    at_once = batch * max(1, (1 << 21) // (batch * len(channels) * tile * tile))

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, group in whole_groups(batches, window):
            bounds = np.searchsorted(group, np.arange(0, int(group[-1]) + at_once + 1, at_once))
            for a, b in zip(bounds[:-1], bounds[1:]):
                if a < b:
                    yield scored(pdf.iloc[a:b], group[a:b] - group[a])

    def scored(pdf: pd.DataFrame, n: np.ndarray) -> pd.DataFrame:
        py, px = pdf["py"].to_numpy(), pdf["px"].to_numpy()
        input_ = np.broadcast_to(fill[None, :, None, None], (int(n[-1]) + 1, len(channels), tile, tile)).copy()
        for c, name in enumerate(channels):
            input_[n, c, py, px] = pdf[name].to_numpy(np.float32)
        out = np.concatenate([np.asarray(predict(input_[k : k + batch]), np.float32) for k in range(0, len(input_), batch)])
        rows = pdf[[*window, "y", "x"]]
        return pd.concat([rows.assign(k=np.int32(k), score=out[n, k, py, px]) for k in range(out.shape[1])])

    needed = windows.where("valid").select(*window, "y", "x", "py", "px", *channels)
    dealt = needed.repartition(*window).sortWithinPartitions(*window)
    return dealt.mapInPandas(of, f"{fields}, wy int, wx int, y {windows.schema['y'].dataType.simpleString()}, x {windows.schema['x'].dataType.simpleString()}, k int, score float")


def binary_threshold(score: Column, limit: float) -> Column:
    """1 above the limit, else 0; no score is 0."""
    return F.when(score > F.lit(limit).cast("float"), 1).otherwise(0)


def stitch_binary(scores: DataFrame, tile: int, bound: int, limit: float, keys: tuple[str, ...] = ("tile_id",)) -> DataFrame:
    """(keys, y, x, v): each pixel's class by the window that owns it; no shuffle."""
    own = (F.col("wy") == window_owner(F.col("y"), tile, bound)) & (F.col("wx") == window_owner(F.col("x"), tile, bound))
    return scores.where(own & (F.col("k") == 0)).select(*keys, "y", "x", binary_threshold(F.col("score"), limit).alias("v"))


def average_scores(scores: DataFrame, keys: tuple[str, ...] = ("tile_id",)) -> DataFrame:
    """(keys, y, x, k, score): the mean over the windows that hold a pixel."""
    return scores.groupBy(*keys, "y", "x", "k").agg(F.avg(F.col("score").cast("double")).alias("score"))


def argmax_class(means: DataFrame, keys: tuple[str, ...] = ("tile_id",)) -> DataFrame:
    """(keys, y, x, k): the class of the greatest mean, the lesser class on ties."""
    return means.groupBy(*keys, "y", "x").agg(F.max_by("k", F.struct("score", -F.col("k"))).alias("k"))


def detection_classes(k: Column, classes: list[int] | None = None, strict_dn: bool = True) -> Column:
    """A class that counts as a detection: those listed, or all above 0. With strict_dn class 0 never does."""
    wanted = k.isin(*classes) if classes else k > 0
    return wanted & (k > 0) if strict_dn else wanted


def stitch_multiclass(scores: DataFrame, classes: list[int] | None = None, strict_dn: bool = True, keys: tuple[str, ...] = ("tile_id",)) -> DataFrame:
    """(keys, y, x, v, is_detection): the winning class where it is a detection, else 0."""
    best = argmax_class(average_scores(scores, keys), keys)
    hit = detection_classes(F.col("k"), classes, strict_dn)
    return best.select(*keys, "y", "x", F.when(hit, F.col("k")).otherwise(0).alias("v"), hit.alias("is_detection"))


def kept_by(at: Column, size: Column, w: Column, tile: int, bound: int) -> Column:
    """Whether window w keeps the pixel at `at` of an axis of this size: its bound is cut off but at the grid's ends."""
    step = step_of(tile, bound)
    low = F.when(w == 0, 0).otherwise(w * step + bound)
    high = F.when(w * step + tile >= size, size).otherwise(w * step + tile - bound)
    return (at >= low) & (at < high)


def union_detections(older: DataFrame | None, newer: DataFrame | None) -> DataFrame:
    """The results of both periods together; one that failed may be missing, not both."""
    if older is None and newer is None:
        raise ValueError("both periods failed")
    return older.unionByName(newer) if older is not None and newer is not None else older if older is not None else newer


def patch_stats(values: DataFrame, value: str = "score", by: tuple[str, ...] = ("tile_id",)) -> DataFrame:
    v = F.col(value).cast("double")
    return values.groupBy(*by).agg(F.min(v).alias("low"), F.max(v).alias("high"), F.avg(v).alias("mean"))
