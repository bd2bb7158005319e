"""Language identification by a bidirectional gated recurrent network over bytes, trained in NumPy.

The network reads lower-cased UTF-8 in windows, gives every byte a distribution over languages from the states of both
directions, and a document the mean of its bytes' distributions. Gates are clipped lines, so that a step is a few
passes over arrays of (units, windows). It is trained by backpropagation through time on windows of labelled texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scenewatch.llm.common import byte_slices, cut, given_back, held_out, whole

UNITS = 12
WINDOW = 128
UNKNOWN = "und"


class Direction:
    """One direction's gated recurrent units; all arrays are (units, windows)."""

    def __init__(self, units: int, rng: np.random.Generator) -> None:
        self.h = units
        self.w = (rng.normal(0, 0.3, (3 * units, 256))).astype(np.float32)
        self.w[: 2 * units] += 0.5
        self.u = (rng.normal(0, 0.4 / np.sqrt(units), (3 * units, units))).astype(np.float32)

    def run(self, x: np.ndarray, out: np.ndarray) -> None:
        """The state after each row of x (steps, windows), into out (steps, units, windows)."""
        n, h = self.h, np.zeros((self.h, x.shape[1]), np.float32)
        g, a = np.empty((3 * n, x.shape[1]), np.float32), np.empty((3 * n, x.shape[1]), np.float32)
        for t in range(len(x)):
            np.take(self.w, x[t], axis=1, out=g, mode="clip")
            np.dot(self.u, h, out=a)
            gate = g[: 2 * n]
            gate += a[: 2 * n]
            np.clip(gate, 0, 1, out=gate)
            c = g[2 * n :]
            a[2 * n :] *= gate[n:]
            c += a[2 * n :]
            np.clip(c, -1, 1, out=c)
            h -= c
            h *= gate[:n]
            h += c
            out[t] = h

    def learn(self, x: np.ndarray, states: np.ndarray, grads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The gradients of w and u, by going back through the steps; grads is that of each state from outside."""
        n, steps, width = self.h, *x.shape
        dh, du = np.zeros((n, width), np.float32), np.zeros_like(self.u)
        every = np.empty((3 * n, steps, width), np.float32)
        for t in range(steps - 1, -1, -1):
            prior = states[t - 1] if t else np.zeros((n, width), np.float32)
            a, g = self.u @ prior, self.w[:, x[t]]
            gate = g[: 2 * n] + a[: 2 * n]
            z, r = np.clip(gate[:n], 0, 1), np.clip(gate[n:], 0, 1)
            raw = g[2 * n :] + r * a[2 * n :]
            c = np.clip(raw, -1, 1)
            dh += grads[t]
            d = every[:, t]
            d[2 * n :] = dh * (1 - z) * (np.abs(raw) < 1)
            d[:n] = dh * (prior - c) * (np.abs(gate[:n] - 0.5) < 0.5)
            d[n : 2 * n] = d[2 * n :] * a[2 * n :] * (np.abs(gate[n:] - 0.5) < 0.5)
            da = np.concatenate([d[: 2 * n], d[2 * n :] * r])
            du += da @ prior.T
            dh = dh * z + self.u.T @ da
        flat = x.ravel()
        return np.stack([np.bincount(flat, row.ravel(), 256) for row in every]).astype(np.float32), du


class Network:
    """Both directions and the layer that labels each position."""

    def __init__(self, languages: list[str], units: int = UNITS, seed: int = 6) -> None:
        rng = np.random.default_rng(seed)
        self.languages, self.units = languages, units
        self.ways = [Direction(units, rng), Direction(units, rng)]
        self.v = rng.normal(0, 0.3, (len(languages), 2 * units)).astype(np.float32)
        self.b = np.zeros((len(languages), 1), np.float32)

    def states(self, x: np.ndarray) -> np.ndarray:
        """(steps, 2 x units, windows): the states that each direction has at each byte."""
        out = np.empty((len(x), 2 * self.units, x.shape[1]), np.float32)
        self.ways[0].run(x, out[:, : self.units])
        self.ways[1].run(x[::-1], out[::-1, self.units :])
        return out

    def positions(self, state: np.ndarray) -> np.ndarray:
        """The distribution over languages (languages, windows) at one step."""
        p = self.v @ state
        p += self.b
        p -= p.max(axis=0)
        np.exp(p, out=p)
        p /= p.sum(axis=0)
        return p

    def train(self, x: np.ndarray, y: np.ndarray, batches: int = 240, width: int = 256, rate: float = 0.01, seed: int = 7) -> None:
        """Adam on the mean cross entropy of all positions; x is (steps, windows) bytes, y the windows' languages."""
        rng = np.random.default_rng(seed)
        params = [self.ways[0].w, self.ways[0].u, self.ways[1].w, self.ways[1].u, self.v, self.b]
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
        n = self.units
        for k in range(1, batches + 1):
            pick = rng.integers(0, x.shape[1], min(width, x.shape[1]))
            xs, ys = x[:, pick], y[pick]
            s = self.states(xs)
            ds, dv, db = np.empty_like(s), np.zeros_like(self.v), np.zeros_like(self.b)
            for t in range(len(xs)):
                p = self.positions(s[t])
                p[ys, np.arange(len(ys))] -= 1
                p /= p.shape[1] * len(xs) / 16
                dv += p @ s[t].T
                db += p.sum(axis=1, keepdims=True)
                ds[t] = self.v.T @ p
            grads = [*self.ways[0].learn(xs, s[:, :n], ds[:, :n]), *self.ways[1].learn(xs[::-1], s[::-1, n:], ds[::-1, n:]), dv, db]
            size = np.sqrt(sum(float((g * g).sum()) for g in grads))
            step = rate * min(1.0, 2 * (1 - k / (batches + 1)))
            for p, (m, v), g in zip(params, moments, grads):
                g = g * min(1.0, 5 / (size + 1e-9))
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= step * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-6)

    def documents(self, data: np.ndarray, rows: np.ndarray, width: int = 1024) -> np.ndarray:
        """(rows, languages): the mean distribution of the bytes of each row; rows are offsets into data."""
        lens = np.diff(rows)
        count = -(-lens // WINDOW)
        row = np.repeat(np.arange(len(lens)), count)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        # the last window of a long row ends with it and shares bytes with the one before; those count once
        start = np.minimum(nth * WINDOW, np.maximum(lens[row] - WINDOW, 0))
        skip = nth * WINDOW - start
        padded = np.concatenate([data, np.full(WINDOW, 32, np.uint8)])
        out = np.zeros((len(lens), len(self.languages)))
        step = np.arange(WINDOW)[:, None]
        for at in range(0, len(row), width):
            part = slice(at, at + width)
            own = row[part]
            inside = step < lens[own]
            x = np.where(inside, padded[np.minimum(rows[own] + start[part] + step, len(padded) - 1)], 32).astype(np.int32)
            weight = (inside & (step >= skip[part])).astype(np.float32)
            s, total = self.states(x), np.zeros((len(self.languages), len(own)), np.float32)
            for t in range(WINDOW):
                total += self.positions(s[t]) * weight[t]
            for k in range(len(self.languages)):
                out[:, k] += np.bincount(own, total[k], len(lens))
        return out / np.maximum(lens, 1)[:, None]


def sampled(labelled: DataFrame, per_language: int, most: int, parts: int = 64) -> DataFrame:
    """(lang, h, t): distinct lower-cased texts with a letter and a language, the per_language least hashes of each.

    Copies of a text count once. No task sees a whole language: each of `parts` ranges of hashes is cut first. With
    more than most / per_language languages each gets fewer texts, so that at most `most` stay in all.
    """
    known = labelled.where("lang is not null").where(F.col("text").rlike("\\p{L}")).select("lang", F.xxhash64("text").alias("h"), "text")
    keys = known.select("lang", "h").distinct()
    part = F.pmod("h", F.lit(parts))
    near = keys.withColumn("part", part).withColumn("n", F.row_number().over(Window.partitionBy("lang", "part").orderBy("h"))).where(F.col("n") <= per_language)
    chosen = cut(near.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("n") <= per_language).select("lang", "h", "n"))
    languages = chosen.select("lang").distinct().count()
    if languages > most:
        raise ValueError(f"{languages} languages are more than the {most} texts that are learned from")
    few = chosen.where(F.col("n") <= min(per_language, most // max(1, languages))).select("lang", "h")
    return known.join(F.broadcast(few), ["lang", "h"]).groupBy("lang", "h").agg(F.lower(F.min("text")).alias("t"))


def fit(labelled: DataFrame, per_language: int = 400, windows: int = 4, most: int = 25_600, **options) -> Network | None:
    """A network trained on `windows` windows of each of per_language texts a language, those with the least hashes.

    labelled has text and lang; rows with a null, or without any letter, are left out. At most `most` texts are learned
    from in all. None where nothing is labelled.
    """
    spot = [F.expr(f"substring(t, cast(pmod(xxhash64(h, {k}), greatest(length(t) - {WINDOW // 2}, 1)) as int) + 1, {WINDOW})") for k in range(windows)]
    rows = sampled(labelled.select("lang", F.col("text").cast("string")), per_language, most).select("lang", "h", F.array(*spot).alias("parts")).orderBy("lang", "h").collect()
    if not rows:
        return None
    network = Network(sorted({r.lang for r in rows}))
    parts = [(p.encode()[: WINDOW // 2].ljust(WINDOW // 2), network.languages.index(r.lang)) for r in rows for p in r.parts]
    x = np.frombuffer(b"".join(p for p, _ in parts), np.uint8).reshape(-1, WINDOW // 2).T.astype(np.int32)
    network.train(np.ascontiguousarray(x), np.array([k for _, k in parts]), **options)
    return network


def judged(network: Network | None, texts: pa.Array) -> tuple[pa.Array, pa.Array]:
    """(language, probability) of lower-cased texts; null ones are `und` with 0."""
    empty = np.array(texts.is_null()) if network else np.ones(len(texts), bool)
    names, scores = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
    if not empty.all():
        pooled = np.concatenate([network.documents(data, rows) for _, _, data, rows in byte_slices(texts)])
        best = pooled.argmax(axis=1)
        names = np.where(empty, UNKNOWN, np.array(network.languages, object)[best])
        scores = np.where(empty, 0.0, np.minimum(pooled.max(axis=1), 1.0))
    return pa.array(names, pa.string()), pa.array(scores)


def predict(docs: DataFrame, network: Network | None, keep: str = "doc_id") -> DataFrame:
    """(keep, lang_pred, score) for each document: the language of the greatest pooled probability, and that.

    Null texts, and those without a letter, are `und` with score 0, as is all if the network is None. Whole texts are
    read; rows with repeated or null ids stay rows. keep is one column of docs, of any type, that is passed on.
    """
    shared = docs.sparkSession.sparkContext.broadcast(network)
    letters = docs.select(keep, F.when(F.col("text").rlike("\\p{L}"), F.lower(F.col("text").cast("string"))).alias("_t"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), *judged(shared.value, batch.column(1))], names=[keep, "lang_pred", "score"])

    return letters.mapInArrow(of, f"`{keep}` {docs.schema[keep].dataType.simpleString()}, lang_pred string, score double")


def recognised(docs: DataFrame, least: float = 0.4, **options) -> DataFrame:
    """The documents, with all their columns, whose language is told with at least this probability.

    Null and empty texts and those without letters go. A document's own lang, source and id are no inputs of its prediction; a null
    lang or id does no harm. Repeated rows are told alike, a tie of two languages by their order. An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs.where(~held_out(F.col("doc_id"))), **options))

    @F.arrow_udf("lang_pred string, score double")
    def told(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.StructArray.from_arrays(judged(shared.value, texts), names=["lang_pred", "score"])
        given_back()

    # only texts go to Python; the documents stay in Spark, where a batch of them would be held three times over
    letters = F.when(F.col("text").rlike("\\p{L}"), F.lower(F.col("text").cast("string")))
    known = whole(docs, "text").withColumn("_l", told(letters))
    return known.where((F.col("_l.lang_pred") != UNKNOWN) & (F.col("_l.score") >= least)).select("_doc.*")


def identify(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learns from the languages of documents not held out, predicts all."""
    network = fit(docs.where(~held_out(F.col("doc_id"))), **options)
    return predict(docs, network).withColumn("held_out", held_out(F.col("doc_id"))).select("doc_id", "held_out", "lang_pred", "score")
