"""Importance resampling: keep the documents that look most like a target, by hashed n-gram models and Gumbel top-k.

Each text is a bag of one- and two-word terms hashed into a fixed number of buckets. Its weight is the log ratio of
two bag models, one of target examples and one of all raw texts. Adding Gumbel noise, fixed by the document's id, and
taking the k greatest draws k documents without replacement with chances that follow the ratio.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenewatch.llm.common import SPACE_BYTES, byte_slices, fold_tables, mixed, need, tokens, written

BUCKETS = 1 << 14
GAP, SAME = fold_tables(SPACE_BYTES)


def terms(data: np.ndarray, rows: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of each word and each pair of neighbours of the rows' texts."""
    _, _, row, h = tokens(data, rows, GAP, SAME)
    pair = row[1:] == row[:-1]
    two = mixed(h[:-1] * np.uint64(3) + h[1:])[pair]
    return np.concatenate([row, row[1:][pair]]), (np.concatenate([h, two]) % np.uint64(buckets)).astype(np.int64)


def term_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The number of terms of all texts in each bucket; every task sends its sums, which meet in one row a bucket."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, data, rows in byte_slices(batch.column(0)):
                total += np.bincount(terms(data, rows, buckets)[1], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    sums = texts.select(F.coalesce("text", F.lit(""))).mapInArrow(of, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in sums.collect():
        out[r.bucket] = r.n
    return out


def log_ratio(target: np.ndarray, raw: np.ndarray, smoothing: float = 1.0) -> np.ndarray:
    """log P(bucket | target) - log P(bucket | raw); the target model is smoothed towards the raw one."""
    q = (raw + 1) / (raw.sum() + len(raw))
    p = (target + smoothing * len(raw) * q) / (target.sum() + smoothing * len(raw))
    return np.log(p) - np.log(q)


def weigh(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """(doc_id, h, log_weight): the sum of the ratios of each whole text's terms; h is a hash of the text."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for a, b, data, rows in byte_slices(batch.column(0)):
                row, bucket = terms(data, rows, len(shared.value))
                out[a:b] = np.bincount(row, shared.value[bucket], minlength=b - a)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(out)], names=["doc_id", "h", "log_weight"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return need(docs, "doc_id", "text").select(F.coalesce("text", F.lit("")), "doc_id", F.xxhash64("text").alias("h")).mapInArrow(of, f"doc_id {kind}, h long, log_weight double")


def gumbel(seed: int, *by: str) -> Column:
    """Standard Gumbel noise that depends on the columns and the seed only."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *by), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return -F.log(-F.log(u))


def kth_greatest(rows: DataFrame, k: int, fine: int = 4096, few: int = 10_000) -> tuple[float, int, int] | None:
    """The k-th of rows in the order of key, tie, other, all descending; None if k is 0 or there are no more than k.

    Counts in equal ranges narrow down to a range of at most `few` rows or of one key before anything is sorted.
    """
    low, high, n = rows.agg(F.min("key"), F.max("key"), F.count("*")).first()
    if not k or n <= k:
        return None
    while n > few and high > low:
        width = (high - low) / fine
        inside = rows.where((F.col("key") >= low) & (F.col("key") <= high))
        counts = {r.b: r for r in inside.groupBy(F.least(F.floor((F.col("key") - low) / width), F.lit(fine - 1)).alias("b")).agg(F.count("*").alias("n"), F.min("key").alias("a"), F.max("key").alias("z")).collect()}
        for b in sorted(counts, reverse=True):
            if counts[b].n >= k:
                break
            k -= counts[b].n
        if (counts[b].a, counts[b].z) == (low, high):
            break
        low, high, n = counts[b].a, counts[b].z, counts[b].n
    order = [F.desc("key"), F.desc_nulls_last("tie"), F.desc("other")]
    last = rows.where((F.col("key") >= low) & (F.col("key") <= high)).orderBy(*order).offset(k - 1).limit(1).first()
    return last.key, last.tie, last.other


def resample(docs: DataFrame, examples: DataFrame, share: float = 0.85, seed: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, log_weight, key, kept): kept is true for the k = round(share x rows) documents of the greatest keys.

    examples has the texts of the target model; the raw model counts all docs. key is log_weight plus Gumbel noise
    drawn from doc_id and text, so reruns agree. Null and empty texts have log_weight 0. Rows alike in id and text have
    one key and are kept or not together, so at most they exceed k. Without examples all weights are 0.
    """
    raw = term_counts(docs, buckets)
    target = term_counts(examples, buckets)
    ratio = log_ratio(target, raw) if target.any() else np.zeros(buckets)
    keyed = written(weigh(docs, ratio).withColumn("key", F.col("log_weight") + gumbel(seed, "doc_id", "h")), "resample-keys")
    rows = keyed.select("key", F.col("doc_id").cast("long").alias("tie"), F.col("h").alias("other"))
    n = keyed.count()
    k = math.floor(share * n + 0.5)
    last = kth_greatest(rows, k)
    if last is None:
        kept = F.lit(k >= n and k > 0)
    else:
        key, tie, other = last
        t = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
        at = -(1 << 63) if tie is None else tie
        kept = (F.col("key") > key) | ((F.col("key") == key) & ((t > at) | ((t == at) & (F.col("h") >= other))))
    return keyed.select("doc_id", "log_weight", "key", kept.alias("kept"))


def good_examples(docs: DataFrame, labels: DataFrame, most_rows: int = 20_000) -> DataFrame:
    """Texts of documents labelled of quality 1: at most most_rows, those with the least hashed ids."""
    known = need(labels, "doc_id", "quality").where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    return docs.join(F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)), "doc_id", "left_semi").select("text")
