"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in a hash-shuffled order, one full pass after another. A document finishes at
(words of its source so far, its own included) / (target of its source) in virtual time; the mix is the prefix of all
queues merged by finish time that fits the budget. No step sees a whole source, all sources or all ranges in one task:
positions come from sums over hash buckets in two levels plus a running sum inside each bucket; the budget's cut and
the level of the targets come from sums over a fixed number of ranges, of which the one that matters is parted again.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenewatch.llm.common import WORD, cut, need, whole, written

PASSES = 2
BUCKET_ROWS = 20_000
#: Buckets of one group of the upper level of sums.
GROUP = 1024
#: Ranges of each round of narrowing(), and rows few enough to sort.
RANGES, FEW = 4096, 10_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def ranked(sizes: DataFrame) -> DataFrame:
    """sizes with rank: the place of each source in code-point order, null last, from 0.

    Rows are sorted by ranges; a place is that in the range plus the rows of the ranges before, of which there are as
    many as shuffle partitions.
    """
    rows = cut(sizes.orderBy(F.col("source").asc_nulls_last())).withColumn("_at", F.monotonically_increasing_id())
    part = F.shiftright("_at", 33)
    before, counts = [], {r.p: r.n for r in rows.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    for p in range(max(counts, default=0) + 1):
        before.append((before[-1] + counts.get(p - 1, 0)) if before else 0)
    nth = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.withColumn("rank", F.element_at(F.array(*[F.lit(n).cast("long") for n in before]), (part + 1).cast("int")) + nth).drop("_at")


def narrowing(rows: DataFrame, key: str, sums: dict[str, Column], reached) -> tuple[float, float, dict[str, float]] | None:
    """(low, high, sums before low): the range of key in which `reached` first holds, with at most FEW rows or one key.

    reached is asked with the sums of all rows up to the end of a range. Each round sums RANGES equal ranges in one
    aggregate and goes on inside the one in question. None if it never holds.
    """
    low, high, n = rows.agg(F.min(key), F.max(key), F.count("*")).first()
    before = dict.fromkeys(sums, 0)
    while n:
        width = (high - low) / RANGES or 1.0
        inside = rows.where(F.col(key).between(low, high))
        bin_ = F.least(F.floor((F.col(key) - low) / width), F.lit(RANGES - 1))
        found = inside.groupBy(bin_.alias("_bin")).agg(F.count("*").alias("_rows"), F.min(key).alias("_low"), F.max(key).alias("_high"), *[c.alias(k) for k, c in sums.items()]).collect()
        for r in sorted(found, key=lambda r: r._bin):
            upto = {k: before[k] + r[k] for k in sums}
            if reached(upto, r._high):
                break
            before = upto
        else:
            return None
        if r._rows <= FEW or r._low == r._high or (r._low, r._high) == (low, high):
            return r._low, r._high, before
        low, high, n = r._low, r._high, r._rows
    return None


def targets(sizes: DataFrame, weights: Sequence[float], share: float, cap: float = PASSES) -> DataFrame:
    """(source, rank, source_size, target) from (source, source_size), one row a source.

    Sources in code-point order, null last, take the weights in turn. Together they get share x all sizes, each by its
    weight but at most cap x its size; what lies above is shared again by weight among the others until none is above.
    That fixed point is target = min(cap x size, level x weight). With sources by cap x size / weight, the level is
    (budget - the caps of those below it) / (the weights of the others).
    """
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    share_of = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights)).cast("int") + 1)
    one = cut(ranked(sizes).withColumn("w", share_of).withColumn("most", F.col("source_size") * F.lit(float(cap))).withColumn("t", F.col("most") / F.col("w")))
    total, weight = one.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("w"), F.lit(0.0))).first()
    budget = total * float(share)

    def fits(upto: dict[str, float], t: float) -> bool:
        """Whether a level of t would hand out the budget: the sources up to t get their caps, the others t x weight."""
        return upto["most"] + t * (weight - upto["w"]) >= budget

    found = narrowing(one, "t", {"most": F.sum("most"), "w": F.sum("w")}, fits)
    if found is None:
        level = math.inf
    else:
        low, high, before = found
        near = one.where(F.col("t").between(low, high)).groupBy("t").agg(F.sum("most").alias("most"), F.sum("w").alias("w")).orderBy("t").collect()
        for r in near:
            level = (budget - before["most"]) / (weight - before["w"])
            if level <= r.t:
                break
            before = {k: before[k] + r[k] for k in before}
    return one.select("source", "rank", "source_size", F.least("most", F.lit(level) * F.col("w")).alias("target"))


def base_sums(placed: DataFrame, p: int) -> DataFrame:
    """(source, b, before): the words of a source in the buckets before b, in pass p; sums in groups, then in buckets."""
    sums = placed.groupBy("source", F.col(f"b{p}").alias("b")).agg(F.sum("size").alias("n")).withColumn("g", F.floor(F.col("b") / GROUP))
    groups = sums.groupBy("source", "g").agg(F.sum("n").alias("n"))
    start = groups.select(F.col("source").alias("s"), F.col("g").alias("of"), (F.sum("n").over(Window.partitionBy("source").orderBy("g")) - F.col("n")).alias("start"))
    inside = sums.select("source", "b", "g", (F.sum("n").over(Window.partitionBy("source", "g").orderBy("b")) - F.col("n")).alias("inside"))
    return inside.join(start, F.col("source").eqNullSafe(F.col("s")) & (F.col("g") == F.col("of"))).select("source", "b", (F.col("start") + F.col("inside")).alias("before"))


def queue(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, seed: int = 10) -> DataFrame:
    """(doc_id, h, size, rank, source_size, target, finish, taken): one row a document.

    size is the number of words (null text: 0), h a hash of the text, finish the array of virtual finish times of its
    passes, taken its words times the passes that fall within the budget, share x all sizes. The order is drawn from
    hashes of doc_id, text and seed, so reruns agree. A source of size 0 has target 0 and finish nulls; an empty table
    gives no rows; rows with repeated or null ids are documents of their own. Other columns are ignored.
    """
    base = written(
        need(docs, "doc_id", "text", "source").select(F.col("doc_id"), "source", n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("h")), "mix-sizes"
    )
    sources = written(targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share), "mix-targets")
    rows = base.count()
    bits = max(3, math.ceil(math.log2(max(1, rows / BUCKET_ROWS))))
    placed = base
    for p in range(PASSES):
        placed = placed.withColumn(f"k{p}", F.xxhash64("doc_id", "h", F.lit(seed), F.lit(p))).withColumn(f"b{p}", F.shiftrightunsigned(f"k{p}", 64 - bits))
    for p in range(PASSES):
        sums = base_sums(placed, p)
        inside = Window.partitionBy("source", f"b{p}").orderBy(f"k{p}", "doc_id", "size", "h").rowsBetween(Window.unboundedPreceding, 0)
        run = placed.withColumn(f"at{p}", F.sum("size").over(inside)).alias("x")
        placed = run.join(sums.alias("y"), F.col("x.source").eqNullSafe(F.col("y.source")) & (F.col(f"x.b{p}") == F.col("y.b"))).select(
            "x.*", F.col("y.before").alias(f"before{p}")
        )
    s, d = sources.alias("s"), placed.alias("d")
    timed = d.join(s, F.col("d.source").eqNullSafe(F.col("s.source")))  # Spark broadcasts sources while they are few
    finish = F.array(*[(F.lit(p) * F.col("source_size") + F.col(f"before{p}") + F.col(f"at{p}")) / F.when(F.col("target") > 0, F.col("target")) for p in range(PASSES)])
    timed = written(timed.select("doc_id", "h", "size", "rank", "source_size", "target", finish.alias("finish")), "mix-finish")
    at, rank = cutoff(timed, share)
    within = [F.when((f := F.col("finish")[p]) < at, 1).when((f == at) & (F.col("rank") <= rank), 1).otherwise(0) for p in range(PASSES)]
    return timed.withColumn("taken", F.col("size") * sum(within[1:], within[0]))


def cutoff(timed: DataFrame, share: float) -> tuple[float, int]:
    """The last (finish, rank) within the budget in the merged order of all passes.

    Words are summed in ranges of finish time, and again inside the range that holds the cut; what is left there, at
    most FEW rows or those of one source at one moment, is summed by (finish, rank), which are taken or not together.
    """
    one = timed.select("rank", "size", F.explode("finish").alias("f")).where("f is not null and size > 0")
    budget = (timed.agg(F.sum("size")).first()[0] or 0) * share
    found = narrowing(one, "f", {"n": F.sum("size")}, lambda upto, _: upto["n"] > budget)
    if found is None:
        return float("inf"), 1 << 62
    low, high, before = found
    total, rows, last = before["n"], one.where(F.col("f").between(low, high)), (low, -1)  # all before this range are within
    if low == high:  # one moment, at which very many sources may finish a document
        first, end, earlier = narrowing(rows, "rank", {"n": F.sum("size")}, lambda upto, _: total + upto["n"] > budget)
        rows, last, total = rows.where(F.col("rank").between(first, end)), (low, first - 1), total + earlier["n"]
    for r in rows.groupBy("f", "rank").agg(F.sum("size").alias("n")).orderBy("f", "rank").collect():
        total += r.n
        if total > budget:
            break
        last = (r.f, r["rank"])
    return last


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, seed: int = 10) -> DataFrame:
    """The documents of the mix with all their columns, as often as they are taken, in the order of finish times.

    Texts without words, null ones too, have no size and are never taken; a null source is a source, the last one. Repeated rows, and rows
    of a null id, are documents of their own; equal finish times go by source, id and text. An empty table gives no rows.
    """
    plan = queue(docs, weights, share, seed).where("taken > 0")
    same = Window.partitionBy("doc_id", "h").orderBy("taken")
    plan = plan.withColumn("copy", F.row_number().over(same)).select(F.col("doc_id").alias("id"), F.col("h").alias("hash"), "copy", F.slice("finish", 1, (F.col("taken") / F.col("size")).cast("int")).alias("finish"))
    rows = whole(docs, "doc_id", F.xxhash64("text").alias("_h"), "source").withColumn("_copy", F.row_number().over(Window.partitionBy("doc_id", "_h").orderBy("source")))
    joined = rows.join(plan, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("_h") == F.col("hash")) & (F.col("_copy") == F.col("copy")))
    return joined.select("_doc", F.explode("finish").alias("_finish")).orderBy("_finish").select("_doc.*")
