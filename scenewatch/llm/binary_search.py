"""Exact k nearest binary codes by Hamming distance, with multi-index hashing that grows its search radii.

A 64-bit code is cut into m segments, each indexed. A code within m(s+1)-1 bits of a query agrees with it to within s
bits in some segment, so probing all segments at radius s proves every distance below m(s+1), and probing only the
first a of them so far, every distance below ms + a. Radii grow, small ones for all segments at once and then one
segment at a time, until the k-th distance found is proved; queries that are done leave. Equal codes are one entry with its
least ids.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenewatch.llm.common import cut, need

BITS = 64
#: Codes of a bucket from which on it is parted into blocks, at least.
BLOCK = 20_000


def sign_code(vector: Column) -> Column:
    """64 bits as a long: bit i is set if the vector's i-th number is positive; missing, null and NaN ones are not."""
    out = F.lit(0).cast("long")
    for i in range(BITS):
        x = F.get(vector, F.lit(i))
        out = out.bitwiseOR(F.when((x > 0) & ~F.isnan(x), F.lit((1 << i) if i < 63 else -(1 << 63))).otherwise(F.lit(0)).cast("long"))
    return out


def segments(code: Column, m: int) -> list[Column]:
    """The m segments of a code, the first from its lowest bits."""
    width = BITS // m
    return [F.shiftrightunsigned(code, i * width).bitwiseAND(F.lit((1 << width) - 1 if width < 64 else -1).cast("long")) for i in range(m)]


def parts(codes: int) -> int:
    """A number of segments such that a bucket of one holds a few codes: a segment has about log2(codes) bits.

    Segments have 16 bits at most: one of 32 would have 601 million values within 16 flips of a query's.
    """
    return min((4, 8), key=lambda m: abs(BITS / m - math.log2(max(codes, 2))))


def schedule(m: int, first: int = 2, together: int = 4) -> list[tuple[list[int], list[int], int]]:
    """(radii, segments to probe at them, the greatest distance proved then): the rounds of a search.

    The first round takes all radii up to `first`; below `together` all segments go in one round.
    """
    most = BITS // m
    out = [(list(range(min(first, most) + 1)), list(range(m)), m * (min(first, most) + 1) - 1)]
    out += [([s], list(range(m)), m * (s + 1) - 1) for s in range(first + 1, min(together, most + 1))]
    return out + [([s], [a], m * s + a) for s in range(max(together, first + 1), most + 1) for a in range(m)]


def flipped(probes: DataFrame, width: int, radius: int) -> DataFrame:
    """probes with a column v: a row for each value that differs from v0 in exactly `radius` of its `width` bits.

    Each step chooses one more bit above those chosen, so masks are made by the tasks, and never listed anywhere.
    """
    rows = probes.withColumn("v", F.col("v0")).withColumn("_next", F.lit(0))
    for k in range(radius):
        free = F.sequence(F.col("_next"), F.lit(width - radius + k))
        rows = rows.withColumn("_bit", F.explode(free))
        rows = rows.withColumn("v", F.col("v").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_bit")))).withColumn("_next", F.col("_bit") + 1).drop("_bit")
    return rows.drop("_next")


def blocks_of(index: DataFrame, count: int) -> DataFrame:
    """(s, v, blocks): the buckets of index (s, v, code) to be parted, and into how many blocks.

    A bucket is parted if it holds over BLOCK codes and over a 10,000th of all, so there are at most 10,000 of each
    segment, whatever the data.
    """
    most = max(BLOCK, count // 10_000)
    return index.groupBy("s", "v").agg(F.count("*").alias("n")).where(F.col("n") > most).select("s", "v", F.ceil(F.col("n") / most).cast("int").alias("blocks"))


def nearest(rows: DataFrame, wanted: Column, k: int = 10) -> DataFrame:
    """(query_id, rank, neighbor_id, distance): the k nearest other rows of each row for which `wanted` holds.

    rows has `id` and `code`; those with a null in either are neither found nor asked. Ties go to the lesser id. A query
    has fewer than k rows only if there are fewer others. Rows with a repeated id are taken once, by their least code.
    Crowded buckets of the index are parted into blocks by a hash of the code, and a probe goes to each of them.
    """
    rows = rows.where("id is not null and code is not null").groupBy("id").agg(F.min("code").alias("code"))
    least = F.slice(F.array_sort(F.collect_list("id")), 1, k + 1)
    ranked = rows.withColumn("n", F.row_number().over(Window.partitionBy("code").orderBy("id"))).where(F.col("n") <= k + 1)
    entries = cut(ranked.groupBy("code").agg(least.alias("ids"), F.min("id").alias("first")))
    count = entries.count()
    m = parts(count)
    width = BITS // m
    index = cut(entries.select("code", "first", F.size("ids").alias("size"), F.posexplode(F.array(*segments(F.col("code"), m))).alias("s", "v")))
    crowded = F.broadcast(cut(blocks_of(index, count)))
    of_code = F.pmod(F.xxhash64("code"), F.coalesce("blocks", F.lit(1))).cast("int")
    index = cut(index.join(crowded, ["s", "v"], "left").withColumn("block", of_code).drop("blocks"))
    asked = cut(rows.where(wanted).select(F.col("id").alias("query_id"), "code"))
    open_ = cut(asked.select(F.col("code").alias("q")).distinct().withColumn("bound", F.lit(BITS)))
    best = None
    done = []
    rounds = schedule(m)
    for radii, some, proved in rounds:
        cuts = F.array(*[F.struct(F.lit(a).alias("s"), segments(F.col("q"), m)[a].alias("v0")) for a in some])
        asking = open_.select("q", "bound", F.inline(cuts))
        probes = reduce(DataFrame.unionByName, [flipped(asking, width, r) for r in radii]).drop("v0")
        probes = probes.join(crowded, ["s", "v"], "left").withColumn("block", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))).drop("blocks")
        apart = F.bit_count(F.col("q").bitwiseXOR(F.col("code"))).cast("int")
        found = probes.join(index, ["s", "v", "block"]).withColumn("d", apart).where("d <= bound").select("q", "code", "first", "size", "d")
        if best is not None:
            found = found.unionByName(best)
        # k + 1 codes are enough: each better one has a better row, and only one of those rows can be the query's own
        near = Window.partitionBy("q").orderBy("d", "first")
        top = found.distinct().withColumn("r", F.row_number().over(near)).where(F.col("r") <= k + 1)
        top = top.withColumn("upto", F.sum("size").over(near.rowsBetween(Window.unboundedPreceding, 0)) - 1)
        whole = Window.partitionBy("q")
        top = top.withColumns({"bound": F.coalesce(F.min(F.when(F.col("upto") >= k, F.col("d"))).over(whole), F.lit(BITS)), "codes": F.count("*").over(whole)}).where("d <= bound")
        # whoever has found all codes there are is done
        top = cut(top.withColumn("bound", F.when(F.col("codes") == count, -1).otherwise(F.col("bound"))))
        last = radii[-1] == width and some[-1] == m - 1
        done.append((top if last else top.where(F.col("bound") <= proved)).select("q", "code", "d"))
        if last:
            break
        best = top.where(F.col("bound") > proved).select("q", "code", "first", "size", "d")
        reach = top.groupBy("q").agg(F.min("bound").alias("b"))
        open_ = cut(open_.select("q").join(reach, "q", "left").select("q", F.coalesce("b", F.lit(BITS)).alias("bound")).where(F.col("bound") > proved))
        if open_.isEmpty():
            break
    near = done[0]
    for more in done[1:]:
        near = near.unionByName(more)
    asked = asked.withColumnRenamed("code", "q")
    answers = asked.join(near, "q").select("query_id", "code", "d").join(entries, "code").select("query_id", "d", F.explode("ids").alias("neighbor_id")).where("neighbor_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("d", "neighbor_id"))
    return answers.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "neighbor_id", F.col("d").alias("distance"))


def codes_of(embeddings: DataFrame) -> DataFrame:
    """(id, code) from vec_id and embedding."""
    return need(embeddings, "vec_id", "embedding").select(F.col("vec_id").cast("long").alias("id"), F.when(F.col("embedding").isNotNull(), sign_code(F.col("embedding"))).alias("code"))
