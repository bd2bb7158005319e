"""Resharding as a minimum-cost flow: move the fewest bytes from old shard sizes to new capacities.

The flow is solved over shards (a few dozen nodes); which documents move follows from positions inside each old shard,
counted in blocks of bounded size. Only documents of shards that lose or gain are rewritten.
"""

from __future__ import annotations

import heapq
import math
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StructType, VariantType

from scenewatch.llm.common import cut, need, shared_dir, until_exit, written

HEADER = 16


def doc_size(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus a fixed header."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + HEADER).cast("long")


def cheapest_flow(sizes: dict[int, int], capacities: Sequence[int], cost: Callable[[int, int], int] = lambda i, j: int(i != j)) -> dict[tuple[int, int], int]:
    """Bytes to send from each old shard to each new one: all of them, within the capacities, at the least total cost.

    Successive shortest augmenting paths with potentials. cost(i, j) is the price of a byte from i to j; as given, a
    byte that stays is free and one that moves costs one.
    """
    if sum(sizes.values()) > sum(capacities):
        raise ValueError("the new shards cannot hold all bytes")
    olds = sorted(sizes)
    left, room, flow = dict(sizes), dict(enumerate(capacities)), {}
    up, down = dict.fromkeys(olds, 0), dict.fromkeys(room, 0)
    for j in room:
        down[j] = min((cost(i, j) for i in olds), default=0)
    while any(left.values()):
        dist = {("o", i): -up[i] for i in olds if left[i]}
        base = min(dist.values())
        dist = {k: v - base for k, v in dist.items()}
        came, done, heap = {}, {}, [(d, k) for k, d in dist.items()]
        heapq.heapify(heap)
        while heap:
            d, node = heapq.heappop(heap)
            if node in done:
                continue
            done[node] = d
            side, x = node
            if side == "o":
                steps = [(("n", j), cost(x, j) + up[x] - down[j]) for j in room]
            else:
                steps = [(("o", i), -cost(i, x) + down[x] - up[i]) for i in olds if flow.get((i, x))]
            for to, price in steps:
                if to not in done and d + price < dist.get(to, math.inf):
                    dist[to] = d + price
                    came[to] = node
                    heapq.heappush(heap, (d + price, to))
        end = min((j for j in room if room[j]), key=lambda j: (done[("n", j)] + down[j], j))
        path = [("n", end)]
        while path[-1] in came:
            path.append(came[path[-1]])
        path.reverse()
        amount = min([left[path[0][1]], room[end], *(flow[(b[1], a[1])] for a, b in zip(path, path[1:]) if a[0] == "n")])
        for a, b in zip(path, path[1:]):
            key, sign = ((a[1], b[1]), 1) if a[0] == "o" else ((b[1], a[1]), -1)
            flow[key] = flow.get(key, 0) + sign * amount
        left[path[0][1]] -= amount
        room[end] -= amount
        far = max(done.values())
        for i in olds:
            up[i] += done.get(("o", i), far)
        for j in room:
            down[j] += done.get(("n", j), far)
    return {k: v for k, v in flow.items() if v}


def even(total: int, shards: int) -> list[int]:
    return [total // shards + (j < total % shards) for j in range(shards)]


def reshard(docs: DataFrame, old_shard: Column, shards: int = 40, capacities: Sequence[int] | None = None, block_bytes: int = 64 << 20) -> DataFrame:
    """(doc_id, size, text_crc32, old_shard, shard, slot): where each document goes.

    old_shard is the shard that holds a document now (null: shard 0); shards up to 0..shards-1 keep their number.
    capacities in bytes default to equal ones. A flow's share of an old shard is a run of its documents in hash order;
    the few documents across the ends of runs, at most one for each transfer, fill the remaining room, largest first.
    Slots count from 0 without gaps in each shard. An empty table gives no rows; rows with repeated or null ids are
    documents of their own. The driver holds one row a shard and one a transfer, never one a document or block.
    """
    spark = docs.sparkSession
    old = F.coalesce(old_shard.cast("int"), F.lit(0))
    base = docs.select("doc_id", doc_size(F.col("text")).alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), old.alias("old_shard"))
    base = written(base.withColumn("h", F.xxhash64("doc_id", "text_crc32", "size")), "shard-sizes")
    sizes = {r.old_shard: r.n for r in base.groupBy("old_shard").agg(F.sum("size").alias("n")).collect()}
    room = list(capacities) if capacities is not None else even(sum(sizes.values()), shards)
    flow = cheapest_flow(sizes, room)
    runs, blocks = [], []
    for i in sorted(sizes):
        ends, to = [], []
        for j in sorted((j for o, j in flow if o == i), key=lambda j: (j != i, j)):
            ends.append((ends[-1] if ends else 0) + flow[i, j])
            to.append(j)
        runs.append((i, ends, to, max(4, math.ceil(sizes[i] / block_bytes))))
    plan = F.broadcast(spark.createDataFrame(runs, "old_shard int, ends array<long>, targets array<int>, n_blocks int"))
    rows = base.join(plan.select("old_shard", "n_blocks"), "old_shard").withColumn("block", F.pmod("h", F.col("n_blocks")).cast("int")).drop("n_blocks")
    of_block = Window.partitionBy("old_shard", "block")
    sums = rows.groupBy("old_shard", "block").agg(F.sum("size").alias("bytes"))
    sums = sums.select("old_shard", "block", (F.sum("bytes").over(Window.partitionBy("old_shard").orderBy("block")) - F.col("bytes")).alias("before"))
    run = F.sum("size").over(of_block.orderBy("h", "doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, 0))
    at = rows.withColumn("run", run).join(sums, ["old_shard", "block"]).withColumn("start", F.col("before") + F.col("run") - F.col("size"))
    at = at.join(plan.select("old_shard", "ends", "targets"), "old_shard")
    at = at.withColumn("k", F.size(F.filter("ends", lambda e: e <= F.col("start"))))
    at = at.withColumn("shard", F.when(F.col("start") + F.col("size") <= F.element_at("ends", F.col("k") + 1), F.element_at("targets", F.col("k") + 1)))
    at = written(at.select("doc_id", "size", "text_crc32", "h", "old_shard", "block", "start", "shard"), "shard-runs")
    for r in at.where("shard is not null").groupBy("shard").agg(F.sum("size").alias("n")).collect():
        room[r.shard] -= r.n
    placed = []
    for r in sorted(at.where("shard is null").select("old_shard", "start", "size").collect(), key=lambda r: (-r["size"], r.old_shard, r.start)):
        j = max(range(len(room)), key=lambda j: (room[j], -j))
        room[j] -= r["size"]
        placed.append((r.old_shard, r.start, j))
    across = F.broadcast(spark.createDataFrame(placed, "old_shard int, start long, other int"))
    full = at.join(across, ["old_shard", "start"], "left").withColumn("shard", F.coalesce("shard", "other"))
    inside = Window.partitionBy("old_shard", "block", "shard").orderBy("h", "doc_id", "start")
    counts = full.groupBy("shard", "old_shard", "block").agg(F.count("*").alias("n"))
    first = counts.select("shard", "old_shard", "block", (F.sum("n").over(Window.partitionBy("shard").orderBy("old_shard", "block")) - F.col("n")).alias("first"))
    slotted = full.withColumn("nth", F.row_number().over(inside) - 1).join(first, ["old_shard", "block", "shard"])
    return slotted.select("doc_id", "size", "text_crc32", "old_shard", "shard", (F.col("first") + F.col("nth")).alias("slot"))


#: What tells documents apart where ids repeat or are null: all but `_copy`, which counts rows alike in these.
KEY = ["_none", "_id", "_size", "_crc", "_old"]


def keyed(rows: DataFrame, size: Column, crc: Column, old: Column, *keep: str | Column) -> DataFrame:
    id_ = F.col("doc_id")
    return rows.select(*keep, id_.isNull().alias("_none"), F.coalesce(id_.cast("string"), F.lit("")).alias("_id"), size.alias("_size"), crc.alias("_crc"), old.alias("_old"))


def rewrite(docs: DataFrame, plan: DataFrame, root: str, old_shard: Column | None = None) -> list[int]:
    """Writes the shards of a plan that lose or gain documents to root/shard=N, in slot order; returns their numbers.

    docs and plan meet on doc_id (null or not), text and, as given to reshard(), old_shard, and rows alike in these by a
    copy number, so each document is written once. Without old_shard rows of one id and text in several shards are
    taken as alike. Columns shard and slot of docs, if there, make way for the new ones; all others are kept. Other shards' files are left alone; those of affected shards are replaced, and removed where the
    shard has nothing left, so docs must be read from elsewhere.
    """
    spark = docs.sparkSession
    moved = plan.where("old_shard <> shard").select(F.explode(F.array("old_shard", "shard")).alias("shard")).distinct()
    affected = sorted(r.shard for r in moved.collect())
    if not affected:
        return affected
    old = F.coalesce(old_shard.cast("int"), F.lit(0)) if old_shard is not None else F.lit(0)
    fields = [f for f in docs.schema if f.name not in ("shard", "slot")]
    hashed = [F.col(f"`{f.name}`") for f in fields if f.name != "text" and not isinstance(f.dataType, (MapType, VariantType))]
    doc = F.struct(*[F.col(f"`{f.name}`") for f in fields]).alias("_doc")
    own = keyed(docs, doc_size(F.col("text")), F.crc32(F.coalesce("text", F.lit("")).cast("binary")), old, doc, F.xxhash64(*hashed).alias("_rest"))
    place = keyed(plan, F.col("size"), F.col("text_crc32"), F.col("old_shard") if old_shard is not None else F.lit(0), "shard", "slot")
    often = cut(place.groupBy(*KEY).count().where("count > 1").select(*KEY))
    here = F.col("shard").isin(affected)
    if often.isEmpty():
        rows = own.join(place.where(here), KEY)
    else:
        alike = Window.partitionBy(*KEY)
        many = own.join(often, KEY, "left_semi").withColumn("_copy", F.row_number().over(alike.orderBy("_rest")))
        spots = place.join(often, KEY, "left_semi").withColumn("_copy", F.row_number().over(alike.orderBy("shard", "slot")))
        rows = own.join(place.where(here).join(often, KEY, "left_anti"), KEY).unionByName(many.join(spots.where(here), [*KEY, "_copy"]).drop("_copy"))
    rows = rows.select("_doc.*", "slot", "shard")
    rows.sortWithinPartitions("shard", "slot").write.option("partitionOverwriteMode", "dynamic").partitionBy("shard").mode("overwrite").parquet(root)
    for j in set(affected) - {r.shard for r in plan.select("shard").distinct().collect()}:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/shard={j}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return affected


def resharded(docs: DataFrame, old_shard: Column, shards: int = 40) -> DataFrame:
    """The rows of reshard(), those of affected shards read back from the files that rewrite() made of them.

    The files go when the application ends.
    """
    if clashing := {"shard", "slot"} & set(docs.columns):  # they would give way in the files, and old_shard may name them
        docs, old_shard = docs.withColumn("_old_shard", old_shard).drop(*clashing), F.col("_old_shard")
    plan = written(reshard(docs, old_shard, shards), "shard-plan")
    root = f"{shared_dir(docs.sparkSession)}/shards-{uuid.uuid4().hex}"
    affected = rewrite(docs, plan, root, old_shard)
    if not affected:
        return plan
    until_exit(docs.sparkSession, root)
    fields = StructType([*docs.schema.fields, plan.schema["slot"], plan.schema["shard"]])
    back = docs.sparkSession.read.schema(fields).parquet(root)
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32")
    found = back.select("doc_id", doc_size(F.col("text")).alias("size"), crc, F.coalesce(old_shard.cast("int"), F.lit(0)).alias("old_shard"), "shard", "slot")
    return found.unionByName(plan.where(~F.col("shard").isin(affected)))
