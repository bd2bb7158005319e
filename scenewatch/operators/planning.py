"""From requests to scenes: range, spatial and as-of joins, and what is counted on the way."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from scenewatch.functions.geo import envelopes_touch
from scenewatch.functions.names import scene_key, scene_label
from scenewatch.functions.times import build_intervals

BOX = ("min_x", "min_y", "max_x", "max_y")
BUCKET_DAYS = 8


def day_bucket(day: Column) -> Column:
    return F.floor(F.datediff(day, F.lit("1970-01-01")) / BUCKET_DAYS)


def day_nodes(first: Column, last: Column, levels: int) -> Column:
    """Nodes (level, at) of a tree of days, 8 children a node, that cover first..last exactly: at most 14 a level below the top one."""
    low, high = F.unix_date(first), F.unix_date(last) + 1

    def at_level(k: int) -> Callable[[Column], Column]:
        return lambda at: F.struct(F.lit(k).alias("level"), at.alias("at"))

    def span(a: Column, b: Column) -> Column:
        return F.when(a < b, F.sequence(a, b - 1)).otherwise(F.array().cast("array<int>"))

    out = []
    for k in range(levels):
        size, up = 8**k, 8 ** (k + 1)
        a, b = F.ceil(low / size).cast("int"), F.floor(high / size).cast("int")
        above, below = F.ceil(low / up).cast("int"), F.floor(high / up).cast("int")
        here = span(a, b) if k == levels - 1 else F.when(above < below, F.concat(span(a, 8 * above), span(8 * below, b))).otherwise(span(a, b))
        out.append(F.transform(here, at_level(k)))
    return F.concat(*out)


def plan_jobs(jobs: DataFrame, scenes: DataFrame, start: str = "start", end: str = "end", most: int = 100_000, sent: int = 100_000, alike: int = 1000, even: int = 1000, chunk: int = 1000) -> DataFrame:
    """Each job with every scene of its days, both ends included, with at most its cloud.

    Jobs of one period and cloud have the same scenes: some `alike` of them go through the join as one bundle, and are told apart after
    it, so that the join's work is that of distinct requests and only the pairs themselves grow with both tables.
    A period is cut into nodes of a tree of days, and a scene lies in one node of each level, so an equality join meets exactly the scenes of
    the period; levels are as many as the longest period needs, two for up to 63 days. Up to `sent` jobs, counted first, go to
    every task; up to `even` of them leave scenes where they are, more make so many pairs a scene that scenes are dealt out evenly first,
    in chunks of one day, some `chunk` scenes or fewer if tasks would have less than 8 chunks: a bundle meets a whole chunk, so that its jobs come again and again with few scenes between, and
    a columnar file holds runs and repeats instead of a number for each pair. More jobs are joined by a shuffle, in which a day of over
    `most` scenes is parted by a hash and its jobs go to each part; days are few whatever the data.
    """
    same = [start, end, "cloud"]
    n, longest, largest = jobs.groupBy(*same).agg(F.count("*").alias("n")).agg(F.sum("n"), F.max(F.datediff(end, start)), F.max("n")).first()
    levels = 1
    while 8**levels <= (longest or 0) + 1:
        levels += 1
    own = [c for c in jobs.columns if c not in same]
    hashed = [F.col(f"`{f.name}`") for f in jobs.schema if f.name in own and not isinstance(f.dataType, (MapType, VariantType))]
    salt = F.pmod(F.xxhash64(*hashed), F.lit(-(-(largest or 1) // alike))) if hashed else F.lit(0)
    bundles = jobs.groupBy(*same, salt.alias("_salt")).agg(F.collect_list(F.struct(*[F.col(f"`{c}`") for c in own or same])).alias("_jobs"))
    node = lambda level, at: at.cast("long") * 32 + level
    nodes = bundles.select(*same, "_salt", "_jobs", F.explode(day_nodes(F.col(start), F.col(end), levels)).alias("_d")).select("*", node(F.col("_d.level"), F.col("_d.at")).alias("_n")).drop("_d").withColumnRenamed("cloud", "cloud_limit")
    at = lambda day: F.array(*[node(F.lit(k), F.floor(day / 8**k)) for k in range(levels)])
    day = F.unix_date("date")
    dated = scenes.where("date is not null").withColumn("_n", F.explode(at(day)))
    days = scenes.where("date is not null").groupBy(day.alias("_day")).agg(F.count("*").alias("n"))
    named = [c for c in ("captured_at", "tile_id", "img_data_path", "date") if c in scenes.columns]
    if (n or 0) <= min(even, sent):
        near = F.broadcast(nodes).alias("j").join(dated.alias("s"), "_n")
    elif n <= sent:
        sizes = {r[0]: r[1] for r in days.collect()}
        tasks = int(scenes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        each = max(1, min(chunk, sum(sizes.values()) // (8 * tasks)))
        counts = [(k, -(-v // each)) for k, v in sizes.items()]
        tasks = max(tasks, sum(v for _, v in counts) // 100)  # a task holds its scenes: some 100 chunks
        chunks = scenes.sparkSession.createDataFrame(counts, "_day int, _parts int")
        dealt = scenes.withColumn("_day", day).join(F.broadcast(chunks), "_day").withColumn("_c", F.pmod(F.xxhash64(*named), "_parts").cast("int")).repartition(tasks, "_day", "_c")
        spots = chunks.select("_day", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_c")).repartition(tasks, "_day", "_c").withColumn("_n", F.explode(at(F.col("_day"))))
        spots = spots.join(F.broadcast(nodes), "_n").alias("j")
        near = spots.join(dealt.hint("shuffle_hash").alias("s"), (F.col("j._day") == F.col("s._day")) & (F.col("j._c") == F.col("s._c")))
    else:
        busy = days.withColumn("_n", F.explode(at(F.col("_day")))).groupBy("_n").agg(F.ceil(F.sum("n") / most).cast("int").alias("_parts")).where("_parts > 1")
        parts = F.broadcast(busy)  # nodes of a calendar, not of scenes
        dealt = nodes.join(parts, "_n", "left").withColumn("_p", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
        part = F.pmod(F.xxhash64(*named), F.coalesce("_parts", F.lit(1))).cast("int")
        near = dealt.alias("j").join(dated.join(parts, "_n", "left").withColumn("_p", part).drop("_parts").alias("s"), ["_n", "_p"])
    theirs = [F.col(f"s.`{c}`") for c in scenes.columns]
    pairs = near.where(F.col("s.cloud") <= F.col("j.cloud_limit")).select(F.explode("j._jobs").alias("_job"), *[F.col(f"j.`{c}`").alias(f"_{k}") for k, c in enumerate([start, end, "cloud_limit"])], *theirs)
    whose = {start: F.col("_0").alias(start), end: F.col("_1").alias(end), "cloud": F.col("_2").alias("cloud_limit")}
    return pairs.select(*[whose.get(c, F.col(f"_job.`{c}`")) for c in jobs.columns], *[F.col(f"`{c}`") for c in scenes.columns])


def scenes_in_boxes(scenes: DataFrame, areas: DataFrame, cell: float = 1.0) -> DataFrame:
    """Each area with the scenes whose envelopes touch its own: a join on grid cells, then the exact test.

    Both sides are spread over the cells they cover; a pair counts once, in the cell of its common lower corner.
    """

    def cells(df: DataFrame) -> DataFrame:
        x = F.explode(F.sequence(F.floor(F.col("min_x") / cell), F.floor(F.col("max_x") / cell))).alias("_cx")
        return df.select("*", x).select("*", F.explode(F.sequence(F.floor(F.col("min_y") / cell), F.floor(F.col("max_y") / cell))).alias("_cy"))

    a, s = cells(areas).alias("a"), cells(scenes).alias("s")
    both = a.join(s, (F.col("a._cx") == F.col("s._cx")) & (F.col("a._cy") == F.col("s._cy")))
    sides = [{n: F.col(f"{k}.{n}") for n in BOX} for k in ("a", "s")]
    corner = (F.floor(F.greatest("a.min_x", "s.min_x") / cell) == F.col("a._cx")) & (F.floor(F.greatest("a.min_y", "s.min_y") / cell) == F.col("a._cy"))
    extra = [F.col(f"a.{c}") for c in areas.columns if c not in BOX]
    return both.where(envelopes_touch(*sides) & corner).select(*extra, *[F.col(f"s.{c}") for c in scenes.columns])


def pair_scenes(new: DataFrame, base: DataFrame) -> DataFrame:
    """(tile_id, new_key, new_at, base_key, base_at): for each new scene the latest base strictly before it.

    If none is before it, the latest base of the tile at all; tiles without a base give nulls. Equal times go to the
    lesser key. The work is that of sorting, not of pairing, and no task sorts a whole tile: scenes are sorted inside
    spans of a few days, and the last base of earlier spans is carried over by a window over the spans of a tile.
    """
    key = scene_key()
    span = day_bucket(F.col("captured_at").cast("date"))
    n = new.select("tile_id", F.col("captured_at").alias("at"), key.alias("key"), F.lit(1).alias("is_new"), span.alias("span"))
    b = base.select("tile_id", F.col("captured_at").alias("at"), key.alias("key"), F.lit(0).alias("is_new"), span.alias("span"))
    own = F.struct("at", "key")
    latest_first = F.struct(-F.unix_micros(F.col("at").cast("timestamp")), F.col("key"))
    spans = b.groupBy("tile_id", "span").agg(F.min_by(own, latest_first).alias("last"))
    latest = spans.groupBy("tile_id").agg(F.max_by("last", "span").alias("latest"))
    # at equal times the new one comes first: a base must be strictly before it
    ordered = Window.partitionBy("tile_id", "span").orderBy("at", F.desc("is_new"), F.desc("key")).rowsBetween(Window.unboundedPreceding, 0)
    before = F.last(F.when(F.col("is_new") == 0, own), ignorenulls=True).over(ordered)
    found = n.unionByName(b).withColumn("before", before).where("is_new = 1")
    known = n.select("tile_id", "span").unionByName(spans.select("tile_id", "span")).distinct().join(spans, ["tile_id", "span"], "left")
    earlier = Window.partitionBy("tile_id").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    carried = known.withColumn("carried", F.last("last", ignorenulls=True).over(earlier)).select("tile_id", "span", "carried")
    out = found.join(carried, ["tile_id", "span"], "left").join(latest, "tile_id", "left").withColumn("_base", F.coalesce("before", "carried", "latest"))
    return out.select("tile_id", F.col("key").alias("new_key"), F.col("at").alias("new_at"), F.col("_base.key").alias("base_key"), F.col("_base.at").alias("base_at"))


def pair_dedup(pairs: DataFrame) -> DataFrame:
    """Each pair of scenes once; new scenes without a base are dropped."""
    return pairs.where("base_key is not null").dropDuplicates(["new_key", "base_key"])


def common_tiles(a: DataFrame, b: DataFrame) -> DataFrame:
    """The tiles that both periods have."""
    return a.select("tile_id").distinct().join(b.select("tile_id").distinct(), "tile_id")


def require_tiles(required: DataFrame, selected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(selected scenes of required tiles, required tiles that have none)."""
    return selected.join(required, "tile_id", "left_semi"), required.join(selected, "tile_id", "left_anti")


def interval_pick(scenes: DataFrame, n: int, start: Column, end: Column) -> DataFrame:
    """(scene columns, i): for each tile and each of n slices of the period the least cloudy scene, latest on ties.

    A slice without a scene takes the one nearest to its middle, the least cloudy on ties, then in time order. Scenes
    are reduced in their own slice first, to its pick and its first and last one, before they are shuffled; an empty
    slice then chooses between the last scene before it and the first one after it.
    """
    slices = build_intervals(start, end, n)
    at = F.unix_micros(F.col("captured_at").cast("timestamp"))
    # -1 before the period, n after it
    own = F.when(at < slices[0]["from_us"], -1).otherwise(F.size(F.filter(slices, lambda s: s["to_us"] <= at)))
    row = F.struct(*[F.col(f"`{c}`") for c in scenes.columns]).alias("_row")
    rows = scenes.where(at.isNotNull()).select("tile_id", own.alias("i"), at.alias("_at"), "cloud", scene_key().alias("_key"), F.col("img_data_path").alias("_path"), row)
    last_ones = (F.col("cloud"), F.col("_key"), F.col("_path"))

    def least(*order: Column) -> Column:
        return F.min_by(F.struct("_at", "cloud", "_key", "_path", "_row"), F.struct(*[c.alias(f"c{k}") for k, c in enumerate(order)]))

    each = rows.groupBy("tile_id", "i").agg(least(F.col("cloud"), -F.col("_at"), F.col("_key"), F.col("_path")).alias("pick"), least(F.col("_at"), *last_ones).alias("first"), least(-F.col("_at"), *last_ones).alias("last"))
    wanted = each.select("tile_id").distinct().select("tile_id", F.explode(F.sequence(F.lit(-1), F.lit(n))).alias("i"))
    by = Window.partitionBy("tile_id").orderBy("i")
    full = wanted.join(each, ["tile_id", "i"], "left").withColumns({
        "before": F.last("last", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1)),
        "after": F.first("first", ignorenulls=True).over(by.rowsBetween(1, Window.unboundedFollowing)),
    }).where(F.col("i").between(0, n - 1))
    slot = F.element_at(slices, F.col("i") + 1)
    middle = F.floor((slot["from_us"] + slot["to_us"]) / 2)
    sides = [F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(f"{c}._at") - middle).alias("far"), F.col(f"{c}.cloud"), F.col(f"{c}._at"), F.col(f"{c}._key"), F.col(f"{c}._path"), F.col(f"{c}._row"))) for c in ("before", "after")]
    # nothing orders rows by _row: before and after differ in time
    nearer = F.when(sides[0].isNull(), sides[1]["_row"]).when(sides[1].isNull() | (sides[0]["far"] < sides[1]["far"]), sides[0]["_row"])
    nearer = nearer.when(sides[0]["far"] > sides[1]["far"], sides[1]["_row"]).when(sides[1]["cloud"] < sides[0]["cloud"], sides[1]["_row"]).otherwise(sides[0]["_row"])
    chosen = full.select(F.coalesce("pick._row", nearer).alias("_row"), "i").where("_row is not null")
    return chosen.select("_row.*", "i")


def is_time_series(preprocess: Column, channels: Column) -> Column:
    """Identity models all of whose channels begin with NDVI."""
    return (F.lower(F.trim(preprocess)) == "identity") & (F.size(channels) > 0) & F.forall(channels, lambda c: F.upper(F.trim(c)).startswith("NDVI"))


def catalog_level(preprocess: Column, has_l2a: bool = True) -> Column:
    return F.when((F.lower(F.trim(preprocess)) == "sentinel2a") & F.lit(has_l2a), "L2A").otherwise("L1C")


def validate_jobs(jobs: DataFrame, specs: DataFrame, polygons: DataFrame) -> DataFrame:
    """Jobs with the first thing wrong with each as `error`, null where nothing is.

    jobs: model, polygon_id, cloud (null: 50), start, end, start2, end2, year, year2. specs: model, inputs, season.
    polygons: polygon_id, public; only 1 and 2 may be asked for.
    """
    known = jobs.join(specs.select("model", F.lit(True).alias("_m"), "inputs", "season"), "model", "left")
    known = known.join(polygons.where("public in (1, 2)").select("polygon_id", F.lit(True).alias("_p")), "polygon_id", "left")
    two, seasonal = F.coalesce("inputs", F.lit(1)) == 2, F.coalesce("season", F.lit("")) != ""
    error = (
        F.when(F.col("_m").isNull(), "unknown model")
        .when(F.col("_p").isNull(), "no such area")
        .when(~F.coalesce("cloud", F.lit(50)).between(0, 100), "cloud out of range")
        .when(seasonal & (F.coalesce("year", F.lit(0)) == 0), "no year")
        .when(seasonal & two & (F.coalesce("year2", F.lit(0)) == 0), "no base year")
        .when(seasonal & two & (F.col("year") == F.col("year2")), "years are the same")
        .when(~seasonal & (F.col("start").isNull() | F.col("end").isNull()), "no dates")
        .when(~seasonal & two & (F.col("start2").isNull() | F.col("end2").isNull()), "no base dates")
    )
    return known.withColumn("error", error).drop("_m", "_p", "inputs", "season")


def visible_polygons(polygons: DataFrame, is_admin: bool) -> DataFrame:
    return polygons if is_admin else polygons.where("public = 2")


def run_counters(jobs: DataFrame, seen: DataFrame, inside: DataFrame, paired: DataFrame) -> DataFrame:
    """Per job: scenes seen, outside its area, without a base, and pairs to process; jobs without scenes count 0."""

    def count(df: DataFrame, name: str, where: str = "true") -> DataFrame:
        return df.groupBy("job_id").agg(F.count_if(F.expr(where)).alias(name))

    out = jobs.select("job_id").join(count(seen, "seen"), "job_id", "left").join(count(inside, "inside"), "job_id", "left").join(count(paired, "processed", "base_key is not null"), "job_id", "left").join(count(paired, "misses", "base_key is null"), "job_id", "left")
    n = {c: F.coalesce(c, F.lit(0)) for c in ("seen", "inside", "processed", "misses")}
    return out.select("job_id", n["seen"].alias("seen"), (n["seen"] - n["inside"]).alias("skipped_outside"), n["misses"].alias("misses"), n["processed"].alias("processed"))


def sorted_labels(scenes: DataFrame, by: str = "job_id") -> DataFrame:
    """(by, labels): the sorted labels of each run's scenes."""
    return scenes.groupBy(by).agg(F.array_sort(F.collect_set(scene_label())).alias("labels"))

