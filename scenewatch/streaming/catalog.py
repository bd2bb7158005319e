"""The catalog and the queue as streams: new files in, state that stays small."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from scenewatch.functions.times import LOOK_BACK_DAYS
from scenewatch.operators.job_queue import settle_queue
from scenewatch.operators.planning import plan_jobs
from scenewatch.operators.selection import best_scene_per_tile

SCENE = "tile_id STRING, captured_at TIMESTAMP, date DATE, scene_id STRING, safe_name STRING, img_data_path STRING, cloud DOUBLE, nodata_pct DOUBLE, min_x DOUBLE, min_y DOUBLE, max_x DOUBLE, max_y DOUBLE"


def stream_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Scenes from JSON files as they come; a scene id counts once within the look-back, later ones are dropped."""
    rows = spark.readStream.schema(SCENE).json(path)
    return rows.withWatermark("captured_at", f"{LOOK_BACK_DAYS} days").dropDuplicatesWithinWatermark(["scene_id"])


def merge_best(batch: DataFrame, table: str, number: int) -> None:
    """Puts a batch's best scenes into the table of the best so far: version `number` is written beside the last.

    Writing a version is repeatable, so a batch that runs again after a failure leaves the same table.
    """
    spark = batch.sparkSession
    last = [n for n in versions(spark, table) if n < number]
    rows = batch if not last else batch.unionByName(spark.read.schema(batch.schema).parquet(f"{table}/v={max(last)}"))
    best_scene_per_tile(rows).select(*batch.columns).write.mode("overwrite").parquet(f"{table}/v={number}")


def versions(spark: SparkSession, table: str) -> list[int]:
    """The finished versions of a table, by the folders' names in whatever store it is in."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(table)
    fs = path.getFileSystem(conf)
    if not fs.exists(path):
        return []
    done = [str(s.getPath().getName()) for s in fs.listStatus(path) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return sorted(int(n[2:]) for n in done if n.startswith("v="))


def best_scenes(spark: SparkSession, table: str) -> DataFrame:
    """The best scene of each tile after the last finished batch."""
    found = versions(spark, table)
    if not found:
        raise ValueError(f"no batch has been written to {table}")
    return spark.read.schema(SCENE).parquet(f"{table}/v={found[-1]}")


def stream_best_scene(scenes: DataFrame, table: str, checkpoint: str) -> DataStreamWriter:
    """Keeps the best scene of each tile in a table as scenes come."""
    return scenes.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, number: merge_best(batch, table, number))


def stream_jobs(queue: DataFrame, scenes: DataFrame, plans: str, results: str, checkpoint: str) -> DataStreamWriter:
    """Plans each batch of requests against the catalog; those for which scenes were found become results."""

    def of(batch: DataFrame, number: int) -> None:
        planned = plan_jobs(batch, scenes).select("job_id", "scene_id")
        planned.write.mode("overwrite").parquet(f"{plans}/batch={number}")
        found = batch.sparkSession.read.parquet(f"{plans}/batch={number}").select("job_id").distinct()
        _, done = settle_queue(batch, batch, found, F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm"))
        done.write.mode("overwrite").parquet(f"{results}/batch={number}")

    return queue.writeStream.option("checkpointLocation", checkpoint).foreachBatch(of)


def scene_counts_by_window(scenes: DataFrame, length: str = "5 days", start: str | None = None) -> DataFrame:
    """(tile_id, from, to, n): scenes of each tile in tumbling windows; a stream needs its watermark set."""
    w = F.window("captured_at", length, length, start) if start else F.window("captured_at", length)
    return scenes.groupBy("tile_id", w.alias("w")).agg(F.count("*").alias("n")).select("tile_id", F.col("w.start").alias("from"), F.col("w.end").alias("to"), "n")
