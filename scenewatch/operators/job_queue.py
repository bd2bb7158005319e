"""The queue of requests and the list of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenewatch.functions.times import LISTING_LAYOUTS, QUEUE_LAYOUTS, RESULT_LAYOUTS, format_date, parse_time_multi

DASH = "—"


def queue_time(text: Column) -> Column:
    """When a request was made; a time that cannot be read is the oldest."""
    return F.coalesce(parse_time_multi(text, QUEUE_LAYOUTS), F.lit("1970-01-01").cast("timestamp"))


def oldest_job(queue: DataFrame, key: str = "job_id") -> DataFrame:
    """The request that has waited longest, the least key on ties."""
    return queue.orderBy(queue_time(F.col("time")), key).limit(1)


def newest_first(results: DataFrame) -> DataFrame:
    """Results by time, newest first; those without a readable time last."""
    return results.orderBy(parse_time_multi(F.col("time"), LISTING_LAYOUTS).desc_nulls_last())


def enrich_jobs(jobs: DataFrame, specs: DataFrame, polygons: DataFrame) -> DataFrame:
    """Requests as people read them: the model's and the area's names, else their keys, else a dash; dates by day."""
    rows = jobs.join(specs.select("model", "description"), "model", "left").join(polygons.select("polygon_id", "name"), "polygon_id", "left")
    shown = {c: format_date(F.col(c).cast("string")) for c in ("start", "end", "start2", "end2", "time") if c in jobs.columns}
    return rows.withColumns(
        {
            "model": F.coalesce("description", "model", F.lit(DASH)), "area": F.coalesce("name", F.col("polygon_id").cast("string"), F.lit(DASH)),
            "cloud": F.coalesce(F.concat(F.col("cloud").cast("string"), F.lit("%")), F.lit(DASH)), "raw_time": F.col("time"), **shown,
        }
    ).drop("description", "name", "polygon_id")


def settle_queue(queue: DataFrame, processed: DataFrame, artifacts: DataFrame, finished: Column, key: str = "job_id") -> tuple[DataFrame, DataFrame]:
    """(what stays in the queue, new results): finished requests leave; those with an artifact become results, stamped."""
    left = queue.join(processed.select(key), key, "left_anti")
    done = queue.join(processed.select(key), key, "left_semi").join(artifacts.select(key), key, "left_semi")
    return left, done.withColumn("time", finished)


def prune_results(results: DataFrame, now: Column, days: int = 30) -> tuple[DataFrame, DataFrame]:
    """(results that stay, those removed): older than so many days; times that cannot be read stay."""
    old = F.coalesce(parse_time_multi(F.col("time"), RESULT_LAYOUTS) < now - F.expr(f"interval {int(days)} days"), F.lit(False))
    return results.where(~old), results.where(old)


def sorted_options(models: DataFrame, polygons: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Models by description and areas by name without regard to case."""
    return models.orderBy("description"), polygons.orderBy(F.lower("name"))
