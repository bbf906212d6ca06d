"""Running totals of tasks from a stream of finished sites."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from dramatis.sources.scratch import shared_folder

SITE_EVENT = "task_id string, url string, status string, contacts_count long"


def running_totals(events: DataFrame) -> DataFrame:
    """Per task: processed, ok, errors, contacts so far."""
    return events.groupBy("task_id").agg(
        F.count(F.lit(1)).alias("processed"), F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") != "ok").alias("errors"), F.coalesce(F.sum("contacts_count"), F.lit(0)).alias("contacts")
    )


def read_events(spark: SparkSession, path: str, schema: str | StructType = SITE_EVENT, files_per_trigger: int = 4) -> DataFrame:
    """Finished sites as they arrive; at most so many files a trigger, which bounds the work in flight."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def publish_totals(events: DataFrame, checkpoint: str, publish: Callable[[DataFrame, int], None], available_now: bool = True) -> StreamingQuery:
    """Hand the changed totals of each trigger to ``publish``. Stopping the query pauses a task; starting it again with the same checkpoint resumes."""
    writer = running_totals(events).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(publish)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def recovered(sites: DataFrame) -> DataFrame:
    """Sites after a crash: what was being processed is pending again."""
    return sites.withColumn("status", F.when(F.col("status") == "processing", "pending").otherwise(F.col("status")))


def resumable(sites: DataFrame, finished: DataFrame) -> DataFrame:
    """Sites of which no result is stored yet."""
    return sites.join(finished.select("task_id", "url").distinct(), ["task_id", "url"], "left_anti")


def totals_of_stream(sites: DataFrame, files_per_trigger: int = 4) -> DataFrame:
    """Write finished sites as a stream's input, run the stream to its end, and give the last totals of each task."""
    spark = sites.sparkSession
    root = f"{shared_folder(spark)}/totals-{uuid.uuid4().hex}"
    schema = sites.select("task_id", "url", "status", "contacts_count").schema
    sites.select(*schema.names).write.parquet(f"{root}/in")
    publish_totals(read_events(spark, f"{root}/in", schema, files_per_trigger), f"{root}/checkpoint", lambda df, batch: df.write.mode("overwrite").parquet(f"{root}/out/batch={batch}")).awaitTermination()
    out = spark.read.parquet(f"{root}/out")
    last = F.max_by(F.struct("processed", "ok", "errors", "contacts"), "processed")
    return out.groupBy("task_id").agg(last.alias("t")).select("task_id", "t.*")
