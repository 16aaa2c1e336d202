"""Progress and answers as streams (CNV-06, CNV-07): file source in, transitions and counts out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans import contract as C
from ..registry import query


def events_stream(spark: SparkSession, path: str) -> DataFrame:
    """An append-only folder of event files as a stream; one file a trigger, so that a start on old data is bounded too."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def progress(events: DataFrame, late: str = "10 minutes", window: str = "1 day") -> DataFrame:
    """Events by day and type; a watermark closes windows and drops state. Runs alike on a stream and a table."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def follow(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update") -> StreamingQuery:
    """Sends each micro-batch to sink until what is there now is read."""
    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()


@query("cnv_06_daily_progress", "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def daily_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progress(C.table(spark, sf_dir, "events"))


@query("cnv_06_sessions", "SELECT user_id, count(*) AS sessions FROM (SELECT user_id, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL OR ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 1 END AS opens FROM events) WHERE opens = 1 GROUP BY user_id")
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a user starts anew after six quiet hours."""
    e = C.table(spark, sf_dir, "events")
    return e.groupBy("user_id", F.session_window("ts", "6 hours")).agg(F.count(F.lit(1)).alias("n")).groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"))
