"""Streaming forms: cleaned cues without repeats and windowed counts of arriving cues.

The transforms are the batch ones; state is bounded by watermarks on the time
of arrival. Deliveries of a cue already seen within the watermark are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidecue.functions import text


def read_cues(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 8) -> DataFrame:
    """Cues of a folder of parquet files, or of one file, a few files per batch."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if [f.rstrip("/").rsplit("/", 1)[-1] for f in spark.read.parquet(path).inputFiles()] == [path.rstrip("/").rsplit("/", 1)[-1]]:
        folder, name = path.rstrip("/").rsplit("/", 1)
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def once(cues: DataFrame, key: str = "cue_id", arrived: str = "ingested_at", late: str = "7 days") -> DataFrame:
    """Cues without repeated deliveries, as far back as the watermark."""
    timed = cues.withColumn(arrived, F.col(arrived).cast("timestamp"))
    return timed.withWatermark(arrived, late).dropDuplicatesWithinWatermark([key])


def clean(cues: DataFrame) -> DataFrame:
    """Cues with markup and known garbling put right; stateless."""
    return cues.withColumn("text", text.squeeze(text.repair_encoding(text.strip_markup(F.col("text"), entities=False))))


def arrivals(cues: DataFrame, window: str = "1 day", late: str = "7 days", arrived: str = "ingested_at") -> DataFrame:
    """(window_start, workspace, n_cues, shown_ms) per tumbling window of arrival.

    A window is given once the watermark has passed it, and its state is
    dropped then. Rows later than that are left out.
    """
    timed = cues.withColumn(arrived, F.col(arrived).cast("timestamp")).withWatermark(arrived, late)
    counted = timed.groupBy(F.window(arrived, window).alias("w"), "workspace").agg(F.count(F.lit(1)).alias("n_cues"), F.sum(F.greatest(F.coalesce(F.col("end_ms") - F.col("start_ms"), F.lit(0)), F.lit(0))).alias("shown_ms"))
    return counted.select(F.col("w.start").alias("window_start"), "workspace", "n_cues", "shown_ms")


def drain(stream: DataFrame, folder: str, trigger_once: bool = True) -> DataFrame:
    """Write a stream's rows to folder/rows as parquet, with its progress in folder/progress, and read what was written.

    Files are written by the tasks, so nothing comes to the driver, and a run
    begun again over the same folder goes on where it stopped. With
    trigger_once the stream ends when it has read what is there.
    """
    run = stream.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/progress")
    run = (run.trigger(availableNow=True) if trigger_once else run).start()
    run.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")
