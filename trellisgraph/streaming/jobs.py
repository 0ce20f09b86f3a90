"""Streams: incremental ingest by content hash, keyed merges, and windowed counts with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from trellisgraph.operators import write


def text_stream(spark: SparkSession, folder: str) -> DataFrame:
    """New text files of a folder as rows (source, text, at)."""
    raw = spark.readStream.format("text").option("wholetext", True).load(folder)
    return raw.select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("text"), F.col("_metadata.file_modification_time").alias("at"))


def unseen_texts(texts: DataFrame, delay: str = "7 days") -> DataFrame:
    """Each content once within the watermark; state older than it is dropped."""
    return texts.withColumn("content_hash", F.sha2("text", 256)).withWatermark("at", delay).dropDuplicatesWithinWatermark(["content_hash"])


def ingest(texts: DataFrame, log_path: str, out_path: str, checkpoint: str, extract=None) -> StreamingQuery:
    """Writes what ``extract`` gives for texts that the log lacks, then appends them to the log, batch by batch.

    The batch number is part of both paths, so a batch that is run again after a failure replaces its own output.
    """

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        log = spark.read.schema("name string, source string, batch long").parquet(log_path) if _exists(spark, log_path) else spark.createDataFrame([], "name string, source string, batch long")
        fresh = write.unseen(batch, log.where(F.col("batch") < number)).dropDuplicates(["content_hash"])
        (extract(fresh) if extract else fresh).write.mode("overwrite").parquet(f"{out_path}/batch={number}")
        fresh.select(F.col("content_hash").alias("name"), "source").write.mode("overwrite").parquet(f"{log_path}/batch={number}")

    return texts.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def events_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The events of a folder as a stream; ``ts`` as a timestamp, which watermarks need."""
    return spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, size: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    w = events.withWatermark("ts", delay) if events.isStreaming else events
    return w.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, size: str = "2 hours", step: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    w = events.withWatermark("ts", delay) if events.isStreaming else events
    return w.groupBy(F.window("ts", size, step)).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    w = events.withWatermark("ts", delay) if events.isStreaming else events
    return w.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def to_memory(df: DataFrame, name: str, mode: str = "append") -> StreamingQuery:
    """Runs a stream over what is there now into an in-memory table."""
    return df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
