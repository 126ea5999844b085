"""Incremental ingest: a file stream of documents becomes passages, each document once.

The checkpoint remembers which files are done, so a restart goes on where it stopped; a batch is written under its own
number, so a repeated batch replaces itself.  Readers take the latest batch of a document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import passages as P

DOCUMENT = "doc_id long, text string"


def stream_documents(spark: SparkSession, path: str, schema: str = DOCUMENT, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)


def passage_batches(docs: DataFrame, out: str, checkpoint: str, most: int = 100) -> StreamingQuery:
    """Start splitting the stream; one folder per batch below out."""

    def write(batch: DataFrame, number: int) -> None:
        P.passages(batch.dropDuplicates(["doc_id"]), "doc_id", "text", most).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, out: str) -> DataFrame:
    """Passages of the last batch that holds each document."""
    rows = spark.read.option("basePath", out).parquet(out)
    last = rows.groupBy("id").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["id", "batch"]).drop("batch")


def query_windows(events: DataFrame, ts: str, key: str, size: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """window_start, key, n of a stream (or table) of events in tumbling windows, late ones up to a watermark."""
    counted = events.withWatermark(ts, late).groupBy(F.window(ts, size), key).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("window_start"), key, "n")


def sessions(events: DataFrame, user: str, ts: str, gap_seconds: int = 1800) -> DataFrame:
    """user, session, start, end, n of a table of events: a gap longer than gap_seconds starts a session."""
    w = Window.partitionBy(user).orderBy(ts)
    seconds = F.col(ts).cast("timestamp").cast("long")
    new = (seconds - F.lag(seconds).over(w) > gap_seconds) | F.lag(seconds).over(w).isNull()
    x = events.withColumn("session", F.sum(F.when(new, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return x.groupBy(user, "session").agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count("*").alias("n"))
