"""Incremental ingest: a file stream whose batches are idempotent by content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sinks.writers import unseen


def ingest_new(spark: SparkSession, source: str, target: str, checkpoint: str, schema: str = "path string, text string"):
    """Everything that arrived in ``source`` (JSON lines) since the last call; contents seen before are skipped.

    Each batch is keyed by its number, so that a batch that is run again
    replaces what it wrote.  Rows that don't parse go to ``quarantine``.
    """
    stream = spark.readStream.schema(schema + ", _bad string").option("columnNameOfCorruptRecord", "_bad").json(source)

    def upsert(batch: DataFrame, number: int) -> None:
        s = batch.sparkSession
        bad = batch.where("_bad IS NOT NULL OR text IS NULL")
        bad.write.mode("overwrite").json(f"{target}/quarantine/batch={number}")
        good = batch.where("_bad IS NULL AND text IS NOT NULL").select("path", "text", F.md5("text").alias("md5"))
        try:
            seen = s.read.schema("md5 string, batch int").parquet(f"{target}/ledger").where(F.col("batch") != number).select("md5")
        except Exception as e:  # the first batch finds no ledger
            if "PATH_NOT_FOUND" not in str(e):
                raise
            seen = s.createDataFrame([], "md5 string")
        new = unseen(good, seen)
        new.write.mode("overwrite").parquet(f"{target}/docs/batch={number}")
        s.read.parquet(f"{target}/docs/batch={number}").select("md5").write.mode("overwrite").parquet(f"{target}/ledger/batch={number}")

    return stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions per user, batch or stream: (user_id, start, end, n)."""
    e = events.select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    if e.isStreaming:
        e = e.withWatermark("ts", "1 hour")
    s = e.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
