"""Incremental indexing as a stream: new files are upserted in micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.commits import Log


def ingest(spark: SparkSession, source: str, schema: StructType, root: str, key: str, order: str, checkpoint: str, files: int = 64) -> int:
    """Reads what is new in ``source`` and merges it into the log at ``root`` (only
    buckets that a batch touches are written anew; a row older by ``order`` than the
    stored one changes nothing), ``files`` files a batch; the checkpoint makes a restart go on where it
    stopped, and a batch that comes twice changes nothing. Returns batches run."""

    done = []

    def apply(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        latest = batch.groupBy(key).agg(F.max_by(F.struct(*[c for c in batch.columns if c != key]), order).alias("_r")).select(key, "_r.*").select(*batch.columns)
        session = batch.sparkSession
        Log(session, root).merge(latest, [key], F.col(order))
        done.append(number)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    q = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return len(done)


def windowed_counts(events: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts and sums of an event stream in tumbling windows; rows later than ``late`` are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("w.start", "event_type", "n", "total")
