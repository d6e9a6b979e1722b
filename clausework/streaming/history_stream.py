"""Search history kept up to date by a stream.

The search log is read as a stream and counted by query text and day.  The
state of a day is dropped once the watermark has passed it, so the state
holds the last days only, whatever the age of the log.  Each micro-batch
writes the groups it changed, with their new totals, as one commit of the
history's store (``operators.snapshots``) named by the stream and the epoch:
an epoch that runs again is a commit that is there already.

The history is the last total of each group.  ``merge`` folds the changes of
many epochs into one folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausework.operators.snapshots import Snapshots
from clausework.streaming.intake_stream import stream_id

LOG = "query_text string, result_count bigint, searched_at timestamp_ntz"
TABLE = "search_history"
_GROUP = ["day", "query_text"]


def _counted(log: DataFrame, late: str) -> DataFrame:
    # the time as it is written, without any zone
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', searched_at)")
    timed = log.withColumn("at", F.timestamp_micros(micros)).withWatermark("at", late)
    groups = timed.groupBy(F.window("at", "1 day"), "query_text").agg(F.count("*").alias("searches"), F.sum("result_count").alias("results"))
    day = F.date_from_unix_date(F.floor(F.unix_seconds(F.col("window.start")) / 86400).cast("int"))
    return groups.select(day.alias("day"), "query_text", "searches", "results")


def maintain(spark: SparkSession, log: str, store: str, checkpoint: str, late: str = "2 days", max_files: int = 1000):
    """Start the stream over the log's folder; it takes in what is there, in bounded
    micro-batches, and stops.  Rows later than ``late`` behind the newest are left out,
    as their day's state is gone."""
    run = stream_id(spark, checkpoint)

    def commit(changed: DataFrame, epoch: int) -> None:
        Snapshots(spark, store).commit(f"{run}-{epoch}", {TABLE: changed.withColumn("epoch", F.lit(epoch).cast("bigint"))})

    rows = spark.readStream.schema(LOG).option("maxFilesPerTrigger", str(max_files)).parquet(log)
    return (_counted(rows, late).writeStream.outputMode("update").foreachBatch(commit)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def history(spark: SparkSession, store: str, version: int | None = None) -> DataFrame:
    """``day, query_text, searches, results`` as of a version of the store."""
    return _last(Snapshots(spark, store).read(TABLE, version)).drop("epoch")


def _last(changes: DataFrame) -> DataFrame:
    totals = changes.groupBy(*_GROUP).agg(F.max_by(F.struct("searches", "results", "epoch"), "epoch").alias("last"))
    return totals.select(*_GROUP, "last.searches", "last.results", "last.epoch")


def merge(spark: SparkSession, store: str, name: str) -> int | None:
    """Fold the changes of all epochs so far into one folder."""
    return Snapshots(spark, store).merge(name, TABLE, _last)
