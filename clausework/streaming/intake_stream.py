"""Streaming intake of a landing folder.

At its start the stream lists the landing folder in tasks and writes what is new
to listings kept in the checkpoint, each of a micro-batch's files at most
(``sources.intake.list_landing``); ``readStream`` is over these listings.  A file source
over the landing folder itself would hold a row for every file ever landed on the driver,
and the log of the source too.  The files of a micro-batch are opened by
the tasks; each micro-batch runs
the same stateless intake and analysis as the batch path and writes the
store tables through ``foreachBatch``.  No state, no watermark: uploads are
independent.  Exactly-once output: every table of micro-batch ``n`` is
written (overwrite) under ``run=<id>/batch=<n>``, the id being kept in the
checkpoint, so a replayed epoch replaces its own folder and a new checkpoint
or a second stream on the same store adds to what is stored; the analysed frame of the batch is
written first and every table is derived from that copy.

0-byte files are skipped by the file source (T1), so a streaming run never
logs them; the batch path with a manifest does.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausework.operators.store import Store, analyse_files, persist_analysed
from clausework.session import run_dir
from clausework.sources import corpus as CP
from clausework.sources import intake as IN

LISTING_SCHEMA = "path STRING, mtime_micros BIGINT, length BIGINT"
# Files of a micro-batch, at most.  Each batch is eight jobs whatever it holds, so small ones
# cost more than their files; the files of one are shared out over the tasks.
FILES_PER_BATCH = 100_000
STORE_TABLES = ["documents", "parties", "clauses", "risks", "upload_log", "outcomes", "paragraphs"]


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id of the stream that this checkpoint belongs to, made at its first start."""
    folder = f"{checkpoint.rstrip('/')}/run_id"
    if not _exists(spark, f"{folder}/_SUCCESS"):
        spark.createDataFrame([(uuid.uuid4().hex,)], "id string").write.mode("overwrite").text(folder)
    return spark.read.text(folder).first()[0]


def _listings(spark: SparkSession, landing: str, checkpoint: str, files_each: int) -> str:
    """The folder of the stream's listings, after what has landed since the last start was added to
    it: files that a listing holds already are not new, so a start that was cut short adds the rest."""
    folder = f"{checkpoint.rstrip('/')}/landed"
    if not _exists(spark, folder):
        if _exists(spark, f"{checkpoint.rstrip('/')}/sources"):
            raise ValueError(f"{checkpoint} belongs to a stream that read the landing folder itself; start with a new checkpoint")
        at = spark._jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(at)
    known = spark.read.schema(LISTING_SCHEMA).parquet(folder).select("path")
    path = run_dir(spark, "landed-new")
    IN.list_landing(spark, landing).join(known, "path", "left_anti").write.parquet(path)
    new = spark.read.schema(LISTING_SCHEMA).parquet(path)
    if n := new.count():
        # dealt by a hash, a listing may have some more files than another
        parts = 1 if n <= files_each else -(-n * 21 // (20 * files_each))
        new.repartition(parts, "path").write.option("maxRecordsPerFile", files_each).mode("append").parquet(folder)
    return folder


def _process_batch(landing: str, store_path: str, run_id: str, responses: DataFrame | None, bucket: str):
    def run(batch: DataFrame, epoch_id: int) -> None:
        # a listing is one small file: its rows are shared out over the tasks that open the files
        listed = batch.repartition(4 * batch.sparkSession.sparkContext.defaultParallelism, "path")
        files = IN.with_content(listed, landing).select("path", F.regexp_extract("path", r"([^/]*)$", 1).alias("file_name"),
                                                        "mtime_micros", "length", "content")
        # read once: extraction takes each route from a copy with few partitions, not from the files again
        copy = run_dir(batch.sparkSession, "stream-files")
        IN.with_ids(files).write.parquet(copy)
        texts = IN.extract_texts(batch.sparkSession.read.parquet(copy))
        intake = texts.select("document_id", "file_name",
                              F.timestamp_micros("mtime_micros").cast("timestamp_ntz").alias("uploaded_at"),
                              F.col("text").alias("raw_text"))
        part = f"{store_path}/_analysed/run={run_id}/batch={epoch_id}"
        analysed = persist_analysed(analyse_files(intake, responses, bucket=bucket), part)
        st = Store.from_analysed(analysed)
        for name in STORE_TABLES:
            getattr(st, name).write.mode("overwrite").parquet(f"{store_path}/{name}/run={run_id}/batch={epoch_id}")
    return run


def start_intake_stream(spark: SparkSession, landing: str, store_path: str, checkpoint: str,
                        responses: DataFrame | None = None, bucket: str = "",
                        max_files_per_trigger: int = FILES_PER_BATCH):
    """Start the intake stream; returns the ``StreamingQuery``.

    ``trigger(availableNow=True)``: process what has landed, in bounded
    micro-batches, then stop; a later start resumes from the checkpoint.
    """
    # a listing is a micro-batch, however old it is when a start that was cut short is made up for
    stream = (spark.readStream.schema(LISTING_SCHEMA)
              .option("maxFilesPerTrigger", "1")
              .option("maxFileAge", "36500d")
              .parquet(_listings(spark, landing, checkpoint, max_files_per_trigger)))
    return (stream.writeStream
            .foreachBatch(_process_batch(landing, store_path, stream_id(spark, checkpoint), responses, bucket))
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start())


def stream_corpus_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Land the corpus as files, stream them in, return the stored documents.

    Output: ``file_name, document_type, risk_score, mode, n_chars`` per
    stored document (ids depend on the landing path, so they are left out).
    """
    root = run_dir(spark, "stream")
    landing, store, ckpt = f"{root}/landing", f"{root}/store", f"{root}/checkpoint"
    CP.land_files(CP.corpus_files(spark, sf_dir), landing)
    q = start_intake_stream(spark, landing, store, ckpt)
    q.awaitTermination()
    docs = spark.read.parquet(f"{store}/documents")
    return docs.select("file_name", "document_type", F.col("risk_score").cast("bigint").alias("risk_score"),
                       "mode", F.length("raw_text").cast("bigint").alias("n_chars"))


__all__ = ["start_intake_stream", "stream_corpus_intake"]
