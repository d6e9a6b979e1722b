"""Inputs derived from the driver tables (FIXTURES.md).

The raw ``documents`` table holds none of the clause keywords and no blank
lines, so a contract corpus is derived from it row by row: narrow
projections only, no shuffle, so it scales with the input splits.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausework import constants as C
from clausework.functions.text import is_supported
from clausework.sources.tables import load, spread


def _by_doc_id_mod(doc_id: Column, values: list[str]) -> Column:
    """``values[doc_id % len(values)]`` as a column."""
    arr = F.array(*[F.lit(v) for v in values])
    return F.element_at(arr, (F.pmod(doc_id, F.lit(len(values))) + 1).cast("int"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract corpus: one row per uploaded file.

    Columns: document_id, file_name, uploaded_at (TIMESTAMP_NTZ), raw_text,
    doc_id (the source key, kept for fixture assignment).
    """
    # spread on the join key itself: when the scan is too coarse and rows are
    # hash-partitioned here, every later join on document_id (responses,
    # children) finds them already clustered and adds no second exchange
    docs = spread(load(spark, sf_dir, "documents")
                  .select("doc_id", "source", "text", F.col("doc_id").cast("string").alias("document_id")),
                  "document_id")
    doc_id = F.col("doc_id")
    body = F.coalesce(F.col("text"), F.lit(""))
    additions = [
        F.when(F.pmod(doc_id, F.lit(m)) == r, F.lit("\n\n" + text * times)).otherwise(F.lit(""))
        for m, r, text, times in C.CORPUS_ADDITIONS
    ]
    raw_text = (F.when(F.pmod(doc_id, F.lit(C.CORPUS_EMPTY_MODULUS)) == 0, F.lit(""))
                .otherwise(F.concat(body, *additions)))
    return docs.select(
        "document_id",
        F.concat(F.col("source"), F.lit("_"), doc_id.cast("string"),
                 _by_doc_id_mod(doc_id, C.CORPUS_EXTENSIONS)).alias("file_name"),
        F.expr(f"timestampadd(SECOND, doc_id, TIMESTAMP_NTZ '{C.CORPUS_EPOCH}')").alias("uploaded_at"),
        raw_text.alias("raw_text"),
        doc_id,
    )


def with_status(df: DataFrame) -> DataFrame:
    """Add ``supported`` and outcome ``status`` (skipped / failed / processed)."""
    supported = is_supported("file_name")
    text = F.coalesce(F.col("raw_text"), F.lit(""))
    status = (F.when(~supported, F.lit(C.STATUS_SKIPPED))
              .when(text == "", F.lit(C.STATUS_FAILED))
              .otherwise(F.lit(C.STATUS_PROCESSED)))
    return df.withColumn("supported", supported).withColumn("status", status)


def processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are analysed and stored: supported and with text."""
    return (with_status(corpus(spark, sf_dir))
            .where(F.col("status") == C.STATUS_PROCESSED)
            .drop("supported", "status"))


def search_queries(spark: SparkSession) -> DataFrame:
    """The search fixture ``(query_id INT, query_text STRING)``; a parameter table."""
    return spark.createDataFrame(C.SEARCH_FIXTURE, "query_id BIGINT, query_text STRING")


def word_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A large query log ``(query_id STRING, query_text STRING)``: each distinct
    lowered word of ``benchmark`` is asked once, named by itself."""
    word = F.explode(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[\x20\x09-\x0D]+")).alias("query_text")
    words = load(spark, sf_dir, "benchmark").select(word).where("query_text <> ''").distinct()
    return words.select(F.col("query_text").alias("query_id"), "query_text")


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LLM responses ``(document_id, response_text)`` assigned by doc_id % 27.

    The fixture list is a 26-row literal table joined by remainder, so it is
    broadcast (fixed size) and the output grows with the corpus.
    """
    fixture = spark.createDataFrame(list(enumerate(C.RESPONSE_FIXTURE)),
                                    "remainder INT, response_text STRING")
    docs = corpus(spark, sf_dir).select(
        "document_id", F.pmod(F.col("doc_id"), F.lit(C.RESPONSE_MODULUS)).cast("int").alias("remainder"))
    return docs.join(F.broadcast(fixture), "remainder").select("document_id", "response_text")


def part_answers(spark: SparkSession, sf_dir: str, prompts: DataFrame) -> DataFrame:
    """Answers ``(document_id, part, response_text)`` to the parts of prompts, assigned by ``(doc_id + part) % 27``."""
    fixture = spark.createDataFrame(list(enumerate(C.RESPONSE_FIXTURE)), "remainder INT, response_text STRING")
    remainder = F.pmod(F.col("document_id").cast("bigint") + F.col("part"), F.lit(C.RESPONSE_MODULUS)).cast("int")
    return prompts.select("document_id", "part", remainder.alias("remainder")).join(F.broadcast(fixture), "remainder").select("document_id", "part", "response_text")


def search_log_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search log derived from ``events`` (FIXTURES.md section 6)."""
    ev = load(spark, sf_dir, "events")
    return ev.select(
        F.col("event_type").alias("query_text"),
        F.floor(F.col("value")).cast("bigint").alias("result_count"),
        F.col("ts").cast("timestamp_ntz").alias("searched_at"),
    )


def corpus_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus seen as landed files, in the ``binaryFile`` shape.

    ``path, modificationTime (as epoch micros), length, content`` plus
    ``file_name``; lets the intake rules run over table data.
    """
    c = corpus(spark, sf_dir)
    content = F.encode(F.col("raw_text"), "UTF-8")
    return c.select(
        F.concat(F.lit("landing/"), F.col("file_name")).alias("path"),
        "file_name",
        (F.col("doc_id") * 1000000 + F.lit(C.CORPUS_EPOCH_MICROS)).alias("mtime_micros"),
        F.octet_length(content).cast("bigint").alias("length"),
        content.alias("content"),
    )


def _fs_uri(path: str) -> str:
    """Hadoop-style ``file:/x`` to a URI pyarrow understands."""
    if path.startswith("file:") and not path.startswith("file://"):
        return "file://" + path[len("file:"):]
    return path


def land_files(files: DataFrame, folder: str) -> int:
    """Write ``(file_name, content)`` rows as files under ``folder``: a landing folder for tests and queries.

    Runs inside the tasks (``mapInPandas``): each task writes its own rows to
    the shared file system, so nothing passes through the driver.  Names are
    deterministic, so a retried task rewrites the same files.
    """
    target = _fs_uri(folder)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.fs as pafs

        fs, base = pafs.FileSystem.from_uri(target)
        fs.create_dir(base, recursive=True)
        for pdf in batches:
            sizes = []
            for name, content in zip(pdf["file_name"], pdf["content"]):
                data = bytes(content) if content is not None else b""
                with fs.open_output_stream(f"{base}/{name}") as out:
                    out.write(data)
                sizes.append(len(data))
            yield pd.DataFrame({"file_name": pdf["file_name"], "n_bytes": pd.Series(sizes, dtype="int64")})

    written = files.select("file_name", "content").mapInPandas(write, "file_name string, n_bytes long")
    return written.agg(F.count(F.lit(1))).first()[0]


def page_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracted PDF pages ``(document_id, page_no, text)`` from ``conversations``."""
    conv = load(spark, sf_dir, "conversations")
    return conv.select(F.col("conv_id").cast("string").alias("document_id"),
                       (F.col("turn") + 1).cast("int").alias("page_no"),
                       F.coalesce(F.col("text"), F.lit("")).alias("text"))


def block_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracted DOCX blocks ``(document_id, kind, ord, text)``.

    ``kind`` is ``paragraph`` for user turns, ``cell`` otherwise.
    """
    conv = load(spark, sf_dir, "conversations")
    return conv.select(F.col("conv_id").cast("string").alias("document_id"),
                       F.when(F.col("role") == "user", F.lit("paragraph")).otherwise(F.lit("cell")).alias("kind"),
                       F.col("turn").cast("int").alias("ord"),
                       F.coalesce(F.col("text"), F.lit("")).alias("text"))


def extraction_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``.doc`` extractor attempts ``(document_id, method_rank, ok, text)``.

    One attempt per turn of a conversation (rank 1 converter, 2 library, 3 and
    up raw reads); attempt r uses turn r-1; ``(conv_id + r) % 3`` decides: 0 empty text,
    1 not ok, 2 ok with text.
    """
    conv = load(spark, sf_dir, "conversations")
    rank = (F.col("turn") + 1).cast("int")
    sel = F.pmod(F.col("conv_id") + rank, F.lit(3))
    return conv.select(
        F.col("conv_id").cast("string").alias("document_id"),
        rank.alias("method_rank"),
        (sel != 1).alias("ok"),
        F.when(sel == 0, F.lit("")).otherwise(F.coalesce(F.col("text"), F.lit(""))).alias("text"),
    )
