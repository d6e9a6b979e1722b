"""An upload as one job: landing, extraction, analysis, store, log and search index.

All files of a batch go through intake together.  The analysed frame is
written once, every table is derived from it, and the tables of the store, the
raw bytes, the upload log and the batch's index segment become visible in one
commit, so a job that dies leaves nothing to be seen and one that is sent
again adds nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausework.operators import reports as RP
from clausework.operators import search as S
from clausework.operators import search_index as SI
from clausework.operators import store as ST
from clausework.operators.snapshots import Snapshots
from clausework.session import run_dir
from clausework.sources import intake as IN


def upload(files: DataFrame, store: str, batch: str, responses: DataFrame | None = None, bucket: str = "",
           index: bool = True) -> int | None:
    """Take in landed files (``path, file_name, mtime_micros, length, content``) as one batch
    of the store under ``store``; the version, or None when the batch is there already."""
    spark = files.sparkSession
    if batch in Snapshots(spark, store).batches():
        return None
    named = IN.with_ids(files)
    texts = IN.extract_texts(named)
    intake = texts.select("document_id", "file_name", F.timestamp_micros("mtime_micros").cast("timestamp_ntz").alias("uploaded_at"), F.col("text").alias("raw_text"))
    analysed = ST.persist_analysed(ST.analyse_files(intake, responses, bucket=bucket), run_dir(spark, "upload"))
    tables = ST.Store.from_analysed(analysed)
    more = {"landing": named.where("supported").select("document_id", "file_name", "content")}
    if index:
        rows = S.area_rows(tables.documents, tables.clauses, tables.risks, tables.paragraphs)
        more |= SI.segment_tables(rows, batch)
    return tables.append(store, batch, more, SI.PARTITION_BY)


def report(spark, store: str, path: str, version: int | None = None) -> dict[str, str]:
    """Write the five report sheets of a store's version under ``path``; their folders."""
    st = ST.Store.current(spark, store, version)
    return RP.write_report(st.documents, st.parties, st.clauses, st.risks, path)
