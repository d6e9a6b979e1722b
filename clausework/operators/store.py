"""Parent/child contract store.

All tables of one intake batch come from one analysed frame: each file row
carries its status and its analysis struct, the parent table is a
projection, and the child tables are ``posexplode`` of the analysis arrays
(no join, no shuffle).  Writing persists the analysed frame once in the
shared folder and derives every table from that copy, so a lost executor
only re-runs its own tasks and the tables never disagree.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausework import constants as C
from clausework.functions.arrays import explode_with_pos
from clausework.functions.text import coerce_score, safe_name, split_paragraphs
from clausework.operators.analysis import with_analysis
from clausework.operators.logs import written_or_logged
from clausework.operators.rules import empty_analysis
from clausework.operators.search import paragraph_table
from clausework.operators.snapshots import Snapshots
from clausework.sources.corpus import with_status

# Columns of the child tables as the service stores them (plus our ``pos``).
CHILD_COLUMNS = {
    "parties": ["document_id", "pos", "party_name"],
    "clauses": ["document_id", "pos", "clause_type", "clause_text"],
    "risks": ["document_id", "pos", "risk", "severity", "reason"],
}
# Parent columns every child row also carries (copied from the same analysed
# row at write time), so search and reports need no join back to documents.
CARRIED = ["file_name", "uploaded_at"]
DOCUMENT_COLUMNS = ["document_id", "file_name", "document_type", "effective_date", "expiry_date",
                    "contract_value", "governing_law", "risk_score", "mode", "gcs_path", "raw_text"]


def storage_path(document_id, file_name, bucket: str, folder: str = C.DEFAULT_FOLDER) -> Column:
    """``gs://<bucket>/<folder>/<id>_<name>``; NULL when no bucket is set (K8)."""
    if not bucket:
        return F.lit(None).cast("string")
    return F.concat(F.lit(f"{C.STORE_SCHEME}{bucket}/{folder}/"), safe_name(document_id, file_name))


def analyse_files(files: DataFrame, responses: DataFrame | None = None,
                  bucket: str = "", folder: str = C.DEFAULT_FOLDER) -> DataFrame:
    """Outcome of every uploaded file (skipped / failed / processed) with its analysis.

    ``files`` has ``document_id, file_name, uploaded_at, raw_text``.
    Output adds ``status``, ``gcs_path`` (NULL when not stored) and
    ``analysis``.
    """
    df = with_status(files)
    processed = F.col("status") == C.STATUS_PROCESSED
    df = df.withColumn("_an_text", F.when(processed, F.col("raw_text")).otherwise(F.lit("")))
    df = with_analysis(df, responses, text_col="_an_text")
    analysis = (F.when(processed, F.col("analysis"))
                .when(F.col("status") == C.STATUS_FAILED, empty_analysis(C.FAILED_RISK))
                .otherwise(empty_analysis(C.SKIPPED_RISK)))
    gcs = F.when(F.col("status") != C.STATUS_SKIPPED,
                 storage_path(F.col("document_id"), F.col("file_name"), bucket, folder))
    return (df.withColumn("analysis", analysis)
            .withColumn("gcs_path", gcs.cast("string"))
            .drop("_an_text", "supported"))


UPLOAD_LOG = ("document_id string, file_name string, document_type string, risk_score int, mode string, status string, "
              "gcs_path string, uploaded_at timestamp_ntz")
TABLES = ["documents", "parties", "clauses", "risks", "upload_log", "outcomes", "paragraphs"]


@dataclass
class Store:
    """The four stored tables, the upload log, per-file outcomes, and the
    paragraph table of the stored documents (split once at intake, read by
    every raw-text search)."""
    documents: DataFrame
    parties: DataFrame
    clauses: DataFrame
    risks: DataFrame
    upload_log: DataFrame
    outcomes: DataFrame
    paragraphs: DataFrame

    @staticmethod
    def from_analysed(analysed: DataFrame) -> "Store":
        documents = documents_table(analysed)
        return Store(documents, parties_table(analysed), clauses_table(analysed),
                     risks_table(analysed), upload_log_table(analysed), outcomes_table(analysed),
                     paragraph_table(documents))

    def write(self, path: str, mode: str = "overwrite", parallel: int = 4) -> None:
        """Write every table under ``path`` (a shared folder), one job each.

        The tables are independent reads of the same persisted frame, so up
        to ``parallel`` write jobs are submitted at once: small tables no
        longer wait for each other, large ones share the executors.
        """
        def write_one(name: str) -> None:
            df = getattr(self, name)
            if name != "outcomes":
                df = df.sortWithinPartitions("document_id")  # tight min/max stats for id lookups
            write = lambda: df.write.mode(mode).parquet(f"{path}/{name}")
            if name == "upload_log":  # a log does not fail the intake
                written_or_logged(write, "upload log")
            else:
                write()

        with ThreadPoolExecutor(max_workers=max(1, parallel)) as pool:
            for done in [pool.submit(write_one, name) for name in TABLES]:
                done.result()

    def append(self, path: str, batch: str, more: dict[str, DataFrame] | None = None, partition_by: dict[str, list[str]] | None = None,
               **how) -> int | None:
        """Add the tables of a batch (and ``more`` of the same batch) to the store under ``path`` in one
        commit; its version, or None when the batch was there already (``operators.snapshots``)."""
        tables = {name: getattr(self, name) for name in TABLES}
        tables = {name: df if name == "outcomes" else df.sortWithinPartitions("document_id") for name, df in tables.items()}
        return Snapshots(path=path, spark=self.documents.sparkSession).commit(
            batch, tables | (more or {}), partition_by, optional=("upload_log",), **how)

    @staticmethod
    def current(spark: SparkSession, path: str, version: int | None = None) -> "Store":
        """All batches committed by ``append`` up to a version (the latest by default)."""
        log = Snapshots(spark, path)
        return Store(*[log.read(n, version, UPLOAD_LOG if n == "upload_log" else None) for n in TABLES])

    @staticmethod
    def read(spark: SparkSession, path: str) -> "Store":
        hadoop = spark._jvm.org.apache.hadoop.fs.Path

        def table(name: str) -> DataFrame:
            folder = hadoop(f"{path}/{name}")
            if name == "upload_log" and not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
                return spark.createDataFrame([], UPLOAD_LOG)  # the log could not be written
            return spark.read.parquet(f"{path}/{name}")

        return Store(*[table(n) for n in TABLES])


def persist_analysed(analysed: DataFrame, path: str) -> DataFrame:
    """Write the analysed frame once and read it back: cuts lineage so every
    table of the batch is derived from the same rows (T10)."""
    analysed.write.mode("overwrite").parquet(f"{path}/analysed")
    return analysed.sparkSession.read.parquet(f"{path}/analysed")


def _processed(analysed: DataFrame) -> DataFrame:
    return analysed.where(F.col("status") == C.STATUS_PROCESSED)


def documents_table(analysed: DataFrame) -> DataFrame:
    """Parent rows (K1): processed documents only; score coerced to INT."""
    a = lambda f: F.col(f"analysis.{f}")
    return _processed(analysed).select(
        "document_id", "file_name",
        a("document_type").alias("document_type"), a("effective_date").alias("effective_date"),
        a("expiry_date").alias("expiry_date"), a("contract_value").alias("contract_value"),
        a("governing_law").alias("governing_law"),
        coerce_score(a("risk_score")).alias("risk_score"),
        a("mode").alias("mode"),
        F.coalesce(F.col("gcs_path"), F.lit("")).alias("gcs_path"),
        "raw_text", "uploaded_at")


def child_view(children: DataFrame, name: str) -> DataFrame:
    """A child table with exactly the service's columns (carried ones dropped)."""
    return children.select(*CHILD_COLUMNS[name])


def parties_table(analysed: DataFrame) -> DataFrame:
    """One row per party (K2); an empty list gives no rows."""
    return explode_with_pos(_processed(analysed), ["document_id", *CARRIED], F.col("analysis.parties"),
                            "pos", "party_name").select(*CHILD_COLUMNS["parties"], *CARRIED)


def _whole_clauses(analysed: DataFrame) -> DataFrame:
    """``analysed`` with ``_whole``, its clauses with ``clause_text_full``: a text of the
    rules as long as their cut is read again from the first paragraph with its keyword."""
    clauses = F.col("analysis.key_clauses")
    is_cut = lambda c: (F.length(c["clause_text"]) == C.CLAUSE_TEXT_CHARS) & (F.col("analysis.mode") == C.RULES_MODE)

    def whole(paragraphs, c):
        first = F.get(F.filter(paragraphs, lambda p: p.startswith(c["clause_text"]) & F.lower(p).contains(F.lower(c["clause_type"]))), F.lit(0))
        text = F.coalesce(c["clause_text"], F.lit(""))
        return F.struct(c["clause_type"].alias("clause_type"), c["clause_text"].alias("clause_text"),
                        F.when(is_cut(c), F.coalesce(first, text)).otherwise(text).alias("clause_text_full"))

    # the paragraphs are the start of a fold over the clauses: an expression inside
    # a function of each clause would split the text anew for every clause
    none = F.array().cast("array<struct<clause_type:string,clause_text:string,clause_text_full:string>>")
    start = F.struct(F.when(F.exists(clauses, is_cut), split_paragraphs("raw_text")).alias("paragraphs"), none.alias("done"))
    folded = F.aggregate(clauses, start, lambda a, c: F.struct(
        a["paragraphs"].alias("paragraphs"), F.concat(a["done"], F.array(whole(a["paragraphs"], c))).alias("done")), lambda a: a["done"])
    return analysed.withColumn("_whole", folded)


def clauses_table(analysed: DataFrame) -> DataFrame:
    """One row per clause (K3); missing fields are ''.  ``clause_text_full`` is
    the text before the service's cut, carried beside its columns."""
    return (explode_with_pos(_whole_clauses(_processed(analysed)), ["document_id", *CARRIED], F.col("_whole"),
                             "pos", "c")
            .select("document_id", "pos",
                    F.coalesce(F.col("c.clause_type"), F.lit("")).alias("clause_type"),
                    F.coalesce(F.col("c.clause_text"), F.lit("")).alias("clause_text"),
                    F.col("c.clause_text_full").alias("clause_text_full"), *CARRIED))


def risks_table(analysed: DataFrame) -> DataFrame:
    """One row per risk (K4); missing fields are ''."""
    return (explode_with_pos(_processed(analysed), ["document_id", *CARRIED], F.col("analysis.risks"), "pos", "r")
            .select("document_id", "pos",
                    F.coalesce(F.col("r.risk"), F.lit("")).alias("risk"),
                    F.coalesce(F.col("r.severity"), F.lit("")).alias("severity"),
                    F.coalesce(F.col("r.reason"), F.lit("")).alias("reason"), *CARRIED))


def upload_log_table(analysed: DataFrame) -> DataFrame:
    """Upload log (K5): processed and no-text files, not unsupported ones.

    No-text rows carry '' type and mode and a NULL score; the path is NULL
    when the file was not stored.
    """
    processed = F.col("status") == C.STATUS_PROCESSED
    return analysed.where(F.col("status") != C.STATUS_SKIPPED).select(
        "document_id", "file_name",
        F.when(processed, F.col("analysis.document_type")).otherwise(F.lit("")).alias("document_type"),
        F.when(processed, coerce_score(F.col("analysis.risk_score"))).alias("risk_score"),
        F.when(processed, F.col("analysis.mode")).otherwise(F.lit("")).alias("mode"),
        F.when(processed, F.lit(C.STATUS_PROCESSED)).otherwise(F.lit(C.LOG_STATUS_FAILED)).alias("status"),
        "gcs_path", "uploaded_at")


def outcomes_table(analysed: DataFrame) -> DataFrame:
    """One outcome per file (P6): skipped files have no id; only processed
    ones have a score and mode."""
    processed = F.col("status") == C.STATUS_PROCESSED
    return analysed.select(
        F.when(F.col("status") == C.STATUS_SKIPPED, F.lit("")).otherwise(F.col("document_id")).alias("document_id"),
        "file_name", "status",
        F.when(processed, F.col("analysis.risk_score")).alias("risk_score"),
        F.when(processed, F.col("analysis.mode")).otherwise(F.lit("")).alias("mode"),
        F.coalesce(F.col("gcs_path"), F.lit("")).alias("gcs_path"),
        "analysis", "uploaded_at", F.col("document_id").alias("source_id"))


# --------------------------------------------------------------------------
# Reads (S9-S14) and loop-joins
# --------------------------------------------------------------------------

def documents_newest_first(documents: DataFrame) -> DataFrame:
    """All documents, 11 columns, newest first (S9); ties by id."""
    return (documents.orderBy(F.col("uploaded_at").desc(), F.col("document_id"))
            .select(*DOCUMENT_COLUMNS))


def lookup_children(children: DataFrame, document_ids) -> DataFrame:
    """Children of the given documents.

    ``document_ids`` is one id (an equality pushed into the parquet scan) or
    a one-column DataFrame of ids (a left-semi join).
    """
    if isinstance(document_ids, str):
        return children.where(F.col("document_id") == document_ids)
    return children.join(document_ids.select("document_id"), "document_id", "left_semi")


def with_parent_keys(children: DataFrame, documents: DataFrame) -> DataFrame:
    """Children with their document's name and upload time: the carried
    columns when the child table has them (no shuffle), else the join."""
    if all(c in children.columns for c in CARRIED):
        return children
    return with_document(children, documents)


def with_document(children: DataFrame, documents: DataFrame) -> DataFrame:
    """Children with their document's name and upload time.

    Inner: a document without children adds no rows, and orphans are never
    reached.  Only the three key columns of the parent take part (raw text
    stays out of the shuffle).
    """
    meta = documents.select("document_id", "file_name", "uploaded_at")
    return children.drop(*CARRIED).join(meta, "document_id", "inner")


def search_history(search_log: DataFrame) -> DataFrame:
    """Search log, newest first."""
    return (search_log.select("query_text", "result_count", "searched_at")
            .orderBy(F.col("searched_at").desc(), "query_text", "result_count"))


def upload_history(upload_log: DataFrame) -> DataFrame:
    """Upload log, newest first, eight columns."""
    return (upload_log.select("document_id", "file_name", "document_type", "risk_score", "mode",
                              "status", "gcs_path", "uploaded_at")
            .orderBy(F.col("uploaded_at").desc(), F.col("document_id")))
