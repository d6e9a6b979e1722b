"""Report tables, outcome cards and log appends.

The five report sheets are DataFrames ordered like the service's workbook:
documents newest first, children in stored order.  Child rows written by
this package carry their parent's file name and upload time, so the child
sheets need no join; for child tables without them, an inner join on
``document_id`` takes only the parent's key columns.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausework import constants as C
from clausework.functions.text import prefix, upper_severity
from clausework.operators.logs import written_or_logged

REPORT_DOCUMENT_COLUMNS = ["document_id", "file_name", "document_type", "effective_date", "expiry_date",
                           "contract_value", "governing_law", "risk_score", "mode", "gcs_path"]
SHEETS = ["documents", "parties", "clauses", "risks", "raw_text"]


def _newest_first():
    return [F.col("uploaded_at").desc(), F.col("document_id")]


def report_documents(documents: DataFrame) -> DataFrame:
    """Documents sheet: ten columns, newest first."""
    return (documents.orderBy(*_newest_first())
            .select(*REPORT_DOCUMENT_COLUMNS))


def report_children(children: DataFrame, documents: DataFrame, fields: list[str]) -> DataFrame:
    """Parties / Clauses / Risks sheet: ``document_id, file_name, <fields>``."""
    from clausework.operators.store import with_parent_keys
    return (with_parent_keys(children, documents)
            .orderBy(*_newest_first(), F.col("pos"))
            .select("document_id", "file_name", *fields))


def report_raw_text(documents: DataFrame, chars: int | None = C.REPORT_TEXT_CHARS) -> DataFrame:
    """Raw_Text sheet: text cut at 30,000 characters, as in the service's workbook (None: whole).

    The cut comes before the sort, so the range exchange carries at most
    that many characters per document.
    """
    text = F.coalesce("raw_text", F.lit(""))
    return (documents.select("document_id", "file_name", "uploaded_at",
                             (text if chars is None else prefix(text, chars)).alias("raw_text"))
            .orderBy(*_newest_first())
            .select("document_id", "file_name", "raw_text"))


def write_report(documents: DataFrame, parties: DataFrame, clauses: DataFrame, risks: DataFrame,
                 path: str) -> dict[str, str]:
    """Write the five sheets as parquet folders under ``path`` (overwrite:
    the report is a derived view, rebuilt on demand)."""
    sheets = {
        "documents": report_documents(documents),
        "parties": report_children(parties, documents, ["party_name"]),
        "clauses": report_children(clauses, documents, ["clause_type", "clause_text"]),
        "risks": report_children(risks, documents, ["risk", "severity", "reason"]),
        "raw_text": report_raw_text(documents),
    }
    out = {name: f"{path}/{name}" for name in sheets}
    # independent sheets: their write jobs are submitted together
    with ThreadPoolExecutor(max_workers=len(sheets)) as pool:
        for done in [pool.submit(df.write.mode("overwrite").parquet, out[name]) for name, df in sheets.items()]:
            done.result()
    return out


def has_documents(documents: DataFrame) -> DataFrame:
    """One row: is there any stored document (A3)?  Reads only the key column."""
    return documents.select("document_id").limit(1).agg(
        (F.count(F.lit(1)) > 0).alias("has_documents"))


def processed_count(outcomes: DataFrame) -> DataFrame:
    """Outcomes in a batch, skipped and failed included (A2), with the split by status."""
    return outcomes.agg(
        F.count(F.lit(1)).alias("processed_count"),
        F.count(F.when(F.col("status") == C.STATUS_PROCESSED, 1)).alias("n_processed"),
        F.count(F.when(F.col("status") == C.STATUS_FAILED, 1)).alias("n_failed"),
        F.count(F.when(F.col("status") == C.STATUS_SKIPPED, 1)).alias("n_skipped"))


def _or_not_detected(c):
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit(C.NOT_DETECTED)).otherwise(c)


def result_cards(outcomes: DataFrame) -> DataFrame:
    """Display values of the per-file result card (P7); HTML is not built.  The cards of
    clauses and risks hold a heading line and the clause's text or the risk's reason."""
    a = lambda f: F.col(f"analysis.{f}")
    parties = F.when(F.size(a("parties")) == 0, F.lit(C.NOT_DETECTED)).otherwise(
        F.array_join(a("parties"), "\n"))
    clauses = F.when(F.size(a("key_clauses")) == 0, F.lit(C.NO_CLAUSES)).otherwise(
        F.array_join(F.transform(a("key_clauses"), lambda c: c["clause_type"]), "\n"))
    risks = F.when(F.size(a("risks")) == 0, F.lit(C.NO_RISKS)).otherwise(
        F.array_join(F.transform(a("risks"), lambda r: F.concat(upper_severity(r["severity"]), F.lit(" — "),
                                                                r["risk"])), "\n"))
    clause_cards = F.when(F.size(a("key_clauses")) == 0, F.lit(C.NO_CLAUSES)).otherwise(
        F.array_join(F.transform(a("key_clauses"), lambda c: F.concat(c["clause_type"], F.lit("\n"), c["clause_text"])), "\n\n"))
    risk_cards = F.when(F.size(a("risks")) == 0, F.lit(C.NO_RISKS)).otherwise(
        F.array_join(F.transform(a("risks"), lambda r: F.concat(upper_severity(r["severity"]), F.lit(" — "), r["risk"],
                                                                F.lit("\n"), r["reason"])), "\n\n"))
    score = F.concat(F.coalesce(F.col("risk_score").cast("string"), F.lit("")), F.lit(C.SCORE_SUFFIX))
    gcs = F.when(F.col("gcs_path") == "", F.lit(C.NOT_UPLOADED)).otherwise(F.col("gcs_path"))
    return outcomes.select(
        "source_id", "file_name", "status", score.alias("score_display"), "mode",
        a("document_type").alias("document_type"), gcs.alias("gcs_display"),
        parties.alias("parties_display"),
        _or_not_detected(a("effective_date")).alias("effective_display"),
        _or_not_detected(a("expiry_date")).alias("expiry_display"),
        _or_not_detected(a("contract_value")).alias("value_display"),
        _or_not_detected(a("governing_law")).alias("law_display"),
        clauses.alias("clauses_display"), risks.alias("risks_display"),
        clause_cards.alias("clause_cards"), risk_cards.alias("risk_cards"))


def append_search_log(counts: DataFrame, path: str) -> bool:
    """Append one log row per asked query: text as typed, full hit count (K6).

    Counted by query id, so the same text asked twice is two rows.  A log
    that can't be written is reported and does not fail the search; returns
    whether it was written.
    """
    rows = counts.select("query_text", F.col("result_count").cast("bigint").alias("result_count"),
                         F.localtimestamp().alias("searched_at"))
    return written_or_logged(lambda: rows.write.mode("append").parquet(path), "search log")
