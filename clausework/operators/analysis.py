"""Analysis of processed documents: LLM responses with rule fallback.

Responses arrive as a table ``(document_id, response_text)``; the network
call stays outside Spark.  Documents are joined to their responses on
``document_id`` (a shuffle join sized by the data; AQE may broadcast a small
side).  Rows without a response are analysed by rules with the no-key error;
rejected responses fall back to rules with a stable error code.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausework import constants as C
from clausework.functions.responses import FIELDS, clean_response, field_values, parsed_fields, response_checks, sealed_items, unsealed
from clausework.functions.text import strip_ws
from clausework.operators.rules import analysis_struct, with_rule_analysis


def with_response_checks(df: DataFrame, text_col: str = "response_text") -> DataFrame:
    """Add ``cleaned``, ``resp_valid``, ``resp_error``, ``resp_score`` and the
    parsed variant ``resp_v`` for a response text column."""
    # each step is a column that the next reads: a text is parsed once, a field is taken from it once
    staged = df.withColumn("cleaned", clean_response(F.col(text_col)))
    staged = staged.withColumn("_items", sealed_items(F.col("cleaned")))
    staged = staged.withColumn("resp_v", unsealed(F.col("_items"), F.col("cleaned")))
    staged = staged.withColumns({f"_x_{f}": c for f, c in field_values(F.col("resp_v")).items()})
    staged = staged.withColumns({f"_t_{f}": F.schema_of_variant(f"_x_{f}") for f in FIELDS})
    checks = response_checks(F.col("resp_v"), {f: F.col(f"_x_{f}") for f in FIELDS}, {f: F.col(f"_t_{f}") for f in FIELDS})
    return (staged.withColumns({"resp_score": checks["score"], "resp_valid": F.coalesce(checks["valid"], F.lit(False)), "resp_error": checks["error"]})
            .drop("_items", *(f"_{k}_{f}" for f in FIELDS for k in "xt")))


def with_analysis(docs: DataFrame, responses: DataFrame | None = None,
                  text_col: str = "raw_text") -> DataFrame:
    """Add the ``analysis`` struct to processed documents.

    Without a responses table every document is analysed by rules and
    carries the no-key error (the service's behaviour without a key).
    """
    if responses is None:
        return with_rule_analysis(docs, text_col=text_col, ai_error=C.NO_KEY_ERROR)

    # responses are cleaned, parsed and checked on their own side, before the
    # join: the check runs once per response, and only the parsed value crosses the exchange
    checked_resp = with_response_checks(responses.select("document_id", "response_text"))
    marked = checked_resp.select("document_id", "resp_v", "resp_score", "resp_valid", "resp_error",
                                 F.col("response_text").isNotNull().alias("_has_resp"),
                                 F.lit(True).alias("_resp_row"), "response_text")
    checked = docs.join(one_response_per_document(marked), "document_id", "left")
    has_row = F.col("_resp_row").isNotNull()
    has_resp = F.coalesce(F.col("_has_resp"), F.lit(False))
    use_llm = has_resp & F.coalesce(F.col("resp_valid"), F.lit(False))
    # rules only need the text where the response is not used
    checked = checked.withColumn("_fb_text", F.when(use_llm, F.lit("")).otherwise(F.col(text_col)))
    ruled = with_rule_analysis(checked, text_col="_fb_text", out_col="_rules")
    llm = parsed_fields(F.col("resp_v"), F.col("resp_score"))
    llm_analysis = analysis_struct(
        llm["document_type"], llm["parties"], llm["effective_date"], llm["expiry_date"],
        llm["contract_value"], llm["governing_law"], llm["key_clauses"], llm["risks"],
        llm["risk_score"], F.lit(C.LLM_MODE), F.lit(""))
    error = (F.when(~has_row, F.lit(C.NO_KEY_ERROR))
             .when(~has_resp, F.lit(C.ERR_CALL_FAILED))
             .otherwise(F.col("resp_error")))
    fallback = F.col("_rules").withField("ai_error", error)
    return (ruled.withColumn("analysis", F.when(use_llm, llm_analysis).otherwise(fallback))
            .drop("_fb_text", "_rules", "resp_v", "resp_score", "resp_valid", "resp_error",
                  "_has_resp", "_resp_row"))


def one_response_per_document(checked: DataFrame, keys: tuple[str, ...] = ("document_id",)) -> DataFrame:
    """One checked response per document (or other ``keys``), so a document is never stored twice.

    The service asks once per document; a responses table written twice
    (e.g. a re-run appended) may repeat a key.  A usable response wins over
    an unusable one, then the smallest text, so the pick is deterministic.
    ``min_by`` aggregates partially before its exchange, so a document
    repeated in a third of all rows ships one row per map task; the join
    that follows reuses this partitioning on ``document_id``.
    """
    fields = [c for c in checked.columns if c not in keys]
    rank = F.struct((~(F.coalesce(F.col("_has_resp"), F.lit(False))
                       & F.coalesce(F.col("resp_valid"), F.lit(False)))).alias("unusable"),
                    F.col("response_text").alias("text"))
    best = (checked.groupBy(*keys)
            .agg(F.min_by(F.struct(*fields), rank).alias("_best")))
    return best.select(*keys, *[F.col(f"_best.{c}").alias(c) for c in fields if c != "response_text"])


def fold_part_answers(prompts: DataFrame, answers: DataFrame) -> DataFrame:
    """One analysis of each document from the answers to the parts of its prompt.

    ``prompts`` has ``document_id, part`` (``functions.responses.prompt_parts``),
    ``answers`` ``document_id, part, response_text``.  Output: ``document_id,
    n_parts, n_used, ai_error, analysis``.

    Every part must have a usable answer; else ``analysis`` is NULL and
    ``ai_error`` says why (``PART_MISSING``, or the code of the first part that
    was rejected), and the document is left to the rules.  The answers are
    folded in the order of the parts: the first text that is not empty of each
    field; parties and clauses once each, in order of appearance; a risk (by
    its lowered name) once, with the highest severity that a part gave it and
    that part's reason; the least of the scores, as a risk anywhere is one of
    the whole.
    """
    keys = ("document_id", "part")
    checked = with_response_checks(answers.select(*keys, "response_text"))
    marked = checked.select(*keys, "resp_v", "resp_score", "resp_valid", "resp_error", F.col("response_text").isNotNull().alias("_has_resp"), "response_text")
    best = one_response_per_document(marked, keys)
    f = parsed_fields(F.col("resp_v"), F.col("resp_score"))
    told = best.select(*keys, "_has_resp", "resp_valid", "resp_error", *[c.alias(name) for name, c in f.items()])
    each = prompts.select(*keys).join(told, list(keys), "left")
    used = F.coalesce(F.col("_has_resp") & F.col("resp_valid"), F.lit(False))
    error = F.when(~F.coalesce(F.col("_has_resp"), F.lit(False)), F.lit(C.ERR_PART_MISSING)).when(~used, F.col("resp_error"))
    parts = each.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("part", used.alias("used"), error.alias("error"), *f))).alias("parts"))
    parts = parts.select("document_id", "parts", F.array_distinct(F.flatten(F.transform("parts", lambda p: p["risks"]))).alias("risks"))

    def first_text(name: str):
        return F.coalesce(F.get(F.filter(F.transform("parts", lambda p: p[name]), lambda x: x != ""), F.lit(0)), F.lit(""))

    def rank(risk):
        level = F.lower(risk["severity"])
        return F.when(level == "high", 0).when(level == "medium", 1).when(level == "low", 2).otherwise(3)

    def worst(name):
        same = F.filter("risks", lambda r: F.lower(strip_ws(r["risk"])) == name)
        return F.aggregate(same, F.get(same, F.lit(0)), lambda a, r: F.when(rank(r) < rank(a), r).otherwise(a))

    names = F.array_distinct(F.transform("risks", lambda r: F.lower(strip_ws(r["risk"]))))
    joined = lambda name: F.array_distinct(F.flatten(F.transform("parts", lambda p: p[name])))
    analysis = analysis_struct(
        first_text("document_type"), joined("parties"), first_text("effective_date"), first_text("expiry_date"),
        first_text("contract_value"), first_text("governing_law"), joined("key_clauses"), F.transform(names, worst),
        F.array_min(F.transform("parts", lambda p: p["risk_score"])), F.lit(C.LLM_MODE), F.lit(""))
    errors = F.filter(F.transform("parts", lambda p: p["error"]), lambda e: e.isNotNull())
    missing = F.exists(errors, lambda e: e == C.ERR_PART_MISSING)
    return parts.select(
        "document_id", F.size("parts").cast("bigint").alias("n_parts"), F.size(F.filter("parts", lambda p: p["used"])).cast("bigint").alias("n_used"),
        F.when(missing, F.lit(C.ERR_PART_MISSING)).otherwise(F.coalesce(F.get(errors, F.lit(0)), F.lit(""))).alias("ai_error"),
        F.when(F.size(errors) == 0, analysis).alias("analysis"))


def request_responses(prompts: DataFrame, ask: Callable[[str], str | None], path: str) -> DataFrame:
    """Fill the responses table by calling ``ask(prompt)`` inside the tasks.

    ``prompts`` is ``(document_id, prompt)`` (see ``analysis_prompts``);
    ``ask`` is any Python callable (e.g. a client for a hosted model).  Calls
    run per Arrow batch in ``mapInPandas``, spread over the executors; a call
    that raises gives a NULL response, which falls back to rules with
    ``CALL_FAILED``.  Model answers are not deterministic and a retried task
    would ask again, so the table is written once under ``path`` (a shared
    folder) and read back before any use.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = []
            for prompt in pdf["prompt"]:
                try:
                    texts.append(ask(prompt))
                except Exception:  # noqa: BLE001 - any failure falls back to rules
                    texts.append(None)
            yield pd.DataFrame({"document_id": pdf["document_id"], "response_text": texts})

    (prompts.select("document_id", "prompt")
     .mapInPandas(run, "document_id string, response_text string")
     .write.mode("overwrite").parquet(path))
    return prompts.sparkSession.read.parquet(path)


def normalized(analysed: DataFrame, gcs_path=None) -> DataFrame:
    """NormalizedDocument (P5): id, name, path and raw text with the analysis
    fields; ``ai_error`` dropped."""
    gcs = F.coalesce(gcs_path, F.lit("")) if gcs_path is not None else F.lit("")
    fields = [F.col(f"analysis.{f}").alias(f) for f in
              ["document_type", "parties", "effective_date", "expiry_date", "contract_value",
               "governing_law", "key_clauses", "risks", "risk_score", "mode"]]
    return analysed.select("document_id", "file_name", *fields, gcs.alias("gcs_path"),
                           F.col("raw_text"))
