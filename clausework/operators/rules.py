"""Keyword-rule contract analysis (R1-R3, A4) as one narrow projection.

Per document: the text is lowered once and split into paragraphs once; each
keyword then costs one ``contains`` on the lowered text and one scan of the
lowered paragraph array.  Keywords are literal columns (one per keyword), so
the split is never repeated inside a lambda.  No shuffle: the analysis runs
where the input split is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausework import constants as C
from clausework.functions.text import best_paragraph, lower_all, split_paragraphs
from clausework.operators.matching import literal_matches

CLAUSE_TYPE = "struct<clause_type:string,clause_text:string>"
RISK_TYPE = "struct<risk:string,severity:string,reason:string>"


def analysis_struct(document_type: Column, parties: Column, effective_date: Column,
                    expiry_date: Column, contract_value: Column, governing_law: Column,
                    key_clauses: Column, risks: Column, risk_score: Column, mode: Column,
                    ai_error: Column) -> Column:
    """The analysis record with fixed field names and types."""
    return F.struct(
        document_type.cast("string").alias("document_type"),
        parties.cast("array<string>").alias("parties"),
        effective_date.cast("string").alias("effective_date"),
        expiry_date.cast("string").alias("expiry_date"),
        contract_value.cast("string").alias("contract_value"),
        governing_law.cast("string").alias("governing_law"),
        key_clauses.cast(f"array<{CLAUSE_TYPE}>").alias("key_clauses"),
        risks.cast(f"array<{RISK_TYPE}>").alias("risks"),
        risk_score.cast("bigint").alias("risk_score"),
        mode.cast("string").alias("mode"),
        ai_error.cast("string").alias("ai_error"),
    )


def empty_analysis(risk: tuple[str, str, str] | None = None) -> Column:
    """Default analysis (all empty), optionally with one synthetic risk."""
    risks = (F.array(F.struct(F.lit(risk[0]).alias("risk"), F.lit(risk[1]).alias("severity"),
                              F.lit(risk[2]).alias("reason")))
             if risk else F.array().cast(f"array<{RISK_TYPE}>"))
    e = F.lit("")
    return analysis_struct(e, F.array().cast("array<string>"), e, e, e, e,
                           F.array().cast(f"array<{CLAUSE_TYPE}>"), risks, F.lit(0), e, e)


def with_rule_analysis(df: DataFrame, text_col: str = "raw_text", out_col: str = "analysis",
                       keywords: list[str] | None = None,
                       risk_rules: list[tuple[str, str, str, str]] | None = None,
                       ai_error: str = "") -> DataFrame:
    """Add the rules-mode analysis struct of ``text_col`` as ``out_col``.

    ``keywords`` and ``risk_rules`` are parameters (defaults: the fixed
    lists).  A keyword counts when it occurs anywhere in the lowered text
    (substring, no word boundary); its clause text is the first paragraph
    containing it, or '' when it only occurs in short chunks.
    """
    keywords = C.CONTRACT_KEYWORDS if keywords is None else keywords
    risk_rules = C.RISK_RULES if risk_rules is None else risk_rules
    text = F.coalesce(F.col(text_col), F.lit(""))
    staged = (df.withColumn("_rl_lower", F.lower(text))
                .withColumn("_rl_paras", split_paragraphs(text))
                .withColumn("_rl_lparas", lower_all("_rl_paras")))
    lowered = F.col("_rl_lower")
    clauses = [
        F.when(lowered.contains(F.lit(kw)),
               F.struct(F.lit(kw.title()).alias("clause_type"),
                        best_paragraph("_rl_paras", "_rl_lparas", kw).alias("clause_text")))
        for kw in keywords
    ]
    risks = [
        F.when(~lowered.contains(F.lit(kw)),
               F.struct(F.lit(risk).alias("risk"), F.lit(sev).alias("severity"),
                        F.lit(reason).alias("reason")))
        for kw, risk, sev, reason in risk_rules
    ]
    key_clauses = (F.filter(F.array(*clauses), lambda x: x.isNotNull())
                   if clauses else F.array().cast(f"array<{CLAUSE_TYPE}>"))
    risk_arr = (F.filter(F.array(*risks), lambda x: x.isNotNull())
                if risks else F.array().cast(f"array<{RISK_TYPE}>"))
    staged = staged.withColumn("_rl_clauses", key_clauses).withColumn("_rl_risks", risk_arr)
    score = F.greatest(F.lit(0), F.lit(C.SCORE_BASE) - F.size("_rl_risks") * C.SCORE_STEP)
    e = F.lit("")
    analysis = analysis_struct(F.lit(C.RULES_DOCUMENT_TYPE), F.array().cast("array<string>"), e, e, e, e,
                               F.col("_rl_clauses"), F.col("_rl_risks"), score,
                               F.lit(C.RULES_MODE), F.lit(ai_error))
    return (staged.withColumn(out_col, analysis)
            .drop("_rl_lower", "_rl_paras", "_rl_lparas", "_rl_clauses", "_rl_risks"))


def keyword_matches(docs: DataFrame, keywords: list[str] | None = None, text_col: str = "raw_text") -> DataFrame:
    """Documents x keywords on substring (J4): ``document_id, k_ord, keyword``.

    The keywords are a parameter of the plan, so each is a literal that
    carries its own order and text: the text is lowered once, and there is
    no join and no exchange.
    """
    keywords = C.CONTRACT_KEYWORDS if keywords is None else keywords
    lowered = docs.select("document_id", F.lower(F.col(text_col)).alias("_lt"))
    schema = T.StructType([T.StructField("k_ord", T.IntegerType()), T.StructField("keyword", T.StringType())])
    return literal_matches(lowered, ["_lt"], [(kw.lower(), (i, kw)) for i, kw in enumerate(keywords)], schema).drop("_lt")
