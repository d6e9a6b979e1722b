"""Rule analysis on known texts, and traps."""

from pyspark.sql import functions as F

from clausework import constants as C
from clausework.operators.analysis import with_analysis
from clausework.operators.rules import with_rule_analysis


def analyse(spark, text):
    df = spark.createDataFrame([("d1", text)], "document_id string, raw_text string")
    return with_rule_analysis(df).select("analysis").first().analysis


def test_keywords_and_risks_of_known_texts(spark):
    every = set(C.CONTRACT_KEYWORDS)
    for text, present in (("Liability of the carrier ends at the quay.", {"liability"}),
                          ("SECURITY and Arbitration are set out in annex two.", {"security", "arbitration"}),
                          ("Nothing of note stands in this letter.", set()),
                          (" ".join(every), every)):
        a = analyse(spark, text)
        assert {c.clause_type.lower() for c in a.key_clauses} == present
        told = " ".join(r.risk.lower() for r in a.risks)
        assert ("governing law" in told) == ("governing law" not in present)
        assert a.risk_score in (60, 80, 100)


def test_without_responses_the_rules_answer(spark):
    df = spark.createDataFrame([("x", "A lease of two fields."), ("y", None)], "document_id string, raw_text string")
    rows = [r.analysis for r in with_analysis(df).select("analysis").collect()]
    assert [(a.mode, a.ai_error) for a in rows] == [(C.RULES_MODE, C.NO_KEY_ERROR)] * 2


def test_substring_without_word_boundary_and_empty_clause_text(spark):
    # 'payment' inside 'prepayments'; the only paragraph is too short -> '' (T6)
    a = analyse(spark, "Prepayments.")
    assert [(c.clause_type, c.clause_text) for c in a.key_clauses] == [("Payment", "")]


def test_clause_order_follows_keyword_list(spark):
    a = analyse(spark, "Arbitration applies to every dispute here.\n\nTermination on notice of thirty days.")
    assert [c.clause_type for c in a.key_clauses] == ["Termination", "Arbitration"]
    assert a.risk_score == 80


def test_clause_text_cut_at_1000(spark):
    a = analyse(spark, "Security " * 300)
    assert len(a.key_clauses[0].clause_text) == 1000


def test_fixture_corpus_counts(spark, sf):
    from clausework.operators.search import paragraph_table
    from clausework.operators.store import clauses_table, risks_table
    from clausework.sources import corpus as CP
    stored = CP.processed(spark, sf)
    analysed = with_rule_analysis(stored).withColumn("status", F.lit(C.STATUS_PROCESSED))
    assert clauses_table(analysed).count() == 290
    assert risks_table(analysed).count() == 170
    assert paragraph_table(stored).count() == 3247
    scores = {r.risk_score: r["count"] for r in analysed.groupBy("analysis.risk_score").count().collect()}
    assert scores == {60: 53, 80: 64, 100: 12}
    clauses = clauses_table(analysed)
    assert clauses.where(F.col("clause_text") == "").count() == 9
    assert clauses.where(F.length("clause_text") == 1000).count() == 9
    by_type = {r.clause_type: r["count"] for r in clauses.groupBy("clause_type").count().collect()}
    assert by_type == {"Termination": 64, "Confidentiality": 64, "Payment": 40, "Liability": 32,
                       "Governing Law": 24, "Security": 25, "Arbitration": 22, "Indemnity": 19}
