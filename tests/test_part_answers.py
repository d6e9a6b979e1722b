"""Answers to the parts of a prompt folded into one analysis."""

import json

from clausework import constants as C
from clausework.functions.responses import prompt_parts
from clausework.operators.analysis import fold_part_answers


def test_parts_are_folded_in_order(spark):
    text = "x" * (2 * C.LLM_INPUT_CHARS + 5)
    prompts = prompt_parts(spark.createDataFrame([(d, text if d != "short" else "y") for d in ("whole", "missing", "bad", "short")], "document_id string, raw_text string"))
    answer = lambda **f: json.dumps(f)
    one = answer(document_type="", parties=["A", "B"], effective_date="2024", key_clauses=[{"clause_type": "Payment", "clause_text": "p"}], risks=[{"risk": "Cap", "severity": "low", "reason": "r0"}], risk_score=80)
    two = answer(document_type="lease", parties=["B", "C"], effective_date="2025", key_clauses=[{"clause_type": "Payment", "clause_text": "p"}, {"clause_type": "Payment", "clause_text": "q"}],
                 risks=[{"risk": " cap ", "severity": "High", "reason": "r1"}, {"risk": "Law", "severity": "medium", "reason": "r2"}], risk_score=35)
    three = "```json\n" + answer(document_type="nda", governing_law="England", risk_score=90) + "\n```"
    rows = [("whole", 2, three), ("whole", 0, one), ("whole", 1, two), ("whole", 1, "not json"), ("missing", 0, one), ("missing", 2, three), ("missing", 1, None),
            ("bad", 0, "[1]"), ("bad", 1, "not json"), ("bad", 2, three), ("short", 0, "{}"), ("nobody", 0, one)]
    got = {r.document_id: r for r in fold_part_answers(prompts, spark.createDataFrame(rows, "document_id string, part int, response_text string")).collect()}
    assert {d: (r.n_parts, r.n_used, r.ai_error) for d, r in got.items()} == {
        "whole": (3, 3, ""), "missing": (3, 2, C.ERR_PART_MISSING), "bad": (3, 1, C.ERR_SCHEMA), "short": (1, 1, "")}
    a = got["whole"].analysis
    assert (a.document_type, a.effective_date, a.governing_law, a.risk_score, a.parties) == ("lease", "2024", "England", 35, ["A", "B", "C"])
    assert [(c.clause_type, c.clause_text) for c in a.key_clauses] == [("Payment", "p"), ("Payment", "q")]
    assert [(r.risk, r.severity, r.reason) for r in a.risks] == [(" cap ", "High", "r1"), ("Law", "medium", "r2")]
    assert got["missing"].analysis is None and got["bad"].analysis is None and got["short"].analysis.risk_score == 0
