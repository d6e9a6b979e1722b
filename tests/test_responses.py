"""LLM responses as data: validity and score of each fixture response (T5)."""

import json

import pytest

from clausework import constants as C
from clausework.operators.analysis import with_response_checks

# (valid, score) per fixture index, FIXTURES.md section 5
EXPECTED = {0: (True, 40), 1: (True, 150), 2: (True, 0), 3: (False, None), 4: (False, None),
            5: (False, None), 6: (True, 85), 7: (False, None), 8: (True, 85), 9: (True, 0),
            10: (False, None), 11: (False, None), 12: (True, 0), 13: (False, None), 14: (False, None),
            15: (False, None), 16: (False, None), 17: (False, None), 18: (False, None), 19: (True, 1),
            20: (True, 0), 21: (True, 0), 22: (False, None), 23: (True, 0), 24: (True, 0),
            25: (False, None)}


def checked(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "document_id int, response_text string")
    return {r.document_id: r for r in with_response_checks(df).collect()}


def test_fixture_validity_and_scores(spark):
    rows = checked(spark, C.RESPONSE_FIXTURE)
    for i, (valid, score) in EXPECTED.items():
        assert rows[i].resp_valid is valid, (i, C.RESPONSE_FIXTURE[i])
        if valid:
            assert rows[i].resp_score == score, i


def test_error_codes(spark):
    rows = checked(spark, ["not json", '{"a": 1} tail', "[1]", '{"parties": "x"}', "{}"])
    assert [rows[i].resp_error for i in range(5)] == [C.ERR_INVALID_JSON, C.ERR_INVALID_JSON,
                                                      C.ERR_SCHEMA, C.ERR_SCHEMA, ""]


# (text, whether all of it is one JSON value)
STRICT = [("{}", True), (" [1, 2]\n", True), ("7", True), ('"x"', True), ("null", True), ("", False), (None, False), ("1,2", False),
          ('{"a":1},"b"', False), ("[1],[2", False), ('{"a":1}]', False), ('1,"' + "0" * 64 + '"] ', False), ("{} //", False),
          ('"open', False), ("{'a':1}", False), ("01", False), ('{"a":1,}', False), ('"\\u00e9 \\" ] , ["', True), ("tru", False)]


def test_parse_strict(spark):
    from clausework.functions.responses import parse_strict
    from pyspark.sql import functions as F
    rows = spark.createDataFrame(list(enumerate(t for t, _ in STRICT)), "i int, t string")
    got = {r.i: r.ok for r in rows.select("i", parse_strict(F.col("t")).isNotNull().alias("ok")).collect()}
    assert [got[i] for i in range(len(STRICT))] == [ok for _, ok in STRICT]


def test_checks_stay_in_the_jvm(spark):
    df = spark.createDataFrame([(1, "{}")], "document_id int, response_text string")
    plan = with_response_checks(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_parsed_fields(spark):
    from pyspark.sql import functions as F

    from clausework.operators.analysis import with_analysis
    docs = spark.createDataFrame([("d0", "Plain text."), ("d9", "Plain text."), ("dx", "Plain text.")],
                                 "document_id string, raw_text string")
    resp = spark.createDataFrame([("d0", C.RESPONSE_FIXTURE[0]), ("d9", C.RESPONSE_FIXTURE[9])],
                                 "document_id string, response_text string")
    out = {r.document_id: r.analysis for r in with_analysis(docs, resp).collect()}
    a0 = out["d0"]
    assert a0.mode == C.LLM_MODE and a0.parties == ["Acme Ltd", "Beta LLC"] and a0.risk_score == 40
    assert a0.key_clauses[0].clause_type == "Payment" and a0.risks[0].severity == "high"
    assert out["d9"].key_clauses[0].clause_text == ""  # missing field -> default ''
    assert out["dx"].mode == C.RULES_MODE and out["dx"].ai_error == C.NO_KEY_ERROR
    assert F is not None


@pytest.mark.parametrize("text", ['{"risk_score": NaN}', '{"a": 1, "a": 2}'])
def test_documented_deviation_nan_and_duplicate_keys(spark, text):
    # Python's json accepts both; Spark's VARIANT parser rejects them, so such
    # a response falls back to rules (documented in README).
    json.loads(text)
    assert checked(spark, [text])[0].resp_valid is False


def test_request_responses_hook(spark):
    from clausework.functions.responses import analysis_prompt
    from clausework.operators.analysis import request_responses, with_analysis
    from clausework.session import run_dir
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([("a", "Termination applies."), ("b", "Payment due."), ("c", "Other text.")],
                                 "document_id string, raw_text string")
    prompts = docs.select("document_id", analysis_prompt(F.col("raw_text")).alias("prompt"))

    def ask(prompt):  # stands in for a model client
        if "Termination" in prompt:
            return '{"document_type": "nda", "risk_score": 70}'
        if "Payment" in prompt:
            raise RuntimeError("timeout")
        return "no json here"

    resp = request_responses(prompts, ask, run_dir(spark, "test-responses"))
    out = {r.document_id: r.analysis for r in with_analysis(docs, resp).collect()}
    assert out["a"].mode == C.LLM_MODE and out["a"].risk_score == 70
    assert out["b"].mode == C.RULES_MODE and out["b"].ai_error == C.ERR_CALL_FAILED
    assert out["c"].ai_error == C.ERR_INVALID_JSON


def test_repeated_response_rows_give_one_document(spark):
    from clausework.operators.analysis import with_analysis
    docs = spark.createDataFrame([("d1", "Termination applies to this agreement in full."),
                                  ("d2", "Payment is due within thirty days of the invoice.")],
                                 "document_id string, raw_text string")
    good = json.dumps({"document_type": "lease", "risk_score": 70})
    responses = spark.createDataFrame(
        [("d1", "not json"), ("d1", good), ("d1", "not json"), ("d2", "{} tail"), ("d2", "also bad")],
        "document_id string, response_text string")
    rows = {r.document_id: r.analysis for r in with_analysis(docs, responses).collect()}
    assert len(rows) == 2
    # a usable response wins over unusable repeats
    assert rows["d1"].document_type == "lease" and rows["d1"].mode == C.LLM_MODE
    # none usable: rules, with the error of the smallest text
    assert rows["d2"].mode == C.RULES_MODE and rows["d2"].ai_error == C.ERR_INVALID_JSON
