"""Rules as a table against rules read one by one."""

import random

import pytest

from clausework import constants as C
from clausework.operators import rule_table as RT
from clausework.operators.rules import with_rule_analysis
from clausework.sources import corpus as CP

SCHEMA = "rule_id string, every array<string>, some array<string>, none array<string>"


def test_equals_rules_one_by_one(spark):
    rng = random.Random(5)
    keys = [f"k{a}{b}" for a in "abcdefgh" for b in "abcdefghijklmnopqrstu"]  # over two words of a bitmap
    docs = [(f"d{i}", " ".join(rng.choice(keys) for _ in range(rng.randint(0, 40)))) for i in range(60)] + [("null", None), ("upper", "KAA kab")]
    pick = lambda lo, hi: [rng.choice(keys) for _ in range(rng.randint(lo, hi))]
    rules = [(f"r{i}", pick(0, 2), pick(0, 3) if i % 2 else [], pick(0, 3)) for i in range(10_000)]
    rules += [("always", [], [], []), ("nulls", None, None, None), ("twice", ["kaa"], [], []), ("twice", ["kab"], [], []), ("odd", ["", None, "KAA"], [], ["zz"])]
    got = {(r.document_id, r.rule_id) for r in RT.evaluate(spark.createDataFrame(docs, "document_id string, raw_text string"), spark.createDataFrame(rules, SCHEMA)).collect()}
    want = set()
    for d, text in docs:
        low = (text or "").lower()
        for rule, *lists in rules:
            every, some, none = ([k.lower() for k in x or [] if k] for x in lists)
            if all(k in low for k in every) and (not some or any(k in low for k in some)) and not any(k in low for k in none):
                want.add((d, rule))
    assert got == want


def test_equals_the_present_keywords_and_rules(spark, sf):
    docs = CP.corpus(spark, sf)
    fixed = [(f"has:{k}", [k], [], []) for k in C.CONTRACT_KEYWORDS] + [(f"lacks:{risk}", [], [], [k]) for k, risk, *_ in C.RISK_RULES]
    got = {}
    for r in RT.evaluate(docs, spark.createDataFrame(fixed, SCHEMA)).collect():
        got.setdefault(r.document_id, set()).add(r.rule_id)
    for r in with_rule_analysis(docs).select("document_id", "analysis").collect():
        want = {f"has:{c.clause_type.lower()}" for c in r.analysis.key_clauses} | {f"lacks:{x.risk}" for x in r.analysis.risks}
        assert got.get(r.document_id, set()) == want


@pytest.mark.parametrize("sent", [10**6, 0])
def test_rows_of_one_document_meet_on_both_ways(spark, monkeypatch, sent):
    """rules in the tasks or in joins, the same rows: repeated and missing ids, no texts, no rules."""
    monkeypatch.setattr(RT, "SENT_RULES", sent)
    docs = spark.createDataFrame([("a", "one"), ("a", "two"), ("b", "two three"), ("c", None), (None, "one two")], "document_id string, raw_text string")
    rules = [("both", ["one", "two"], [], []), ("any", [], ["three", "one"], []), ("not", [], [], ["three"]), ("all", None, None, None), (None, ["two"], [], ["one"]), ("any", ["two"], [], [])]
    got = sorted((str(r.document_id), str(r.rule_id)) for r in RT.evaluate(docs, spark.createDataFrame(rules, SCHEMA)).collect())
    always = [(d, "all") for d in ("a", "b", "c", "None")] + [(d, "not") for d in ("a", "c", "None")]
    assert got == sorted([*always, ("a", "both"), ("a", "any"), ("b", "any"), ("b", "None")])
    assert RT.evaluate(docs, spark.createDataFrame([], SCHEMA)).count() == 0


def test_rules_of_a_small_table_need_no_join_with_hits(spark):
    """what a document has is one row of numbers; before, each keyword of a document was a row that was written and joined."""
    docs = spark.createDataFrame([("a", "one two")], "document_id string, raw_text string")
    rules = spark.createDataFrame([(f"r{i}", [f"k{i}"], [], [f"k{i + 1}"]) for i in range(200)], SCHEMA)
    plan = RT.evaluate(docs, rules)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "rule-hits" not in plan
