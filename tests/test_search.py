"""Search: hit counts of the fixture queries (FIXTURES.md section 4), NULL
fields, the 50 cap and the count before it."""

from pyspark.sql import functions as F

from clausework.operators import search as S
from clausework.plans import catalog as Q

# query_id -> (clause, risk, raw) hits at sf0.001
EXPECTED = {1: (40, 0, 31), 2: (86, 65, 1292), 3: (24, 105, 24), 4: (0, 0, 34), 5: (0, 65, 0),
            6: (0, 0, 12), 7: (281, 170, 3247), 8: (0, 0, 0), 9: (40, 0, 31)}


def test_fixture_hit_counts(spark, sf):
    rows = Q.q_batch_search(spark, sf).collect()
    got = {}
    for r in rows:
        got.setdefault(r.query_id, {})[r.match_area] = r.hits
    for qid, (c, k, p) in EXPECTED.items():
        assert (got[qid]["Clause"], got[qid]["Risk"], got[qid]["Raw Text"]) == (c, k, p), qid


def test_counts_before_cap_and_top50(spark, sf):
    counts = {r.query_id: r.result_count for r in Q.q_search_result_count(spark, sf).collect()}
    assert counts[2] == 86 + 65 + 1292 and counts[8] == 0
    top = Q.q_search_top50(spark, sf)
    per_q = {r.query_id: r["count"] for r in top.groupBy("query_id").count().collect()}
    assert per_q[2] == 50 and 8 not in per_q
    ranks = sorted(r["rank"] for r in top.where(F.col("query_id") == 2).collect())
    assert ranks == list(range(1, 51))


def test_null_fields(spark):
    docs = spark.createDataFrame([("d1", "f.txt", None, "")],
                                 "document_id string, file_name string, uploaded_at timestamp_ntz, raw_text string")
    clauses = spark.createDataFrame([("d1", 0, None, "Some text")],
                                    "document_id string, pos long, clause_type string, clause_text string")
    risks = spark.createDataFrame([("d1", 0, "r", None, "why")],
                                  "document_id string, pos long, risk string, severity string, reason string")
    queries = spark.createDataFrame([(1, "none"), (2, "some"), (3, "r none why")], "query_id long, query_text string")
    hits = S.all_hits(docs, clauses, risks, queries).collect()
    areas = sorted((h.query_id, h.match_area) for h in hits)
    # NULL severity renders as 'None' and matches; NULL clause type is ''
    assert areas == [(1, "Risk"), (2, "Clause"), (3, "Risk")]


def test_whole_clause_is_searched_and_prompts_cover_whole_text(spark):
    from pyspark.sql import functions as F

    from clausework import constants as C
    from clausework.functions.responses import analysis_prompt, prompt_parts
    from clausework.operators import search as S
    from clausework.operators.rules import with_rule_analysis
    from clausework.operators.store import clauses_table
    long = "Termination " + "on notice " * 3000 + "zebra"
    docs = spark.createDataFrame([("a", long), ("b", "Payment is due in thirty days."), ("c", None)], "document_id string, raw_text string")
    files = docs.where("raw_text is not null").withColumns({"file_name": F.lit("f"), "uploaded_at": F.lit(0).cast("timestamp"), "status": F.lit(C.STATUS_PROCESSED)})
    clauses = clauses_table(with_rule_analysis(files))
    assert {(r.clause_text, r.clause_text_full) for r in clauses.collect()} == {(long[:1000], long), ("Payment is due in thirty days.",) * 2}
    query = spark.createDataFrame([(1, "Zebra")], "query_id int, query_text string")
    assert S.hits_of(S.clause_rows(clauses), query).count() == 0
    assert [r.document_id for r in S.hits_of(S.clause_rows(clauses, "clause_text_full"), query).collect()] == ["a"]
    parts = {(r.document_id, r.part): r.prompt for r in prompt_parts(docs).collect()}
    assert set(parts) == {("a", 0), ("a", 1), ("a", 2), ("b", 0), ("c", 0)}
    assert "".join(parts["a", k][len(C.PROMPT_TEMPLATE):] for k in range(3)) == long
    assert all(r.p == parts[r.document_id, 0] for r in docs.select("document_id", analysis_prompt(F.col("raw_text")).alias("p")).collect())
