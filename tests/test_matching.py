"""Many-pattern matching: literals, the broadcast index and the shuffled
index all give the brute-force answer."""

import datetime as dt
import random

import pytest

from clausework.operators import matching as M
from clausework.operators import search as S
from clausework.operators.rules import keyword_matches

ALPHABET = "ab .%_İıßσς😀"


def _fixture(spark, seed=7, n_rows=300, n_pats=90):
    rnd = random.Random(seed)
    word = lambda lo, hi: "".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(lo, hi)))
    rows = [(i, word(0, 40).lower(), None if i % 17 == 0 else word(0, 10).lower(),
             dt.datetime(2024, 1, 1) + dt.timedelta(seconds=i)) for i in range(n_rows)]
    pats = [(j, word(1, 6).lower()) for j in range(n_pats)]
    pats.append((n_pats, pats[0][1]))   # the same text twice: both keys match
    pats.append((0, pats[0][1]))        # a row given twice counts once
    pats.append((None, pats[1][1]))     # a NULL key is a key
    pats += [(n_pats + 1, ""), (n_pats + 2, None)]  # match nothing
    rdf = spark.createDataFrame(rows, "id long, t1 string, t2 string, ts timestamp_ntz")
    pdf = spark.createDataFrame(pats, "pid long, p string")
    want = sorted({(i, str(j)) for i, a, b, _ in rows for j, p in pats
                   if p and (p in a or (b is not None and p in b))})
    return rdf, pdf, want


# literals, index sent to the executors, index shuffled
WAYS = [(1000, 10**6), (0, 10**6), (0, 0)]


@pytest.mark.parametrize("literal_max,broadcast_rows", WAYS)
def test_ways_match_brute_force(spark, monkeypatch, literal_max, broadcast_rows):
    monkeypatch.setattr(M, "LITERAL_MAX", literal_max)
    monkeypatch.setattr(M, "BROADCAST_ROWS", broadcast_rows)
    rdf, pdf, want = _fixture(spark)
    got = M.rows_containing(rdf, ["t1", "t2"], pdf, "p", "pid")
    assert got.columns == ["id", "t1", "t2", "ts", "pid"]
    rows = got.collect()
    assert sorted((r.id, str(r.pid)) for r in rows) == want
    assert all(r.ts == dt.datetime(2024, 1, 1) + dt.timedelta(seconds=r.id) for r in rows)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark, monkeypatch):
    rdf, pdf, _ = _fixture(spark, n_pats=10)
    literal = _plan(M.rows_containing(rdf, ["t1"], pdf, "p", "pid"))
    assert "Join" not in literal and "Exchange" not in literal
    words = _plan(keyword_matches(rdf.selectExpr("id AS document_id", "t1 AS raw_text")))
    assert "Join" not in words and "Exchange" not in words
    monkeypatch.setattr(M, "LITERAL_MAX", 0)
    sent = _plan(M.rows_containing(rdf, ["t1"], pdf, "p", "pid"))
    # the patterns travel to the texts, and the texts stay where they are
    assert "BroadcastHashJoin" in sent and "BuildRight" in sent and "NestedLoop" not in sent and "hashpartitioning" not in sent
    monkeypatch.setattr(M, "BROADCAST_ROWS", 0)
    assert "NestedLoop" not in _plan(M.rows_containing(rdf, ["t1"], pdf, "p", "pid"))


def test_keyword_matches_carry_order_and_text(spark):
    docs = spark.createDataFrame([("d1", "A Payment and a RENEWAL"), ("d2", None), ("d3", "")], "document_id string, raw_text string")
    got = keyword_matches(docs, ["renewal", "payment", "absent"]).collect()
    assert sorted(map(tuple, got)) == [("d1", 0, "renewal"), ("d1", 1, "payment")]


def _search_tables(spark):
    docs = spark.createDataFrame(
        [("d1", "a.txt", dt.datetime(2024, 1, 2), "Payment terms apply to every invoice sent.\n\nNone of this")],
        "document_id string, file_name string, uploaded_at timestamp_ntz, raw_text string")
    clauses = spark.createDataFrame([("d1", 0, "Payment", "Payment terms apply to every invoice sent.")],
                                    "document_id string, pos long, clause_type string, clause_text string")
    risks = spark.createDataFrame([("d1", 0, "Missing termination clause", "high", "why")],
                                  "document_id string, pos long, risk string, severity string, reason string")
    return docs, clauses, risks


def test_search_same_on_all_ways(spark, monkeypatch):
    queries = spark.createDataFrame([(1, "PAY"), (2, "high why"), (3, " "), (4, "zzz"), (5, None)],
                                    "query_id long, query_text string")
    cols = ["query_id", "match_area", "pos", "matched_text"]
    found = []
    for literal_max, broadcast_rows in WAYS:
        monkeypatch.setattr(M, "LITERAL_MAX", literal_max)
        monkeypatch.setattr(M, "BROADCAST_ROWS", broadcast_rows)
        found.append(sorted(tuple(r) for r in S.all_hits(*_search_tables(spark), queries).select(*cols).collect()))
    assert found[0] == found[1] == found[2]
    assert {(q, a) for q, a, _, _ in found[0]} == {(1, "Clause"), (1, "Raw Text"), (2, "Risk"), (3, "Clause"),
                                                   (3, "Risk"), (3, "Raw Text")}


def test_batch_search_repeated_texts_on_all_ways(spark, monkeypatch, tmp_path):
    """A text asked many times: every query id gets the counts and top rows of its text."""
    docs = spark.createDataFrame(
        [(f"d{i}", f"f{i}.txt", dt.datetime(2024, 1, 1) + dt.timedelta(seconds=i),
          "\n\n".join(f"Paragraph {j} of document {i} mentions payment terms." for j in range(3)))
         for i in range(30)],
        "document_id string, file_name string, uploaded_at timestamp_ntz, raw_text string")
    clauses = spark.createDataFrame([], "document_id string, pos long, clause_type string, clause_text string")
    risks = spark.createDataFrame([], "document_id string, pos long, risk string, severity string, reason string")
    texts = ["Payment", "document 1", "zzz"]
    queries = spark.createDataFrame([(i, texts[i % 3]) for i in range(120)], "query_id long, query_text string")
    want = {"payment": 90, "document 1": 11 * 3, "zzz": 0}  # d1, d10..d19
    for literal_max, broadcast_rows in WAYS:
        monkeypatch.setattr(M, "LITERAL_MAX", literal_max)
        monkeypatch.setattr(M, "BROADCAST_ROWS", broadcast_rows)
        out = S.batch_search(docs, clauses, risks, queries, str(tmp_path / f"bs{literal_max}-{broadcast_rows}"),
                             log_path=str(tmp_path / "log"))
        counts = {r.query_id: r.result_count for r in out["counts"].collect()}
        assert counts == {i: want[texts[i % 3].lower()] for i in range(120)}
        top = out["top"].collect()
        per_query = {}
        for r in top:
            per_query.setdefault(r.query_id, []).append((r["rank"], r.uploaded_at, r.pos, r.matched_text))
        assert {q: len(v) for q, v in per_query.items()} == {i: min(50, want[texts[i % 3].lower()])
                                                            for i in range(120) if i % 3 != 2}
        for v in per_query.values():
            v.sort()
            assert [r[0] for r in v] == list(range(1, len(v) + 1))
            assert v == sorted(v, key=lambda r: (-r[1].timestamp(), r[2]))
        first = out["top"].where("query_id = 0 AND rank = 1").collect()
        assert [(r.document_id, r.pos) for r in first] == [("d29", 0)]
        assert first[0].matched_text.startswith("Paragraph 0 of document 29")
    log = spark.read.parquet(str(tmp_path / "log"))
    assert log.count() == 3 * 120


def test_text_leaves_the_ranking_exchange(spark):
    docs, clauses, risks = _search_tables(spark)
    queries = spark.createDataFrame([(1, "pay")], "query_id long, query_text string")
    ranked = S.top_keys(S.hit_keys(S.area_rows(docs, clauses, risks), S.text_patterns(queries)))
    plan = _plan(ranked)
    assert "matched_text" not in plan.split("Exchange")[0] and "_salt" in plan


def test_a_failing_log_does_not_fail_the_search(spark, tmp_path):
    docs, clauses, risks = _search_tables(spark)
    queries = spark.createDataFrame([(1, "pay")], "query_id long, query_text string")
    (tmp_path / "file").write_text("in the way")
    out = S.batch_search(docs, clauses, risks, queries, str(tmp_path / "out"), log_path=str(tmp_path / "file"))
    assert out["counts"].first().result_count == 2


def test_texts_are_not_copied_for_each_word(spark, monkeypatch):
    """neither way carries the text beside its exploded words or grams."""
    monkeypatch.setattr(M, "LITERAL_MAX", 0)
    rdf, pdf, _ = _fixture(spark, n_pats=10)
    for broadcast_rows in (10**6, 0):
        monkeypatch.setattr(M, "BROADCAST_ROWS", broadcast_rows)
        plan = M.rows_containing(rdf, ["t1", "t2"], pdf, "p", "pid").select("id", "pid")._jdf.queryExecution().optimizedPlan().toString()
        exploded = [line.split("explode")[1] for line in plan.splitlines() if "Generate explode" in line]
        assert exploded and all("t1#" not in line.split("], ")[0].split("[")[-1] for line in exploded)


def test_finder_equals_substring_search():
    rnd = random.Random(3)
    word = lambda lo, hi: "".join(rnd.choice("ab c\u00a0\x1c") for _ in range(rnd.randint(lo, hi)))
    patterns = sorted({word(1, 14) for _ in range(400)} | {" ", "  ", "a", "abcabcabcabc", "\u00a0a"})
    find = M.finder(patterns)
    for _ in range(300):
        texts = [word(0, 60) for _ in range(rnd.randint(0, 2))] + ["abc" * 40] * rnd.randint(0, 1)
        assert sorted(find(texts)) == [p for p in patterns if any(p in t for t in texts)]
