"""The stored index and the early-ending search against plain substring search."""

import datetime as dt
import random
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from clausework.operators import search as S
from clausework.operators import search_index as SI
from clausework.operators.newest import NewestFirst, slices_of, write_by_time

ALPHABET = "ab .%_ıßσς😀"
ROW = "document_id string, file_name string, uploaded_at timestamp_ntz, match_area string, area_rank int, pos long, title string, matched_text string, severity string, _t1 string, _t2 string"


def fixture(spark, n, seed, start=0):
    rnd = random.Random(seed)
    word = lambda lo, hi: "".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(lo, hi)))
    rows = []
    for i in range(start, start + n):
        texts = (word(0, 30), None if i % 7 == 0 else word(0, 6))
        when = None if i % 41 == 40 else dt.datetime(2024, 3, 31) + dt.timedelta(hours=i // 3)
        area = i % 3 + 1
        rows.append((f"d{i // 3}", f"f{i // 3}", when, S.AREAS[area], area, i // 3 % 2, "t", texts[0], None, *texts))
    return rows, spark.createDataFrame(rows, ROW)


def queries_of(spark, seed, n=80):
    rnd = random.Random(seed)
    texts = ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(1, 8))) for _ in range(n)]
    texts += ["", None, texts[0], "zzzz", "a", " ", "ab", "😀", "aaaaaaa"]
    return texts, spark.createDataFrame(list(enumerate(texts)), "query_id long, query_text string")


def plain_hits(rows, texts):
    return sorted((k, r[0], r[4], r[5]) for k, q in enumerate(texts) if q for r in rows
                  if q.lower() in (r[9] or "") or q.lower() in (r[10] or ""))


def test_index_equals_plain_search(spark, tmp_path):
    one, a = fixture(spark, 90, 1)
    two, b = fixture(spark, 60, 2, start=90)
    texts, queries = queries_of(spark, 3)
    index = SI.SearchIndex(spark, str(tmp_path / "i"))
    hits = lambda i, rows: sorted((r.query_id, r.document_id, r.area_rank, r.pos) for r in i.hits(queries, rows).collect())
    assert index.add("a", a) == 1 and hits(index, a) == plain_hits(one, texts)
    # a second batch is a second segment; a batch sent again adds nothing
    assert index.add("b", b) == 2 and index.add("b", b) is None
    both = a.unionByName(b)
    assert hits(index, both) == plain_hits(one + two, texts)
    assert hits(SI.SearchIndex(spark, index.store.path, version=1), a) == plain_hits(one, texts)
    index.merge("m")
    assert len(index.store.folders(SI.POSTINGS)[0]) == 1 and hits(index, both) == plain_hits(one + two, texts)
    areas = {(r.query_id, r.match_area): r.hits for r in index.counts(queries).collect()}
    want = {}
    for k, _, area, _ in plain_hits(one + two, texts):
        want[k, S.AREAS[area]] = want.get((k, S.AREAS[area]), 0) + 1
    assert {k: v for k, v in areas.items() if v} == want


def test_many_grams_meet_in_a_join(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(SI, "PUSHED_GRAMS", 3)
    one, a = fixture(spark, 60, 5)
    texts, queries = queries_of(spark, 6)
    index = SI.SearchIndex(spark, str(tmp_path / "i"))
    index.add("a", a)
    assert sorted((r.query_id, r.document_id, r.area_rank, r.pos) for r in index.hits(queries, a).collect()) == plain_hits(one, texts)


def test_a_search_reads_postings_of_its_grams_only(spark, tmp_path):
    rows, a = fixture(spark, 60, 7)
    index = SI.SearchIndex(spark, str(tmp_path / "i"))
    index.add("a", a)
    text = max((r[9] for r in rows), key=len)[2:7]
    keys = index.hit_keys(spark.createDataFrame([(1, text)], "query_id long, query_text string"))
    plan = keys._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    assert scans and all("_t1" not in s and "matched_text" not in s for s in scans)  # no text is read
    postings = [s for s in scans if "text_no" in s]
    assert postings and all("PushedFilters: [" in s and "gram" in s[s.index("PushedFilters"):] and "gram_part" in s[s.index("PartitionFilters"):] for s in postings)


def test_odd_indexes(spark, tmp_path):
    _, a = fixture(spark, 9, 8)
    index = SI.SearchIndex(spark, str(tmp_path / "i"))
    index.add("none", a.limit(0))
    _, queries = queries_of(spark, 9)
    assert index.hits(queries, a).count() == 0
    index.add("nulls", a.withColumns({"_t1": F.lit(None).cast("string"), "_t2": F.lit("")}))
    assert index.hits(queries, a).count() == 0


def test_newest_first_equals_whole_ranking(spark, tmp_path):
    rows, a = fixture(spark, 330, 11)
    texts, queries = queries_of(spark, 12, n=30)
    path = str(tmp_path / "rows")
    write_by_time(a, path, slice_seconds=3 * 3600)
    keys = S.hit_keys(a, S.text_patterns(queries))
    for n in (1, 4, 1000):
        want = sorted(map(str, S.top_hits(a, keys, queries, str(tmp_path / f"top-{n}"), n).collect()))
        search = NewestFirst(spark, path)
        assert sorted(map(str, search.top(queries, n).collect())) == want
    assert len(search.slices_read) == len(slices_of(spark, path))  # a query without hits asks them all
    # what many rows hold is answered from the newest slices; rarer texts need more of them
    read = {}
    for text in ("a", " ", "ab"):
        search = NewestFirst(spark, path)
        search.top(spark.createDataFrame([(1, text)], "query_id long, query_text string"), 4)
        read[text] = len(search.slices_read)
    assert read["a"] < len(slices_of(spark, path)) / 4 and read["a"] <= read["ab"]
    assert NewestFirst(spark, str(tmp_path / "empty")).top(queries, 3).count() == 0


def test_a_text_has_as_many_postings_as_words(spark, tmp_path):
    """the index grows with the words of the texts, not with their characters."""
    _, a = fixture(spark, 1, 13)
    index = SI.SearchIndex(spark, str(tmp_path / "i"))
    texts = a.withColumns({"_t1": F.lit("  one two\tthree \u00a0 four\n"), "_t2": F.lit(None).cast("string")})
    index.add("a", texts)
    found = index.store.read(SI.POSTINGS).orderBy("at").collect()
    assert [r.gram for r in found] == ["  one", " two", "\tthree", " \u00a0", " four", "\n"]
    asked = ["one two", "e two\tth", " ", "\n", "r\n", "\u00a0 f", "one  two", "two th", "\n ", "ne t", "  one two\tthree \u00a0 four\n"]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, query_text string")
    assert sorted(r.query_id for r in index.hits(queries, texts).collect()) == [0, 1, 2, 3, 4, 5, 9, 10]


def test_a_gram_of_neighbouring_rows_is_one_record(spark, tmp_path):
    """the index holds, sorts and moves a gram once for a block of rows, not once for each place; an intake moves no postings."""
    _, a = fixture(spark, 60, 14)
    texts = a.coalesce(1).withColumns({"_t1": F.lit("one two one"), "_t2": F.lit("two"), "area_rank": F.lit(3)})
    index = SI.SearchIndex(spark, str(tmp_path / "i"))
    index.add("a", texts)
    found = {r.gram: (r.places, len(r["at"])) for r in index.store.read(SI.POSTINGS).collect()}
    assert found == {"one": (60, 60), " two": (60, 60), " one": (60, 60), "two": (60, 60)} and index.store.read(SI.POSTINGS).count() == 4
    assert {r.gram: r.places for r in index.store.read(SI.GRAMS).collect()} == dict.fromkeys(found, 60)
    assert "Exchange" not in SI.segment_tables(texts, "s", str(tmp_path / "rows"))[SI.POSTINGS]._jdf.queryExecution().executedPlan().toString()


def test_blocks_answer_as_plain_search(monkeypatch):
    """rows cut into small blocks, two segments, records in small batches; queries marked and counted."""
    monkeypatch.setattr(SI, "BLOCK_PLACES", 15)
    monkeypatch.setattr(SI, "CELLS_AT_ONCE", 40)
    rnd = random.Random(15)
    word = lambda lo, hi: "".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(lo, hi))).lower()
    rows = [(i + (i // 20 << 33), i // 30 + 1, None if i % 9 == 0 else word(0, 25), word(0, 8)) for i in range(60)]
    queries = sorted({q for q in (word(1, 3) for _ in range(60)) if len(re.findall(SI.GRAM, q)) == 1} | {" ", "a", " "})
    one = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.string(), pa.string()))], names=["row", "area_rank", "_t1", "_t2"])
    records = [(s, r) for s in ("s", "t") for b in SI._blocks(iter([one.slice(0, 25), one.slice(25)])) for r in b.to_pylist()]
    assert len({r["base"] for _, r in records}) > 6
    batches = []
    for k in range(0, len(records), 7):
        some = [{"segment": s} | r for s, r in records[k:k + 7]]
        batches.append(pa.RecordBatch.from_pylist(some, pa.schema([("segment", pa.string()), ("base", pa.int64()), ("area_rank", pa.int32()), ("gram", pa.string()), ("row_text_no", pa.list_(pa.int32()))])))
    want = {(s, r, n) for s in ("s", "t") for r, _, *texts in rows for n, q in enumerate(queries) if any(q in t for t in texts if t)}
    got = [(r["segment"], r["row"], n) for b in SI._marks(queries, False)(iter(batches)) for r in b.to_pylist() for n in r["ns"]]
    assert len(got) == len(want) and set(got) == want
    counted = {}
    for r in (r for b in SI._marks(queries, True)(iter(batches)) for r in b.to_pylist()):
        counted[r["area_rank"], r["_n"]] = counted.get((r["area_rank"], r["_n"]), 0) + r["hits"]
    area = {r: a for r, a, *_ in rows}
    assert counted == {k: v for k, v in Counter((area[r], n) for _, r, n in want).items()}
