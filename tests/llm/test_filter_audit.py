"""The filter audit against brute force, on small and odd tables."""

import random
import re
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from clausework.llm import filter_audit as A


def plain_mask(i, rows):
    doc, text = rows[i][0], rows[i][1] or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", text)
    smaller = any((r[1] or "") == text and r[0] is not None and (doc is None or r[0] < doc) for r in rows)
    return [len(ws) < 200, 100 * len(set(ws)) < 50 * len(ws), 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), bool(re.search("[#$%&*|]", text)), smaller]


def plain_audit(rows, labels):
    marks = [plain_mask(i, rows) for i in range(len(rows))]
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    out, shapley = {}, {}
    for part in {r[2] or "" for r in rows}:
        mine = [(r[0], m) for r, m in zip(rows, marks) if (r[2] or "") == part]
        for order in permutations(range(5)):
            left = list(mine)
            for k, f in enumerate(order):
                gone = [x for x in left if x[1][f]]
                left = [x for x in left if not x[1][f]]
                fails = sum(m[f] for _, m in mine)
                out[part, "".join("ABCDE"[x] for x in order), k + 1] = [
                    len(left), len(gone), fails - len(gone), sum(m[f] and sum(m) == 1 for _, m in mine),
                    sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone)]
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
    return {key: (*v, shapley[key[0], "ABCDE".index(key[1][key[2] - 1])]) for key, v in out.items()}


def rows_of(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    texts = [None, "", " \n", "A", "AB", "ABCD", "ABCDE", "one $ two", " ".join(rng.choice(words) for _ in range(260)), " ".join(words[:250]), "x y " * 150,
             "Same start of a text " + "é" * 50, "Same start of a text " + "é" * 51, "Same start of a text " + "日" * 50 + " end", "UP and DOWN " * 90, "long " * 4000]
    rows = [(i, rng.choice(texts), rng.choice(["en", "de", None, ""])) for i in range(220)]
    rows += [(None, texts[8], "en"), (None, "only here", "en"), (7, texts[9], "de"), (7, texts[9], "de"), (500, "only here too", "en")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("limits", [{}, {"block_bytes": 200, "range_bytes": 300}])
def test_audit_equals_brute_force(spark, monkeypatch, limits):
    monkeypatch.setattr(A, "FAN_IN", 3)
    rows = rows_of(len(limits))
    labels = [(i, i % 2, int(i % 7 == 0)) for i in range(0, 200, 3)] + [(3, 1, 1), (None, 1, 1), (9, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(7).withColumns({c: F.lit("x") for c in ("part", "mask", "term", "least", "key", "n")})
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("good", F.lit(5))
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley)
           for r in A.audit(docs, marks, **limits).collect()}
    assert got == plain_audit(rows, labels)


def test_trie_holds_least_ids():
    rng = random.Random(1)
    trie, want, number = A.TextTrie(), {}, {}
    for _ in range(3000):
        text = "".join(rng.choice("abé日") for _ in range(rng.randint(0, 6))) * rng.choice([1, 1, 40])
        i = rng.choice([None, rng.randint(0, 99)])
        t = trie.insert(text, i)
        assert number.setdefault(text, t) == t
        want[text] = min([x for x in (want.get(text), i) if x is not None], default=None)
    assert {x: trie.least[t] for x, t in number.items()} == want and len(set(number.values())) == len(number)


def test_prefixes_are_split_until_light(spark):
    """No key but a whole text weighs more than its share, and equal texts share a key."""
    texts = [f"The common beginning of many texts, number {i % 400}" for i in range(800)] + ["The "] * 300 + ["The c"] * 40 + [""] * 30
    entries = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "term long, text string, least long")
    keyed, whole = A._prefix_keys(entries, 2000)
    rows = keyed.collect()
    weight = {}
    for r in rows:
        assert r.text.startswith(r.key)
        weight[r.key] = weight.get(r.key, 0) + len(r.text) + 16
    assert whole and len(rows) == len(texts) and len({(r.text, r.key) for r in rows}) == len(set(texts))
    assert all(w <= 2000 for k, w in weight.items() if k not in texts)
    assert {r.text: r.salts for r in rows if r.salts > 1} == {"The ": 3}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert A.audit(docs, spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")).count() == 0
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = A.audit(docs.union(spark.createDataFrame([(None, None, None)], docs.schema)), none).collect()
    assert len(one) == 600 and sum(r.removed for r in one) == 120 and {r.part for r in one} == {""}
