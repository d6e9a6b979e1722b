"""K-d shards against a brute-force tree, and on tables that leave nodes empty."""

import random

import pytest
from pyspark.sql import functions as F

from clausework.llm import sharding as S

SCHEMA = "doc_id long, text string, lang string, source string"


def plain_tree(rows, dims, n_shards):
    """Shards of ``(id, size, row, dims)`` by the rule of the docstring, one node after the other."""
    spread = [max(1, max(r[3][d] for r in rows) - min(r[3][d] for r in rows)) for d in range(len(dims))]
    out, todo = {}, [(rows, 0, n_shards)]
    while todo:
        here, first, k = todo.pop()
        if not here:
            continue
        if k == 1 or len(here) == 1:
            out.update({r[2]: first for r in here})
            continue
        span = [max(r[3][d] for r in here) - min(r[3][d] for r in here) for d in range(len(dims))]
        d = max(range(len(dims)), key=lambda d: (span[d] / spread[d], dims[d]))
        order = sorted(here, key=lambda r: (r[3][d], r[0], r[2]))
        wanted, below = sum(r[1] for r in here) * (k // 2) / k, 0
        at = len(order) - 1
        for i, r in enumerate(order):
            if below + r[1] > wanted:
                at = i
                break
            below += r[1]
        else:
            below -= order[-1][1]
        left = wanted - below
        cut = at + (abs(order[at][1] - left) < abs(left))
        todo += [(order[:cut], first, k // 2), (order[cut:], first + k // 2, k - k // 2)]
    return out


@pytest.mark.parametrize("n_shards", [2, 5, 48])
def test_equals_plain_tree(spark, monkeypatch, n_shards):
    monkeypatch.setattr(S, "LEVEL_BINS", 512)  # several rounds for each quantile
    rng = random.Random(n_shards)
    rows = [(rng.randint(0, 60), rng.randint(1, 900), i, (rng.choice([3, 5, 1000, 1 << 40]), rng.randint(0, 9), rng.choice([0, 0, 1]))) for i in range(300)]
    df = spark.createDataFrame([(i, z, r, *d) for i, z, r, d in rows], "id long, size long, row long, a long, b long, c long").repartition(4)
    got = {r.row: r.shard for r in S.kd_shards(df, ["a", "b", "c"], n_shards).collect()}
    assert got == plain_tree(rows, ["a", "b", "c"], n_shards)


def check(df, n_shards, **how):
    rows = S.shard_documents(df, n_shards=n_shards, **how).collect()
    by = {}
    for r in rows:
        assert 0 <= r.shard < n_shards
        by.setdefault(r.shard, []).append((r.slot, r.size))
    assert all(sorted(s for s, _ in v) == list(range(len(v))) for v in by.values())
    return {k: sum(z for _, z in v) for k, v in by.items()}, len(rows)


def test_tables_that_leave_nodes_empty(spark):
    few = spark.createDataFrame([(i, "t" * (i + 1), "en", "s") for i in range(3)], SCHEMA)
    sizes, n = check(few, 16)
    assert n == 3 and len(sizes) == 3
    big = spark.createDataFrame([(i, "t" * (100_000 if i == 7 else 50), "en", f"source-{i % 3}") for i in range(31)], SCHEMA)
    sizes, n = check(big, 16)
    assert n == 31 and max(sizes.values()) <= 100_001 + 51 * 30
    equal = spark.createDataFrame([(None, "same", None, None)] * 400, SCHEMA)
    sizes, n = check(equal, 16)
    assert n == 400 and set(sizes.values()) == {25 * 5}
    assert check(few.limit(0), 16) == ({}, 0)
    sizes, n = check(spark.createDataFrame([(i, "x" * (i % 50), "en", None) for i in range(3000)], SCHEMA), 2000)
    assert n == 3000 and max(sizes.values()) <= 150
    assert check(few, 1)[0] == {0: 2 + 3 + 4}


def test_long_names_are_told_apart(spark):
    """Names that share their first characters are dimensions by their whole strings."""
    ranks = {r.value: r["rank"] for r in S.ranked(spark.createDataFrame([(f"a-long-common-name-{i % 40:02}",) for i in range(200)] + [(None,), ("",)], "s string"), "s").collect()}
    assert [ranks[k] for k in sorted(ranks)] == list(range(1, 42))
    docs = spark.createDataFrame([(1, "t" * 10, "en", f"a-long-common-name-{i % 2}") for i in range(40)], SCHEMA).withColumn("row", F.lit("x"))
    sizes, _ = check(docs, 2)
    assert set(sizes.values()) == {220}


def test_node_tables_run_no_python_on_executors(spark):
    """The tables of nodes come from Arrow: no Python RDD stands under them."""
    table = S._node_table(spark, [(1, 2), (3, None)], S._schema(of="int64", cut="int64"))
    assert [tuple(r) for r in table.collect()] == [(1, 2), (3, None)]
    assert "Python" not in table._jdf.queryExecution().toRdd().toDebugString()
