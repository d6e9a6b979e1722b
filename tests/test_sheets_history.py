"""Numbered sheets without a task that sees all rows; a history kept by a stream."""

import datetime as dt
import random

from pyspark.sql import functions as F

from clausework.operators import sheets as SH
from clausework.operators.snapshots import Snapshots
from clausework.streaming import history_stream as H


def test_numbers_are_gapless_in_order(spark, tmp_path):
    rng = random.Random(1)
    rows = [(rng.choice([None, *range(40)]), i) for i in range(1000)]
    df = spark.createDataFrame(rows, "k long, i long").repartition(7)
    got = SH.in_sheets(df, [F.col("k").desc_nulls_last(), "i"], 300)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Window" not in plan
    want = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    assert [(r.k, r.i, r.number, r.sheet) for r in got.orderBy("number").collect()] == [(k, i, n + 1, n // 300) for n, (k, i) in enumerate(want)]
    assert SH.numbered(df.limit(0), ["i"]).count() == 0
    SH.write_sheets(df, ["i"], str(tmp_path / "sheets"), 400)
    sheets = spark.read.parquet(str(tmp_path / "sheets"))
    assert {r.sheet: r["count"] for r in sheets.groupBy("sheet").count().collect()} == {0: 400, 1: 400, 2: 200}


def test_history_equals_the_batch_count_after_replays(spark, tmp_path):
    log, store, checkpoint = (str(tmp_path / n) for n in ("log", "store", "checkpoint"))
    rng = random.Random(2)
    start, seen = dt.datetime(2024, 3, 30, 22), []

    def add(hours, n=60):
        rows = [(rng.choice(["pay", "law", None]), rng.randint(0, 9), start + dt.timedelta(hours=hours, minutes=rng.randint(0, 600))) for _ in range(n)]
        spark.createDataFrame(rows, H.LOG).coalesce(1).write.mode("append").parquet(log)
        seen.extend(rows)

    def want():
        out = {}
        for text, n, at in seen:
            a, b = out.get((at.date(), text), (0, 0))
            out[at.date(), text] = (a + 1, b + n)
        return out

    run = lambda: H.maintain(spark, log, store, checkpoint, max_files=1).awaitTermination()
    got = lambda v=None: {(r.day, r.query_text): (r.searches, r.results) for r in H.history(spark, store, v).collect()}
    add(0)
    run()
    first = want()
    assert got() == first
    add(20)
    add(30)
    run()
    assert got() == want() and got(1) == first
    run()  # nothing new
    # an epoch that runs again commits nothing, whatever it would write
    log_of = Snapshots(spark, store)
    again = log_of.batches()[-1]
    assert log_of.commit(again, {H.TABLE: log_of.read(H.TABLE)}) is None and got() == want()
    H.merge(spark, store, "merged")
    assert len(log_of.folders(H.TABLE)[0]) == 1 and got() == want()
    add(40)
    run()
    assert got() == want()
    # what comes later than the watermark is left out, with its day's state
    late = [("pay", 5, start - dt.timedelta(days=30))]
    add(24 * 10, 5)
    run()
    before = got()
    spark.createDataFrame(late, H.LOG).coalesce(1).write.mode("append").parquet(log)
    run()
    assert got() == before
