"""Only the newest parts of a text's hits are ranked."""

import datetime as dt
import random

from pyspark.sql import functions as F

from clausework.operators import search as S


def test_newest_parts_hold_the_first_hits(spark):
    """hits that cannot be shown are left out before they are sorted, and none that can."""
    rnd = random.Random(9)
    keys = [(rnd.choice("abc"), None if i % 50 == 0 else dt.datetime(2024, 1, 1) + dt.timedelta(seconds=rnd.choice([5, i, 90 * i])), f"d{i}", 1, i) for i in range(900)]
    keys += [("none", None, "d1", 1, 1), ("none", None, "d2", 1, 1)]
    df = spark.createDataFrame(keys, "q string, uploaded_at timestamp_ntz, document_id string, area_rank int, pos long")
    few = S.newest_keys(df, 5)
    assert few.count() < 100
    assert sorted(map(str, S.top_keys(few, 5).collect())) == sorted(map(str, S.top_keys(df, 5).collect()))
    for same in (df.where("uploaded_at is null"), df.limit(0), df.withColumn("uploaded_at", F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00")))):
        assert S.newest_keys(same, 5).count() == same.count()
