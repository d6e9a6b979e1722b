"""Tables laid out by document: joins without an exchange, lookups that read one bucket."""

import re

from clausework.operators import bucketed as B
from clausework.operators import store as ST
from clausework.sources import corpus as CP


def plan_of(df):
    df.collect()  # the final plan
    return df._jdf.queryExecution().executedPlan().toString()


def test_joins_without_exchange_and_lookups_of_one_bucket(spark, sf, tmp_path):
    st = ST.Store.from_analysed(ST.analyse_files(CP.corpus(spark, sf), CP.responses(spark, sf)))
    path = str(tmp_path / "published")
    B.publish(st, path, buckets=8)
    published = B.Published(spark, path)  # declared again from the layout beside the data
    for name in ("parties", "clauses", "risks"):
        joined = published.with_documents(name)
        want = ST.with_document(ST.child_view(getattr(st, name), name), st.documents)
        assert sorted(map(str, joined.select(*want.columns).collect())) == sorted(map(str, want.collect()))
        plan = plan_of(joined)
        assert "SortMergeJoin" in plan and "Exchange" not in plan and "raw_text" not in plan
        one = st.documents.orderBy("document_id").first().document_id
        lookup = published.children(name, one)
        assert sorted(map(str, lookup.collect())) == sorted(map(str, ST.child_view(ST.lookup_children(getattr(st, name), one), name).collect()))
        spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # the plan tells of buckets only so
        try:
            assert re.search(r"SelectedBucketsCount: 1 out of 8", plan_of(published.children(name, one)))
        finally:
            spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    assert published.children("clauses", "no such document").count() == 0
    empty = ST.Store.from_analysed(ST.analyse_files(CP.corpus(spark, sf).limit(0)))
    assert B.publish(empty, str(tmp_path / "empty"), buckets=4).with_documents("clauses").count() == 0
