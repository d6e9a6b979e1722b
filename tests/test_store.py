"""Store tables, outcomes, logs and reports over the fixture corpus."""

from pyspark.sql import functions as F

from clausework import constants as C
from clausework.operators import reports as RP
from clausework.operators import store as ST
from clausework.session import run_dir
from clausework.sources import corpus as CP


def test_outcome_counts(spark, sf):
    st = ST.Store.from_analysed(ST.analyse_files(CP.corpus(spark, sf)))
    counts = RP.processed_count(st.outcomes).first()
    assert (counts.n_skipped, counts.n_failed, counts.n_processed) == (66, 5, 129)
    assert counts.processed_count == 200
    log = {r.status: r["count"] for r in st.upload_log.groupBy("status").count().collect()}
    assert log == {C.STATUS_PROCESSED: 129, C.LOG_STATUS_FAILED: 5}  # skipped files are not logged
    failed = st.upload_log.where(F.col("status") == C.LOG_STATUS_FAILED).first()
    assert failed.risk_score is None and failed.document_type == "" and failed.gcs_path is None


def test_write_and_read_back(spark, sf):
    path = run_dir(spark, "test-store")
    analysed = ST.persist_analysed(ST.analyse_files(CP.corpus(spark, sf), CP.responses(spark, sf)), path)
    st = ST.Store.from_analysed(analysed)
    st.write(path)
    back = ST.Store.read(spark, path)
    assert back.documents.count() == 129
    assert back.clauses.count() == st.clauses.count()
    assert back.parties.count() > 0
    # every child row has its parent (one analysed frame feeds all tables)
    assert back.clauses.join(back.documents, "document_id", "left_anti").count() == 0
    # point lookup reaches the parquet scan as an equality filter
    one = back.documents.select("document_id").first().document_id
    plan = ST.lookup_children(back.clauses, one)._jdf.queryExecution().toString()
    assert f"EqualTo(document_id,{one})" in plan


def test_reports(spark, sf):
    st = ST.Store.from_analysed(ST.analyse_files(CP.corpus(spark, sf)))
    docs = RP.report_documents(st.documents)
    assert docs.columns == RP.REPORT_DOCUMENT_COLUMNS
    first = docs.first()
    newest = st.documents.orderBy(F.col("uploaded_at").desc()).first()
    assert first.document_id == newest.document_id
    assert RP.has_documents(st.documents).first().has_documents is True
    assert RP.has_documents(st.documents.limit(0)).first().has_documents is False
    raw = RP.report_raw_text(st.documents)
    assert raw.agg(F.max(F.length("raw_text"))).first()[0] <= C.REPORT_TEXT_CHARS
    out = RP.write_report(st.documents, st.parties, st.clauses, st.risks, run_dir(spark, "test-report"))
    assert set(out) == set(RP.SHEETS)
    # an empty sheet keeps its schema
    assert spark.read.parquet(out["parties"]).columns == ["document_id", "file_name", "party_name"]


def test_result_cards(spark, sf):
    st = ST.Store.from_analysed(ST.analyse_files(CP.corpus(spark, sf)))
    cards = {r.status: r for r in RP.result_cards(st.outcomes).collect()}
    assert cards["skipped"].score_display == " / 100"
    assert cards["failed"].risks_display == "HIGH — No text extracted"
    assert cards["processed"].gcs_display == C.NOT_UPLOADED
    assert cards["processed"].parties_display == C.NOT_DETECTED


def test_search_log_appends(spark, sf, tmp_path):
    from clausework.operators import search as S
    st = ST.Store.from_analysed(ST.analyse_files(CP.corpus(spark, sf)))
    q = CP.search_queries(spark)
    counts = S.batch_search(st.documents, st.clauses, st.risks, q, str(tmp_path / "search"))["counts"]
    path = run_dir(spark, "test-searchlog")
    RP.append_search_log(counts, path)
    RP.append_search_log(counts, path)
    log = spark.read.parquet(path)
    assert log.count() == 18  # the repeated text is logged once per asking
    assert log.where(F.col("query_text") == "zzzz").select("result_count").distinct().first()[0] == 0


def test_histories_newest_first(spark, sf):
    st = ST.Store.from_analysed(ST.analyse_files(CP.corpus(spark, sf)))
    hist = ST.upload_history(st.upload_log).collect()
    assert len(hist) == 134 and len(hist[0]) == 8
    times = [r.uploaded_at for r in hist]
    assert times == sorted(times, reverse=True)
    searches = ST.search_history(CP.search_log_input(spark, sf)).collect()
    assert [r.searched_at for r in searches] == sorted((r.searched_at for r in searches), reverse=True)
    assert searches[0].__fields__ == ["query_text", "result_count", "searched_at"]
