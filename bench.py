"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query runs once to warm up and then ``$BENCH_REPEAT`` times; the median
is reported.  Read-only queries are forced to completion with the ``noop``
sink (every column computed, nothing collected); queries that write go to a
fresh folder under the shared folder each run.  Prints one JSON line.

Queries:
  rule_analysis           keyword-rule analysis of every processed document
  split_paragraphs        paragraph table of every processed document
  analysis_with_fallback  LLM responses joined and validated, rules fallback
  store_build             intake analysis persisted + all seven store tables written
  batch_search            20 queries over the written store: per-area counts
                          written once, totals, and top 50 per query
  report_clauses          Clauses sheet from the written store, newest first

Reported beside them (``more``, not in the total), one run each after a warm-up
search: ``index_build``, the stored search index over the store's rows, and
``indexed_search``, 1,000 words of ``benchmark`` counted from its postings.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from clausework.functions.arrays import explode_with_pos  # noqa: E402
from clausework.functions.text import split_paragraphs  # noqa: E402
from clausework.operators import reports as RP  # noqa: E402
from clausework.operators import search as S  # noqa: E402
from clausework.operators import search_index as SI  # noqa: E402
from clausework.operators import store as ST  # noqa: E402
from clausework.operators.analysis import with_analysis  # noqa: E402
from clausework.operators.rules import with_rule_analysis  # noqa: E402
from clausework.session import build_session, run_dir  # noqa: E402
from clausework.sources import corpus as CP  # noqa: E402

# Twenty search texts: the nine fixture queries plus eleven words.
BENCH_QUERIES = ["payment", "tion", "Governing Law", "none", "missing high", "%", " ", "zzzz", "payment",
                 "termination", "confidential", "liability", "security", "arbitration", "indemnity",
                 "notice", "agreement", "fees", "court", "state"]


def noop(df):
    df.write.format("noop").mode("overwrite").save()


def build_store(spark, sf):
    path = run_dir(spark, "bench-store")
    analysed = ST.persist_analysed(ST.analyse_files(CP.corpus(spark, sf)), path)
    ST.Store.from_analysed(analysed).write(path)
    return path


def headline(spark, sf):
    store_path = build_store(spark, sf)  # the written store searched and reported on
    queries = spark.createDataFrame(list(enumerate(BENCH_QUERIES, start=1)), "query_id BIGINT, query_text STRING")

    def rule_analysis():
        noop(with_rule_analysis(CP.processed(spark, sf)))

    def split_paragraphs_q():
        noop(explode_with_pos(CP.processed(spark, sf), ["document_id"], split_paragraphs("raw_text"),
                              "pos", "paragraph"))

    def analysis_with_fallback():
        noop(with_analysis(CP.processed(spark, sf), CP.responses(spark, sf)))

    def store_build():
        build_store(spark, sf)

    def batch_search():
        st = ST.Store.read(spark, store_path)
        out = S.batch_search(st.documents, st.clauses, st.risks, queries, run_dir(spark, "bench-search"),
                             paragraphs=st.paragraphs)
        for name in ("counts", "areas", "top"):
            noop(out[name])

    def report_clauses():
        st = ST.Store.read(spark, store_path)
        noop(RP.report_children(st.clauses, st.documents, ["clause_type", "clause_text"]))

    return {"rule_analysis": rule_analysis, "split_paragraphs": split_paragraphs_q,
            "analysis_with_fallback": analysis_with_fallback, "store_build": store_build,
            "batch_search": batch_search, "report_clauses": report_clauses}


def indexed(spark, sf):
    """Seconds of building the stored index and of 1,000 queries over it."""
    st = ST.Store.read(spark, build_store(spark, sf))
    index = SI.SearchIndex(spark, run_dir(spark, "bench-index"))
    built = timed(lambda: index.add("all", S.area_rows(st.documents, st.clauses, st.risks, st.paragraphs)))
    words = CP.word_queries(spark, sf).orderBy("query_id").limit(1000)
    noop(index.counts(words))
    return {"index_build": round(built, 3), "indexed_search": round(timed(lambda: noop(index.counts(words))), 3)}


def timed(fn):
    t0 = time.perf_counter()
    fn()
    return time.perf_counter() - t0


def main():
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    spark = build_session(cpus=cpus, app_name="clausework-bench")
    times = {}
    for name, fn in headline(spark, sf).items():
        timed(fn)  # warm-up
        times[name] = round(statistics.median(timed(fn) for _ in range(repeat)), 3)
    sf_label = os.path.basename(sf.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total_median", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "more": indexed(spark, sf), "sf": sf_label}))
    spark.stop()


if __name__ == "__main__":
    main()
