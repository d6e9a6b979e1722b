"""Named queries: one callable per operator key of SURVEY section 2.

Each takes ``(spark, sf_dir)`` and returns a DataFrame over the whole input
tables (or data Spark derives from them).  Arrays and structs are flattened
so that results compare with the DuckDB oracle (``plans/oracle.py``);
counts and positions are BIGINT on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clausework import constants as C
from clausework.functions import responses as R
from clausework.functions.arrays import explode_with_pos
from clausework.functions import text as T
from clausework.operators import bucketed as B
from clausework.operators import landing as LD
from clausework.operators import reports as RP
from clausework.operators import search as S
from clausework.operators import search_index as SI
from clausework.operators import rule_table as RT
from clausework.operators import sheets as SH
from clausework.operators import store as ST
from clausework.operators import upload as UP
from clausework.operators.newest import NewestFirst, write_by_time
from clausework.operators.analysis import fold_part_answers, normalized, with_analysis, with_response_checks
from clausework.operators.rules import keyword_matches, with_rule_analysis
from clausework.session import run_dir
from clausework.sources import corpus as CP
from clausework.sources import intake as IN
from clausework.sources.tables import load

Query = Callable[[SparkSession, str], DataFrame]

DEMO_BUCKET = "contract-archive"


# --------------------------------------------------------------------------
# shared building blocks
# --------------------------------------------------------------------------

def _rules_store(spark, sf) -> ST.Store:
    return ST.Store.from_analysed(ST.analyse_files(CP.corpus(spark, sf)))


def _llm_store(spark, sf) -> ST.Store:
    return ST.Store.from_analysed(ST.analyse_files(CP.corpus(spark, sf), CP.responses(spark, sf)))


def _rule_analysed(spark, sf) -> DataFrame:
    return with_rule_analysis(CP.corpus(spark, sf))


def _search_rows(spark, sf) -> DataFrame:
    st = _rules_store(spark, sf)
    return S.area_rows(st.documents, st.clauses, st.risks, st.paragraphs)


def _search(spark, sf, queries: DataFrame) -> dict[str, DataFrame]:
    st = _rules_store(spark, sf)
    return S.batch_search(st.documents, st.clauses, st.risks, queries, run_dir(spark, "search"), paragraphs=st.paragraphs)


def _joined(arr, field: str | None = None):
    """Array flattened to one '|'-joined string (empty array -> '')."""
    if field is not None:
        arr = F.transform(arr, lambda x: x[field])
    return F.array_join(arr, "|")


def _n(arr):
    return F.size(arr).cast("bigint")


# --------------------------------------------------------------------------
# step 1: text rules and clauses
# --------------------------------------------------------------------------

def q_split_paragraphs(spark, sf):
    return explode_with_pos(CP.corpus(spark, sf), ["document_id"], T.split_paragraphs("raw_text"),
                            "pos", "paragraph")


def q_strip_text(spark, sf):
    conv = load(spark, sf, "conversations")
    return conv.select(F.col("conv_id").alias("conv_id"), F.col("turn").alias("turn"),
                       T.strip_ws("text").alias("stripped"),
                       F.length("text").cast("bigint").alias("n_before"),
                       F.length(T.strip_ws("text")).cast("bigint").alias("n_after"))


def q_lower_fold(spark, sf):
    return CP.corpus(spark, sf).select("document_id", F.lower("raw_text").alias("lower_text"))


def q_best_paragraph(spark, sf):
    docs = (CP.corpus(spark, sf).select("document_id", T.split_paragraphs("raw_text").alias("p"))
            .withColumn("lp", T.lower_all("p")))
    per_kw = F.array(*[F.struct(F.lit(kw).alias("keyword"),
                                T.best_paragraph("p", "lp", kw).alias("best_paragraph"))
                       for kw in C.CONTRACT_KEYWORDS])
    return docs.select("document_id", F.inline(per_kw))


def q_keyword_matches(spark, sf):
    m = keyword_matches(CP.corpus(spark, sf))
    return m.select("document_id", F.col("k_ord").cast("bigint").alias("k_ord"), "keyword")


def q_clause_title(spark, sf):
    m = keyword_matches(CP.corpus(spark, sf))
    return m.select("document_id", "keyword", T.title_case("keyword").alias("clause_type"))


def q_rule_clauses(spark, sf):
    return ST.child_view(ST.clauses_table(_rule_analysed(spark, sf).withColumn("status", F.lit(C.STATUS_PROCESSED))),
                         "clauses")


# --------------------------------------------------------------------------
# step 2: risks, score, analysis record
# --------------------------------------------------------------------------

def q_rule_risks(spark, sf):
    return ST.child_view(ST.risks_table(_rule_analysed(spark, sf).withColumn("status", F.lit(C.STATUS_PROCESSED))),
                         "risks")


def q_risk_score(spark, sf):
    return _rule_analysed(spark, sf).select("document_id", F.col("analysis.risk_score").alias("risk_score"))


def _flat_analysis(df, extra=()):
    a = lambda f: F.col(f"analysis.{f}")
    return df.select(
        "document_id", *extra,
        a("document_type").alias("document_type"),
        _joined(a("parties")).alias("parties"), _n(a("parties")).alias("n_parties"),
        a("effective_date").alias("effective_date"), a("expiry_date").alias("expiry_date"),
        a("contract_value").alias("contract_value"), a("governing_law").alias("governing_law"),
        _joined(a("key_clauses"), "clause_type").alias("clause_types"),
        _n(a("key_clauses")).alias("n_clauses"),
        _joined(a("risks"), "risk").alias("risk_names"), _n(a("risks")).alias("n_risks"),
        a("risk_score").cast("bigint").alias("risk_score"), a("mode").alias("mode"),
        a("ai_error").alias("ai_error"))


def q_rule_analysis(spark, sf):
    return _flat_analysis(_rule_analysed(spark, sf))


def q_normalize_analysis(spark, sf):
    n = normalized(with_analysis(CP.processed(spark, sf)))
    return n.select("document_id", "file_name", "document_type", _n("parties").alias("n_parties"),
                    "effective_date", "expiry_date", "contract_value", "governing_law",
                    _n("key_clauses").alias("n_clauses"), _n("risks").alias("n_risks"),
                    F.col("risk_score").cast("bigint").alias("risk_score"), "mode", "gcs_path",
                    "raw_text")


def q_prefix_cuts(spark, sf):
    c = CP.corpus(spark, sf)
    return c.select("document_id", *[T.prefix("raw_text", n).alias(f"cut_{n}") for n in
                                     (C.CLAUSE_TEXT_CHARS, C.SEARCH_TEXT_CHARS, C.LLM_INPUT_CHARS,
                                      C.REPORT_TEXT_CHARS)])


# --------------------------------------------------------------------------
# step 3: store tables, lookups, joins
# --------------------------------------------------------------------------

def _written(spark, sf, name: str) -> DataFrame:
    """Analyse with responses, persist the analysed frame in the shared
    folder, write one store table from it and read that table back."""
    path = run_dir(spark, f"store-{name}")
    analysed = ST.persist_analysed(
        ST.analyse_files(CP.corpus(spark, sf), CP.responses(spark, sf)), path)
    table = getattr(ST.Store.from_analysed(analysed), name)
    table.write.mode("overwrite").parquet(f"{path}/{name}")
    return spark.read.parquet(f"{path}/{name}")


def q_write_documents(spark, sf):
    return _written(spark, sf, "documents").drop("uploaded_at")


def q_write_parties(spark, sf):
    return ST.child_view(_written(spark, sf, "parties"), "parties")


def q_write_clauses(spark, sf):
    return ST.child_view(_written(spark, sf, "clauses"), "clauses")


def q_write_risks(spark, sf):
    return ST.child_view(_written(spark, sf, "risks"), "risks")


def q_documents_newest_first(spark, sf):
    return ST.documents_newest_first(_rules_store(spark, sf).documents)


def _ids(store):
    return store.documents.select("document_id")


def q_document_clauses(spark, sf):
    st = _rules_store(spark, sf)
    return ST.child_view(ST.lookup_children(st.clauses, _ids(st)), "clauses")


def q_document_risks(spark, sf):
    st = _rules_store(spark, sf)
    return ST.child_view(ST.lookup_children(st.risks, _ids(st)), "risks")


def q_document_parties(spark, sf):
    st = _llm_store(spark, sf)
    return ST.child_view(ST.lookup_children(st.parties, _ids(st)), "parties")


def q_documents_clauses(spark, sf):
    st = _rules_store(spark, sf)
    return ST.with_document(ST.child_view(st.clauses, "clauses"), st.documents)


def q_documents_risks(spark, sf):
    st = _rules_store(spark, sf)
    return ST.with_document(st.risks, st.documents)


def q_documents_parties(spark, sf):
    st = _llm_store(spark, sf)
    return ST.with_document(st.parties, st.documents)


def q_nonempty_text(spark, sf):
    return CP.processed(spark, sf).select("document_id", "file_name")


def q_coerce_score(spark, sf):
    ev = load(spark, sf, "events")
    return ev.select("event_id",
                     T.coerce_score(F.col("value").cast("string")).cast("bigint").alias("score_value"),
                     T.coerce_score(F.col("event_type")).cast("bigint").alias("score_type"),
                     T.coerce_score(F.col("props")).cast("bigint").alias("score_props"))


# --------------------------------------------------------------------------
# step 4: search
# --------------------------------------------------------------------------

def q_search_clauses(spark, sf):
    hits = S.hits_of(S.clause_rows(_rules_store(spark, sf).clauses), CP.search_queries(spark))
    return hits.select("query_id", "document_id", "pos", "title", "matched_text")


def q_search_risks(spark, sf):
    hits = S.hits_of(S.risk_rows(_rules_store(spark, sf).risks), CP.search_queries(spark))
    return hits.select("query_id", "document_id", "pos", "title", "matched_text", "severity")


def q_search_raw_text(spark, sf):
    hits = S.hits_of(S.raw_rows(_rules_store(spark, sf).paragraphs), CP.search_queries(spark))
    return hits.select("query_id", "document_id", "pos", "title", "matched_text")


def q_search_all(spark, sf):
    return (S.hits_of(_search_rows(spark, sf), CP.search_queries(spark))
            .select(*S.HIT_COLUMNS).drop("uploaded_at", "area_rank"))


def q_search_top50(spark, sf):
    rows, queries = _search_rows(spark, sf), CP.search_queries(spark)
    keys = S.hit_keys(rows, S.text_patterns(queries))
    return S.top_hits(rows, keys, queries, run_dir(spark, "search-top")).drop("uploaded_at", "area_rank")


def q_search_result_count(spark, sf):
    queries = CP.search_queries(spark)
    keys = S.hit_keys(_search_rows(spark, sf), S.text_patterns(queries))
    return S.result_counts(S.area_counts(keys, queries))


def q_batch_search(spark, sf):
    return _search(spark, sf, CP.search_queries(spark))["areas"]


def q_batch_search_words(spark, sf):
    """As many queries as the benchmark has words: the inverted index of patterns."""
    return _search(spark, sf, CP.word_queries(spark, sf))["areas"]


def q_search_log(spark, sf):
    st = _rules_store(spark, sf)
    path = run_dir(spark, "search-log")
    S.batch_search(st.documents, st.clauses, st.risks, CP.search_queries(spark), run_dir(spark, "search"),
                   paragraphs=st.paragraphs, log_path=path)
    return ST.search_history(spark.read.parquet(path)).select("query_text", "result_count")


# --------------------------------------------------------------------------
# step 5: reports, outcomes, histories
# --------------------------------------------------------------------------

def q_report_documents(spark, sf):
    return RP.report_documents(_rules_store(spark, sf).documents)


def q_report_parties(spark, sf):
    st = _llm_store(spark, sf)
    return RP.report_children(st.parties, st.documents, ["party_name"])


def q_report_clauses(spark, sf):
    st = _rules_store(spark, sf)
    return RP.report_children(st.clauses, st.documents, ["clause_type", "clause_text"])


def q_report_risks(spark, sf):
    st = _rules_store(spark, sf)
    return RP.report_children(st.risks, st.documents, ["risk", "severity", "reason"])


def q_report_raw_text(spark, sf):
    return RP.report_raw_text(_rules_store(spark, sf).documents)


def q_has_documents(spark, sf):
    return RP.has_documents(_rules_store(spark, sf).documents)


def q_processed_count(spark, sf):
    return RP.processed_count(_rules_store(spark, sf).outcomes)


def q_upload_outcomes(spark, sf):
    o = _rules_store(spark, sf).outcomes
    a = lambda f: F.col(f"analysis.{f}")
    return o.select("document_id", "file_name", "status", F.col("risk_score").cast("bigint").alias("risk_score"),
                    "mode", "gcs_path", a("document_type").alias("document_type"),
                    _n(a("key_clauses")).alias("n_clauses"),
                    _joined(a("risks"), "risk").alias("risk_names"),
                    _joined(a("risks"), "severity").alias("severities"))


def q_result_cards(spark, sf):
    return RP.result_cards(_llm_store(spark, sf).outcomes)


def q_upload_log(spark, sf):
    return _rules_store(spark, sf).upload_log.select(
        "document_id", "file_name", "document_type", F.col("risk_score").cast("bigint").alias("risk_score"),
        "mode", "status", "gcs_path", "uploaded_at")


def q_search_history(spark, sf):
    return ST.search_history(CP.search_log_input(spark, sf))


def q_upload_history(spark, sf):
    return ST.upload_history(_rules_store(spark, sf).upload_log).withColumn(
        "risk_score", F.col("risk_score").cast("bigint"))


def q_upper_severity(spark, sf):
    r = _rules_store(spark, sf).risks
    return r.select("document_id", "pos", T.upper_severity("severity").alias("severity_label"))


# --------------------------------------------------------------------------
# step 6: intake over files (the corpus seen as landed files)
# --------------------------------------------------------------------------

def _files(spark, sf):
    return IN.with_ids(CP.corpus_files(spark, sf))


def q_intake_manifest(spark, sf):
    return _files(spark, sf).select("path", "file_name", "document_id", "length")


def q_supported_files(spark, sf):
    return CP.corpus(spark, sf).select("file_name", T.file_suffix("file_name").alias("suffix"),
                                       T.is_supported("file_name").alias("is_supported"))


def q_extraction_route(spark, sf):
    return CP.corpus(spark, sf).select("file_name", IN.route("file_name").alias("route"))


def q_decode_text(spark, sf):
    return CP.corpus_files(spark, sf).select("file_name", IN.decode_text(F.col("content")).alias("text"))


def q_assemble_pages(spark, sf):
    return IN.assemble_pages(CP.page_table(spark, sf))


def q_assemble_blocks(spark, sf):
    return IN.assemble_blocks(CP.block_table(spark, sf))


def q_extraction_fallback(spark, sf):
    return IN.extraction_fallback(CP.extraction_candidates(spark, sf))


def q_extraction_status(spark, sf):
    texts = IN.extract_texts(_files(spark, sf).where(F.col("supported")))
    return texts.select("document_id", "file_name", "route",
                        IN.extraction_status(F.col("text")).alias("status"),
                        F.length("text").cast("bigint").alias("n_chars"))


def q_document_ids(spark, sf):
    return _files(spark, sf).select("path", "document_id")


def q_safe_name(spark, sf):
    return CP.corpus(spark, sf).select("document_id", T.safe_name("document_id", "file_name").alias("safe_name"))


def q_storage_path(spark, sf):
    files = CP.with_status(CP.corpus(spark, sf)).where(F.col("status") != C.STATUS_SKIPPED)
    stored = ST.storage_path(F.col("document_id"), F.col("file_name"), DEMO_BUCKET)
    return files.select("document_id", stored.alias("log_gcs_path"),
                        F.when(F.col("status") == C.STATUS_PROCESSED, stored).alias("doc_gcs_path"))


def q_landing_copy(spark, sf):
    out = IN.landing_copy(_files(spark, sf), run_dir(spark, "landing"))
    return out.select("document_id", "file_name", F.octet_length("content").cast("bigint").alias("n_bytes"))


# --------------------------------------------------------------------------
# step 7: LLM prompts and responses as tables
# --------------------------------------------------------------------------

def _checked(spark, sf):
    return with_response_checks(CP.responses(spark, sf))


def q_analysis_prompts(spark, sf):
    return CP.corpus(spark, sf).select("document_id", R.analysis_prompt(F.col("raw_text")).alias("prompt"))


def q_response_clean(spark, sf):
    return CP.responses(spark, sf).select("document_id", R.clean_response(F.col("response_text")).alias("cleaned"))


def q_response_valid(spark, sf):
    return _checked(spark, sf).select("document_id", F.col("resp_valid").alias("is_valid"),
                                      F.col("resp_error").alias("error_code"))


def q_response_parse(spark, sf):
    c = _checked(spark, sf).where(F.col("resp_valid"))
    f = R.parsed_fields(F.col("resp_v"), F.col("resp_score"))
    return c.select(
        "document_id", f["document_type"].alias("document_type"),
        _joined(f["parties"]).alias("parties"), _n(f["parties"]).alias("n_parties"),
        f["effective_date"].alias("effective_date"), f["expiry_date"].alias("expiry_date"),
        f["contract_value"].alias("contract_value"), f["governing_law"].alias("governing_law"),
        _joined(f["key_clauses"], "clause_type").alias("clause_types"),
        _joined(f["key_clauses"], "clause_text").alias("clause_texts"),
        _n(f["key_clauses"]).alias("n_clauses"),
        _joined(f["risks"], "risk").alias("risk_names"),
        _joined(f["risks"], "severity").alias("severities"),
        _n(f["risks"]).alias("n_risks"),
        f["risk_score"].cast("bigint").alias("risk_score"))


def q_analysis_with_fallback(spark, sf):
    return _flat_analysis(with_analysis(CP.processed(spark, sf), CP.responses(spark, sf)))


# --------------------------------------------------------------------------
# batches committed to one store, the stored search index, early-ending search
# --------------------------------------------------------------------------

def _halves(df: DataFrame) -> list[DataFrame]:
    """A table as two batches that together are the whole of it."""
    half = F.pmod(F.xxhash64("file_name"), F.lit(2))
    return [df.where(half == 0), df.where(half == 1)]


def _appended(spark, sf) -> str:
    """The corpus with its responses committed as two batches, the first one sent twice."""
    path = run_dir(spark, "append-store")
    analysed = ST.persist_analysed(ST.analyse_files(CP.corpus(spark, sf), CP.responses(spark, sf)), path)
    one, two = (ST.Store.from_analysed(part) for part in _halves(analysed))
    for batch, st in (("one", one), ("two", two), ("one", one)):
        st.append(path, batch)
    return path


def q_append_documents(spark, sf):
    return ST.Store.current(spark, _appended(spark, sf)).documents.drop("uploaded_at")


def q_append_clauses(spark, sf):
    return ST.child_view(ST.Store.current(spark, _appended(spark, sf)).clauses, "clauses")


def q_append_log(spark, sf):
    return (ST.Store.current(spark, _appended(spark, sf)).upload_log
            .select("document_id", "file_name", "document_type", F.col("risk_score").cast("bigint").alias("risk_score"),
                    "mode", "status", "gcs_path", "uploaded_at"))


def q_upload_job(spark, sf):
    """Landed files uploaded in two jobs, read back from the store: documents with their outcome."""
    path = run_dir(spark, "uploads")
    for k, files in enumerate(_halves(CP.corpus_files(spark, sf))):
        UP.upload(files, path, f"upload-{k}", index=False)
    docs = ST.Store.current(spark, path).documents
    return docs.select("file_name", "document_type", F.col("risk_score").cast("bigint").alias("risk_score"),
                       "mode", F.length("raw_text").cast("bigint").alias("n_chars"))


def _indexed(spark, sf) -> tuple[SI.SearchIndex, DataFrame]:
    """The searchable rows indexed as two segments, the first one sent twice."""
    rows = _search_rows(spark, sf)
    index = SI.SearchIndex(spark, run_dir(spark, "search-index"))
    one, two = _halves(rows)
    for batch, part in (("one", one), ("two", two), ("one", one)):
        index.add(batch, part)
    return index, rows


def q_indexed_search(spark, sf):
    """Every hit of every query from the stored index (as ``search_all``)."""
    index, rows = _indexed(spark, sf)
    return index.hits(CP.search_queries(spark), rows).drop("uploaded_at", "area_rank")


def q_indexed_search_words(spark, sf):
    """Counts of as many queries as the benchmark has words, from a merged index (as ``batch_search_words``)."""
    index, _ = _indexed(spark, sf)
    index.merge("merged")
    return index.counts(CP.word_queries(spark, sf))


# The corpus has a document a second: slices of two minutes stand for days.
CORPUS_SLICE_SECONDS = 120


def q_newest_top50(spark, sf):
    """The first 50 hits of each query from rows stored by upload time (as ``search_top50``)."""
    path = run_dir(spark, "rows-by-time")
    write_by_time(_search_rows(spark, sf), path, CORPUS_SLICE_SECONDS)
    return NewestFirst(spark, path).top(CP.search_queries(spark)).drop("uploaded_at", "area_rank")


def _published(spark, store: ST.Store, children: str) -> B.Published:
    return B.publish(store, run_dir(spark, "published"), buckets=8, children=[children])


def q_bucketed_clauses(spark, sf):
    return _published(spark, _rules_store(spark, sf), "clauses").with_documents("clauses")


def q_bucketed_risks(spark, sf):
    return _published(spark, _rules_store(spark, sf), "risks").with_documents("risks")


def q_bucketed_parties(spark, sf):
    return _published(spark, _llm_store(spark, sf), "parties").with_documents("parties")


def q_newest_document_clauses(spark, sf):
    """The clauses of the document uploaded last, read from its bucket."""
    published = _published(spark, _rules_store(spark, sf), "clauses")
    newest = published.documents.select("document_id", "uploaded_at").orderBy(F.col("uploaded_at").desc(), "document_id").first()
    return published.children("clauses", newest.document_id if newest else "")


# Rows of a numbered sheet here: small, so that the corpus fills several.
CORPUS_SHEET_ROWS = 500


def q_numbered_documents(spark, sf):
    """The documents sheet, newest first, in sheets of a fixed number of rows with row numbers."""
    docs = _rules_store(spark, sf).documents.select("document_id", "file_name", "risk_score", "uploaded_at")
    rows = SH.in_sheets(docs, [F.col("uploaded_at").desc(), "document_id"], CORPUS_SHEET_ROWS)
    return rows.select("sheet", "number", "document_id", "file_name", F.col("risk_score").cast("bigint").alias("risk_score"))


def q_numbered_clauses(spark, sf):
    """The clauses sheet in the same manner."""
    clauses = _rules_store(spark, sf).clauses.select("document_id", "file_name", "pos", "clause_type", "uploaded_at")
    rows = SH.in_sheets(clauses, [F.col("uploaded_at").desc(), "document_id", "pos"], CORPUS_SHEET_ROWS)
    return rows.select("sheet", "number", "document_id", "file_name", "clause_type")


def q_landing_round_trip(spark, sf):
    """All supported files landed twice, the second time as other documents, and put together again."""
    store = run_dir(spark, "landing-store")
    files = _files(spark, sf).where("supported").select("document_id", "file_name", "content")
    LD.land(files, store, "first")
    LD.land(files.withColumn("document_id", F.concat("document_id", F.lit("-again"))), store, "second")
    return LD.landed(spark, store).select("document_id", "file_name", F.octet_length("content").cast("bigint").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))


def q_table_rules(spark, sf):
    """Rules as a table: the eight keywords, the two rules for what is missing, and for each word of the
    benchmark that a document has it but not the word after it."""
    word = CP.word_queries(spark, sf).select(F.col("query_text").alias("w"))
    pairs = word.select("w", F.lead("w").over(Window.orderBy("w")).alias("after")).select(
        F.concat(F.lit("pair:"), "w").alias("rule_id"), F.array("w").alias("every"), F.array().cast("array<string>").alias("some"), F.array("after").alias("none"))
    fixed = [(f"has:{k}", [k], [], []) for k in C.CONTRACT_KEYWORDS] + [(f"lacks:{k}", [], [], [k]) for k, *_ in C.RISK_RULES]
    rules = spark.createDataFrame(fixed, "rule_id string, every array<string>, some array<string>, none array<string>").unionByName(pairs)
    return RT.evaluate(CP.corpus(spark, sf), rules)


def q_maintained_history(spark, sf):
    """The search log streamed in several epochs, one of them twice, and counted by day and text."""
    from clausework.streaming import history_stream as H

    root = run_dir(spark, "history")
    CP.search_log_input(spark, sf).repartition(6, "searched_at").write.parquet(f"{root}/log")
    for _ in range(2):  # started again: nothing is new
        H.maintain(spark, f"{root}/log", f"{root}/store", f"{root}/checkpoint", late="3650 days", max_files=2).awaitTermination()
    H.merge(spark, f"{root}/store", "merged")
    return H.history(spark, f"{root}/store")


# --------------------------------------------------------------------------
# whole texts beside the service's cuts; a manifest over real files
# --------------------------------------------------------------------------

def q_report_raw_text_whole(spark, sf):
    return RP.report_raw_text(_rules_store(spark, sf).documents, chars=None)


def q_search_clauses_whole(spark, sf):
    """Clauses searched in their whole texts; the text shown is the stored one."""
    hits = S.hits_of(S.clause_rows(_rules_store(spark, sf).clauses, "clause_text_full"), CP.search_queries(spark))
    return hits.select("query_id", "document_id", "pos", "title", "matched_text")


def q_analysis_prompt_parts(spark, sf):
    parts = R.prompt_parts(CP.corpus(spark, sf))
    return parts.select("document_id", F.col("part").cast("bigint").alias("part"), "prompt")


def q_part_answers(spark, sf):
    """The answers to all parts of every document's prompt, folded into one analysis."""
    prompts = R.prompt_parts(CP.corpus(spark, sf))
    folded = fold_part_answers(prompts, CP.part_answers(spark, sf, prompts))
    named = folded.withColumns({"part_error": F.col("ai_error"), "severities": _joined(F.col("analysis.risks"), "severity")})
    flat = _flat_analysis(named, ["n_parts", "n_used", "part_error", "severities"])
    return flat.drop("mode", "ai_error").withColumnRenamed("part_error", "ai_error")


def q_landed_manifest(spark, sf):
    """The corpus landed as files and read back by its manifest: empty files, which the file
    source does not list, included."""
    folder = run_dir(spark, "landed")
    files = CP.corpus_files(spark, sf)
    CP.land_files(files, folder)
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    root = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toString()
    manifest = files.select(F.concat(F.lit(f"{root}/"), "file_name").alias("path"), "file_name")
    read = IN.read_landing(spark, folder, manifest)
    return read.select("file_name", "length", F.octet_length("content").cast("bigint").alias("n_bytes"))


# --------------------------------------------------------------------------
# step 8: streaming intake
# --------------------------------------------------------------------------

def q_stream_intake(spark, sf):
    from clausework.streaming.intake_stream import stream_corpus_intake
    return stream_corpus_intake(spark, sf)


QUERIES: dict[str, Query] = {
    # step 1
    "split_paragraphs": q_split_paragraphs, "strip_text": q_strip_text,
    "best_paragraph": q_best_paragraph, "clause_title": q_clause_title,
    "keyword_matches": q_keyword_matches, "rule_clauses": q_rule_clauses,
    # step 2
    "rule_risks": q_rule_risks, "risk_score": q_risk_score, "rule_analysis": q_rule_analysis,
    "normalize_analysis": q_normalize_analysis, "lower_fold": q_lower_fold, "prefix_cuts": q_prefix_cuts,
    # step 3
    "write_documents": q_write_documents, "write_parties": q_write_parties,
    "write_clauses": q_write_clauses, "write_risks": q_write_risks,
    "documents_newest_first": q_documents_newest_first,
    "document_clauses": q_document_clauses, "document_risks": q_document_risks,
    "document_parties": q_document_parties,
    "documents_clauses": q_documents_clauses, "documents_risks": q_documents_risks,
    "documents_parties": q_documents_parties,
    "nonempty_text": q_nonempty_text, "coerce_score": q_coerce_score,
    # step 4
    "search_clauses": q_search_clauses, "search_risks": q_search_risks,
    "search_raw_text": q_search_raw_text, "search_all": q_search_all,
    "search_top50": q_search_top50, "search_result_count": q_search_result_count,
    "batch_search": q_batch_search, "batch_search_words": q_batch_search_words, "search_log": q_search_log,
    # step 5
    "report_documents": q_report_documents, "report_parties": q_report_parties,
    "report_clauses": q_report_clauses, "report_risks": q_report_risks,
    "report_raw_text": q_report_raw_text, "has_documents": q_has_documents,
    "processed_count": q_processed_count, "upload_outcomes": q_upload_outcomes,
    "result_cards": q_result_cards, "upload_log": q_upload_log,
    "search_history": q_search_history, "upload_history": q_upload_history,
    "upper_severity": q_upper_severity,
    # step 6
    "intake_manifest": q_intake_manifest, "supported_files": q_supported_files,
    "extraction_route": q_extraction_route, "decode_text": q_decode_text,
    "assemble_pages": q_assemble_pages, "assemble_blocks": q_assemble_blocks,
    "extraction_fallback": q_extraction_fallback, "extraction_status": q_extraction_status,
    "document_ids": q_document_ids, "safe_name": q_safe_name, "storage_path": q_storage_path,
    "landing_copy": q_landing_copy,
    # step 7
    "analysis_prompts": q_analysis_prompts, "response_clean": q_response_clean,
    "response_parse": q_response_parse, "response_valid": q_response_valid,
    "analysis_with_fallback": q_analysis_with_fallback,
    # batches, index, early end
    "append_documents": q_append_documents, "append_clauses": q_append_clauses, "append_log": q_append_log,
    "upload_job": q_upload_job, "indexed_search": q_indexed_search, "indexed_search_words": q_indexed_search_words,
    "newest_top50": q_newest_top50,
    "bucketed_clauses": q_bucketed_clauses, "bucketed_risks": q_bucketed_risks, "bucketed_parties": q_bucketed_parties,
    "newest_document_clauses": q_newest_document_clauses,
    "report_raw_text_whole": q_report_raw_text_whole, "search_clauses_whole": q_search_clauses_whole,
    "analysis_prompt_parts": q_analysis_prompt_parts, "landed_manifest": q_landed_manifest,
    "part_answers": q_part_answers,
    "numbered_documents": q_numbered_documents, "numbered_clauses": q_numbered_clauses, "maintained_history": q_maintained_history,
    "table_rules": q_table_rules, "landing_round_trip": q_landing_round_trip,
    # step 8
    "stream_intake": q_stream_intake,
}
