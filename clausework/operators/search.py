"""Substring search over clauses, risks and raw-text paragraphs.

Many queries run in one job.  The query table is a parameter; each distinct
lowered query text is matched once (``operators.matching``), over the union
of the three areas, and its results go to every query id with that text by
an equi-join, so a text asked by a third of a large log is matched, counted
and ranked once.

* counts (A1) are partial aggregates before the shuffle;
* the top 50 (O2) are ranked on compact hit keys at two levels, salted parts
  of a query first, so a query that hits a third of all rows is no one
  task's work; only the final rows fetch their texts.

``(document_id, area, pos)`` names a searchable row: ``document_id`` is the
store's primary key.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clausework import constants as C
from clausework.functions.arrays import explode_with_pos
from clausework.functions.text import prefix, split_paragraphs
from clausework.operators.matching import Patterns, rows_containing

HIT_COLUMNS = ["query_id", "document_id", "file_name", "uploaded_at", "match_area", "area_rank",
               "pos", "title", "matched_text", "severity"]
AREAS = {1: C.AREA_CLAUSE, 2: C.AREA_RISK, 3: C.AREA_RAW}
# What names a hit of one query text, and what its order needs.
ROW_KEY = ["document_id", "area_rank", "pos"]
# Parts of one query's hits that are ranked apart before they meet.
RANK_SALTS = 64
# Parts of the upload time by whose counts hits are left out before they are sorted.
TIME_PARTS = 1024
_TEXTS = ["_t1", "_t2"]


def paragraph_table(documents: DataFrame) -> DataFrame:
    """Paragraphs of every stored document with their order; the split runs
    once per document, not once per query."""
    return explode_with_pos(documents, ["document_id", "file_name", "uploaded_at"],
                            split_paragraphs("raw_text"), "pos", "paragraph")


def text_patterns(queries: DataFrame) -> Patterns:
    """Each distinct query text once, lowered but not trimmed (a one-space
    query is legal; an empty one is not, as in the service), keyed by itself."""
    return Patterns(queries.select(F.lower("query_text").alias("q")).distinct(), "q", "q")


def risk_text(risk, severity, reason):
    """``"risk severity reason"`` lowered; a NULL field reads as ``None``."""
    none = F.lit("None")
    return F.lower(F.concat_ws(" ", F.coalesce(risk, none), F.coalesce(severity, none),
                               F.coalesce(reason, none)))


def _area(rows: DataFrame, rank: int, title, matched_text, severity, t1, t2) -> DataFrame:
    """Rows of one area in the common shape: what a hit shows and the texts searched."""
    carried = [c for c in ("file_name", "uploaded_at") if c in rows.columns]
    return rows.select("document_id", *carried, F.lit(AREAS[rank]).alias("match_area"),
                       F.lit(rank).alias("area_rank"), F.col("pos").cast("bigint").alias("pos"),
                       title.alias("title"), matched_text.alias("matched_text"),
                       severity.cast("string").alias("severity"), t1.alias("_t1"), t2.cast("string").alias("_t2"))


def clause_rows(clauses: DataFrame, searched: str = "clause_text") -> DataFrame:
    """Clauses, searched in the lowered type and text (P1); ``searched`` may be
    ``clause_text_full``, the text before the service's cut."""
    return _area(clauses, 1, F.col("clause_type"), F.col("clause_text"), F.lit(None),
                 F.lower("clause_type"), F.lower(searched))


def risk_rows(risks: DataFrame) -> DataFrame:
    """Risks, searched in the joined fields, so a match may span two of them."""
    joined = risk_text(F.col("risk"), F.col("severity"), F.col("reason"))
    return _area(risks, 2, F.col("risk"), F.col("reason"), F.col("severity"), joined, F.lit(None))


def raw_rows(paragraphs: DataFrame, shown_chars: int | None = C.SEARCH_TEXT_CHARS) -> DataFrame:
    """Paragraphs, searched whole; the text shown is cut at ``shown_chars`` (None: whole)."""
    shown = F.col("paragraph") if shown_chars is None else prefix(F.col("paragraph"), shown_chars)
    return _area(paragraphs, 3, F.lit(C.RAW_HIT_TITLE), shown, F.lit(None), F.lower("paragraph"), F.lit(None))


def area_rows(documents: DataFrame, clauses: DataFrame, risks: DataFrame, paragraphs: DataFrame | None = None) -> DataFrame:
    """Every searchable row of the three areas (U1), with its document's name and upload time."""
    from clausework.operators.store import with_parent_keys
    paragraphs = paragraph_table(documents) if paragraphs is None else paragraphs
    # child rows carry file name and upload time: no join back to documents
    return (clause_rows(with_parent_keys(clauses, documents))
            .unionByName(risk_rows(with_parent_keys(risks, documents)))
            .unionByName(raw_rows(paragraphs)))


def _query_texts(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", "query_text", F.lower("query_text").alias("q"))


def hits_of(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """Hits of every query over searchable rows, with all that a hit shows."""
    found = rows_containing(rows, _TEXTS, text_patterns(queries)).drop(*_TEXTS)
    return found.join(_query_texts(queries).select("query_id", "q"), "q").drop("q")


def all_hits(documents: DataFrame, clauses: DataFrame, risks: DataFrame, queries: DataFrame,
             paragraphs: DataFrame | None = None) -> DataFrame:
    """Every hit of every query (U1), keyed by ``query_id``."""
    return hits_of(area_rows(documents, clauses, risks, paragraphs), queries).select(*HIT_COLUMNS)


def hit_keys(rows: DataFrame, patterns: Patterns) -> DataFrame:
    """Compact hits per query text ``q``: the row's key and upload time, no text."""
    slim = rows.select(*ROW_KEY, "uploaded_at", *_TEXTS)
    return rows_containing(slim, _TEXTS, patterns).select("q", "uploaded_at", *ROW_KEY)


def hit_order():
    """Service order: newest document first, then Clause, Risk, Raw Text, then position."""
    return [F.col("uploaded_at").desc(), F.col("document_id"), F.col("area_rank"), F.col("pos")]


def top_keys(keys: DataFrame, n: int = C.SEARCH_SHOWN, key: str = "q") -> DataFrame:
    """First ``n`` hit keys per query text in service order, with their rank (O2).

    Ranked first within ``RANK_SALTS`` parts of each text's hits, then over
    the at most ``n`` survivors of each part.
    """
    salted = keys.withColumn("_salt", F.pmod(F.xxhash64(*ROW_KEY), F.lit(RANK_SALTS)))
    part = Window.partitionBy(key, "_salt").orderBy(*hit_order())
    best = salted.withColumn("_r", F.row_number().over(part)).where(F.col("_r") <= n).drop("_r", "_salt")
    whole = Window.partitionBy(key).orderBy(*hit_order())
    return (best.withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= n)
            .withColumn("rank", F.col("rank").cast("bigint")))


def newest_keys(keys: DataFrame, n: int = C.SEARCH_SHOWN) -> DataFrame:
    """The hit keys that can be among the first ``n`` of their query text: those of the newest
    parts of the upload time that hold ``n`` of its hits, so that only these are sorted."""
    # the difference of two times without a zone: no clock change can reorder parts
    second = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', uploaded_at)")
    first, last = keys.agg(F.min(second), F.max(second)).first()
    if first is None:
        return keys
    part = F.coalesce(F.floor((second - first) / F.lit((last - first) // TIME_PARTS + 1)), F.lit(-1))  # no time comes last
    parted = keys.withColumn("_part", part)
    newer = F.sum("count").over(Window.partitionBy("q").orderBy(F.col("_part").desc())) - F.col("count")
    least = (parted.groupBy("q", "_part").count().withColumn("_newer", newer).where(F.col("_newer") < n)
             .groupBy(F.col("q").alias("_q")).agg(F.min("_part").alias("_least")))
    return parted.join(least, (F.col("q") == F.col("_q")) & (F.col("_part") >= F.col("_least"))).select(*keys.columns)


def top_hits(rows: DataFrame, keys: DataFrame, queries: DataFrame, path: str, n: int = C.SEARCH_SHOWN) -> DataFrame:
    """The first ``n`` hits of each query with their texts.

    The ranked keys are written once under ``path``, so the join that fetches
    the texts knows their size: a few are broadcast, many are a shuffle join.
    """
    spark = rows.sparkSession
    top_keys(newest_keys(keys, n), n).drop("uploaded_at").write.mode("overwrite").parquet(f"{path}/top_keys")
    top = spark.read.parquet(f"{path}/top_keys")
    shown = rows.drop(*_TEXTS).join(top, ROW_KEY)
    return shown.join(_query_texts(queries).select("query_id", "q"), "q").select(*HIT_COLUMNS, "rank")


def area_counts(keys: DataFrame, queries: DataFrame) -> DataFrame:
    """Per query and area: hit count (J5 summary); zero rows for all areas."""
    return area_table(keys.groupBy("q", "area_rank").agg(F.count(F.lit(1)).alias("hits")), queries)


def area_table(counts: DataFrame, queries: DataFrame) -> DataFrame:
    """The counts ``q, area_rank, hits`` of query texts as rows of every query and area."""
    areas = F.array(*[F.struct(F.lit(r).alias("area_rank"), F.lit(a).alias("match_area")) for r, a in AREAS.items()])
    grid = _query_texts(queries).select("query_id", "query_text", "q", F.inline(areas))
    return (grid.join(counts, ["q", "area_rank"], "left")
            .select("query_id", "query_text", "match_area",
                    F.coalesce(F.col("hits"), F.lit(0)).cast("bigint").alias("hits")))


def result_counts(areas: DataFrame) -> DataFrame:
    """Hits per query before the display cap (A1) from its counts by area; zero-hit queries give 0."""
    return (areas.groupBy("query_id", "query_text")
            .agg(F.sum("hits").cast("bigint").alias("result_count")))


def batch_search(documents: DataFrame, clauses: DataFrame, risks: DataFrame, queries: DataFrame,
                 path: str, paragraphs: DataFrame | None = None, log_path: str | None = None) -> dict[str, DataFrame]:
    """Many queries in one job (J5), with every output of the service's search.

    One matching pass writes the compact hit keys under ``path`` (a shared
    folder); the counts per area and the first 50 are two concurrent jobs over
    them, and only the first 50 fetch their texts.  With ``log_path`` the
    search logs itself, one row per asked query (K6).
    Outputs: ``areas``, ``counts`` (A1, before the cap) and ``top`` (first 50
    per query, O2).
    """
    spark = documents.sparkSession
    rows = area_rows(documents, clauses, risks, paragraphs)
    hit_keys(rows, text_patterns(queries)).write.mode("overwrite").parquet(f"{path}/hit_keys")
    keys = spark.read.parquet(f"{path}/hit_keys")
    with ThreadPoolExecutor(max_workers=2) as pool:
        counted = pool.submit(area_counts(keys, queries).write.mode("overwrite").parquet, f"{path}/areas")
        top = pool.submit(top_hits, rows, keys, queries, path)
        counted.result()
        top = top.result()
    areas = spark.read.parquet(f"{path}/areas")
    counts = result_counts(areas)
    if log_path is not None:
        from clausework.operators.reports import append_search_log
        append_search_log(counts, log_path)
    return {"counts": counts, "areas": areas, "top": top}
