"""DuckDB oracle SQL for the named queries.

Written independently of the Spark plans: DuckDB's RE2 has no look-behind
and its ``\\s`` lacks ``\\v``, so paragraph splitting uses an explicit
white-space class and two replacement passes (SURVEY T3).  Input views:
``documents``, ``events``, ``conversations`` (pre-registered by the driver).
"""

from __future__ import annotations

from clausework import constants as C

# Python str white space: ASCII controls, space, U+001C..U+001F, Unicode spaces.
W = (r"[\t\n\x0b\f\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}"
     r"\x{202f}\x{205f}\x{3000}]")


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{W}+|{W}+$', '', 'g')"


def split(x: str) -> str:
    marked = f"regexp_replace(coalesce({x}, ''), '\\n{W}*\\n', chr(1), 'g')"
    marked = f"regexp_replace({marked}, '\\.{W}+([A-Z])', '.' || chr(1) || '\\1', 'g')"
    chunks = f"list_transform(string_split({marked}, chr(1)), lambda c: {strip('c')})"
    return f"list_filter({chunks}, lambda c: length(c) > {C.MIN_PARAGRAPH_CHARS})"


def _additions() -> str:
    parts = []
    for m, r, text, times in C.CORPUS_ADDITIONS:
        add = lit(text) if times == 1 else f"repeat({lit(text)}, {times})"
        parts.append(f"(CASE WHEN doc_id % {m} = {r} THEN chr(10) || chr(10) || {add} ELSE '' END)")
    return " || ".join(parts)


_EXT = "[" + ", ".join(lit(e) for e in C.CORPUS_EXTENSIONS) + "]"
_SUPPORTED = ", ".join(lit(e) for e in C.SUPPORTED_EXTENSIONS)
_KW = ", ".join(f"({i}, {lit(k)}, {lit(k.title())})" for i, k in enumerate(C.CONTRACT_KEYWORDS))
_RR = ", ".join(f"({i}, {lit(k)}, {lit(r)}, {lit(s)}, {lit(e)})" for i, (k, r, s, e) in enumerate(C.RISK_RULES))
_Q = ", ".join(f"({i}, {lit(t)})" for i, t in C.SEARCH_FIXTURE)
_RESP = ", ".join(f"({i}, {lit(t)})" for i, t in enumerate(C.RESPONSE_FIXTURE))

BASE = f"""
corpus AS (
  SELECT CAST(doc_id AS VARCHAR) AS document_id,
         source || '_' || CAST(doc_id AS VARCHAR) || ({_EXT})[doc_id % 6 + 1] AS file_name,
         TIMESTAMP '{C.CORPUS_EPOCH}' + to_seconds(doc_id) AS uploaded_at,
         CASE WHEN doc_id % {C.CORPUS_EMPTY_MODULUS} = 0 THEN ''
              ELSE coalesce(text, '') || {_additions()} END AS raw_text,
         doc_id
  FROM documents),
files AS (
  SELECT *, regexp_extract(file_name, '(?s)^.+(\\.[^.]+)$', 1) AS suffix FROM corpus),
outcome AS (
  SELECT *, CASE WHEN lower(suffix) NOT IN ({_SUPPORTED}) THEN 'skipped'
                 WHEN raw_text = '' THEN 'failed' ELSE 'processed' END AS status FROM files),
processed AS (SELECT * FROM outcome WHERE status = 'processed'),
kw AS (SELECT * FROM (VALUES {_KW}) t(k_ord, keyword, clause_type)),
rr AS (SELECT * FROM (VALUES {_RR}) t(r_ord, keyword, risk, severity, reason)),
paras AS (
  SELECT document_id, file_name, uploaded_at, unnest(p) AS paragraph, unnest(range(len(p))) AS pos
  FROM (SELECT *, {split('raw_text')} AS p FROM processed)),
kwm AS (
  SELECT d.document_id, k.k_ord, k.keyword, k.clause_type
  FROM processed d JOIN kw k ON contains(lower(d.raw_text), k.keyword)),
best AS (
  SELECT p.document_id, k.keyword, arg_min(p.paragraph, p.pos) AS para
  FROM paras p JOIN kw k ON contains(lower(p.paragraph), k.keyword) GROUP BY 1, 2),
rclauses AS (
  SELECT m.document_id,
         row_number() OVER (PARTITION BY m.document_id ORDER BY m.k_ord) - 1 AS pos,
         m.clause_type, coalesce(substring(b.para, 1, {C.CLAUSE_TEXT_CHARS}), '') AS clause_text
  FROM kwm m LEFT JOIN best b ON b.document_id = m.document_id AND b.keyword = m.keyword),
rrisks AS (
  SELECT d.document_id, row_number() OVER (PARTITION BY d.document_id ORDER BY r.r_ord) - 1 AS pos,
         r.risk, r.severity, r.reason
  FROM processed d JOIN rr r ON NOT contains(lower(d.raw_text), r.keyword)),
ragg AS (
  SELECT d.document_id,
         coalesce((SELECT string_agg(c.clause_type, '|' ORDER BY c.pos) FROM rclauses c WHERE c.document_id = d.document_id), '') AS clause_types,
         (SELECT count(*) FROM rclauses c WHERE c.document_id = d.document_id) AS n_clauses,
         coalesce((SELECT string_agg(r.risk, '|' ORDER BY r.pos) FROM rrisks r WHERE r.document_id = d.document_id), '') AS risk_names,
         coalesce((SELECT string_agg(r.severity, '|' ORDER BY r.pos) FROM rrisks r WHERE r.document_id = d.document_id), '') AS severities,
         (SELECT count(*) FROM rrisks r WHERE r.document_id = d.document_id) AS n_risks
  FROM processed d),
rdocs AS (
  SELECT d.document_id, d.file_name, 'contract' AS document_type, '' AS effective_date, '' AS expiry_date,
         '' AS contract_value, '' AS governing_law,
         CAST(greatest(0, {C.SCORE_BASE} - {C.SCORE_STEP} * a.n_risks) AS BIGINT) AS risk_score,
         'mock_analysis' AS mode, '' AS gcs_path, d.raw_text, d.uploaded_at
  FROM processed d JOIN ragg a USING (document_id)),
q AS (SELECT CAST(query_id AS BIGINT) AS query_id, query_text, lower(query_text) AS lq
      FROM (VALUES {_Q}) t(query_id, query_text)),
chits AS (
  SELECT q.query_id, c.document_id, c.pos, 'Clause' AS match_area, 1 AS area_rank,
         c.clause_type AS title, c.clause_text AS matched_text, CAST(NULL AS VARCHAR) AS severity
  FROM rclauses c JOIN q ON contains(lower(coalesce(c.clause_type, '')), q.lq)
                          OR contains(lower(coalesce(c.clause_text, '')), q.lq)),
rhits AS (
  SELECT q.query_id, r.document_id, r.pos, 'Risk' AS match_area, 2 AS area_rank,
         r.risk AS title, r.reason AS matched_text, r.severity
  FROM rrisks r JOIN q ON contains(lower(coalesce(r.risk, 'None') || ' ' || coalesce(r.severity, 'None')
                                        || ' ' || coalesce(r.reason, 'None')), q.lq)),
phits AS (
  SELECT q.query_id, p.document_id, p.pos, 'Raw Text' AS match_area, 3 AS area_rank,
         'Text Match' AS title, substring(p.paragraph, 1, {C.SEARCH_TEXT_CHARS}) AS matched_text,
         CAST(NULL AS VARCHAR) AS severity
  FROM paras p JOIN q ON contains(lower(p.paragraph), q.lq)),
hits AS (
  SELECT h.*, d.file_name, d.uploaded_at
  FROM (SELECT * FROM chits UNION ALL SELECT * FROM rhits UNION ALL SELECT * FROM phits) h
  JOIN processed d USING (document_id)),
counts AS (
  SELECT q.query_id, q.query_text, CAST(count(h.query_id) AS BIGINT) AS result_count
  FROM q LEFT JOIN hits h ON h.query_id = q.query_id GROUP BY 1, 2),
resp AS (
  SELECT c.document_id, r.response_text
  FROM corpus c JOIN (VALUES {_RESP}) r(remainder, response_text) ON c.doc_id % {C.RESPONSE_MODULUS} = r.remainder),
rclean AS (
  SELECT document_id, response_text,
         {strip(f"replace(replace({strip('response_text')}, '```json', ''), '```', '')")} AS j
  FROM resp),
rtyped AS (
  SELECT *, json_valid(j) AS parsed, json_type(jj) AS top,
         json_type(jj, '$.parties') AS t_parties, json_type(jj, '$.key_clauses') AS t_clauses,
         json_type(jj, '$.risks') AS t_risks, json_type(jj, '$.risk_score') AS t_score
  FROM (SELECT *, CASE WHEN json_valid(j) THEN j END AS jj FROM rclean)),
rchk AS (
  SELECT *,
    CASE WHEN NOT parsed THEN NULL
         WHEN t_score IS NULL THEN 0
         WHEN t_score IN ('BIGINT', 'UBIGINT') THEN TRY_CAST(json_extract(jj, '$.risk_score') AS BIGINT)
         WHEN t_score = 'DOUBLE' THEN TRY_CAST(trunc(CAST(json_extract(jj, '$.risk_score') AS DOUBLE)) AS BIGINT)
         WHEN t_score = 'BOOLEAN' THEN CASE WHEN CAST(json_extract(jj, '$.risk_score') AS BOOLEAN) THEN 1 ELSE 0 END
         WHEN t_score = 'VARCHAR' AND regexp_full_match(json_extract_string(jj, '$.risk_score'), '{W}*[+-]?[0-9]+(_[0-9]+)*{W}*')
              THEN TRY_CAST(replace({strip("json_extract_string(jj, '$.risk_score')")}, '_', '') AS BIGINT)
    END AS score,
    parsed AND top = 'OBJECT'
      AND coalesce(json_type(jj, '$.document_type'), 'VARCHAR') = 'VARCHAR'
      AND coalesce(json_type(jj, '$.effective_date'), 'VARCHAR') = 'VARCHAR'
      AND coalesce(json_type(jj, '$.expiry_date'), 'VARCHAR') = 'VARCHAR'
      AND coalesce(json_type(jj, '$.contract_value'), 'VARCHAR') = 'VARCHAR'
      AND coalesce(json_type(jj, '$.governing_law'), 'VARCHAR') = 'VARCHAR'
      AND (t_parties IS NULL OR (t_parties = 'ARRAY' AND
           len(list_filter(json_extract(jj, '$.parties[*]'), lambda e: json_type(e) <> 'VARCHAR')) = 0))
      AND (t_clauses IS NULL
           OR (t_clauses = 'OBJECT' AND len(json_keys(jj, '$.key_clauses')) = 0)
           OR (t_clauses = 'VARCHAR' AND json_extract_string(jj, '$.key_clauses') = '')
           OR (t_clauses = 'ARRAY' AND len(list_filter(json_extract(jj, '$.key_clauses[*]'), lambda e: NOT (
                 json_type(e) = 'OBJECT'
                 AND coalesce(json_type(e, '$.clause_type'), 'VARCHAR') = 'VARCHAR'
                 AND coalesce(json_type(e, '$.clause_text'), 'VARCHAR') = 'VARCHAR'))) = 0))
      AND (t_risks IS NULL
           OR (t_risks = 'OBJECT' AND len(json_keys(jj, '$.risks')) = 0)
           OR (t_risks = 'VARCHAR' AND json_extract_string(jj, '$.risks') = '')
           OR (t_risks = 'ARRAY' AND len(list_filter(json_extract(jj, '$.risks[*]'), lambda e: NOT (
                 json_type(e) = 'OBJECT'
                 AND coalesce(json_type(e, '$.risk'), 'VARCHAR') = 'VARCHAR'
                 AND coalesce(json_type(e, '$.severity'), 'VARCHAR') = 'VARCHAR'
                 AND coalesce(json_type(e, '$.reason'), 'VARCHAR') = 'VARCHAR'))) = 0))
      AS fields_ok
  FROM rtyped),
rvalid AS (
  SELECT document_id, j, jj, score,
         coalesce(fields_ok AND score IS NOT NULL, false) AS is_valid,
         CASE WHEN NOT parsed THEN 'INVALID_JSON'
              WHEN coalesce(fields_ok AND score IS NOT NULL, false) THEN ''
              ELSE 'SCHEMA_MISMATCH' END AS error_code
  FROM rchk),
rparsed AS (
  SELECT document_id, j, jj, score,
         coalesce(json_extract_string(jj, '$.document_type'), '') AS document_type,
         CASE WHEN json_type(jj, '$.parties') = 'ARRAY' THEN json_extract_string(jj, '$.parties[*]') ELSE [] END AS parties,
         coalesce(json_extract_string(jj, '$.effective_date'), '') AS effective_date,
         coalesce(json_extract_string(jj, '$.expiry_date'), '') AS expiry_date,
         coalesce(json_extract_string(jj, '$.contract_value'), '') AS contract_value,
         coalesce(json_extract_string(jj, '$.governing_law'), '') AS governing_law,
         CASE WHEN json_type(jj, '$.key_clauses') = 'ARRAY' THEN json_extract(jj, '$.key_clauses[*]') ELSE [] END AS kc,
         CASE WHEN json_type(jj, '$.risks') = 'ARRAY' THEN json_extract(jj, '$.risks[*]') ELSE [] END AS rk
  FROM rvalid WHERE is_valid),
lflat AS (
  SELECT document_id, document_type, array_to_string(parties, '|') AS parties,
         CAST(len(parties) AS BIGINT) AS n_parties, effective_date, expiry_date, contract_value, governing_law,
         array_to_string(list_transform(kc, lambda e: coalesce(json_extract_string(e, '$.clause_type'), '')), '|') AS clause_types,
         array_to_string(list_transform(kc, lambda e: coalesce(json_extract_string(e, '$.clause_text'), '')), '|') AS clause_texts,
         CAST(len(kc) AS BIGINT) AS n_clauses,
         array_to_string(list_transform(rk, lambda e: coalesce(json_extract_string(e, '$.risk'), '')), '|') AS risk_names,
         array_to_string(list_transform(rk, lambda e: coalesce(json_extract_string(e, '$.severity'), '')), '|') AS severities,
         CAST(len(rk) AS BIGINT) AS n_risks, CAST(score AS BIGINT) AS risk_score
  FROM rparsed),
fallback AS (
  SELECT d.document_id, d.file_name, d.raw_text, d.uploaded_at,
         v.is_valid IS NOT NULL AND v.is_valid AS use_llm,
         CASE WHEN v.document_id IS NULL THEN {lit(C.NO_KEY_ERROR)} ELSE v.error_code END AS err
  FROM processed d LEFT JOIN rvalid v USING (document_id)),
final AS (
  SELECT f.document_id, f.file_name, f.raw_text, f.uploaded_at,
         CASE WHEN f.use_llm THEN l.document_type ELSE 'contract' END AS document_type,
         CASE WHEN f.use_llm THEN l.parties ELSE '' END AS parties,
         CASE WHEN f.use_llm THEN l.n_parties ELSE 0 END AS n_parties,
         CASE WHEN f.use_llm THEN l.effective_date ELSE '' END AS effective_date,
         CASE WHEN f.use_llm THEN l.expiry_date ELSE '' END AS expiry_date,
         CASE WHEN f.use_llm THEN l.contract_value ELSE '' END AS contract_value,
         CASE WHEN f.use_llm THEN l.governing_law ELSE '' END AS governing_law,
         CASE WHEN f.use_llm THEN l.clause_types ELSE a.clause_types END AS clause_types,
         CASE WHEN f.use_llm THEN l.n_clauses ELSE a.n_clauses END AS n_clauses,
         CASE WHEN f.use_llm THEN l.risk_names ELSE a.risk_names END AS risk_names,
         CASE WHEN f.use_llm THEN l.severities ELSE a.severities END AS severities,
         CASE WHEN f.use_llm THEN l.n_risks ELSE a.n_risks END AS n_risks,
         CAST(CASE WHEN f.use_llm THEN l.risk_score ELSE greatest(0, {C.SCORE_BASE} - {C.SCORE_STEP} * a.n_risks) END AS BIGINT) AS risk_score,
         CASE WHEN f.use_llm THEN 'groq_analysis' ELSE 'mock_analysis' END AS mode,
         CASE WHEN f.use_llm THEN '' ELSE f.err END AS ai_error
  FROM fallback f JOIN ragg a USING (document_id) LEFT JOIN lflat l USING (document_id)),
lparties AS (
  SELECT document_id, unnest(parties) AS party_name, unnest(range(len(parties))) AS pos
  FROM rparsed),
lclauses AS (
  SELECT document_id, unnest(kc) AS e, unnest(range(len(kc))) AS pos FROM rparsed),
lrisks AS (
  SELECT document_id, unnest(rk) AS e, unnest(range(len(rk))) AS pos FROM rparsed),
ldocs AS (
  SELECT document_id, file_name, document_type, effective_date, expiry_date, contract_value, governing_law,
         CAST(risk_score AS BIGINT) AS risk_score, mode, '' AS gcs_path, raw_text, uploaded_at
  FROM final)
"""


# Pure text operators see every document, not only those that are stored.
ALL_DOCUMENTS = {"split_paragraphs", "best_paragraph", "keyword_matches", "clause_title", "rule_clauses", "rule_risks",
                 "risk_score", "rule_analysis", "analysis_prompts", "analysis_prompt_parts", "table_rules"}


def with_base(body: str, all_documents: bool = False) -> str:
    base = BASE.strip()
    if all_documents:
        base = base.replace("FROM outcome WHERE status = 'processed'", "FROM outcome", 1)
    return "WITH " + base + "\n" + body


def _id_sql(path: str, mtime: str, length: str) -> str:
    h = f"sha256({path} || '|' || CAST({mtime} AS VARCHAR) || '|' || CAST({length} AS VARCHAR))"
    return (f"substring({h}, 1, 8) || '-' || substring({h}, 9, 4) || '-' || substring({h}, 13, 4) || '-' "
            f"|| substring({h}, 17, 4) || '-' || substring({h}, 21, 12)")


_FILE_ID = _id_sql("'landing/' || file_name", f"doc_id * 1000000 + {C.CORPUS_EPOCH_MICROS}", "strlen(raw_text)")
_ROUTE = ("CASE lower(suffix) WHEN '.pdf' THEN 'pdf' WHEN '.docx' THEN 'docx' WHEN '.doc' THEN 'doc' "
          "WHEN '.txt' THEN 'txt' ELSE 'unsupported' END")
_DECODED = strip("regexp_replace(raw_text, '\\r\\n?', chr(10), 'g')")
_TITLE = ("array_to_string(list_transform(string_split(keyword, ''), lambda ch, i: CASE WHEN i > 1 AND "
          "lower(string_split(keyword, '')[i - 1]) <> upper(string_split(keyword, '')[i - 1]) "
          "THEN lower(ch) ELSE upper(ch) END), '')")

ORACLE: dict[str, str] = {
    # step 1
    "split_paragraphs": "SELECT document_id, CAST(pos AS BIGINT) AS pos, paragraph FROM paras",
    "strip_text": f"""SELECT conv_id, turn, {strip('text')} AS stripped, CAST(length(text) AS BIGINT) AS n_before,
                      CAST(length({strip('text')}) AS BIGINT) AS n_after FROM conversations""",
    "lower_fold": "SELECT document_id, lower(raw_text) AS lower_text FROM corpus",
    "best_paragraph": f"""SELECT d.document_id, k.keyword,
                          coalesce(substring(b.para, 1, {C.CLAUSE_TEXT_CHARS}), '') AS best_paragraph
                          FROM processed d CROSS JOIN kw k
                          LEFT JOIN best b ON b.document_id = d.document_id AND b.keyword = k.keyword""",
    "keyword_matches": "SELECT document_id, CAST(k_ord AS BIGINT) AS k_ord, keyword FROM kwm",
    "clause_title": f"SELECT document_id, keyword, {_TITLE} AS clause_type FROM kwm",
    "rule_clauses": "SELECT document_id, CAST(pos AS BIGINT) AS pos, clause_type, clause_text FROM rclauses",
    # step 2
    "rule_risks": "SELECT document_id, CAST(pos AS BIGINT) AS pos, risk, severity, reason FROM rrisks",
    "risk_score": "SELECT document_id, risk_score FROM rdocs",
    "rule_analysis": """SELECT d.document_id, 'contract' AS document_type, '' AS parties, CAST(0 AS BIGINT) AS n_parties,
                        '' AS effective_date, '' AS expiry_date, '' AS contract_value, '' AS governing_law,
                        a.clause_types, CAST(a.n_clauses AS BIGINT) AS n_clauses, a.risk_names,
                        CAST(a.n_risks AS BIGINT) AS n_risks, d.risk_score, 'mock_analysis' AS mode, '' AS ai_error
                        FROM rdocs d JOIN ragg a USING (document_id)""",
    "normalize_analysis": """SELECT d.document_id, d.file_name, 'contract' AS document_type, CAST(0 AS BIGINT) AS n_parties,
                             '' AS effective_date, '' AS expiry_date, '' AS contract_value, '' AS governing_law,
                             CAST(a.n_clauses AS BIGINT) AS n_clauses, CAST(a.n_risks AS BIGINT) AS n_risks,
                             d.risk_score, 'mock_analysis' AS mode, '' AS gcs_path, d.raw_text
                             FROM rdocs d JOIN ragg a USING (document_id)""",
    "prefix_cuts": f"""SELECT document_id, substring(raw_text, 1, {C.CLAUSE_TEXT_CHARS}) AS cut_{C.CLAUSE_TEXT_CHARS},
                       substring(raw_text, 1, {C.SEARCH_TEXT_CHARS}) AS cut_{C.SEARCH_TEXT_CHARS},
                       substring(raw_text, 1, {C.LLM_INPUT_CHARS}) AS cut_{C.LLM_INPUT_CHARS},
                       substring(raw_text, 1, {C.REPORT_TEXT_CHARS}) AS cut_{C.REPORT_TEXT_CHARS} FROM corpus""",
    # step 3 (write_* read back the store built with responses)
    "write_documents": """SELECT document_id, file_name, document_type, effective_date, expiry_date, contract_value,
                          governing_law, CAST(TRY_CAST(risk_score AS INTEGER) AS BIGINT) AS risk_score, mode,
                          gcs_path, raw_text FROM ldocs""",
    "write_parties": """SELECT f.document_id, CAST(p.pos AS BIGINT) AS pos, p.party_name
                        FROM lparties p JOIN final f USING (document_id) WHERE f.mode = 'groq_analysis'""",
    "write_clauses": """SELECT document_id, CAST(pos AS BIGINT) AS pos, clause_type, clause_text FROM (
                          SELECT c.document_id, c.pos, coalesce(json_extract_string(c.e, '$.clause_type'), '') AS clause_type,
                                 coalesce(json_extract_string(c.e, '$.clause_text'), '') AS clause_text
                          FROM lclauses c JOIN final f USING (document_id) WHERE f.mode = 'groq_analysis'
                          UNION ALL
                          SELECT c.document_id, c.pos, c.clause_type, c.clause_text
                          FROM rclauses c JOIN final f USING (document_id) WHERE f.mode = 'mock_analysis')""",
    "write_risks": """SELECT document_id, CAST(pos AS BIGINT) AS pos, risk, severity, reason FROM (
                        SELECT r.document_id, r.pos, coalesce(json_extract_string(r.e, '$.risk'), '') AS risk,
                               coalesce(json_extract_string(r.e, '$.severity'), '') AS severity,
                               coalesce(json_extract_string(r.e, '$.reason'), '') AS reason
                        FROM lrisks r JOIN final f USING (document_id) WHERE f.mode = 'groq_analysis'
                        UNION ALL
                        SELECT r.document_id, r.pos, r.risk, r.severity, r.reason
                        FROM rrisks r JOIN final f USING (document_id) WHERE f.mode = 'mock_analysis')""",
    "documents_newest_first": """SELECT document_id, file_name, document_type, effective_date, expiry_date,
                                 contract_value, governing_law, risk_score, mode, gcs_path, raw_text FROM rdocs""",
    "document_clauses": "SELECT document_id, CAST(pos AS BIGINT) AS pos, clause_type, clause_text FROM rclauses",
    "document_risks": "SELECT document_id, CAST(pos AS BIGINT) AS pos, risk, severity, reason FROM rrisks",
    "document_parties": """SELECT p.document_id, CAST(p.pos AS BIGINT) AS pos, p.party_name
                           FROM lparties p JOIN final f USING (document_id) WHERE f.mode = 'groq_analysis'""",
    "documents_clauses": """SELECT c.document_id, CAST(c.pos AS BIGINT) AS pos, c.clause_type, c.clause_text,
                            d.file_name, d.uploaded_at FROM rclauses c JOIN processed d USING (document_id)""",
    "documents_risks": """SELECT r.document_id, CAST(r.pos AS BIGINT) AS pos, r.risk, r.severity, r.reason,
                          d.file_name, d.uploaded_at FROM rrisks r JOIN processed d USING (document_id)""",
    "documents_parties": """SELECT p.document_id, CAST(p.pos AS BIGINT) AS pos, p.party_name, f.file_name, f.uploaded_at
                            FROM lparties p JOIN final f USING (document_id) WHERE f.mode = 'groq_analysis'""",
    "nonempty_text": "SELECT document_id, file_name FROM processed",
    "coerce_score": """SELECT event_id,
                       TRY_CAST(trunc(TRY_CAST(CAST(value AS VARCHAR) AS DOUBLE)) AS INTEGER)::BIGINT AS score_value,
                       TRY_CAST(trunc(TRY_CAST(event_type AS DOUBLE)) AS INTEGER)::BIGINT AS score_type,
                       TRY_CAST(trunc(TRY_CAST(props AS DOUBLE)) AS INTEGER)::BIGINT AS score_props
                       FROM events""",
    # step 4
    "search_clauses": "SELECT query_id, document_id, CAST(pos AS BIGINT) AS pos, title, matched_text FROM chits",
    "search_risks": "SELECT query_id, document_id, CAST(pos AS BIGINT) AS pos, title, matched_text, severity FROM rhits",
    "search_raw_text": "SELECT query_id, document_id, CAST(pos AS BIGINT) AS pos, title, matched_text FROM phits",
    "search_all": """SELECT query_id, document_id, file_name, match_area, CAST(pos AS BIGINT) AS pos, title,
                     matched_text, severity FROM hits""",
    "search_top50": """SELECT query_id, document_id, file_name, match_area, CAST(pos AS BIGINT) AS pos, title,
                       matched_text, severity, rank FROM (
                         SELECT *, CAST(row_number() OVER (PARTITION BY query_id
                                ORDER BY uploaded_at DESC, document_id, area_rank, pos) AS BIGINT) AS rank
                         FROM hits) WHERE rank <= 50""",
    "search_result_count": "SELECT query_id, query_text, result_count FROM counts",
    "batch_search": """SELECT q.query_id, q.query_text, a.match_area,
                       CAST(count(h.query_id) AS BIGINT) AS hits
                       FROM q CROSS JOIN (VALUES ('Clause'), ('Risk'), ('Raw Text')) a(match_area)
                       LEFT JOIN hits h ON h.query_id = q.query_id AND h.match_area = a.match_area
                       GROUP BY 1, 2, 3""",
    "batch_search_words": """, w AS (
                         SELECT DISTINCT unnest(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+')) AS lq FROM benchmark),
                       areas AS (
                         SELECT 'Clause' AS match_area, lower(coalesce(clause_type, '')) AS t1, lower(coalesce(clause_text, '')) AS t2 FROM rclauses
                         UNION ALL SELECT 'Risk', lower(coalesce(risk, 'None') || ' ' || coalesce(severity, 'None') || ' ' || coalesce(reason, 'None')), '' FROM rrisks
                         UNION ALL SELECT 'Raw Text', lower(paragraph), '' FROM paras),
                       found AS (SELECT w.lq, a.match_area, count(*) AS n FROM areas a JOIN w ON w.lq <> '' AND (contains(a.t1, w.lq) OR contains(a.t2, w.lq)) GROUP BY 1, 2)
                       SELECT w.lq AS query_id, w.lq AS query_text, m.match_area, CAST(coalesce(f.n, 0) AS BIGINT) AS hits
                       FROM w CROSS JOIN (VALUES ('Clause'), ('Risk'), ('Raw Text')) m(match_area)
                       LEFT JOIN found f ON f.lq = w.lq AND f.match_area = m.match_area WHERE w.lq <> ''""",
    "search_log": "SELECT query_text, result_count FROM counts",
    # step 5
    "report_documents": """SELECT document_id, file_name, document_type, effective_date, expiry_date, contract_value,
                           governing_law, risk_score, mode, gcs_path FROM rdocs""",
    "report_parties": """SELECT p.document_id, f.file_name, p.party_name
                         FROM lparties p JOIN final f USING (document_id) WHERE f.mode = 'groq_analysis'""",
    "report_clauses": """SELECT c.document_id, d.file_name, c.clause_type, c.clause_text
                         FROM rclauses c JOIN processed d USING (document_id)""",
    "report_risks": """SELECT r.document_id, d.file_name, r.risk, r.severity, r.reason
                       FROM rrisks r JOIN processed d USING (document_id)""",
    "report_raw_text": f"""SELECT document_id, file_name, substring(raw_text, 1, {C.REPORT_TEXT_CHARS}) AS raw_text
                           FROM processed""",
    "has_documents": "SELECT count(*) > 0 AS has_documents FROM processed",
    "processed_count": """SELECT CAST(count(*) AS BIGINT) AS processed_count,
                          CAST(count(*) FILTER (WHERE status = 'processed') AS BIGINT) AS n_processed,
                          CAST(count(*) FILTER (WHERE status = 'failed') AS BIGINT) AS n_failed,
                          CAST(count(*) FILTER (WHERE status = 'skipped') AS BIGINT) AS n_skipped FROM outcome""",
    "upload_outcomes": f"""SELECT CASE WHEN o.status = 'skipped' THEN '' ELSE o.document_id END AS document_id,
                           o.file_name, o.status, d.risk_score,
                           CASE WHEN o.status = 'processed' THEN 'mock_analysis' ELSE '' END AS mode, '' AS gcs_path,
                           CASE WHEN o.status = 'processed' THEN 'contract' ELSE '' END AS document_type,
                           CAST(coalesce(a.n_clauses, 0) AS BIGINT) AS n_clauses,
                           CASE o.status WHEN 'processed' THEN a.risk_names
                                WHEN 'failed' THEN {lit(C.FAILED_RISK[0])} ELSE {lit(C.SKIPPED_RISK[0])} END AS risk_names,
                           CASE o.status WHEN 'processed' THEN a.severities
                                WHEN 'failed' THEN {lit(C.FAILED_RISK[1])} ELSE {lit(C.SKIPPED_RISK[1])} END AS severities
                           FROM outcome o LEFT JOIN rdocs d USING (document_id) LEFT JOIN ragg a USING (document_id)""",
    "result_cards": f"""SELECT o.document_id AS source_id, o.file_name, o.status,
                        coalesce(CAST(f.risk_score AS VARCHAR), '') || ' / 100' AS score_display,
                        coalesce(f.mode, '') AS mode, coalesce(f.document_type, '') AS document_type,
                        'Not uploaded to GCS' AS gcs_display,
                        CASE WHEN coalesce(f.n_parties, 0) = 0 THEN 'Not detected' ELSE replace(f.parties, '|', chr(10)) END AS parties_display,
                        CASE WHEN coalesce(f.effective_date, '') = '' THEN 'Not detected' ELSE f.effective_date END AS effective_display,
                        CASE WHEN coalesce(f.expiry_date, '') = '' THEN 'Not detected' ELSE f.expiry_date END AS expiry_display,
                        CASE WHEN coalesce(f.contract_value, '') = '' THEN 'Not detected' ELSE f.contract_value END AS value_display,
                        CASE WHEN coalesce(f.governing_law, '') = '' THEN 'Not detected' ELSE f.governing_law END AS law_display,
                        CASE WHEN coalesce(f.n_clauses, 0) = 0 THEN 'No clauses detected.' ELSE replace(f.clause_types, '|', chr(10)) END AS clauses_display,
                        CASE o.status
                          WHEN 'failed' THEN upper({lit(C.FAILED_RISK[1])}) || ' — ' || {lit(C.FAILED_RISK[0])}
                          WHEN 'skipped' THEN upper({lit(C.SKIPPED_RISK[1])}) || ' — ' || {lit(C.SKIPPED_RISK[0])}
                          ELSE CASE WHEN f.n_risks = 0 THEN 'No risks detected.' ELSE f.risk_labels END END AS risks_display,
                        CASE WHEN coalesce(f.n_clauses, 0) = 0 THEN 'No clauses detected.' ELSE f.clause_cards END AS clause_cards,
                        CASE o.status
                          WHEN 'failed' THEN upper({lit(C.FAILED_RISK[1])}) || ' — ' || {lit(C.FAILED_RISK[0])} || chr(10) || {lit(C.FAILED_RISK[2])}
                          WHEN 'skipped' THEN upper({lit(C.SKIPPED_RISK[1])}) || ' — ' || {lit(C.SKIPPED_RISK[0])} || chr(10) || {lit(C.SKIPPED_RISK[2])}
                          ELSE CASE WHEN f.n_risks = 0 THEN 'No risks detected.' ELSE f.risk_cards END END AS risk_cards
                        FROM outcome o LEFT JOIN (
                          SELECT fi.*, CASE WHEN fi.mode = 'groq_analysis'
                                 THEN (SELECT string_agg(upper(coalesce(json_extract_string(r.e, '$.severity'), '')) || ' — '
                                              || coalesce(json_extract_string(r.e, '$.risk'), ''), chr(10) ORDER BY r.pos)
                                       FROM lrisks r WHERE r.document_id = fi.document_id)
                                 ELSE (SELECT string_agg(upper(r.severity) || ' — ' || r.risk, chr(10) ORDER BY r.pos)
                                       FROM rrisks r WHERE r.document_id = fi.document_id) END AS risk_labels,
                                 CASE WHEN fi.mode = 'groq_analysis'
                                 THEN (SELECT string_agg(upper(coalesce(json_extract_string(r.e, '$.severity'), '')) || ' — '
                                              || coalesce(json_extract_string(r.e, '$.risk'), '') || chr(10)
                                              || coalesce(json_extract_string(r.e, '$.reason'), ''), chr(10) || chr(10) ORDER BY r.pos)
                                       FROM lrisks r WHERE r.document_id = fi.document_id)
                                 ELSE (SELECT string_agg(upper(r.severity) || ' — ' || r.risk || chr(10) || r.reason, chr(10) || chr(10) ORDER BY r.pos)
                                       FROM rrisks r WHERE r.document_id = fi.document_id) END AS risk_cards,
                                 CASE WHEN fi.mode = 'groq_analysis'
                                 THEN (SELECT string_agg(coalesce(json_extract_string(c.e, '$.clause_type'), '') || chr(10)
                                              || coalesce(json_extract_string(c.e, '$.clause_text'), ''), chr(10) || chr(10) ORDER BY c.pos)
                                       FROM lclauses c WHERE c.document_id = fi.document_id)
                                 ELSE (SELECT string_agg(c.clause_type || chr(10) || c.clause_text, chr(10) || chr(10) ORDER BY c.pos)
                                       FROM rclauses c WHERE c.document_id = fi.document_id) END AS clause_cards
                          FROM final fi) f USING (document_id)""",
    "upload_log": """SELECT o.document_id, o.file_name,
                     CASE WHEN o.status = 'processed' THEN 'contract' ELSE '' END AS document_type,
                     d.risk_score, CASE WHEN o.status = 'processed' THEN 'mock_analysis' ELSE '' END AS mode,
                     CASE WHEN o.status = 'processed' THEN 'processed' ELSE 'failed_no_text' END AS status,
                     CAST(NULL AS VARCHAR) AS gcs_path, o.uploaded_at
                     FROM outcome o LEFT JOIN rdocs d USING (document_id) WHERE o.status <> 'skipped'""",
    "search_history": """SELECT event_type AS query_text, CAST(floor(value) AS BIGINT) AS result_count,
                         ts AS searched_at FROM events""",
    "upload_history": """SELECT o.document_id, o.file_name,
                         CASE WHEN o.status = 'processed' THEN 'contract' ELSE '' END AS document_type,
                         d.risk_score, CASE WHEN o.status = 'processed' THEN 'mock_analysis' ELSE '' END AS mode,
                         CASE WHEN o.status = 'processed' THEN 'processed' ELSE 'failed_no_text' END AS status,
                         CAST(NULL AS VARCHAR) AS gcs_path, o.uploaded_at
                         FROM outcome o LEFT JOIN rdocs d USING (document_id) WHERE o.status <> 'skipped'""",
    "upper_severity": "SELECT document_id, CAST(pos AS BIGINT) AS pos, upper(severity) AS severity_label FROM rrisks",
    # step 6
    "intake_manifest": f"""SELECT 'landing/' || file_name AS path, file_name, {_FILE_ID} AS document_id,
                           CAST(strlen(raw_text) AS BIGINT) AS length FROM corpus""",
    "supported_files": f"""SELECT file_name, suffix, lower(suffix) IN ({_SUPPORTED}) AS is_supported FROM files""",
    "extraction_route": f"SELECT file_name, {_ROUTE} AS route FROM files",
    "decode_text": f"SELECT file_name, {_DECODED} AS text FROM corpus",
    "assemble_pages": f"""SELECT CAST(conv_id AS VARCHAR) AS document_id,
                          {strip("string_agg(chr(10) || '--- Page ' || CAST(turn + 1 AS VARCHAR) || ' ---' || chr(10) || coalesce(text, ''), '' ORDER BY turn)")} AS text
                          FROM conversations GROUP BY conv_id""",
    "assemble_blocks": f"""SELECT CAST(conv_id AS VARCHAR) AS document_id,
                           string_agg(CASE WHEN role = 'user' THEN text ELSE {strip('text')} END, chr(10) || chr(10)
                                      ORDER BY CASE WHEN role = 'user' THEN 0 ELSE 1 END, turn) AS text
                           FROM conversations WHERE {strip("coalesce(text, '')")} <> '' GROUP BY conv_id""",
    "extraction_fallback": f"""SELECT document_id, coalesce(arg_min(st, method_rank) FILTER (WHERE accepted), '') AS text
                               FROM (SELECT CAST(conv_id AS VARCHAR) AS document_id, turn + 1 AS method_rank,
                                            ((conv_id + turn + 1) % 3) <> 1
                                              AND (turn + 1 <> 1 OR {strip("CASE WHEN (conv_id + turn + 1) % 3 = 0 THEN '' ELSE coalesce(text, '') END")} <> '') AS accepted,
                                            {strip("CASE WHEN (conv_id + turn + 1) % 3 = 0 THEN '' ELSE coalesce(text, '') END")} AS st
                                     FROM conversations) GROUP BY document_id""",
    "extraction_status": f"""SELECT {_FILE_ID} AS document_id, file_name, {_ROUTE} AS route,
                             CASE WHEN (CASE WHEN {_ROUTE} IN ('txt', 'doc') THEN {_DECODED} ELSE '' END) = ''
                                  THEN 'failed' ELSE 'processed' END AS status,
                             CAST(length(CASE WHEN {_ROUTE} IN ('txt', 'doc') THEN {_DECODED} ELSE '' END) AS BIGINT) AS n_chars
                             FROM files WHERE lower(suffix) IN ({_SUPPORTED})""",
    "document_ids": f"SELECT 'landing/' || file_name AS path, {_FILE_ID} AS document_id FROM corpus",
    "safe_name": "SELECT document_id, document_id || '_' || file_name AS safe_name FROM corpus",
    "storage_path": """SELECT o.document_id,
                       'gs://contract-archive/contracts/' || o.document_id || '_' || o.file_name AS log_gcs_path,
                       CASE WHEN o.status = 'processed'
                            THEN 'gs://contract-archive/contracts/' || o.document_id || '_' || o.file_name END AS doc_gcs_path
                       FROM outcome o WHERE o.status <> 'skipped'""",
    "landing_copy": f"""SELECT {_FILE_ID} AS document_id, file_name, CAST(strlen(raw_text) AS BIGINT) AS n_bytes
                        FROM files WHERE lower(suffix) IN ({_SUPPORTED})""",
    # step 7
    "analysis_prompts": f"""SELECT document_id, {lit(C.PROMPT_TEMPLATE)} || substring(raw_text, 1, {C.LLM_INPUT_CHARS}) AS prompt
                            FROM processed""",
    "response_clean": "SELECT document_id, j AS cleaned FROM rclean",
    "response_valid": "SELECT document_id, is_valid, error_code FROM rvalid",
    "response_parse": """SELECT document_id, document_type, parties, n_parties, effective_date, expiry_date,
                         contract_value, governing_law, clause_types, clause_texts, n_clauses, risk_names,
                         severities, n_risks, risk_score FROM lflat""",
    "stream_intake": f"""SELECT f.file_name, 'contract' AS document_type, d.risk_score, 'mock_analysis' AS mode,
                          CAST(length({_DECODED.replace('raw_text', 'f.raw_text')}) AS BIGINT) AS n_chars
                          FROM rdocs d JOIN files f USING (document_id)
                          WHERE lower(f.suffix) IN ('.txt', '.doc') AND {_DECODED.replace('raw_text', 'f.raw_text')} <> ''""",
    "analysis_with_fallback": """SELECT document_id, document_type, parties, n_parties, effective_date, expiry_date,
                                 contract_value, governing_law, clause_types, n_clauses, risk_names, n_risks,
                                 risk_score, mode, ai_error FROM final""",
}


# The same rows by another way: stored batches, the index, the early-ending search.
ORACLE |= {
    "append_documents": ORACLE["write_documents"], "append_clauses": ORACLE["write_clauses"],
    "indexed_search": ORACLE["search_all"], "indexed_search_words": ORACLE["batch_search_words"],
    "newest_top50": ORACLE["search_top50"], "upload_job": ORACLE["stream_intake"],
    "append_log": """SELECT o.document_id, o.file_name, coalesce(d.document_type, '') AS document_type,
                     CAST(TRY_CAST(d.risk_score AS INTEGER) AS BIGINT) AS risk_score, coalesce(d.mode, '') AS mode,
                     CASE WHEN o.status = 'processed' THEN 'processed' ELSE 'failed_no_text' END AS status,
                     CAST(NULL AS VARCHAR) AS gcs_path, o.uploaded_at
                     FROM outcome o LEFT JOIN ldocs d USING (document_id) WHERE o.status <> 'skipped'""",
    "bucketed_clauses": ORACLE["documents_clauses"], "bucketed_risks": ORACLE["documents_risks"],
    "bucketed_parties": ORACLE["documents_parties"],
    "newest_document_clauses": """SELECT document_id, CAST(pos AS BIGINT) AS pos, clause_type, clause_text FROM rclauses
                                  WHERE document_id = (SELECT document_id FROM processed ORDER BY uploaded_at DESC, document_id LIMIT 1)""",
    "report_raw_text_whole": "SELECT document_id, file_name, raw_text FROM processed",
    "search_clauses_whole": """SELECT q.query_id, c.document_id, CAST(c.pos AS BIGINT) AS pos, c.clause_type AS title, c.clause_text AS matched_text
                               FROM rclauses c JOIN kw k ON k.clause_type = c.clause_type
                               LEFT JOIN best b ON b.document_id = c.document_id AND b.keyword = k.keyword
                               JOIN q ON contains(lower(c.clause_type), q.lq) OR contains(lower(coalesce(b.para, '')), q.lq)""",
    "analysis_prompt_parts": f"""SELECT document_id, CAST(part AS BIGINT) AS part,
                                 {lit(C.PROMPT_TEMPLATE)} || substring(raw_text, part * {C.LLM_INPUT_CHARS} + 1, {C.LLM_INPUT_CHARS}) AS prompt
                                 FROM (SELECT document_id, raw_text, unnest(range(CAST(greatest(1, ceil(length(raw_text) / {C.LLM_INPUT_CHARS}.0)) AS BIGINT))) AS part
                                       FROM processed)""",
    "numbered_documents": """SELECT CAST((number - 1) // 500 AS BIGINT) AS sheet, number, document_id, file_name, risk_score FROM (
                             SELECT row_number() OVER (ORDER BY uploaded_at DESC, document_id) AS number, document_id, file_name, risk_score FROM rdocs)""",
    "numbered_clauses": """SELECT CAST((number - 1) // 500 AS BIGINT) AS sheet, number, document_id, file_name, clause_type FROM (
                           SELECT row_number() OVER (ORDER BY d.uploaded_at DESC, c.document_id, c.pos) AS number, c.document_id, d.file_name, c.clause_type
                           FROM rclauses c JOIN processed d USING (document_id))""",
    "maintained_history": """SELECT CAST(ts AS DATE) AS day, event_type AS query_text, count(*) AS searches,
                             CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS results FROM events GROUP BY 1, 2""",
    "table_rules": """, w AS (
                      SELECT DISTINCT unnest(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+')) AS lq FROM benchmark),
                    n AS (SELECT lq, lead(lq) OVER (ORDER BY lq) AS nxt FROM w WHERE lq <> '')
                    SELECT d.document_id, 'pair:' || lq AS rule_id FROM processed d JOIN n ON contains(lower(d.raw_text), lq)
                      AND NOT contains(lower(d.raw_text), coalesce(nxt, lq || chr(1) || lq))
                    UNION ALL SELECT document_id, 'has:' || keyword FROM kwm
                    UNION ALL SELECT d.document_id, 'lacks:' || r.keyword FROM processed d JOIN rr r ON NOT contains(lower(d.raw_text), r.keyword)""",
    "landing_round_trip": f"""SELECT {_FILE_ID} || again AS document_id, file_name, CAST(strlen(raw_text) AS BIGINT) AS n_bytes, sha256(raw_text) AS sha256
                              FROM files, (VALUES (''), ('-again')) t(again) WHERE lower(suffix) IN ({_SUPPORTED})""",
    "landed_manifest": "SELECT file_name, CAST(strlen(raw_text) AS BIGINT) AS length, CAST(strlen(raw_text) AS BIGINT) AS n_bytes FROM corpus",
}


_PARTS = f"range(CAST(greatest(1, ceil(length(coalesce(raw_text, '')) / {C.LLM_INPUT_CHARS}.0)) AS BIGINT))"
_PART_ANSWERS = f""",
pp AS (SELECT document_id, unnest({_PARTS}) AS part FROM processed),
pv AS (SELECT pp.document_id, pp.part, coalesce(v.is_valid, false) AS ok,
         CASE WHEN v.document_id IS NULL THEN 'PART_MISSING' WHEN NOT v.is_valid THEN v.error_code END AS err,
         p.document_type, p.effective_date, p.expiry_date, p.contract_value, p.governing_law, p.score, p.parties, p.kc, p.rk
       FROM pp LEFT JOIN rvalid v ON v.document_id = pp.document_id || '#' || CAST(pp.part AS VARCHAR)
       LEFT JOIN rparsed p ON p.document_id = v.document_id),
pd AS (SELECT document_id, count(*) AS n_parts, count(*) FILTER (WHERE ok) AS n_used, bool_or(err = 'PART_MISSING') AS missing, arg_min(err, part) FILTER (WHERE err IS NOT NULL) AS err,
         {", ".join(f"coalesce(arg_min({c}, part) FILTER (WHERE {c} <> ''), '') AS {c}" for c in ("document_type", "effective_date", "expiry_date", "contract_value", "governing_law"))},
         min(score) AS risk_score FROM pv GROUP BY 1),
py AS (SELECT document_id, name, min(place) AS place FROM (
         SELECT document_id, part * 100000 + unnest(range(len(parties))) AS place, unnest(parties) AS name FROM pv) GROUP BY 1, 2),
pc AS (SELECT document_id, t, x, min(place) AS place FROM (
         SELECT document_id, place, coalesce(json_extract_string(e, '$.clause_type'), '') AS t, coalesce(json_extract_string(e, '$.clause_text'), '') AS x FROM (
           SELECT document_id, part * 100000 + unnest(range(len(kc))) AS place, unnest(kc) AS e FROM pv)) GROUP BY 1, 2, 3),
pr AS (SELECT document_id, k, min(place) AS place, arg_min(risk, lvl * 1000000000 + place) AS risk, arg_min(severity, lvl * 1000000000 + place) AS severity FROM (
         SELECT *, lower({strip('risk')}) AS k, CASE lower(severity) WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 3 END AS lvl FROM (
           SELECT document_id, place, coalesce(json_extract_string(e, '$.risk'), '') AS risk, coalesce(json_extract_string(e, '$.severity'), '') AS severity FROM (
             SELECT document_id, part * 100000 + unnest(range(len(rk))) AS place, unnest(rk) AS e FROM pv))) GROUP BY 1, 2),
pu AS (SELECT *, n_used = n_parts AS whole FROM pd)
SELECT d.document_id, CAST(n_parts AS BIGINT) AS n_parts, CAST(n_used AS BIGINT) AS n_used, CASE WHEN missing THEN 'PART_MISSING' ELSE coalesce(err, '') END AS ai_error,
  {", ".join(f"CASE WHEN whole THEN d.{c} END AS {c}" for c in ("document_type", "effective_date", "expiry_date", "contract_value", "governing_law"))},
  CASE WHEN whole THEN CAST(risk_score AS BIGINT) END AS risk_score,
  CASE WHEN whole THEN coalesce((SELECT string_agg(name, '|' ORDER BY place) FROM py WHERE py.document_id = d.document_id), '') END AS parties,
  CASE WHEN whole THEN (SELECT count(*) FROM py WHERE py.document_id = d.document_id) END AS n_parties,
  CASE WHEN whole THEN coalesce((SELECT string_agg(t, '|' ORDER BY place) FROM pc WHERE pc.document_id = d.document_id), '') END AS clause_types,
  CASE WHEN whole THEN (SELECT count(*) FROM pc WHERE pc.document_id = d.document_id) END AS n_clauses,
  CASE WHEN whole THEN coalesce((SELECT string_agg(risk, '|' ORDER BY place) FROM pr WHERE pr.document_id = d.document_id), '') END AS risk_names,
  CASE WHEN whole THEN (SELECT count(*) FROM pr WHERE pr.document_id = d.document_id) END AS n_risks,
  CASE WHEN whole THEN coalesce((SELECT string_agg(severity, '|' ORDER BY place) FROM pr WHERE pr.document_id = d.document_id), '') END AS severities
FROM pu d"""


def _part_answers() -> str:
    """The answers of the fixture stand for parts of prompts: ``document_id`` of ``resp`` is ``id#part``."""
    whole = f"SELECT c.document_id, r.response_text\n  FROM corpus c JOIN (VALUES {_RESP}) r(remainder, response_text) ON c.doc_id % {C.RESPONSE_MODULUS} = r.remainder"
    part = (f"SELECT c.document_id || '#' || CAST(c.part AS VARCHAR) AS document_id, r.response_text\n"
            f"  FROM (SELECT document_id, doc_id, unnest({_PARTS}) AS part FROM processed) c "
            f"JOIN (VALUES {_RESP}) r(remainder, response_text) ON (c.doc_id + c.part) % {C.RESPONSE_MODULUS} = r.remainder")
    base = with_base("", all_documents=True)
    if whole not in base:
        raise ValueError("the base SQL has other responses")
    return base.replace(whole, part).rstrip() + _PART_ANSWERS


def oracle_sql() -> dict[str, str]:
    return {k: with_base(v, k in ALL_DOCUMENTS) for k, v in ORACLE.items()} | {"part_answers": _part_answers()}
