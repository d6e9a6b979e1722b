"""DuckDB SQL for those of the operator queries that SQL can express."""

from __future__ import annotations

from clausework.llm import revisits
from clausework.llm.vector_codes import ENTRIES, MAX_COMPONENT, PARTS, ROUNDS, SCALE

_WORDS = {
    "words@1": r"[^\x20\x09-\x0D]+",
    "words@2": r"[^\x20\x09-\x0D!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]",
}


def _op6() -> str:
    bare = "regexp_replace(text, '(?m)^Licensed under [^\\n]*$', '', 'g')"
    counts = " UNION ALL ".join(
        f"SELECT doc_id, source, lang, '{v}' AS tokenizer, len(regexp_extract_all(coalesce(text, ''), '{p}')) AS n, "
        f"len(regexp_extract_all(coalesce({bare}, ''), '{p}')) AS r FROM documents" for v, p in _WORDS.items())
    return f"""
WITH counts AS ({counts}),
bad AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 0),
changes AS (
  SELECT source, lang, tokenizer, 1 AS d, n AS t FROM counts
  UNION ALL SELECT source, lang, tokenizer, -1, -n FROM counts WHERE doc_id IN (SELECT doc_id FROM bad)
  UNION ALL SELECT source, lang, tokenizer, 0, r - n FROM counts
    WHERE doc_id NOT IN (SELECT doc_id FROM bad) AND r <> n)
SELECT source, lang, tokenizer, CAST(sum(d) AS BIGINT) AS n_docs, CAST(sum(t) AS BIGINT) AS n_tokens, count(*) AS n_changes
FROM changes GROUP BY ALL"""


def _op10() -> str:
    names = {"cc": "cache-control", "cl": "content-length", "ct": "content-type", "dt": "date", "et": "etag", "lm": "last-modified", "sv": "server"}
    new = {c: f"coalesce({c}, found.{c})" if n in revisits.PERMITTED else f"found.{c}" for c, n in names.items()}
    lines = lambda values: "concat_ws(chr(10), " + ", ".join(f"'{n}: ' || {values[c]}" for c, n in names.items()) + ")"
    own = {c: c for c in names}
    return f"""
WITH p AS (
  SELECT page_id, coalesce(url, '') AS url, CAST(1700000000 + 37 * coalesce(page_id, 0) AS BIGINT) AS t,
         CAST('0x' || substr(md5(coalesce(url, '')), 1, 7) AS BIGINT) AS pick, '"' || md5(coalesce(html, '')) || '"' AS tag, md5(coalesce(html, '')) AS body,
         CAST(length(html) AS VARCHAR) AS n FROM pages),
r AS (
  SELECT 8 * page_id AS record_id, 'response' AS kind, url, t AS seconds, 'max-age=60' AS cc, n AS cl, 'text/html' AS ct, CAST(t AS VARCHAR) AS dt, tag AS et, CAST(t AS VARCHAR) AS lm, 'a' AS sv FROM p
  UNION ALL SELECT 8 * page_id + 1, 'revisit', url, t + 3600 * (1 + pick % 240), 'max-age=600', NULL, 'text/html', CAST(t + 3600 * (1 + pick % 240) AS VARCHAR), 'W/' || tag, NULL, 'b' FROM p
  UNION ALL SELECT 8 * page_id + 2, 'response', url, t + 864000, NULL, NULL, 'text/html', CAST(t + 864000 AS VARCHAR), '"2-' || body || '"', CAST(t + 777600 AS VARCHAR), NULL FROM p WHERE pick % 3 = 0
  UNION ALL SELECT 8 * page_id + 3, 'revisit', url, t + 1728000, NULL, NULL, 'text/html', CAST(t + 1728000 AS VARCHAR), CASE WHEN pick % 5 <> 0 THEN tag END, CASE WHEN pick % 5 < 2 THEN CAST(t AS VARCHAR) END, NULL FROM p
  UNION ALL SELECT 8 * page_id + 4, 'revisit', url, t - 1000, NULL, NULL, 'text/html', CAST(t - 1000 AS VARCHAR), tag, CAST(t AS VARCHAR), NULL FROM p WHERE pick % 7 = 0),
s AS (SELECT *, regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest FROM r),
u AS (SELECT *, regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), '^(?:www|m)\\.', '')
        || regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '(?:/|\\.html)$', '') AS base,
        regexp_replace(regexp_replace(regexp_extract(rest, '\\?(.*)$', 1), '(^|&){revisits.TRACKING}=[^&]*', '', 'g'), '^&', '') AS q FROM s),
c AS (SELECT *, base || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS canonical_url FROM u),
w AS (SELECT *, last_value(CASE WHEN kind = 'response' THEN struct_pack(record_id := record_id, {", ".join(f"{x} := {x}" for x in names)}) END IGNORE NULLS)
        OVER (PARTITION BY canonical_url ORDER BY seconds, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS found FROM c),
j AS (SELECT *, regexp_replace(found.et, '^[Ww]/', '') = regexp_replace(et, '^[Ww]/', '') AS tags, found.lm = lm AS dates FROM w WHERE kind = 'revisit'),
k AS (SELECT *, CASE WHEN found IS NULL THEN 'no_response' WHEN tags THEN 'resolved' WHEN NOT tags THEN 'mismatch'
        WHEN dates THEN 'resolved' WHEN NOT dates THEN 'mismatch' ELSE 'unchecked' END AS status FROM j)
SELECT CAST(record_id AS BIGINT) AS record_id, canonical_url, CAST(CASE WHEN status <> 'mismatch' THEN found.record_id END AS BIGINT) AS response_id, status,
  CASE WHEN status IN ('resolved', 'unchecked') THEN {lines(new)} ELSE {lines(own)} END AS headers FROM k"""


def _op13() -> str:
    floored = "(s - ((s % n) + n) % n) // n"
    steps = []
    for k in range(ROUNDS + 1):
        steps.append(f"""
d{k} AS MATERIALIZED (
  SELECT p.rn, p.part, e.entry, CAST(sum((p.v - e.v) * (p.v - e.v)) AS BIGINT) AS dist
  FROM pieces p JOIN book{k} e USING (part, pos) GROUP BY ALL),
a{k} AS MATERIALIZED (SELECT rn, part, arg_min(entry, dist * {ENTRIES} + entry) AS entry, min(dist) AS dist FROM d{k} GROUP BY ALL)""")
        if k < ROUNDS:
            steps.append(f"""
book{k + 1} AS MATERIALIZED (
  SELECT part, entry, pos, CAST(CASE WHEN n IS NULL THEN o.v ELSE {floored} END AS BIGINT) AS v
  FROM book{k} o LEFT JOIN (
    SELECT part, entry, pos, CAST(sum(v) AS BIGINT) AS s, count(*) AS n FROM pieces JOIN a{k} USING (rn, part) GROUP BY ALL) USING (part, entry, pos))""")
    last = ROUNDS
    return f"""
WITH valid AS (
  SELECT vec_id, label, list_transform(embedding, lambda c: CAST(floor({SCALE} * CAST(c AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c) AND abs(c) < {MAX_COMPONENT})) = len(embedding)),
numbered AS (SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, x) - 1 AS rn FROM valid),
kept AS MATERIALIZED (SELECT * FROM numbered WHERE len(x) = (SELECT len(x) FROM numbered WHERE rn = 0)),
pieces AS MATERIALIZED (
  SELECT rn, {PARTS} * i // len(x) AS part, i AS pos, x[i + 1] AS v
  FROM (SELECT rn, x, unnest(range(len(x))) AS i FROM kept)),
book0 AS MATERIALIZED (SELECT part, r.entry, pos, v FROM pieces JOIN (
  SELECT rn, row_number() OVER (ORDER BY rn) - 1 AS entry FROM kept ORDER BY rn LIMIT {ENTRIES}) r USING (rn)),{",".join(steps)},
digest AS (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM book{last}),
coded AS (SELECT rn, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(dist) AS BIGINT) AS error FROM a{last} GROUP BY rn)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM kept JOIN coded USING (rn), digest"""


def _op12() -> str:
    return """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part FROM documents),
w AS (SELECT *, string_split_regex(t, '[\\x20\\x09-\\x0D]+') AS raw, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
v AS (SELECT *, list_filter(raw, lambda x: x <> '') AS ws FROM w),
f AS (SELECT doc_id, part,
  CASE WHEN len(ws) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 2 ELSE 0 END
  + CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t) THEN 4 ELSE 0 END
  + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
  + CASE WHEN CASE WHEN doc_id IS NULL THEN least IS NOT NULL ELSE least < doc_id END THEN 16 ELSE 0 END AS mask FROM v),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY 1),
m AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(bad, 0)) AS bad FROM f LEFT JOIN l USING (doc_id) GROUP BY 1, 2),
k AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) t(name, bit)),
o AS (SELECT [a, b, c, x, y] AS names FROM (SELECT k1.name AS a, k2.name AS b, k3.name AS c, k4.name AS x, k5.name AS y
  FROM k k1, k k2, k k3, k k4, k k5) WHERE len(list_distinct([a, b, c, x, y])) = 5),
s AS (SELECT array_to_string(names, '') AS filter_order, i AS step, names[i] AS name,
  coalesce(list_sum(list_transform(names[1:i - 1], lambda x: 1 << (ascii(x) - 65))), 0)::INT AS gone FROM o, (SELECT unnest(range(1, 6)) AS i)),
g AS (SELECT p.part, s.*, k.bit FROM (SELECT DISTINCT part FROM d) p, s JOIN k USING (name)),
r AS (SELECT g.part, g.filter_order, g.step, g.name,
  sum(CASE WHEN mask & gone = 0 AND mask & bit = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & gone = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN mask & gone <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN mask & gone = 0 AND mask & bit <> 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & gone = 0 AND mask & bit <> 0 THEN bad ELSE 0 END) AS toxic_lost
  FROM g JOIN m ON m.part = g.part GROUP BY ALL)
SELECT part, filter_order, CAST(step AS BIGINT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, name) AS BIGINT) AS shapley FROM r"""


ORACLE = {"op6_token_rollups": _op6(), "op10_revisits": _op10(), "op12_filter_audit": _op12(), "op13_ball_kmeans": _op13()}
