"""LLM responses as data (R4-R7): prompt export, cleaning, strict parsing.

A response is accepted only when the whole text is one JSON object and
every known field has the type the analysis schema wants.  Presence, JSON
null and type are told apart through VARIANT: a missing field is SQL NULL,
a JSON null has variant type VOID.

Everything is a native expression, the check that the whole text parses
included (``parse_strict``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausework import constants as C
from clausework.functions.text import prefix, strip_ws

# Integer text accepted by Python int(): optional sign, digit groups joined by single underscores.
_INT_TEXT = r"(?U)^\s*[+-]?[0-9]+(_[0-9]+)*\s*$"
_STRING_FIELDS = ["document_type", "effective_date", "expiry_date", "contract_value", "governing_law"]
_CLAUSE_FIELDS = ["clause_type", "clause_text"]
_RISK_FIELDS = ["risk", "severity", "reason"]


def sealed_items(text: Column) -> Column:
    """A text as the first item of an array whose second item is the text's SHA-256, parsed (see ``parse_strict``)."""
    return F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit(',"'), F.sha2(text, 256), F.lit('"]'))), "$", "array<variant>")


def unsealed(items: Column, text: Column) -> Column:
    """The value before the seal, where the array holds it and the seal alone."""
    sealed = (F.size(items) == 2) & (F.try_variant_get(F.get(items, 1), "$", "string") == F.sha2(text, 256))
    return F.when(sealed, F.get(items, 0))


def parse_strict(text: Column) -> Column:
    """The one JSON value that makes up a whole text, as a variant; else NULL.

    Spark's JSON parsers accept text after the first value.  So the text is
    parsed as the first item of an array whose second and last item is the
    text's SHA-256: text that follows the value, closes the array or adds
    items leaves no such array, and no text holds its own SHA-256.
    """
    return unsealed(sealed_items(text), text)


def analysis_prompt(raw_text) -> Column:
    """Prompt for one document: our template + the first 12,000 characters."""
    return F.concat(F.lit(C.PROMPT_TEMPLATE), prefix(F.coalesce(raw_text, F.lit("")), C.LLM_INPUT_CHARS))


def prompt_parts(documents: DataFrame, id_col: str = "document_id", text_col: str = "raw_text") -> DataFrame:
    """``id_col, part, prompt`` over the whole text: part 0 is ``analysis_prompt``, each
    further one has the next 12,000 characters; an empty text has part 0 only."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(C.LLM_INPUT_CHARS))
    parts = F.transform(starts, lambda s: F.concat(F.lit(C.PROMPT_TEMPLATE), text.substr(s + 1, F.lit(C.LLM_INPUT_CHARS))))
    return documents.select(id_col, F.posexplode(parts).alias("part", "prompt"))


def clean_response(text) -> Column:
    """Strip, drop every fence marker in order, strip again."""
    out = strip_ws(text)
    for marker in C.FENCE_MARKERS:
        out = F.replace(out, F.lit(marker), F.lit(""))
    return strip_ws(out)


def _vget(v, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def _vtype(x) -> Column:
    return F.schema_of_variant(x)


# The known fields of a response.
FIELDS = [*_STRING_FIELDS, "parties", "key_clauses", "risks", "risk_score"]


def field_values(v) -> dict[str, Column]:
    """The known fields of a parsed response as variants, NULL where missing."""
    return {f: _vget(v, f"$.{f}") for f in FIELDS}


def _string_or_missing(x, t) -> Column:
    return x.isNull() | (t == "STRING")


def _items_ok(x, t, item_fields: list[str]) -> Column:
    """A list of objects whose known fields are strings; or something that
    iterates to nothing in Python ('' or {}); or missing."""
    arr = F.try_variant_get(x, "$", "array<variant>")

    def elem_ok(e):
        ok = _vtype(e).startswith("OBJECT<")
        for f in item_fields:
            ok = ok & _string_or_missing(_vget(e, f"$.{f}"), _vtype(_vget(e, f"$.{f}")))
        return ok

    empty_iterable = (t == "OBJECT<>") | ((t == "STRING") & (F.try_variant_get(x, "$", "string") == ""))
    return x.isNull() | empty_iterable | (t.startswith("ARRAY<") & F.forall(arr, elem_ok))


def _parties_ok(x, t) -> Column:
    arr = F.try_variant_get(x, "$", "array<variant>")
    return x.isNull() | (t.startswith("ARRAY<") & F.forall(arr, lambda e: _vtype(e) == "STRING"))


def response_score(sv, st) -> Column:
    """``int(risk_score)`` with Python rules: missing 0; integers as is;
    fractions truncated toward zero; booleans 1/0; integer text parsed;
    anything else NULL (rejects the response)."""
    text = F.try_variant_get(sv, "$", "string")
    return (F.when(sv.isNull(), F.lit(0).cast("bigint"))
            .when(st.isin("BIGINT", "INT", "SMALLINT", "TINYINT"), F.try_variant_get(sv, "$", "bigint"))
            .when(st.startswith("DECIMAL") | st.isin("DOUBLE", "FLOAT"),
                  F.try_variant_get(sv, "$", "double").try_cast("bigint"))
            .when(st == "BOOLEAN",
                  F.when(F.try_variant_get(sv, "$", "boolean"), F.lit(1)).otherwise(F.lit(0)).cast("bigint"))
            .when((st == "STRING") & text.rlike(_INT_TEXT),
                  F.regexp_replace(strip_ws(text), "_", "").try_cast("bigint")))


def response_checks(v, values: dict[str, Column] | None = None, types: dict[str, Column] | None = None) -> dict[str, Column]:
    """Columns describing one cleaned response, given its parsed variant
    ``v`` (``parse_strict``): validity, error code and score.

    ``v`` and, where given, the ``values`` of its fields (``field_values``) and
    their ``types`` should be columns computed once: every check reads them.
    """
    x = values or field_values(v)
    t = types or {f: _vtype(c) for f, c in x.items()}
    parsed = v.isNotNull()
    is_object = _vtype(v).startswith("OBJECT<")
    fields_ok = (_parties_ok(x["parties"], t["parties"]) & _items_ok(x["key_clauses"], t["key_clauses"], _CLAUSE_FIELDS)
                 & _items_ok(x["risks"], t["risks"], _RISK_FIELDS))
    for f in _STRING_FIELDS:
        fields_ok = fields_ok & _string_or_missing(x[f], t[f])
    score = response_score(x["risk_score"], t["risk_score"])
    valid = parsed & is_object & F.coalesce(fields_ok, F.lit(False)) & score.isNotNull()
    error = (F.when(~parsed, F.lit(C.ERR_INVALID_JSON))
             .when(~valid, F.lit(C.ERR_SCHEMA))
             .otherwise(F.lit("")))
    return {"valid": valid, "error": error, "score": score}


def _items(v, field: str, item_fields: list[str]) -> Column:
    arr = F.try_variant_get(v, f"$.{field}", "array<variant>")
    conv = F.transform(arr, lambda e: F.struct(*[
        F.coalesce(F.try_variant_get(e, f"$.{f}", "string"), F.lit("")).alias(f) for f in item_fields]))
    return F.coalesce(conv, F.array().cast(
        "array<struct<" + ",".join(f"{f}:string" for f in item_fields) + ">>"))


def parsed_fields(v, score) -> dict[str, Column]:
    """Analysis fields read from an accepted response; defaults for missing ones."""
    out = {f: F.coalesce(F.try_variant_get(v, f"$.{f}", "string"), F.lit("")) for f in _STRING_FIELDS}
    out["parties"] = F.coalesce(F.try_variant_get(v, "$.parties", "array<string>"),
                                F.array().cast("array<string>"))
    out["key_clauses"] = _items(v, "key_clauses", _CLAUSE_FIELDS)
    out["risks"] = _items(v, "risks", _RISK_FIELDS)
    out["risk_score"] = score
    return out
