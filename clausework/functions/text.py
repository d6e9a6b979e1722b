"""Text rules as native Spark column expressions (no UDFs).

Whitespace follows Python ``str`` semantics: Unicode white space plus the
four separators U+001C..U+001F.  Java's ``(?U)\\s`` covers the former, the
explicit range the latter.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clausework import constants as C

_WS = r"[\s\x1c-\x1f]"
# Chunk boundary: a blank line (newline, optional white space, newline), or
# white space between a full stop and an upper-case ASCII letter.
PARAGRAPH_SPLIT = rf"(?U)\n{_WS}*\n|(?<=\.){_WS}+(?=[A-Z])"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c) -> Column:
    """Strip Python white space at both ends (E2): ``trim`` with the exact
    character set (``F.trim`` alone strips spaces only)."""
    return F.trim(_col(c), F.lit(C.PY_WHITESPACE))


def split_paragraphs(c) -> Column:
    """Paragraph chunks, stripped, longer than 20 characters, in order.

    NULL text counts as empty text.
    """
    chunks = F.split(F.coalesce(_col(c), F.lit("")), PARAGRAPH_SPLIT, -1)
    return F.filter(F.transform(chunks, strip_ws),
                    lambda p: F.length(p) > C.MIN_PARAGRAPH_CHARS)


def lower_all(arr) -> Column:
    """Lower-case every element of a string array (E3), once."""
    return F.transform(_col(arr), F.lower)


def first_containing(paragraphs, lowered, keyword: str) -> Column:
    """First paragraph whose lower-case form contains ``keyword`` (O3), or NULL.

    ``lowered`` is ``lower_all(paragraphs)``, computed once per document and
    shared by all keywords.
    """
    idx = F.array_position(F.transform(_col(lowered), lambda p: p.contains(F.lit(keyword))), True)
    return F.when(idx > 0, F.element_at(_col(paragraphs), idx.cast("int")))


def best_paragraph(paragraphs, lowered, keyword: str) -> Column:
    """First paragraph containing the keyword, cut at 1,000; '' if none."""
    keyword = keyword.lower()
    return F.coalesce(prefix(first_containing(paragraphs, lowered, keyword), C.CLAUSE_TEXT_CHARS),
                      F.lit(""))


def prefix(c, n: int) -> Column:
    """First ``n`` code points."""
    return F.substring(_col(c), 1, n)


def title_case(c) -> Column:
    """Python ``str.title``: a cased character after a cased one is lowered,
    every other character upper-cased (E5).

    Differs from ``initcap``, which only restarts words after spaces
    (``Non-Compete`` against ``Non-compete``).
    """
    chars = F.split(_col(c), "", -1)

    def one(ch, i):
        prev = F.element_at(chars, i)  # 1-based: the character before index i
        prev_cased = (i > 0) & (F.lower(prev) != F.upper(prev))
        return F.when(prev_cased, F.lower(ch)).otherwise(F.upper(ch))

    return F.when(_col(c) == "", F.lit("")).otherwise(F.array_join(F.transform(chars, one), ""))


def contains_text(haystack, needle) -> Column:
    """Plain substring test; ``%`` and ``_`` are literal (never LIKE)."""
    return F.contains(_col(haystack), _col(needle) if not isinstance(needle, str) else F.lit(needle))


def coerce_score(c) -> Column:
    """Score text to INT (E9): NULL/'' -> NULL; else truncate a float toward 0.

    Follows Python ``int(float(v))`` where Spark allows: digit-group
    underscores are accepted; Java-only number forms (``1d``, ``1f``, hex)
    are rejected; NaN, infinities and values outside INT give NULL.
    """
    s = strip_ws(_col(c).cast("string"))
    java_only = s.rlike(r"(?i)0x|[df]$")
    parsed = F.regexp_replace(s, r"(?<=[0-9])_(?=[0-9])", "").try_cast("double")
    finite = ~F.isnan(parsed) & (F.abs(parsed) != F.lit(float("inf")))
    # double -> int casting truncates toward zero; try_cast gives NULL outside INT
    return (F.when(s.isNull() | (s == "") | java_only | ~finite, F.lit(None).cast("int"))
            .otherwise(parsed.try_cast("int")))


def safe_name(document_id, file_name) -> Column:
    """``<id>_<file name>``."""
    return F.concat(_col(document_id), F.lit("_"), _col(file_name))


def upper_severity(c) -> Column:
    """Severity upper-cased for display."""
    return F.upper(_col(c))


def file_suffix(name) -> Column:
    """Python ``Path(name).suffix``: the last ``.xxx`` of the last path
    component that has something before it; '' otherwise."""
    return F.regexp_extract(F.regexp_extract(_col(name), r"(?s)([^/]*)/*$", 1), r"(?s)^.+(\.[^.]+)$", 1)


def is_supported(name) -> Column:
    """Supported extension by lower-cased suffix."""
    return F.lower(file_suffix(name)).isin(*C.SUPPORTED_EXTENSIONS)
