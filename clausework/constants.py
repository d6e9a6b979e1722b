"""Fixed values.

Everything in the first block must equal the original service's values for
results to match; it is stated here once, in natural order.  The second block
holds our own fixture definitions (FIXTURES.md), used to derive a contract
corpus from the driver's ``documents`` table.
"""

# --------------------------------------------------------------------------
# FIXED VALUES (must equal the original service)
# --------------------------------------------------------------------------

# Clause keywords, in list order.
CONTRACT_KEYWORDS = [
    "termination", "confidentiality", "payment", "governing law",
    "liability", "indemnity", "security", "arbitration",
]

# Missing-clause risk rules: (keyword whose absence raises the risk, risk, severity, reason).
RISK_RULES = [
    ("termination", "Termination clause may be missing", "high",
     "No termination keyword found."),
    ("governing law", "Governing law clause may be missing", "medium",
     "No governing law keyword found."),
]

# Score: max(0, SCORE_BASE - SCORE_STEP * number_of_risks).
SCORE_BASE = 100
SCORE_STEP = 20

RULES_DOCUMENT_TYPE = "contract"
RULES_MODE = "mock_analysis"
LLM_MODE = "groq_analysis"
NO_KEY_ERROR = "NO GROQ_API_KEY FOUND"

SUPPORTED_EXTENSIONS = [".pdf", ".docx", ".doc", ".txt"]

# Python str white space (str.isspace / str.strip): ASCII controls, space,
# the four separators U+001C..U+001F and the Unicode space characters.
PY_WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
                 "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
                 "\u2028\u2029\u202f\u205f\u3000")

# Paragraph rules.
MIN_PARAGRAPH_CHARS = 20          # keep chunks strictly longer than this
CLAUSE_TEXT_CHARS = 1000          # clause text cut
SEARCH_TEXT_CHARS = 1200          # raw-text hit cut
LLM_INPUT_CHARS = 12000           # prompt text cut
REPORT_TEXT_CHARS = 30000         # report raw-text cut
SEARCH_SHOWN = 50                 # hits shown per search

# Synthetic outcome risks.
SKIPPED_RISK = ("Unsupported file type", "medium", "Supported formats: PDF, DOCX, DOC, TXT")
FAILED_RISK = ("No text extracted", "high", "File may be scanned, image-based, or corrupted.")

# Status values: outcome status, and the status written to the upload log.
STATUS_PROCESSED = "processed"
STATUS_FAILED = "failed"
STATUS_SKIPPED = "skipped"
LOG_STATUS_FAILED = "failed_no_text"

# Search areas, in the order hits are listed for one document.
AREA_CLAUSE, AREA_RISK, AREA_RAW = "Clause", "Risk", "Raw Text"
RAW_HIT_TITLE = "Text Match"

# Result-card display texts.
NOT_DETECTED = "Not detected"
NOT_UPLOADED = "Not uploaded to GCS"
NO_CLAUSES = "No clauses detected."
NO_RISKS = "No risks detected."
SCORE_SUFFIX = " / 100"

# Object store path pieces.
DEFAULT_FOLDER = "contracts"
STORE_SCHEME = "gs://"

# PDF page header: newline, "--- Page n ---", newline, then the page text.
PAGE_HEADER_PREFIX = "\n--- Page "
PAGE_HEADER_SUFFIX = " ---\n"
# DOCX blocks are joined by a blank line.
BLOCK_SEPARATOR = "\n\n"

# Response cleaning: these fence markers are removed, in this order.
FENCE_MARKERS = ["```json", "```"]

# --------------------------------------------------------------------------
# Our own values (not from the original service)
# --------------------------------------------------------------------------

# Prompt wording for exported LLM requests (our own text).
PROMPT_TEMPLATE = (
    "Review the contract below and answer with one JSON object only, no prose and no markdown.\n"
    "Keys: document_type (string), parties (list of strings), effective_date, expiry_date,\n"
    "contract_value, governing_law (strings), key_clauses (list of objects with clause_type\n"
    "and clause_text), risks (list of objects with risk, severity low/medium/high, reason),\n"
    "risk_score (integer 0-100, where 100 is safest).\n\n"
    "Contract:\n"
)

# Stable error codes for a rejected response (the original used exception text).
ERR_INVALID_JSON = "INVALID_JSON"
ERR_SCHEMA = "SCHEMA_MISMATCH"
ERR_PART_MISSING = "PART_MISSING"   # a part of a prompt has no answer
ERR_CALL_FAILED = "CALL_FAILED"

# Derived corpus (FIXTURES.md section 3): extension by doc_id % 6.
CORPUS_EXTENSIONS = [".pdf", ".docx", ".DOC", ".txt", ".xlsx", ""]
CORPUS_EMPTY_MODULUS = 23
CORPUS_EPOCH = "2024-01-01 00:00:00"
CORPUS_EPOCH_MICROS = 1704067200000000
# (modulus, remainder, text, repeat)
CORPUS_ADDITIONS = [
    (2, 0, "Termination requires thirty days written notice.", 1),
    (3, 0, "Confidentiality survives expiry of this agreement.", 1),
    (4, 0, "Payment falls due ten days after each invoice.", 1),
    (5, 0, "Governing law is that of the agreed state.", 1),
    (6, 0, "Liability is capped at the fees paid.", 1),
    (7, 0, "Indemnity covers third party claims only.", 1),
    (8, 0, "Security audits take place every year.", 1),
    (9, 0, "Arbitration replaces court proceedings here.", 1),
    (11, 0, "Payment.", 1),
    (16, 1, "Security controls apply and ", 60),
]

# Search fixture (FIXTURES.md section 4); one text is asked twice.
SEARCH_FIXTURE = [
    (1, "payment"), (2, "tion"), (3, "Governing Law"), (4, "none"),
    (5, "missing high"), (6, "%"), (7, " "), (8, "zzzz"), (9, "payment"),
]

# LLM response fixture (FIXTURES.md section 5), assigned by doc_id % 27;
# remainder 26 has no response.
RESPONSE_MODULUS = 27
RESPONSE_FIXTURE = [
    '{"document_type": "service agreement", "parties": ["Acme Ltd", "Beta LLC"], '
    '"effective_date": "2024-01-01", "expiry_date": "2025-12-31", "contract_value": "USD 10,000", '
    '"governing_law": "England", "key_clauses": [{"clause_type": "Payment", '
    '"clause_text": "Fees are due monthly."}], "risks": [{"risk": "Uncapped liability", '
    '"severity": "high", "reason": "No cap is stated."}], "risk_score": 40}',
    '```json\n{"document_type": "nda", "parties": ["Gamma Inc"], "risk_score": 150}\n```',
    '{}',
    'not json',
    '{"document_type": null}',
    '{"contract_value": 5000}',
    '{"risk_score": "85"}',
    '{"risk_score": "85.5"}',
    '{"risk_score": 85.7}',
    '{"key_clauses": [{"clause_type": "Payment", "note": "extra key"}]}',
    '{"key_clauses": [{"clause_type": 7, "clause_text": "seven"}]}',
    '{"key_clauses": null}',
    '{"risks": {}}',
    '{"risk_score": 10} and some trailing words',
    '[1]',
    '{"parties": ["a", 1]}',
    '{"parties": "abc"}',
    '{"risks": ["x"]}',
    '{"risk_score": null}',
    '{"risk_score": true}',
    '{"key_clauses": ""}',
    '{"key_clauses": []}',
    '{"risks": [{"risk": null, "severity": "low", "reason": "r"}]}',
    '{"mode": "manual", "risk_score": -0.7}',
    '{"parties": []}',
    '{"parties": [null]}',
]
