"""Text rules on known cases, and against a character scanner on fuzzed input."""

import random

from pyspark.sql import functions as F

from clausework.functions import text as T
from conftest import one_col


def scan_paragraphs(text):
    """Paragraphs found by walking over the characters."""
    cuts, begin, i, n = [], 0, 0, len(text)
    while i < n:
        run = i
        while run < n and text[run].isspace():
            run += 1
        if run == i:
            i += 1
            continue
        last_break = text.rfind("\n", i + 1, run)
        if text[i] == "\n" and last_break >= 0:
            cuts.append(text[begin:i])
            begin = i = last_break + 1
        elif i and text[i - 1] == "." and run < n and "A" <= text[run] <= "Z":
            cuts.append(text[begin:i])
            begin = i = run
        else:
            i += 1
    cuts.append(text[begin:])
    return [c.strip() for c in cuts if len(c.strip()) > 20]


def spark_split(spark, texts):
    df = one_col(spark, texts).select(F.col("t"), T.split_paragraphs("t").alias("p"))
    return {r.t: list(r.p) for r in df.collect()}


def test_split_known_cases(spark):
    want = {
        "The lessee keeps the garden tidy.\n \nThe lessor repairs the roof yearly.":
            ["The lessee keeps the garden tidy.", "The lessor repairs the roof yearly."],
        "Goods travel at seller's cost. Risk passes on delivery to the buyer.":
            ["Goods travel at seller's cost.", "Risk passes on delivery to the buyer."],
        "one line\nand its next line stay together": ["one line\nand its next line stay together"],
        "tiny\n\nbut this part is long enough": ["but this part is long enough"],
        "exactly twenty chars": [],
        "": [],
    }
    assert spark_split(spark, list(want)) == want


def _best(spark, text, kw):
    df = one_col(spark, [text]).select(T.split_paragraphs("t").alias("p"))
    df = df.select("p", T.lower_all("p").alias("lp"))
    return df.select(T.best_paragraph("p", "lp", kw).alias("b")).first().b


def test_best_paragraph_is_the_first_that_holds_the_keyword(spark):
    text = "Deliveries arrive by rail only.\n\nLIABILITY ends with the season.\n\nA second liability clause follows."
    assert _best(spark, text, "liability") == "LIABILITY ends with the season."
    assert _best(spark, text, "indemnity") == ""


ALPHABET = (["a", "b", "Z", "Q", ".", ".", " ", "\n", "\n", "\t", "\r", "\x0b", "\x0c", "\x1c", "\x1d",
             "\x1e", "\x1f", "\x85", "\xa0", " ", "　", " ", "​", "é", "x" * 25]
            + ["Lorem ipsum dolor sit"])


def fuzz_strings(n, seed=7):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 40))) for _ in range(n)]


def test_split_matches_python_on_fuzz(spark):
    texts = list(dict.fromkeys(fuzz_strings(3000)))
    got = spark_split(spark, texts)
    bad = [t for t in texts if got[t] != scan_paragraphs(t)]
    assert not bad, repr(bad[:3])


def test_strip_matches_python_on_fuzz(spark):
    texts = list(dict.fromkeys(fuzz_strings(2000, seed=11)))
    rows = one_col(spark, texts).select("t", T.strip_ws("t").alias("s")).collect()
    bad = [r.t for r in rows if r.s != r.t.strip()]
    assert not bad, repr(bad[:3])


def test_title_case_matches_python(spark):
    words = ["termination", "governing law", "non-compete", "they're", "1st payment", "ÉTÉ clause",
             "x", "", "mIxEd-CaSe_words"]
    rows = one_col(spark, words).select("t", T.title_case("t").alias("u")).collect()
    assert {r.t: r.u for r in rows} == {w: w.title() for w in words}


def test_prefix_counts_code_points(spark):
    s = "é" * 1500 + "\U0001F600"
    assert one_col(spark, [s]).select(F.length(T.prefix("t", 1000)).alias("n")).first().n == 1000


def test_report_cut_at_30000(spark):
    s = "a" * 30005
    assert one_col(spark, [s]).select(F.length(T.prefix("t", 30000)).alias("n")).first().n == 30000


def test_coerce_score(spark):
    want = {"85": 85, " 85 ": 85, "85.9": 85, "-3.9": -3, "1e2": 100, "abc": None, "": None, "nan": None,
            "1_000": 1000, None: None, "+7": 7, ".5": 0, "0.0": 0}
    rows = one_col(spark, list(want)).select("t", T.coerce_score("t").alias("v")).collect()
    assert {r.t: r.v for r in rows} == want


def test_coerce_score_documented_differences(spark):
    # Java-only number forms are rejected as Python rejects them; values
    # Python accepts but INT cannot hold, and infinities (Python raises), give NULL.
    rows = one_col(spark, ["1d", "1f", "0x10", "inf", "99999999999"]).select(
        "t", T.coerce_score("t").alias("v")).collect()
    assert {r.t: r.v for r in rows} == {"1d": None, "1f": None, "0x10": None, "inf": None,
                                        "99999999999": None}


def test_suffix_and_support(spark):
    names = ["a.pdf", "b.DOCX", "c.Doc", "d.txt", "e.xlsx", "noext", ".txt", "a.b.txt", "a.", "x .TXT", "x/.txt", "a.txt/", "d.pdf/e"]
    rows = one_col(spark, names).select("t", T.is_supported("t").alias("ok")).collect()
    from pathlib import Path
    want = {n: Path(n).suffix.lower() in {".pdf", ".docx", ".doc", ".txt"} for n in names}
    assert {r.t: r.ok for r in rows} == want
