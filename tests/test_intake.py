"""File intake from disk (S1-S8, T1) and the streaming intake."""

import os

from pyspark.sql import functions as F

from clausework.sources import intake as IN
from clausework.streaming.intake_stream import start_intake_stream


def make_files(root):
    os.makedirs(os.path.join(root, "nested"), exist_ok=True)
    files = {
        "bad.txt": b"Termination \xff\xfeapplies.\r\nGoverning law: here.\r\n",
        "empty.txt": b"",
        "UPPER.TXT": b"  Payment is due.  ",
        "tool.exe": b"MZ",
        "noext": b"text",
        ".txt": b"hidden",
        "_x.txt": b"underscore",
        "a b#c.txt": b"space and hash",
        "nested/deep.doc": b"Old word file as text",
        "scan.pdf": b"%PDF-not really",
    }
    for name, data in files.items():
        with open(os.path.join(root, name), "wb") as f:
            f.write(data)
    return files


def test_binary_file_source_and_manifest(spark, tmp_path):
    root = str(tmp_path / "landing")
    make_files(root)
    plain = IN.read_landing(spark, root)
    names = {r.file_name for r in plain.collect()}
    # the file source drops 0-byte files and hidden/underscore names
    assert "empty.txt" not in names and ".txt" not in names and "_x.txt" not in names
    assert {"bad.txt", "UPPER.TXT", "a b#c.txt", "deep.doc"} <= names
    base = "file:" + root
    manifest = spark.createDataFrame(
        [(f"{base}/empty.txt", "empty.txt"), (f"{base}/bad.txt", "bad.txt")], "path string, file_name string")
    kept = {r.file_name: r.length for r in IN.read_landing(spark, root, manifest).collect()}
    assert kept == {"empty.txt": 0, "bad.txt": len(b"Termination \xff\xfeapplies.\r\nGoverning law: here.\r\n")}


def test_extraction_and_status(spark, tmp_path):
    root = str(tmp_path / "landing2")
    make_files(root)
    files = IN.with_ids(IN.read_landing(spark, root))
    texts = {r.file_name: r for r in IN.extract_texts(files.where(F.col("supported"))).collect()}
    # bad bytes dropped, CRLF -> LF, stripped
    assert texts["bad.txt"].text == "Termination applies.\nGoverning law: here."
    assert texts["UPPER.TXT"].text == "Payment is due."
    assert texts["deep.doc"].route == "doc" and texts["deep.doc"].text == "Old word file as text"
    assert texts["scan.pdf"].text == ""  # no parser, or not a PDF: no text -> failed
    status = {r.file_name: r.s for r in IN.extract_texts(files.where(F.col("supported")))
              .select("file_name", IN.extraction_status(F.col("text")).alias("s")).collect()}
    assert status["scan.pdf"] == "failed" and status["bad.txt"] == "processed"
    assert "tool.exe" not in texts and "noext" not in texts
    ids = [r.document_id for r in files.collect()]
    assert len(set(ids)) == len(ids)
    # ids are stable across reads
    again = {r.path: r.document_id for r in IN.with_ids(IN.read_landing(spark, root)).collect()}
    assert again == {r.path: r.document_id for r in files.collect()}


def test_assemble_and_fallback(spark):
    pages = spark.createDataFrame([("d", 2, "second"), ("d", 1, " first ")], "document_id string, page_no int, text string")
    assert IN.assemble_pages(pages).first().text == "--- Page 1 ---\n first \n--- Page 2 ---\nsecond"
    blocks = spark.createDataFrame([("d", "cell", 0, " c1 "), ("d", "paragraph", 1, " p2"), ("d", "paragraph", 0, "p1"),
                                    ("d", "cell", 1, "   ")], "document_id string, kind string, ord int, text string")
    assert IN.assemble_blocks(blocks).first().text == "p1\n\n p2\n\nc1"
    cand = spark.createDataFrame([("a", 1, True, "  "), ("a", 2, True, ""), ("a", 3, True, "raw"),
                                  ("b", 1, False, "x"), ("b", 2, False, "y"), ("b", 3, True, " z "),
                                  ("c", 1, False, "x")], "document_id string, method_rank int, ok boolean, text string")
    got = {r.document_id: r.text for r in IN.extraction_fallback(cand).collect()}
    assert got == {"a": "", "b": "z", "c": ""}


def test_stream_intake_reads_new_files_only(spark, tmp_path):
    landing, store, ckpt = (str(tmp_path / n) for n in ("in", "store", "ckpt"))
    os.makedirs(landing)
    with open(os.path.join(landing, "one.txt"), "w") as f:
        f.write("Termination applies on notice. Governing law is local.")
    start_intake_stream(spark, landing, store, ckpt).awaitTermination()
    assert spark.read.parquet(store + "/documents").count() == 1
    with open(os.path.join(landing, "two.txt"), "w") as f:
        f.write("Payment is due monthly in full always.")
    start_intake_stream(spark, landing, store, ckpt).awaitTermination()
    docs = spark.read.parquet(store + "/documents")
    assert sorted(r.file_name for r in docs.collect()) == ["one.txt", "two.txt"]
    scores = {r.file_name: r.risk_score for r in docs.collect()}
    assert scores == {"one.txt": 100, "two.txt": 60}


def test_a_manifest_is_not_gathered_by_a_hint(spark, tmp_path):
    """no broadcast is asked for, so Spark's threshold bounds what reaches the driver."""
    (tmp_path / "a.txt").write_text("text")
    (tmp_path / "empty.txt").write_text("")
    manifest = spark.createDataFrame([(f"file:{tmp_path}/{n}", n) for n in ("a.txt", "empty.txt", "gone.txt")], "path string, file_name string")
    read = IN.read_landing(spark, str(tmp_path), manifest)
    assert sorted((r.file_name, r.length) for r in read.collect()) == [("a.txt", 4), ("empty.txt", 0), ("gone.txt", 0)]
    assert "broadcast" not in read._jdf.queryExecution().analyzed().toString().lower()
