"""File intake.

Files are read with the ``binaryFile`` source: one row per file, split and
scheduled by Spark.  Text assembly from extracted pieces runs natively:

* PDF: a page table ``(document_id, page_no, text)`` -> ordered listagg (S5);
* DOCX: a block table ``(document_id, kind, ord, text)`` -> ordered listagg (S6);
* DOC: extractor attempts ``(document_id, method_rank, ok, text)`` -> first accepted (S7);
* TXT: UTF-8 decode dropping bad bytes, universal newlines, strip (S4).

Byte parsers for PDF/DOCX are optional (import-gated ``mapInPandas`` hooks
that emit page/block tables).  Without them a PDF/DOCX gives no text and the
file fails with "no text", as the service does when its parser raises.
"""

from __future__ import annotations

import os
import re
from typing import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausework import constants as C
from clausework.functions.text import file_suffix, is_supported, strip_ws
from clausework.session import run_dir

ROUTES = {".pdf": "pdf", ".docx": "docx", ".doc": "doc", ".txt": "txt"}


def read_landing(spark: SparkSession, folder: str, manifest: DataFrame | None = None) -> DataFrame:
    """Files under ``folder`` (recursively) as ``path, file_name, mtime_micros, length, content``.

    ``binaryFile`` silently skips 0-byte files and names starting with ``.``
    or ``_`` (T1).  Pass a ``manifest (path, file_name)`` to keep them: only
    listed files are returned, and a listed file the source cannot see reads
    as empty.
    """
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
             .select("path", F.unix_micros("modificationTime").alias("mtime_micros"),
                     "length", "content"))
    if manifest is None:
        return files.withColumn("file_name", F.regexp_extract("path", r"([^/]*)$", 1))
    listed = manifest.select("path", "file_name")
    # a join on the path: the manifest, a row for each file, is never gathered
    # on the driver unless it is below Spark's own broadcast threshold
    present = files.join(listed, "path", "inner")
    # listed files the source cannot see: only paths are compared (the
    # binaryFile scan reads no bytes when no content is selected)
    unseen = (listed.join(files.select("path"), "path", "left_anti")
              .select("path", F.lit(None).cast("bigint").alias("mtime_micros"),
                      F.lit(0).cast("bigint").alias("length"), F.lit(b"").cast("binary").alias("content"),
                      "file_name"))
    return present.unionByName(unseen)


# Entries of a folder, and bytes of files, that a task hands on at a time.
LISTED_ROWS, READ_BYTES = 10_000, 8 << 20


def qualified(spark: SparkSession, folder: str) -> str:
    """A folder as the file source names it (``file:/x``)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def _file_system(root: str):
    """The file system of a qualified folder as tasks use it, and the folder's path there."""
    from pyarrow import fs as pafs

    if root.startswith("file:"):
        return pafs.LocalFileSystem(), re.sub(r"^file:(//)?", "", root)
    return pafs.FileSystem.from_uri(root)


def _is_hidden(name: str) -> bool:
    """Whether the file source passes over a file or folder of this name."""
    if name.startswith(("_common_metadata", "_metadata")):
        return False
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def _entries(fs, folder: str) -> Iterator[tuple[str, bool, int, int]]:
    """``name, is_folder, mtime in ms, length`` of what a folder holds."""
    from pyarrow import fs as pafs

    if isinstance(fs, pafs.LocalFileSystem):  # one at a time, however many there are
        with os.scandir(folder) as found:
            for e in found:
                try:
                    stat = e.stat()
                except FileNotFoundError:  # gone meanwhile
                    continue
                yield e.name, e.is_dir(), stat.st_mtime_ns // 1_000_000, stat.st_size
    else:
        for i in fs.get_file_info(pafs.FileSelector(folder)):
            yield i.base_name, i.type == pafs.FileType.Directory, (i.mtime_ns or 0) // 1_000_000, i.size or 0


def list_landing(spark: SparkSession, folder: str) -> DataFrame:
    """The files that ``binaryFile`` would read under ``folder`` (recursively) as ``path, mtime_micros, length``.

    Folders are listed by tasks, level by level, into a written table: no row per file
    reaches the driver, as it does when the file source lists them.  Hidden and 0-byte files are left out (T1).
    """
    root, out = qualified(spark, folder), run_dir(spark, "listing")

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = _file_system(root)
        columns = ["path", "is_folder", "mtime_micros", "length"]
        for batch in batches:
            for at in batch["folder"]:
                rows = []
                for name, is_folder, mtime, length in _entries(fs, base + at[len(root):]):
                    if not _is_hidden(name) and (is_folder or length > 0):
                        rows.append((f"{at}/{name}", is_folder, mtime * 1000, length))
                    if len(rows) == LISTED_ROWS:
                        yield pd.DataFrame(rows, columns=columns)
                        rows = []
                yield pd.DataFrame(rows, columns=columns)

    schema = "path string, is_folder boolean, mtime_micros long, length long"
    level, depth = spark.createDataFrame([(root,)], "folder string"), 0
    while True:
        level.mapInPandas(listed, schema).write.parquet(f"{out}/depth={depth}")
        folders = spark.read.schema(schema).parquet(f"{out}/depth={depth}").where("is_folder")
        if folders.isEmpty():
            break
        level, depth = folders.select(F.col("path").alias("folder")).repartition("folder"), depth + 1
    return spark.read.schema(schema).parquet(out).where("not is_folder").select("path", "mtime_micros", "length")


def with_content(files: DataFrame, folder: str) -> DataFrame:
    """``files``, listed under ``folder``, with their ``content``: each is opened once, by the task that has its row."""
    root = qualified(files.sparkSession, folder)

    def read(batches):
        import pyarrow as pa

        fs, base = _file_system(root)
        for batch in batches:
            contents, size, start = [], 0, 0
            for k, path in enumerate(batch.column("path").to_pylist(), start=1):
                with fs.open_input_file(base + path[len(root):]) as f:
                    contents.append(f.read())
                size += len(contents[-1])
                if size >= READ_BYTES or k == batch.num_rows:
                    part = batch.slice(start, len(contents))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(contents, pa.binary())], names=[*part.schema.names, "content"])
                    contents, size, start = [], 0, k

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields)
    return files.mapInArrow(read, f"{schema}, content binary")


def document_id(path, mtime_micros, length) -> Column:
    """Stable id per landed file (E8): a UUID-shaped SHA-256 of path, mtime
    and size.  A random UUID would change when a task is retried."""
    h = F.sha2(F.concat_ws("|", path, mtime_micros.cast("string"), length.cast("string")), 256)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4),
                       F.substring(h, 17, 4), F.substring(h, 21, 12))


def route(file_name) -> Column:
    """Extractor route by lower-cased suffix; 'unsupported' otherwise (S3)."""
    suffix = F.lower(file_suffix(file_name))
    out = F.lit("unsupported")
    for ext, name in reversed(list(ROUTES.items())):
        out = F.when(suffix == ext, F.lit(name)).otherwise(out)
    return out


def decode_text(content) -> Column:
    """UTF-8 decode ignoring bad bytes, universal newlines, strip.

    Invalid sequences become U+FFFD under ``make_valid_utf8`` and are then
    dropped; valid input is left untouched.
    """
    raw = content.cast("string")
    fixed = F.when(F.is_valid_utf8(raw), raw).otherwise(
        F.regexp_replace(F.make_valid_utf8(raw), "\ufffd", ""))
    return strip_ws(F.regexp_replace(fixed, "\r\n?", "\n"))


# Pieces concatenated per (document, range) before the per-document step.
ASSEMBLY_RANGE = 1024


def _ordered_concat(df: DataFrame, order_cols: list[str], sep: str) -> DataFrame:
    """Per document, ``text`` values joined by ``sep`` in ``order_cols`` order.

    Two levels: ranges of ASSEMBLY_RANGE pieces are joined first, spread
    over all reducers, so a document holding a third of all pieces does not
    gather every row in one task; the last step joins the ordered partial
    strings (the document's text is one value by definition).
    """
    sep_sql = sep.replace("'", "''")
    order_sql = ", ".join(order_cols)
    ranged = df.withColumn("_range", F.floor(F.col("_seq") / ASSEMBLY_RANGE))
    partial = (ranged.groupBy("document_id", "_range")
               .agg(F.expr(f"listagg(text, '{sep_sql}') WITHIN GROUP (ORDER BY {order_sql})").alias("text")))
    return (partial.groupBy("document_id")
            .agg(F.expr(f"listagg(text, '{sep_sql}') WITHIN GROUP (ORDER BY _range)").alias("text")))


def assemble_pages(pages: DataFrame) -> DataFrame:
    """Page texts in page order, each after ``\\n--- Page n ---\\n``; stripped."""
    piece = F.concat(F.lit(C.PAGE_HEADER_PREFIX), F.col("page_no").cast("string"),
                     F.lit(C.PAGE_HEADER_SUFFIX), F.coalesce("text", F.lit("")))
    staged = pages.select("document_id", "page_no", piece.alias("text"), F.col("page_no").alias("_seq"))
    return (_ordered_concat(staged, ["page_no"], "")
            .select("document_id", strip_ws("text").alias("text")))


def assemble_blocks(blocks: DataFrame) -> DataFrame:
    """Non-blank paragraphs as they are, then non-blank table cells stripped,
    each in order, joined by a blank line (S6)."""
    is_par = F.col("kind") == "paragraph"
    text = F.when(is_par, F.col("text")).otherwise(strip_ws("text"))
    staged = (blocks.where(strip_ws(F.coalesce("text", F.lit(""))) != "")
              .select("document_id", F.when(is_par, 0).otherwise(1).alias("kind_rank"), "ord",
                      text.alias("text")))
    # paragraphs and cells are ranged separately so ranges follow the block order
    staged = staged.withColumn("_seq", F.col("kind_rank") * F.lit(1 << 40) + F.col("ord"))
    return _ordered_concat(staged, ["_seq"], C.BLOCK_SEPARATOR)


def extraction_fallback(candidates: DataFrame) -> DataFrame:
    """First accepted attempt by rank, else '' (S7).

    Rank 1 (converter) counts only when ok and non-blank; later ranks count
    whenever ok, even when empty.  Texts are stripped.
    """
    accepted = F.col("ok") & ((F.col("method_rank") != 1) | (strip_ws(F.coalesce("text", F.lit(""))) != ""))
    return (candidates.groupBy("document_id")
            .agg(F.min_by(F.when(accepted, strip_ws(F.coalesce("text", F.lit("")))),
                          F.when(accepted, F.col("method_rank"))).alias("text"))
            .select("document_id", F.coalesce("text", F.lit("")).alias("text")))


def _pdf_pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    try:
        import fitz  # optional
    except ImportError:
        fitz = None
    for pdf in batches:
        rows = []
        for doc_id, content in zip(pdf["document_id"], pdf["content"]):
            if fitz is None:
                continue
            try:
                with fitz.open(stream=bytes(content), filetype="pdf") as doc:
                    for i, page in enumerate(doc, start=1):
                        rows.append((doc_id, i, page.get_text()))
            except Exception:  # unreadable file: no pages, hence no text
                continue
        yield pd.DataFrame(rows, columns=["document_id", "page_no", "text"])


def _docx_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    try:
        import io

        import docx  # optional
    except ImportError:
        docx = None
    for pdf in batches:
        rows = []
        for doc_id, content in zip(pdf["document_id"], pdf["content"]):
            if docx is None:
                continue
            try:
                d = docx.Document(io.BytesIO(bytes(content)))
                for i, para in enumerate(d.paragraphs):
                    rows.append((doc_id, "paragraph", i, para.text))
                k = 0
                for table in d.tables:
                    for row in table.rows:
                        for cell in row.cells:
                            rows.append((doc_id, "cell", k, cell.text))
                            k += 1
            except Exception:
                continue
        yield pd.DataFrame(rows, columns=["document_id", "kind", "ord", "text"])


def extract_texts(files: DataFrame) -> DataFrame:
    """Text per landed file (S3-S8): ``document_id, file_name, route, text``.

    TXT and DOC decode natively (DOC falls through to the raw read when no
    converter is installed); PDF and DOCX bytes go through the optional
    parser hooks into page/block tables, assembled natively.  A file whose
    extraction yields nothing gets ''.
    """
    staged = files.withColumn("route", route("file_name"))
    meta = ["document_id", "file_name", "route", "path", "mtime_micros", "length"]
    is_binary = F.col("route").isin("pdf", "docx")
    # TXT, DOC and unsupported rows: one narrow projection, no shuffle
    inline = staged.where(~is_binary).select(
        *meta, F.when(F.col("route").isin("txt", "doc"), decode_text(F.col("content")))
        .otherwise(F.lit("")).alias("text"))
    binary = staged.where(is_binary)
    pages = binary.where(F.col("route") == "pdf").select("document_id", "content").mapInPandas(
        _pdf_pages, "document_id string, page_no int, text string")
    blocks = binary.where(F.col("route") == "docx").select("document_id", "content").mapInPandas(
        _docx_blocks, "document_id string, kind string, ord int, text string")
    texts = assemble_pages(pages).unionByName(assemble_blocks(blocks))
    assembled = (binary.select(*meta).join(texts, "document_id", "left")
                 .withColumn("text", F.coalesce("text", F.lit(""))))
    return inline.unionByName(assembled)


def extraction_status(text) -> Column:
    """'failed' when no text was extracted, else 'processed' (S8)."""
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit(C.STATUS_FAILED)).otherwise(F.lit(C.STATUS_PROCESSED))


def with_ids(files: DataFrame) -> DataFrame:
    """Add ``document_id`` (E8) and ``supported`` (S2) to landed files."""
    return (files.withColumn("document_id", document_id(F.col("path"), F.col("mtime_micros"), F.col("length")))
            .withColumn("supported", is_supported("file_name")))


def landing_copy(files: DataFrame, path: str) -> DataFrame:
    """Keep raw bytes of supported files under their ids (K9); returns the written table."""
    out = files.where(F.col("supported")).select("document_id", "file_name", "content")
    out.write.mode("overwrite").parquet(path)
    return files.sparkSession.read.parquet(path)
