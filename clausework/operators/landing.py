"""Content-addressed landing of raw bytes (K9).

A file is cut where its content says so: after a byte at which a rolling hash
of the last ``WINDOW`` bytes ends in ``CUT_BITS`` zero bits, no chunk below
``LEAST`` or above ``MOST`` bytes.  A change moves only the cuts near it, so a file
uploaded again, or with a page changed, has the same chunks elsewhere.  Chunks
are stored once under their SHA-256; a file is the list of its chunks.  A
repeat upload is a new document and stores no bytes.

A batch's new chunks and files become visible in one commit
(``operators.snapshots``).  Chunks are told apart by hash before any bytes are
sent, and a chunk that many files share leaves each task once.  Two batches
at once may both store a chunk; readers take one of them.

Cases: an empty or NULL content has no chunk and is read back empty; a batch that is
sent again stores nothing; files that repeat a document id within a batch are one when
they are equal in name and bytes.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausework.operators.snapshots import Snapshots
from clausework.session import run_dir

WINDOW = 16
CUT_BITS = 13
LEAST, MOST = 2 << 10, 64 << 10
# Bytes whose rolling hashes are made together.
BLOCK = 4 << 20
_FACTOR = 0x9E3779B97F4A7C15
CHUNKS, FILES = "landed_chunks", "landed_files"


def cuts(data: bytes) -> list[int]:
    """Where the chunks of ``data`` end."""
    import numpy as np

    n, ends, start = len(data), [], 0
    powers = [pow(_FACTOR, k + 1, 1 << 64) for k in range(WINDOW)]
    view = np.frombuffer(data, np.uint8)
    for block in range(0, n, BLOCK):
        lead = min(block, WINDOW - 1)
        part = view[block - lead:block + BLOCK].astype(np.uint64)
        rolled = np.zeros(len(part), np.uint64)
        for k, p in enumerate(powers[:len(part)]):
            rolled[k:] += part[:len(part) - k] * np.uint64(p)
        marks = np.flatnonzero((rolled[lead:] >> np.uint64(64 - CUT_BITS)) == 0)
        for end in (marks + block + 1).tolist():
            while end - start > MOST:
                start += MOST
                ends.append(start)
            if end - start >= LEAST:
                ends.append(end)
                start = end
    while n - start > MOST:
        start += MOST
        ends.append(start)
    return ends + [n] if n > start else ends


def _chunked(files: DataFrame) -> DataFrame:
    """A row for each chunk of each file, and one without a chunk for an empty file."""
    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("document_id", pa.string()), ("file_name", pa.string()), ("seq", pa.int32()), ("chunk", pa.string()), ("data", pa.binary())])
        for batch in batches:
            ids, names, contents = batch.columns
            for i in range(batch.num_rows):
                data = contents[i].as_py() or b""
                ends = cuts(data)
                pieces = [data[a:b] for a, b in zip([0, *ends], ends)] or [None]
                hashes = [p if p is None else hashlib.sha256(p).hexdigest() for p in pieces]
                n = len(pieces)
                yield pa.RecordBatch.from_arrays([pa.array([ids[i].as_py()] * n, pa.string()), pa.array([names[i].as_py()] * n, pa.string()),
                                                  pa.array(range(n), pa.int32()), pa.array(hashes, pa.string()), pa.array(pieces, pa.binary())], schema=schema)

    return files.select("document_id", "file_name", "content").mapInArrow(run, "document_id string, file_name string, seq int, chunk string, data binary")


def land(files: DataFrame, store: str, batch: str) -> int | None:
    """Store files (``document_id, file_name, content``) as a batch; its version, or None when it is there already."""
    spark = files.sparkSession
    log = Snapshots(spark, store)
    if batch in log.batches():
        return None
    path = run_dir(spark, "chunks")
    _chunked(files).write.parquet(path)
    rows = spark.read.parquet(path)
    known = log.read(CHUNKS, schema="chunk string, data binary").select("chunk")
    fresh = rows.where("chunk is not null").select("chunk", "data").join(known, "chunk", "left_anti").groupBy("chunk").agg(F.first("data").alias("data"))
    lists = (rows.select("document_id", "file_name", "seq", "chunk").distinct().groupBy("document_id", "file_name")
             .agg(F.sort_array(F.collect_list(F.struct("seq", "chunk"))).alias("c")))
    lists = lists.select("document_id", "file_name", F.filter(F.transform("c", lambda x: x["chunk"]), lambda h: h.isNotNull()).alias("chunks"))
    return log.commit(batch, {CHUNKS: fresh, FILES: lists})


def landed(spark: SparkSession, store: str, version: int | None = None) -> DataFrame:
    """``document_id, file_name, content`` of every file, put together from its chunks."""
    log = Snapshots(spark, store)
    files = log.read(FILES, version).withColumn("n", F.monotonically_increasing_id())
    places = files.select("document_id", "file_name", "n", F.posexplode_outer("chunks").alias("seq", "chunk"))
    data = places.join(log.read(CHUNKS, version), "chunk", "left")
    one = data.groupBy("document_id", "file_name", "n", "seq").agg(F.first("data").alias("data"))
    whole = one.groupBy("document_id", "file_name", "n").agg(F.expr("listagg(data) WITHIN GROUP (ORDER BY seq)").alias("content"))
    return whole.select("document_id", "file_name", F.coalesce("content", F.lit(b"")).alias("content"))
